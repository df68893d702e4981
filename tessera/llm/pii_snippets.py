"""Snippets with known truth for the personal-data selector: templates write values of a kind into contexts where they are
personal data, and look-alikes into contexts where they are not. Whether a value counts comes from its template alone, never from the
features. FOLDS keeps templates apart: trees are grown on the first, thresholds set on the second, the third is for tests.
"""

from __future__ import annotations

import random
import string

FOLDS = ("grow", "calibrate", "test")
_HEX, _B62 = "0123456789abcdef", string.ascii_letters + string.digits


def _some(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def check_digit(digits: str) -> str:
    """The digit that makes digits pass the Luhn test."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _iban(rng: random.Random, good: bool = True) -> str:
    land, size = rng.choice((("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14)))
    body = _some(rng, string.digits, size)
    if land in ("GB", "NL"):
        body = _some(rng, string.ascii_uppercase, 4) + body[4:]
    rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    check = 98 - rest if good else (98 - rest + rng.randint(1, 90)) % 97
    flat = f"{land}{check:02d}{body}"
    return " ".join(flat[i : i + 4] for i in range(0, len(flat), 4)) if rng.random() < 0.6 else flat


def _phone(rng: random.Random) -> str:
    a, b, c = rng.randint(201, 989), rng.randint(200, 999), rng.randint(0, 9999)
    return rng.choice((f"({a}) {b}-{c:04d}", f"{a}-{b}-{c:04d}", f"{a}.{b}.{c:04d}", f"{a} {b} {c:04d}"))


def _mail(rng: random.Random) -> str:
    at, name = rng.choice((" [at] ", "[at]", " (at) ", "(at)")), _some(rng, string.ascii_lowercase, rng.randint(3, 9))
    return f"{name}{rng.choice(('', '.' + name[:3], str(rng.randint(1, 99))))}{at}{_some(rng, string.ascii_lowercase, 7)}.{rng.choice(('com', 'org', 'net', 'de'))}"


def _secret(rng: random.Random) -> str:
    return rng.choice((_some(rng, _HEX, 40), _some(rng, _HEX, 32), _some(rng, _B62, rng.randint(20, 48)), _some(rng, _B62 + "+/_-", rng.randint(24, 64)) + "7a"))


def _placeholder(rng: random.Random) -> str:
    return rng.choice(("your-secret-goes-here", "change-me-before-release", "xxxxxxxxxxxxxxxxxxxx", "0000000000000000", "undefined_value_here", "example-value-only", "see_the_manual_page", "insert-your-key-here", "not-set-in-this-file"))


_NAME = ("token", "secret", "password", "api_key", "apikey", "api-key", "access_key")


def _assigned(rng: random.Random, value: str) -> str:
    quote, sign = rng.choice(("", '"', "'")), rng.choice(("=", ": ", " = ", ":"))
    return f"{rng.choice(_NAME)}{sign}{quote}{value}{quote}"


def _prefixed(rng: random.Random) -> str:
    return rng.choice(("AKIA" + _some(rng, string.ascii_uppercase + string.digits, 16), "ghp_" + _some(rng, _B62, 36), "sk-" + _some(rng, _B62, 32), f"eyJ{_some(rng, _B62, 20)}.{_some(rng, _B62, 40)}.{_some(rng, _B62, 43)}"))


def _ssn(rng: random.Random) -> str:
    return f"{rng.choice((rng.randint(1, 665), rng.randint(667, 899))):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"


def _card13(rng: random.Random, good: bool) -> str:
    body = ("4" if good else rng.choice("12356789")) + _some(rng, string.digits, 11)
    digit = check_digit(body)
    return body + (digit if good else str((int(digit) + rng.randint(1, 9)) % 10))


#: Fixed templates by fold: (kind, whether the value counts, value, contexts). {} stands for the value.
_VALUES = {
    ("phone", True): _phone, ("phone", False): _phone,
    ("card", True): lambda r: _card13(r, True), ("card", False): lambda r: _card13(r, False),
    ("email", True): _mail, ("email", False): lambda r: f"{_some(r, string.ascii_lowercase, 5)} (at) {r.randint(1, 12)}.{r.randint(10, 59)}",
    ("secret", True): lambda r: _assigned(r, _secret(r)) if r.random() < 0.6 else _prefixed(r) if r.random() < 0.9 else "-----BEGIN RSA PRIVATE KEY-----",
    ("secret", False): lambda r: _assigned(r, _placeholder(r)),
    ("iban", True): _iban, ("iban", False): lambda r: _iban(r, False),
    ("id", True): _ssn, ("id", False): lambda r: r.choice((f"000-{r.randint(10, 99)}-{r.randint(1000, 9999)}", f"9{r.randint(10, 99)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", f"{r.randint(100, 600)}-00-{r.randint(1000, 9999)}", _ssn(r))),
    ("ip", False): lambda r: f"{r.randint(1, 9)}.{r.randint(0, 30)}.{r.randint(300, 999)}.{r.randint(256, 9999)}",
}
_CONTEXTS = {
    "phone": {True: ("call me at {} today", "Tel: {}.", "phone {} or", "mobile: {}", "reach us by phone, {}", "my cell is {}"), False: ("part no {} in stock", "order {} has shipped", "sku {} red", "see ticket {} for", "invoice {} of May", "serial {}")},
    "card": {True: ("paid by visa {} on", "card: {}", "my card number {} expires", "charge visa {} please", "credit card {}", "Visa {}"), False: ("ean {} box", "article {} in stock", "barcode {}", "order {} shipped", "serial {} of", "stamp {} ms")},
    "email": {True: ("write to {} for", "mail: {}", "contact {} now", "e-mail {}.", "questions to {}", "author: {}"), False: ("we met {} sharp", "arrived {} by train", "starts {} on", "doors open {}", "closing {}", "lunch {} or so")},
    "secret": {True: ("set {} in the file", "export {}", "with {} you can", "config: {}", "and {} then", "# {}"), False: ("set {} in the file", "export {}", "with {} you can", "config: {}", "and {} then", "# {}")},
    "iban": {True: ("transfer to IBAN {} by", "my account {} at the bank", "IBAN: {}", "pay to {} today", "bank account {}", "iban {}"), False: ("model {} of", "part {} in stock", "article {}", "serial {} and", "product code {}", "ref {}")},
    "id": {True: ("ssn {} on file", "social security number {}", "SSN: {}", "his social security no. {}", "tax id {}", "her ssn is {}"), False: ("part {} in stock", "order {} shipped", "item {}", "model {} of", "product {}", "ref {}")},
    "ip": {False: ("version {} is out", "release {}", "build {} of", "see section {}", "firmware {}", "update to {}")},
}
_PLAIN = ("and then {} was", "of the {} there", "so {}, that")


def snippets(fold: str, each: int = 60, seed: int = 11) -> list[tuple[int, str, str, int, int, bool]]:
    """(id, text, kind, start, end, counts) of each fold: two contexts a kind and truth are its own, and one that says nothing; ends are exclusive."""
    at = FOLDS.index(fold)
    rng, out = random.Random(seed * 10 + at), []
    for (kind, counts), value in _VALUES.items():
        contexts = [*_CONTEXTS[kind][counts][2 * at : 2 * at + 2], *([_PLAIN[at]] if counts or kind == "secret" else [])]
        for k in range(each):
            text, v = contexts[k % len(contexts)], value(rng)
            filler = " ".join(_some(rng, string.ascii_lowercase, rng.randint(2, 7)) for _ in range(4))
            begin = f"{filler} {text[: text.index('{}')]}"
            out.append((len(out), f"{begin}{v}{text[text.index('{}') + 2 :]} {filler}", kind, len(begin), len(begin) + len(v), counts))
    return out
