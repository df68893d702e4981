"""Small documents with every awkward case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import collections
import hashlib
import random
import re

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, unit string, key long, spans string"


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Random documents with copies, near copies, a shared passage, nulls, blanks and a long text; extra columns clash with operators' names."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, base = text(70), text(200)
    docs = [base, base, base.replace("w1 ", "W1  "), " ".join(w if i % 50 else "x" for i, w in enumerate(base.split()))]
    docs += [None, "", " \t\n", "one", "one two three", "One Two  THREE", text(3000), text(30) + "\n" + passage + "\n" + text(40), passage + " tail", "é — ü " + text(20)]
    docs += [" ".join(["same"] * 300), "a b c d e f g h i j " * 12, "mail me: ann@example.org or +1 (555) 010-9999, card 4111 1111 1111 1111, host 10.0.0.255 and 1.2.3.999 #### $$$ &&&"]
    docs += ["Released under the MIT License. Under the MIT license again.", "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0", text(12) + " This work is licensed under the GNU General Public License, version 3."]
    while len(docs) < n:
        docs.append(text(rng.randint(1, 250)))
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), 0.5, "u", i, "x") for i, t in enumerate(docs)]
    return [*out, out[7], (None, "null id " + base, "en", "s0", 1, 0.5, "u", 1, "x")]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text: str | None) -> set:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets: dict[int, set]) -> dict[int, int]:
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def repeats(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    for k, t in sorted(docs):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), k)
    out = {}
    for k, t in docs:
        w = words(t)
        gone: set[int] = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def luhn(text: str) -> bool:
    d = [int(c) for c in re.sub("[^0-9]", "", text)][::-1]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(d)) % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(s)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def personal(text: str | None) -> str:
    found = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m[0]))
    return hashlib.sha256(",".join(f"{n}:{s}:{e}" for s, _, e, n in found).encode()).hexdigest()


LICENSES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def licences(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in LICENSES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def licence_labels(text: str | None) -> set[str]:
    """Labels of templates whose mandatory phrase stands in the text, by a scan of all places; and those of the base."""
    from tessera.llm.license_scan import TEMPLATES

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    stands = lambda p: any(w[i : i + len(p)] == p for i in range(len(w)))
    return {label for label, _, must in TEMPLATES if stands(must.split())} | {label for phrase, label in LICENSES if stands(phrase.split())}


def measured(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    spots = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if spots[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
