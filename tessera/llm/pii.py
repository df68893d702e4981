"""Personal data: candidate spans by high-recall patterns, boosted trees over format and context, calibrated thresholds.
DataFrame functions only on the main path.

Generators propose spans of a kind; they may overlap. Those that pass their kind's base test always count. For the others,
boosted trees decide. They are grown on snippets that templates write (pii_snippets): values that are personal data where they
stand, and look-alikes that aren't, so the truth is not made from the features. Candidates of the snippets are binned into format and
context features, equal vectors are counted, and trees of depth two are grown on the counts. Each kind has a threshold of its own: the
least score at which snippets of other templates reach PRECISION; a kind that never does takes nothing. Trees compile to CASE
expressions, so finding, scoring and choosing is one projection with no shuffle; the fit is made once a process.

Patterns are anchored at the start of their runs and use possessive repeats, so a long run costs linear time; places come
from the lengths between matches, summed in blocks. Defined cases: a null or empty text has no spans; spans count code
points, end exclusive; equal rows get equal results; other columns stay with detect() (one named as its output is renamed
<name>_in) and with redact(); an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import clean_name, make_room
from .pii_snippets import snippets
from .quality import let

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "id")
#: (kind, pattern, base or not). \G keeps leftmost search whole where a match may begin inside a run that another match ended in.
GENERATORS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", True),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True),
    ("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", True),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", True),
    ("phone", r"(?<![0-9+])(?<!\+[0-9]{1,3}[ .-]{1,2})(?<!\+[0-9]{1,3}[ .-]{1,2}\()\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", False),
    ("card", r"(?<![0-9])[0-9]{13}(?![0-9])", False),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", False),
    ("secret", r"(?i)(?<![a-z])(?:token|secret|password|(?:api|access)[_-]?key) ?[=:] ?[\"'][^\"'\s]{8,}+[\"']", False),
    ("secret", r"(?i)(?<![a-z])(?:token|secret|password|(?:api|access)[_-]?key) ?[=:] ?[a-z0-9+/_.-]{12,}+", False),
    ("secret", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)", False),
    ("secret", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", False),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", False),
    ("id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False),
)
#: Texts without any of these have no candidate.
HINT = r"[0-9@]|[\[(]at[\])]|(?i:token|secret|password|key) ?[=:]|PRIVATE KEY|sk-|gh[pousr]_|eyJ"
OCTET = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
PRECISION, ROUNDS, RATE = 0.9, 30, 0.5
#: Words that speak for a kind, and words that speak for no personal data.
FOR = {"email": "mail|contact|write|author|questions", "ip": "host|server|addr|ip", "card": "card|visa|paid|pay|charge|amex", "phone": "phone|tel|call|mobile|cell|fax|reach", "secret": "key|token|secret|export|config", "iban": "iban|account|bank|transfer|pay", "id": "ssn|social|security|tax"}
AGAINST = "version|order|ref|isbn|ean|part|sku|ticket|invoice|item|serial|model|article|stock|build|release|product|code|section|firmware|update|barcode|stamp"
_BLOCK = 64


def prefix_sums(sizes: Column) -> Column:
    """Sum of the entries before each entry of an array, in blocks: linear but for the number of blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * _BLOCK + 1, _BLOCK), F.lit(0), lambda a, x: a + x))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("all"))
    bases = F.aggregate(blocks, start, lambda a, x: F.struct((a["n"] + x).alias("n"), F.array_append(a["all"], a["n"]).alias("all")))["all"]

    def place(base):
        return F.transform(sizes, lambda _, i: F.get(base, F.floor(i / _BLOCK).cast("int")) + F.aggregate(F.slice(sizes, i - i % _BLOCK + 1, i % _BLOCK), F.lit(0), lambda a, x: a + x))

    return let(bases, place)


def _luhn(text: Column) -> Column:
    digits = F.regexp_extract_all(F.reverse(F.regexp_replace(text, "[^0-9]", "")), F.lit("[0-9]"), F.lit(0))
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _n_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", ""))


def _mod97(text: Column) -> Column:
    flat = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.left(flat, F.lit(4)))
    values = F.transform(F.split(turned, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, v: F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)) == 1


def _strict(kind: str, text: Column) -> Column:
    """Whether a span passes its kind's strict test; one of the features."""
    if kind == "ip":
        return text.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(text)
    if kind == "phone":
        return _n_digits(text).between(10, 15)
    if kind == "email":
        return text.rlike(r"\.[A-Za-z]{2,}$")
    if kind == "iban":
        return _mod97(text)
    if kind == "id":
        return ~text.rlike("^(?:000|666|9)|-00-|0000$")
    return text.rlike("[0-9]") & text.rlike("[A-Za-z0-9+/_.-]{16,}[\"']?$")


_BASE_TEST = {"email": lambda x: F.lit(True), "ip": lambda x: _strict("ip", x), "card": lambda x: _strict("card", x), "phone": lambda x: _strict("phone", x)}


def _spans(text: Column, g: int) -> Column:
    """Candidates of one generator: s, e, kind, base, pass and binned features."""
    kind, pattern, base = GENERATORS[g]

    def located(pieces):
        sizes = F.transform(pieces["gaps"], lambda x, i: F.length(x) + F.coalesce(F.length(F.get(pieces["hits"], i)), F.lit(0)))

        def rows(before):
            def one(hit, i):
                gap, after = F.get(pieces["gaps"], i), F.get(pieces["gaps"], i + 1)
                start = F.get(before, i) + F.length(gap)
                prev, post = F.right(gap, F.lit(1)), F.left(after, F.lit(1))
                side = lambda c: F.when(c == "", 0).when(c.rlike(r"[\s\"'(\[<]"), 1).when(c.rlike(r"[\p{L}0-9]"), 2).otherwise(3)
                size, digits, ahead = F.length(hit), _n_digits(hit), F.right(gap, F.lit(32))
                value = F.regexp_extract(hit, r"([^=:]+)$", 1) if kind == "secret" else hit
                has = lambda p, c=value: c.rlike(p).cast("int")
                return F.struct(
                    start.alias("s"), (start + size).alias("e"), F.lit(KINDS.index(kind)).alias("k"), (_BASE_TEST[kind](hit) if base else F.lit(False)).alias("base"),
                    F.array(
                        F.lit(g), F.when(size < 12, 0).when(size < 17, 1).when(size < 30, 2).otherwise(3), F.when(digits < 4, 0).when(digits < 10, 1).when(digits < 16, 2).otherwise(3),
                        F.when(hit.rlike(r"[ ()]"), 2).when(hit.rlike(r"[.-]"), 1).otherwise(0), side(prev), side(post), has(rf"(?i)\b(?:{FOR[kind]})", ahead), has(rf"(?i)\b(?:{AGAINST})", ahead),
                        _strict(kind, hit).cast("int"), has("[a-z]") + has("[A-Z]") + has("[0-9]"), has(r"(.)\1{5}|(?i:example|change|your|value|manual|insert|not-set)"),
                    ).alias("x"),
                )

            return F.transform(pieces["hits"], one)

        return let(prefix_sums(sizes), rows)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.struct(F.split(text, pattern, -1).alias("gaps"), h.alias("hits")), located)))


SPAN = "array<struct<s:int,e:int,k:int,base:boolean,x:array<int>>>"


def candidates(docs: DataFrame, name: str) -> DataFrame:
    """docs with all candidate spans of every generator."""
    text = F.col("text")
    empty = F.array().cast(SPAN)
    each = F.flatten(F.array(*[F.coalesce(_spans(text, g).cast(SPAN), empty) for g in range(len(GENERATORS))]))
    return docs.withColumn(name, F.when(text.rlike(HINT), each).otherwise(empty))


def grow(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = ROUNDS, rate: float = RATE) -> tuple[list, float]:
    """Gradient boosting with trees of depth two on counted vectors (x, personal, not): trees and intercept."""
    x = np.array([r[0] for r in rows])
    pos, neg = (np.array([r[i] for r in rows], float) for i in (1, 2))
    n = pos + neg
    bias = math.log((pos.sum() + 1) / (neg.sum() + 1))
    z, trees = np.full(len(rows), bias), []
    splits = [(f, v) for f in range(x.shape[1]) for v in np.unique(x[:, f])]

    def best(mask, g, h):
        gain, at = 1e-9, None
        for f, v in splits:
            left = mask & (x[:, f] == v)
            a, b, c, d = g[left].sum(), h[left].sum(), g[mask].sum(), h[mask].sum()
            now = a * a / (b + 1) + (c - a) ** 2 / (d - b + 1) - c * c / (d + 1)
            if now > gain + 1e-12:
                gain, at = now, (f, int(v))
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = pos - n * p, n * p * (1 - p)
        every = np.ones(len(rows), bool)
        if not (root := best(every, g, h)):
            break
        tree = []
        for hit in (True, False):
            mask = (x[:, root[0]] == root[1]) == hit
            sub = best(mask, g, h)
            for yes in (True, False) if sub else (True,):
                leaf = mask & ((x[:, sub[0]] == sub[1]) == yes) if sub else mask
                value = rate * g[leaf].sum() / (h[leaf].sum() + 1)
                z[leaf] += value
                tree.append((root, hit, sub, yes, float(value)))
        trees.append(tree)
    return trees, bias


def margin(x: tuple[int, ...], trees: list, bias: float) -> float:
    """Score of one vector."""
    holds = lambda split, yes: split is None or (x[split[0]] == split[1]) == yes
    return bias + sum(leaf for tree in trees for root, hit, sub, yes, leaf in tree if holds(root, hit) and holds(sub, yes))


def calibrate(rows: list[tuple[tuple[int, ...], int, int]], trees: list, bias: float) -> list[float]:
    """Threshold of each kind: the least score at which counted vectors (x, personal, not) above it reach PRECISION."""
    out = []
    for kind in KINDS:
        own = sorted(((margin(x, trees, bias), p, n) for x, p, n in rows if GENERATORS[x[0]][0] == kind), reverse=True)
        least, good, every = math.inf, 0, 0
        for i, (z, p, n) in enumerate(own):
            good, every = good + p, every + p + n
            if good >= PRECISION * every and (i + 1 == len(own) or own[i + 1][0] < z):
                least = z
        out.append(least)
    return out


def snippet_counts(spark: SparkSession, *folds: str) -> list[list[tuple[tuple[int, ...], int, int]]]:
    """For each fold (x, personal, not) of the candidates that its snippets give; a candidate is personal if it meets a value that counts."""
    names = ("fold", "text", "kind", "s", "e", "counts")
    rows = [dict(zip(names, (i, *r[1:]), strict=True)) for i, fold in enumerate(folds) for r in snippets(fold)]
    table = spark.sql("SELECT inline(from_json(:rows, 'array<struct<fold:int,text:string,kind:string,s:int,e:int,counts:boolean>>'))", args={"rows": json.dumps(rows)})
    found = candidates(table, "c").select("fold", "kind", "s", "e", "counts", F.explode("c").alias("c")).where("NOT c.base")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    # a generator may take a little more or less than the value: the key's name before it, a mark behind it
    meets = (F.col("c.s") < F.col("e")) & (F.col("c.e") > F.col("s"))
    personal = F.col("counts") & meets & (F.get(kinds, F.col("c.k")) == F.col("kind"))
    got = found.groupBy("fold", "c.x").agg(F.sum(personal.cast("long")).alias("p"), F.sum((~personal).cast("long")).alias("n")).collect()
    return [sorted((tuple(r.x), r.p, r.n) for r in got if r.fold == i) for i in range(len(folds))]


@lru_cache(1)
def model() -> tuple[list, float, list[float]]:
    """Trees, intercept and thresholds by kind; the fit depends on the snippets alone."""
    first, second = snippet_counts(SparkSession.active(), "grow", "calibrate")
    trees, bias = grow(first)
    return trees, bias, calibrate(second, trees, bias)


def _margin(x: Column, trees: list, bias: float) -> Column:
    total = F.lit(bias)
    for tree in trees:
        value = None
        for (f, v), hit, sub, yes, leaf in tree:
            test = (F.get(x, F.lit(f)) == v) if hit else (F.get(x, F.lit(f)) != v)
            if sub:
                inner = F.get(x, F.lit(sub[0]))
                test = test & ((inner == sub[1]) if yes else (inner != sub[1]))
            value = F.when(test, F.lit(leaf)) if value is None else value.when(test, F.lit(leaf))
        total = total + value.otherwise(F.lit(0.0))
    return total


def choose(found: DataFrame, name: str, fitted: tuple[list, float, list[float]]) -> DataFrame:
    """Keep base spans, and candidates whose score reaches their kind's threshold and that no base span equals; ordered by start, then kind."""
    trees, bias, least = fitted
    most = F.array(*[F.lit(float(z)) for z in least])

    def picked(c):
        return c["base"] | (_margin(c["x"], trees, bias) >= F.get(most, c["k"]))

    slim = lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["base"].alias("base"))
    kept = F.transform(F.filter(F.col(name), picked), slim)
    # of candidates that are equal but for their generator, one stays; base ones sort last and are all kept
    ordered = F.array_sort(kept)
    twin = lambda s: F.filter(s, lambda c, i: ~F.coalesce((F.get(s, i + 1)["s"] == c["s"]) & (F.get(s, i + 1)["k"] == c["k"]) & (F.get(s, i + 1)["e"] == c["e"]), F.lit(False)))
    return found.withColumn(name, let(ordered, twin))


def detect(docs: DataFrame, name: str = "spans", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if None) with chosen spans: array of s, k (place in KINDS), e, base."""
    docs = make_room(docs, name)
    found = candidates(docs, name).select(*(docs.columns if keep is None else keep), name)
    return choose(found, name, model())


def render(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(kinds, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def digest(found: DataFrame, name: str = "spans") -> DataFrame:
    """doc_id, counts of base spans, their hash, and all spans as text."""
    base = F.filter(F.col(name), lambda c: c["base"])
    count = lambda k: F.size(F.filter(F.col(name), lambda c: c["base"] & (c["k"] == KINDS.index(k)))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(render(base).cast("binary"), 256).alias("base_sha256"), render(F.col(name)).alias(name))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; of overlapping spans the first to start counts, later ones lose the part it covers."""
    at = clean_name(docs, "pii_spans")
    found = detect(docs, at)
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def rebuilt(s):
        # each span begins where those before it have ended
        start = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts"))

        def step(a, c):
            begin = F.greatest(c["s"], a["end"])
            put = F.array(F.substring(F.col("text"), a["end"] + 1, begin - a["end"]), F.concat(F.lit("<"), F.get(kinds, c["k"]), F.lit(">")))
            return F.when(c["e"] > a["end"], F.struct(c["e"].alias("end"), F.concat(a["parts"], put).alias("parts"))).otherwise(a)

        done = F.aggregate(s, start, step)
        return let(done, lambda d: F.concat(F.array_join(d["parts"], ""), F.substring(F.col("text"), d["end"] + 1, F.length("text"))))

    clean = F.when(F.size(at) > 0, let(F.col(at), rebuilt)).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*docs.columns)
