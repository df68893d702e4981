"""Toxicity: a linear classifier on character n-grams, each feature scaled by its naive Bayes log-count ratio.

A document's features are counts, over its distinct lower-cased words, of the 3- to 5-grams of "<word>", hashed to
BUCKETS. The ratio of a feature is log((toxic documents with it + a) / their total) - log((clean ones + a) / theirs).
Logistic regression is trained on count * ratio over the features with the strongest ratios. Because a document's
features are sums over its distinct words, every distinct word of a batch is scored once.

The fit uses at most TOXIC_ROWS + CLEAN_ROWS labelled rows (those with the least hash of doc_id; whole texts); the intercept
is corrected to the label shares of all labelled rows outside the fold. Rows with crc32(doc_id as text) mod 4 = 2 are held
out. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: a null or blank text is scored by the intercept; a null doc_id is not held out; labels that are null are
skipped, conflicting ones of one document count as toxic; with no labels of a class all scores are 0; equal texts get equal
scores; an empty table gives no rows; other columns stay, one named as an output (in any case of letters) as
<name>_in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, Words, alnum_word, chunks, clean_name, make_room, mix, tidy

BUCKETS, GRAMS, SMOOTHING, FEATURES = 1 << 18, (3, 4, 5), 1.0, 6000
TOXIC_ROWS, CLEAN_ROWS = 1500, 2500
THRESHOLD = 0.3
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _distinct_words(data, offsets):
    """Row and word number of each distinct word of each text; for each word number, where it stands in data."""
    w = Words(data, offsets, True, alnum_word())
    keys, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
    row = np.repeat(np.arange(len(w.count)), w.count)
    pairs = np.unique(row * np.int64(max(1, len(keys))) + which)
    return pairs // max(1, len(keys)), pairs % max(1, len(keys)), w.start[first] + w.base, w.end[first] + w.base


def _grams(data, lo, hi):
    """Word number and bucket of each n-gram of <word>, for words that stand at lo to hi in data."""
    size = hi - lo
    ends = np.cumsum(size + 2)
    at = ends - size - 2
    buf = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    inner = np.ones(len(buf), bool)
    inner[at] = inner[ends - 1] = False
    flat = data[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat).astype(np.uint8)
    buf[inner], buf[at], buf[ends - 1] = flat, 0x3C, 0x3E
    word = np.repeat(np.arange(len(lo)), size + 2)
    words, buckets = [], []
    big = buf.astype(_U)
    for n in GRAMS:
        if len(buf) < n:
            continue
        ok = word[: len(buf) - n + 1] == word[n - 1 :]
        h = np.zeros(len(buf) - n + 1, _U)
        for k in range(n):
            h = h * _U(257) + big[k : len(buf) - n + 1 + k] + _U(1)
        words.append(word[: len(ok)][ok])
        buckets.append((mix(h[ok] + _U(n)) % _U(BUCKETS)).astype(np.int64))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(words), np.concatenate(buckets)


def features(texts: pa.Array):
    """Buckets and counts of each text."""
    for i, j, data, offsets in chunks(texts):
        row, word, lo, hi = _distinct_words(data, offsets)
        gram_word, bucket = _grams(data, lo, hi)
        order = np.argsort(gram_word, kind="stable")
        bucket, per_word = bucket[order], np.bincount(gram_word, minlength=len(lo))
        starts = np.cumsum(per_word) - per_word
        n = per_word[word]
        flat = bucket[np.repeat(starts[word] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        for k in range(j - i):
            lo_k, hi_k = np.searchsorted(row, [k, k + 1])
            a, b = int(n[:lo_k].sum()), int(n[:hi_k].sum())
            yield np.unique(flat[a:b], return_counts=True)


def choose_features(seen: np.ndarray, rows: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Log-count ratio of every bucket, and the buckets with the strongest ones; seen[y, bucket]: rows of class y with the bucket."""
    df = seen.sum(0)
    ratio = np.log((seen[1] + SMOOTHING) / rows[1]) - np.log((seen[0] + SMOOTHING) / rows[0])
    strength = np.where(df >= 5, np.abs(ratio) * np.sqrt(df), 0)
    return ratio, np.argsort(-strength, kind="stable")[:FEATURES]


def fit(r: np.ndarray, c: np.ndarray, n: np.ndarray, ratio: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of the chosen features (coefficient times ratio) and intercept, from counts n of feature c in row r; prior: share of
    toxic rows among all labelled ones."""
    x = np.log1p(n) * ratio[c]
    w, b, m, v = np.zeros(len(ratio)), 0.0, np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for t in range(1, 301):
        z = np.bincount(r, weights=x * w[c], minlength=len(y)) + b
        err = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(c, weights=x * err[r], minlength=len(ratio)) / len(y) + 1e-3 * w, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    share = y.mean()
    return w * ratio, float(b + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold; None if a class has no rows."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    shares = {int(r.toxic): r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        return None
    pick = lambda label, n: usable.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, TOXIC_ROWS).unionByName(pick(0, CLEAN_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))

    def extract(batches):
        for batch in batches:
            found = list(features(batch.column("text")))
            at = pa.array(np.cumsum([0] + [len(b) for b, _ in found]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if found else np.zeros(0), pa.int32())) for x in zip(*found, strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), *lists], ["doc_id", "toxic", "bucket", "n"])

    scratch = Scratch()
    got = scratch.cut(rows.mapInArrow(tidy(extract), "doc_id long, toxic int, bucket array<int>, n array<int>"), "features")
    # a row a bucket and class comes to the driver, and then only the chosen features of the sample
    counts = got.select("toxic", F.explode("bucket").alias("b")).groupBy("b", "toxic").agg(F.count(F.lit(1)).alias("n")).toArrow()
    seen = np.zeros((2, BUCKETS), np.int64)
    seen[counts["toxic"].to_numpy(), counts["b"].to_numpy()] = counts["n"].to_numpy()
    label = got.select("doc_id", "toxic").toArrow().sort_by("doc_id")
    y = label["toxic"].to_numpy().astype(np.float64)
    ratio, chosen = choose_features(seen, (int((y == 0).sum()), int((y == 1).sum())))
    slot = np.full(BUCKETS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen), dtype=np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(slot)

    def slim(batches):
        for batch in batches:
            lists = batch.column("bucket")
            c = shared.value[np.asarray(lists.flatten())]
            keep = c >= 0
            sizes = np.add.reduceat(np.append(keep, False), np.asarray(lists.offsets)[:-1] - lists.offsets[0].as_py()) if batch.num_rows else np.zeros(0)
            sizes = np.where(np.asarray(lists.value_lengths()) > 0, sizes, 0)
            at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            both = [pa.ListArray.from_arrays(at, x) for x in (pa.array(c[keep].astype(np.int16)), batch.column("n").flatten().filter(pa.array(keep)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *both], ["doc_id", "c", "n"])

    kept = got.mapInArrow(slim, "doc_id long, c array<smallint>, n array<int>").toArrow().sort_by("doc_id").combine_chunks()
    scratch.clear()
    c, n = (kept[x].combine_chunks() for x in ("c", "n"))
    r = np.repeat(np.arange(len(y)), np.asarray(c.value_lengths()))
    weights = np.zeros(BUCKETS)
    weights[chosen], bias = fit(r, np.asarray(c.flatten()).astype(np.int64), np.asarray(n.flatten()).astype(np.float64), ratio[chosen], y, shares[1] / (shares[0] + shares[1]))
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; the model is one array of BUCKETS numbers."""
    docs = make_room(docs, name)
    own = docs.columns
    spark = docs.sparkSession
    at = own.index("text")
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def scored(batches):
        weights, bias = shared.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, j, data, offsets in chunks(batch.column(at)):
                row, word, lo, hi = _distinct_words(data, offsets)
                gram_word, bucket = _grams(data, lo, hi)
                hit = weights[bucket] != 0
                # counts enter as log(1 + n), so grams of several words of a text are put together first
                order = np.argsort(gram_word[hit], kind="stable")
                g, n = bucket[hit][order], np.bincount(gram_word[hit], minlength=len(lo))
                starts = (np.cumsum(n) - n)[word]
                m = n[word]
                flat = g[np.repeat(starts - np.cumsum(m) + m, m) + np.arange(int(m.sum()))]
                keys, times = np.unique(np.repeat(row, m) * np.int64(BUCKETS) + flat, return_counts=True)
                z[i:j] = np.bincount(keys // BUCKETS, weights=weights[keys % BUCKETS] * np.log1p(times), minlength=j - i)
            s = 1 / (1 + np.exp(-np.clip(z + bias, -50, 50)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(s)], [*own, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"])
    return docs.mapInArrow(tidy(scored), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted."""
    out = score(make_room(docs, "held_out", "predicted"), train(docs, labels))
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with the columns of docs alone."""
    at = clean_name(docs, "toxicity")
    return score(docs, train(docs, labels), at).where(F.col(at) < threshold).select(*docs.columns)
