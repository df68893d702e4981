"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Equal vectors are first put together (a pre-aggregated group, so a common vector is one row with a count). The distinct ones
are dealt into blocks by hash; each pair of blocks is a cell of one task. In a cell unit vectors are quantised to int8 with
a scale of their own: x = x~ + e, |e| known. Tiles of int8 products (held as float32, exact below 2**24) give x~.y~, and
|x.y - x~.y~| <= |e_x| + (1 + |e_x|) |e_y|. Only pairs that could reach the threshold are worked out in double precision,
a bounded number at a time. A cell returns, for each vector, its number of links, and a spanning forest of the cell's links
(at most one row a vector), never its pairs. All cells together compare all pairs, so work is quadratic in distinct vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths don't link; a null vec_id links with nothing and is not kept; rows that repeat a vec_id are vectors of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut
from .components import components

THRESHOLD = 0.95
BLOCK, MOST_BLOCK, TILE, RECHECK = 4096, 65536, 2048, 1 << 15


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales and the norms of what quantising loses (rounded up)."""
    top = np.abs(unit).max(1, keepdims=True)
    scale = 127.0 / top
    codes = np.rint(unit * scale).astype(np.int8)
    lost = np.linalg.norm(unit - codes / scale, axis=1) * (1 + 1e-12) + 1e-15
    return codes, 1.0 / scale[:, 0], lost


def linked_pairs(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Pairs (a, b) of row numbers, a of left and b of right, with cosine of at least the threshold, tile by tile."""
    raw = vectors.astype(np.float64)
    norm = np.sqrt((raw * raw).sum(1))
    codes, scale, lost = quantise(raw / norm[:, None])
    kind = np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64
    work = codes.astype(kind)
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(0, len(right), TILE):
            b = right[j : j + TILE]
            product = work[a] @ work[b].T
            # least product that can still be a link, from the largest bound of the row's partners: a cheap first cut
            slack = lost[a] + (1 + lost[a]) * lost[b].max() + 1e-9
            ra, rb = np.nonzero(product >= ((threshold - slack) / (scale[a] * scale[b].max()))[:, None].astype(kind) * (1 - 1e-6) if threshold > slack.max() else product >= -np.inf)
            for k in range(0, len(ra), RECHECK):
                x, y = a[ra[k : k + RECHECK]], b[rb[k : k + RECHECK]]
                near = product[ra[k : k + RECHECK], rb[k : k + RECHECK]] * scale[x] * scale[y] + lost[x] + (1 + lost[x]) * lost[y] + 1e-9 >= threshold
                x, y = x[near], y[near]
                sure = (raw[x] * raw[y]).sum(1) / (norm[x] * norm[y]) >= threshold
                yield x[sure], y[sure]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row number reachable from each of n rows by the links (a, b)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == old).all():
            return label


def _cell(threshold: float):
    def work(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rep", "ascending")])
        rep, block, times = (group[c].to_numpy() for c in ("rep", "block", "times"))
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        flat = group["embedding"].combine_chunks()
        vectors = np.asarray(flat.flatten(), dtype=np.float64).reshape(len(rep), -1)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for a, b in linked_pairs(vectors, left, right, threshold):
            if lo == hi:
                once = a < b
                a, b = a[once], b[once]
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            if len(a):
                root = forest(len(rep), np.concatenate([a, np.arange(len(rep))]), np.concatenate([b, label]))
                label = root
        used = np.flatnonzero((links > 0) | (label != np.arange(len(rep))))
        return pa.table({"rep": pa.array(rep[used]), "links": pa.array(links[used]), "root": pa.array(rep[label[used]])})

    return work


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept; a row a vector."""
    e = F.col("embedding").cast("array<double>")
    fine = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull(), e).alias("embedding"))
    valid = rows.where(F.col("embedding").isNotNull())
    classes = cut(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")), "vectors")
    n = classes.count()
    size = int(min(MOST_BLOCK, max(BLOCK, n / 16)))
    g = max(1, -(-n // size))
    # classes of rep and lengths: a length is a cell dimension of its own
    dealt = classes.withColumns({"block": F.pmod(F.xxhash64("rep", "embedding"), F.lit(g)), "dim": F.size("embedding")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))))
    dealt = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    found = cut(dealt.groupBy("dim", "lo", "hi").applyInArrow(_cell(threshold), "rep long, links long, root long"), "cells")
    links = found.groupBy("rep").agg(F.sum("links").alias("more"))
    roots = components(found.where(F.col("rep") != F.col("root")), "rep", "root")
    facts = classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    facts = facts.select("embedding", (F.coalesce("more", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(facts, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
