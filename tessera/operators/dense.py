"""Exact dense search (R1, J4, J8) by matrix products of a block of queries and a block of vectors.

Up to QUERY_BLOCK queries (fewer if they are long) are one block that goes to all executors, and every task keeps its own k best, whatever the number of its
batches. More queries are dealt into blocks by hash, vectors into blocks too, and each pair of blocks is a cell of one task; neither
side passes through the driver. Products are made in tiles of bounded size, of which the hits alone are kept, so a task's memory doesn't
grow with queries times vectors. A ranked window by query takes the best of what tasks or cells return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Rows of a block of queries and of one of vectors at most, numbers in a block at most, and numbers in a tile of products.
QUERY_BLOCK, VECTOR_BLOCK, NUMBERS, TILE = 1 << 13, 1 << 14, 1 << 23, 1 << 21


def _matrix(column, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=kind).reshape(len(column), -1)


def _groups(by, n: int) -> list[np.ndarray]:
    """Rows of each value of by."""
    if by is None:
        return [np.arange(n)]
    codes = by.dictionary_encode().indices.to_numpy(zero_copy_only=False) if by.null_count == 0 else np.array([hash(str(x)) for x in by.to_pylist()])
    return [np.flatnonzero(codes == c) for c in np.unique(codes)]


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row; ties by key. scores are rounded in place."""
    scores = np.round(scores, 6, out=scores)
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    if np.isnan(scores.sum()):
        by_key = np.argsort(keys, kind="stable")
        order = by_key[np.argsort(-scores[:, by_key], axis=1, kind="stable")[:, :k]]
        return np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    taken = scores >= last
    for r in np.flatnonzero(taken.sum(axis=1) > k):  # of those that tie for the last places the least keys
        tied = np.flatnonzero(scores[r] == last[r])
        spare = int(taken[r].sum()) - k
        taken[r, tied[np.argsort(keys[tied], kind="stable")[len(tied) - spare :]]] = False
    return np.nonzero(taken)


def _meet(vectors: DataFrame, queries: DataFrame, key: str, vec: str, qid: str, qvec: str, by: str | None, choose, k: int | None = None) -> DataFrame:
    """Rows (qid, key, by, dense) that choose(scores, keys, qids) marks in a tile of products; with k, the k best of a query and value of by in each
    task or cell."""
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    own = [F.col(key).alias("key"), F.col(vec).alias("v"), (F.col(by) if by else F.lit(None).cast("string")).alias("by")]
    v = vectors.where(F.col(vec).isNotNull()).select(*own)
    q = queries.where(F.col(qvec).isNotNull()).select(F.col(qid).alias("qid"), F.col(qvec).alias("q"))
    schema = f"qid {kind(queries, qid)}, key {kind(vectors, key)}, by {kind(vectors, by) if by else 'string'}, dense double"

    def tiles(ids: pa.Array, wanted: np.ndarray, table: pa.Table):
        """Hits of each tile."""
        high = max(1, min(len(ids), TILE // 1024))
        wide = max(1, TILE // high)
        for at in range(0, len(table), wide):
            part = table.slice(at, wide)
            keys, groups, vecs = part["key"].combine_chunks(), part["by"].combine_chunks(), _matrix(part["v"]).T
            own = keys.to_numpy(zero_copy_only=False)
            for top in range(0, len(ids), high):
                some_ids, scores = ids.slice(top, high), wanted[top : top + high].astype(np.float64, copy=False) @ vecs
                rows, cols = [], []
                for some in _groups(groups, len(own)) if by else [slice(None)]:
                    cut = scores[:, some]
                    r, c = choose(cut, own[some], some_ids)
                    rows.append(r)
                    cols.append(some[c] if by else c)
                    scores[:, some] = cut
                r, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols))
                yield pa.table({"qid": some_ids.take(pa.array(r)), "key": keys.take(pa.array(c)), "by": groups.take(pa.array(c)), "dense": pa.array(np.round(scores[r, c], 6))})

    def gathered(found, n: int) -> list[pa.Table]:
        """The k best of all tiles, or all hits."""
        held, size = [], 0
        for t in found:
            held.append(t)
            size += len(t)
            if k is not None and size > max(1 << 18, 4 * k * n):
                held = [fewer(held)]
                size = len(held[0])
        return [fewer(held)] if held and k is not None else held

    def fewer(held: list[pa.Table]) -> pa.Table:
        """The k best of a task's hits so far."""
        t = pa.concat_tables(held).sort_by([("qid", "ascending"), ("by", "ascending"), ("dense", "descending"), ("key", "ascending")])
        same = np.ones(len(t), bool)
        for c in ("qid", "by"):
            codes = t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            same[1:] &= codes[1:] == codes[:-1]
        if len(t):
            same[0] = False
        start = np.flatnonzero(~same)
        place = np.arange(len(t)) - np.repeat(start, np.diff(np.append(start, len(t))))
        return t.filter(pa.array(place < k))

    n, dim = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    most = lambda rows: max(1, min(rows, NUMBERS // max(1, dim)))
    if n <= most(QUERY_BLOCK):
        rows = q.toArrow()  # at most a block
        single = rows.schema.field("q").type.value_type == pa.float32()
        shared = vectors.sparkSession.sparkContext.broadcast((rows["qid"].combine_chunks(), _matrix(rows["q"], np.float32 if single else np.float64) if n else None))

        def scan(batches):
            ids, wanted = shared.value
            found = (t for batch in batches if batch.num_rows and wanted is not None for t in tiles(ids, wanted, pa.Table.from_batches([batch])))
            if k is None:
                yield from (b for t in found for b in t.to_batches())
            else:
                yield from (b for t in gathered(found, len(ids)) for b in t.to_batches())

        return v.mapInArrow(scan, schema)
    blocks, parts = -(-n // most(QUERY_BLOCK)), max(1, -(-v.count() // most(VECTOR_BLOCK)))
    number = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = q.select(number("qid", blocks).alias("block"), every(parts).alias("part"), "qid", "q")
    right = v.select(number("key", parts).alias("part"), every(blocks).alias("block"), "key", "v", "by")

    def cell(wanted: pa.Table, table: pa.Table) -> pa.Table:
        if not len(wanted) or not len(table):
            return empty.empty_table()
        ids = wanted["qid"].combine_chunks()
        return pa.concat_tables([empty.empty_table(), *gathered(tiles(ids, _matrix(wanted["q"], None), table), len(ids))])

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(vectors.sparkSession.createDataFrame([], schema).schema)
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(cell, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "key", vec: str = "embedding", qid: str = "qid", qvec: str = "embedding", by: str | None = None) -> DataFrame:
    """qid, key, dense (rounded to 6 digits), dense_rank (from 0), and by if asked for: the k best of each query, or of each query and value
    of by; ties by key."""
    found = _meet(vectors, queries, key, vec, qid, qvec, by, lambda s, keys, ids: _best(s, keys, k), k)
    rank = F.row_number().over(Window.partitionBy("qid", "by").orderBy(F.desc("dense"), "key"))
    ranked = found.withColumn("dense_rank", rank - 1).where(F.col("dense_rank") < k)
    return ranked.select("qid", "key", *([F.col("by").alias(by)] if by else []), "dense", "dense_rank")


def pairs_above(vectors: DataFrame, threshold: float, key: str, vec: str) -> DataFrame:
    """A < b with cosine of at least the threshold (unit vectors)."""

    def above(scores, keys, ids):
        # few products come near the threshold, and these alone are rounded
        r, c = np.nonzero(scores >= threshold - 1e-6)
        keep = (np.round(scores[r, c], 6) >= threshold) & (ids.to_numpy(zero_copy_only=False)[r] < keys[c])
        return r[keep], c[keep]

    found = _meet(vectors, vectors, key, vec, key, vec, None, above)
    return found.select(F.col("qid").alias("a"), F.col("key").alias("b"), F.col("dense").alias("cosine"))
