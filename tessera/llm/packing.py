"""Packing along a space-filling curve.

Each document's ids are hashed to a vector (2**16 buckets, log(1 + count) each, scaled to length 1), which a fixed random matrix projects to DIMS dimensions. Quantiles of these over all documents cut each dimension into
2**BITS cells, so no cell at an edge gathers what is far out, and the cells give the document's place on a Hilbert
curve. Documents are sorted along it, so that like documents are neighbours, and laid end to end into sequences of
SEQUENCE ids. The rest at a partition's end is parted at powers of two, which need no padding.

Partitions are stretches of the curve with like numbers of ids: ids are summed by the first COARSE bits of the key (at most
2**COARSE sums come to the driver). A stretch that holds more than one partition's share, such as a group of copies, is parted
by a hash of doc_id and ids. Ties on the curve are ordered by doc_id and ids. Defined cases: a null or empty text is its end id alone; a document longer than a sequence is cut; an empty
table gives no rows; other columns are ignored; rows that repeat a doc_id are packed each for itself (row tells them apart).
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import default_tokenizer, encoder, with_end
from .common import cut, mix, partitions, tidy
from .token_files import bits_for, pack, unpack

SEQUENCE, DIMS, BITS = 1024, 4, 8
#: Accuracy of the quantiles: their ranks are wrong by at most one in so many.
COARSE, ACCURACY = 16, 5000


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((1 << 16, DIMS)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of so many bits (Skilling's transform, by columns)."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for d in range(n):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, n):
        x[d] = x[d] ^ x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ t) >> b) & 1)
    return key


def coordinates(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Projected vectors of documents, one row each; every document has at least one id."""
    doc = np.repeat(np.arange(len(n)), n)
    keys, times = np.unique((doc << 16) | (mix(ids.astype(np.uint64)) >> np.uint64(48)).astype(np.int64), return_counts=True)
    weight = np.log1p(times)
    starts = np.searchsorted(keys >> 16, np.arange(len(n)))
    size = np.sqrt(np.add.reduceat(weight * weight, starts))
    out = np.add.reduceat(weight[:, None] * _projection()[keys & 0xFFFF], starts, axis=0)
    return out / size[:, None]


def cell_bounds(tok: DataFrame) -> np.ndarray:
    """For each dimension the 2**BITS - 1 quantiles that part its cells, over all documents."""
    shares = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    row = tok.agg(*[F.percentile_approx(F.get("at", F.lit(d)), shares, ACCURACY) for d in range(DIMS)]).first()
    return np.array([x or [0.0] * len(shares) for x in row])


def on_curve(bounds: np.ndarray, first: np.ndarray | None = None) -> Column:
    """Struct of the column at: its Hilbert key and the partition, or without these the stretch of the curve, that it lies in."""
    drop = DIMS * BITS - COARSE

    @F.arrow_udf("curve_key long, part int")
    def place(at: pa.Array) -> pa.Array:
        x = np.asarray(at.flatten()).reshape(-1, DIMS)
        key = hilbert_key(np.stack([np.searchsorted(bounds[d], x[:, d]) for d in range(DIMS)], 1), BITS)
        part = key >> drop
        return pa.StructArray.from_arrays([pa.array(key), pa.array((part if first is None else first[part]).astype(np.int32))], ["curve_key", "part"])

    return place("at")


def shares(by: np.ndarray, n: int) -> tuple[np.ndarray, dict[int, int]]:
    """First partition of each stretch that holds by[c] ids, and how many partitions a stretch takes where more than one."""
    share = max(1.0, by.sum() / n)
    begin = (np.cumsum(by) - by) / share
    first = np.minimum(begin, n - 1).astype(np.int32)
    last = np.clip(np.ceil(begin + by / share) - 1, first, n - 1).astype(np.int32)
    return first, {int(c): int(last[c] - first[c] + 1) for c in np.flatnonzero((by > share) & (last > first))}


def deal(tok: DataFrame, n: int) -> DataFrame:
    """tok with curve_key, in n partitions along the curve that hold like numbers of ids."""
    bounds = cell_bounds(tok)
    sums = tok.select(on_curve(bounds)["part"].alias("c"), "n_ids").groupBy("c").agg(F.sum("n_ids").alias("n")).toArrow()
    by = np.zeros(1 << COARSE, np.float64)
    by[sums["c"].to_numpy()] = sums["n"].to_numpy()
    first, wide = shares(by, n)
    placed = tok.withColumn("to", on_curve(bounds, first)).withColumn("curve_key", F.col("to")["curve_key"])
    part = F.col("to")["part"]
    if wide:  # fewer than n stretches
        stretch = F.shiftright("curve_key", DIMS * BITS - COARSE).cast("int")
        table = F.create_map(*[F.lit(x) for pair in wide.items() for x in pair])
        part = part + F.coalesce(F.pmod(F.xxhash64("doc_id", "ids"), F.element_at(table, stretch)), F.lit(0)).cast("int")
    return placed.withColumn("part", part).drop("to").repartitionById(n, "part").sortWithinPartitions("curve_key", "doc_id", "ids")


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, its projected vector, its number of ids and the ids, bit-packed."""

    def rows(batches):
        enc = encoder(tokenizer)
        bits = bits_for(max(enc.vocab_size, end_id + 1))
        for batch in batches:
            for at, ids, n in enc.encode(batch.column(1)):
                ids, n = with_end(ids, n, end_id)
                if not len(n):
                    continue
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(n)), "at": pa.FixedSizeListArray.from_arrays(pa.array(coordinates(ids, n).ravel()), DIMS).cast(pa.list_(pa.float64())), "n_ids": pa.array(n), "bits": pa.array(np.full(len(n), bits, np.int32)), "ids": pa.array([pack(ids[b - c : b], bits) for b, c in zip(ends.tolist(), n.tolist(), strict=True)], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(rows), "doc_id long, at array<double>, n_ids long, bits int, ids binary")


def sequences(total: int, length: int) -> np.ndarray:
    """Lengths of the sequences that hold total ids with no padding: full ones, then powers of two."""
    rest = [1 << b for b in range(length.bit_length() - 1, -1, -1) if (total % length) >> b & 1]
    return np.array([length] * (total // length) + rest, np.int64)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, length: int = SEQUENCE) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row."""
    tok = cut(tokenised(docs, tokenizer or default_tokenizer(), end_id), "tokenised")
    ordered = deal(tok, partitions(docs.sparkSession))

    def emit(held, last, state):
        """Pieces of held documents in as many full sequences as they fill; the rest of them stays, unless last."""
        lens = np.array([len(x[1]) - x[2] for x in held], np.int64)
        total = int(lens.sum())
        sizes = sequences(total, length) if last else np.full(total // length, length, np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(lens)
        bounds = np.unique(np.concatenate([cuts, ends[ends <= cuts[-1]]]))
        lo, hi = bounds[:-1], bounds[1:]
        doc = np.searchsorted(ends, lo, "right")
        seq = np.searchsorted(cuts, lo, "right") - 1
        within = lo - (ends - lens)[doc]
        out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row")}
        for d, s, w, a, b in zip(doc.tolist(), seq.tolist(), within.tolist(), lo.tolist(), hi.tolist(), strict=True):
            key, ids, done, row = held[d]
            at = done + w
            for k, v in zip(out, (key, at, b - a, zlib.crc32(ids[at : at + b - a]), len(ids), state["base"] + s, a - int(cuts[s]), row), strict=True):
                out[k].append(v)
        state["base"] += len(sizes)
        used = int(cuts[-1])
        first = int(np.searchsorted(ends, used, "right"))
        held = held[first:]
        if held:
            key, ids, done, row = held[0]
            held[0] = (key, ids, done + used - int((ends - lens)[first]), row)
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()}), held

    def pieces(batches):
        part = TaskContext.get().partitionId()
        state, held, size, row = {"base": part << 40}, [], 0, part << 40
        for batch in batches:
            for key, bits, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "bits", "n_ids", "ids")), strict=True):
                held.append((key, unpack(raw, bits, 0, n).astype("<u4"), 0, row))
                row += 1
                size += n
                if size >= 512 * length:
                    done, held = emit(held, False, state)
                    size = sum(len(x[1]) - x[2] for x in held)
                    yield done
        if held:
            yield emit(held, True, state)[0]

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"
    return ordered.select("doc_id", "bits", "n_ids", "ids").mapInArrow(tidy(pieces), schema)
