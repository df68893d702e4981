"""Token-ID output: ids bit-packed at the fewest bits that the vocabulary needs, in blocks.

A file set is a folder of Parquet files whose rows are blocks of whole documents. A block carries its place
(file_no, block_no), the number of ids before it in its file, its documents' ids and lengths, and a payload in which
id k takes bits k*bits to (k+1)*bits, least significant first. Readers unpack a block by numpy at once, or any
range of ids in it. The sum of ids in the files before, one number a file, places every document in the whole.

Defined cases: a null or empty text has its end id only; a null doc_id comes first; equal doc_ids are in order of a hash of their
texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import default_tokenizer, encoder, with_end
from .common import fresh_path, partitions, tidy

BLOCK_IDS = 1 << 17
BLOCKS = "file_no int, block_no int, start_in_file long, n_ids long, first_doc long, last_doc long, bits int, doc_ids binary, doc_lens binary, payload binary"


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at a fixed width of bits, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start to start + count of a payload; reads only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    lo, hi = start * bits // 8, -(-(start + count) * bits // 8)
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, hi - lo, lo), bitorder="little")
    flags = flags[start * bits - lo * 8 :][: count * bits].reshape(count, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Write the documents' ids, each with end_id behind, in ascending order of doc_id."""
    n = partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def blocks(batches):
        enc, file_no = encoder(tokenizer), TaskContext.get().partitionId()
        bits = bits_for(max(enc.vocab_size, end_id + 1))
        state = {"block": 0, "start": 0}

        def block(keys, lens, ids):
            flat = np.concatenate(ids)
            real = [k for k in keys if k is not None]
            row = {"file_no": file_no, "block_no": state["block"], "start_in_file": state["start"], "n_ids": len(flat), "first_doc": min(real, default=None), "last_doc": max(real, default=None), "bits": bits}
            row |= {"doc_ids": np.array([np.iinfo(np.int64).min if k is None else k for k in keys], "<i8").tobytes(), "doc_lens": np.array(lens, "<u4").tobytes(), "payload": pack(flat, bits)}
            state["block"] += 1
            state["start"] += len(flat)
            return pa.RecordBatch.from_pylist([row], schema)

        keys, lens, ids, held = [], [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, flat, count in enc.encode(batch.column(1)):
                flat, count = with_end(flat, count, end_id)
                ends = np.cumsum(count)
                for k, (hi, c) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)):
                    keys.append(doc_ids[at + k])
                    lens.append(c)
                    ids.append(flat[hi - c : hi])
                    held += c
                    if held >= block_ids:
                        yield block(keys, lens, ids)
                        keys, lens, ids, held = [], [], [], 0
        if keys:
            yield block(keys, lens, ids)

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[t]) for c, t in (x.split() for x in BLOCKS.split(", "))])
    ordered.mapInArrow(tidy(blocks), BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def file_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids in the files before each file; one number a file."""
    sizes = spark.read.parquet(path).groupBy("file_no").agg(F.sum("n_ids").alias("n")).collect()
    out, total = {}, 0
    for file_no, n in sorted(sizes):
        out[file_no] = total
        total += n
    return out


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids. With doc_ids, only blocks that can hold them are read, and of
    these only the bytes of their ids are unpacked."""
    starts = file_starts(spark, path)
    blocks = spark.read.parquet(path)
    if doc_ids is not None:
        lo, hi = min(doc_ids, default=0), max(doc_ids, default=-1)
        blocks = blocks.where((F.col("last_doc") >= lo) & (F.col("first_doc") <= hi))
        doc_ids = np.unique(np.array(doc_ids, np.int64))

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, lens = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_lens"], "<u4").astype(np.int64)
                ends = np.cumsum(lens)
                missing = keys == np.iinfo(np.int64).min
                if doc_ids is None:
                    ids = unpack(row["payload"], row["bits"], 0, int(ends[-1])).astype("<u4")
                    begin = ends - lens
                else:
                    some = np.isin(keys, doc_ids) & ~missing
                    keys, missing, lens, begin = keys[some], missing[some], lens[some], (ends - lens)[some]
                    ids = np.concatenate([np.zeros(0, "<u4"), *[unpack(row["payload"], row["bits"], a, n).astype("<u4") for a, n in zip(begin.tolist(), lens.tolist(), strict=True)]])
                    ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                out = {"doc_id": pa.array(keys, mask=missing), "start": pa.array(starts[row["file_no"]] + row["start_in_file"] + begin), "n_tokens": pa.array(lens), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.select("file_no", "start_in_file", "bits", "doc_ids", "doc_lens", "payload").mapInArrow(tidy(documents), schema)


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files of docs and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or default_tokenizer(), end_id)
    return read_tokens(spark, path)


def gather(frame: pd.DataFrame) -> np.ndarray:
    """Ids of documents in order, for tests of the round trip."""
    return np.concatenate([np.asarray(x, np.uint32) for x in frame.sort_values("start")["ids"]])
