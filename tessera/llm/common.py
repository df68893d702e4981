"""What the operators of this package share: the shared folder, tables cut from their lineage, and
numpy kernels that turn a batch of texts into word hashes and window hashes."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import shared_dir, spread

#: ASCII white space as the contracts define it: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Texts are worked on in pieces of about so many bytes, to bound numpy's temporaries: some ten arrays of 8 bytes a byte.
#: A text that is longer is a piece of its own, so a worker's need grows with its longest text (80 MB for a text of 1 MB).
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lost executors then cost no recomputation."""
    path = path or fresh_path(df.sparkSession, tag)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that cut() wrote, by Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def make_room(df: DataFrame, *added: str) -> DataFrame:
    """df with its columns that clash with names to be added, in any case of letters, renamed to <name>_in."""
    wanted = {a.lower() for a in added}
    for c in df.columns:
        if c.lower() in wanted:
            df = df.withColumnRenamed(c, clean_name(df, f"{c}_in"))
    return df


def tidy(emit):
    """A function of Arrow batches that gives memory back to the system when a task ends; Spark keeps its Python workers."""

    def run(batches):
        import ctypes

        yield from emit(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


class Scratch:
    """Tables in the shared folder that are of no use once the result has been written or is itself a table."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        path = fresh_path(df.sparkSession, tag)
        self.paths.append((df.sparkSession, path))
        return cut(df, tag, path)

    def clear(self) -> None:
        for spark, path in self.paths:
            forget(spark, path)
        self.paths.clear()


# ---------------------------------------------------------------- numpy kernels

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64: KEPT of them are remembered, more are made for one call."""

    KEPT = 5 << 18

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def _make(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, self.base, _U), np.full(n, self.inverse, _U)
        up[0] = down[0] = 1
        return np.cumprod(up, out=up), np.cumprod(down, out=down)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return self._make(n)
        if len(self.up) < n:
            self.up, self.down = self._make(min(self.KEPT, max(n + n // 4, 1 << 16)))
        return self.up, self.down


_BYTE, _WORD = _Powers(0x9E3779B97F4A7C15), _Powers(0xD1342543DE82EF95)


@lru_cache(None)
def _byte_values(lower: bool) -> np.ndarray:
    v = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x2545F4914F6CDD1D))
    if lower:
        v[65:91] = v[97:123]
    return v


@lru_cache(None)
def _is_word() -> np.ndarray:
    ok = np.ones(256, bool)
    ok[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return ok


@lru_cache(None)
def alnum_word() -> np.ndarray:
    """Bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of lower-cased text: digits, letters and all beyond ASCII."""
    ok = np.zeros(256, bool)
    ok[48:58] = ok[65:91] = ok[97:123] = ok[128:] = True
    return ok


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an array of strings (null: empty), and the offsets of its rows."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


class Words:
    """Words of consecutive texts: count[i] words of text i, from first[i]; hash, start and end (in data) of each word."""

    __slots__ = ("count", "data", "end", "first", "hash", "start", "base")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, is_word: np.ndarray | None = None):
        lo, hi = int(offsets[0]), int(offsets[-1])
        part = data[lo:hi]
        rel = offsets - lo
        ok = np.zeros(len(part) + 2, np.int8)
        ok[1:-1] = (_is_word() if is_word is None else is_word)[part]
        step = np.diff(ok)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # a text's end also ends a word, where the next text begins with one
        if len(rel) > 2 and len(starts):
            inner = rel[1:-1]
            k = np.searchsorted(starts, inner, "right") - 1
            over = (k >= 0) & (starts[k] < inner) & (ends[k] > inner)
            cuts = np.unique(inner[over])
            if len(cuts):
                starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        self.data, self.base, self.start, self.end = data, lo, starts, ends
        self.first = np.searchsorted(starts, rel[:-1], "left")
        self.count = np.searchsorted(starts, rel[1:], "left") - self.first
        up, down = _BYTE.get(len(part) + 1)
        total = np.zeros(len(part) + 1, _U)
        np.cumsum(_byte_values(lower)[part] * up[: len(part)], out=total[1:])
        self.hash = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they lie in one text."""
        n = len(self.hash)
        ok = np.zeros(n, bool)
        out = np.zeros(n, _U)
        if n >= k:
            up, down = _WORD.get(n + 1)
            total = np.zeros(n + 1, _U)
            np.cumsum(self.hash * up[:n], out=total[1:])
            out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])
            last = np.repeat(self.first + self.count, self.count)
            ok = np.arange(n) + k <= last
        return out, ok


def chunks(texts: pa.Array, size: int = CHUNK_BYTES):
    """(first row, end row, data, offsets of these rows) in pieces of about size bytes; a longer text is a piece of its own."""
    data, offsets = text_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data, offsets[i : j + 1]
        i = j


def n_words(text) -> "F.Column":
    """Number of words of a text column; null or blank: 0."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")
