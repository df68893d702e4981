"""Substring dedup by difference-cover anchors.

COVER is a difference cover modulo PERIOD: for every shift two of its residues lie that far apart, so if a run of WINDOW
words stands at places p and q of two documents, some t < PERIOD puts both p + t and q + t on the cover. Anchors of
ANCHOR = WINDOW - PERIOD + 1 words that start at cover places are hashed; those found in two or more documents are shared.
Only windows that contain a shared anchor can repeat, so extension hashes just these (96 bits), and a window's
least doc_id decides which documents lose it. Words under lost windows go.

Each document counts a hash once, so a repeated word is no hot key. What documents of one Arrow batch share is settled there: of a
hash that many of them hold, one row goes to the hash's other holders, and the rest are dealt out by document. So a header that
stands in every file is a row a batch, not a row a file. Exact copies of a document (same word sequence) are told by their digest
and skip the extension.

Defined cases: null or blank texts have no words; a document of fewer than WINDOW words keeps all; a null doc_id neither
loses words nor makes others lose them; rows of equal doc_id don't affect each other; ties can't arise, as only a
smaller doc_id counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Words, chunks, cut, mix, tidy

#: A perfect difference set of 6 residues modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
WINDOW = 50
_U = np.uint64


def _on_cover() -> np.ndarray:
    out = np.zeros(PERIOD, bool)
    out[list(COVER)] = True
    return out


def _places(w: Words) -> np.ndarray:
    return np.arange(len(w.hash)) - np.repeat(w.first, w.count)


def _anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the anchor from each word on, and whether it starts on the cover and lies in a document long enough."""
    h, ok = w.windows(window - PERIOD + 1)
    return h, ok & _on_cover()[_places(w) % PERIOD] & np.repeat(w.count >= window, w.count)


def _second(w: Words, window: int) -> np.ndarray:
    """Another 32 bits of each window's hash, from remixed words."""
    n = len(w.hash)
    total = np.zeros(n + 1, _U)
    np.cumsum(mix(w.hash ^ _U(0x6A09E667F3BCC909)), out=total[1:])
    out = np.zeros(n, np.int32)
    if n >= window:
        out[: n - window + 1] = (mix(total[window:] - total[: n - window + 1]) >> _U(33)).astype(np.int32)
    return out


def _distinct(row: np.ndarray, h: np.ndarray, *more: np.ndarray):
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new], *(m[order][new] for m in more)


def _rows_of(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.count)), w.count)


def _digests(w: Words, window: int):
    """Rows of a window's words at least, and a hash of all words of each."""
    long = np.flatnonzero(w.count >= window)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(w.hash + _places(w).astype(_U) * _U(0x9E3779B97F4A7C15)))])
    return long, mix(total[w.first[long] + w.count[long]] - total[w.first[long]])


def _copied(w: Words, window: int, copies: pa.Array, first: int) -> np.ndarray:
    """Whether a row's own digest is among the copied ones of its doc_id."""
    long, digest = _digests(w, window)
    out = np.zeros(len(w.count), bool)
    out[long] = _in_lists(long, digest, copies, first)
    return out


def _settle(doc: np.ndarray, *key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of (doc, key): whether a smaller doc holds its key here, and whether another one does."""
    order = np.lexsort((doc, *key))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    ordered = doc[order]
    least = np.repeat(ordered[first], sizes)
    most = np.repeat(ordered[first + sizes - 1], sizes) if len(first) else least
    later, several = np.empty(len(order), bool), np.empty(len(order), bool)
    later[order], several[order] = ordered > least, most > least
    return later, several


def shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, copies (digests of its rows whose words a smaller doc_id has too), anchors (hashes of its shared anchors); documents without either are left out."""

    def emit(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for i, j, data, offsets in chunks(batch.column(1)):
                w = Words(data, offsets, False)
                h, ok = _anchors(w, window)
                row, h = _distinct(_rows_of(w)[ok], h[ok])
                long, digest = _digests(w, window)
                parts.append((ids[i:j][np.concatenate([row, long])], np.concatenate([h, digest]), np.concatenate([np.zeros(len(h), np.int64), w.count[long]])))
            if not parts:
                continue
            doc, h, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            later, several = _settle(doc, h, n)
            # anchors that documents of the batch share are settled for all of these; the least of them stands for them elsewhere
            told = np.where(n > 0, np.where(later, -2, n), np.where(several, -1, 0))
            again = several & (n == 0) & ~later
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.append(doc, doc[again])), "hash": pa.array(np.append(h, h[again]).view(np.int64)), "n": pa.array(np.append(told, n[again]).astype(np.int32))})

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(emit), "doc_id long, hash long, n int")
    same = Window.partitionBy("hash", "n", F.when(F.col("n") < 0, F.col("doc_id")))
    found = rows.withColumns({"least": F.min("doc_id").over(same), "most": F.max("doc_id").over(same)})
    found = found.where("n < 0 OR least < most AND (n = 0 OR doc_id > least)")
    anchor = F.col("n").isin(0, -1)
    return found.groupBy("doc_id").agg(F.collect_set(F.when(~anchor, F.col("hash"))).alias("copies"), F.collect_set(F.when(anchor, F.col("hash"))).alias("anchors"))


def _in_lists(row: np.ndarray, h: np.ndarray, lists: pa.Array, first: int) -> np.ndarray:
    """Whether h is in the list of its row; rows count from first."""
    part = lists.slice(first, int(row.max()) + 1 if len(row) else 0)
    out = np.zeros(len(h), bool)
    if not len(part):
        return out
    bounds = np.searchsorted(row, np.arange(len(part) + 1))
    at = np.asarray(part.offsets)
    values = np.asarray(part.values).view(np.uint64) if len(part.values) else np.zeros(0, _U)
    for k in range(len(part)):
        if at[k + 1] > at[k]:
            a, b = bounds[k], bounds[k + 1]
            out[a:b] = np.isin(h[a:b], values[at[k] : at[k + 1]])
    return out


def _candidate_windows(window: int):
    def emit(batches):
        for batch in batches:
            keys, texts, lists, copies = (batch.column(c) for c in range(4))
            ids, parts = keys.to_numpy(), []
            for i, j, data, offsets in chunks(texts):
                w = Words(data, offsets, False)
                h, ok = _anchors(w, window)
                row = _rows_of(w)
                hit = np.zeros(len(h), bool)
                hit[ok] = _in_lists(row[ok], h[ok], lists, i)
                n = len(h)
                seen = np.concatenate([[0], np.cumsum(hit)])
                full, ok = w.windows(window)
                chosen = ok & ~_copied(w, window, copies, i)[row] & (seen[np.minimum(np.arange(n) + PERIOD, n)] > seen[:-1])
                r, f, s = _distinct(row[chosen], full[chosen], _second(w, window)[chosen])
                parts.append((ids[i:j][r], f, s))
            if parts:
                doc, f, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc), "hash": pa.array(f.view(np.int64)), "more": pa.array(s), "lost": pa.array(_settle(doc, f, s)[0])})

    return emit


def _removed(window: int):
    def emit(batches):
        for batch in batches:
            keys, texts, copies, lists = (batch.column(c) for c in range(4))
            for i, j, data, offsets in chunks(texts):
                w = Words(data, offsets, False)
                full, ok = w.windows(window)
                row = _rows_of(w)
                hit = np.zeros(len(full), bool)
                hit[ok] = _in_lists(row[ok], full[ok], lists, i)
                step = np.zeros(len(full) + 1, np.int64)
                at = np.flatnonzero(hit)
                step[at] += 1
                np.add.at(step, at + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                copied = _copied(w, window, copies, i)
                digests, removed = [], np.zeros(j - i, np.int64)
                for k in range(j - i):
                    a, n = int(w.first[k]), int(w.count[k])
                    words = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    lost = gone[a : a + n]
                    if copied[k]:
                        words, removed[k] = [], n
                    elif lost.any():
                        words, removed[k] = [x for x, g in zip(words, lost.tolist(), strict=True) if not g], int(lost.sum())
                    digests.append((w.count[k], b" ".join(words)))
                yield i, j, keys, w.count, removed, digests

    return emit


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    info = cut(shared_anchors(docs, window), "shared-anchors")
    # both joins deal the texts out by doc_id in the same way, so Spark reuses the one exchange
    # (the test is kept from turning the left join into another one, which would deal its own texts out)
    wanted = F.when(F.spark_partition_id() >= 0, F.coalesce(F.size("anchors") > 0, F.lit(False)))
    windows = docs.join(info, "doc_id", "left").where(wanted).select("doc_id", "text", "anchors", "copies").mapInArrow(tidy(_candidate_windows(window)), "doc_id long, hash long, more int, lost boolean")
    least = F.min("doc_id").over(Window.partitionBy("hash", "more", F.when(F.col("lost"), F.col("doc_id"))))
    lost = windows.withColumn("least", least).where("lost OR doc_id > least").groupBy("doc_id").agg(F.collect_set("hash").alias("windows"))
    marks = lost.join(info.where(F.size("copies") > 0).select("doc_id", "copies"), "doc_id", "full")
    body = _removed(window)

    def emit(batches):
        for i, j, keys, count, removed, kept in body(batches):
            out = {"doc_id": keys.slice(i, j - i), "n_words": pa.array(count.astype(np.int64)), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for _, x in kept])}
            if with_text:
                out["kept_text"] = pa.array([x.decode("utf-8", "replace") for _, x in kept])
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.join(marks, "doc_id", "left").select("doc_id", "text", F.coalesce("copies", F.array().cast("array<bigint>")).alias("copies"), F.coalesce("windows", F.array().cast("array<bigint>")).alias("windows")).mapInArrow(tidy(emit), schema)
