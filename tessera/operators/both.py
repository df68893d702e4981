"""Dense search and BM25 in one pass over texts, for a batch of questions.

A task embeds a few hundred texts at a time, meets them with all questions of a block, and keeps each question's k best by either score; vectors
never leave the task. A block of questions goes to all executors; more questions take more passes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT
from ..functions import text as T
from ..shared import keep
from . import embedding as E, sparse as S

#: Numbers in a block of questions, and in a table of scores of texts by questions; questions whose vectors are doubles at once.
NUMBERS, TILE, HIGH = 1 << 24, 1 << 22, 1 << 11
#: Terms that a matrix product takes at most, and questions that have one at least.
COMMON, LEAST = 256, 32


class _Best:
    """The k best texts of each question so far; ties by key."""

    def __init__(self, k: int, n: int, above: float):
        self.k, self.n, self.least, self.above = k, n, np.full(n, -np.inf), above
        self.held, self.size, self.first = [], 0, True

    def add(self, scores: np.ndarray, keys: pa.Array, dense: np.ndarray) -> None:
        """scores and dense: texts by questions."""
        if self.first and len(scores) >= self.k:
            least = np.round(np.partition(scores.T.copy(), len(scores) - self.k, axis=1)[:, len(scores) - self.k], 6)
            self.least, self.first = np.maximum(self.least, least), False
        # what may round to the least that is wanted
        d, q = np.nonzero(scores >= np.maximum(self.least - 1e-6, self.above + 4e-7))
        score = np.round(scores[d, q], 6) + 0.0
        stays = (score >= self.least[q]) & (score > self.above)
        d, q, score = d[stays], q[stays], score[stays]
        self.held.append(pa.table({"q": q, "score": score, "key": keys.take(pa.array(d)), "dense": np.round(dense[d, q], 6) + 0.0}))
        self.size += len(q)
        if self.size > (1 << 18) + 4 * self.k * self.n:
            self.cut()

    def cut(self) -> pa.Table:
        t = pa.concat_tables(self.held).sort_by([("q", "ascending"), ("score", "descending"), ("key", "ascending")])
        q = t["q"].to_numpy()
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        last = np.flatnonzero(place == self.k - 1)
        self.least[q[last]] = np.maximum(self.least[q[last]], t["score"].to_numpy()[last])
        t = t.filter(pa.array(place < self.k))
        self.held, self.size = [t], len(t)
        return t


def _common(starts: np.ndarray, asks: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms of most questions, and their weights by questions."""
    asked = np.diff(starts)
    common = np.flatnonzero(asked >= LEAST)
    common = np.sort(common[np.argsort(-asked[common], kind="stable")][:COMMON])
    table = np.zeros((len(common), n))
    for i, t in enumerate(common):
        table[i, asks[starts[t] : starts[t + 1]]] = weights[starts[t] : starts[t + 1]]
    return common, table


def _lexical(lists: pa.Array, terms: dict[str, int], starts: np.ndarray, asks: np.ndarray, weights: np.ndarray, common: tuple[np.ndarray, np.ndarray], n: int, avgdl: float, config) -> np.ndarray:
    """BM25 of texts (lists of content words) by questions; a term's questions are asks[starts[t] : starts[t + 1]]. Common terms are a product of
    matrices, others are added in their order."""
    out = np.zeros((len(lists), n))
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    if not len(coded):
        return out
    number = np.array([terms.get(S.stemmed(w), -1) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    doc, asked = np.repeat(np.arange(len(lists)), sizes), number >= 0
    own, tf = np.unique(number[asked] * len(lists) + doc[asked], return_counts=True)
    t, d = np.divmod(own, len(lists))
    k1, b = config.bm25_k1, config.bm25_b
    w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[d] / avgdl))
    place = np.searchsorted(common[0], t)
    often = (place < len(common[0])) & (np.append(common[0], -1)[place] == t)
    table = np.zeros((len(lists), len(common[0])))
    table[d[often], place[often]] = w[often]
    np.matmul(table, common[1], out=out)
    t, d, w = t[~often], d[~often], w[~often]
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)) if len(t) else []
    i = 0
    for j in ends:
        of = slice(starts[t[i]], starts[t[i] + 1])
        out[d[i:j, None], asks[of]] += w[i:j, None] * weights[of]
        i = j
    return out


def _scan(words: DataFrame, asked: DataFrame, weights: DataFrame, avgdl: float, dense_k: int, sparse_k: int, dim: int, config) -> DataFrame:
    """qid, key, by (d or s), score, dense of a block of questions: each task's best. asked: qid, embedding; weights: qid, term, weight."""
    rows = asked.toArrow()  # a block
    ids = rows["qid"].combine_chunks()
    wanted = np.asarray(rows["embedding"].combine_chunks().flatten(), np.float32).reshape(len(ids), dim)
    w = weights.toArrow()  # the block's terms
    coded = w["term"].combine_chunks().dictionary_encode()
    vocab = coded.dictionary.to_pylist()
    names = sorted(vocab)
    terms = {t: i for i, t in enumerate(names)}
    number = np.array([terms[t] for t in vocab], np.int64)[coded.indices.to_numpy()] if len(w) else np.zeros(0, np.int64)
    at = np.asarray(pc.index_in(w["qid"].combine_chunks(), value_set=ids), np.int64)
    order = np.lexsort((at, number))
    starts = np.append(0, np.cumsum(np.bincount(number, minlength=len(names)))).astype(np.int64)
    shared = words.sparkSession.sparkContext.broadcast((ids, wanted, terms, starts, at[order], np.asarray(w["weight"], float)[order]))
    kind = lambda d, c: d.schema[c].dataType.simpleString()

    def run(batches):
        ids, wanted, terms, starts, asks, weights = shared.value
        n = len(ids)
        if not n:
            return
        near, lexical = _Best(dense_k, n, -np.inf), _Best(sparse_k, n, 0.0)
        common = _common(starts, asks, weights, n)
        few = max(1, min(E.PIECE_TEXTS, TILE // max(1, n)))
        for batch in batches:
            for i in range(0, batch.num_rows, few):
                part = batch.slice(i, few)
                keys, lists = part.column(0), part.column(1).cast(pa.list_(pa.string()))
                vecs = E.embed_lists(lists, dim).astype(np.float32).astype(np.float64)
                dense = np.empty((len(keys), n))
                for top in range(0, n, HIGH):
                    dense[:, top : top + HIGH] = vecs @ wanted[top : top + HIGH].T.astype(np.float64)
                near.add(dense, keys, dense)
                lexical.add(_lexical(lists, terms, starts, asks, weights, common, n, avgdl, config), keys, dense)
        for name, best in (("d", near), ("s", lexical)):
            if best.held:
                t = best.cut()
                yield from pa.table({"qid": ids.take(t["q"].combine_chunks()), "key": t["key"], "by": pa.array([name] * len(t), pa.string()), "score": t["score"], "dense": t["dense"]}).combine_chunks().to_batches(1 << 14)

    return words.mapInArrow(run, f"qid {kind(asked, 'qid')}, key {kind(words, 'key')}, by string, score double, dense double")


def search(docs: DataFrame, queries: DataFrame, qid: str, question: str, indexed: DataFrame, key: str = "doc_id", text: str = "text", config=DEFAULT) -> DataFrame:
    """qid, key, by, score, dense: a question's dense_k best by cosine of the hashing embedder (by d) and sparse_k best by BM25 (by s) are among
    them, with their true cosine, both rounded to 6 digits. indexed: the postings of docs, or sparse.counted()."""
    asked = keep(E.hash_embed(queries, qid, question, config.embed_dim).withColumnRenamed("key", "qid"), "asked")
    weights, avgdl = S.term_weights(indexed, queries, qid, question)
    weights = keep(weights, "weights")
    words = docs.select(F.col(key).alias("key"), T.content_tokens(F.col(text)).alias("ws"))
    blocks = max(1, -(-asked.count() * config.embed_dim // NUMBERS))
    own = lambda d, b: d.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
    found = [keep(_scan(words, own(asked, b), own(weights, b), avgdl, config.dense_k, config.sparse_k, config.embed_dim, config), "met") for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)
