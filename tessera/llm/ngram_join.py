"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set is its distinct five-word shingles (hashed to 64 bits). By size band the universe of shingles is parted into
m segments by hash; a document's segment subset is what it has of one. Two sets of Jaccard similarity 0.75 or more differ
in at most T = size / 3 shingles, so all but T of the m subsets agree. Each document indexes its T + 1 cheapest
subsets; cost depends on a subset alone (empty ones cost most, then those whose rarest shingle is frequent), so two documents
order their common subsets alike and the cheapest common one is indexed by both. A document with fewer than T + 1
subsets that aren't empty also indexes their one-deletion neighbourhoods; where even these can't meet, it goes into an overflow
group of its band. Sizes near a band's upper end index in the next band too.

A key also says how late it comes in its document's order. All subsets before the cheapest common one of two sets differ, and one that
holds a single shingle is a difference of its own, so with s such subsets before it in one set of n shingles and s' in one of n',
7 * (s + s') <= n + n' for sets that link. Each index row carries lead = 7 s - n; pairs whose leads add up to more than 0 aren't candidates at that
key, and a key's rows that even its least lead rules out go before anything else. So passages that many documents share, whose
shingles come last in the order, link nothing by themselves. Keys that the same documents share then count as one group.

Documents of a group are candidates; pairs that sizes or parity bits rule out go. Equal sets link by their digest, and a task
indexes a set once however many copies it meets. Then every document is verified against a centre of its groups, the one it shares
most keys with: a group's centre is its document of the least lead, which has fewest rare shingles of its own. Linked documents become
components, and documents of groups that still hold several are tried against a centre of another component, one each a round, as long
as that links many. Only pairs across components that share a key are looked at after that. Their rows carry a fixed number of
parity bits, so the join that meets them rules nearly all out and hands on no pair that these bits tell apart. So a group of copies,
near or equal, costs its size for most of its links, and no link between components is lost; documents that are near each
other, but not near enough, still meet pair by pair inside that join, and those a few shingles short of a link come out of it.

Frequencies of shingles for the cost order are counted over all documents in bounded summaries (a shingle missing from them
counts as rare: dearer, never wrong). Keys that these find frequent are dealt out in several parts, and only their least lead
and their members' sums are put together, by pre-aggregation and a join that adaptive execution may split.

Defined cases: fewer than five words: the whole sequence is one shingle; a null or blank text has an empty set and links with
nothing; a null doc_id links with nothing and its component is null; rows that repeat a doc_id are one node, whose
set is that of each row; an empty table gives no rows; other columns stay in first_of_each().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from .common import Scratch, Words, chunks, clean_name, cut, mix, tidy
from .components import components

SHINGLE, PERCENT = 5, 75
#: Sizes up to FIRST_BAND are parted into SEGMENTS * FIRST_BAND segments; each next band is BAND_STEP times as wide.
FIRST_BAND, BAND_STEP, SEGMENTS = 1024, 8, 4
HOT_KEPT, HOT_SHARE, HOT_ROWS = 1 << 15, 1 / 4000, 1 << 19
#: Parity bits of a set: the least power of two that is no less than BITS_EACH times its size, and at least LEAST_BITS.
FILTER_BITS, LEAST_BITS, BITS_EACH = 1 << 22, 512, 8
#: Parity bits that rows of candidate groups carry at most; documents that one key may gather in one part; sets that a task remembers.
SKETCH_BITS, KEY_ROWS, REMEMBERED = 2048, 1 << 16, 100_000
#: Documents are tried against centres of their groups again while a round links at least this share of what the first one did.
NEXT_ROUND = 1 / 8
_U = np.uint64


def shingle_sets(data, offsets, size: int = SHINGLE):
    """Row and hash of each distinct shingle, sorted; and the number of words of each row."""
    w = Words(data, offsets, True)
    h, ok = w.windows(size)
    rows, hashes = [np.repeat(np.arange(len(w.count)), w.count)[ok]], [h[ok]]
    for k in range(1, size):
        short = np.flatnonzero(w.count == k)
        if len(short):
            rows.append(short)
            hashes.append(mix(w.windows(k)[0][w.first[short]] + _U(k)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new], len(w.count)


def bands(n: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each of at most two bands: which sizes index there, and its number of segments (one value a size)."""
    top = np.full(len(n), FIRST_BAND, np.int64)
    while (low := n > top).any():
        top[low] *= BAND_STEP
    upper = (n * 100) // PERCENT > top  # a partner may be in the next band
    return [(np.ones(len(n), bool), top * SEGMENTS), (upper, top * BAND_STEP * SEGMENTS)]


def index_keys(row, h, n_rows, hot: tuple[np.ndarray, np.ndarray]):
    """(row, key, lead, cost) of every subset that a document indexes."""
    n = np.bincount(row, minlength=n_rows)
    weight = np.zeros(len(h), np.int64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], h), len(hot[0]) - 1)
        weight = np.where(hot[0][at] == h, hot[1][at], 0)
    out = []
    for chosen, m in bands(n):
        use = chosen[row]
        if not use.any():
            continue
        r, x, c, m_of = row[use], h[use], weight[use], m[row[use]]
        segment = (mix(x ^ _U(0x5851F42D4C957F2D)) % m_of.astype(_U)).astype(np.int64)
        order = np.lexsort((x, segment, r))
        r, x, c, segment, m_of = r[order], x[order], c[order], segment[order], m_of[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (segment[1:] != segment[:-1])
        starts = np.flatnonzero(new)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(x))])
        ends = np.append(starts[1:], len(r))
        tag = mix(segment.astype(_U) * _U(1 << 20) + m_of.astype(_U))[starts]
        content = total[ends] - total[starts]
        key = mix(content ^ tag)
        cost = np.minimum.reduceat(c, starts)
        doc = r[starts]
        rank_order = np.lexsort((key, cost, doc))
        count = np.bincount(doc, minlength=n_rows)
        first = np.cumsum(count) - count
        rank = np.empty(len(doc), np.int64)
        rank[rank_order] = np.arange(len(doc)) - first[doc[rank_order]]
        single = np.zeros(len(doc) + 1, np.int64)
        np.cumsum((ends - starts == 1)[rank_order], out=single[1:])
        before = np.empty(len(doc), np.int64)
        before[rank_order] = single[:-1] - single[first[doc[rank_order]]]
        need = n // 3 + 1
        take = rank < need[doc]
        out.append((doc[take], key[take], 7 * before[take] - n[doc[take]], cost[take]))
        few = np.flatnonzero(chosen & (count < need) & (n > 0))
        if len(few):
            short = np.isin(doc, few)
            for s, e, d, t, full in zip(starts[short], ends[short], doc[short], tag[short], content[short], strict=True):
                less = mix((full - mix(x[s:e])) ^ t ^ _U(1))  # what the subset is without one shingle
                out.append((np.full(e - s + 1, d), np.append(less, mix(np.array([full ^ t ^ _U(1)], _U))), np.full(e - s + 1, -n[d]), np.zeros(e - s + 1, np.int64)))
            lost = few[2 * count[few] <= n[few] // 3]
            if len(lost):
                out.append((lost, mix(m[lost].astype(_U) ^ _U(0xA5A5A5A5)), -n[lost], np.zeros(len(lost), np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def digests(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(h + _U(0x51ED270B)))])
    ends = np.cumsum(n)
    return mix((total[ends] - total[ends - n]) ^ n.astype(_U))


class _Seen:
    """Sets that a task has met, as many as it remembers."""

    def __init__(self):
        self.known: set[int] = set()

    def new(self, digest: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digest), bool)
        for k, d in enumerate(digest.tolist()):
            if d not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known.add(d)
                out[k] = True
        return out


class _Counts:
    """A bounded summary of the most frequent shingles of a task."""

    def __init__(self):
        self.keys, self.counts, self.rows = np.zeros(0, _U), np.zeros(0, np.int64), 0

    def add(self, h: np.ndarray, rows: int) -> None:
        self.rows += rows
        u, c = np.unique(h, return_counts=True)
        keys, where = np.unique(np.concatenate([self.keys, u]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([self.counts, c]), minlength=len(keys)).astype(np.int64)
        if len(keys) > 8 * HOT_KEPT:
            best = np.sort(np.argpartition(-counts, HOT_KEPT)[:HOT_KEPT])
            keys, counts = keys[best], counts[best]
        self.keys, self.counts = keys, counts

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        keep = self.counts >= max(3, self.rows * HOT_SHARE)
        return self.keys[keep], self.counts[keep]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def survey(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, parity and sketch of every row: bit k of parity is the number of shingles in bucket k modulo
    2, and sketch is parity folded to SKETCH_BITS. Rows whose n_shingles is null hold a task's frequent shingles, hot and n_hot."""
    schema = "doc_id long, n_shingles long, digest long, parity array<long>, sketch array<long>, hot array<long>, n_hot array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def emit(batches):
        counts, seen = _Counts(), _Seen()
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1)):
                row, h, rows = shingle_sets(data, offsets)
                n = np.bincount(row, minlength=rows)
                digest = digests(row, h, n)
                new = seen.new(digest)
                counts.add(h[new[row]], int(new.sum()))
                bits = np.full(rows, LEAST_BITS, np.int64)
                while (low := bits < BITS_EACH * n).any():
                    bits[low] *= 2
                begin = np.cumsum(bits) - bits
                bit = begin[row] + (mix(h ^ _U(0x2F0B4C47)) & (bits[row] - 1).astype(_U)).astype(np.int64)
                odd = np.zeros(int(bits.sum()) // 8, np.uint8)
                np.bitwise_xor.at(odd, bit >> 3, np.left_shift(1, bit & 7).astype(np.uint8))
                odd = odd.view(np.int64)
                few = np.minimum(bits, SKETCH_BITS)
                short = [np.bitwise_xor.reduce(odd[a // 64 : (a + k) // 64].reshape(-1, f // 64), 0) for a, k, f in zip(begin.tolist(), bits.tolist(), few.tolist(), strict=True)]
                none = pa.nulls(rows, pa.list_(pa.int64()))
                columns = [batch.column(0).slice(i, j - i), pa.array(n), pa.array(digest.view(np.int64)), _lists(odd, bits // 64), _lists(np.concatenate(short), few // 64), none, none]
                yield pa.RecordBatch.from_arrays(columns, names)
        hot, times = counts.frequent()
        if len(hot):
            size = np.array([len(hot)])
            none = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([*none, _lists(hot.view(np.int64), size), _lists(times, size)], names)

    return docs.mapInArrow(tidy(emit), schema)


def hot_shingles(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts, sorted by hash; at most HOT_ROWS of them."""
    rows = surveyed.where("n_shingles IS NULL").select(F.explode(F.arrays_zip("hot", "n_hot")).alias("x")).select("x.hot", "x.n_hot")
    top = rows.groupBy("hot").agg(F.sum("n_hot").alias("n")).orderBy(F.desc("n"), "hot").limit(HOT_ROWS).toArrow()
    h, n = top["hot"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def key_rows(docs: DataFrame, surveyed: DataFrame) -> DataFrame:
    """(key, part, doc_id, lead) of what documents index: a frequent key is dealt out in parts from 1, others have part 0. Of equal sets a task indexes the first
    it meets, as long as it remembers it."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_shingles(surveyed))

    def emit(batches):
        hot, seen = shared.value, _Seen()
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in chunks(batch.column(1)):
                row, h, rows = shingle_sets(data, offsets)
                use = seen.new(digests(row, h, np.bincount(row, minlength=rows)))[row]
                at, key, lead, cost = index_keys(row[use], h[use], rows, hot)
                own = ids.slice(i, j - i).take(pa.array(at))
                parts = (cost // KEY_ROWS).astype(_U)
                part = np.where(parts > 0, 1 + mix(np.asarray(own).astype(np.int64).view(_U)) % (parts + _U(1)), 0).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "part": pa.array(part), "doc_id": own, "lead": pa.array(lead.astype(np.int32))})

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(tidy(emit), "key long, part int, doc_id long, lead int")


def _members() -> dict[str, Column]:
    """Aggregates that tell the members of a key."""
    h = F.xxhash64("doc_id")
    return {"first": F.min("doc_id"), "last": F.max("doc_id"), "size": F.count(F.lit(1)), "low": F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), "high": F.sum(F.shiftrightunsigned(h, 32))}


def shared_groups(docs: DataFrame, surveyed: DataFrame, scratch: Scratch) -> DataFrame:
    """group_id, first, doc_id, lead, n_keys: documents that share keys; keys of the same documents are one group, with each document's least lead."""
    group = Window.partitionBy("key", "part")
    known = F.xxhash64("last", "size", "low", "high").alias("group_id")
    rows = key_rows(docs, surveyed).withColumn("least", F.min("lead").over(group)).where("part > 0 OR lead + least <= 0")
    rows = rows.withColumns({k: v.over(group) for k, v in _members().items()}).where("part > 0 OR first < last")
    rows = scratch.cut(rows.select("key", "part", known, "first", "doc_id", "lead"), "keys")
    wide = rows.where("part > 0").select("key", "doc_id", "lead")
    wide = wide.join(wide.groupBy("key").agg(F.min("lead").alias("least")), "key").where("lead + least <= 0")
    sums = wide.groupBy("key").agg(*[v.alias(k) for k, v in _members().items()]).where("first < last")
    wide = wide.join(sums, "key").select(known, "first", "doc_id", "lead")
    rows = rows.where("part = 0").select("group_id", "first", "doc_id", "lead").unionByName(wide)
    return rows.groupBy("group_id", "first", "doc_id").agg(F.min("lead").alias("lead"), F.count(F.lit(1)).alias("n_keys"))


def _most(a: str, b: str) -> Column:
    """By how many shingles sets of these sizes can differ at most, if they link."""
    return F.floor((F.col(a) + F.col(b)) * (100 - PERCENT) / (100 + PERCENT)).cast("long")


def sketches_differ(x: Column, y: Column) -> Column:
    """Number of differing bits of two sketches; the longer one is folded to the length of the other."""
    count = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda a, n: a + n)
    half = lambda p: F.transform(F.slice(p, 1, F.size(p) / 2), lambda v, i: v.bitwiseXOR(F.get(p, i + (F.size(p) / 2).cast("int"))))
    return F.when(F.size(x) == F.size(y), count(x, y)).when(F.size(x) == 2 * F.size(y), count(half(x), y)).when(2 * F.size(x) == F.size(y), count(x, half(y))).otherwise(F.lit(0))


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """Number of differing parity bits; the longer one is folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    odd = np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0) ^ y
    return int(np.bitwise_count(odd.view(_U)).sum(dtype=np.int64))  # of signed numbers numpy counts the bits of the absolute value


def could_link(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) that may be similar: by sizes, and as every shingle in one set alone flips one bit, by differing parity bits."""

    @F.arrow_udf(BooleanType())
    def near(x: pa.Array, y: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array([_differing(p.values.to_numpy(), q.values.to_numpy()) <= k for p, q, k in zip(x, y, most.to_pylist(), strict=True)], pa.bool_())

    side = lambda k: known.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"{k}_n"), F.col("parity").alias(f"{k}_p"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n"))
    return both.where(near("a_p", "b_p", _most("a_n", "b_n"))).select("a", "b").distinct()


def equal_sets(known: DataFrame) -> DataFrame:
    """(a, b, whole): documents b whose set an earlier document a has too; whole: b has no other set."""
    some = known.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "digest")
    first = some.groupBy("digest").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("digest", "a")
    several = some.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 != d1").select(F.col("doc_id").alias("b"), F.lit(False).alias("whole"))
    pairs = some.join(first, "digest").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()
    return pairs.join(several, "b", "left").select("a", "b", F.coalesce("whole", F.lit(True)).alias("whole"))


def _possible(ids: DataFrame):
    """A test that all of ids pass and few others, of fixed size: FILTER_BITS bits."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    bits = np.zeros(FILTER_BITS, bool)
    bits[ids.select(slot("doc_id").alias("s")).distinct().toArrow()["s"].to_numpy()] = True
    shared = ids.sparkSession.sparkContext.broadcast(np.packbits(bits))

    @F.arrow_udf(BooleanType())
    def test(s: pa.Array) -> pa.Array:
        x = s.to_numpy()
        return pa.array((shared.value[x >> 3] >> (7 - (x & 7))) & 1 == 1)

    return lambda c: test(slot(c))


def verify(pairs: DataFrame, texts: DataFrame, per_task: int = 256) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets are similar. An a with many partners is copied to several groups."""
    copies = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("parts"))
    right = pairs.join(copies, "a").select("a", F.pmod(F.hash("b"), "parts").alias("part"), F.col("b").alias("doc_id"))
    left = copies.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))
    both = left.withColumn("right", F.lit(False)).unionByName(right.withColumn("right", F.lit(True))).join(texts, "doc_id")
    dealt = both.repartition("a", "part").sortWithinPartitions("a", "part", "right", "doc_id").select("a", "part", "right", "doc_id", "text")

    def emit(batches):
        at, sets = None, []
        for batch in batches:
            a, part, right, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            out_a, out_b = [], []
            for i, j, data, offsets in chunks(batch.column(4)):
                row, h, rows = shingle_sets(data, offsets)
                ends = np.searchsorted(row, np.arange(rows + 1))
                for k in range(rows):
                    own = h[ends[k] : ends[k + 1]]
                    if (a[i + k], part[i + k]) != at:
                        at, sets = (a[i + k], part[i + k]), []
                    if not right[i + k]:
                        sets.append(own.copy())
                        continue
                    for first in sets:
                        common = len(np.intersect1d(own, first, assume_unique=True))
                        if common and 100 * common >= PERCENT * (len(own) + len(first) - common):
                            out_a.append(a[i + k])
                            out_b.append(ids[i + k])
                            break
            yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.mapInArrow(tidy(emit), "a long, b long")


def open_groups(groups: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows of groups that hold several components, with c, the document's component, and the group's centre, its document of the least lead."""
    rows = groups.withColumn("c", F.col("doc_id")) if found is None else groups.join(found, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    ends = rows.groupBy("group_id", "first").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("lead", "doc_id", "c")).alias("m")).where("c0 < c1")
    return rows.join(ends.select("group_id", "first", F.col("m.doc_id").alias("centre"), F.col("m.c").alias("centre_c")), ["group_id", "first"])


def links(docs: DataFrame, surveyed: DataFrame) -> DataFrame:
    """node, component of every document that links with another one; surveyed: survey of docs."""
    scratch = Scratch()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = surveyed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "digest", "parity", "sketch")
    equal = scratch.cut(equal_sets(known), "equal-sets")
    # copies of a set are represented by their first document
    same = equal.where("whole").select(F.col("b").alias("doc_id"), F.col("a").alias("rep"))
    first = same.select(F.col("doc_id").alias("first"), F.col("rep").alias("rep_first"))
    groups = shared_groups(docs, surveyed, scratch).join(same, "doc_id", "left").join(first, "first", "left")
    groups = groups.select("group_id", F.coalesce("rep_first", "first").alias("first"), F.coalesce("rep", "doc_id").alias("doc_id"), "lead", "n_keys")
    groups = scratch.cut(groups.groupBy("group_id", "first", "doc_id").agg(F.min("lead").alias("lead"), F.sum("n_keys").alias("n_keys")), "groups")
    sure = tried = equal.select("a", "b").limit(0)
    found, n_linked = None, []
    while True:
        counted = open_groups(groups, found).where("c != centre_c").groupBy("doc_id", "centre").agg(F.sum("n_keys").alias("n"))
        counted = counted.withColumns({"a": F.least("doc_id", "centre"), "b": F.greatest("doc_id", "centre")}).join(tried, ["a", "b"], "left_anti")
        best = counted.groupBy("doc_id").agg(F.max_by("centre", F.struct("n", -F.col("centre"))).alias("a")).select("a", F.col("doc_id").alias("b"))
        best = scratch.cut(best, "first-pairs")
        tried = tried.unionByName(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        near = scratch.cut(could_link(best, known), "near-pairs")
        linked = scratch.cut(verify(near, candidate_texts(docs, near, scratch)), "verified")
        sure = sure.unionByName(linked)
        found = components(sure, "a", "b").select(F.col("node").alias("doc_id"), "component")
        n_linked.append(linked.count())
        if n_linked[-1] <= NEXT_ROUND * n_linked[0]:
            break
    placed = scratch.cut(open_groups(groups, found).drop("centre", "centre_c", "n_keys").join(known.select("doc_id", "n_shingles", "sketch").distinct(), "doc_id"), "open-groups")
    x, y = (placed.select("group_id", "first", *[F.col(c).alias(f"{k}_{c}") for c in ("doc_id", "lead", "n_shingles", "sketch", "c")]) for k in "xy")
    apart = (F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_c") != F.col("y_c")) & (F.col("x_lead") + F.col("y_lead") <= 0)
    sizes = 100 * F.least("x_n_shingles", "y_n_shingles") >= PERCENT * F.greatest("x_n_shingles", "y_n_shingles")
    near = sketches_differ(F.col("x_sketch"), F.col("y_sketch")) <= _most("x_n_shingles", "y_n_shingles")
    met = (x["group_id"] == y["group_id"]) & (x["first"] == y["first"])
    across = x.join(y, met & apart & sizes & near).select(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).distinct()
    across = scratch.cut(across.join(tried, ["a", "b"], "left_anti"), "met")
    across = scratch.cut(could_link(across, known), "more-pairs")
    more = scratch.cut(verify(across, candidate_texts(docs, across, scratch)), "verified")
    out = components(sure.unionByName(more).unionByName(equal.select("a", "b")), "a", "b")
    scratch.clear()
    return out


def candidate_texts(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Texts of the documents in pairs; a fixed-size filter keeps most others from being dealt out."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    maybe = _possible(ids)
    return scratch.cut(docs.where(maybe("doc_id")).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "candidate-texts")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id; a row a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    surveyed = cut(survey(docs), "survey")
    found = links(docs, surveyed)
    out = surveyed.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the least doc_id; documents that link with nothing stay, rows that repeat a doc_id stay or go together."""
    node, scratch = clean_name(docs, "join_node"), Scratch()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = links(texts, scratch.cut(survey(texts), "survey")).where(F.col("node") != F.col("component")).select(F.col("node").alias(node))
    scratch.clear()
    return docs.join(gone, docs["doc_id"] == gone[node], "left_anti")
