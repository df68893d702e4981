"""Mixing sources to target weights by the cube method.

targets() fills the weights: every source gets its share of all words, stops at cap times its own, and the excess is shared
anew. A source at ratio r takes each document floor(r) times; the fraction of r is left to a balanced sample: every
document starts with that inclusion probability, and the flight phase moves the probabilities of three documents at a
time along the null space of the two balancing equations (words and documents of the source), until one of them is 0 or
1. So every step keeps both totals. At most two documents a group stay undecided, and a few wait; a second flight over
those of one source leaves a dozen, the landing: of their subsets, the one whose words come nearest the target.

Groups are (source, hash of doc_id) with a number of groups that follows a source's rows, so a hot source is many small
tasks, and results don't depend on partitions. What a thousand groups leave open is one group of the next level, until a source has
one; so no task holds more than some thousands of units. Held back for the landing are units whose sizes come nearest to powers of
two, as their subsets reach almost any rest. Sources are a table like any other: weights follow from ranks in it, and the
targets from a few sums over it. Only (doc_id, source, size) is shuffled.

Defined cases: null texts have size 0, and documents of size 0 ride along in flight as any other; a null source is a
source of its own, last in the order of weights; rows with equal doc_id, text and source are alike and ordered by a hash of their
columns; an empty table gives no rows; a table of empty texts takes nothing; all columns stay with mixed_documents(), whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch, clean_name, cut, n_words, partitions

WEIGHTS, CAP, GROUP_ROWS, HELD, SEED = (1.0, 2.0, 3.0), 3.0, 4000, 10, 20240
#: Groups whose open units are one group of the next level.
LEVEL = 1000


def source_table(units: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source, source_size, rows, weight: weights repeat in the sources' order by code point, null last."""
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    last = F.col("source").isNull()
    placed = sums.repartitionByRange(min(64, partitions(units.sparkSession)), last, "source").sortWithinPartitions(last, "source")
    placed = cut(placed.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before, total = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a partition
        before[r.part], total = total, total + r.n
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), part) if before else F.lit(0)
    rank = start + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return placed.select("source", "source_size", "rows", weight.alias("weight"))


def with_targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources with target: sizes are shared by weight, at most cap times a source's own; the excess is shared anew by weight among the
    others. A source that is full stays so, as each round leaves the others more a weight; a round is one sum over the table."""
    size, weight, level = F.col("source_size"), F.col("weight"), -1.0
    whole = sources.agg(F.sum("source_size")).first()[0]
    while whole:
        full = weight * level > cap * size
        given, left = sources.agg(F.sum(F.when(full, cap * size).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(weight))).first()
        new = (whole - given) / left if left else level
        if not left or new <= level * (1 + 1e-12):
            break
        level = new
    return sources.withColumn("target", F.least(cap * size, weight * max(level, 0.0)))


def _flight(p: np.ndarray, x: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Move probabilities to 0 or 1, three units at a time, keeping sum(p) and sum(p * x); at most two stay between."""
    p, live, eps = p.copy(), [], 1e-9
    for k in range(len(p)):
        if eps < p[k] < 1 - eps:
            live.append(k)
        else:
            p[k] = round(p[k])
        while len(live) == 3:
            a, b, c = live
            d = (x[b] - x[c], x[c] - x[a], x[a] - x[b])  # null space of the rows (1, 1, 1) and x
            if d == (0, 0, 0):
                d = (1.0, -1.0, 0.0)
            up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(live, d, strict=True) if v)
            down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(live, d, strict=True) if v)
            step = up if u[k] * (up + down) < down else -down
            for i, v in zip(live, d, strict=True):
                p[i] += step * v
                if p[i] < eps or p[i] > 1 - eps:
                    p[i] = round(p[i])
            live = [i for i in live if 0 < p[i] < 1]
    return p


def _draws(ids: pd.Series, seed: int) -> np.ndarray:
    """Uniform draws that depend on doc_id alone."""
    from .common import mix

    h = mix(ids.fillna(-1).to_numpy(np.int64).view(np.uint64) ^ np.uint64(seed))
    return (h >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _held(sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """HELD units whose sizes come nearest to 1, 2, 4 and so on."""
    free = np.ones(len(sizes), bool)
    for k in range(min(HELD, len(sizes))):
        left = np.flatnonzero(free)
        free[left[np.lexsort((draws[left], np.abs(sizes[left] - (1 << k))))[0]]] = False
    return np.flatnonzero(~free)


def _fly(frame: pd.DataFrame, hold: bool, seed: int) -> pd.DataFrame:
    """Flight over frame's units; if hold, some of them wait for the landing."""
    frame = frame.sort_values(["doc_id", "size", "unit"], kind="stable", na_position="first").reset_index(drop=True)
    p, x, draws = frame["p"].to_numpy().copy(), frame["size"].to_numpy(np.float64), _draws(frame["doc_id"], seed)
    p = np.where((p < 1e-9) | (p > 1 - 1e-9), np.round(p), p)
    fly = (p > 0) & (p < 1)
    if hold:
        open_ = np.flatnonzero(fly)
        fly[open_[_held(x[open_], draws[open_])]] = False
    p[fly] = _flight(p[fly], x[fly].tolist(), draws[fly])
    frame["p"] = p
    return frame


def cube_flight(frame: pd.DataFrame) -> pd.DataFrame:
    """Flight over one group; a source's first group holds units back."""
    return _fly(frame, frame["bucket"].iloc[0] == 0, SEED)


def cube_landing(frame: pd.DataFrame) -> pd.DataFrame:
    """A second flight over what the groups of a source left, until HELD + 2 units are open; of their subsets, the one
    with the nearest totals: words first, then documents."""
    x = frame["size"].to_numpy(np.float64)
    words, count = float((frame["p"] * x).sum()), float(frame["p"].sum())
    frame = _fly(frame, True, SEED + 1)
    p, x = frame["p"].to_numpy().copy(), frame["size"].to_numpy(np.float64)
    rest = np.flatnonzero((p > 0) & (p < 1))
    sets = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    p[rest] = 0
    off = np.abs(sets @ x[rest] + float((p * x).sum()) - words) + 0.5 * np.abs(sets.sum(1) + p.sum() - count)
    p[rest] = sets[int(np.argmin(off))]
    frame["p"] = p
    return frame


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, unit (tells rows of one doc_id apart), size, source_size, target, copies, taken; a row a document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text", "source").alias("unit"))
    scratch = Scratch()
    units = scratch.cut(sized, "units")
    facts = scratch.cut(with_targets(source_table(units, weights), cap).drop("weight"), "targets")
    most = -(-(facts.agg(F.max("rows")).first()[0] or 0) // GROUP_ROWS)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups = F.ceil(F.col("rows") / F.lit(GROUP_ROWS))
    known = units.join(facts, units["source"].eqNullSafe(facts["source"]), "left").drop(facts["source"])
    known = known.withColumns({"whole": F.floor(ratio + 1e-12).cast("long"), "bucket": F.pmod(F.xxhash64("doc_id", "unit"), groups)})
    known = known.withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    columns = "doc_id long, source string, size long, unit long, source_size long, target double, whole long, bucket long, p double"
    known = known.select(*(c.split()[0] for c in columns.split(", ")))
    flown = cut(known.groupBy("source", "bucket").applyInPandas(cube_flight, columns), "flown")
    open_ = (F.col("p") > 0) & (F.col("p") < 1)
    done, rest = flown.where(~open_), flown.where(open_)
    scratch.clear()
    while most > LEVEL:
        again = rest.withColumn("bucket", F.floor(F.col("bucket") / LEVEL).cast("long"))
        flown = cut(again.groupBy("source", "bucket").applyInPandas(cube_flight, columns), "flown")
        done, rest, most = done.unionByName(flown.where(~open_)), flown.where(open_), -(-most // LEVEL)
    done = done.unionByName(rest.groupBy("source").applyInPandas(cube_landing, columns))
    copies = F.col("whole") + F.round("p").cast("long")
    return done.select("doc_id", "unit", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: docs' columns, each row as many times as the mix takes it."""
    unit, times, key = (clean_name(docs, x) for x in ("mix_unit", "mix_times", "mix_doc"))
    # rows that agree in doc_id, text and source share their copies in the order of a hash of all columns
    order = clean_name(docs, "mix_nth")
    takes = mix(docs, weights, cap).select(F.col("doc_id").alias(key), F.col("unit").alias(unit), F.col("copies").alias(times))
    takes = takes.withColumn(order, F.row_number().over(Window.partitionBy(key, unit).orderBy(F.desc(times))))
    plain = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()]
    numbered = docs.withColumns({unit: F.xxhash64("text", "source"), order: F.xxhash64(*plain)})
    numbered = numbered.withColumn(order, F.row_number().over(Window.partitionBy("doc_id", unit).orderBy(order)))
    same = numbered["doc_id"].eqNullSafe(takes[key]) & (numbered[unit] == takes[unit]) & (numbered[order] == takes[order])
    joined = numbered.join(takes, same).where(F.col(times) > 0)
    return joined.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*[docs[c] for c in docs.columns])
