"""Hard-negative mining with angular triangle filtering (operator 13).

Vectors become whole numbers, and each row stores its norm and its angles to a few reference directions. Two vectors with
angles s and t to one reference are at least |s - t| and at most min(s + t, 2 pi - s - t) apart; the tightest interval
over all references, as cosines times both norms, bounds their score. The bounds are widened by more than the rounding
of angles and products can move them, so a score is never outside. Integer scores are computed only for rows whose bounds
overlap what an anchor looks for: more than the worst of its positives so far, or one of its windows above the worst
there. Filtering never changes a result; the references, picked from a sample, only decide how much it saves.

Rows lie in packed blocks of at most BLOCK bytes, sorted by label and nearest reference. Anchors are packed the same way,
and blocks of at most ANCHORS bytes are broadcast at a time; each such round reads the rows where they are,
without a shuffle of them, and joins blocks whose angle and norm ranges can hold a wanted score. A task keeps the best of
each anchor of a round, whatever the number of its rows; what tasks found is merged by a small window for each anchor.

Rows with a null id, label or vector, or a null or non-finite component take no part. Shorter vectors are filled with
zeros. Ties of scores go to the smaller id. Rows of one id count each, but an id that repeats is one anchor (the row of
its smallest label, then vector), and its rows are neither its positives nor its negatives. Anchors without other rows
of their label give no rows, as do windows without rows, and empty tables. Scores beyond 64 bits are an error. Columns
other than vec_id, label and embedding are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, stored

#: Bytes of a block's vectors, bytes of anchors that are broadcast at a time (and a block more), reference directions and
#: the sample of rows that these are picked from.
BLOCK, ANCHORS, REFERENCES, SAMPLE = 1 << 20, 1 << 24, 8, 1024
#: Positives of an anchor, negatives of a positive, and a negative's least and greatest score as hundredths of a positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
SCALE, NONE = 256, np.iinfo(np.int64).min


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with whole components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    some = some.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite))
    return some.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def relabelled(rows: DataFrame) -> DataFrame:
    """The labels as noise turns some of them: each seventh row has the next label."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def directions(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of a sample, each the farthest from those before."""
    norms = np.sqrt((sample * sample).sum(1))
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def references(rows: DataFrame, width: int, n: int = REFERENCES) -> np.ndarray:
    """Directions from SAMPLE rows with the least hashes."""
    some = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect()
    return directions(matrix(pa.array([r[0] for r in some], pa.list_(pa.int64())), width).astype(float), n)


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Lists as rows, filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def slack(width: int) -> float:
    """How far rounding can move the cosine of a difference of two computed angles: a cosine of width products is off by
    (width + 8) units in the last place, and where it is c off, its angle is by at most pi / 2 sqrt(2 c)."""
    return 2 * np.pi * np.sqrt(2 * (width + 8) * 2.0**-52)


PACKED = "block long, n int, goal double, labels array<long>, low array<double>, high array<double>, norm double, ids binary, label binary, v binary, norms binary, angles binary"


def packed(rows: DataFrame, refs: np.ndarray, width: int, windows: bool = False) -> DataFrame:
    """Blocks of rows: ids, labels, vectors, norms and angles as bytes, and the ranges of angles and norms. With windows,
    also the rows' `scores` of positives, and as `goal` the least of them that has a window."""
    size = max(16, BLOCK // (8 * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, made = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 16 * size:
                out = blocks(held, made)
                made += len(out)
                yield out
                held, n = [], 0
        if held:
            yield blocks(held, made)

    def blocks(held: list, made: int) -> pa.RecordBatch:
        from pyspark import TaskContext

        table = pa.Table.from_batches(held)
        v = matrix(table.column("v").combine_chunks(), width)
        ids, label = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "label"))
        x = v.astype(float)
        norms = np.sqrt((x * x).sum(1))
        cosines = np.divide(x @ refs.T, norms[:, None], out=np.zeros((len(x), len(refs))), where=norms[:, None] > 0)
        angles = np.arccos(np.clip(cosines, -1, 1))
        near = angles.argmin(1) if len(refs) else np.zeros(len(x), int)
        order = np.lexsort((ids, near, label))
        goals = matrix(table.column("scores").combine_chunks(), POSITIVES) if windows else np.zeros((len(v), 0), np.int64)
        if windows:
            there = np.diff(table.column("scores").combine_chunks().offsets.to_numpy())
            goals[np.arange(POSITIVES) >= there[:, None]] = NONE
        rows = []
        for i, at in enumerate(range(0, len(order), size)):
            o = order[at : at + size]
            block = (TaskContext.get().partitionId() << 33) + made + i
            ends = [angles[o].min(0).tolist(), angles[o].max(0).tolist()]
            rows.append((block, len(o), float(goals[o][goals[o] >= 0].min(initial=1 << 62)), np.unique(label[o]).tolist(), *ends, float(norms[o].max()), *(np.ascontiguousarray(c[o]).tobytes() for c in (ids, label, v, norms, angles, *[goals] * windows))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    doubles = pa.list_(pa.float64())
    types = [pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), doubles, doubles, pa.float64(), *[pa.binary()] * (5 + windows)]
    schema = PACKED + ", scores binary" * windows
    names = [c.split()[0] for c in schema.split(", ")]
    return rows.mapInArrow(run, schema)


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict, width: int, refs: int, prefix: str) -> None:
        take = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.ids, self.label, self.norms = take("ids", np.int64), take("label", np.int64), take("norms", float)
        n = len(self.ids)
        self.v, self.angles = take("v", np.int64).reshape(n, width), take("angles", float).reshape(n, refs)
        self.largest = int(np.abs(self.v).max(initial=0))
        self.x = self.v.astype(float)


def bounds(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of a's rows with b's, by the angles to all references."""
    apart, most = np.zeros((len(a.ids), len(b.ids))), np.full((len(a.ids), len(b.ids)), np.pi)
    for s, t in zip(a.angles.T, b.angles.T):
        np.maximum(apart, np.abs(s[:, None] - t), out=apart)
        total = s[:, None] + t
        np.minimum(most, np.minimum(total, 2 * np.pi - total), out=most)
    norms, e = a.norms[:, None] * b.norms, slack(a.v.shape[1])
    wide = norms * e + 1
    return norms * np.cos(most) - wide, norms * np.cos(apart) + wide


def scores(a: Block, i: int, b: Block, rows: np.ndarray) -> np.ndarray:
    """Inner products of a's row with rows of b, as whole numbers."""
    most = a.largest * b.largest * a.v.shape[1]
    if most < 1 << 53:  # all sums are exact as doubles
        return (b.x[rows] @ a.x[i]).astype(np.int64)
    if most < 1 << 63:
        return b.v[rows] @ a.v[i]
    exact = [sum(int(p) * int(q) for p, q in zip(b.v[k], a.v[i])) for k in rows]
    return np.array(exact, np.int64)  # beyond 64 bits: an OverflowError


def merged(best: np.ndarray, ids: np.ndarray, score: np.ndarray, their: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of two lists by score, then id, as many as there were."""
    s, i = np.concatenate([best, score]), np.concatenate([ids, their])
    order = np.lexsort((i, np.where(s > NONE, -s, -(NONE + 1))))[: len(best)]
    return s[order], i[order]


def search(pairs: DataFrame, width: int, refs: int, k: int, windows: bool) -> DataFrame:
    """(anchor_id, slot, id, score): the k best rows of each anchor that a task's pairs of blocks hold, for each of its
    windows, or of its own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        last: tuple[int, Block] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if last is None or last[0] != row["block"]:
                    last = row["block"], Block(row, width, refs, "")
                if row["a_block"] not in kept:
                    a = Block(row, width, refs, "a_")
                    goals = np.frombuffer(row["a_scores"], np.int64).reshape(len(a.ids), POSITIVES) if windows else np.zeros((len(a.ids), 1), np.int64)
                    shape = (*goals.shape, k)
                    kept[row["a_block"]] = a, goals, np.full(shape, NONE), np.zeros(shape, np.int64)
                compare(*kept[row["a_block"]], last[1])
        for a, _, best, ids in kept.values():
            i, slot, r = np.nonzero(best > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[i]), pa.array(slot.astype(np.int32)), pa.array(ids[i, slot, r]), pa.array(best[i, slot, r])], ["anchor_id", "slot", "id", "score"])

    def compare(a: Block, goals: np.ndarray, best: np.ndarray, ids: np.ndarray, b: Block) -> None:
        low, high = bounds(a, b)
        same = a.label[:, None] == b.label
        wanted = np.zeros(same.shape, bool)
        for j in range(goals.shape[1]):
            floor = best[:, j, -1].astype(float)
            if windows:
                there = goals[:, j] > NONE
                goal = np.where(there, goals[:, j], 0).astype(float)
                edge = np.abs(goal) * 1e-12 + 1
                floor = np.maximum(floor, goal * LEAST / 100 - edge)
                wanted |= (high >= floor[:, None]) & (low <= (goal * MOST / 100 + edge)[:, None]) & there[:, None]
            else:
                wanted |= high >= floor[:, None]
        wanted &= (same != windows) & (a.ids[:, None] != b.ids)
        for i in np.flatnonzero(wanted.any(1)):
            rows = np.flatnonzero(wanted[i])
            score = scores(a, i, b, rows)
            for j in range(goals.shape[1]):
                fit = score >= best[i, j, -1]
                if windows:
                    goal = int(goals[i, j])
                    if goal == NONE:
                        continue
                    # whole numbers: 30 p <= 100 s <= 90 p
                    fit &= (score >= -(-LEAST * goal // 100)) & (score <= MOST * goal // 100)
                if fit.any():
                    best[i, j], ids[i, j] = merged(best[i, j], ids[i, j], score[fit], b.ids[rows[fit]])

    return pairs.mapInArrow(run, "anchor_id long, slot int, id long, score long")


def rounds(rows: DataFrame, anchors: DataFrame, can_meet, width: int, refs: int, k: int, windows: bool) -> DataFrame:
    """search() of all rows for all anchors, so many of these at a time; what each round found is written."""
    anchors, most = stored(anchors), max(1, ANCHORS // (8 * (width + refs + 8)))
    numbers = anchors.select("block", "n").withColumn("part", F.floor((F.sum("n").over(Window.orderBy("block")) - 1) / most))
    numbers = stored(numbers.select("block", "part"))  # two numbers a block
    found = None
    for part in range((numbers.agg(F.max("part")).first()[0] or 0) + 1):
        some = anchors.join(numbers.where(F.col("part") == part).select("block"), "block")
        some = some.select(*(F.col(c).alias(f"a_{c}") for c in some.columns))
        # at most ANCHORS bytes and a block more
        out = stored(search(rows.join(F.broadcast(some), can_meet), width, refs, k, windows))
        found = out if found is None else found.unionByName(out)
    return found


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of what tasks found, with their rank from 1."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, v); anchors are the
    rows whose id `every` divides."""
    rows = stored(by_bytes(rows))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    refs = references(rows, width)
    blocks = stored(packed(rows, refs, width))
    heads = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
    heads = stored(heads)
    near = rounds(blocks, packed(heads, refs, width), F.arrays_overlap("labels", "a_labels"), width, len(refs), POSITIVES, False)
    positives = stored(first(near, POSITIVES).select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # an anchor has POSITIVES at most
    goals = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p["positive_score"]).alias("scores"), F.min("positive_score").alias("least"), F.max("positive_score").alias("most"))
    # only positive scores have windows, and 0 the window of 0
    hunters = heads.join(goals.where("most >= 0"), "vec_id")
    # ranges of angles to a reference that are apart keep blocks apart
    # and so do norms that are too small for the least window
    apart = F.array_max(F.transform(F.arrays_zip("low", "high", "a_low", "a_high"), lambda z: F.greatest(F.lit(0.0), z["a_low"] - z["high"], z["low"] - z["a_high"])))
    reach = (F.cos(F.coalesce(apart, F.lit(0.0))) + slack(width)) * F.col("norm") * F.col("a_norm") + 1
    found = rounds(blocks, packed(hunters, refs, width, True), reach * 100 >= LEAST * F.col("a_goal") * (1 - 1e-12) - 100, width, len(refs), NEGATIVES, True)
    out = first(found, NEGATIVES).withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positives, ["anchor_id", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
