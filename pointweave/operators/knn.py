"""Exact nearest-neighbour joins, in any number of dimensions.

Up to SMALL points of b are broadcast and meet every point of a; up to HELD points are broadcast with a tree of their
cells, in which each task searches for its points of a. Beyond, points of b lie in the cells of a tree, which is
built from a sample (see `cells`). A point of a first meets cells near it that hold k points together; the k-th best of
these is the radius of a ball, and only cells whose boxes reach into the ball are met next: the nearest ones first, in
three rounds at most, each with the ball of the round before. So points far from b, whose first ball is large, meet few
cells, and no width has to suit all of a cloud.

Of equal points of b only those with the lowest ids count, as many as are asked for, and equal points of a are searched
once, so copies cost nothing. A cell's points are read once for a batch of points that look into it, and a cell that
very many points look into is split between tasks. Each round is written, as the next one needs it twice. Ties go to the
lower id. Points with a null, NaN or infinite coordinate have no neighbours and are none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators.cells import LEAVES, SAMPLED, Packed, Tree, grown
from pointweave.sources.scratch import removed, saved

AXES = ("x", "y", "z")
#: Points that are broadcast at most, without and with a tree, points of a cell for each neighbour asked for (and at least), and points that look
#: into one cell in one task.
SMALL, HELD, FULL, LEAST, CROWD = 4096, 1 << 16, 3, 64, 1 << 16
#: Cells that a point meets in the second and the third round; the rest come in the fourth.
TURNS = (16, 128)


def knn(a: DataFrame, b: DataFrame, k: int, ids: tuple[str, str] = ("a", "b"), itself: bool = True, axes: tuple[str, ...] = AXES, small: int = SMALL, known: int | None = None) -> DataFrame:
    """(a, b, d2, rank): the k nearest points of b (b, x, y, z) for each point of a (a, x, y, z), rank from 1. Without
    itself, a point is not its own neighbour. The columns in `axes` are the coordinates. `known`: the caller has
    counted b and found so many points, or most(small) + 1 if there are more."""
    ia, ib = ids
    good = lambda df, p: reduce(lambda s, c: s & (F.abs(F.col(p + c)) < float("inf")), axes, F.lit(True))
    left = a.select(F.col(ia).alias("a"), *(F.col(c).cast("double").alias(f"a{c}") for c in axes))
    left = left.where(good(left, "a"))
    right = b.select(F.col(ib).alias("b"), *(F.col(c).cast("double").alias(f"b{c}") for c in axes))
    right = right.where(good(right, "b"))
    n = right.limit(most(small) + 1).count() if known is None else known
    if n > most(small):
        return searched(left, right, k, itself, axes)
    if n > small:
        return held(left, right, k, itself, axes)
    pairs = left.crossJoin(F.broadcast(right)) if n else left.join(right, F.lit(False))  # at most `small` rows, counted above
    pairs = pairs if itself else pairs.where("a <> b")
    near = pairs.select("a", "b", apart(axes).alias("d2"))
    if k == 1:  # no sort, and one row for each point and task in the shuffle
        best = near.groupBy("a").agg(F.min(F.struct("d2", "b")).alias("m"))
        return best.select("a", F.col("m.b").alias("b"), F.col("m.d2").alias("d2"), F.lit(1).alias("rank"))
    return ranked(near, k)


def most(small: int) -> int:
    """Points of b that are broadcast at most; a caller who wants fewer than SMALL wants cells beyond."""
    return max(small, HELD) if small >= SMALL else small


def held(left: DataFrame, right: DataFrame, k: int, itself: bool, axes: tuple[str, ...]) -> DataFrame:
    """knn() where each task holds all points of b, HELD at most."""
    a, b, at, many = left.schema["a"].dataType.simpleString(), right.schema["b"].dataType.simpleString(), [f"a{c}" for c in axes], k + (not itself)
    rows = right.toArrow()  # HELD rows
    rows = rows.sort_by("b").combine_chunks()
    x = np.stack([rows.column(f"b{c}").to_numpy() for c in axes], 1) + 0.0  # -0.0 is 0.0
    # of equal points only the first ones count
    order = np.lexsort((np.arange(len(x)), *x.T))
    new = np.append(True, (np.diff(x[order], axis=0) != 0).any(1))
    place = np.cumsum(new) - 1
    keep = np.sort(order[np.arange(len(x)) - np.flatnonzero(new)[place] < many])
    shared = left.sparkSession.sparkContext.broadcast((Packed.of(x[keep]), rows.column("b").take(pa.array(keep)).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, names = shared.value
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                point, row, d2, rank = packed.nearest(numbers(batch, at), many)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(point)), names.take(pa.array(row)), pa.array(d2), pa.array(rank, pa.int32())], ["a", "b", "d2", "rank"])

    found = left.mapInArrow(run, f"a {a}, b {b}, d2 double, rank int")
    return found if itself else ranked(found.where("a <> b"), k)


def apart(axes: tuple[str, ...]) -> Column:
    """Squared distance of (ax, ..) and (bx, ..)."""
    return reduce(lambda s, d: s + d, ((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in axes))


def numbers(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1) if len(batch) else np.zeros((0, len(names)))


def planted(right: DataFrame, k: int, axes: tuple[str, ...], copies: bool = False) -> tuple[DataFrame, Tree]:
    """(b, bx, .., cell), written, and the tree of the cells; of equal points the k lowest ids, or all with copies."""
    at = [f"b{c}" for c in axes]
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("b"))
    points = saved(right if copies else right.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank"))
    n = points.count()
    leaves = min(LEAVES, max(1, n // max(LEAST, FULL * k)))
    every = max(1, n // (SAMPLED * leaves))
    sample = points.where(F.pmod(F.xxhash64("b"), F.lit(every)) == 0).select(*at).toPandas()  # SAMPLED points a cell
    tree = grown(sample.to_numpy(float), leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.assign(numbers(batch, at)).astype(np.int32))], [*batch.schema.names, "cell"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    cells = saved(points.mapInArrow(run, f"{names}, cell int"))
    removed(points)
    boxes = cells.groupBy("cell").agg(*(F.min(c).alias(f"low{c}") for c in at), *(F.max(c).alias(f"high{c}") for c in at), F.count("*").alias("n")).toPandas()  # LEAVES rows
    take = lambda p: boxes[[p + c for c in at]].to_numpy(float)
    return cells, tree.measured(boxes["cell"].to_numpy(), take("low"), take("high"), boxes["n"].to_numpy())


def regions(points: DataFrame, many: int, id_: str = "pid", axes: tuple[str, ...] = AXES) -> DataFrame:
    """(<id>, part): `many` parts at most of points that lie together, by a tree over a sample of SAMPLED points a part."""
    rows = points.select(id_, *(F.col(c).cast("double").alias(c) for c in axes))
    every = max(1, rows.count() // (SAMPLED * many))
    good = reduce(lambda s, c: s & (F.abs(F.col(c)) < float("inf")), axes, F.lit(True))
    sample = rows.where(good & (F.pmod(F.xxhash64(id_), F.lit(every)) == 0)).select(*axes).toPandas()  # SAMPLED points a part
    tree = grown(sample.to_numpy(float), many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_), pa.array(tree.assign(numbers(batch, list(axes))).astype(np.int32))], [id_, "part"])

    return rows.mapInArrow(run, f"{id_} {rows.schema[id_].dataType.simpleString()}, part int")


def looked_up(spots: DataFrame, tree: Tree, k: int, at: list[str], first: int = 0, last: int = 0, seeded: bool = True) -> DataFrame:
    """(cell, a, ax, .., worst, many): the cells that each point looks into: those near it that hold k points or, with
    `last`, the first-th to last-th nearest of those that reach into its ball of squared radius `worst`; if it is seeded, the
    cells near it have been met and are left out."""
    kind = spots.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                x = numbers(batch, at)
                point, cell = tree.seeds(x, k) if seeded else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                many = np.zeros(len(x), bool)
                if last:
                    seen = point * (1 << 32) + cell
                    point, cell, far = tree.within(x, batch.column("worst").to_numpy(zero_copy_only=False))
                    new = ~np.isin(point * (1 << 32) + cell, seen)
                    point, cell, far = point[new], cell[new], far[new]
                    order = np.lexsort((cell, far, point))
                    point, cell = point[order], cell[order]
                    rank = np.arange(len(point)) - np.searchsorted(point, point)
                    many = np.bincount(point, minlength=len(x)) > last
                    some = (rank >= first) & (rank < last)
                    point, cell = point[some], cell[some]
                rows = batch.take(pa.array(point))
                worst = rows.column("worst") if last else pa.array(np.full(len(rows), np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), rows.column("a"), *(rows.column(c) for c in at), worst, pa.array(many[point])], ["cell", "a", *at, "worst", "many"])

    return spots.mapInArrow(run, f"cell int, a {kind}, {', '.join(f'{c} double' for c in at)}, worst double, many boolean")


def compared(pairs: DataFrame, cells: DataFrame, k: int, axes: tuple[str, ...]) -> DataFrame:
    """(a, b, d2): for each point and cell of `pairs`, the k nearest in the cell (and ties), within the point's ball. A
    task reads the points of a cell, then all that look into it; a cell with a crowd comes in several parts."""
    a, b, at = pairs.schema["a"].dataType, cells.schema["b"].dataType, [f"p{c}" for c in axes]
    crowds = pairs.groupBy("cell").agg(F.floor(F.count("*") / CROWD).cast("int").alias("parts"))  # LEAVES rows
    look = pairs.join(F.broadcast(crowds), "cell")
    look = look.select("cell", F.pmod(F.xxhash64("a"), F.col("parts") + 1).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("a"), F.lit(None).cast(b).alias("b"), *(F.col(f"a{c}").alias(f"p{c}") for c in axes), "worst")
    there = cells.join(F.broadcast(crowds), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts"))))
    there = there.select("cell", "part", F.lit(0).alias("kind"), F.lit(None).cast(a).alias("a"), "b", *(F.col(f"b{c}").alias(f"p{c}") for c in axes), F.lit(0.0).alias("worst"))
    both = there.unionByName(look).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, names = None, [], []
        for batch in batches:
            if not len(batch):
                continue
            cell, part, kind = (batch.column(c).to_numpy() for c in ("cell", "part", "kind"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            x, worst = numbers(batch, at), batch.column("worst").to_numpy()
            for i, j in zip([0, *cuts], [*cuts, len(batch)]):
                if not kind[i]:
                    if now != (cell[i], part[i]):
                        now, points, names = (cell[i], part[i]), [], []
                    points.append(x[i:j])
                    names.append(batch.column("b").slice(i, j - i))
                    continue
                if len(points) > 1:
                    points, names = [np.concatenate(points)], [pa.concat_arrays(names)]
                step = max(1, (1 << 21) // len(points[0]))
                for s in range(i, j, step):
                    q, p, d2 = best(x[s : min(s + step, j)], points[0], worst[s : min(s + step, j)])
                    yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(q + s)), names[0].take(pa.array(p)), pa.array(d2)], ["a", "b", "d2"])

    def best(x: np.ndarray, y: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d2 = np.zeros((len(x), len(y)))
        for c in range(x.shape[1]):
            d = x[:, None, c] - y[None, :, c]
            d2 += d * d
        if len(y) > k:
            worst = np.minimum(worst, np.partition(d2, k - 1, axis=1)[:, k - 1])
        q, p = np.nonzero(d2 <= worst[:, None])
        return q, p, d2[q, p]

    return both.mapInArrow(run, f"a {a.simpleString()}, b {b.simpleString()}, d2 double")


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d2", "b"))
    return pairs.select("a", "b", "d2", rank.alias("rank")).where(F.col("rank") <= k)


def searched(left: DataFrame, right: DataFrame | None, k: int, itself: bool, axes: tuple[str, ...], index: tuple[DataFrame, Tree] | None = None, bound: DataFrame | None = None) -> DataFrame:
    """knn() over cells, of planted() points if these are given. With bounds (a, worst), of each point's k-th squared
    distance, no cell is met to find one first."""
    most, at = k + (not itself), [f"a{c}" for c in axes]
    cells, tree = index or planted(right, most, axes)
    spots = saved(left.groupBy(*at).agg(F.min("a").alias("a"), F.count("*").alias("n")))
    near = saved(ranked(compared(looked_up(spots, tree, most, at), cells, most, axes), most)) if bound is None else None
    if bound is not None:  # computed otherwise than here, it stays a bound after rounding
        bound = bound.withColumn("worst", F.col("worst") * (1 + 1e-12))
    todo, begin = spots, 0
    for end in (*TURNS, 1 << 40):
        worst = bound
        if near is not None:
            # a point that has not found enough yet has no bound of its own
            worst = near.groupBy("a").agg(F.when(F.count("*") >= most, F.max("d2")).otherwise(float("inf")).alias("worst"))
            worst = worst if bound is None else bound.join(worst.withColumnRenamed("worst", "w"), "a", "left").select("a", F.least("w", "worst").alias("worst"))
        look = saved(looked_up(todo.join(worst, "a"), tree, most, at, begin, end, bound is None))
        more = compared(look, cells, most, axes)
        better = saved(ranked(more if near is None else near.drop("rank").unionByName(more), most))
        if near is not None:
            removed(near)
        near, begin = better, end
        todo = todo.join(look.where("many").select("a").distinct(), "a", "left_semi")
        if not look.where("many").limit(1).count():
            break
    if not spots.where("n > 1").limit(1).count() and left.limit(1).count():
        found = near
    else:
        # equal points have the neighbours of the first of them
        same = left.join(spots.withColumnRenamed("a", "first"), at).select("a", "first")
        found = same.join(near.withColumnRenamed("a", "first"), "first").select("a", "b", "d2", "rank")
    return found if itself else ranked(found.where("a <> b"), k)


def nearest(a: DataFrame, b: DataFrame, ids: tuple[str, str] = ("a", "b"), rank: int = 1, axes: tuple[str, ...] = AXES) -> DataFrame:
    return knn(a, b, rank, ids, axes=axes).where(F.col("rank") == rank).select("a", "b", "d2")
