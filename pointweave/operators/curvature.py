"""Mean curvature of each point from a quadric through its nearest neighbours.

Neighbours are offsets from the point, itself included. In the frame of their covariance's axes (longest first) a least
squares quadric gives the height over the first two; its raw coefficients count as derivatives. The third axis points
where its largest component is positive, so signs are the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.knn import knn
from pointweave.sources.scratch import saved

#: Coordinates of the neighbourhoods that are fitted at a time; a fit takes some ten times as much memory.
VALUES = 1 << 16


def mean_curvature(offsets: np.ndarray) -> np.ndarray:
    """Curvatures of n neighbourhoods (n x k x 3)."""
    centred = offsets - offsets.mean(axis=1, keepdims=True)
    _, axes = np.linalg.eigh(np.einsum("nki,nkj->nij", centred, centred) / max(1, offsets.shape[1] - 1))
    axes = axes[:, :, ::-1]
    largest = np.take_along_axis(axes, np.abs(axes).argmax(axis=1, keepdims=True), 1)
    local = offsets @ (axes * np.where(largest < 0, -1.0, 1.0))
    u, v, height = local[..., 0], local[..., 1], local[..., 2]
    design = np.stack([u * u, v * v, u * v, u, v, np.ones_like(u)], axis=-1)
    fit = (np.linalg.pinv(design) @ height[..., None])[..., 0]
    uu, vv, uv, du, dv = fit.T[:5]
    slope = 1 + du * du + dv * dv
    return ((1 + du * du) * vv + (1 + dv * dv) * uu - 2 * uv * du * dv) / (2 * slope**1.5)


def curvature(points: DataFrame, k: int) -> DataFrame:
    """(pid, curvature); a neighbourhood has k points (fewer in a smaller cloud), so its list is short."""
    near = knn(points, points, k, ("pid", "pid"))
    at = lambda i: points.select(F.col("pid").alias(i), *(F.col(c).alias(f"{i}{c}") for c in "xyz"))
    offset = F.struct("rank", *((F.col(f"b{c}") - F.col(f"a{c}")).alias(c) for c in "xyz"))
    around = near.join(at("b"), "b").join(at("a"), "a").groupBy("a").agg(F.sort_array(F.collect_list(offset)).alias("o"))
    flat = around.select(F.col("a").alias("pid"), F.flatten(F.transform("o", lambda o: F.array(o["x"], o["y"], o["z"]))).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("o")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            out = np.zeros(len(batch))
            for n in np.unique(sizes):
                same = np.flatnonzero(sizes == n)
                step = max(1, VALUES // max(1, n))
                for mine in (same[i : i + step] for i in range(0, len(same), step)):
                    out[mine] = mean_curvature(values[starts[mine][:, None] + np.arange(n)].reshape(len(mine), -1, 3))
            yield pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(out)], ["pid", "curvature"])

    return flat.mapInArrow(run, "pid long, curvature double")


def standardised(values: DataFrame) -> DataFrame:
    """(pid, curvature): the distance from the mean in two standard deviations, at most 1; all 0 without deviation."""
    values = saved(values)
    whole = values.agg(F.avg("curvature").alias("mean"), F.stddev_pop("curvature").alias("deviation"))
    far = F.abs(F.col("curvature") - F.col("mean")) / (2 * F.col("deviation"))
    return values.crossJoin(F.broadcast(whole)).select("pid", F.when(F.col("deviation") > 0, F.least(far, F.lit(1.0))).otherwise(0.0).alias("curvature"))  # one row
