"""Gradients of both clouds against finite differences."""

import numpy as np
import pytest

from pointweave.operators import gradient


def loss(p, q, wp, wq, rank):
    d = ((p[:, None] - q[None]) ** 2).sum(-1)
    return (wp * np.sort(d, 1)[:, rank - 1]).sum() + (wq * np.sort(d, 0)[rank - 1]).sum()


@pytest.mark.parametrize("rank", [1, 2])
def test_against_finite_differences(spark, rank):
    rng = np.random.default_rng(rank)
    p, q, wp, wq = rng.random((7, 3)), rng.random((5, 3)), rng.random(7), rng.random(5)
    frame = lambda x, w: spark.createDataFrame([(i, *map(float, v), float(k)) for i, (v, k) in enumerate(zip(x, w))], "pid long, x double, y double, z double, weight double")
    got = {(r["side"], r["pid"]): tuple(r)[2:] for r in gradient.both_ways(frame(p, wp), frame(q, wq), rank).collect()}
    for side, x in (("a", p), ("b", q)):
        for i in range(len(x)):
            for c in range(3):
                ends = []
                for e in (1e-6, -1e-6):
                    old = x[i, c]
                    x[i, c] += e
                    ends.append(loss(p, q, wp, wq, rank))
                    x[i, c] = old
                assert got.get((side, i), (0, 0, 0))[c] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-6)


def test_no_points(spark):
    none = spark.createDataFrame([], "pid long, x double, y double, z double, weight double")
    one = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0)], none.schema)
    assert gradient.both_ways(one, none).count() == 0
