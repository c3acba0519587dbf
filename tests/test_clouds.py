import numpy as np
import pytest

from pointweave.functions import color
from pointweave.operators.knn import knn, nearest
from pointweave.operators import rd
from pyspark.sql import functions as F

A = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)]
B = [(0, -100.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0)]


def rows(df):
    return sorted((r["a"], r["b"], r["d2"]) for r in df.collect())


def test_nearest_known_values(spark):
    a, b = spark.createDataFrame(A, "a long, x double, y double, z double"), spark.createDataFrame(B, "b long, x double, y double, z double")
    assert rows(nearest(a, b)) == [(0, 1, 4.0), (1, 1, 1.0), (2, 1, 5.0)]
    assert rows(nearest(a, b, rank=2)) == [(0, 0, 10000.0), (1, 0, 10201.0), (2, 0, 10001.0)]


def test_knn_against_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 6, (80, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "i long, x double, y double, z double")
    got = {(r["a"], r["rank"]): r["b"] for r in knn(df, df, 3, ("i", "i"), itself=False).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    for i in range(len(p)):
        order = [j for j in np.lexsort((np.arange(len(p)), d[i])) if j != i][:3]
        assert [got[i, k + 1] for k in range(3)] == order


def test_colours(spark):
    df = spark.createDataFrame([(255.0, 255.0, 255.0), (255.0, 0.0, 0.0), (0.0, 0.0, 0.0)], "r double, g double, b double")
    y = [tuple(round(v, 3) for v in r) for r in df.select(*color.rgb_to_yuv(F.col("r"), F.col("g"), F.col("b"))).collect()]
    assert y == [(255.0, 128.0, 128.0), (54.213, 98.777, 255.0), (0.0, 128.0, 128.0)]


def mean_gap(x1, y1, x2, y2):
    low, high = max(min(x1), min(x2)), min(max(x1), max(x2))
    area = [np.polyval(np.polyint(np.polyfit(x, y, 3)), [low, high]) for x, y in ((x1, y1), (x2, y2))]
    return ((area[1][1] - area[1][0]) - (area[0][1] - area[0][0])) / (high - low)


def test_bjontegaard_against_polyfit(spark):
    rng = np.random.default_rng(6)
    curves = {}
    for n, name in ((4, "a"), (7, "b"), (6, "c"), (5, "d")):
        rate = np.sort(rng.uniform(0.1, 8, n))
        curves[name] = rate, 25 + 6 * np.log(rate + 1) + rng.normal(size=n) * 0.2
    curves["scaled"] = curves["a"][0] * 1.1, curves["a"][1]
    rows = [("x", m, float(r), float(s)) for m, (rate, snr) in curves.items() for r, s in zip(rate, snr)]
    rows += [("x", "c", 9.0, float("inf")), ("x", "c", 0.0, 1.0), ("x", "short", 1.0, 30.0), ("x", "short", 2.0, 31.0), ("y", "b", 1.0, 1.0)]
    got = {r["method"]: r for r in rd.compared(spark.createDataFrame(rows, "cloud string, method string, rate double, metric double"), "a").collect()}
    assert set(got) == {"b", "c", "d", "scaled", "short"}
    base = curves["a"]
    for m in "bcd":
        rate, snr = curves[m]
        assert got[m]["bd_snr"] == pytest.approx(mean_gap(np.log(base[0]), base[1], np.log(rate), snr), rel=1e-6, abs=1e-8)
        assert got[m]["bd_rate"] == pytest.approx((np.exp(mean_gap(base[1], np.log(base[0]), snr, np.log(rate))) - 1) * 100, rel=1e-6, abs=1e-6)
    assert got["scaled"]["bd_rate"] == pytest.approx(10.0)
    assert got["short"]["bd_rate"] is None and got["short"]["bd_snr"] is None


def test_registered_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
