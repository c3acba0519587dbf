import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.jobs import queries
from pointweave.operators import knn as neighbours
from pointweave.operators import mapping, rd
from pointweave.sources import logs, reports

RNG = np.random.default_rng(8)


def brute(p, q, k):
    d = ((p[:, None] - q[None]) ** 2).sum(-1)
    return {(i, r + 1): int(j) for i in range(len(p)) for r, j in enumerate(np.lexsort((np.arange(len(q)), d[i]))[:k])}


def points(spark, p):
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "i long, x double, y double, z double")


@pytest.mark.parametrize("small, full", [(4096, 32), (0, 32), (0, 2)])
def test_knn_with_outliers_and_a_dense_cluster(spark, monkeypatch, small, full):
    """Broadcast, in cells, and in cells that begin small: the same neighbours."""
    monkeypatch.setattr(neighbours, "SMALL", small)
    monkeypatch.setattr(neighbours, "FULL", full)
    p = np.concatenate([RNG.normal(size=(40, 3)), RNG.normal(size=(60, 3)) * 1e-3, [[50.0, 0, 0], [0, -90.0, 3]]])
    q = np.concatenate([RNG.normal(size=(30, 3)), RNG.normal(size=(80, 3)) * 1e-3, [[-40.0, 9, 0]]])
    got = {(r["a"], r["rank"]): r["b"] for r in neighbours.knn(points(spark, p), points(spark, q), 4, ("i", "i")).collect()}
    assert got == brute(p, q, 4)
    few = neighbours.knn(points(spark, p[:3]), points(spark, q[:2]), 4, ("i", "i"))
    assert few.count() == 6 and neighbours.knn(points(spark, p), points(spark, q).where("false"), 4, ("i", "i")).count() == 0


def test_lossless_curves_alone_and_none(spark):
    inf = float("inf")
    rows = [("c", "A", 1.0, 30.0), ("c", "A", 3.0, inf), ("c", "A", 2.0, inf), ("c", "B", 5.0, inf), ("c", "C", 1.0, 20.0), ("c", "C", 2.0, float("nan"))]
    got = rd.lossless(spark.createDataFrame(rows, "cloud string, method string, rate double, metric double")).collect()
    assert {r["method"]: (r["lossless_rate"], r["finite"]) for r in got} == {"A": (2.0, 1), "B": (5.0, 0), "C": (None, 1)}


def test_psnr_of_tiny_errors_and_of_none(spark):
    df = spark.createDataFrame([(1e-6, 0.0, 0.5)], "dy double, du double, dv double").agg(*queries.metrics()).first()
    assert df["y_psnr"] == pytest.approx(120.0) and df["y_mse"] == 0.0 and df["u_psnr"] == float("inf")


def test_flat_ranges_have_share_zero(spark):
    df = spark.createDataFrame([(2.0, 2.0, 2.0), (3.0, 2.0, 4.0)], "c double, low double, high double")
    assert [r[0] for r in df.select(queries.share("c", "low", "high")).collect()] == [0.0, 0.5]


def test_densified_edges_and_single_lines(spark):
    nodes = spark.createDataFrame([(i, 0, float(i * i), 0.0, 1.0) for i in range(3)], "gi long, gj long, x double, y double, z double")
    at = lambda i: {r["at"]: r["x"] for r in mapping.densified(nodes, spark.createDataFrame([(i,)], "gi long")).collect()}
    assert at(0) == {0: 0, 1: 1, 2: 4, -0.5: -1.0, 0.5: 0.5}
    assert at(1) == {0: 0, 1: 1, 2: 4, 0.5: 0.5, 1.5: 2.5}
    assert at(2) == {0: 0, 1: 1, 2: 4, 1.5: 2.5, 2.5: 7.0}
    one = mapping.densified(nodes.where("gi = 1"), spark.createDataFrame([(1,)], "gi long")).collect()
    assert sorted((r["at"], r["x"]) for r in one) == [(0.5, 1.0), (1.0, 1.0), (1.5, 1.0)]


def test_log_without_a_value_is_an_error(spark):
    text = spark.createDataFrame([('uncompressedDataPath : "a.ply"\npositions bitstream size 12 B (0.5 bpp)',)], "t string")
    assert text.select(logs.encoder_values(F.col("t"))[1]).first()[0] == 12
    with pytest.raises(Exception, match="no match"):
        text.select(*logs.encoder_values(F.col("t"))).collect()


def test_reports_of_odd_names_and_of_none(spark):
    rows = spark.createDataFrame([("a b/c", "x=1", 2, 0.5, float("inf"))], "cloud string, method string, qp long, rate double, metric double")
    path = reports.write(spark, rows, ["cloud", "method"])
    got = reports.discovered(spark, path, "qp long, rate double, metric double", ["cloud", "method"], rows.schema).collect()
    assert [tuple(r) for r in got] == [("a b/c", "x=1", 2, 0.5, float("inf"))]
    with pytest.raises(ValueError, match="no reports"):
        reports.discovered(spark, reports.write(spark, rows.where("false"), ["cloud"]), "qp long", ["cloud"], rows.schema)
