"""The sweep of levels and the histograms against numpy."""

import numpy as np
import pytest

from pointweave.jobs import sweep

BT709 = np.array([[0.2126, 0.7152, 0.0722], [-0.1146, -0.3854, 0.5], [0.5, -0.4542, -0.0458]])


def yuv(rgb):
    return np.clip(rgb @ BT709.T + [0, 128, 128], 0, 255)


def data(spark):
    rng = np.random.default_rng(21)
    p, colours = rng.random((60, 3)), rng.integers(0, 256, (60, 3)).astype(float)
    u, v = np.meshgrid(np.linspace(0, 1, 4), np.linspace(0, 1, 5), indexing="ij")
    grids = {"base": np.stack([u, v, 0.5 + 0 * u], -1), "bent": np.stack([u, v, u * v], -1)}
    points = spark.createDataFrame([(i, 0, *map(float, x), *map(float, c)) for i, (x, c) in enumerate(zip(p, colours))], "pid long, patch int, x double, y double, z double, red double, green double, blue double")
    lattices = {n: spark.createDataFrame([(i * 5 + j, i, j, *map(float, g[i, j])) for i in range(4) for j in range(5)], "node long, gi long, gj long, x double, y double, z double") for n, g in grids.items()}
    carried = {}
    for n, g in grids.items():
        nodes = g.reshape(-1, 3)
        taken, where = np.zeros(20, int), []
        for x in p:
            d = np.sqrt(((x - nodes) ** 2).sum(1))
            near = np.lexsort((np.arange(20), d))[:9]
            k = near[int((taken[near] * d[near]).argmin())]
            taken[k] += 1
            where.append(k)
        where = np.array(where)
        rgb = np.array([np.rint(colours[where == k].mean(0)) if (where == k).any() else colours[((p - nodes[k]) ** 2).sum(1).argmin()] for k in range(20)])
        carried[n] = where, rgb
    return points, lattices, colours, carried


def test_sweep_against_numpy(spark):
    points, lattices, colours, carried = data(spark)
    got = {(r["variant"], r["qp"]): r for r in sweep.swept(points, lattices, [4, 20, 50]).collect()}
    assert set(got) == {(n, q) for n in lattices for q in (4, 20, 50)}
    for (n, q), row in got.items():
        where, rgb = carried[n]
        wide = 2 ** ((q - 4) / 6)
        coarse = np.clip(np.rint(np.rint(rgb / wide) * wide), 0, 255)
        diff = (yuv(colours) - yuv(coarse[where])) / 255
        for i, c in enumerate("yuv"):
            assert row[f"{c}_mse"] == pytest.approx((diff[:, i] ** 2).mean(), abs=2e-9)
            assert row[f"{c}_mae"] == pytest.approx(np.abs(diff[:, i]).mean(), abs=2e-9)
        assert row["input_point_count"] == 60
        assert row["color_bits_per_input_point"] == pytest.approx(row["color_bitstream_size_in_bytes"] * 8 / 60)
    assert got["base", 50]["color_bitstream_size_in_bytes"] < got["base", 4]["color_bitstream_size_in_bytes"]


def test_histograms_against_numpy(spark):
    points, lattices, colours, carried = data(spark)
    got = {}
    for r in sweep.histograms(points, lattices, 10).collect():
        got.setdefault((r["variant"], r["kind"]), np.zeros(10, int))[r["bin"]] = r["n"]
    for n, (where, rgb) in carried.items():
        square = ((yuv(colours) - yuv(rgb[where]))[:, 0] / 255) ** 2
        for kind, some in (("all", square), ("nonzero", square[square > 0])):
            v = np.round(-10 * np.log10(np.maximum(some, 1e-8)), 9)
            assert got[n, kind].tolist() == np.histogram(v, 10)[0].tolist()


def test_ramps(spark):
    from pyspark.sql import functions as F

    from pointweave.functions import palette

    stops = [(0.0, (0, 10, 255)), (0.5, (100, 10, 0)), (1.0, (0, 30, 0))]
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 0.5, 0.75, 1.0, 7.0, None)], "v double")
    got = [tuple(r) for r in df.select(*palette.ramp(F.col("v"), stops)).collect()]
    assert got == [(0, 10, 255), (0, 10, 255), (50, 10, 128), (100, 10, 0), (50, 20, 0), (0, 30, 0), (0, 30, 0), (None, None, None)]
    one = spark.createDataFrame([(0,), (2,)], "label int")
    assert [tuple(r) for r in one.select(*palette.labels(F.col("label"), 3, stops)).collect()] == [(0, 10, 255), (0, 30, 0)]
    assert tuple(one.limit(1).select(*palette.labels(F.col("label"), 1, stops)).first()) == (0, 10, 255)
