import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import curvature, graph, knn, refine
from pointweave.sources import ply
from pointweave.sources.scratch import saved

RNG = np.random.default_rng(5)


def test_curvature_of_known_surfaces():
    u, v = RNG.uniform(-0.1, 0.1, (2, 40))
    plane = np.stack([u, v, 0 * u], 1)
    bowl = np.stack([u, v * 1.5, 0.3 * u * u + 0.3 * (1.5 * v) ** 2], 1)
    flat, round_ = curvature.mean_curvature(np.stack([plane, bowl]))
    assert flat == pytest.approx(0, abs=1e-9)
    assert round_ == pytest.approx(0.3, abs=0.01)  # raw coefficients count as derivatives
    few = curvature.mean_curvature(np.zeros((1, 1, 3)))
    assert few.shape == (1,) and few[0] == 0


def test_curvature_against_one_point_at_a_time(spark):
    p = RNG.normal(size=(60, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    raw = curvature.curvature(df, 9)
    got = {r[0]: r[1] for r in raw.collect()}
    for i in range(60):
        near = p[np.argsort(((p - p[i]) ** 2).sum(1), kind="stable")[:9]] - p[i]
        _, _, axes = np.linalg.svd(np.cov(near, rowvar=False))
        axes = np.array([a * np.sign(a[np.abs(a).argmax()]) for a in axes])
        x, y, z = (near @ axes.T).T
        a, b, c, d, e, _ = np.linalg.lstsq(np.stack([x * x, y * y, x * y, x, y, np.ones(9)], 1), z, rcond=None)[0]
        assert got[i] == pytest.approx(((1 + d * d) * b + (1 + e * e) * a - 2 * c * d * e) / 2 / (1 + d * d + e * e) ** 1.5, rel=1e-6, abs=1e-9)
    values = np.array([got[i] for i in range(60)])
    scaled = {r[0]: r[1] for r in curvature.standardised(raw).collect()}
    assert [scaled[i] for i in range(60)] == pytest.approx(np.minimum(np.abs(values - values.mean()) / 2 / values.std(), 1))
    same = curvature.standardised(df.select("pid", F.lit(2.0).alias("curvature")))
    assert {r[1] for r in same.collect()} == {0.0}
    assert curvature.curvature(df.where("false"), 9).count() == 0


def test_ply_round_trip_and_counts(spark, tmp_path):
    rows = [(i, i % 3, i + 0.5, -1.0, 1e-7, 254.9, 0.0, 3.0) for i in range(20)]
    df = spark.createDataFrame(rows, "pid long, patch int, x double, y double, z double, red double, green double, blue double")
    path = str(tmp_path / "clouds")
    ply.write(df, path)
    back = ply.read(spark, path)
    assert back.columns == ["file", "x", "y", "z", "red", "green", "blue"]
    assert sorted(r[1] for r in back.collect()) == [i + 0.5 for i in range(20)]
    assert {(r["red"], r["green"], r["blue"]) for r in back.collect()} == {(254, 0, 3)}
    assert sorted((r["declared"], r["n"]) for r in ply.counts(spark, path).collect()) == [(6, 6), (7, 7), (7, 7)]


def test_ply_with_comments_normals_and_bad_numbers(spark, tmp_path):
    text = "ply\nformat ascii 1.0\ncomment 12 made by hand\nobj_info 7\nelement vertex 3\nproperty float x\nproperty double nx\nproperty uchar red\nend_header\n1 0.25 255 \n-2.5 oops 3\n"
    (tmp_path / "a.ply").write_text(text)
    got = ply.read(spark, str(tmp_path / "a.ply")).select("x", "nx", "red").collect()
    assert [tuple(r) for r in got] == [(1.0, 0.25, 255), (-2.5, None, 3)]
    assert [(r["declared"], r["n"]) for r in ply.counts(spark, str(tmp_path / "a.ply")).collect()] == [(3, 2)]


def test_smoothed_labels_against_matrices(spark):
    n, k = 30, 4
    p = RNG.normal(size=(n, 2))
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    links = [(i, int(j), 1.0) for i in range(n) for j in np.argsort(d[i])[1 : k + 1]]
    label = RNG.integers(0, 3, n)
    edges = spark.createDataFrame(links, "src long, dst long, w double")
    got = dict(graph.smoothed_labels(edges, spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "pid long, cluster int"), 6).collect())
    a = np.eye(n)
    for i, j, _ in links:
        a[i, j] = 1
    a /= a.sum(1, keepdims=True)
    soft = np.eye(3)[label]
    for _ in range(6):
        soft = a @ soft
        soft /= np.linalg.norm(soft, axis=1, keepdims=True)
    assert got == {i: int(np.round(soft[i], 9).argmax()) for i in range(n)}


def test_rounds_of_refinement_are_single_steps(spark):
    nodes = [(i, i // 3, i % 3, *map(float, RNG.normal(size=3))) for i in range(9)]
    lattice = spark.createDataFrame(nodes, "node long, gi long, gj long, x double, y double, z double")
    cloud = spark.createDataFrame([(i, *map(float, RNG.normal(size=3))) for i in range(20)], "pid long, x double, y double, z double")
    edges = graph.lattice_edges(lattice)
    twice = graph.refined(graph.refined(lattice, cloud, edges), cloud, edges)
    got = {r[0]: tuple(r)[1:] for r in refine.refined_often(lattice, cloud, edges, 2).collect()}
    for r in twice.collect():
        assert got[r[0]] == pytest.approx(tuple(r)[1:])


def refined_once(nodes, cloud, links):
    """One round with dense matrices."""
    scale = lambda m: np.divide(m, m.sum(1, keepdims=True), out=np.zeros_like(m), where=np.abs(m.sum(1, keepdims=True)) > 1e-16)
    inner = links * ((nodes[:, None] - nodes[None]) ** 2).sum(-1) / links.sum(1, keepdims=True)
    v = inner.sum(0) - inner.sum(0).min()
    inner = scale(inner * v / v.max())
    far = np.sqrt(((nodes[:, None] - cloud[None]) ** 2).sum(-1))
    outer, met = np.zeros_like(far), np.zeros(far.shape, bool)
    for i, j in [*enumerate(far.argmin(1)), *((int(i), j) for j, i in enumerate(far.argmin(0)))]:
        outer[i, j] += far[i, j]
        met[i, j] = True
    outer[met] -= outer[met].min()
    outer[met] /= outer[met].max()
    both = scale(np.concatenate([inner, 2 * scale(outer)], 1))
    return both @ np.concatenate([nodes, cloud])


@pytest.mark.parametrize("small", [4096, 0])
def test_rounds_of_refinement_against_dense_matrices(spark, small, monkeypatch):
    monkeypatch.setattr(knn, "LEAST", 8)
    rng = np.random.default_rng(15)
    u, v = np.meshgrid(np.arange(9) / 8, np.arange(8) / 7, indexing="ij")
    nodes = np.stack([u, v, 0 * u], -1).reshape(-1, 3) + 0.02 * rng.normal(size=(72, 3))
    nodes[5] = nodes[6]  # copies that part later
    cloud = np.concatenate([rng.random((200, 3)) * [1, 1, 0.3], [[3.0, 3, 3]]])
    lattice = spark.createDataFrame([(i, i // 8, i % 8, *map(float, x)) for i, x in enumerate(nodes)], "node long, gi long, gj long, x double, y double, z double")
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(cloud)], "pid long, x double, y double, z double")
    edges = saved(graph.lattice_edges(lattice))
    links = np.zeros((72, 72))
    for r in edges.collect():
        links[r["src"], r["dst"]] = 1
    for _ in range(3):
        nodes = refined_once(nodes, cloud, links)
    got = {r[0]: tuple(r)[1:] for r in refine.refined_often(lattice, points, edges, 3, small=small).collect()}
    assert len(got) == 72
    for i in range(72):
        assert got[i] == pytest.approx(nodes[i].tolist(), abs=1e-9)


def test_registered_refinement_runs_all_rounds(spark, tmp_path):
    from pointweave.jobs import patches, sweep

    rng = np.random.default_rng(8)
    v = rng.random((132, 6)).astype(np.float32)
    rows = [(i, 0, x.tolist()) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    cloud, nodes = v[::2, :3].astype(float), v[1::2, :3].astype(float)
    got = {r[0]: tuple(r)[1:] for r in patches.refine_rounds(spark, str(tmp_path)).collect()}
    variants = {r["node"]: (r["x"], r["y"], r["z"]) for r in sweep.variants(spark, str(tmp_path))["refined"].collect()}
    # the registered lattice keeps its last row, which is not full; that of the sweep does not
    for lattice, n in ((got, 66), (variants, 64)):
        links = np.array([[abs(i // 16 - j // 16) + abs(i % 16 - j % 16) == 1 for j in range(n)] for i in range(n)], float)
        want = nodes[:n]
        for _ in range(100):
            want = refined_once(want, cloud, links)
        assert len(lattice) == n
        for i in range(n):
            assert lattice[i] == pytest.approx(want[i].tolist(), abs=2e-6)


def test_rounds_in_memory_are_those_over_cells_with_odd_coordinates(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAST", 8)
    rng = np.random.default_rng(16)
    nodes = [[i, i // 5, i % 5, *map(float, x)] for i, x in enumerate(rng.random((30, 3)))]
    nodes[7][3], nodes[20][4], nodes[11][3:] = None, None, nodes[12][3:]
    cloud = [[i, *map(float, x)] for i, x in enumerate(rng.random((90, 3)))]
    cloud[3][1], cloud[4][2], cloud[5][3], cloud[9][1:] = None, float("nan"), float("inf"), cloud[8][1:]
    lattice = spark.createDataFrame(nodes, "node long, gi long, gj long, x double, y double, z double")
    points = spark.createDataFrame(cloud, "pid long, x double, y double, z double")
    edges = saved(graph.lattice_edges(lattice).unionByName(spark.createDataFrame([(3, 99, 1.0), (99, 4, 1.0), (0, None, 1.0)], "src long, dst long, w double")))
    one, two = ({r[0]: tuple(r)[1:] for r in refine.refined_often(lattice, points, edges, 2, small=small).collect()} for small in (4096, 0))
    assert len(one) == 30 and set(one) == set(two)
    for i in one:
        assert one[i] == pytest.approx(two[i], abs=1e-9)


def test_refinement_without_points_or_nodes(spark):
    lattice = spark.createDataFrame([(0, 0, 0, 1.0, 2.0, 3.0), (1, 0, 1, 2.0, 2.0, 3.0)], "node long, gi long, gj long, x double, y double, z double")
    none = spark.createDataFrame([], "pid long, x double, y double, z double")
    edges = graph.lattice_edges(lattice)
    assert {tuple(r) for r in refine.refined_often(lattice, none, edges, 1).collect()} == {(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0)}
    assert refine.refined_often(lattice.where("node < 0"), none, edges.where("src < 0"), 2).count() == 0


def test_smoothing_keeps_the_graph_in_its_parts(spark):
    rng = np.random.default_rng(8)
    n, label = 50, rng.integers(0, 4, 50)
    pairs = [(i, int(j)) for i in range(n) for j in rng.choice(n, 3, replace=False) if i != j]
    edges = spark.createDataFrame([(i, j, 1.0) for i, j in pairs] + [(70, 1, 2.0), (2, 80, 1.0)], "src long, dst long, w double")
    labels = spark.createDataFrame([(i, None if c == 3 else int(c)) for i, c in enumerate(label)], "pid long, cluster int")
    walk = np.zeros((52, 52))  # 70 and 80 come last; neither has a label
    for i, j in pairs:
        walk[i, j] += 1
    walk[50, 1], walk[2, 51] = 2, 1
    walk[range(n), range(n)] += 1
    walk[:51] /= walk[:51].sum(1, keepdims=True)
    soft = np.zeros((52, 4))
    soft[range(n), label] = 1
    for _ in range(5):
        soft = walk @ soft
        soft /= np.maximum(np.sqrt((soft * soft).sum(1, keepdims=True)), 1e-300)
    want = {(70 if i == 50 else i): int(np.round(soft[i], 9).argmax()) for i in range(51)}
    for parts in (None, spark.createDataFrame([(i, i % 3) for i in range(n)], "pid long, part int")):
        got = {r["pid"]: 3 if r["cluster"] is None else r["cluster"] for r in graph.smoothed_labels(edges, labels, 5, parts, every=2).collect()}
        assert got == want


def test_smoothing_deals_the_graph_once(spark, monkeypatch):
    tables = []
    keep = graph.saved
    monkeypatch.setattr(graph, "saved", lambda df: tables.append(df.columns) or keep(df))
    edges = spark.createDataFrame([(i, (i + 1) % 9, 1.0) for i in range(9)], "src long, dst long, w double")
    labels = spark.createDataFrame([(i, i // 3) for i in range(9)], "pid long, cluster int")
    for rounds in (8, 16):
        tables.clear()
        out = graph.smoothed_labels(edges, labels, rounds)
        assert out.count() == 9
        rows = [t for t in tables if "m" in t]
        assert len(rows) == 1 + rounds // 8 and all(t == ["pid", "sends", "c", "m"] or t[0] == "pid" for t in rows)


def test_curvature_fits_few_neighbourhoods_at_a_time(spark, monkeypatch):
    def fit(offsets):
        if offsets.size > 100:
            raise ValueError(f"{offsets.size} values at once")
        return np.full(len(offsets), float(len(offsets)))

    monkeypatch.setattr(curvature, "VALUES", 100, raising=False)
    monkeypatch.setattr(curvature, "mean_curvature", fit)
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(RNG.normal(size=(60, 3)))], "pid long, x double, y double, z double")
    assert curvature.curvature(df, 9).count() == 60
