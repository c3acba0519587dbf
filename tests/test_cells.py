"""Neighbour joins over cells and Ward clustering, against numpy."""

import heapq

import numpy as np
import pytest

from pointweave.operators import ward
from pointweave.operators.cells import grown
from pointweave.operators.knn import knn


def frame(spark, p, ids=None):
    axes = "xyzw"[: p.shape[1]]
    return spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(range(len(p)) if ids is None else ids, p)], "i long, " + ", ".join(f"{c} double" for c in axes))


def brute(p, q, k, itself=True):
    out = {}
    for i in range(len(p)):
        d2 = np.zeros(len(q))
        for c in range(p.shape[1]):
            d2 += (p[i, c] - q[:, c]) * (p[i, c] - q[:, c])
        order = [j for j in np.lexsort((np.arange(len(q)), d2)) if itself or j != i][:k]
        out.update({(i, r + 1): (j, d2[j]) for r, j in enumerate(order)})
    return out


def got(a, b, k, p, **more):
    return {(r["a"], r["rank"]): (r["b"], r["d2"]) for r in knn(a, b, k, ("i", "i"), axes=tuple("xyzw"[: p.shape[1]]), small=50, **more).collect()}


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_cells_against_all_pairs(spark, dims):
    rng = np.random.default_rng(dims)
    p, q = rng.normal(size=(300, dims)), rng.normal(size=(2000, dims)) ** 3
    assert got(frame(spark, p), frame(spark, q), 7, p) == brute(p, q, 7)


def test_copies_lattices_and_lines(spark):
    rng = np.random.default_rng(7)
    p = np.concatenate([np.zeros((400, 3)), rng.integers(0, 6, (500, 3)), np.stack([np.arange(300) * 1e-3, np.ones(300), np.ones(300)], 1)]).astype(float)
    df = frame(spark, p)
    assert got(df, df, 9, p, itself=False) == brute(p, p, 9, itself=False)
    same = np.ones((80, 3))
    assert got(frame(spark, same), frame(spark, same), 3, same) == brute(same, same, 3)


def test_far_points_and_few_points(spark):
    rng = np.random.default_rng(8)
    q = rng.normal(size=(1500, 3))
    p = np.concatenate([rng.normal(size=(60, 3)) + 1e4, rng.normal(size=(60, 3)) * 30, [[1e9, 0, 0]]])
    assert got(frame(spark, p), frame(spark, q), 5, p) == brute(p, q, 5)
    assert got(frame(spark, p[:3]), frame(spark, q[:60]), 100, p) == brute(p[:3], q[:60], 100)


def test_points_without_a_place(spark):
    nan, inf = float("nan"), float("inf")
    odd = spark.createDataFrame([(1, 0.0, 0.0, None), (2, nan, 0.0, 0.0), (3, 0.0, inf, 0.0), (4, 0.0, 0.0, 0.0)], "i long, x double, y double, z double")
    for small in (0, 50):
        assert [(r["a"], r["b"]) for r in knn(odd, odd, 2, ("i", "i"), small=small).collect()] == [(4, 4)]
        assert knn(odd, odd.where("i < 4"), 2, ("i", "i"), small=small).count() == 0
        assert knn(odd.where("i < 4"), odd, 2, ("i", "i"), small=small).count() == 0


def test_trees_part_all_but_equal_points():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(500, 3)), np.zeros((300, 3))])
    tree = grown(x, 64)
    cell = tree.assign(x)
    assert len(set(cell[500:])) == 1 and len(set(cell)) > 30
    assert np.bincount(cell[:500]).max() < 60
    assert grown(np.zeros((10, 3)), 4).assign(np.ones((2, 3))).tolist() == [0, 0]


def one_by_one(points, edges, k):
    """Merges of the cheapest pair again and again, with a heap; labels by the smallest id."""
    n, sums = {i: 1.0 for i in range(len(points))}, {i: p.astype(float) for i, p in enumerate(points)}
    near = {i: set() for i in n}
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    cost = lambda u, v: n[u] * n[v] / (n[u] + n[v]) * ((sums[u] / n[u] - sums[v] / n[v]) ** 2).sum()
    heap = [(cost(u, v), u, v, n[u], n[v]) for u in near for v in near[u] if u < v]
    heapq.heapify(heap)
    label = {i: i for i in n}
    while heap and len(n) > k:
        _, u, v, nu, nv = heapq.heappop(heap)
        if n.get(u) != nu or n.get(v) != nv:
            continue
        n[u] += n.pop(v)
        sums[u] = sums[u] + sums.pop(v)
        label = {i: u if c == v else c for i, c in label.items()}
        for o in near.pop(v):
            near[o].discard(v)
            if o != u:
                near[o].add(u)
                near[u].add(o)
        for o in near[u]:
            a, b = min(u, o), max(u, o)
            heapq.heappush(heap, (cost(a, b), a, b, n[a], n[b]))
    names = {c: i for i, c in enumerate(sorted(set(label.values())))}
    return [names[label[i]] for i in range(len(points))]


def clusters(spark, p, edges, k, **more):
    axes = tuple("xyzw"[: p.shape[1]])
    links = spark.createDataFrame([(int(u), int(v)) for u, v in edges], "src long, dst long")
    out = {r["pid"]: r["cluster"] for r in ward.ward(frame(spark, p).withColumnRenamed("i", "pid"), links, k, axes, **more).collect()}
    return [out[i] for i in range(len(p))]


def inertia(p, label):
    return sum(((p[np.array(label) == c] - p[np.array(label) == c].mean(0)) ** 2).sum() for c in set(label))


def test_ward_on_a_complete_graph_is_the_heap_version(spark):
    p = np.random.default_rng(11).normal(size=(60, 3))
    edges = [(u, v) for u in range(60) for v in range(u)] + [(3, 3), (1, 2)]
    for k in (1, 6):
        assert clusters(spark, p, edges, k, local=20) == one_by_one(p, edges, k)


def test_ward_of_500_points_on_a_neighbour_graph(spark):
    p = np.random.default_rng(12).normal(size=(500, 4))
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    edges = [(i, int(j)) for i in range(500) for j in np.argsort(d[i])[1:9]]
    want = one_by_one(p, edges, 9)
    here = clusters(spark, p, edges, 9, local=100)
    assert here == clusters(spark, p, edges, 9, local=500)  # the same rounds in memory
    assert len(set(here)) == 9
    assert inertia(p, here) == pytest.approx(inertia(p, want), rel=0.1)


def test_ward_of_graphs_in_parts(spark):
    rng = np.random.default_rng(13)
    p = np.concatenate([rng.normal(size=(30, 3)) + c for c in (0, 50, 100)] + [[[200.0, 0, 0]]])
    edges = [(i, i + 1) for i in range(89) if i % 30 != 29]
    for local in (10, 1000):
        label = clusters(spark, p, edges, 4, local=local)
        assert label == [0] * 30 + [1] * 30 + [2] * 30 + [3]
    assert clusters(spark, p[:3], [], 5) == [0, 1, 2]
    assert clusters(spark, p[:1], [], 1) == [0]
    assert ward.ward(frame(spark, p).withColumnRenamed("i", "pid").where("pid < 0"), spark.createDataFrame([], "src long, dst long"), 3).count() == 0


@pytest.mark.parametrize("k, itself", [(1, True), (9, True), (4, False)])
def test_middle_sized_clouds_are_searched_without_written_tables(spark, monkeypatch, k, itself):
    from pointweave.operators import knn as neighbours

    monkeypatch.setattr(neighbours, "saved", None)
    rng = np.random.default_rng(12)
    p = np.concatenate([np.round(rng.random((4200, 3)) * 12) / 4, np.full((40, 3), 1.0), [[90.0, 0, -0.0]]])
    b = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)] + [(9000, 0.0, float("nan"), 0.0)], "i long, x double, y double, z double")
    got = {(r["a"], r["rank"]): (r["b"], r["d2"]) for r in knn(b.where("i % 60 = 0 or i > 4235"), b, k, ("i", "i"), itself=itself).collect()}
    want = {}
    for i in [i for i in range(len(p)) if i % 60 == 0 or i > 4235]:
        d2 = ((p[i] - p) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(p)), d2)) if itself or j != i][:k]
        want |= {(i, r + 1): (j, d2[j]) for r, j in enumerate(order)}
    assert got == want
