"""Hard negatives against a search of all rows."""

import numpy as np
import pyarrow as pa
import pytest

from pointweave.llm import negatives


def brute(rows, every=100, positives=5, most=10):
    """rows: (vec_id, label, whole numbers)."""
    width = max((len(v) for _, _, v in rows), default=0)
    full = [(i, k, [*map(int, v)] + [0] * (width - len(v))) for i, k, v in rows]
    heads = {}
    for i, k, v in full:
        if i % every == 0:
            heads[i] = min(heads.get(i, (k, v)), (k, v))
    out = set()
    for a, (label, v) in heads.items():
        scored = [(-sum(p * q for p, q in zip(v, w)), i, k) for i, k, w in full if i != a]
        same = sorted((s, i) for s, i, k in scored if k == label)[:positives]
        for s, p in same:
            fit = sorted((t, i) for t, i, k in scored if k != label and 30 * -s <= 100 * -t <= 90 * -s)[:most]
            out |= {(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit, 1)}
    return out


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "mine", 1.5) for r in rows], "vec_id long, label int, v array<long>, block string, norm double").repartition(3)
    return {tuple(r) for r in negatives.mined(df, **more).collect()}


def clustered(n, width, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    v = np.floor(256 * (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, width)))).astype(int)
    return [(i, int(rng.integers(0, labels)), v[i].tolist()) for i in range(n)]


def test_against_all_rows_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 8 * 8 * 20)  # blocks of 20 rows
    monkeypatch.setattr(negatives, "ANCHORS", 8 * 24 * 30)  # several rounds
    rows = clustered(1200, 8, 1)
    want = brute(rows, 10)
    assert len(want) > 2000
    assert got(spark, rows, every=10) == want


def test_ties_copies_zeros_and_short_vectors(spark):
    rows = [(i, i % 3 % 2, [3, 4]) for i in range(60)] + [(60, 0, [0, 0]), (61, 1, []), (62, 1, [1]), (100, 0, [-3, -4]), (100, 0, [-3, -4]), (100, 1, [5, 5]), (63, 1, [3, 4, 9])]
    rows += [(63, 1, [3, 4, 9]), (-100, 1, [2, 2]), (200, 7, [1, 1])]
    rows += [(70 + i, 1, [2, i % 4]) for i in range(25)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, every=1) == brute(rows, 1)


def test_tables_without_results(spark):
    assert got(spark, []) == set()
    assert got(spark, [(1, 0, [1]), (2, 1, [1])]) == set()
    assert got(spark, [(100, 0, [1]), (2, 1, [1])]) == set()
    assert got(spark, [(100, 0, []), (2, 1, []), (3, 0, [])]) == brute([(100, 0, []), (2, 1, []), (3, 0, [])])


def test_large_components_are_exact_and_overflows_are_errors(spark):
    rows = clustered(150, 4, 2)
    large = [(i, k, [x * (1 << 18) for x in v]) for i, k, v in rows]
    assert got(spark, large) == brute(large)
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        got(spark, [(i, k, [x << 45 for x in v]) for i, k, v in rows])


def test_rows_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [0.5, -0.001]), (2, None, [1.0]), (3, 0, None), (4, 0, [1.0, None]), (5, 0, [nan]), (6, 0, [-inf]), (None, 1, [1.0]), (14, 9, [1.0]), (7, 3, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    used = negatives.relabelled(negatives.usable(df)).collect()
    assert {(r["vec_id"], r["label"], tuple(r["v"])) for r in used} == {(1, 0, (128, -1)), (14, 0, (256,)), (7, 4, ())}


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(size=(300, 6))).astype(np.int64)
    v[::3] = v[0] * rng.integers(1, 4, (100, 1))  # the same direction
    refs = negatives.directions(v[:50].astype(float), 5)
    x = v.astype(float)
    norms = np.sqrt((x * x).sum(1))
    angles = np.arccos(np.clip(x @ refs.T / norms[:, None], -1, 1))
    row = {"ids": np.arange(300).tobytes(), "label": np.zeros(300, np.int64).tobytes(), "v": v.tobytes(), "norms": norms.tobytes(), "angles": angles.tobytes()}
    b = negatives.Block(row, 6, 5, "")
    low, high = negatives.bounds(b, b)
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low).mean() < 0.7 * (2 * norms[:, None] * norms).mean()


def test_lists_become_rows():
    assert negatives.matrix(pa.array([[1, 2], [], [3]], pa.list_(pa.int64())), 3).tolist() == [[1, 2, 0], [0, 0, 0], [3, 0, 0]]
