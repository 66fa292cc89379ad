"""Reconciled forecasts against the summing matrix of numpy."""

import numpy as np
import pytest

from tidewarp.operators.hierarchy import Hierarchy
from tidewarp.series import SeriesSpec

SPEC = SeriesSpec(("n", "store"), "t", "y")
EDGES = [("a", "top"), ("b", "top"), ("c", "top"), ("a1", "a"), ("a2", "a"), ("a2x", "a2"), ("a2y", "a2"), ("b1", "b"), ("u", "second"), ("v", "second"), ("b1", "b")]
LEAVES = ["a1", "a2x", "a2y", "b1", "c", "u", "v"]
NODES = ["top", "second", "a", "b", "a2", *LEAVES]


def covers(node, leaf):
    up = dict(EDGES)
    while leaf != node:
        if leaf not in up:
            return False
        leaf = up[leaf]
    return True


S = np.array([[float(covers(n, x)) for x in LEAVES] for n in NODES])


@pytest.fixture(scope="module")
def tree(spark):
    return Hierarchy(spark.createDataFrame([*EDGES, (None, "top"), ("z", None)], "node string, parent string"))


def forecasts(spark, seed=0, without=()):
    r = np.random.default_rng(seed)
    rows = [(n, s, t, None if n in without else float(r.normal(10, 4)), float(r.uniform(0.5, 3))) for s in ("x", "y") for t in (1, 2) for n in [*NODES, "alone"]]
    return rows, spark.createDataFrame(rows, "n string, store string, t int, y double, w double")


def by_cell(df):
    out = {}
    for r in df.collect():
        assert (r["n"]) not in out.setdefault((r["store"], r["t"]), {})
        out[r["store"], r["t"]][r["n"]] = r["y"]
    return out


def test_levels(tree):
    assert [{r["node"] for r in level.collect()} for level in tree.levels] == [{"top", "second"}, {"a", "b", "c", "u", "v"}, {"a1", "a2", "b1"}, {"a2x", "a2y"}]
    found = {tuple(r) for r in tree.summing().collect()}
    assert found == {(n, x) for i, n in enumerate(NODES) for j, x in enumerate(LEAVES) if S[i, j]}


@pytest.mark.parametrize("weighted", [False, True])
def test_least_squares(spark, tree, weighted):
    rows, df = forecasts(spark)
    found = by_cell(tree.least_squares(df, SPEC, "w" if weighted else None))
    for cell, got in found.items():
        own = {n: (y, w) for n, s, t, y, w in rows if (s, t) == cell}
        y, w = np.array([own[n][0] for n in NODES]), np.array([own[n][1] if weighted else 1.0 for n in NODES])
        want = S @ np.linalg.solve(S.T @ (w[:, None] * S), S.T @ (w * y))
        np.testing.assert_allclose([got[n] for n in NODES], want, rtol=1e-9)
        assert got["alone"] == own["alone"][0] and len(got) == len(NODES) + 1


def test_without_some_forecasts(spark, tree):
    rows, df = forecasts(spark, 1, without=("a", "a2x", "second"))
    found = by_cell(tree.least_squares(df, SPEC))
    keep_n, keep_x = [n for n in NODES if n not in ("a", "a2x", "second")], [x for x in LEAVES if x != "a2x"]
    for cell, got in found.items():
        own = {n: y for n, s, t, y, _ in rows if (s, t) == cell}
        own_s = S[:, [LEAVES.index(x) for x in keep_x]]
        a = own_s[[NODES.index(n) for n in keep_n]]
        want = own_s @ np.linalg.solve(a.T @ a, a.T @ np.array([own[n] for n in keep_n]))
        for n, x in zip(NODES, want, strict=True):
            assert abs(got.get(n, 0.0) - x) < 1e-9
        assert "a2x" not in got


def test_bottom_up_and_top_down(spark, tree):
    rows, df = forecasts(spark, 2)
    found = by_cell(tree.bottom_up(df, SPEC))
    past = [(x, s, 0, float(i) * (s == "x")) for i, x in enumerate(LEAVES) for s in ("x", "y")]
    down = by_cell(tree.top_down(df, spark.createDataFrame(past, "n string, store string, t int, y double"), SPEC))
    for cell in found:
        own = {n: y for n, s, t, y, _ in rows if (s, t) == cell}
        np.testing.assert_allclose([found[cell][n] for n in NODES], S @ np.array([own[x] for x in LEAVES]), rtol=1e-12)
        shares = {x: float(i) for i, x in enumerate(LEAVES)} if cell[0] == "x" else dict.fromkeys(LEAVES, 1.0)
        leaf = []
        for x in LEAVES:
            root = "second" if x in "uv" else "top"
            leaf.append(own[root] * shares[x] / sum(v for k, v in shares.items() if (k in "uv") == (x in "uv")))
        np.testing.assert_allclose([down[cell][n] for n in NODES], S @ np.array(leaf), rtol=1e-12)
        assert down[cell]["alone"] == own["alone"]


def test_no_forest(spark):
    for edges in ([("a", "b"), ("a", "c")], [("a", "b"), ("b", "a")], [("x", "y"), ("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError, match="parents|cycle"):
            Hierarchy(spark.createDataFrame(edges, "node string, parent string"))
