"""Long series: slices, halos, carries, exact quantiles and ranks against plain versions, with slices of a few rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarp.operators import grid, scaling, slices, windows
from tidewarp.operators.slices import Slices
from tidewarp.series import SeriesSpec

SPEC = SeriesSpec(("k",), "t", "y")
NO_KEYS = SeriesSpec((), "t", "y")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(11)
    sizes = {"a": 400, "b": 1, "c": 37, None: 60}
    out = []
    for k, n in sizes.items():
        for i in range(n):
            out.append((k, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(i * 3))).to_pydatetime(), None if r.random() < 0.5 or (k == "c" and i > 30) or (k is None and i < 9) else float(r.integers(0, 50)), i))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t timestamp, y double, i int").repartition(5)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 16)
    init = Slices.__init__
    monkeypatch.setattr(Slices, "__init__", lambda self, df, keys, order, parts=None: init(self, df, keys, order, parts or 9))


def series(rows):
    out = {}
    for k, t, y, i in sorted(rows, key=lambda r: r[3]):
        out.setdefault(k, []).append((t, y))
    return out


def same(a, b):
    return a is None and b is None or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


def test_positions(df, rows):
    s = Slices.of(df, SPEC)
    assert s.sorted.select("__tw_slice").distinct().count() > 5
    found = s.numbered("rn", "n").collect()
    assert len(found) == len(rows) and all(r["rn"] == r["i"] for r in found)
    assert {(r["k"], r["n"]) for r in found} == {(k, len(v)) for k, v in series(rows).items()}


@pytest.mark.parametrize("step", [1, 3])
def test_supervised_windows(df, rows, step):
    found = {(r["k"], r["start"]): (r["x"], r["y"]) for r in windows.supervised_windows(df, SPEC, 5, 2, step).collect()}
    want = {(k, i): ([y for _, y in v[i : i + 5]], [y for _, y in v[i + 5 : i + 7]]) for k, v in series(rows).items() for i in range(0, len(v) - 6, step)}
    assert found == want


def test_windows_wider_than_blocks(df, rows):
    found = {(r["k"], r["start"]): r["x"] for r in windows.lag_windows(df, SPEC, 50).collect()}
    assert found == {(k, i): [y for _, y in v[i : i + 50]] for k, v in series(rows).items() for i in range(len(v) - 49)}


def test_row_by_row(df, rows):
    for r in windows.difference(df, SPEC, lag=4).collect():
        v = series(rows)[r["k"]]
        past = v[r["i"] - 4][1] if r["i"] >= 4 else None
        assert same(r["diff"], None if past is None or r["y"] is None else r["y"] - past)
    found = windows.moving_average(df, SPEC, 3).collect()
    assert len(found) == sum(max(0, len(v) - 2) for v in series(rows).values())
    for r in found:
        known = [y for _, y in series(rows)[r["k"]][r["i"] - 2 : r["i"] + 1] if y is not None]
        assert same(r["moving_average"], sum(known) / len(known) if known else None)


def test_fills(df, rows):
    want_fill, want_line = {}, {}
    for k, v in series(rows).items():
        y = pd.Series([y for _, y in v], dtype=float)
        want_fill |= {(k, i): x for i, x in enumerate(y.ffill())}
        want_line |= {(k, i): x for i, x in enumerate(y.interpolate(limit_direction="forward"))}
    for f, want in ((grid.forward_fill, want_fill), (grid.interpolate, want_line)):
        out = f(df, SPEC)
        assert out.columns == df.columns
        found = {(r["k"], r["i"]): r["y"] for r in out.collect()}
        assert found.keys() == want.keys() and all(same(found[x], None if math.isnan(want[x]) else want[x]) for x in want)


def test_outliers_and_gaps(df, rows):
    found = {(r["k"], r["i"]): (r["y"], r["outlier"]) for r in grid.repair_outliers(df, SPEC, 3, 1.5).collect()}
    for k, v in series(rows).items():
        for i, (_, y) in enumerate(v):
            around = [x for _, x in v[max(0, i - 3) : i + 4] if x is not None]
            odd = y is not None and abs(y - np.mean(around)) > 1.5 * np.std(around)
            assert found[k, i][1] == odd and same(found[k, i][0], float(np.mean(around)) if odd else y)
    gaps = {r["k"]: (r["gap_seconds"], r["n"]) for r in grid.sampling_gaps(df, SPEC, "seconds").collect()}
    assert gaps == {k: (3 * 3600, len(v) - 1) for k, v in series(rows).items() if len(v) > 1}


@pytest.mark.parametrize("knots", [5, 1001])
def test_exact_quantiles(df, rows, knots):
    found = {r["k"]: (r["__rows"], r["__knots"]) for r in scaling.exact_quantiles(df.select("k", "y"), ("k",), "y", knots).collect()}
    known = {k: [y for _, y in v if y is not None] for k, v in series(rows).items()}
    assert found.keys() == {k for k, v in known.items() if v}
    for k, (n, got) in found.items():
        assert n == len(known[k]) and len(got) == knots
        np.testing.assert_allclose(got, np.quantile(known[k], np.linspace(0, 1, knots)), rtol=1e-12)


def test_ranks(df, rows):
    known = df.where("k IS NOT NULL AND y IS NOT NULL")
    scaler = scaling.GaussRankScaler(SPEC).fit(known)
    assert {(r["k"], r["value"]): r["rank"] for r in scaler.knots.collect()} == {(k, y): i for k, v in series(rows).items() if k for i, y in enumerate(sorted({y for _, y in v if y is not None}))}
    back = scaler.inverse(scaler.transform(known))
    assert back.count() == known.count() and back.where(F.abs(F.col("y") - F.col("y")) > 1e-6).count() == 0
    a, b = ({(r["k"], r["i"]): r["y"] for r in x.collect()} for x in (known, back))
    assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-3 for x in a)
    # Between two knots and beyond the last.
    ends = known.groupBy("k").agg((F.max("y") + 5).alias("y"), F.max("t").alias("t"))
    assert {round(r["score"], 6) for r in scaler.ranks(ends).collect()} <= {0.9999, 0.0}


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, t timestamp, y double")
    assert windows.supervised_windows(none, SPEC, 3, 1).count() == 0 and grid.interpolate(none, SPEC).count() == 0
    assert windows.moving_average(none, NO_KEYS).count() == 0 and scaling.exact_quantiles(none, (), "y", 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        windows.lag_windows(none, SPEC, 0)


def test_a_long_series_over_balanced_tasks(spark, monkeypatch):
    """Two million rows of one key: ranges and blocks are even, and nothing is exchanged by the key alone."""
    monkeypatch.setattr(slices, "BLOCK", 1 << 14)
    n = 2_000_000
    long = spark.range(n).select(F.lit("one").alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("t"), (F.col("id") % 1000).cast("double").alias("y"))
    s = Slices(long, ("k",), ["t"], 8)
    sizes = [r["count"] for r in s.sorted.groupBy("__tw_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.5 * n / 8
    found, over = s.blocks(after=9)
    found = found.withColumn("x", F.sum("y").over(over.rowsBetween(0, 9))).where("__tw_own")
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == n and max(per_task) < n / 2
    assert found.where(F.col("__tw_rn") <= n - 10).agg(F.sum("x")).first()[0] == sum(sum((i + j) % 1000 for j in range(10)) for i in range(1000)) * 2000 - sum(sum((i + j) % 1000 for j in range(10)) for i in range(991, 1000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "hashpartitioning(k#" not in plan.replace("__tw_block", "") or "__tw_block" in plan
