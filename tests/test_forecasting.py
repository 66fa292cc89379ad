"""Least squares from Gram sums, candidate search, bootstrap by weights, covariates known ahead, against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.models.registry import make
from tidewarp.operators import covariates, intervals, least_squares, resample, slices
from tidewarp.operators.slices import Slices
from tidewarp.plans import search
from tidewarp.plans.configs import PipelineConfigs
from tidewarp.series import SeriesSpec

SPEC = SeriesSpec(("k",), "t", "y")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 16)
    init = Slices.__init__
    monkeypatch.setattr(Slices, "__init__", lambda self, df, keys, order, parts=None: init(self, df, keys, order, parts or 5))


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def values():
    r = np.random.default_rng(2)
    t = np.arange(120)
    return {"a": 10 + 3 * np.sin(t * 2 * np.pi / 7) + r.normal(0, 0.3, 120), "b": 50 + 0.5 * t + r.normal(0, 2, 120), "flat": np.full(60, 4.0), "short": np.arange(5.0)}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, day(i), float(y), i) for k, v in values().items() for i, y in enumerate(v)], "k string, t date, y double, extra int").repartition(3)


def windows(v, lags, horizon):
    both = np.lib.stride_tricks.sliding_window_view(v, lags + horizon)
    return np.column_stack([np.ones(len(both)), both[:, :lags]]), both[:, lags:]


def test_direct_regression_is_least_squares(df):
    found = {(r["k"], r["horizon"]): (r["n"], r["coefficients"]) for r in least_squares.direct_regression(df, SPEC, 7, 3).collect()}
    assert {k for k, _ in found} == {"a", "b", "flat"}
    for k in ("a", "b"):
        x, y = windows(values()[k], 7, 3)
        want = np.linalg.lstsq(x, y, rcond=None)[0]
        for h in (1, 2, 3):
            assert found[k, h][0] == len(x)
            np.testing.assert_allclose(found[k, h][1], want[:, h - 1], rtol=1e-5, atol=1e-6)
    # A constant series: any one column explains it, the others add nothing.
    assert sum(c != 0 for c in found["flat", 1][1]) == 1


def test_direct_forecast(df):
    found = {(r["k"], r["t"]): r["y"] for r in least_squares.direct_forecast(df, SPEC, 7, 3).collect()}
    for k in ("a", "b", "flat"):
        v = values()[k]
        x, y = windows(v, 7, 3)
        want = np.append(1, v[-7:]) @ np.linalg.lstsq(x, y, rcond=None)[0]
        for h in range(3):
            assert abs(found[k, day(len(v) + h)] - want[h]) < 1e-4


def test_windows_with_nulls_are_left_out(df):
    holes = df.where("k = 'a'").withColumn("y", F.when(F.col("extra") % 30 != 3, F.col("y")))
    v = values()["a"].copy()
    v[np.arange(120) % 30 == 3] = np.nan
    x, y = windows(v, 4, 1)
    good = ~np.isnan(x).any(axis=1) & ~np.isnan(y).any(axis=1)
    got = least_squares.direct_regression(holes, SPEC, 4, 1).first()
    assert got["n"] == good.sum()
    np.testing.assert_allclose(got["coefficients"], np.linalg.lstsq(x[good], y[good], rcond=None)[0][:, 0], rtol=1e-5, atol=1e-6)


def test_solving_takes_the_largest_pivot(spark):
    system = spark.createDataFrame([([[0.0, 2.0, 4.0], [3.0, 1.0, 5.0]],), ([[1e-20, 1.0, 1.0], [1.0, 1.0, 2.0]],), ([[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]],)], "m array<array<double>>")
    a, b, c = (r[0] for r in system.select(least_squares.solve(F.col("m"), 2)).collect())
    assert a == [[1.0], [2.0]]
    np.testing.assert_allclose(b, [[1.0], [1.0]])
    assert [x for [x] in c].count(0.0) == 1
    ridge = system.limit(1).select(least_squares.solve(F.array(F.array(F.lit(2.0), F.lit(0.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(4.0))), 2, 1.0)).first()[0]
    assert ridge == [[1.0], [2.0]]


def test_multiplicities_are_the_bootstrap(df):
    length, splits = 7, 4
    drawn = resample.block_multiplicities(df, SPEC, length, splits)
    assert drawn.columns == [*df.columns, "times_drawn"]
    weights = {(r["k"], r["extra"]): r["times_drawn"] for r in drawn.collect()}
    train, test = resample.block_bootstrap(df, SPEC, length, splits)
    count = {(r["k"], r["extra"], r["split"]): r["count"] for r in train.groupBy("k", "extra", "split").count().collect()}
    assert {(k, i, s): n for (k, i), w in weights.items() for s, n in enumerate(w) if n} == count
    assert {(r["k"], r["extra"], r["split"]) for r in test.collect()} == {(k, i, s) for (k, i), w in weights.items() for s, n in enumerate(w) if not n}
    means = train.groupBy("split", "k").agg(F.avg("y").alias("y_hat"))
    want = {r["k"]: r["error"] for r in intervals.interval_error(test.join(means, ["split", "k"]), SPEC, 0.8).collect()}
    got = {r["k"]: r["error"] for r in resample.mean_errors(df, SPEC, length, splits, 0.8).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want) and all(got[k] is None for k in got.keys() - want.keys())


def configs():
    return PipelineConfigs([("naive", {}), *[("d_linear", f"k{k}", {"init_configs": {"kernel_size": k}}) for k in (3, 5, 7)], ("n_linear", {}), ("d_linear", "few", {"init_configs": {"lags": 3}})])


def test_halving(df, monkeypatch):
    written = []
    keep = search.written
    monkeypatch.setattr(search, "written", lambda d, what: written.append(what) or keep(d, what))
    found = search.halving(df, SPEC, configs(), 7, valid_rows=10, rungs=3).collect()
    assert written == ["rung"] * 3
    plain = {alias: (name, o["init_configs"]) for alias, name, o in configs().entries}
    series = values()
    for k in ("a", "b", "flat"):
        racing = set(plain)
        for rung in range(3):
            own = sorted((r for r in found if r["k"] == k and r["rung"] == rung), key=lambda r: r["rank"])
            assert {r["model"] for r in own} == racing
            n = (len(series[k]) - 10) // (4 >> rung)
            v = series[k][-n - 10 :]
            for r in own:
                name, params = plain[r["model"]]
                model = make(name, **{"lags": 7, "seed": 0} | params)
                days = np.arange(len(series[k]) - len(v), len(series[k])) + (day(0) - dt.date(1970, 1, 1)).days
                f = model.predict_values(model.fit_values(v[:n], days[:n]), v[n - model.lags : n], days[n:])
                assert r["train_rows"] == n and abs(r["score"] - np.mean(np.abs(f - v[n:]))) < 1e-9
            assert [(r["score"], r["model"]) for r in own] == sorted((r["score"], r["model"]) for r in own)
            racing = {r["model"] for r in own if r["kept"]}
            assert len(racing) == (1 if rung == 2 else -(-len(own) // 2))
    assert not any(r["k"] == "short" for r in found)


def test_halving_without_keys_and_winners(spark, df):
    one = df.where("k = 'a'").drop("k")
    found = search.halving(one, SeriesSpec((), "t", "y"), configs(), 7, rungs=2)
    won = search.best(found, []).collect()
    assert len(won) == 1 and won[0]["model"] != "naive"
    none = search.halving(df.limit(0), SPEC, configs(), 7, rungs=2)
    assert none.count() == 0
    with pytest.raises(ValueError, match="rungs"):
        search.halving(df, SPEC, configs(), 7, rungs=0)
    with pytest.raises(ValueError, match="more than"):
        search.halving(df, SPEC, PipelineConfigs([("wide_gbrt", {})]), 7)


def test_only_versions_known_by_the_origin_are_used(spark):
    versions = [("a", day(10), day(1), 1.0), ("a", day(10), day(5), 5.0), ("a", day(10), day(9), 9.0), ("a", day(11), None, 7.0), ("b", day(10), day(8), 80.0), ("a", day(12), day(5), 3.0), ("a", day(12), day(5), 4.0)]
    v = spark.createDataFrame(versions, "k string, t date, known date, x double")
    origins = spark.createDataFrame([("a", day(9)), ("a", day(8)), ("b", day(7)), ("c", day(9)), (None, day(9))], "k string, origin date")
    found = {(r["k"], r["origin"], r["horizon"]): (r["t"], r["x"], r["known"]) for r in covariates.known_ahead(origins, v, SPEC, ["x"], 3).collect()}
    assert len(found) == 15
    assert found["a", day(9), 1] == (day(10), 9.0, day(9))
    assert found["a", day(8), 2] == (day(10), 5.0, day(5))
    assert found["a", day(9), 2] == (day(11), 7.0, None)
    assert found["a", day(9), 3] == (day(12), 4.0, day(5))
    assert found["b", day(7), 3] == (day(10), None, None) and found["c", day(9), 1][1] is None and found[None, day(9), 1][1] is None


def test_running_versions(spark):
    changes = spark.createDataFrame([("d", 1, 2.0), ("d", 1, 3.0), ("d", 4, 1.0), ("e", 2, 7.0)], "k string, known int, q double")
    assert sorted(map(tuple, covariates.running_versions(changes, ["k"], "known", {"x": "q"}).collect())) == [("d", 1, 5.0), ("d", 4, 6.0), ("e", 2, 7.0)]


# --- arrays by matrix, peaks, chains with validation rows, features known ahead


def test_correlations_and_spectra_are_numpys(spark):
    from tidewarp.functions import arrays

    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=n).tolist(), r.normal(size=m).tolist()) for i, (n, m) in enumerate([(7, 7), (7, 6), (8, 7), (8, 8), (1, 1), (9, 2), (7, 6)])] + [(90, None, [1.0]), (91, [], [])]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    found = df.select("i", arrays.correlate_same(F.col("a"), F.col("b")).alias("c"), arrays.spectrum(F.col("a")).alias("s"), arrays.frequencies(F.col("a"), 0.5).alias("f"), arrays.spectrum_top(F.col("a"), 2).alias("t"))
    for r_, (_, a, b) in zip(sorted(found.collect()), rows, strict=True):
        if not a:
            assert r_["c"] is None and r_["s"] is None
            continue
        np.testing.assert_allclose(r_["c"], np.correlate(a, b, "same"), atol=1e-12)
        np.testing.assert_allclose(r_["s"], np.abs(np.fft.fft(a)), atol=1e-12)
        np.testing.assert_allclose(r_["f"], np.fft.fftfreq(len(a), 0.5), atol=1e-12)
        assert [t["amplitude"] for t in r_["t"]] == sorted(r_["s"], reverse=True)[:2]


def plain_peaks(x, distance=None):
    runs = [0, *(i for i in range(1, len(x)) if x[i] != x[i - 1]), len(x)]
    tops = [(x[a], (a + b - 1) // 2) for p, a, b in zip(runs, runs[1:], runs[2:], strict=False) if b < len(x) and x[a] > x[p] and x[a] > x[b]]
    kept = []
    for _, i in sorted(tops, reverse=True):
        if distance is None or all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return len(kept)


def test_peaks(spark):
    from tidewarp.functions import arrays

    r = np.random.default_rng(4)
    rows = [(i, r.integers(0, 4, n).astype(float).tolist()) for i, n in enumerate([0, 1, 2, 3, 5, 12, 40, 200, 700])] + [(20, [1.0] * 6), (21, [0.0, 1.0, 1.0, 0.0]), (22, [1.0, 2.0, 2.0])]
    found = spark.createDataFrame(rows, "i int, x array<double>").select("i", arrays.peaks(F.col("x")).alias("p"), arrays.far_peaks(F.col("x"), 20).alias("f")).collect()
    assert {r["i"]: (r["p"], r["f"]) for r in found} == {i: (plain_peaks(x), plain_peaks(x, 20)) for i, x in rows}


def test_chain_with_validation_rows_and_saving(spark, df, tmp_path):
    from tidewarp.operators import scaling
    from tidewarp.plans.chain import Chain, load_chain

    rows = df.where("k IN ('a', 'b')").drop("extra")
    train, valid = rows.where(F.col("t") < day(110)), rows.where(F.col("t") >= day(110))
    chain = Chain(SPEC, [("scale", scaling.Scaler(SPEC, "standard")), ("ranks", scaling.GaussRankScaler(SPEC)), ("model", make("n_linear", lags=7))]).fit(train, valid)
    scores = {r["k"]: (r["n"], r["mae"]) for r in chain.scores.collect()}
    assert scores["a"][0] == 10 and scores["a"][1] < 2
    first = scaling.Scaler(SPEC, "standard").fit(train).transform(valid).agg(F.max("y")).first()[0]
    assert chain.transformed.count() == 20 and chain.transformed.agg(F.max("y")).first()[0] != first
    with pytest.raises(ValueError, match="after"):
        chain.fit(valid, train)
    chain.fit(train, valid)
    chain.save(str(tmp_path / "chain"))
    again = load_chain(spark, str(tmp_path / "chain"))
    key = lambda c: sorted((r["k"], r["horizon"], round(r["y"], 9)) for r in c.predict(3).collect())
    assert key(again) == key(chain) and [n for n, _ in again.steps] == ["scale", "ranks", "model"]


def test_features_known_ahead_are_used(spark):
    """The target follows a feature; a future in which it rises is forecast higher than one in which it stays."""
    r = np.random.default_rng(5)
    x = (r.random(160) > 0.5).astype(float)
    rows = [(day(i), float(10 + 50 * x[i]), float(x[i])) for i in range(160)]
    spec = SeriesSpec((), "t", "y", ("x",))
    fitted = make("wide_gbrt", lags=4).fit(spark.createDataFrame(rows, "t date, y double, x double"), spec)
    ahead = lambda v: spark.createDataFrame([(day(160 + i), v) for i in range(9)], "t date, x double")
    up, down, none = ([r["y"] for r in fitted.predict(9, future=f).orderBy("horizon").collect()] for f in (ahead(1.0), ahead(0.0), None))
    assert up[:4] == down[:4] and up[5:] != down[5:]
    assert none == (up if x[-1] == 1.0 else down)
