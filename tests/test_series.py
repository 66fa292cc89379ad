"""Series operators on small frames with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewarp.functions import arrays, calendar, metrics, plots, sql
from tidewarp.models import linear, nets, trees
from tidewarp.models.autodiff import Tensor, concat
from tidewarp.models.base import load_forecaster, pack_state, unpack_state
from tidewarp.models.registry import MODELS, PRESETS, make, model_names
from tidewarp.operators import checks, grid, intervals, resample, scaling, strategies, windows
from tidewarp.plans.chain import Chain, NotFittedError
from tidewarp.plans.configs import PipelineConfigs
from tidewarp.plans.pipeline import ModelPipeline, holdout
from tidewarp.series import SeriesSpec, require_time
from tidewarp.sources.catalogue import Dataset, SeriesCatalogue
from tidewarp.streaming import ingest

ONE = SeriesSpec()
KEYED = SeriesSpec(("k",))


def series(spark, values, start="2024-01-01", step=1):
    day = dt.date.fromisoformat(start)
    return spark.createDataFrame([(day + dt.timedelta(days=i * step), None if v is None else float(v)) for i, v in enumerate(values)], "ds date, y double").repartition(3)


def keyed(spark, **values):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(k, day + dt.timedelta(days=i), float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "k string, ds date, y double").repartition(3)


def col(spark, values, expression):
    return spark.createDataFrame([([float(v) for v in values],)], "x array<double>").select(expression(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize(("step", "horizon", "starts"), [(1, 1, [0, 1, 2, 3, 4]), (1, 2, [0, 0, 2, 2, 4, 4]), (2, 1, [0, 2, 4])])
def test_lag_windows(spark, step, horizon, starts):
    got = windows.lag_windows(series(spark, range(7)), ONE, 3, step, horizon).orderBy("row").collect()
    assert [r["start"] for r in got] == starts and got[-1]["x"] == [starts[-1], starts[-1] + 1.0, starts[-1] + 2.0]


def test_supervised_windows_per_key_keep_nulls(spark):
    df = keyed(spark, a=range(6), b=range(3)).withColumn("y", F.when(F.col("y") != 2, F.col("y")))
    got = windows.supervised_windows(df, KEYED, 2, 2, 2).orderBy("k", "start").collect()
    assert [(r["k"], r["start"], r["x"], r["y"]) for r in got] == [("a", 0, [0.0, 1.0], [None, 3.0]), ("a", 2, [None, 3.0], [4.0, 5.0])]
    with pytest.raises(ValueError):
        windows.supervised_windows(df, KEYED, 0, 1)


def test_split_tail_difference(spark):
    df = series(spark, [1.0, 4.0, 9.0, 16.0, 25.0])
    assert [r["part"] for r in windows.ordered_split(df, ONE, 0.7).orderBy("ds").collect()] == ["train"] * 3 + ["test"] * 2
    assert [r["y"] for r in windows.tail(df, ONE, 2).orderBy("ds").collect()] == [16.0, 25.0]
    assert [r["diff"] for r in windows.difference(df, ONE).orderBy("ds").collect()] == [None, 3.0, 5.0, 7.0, 9.0]
    assert [r["moving_average"] for r in windows.moving_average(df, ONE, 2).orderBy("ds").collect()] == [2.5, 6.5, 12.5, 20.5]


def test_array_functions(spark):
    x = [3.0, 1.0, 4.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        assert math.isclose(col(spark, x, lambda c, q=q: arrays.quantile(c, q)), np.percentile(x, 100 * q)), name
    assert math.isclose(col(spark, x, arrays.std_pop), np.std(x))
    p = np.array(x) / sum(x)
    assert math.isclose(col(spark, x, arrays.entropy2), -(p * np.log2(p)).sum())
    assert col(spark, [-1, 1], arrays.entropy2) is None
    assert col(spark, x, lambda c: arrays.diff(c, 2)) == np.diff(x, 2).tolist()
    assert col(spark, x, arrays.peaks) == 2  # the plateau counts once
    assert col(spark, [1, 2, 2, 3], arrays.peaks) == 0 and col(spark, [5, 5, 5], arrays.peaks) == 0
    same = np.correlate(x, x, "full")[len(x) - 1 - len(x) // 2 :][: len(x)]
    assert np.allclose(col(spark, x, lambda c: arrays.correlate_same(c, c)), same)
    assert np.allclose(col(spark, x, arrays.spectrum), np.abs(np.fft.fft(x)))
    assert col(spark, x, arrays.evens) == x[::2] and col(spark, x, arrays.odds) == x[1::2]
    assert col(spark, x, lambda c: arrays.remove_at(c, 1, 2)) == [3.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    assert col(spark, [1, 2, 4], lambda c: arrays.moving_average_padded(c, 2)) == [1.5, 1.5, 3.0]


def test_calendar_edges(spark):
    days = [dt.date(2020, 2, 28), dt.date(2020, 2, 29), dt.date(2020, 3, 1), dt.date(2020, 12, 31), dt.date(2021, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "ds date")
    feats = calendar.calendar_features(F.col("ds"), F.lit(days[0]), "")
    assert len(feats) == 82
    got = {r["ds"]: r for r in df.select("ds", *[v.alias(k) for k, v in feats.items()]).collect()}
    for d, r in got.items():
        t = pd.Timestamp(d)
        assert (r["weekday"], r["week"], r["quarter"], r["day_of_year"], r["is_end_of_month"]) == (t.weekday(), t.week, t.quarter, t.dayofyear, int(t.is_month_end))
        assert r["is_weekend"] == int(t.weekday() < 5) and r["day_to_start_timestamp"] == (t - pd.Timestamp(days[0])).days
        assert r["day_to_last_year_winter"] == (t - pd.Timestamp(d.year - 1, 12, 1)).days and math.isclose(r["week_to_next_year_summer"], (t - pd.Timestamp(d.year + 1, 6, 1)).days / 7)
    assert df.select(calendar.extra_flags(F.col("ds"))["is_weekend_true"]).collect()[1][0] == 1


def test_grid(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, d), v) for d, v in [(1, 1.0), (2, None), (5, 7.0), (6, None)]], "ds date, y double")
    full = grid.regularise(df, ONE)
    assert full.count() == 6 and grid.regularise(df, ONE, fill=0.0).agg(F.sum("y")).first()[0] == 8.0
    assert [r["y"] for r in grid.interpolate(full, ONE).orderBy("ds").collect()] == [1.0, 2.5, 4.0, 5.5, 7.0, 7.0]
    assert [r["y"] for r in grid.forward_fill(full, ONE).orderBy("ds").collect()] == [1.0, 1.0, 1.0, 1.0, 7.0, 7.0]
    assert grid.modal_gap(df, ONE).first()["gap_days"] == 1
    assert [(str(r["after"]), r["gap_days"]) for r in grid.gap_report(df, ONE).collect()] == [("2024-01-02", 3)]
    spike = series(spark, [1.0] * 10 + [100.0] + [1.0] * 10)
    assert grid.repair_outliers(spike, ONE, 7, 2.0).where("outlier").count() == 1
    stamped = df.withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    assert str(grid.future_index(stamped, ONE, 2).orderBy("horizon").collect()[1]["ds"]) == "2024-01-08 00:00:00"


def test_checks(spark):
    df = keyed(spark, a=range(10), b=range(3))
    good, bad = checks.long_enough(df, KEYED, 5)
    assert {r["k"] for r in good.collect()} == {"a"} and [r["k"] for r in bad.collect()] == ["b"]
    a = df.where("k = 'a'")
    train, valid = a.where("ds < '2024-01-08'"), a.where("ds >= '2024-01-08'")
    assert checks.train_before_valid(train, valid, KEYED).first()["ok"]
    assert not checks.train_before_valid(a, valid, KEYED).first()["ok"]
    assert checks.pad_validation(train, valid, KEYED, 3).count() == 6
    assert checks.pad_validation(train, valid.where("ds > '2024-01-09'"), KEYED, 3).count() == 1  # not adjacent
    with pytest.raises(TypeError):
        require_time(df, SeriesSpec((), "k"))


@pytest.mark.parametrize("name", ["min_max", "standard", "quantile"])
def test_scaler_round_trip(spark, name):
    df = keyed(spark, a=[3, 1, 4, 1, 5, 9, 2, 6], b=[10, 20, 30, 40, 50, 60, 70, 90])
    s = scaling.Scaler(KEYED, name).fit(df)
    z = s.transform(df)
    back = {(r["k"], r["ds"]): r["y"] for r in s.inverse(z).collect()}
    for r in df.collect():
        assert math.isclose(back[r["k"], r["ds"]], r["y"], abs_tol=0.3 if name == "quantile" else 1e-9)
    if name != "standard":
        assert z.agg(F.min("y"), F.max("y")).first() == (0.0, 1.0)


def test_scaler_of_a_constant(spark):
    df = series(spark, [4.0] * 5)
    assert scaling.Scaler(ONE).fit(df).transform(df).agg(F.max("y")).first()[0] == 0.0


def test_gauss_rank(spark):
    df = series(spark, [5.0, 1.0, 3.0, 3.0, 9.0, 7.0])
    s = scaling.GaussRankScaler(ONE).fit(df)
    z = s.transform(df)
    got = {r["ds"]: r["y"] for r in z.collect()}
    assert math.isclose(sum(got[d] for d in got if d.day != 4), 0.0, abs_tol=1e-2)
    back = {r["ds"]: r["y"] for r in s.inverse(z).collect()}
    assert all(math.isclose(back[r["ds"]], r["y"], abs_tol=1e-6) for r in df.collect())


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-3.0, -1.0), (4.0, 4.0)], "y double, p double")
    got = df.agg(*[f("y", "p").alias(k) for k, f in metrics.METRICS.items()]).first()
    y, p = np.array([1.0, -3, 4]), np.array([2.0, -1, 4])
    assert math.isclose(got["wmape"], abs(y - p).sum() / abs(y).sum()) and math.isclose(got["rmse"], np.sqrt(((y - p) ** 2).mean()))
    assert math.isclose(got["r2"], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert df.where("y = 4").agg(metrics.r2("y", "p")).first()[0] is None


def test_intervals(spark):
    df = series(spark, [10.0, -10.0])
    got = intervals.apply_interval(df, ONE, 0.1).orderBy("ds").collect()
    assert (got[0]["y_lower"], got[0]["y_upper"]) == (9.0, 11.0) and (got[1]["y_lower"], got[1]["y_upper"]) == (-9.0, -11.0)
    scored = spark.createDataFrame([(s, 10.0, 10.0 - s) for s in range(5)], "split int, y double, y_hat double")
    assert math.isclose(intervals.interval_error(scored, ONE, 0.9).first()["error"], np.percentile([0, 0.1, 0.2, 0.3, 0.4], 90))
    assert math.isclose(intervals.interval_error(scored, ONE, 0.9, compat=True).first()["error"], np.percentile([0, 0.1, 0.2, 0.3, 0.4], 0.9))


def test_bootstrap_and_origins(spark):
    df = series(spark, range(50))
    train, test = resample.block_bootstrap(df, ONE, 10, 3)
    for split in range(3):
        a = {r["y"] for r in train.where(F.col("split") == split).collect()}
        b = {r["y"] for r in test.where(F.col("split") == split).collect()}
        assert not a & b and a | b == set(map(float, range(50)))
    folds = resample.rolling_origin(df, ONE, 10, 5, 2)
    assert [r["y"] for r in folds.where("fold = 1 AND part = 'test'").orderBy("rn").collect()] == [40.0, 41.0, 42.0, 43.0, 44.0]


def test_strategies(spark):
    x = strategies.context(series(spark, range(10)), ONE, 3).first()["x"]
    assert x == [7.0, 8.0, 9.0]
    rolled = col(spark, [3, 6, 9], lambda c: strategies.recursive(c, 2, strategies.moving_average_step(3)))
    assert rolled == [6.0, 7.0]
    line = strategies.ar1(series(spark, [2.0**i for i in range(8)]), ONE).first()
    assert math.isclose(line["slope"], 2.0) and line["last"] == 128.0


@pytest.mark.parametrize("name", sorted(MODELS))
def test_models_learn_a_weekly_pattern(name):
    t = np.arange(140)
    y = 50 + 10 * np.sin(2 * np.pi * t / 7) + 0.02 * t
    model = make(name, lags=7, rounds=40, epochs=150)
    days = t + 19723.0
    if model.wide_inputs:
        own = np.column_stack([days % 7, days // 30])
        got = model.predict_wide(unpack_state(pack_state(model.fit_wide(y[:-7], own[:-7]))), y[-14:-7], own[-8], own[-7:])
    else:
        got = model.predict_values(unpack_state(pack_state(model.fit_values(y[:-7], days[:-7]))), y[-14:-7], days[-7:])
    naive = np.abs(y[-7:] - y[-8]).mean()
    assert got.shape == (7,) and np.abs(got - y[-7:]).mean() < 0.8 * naive


def test_extrapolation_beyond_the_window():
    y = np.arange(60.0)
    for name in ("n_linear", "d_linear", "auto_arima", "prophet"):
        model = make(name, lags=5)
        state = model.fit_values(y, np.arange(60))
        assert np.allclose(model.predict_values(state, y[-5:], np.arange(60, 72)), 60 + np.arange(12), atol=1.5), name


def test_models_per_key_match_single_series(spark):
    df = keyed(spark, a=range(30), b=[i % 7 for i in range(30)], c=[1, 2])
    fitted = make("n_linear", lags=7).fit(df, KEYED)
    both = {(r["k"], r["horizon"]): r["y"] for r in fitted.predict(3).collect()}
    assert {k for k, _ in both} == {"a", "b"} and [r["k"] for r in fitted.short.collect()] == ["c"]
    alone = make("n_linear", lags=7).fit(df.where("k = 'b'").drop("k"), ONE).predict(3).collect()
    assert all(math.isclose(both["b", r["horizon"]], r["y"]) for r in alone)


def test_save_and_load(spark, tmp_path):
    fitted = make("d_linear", lags=5, kernel_size=3).fit(keyed(spark, a=range(30)), KEYED)
    fitted.save(str(tmp_path / "m"))
    again = load_forecaster(spark, str(tmp_path / "m"))
    assert again.model == fitted.model and again.predict(4).collect() == fitted.predict(4).collect()


def test_trees_fit_a_step():
    x = np.linspace(0, 1, 200)[:, None]
    y = (x[:, 0] > 0.5) * 4.0
    for kind in (trees.Boosting("level"), trees.Boosting("leaf"), trees.Boosting("oblivious"), trees.Boosting("leaf", linear=True), trees.Forest()):
        assert np.abs(kind.predict(kind.fit(x, y), x) - y).mean() < 0.3


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(3, 4)), r.normal(size=(4, 2))

    def value(a_, b_):
        x, y = Tensor(a_), Tensor(b_)
        z = (x @ y).tanh()
        w = concat([z.softmax(), z.normed().sigmoid()]) * 2.0
        return (((w[:, 1:] ** 2.0).mean() + (w.swap() @ w).abs().sum() / 3.0) ** 0.5, x, y)

    out, x, y = value(a, b)
    out.backward()
    for which, grad in ((a, x.grad), (b, y.grad)):
        for at in [(0, 0), (2, 1)]:
            moved = which.copy()
            moved[at] += 1e-6
            change = (value(moved, b)[0] if which is a else value(a, moved)[0]).data - out.data
            assert math.isclose(change / 1e-6, grad[at], rel_tol=1e-3, abs_tol=1e-5)


def test_net_schedules_and_losses():
    assert nets.schedule("CosineAnnealing", 5, 1.0) < 0.01 and nets.schedule("CosineAnnealingWarmRestarts", 5, 1.0) == 1.0
    y = np.sin(np.arange(60))
    for loss in nets.LOSSES:
        model = make("tide", lags=6, epochs=10, loss=loss)
        assert np.isfinite(model.predict_values(model.fit_values(y, np.arange(60)), y[-6:], np.arange(60, 63))).all()


def test_net_parts():
    v, g = np.random.default_rng(1).normal(size=(4, 3)), np.array([1.0, 2.0, 0.5])
    assert np.allclose(np.linalg.norm(nets.weight_normed(Tensor(v), Tensor(g)).data, axis=0), g)
    t = np.arange(120)
    y = 20 + 5 * np.sin(2 * np.pi * t / 7) + np.random.default_rng(0).normal(size=120)
    x, z = (np.lib.stride_tricks.sliding_window_view(y, 14)[:, part] for part in (slice(0, 7), slice(7, 14)))
    tft = make("tft", lags=7, epochs=60)
    found = tft.predict_quantiles(tft.fit_windows(x, z), x)
    assert (found[0.1] <= found[0.5]).mean() > 0.8 and (found[0.5] <= found[0.9]).mean() > 0.8
    assert 0.6 < ((found[0.1] <= z) & (z <= found[0.9])).mean() <= 1
    for name, more in (("itransformer", {}), ("tcn", {"weight_norm": True}), ("tide", {"noise": 0.05}), ("transformer", {})):
        net = make(name, lags=7, epochs=80, **more)
        assert np.abs(net.predict_windows(net.fit_windows(x, z), x) - z).mean() < 0.8 * np.abs(z - x[:, -1:]).mean(), name
    inverted = make("itransformer", lags=7)
    parts = [v.data for v in inverted.variates(Tensor(x))]
    assert np.allclose(parts[1][:, 1:], np.diff(x)) and np.allclose(parts[2][:, 1:-1], (x[:, :-2] + x[:, 1:-1] + x[:, 2:]) / 3) and np.allclose(parts[2] + parts[3], x)


def test_registry_and_configs():
    assert len(MODELS) == 22 and PRESETS["all"] == tuple(sorted(MODELS))
    assert model_names(["tcn", linear.DLinear, "tcn"]) == ["d_linear", "tcn"] and "tcn" not in model_names(None, ["tcn"])
    with pytest.raises(KeyError):
        model_names(["nothing"])
    configs = PipelineConfigs([("tcn", {}), ("tcn", {"init_configs": {"width": 4}}), ("tcn", "mine", {})])
    assert [a for a, _, _ in configs.entries] == ["tcn_1", "tcn_2", "mine"] and configs.get_configs("tcn_2")["init_configs"] == {"width": 4}
    with pytest.raises(KeyError):
        PipelineConfigs([("tcn", {"wrong": {}})])
    pipe = ModelPipeline(ONE, 5, include=["d_linear"], params={"strength": 1.0, "d_linear__kernel_size": 3})
    assert pipe.plan() == [("d_linear", "d_linear", {"lags": 5, "seed": 0, "strength": 1.0, "kernel_size": 3})]


def test_pipeline(spark):
    t = range(60)
    df = keyed(spark, a=[10 + i for i in t], b=[50 + 10 * math.sin(i * 2 * math.pi / 7) for i in t])
    pipe = ModelPipeline(KEYED, 7, include=["n_linear", "auto_arima"], quantile=0.9, cv=2)
    board = pipe.fit(df, valid_rows=7)
    assert board.count() == 4 and set(board.columns) >= {"k", "model", "mae", "quantile_acc", "train_cost", "eval_cost", "rank"}
    ahead = pipe.predict(3)
    assert ahead.count() == 6 and set(ahead.columns) >= {"y_lower", "y_upper"}
    assert pipe.get_model().model.name in ("n_linear", "auto_arima") and pipe.get_model_all_configs("n_linear")["lags"] == 7
    a = {r["horizon"]: r["y"] for r in pipe.predict(3, "n_linear").where("k = 'a'").collect()}
    assert all(abs(a[h] - (62 + h)) < 3 for h in a)
    train, valid = holdout(df, KEYED, 7)
    with pytest.raises(ValueError):
        ModelPipeline(KEYED, 7, include=["n_linear"]).fit(df, valid)
    with pytest.raises(ValueError):
        ModelPipeline(KEYED, 7, include=["n_linear"]).fit(train, valid.drop("y"))


@pytest.mark.parametrize("lags", [5, 40])
def test_pipeline_error_takes_all_held_out_rows(spark, lags):
    r = np.random.default_rng(0)
    values = {"a": r.normal(10, 1, 130).tolist(), "b": r.normal(20, 5, 400).tolist(), "c": r.normal(5, 1, 90).tolist()}
    df, pipe = keyed(spark, **values), ModelPipeline(KEYED, lags, quantile=0.9, cv=3)
    drawn, rest = resample.block_bootstrap(df, KEYED, lags, 3)
    ends, want = {}, {}
    for x in drawn.orderBy("pos").collect():
        ends.setdefault((x["k"], x["split"]), []).append(x["y"])
    for x in rest.collect():
        if len(ends[x["k"], x["split"]]) > lags:  # others are too short for the model
            want.setdefault((x["k"], x["split"]), []).append((abs(x["y"] - ends[x["k"], x["split"]][-1]), abs(x["y"])))
    assert max(map(len, want.values())) > max(lags, 30)
    wmape = {g: sum(e for e, _ in x) / sum(y for _, y in x) for g, x in want.items()}
    got = {x["k"]: x["error"] for x in pipe._error("naive", "naive", {"lags": lags}, df).collect()}
    assert set(got) == {k for k, _ in want}
    for k in got:
        assert np.isclose(got[k], np.quantile([w for (a, _), w in wmape.items() if a == k], 0.9))


def test_far_peaks_of_long_windows(spark):
    def greedy(x, distance=150):
        found, i = [], 1
        while i < len(x) - 1:
            j = i
            while j < len(x) - 1 and x[j] == x[i]:
                j += 1
            if x[i - 1] < x[i] and x[j] < x[i]:
                found.append((x[i], (i + j - 1) // 2))
            i = j
        kept = []
        for _, at in sorted(found, reverse=True):
            kept += [at] if all(abs(at - k) >= distance for k in kept) else []
        return len(kept)

    r = np.random.default_rng(0)
    rows = [r.normal(size=n).tolist() for n in (7, 150, 151, 400, 900)] + [r.integers(0, 4, n).astype(float).tolist() for n in (7, 160, 500)] + [[1.0] * 400, [3.0, 1.0, 3.0, 2.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x array<double>").repartition(4)
    got = {x["i"]: x["n"] for x in df.select("i", arrays.window_statistics(F.col("x"))["far_peaks"].alias("n")).collect()}
    assert [got[i] for i in range(len(rows))] == [greedy(x) for x in rows] and max(got.values()) > 2


def test_catalogue(spark, tmp_path):
    (tmp_path / "mine.csv").write_text("day,v\n2024-01-01,1\n2024-01-02,2\n")
    found = SeriesCatalogue(spark, str(tmp_path))
    found.register(Dataset("mine", "day string, v int", SeriesSpec((), "day", "v"), "yyyy-MM-dd"))
    assert found["mine.csv"].count() == 2 and found.spec("mine").target == "v" and len(found) == 11 and "mine" in str(found)
    with pytest.raises(KeyError):
        found["missing"]


def test_streams(spark, tmp_path):
    events = [(dt.datetime(2024, 1, d, h), "a" if h % 2 else "b") for d in range(1, 6) for h in range(0, 24, 3)]
    spark.createDataFrame(events, "ts timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = ingest.daily_counts(ingest.read_events(spark, str(tmp_path / "in"), "ts timestamp, k string"), ["k"])
    q = stream.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["k"], r["ds"].day): r["y"] for r in spark.table("daily").collect()}
    assert got and all(v == 4.0 for v in got.values()) and max(d for _, d in got) < 5  # the last day waits for the watermark
    spark.table("daily").write.parquet(str(tmp_path / "daily"))
    kept = ingest.last_values(ingest.read_events(spark, str(tmp_path / "daily"), "k string, ds timestamp, y double", "ds"), "k", 2)
    q = kept.writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["k"]: r["x"] for r in spark.table("kept").collect()} == {"a": [4.0, 4.0], "b": [4.0, 4.0]}
    fitted = make("n_linear", lags=2).fit(keyed(spark, a=range(20), b=range(20)), KEYED)
    q = ingest.score_batches(stream, fitted, 2, str(tmp_path / "out"), str(tmp_path / "c3"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 4


def test_pipeline_save_and_load(spark, tmp_path):
    df = keyed(spark, a=range(40), b=[i % 7 for i in range(40)])
    pipe = ModelPipeline(KEYED, 7, include=["n_linear"], quantile=0.9, cv=2)
    pipe.fit(df, valid_rows=7)
    pipe.save(str(tmp_path / "p"))
    again = ModelPipeline.load(spark, str(tmp_path / "p"))
    key = lambda r: (r["k"], r["horizon"])
    assert sorted(again.predict(3).collect(), key=key) == sorted(pipe.predict(3).collect(), key=key)


def test_chain(spark):
    df = keyed(spark, a=range(30))
    chain = Chain(KEYED, [("scale", scaling.Scaler(KEYED)), ("model", make("n_linear", lags=5))])
    with pytest.raises(NotFittedError):
        chain.predict(1)
    got = [r["y"] for r in chain.fit(df).predict(3).orderBy("horizon").collect()]
    assert np.allclose(got, [30, 31, 32], atol=0.5) and chain["model"].name == "n_linear"
    assert np.allclose([r["y"] for r in chain.predict(3, df).orderBy("horizon").collect()], got)
    with pytest.raises(TypeError):
        Chain(KEYED, [("scale", scaling.Scaler(KEYED))])


def test_plots(spark):
    df = series(spark, [1.0, 5.0, 2.0])
    assert plots.plot_single_series(df, "ds", "y").startswith("<svg")
    ahead = intervals.apply_interval(series(spark, [3.0, 4.0], "2024-01-04"), ONE, 0.2)
    assert "polygon" in plots.plot_data_period(df, ahead, "ds", "y")
    assert plots.plot2d([[1, 2], [3, 4]], [[5, 6], [7, 9]], row=1).count("<polyline") == 2
    with pytest.raises(ValueError):
        plots.plot1d([])


def test_sql_functions(spark):
    sql.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM future_days(DATE '2024-02-28', 2)").collect()] == [(1, dt.date(2024, 2, 29)), (2, dt.date(2024, 3, 1))]
    assert spark.sql("SELECT * FROM lag_windows(array(1D, 2D, 3D, 4D), 2, 2)").count() == 2


def test_task_resources(spark):
    from tidewarp.functions.resources import task_resources

    found = task_resources(spark)
    assert found["task_cpus"] == 1 and found["executor_cores"] == found["tasks_at_once"] == spark.sparkContext.defaultParallelism and found["accelerators"] == {}
