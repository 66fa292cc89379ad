"""Series finer and coarser than a day, features beside the target, and options of the pipeline."""

import calendar as cal
import datetime as dt
import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewarp.functions import arrays
from tidewarp.functions.calendar import calendar_features
from tidewarp.models.registry import MODELS, OTHERS, make
from tidewarp.models.trees import statistics
from tidewarp.operators import grid, scaling
from tidewarp.plans.configs import PipelineConfigs
from tidewarp.plans.pipeline import ModelPipeline
from tidewarp.series import SeriesSpec, Step
from tidewarp.sources import generators
from tidewarp.sources.catalogue import Dataset, SeriesCatalogue

KEYED = SeriesSpec(("k",))


def hourly(spark, values, k="a"):
    first = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, first + dt.timedelta(hours=i), float(v)) for i, v in enumerate(values)], "k string, ds timestamp_ntz, y double").repartition(4)


def monthly(spark, values, day=31):
    at = lambda i: dt.date(2019 + i // 12, i % 12 + 1, min(day, cal.monthrange(2019 + i // 12, i % 12 + 1)[1]))
    return spark.createDataFrame([("m", at(i), float(v)) for i, v in enumerate(values)], "k string, ds date, y double").repartition(3)


def test_steps():
    assert Step.of("15min") == Step(0, 900) and Step.of(2) == Step.of("2D") == Step(0, 172800) and Step.of("MS") == Step(1, 0, 1) and Step.of("2ME") == Step(2, 0, 31)
    for bad in ("", "0D", "5", "fortnight"):
        with pytest.raises(ValueError):
            Step.of(bad)
    wall = np.array([dt.datetime(2023, m, 28 if m == 2 else 30, 6).timestamp() for m in range(1, 13)], np.int64)
    assert Step.modal(wall) == Step(1, 0, 30)
    ahead = Step(1, 0, 31).ahead(int(dt.datetime(2024, 1, 31, tzinfo=dt.UTC).timestamp()), 3)
    assert [str(np.datetime64(int(x), "s").astype("datetime64[D]")) for x in ahead] == ["2024-02-29", "2024-03-31", "2024-04-30"]
    assert Step.modal(np.array([0, 3600, 7200, 14400])) == Step(0, 3600) and Step.modal(np.array([5])) == Step()


@pytest.mark.parametrize("name", [n for n in sorted([*MODELS, *OTHERS]) if n in ("naive", "n_linear", "d_linear", "auto_arima", "prophet", "xgboost", "wide_gbrt")])
def test_hourly_forecasts_go_on_hourly(spark, name):
    got = make(name, lags=24, rounds=5).fit(hourly(spark, range(240)), KEYED).predict(30).orderBy("horizon").collect()
    assert [x["ds"] for x in got] == [dt.datetime(2024, 1, 11) + dt.timedelta(hours=h) for h in range(30)]
    assert abs(got[0]["y"] - 239.5) < 6 and (name != "naive" or {x["y"] for x in got} == {239.0})


def test_monthly_forecasts_keep_month_ends(spark):
    got = make("naive", lags=6).fit(monthly(spark, range(26)), KEYED).predict(4).orderBy("horizon").collect()
    assert [str(x["ds"]) for x in got] == ["2021-03-31", "2021-04-30", "2021-05-31", "2021-06-30"] and got[0]["y"] == 25
    got = make("naive", lags=6).fit(monthly(spark, range(26), 15), KEYED).predict(2).orderBy("horizon").collect()
    assert [str(x["ds"]) for x in got] == ["2021-03-15", "2021-04-15"]


def test_the_additive_model_has_history_and_frequency(spark):
    df = hourly(spark, [10 + 3 * math.sin(i * math.pi / 12) for i in range(96)])
    fitted = make("prophet", lags=6).fit(df, KEYED)
    ahead = fitted.predict(3, freq="D", include_history=True).orderBy("ds").collect()
    assert len(ahead) == 99 and [x["horizon"] for x in ahead] == list(range(-95, 4)) and str(ahead[-1]["ds"]) == "2024-01-07 23:00:00"
    assert np.mean([abs(x["y"] - y["y"]) for x, y in zip(ahead[:96], df.orderBy("ds").collect(), strict=True)]) < 0.3
    with pytest.raises(TypeError):
        fitted.predict(3, nothing=1)


def test_grids_of_any_frequency(spark):
    df = hourly(spark, range(6)).where("y <> 2").withColumn("k", F.lit("a")).unionByName(hourly(spark, range(10, 16), "b"))
    assert {(x["k"], x["gap_seconds"]) for x in grid.modal_gap(df, KEYED, "seconds").collect()} == {("a", 3600), ("b", 3600)}
    static = spark.createDataFrame([("a", "north"), ("b", "south")], "k string, region string")
    full = grid.regularise(df, KEYED, freq="h", static=static, hierarchy={"all": ["a", "b"]})
    got = {(x["k"], x["ds"].hour): (x["y"], x["region"]) for x in full.collect()}
    assert len(got) == 18 and got["a", 2] == (None, "north") and got["all", 2] == (None, None) and got["all", 3] == (16.0, None) and got["b", 2] == (12.0, "south")
    months = grid.regularise(monthly(spark, range(12)).where("y <> 1"), KEYED, fill=0.0, freq="ME").orderBy("ds").collect()
    assert [str(x["ds"]) for x in months[:3]] == ["2019-01-31", "2019-02-28", "2019-03-31"] and len(months) == 12 and months[1]["y"] == 0
    assert [str(x["ds"]) for x in grid.future_index(monthly(spark, range(2)), KEYED, 2, freq="ME").orderBy("horizon").collect()] == ["2019-03-31", "2019-04-30"]


def test_wide_inputs_are_the_feature_queries(spark):
    """The statistics that the wide model computes are those of the column expressions, its calendar that of the feature set."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(5, 2, (20, 9)), r.integers(0, 3, (20, 9))]).astype(float)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, x array<double>")
    stats = arrays.window_statistics(F.col("x"))
    more = {"auto": arrays.correlate_same(F.col("x"), F.col("x")), "cross": arrays.correlate_same(F.col("x"), arrays.diff(F.col("x")))}
    rows = df.select("i", *[c.cast("double").alias(k) for k, c in stats.items()], *[c.alias(k) for k, c in more.items()]).orderBy("i").collect()
    want = np.array([[np.nan if v is None else v for k in stats for v in [row[k]]] + row["auto"] + row["cross"] for row in rows])
    assert np.allclose(statistics(x), want, equal_nan=True)

    spec = SeriesSpec(("k",), features=("temp",))
    series = hourly(spark, r.normal(size=60)).withColumn("temp", F.hour("ds") * 1.5)
    model = make("wide_gbrt", lags=6, rounds=3)
    states = model.fit(series, spec).states.first()
    first = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    last = series.orderBy(F.desc("ds")).limit(1).select(*[c.cast("double").alias(k) for k, c in calendar_features(F.col("ds"), first).items()], "temp").first()
    assert list(states["inputs"]) == list(last) and len(last) == 83


def test_features_reach_the_model(spark):
    """A target that its lags don't tell, but the feature of the row before does."""
    r = np.random.default_rng(5)
    signal = r.normal(size=300)
    y = np.append(0, signal[:-1]) * 10
    base = spark.createDataFrame([("a", dt.date(2023, 1, 1) + dt.timedelta(days=i), float(v), float(s)) for i, (v, s) in enumerate(zip(y, signal, strict=True))], "k string, ds date, y double, s double")
    errors = {}
    for features in ((), ("s",)):
        spec = SeriesSpec(("k",), features=features)
        fitted = make("wide_gbrt", lags=3, rounds=40).fit(base.where("ds < '2023-09-01'"), spec)
        off = []
        for day in range(5, 25):
            end = dt.date(2023, 9, day)
            ahead = fitted.predict_from(base.where(F.col("ds") < F.lit(end)), 1).first()
            off.append(abs(ahead["y"] - y[(end - dt.date(2023, 1, 1)).days]))
        errors[features] = np.mean(off)
    assert errors["s",] < 0.5 * errors[()]


def test_score_is_the_mean_r2_of_windows(spark):
    y = np.random.default_rng(1).normal(size=60).cumsum()
    fitted = make("n_linear", lags=5).fit(hourly(spark, y), KEYED)
    got = fitted.score(hourly(spark, y)).first()["r2"]
    x, z = (np.lib.stride_tricks.sliding_window_view(y, 10)[:, s] for s in (slice(0, 5), slice(5, 10)))
    # The model in closed form: a ridge map of the window without its last value's level.
    d, t = x - x[:, -1:], z - x[:, -1:]
    a = np.column_stack([d, np.ones(len(d))])
    penalty = 1e-3 * len(d) * np.diag([1.0] * 5 + [0.0])
    w = np.linalg.pinv(a.T @ a + penalty) @ a.T @ t
    p = a @ w + x[:, -1:]
    assert np.isclose(got, np.mean(1 - ((z - p) ** 2).sum(1) / ((z - z.mean(1, keepdims=True)) ** 2).sum(1)))
    ahead = [r["y"] for r in fitted.predict(5).orderBy("horizon").collect()]
    assert np.allclose(ahead, np.append(y[-5:] - y[-1], 1) @ w + y[-1])
    assert fitted.score(hourly(spark, y[:7])).first()["r2"] is None
    with pytest.raises(TypeError):
        make("prophet", lags=5).fit(hourly(spark, y), KEYED).score(hourly(spark, y))


def test_options_of_each_step_are_used(spark):
    df = hourly(spark, [10 + (i % 24) + 0.01 * i for i in range(200)])
    configs = PipelineConfigs([
        ("d_linear", "plain", {}),
        ("d_linear", "stiff", {"fit_configs": {"strength": 1e9}}),
        ("prophet", "hours", {}),
        ("prophet", "days", {"predict_configs": {"freq": "D"}}),
    ])
    pipe = ModelPipeline(KEYED, 24, configs=configs, scaler=None)
    board = {x["model"]: x["mae"] for x in pipe.fit(df, valid_rows=24).collect()}
    assert set(board) >= {"plain", "stiff", "hours"} and board["stiff"] > 2 * board["plain"]
    assert pipe.get_model_all_configs("stiff")["strength"] == 1e9
    gaps = {a: np.diff([x["ds"].timestamp() for x in pipe.predict(3, a).orderBy("horizon").collect()]) for a in ("hours", "days")}
    assert set(gaps["hours"]) == {3600} and set(gaps["days"]) == {86400}
    for step in ("fit_configs", "predict_configs"):
        with pytest.raises(KeyError):
            PipelineConfigs([("d_linear", {step: {"no_such_option": 1}})])
    pipe.unpersist()
    assert pipe.predict(2).count() == 2


def test_a_grid_of_parameters(spark):
    configs = PipelineConfigs.grid("d_linear", {"kernel_size": [3, 5], "strength": [0.1, 1e9]})
    assert [a for a, _, _ in configs.entries][0] == "d_linear--kernel_size-3--strength-0.1" and len(configs.entries) == 4
    with pytest.raises(KeyError):
        PipelineConfigs.grid("d_linear", {"wrong": [1]})
    pipe = ModelPipeline(KEYED, 6, configs=configs, scaler=None)
    pipe.fit(hourly(spark, [i % 6 for i in range(80)]), valid_rows=6)
    assert "strength-0.1" in pipe.best().first()["model"] and pipe.get_model().model.strength == 0.1


def test_saved_pipelines_keep_predict_options(spark, tmp_path):
    configs = PipelineConfigs([("prophet", "days", {"predict_configs": {"freq": "2D"}})])
    pipe = ModelPipeline(KEYED, 6, configs=configs)
    pipe.fit(hourly(spark, range(80)), valid_rows=6)
    pipe.save(str(tmp_path / "p"))
    again = ModelPipeline.load(spark, str(tmp_path / "p")).predict(2, "days").orderBy("horizon").collect()
    assert (again[1]["ds"] - again[0]["ds"]).days == 2


def test_resamples_keep_their_times(spark):
    """An hourly season is learnt from drawn blocks only if their rows keep their times, so its interval is narrow."""
    df = hourly(spark, [50 + 20 * math.sin(i * math.pi / 12) for i in range(400)])
    pipe = ModelPipeline(KEYED, 10, quantile=0.9, cv=2)
    error = pipe._error("prophet", "prophet", {"lags": 10}, df).first()["error"]
    assert error < 0.1


def test_quantile_scaler_against_numpy(spark):
    r = np.random.default_rng(2)
    y = np.append(r.normal(size=300), [0.5] * 40)
    df = hourly(spark, y)
    scaler = scaling.Scaler(KEYED, "quantile").fit(df)
    knots, at = np.quantile(y, np.linspace(0, 1, 1001)), np.linspace(0, 1, 1001)
    want = (np.interp(y, knots, at) - np.interp(-y, -knots[::-1], -at[::-1])) / 2
    want = np.where(y <= knots[0], 0, np.where(y >= knots[-1], 1, want))
    got = [x["y"] for x in scaler.transform(df).orderBy("ds").collect()]
    assert np.allclose(got, want, atol=1e-6)


def test_walks_are_the_sums_of_their_blocks(spark):
    one, many = ([x["y"] for x in generators.random_walk(spark, 500, seed=3, block=b).orderBy("i").collect()] for b in (1000, 37))
    noise = [x["y"] for x in generators.white_noise(spark, 500, seed=3).orderBy("i").collect()]
    assert np.allclose(one, np.cumsum([0.0, *noise[1:]])) and np.allclose(one, many)


def test_parquet_datasets(spark, tmp_path):
    hourly(spark, range(5)).write.parquet(str(tmp_path / "mine.parquet"))
    catalogue = SeriesCatalogue(spark, str(tmp_path))
    catalogue.register(Dataset("mine", "k string, ds timestamp_ntz, y double", KEYED, format="parquet"))
    assert catalogue["mine"].count() == 5


def test_short_spectra_are_sums_in_order(spark):
    """To the last bit, for any size of the values; a fast transform has others."""
    rows = [[float(v) for v in x] for x in np.random.default_rng(8).uniform(1e4, 9e4, (300, 8)).round(7)] + [[1e200] * 8, [1e-200] * 8, [0.0] * 8]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x array<double>")
    got = [x["s"] for x in df.select("i", arrays.spectrum(F.col("x")).alias("s")).orderBy("i").collect()]
    want = []
    for x in rows[:300]:
        both = [[functools.reduce(lambda a, b: a + b, (v * f(2 * math.pi * k * i / 8) for i, v in enumerate(x))) for f in (math.cos, math.sin)] for k in range(8)]
        want.append([math.sqrt(a * a + b * b) for a, b in both])
    assert got[:300] == want and math.isclose(got[300][0], 8e200) and math.isclose(got[301][0], 8e-200) and got[302] == [0.0] * 8
    long = np.random.default_rng(9).normal(size=100)
    assert np.allclose(spark.createDataFrame([(long.tolist(),)], "x array<double>").select(arrays.spectrum(F.col("x"))).first()[0], np.abs(np.fft.fft(long)))
