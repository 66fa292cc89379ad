"""Queries of forecasters, the pipeline, streams and sources. Trained models have no SQL; plain ones are in series_queries."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models.registry import MODELS, OTHERS, make
from ..operators import grid
from ..plans import search
from ..plans.configs import PipelineConfigs
from ..plans.pipeline import ModelPipeline
from ..series import SeriesSpec
from ..sources import series_format
from ..sources.catalogue import Dataset, SeriesCatalogue, daily_events, daily_revenue, hourly_events, read_csv
from ..streaming import ingest
from .series_queries import HOUR_GAPS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
EVENTS = SeriesSpec(("event_type",))


def _text_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: _text_dates(f(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _model(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = daily_events(spark, sf_dir)
        return _text_dates(make(name, lags=7, rounds=20, epochs=40).fit(df, EVENTS).predict(10).withColumn("y", F.round("y", 4)))

    run.__name__ = f"model_{name}"
    return run


for _name in (*MODELS, *OTHERS):
    if _name != "naive":
        QUERIES[f"model_{_name}"] = _model(_name)


@query("WITH eve AS (SELECT event_type, ts::DATE AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2), l AS (SELECT event_type, max(ds) AS b, arg_max(y, ds) AS y FROM eve GROUP BY 1) SELECT event_type, h::INT AS horizon, (b + h::INT)::DATE::VARCHAR AS ds, y FROM l, range(1, 11) t(h)")
def model_naive(spark, sf_dir):
    return make("naive", lags=7).fit(daily_events(spark, sf_dir), EVENTS).predict(10)


@query(f"""WITH {HOUR_GAPS}, l AS (SELECT event_type, max(ds) AS b, arg_max(y, ds) AS y FROM hou GROUP BY 1)
SELECT event_type, h::INT AS horizon, strftime(b + to_seconds(h * gap_seconds), '%Y-%m-%d %H:%M:%S') AS ds, y FROM l JOIN gap USING (event_type), range(1, 31) t(h)""")
def model_naive_hourly(spark, sf_dir):
    ahead = make("naive", lags=24).fit(hourly_events(spark, sf_dir), EVENTS).predict(30)
    return ahead.withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH m AS (SELECT o_orderstatus AS status, last_day(o_orderdate::DATE) AS ds, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2), l AS (SELECT status, max(ds) AS b, arg_max(y, ds) AS y FROM m GROUP BY 1)
SELECT status, h::INT AS horizon, last_day(date_trunc('month', b) + to_months(h::INT))::VARCHAR AS ds, y FROM l, range(1, 15) t(h)""")
def model_naive_monthly(spark, sf_dir):
    """Monthly counts at month ends; forecasts fall on month ends."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = orders.groupBy(F.col("o_orderstatus").alias("status"), F.last_day("o_orderdate").alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return make("naive", lags=12).fit(df, SeriesSpec(("status",))).predict(14)


def _scored(board: DataFrame) -> DataFrame:
    """A leaderboard without its measured times, which differ from run to run."""
    drop = [c for c in ("train_cost", "eval_cost") if c in board.columns]
    return board.drop(*drop).withColumns({c: F.round(c, 6) for c, kind in board.drop(*drop).dtypes if kind == "double"})


@query()
def pipeline_leaderboard(spark, sf_dir):
    pipe = ModelPipeline(EVENTS, 5, include=["d_linear", "n_linear", "lightgbm", "prophet"], quantile=0.9, cv=3, params={"rounds": 10, "lightgbm__rounds": 15})
    return _scored(pipe.fit(daily_events(spark, sf_dir), valid_rows=5))


@query()
def pipeline_forecast(spark, sf_dir):
    configs = PipelineConfigs([("n_linear", {"init_configs": {"strength": 0.1}}), ("n_linear", "n_linear_stiff", {"init_configs": {"strength": 10.0}})])
    pipe = ModelPipeline(EVENTS, 7, configs=configs, scaler="standard", metric="rmse")
    pipe.fit(daily_events(spark, sf_dir), valid_rows=7)
    return pipe.predict(7).withColumn("y", F.round("y", 6))


@query()
def pipeline_predict_series(spark, sf_dir):
    df = daily_events(spark, sf_dir)
    pipe = ModelPipeline(EVENTS, 5, include=["d_linear"])
    pipe.fit(df.where("ds < '2024-01-24'"), valid_rows=5)
    return pipe.predict(5, "d_linear", df=df).withColumn("y", F.round("y", 6))


@query()
def pipeline_search(spark, sf_dir):
    """A small parameter search: one alias per setting, ranked like any models."""
    configs = PipelineConfigs([("d_linear", f"kernel_{k}", {"init_configs": {"kernel_size": k}}) for k in (3, 5, 9)])
    pipe = ModelPipeline(EVENTS, 7, configs=configs)
    return _scored(pipe.fit(daily_events(spark, sf_dir), valid_rows=7))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(max(o_totalprice), 4) AS largest FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_totalprice > 1000 GROUP BY 1""")
def source_pushed_filters(spark, sf_dir):
    """Large orders of late years by month, read by the catalogue's own data source, which takes the filters."""
    series_format.register(spark, {d.name: d for d in GIVEN})
    orders = spark.read.format(series_format.FORMAT).option("dataset", "orders").load(sf_dir)
    late = orders.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_totalprice") > 1000))
    return late.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 4).alias("largest"))


@query()
def search_halving(spark, sf_dir):
    """Eight candidates of two kinds for each series, in three rungs of doubling stretches."""
    configs = PipelineConfigs([*[("d_linear", f"kernel_{k}", {"init_configs": {"kernel_size": k}}) for k in (3, 5, 7, 9)], ("n_linear", "n_linear", {}), ("naive", "naive", {}), *[("d_linear", f"lags_{k}", {"init_configs": {"lags": k}}) for k in (3, 5)]])
    found = search.halving(daily_revenue(spark, sf_dir, ("o_orderstatus",)), SeriesSpec(("o_orderstatus",)), configs, 7, valid_rows=14)
    return found.withColumn("score", F.round("score", 6))


@query("SELECT event_type, ts::DATE::TIMESTAMP::VARCHAR AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2")
def stream_daily_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ingest.daily_counts(events, ["event_type"]).withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions_batch(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ingest.sessions(events, ["user_id"], gap="6 hours").select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS ds FROM orders")
def source_csv(spark, sf_dir):
    """Orders written as CSV and read with a declared schema. The folder is the session's shared one; local mode has one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewarp-csv-")
    import uuid

    path = f"{base}/tidewarp-csv-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ds")).write.csv(path, header=True)
    df = read_csv(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, ds string", "ds", "yyyy-MM-dd")
    return df.select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"), F.date_format("ds", "yyyy-MM-dd").alias("ds"))


#: The given tables as datasets of a catalogue.
GIVEN = [
    Dataset("orders", "o_orderkey long, o_orderdate timestamp, o_totalprice double", SeriesSpec((), "o_orderdate", "o_totalprice"), format="parquet"),
    Dataset("lineitem", "l_orderkey long, l_shipdate timestamp, l_quantity double, l_discount double", SeriesSpec((), "l_shipdate", "l_quantity", ("l_discount",)), format="parquet"),
    Dataset("events", "event_id long, ts timestamp, value double", SeriesSpec((), "ts", "value"), format="parquet"),
]


@query(" UNION ALL ".join(
    f"SELECT {i}::INT AS position, '{d.name}' AS name, '{d.spec.time}' AS time_col, '{d.spec.target}' AS target_col, '{','.join(d.spec.features)}' AS feature_cols, count(*) AS n, count(DISTINCT {d.spec.time}::DATE) AS days, "
    f"min({d.spec.time})::DATE::VARCHAR AS first, max({d.spec.time})::DATE::VARCHAR AS last, round(max({d.spec.target}), 4) AS largest FROM {d.name}" for i, d in enumerate(GIVEN)))
def source_catalogue(spark, sf_dir):
    """The given tables by a catalogue: its rows, and of each dataset what its table holds, read by name."""
    catalogue = SeriesCatalogue(spark, sf_dir, {})
    for d in GIVEN:
        catalogue.register(d)
    found = None
    for name in catalogue.names:
        spec, day = catalogue.spec(name), F.to_date(catalogue.spec(name).time)
        one = catalogue[name].agg(F.count(F.lit(1)).alias("n"), F.count_distinct(day).alias("days"), F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last"), F.round(F.max(spec.target), 4).alias("largest"))
        one = one.withColumn("name", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return catalogue.table().join(found, "name")


@query()
def wide_repaired_forecast(spark, sf_dir):
    """Repair, then forecast: regular grid, linear interpolation, outliers, a decomposition model per status."""
    spec = SeriesSpec(("status",))
    df = daily_revenue(spark, sf_dir, ("o_orderstatus",)).withColumnRenamed("o_orderstatus", "status")
    clean = grid.repair_outliers(grid.interpolate(grid.regularise(df, spec), spec), spec).drop("outlier")
    return make("d_linear", lags=28).fit(clean, spec).predict(28).withColumn("y", F.round("y", 6))


@query()
def model_global_trees(spark, sf_dir):
    """One boosted model over all series, by the ML library."""
    from ..models.global_trees import GlobalForecaster

    df = daily_events(spark, sf_dir)
    return GlobalForecaster("gbt", 7, 2, {"maxIter": 3, "maxDepth": 3, "seed": 1}).fit(df, EVENTS).predict(df, EVENTS).withColumn("y", F.round("y", 6))


@query()
def chain_forecast(spark, sf_dir):
    from ..operators.scaling import Scaler
    from ..plans.chain import Chain

    chain = Chain(EVENTS, [("scale", Scaler(EVENTS, "standard")), ("model", make("n_linear", lags=7))])
    return chain.fit(daily_events(spark, sf_dir)).predict(5).withColumn("y", F.round("y", 6))


@query("""WITH eve AS (SELECT event_type, ts::DATE AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ds) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM eve)
SELECT a.event_type, (a.k - 1)::INT AS start, p::INT AS pos, b.y AS v FROM n a JOIN range(0, 5) t(p) ON true JOIN n b ON b.event_type = a.event_type AND b.k = a.k + p WHERE (a.k - 1) % 3 = 0 AND a.k + 4 <= a.n""")
def sql_lag_windows(spark, sf_dir):
    from ..functions.sql import register

    register(spark)
    daily_events(spark, sf_dir).createOrReplaceTempView("tidewarp_daily_events")
    return spark.sql(
        """SELECT event_type, w.start, pos, v FROM (SELECT event_type, transform(array_sort(collect_list(struct(ds, y))), s -> s.y) AS ys FROM tidewarp_daily_events GROUP BY event_type),
        LATERAL lag_windows(ys, 5, 3) w LATERAL VIEW posexplode(w.x) p AS pos, v"""
    )


@query("""WITH eve AS (SELECT event_type, ts::DATE AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2), w AS (SELECT event_type, ds, row_number() OVER o - 1 AS start, list(y) OVER (o ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x,
list(y) OVER (o ROWS BETWEEN 5 FOLLOWING AND 6 FOLLOWING) AS z FROM eve WINDOW o AS (PARTITION BY event_type ORDER BY ds))
SELECT event_type, ds::VARCHAR AS ds, start, unnest(range(7))::INT AS pos, unnest(list_concat(x, z)) AS v FROM w WHERE len(z) = 2 AND start % 3 = 0""")
def sql_table_windows(spark, sf_dir):
    from ..functions.sql import register

    register(spark)
    daily_events(spark, sf_dir).createOrReplaceTempView("tidewarp_daily_events")
    return spark.sql(
        """SELECT event_type, cast(ds AS string) AS ds, start, pos, v
        FROM table_windows(TABLE(tidewarp_daily_events) PARTITION BY event_type ORDER BY (ds), 'y', 5, 2, 3) w LATERAL VIEW posexplode(concat(w.x, w.y)) p AS pos, v"""
    )


@query("""WITH d AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, max(o_orderdate)::DATE AS ds FROM orders GROUP BY 1, 2)
SELECT status, priority, h::INT AS horizon, (ds + (7 * h)::INT)::DATE::VARCHAR AS ds FROM d, range(1, 4) t(h)""")
def sql_table_future(spark, sf_dir):
    """Weekly times after the last one of each series of two keys."""
    from ..functions.sql import register

    register(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("ds")).createOrReplaceTempView("tidewarp_orders")
    return spark.sql(
        """SELECT status, priority, horizon, cast(ds AS string) AS ds
        FROM table_future(TABLE(tidewarp_orders) PARTITION BY (status, priority) ORDER BY (ds), array('status', 'priority'), 'ds', 3, 7)"""
    )


@query("""WITH eve AS (SELECT event_type, ts::DATE AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2), h AS (SELECT event_type, ds, CASE WHEN day(ds) % 4 <> 0 THEN y END AS y FROM eve)
SELECT event_type, ds::VARCHAR AS ds, last_value(y IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ds ROWS UNBOUNDED PRECEDING) AS y FROM h""")
def sql_table_filled(spark, sf_dir):
    from ..functions.sql import register

    register(spark)
    daily_events(spark, sf_dir).withColumn("y", F.when(F.day("ds") % 4 != 0, F.col("y"))).createOrReplaceTempView("tidewarp_holes")
    return spark.sql("SELECT event_type, cast(ds AS string) AS ds, y FROM table_filled(TABLE(tidewarp_holes) PARTITION BY event_type ORDER BY (ds), 'y')")
