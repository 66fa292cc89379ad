"""Queries of the series operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, metrics
from ..functions.calendar import calendar_features
from ..operators import checks, covariates, grid, hierarchy, intervals, least_squares, resample, scaling, strategies, windows
from ..operators.slices import Slices
from ..series import SeriesSpec
from ..sources import generators
from ..sources.catalogue import daily_events, daily_revenue, hourly_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ONE = SeriesSpec()
STATUS = SeriesSpec(("status",))
EVENTS = SeriesSpec(("event_type",))

#: Common tables of the SQL side.
REV = "rev AS (SELECT o_orderdate::DATE AS ds, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e7::DOUBLE AS y FROM orders GROUP BY 1)"
BY_STATUS = "sta AS (SELECT o_orderstatus AS status, o_orderdate::DATE AS ds, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e7::DOUBLE AS y FROM orders GROUP BY 1, 2)"
EVE = "eve AS (SELECT event_type, ts::DATE AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2)"
NUM = "num AS (SELECT *, (row_number() OVER (ORDER BY ds) - 1)::INT AS rn, count(*) OVER () AS n FROM rev)"


def win(w: int, p: int = 0) -> str:
    """win: start, x (list of w), y (list of p) over num."""
    y = f", list(y) OVER (ORDER BY ds ROWS BETWEEN {w} FOLLOWING AND {w + p - 1} FOLLOWING) AS y" if p else ""
    return f"win AS (SELECT rn AS start, x{', y' if p else ''} FROM (SELECT rn, n, list(y) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS x{y} FROM num) WHERE rn + {w + p} <= n)"


def query(sql: str | None = None, dates: str = ""):
    """Register a query with its SQL. ``dates`` names its date columns."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "date"})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            swap = ", ".join(f"{c}::VARCHAR AS {c}" for c in dates.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({swap}) FROM ({sql}) q" if swap else sql
        return run

    return add


def rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_revenue(spark, sf_dir)


def by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_revenue(spark, sf_dir, ("o_orderstatus",)).withColumnRenamed("o_orderstatus", "status")


def r(c: Column | str, n: int = 8) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def long(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """A row per array element: columns, part, pos, v (rounded)."""
    parts = None
    for name in names:
        one = df.select(*columns, F.lit(name).alias("part"), F.posexplode(name).alias("pos", "v")).withColumn("v", r(F.col("v").cast("double")))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def sql_long(table: str, columns: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{n}' AS part, (unnest(range(len({n}))))::INT AS pos, round(unnest({n})::DOUBLE, 8) AS v FROM {table}" for n in names)


# --- grid -----------------------------------------------------------------------------------------------


@query(f"WITH {REV} SELECT g.ds::DATE AS ds, coalesce(y, 0.0::DOUBLE) AS y FROM generate_series((SELECT min(ds) FROM rev), (SELECT max(ds) FROM rev), INTERVAL 1 DAY) g(ds) LEFT JOIN rev ON rev.ds = g.ds::DATE", dates="ds")
def series_regularise(spark, sf_dir):
    return grid.regularise(rev(spark, sf_dir), ONE, fill=0.0)


@query(f"WITH {BY_STATUS}, g AS (SELECT status, date_diff('day', lag(ds) OVER (PARTITION BY status ORDER BY ds), ds)::INT AS gap_days FROM sta) SELECT status, gap_days, count(*) AS n FROM g WHERE gap_days IS NOT NULL GROUP BY 1, 2")
def series_gap_histogram(spark, sf_dir):
    return grid.sampling_gaps(by_status(spark, sf_dir), STATUS)


@query(f"""WITH {BY_STATUS}, g AS (SELECT status, date_diff('day', lag(ds) OVER (PARTITION BY status ORDER BY ds), ds)::INT AS gap_days FROM sta),
c AS (SELECT status, gap_days, count(*) AS n FROM g WHERE gap_days IS NOT NULL GROUP BY 1, 2)
SELECT status, gap_days FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, gap_days) AS k FROM c) WHERE k = 1""")
def series_modal_gap(spark, sf_dir):
    return grid.modal_gap(by_status(spark, sf_dir), STATUS)


HOURLY = "hou AS (SELECT event_type, date_trunc('hour', ts) AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2)"
HOUR_GAPS = f"""{HOURLY}, g AS (SELECT event_type, date_diff('second', lag(ds) OVER (PARTITION BY event_type ORDER BY ds), ds) AS gap_seconds FROM hou),
c AS (SELECT event_type, gap_seconds, count(*) AS n FROM g WHERE gap_seconds IS NOT NULL GROUP BY 1, 2),
gap AS (SELECT event_type, gap_seconds FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, gap_seconds) AS k FROM c) WHERE k = 1)"""


@query(f"WITH {HOUR_GAPS} SELECT * FROM gap")
def series_modal_gap_hourly(spark, sf_dir):
    return grid.modal_gap(hourly_events(spark, sf_dir), EVENTS, "seconds")


@query(f"WITH {HOURLY}, e AS (SELECT event_type, min(ds) AS a, max(ds) AS b FROM hou GROUP BY 1), s AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ds FROM e) SELECT event_type, strftime(s.ds, '%Y-%m-%d %H:%M:%S') AS ds, coalesce(y, 0) AS y FROM s LEFT JOIN hou USING (event_type, ds)")
def series_regularise_hourly(spark, sf_dir):
    return grid.regularise(hourly_events(spark, sf_dir), EVENTS, fill=0.0, freq="h").withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {EVE}, e AS (SELECT event_type, min(ds) AS a, max(ds) AS b FROM eve GROUP BY 1), d AS (SELECT event_type, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS ds FROM e),
f AS (SELECT event_type, ds, coalesce(y, 0) AS y FROM d LEFT JOIN eve USING (event_type, ds)), t AS (SELECT 'shown' AS event_type, ds, CASE WHEN count(*) = 2 THEN sum(y) END AS y FROM f WHERE event_type IN ('view', 'click') GROUP BY ds)
SELECT u.*, CASE u.event_type WHEN 'view' THEN 'page' WHEN 'click' THEN 'page' END AS place FROM (SELECT * FROM f UNION ALL SELECT * FROM t) u""", dates="ds")
def series_totals(spark, sf_dir):
    """A grid with the total of two series and what is known of each series."""
    static = spark.createDataFrame([("view", "page"), ("click", "page")], "event_type string, place string")
    return grid.regularise(daily_events(spark, sf_dir), EVENTS, fill=0.0, static=static, hierarchy={"shown": ["view", "click"]}).select("event_type", "ds", "y", "place")


@query(f"WITH {BY_STATUS}, g AS (SELECT status, lag(ds) OVER w AS after, date_diff('day', lag(ds) OVER w, ds)::INT AS gap_days FROM sta WINDOW w AS (PARTITION BY status ORDER BY ds)) SELECT status, after, gap_days FROM g WHERE gap_days > 1", dates="after")
def series_gap_report(spark, sf_dir):
    return grid.gap_report(by_status(spark, sf_dir), STATUS)


@query(f"""WITH {REV}, h AS (SELECT ds, CASE WHEN day(ds) % 4 = 0 THEN NULL ELSE y END AS y, row_number() OVER (ORDER BY ds) AS n FROM rev),
k AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN n END) OVER (ORDER BY ds ROWS UNBOUNDED PRECEDING) AS n0,
             min(CASE WHEN y IS NOT NULL THEN n END) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n1 FROM h)
SELECT k.ds, round(CASE WHEN k.y IS NOT NULL THEN k.y WHEN b.y IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (k.n - k.n0) / (k.n1 - k.n0) END, 8) AS y
FROM k LEFT JOIN h a ON a.n = k.n0 LEFT JOIN h b ON b.n = k.n1""", dates="ds")
def series_interpolate(spark, sf_dir):
    holes = rev(spark, sf_dir).withColumn("y", F.when(F.day("ds") % 4 != 0, F.col("y")))
    return grid.interpolate(holes, ONE).select("ds", r("y").alias("y"))


@query(f"""WITH {REV}, h AS (SELECT ds, CASE WHEN day(ds) % 4 = 0 THEN NULL ELSE y END AS y FROM rev)
SELECT ds, last_value(y IGNORE NULLS) OVER (ORDER BY ds ROWS UNBOUNDED PRECEDING) AS y FROM h""", dates="ds")
def series_forward_fill(spark, sf_dir):
    return grid.forward_fill(rev(spark, sf_dir).withColumn("y", F.when(F.day("ds") % 4 != 0, F.col("y"))), ONE)


@query(f"""WITH {REV}, m AS (SELECT ds, y, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s FROM rev WINDOW w AS (ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))
SELECT ds, round(CASE WHEN abs(y - m) > 2 * s THEN m ELSE y END, 8) AS y, abs(y - m) > 2 * s AS outlier FROM m""", dates="ds")
def series_outlier_repair(spark, sf_dir):
    return grid.repair_outliers(rev(spark, sf_dir), ONE, 7, 2.0).select("ds", r("y").alias("y"), "outlier")


@query(f"WITH {BY_STATUS} SELECT status, h::INT AS horizon, (max(ds) + h::INT)::DATE AS ds FROM sta, range(1, 15) t(h) GROUP BY status, h", dates="ds")
def series_future_index(spark, sf_dir):
    return grid.future_index(by_status(spark, sf_dir), STATUS, 14)


# --- windows --------------------------------------------------------------------------------------------


@query(f"WITH {REV}, {NUM}, {win(7, 3)} {sql_long('win', 'start', ['x', 'y'])}")
def windows_supervised(spark, sf_dir):
    return long(windows.supervised_windows(rev(spark, sf_dir), ONE, 7, 3), ["start"], ["x", "y"])


@query(f"WITH {BY_STATUS}, c AS (SELECT status, count(*) AS n FROM sta GROUP BY 1) SELECT status, greatest(0, (n - 14 - 7) // 5 + 1)::BIGINT AS windows FROM c")
def windows_count(spark, sf_dir):
    found = windows.supervised_windows(by_status(spark, sf_dir), STATUS, 14, 7, 5)
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("windows"))


@query(f"WITH {REV}, {NUM}, {win(7)}, lw AS (SELECT i::INT AS row, start, x FROM win JOIN range(0, 100000) t(i) ON start = (i - i % 3) * 2 AND i < (SELECT count(*) FROM rev)) {sql_long('lw', 'row, start', ['x'])}")
def windows_lag(spark, sf_dir):
    return long(windows.lag_windows(rev(spark, sf_dir), ONE, 7, step=2, horizon=3), ["row", "start"], ["x"])


@query(f"WITH {BY_STATUS}, n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ds) AS rn, count(*) OVER (PARTITION BY status) AS n FROM sta) SELECT status, ds, y, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM n", dates="ds")
def windows_ordered_split(spark, sf_dir):
    return windows.ordered_split(by_status(spark, sf_dir), STATUS, 0.8)


@query(f"WITH {BY_STATUS} SELECT status, ds, y, round(y - lag(y) OVER (PARTITION BY status ORDER BY ds), 8) AS diff FROM sta", dates="ds")
def windows_difference(spark, sf_dir):
    return windows.difference(by_status(spark, sf_dir), STATUS).withColumn("diff", r("diff"))


@query(f"WITH {EVE}, m AS (SELECT event_type, ds, y, avg(y) OVER (PARTITION BY event_type ORDER BY ds ROWS 2 PRECEDING) AS m, row_number() OVER (PARTITION BY event_type ORDER BY ds) AS k FROM eve) SELECT event_type, ds, y, round(m, 8) AS moving_average FROM m WHERE k >= 3", dates="ds")
def windows_moving_average(spark, sf_dir):
    return windows.moving_average(daily_events(spark, sf_dir), EVENTS, 3).withColumn("moving_average", r("moving_average"))


_D1 = "list_transform(range(1, len({x})), lambda i: {x}[i + 1] - {x}[i])"
_MA = "list_transform(range(1, len(x) - 1), lambda i: (x[i] + x[i + 1] + x[i + 2]) / 3)"


@query(f"""WITH {REV}, {NUM}, {win(7)}, d AS (SELECT start, x, {_D1.format(x='x')} AS d1, {_MA} AS ma FROM win),
e AS (SELECT start, d1, {_D1.format(x='d1')} AS d2, ma, list_concat([ma[1]], ma) AS layer, list_transform(range(0, 4), lambda i: x[2 * i + 1]) AS evens, list_transform(range(0, 3), lambda i: x[2 * i + 2]) AS odds,
[x[1], x[2], x[5], x[6], x[7]] AS removed FROM d)
{sql_long('e', 'start', ['d1', 'd2', 'ma', 'layer', 'evens', 'odds', 'removed'])}""")
def windows_array_layers(spark, sf_dir):
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 7)
    x = F.col("x")
    w = w.withColumns({"d1": arrays.diff(x), "d2": arrays.diff(x, 2), "ma": arrays.moving_average(x, 3), "layer": arrays.moving_average_padded(x, 3), "evens": arrays.evens(x), "odds": arrays.odds(x), "removed": arrays.remove_at(x, 2, 3)})
    return long(w, ["start"], ["d1", "d2", "ma", "layer", "evens", "odds", "removed"])


@query(f"""WITH {BY_STATUS}, k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ds) AS a, row_number() OVER (PARTITION BY status ORDER BY ds DESC) AS b FROM sta)
SELECT status, ds, y, 'head' AS part FROM k WHERE a <= 5 UNION ALL SELECT status, ds, y, 'tail' FROM k WHERE b <= 5""", dates="ds")
def windows_tail_head(spark, sf_dir):
    df = by_status(spark, sf_dir)
    return windows.head(df, STATUS, 5).withColumn("part", F.lit("head")).unionByName(windows.tail(df, STATUS, 5).withColumn("part", F.lit("tail")))


@query(f"WITH {REV}, {NUM} SELECT rn - 6 AS start, weekday, month FROM (SELECT rn, (isodow(ds) - 1)::INT AS weekday, month(ds)::INT AS month FROM num) WHERE rn >= 6")
def windows_last_features(spark, sf_dir):
    df = rev(spark, sf_dir).withColumns({"weekday": F.weekday("ds"), "month": F.month("ds")})
    return windows.last_features(df, ONE, 7, ["weekday", "month"])


def _dft(f: str) -> str:
    return f"list_sum(list_transform(range(0, 8), lambda i: x[i + 1] * {f}(2 * pi() * k * i / 8)))"


@query(f"""WITH {REV}, {NUM}, {win(8)}, s AS (SELECT start, k, sqrt(pow({_dft('cos')}, 2) + pow({_dft('sin')}, 2)) AS amplitude FROM win, range(0, 8) t(k)),
t AS (SELECT start, round(amplitude, 5) AS amplitude, (row_number() OVER (PARTITION BY start ORDER BY amplitude DESC) - 1)::INT AS pos FROM s) SELECT start, pos, amplitude FROM t WHERE pos < 3""")
def windows_spectrum_top(spark, sf_dir):
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 8)
    top = arrays.largest(arrays.spectrum(F.col("x")), 3)
    return w.select("start", F.posexplode(top).alias("pos", "amplitude")).withColumn("amplitude", r("amplitude", 5))


@query(f"""WITH {REV}, {NUM}, {win(8)}, s AS (SELECT start, k, sqrt(pow({_dft('cos')}, 2) + pow({_dft('sin')}, 2)) AS amplitude FROM win, range(0, 8) t(k))
SELECT start, round(CASE WHEN k < 4 THEN k ELSE k - 8 END / 8.0::DOUBLE, 8) AS frequency, round(amplitude, 8) AS amplitude FROM s""")
def windows_spectrum_frequencies(spark, sf_dir):
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 8)
    both = w.select("start", F.explode(F.arrays_zip(arrays.frequencies(F.col("x")).alias("f"), arrays.spectrum(F.col("x")).alias("a"))).alias("s"))
    return both.select("start", r("s.f").alias("frequency"), r("s.a", 8).alias("amplitude"))


# --- checks ---------------------------------------------------------------------------------------------


@query(f"WITH {BY_STATUS} SELECT status, count(*) AS n, 1201 AS needed, count(*) >= 1201 AS ok FROM sta GROUP BY status")
def checks_length(spark, sf_dir):
    return checks.length_check(by_status(spark, sf_dir), STATUS, 1200)


@query(f"""WITH {BY_STATUS} SELECT status, max(ds) FILTER (WHERE ds < DATE '2001-01-01') AS train_end, min(ds) FILTER (WHERE ds >= DATE '2001-01-01') AS valid_start, true AS ok FROM sta GROUP BY status
HAVING max(ds) FILTER (WHERE ds < DATE '2001-01-01') IS NOT NULL AND min(ds) FILTER (WHERE ds >= DATE '2001-01-01') IS NOT NULL""", dates="train_end valid_start")
def checks_train_before_valid(spark, sf_dir):
    df = by_status(spark, sf_dir)
    return checks.train_before_valid(df.where("ds < '2001-01-01'"), df.where("ds >= '2001-01-01'"), STATUS)


@query(f"""WITH {EVE}, t AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ds DESC) AS b FROM eve WHERE ds < DATE '2024-01-25')
SELECT event_type, ds, y FROM eve WHERE ds >= DATE '2024-01-25' UNION ALL SELECT event_type, ds, y FROM t WHERE b <= 10 - (SELECT count(DISTINCT ds) FROM eve WHERE ds >= DATE '2024-01-25')""", dates="ds")
def checks_pad_validation(spark, sf_dir):
    df = daily_events(spark, sf_dir)
    return checks.pad_validation(df.where("ds < '2024-01-25'"), df.where("ds >= '2024-01-25'"), EVENTS, 5)


@query("SELECT event_type, user_id, min(ts::DATE) AS first FROM events GROUP BY 1, 2", dates="first")
def checks_ordered_distinct(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ds", F.to_date("ts"))
    return checks.ordered_distinct(events, EVENTS, "user_id")


@query("SELECT o_custkey, date_diff('day', min(o_orderdate), max(o_orderdate))::INT AS days, epoch(max(o_orderdate) - min(o_orderdate))::BIGINT AS seconds FROM orders GROUP BY 1")
def checks_time_difference(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = F.max("o_orderdate"), F.min("o_orderdate")
    return o.groupBy("o_custkey").agg(F.date_diff(a, b).alias("days"), F.timestamp_diff("SECOND", b, a).alias("seconds"))


# --- calendar -------------------------------------------------------------------------------------------

_CAL = {
    "hour": "0", "minute": "0", "weekday": "isodow(ds) - 1", "week": "week(ds)", "month": "month(ds)", "quarter": "quarter(ds)", "day_of_month": "day(ds)", "day_of_year": "dayofyear(ds)",
    "day_of_quarter": "doq", "week_of_month": "(day(ds) - 1) // 7 + 1", "season": "(month(ds) % 12) // 3",
    "is_weekend": "(isodow(ds) < 6)::INT", "is_start_of_week": "(isodow(ds) = 1)::INT", "is_end_of_week": "(isodow(ds) = 5)::INT", "is_start_of_month": "(day(ds) = 1)::INT", "is_middle_of_month": "(day(ds) = 15)::INT",
    "is_end_of_month": "(ds = last_day(ds))::INT", "is_quarter_start": "(doq = 1)::INT", "is_year_start": "(dayofyear(ds) = 1)::INT", "is_year_end": "(month(ds) = 12 AND day(ds) = 31)::INT",
    "day_to_mid_quarter": "doq - 15", "day_to_start_quarter": "doq - 1", "day_to_end_quarter": "doq - 90", "day_to_monday": "abs(isodow(ds) - 2)", "day_to_friday": "abs(isodow(ds) - 6)", "day_to_middle_week": "abs(isodow(ds) - 4)",
    "day_to_start_timestamp": "el", "hour_to_start_timestamp": "el * 24", "minute_to_start_timestamp": "el * 1440", "sec_to_start_timestamp": "el * 86400",
    "month_to_start_timestamp": "el / 30.0::DOUBLE", "week_to_start_timestamp": "el / 7.0::DOUBLE", "quarter_to_start_timestamp": "el / 90.0::DOUBLE", "year_to_start_timestamp": "el / 365.0::DOUBLE",
}
for _ahead, _off in (("", 0), ("next_year_", 1), ("last_year_", -1)):
    for _unit, _len in (("day", 1), ("week", 7), ("month", 30), ("quarter", 90)):
        for _season, _month in (("spring", 3), ("summer", 6), ("autumn", 9), ("winter", 12)):
            _days = f"date_diff('day', make_date(year(ds) + {_off}, {_month}, 1), ds)"
            _CAL[f"{_unit}_to_{_ahead}{_season}"] = _days if _len == 1 else f"{_days} / {_len}.0::DOUBLE"
_WHOLE = {k for k, v in _CAL.items() if "DOUBLE" not in v}
_CAL_ROWS = f"c AS (SELECT ds, date_diff('day', date_trunc('quarter', ds), ds) + 1 AS doq, date_diff('day', (SELECT min(ds) FROM rev), ds) AS el FROM rev)"


@query(f"WITH {REV}, {_CAL_ROWS} SELECT ds, " + ", ".join(f"{'(' + v + ')::BIGINT' if k in _WHOLE else 'round(' + v + ', 8)'} AS {k}" for k, v in _CAL.items()) + " FROM c", dates="ds")
def calendar_all(spark, sf_dir):
    df = rev(spark, sf_dir)
    feats = calendar_features(F.col("ds"), F.col("start"), prefix="")
    start = F.min("ds").over(ONE.whole())
    return df.withColumn("start", start).select("ds", *[(v.cast("long") if k in _WHOLE else r(v)).alias(k) for k, v in feats.items()])


@query(f"WITH {REV}, {_CAL_ROWS}, f AS (SELECT ds, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _CAL.items()) + " FROM c) SELECT ds, "
       + ", ".join(f"round(CASE WHEN max({k}) OVER () = min({k}) OVER () THEN 0 ELSE ({k} - min({k}) OVER ()) / (max({k}) OVER () - min({k}) OVER ()) END, 8) AS {k}" for k in _CAL) + " FROM f", dates="ds")
def calendar_scaled(spark, sf_dir):
    """Each feature min-max scaled over the frame; the bounds are one aggregate row."""
    df = rev(spark, sf_dir)
    start = F.min("ds").over(ONE.whole())
    feats = df.withColumn("start", start).select("ds", *[v.cast("double").alias(k) for k, v in calendar_features(F.col("ds"), F.col("start"), prefix="").items()])
    bounds = feats.agg(*[F.min(k).alias(f"{k}__a") for k in _CAL], *[F.max(k).alias(f"{k}__b") for k in _CAL])
    both = feats.crossJoin(F.broadcast(bounds))  # one row of bounds
    return both.select("ds", *[r(F.when(F.col(f"{k}__b") == F.col(f"{k}__a"), 0.0).otherwise((F.col(k) - F.col(f"{k}__a")) / (F.col(f"{k}__b") - F.col(f"{k}__a")))).alias(k) for k in _CAL])


# --- window statistics ----------------------------------------------------------------------------------

_Q = "list_aggregate({x}, 'quantile_cont', {q}::DOUBLE)"
_STATS = {
    "mean": "list_avg(x)", "median": _Q.format(x="x", q=0.5), "max": "list_max(x)", "min": "list_min(x)", "p25": _Q.format(x="x", q=0.25), "p75": _Q.format(x="x", q=0.75),
    "std": "list_stddev_pop(x)", "entropy": "list_sum(list_transform(x, lambda v: CASE WHEN v > 0 THEN -(v / s) * log2(v / s) ELSE 0 END))",
    "mean_diff": "list_avg(d)", "mean_abs_diff": "list_avg(list_transform(d, lambda v: abs(v)))", "median_diff": _Q.format(x="d", q=0.5), "median_abs_diff": _Q.format(x="list_transform(d, lambda v: abs(v))", q=0.5),
    "under_p75": "len(list_filter(x, lambda v: v < p75))", "under_p25": "len(list_filter(x, lambda v: v < p25))", "under_p90": "len(list_filter(x, lambda v: v < p90))", "over_p90": "len(list_filter(x, lambda v: v > p90))",
    "peaks": "len(list_filter(range(2, len(x)), lambda i: x[i + 1] < x[i] AND x[i - 1] < x[i]))",
    "far_peaks": "least(1, len(list_filter(range(2, len(x)), lambda i: x[i + 1] < x[i] AND x[i - 1] < x[i])))",
}
_COUNTS = {"under_p75", "under_p25", "under_p90", "over_p90", "peaks", "far_peaks"}
_W7 = f"{REV}, {NUM}, {win(7)}, b AS (SELECT start, x, list_sum(x) AS s, {_D1.format(x='x')} AS d, {_Q.format(x='x', q=0.25)} AS p25, {_Q.format(x='x', q=0.75)} AS p75, {_Q.format(x='x', q=0.9)} AS p90 FROM win)"


@query(f"WITH {_W7} SELECT start, " + ", ".join(f"({v})::BIGINT AS {k}" if k in _COUNTS else f"round({v}, 8) AS {k}" for k, v in _STATS.items()) + " FROM b")
def window_statistics(spark, sf_dir):
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 7)
    return w.select("start", *[(v.cast("long") if k in _COUNTS else r(v)).alias(k) for k, v in arrays.window_statistics(F.col("x")).items()])


@query(f"""WITH {REV}, {NUM}, {win(400)}, p AS (SELECT start, list_sort(list_transform(list_filter(range(2, len(x)), lambda i: x[i + 1] < x[i] AND x[i - 1] < x[i]), lambda i: {{'v': x[i], 'i': i}}), 'DESC') AS p FROM win)
SELECT start, len(p)::BIGINT AS peaks, len(list_reduce(p, lambda kept, q: CASE WHEN len(list_filter(kept, lambda k: abs(k.i - q.i) < 150)) > 0 THEN kept ELSE list_append(kept, q) END, [p[1]]))::BIGINT AS far_peaks FROM p WHERE len(p) > 0""")
def window_far_peaks(spark, sf_dir):
    """Peaks of long windows, of which those at least 150 apart are kept greedily."""
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 400)
    return w.select("start", arrays.peaks(F.col("x")).cast("long").alias("peaks"), arrays.far_peaks(F.col("x")).cast("long").alias("far_peaks"))


@query(f"WITH {_W7}, f AS (SELECT start, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _STATS.items()) + " FROM b) SELECT start, "
       + ", ".join(f"round(CASE WHEN max({k}) OVER () = min({k}) OVER () THEN 0 ELSE ({k} - min({k}) OVER ()) / (max({k}) OVER () - min({k}) OVER ()) END, 5) AS {k}" for k in _STATS) + " FROM f")
def window_statistics_scaled(spark, sf_dir):
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 7)
    stats = arrays.window_statistics(F.col("x"))
    rows = w.select("start", F.array(*[v.cast("double") for v in stats.values()]).alias("s"))
    scaled = scaling.scale_windows(rows, "s")
    return scaled.select("start", *[r(F.get("s", F.lit(i)), 5).alias(k) for i, k in enumerate(stats)])


_AC = "list_transform(range(0, 7), lambda k: list_sum(list_transform(range(1, 8), lambda i: CASE WHEN i + k - 3 BETWEEN 1 AND 7 THEN x[i + k - 3] * x[i] ELSE 0 END)))"
_XC = "list_transform(range(0, 7), lambda k: list_sum(list_transform(range(1, 7), lambda i: CASE WHEN i + k - 3 BETWEEN 1 AND 7 THEN x[i + k - 3] * d[i] ELSE 0 END)))"


@query(f"WITH {_W7}, f AS (SELECT start, {_AC} AS autocorrelation, {_XC} AS diff_correlation FROM b) {sql_long('f', 'start', ['autocorrelation', 'diff_correlation'])}")
def window_correlations(spark, sf_dir):
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 7).withColumns({"autocorrelation": arrays.correlate_same(F.col("x"), F.col("x")), "diff_correlation": arrays.correlate_same(F.col("x"), arrays.diff(F.col("x")))})
    return long(w, ["start"], ["autocorrelation", "diff_correlation"])


@query(f"WITH {REV}, {NUM}, {win(7, 2)}, b AS (SELECT start, y, {_D1.format(x='x')} AS d, list_avg(x) AS m FROM win), f AS (SELECT start, list_transform(range(1, 6), lambda i: (d[i] + d[i + 1]) / 2) AS lags, y, [m] AS stat_mean FROM b) {sql_long('f', 'start', ['lags', 'y', 'stat_mean'])}")
def window_wide_features(spark, sf_dir):
    w = windows.wide_features(rev(spark, sf_dir), ONE, 7, 2).withColumn("stat_mean", F.array("stat_mean"))
    return long(w, ["start"], ["lags", "y", "stat_mean"])


@query(f"WITH {REV}, {NUM}, {win(7, 2)}, b AS (SELECT start, x, list_sum(x) AS s, {_D1.format(x='x')} AS d, {_Q.format(x='x', q=0.25)} AS p25, {_Q.format(x='x', q=0.75)} AS p75, {_Q.format(x='x', q=0.9)} AS p90 FROM win) SELECT start, "
       + ", ".join(f"({v})::BIGINT AS stat_{k}" if k in _COUNTS else f"round({v}, 8) AS stat_{k}" for k, v in _STATS.items()) + " FROM b")
def window_wide_statistics(spark, sf_dir):
    """All statistics that wide features have beside their lags."""
    w = windows.wide_features(rev(spark, sf_dir), ONE, 7, 2)
    return w.select("start", *[(F.col(f"stat_{k}").cast("long") if k in _COUNTS else r(f"stat_{k}")).alias(f"stat_{k}") for k in _STATS])


# --- scaling --------------------------------------------------------------------------------------------


@query(f"WITH {EVE} SELECT event_type, ds, round((y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0), 8) AS y FROM eve WINDOW w AS (PARTITION BY event_type)", dates="ds")
def scale_min_max(spark, sf_dir):
    df = daily_events(spark, sf_dir)
    return scaling.Scaler(EVENTS, "min_max").fit(df).transform(df).withColumn("y", r("y"))


@query(f"WITH {BY_STATUS} SELECT status, ds, round((y - avg(y) OVER w) / stddev_pop(y) OVER w, 8) AS y FROM sta WINDOW w AS (PARTITION BY status)", dates="ds")
def scale_standard(spark, sf_dir):
    df = by_status(spark, sf_dir)
    return scaling.Scaler(STATUS, "standard").fit(df).transform(df).withColumn("y", r("y"))


@query(f"WITH {BY_STATUS} SELECT status, ds, round(y, 7) AS y FROM sta", dates="ds")
def scale_round_trip(spark, sf_dir):
    df = by_status(spark, sf_dir)
    out = None
    for name in ("min_max", "standard"):
        s = scaling.Scaler(STATUS, name).fit(df)
        df = s.inverse(s.transform(df))
        out = df
    return out.withColumn("y", r("y", 7))


_AT = "(SELECT list_transform(range(0, 1001), lambda j: CASE WHEN (j * (n - 1)) % 1000 = 0 THEN s[j * (n - 1) // 1000 + 1] ELSE s[j * (n - 1) // 1000 + 1] + (s[j * (n - 1) // 1000 + 2] - s[j * (n - 1) // 1000 + 1]) * (((j * (n - 1)) % 1000) / 1000.0::DOUBLE) END))"


@query(f"""WITH {BY_STATUS}, o AS (SELECT status, list(y ORDER BY y) AS s, count(*) AS n FROM sta GROUP BY 1), k AS (SELECT status, {_AT} AS k FROM o),
p AS (SELECT status, ds, y, k, len(list_filter(k, lambda v: v < y)) AS below, len(list_filter(k, lambda v: v <= y)) AS upto FROM sta JOIN k USING (status))
SELECT status, ds, round(CASE WHEN y <= k[1] THEN 0 WHEN y >= k[1001] THEN 1 WHEN upto > below THEN (below + upto - 1) / 2.0::DOUBLE / 1000 ELSE (upto - 1 + (y - k[upto]) / (k[upto + 1] - k[upto])) / 1000 END, 8) AS y FROM p""", dates="ds")
def scale_quantile(spark, sf_dir):
    df = by_status(spark, sf_dir)
    return scaling.Scaler(STATUS, "quantile").fit(df).transform(df).withColumn("y", r("y"))


@query(f"""WITH {EVE}, v AS (SELECT DISTINCT event_type, y FROM eve), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY y) - 1 AS rank, count(*) OVER (PARTITION BY event_type) - 1 AS m FROM v)
SELECT e.event_type, e.ds, e.y, round(CASE WHEN k.m = 0 THEN 0 ELSE greatest(-0.9999::DOUBLE, least(0.9999::DOUBLE, k.rank / (k.m / 2.0::DOUBLE * 0.9999::DOUBLE) - 0.9999::DOUBLE)) END, 9) AS score
FROM eve e JOIN k USING (event_type, y)""", dates="ds")
def scale_gauss_ranks(spark, sf_dir):
    df = daily_events(spark, sf_dir)
    return scaling.GaussRankScaler(EVENTS).fit(df).ranks(df).withColumn("score", r("score", 9))


@query(f"WITH {EVE} SELECT event_type, ds, y FROM eve", dates="ds")
def scale_gauss_round_trip(spark, sf_dir):
    df = daily_events(spark, sf_dir)
    s = scaling.GaussRankScaler(EVENTS).fit(df)
    return s.inverse(s.transform(df)).withColumn("y", r("y", 4))


@query(f"""WITH {REV}, {NUM}, {win(5)}, l AS (SELECT start, unnest(range(0, 5))::INT AS pos, unnest(x) AS v FROM win)
SELECT start, 'x' AS part, pos, round((v - min(v) OVER (PARTITION BY pos)) / (max(v) OVER (PARTITION BY pos) - min(v) OVER (PARTITION BY pos)), 8) AS v FROM l""")
def scale_window_positions(spark, sf_dir):
    w = windows.lag_windows(rev(spark, sf_dir), ONE, 5).select("start", "x")
    return long(scaling.scale_windows(w, "x"), ["start"], ["x"])


# --- metrics and ranking --------------------------------------------------------------------------------

_P = f"{BY_STATUS}, p AS (SELECT status, ds, y, lag(y) OVER (PARTITION BY status ORDER BY ds) AS p FROM sta), q AS (SELECT * FROM p WHERE p IS NOT NULL)"
_MSQL = {
    "mae": "avg(abs(y - p))", "mse": "avg(pow(y - p, 2))", "rmse": "sqrt(avg(pow(y - p, 2)))", "wmape": "sum(abs(y - p)) / sum(abs(y))", "mape": "avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16::DOUBLE))",
    "max_error": "max(abs(y - p))", "r2": "1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y))",
}


def _lagged(spark, sf_dir):
    df = by_status(spark, sf_dir)
    return df.withColumn("p", F.lag("y").over(STATUS.ordered())).where("p IS NOT NULL")


@query(f"WITH {_P} SELECT status, " + ", ".join(f"round({v}, 8) AS {k}" for k, v in _MSQL.items()) + ", round(avg((y BETWEEN p * 0.5::DOUBLE AND p * 1.5::DOUBLE)::INT), 8) AS quantile_acc FROM q GROUP BY status")
def metrics_points(spark, sf_dir):
    df = _lagged(spark, sf_dir)
    cover = metrics.coverage("y", F.col("p") * 0.5, F.col("p") * 1.5)
    return df.groupBy("status").agg(*[r(f("y", "p")).alias(k) for k, f in metrics.METRICS.items()], r(cover).alias("quantile_acc"))


@query(f"""WITH {REV}, {NUM}, {win(7, 7)}, e AS (SELECT 1 - list_sum(list_transform(range(1, 8), lambda i: pow(y[i] - x[i], 2))) / list_sum(list_transform(y, lambda v: pow(v - list_avg(y), 2))) AS r2 FROM win)
SELECT round(avg(r2), 5) AS r2 FROM e""")
def metrics_r2_windows(spark, sf_dir):
    w = windows.supervised_windows(rev(spark, sf_dir), ONE, 7, 7)
    return metrics.r2_of_windows(w, "y", "x").select(r("r2", 5).alias("r2"))


_MODELS = f"""{BY_STATUS}, f AS (SELECT status, ds, y, lag(y) OVER w AS naive, lag(y, 7) OVER w AS seasonal, avg(y) OVER (PARTITION BY status ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS average,
row_number() OVER w AS k FROM sta WINDOW w AS (PARTITION BY status ORDER BY ds)),
s AS (SELECT status, avg(abs(y - naive)) AS naive, avg(abs(y - seasonal)) AS seasonal, avg(abs(y - average)) AS average FROM f WHERE k > 7 GROUP BY status),
l AS (SELECT status, unnest(['naive', 'seasonal', 'average']) AS model, unnest([naive, seasonal, average]) AS mae FROM s)"""


def _scores(spark, sf_dir):
    df = by_status(spark, sf_dir)
    over = STATUS.ordered()
    f = df.withColumns({"naive": F.lag("y").over(over), "seasonal": F.lag("y", 7).over(over), "average": F.avg("y").over(over.rowsBetween(-7, -1)), "k": F.row_number().over(over)}).where("k > 7")
    f = f.unpivot(["status", "ds", "y"], ["naive", "seasonal", "average"], "model", "p")
    return f.groupBy("status", "model").agg(metrics.mae("y", "p").alias("mae"))


@query(f"WITH {_MODELS} SELECT status, model, round(mae, 8) AS mae FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY mae, model) AS k FROM l) WHERE k = 1")
def leaderboard_best_per_series(spark, sf_dir):
    from ..plans.leaderboard import best

    return best(_scores(spark, sf_dir), ["status"], "mae").select("status", "model", r("mae").alias("mae"))


@query(f"WITH {_MODELS} SELECT model, " + ", ".join(f"round(max(mae) FILTER (WHERE status = '{s}'), 8) AS {s}" for s in "FOP") + " FROM l GROUP BY model")
def leaderboard_pivot(spark, sf_dir):
    wide = metrics.leaderboard_pivot(_scores(spark, sf_dir), "model", "status", "mae", ["F", "O", "P"])
    return wide.select("model", *[r(c).alias(c) for c in ("F", "O", "P")])


# --- resampling and intervals ---------------------------------------------------------------------------

_LCG = "pmod_once AS (SELECT status, split, draw, blocks, ((split * 1000003 + draw * 7919 + 17) * 1103515245 + 12345) % 2147483648 AS o FROM g), dr AS (SELECT status, split, draw, (((o * 1103515245 + 12345) % 2147483648) // 1024) % blocks AS block FROM pmod_once)"
_BOOT = f"""{BY_STATUS}, nb AS (SELECT *, (row_number() OVER (PARTITION BY status ORDER BY ds) - 1) AS rn FROM sta), bl AS (SELECT *, rn // 30 AS block FROM nb),
bc AS (SELECT status, max(block) + 1 AS blocks FROM bl GROUP BY 1), g AS (SELECT status, blocks, s::BIGINT AS split, d::BIGINT AS draw FROM bc, range(0, 5) a(s), range(0, 200) b(d) WHERE d < blocks), {_LCG}"""


@query(f"""WITH {_BOOT}, tr AS (SELECT dr.split, bl.status, count(*) AS train_rows, sum(round(y * 1e7)::BIGINT)::BIGINT AS train_sum FROM bl JOIN dr USING (status, block) GROUP BY 1, 2),
te AS (SELECT s::BIGINT AS split, status, count(*) AS test_rows FROM bl, range(0, 5) a(s) WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.status = bl.status AND dr.split = s AND dr.block = bl.block) GROUP BY 1, 2)
SELECT split, status, train_rows, train_sum, coalesce(test_rows, 0) AS test_rows FROM tr LEFT JOIN te USING (split, status)""")
def resample_block_bootstrap(spark, sf_dir):
    drawn = resample.block_multiplicities(by_status(spark, sf_dir), STATUS, 30, 5)
    cents = F.round(F.col("y") * 1e7).cast("long")
    sums = [F.struct(F.lit(s).cast("long").alias("split"), F.sum(times).alias("train_rows"), F.sum(times * cents).alias("train_sum"), F.sum((times == 0).cast("long")).alias("test_rows")) for s, times in enumerate(resample.times(5))]
    return drawn.groupBy("status").agg(F.array(*sums).alias("all")).select("status", F.explode("all").alias("s")).select("s.split", "status", "s.train_rows", "s.train_sum", "s.test_rows")


@query(f"""WITH {_BOOT}, m AS (SELECT dr.split, bl.status, avg(y) AS p FROM bl JOIN dr USING (status, block) GROUP BY 1, 2),
te AS (SELECT s::BIGINT AS split, status, y FROM bl, range(0, 5) a(s) WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.status = bl.status AND dr.split = s AND dr.block = bl.block)),
w AS (SELECT status, split, sum(abs(y - p)) / sum(abs(y)) AS w FROM te JOIN m USING (split, status) GROUP BY 1, 2) SELECT status, round(quantile_cont(w, 0.9::DOUBLE), 8) AS error FROM w GROUP BY status""")
def interval_errors(spark, sf_dir):
    return resample.mean_errors(by_status(spark, sf_dir), STATUS, 30, 5, 0.9).withColumn("error", r("error"))


@query(f"WITH {BY_STATUS} SELECT status, ds, y, round(y * 0.75::DOUBLE, 9) AS y_lower, round(y * 1.25::DOUBLE, 9) AS y_upper FROM sta", dates="ds")
def interval_apply(spark, sf_dir):
    out = intervals.apply_interval(by_status(spark, sf_dir), STATUS, 0.25)
    return intervals.chosen_columns(out.withColumn("extra", F.lit(1)), STATUS).withColumns({"y_lower": r("y_lower", 9), "y_upper": r("y_upper", 9)})


@query(f"""WITH {REV}, {NUM}, f AS (SELECT f::INT AS fold, rn, n, ds, y FROM num, range(0, 3) t(f))
SELECT fold, CASE WHEN rn < n - fold * 14 - 14 THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(ds) AS first, max(ds) AS last FROM f WHERE rn < n - fold * 14 AND n - fold * 14 - 14 >= 30 GROUP BY 1, 2""", dates="first last")
def resample_rolling_origin(spark, sf_dir):
    folds = resample.rolling_origin(rev(spark, sf_dir), ONE, 30, 14, 3)
    return folds.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("ds").alias("first"), F.max("ds").alias("last"))


@query(f"WITH {BY_STATUS} SELECT status, ds, y, round(y * 0.9::DOUBLE, 8) AS y_lower, round(y * 1.1::DOUBLE, 8) AS y_upper FROM sta", dates="ds")
def interval_rename(spark, sf_dir):
    df = by_status(spark, sf_dir).select("status", "ds", F.col("y").alias("y_q0.50"), r(F.col("y") * 0.9).alias("y_q0.05"), r(F.col("y") * 1.1).alias("y_q0.95"))
    return intervals.rename_quantiles(df, STATUS, 0.05, 0.95)


# --- forecasts ------------------------------------------------------------------------------------------


@query(f"WITH {BY_STATUS}, l AS (SELECT status, max(ds) AS b, arg_max(y, ds) AS y FROM sta GROUP BY 1) SELECT status, h::INT AS horizon, (b + h::INT)::DATE AS ds, y FROM l, range(1, 11) t(h)", dates="ds")
def forecast_naive(spark, sf_dir):
    df = by_status(spark, sf_dir)
    f = strategies.context(df, STATUS, 7).withColumn("f", F.transform(F.sequence(F.lit(1), F.lit(10)), strategies.naive(F.col("x"))))
    return strategies.expand(f.select("status", "f"), STATUS, df, 10)


@query(f"""WITH {EVE}, l AS (SELECT event_type, max(ds) AS b, list(y ORDER BY ds) AS x FROM eve GROUP BY 1)
SELECT event_type, h::INT AS horizon, (b + h::INT)::DATE AS ds, x[len(x) - 7 + (h - 1) % 7 + 1] AS y FROM l, range(1, 11) t(h)""", dates="ds")
def forecast_seasonal_naive(spark, sf_dir):
    df = daily_events(spark, sf_dir)
    f = strategies.context(df, EVENTS, 7).withColumn("f", F.transform(F.sequence(F.lit(1), F.lit(10)), strategies.seasonal_naive(F.col("x"), 7)))
    return strategies.expand(f.select("event_type", "f"), EVENTS, df, 10)


@query(f"""WITH RECURSIVE {EVE}, l AS (SELECT event_type, max(ds) AS b, list(y ORDER BY ds)[-3:] AS x FROM eve GROUP BY 1),
f AS (SELECT event_type, b, x, 0 AS horizon, NULL::DOUBLE AS y FROM l UNION ALL SELECT event_type, b, [x[2], x[3], (x[1] + x[2] + x[3]) / 3], horizon + 1, (x[1] + x[2] + x[3]) / 3 FROM f WHERE horizon < 5)
SELECT event_type, horizon::INT AS horizon, (b + horizon::INT)::DATE AS ds, round(y, 8) AS y FROM f WHERE horizon > 0""", dates="ds")
def forecast_recursive_average(spark, sf_dir):
    df = daily_events(spark, sf_dir)
    f = strategies.context(df, EVENTS, 3).withColumn("f", strategies.recursive(F.col("x"), 5, strategies.moving_average_step(3)))
    return strategies.expand(f.select("event_type", "f"), EVENTS, df, 5).withColumn("y", r("y"))


@query(f"""WITH {EVE}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ds) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM eve),
p AS (SELECT a.event_type, h::INT AS horizon, a.y AS x0, b.y AS v FROM n a JOIN range(1, 6) t(h) ON a.k + 5 <= a.n JOIN n b ON b.event_type = a.event_type AND b.k = a.k + h)
SELECT event_type, horizon, round(regr_slope(v, x0), 8) AS slope, round(regr_intercept(v, x0), 5) AS intercept FROM p GROUP BY 1, 2""")
def forecast_direct_lines(spark, sf_dir):
    return strategies.direct_lines(daily_events(spark, sf_dir), EVENTS, 5).select("event_type", "horizon", r("slope").alias("slope"), r("intercept", 5).alias("intercept"))


@query(f"""WITH {EVE}, p AS (SELECT event_type, ds, y, lag(y) OVER (PARTITION BY event_type ORDER BY ds) AS p FROM eve)
SELECT event_type, round(regr_slope(y, p), 8) AS slope, round(regr_intercept(y, p), 5) AS intercept, arg_max(y, ds) AS last FROM p GROUP BY 1""")
def forecast_ar1(spark, sf_dir):
    return strategies.ar1(daily_events(spark, sf_dir), EVENTS).select("event_type", r("slope").alias("slope"), r("intercept", 5).alias("intercept"), "last")


#: Normal equations of seven lags and a constant, for three steps ahead, by elimination on lists.
_LAGS = f"""{EVE}, wn AS (SELECT event_type, list(y) OVER (o ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS x, list(y) OVER (o ROWS BETWEEN 7 FOLLOWING AND 9 FOLLOWING) AS z FROM eve WINDOW o AS (PARTITION BY event_type ORDER BY ds)),
ww AS (SELECT event_type, list_concat([1.0::DOUBLE], x) AS x, list_concat([1.0::DOUBLE], x, z) AS b FROM wn WHERE len(z) = 3 AND len(x) = 7),
pr AS (SELECT event_type, i, j, sum(x[i] * b[j]) AS v FROM ww, range(1, 9) a(i), range(1, 12) c(j) GROUP BY ALL),
m0 AS (SELECT event_type, list(r ORDER BY i) AS m FROM (SELECT event_type, i, list(v ORDER BY j) AS r FROM pr GROUP BY ALL) GROUP BY ALL),
el AS (SELECT event_type, 1 AS k, m FROM m0 UNION ALL
SELECT event_type, k + 1, list_transform(range(1, 9), lambda i: list_transform(range(1, 12), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * (m[k][j] / m[k][k]) END)) FROM el WHERE k <= 8),
sol AS (SELECT event_type, m FROM el WHERE k = 9)"""


@query(f"WITH RECURSIVE {_LAGS} SELECT event_type, h::INT AS horizon, p::INT AS pos, round(m[p + 1][8 + h], 6) AS coefficient, n FROM sol JOIN (SELECT event_type, count(*) AS n FROM ww GROUP BY 1) USING (event_type), range(1, 4) a(h), range(0, 8) b(p)")
def forecast_gram_coefficients(spark, sf_dir):
    found = least_squares.direct_regression(daily_events(spark, sf_dir), EVENTS, 7, 3)
    return found.select("event_type", "horizon", F.posexplode("coefficients").alias("pos", "coefficient"), "n").withColumn("coefficient", r("coefficient", 6))


@query(f"""WITH RECURSIVE {_LAGS}, la AS (SELECT event_type, max(ds) AS b, list_concat([1.0::DOUBLE], list(y ORDER BY ds)[-7:]) AS x FROM eve GROUP BY 1)
SELECT event_type, h::INT AS horizon, (b + h::INT)::DATE AS ds, round(list_sum(list_transform(range(1, 9), lambda i: m[i][8 + h] * x[i])), 5) AS y FROM sol JOIN la USING (event_type), range(1, 4) t(h)""", dates="ds")
def forecast_gram_direct(spark, sf_dir):
    return least_squares.direct_forecast(daily_events(spark, sf_dir), EVENTS, 7, 3).withColumn("y", r("y", 5))


#: The quantity that is to be shipped on a day, as the orders known by some day have it.
_PLAN = """ver AS (SELECT l_shipdate::DATE AS due, o_orderdate::DATE AS known, sum(sum(l_quantity)) OVER (PARTITION BY l_shipdate::DATE ORDER BY o_orderdate::DATE) AS planned
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


@query(f"""WITH {REV}, {_PLAN}, req AS (SELECT ds AS origin, h::INT AS horizon, (ds + h::INT)::DATE AS ds FROM rev, range(1, 8) t(h))
SELECT req.origin, req.horizon, req.ds, v.planned, v.known FROM req ASOF LEFT JOIN ver v ON v.due = req.ds AND req.origin >= v.known""", dates="origin ds known")
def covariates_known_ahead(spark, sf_dir):
    """Shipments planned for each of the seven days ahead, as they were known on each day."""
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    both = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    days = both.groupBy(F.to_date("l_shipdate").alias("ds"), F.to_date("o_orderdate").alias("known")).agg(F.sum("l_quantity").alias("q"))
    versions = covariates.running_versions(days, ["ds"], "known", {"planned": "q"})
    origins = rev(spark, sf_dir).select(F.col("ds").alias("origin"))
    return covariates.known_ahead(origins, versions, ONE, ["planned"], 7).select("origin", "horizon", "ds", "planned", "known")


#: Monthly revenue by nation, region and in all: forecasts of the next month by the geometric mean of the last three, which don't add up.
_AREAS = """mon AS (SELECT n_name, r_name, date_trunc('month', o_orderdate)::DATE AS ds, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE / 1e7::DOUBLE AS y
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
own AS (SELECT 'nation ' || n_name AS node, 'region ' || r_name AS region, ds, y FROM mon),
alln AS (SELECT node, ds, y FROM own UNION ALL SELECT region, ds, sum(y) FROM own GROUP BY 1, 2 UNION ALL SELECT 'world', ds, sum(y) FROM own GROUP BY 2),
fc AS (SELECT node, exp(avg(ln(y))) AS y FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ds DESC) AS k FROM alln) WHERE k <= 3 GROUP BY node)"""


def areas(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(past, forecasts, edges) of nations, regions and the world."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("orders", "customer", "nation", "region")}
    place = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t["orders"].join(place, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "r_name", F.trunc("o_orderdate", "month").alias("ds"))
    rows = rows.agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.lit(1e7)).alias("y"))
    rows = rows.select(F.concat(F.lit("nation "), "n_name").alias("node"), F.concat(F.lit("region "), "r_name").alias("region"), "ds", "y")
    past = rows.select("node", "ds", "y").unionByName(rows.groupBy(F.col("region").alias("node"), "ds").agg(F.sum("y").alias("y"))).unionByName(rows.groupBy("ds").agg(F.sum("y").alias("y")).withColumn("node", F.lit("world")))
    edges = rows.select("node", F.col("region").alias("parent")).distinct().unionByName(rows.select(F.col("region").alias("node"), F.lit("world").alias("parent")).distinct())
    spec = SeriesSpec(("node",))
    last = windows.tail(past, spec, 3).groupBy("node").agg(F.exp(F.avg(F.log("y"))).alias("y"))
    return past, last.withColumn("ds", F.lit("next")), edges


@query(f"""WITH {_AREAS}, leaf AS (SELECT DISTINCT node, region FROM own), up AS (SELECT leaf.node, region, y FROM leaf JOIN fc USING (node))
SELECT node, round(y, 8) AS y FROM up UNION ALL SELECT region, round(sum(y), 8) FROM up GROUP BY 1 UNION ALL SELECT 'world', round(sum(y), 8) FROM up""")
def hierarchy_bottom_up(spark, sf_dir):
    _, forecasts, edges = areas(spark, sf_dir)
    return hierarchy.Hierarchy(edges).bottom_up(forecasts, SeriesSpec(("node",))).select("node", r("y").alias("y"))


@query(f"""WITH {_AREAS}, share AS (SELECT node, region, sum(y) / (SELECT sum(y) FROM own) AS s FROM own GROUP BY 1, 2), up AS (SELECT node, region, s * (SELECT y FROM fc WHERE node = 'world') AS y FROM share)
SELECT node, round(y, 8) AS y FROM up UNION ALL SELECT region, round(sum(y), 8) FROM up GROUP BY 1 UNION ALL SELECT 'world', round(sum(y), 8) FROM up""")
def hierarchy_top_down(spark, sf_dir):
    past, forecasts, edges = areas(spark, sf_dir)
    return hierarchy.Hierarchy(edges).top_down(forecasts, past, SeriesSpec(("node",))).select("node", r("y").alias("y"))


@query(f"""WITH {_AREAS}, leaf AS (SELECT DISTINCT node, region FROM own), n AS (SELECT leaf.region, leaf.node, y FROM leaf JOIN fc USING (node)),
g AS (SELECT region, count(*) AS k, sum(y) AS s FROM n GROUP BY region), u AS (SELECT g.region, k, s, 1.0::DOUBLE / k + 1 AS w, (s / k + fc.y) / (1.0::DOUBLE / k + 1) AS m FROM g JOIN fc ON fc.node = g.region),
w AS (SELECT sum(1 / w) AS e, sum(m) AS s FROM u), t AS (SELECT (s / e + (SELECT y FROM fc WHERE node = 'world')) / (1 / e + 1) AS t, e, s FROM w),
rt AS (SELECT region, k, u.s, m + (t - t.s) / w / e AS t FROM u, t), up AS (SELECT node, n.region, y + (t - s) / k AS y FROM n JOIN rt USING (region))
SELECT node, round(y, 7) AS y FROM up UNION ALL SELECT region, round(sum(y), 7) FROM up GROUP BY 1 UNION ALL SELECT 'world', round(sum(y), 7) FROM up""")
def hierarchy_least_squares(spark, sf_dir):
    _, forecasts, edges = areas(spark, sf_dir)
    return hierarchy.Hierarchy(edges).least_squares(forecasts, SeriesSpec(("node",))).select("node", r("y", 7).alias("y"))


_FLAG_N = 28


@query(f"""WITH {REV}, gr AS (SELECT g.ds::DATE AS ds, coalesce(y, 0.0::DOUBLE) AS y FROM generate_series((SELECT min(ds) FROM rev), (SELECT max(ds) FROM rev), INTERVAL 1 DAY) g(ds) LEFT JOIN rev ON rev.ds = g.ds::DATE),
k AS (SELECT *, row_number() OVER (ORDER BY ds DESC) AS b FROM gr), tr AS (SELECT list(y ORDER BY ds) AS x FROM k WHERE b > {_FLAG_N}),
te AS (SELECT ds, y, row_number() OVER (ORDER BY ds) AS h FROM k WHERE b <= {_FLAG_N}),
f AS (SELECT ds, y, unnest(['naive', 'seasonal_naive', 'mean_7']) AS model, unnest([x[len(x)], x[len(x) - 7 + (h - 1) % 7 + 1], list_avg(x[-7:])]) AS p FROM te, tr),
m AS (SELECT model, avg(abs(y - p)) AS mae, sqrt(avg(pow(y - p, 2))) AS rmse, sum(abs(y - p)) / sum(abs(y)) AS wmape, avg((y BETWEEN p * 0.5::DOUBLE AND p * 1.5::DOUBLE)::INT) AS coverage FROM f GROUP BY model)
SELECT model, round(mae, 8) AS mae, round(rmse, 8) AS rmse, round(wmape, 8) AS wmape, round(coverage, 8) AS coverage, (row_number() OVER (ORDER BY mae, model))::INT AS rank FROM m""")
def forecast_leaderboard(spark, sf_dir):
    """The flagship: regular grid, tail holdout, three forecasters, metrics, rank."""
    from ..plans.leaderboard import ranked

    full = grid.regularise(rev(spark, sf_dir), ONE, fill=0.0)
    last = ONE.whole().orderBy(F.col("ds").desc())
    marked = full.withColumn("b", F.row_number().over(last))
    train, test = marked.where(F.col("b") > _FLAG_N).drop("b"), marked.where(F.col("b") <= _FLAG_N).withColumn("h", (_FLAG_N + 1 - F.col("b")))
    x = strategies.context(train, ONE, 7)
    named = {"naive": strategies.naive(F.col("x"))(F.col("h")), "seasonal_naive": strategies.seasonal_naive(F.col("x"), 7)(F.col("h")), "mean_7": arrays.mean(F.col("x"))}
    f = test.crossJoin(F.broadcast(x)).select("ds", "y", *[v.alias(k) for k, v in named.items()])  # one window
    f = f.unpivot(["ds", "y"], list(named), "model", "p")
    scored = f.groupBy("model").agg(metrics.mae("y", "p").alias("mae"), metrics.rmse("y", "p").alias("rmse"), metrics.wmape("y", "p").alias("wmape"), metrics.coverage("y", F.col("p") * 0.5, F.col("p") * 1.5).alias("coverage"))
    return ranked(scored, [], "mae").select("model", *[r(c).alias(c) for c in ("mae", "rmse", "wmape", "coverage")], "rank")


# --- generated series -----------------------------------------------------------------------------------

#: A draw of N(0, 1) for a text, as in generators.normal().
_U = "((('0x' || left(md5('{what}:7:' || {of}), 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"
_N = lambda of: f"sqrt(-2 * ln({_U.format(what='radius', of=of)})) * cos(2 * pi() * {_U.format(what='angle', of=of)})"
_STEPS = f"{BY_STATUS}, nn AS (SELECT *, row_number() OVER o - 1 AS rn, count(*) OVER (PARTITION BY status) AS n FROM sta WINDOW o AS (PARTITION BY status ORDER BY ds))"


@query(f"WITH {REV}, {NUM} SELECT ds, round(y + 0.4::DOUBLE * sin(rn::DOUBLE) + 0.4::DOUBLE * cos(rn::DOUBLE), 8) AS y FROM num", dates="ds")
def generate_trigonometry(spark, sf_dir):
    """Daily revenue with a wave on top."""
    rows = Slices.of(rev(spark, sf_dir), ONE).numbered("rn")
    return rows.select("ds", r(F.col("y") + generators.wave(F.col("rn"))).alias("y"))


@query(f"WITH {_STEPS} SELECT status, ds, y, round(({_N('status || chr(58) || rn::VARCHAR')}) * 2 + 1, 8) AS noise FROM nn", dates="ds")
def generate_white_noise(spark, sf_dir):
    return generators.with_noise(by_status(spark, sf_dir), STATUS, 1.0, 2.0, seed=7).withColumn("noise", r("noise"))


@query(f"WITH {_STEPS}, st AS (SELECT *, CASE WHEN rn = 0 THEN 0 ELSE {_N('status || chr(58) || rn::VARCHAR')} END AS step FROM nn) SELECT status, ds, y, round(sum(step) OVER (PARTITION BY status ORDER BY ds), 6) AS walk FROM st", dates="ds")
def generate_random_walk(spark, sf_dir):
    return generators.with_walk(by_status(spark, sf_dir), STATUS, seed=7).withColumn("walk", r("walk", 6))


@query(f"""WITH {_STEPS}, se AS (SELECT *, greatest(1, n // 7) AS len FROM nn), pl AS (SELECT *, CASE WHEN rn < len * 7 THEN rn // len ELSE rn - len * 7 END AS season FROM se)
SELECT status, ds, y, round(10 * ({_N('status || chr(58) || season::VARCHAR')}), 7) AS level FROM pl""", dates="ds")
def generate_random_events(spark, sf_dir):
    return generators.with_seasons(by_status(spark, sf_dir), STATUS, 7, seed=7).withColumn("level", r("level", 7))
