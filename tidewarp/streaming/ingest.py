"""Streams of events to daily series, and a buffer of the last values of each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema: str, time: str = "ts") -> DataFrame:
    """A stream of Parquet files; the time column as a timestamp, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))


def daily_counts(events: DataFrame, keys: list[str], time: str = "ts", late: str = "1 day", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(keys, ds, y) of tumbling (or sliding) windows; rows later than ``late`` are dropped. Works on batches too."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = source.groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return out.select(*keys, F.col("w.start").alias("ds"), "y")


def sessions(events: DataFrame, keys: list[str], time: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(keys, started, ended, n) of session windows."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def last_values(daily: DataFrame, key: str, lags: int) -> DataFrame:
    """(key, x): the last ``lags`` values per key of a stream of (key, ds, y) rows, kept as state between batches.

    The stream may not be an aggregate itself: write finished windows to a table and read that as a stream.
    """

    def update(k, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in parts:
            held += list(zip(pdf["ds"].astype("int64").tolist(), pdf["y"].tolist(), strict=True))
        held = sorted(dict(held).items())[-lags:]
        state.update(([d for d, _ in held], [y for _, y in held]))
        yield pd.DataFrame({key: [k[0]], "x": [[y for _, y in held]]})

    rows = daily.select(key, "ds", "y")
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, x array<double>", "days array<long>, y array<double>", "update", GroupStateTimeout.NoTimeout)


def score_batches(daily: DataFrame, forecaster, n: int, sink: str, checkpoint: str):
    """Forecast n days from each batch of finished windows with a fitted model; appends Parquet to sink."""

    def score(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            forecaster.predict_from(batch, n).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return daily.writeStream.outputMode("append").foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
