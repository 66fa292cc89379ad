"""The last values of each series of a stream, as state with timers and expiry.

Each series holds a list of its last ``lags`` (time, value) rows. Rows may come in any order until the watermark
passes them; rows behind it are dropped. A series that is silent for ``expire`` of event time is told as expired and
forgotten, by a timer that each row moves on, so state is bounded by the series that are alive. The state is in the
checkpoint: a restarted query goes on where it was.

Needs the state store provider for state of several columns, which stateful_session() sets.

Defined cases: of rows of one series and time the last to arrive counts. Null times and values are left out. A series that comes
back after it has expired starts anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """spark, set to keep streaming state in the provider that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class _Recent(StatefulProcessor):
    def __init__(self, key: str, lags: int, expire_ms: int):
        self.key, self.lags, self.expire_ms = key, lags, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, y double")

    def _out(self, key, held: list[tuple[int, float]], at: int, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "at": [pd.Timestamp(at, unit="ms")], "x": [[y for _, y in held]], "expired": [expired]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = {int(at): float(y) for at, y in self.rows.get()}
        before = max(held, default=None)
        for pdf in rows:
            known = pdf.dropna(subset=["ms", "y"])
            held |= dict(zip(known["ms"].astype("int64").tolist(), known["y"].tolist(), strict=True))
        if not held:
            return
        kept = sorted(held.items())[-self.lags :]
        self.rows.put(kept)
        if before != kept[-1][0]:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(kept[-1][0] + self.expire_ms)
        yield self._out(key, kept, kept[-1][0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = [(int(at), float(y)) for at, y in self.rows.get()]
        self.rows.clear()
        if held:
            yield self._out(key, held, held[-1][0], True)

    def close(self) -> None:
        pass


def recent_values(stream: DataFrame, key: str, lags: int, time: str = "ds", value: str = "y", late: str = "1 day", expire_days: float = 30.0) -> DataFrame:
    """(key, at, x, expired): after each batch the last ``lags`` values of each of its series, and once more when a series expires.

    stream has (key, time, value) rows with a timestamp; ``late`` is how long rows may be late.
    """
    if lags < 1 or expire_days <= 0:
        raise ValueError("lags and expire_days must be positive")
    rows = ship(stream).select(F.col(key), F.col(time).alias("__time"), F.unix_millis(F.col(time).cast("timestamp")).alias("ms"), F.col(value).cast("double").alias("y"))
    out = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField("at", T.TimestampType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("expired", T.BooleanType())])
    watched = rows.withWatermark("__time", late)
    return watched.groupBy(key).transformWithStateInPandas(statefulProcessor=_Recent(key, lags, int(expire_days * 86_400_000)), outputStructType=out, outputMode="update", timeMode="eventTime")
