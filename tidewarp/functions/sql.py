"""SQL table functions: over arrays and dates, and over whole tables.

The functions over tables take ``TABLE(t) PARTITION BY (keys) ORDER BY (time)``: Spark partitions and sorts, and a
function reads each partition's rows in order and holds a window of them, never a series. They have the columns
of whatever table they are given: analyze() makes the result's schema from it.
"""

from __future__ import annotations

import datetime as dt
from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .shipping import ship


class LagWindows:
    """lag_windows(values, size, step): (start, x) of each window of an array."""

    def eval(self, values: list, size: int, step: int):
        for start in range(0, len(values or ()) - size + 1, step):
            yield start, values[start : start + size]


class FutureDays:
    """future_days(last, n): (horizon, ds) of the n days after a date."""

    def eval(self, last: dt.date, n: int):
        for h in range(1, n + 1):
            yield h, last + dt.timedelta(days=h)


def _table(table: AnalyzeArgument) -> T.StructType:
    if not table.isTable:
        raise ValueError("the first argument must be TABLE(...) PARTITION BY ... ORDER BY ...")
    return table.dataType


def _column(table: AnalyzeArgument, name: AnalyzeArgument) -> T.DataType:
    fields = {f.name: f.dataType for f in _table(table)}
    if not name.isConstantExpression or name.value not in fields:
        raise ValueError(f"the table has no column {name.value}; it has {sorted(fields)}")
    return fields[name.value]


def _positive(**values: AnalyzeArgument | None) -> None:
    for name, value in values.items():
        if value is not None and (not value.isConstantExpression or not isinstance(value.value, int) or value.value < 1):
            raise ValueError(f"{name} must be a positive whole number")


class TableWindows:
    """table_windows(TABLE(t) ..., target, size [, horizon [, step]]): all columns of the first row of each window, start, and the arrays x and y.

    A partition is a series. The windows of supervised_windows(): x the ``size`` values from the row on, y the
    ``horizon`` (0: none) after them, at each ``step``-th row.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, target: AnalyzeArgument, size: AnalyzeArgument, horizon: AnalyzeArgument | None = None, step: AnalyzeArgument | None = None) -> AnalyzeResult:
        kind = _column(table, target)
        _positive(size=size, step=step)
        out = T.StructType([f for f in _table(table) if f.name not in ("start", "x", "y")])
        return AnalyzeResult(out.add("start", T.LongType()).add("x", T.ArrayType(kind)).add("y", T.ArrayType(kind)))

    def __init__(self):
        self.held: deque = deque()
        self.seen = 0

    def eval(self, table, target: str, size: int, horizon: int = 0, step: int = 1):
        row = table.asDict()
        self.held.append(([v for k, v in row.items() if k not in ("start", "x", "y")], row[target]))
        self.seen += 1
        if len(self.held) == size + horizon:
            start = self.seen - size - horizon
            if start % step == 0:
                values = [v for _, v in self.held]
                yield (*self.held[0][0], start, values[:size], values[size:])
            self.held.popleft()


class TableFilled:
    """table_filled(TABLE(t) ..., target): the table with nulls of target replaced by the last known value of the partition."""

    @staticmethod
    def analyze(table: AnalyzeArgument, target: AnalyzeArgument) -> AnalyzeResult:
        _column(table, target)
        return AnalyzeResult(_table(table))

    def __init__(self):
        self.last = None

    def eval(self, table, target: str):
        row = table.asDict()
        self.last = row[target] if row[target] is not None else self.last
        yield tuple(self.last if k == target else v for k, v in row.items())


class TableFuture:
    """table_future(TABLE(t) ..., time, n [, days]): (keys, horizon, time) of the n times after each partition's last; keys are the columns of PARTITION BY.

    ``keys`` is an array of their names, as a function isn't told which columns it is partitioned by.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, keys: AnalyzeArgument, time: AnalyzeArgument, n: AnalyzeArgument, days: AnalyzeArgument | None = None) -> AnalyzeResult:
        fields = {f.name: f for f in _table(table)}
        kind = _column(table, time)
        _positive(n=n, days=days)
        if missing := [k for k in keys.value if k not in fields]:
            raise ValueError(f"the table has no columns {missing}")
        return AnalyzeResult(T.StructType([*(fields[k] for k in keys.value), T.StructField("horizon", T.IntegerType()), T.StructField(time.value, kind)]))

    def __init__(self):
        self.last = None

    def eval(self, table, keys: list, time: str, n: int, days: int = 1):
        if table[time] is not None:
            self.last = (*(table[k] for k in keys), table[time], n, days)

    def terminate(self):
        if self.last is not None:
            *keys, time, n, days = self.last
            for h in range(1, n + 1):
                yield (*keys, h, time + dt.timedelta(days=h * days))


def register(spark: SparkSession) -> None:
    spark.udtf.register("lag_windows", udtf(LagWindows, returnType="start int, x array<double>"))
    spark.udtf.register("future_days", udtf(FutureDays, returnType="horizon int, ds date"))
    ship(spark.range(0))
    for name, function in (("table_windows", TableWindows), ("table_filled", TableFilled), ("table_future", TableFuture)):
        spark.udtf.register(name, udtf(function))
