"""What a table of series is: its key columns, time column and target column."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SeriesSpec:
    """Columns of a table that holds any number of series, one row per series and time."""

    keys: tuple[str, ...] = ()
    time: str = "ds"
    target: str = "y"
    features: tuple[str, ...] = ()

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def ordered(self) -> WindowSpec:
        return self.whole().orderBy(self.time)

    def columns(self) -> list[str]:
        return [*self.keys, self.time, self.target]


def require_time(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """df, if its time column is a date or timestamp; read from the schema, without a job."""
    kind = df.schema[spec.time].dataType
    if not isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        raise TypeError(f"{spec.time} must be a date or a timestamp, not {kind.simpleString()}")
    return df


def numbered(df: DataFrame, spec: SeriesSpec, name: str = "rn") -> DataFrame:
    """Position of each row in its series, from 0."""
    return df.withColumn(name, (F.row_number().over(spec.ordered()) - 1).cast("int"))


#: Units of a frequency: months, seconds, and the day of the month that times fall on (0: the one that they start from).
UNITS = {
    "S": (0, 1, 0), "s": (0, 1, 0), "T": (0, 60, 0), "min": (0, 60, 0), "H": (0, 3600, 0), "h": (0, 3600, 0), "D": (0, 86400, 0), "d": (0, 86400, 0), "W": (0, 604800, 0),
    "M": (1, 0, 31), "ME": (1, 0, 31), "MS": (1, 0, 1), "Q": (3, 0, 31), "QE": (3, 0, 31), "QS": (3, 0, 1), "Y": (12, 0, 31), "YE": (12, 0, 31), "YS": (12, 0, 1),
}


@dataclass(frozen=True)
class Step:
    """From one time of a series to the next: seconds, or months with the day of the month that times fall on (31: the last)."""

    months: int = 0
    seconds: int = 86400
    anchor: int = 0

    @classmethod
    def of(cls, freq: str | int | Step) -> Step:
        """From a number of days or a frequency such as 15min, h, D, W, MS, 2ME."""
        if isinstance(freq, Step):
            return freq
        if isinstance(freq, int):
            return cls(0, 86400 * freq)
        found = re.fullmatch(r"(\d*)([A-Za-z]+)", freq)
        if not found or found[2] not in UNITS or found[1] == "0":
            raise ValueError(f"no frequency {freq}")
        n, (months, seconds, anchor) = int(found[1] or 1), UNITS[found[2]]
        return cls(months * n, seconds * n, anchor)

    @classmethod
    def modal(cls, wall: np.ndarray) -> Step:
        """The commonest gap of sorted wall seconds, the smallest of several; months where all times fall on one day of the month, or on the last."""
        gaps = np.diff(wall)
        values, counts = np.unique(gaps[gaps > 0], return_counts=True)
        if not len(values):
            return cls()
        seconds = int(values[counts.argmax()])
        if seconds >= 28 * 86400 and len(np.unique(wall % 86400)) == 1:
            days = (wall // 86400).astype("datetime64[D]")
            month = days.astype("datetime64[M]")
            of_month, length = (days - month).astype(int) + 1, ((month + 1).astype("datetime64[D]") - month.astype("datetime64[D]")).astype(int)
            anchor = 31 if (of_month == length).all() else int(of_month.max())
            apart, times = np.unique(np.diff(month.astype(int)), return_counts=True)
            if (of_month == np.minimum(anchor, length)).all() and apart[times.argmax()] > 0:
                return cls(int(apart[times.argmax()]), 0, anchor)
        return cls(0, seconds)

    def ahead(self, wall: int, n: int) -> np.ndarray:
        """Wall seconds of the n times after one."""
        steps = np.arange(1, n + 1)
        if not self.months:
            return wall + steps * self.seconds
        day = np.array(wall // 86400).astype("datetime64[D]")
        month = day.astype("datetime64[M]") + steps * self.months
        anchor = self.anchor or int((day - day.astype("datetime64[M]")).astype(int)) + 1
        length = ((month + 1).astype("datetime64[D]") - month.astype("datetime64[D]")).astype(int)
        return (month.astype("datetime64[D]").astype(int) + np.minimum(anchor, length) - 1) * 86400 + wall % 86400


def wall_seconds(time: Column, kind: T.DataType) -> Column:
    """Seconds since 1970-01-01 00:00 on the clock of the time column."""
    days = F.unix_date(time.cast("date")).cast("long") * 86400
    return days if isinstance(kind, T.DateType) else days + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def at_wall_seconds(wall: Column, kind: T.DataType) -> Column:
    """The time at so many wall seconds, in the type of the time column."""
    day = F.date_from_unix_date(F.floor(wall / 86400).cast("int"))
    return day if isinstance(kind, T.DateType) else day.cast(kind) + F.make_dt_interval(secs=F.pmod(wall, F.lit(86400)))


def next_time(time: Column, steps: Column, kind: T.DataType, step: Step = Step()) -> Column:  # noqa: B008
    """A number of steps (days, if not told) later, in the type of the time column."""
    if step.months:
        first = F.add_months(F.trunc(time, "month"), steps * step.months)
        day = F.date_add(first, F.least(F.lit(step.anchor) if step.anchor else F.day(time), F.day(F.last_day(first))) - 1)
        return day if isinstance(kind, T.DateType) else day.cast(kind) + F.make_dt_interval(hours=F.hour(time), mins=F.minute(time), secs=F.second(time))
    if step.seconds % 86400 == 0:
        days = steps * (step.seconds // 86400)
        return F.date_add(time, days) if isinstance(kind, T.DateType) else time + F.make_dt_interval(days=days)
    if isinstance(kind, T.DateType):
        raise TypeError("a step of less than a day needs a timestamp")
    seconds = steps.cast("long") * step.seconds
    return time + F.make_dt_interval(days=F.floor(seconds / 86400).cast("int"), secs=F.pmod(seconds, F.lit(86400)))
