"""The 82 calendar features of a time column, as expressions.

Values follow the fixed definitions of the feature set, odd ones included: is_weekend is 0 at weekends,
weekday distances count Monday as 1, the middle of a quarter is its 15th day, and hours, minutes and seconds
since the start are whole days times a constant. ``extra_flags`` has the plain versions under other names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First month of each season, and the divisor of each unit in days.
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "winter": 12}
UNITS = {"day": 1, "week": 7, "month": 30, "quarter": 90}
YEARS = {"": 0, "next_year_": 1, "last_year_": -1}


def basic(t: Column, d: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(t), "minute": F.minute(t), "weekday": F.weekday(d), "week": F.weekofyear(d), "month": F.month(d), "quarter": F.quarter(d),
        "day_of_month": F.day(d), "day_of_year": F.dayofyear(d), "day_of_quarter": F.date_diff(d, F.trunc(d, "quarter")) + 1,
        "week_of_month": F.floor((F.day(d) - 1) / 7).cast("int") + 1, "season": F.floor((F.month(d) % 12) / 3).cast("int"),
    }


def flags(d: Column) -> dict[str, Column]:
    wd = F.weekday(d)
    out = {
        "is_weekend": wd < 5, "is_start_of_week": wd == 0, "is_end_of_week": wd == 4, "is_start_of_month": F.day(d) == 1, "is_middle_of_month": F.day(d) == 15,
        "is_end_of_month": d == F.last_day(d), "is_quarter_start": d == F.trunc(d, "quarter").cast("date"), "is_year_start": F.dayofyear(d) == 1,
        "is_year_end": (F.month(d) == 12) & (F.day(d) == 31),
    }
    return {k: v.cast("int") for k, v in out.items()}


def distances(t: Column, d: Column, start: Column) -> dict[str, Column]:
    wd, doq = F.weekday(d), F.date_diff(d, F.trunc(d, "quarter")) + 1
    seconds = F.unix_timestamp(t.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    days = F.floor(seconds / 86400).cast("int")
    return {
        "day_to_mid_quarter": doq - 15, "day_to_start_quarter": doq - 1, "day_to_end_quarter": doq - 90,
        "day_to_monday": F.abs(wd - 1), "day_to_friday": F.abs(wd - 5), "day_to_middle_week": F.abs(wd - 3),
        "day_to_start_timestamp": days, "hour_to_start_timestamp": days * 24, "minute_to_start_timestamp": days * 1440, "sec_to_start_timestamp": days.cast("long") * 86400,
        "month_to_start_timestamp": days / 30, "week_to_start_timestamp": days / 7, "quarter_to_start_timestamp": days / 90, "year_to_start_timestamp": days / 365,
    }


def seasons(d: Column) -> dict[str, Column]:
    """Days since the first day of each season of this, the next and the last year, in four units."""
    out = {}
    for ahead, offset in YEARS.items():
        for unit, length in UNITS.items():
            for season, month in SEASONS.items():
                days = F.date_diff(d, F.make_date(F.year(d) + offset, F.lit(month), F.lit(1)))
                out[f"{unit}_to_{ahead}{season}"] = days if length == 1 else days / length
    return out


def calendar_features(time: Column, start: Column, prefix: str = "timefeatures_") -> dict[str, Column]:
    """All 82 features. ``start`` is the first time of the fitted series."""
    t, d = time.cast("timestamp_ntz"), time.cast("date")
    out = basic(t, d) | flags(d) | distances(t, d, start) | seasons(d)
    return {prefix + k: v for k, v in out.items()}


def extra_flags(time: Column) -> dict[str, Column]:
    """Plain versions beside the fixed ones."""
    wd = F.weekday(time.cast("date"))
    return {"is_weekend_true": (wd >= 5).cast("int"), "days_since_monday": wd, "days_to_sunday": 6 - wd}
