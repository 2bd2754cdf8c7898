"""Day buckets, ranges and rendering of UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import _col


def day(col: Column | str) -> Column:
    """UTC day of a timestamp (the session time zone is UTC)."""
    return F.to_date(_col(col))


def add_days(ts: Column | str, days: Column | int) -> Column:
    days = days if isinstance(days, Column) else F.lit(days)
    return _col(ts) + F.make_dt_interval(days=days.cast("int"))


def iso(col: Column | str) -> Column:
    return F.date_format(_col(col), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def in_range(df: DataFrame, col: str, from_day: str | None = None, to_day: str | None = None) -> DataFrame:
    """Rows of the inclusive day range; plain comparisons, so the bounds reach the scan."""
    kind = df.schema[col].dataType
    if from_day:
        df = df.filter(F.col(col) >= F.lit(f"{from_day} 00:00:00").cast(kind))
    if to_day:
        df = df.filter(F.col(col) <= F.lit(f"{to_day} 23:59:59.999").cast(kind))
    return df
