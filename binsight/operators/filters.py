"""Row filters: period predicates, time-of-day windows, optional equality,
format and length checks (O01-O04, O24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.functions.pg import as_ts, col, day_start, next_day_start, similar_to, time_of_day, tod


def in_days_expr(ts, start, end) -> Column:
    """``ts::date BETWEEN start AND end`` written as a half-open instant range
    (``start 00:00 <= ts < end+1 00:00``) so it reaches the Parquet scan as
    two pushed filters instead of a cast on every row."""
    ts = col(ts)
    return (ts >= day_start(start)) & (ts < next_day_start(end))


def in_days(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Whole days ``start``..``end`` inclusive (the last day counts)."""
    return df.filter(in_days_expr(ts, start, end))


def in_instants_expr(ts, start, end) -> Column:
    """``ts BETWEEN start AND end``: a date bound means its midnight, so the
    end date itself is excluded except for the instant 00:00:00."""
    return col(ts).between(as_ts(start), as_ts(end))


def in_instants(df: DataFrame, ts: str, start, end) -> DataFrame:
    """O02."""
    return df.filter(in_instants_expr(ts, start, end))


def exclude_time_of_day(df: DataFrame, ts: str, t0: str, t1: str) -> DataFrame:
    """Drop rows whose time of day is in [t0, t1] (inclusive)."""
    t = time_of_day(ts)
    return df.filter(~t.between(tod(t0), tod(t1)))


def optional_eq(df: DataFrame, column: str, value) -> DataFrame:
    """``column = value`` unless value is None/0/'' (then all rows)."""
    if value is None or value == 0 or value == "":
        return df
    return df.filter(F.col(column) == F.lit(value))


def bad_format(df: DataFrame, column: str, similar_pattern: str) -> DataFrame:
    """Rows whose ``column NOT SIMILAR TO pattern`` (NULL never matches
    either way, so NULL rows are dropped, as in SQL)."""
    return df.filter(~similar_to(column, similar_pattern))


def bad_length(df: DataFrame, column: str, length: int) -> DataFrame:
    """Rows whose ``char_length(column) <> length``."""
    return df.filter(F.char_length(F.col(column)) != F.lit(length))
