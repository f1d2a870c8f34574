"""Crosstab and the row-array JSON sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binsight.operators.sequence import RP


def crosstab(df: DataFrame, row: str | Sequence[str], column: str, value: str,
             values: Sequence, other: str, agg=F.sum) -> DataFrame:
    """One row per ``row`` key, one column per listed ``column`` value (named
    by its text), and in ``other`` the aggregate over all rows with any other
    value or none, so no row goes missing.  One pass with map-side combine."""
    rows = [row] if isinstance(row, str) else list(row)
    c, values = F.col(column), list(values)
    rest = ~F.coalesce(c.isin(values), F.lit(False))
    return df.groupBy(*rows).agg(*[agg(F.when(c == v, F.col(value))).alias(str(v)) for v in values],
                                 agg(F.when(rest, F.col(value))).alias(other))


def rows_as_text_arrays(df: DataFrame) -> DataFrame:
    """Each row as an array of its values rendered as text (NULL stays NULL),
    positional like the original result files."""
    return df.select(F.array(*[F.col(c).cast("string") for c in df.columns]).alias("row"))


def write_rows_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """O33 at scale: one JSON object ``{"row": [...]}`` per line, written in
    parallel by the executors (no collect)."""
    rows_as_text_arrays(df).write.mode(mode).json(path)


def write_ordered_rows_json(df: DataFrame, path: str, order: Sequence[Column], mode: str = "overwrite") -> None:
    """O33 in display order: the rows are range-sorted by ``order`` (such as
    ``display.pg_order`` terms; ties by all columns), every executor writes its range,
    and each line carries its ``place``, which ascends over all files.  Nothing is
    collected, and the place needs no second pass over the rows."""
    ordered = df.orderBy(*order, *[F.col(c).asc_nulls_last() for c in df.columns])
    (ordered.select(F.monotonically_increasing_id().alias("place"), F.array(*[F.col(c).cast("string") for c in df.columns]).alias("row"))
            .write.mode(mode).json(path))


def read_ordered_rows(spark: SparkSession, path: str) -> DataFrame:
    """(position, row) of what ``write_ordered_rows_json`` wrote, positions from 0
    without gaps: the rows of earlier ranges are counted (one count a range) and
    added to a row's place in its own."""
    rows = spark.read.schema("place long, row array<string>").json(path)
    part = F.shiftright("place", 33)
    # one row per range: bounded by their number, never by the data
    before = F.sum("n").over(Window.orderBy(RP).rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(part.alias(RP)).agg(F.count(F.lit(1)).alias("n")).select(RP, F.coalesce(before, F.lit(0)).alias("before"))
    return (rows.withColumn("__part", part).join(F.broadcast(counts), F.col("__part") == F.col(RP))
                .select((F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("position"), "row"))


def title_columns(df: DataFrame) -> DataFrame:
    """Column titles with the first letter upper-cased, as the original
    result tables were headed (a rename: no data is touched)."""
    return df.toDF(*[c[:1].upper() + c[1:] for c in df.columns])
