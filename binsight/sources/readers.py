"""Reading the domain tables.

The reports only need a :class:`~binsight.sources.bindings.Tables` mapping of
DataFrames.  Production data usually sits in Parquet/Delta folders or in the
session catalog; the original system kept it in a relational database, which
Spark reads in parallel with ``spark.read.jdbc`` (partitioned on a numeric
column so no single task pulls a whole table).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from binsight.sources.bindings import Tables
from binsight.sources.schema import check_tables


def from_parquet(spark: SparkSession, root: str, names: Iterable[str], validate: bool = True) -> Tables:
    """``root/<name>`` (Parquet folder, possibly partitioned by municipality
    and date so period and municipality filters prune files); the schemas are
    checked against the domain model (metadata only, no data read)."""
    t = Tables({n: spark.read.parquet(f"{root}/{n}") for n in names})
    if validate:
        check_tables(t)
    return t


def from_catalog(spark: SparkSession, names: Iterable[str], database: str | None = None) -> Tables:
    prefix = f"{database}." if database else ""
    return Tables({n: spark.table(prefix + n) for n in names})


def from_jdbc(spark: SparkSession, url: str, names: Iterable[str], properties: Mapping[str, str],
              partitioning: Mapping[str, tuple[str, int, int, int]] | None = None) -> Tables:
    """Tables read over JDBC.  ``partitioning[name] = (column, lower, upper,
    num_partitions)`` splits a large table into parallel range reads; small
    dimensions are read in one task."""
    out = {}
    for n in names:
        if partitioning and n in partitioning:
            col, lo, hi, parts = partitioning[n]
            out[n] = spark.read.jdbc(url, n, column=col, lowerBound=lo, upperBound=hi,
                                     numPartitions=parts, properties=dict(properties))
        else:
            out[n] = spark.read.jdbc(url, n, properties=dict(properties))
    return Tables(out)
