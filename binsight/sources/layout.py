"""Facts laid out for pruning: Parquet tables partitioned by municipality and
month and bucketed by tag.

``write_fact`` writes such a table, ``attach_fact`` registers its folder in a
session whose catalog does not know it, and ``from_layout`` hands the tables to
the reports.  A filter on the municipality prunes folders by itself; a period
does so through ``from_layout(period=...)``, since the month is derived from the
time.  Grouping or joining by the bucket column then needs no exchange on the
fact side.

Take at least ``spark.sql.shuffle.partitions`` buckets: Spark may shuffle a table of
fewer again to regain parallelism.  Each write task holds one bucket, so a table has at most months x municipalities
x buckets files.  A bucket is also one read task wherever buckets are used, so a
column whose most frequent value holds more than ``hot`` average buckets (counted
over all rows, null included) is not bucketed: rows then spread freely and AQE
splits the skewed key.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binsight.functions.pg import as_ts, next_day_start
from binsight.sources.bindings import Tables

MONTH = "mese"


def _month(ts) -> Column:
    """First day of the month of a time (null for a null time)."""
    return F.trunc(ts, "month")


def is_hot(df: DataFrame, key: str, buckets: int, hot: float = 4.0) -> bool:
    """Whether the most frequent value of ``key`` holds more than ``hot`` average buckets."""
    r = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    return bool(r.rows) and r.most * buckets > hot * r.rows


def write_fact(df: DataFrame, name: str, path: str, ts: str = "dataora", place: str = "idcomune", key: str = "codicetag",
               buckets: int = 64, hot: float = 4.0) -> bool:
    """Write ``df`` as table ``name`` in ``path``, which must be new; returns
    whether it is bucketed.  ``mese`` is added and must not be a column yet."""
    if MONTH in df.columns:
        raise ValueError(f"the table has a column {MONTH} already")
    bucketed = not is_hot(df, key, buckets, hot)
    rows = df.withColumn(MONTH, _month(ts))
    # one task a bucket (the same hash), or a folder's rows spread over a few tasks
    rows = rows.repartition(buckets, key) if bucketed else rows.repartition(place, MONTH, F.pmod(F.xxhash64(ts, key), F.lit(8)))
    w = rows.write.format("parquet").option("path", path).mode("errorifexists").partitionBy(place, MONTH)
    (w.bucketBy(buckets, key).sortBy(key) if bucketed else w).saveAsTable(name)
    return bucketed


def attach_fact(spark: SparkSession, name: str, path: str, schema: str, place: str = "idcomune", key: str = "codicetag",
                buckets: int | None = 64) -> DataFrame:
    """Register a written folder; ``schema`` is the table's DDL with ``mese`` and
    ``buckets`` what it was written with (None if ``write_fact`` returned False)."""
    clustered = f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if buckets else ""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY ({place}, {MONTH}) {clustered} LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def in_months(df: DataFrame, start, end) -> DataFrame:
    """Rows of the months that the days ``start``..``end`` touch, the end's next
    midnight included; whole folders, so the report's own filter still applies."""
    return df.where((F.col(MONTH) >= _month(as_ts(start))) & (F.col(MONTH) <= _month(next_day_start(end))))


def from_layout(spark: SparkSession, facts: Mapping[str, str], dimensions: Tables | Mapping[str, DataFrame], period: tuple | None = None,
                in_period: Iterable[str] | None = None) -> Tables:
    """Tables for the reports: ``facts`` (domain name -> table name) beside
    ``dimensions``.  With ``period`` = (start, end) the facts named in ``in_period``
    (all by default) are read from its months only: for reports that look at nothing
    outside their period."""
    pruned = set(facts if in_period is None else in_period)
    out = Tables({n: dimensions[n] for n in dimensions})
    for domain, name in facts.items():
        df = spark.table(name)
        if period is not None and domain in pruned:
            df = in_months(df, *period)
        out[domain] = df.drop(MONTH)
    return out
