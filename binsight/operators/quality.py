"""Duplicate detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_duplicates(df: DataFrame, keys: Sequence[str], id_col: str = "id",
                     sep: str = " ", min_count: int = 2) -> DataFrame:
    """Groups of rows equal on ``keys`` seen at least ``min_count`` times,
    with the count and the ids joined in ascending order.

    Fingerprints of the keys are counted first (one long and one count a
    fingerprint after map-side combine).  Only rows whose fingerprint repeats go on
    to the grouping by the full key, which lists their ids; a fingerprint that
    different keys share is told apart there.  The repeated fingerprints are few
    where duplicates are the exception, and Spark then sends them to the rows
    (a broadcast of checked size); otherwise both sides meet by fingerprint.
    """
    code = F.xxhash64(*keys)
    repeated = (df.groupBy(code.alias("__code")).agg(F.count(id_col).alias("__n")).filter(F.col("__n") >= min_count).select("__code"))
    rows = df.join(repeated, code == F.col("__code"), "left_semi")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(id_col)), lambda x: x.cast("string")), sep)
    return (rows.groupBy(*keys).agg(F.count(id_col).alias("conteggio"), ids.alias("stringaid"))
                .filter(F.col("conteggio") >= min_count))


def duplicate_summary(df: DataFrame, key: str | Sequence[str], measures: dict,
                      min_count: int | None = None, count_name: str = "n") -> DataFrame:
    """Per key, a count plus arbitrary aggregate measures; optional HAVING
    ``count >= min_count``."""
    keys = [key] if isinstance(key, str) else list(key)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name),
                                *[expr.alias(name) for name, expr in measures.items()])
    if min_count is not None:
        out = out.filter(F.col(count_name) >= min_count)
    return out
