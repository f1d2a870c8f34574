"""Interval matching (O17) and the wrong-bin detector.

An interval join ``right.ts BETWEEN left.ts + lo AND left.ts + hi`` on top of
an equi key leaves a quadratic residue per key (every event of a station
against every other).  Here time is cut into buckets of width ``hi - lo``;
the left side is replicated into the (at most two) buckets its window
touches, the right side sits in exactly one bucket, the bucket joins the
equi key, and the exact bound is re-checked.  Each matching pair is produced
once, the join stays a hash/sort-merge join, and a hot station is split over
its time buckets.  ``split`` cuts the buckets finer, for keys that are dense
within one window: a cell holds that many times fewer rows of the right side,
and the left side is replicated into ``split`` + 1 buckets at most.

Where only the first match of a left row counts (``DISTINCT ON`` the left row,
ordered by the right time) ``first=True`` sorts both sides of a bucket once and
carries the nearest right row along, so a dense (key, bucket) costs its rows and
not their product.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binsight.functions.pg import interval_seconds, seconds_between

WINDOWS_PER_BUCKET = 4  # width of a bucket with first=True: about one right row in four is in two buckets


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 for a TIMESTAMP_NTZ (zone independent:
    NTZ subtraction, never a session-time-zone conversion)."""
    return F.floor(seconds_between(ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))).cast("long")


def total_seconds(x) -> float:
    return x.total_seconds() if isinstance(x, dt.timedelta) else float(x)


def interval_match(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                   left_ts: str, right_ts: str, lo, hi, split: int = 1, first: bool = False) -> DataFrame:
    """Pairs with equal keys and ``left_ts + lo <= right_ts <= left_ts + hi``
    (``lo``/``hi`` in seconds or timedeltas, ``lo <= hi``).  Column names of
    the two sides must be distinct.  ``first=True`` keeps of each left row's pairs
    the one with the smallest ``right_ts`` (then the smallest right row)."""
    lo_s, hi_s = total_seconds(lo), total_seconds(hi)
    if first:
        return _first_match(left, right, left_keys, right_keys, left_ts, right_ts, lo_s, hi_s, split)
    width = max(int(hi_s - lo_s) // max(split, 1), 1)
    lb = F.floor((epoch_seconds(F.col(left_ts)) + F.lit(int(lo_s // 1))) / width)
    hb = F.floor((epoch_seconds(F.col(left_ts)) + F.lit(int(-(-hi_s // 1)))) / width)
    l2 = left.withColumn("__b", F.explode(F.sequence(lb, hb)))
    r2 = right.withColumn("__b", F.floor(epoch_seconds(F.col(right_ts)) / width))
    cond = [l2["__b"] == r2["__b"]] + [l2[a] == r2[b] for a, b in zip(left_keys, right_keys)]
    j = l2.join(r2, cond, "inner")
    lo_c, hi_c = interval_seconds(lo_s), interval_seconds(hi_s)
    j = j.filter(F.col(right_ts).between(F.col(left_ts) + lo_c, F.col(left_ts) + hi_c))
    return j.drop(l2["__b"]).drop(r2["__b"])


def _first_match(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str],
                 left_ts: str, right_ts: str, lo_s: float, hi_s: float, split: int) -> DataFrame:
    """Both sides of a (key, bucket) from late to early: the last right row seen is
    the earliest one at or after the start of a left row's window.  A left row is in
    the bucket its window starts in, a right row in every bucket it can be seen from."""
    keys = [f"__k{i}" for i in range(len(left_keys))]
    width = max(int(hi_s - lo_s) * WINDOWS_PER_BUCKET // max(split, 1), 1)
    starts = F.col(left_ts) + interval_seconds(lo_s)
    at = F.col(right_ts)
    earliest = F.floor(epoch_seconds(at - interval_seconds(hi_s - lo_s + 1e-6)) / width)
    usable = lambda names: reduce(and_, [F.col(c).isNotNull() for c in names])
    asked = left.filter(usable([*left_keys, left_ts])).select(
        *[F.col(c).alias(k) for c, k in zip(left_keys, keys)], F.floor(epoch_seconds(starts) / width).alias("__b"),
        starts.alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    offered = right.filter(usable([*right_keys, right_ts])).select(
        *[F.col(c).alias(k) for c, k in zip(right_keys, keys)],
        F.explode(F.sequence(earliest, F.floor(epoch_seconds(at) / width))).alias("__b"),
        at.alias("__at"), F.lit(0).alias("__side"), F.struct(*right.columns).alias("__r"))
    late_first = (Window.partitionBy(*keys, "__b").orderBy(F.col("__at").desc(), "__side", F.col("__r").desc())
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = offered.unionByName(asked, allowMissingColumns=True)
    seen = both.withColumn("__m", F.last("__r", ignorenulls=True).over(late_first)).filter(F.col("__side") == 1)
    near = seen.filter(F.col(f"__m.`{right_ts}`") <= F.col(f"__l.`{left_ts}`") + interval_seconds(hi_s))
    return near.select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(c) for c in right.columns])
