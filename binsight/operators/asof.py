"""As-of join of two tables: for every left row the nearest right row of the same
key, before or after it in time.

Both sides are merged into one ordered :class:`~binsight.operators.sequence.Sequence`
and the right rows are carried along it (last non-NULL value), so the join costs
one shuffle of both sides, and a key that holds a third of all rows is spread
over many ranges.  A plain join on the key with an aggregation on top would
compare every left row with every right row of its key.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.functions.pg import interval_seconds, micros_between
from binsight.operators.sequence import Running, Sequence


def asof_join(left: DataFrame, right: DataFrame, on: Seq[str], left_ts: str, right_ts: str, right_cols: Seq[str],
              direction: str = "backward", allow_equal: bool = True, tie: Seq[str] = (), tolerance_seconds: float | None = None,
              partitions: int | None = None, like: DataFrame | None = None) -> DataFrame:
    """Every row of ``left`` with ``right_cols`` of the right row that has the same
    ``on`` columns and the latest time at or before (``direction="forward"``: the
    earliest time at or after) the left row's; NULLs where there is none.

    ``allow_equal=False`` leaves out equal times, ``tolerance_seconds`` what is further
    away.  Among right rows of the same key and time the one with the largest ``tie``
    columns counts (by default the largest ``right_cols``).  A NULL key or time, on
    either side, matches nothing; every left row is kept once, repeated ones too.
    The names of ``right_cols`` must not occur in ``left``.  ``like``: rows with the
    columns of ``left`` and about the same keys and times, which the ranges are cut by
    where ``left`` is costly to read more than once.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    clash = set(right_cols) & set(left.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    back = direction == "backward"
    # at equal times the side that must be read first
    right_first = allow_equal
    usable = F.col(right_ts).isNotNull()
    for c in on:
        usable = usable & F.col(c).isNotNull()
    ties = list(tie) or list(right_cols)
    keys = [f"__k{i}" for i in range(len(on))]

    def at(ts: str) -> Column:
        since = micros_between(F.col(ts), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        return since if back else -since

    def asked(df: DataFrame) -> DataFrame:
        # left rows have no order of their own at one time; their hash tells them apart
        return df.select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], at(left_ts).alias("__t"),
                         F.lit(1 if right_first else 0).alias("__side"), F.xxhash64(*left.columns).alias("__h"),
                         F.struct(*[F.col(c) for c in left.columns]).alias("__l"))

    found = right.filter(usable).select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], at(right_ts).alias("__t"),
                                        F.lit(0 if right_first else 1).alias("__side"), F.lit(0).cast("long").alias("__h"),
                                        F.struct(F.col(right_ts).alias("__rt"), *[F.col(c) for c in right_cols]).alias("__r"),
                                        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(ties)]).alias("__tie"))
    order = ["__t", "__side", "__tie", "__h"]
    both = asked(left).unionByName(found, allowMissingColumns=True)
    cut_by = None if like is None else asked(like).unionByName(found, allowMissingColumns=True).select(*keys, *order)
    seq = Sequence(both, order=order, by=keys, partitions=partitions, like=cut_by)
    out = seq.apply([Running("__m", F.col("__r"), "last_nonnull")]).result().filter(F.col("__l").isNotNull())
    match = F.when(F.col("__t").isNotNull(), F.col("__m"))
    if tolerance_seconds is not None:
        away, near = F.col(f"__l.{left_ts}"), F.col("__m.__rt")
        late, early = (away, near) if back else (near, away)
        match = F.when(late <= early + interval_seconds(tolerance_seconds), match)
    return (out.withColumn("__m", match)
               .select(*[F.col(f"__l.`{c}`").alias(c) for c in left.columns], *[F.col(f"__m.`{c}`").alias(c) for c in right_cols]))
