"""Absence and staleness."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _subsets(cols):
    for r in range(len(cols) + 1):
        yield from (frozenset(c) for c in combinations(cols, r))


def absent(df: DataFrame, other: DataFrame, keys: Sequence[str] | str,
           other_keys: Sequence[str] | str | None = None, null_aware: bool = True,
           not_null: Sequence[str] = (), other_not_null: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``.

    ``null_aware=True`` is SQL ``[NOT] IN`` with three-valued logic: a row is
    kept only if, for every row of ``other``, some key column is non-NULL on
    both sides and different.  So a NULL on the excluded side removes every
    row that agrees with it on the remaining columns (for one column: all
    rows), a NULL key in ``df`` is removed as soon as ``other`` has a row that
    does not contradict it, and nothing is removed when ``other`` is empty.

    One lazy plan of two equi-joins at most, whatever the number of keys.  The
    excluded keys are reduced to *entries*: which columns are NULL, which columns
    are compared, and their values.  Each distinct key of ``df`` asks for one entry
    per NULL pattern that ``other`` has (a scalar subquery counts them); the keys
    that find one are taken out by a NULL-safe anti join.  Key columns the caller
    has filtered to non-NULL are named in ``not_null`` (rows) and
    ``other_not_null`` (excluded side); if that is all of them, a plain anti join
    does.  (Spark's own multi-column ``NOT IN`` would be a nested-loop join.)
    ``null_aware=False`` is ``NOT EXISTS``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    okeys = keys if other_keys is None else ([other_keys] if isinstance(other_keys, str) else list(other_keys))
    o = other.select(*[F.col(ok).alias(f"__o{i}") for i, ok in enumerate(okeys)])
    plain = [F.col(k) == F.col(f"__o{i}") for i, k in enumerate(keys)]
    if not null_aware or (set(keys) <= set(not_null) and set(keys) <= set(other_not_null)):
        return df.join(o, plain, "left_anti")

    def mask(columns: Sequence[str], never: Sequence[str]) -> Column:
        """The NULL columns as bits; those named in ``never`` are known to be none."""
        bits = [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, (c, k) in enumerate(zip(columns, keys, strict=True)) if k not in never]
        return sum(bits, F.lit(0))

    def entry(columns: Sequence[str], nulls: Column, compared: Column) -> Column:
        """Values of the compared columns; both sides are cast to one type first."""
        return F.struct(nulls.alias("nulls"), compared.alias("compared"),
                        *[F.when(F.getbit(compared, F.lit(i)) == 1, F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)])

    def patterns(never: Sequence[str]) -> list[int]:
        free = [i for i, k in enumerate(keys) if k not in never]
        return [sum(1 << i for i in p) for p in _subsets(free)]

    everything = (1 << len(keys)) - 1
    own = df.select(*keys).distinct()
    # values of one key column have one type on both sides
    both = own.union(o)
    kinds = [both.schema.fields[i].dataType for i in range(len(keys))]
    own_cast, o_cast = [f"__x{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(keys))]
    asked = own.select(*keys, *[F.col(k).cast(t).alias(x) for k, t, x in zip(keys, kinds, own_cast, strict=True)])
    o = o.select(*[F.col(x).cast(t).alias(x) for t, x in zip(kinds, o_cast, strict=True)]).distinct().withColumn("__p", mask(o_cast, other_not_null))
    # an excluded key answers rows of every NULL pattern
    rows = [F.lit(everything & ~p) for p in patterns(not_null)]
    entries = (o.withColumn("__c", F.explode(F.array_distinct(F.transform(F.array(*rows), lambda r: r.bitwiseAND(F.lit(everything) - F.col("__p"))))))
                .select(entry(o_cast, F.col("__p"), F.col("__c")).alias("__e")).distinct())
    present = o.agg(F.collect_set("__p").alias("p"))          # one number per NULL pattern: 2^keys at most
    asked = (asked.withColumn("__p", F.explode(present.scalar()))
                  .withColumn("__c", (F.lit(everything) - F.col("__p")).bitwiseAND(F.lit(everything) - mask(own_cast, not_null))))
    found = asked.withColumn("__e", entry(own_cast, F.col("__p"), F.col("__c"))).join(entries.withColumnRenamed("__e", "__f"), F.col("__e").eqNullSafe(F.col("__f")), "left_semi")
    gone = found.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    return df.join(gone, same, "left_anti")


def absent_in_period(dim: DataFrame, fact: DataFrame, key: str, ts: str, start, end,
                     group: Sequence[str]) -> DataFrame:
    """Groups of ``dim`` with no ``fact`` row (joined on ``key``) whose
    day is in [start, end] -- the LEFT JOIN ... HAVING count = 0 pattern, as a
    semi/anti join at group level."""
    from binsight.operators.filters import in_days_expr
    hits = fact.filter(in_days_expr(ts, start, end)).select(key)
    active = dim.join(hits, on=key, how="left_semi").select(*[F.col(g).alias(f"__a{i}") for i, g in enumerate(group)]).distinct()
    same = F.lit(True)
    for i, g in enumerate(group):        # NULL is a group of its own, as in GROUP BY
        same = same & F.col(g).eqNullSafe(F.col(f"__a{i}"))
    return dim.join(active, same, "left_anti")


def last_seen(sources: Sequence[DataFrame], keys: Sequence[str], ts: str = "dataora",
              name: str = "ultimodato") -> DataFrame:
    """Per key, the newest ``ts`` over several sources.  Each source is
    pre-aggregated (partial aggregation), then the union is reduced again; a
    source without a row for a key simply does not contribute (``greatest``
    semantics, NULLs skipped)."""
    parts = [s.groupBy(*keys).agg(F.max(ts).alias(name)) for s in sources]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*keys).agg(F.max(name).alias(name))


def stale(df: DataFrame, ts: str, as_of, within_hours: float = 12.0) -> DataFrame:
    """Rows whose ``ts`` is neither on the day of ``as_of`` nor within
    ``within_hours`` before it."""
    from binsight.functions.pg import as_ts, day_start, interval_seconds, next_day_start
    t = F.col(ts)
    ref = as_ts(as_of)
    same_day = (t >= day_start(as_of)) & (t < next_day_start(as_of))
    recent = t.between((ref - interval_seconds(within_hours * 3600)).cast("timestamp_ntz"), ref)
    return df.filter(~same_day & ~recent)
