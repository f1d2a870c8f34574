"""Sequence operators: LAG, running aggregates and the reports built on them.

Skew-proof ordered windows
--------------------------
``Window.partitionBy(station).orderBy(ts)`` puts every row of a station into
one task, and a window with no partition (the global ``LAG(x) OVER (ORDER BY
ts)`` several reports use) puts the *whole table* into one task.  Neither
survives a station that holds a third of the rows.

:class:`Sequence` instead splits the rows into ranges of ``by + order``, so a
hot station is spread over many ranges, and evaluates every window inside each
range.  The range of a row is a deterministic expression: the number of range
bounds that are not above its key.  The bounds are quantiles of the rows whose
key hash is below a threshold (a fixed uniform sample, ``SAMPLE_PER_RANGE`` rows
per range, see :func:`range_bounds`) and come from a scalar subquery, so nothing
runs while a report is built, and a recomputed task finds the same ranges.  The rows are shuffled
once, straight to the partition of their range; every later window and
summary is partitioned by the range id and needs no further shuffle.

The only rows that see the wrong neighbour are the first rows of each range;
they get the missing state from a *carry table* with one row per range (so its
size is bounded by the number of ranges, never by the data) that is built with
a tiny window over the per-range summaries and broadcast back.

The groups given to :meth:`Sequence.lag` / :meth:`Sequence.running` must be
contiguous in the sequence order (a prefix of ``by + order`` columns, or a
column that is constant over runs of that order, such as an island id from a
running count).
"""

from __future__ import annotations

import math
from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RP = "__rp"  # range partition id
SAMPLE_PER_RANGE = 64  # rows that decide about the bounds, for each range
_ONE_STEP = 64  # up to so many ranges are cut in one step, from 4,096 rows

_RUN_LOCAL = {
    "sum": F.sum,
    "count": F.count,
    "first": lambda c: F.first(c, ignorenulls=False),
    "first_nonnull": lambda c: F.first(c, ignorenulls=True),
    "last_nonnull": lambda c: F.last(c, ignorenulls=True),
}
# how the per-range values of earlier ranges combine into an offset
_RUN_CARRY = {"sum": F.sum, "count": F.sum, "first": _RUN_LOCAL["first"],
              "first_nonnull": _RUN_LOCAL["first_nonnull"], "last_nonnull": _RUN_LOCAL["last_nonnull"]}


class Lag:
    """Previous-row value of ``expr`` within ``group`` (default: the sequence's ``by``)."""

    def __init__(self, name: str, expr, group=None):
        self.name, self.expr, self.group = name, expr, group


class Running:
    """Running aggregate of ``expr`` within ``group``; ``how`` in sum, count,
    first, first_nonnull, last_nonnull.  ``exclusive=True`` (last_nonnull
    only) stops at the previous row: the last non-NULL value *before* the
    current row, e.g. the time of the previous row that satisfies a
    condition (``when(cond, ts)``)."""

    def __init__(self, name: str, expr, how: str = "sum", group=None, exclusive: bool = False):
        if how not in _RUN_LOCAL:
            raise ValueError(how)
        if exclusive and how != "last_nonnull":
            raise ValueError("exclusive is only defined for last_nonnull")
        self.name, self.expr, self.how, self.group, self.exclusive = name, expr, how, group, exclusive


def n_ranges(df: DataFrame, partitions: int | None = None) -> int:
    """Number of ranges: explicit, else spark.sql.shuffle.partitions, else
    (for a non-numeric setting) the context's default parallelism."""
    if partitions:
        return int(partitions)
    value = df.sparkSession.conf.get("spark.sql.shuffle.partitions", None)
    try:
        return max(int(value), 1)
    except (TypeError, ValueError):
        return max(df.sparkSession.sparkContext.defaultParallelism, 1)


def _quantiles(rows: Column, parts: Column | int) -> Column:
    """The elements of a sorted array that cut it into ``parts`` equal parts."""
    parts = F.lit(parts) if isinstance(parts, int) else parts
    cuts = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get(rows, F.floor(i * F.size(rows) / parts).cast("int")))
    return F.when((parts > 1) & (F.size(rows) > 0), cuts).otherwise(F.slice(rows, 1, 0))


def range_bounds(df: DataFrame, keys: Seq[str], n: int, hashed: str | None = None) -> Column:
    """At most ``n - 1`` ascending key structs that cut the rows of ``df`` into
    ranges of about equal size, as a scalar subquery.

    The rows whose hash (of the keys, or the long column ``hashed``) is below a
    threshold are a uniform sample; the threshold follows from the number of rows,
    so the sample has ``SAMPLE_PER_RANGE`` rows a range however large the table is.
    Many ranges are cut in two steps: some ``sqrt(n)`` coarse ranges from a smaller
    sample, then each of them by a task of its own, so no task holds more than
    about ``SAMPLE_PER_RANGE * sqrt(n)`` keys and one array has a key a range.
    """
    code = F.xxhash64(*keys) if hashed is None else F.col(hashed)
    rows = df.select(F.struct(*[F.col(k) for k in keys]).alias("k"), F.shiftrightunsigned(code, 33).alias("u"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()

    def sample(size: int) -> DataFrame:
        return rows.filter(F.col("u") < F.lit(size * 2.0 ** 31) / F.greatest(total, F.lit(1)))

    # sets: rows of equal keys are taken all or none, and count once
    held = F.array_sort(F.collect_set("k"))
    if n <= _ONE_STEP:
        return sample(SAMPLE_PER_RANGE * n).agg(held.alias("s")).select(_quantiles(F.col("s"), n).alias("b")).scalar()
    step = math.ceil(math.sqrt(n))
    groups = math.ceil(n / step)
    cuts = F.transform(F.sequence(F.lit(1), F.lit(groups - 1)), lambda j: F.get("s", F.floor(j * step * F.size("s") / n).cast("int")))
    coarse = (sample(SAMPLE_PER_RANGE * groups).agg(held.alias("s"))
              .select(F.when(F.size("s") > 0, cuts).otherwise(F.slice("s", 1, 0)).alias("b")))
    fine = (sample(SAMPLE_PER_RANGE * n).withColumn("__bounds", coarse.scalar())
            .withColumn("c", range_id("__bounds", F.col("k"), groups)).drop("__bounds").groupBy("c").agg(held.alias("s"))
            .select(_quantiles(F.col("s"), F.least(F.lit(step), F.lit(n) - F.col("c") * step)).alias("b")))
    inner = fine.agg(F.flatten(F.collect_list("b")).alias("b"))
    return inner.withColumn("c", coarse.scalar()).select(F.array_sort(F.concat("c", "b")).alias("b")).scalar()


def _steps(n: int) -> list[int]:
    return [1 << i for i in reversed(range(max(n - 1, 1).bit_length()))]


def range_id(bounds: str, key: Column, n: int) -> Column:
    """How many of the at most ``n - 1`` ascending ``bounds`` (a column) are not above
    ``key``: a binary search."""
    steps = F.array(*[F.lit(step) for step in _steps(n)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= key, at + step).otherwise(at))


def _with_range_id(df: DataFrame, keys: Seq[str], n: int, like: DataFrame | None = None) -> DataFrame:
    """``df`` with the number of each row's range: 0 to ``n - 1``, ascending with
    the keys (nulls first)."""
    if n == 1:
        return df.withColumn(RP, F.lit(0))
    out = (df.withColumn("__bounds", range_bounds(df if like is None else like, keys, n))
             .withColumn("__key", F.struct(*[F.col(k) for k in keys])).withColumn(RP, F.lit(0)))
    # range_id's search with a column a step, which Spark compiles
    for step in _steps(n):
        out = out.withColumn(RP, F.col(RP) + F.when(F.get("__bounds", F.col(RP) + (step - 1)) <= F.col("__key"), step).otherwise(0))
    return out.drop("__bounds", "__key")


class Sequence:
    """Rows of ``df`` in the total order ``by + order`` (ties must be broken by
    the caller, e.g. by appending an id).  ``like``: rows with the same key columns
    and about the same distribution, from which the bounds are taken instead, where
    ``df`` is costly to read more than once."""

    def __init__(self, df: DataFrame, order: Seq[str], by: Seq[str] = (),
                 partitions: int | None = None, like: DataFrame | None = None, _ranged: DataFrame | None = None, _depth: int = 0):
        self.order = list(order)
        self.by = list(by)
        self.keys = [*self.by, *self.order]
        self.n = n_ranges(df, partitions)
        if _ranged is None:
            _ranged = _with_range_id(df, self.keys, self.n, like).repartitionById(self.n, RP)
        self.df, self.depth = _ranged, _depth

    def _with(self, df: DataFrame, more_order: Seq[str] = ()) -> "Sequence":
        """The same ranges over other rows made of this sequence's rows (filtered,
        exploded, with more columns); ``more_order`` breaks ties among them."""
        return Sequence(df, [*self.order, *more_order], self.by, self.n, _ranged=df, _depth=self.depth)

    # -- one step = several window ops sharing one summary and one carry join --
    def lag(self, columns: dict[str, Column | str], group: Seq[str] | None = None) -> "Sequence":
        """Add ``name = value of expr on the previous row of the same group``
        (NULL on the group's first row), for each ``name: expr``."""
        return self.apply([Lag(name, e, group) for name, e in columns.items()])

    def running(self, name: str, expr: Column | str, how: str = "sum",
                group: Seq[str] | None = None) -> "Sequence":
        """Running aggregate from the group's first row up to the current row.

        ``how``: ``sum`` (NULLs skipped; NULL until the first non-NULL, like SQL),
        ``count`` (non-NULL values; 0 before the first), ``first`` (value on the
        group's first row), ``first_nonnull`` (first non-NULL value so far).
        """
        return self.apply([Running(name, expr, how, group)])

    def apply(self, ops: Seq["Lag | Running"], whole: bool = False) -> "Sequence":
        """Evaluate independent lag / running ops in one pass: local windows
        inside each range, one per-range summary (max_by / min_by on the
        sequence key, no shuffle: the data are already partitioned by range),
        one small carry table (one row per range), one broadcast join.

        ``whole`` keeps each range's whole last row in the summary.  Summary and
        result then read the same columns, so Spark runs the exchange below them
        once, where otherwise each has one of its own with all that is before it
        (for rows whose columns the result returns)."""
        keys = [F.col(k).asc_nulls_first() for k in self.keys]
        order_key = F.struct(*[F.col(k) for k in self.keys])
        w_rp = Window.partitionBy(RP).orderBy(*keys)
        # a step reads its rows twice (summary and result); after two steps an
        # exchange to the same partitions keeps that from doubling once more
        df = self.df if self.depth < 2 else self.df.repartitionById(self.n, RP)
        xs, last_fields, first_fields = {}, [F.lit(1).alias("one")], []
        local = {"__lp_one": F.lag(F.lit(1)).over(w_rp)}
        for i, op in enumerate(ops):
            group = list(self.by if op.group is None else op.group)
            e = F.col(op.expr) if isinstance(op.expr, str) else op.expr
            xs[f"__x{i}"] = e
            xs[f"__g{i}"] = F.struct(*[F.col(g) for g in group]) if group else F.lit(0)
            if isinstance(op, Lag):
                local[f"__lx{i}"] = F.lag(f"__x{i}").over(w_rp)
                local[f"__lg{i}"] = F.lag(f"__g{i}").over(w_rp)
                last_fields += [F.col(f"__x{i}").alias(f"x{i}"), F.col(f"__g{i}").alias(f"g{i}")]
            else:
                w = Window.partitionBy(RP, *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding,
                                                                               Window.currentRow)
                local[f"__loc{i}"] = _RUN_LOCAL[op.how](f"__x{i}").over(w)
                if op.exclusive:
                    wx = Window.partitionBy(RP, *group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
                    local[f"__lex{i}"] = _RUN_LOCAL[op.how](f"__x{i}").over(wx)
                last_fields += [F.col(f"__g{i}").alias(f"g{i}"), F.col(f"__loc{i}").alias(f"t{i}")]
                first_fields += [F.col(f"__g{i}").alias(f"g{i}")]
        if whole:
            last_fields.append(F.struct(*[F.col(c) for c in df.columns]).alias("row"))
        loc = df.withColumns(xs).withColumns(local)
        summary = loc.groupBy(RP).agg(
            F.max_by(F.struct(*last_fields), order_key).alias("L"),
            F.min_by(F.struct(*(first_fields or [F.lit(0).alias("z")])), order_key).alias("F"))
        wo = Window.orderBy(RP)
        cums = {}
        for i, op in enumerate(ops):
            if isinstance(op, Running):
                # groups are contiguous: the first group of a range continues from
                # earlier ranges iff it equals the previous range's last group
                wl = Window.partitionBy(F.col(f"L.g{i}")).orderBy(RP).rowsBetween(Window.unboundedPreceding,
                                                                                   Window.currentRow)
                cums[f"cum{i}"] = _RUN_CARRY[op.how](f"L.t{i}").over(wl)
        summary = summary.withColumns(cums) if cums else summary
        carry_cols = [F.col(RP), F.lag(F.col("L.one")).over(wo).alias("c_one")]
        for i, op in enumerate(ops):
            if isinstance(op, Lag):
                carry_cols += [F.lag(f"L.x{i}").over(wo).alias(f"c_x{i}"), F.lag(f"L.g{i}").over(wo).alias(f"c_g{i}")]
            else:
                carry_cols += [F.col(f"F.g{i}").alias(f"c_f{i}"), F.lag(f"L.g{i}").over(wo).alias(f"c_pl{i}"),
                               F.lag(f"cum{i}").over(wo).alias(f"c_cum{i}")]
        carry = summary.select(*carry_cols)
        # one row per range: bounded by the partition count, never by the data
        j = loc.join(F.broadcast(carry), RP, "left")
        first_in_range = F.col("__lp_one").isNull()
        out = {}
        for i, op in enumerate(ops):
            if isinstance(op, Lag):
                prev_x = F.when(first_in_range, F.col(f"c_x{i}")).otherwise(F.col(f"__lx{i}"))
                prev_g = F.when(first_in_range, F.col(f"c_g{i}")).otherwise(F.col(f"__lg{i}"))
                has_prev = (F.when(first_in_range, F.col("c_one")).otherwise(F.col("__lp_one")).isNotNull()
                            & prev_g.eqNullSafe(F.col(f"__g{i}")))
                out[op.name] = F.when(has_prev, prev_x)
            else:
                cont = (F.coalesce(F.col(f"c_pl{i}").eqNullSafe(F.col(f"c_f{i}")), F.lit(False))
                        & F.col(f"__g{i}").eqNullSafe(F.col(f"c_f{i}")))
                loc_v, off = F.col(f"__loc{i}"), F.col(f"c_cum{i}")
                if op.how in ("sum", "count"):
                    v = F.when(cont & off.isNotNull(), F.coalesce(loc_v, F.lit(0)) + off).otherwise(loc_v)
                    out[op.name] = v.cast("long") if op.how == "count" else v
                elif op.how == "first":
                    out[op.name] = F.when(cont, off).otherwise(loc_v)
                elif op.how == "first_nonnull":
                    out[op.name] = F.when(cont, F.coalesce(off, loc_v)).otherwise(loc_v)
                else:  # last_nonnull: the range's own value wins, earlier ranges fill in
                    own = F.col(f"__lex{i}") if op.exclusive else loc_v
                    out[op.name] = F.when(cont, F.coalesce(own, off)).otherwise(own)
        res = j.withColumns(out)
        drop = [c for c in res.columns if c.startswith("__") and c not in self.df.columns and c not in out] + \
               [c for c in carry.columns if c != RP]
        return Sequence(self.df, self.order, self.by, self.n, _ranged=res.drop(*drop),
                        _depth=self.depth + 1 if self.depth < 2 else 1)

    def row_number(self, name: str, group: Seq[str] | None = None) -> "Sequence":
        return self.running(name, F.lit(1), "count", group)

    def result(self) -> DataFrame:
        return self.df.drop(RP)


def ordered_lag(df: DataFrame, columns: dict[str, Column | str], order: Seq[str],
                by: Seq[str] = (), partitions: int | None = None) -> DataFrame:
    """``LAG(expr) OVER (PARTITION BY by ORDER BY order)`` for each
    ``name: expr``; with ``by=()`` the global (unpartitioned) LAG, computed
    without moving the table into one partition."""
    return Sequence(df, order, by, partitions).lag(columns).result()


def running_aggregate(df: DataFrame, name: str, expr: Column | str, order: Seq[str],
                      by: Seq[str] = (), how: str = "sum", partitions: int | None = None) -> DataFrame:
    return Sequence(df, order, by, partitions).running(name, expr, how).result()


# -- generic sequence operators (column names are parameters) -------------------

def debounce(df: DataFrame, keys: Seq[str], ts: str, gap_seconds: float, tie: Seq[str] = ("id",),
             keep_first: bool = True, partitions: int | None = None) -> DataFrame:
    """Keep rows that come more than ``gap_seconds`` after the previous
    row of the same key (the first row of a key is kept unless
    ``keep_first=False``)."""
    from binsight.functions.pg import interval_seconds
    out = Sequence(df, order=[ts, *tie], by=keys, partitions=partitions).lag({"__prev_ts": ts}).result()
    later = F.col(ts) > F.col("__prev_ts") + interval_seconds(gap_seconds)
    cond = (F.col("__prev_ts").isNull() | later) if keep_first else later
    return out.filter(cond).drop("__prev_ts")


def state_changes(df: DataFrame, keys: Seq[str], ts: str, state: str, tie: Seq[str] = ("id",),
                  keep_first: bool = True, partitions: int | None = None) -> DataFrame:
    """Rows whose ``state`` differs from the previous row's state at the
    same key (a NULL state is a state of its own), with the previous state in
    ``prev_state``.  A key's first row counts as a change unless
    ``keep_first=False``."""
    out = Sequence(df, order=[ts, *tie], by=keys, partitions=partitions).lag(
        {"prev_state": state, "__has_prev": F.lit(True)}).result()
    first = F.col("__has_prev").isNull()
    changed = ~F.col(state).eqNullSafe(F.col("prev_state"))
    return out.filter((first | changed) if keep_first else (~first & changed)).drop("__has_prev")


def stuck_values(df: DataFrame, keys: Seq[str], ts: str, value: str, min_repeats: int = 3,
                 tie: Seq[str] = ("id",), since=None, distinct_ts: bool = False, partitions: int | None = None) -> DataFrame:
    """Per key and value, how many rows repeated the previous row's value
    (only rows from ``since`` counted; the LAG sees all rows given) and the
    last time, for counts above ``min_repeats``; ``distinct_ts`` counts times."""
    from binsight.functions.pg import as_ts
    out = Sequence(df, order=[ts, *tie], by=keys, partitions=partitions).lag({"__pv": value}).result()
    rep = out.filter(F.col(value) == F.col("__pv"))
    if since is not None:
        rep = rep.filter(F.col(ts) >= as_ts(since))
    n = F.count_distinct(ts) if distinct_ts else F.count(F.lit(1))
    return (rep.groupBy(*keys, value).agg(n.alias("repeats"), F.max(ts).alias("last_ts"))
               .filter(F.col("repeats") > min_repeats))


def repeat_records(df: DataFrame, order: Seq[str], same: Seq[str], near: dict[str, float],
                   by: Seq[str] = (), partitions: int | None = None) -> DataFrame:
    """Rows that equal the previous row (in ``by + order``) on every
    ``same`` column and are within ``near[col]`` of it on every ``near``
    column (``diff_<col>`` = current - previous)."""
    lags = {f"__p_{c}": c for c in [*same, *near]}
    out = Sequence(df, order=order, by=by, partitions=partitions).lag(lags).result()
    cond = F.lit(True)
    for c in same:
        cond = cond & (F.col(c) == F.col(f"__p_{c}"))
    for c, eps in near.items():
        out = out.withColumn(f"diff_{c}", F.col(c) - F.col(f"__p_{c}"))
        cond = cond & (F.abs(F.col(f"diff_{c}")) < eps)
    return out.filter(cond).drop(*lags)


def phase_durations(df: DataFrame, keys: Seq[str], ts: str, state: str, tie: Seq[str] = ("id",),
                    partitions: int | None = None) -> DataFrame:
    """State changes with the seconds since the previous change
    (``phase_seconds``) and a running phase number per key."""
    from binsight.functions.pg import seconds_between
    ch = state_changes(df, keys, ts, state, tie, keep_first=True, partitions=partitions)
    seq = Sequence(ch, order=[ts, *tie], by=keys, partitions=partitions)
    seq = seq.apply([Lag("__prev_change", ts), Running("phase", F.lit(1), "count")])
    return (seq.result().withColumn("phase_seconds", seconds_between(ts, "__prev_change"))
               .drop("__prev_change"))


def first_per_key(df: DataFrame, keys: Seq[str], order: Seq[str], last: bool = False) -> DataFrame:
    """The first (or last) row per key by ``order`` -- ``DISTINCT ON``
    with an explicit tie-break.  An aggregation (``min_by``/``max_by`` on a
    struct), so it combines map-side and a hot key never sorts in one task."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order])).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*")
