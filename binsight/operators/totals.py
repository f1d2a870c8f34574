"""Totals and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.functions.pg import col, exact, truncated_ratio

# --- fixed values -------------------------------------------------------------
# Waste-type code -> output column of the category sheets, in report order.
CATEGORY_COLUMNS = {
    0: "indifferenziato",
    17: "pannolini",
    16: "barattolame",
    3: "plastica",
    1: "carta",
    15: "vetro",
    2: "vetroelatta",
    4: "organico",
}
# ------------------------------------------------------------------------------


def category_sums(cat: str, value: str, mapping: Mapping[int, str] = CATEGORY_COLUMNS,
                  empty_as_zero: bool = False) -> list[Column]:
    """O11 building block: ``SUM(CASE WHEN cat = code THEN value END) AS name``
    for each ``code: name`` -- a pivot with a fixed value list, evaluated in
    one pass with partial aggregation.  An empty category is NULL unless
    ``empty_as_zero`` (``ELSE 0``)."""
    out = []
    for code, name in mapping.items():
        v = F.when(F.col(cat) == code, F.col(value))
        if empty_as_zero:
            v = v.otherwise(F.lit(0))
        out.append(F.sum(v).alias(name))
    return out


def category_totals(df: DataFrame, keys: Sequence[str], cat: str, value: str,
                    mapping: Mapping[int, str] = CATEGORY_COLUMNS, sorted_min: int | None = 0,
                    empty_as_zero: bool = False, extra: Sequence[Column] = ()) -> DataFrame:
    """One wide row per key: total of ``value`` per category, the total of
    all categories with code > ``sorted_min`` (``diff``), and the grand total."""
    aggs = [*extra, *category_sums(cat, value, mapping, empty_as_zero)]
    if sorted_min is not None:
        aggs.append(F.sum(F.when(F.col(cat) > sorted_min, F.col(value))).alias("diff"))
    aggs.append(F.sum(value).alias("totpeso"))
    return df.groupBy(*keys).agg(*aggs)


def sorted_share(total, unsorted) -> Column:
    """Percentage of the total that is not unsorted, truncated toward
    zero to 2 decimals in exact arithmetic; 0 when nothing was sorted (``x =
    NULL`` never holds, so a NULL difference yields NULL)."""
    diff = exact(total) - exact(unsorted)
    return F.when(diff == 0, F.lit(0).cast("decimal(38,2)")).otherwise(truncated_ratio(diff, total, 100, 2))


def pct_of_total(df: DataFrame, keys: Sequence[str], value: str, pct: str = "percent",
                 tot: str = "tot", type_: str | None = None) -> DataFrame:
    """Each row's share of its key's total (and the total itself, as
    ``type_`` if given), via a grouped aggregate joined back on the keys (NULL
    is a key of its own)."""
    total = F.sum(value).cast(type_) if type_ else F.sum(value)
    totals = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(total.alias(tot))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (df.join(totals, same).drop(*[f"__k{i}" for i in range(len(keys))])
              .withColumn(pct, F.when(F.col(tot) != 0, F.col(value) / F.col(tot) * 100)))


def roll_counter(printed, size) -> tuple[Column, Column]:
    """Labels printed on the current roll and labels left on it, for a
    roll of ``size`` labels after ``printed`` prints in total.  (The original
    ``div``-based CASE reduces to the truncated remainder for any sign.)"""
    printed, size = col(printed), col(size)
    used = printed % size
    return used, size - used


def period_counts(df: DataFrame, keys: Sequence[str], ts: str, spans: Mapping[str, tuple],
                  value: str | None = None, rows: Mapping[str, tuple] | None = None) -> DataFrame:
    """Per key, counts of rows (of non-NULL ``value``, if given) whose day
    falls in each named inclusive [first_day, last_day] span; ``rows`` names
    spans whose rows are counted whatever their value -- all in one scan and
    one aggregation."""
    from binsight.operators.filters import in_days_expr
    target = F.col(value) if value else F.lit(1)
    aggs = [F.count(F.when(in_days_expr(ts, a, b), target)).alias(name) for name, (a, b) in spans.items()]
    aggs += [F.count(F.when(in_days_expr(ts, a, b), F.lit(1))).alias(name) for name, (a, b) in (rows or {}).items()]
    every = [*spans.values(), *(rows or {}).values()]
    lo, hi = min(a for a, _ in every), max(b for _, b in every)
    return df.filter(in_days_expr(ts, lo, hi)).groupBy(*keys).agg(*aggs)


def averages_by(df: DataFrame, keys: Sequence[str], cols: Mapping[str, str],
                type_: str = "decimal(6,3)", extra: Mapping[str, Column] | None = None) -> DataFrame:
    """``CAST(AVG(col) AS type)`` per key (an overflowing average raises,
    as in SQL under ANSI mode), plus optional extra aggregates."""
    aggs = [F.avg(c).cast(type_).alias(name) for name, c in cols.items()]
    aggs += [e.alias(n) for n, e in (extra or {}).items()]
    return df.groupBy(*keys).agg(*aggs)


def dominant_signal(df: DataFrame, keys: Sequence[str], event: str, labels: Sequence[str],
                    name: str = "avviso", count_name: str = "segnalazioni",
                    extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Per key, which of two event labels occurs more often (ties go to
    the second) and how many times it occurred, with further aggregates
    (``extra``)."""
    a, b = labels
    ca = F.sum(F.when(F.col(event) == a, 1).otherwise(0))
    cb = F.sum(F.when(F.col(event) == b, 1).otherwise(0))
    return (df.groupBy(*keys).agg(ca.alias("__a"), cb.alias("__b"), *[e.alias(n) for n, e in (extra or {}).items()])
              .withColumn(name, F.when(F.col("__a") > F.col("__b"), F.lit(a)).otherwise(F.lit(b)))
              .withColumn(count_name, F.when(F.col("__a") > F.col("__b"), F.col("__a")).otherwise(F.col("__b")))
              .drop("__a", "__b"))


def active_inactive(dim: DataFrame, fact: DataFrame, key: str, ts: str, start, end,
                    measures: Mapping[str, Column], zero: Mapping[str, Column] | None = None,
                    always_idle: bool = False) -> DataFrame:
    """One row per ``dim`` row with facts in [start, end + 1 day]: the
    newest ``ts`` (``last_ts``) and the measures over them (active half), UNION
    zero rows with the newest ``ts`` ever for keys whose last fact is before
    ``start`` or that have none -- or for every key with ``always_idle``
    (inactive half).

    Facts are reduced to the wanted keys (semi join) and aggregated per key
    before the join; both halves come from the one joined row."""
    from binsight.functions.pg import as_ts, next_day_start
    wanted = dim.select(key).distinct()
    inside = F.col(ts).between(as_ts(start), next_day_start(end))
    win = (fact.filter(inside).join(wanted, key, "left_semi").groupBy(key)
               .agg(F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("__n"), *[e.alias(n) for n, e in measures.items()]))
    ever = fact.join(wanted, key, "left_semi").groupBy(key).agg(F.max(ts).alias("__ever"))
    zero = zero or {n: F.lit(0) for n in measures}
    idle = F.lit(True) if always_idle else (F.col("__ever") < as_ts(start)) | F.col("__ever").isNull()
    act = F.struct("last_ts", *measures)
    none = F.struct(F.col("__ever").alias("last_ts"), *[zero[n].alias(n) for n in measures])
    halves = F.filter(F.array(F.when(F.col("__n") > 0, act), F.when(idle, none)), lambda x: x.isNotNull())
    j = dim.join(win, key, "left").join(ever, key, "left")
    return j.select(*dim.columns, F.explode(halves).alias("__h")).select(*dim.columns, "__h.*").distinct()


def per_group_population(fact: DataFrame, bridge: DataFrame, key: str | Sequence[str], group: Sequence[str],
                         pre: Mapping[str, Column], post: Mapping[str, Column]) -> DataFrame:
    """Pre-aggregate ``fact`` per ``key`` (``pre`` measures), attach it to
    ``bridge`` on the key columns that ``bridge`` has, and re-aggregate per
    group with ``post`` measures over the pre-aggregated columns."""
    keys = [key] if isinstance(key, str) else list(key)
    agg = fact.groupBy(*keys).agg(*[e.alias(n) for n, e in pre.items()])
    shared = [k for k in keys if k in bridge.columns]
    return bridge.join(agg, shared).groupBy(*group).agg(*[e.alias(n) for n, e in post.items()])
