"""Clock repair (O20): find deposits whose device clock jumped back, cut
the history into islands at each jump and propose rebuilt timestamps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions.pg import as_ts, interval_micros, interval_seconds, micros_between
from binsight.operators.sequence import Lag, Running, Sequence


def clock_repair(df: DataFrame, cutoff, keys=("idcomune", "codicestazione"), seq: str = "id",
                 ts: str = "dataora", restart_gap_seconds: float = 30.0, min_id: int | None = None,
                 valid: "F.Column | None" = None, only: Mapping | None = None, literal: bool = False) -> DataFrame:
    """O20.  Rows in (keys, seq) order, per station:

    * class 1 (``flag``): the clock went back (``ts`` < previous ``ts``);
    * class 0: forward step, ``ts`` after ``cutoff``, measured against the
      previous row that is also after the cutoff;
    * class 2: forward step, ``ts`` before ``cutoff``, measured against the
      previous row that is also before it.
    Class 1 wins over 0/2; steps of 0, rows at exactly the cutoff and first
    rows are not classified (dropped).  ``delta_dataora`` is the step in
    seconds (kept in whole microseconds until the output).  ``conteggio``
    numbers the islands of a station (its running count of jumps).  ``nuovadataora``: a jump right after a
    class-0 row becomes previous time + ``restart_gap_seconds``; a class-2 row
    right after a jump becomes previous time - previous step.
    ``nuovadataora2``: for class-2 rows, the rebuilt time carried along the
    island (after a jump: previous ``nuovadataora`` + step; after another
    class-2 row: the island's first class-2 ``nuovadataora`` + running sum of
    positive steps in the island).

    ``only`` (column: value) keeps one station; it is applied to the input,
    since nothing crosses stations.

    ``literal=True`` keeps the original construction: the steps are measured
    by LAGs over the global (keys, seq) order (a station's first row is
    compared with the previous station's last), the three classes are a
    UNION, so a record can be emitted twice (class 1 and class 0/2), the island
    counter runs over all stations and includes such twins as peers, and ``nuovadataora`` uses the
    global LAG.  Twins are ordered by class (the original order is arbitrary).  ``only``
    is applied after the steps that cross stations.
    """
    if literal:
        out = _clock_repair_literal(df, cutoff, list(keys), seq, ts, restart_gap_seconds, min_id, valid, only or {})
        for c, v in (only or {}).items():
            out = out.filter(F.col(c) == v)
        return out
    keys = list(keys)
    x = df
    for c, v in (only or {}).items():
        x = x.filter(F.col(c) == v)
    if valid is not None:
        x = x.filter(valid)
    cut = as_ts(cutoff)
    x = x.withColumn("__side", F.when(F.col(ts) > cut, 1).when(F.col(ts) < cut, -1).otherwise(0))
    # previous row at the station, and previous row on the same side of the
    # cutoff (= the last time seen on that side before this row): one pass
    first = Sequence(x, order=[seq], by=keys).apply([
        Lag("__prev_ts", ts),
        Running("__prev_pos", F.when(F.col("__side") == 1, F.col(ts)), "last_nonnull", exclusive=True),
        Running("__prev_neg", F.when(F.col("__side") == -1, F.col(ts)), "last_nonnull", exclusive=True)])
    side = (first.df
            .withColumn("__prev_side_ts", F.when(F.col("__side") == 1, F.col("__prev_pos"))
                                           .when(F.col("__side") == -1, F.col("__prev_neg")))
            .drop("__prev_pos", "__prev_neg"))
    d_all = micros_between(ts, "__prev_ts")
    d_side = micros_between(ts, "__prev_side_ts")
    riavvio = (F.when(d_all < 0, 1)
                .when((F.col("__side") == 1) & (d_side > 0), 0)
                .when((F.col("__side") == -1) & (d_side > 0), 2))
    c = (side.withColumn("riavvio", riavvio)
             .withColumn("delta_dataora", F.when(F.col("riavvio") == 1, d_all).otherwise(d_side))
             .withColumn("flag", F.col("riavvio") == 1)
             .filter(F.col("riavvio").isNotNull())
             .drop("__prev_ts", "__prev_side_ts", "__side"))
    if min_id is not None:
        c = c.filter(F.col(seq) > min_id)
    # the same ranges serve every remaining window: the island counter,
    # per-station lags, per-island lags and sums
    g = first._with(c)
    g = g.apply([Running("conteggio", F.when(F.col("flag"), F.lit(1)), "count"),
                 Lag("__pr", "riavvio"), Lag("__pts", ts), Lag("__pdelta", "delta_dataora")])
    gap = interval_seconds(restart_gap_seconds)
    nuova = (F.when((F.col("riavvio") == 1) & (F.col("__pr") == 0), F.col(f"__pts") + gap)
              .when((F.col("riavvio") == 2) & (F.col("__pr") == 1), F.col("__pts") - interval_micros(F.col("__pdelta"))))
    g = g._with(g.df.withColumn("nuovadataora", nuova.cast("timestamp_ntz")))
    island = [*keys, "conteggio"]
    first2 = F.when(F.col("riavvio") == 2, F.struct(F.col(seq).alias("s"), F.col("nuovadataora").alias("v")))
    g = g.apply([Lag("__pnuova", "nuovadataora", group=island),
                 Running("__first2", first2, "first_nonnull", group=island),
                 Running("__possum", F.when(F.col("delta_dataora") > 0, F.col("delta_dataora")), "sum", group=island)])
    z = g.result()
    nuova2 = (F.when((F.col("riavvio") == 2) & (F.col("__pr") == 1), F.col("__pnuova") + interval_micros(F.col("delta_dataora")))
               .when((F.col("riavvio") == 2) & (F.col("__pr") == 2),
                     F.col("__first2.v") + interval_micros(F.col("__possum"))))
    return (z.withColumn("nuovadataora2", nuova2.cast("timestamp_ntz"))
             .withColumn("idn", F.col(seq)).withColumn("delta_dataora", F.col("delta_dataora") / 1_000_000.0)
             .drop("__pr", "__pts", "__pdelta", "__pnuova", "__first2", "__possum"))


def _clock_repair_literal(df, cutoff, keys, seq, ts, restart_gap_seconds, min_id, valid, only):
    x = df if valid is None else df.filter(valid)
    cut = as_ts(cutoff)
    x = x.withColumn("__side", F.when(F.col(ts) > cut, 1).when(F.col(ts) < cut, -1).otherwise(0))
    # global LAG and global per-side LAG (as last time seen on the side); this and
    # the next step are on one range partitioning in (keys, seq) order
    g1 = Sequence(x, order=[*keys, seq]).apply([
        Lag("__prev_ts", ts),
        Running("__prev_pos", F.when(F.col("__side") == 1, F.col(ts)), "last_nonnull", exclusive=True),
        Running("__prev_neg", F.when(F.col("__side") == -1, F.col(ts)), "last_nonnull", exclusive=True)], whole=True)
    prev_side = F.when(F.col("__side") == 1, F.col("__prev_pos")).when(F.col("__side") == -1, F.col("__prev_neg"))
    rec = g1.df.withColumn("__d_all", micros_between(ts, "__prev_ts")).withColumn("__d_side", micros_between(F.col(ts), prev_side))
    if min_id is not None:
        rec = rec.filter(F.col(seq) > min_id)
    jump = F.col("__d_all") < 0
    step = F.when(F.col("__d_side") > 0, F.when(F.col("__side") == 1, 0).when(F.col("__side") == -1, 2))
    classes = (F.when(jump & step.isNotNull(), F.array(F.lit(1), step)).when(jump, F.array(F.lit(1)))
                .when(step.isNotNull(), F.array(step)))
    rows = (rec.withColumn("riavvio", F.explode(classes))
               .withColumn("delta_dataora", F.when(F.col("riavvio") == 1, F.col("__d_all")).otherwise(F.col("__d_side")))
               .withColumn("flag", F.col("riavvio") == 1)
               .withColumn("__jump_next", jump & (F.col("riavvio") == 0))
               .drop("__d_all", "__d_side", "__prev_ts", "__prev_pos", "__prev_neg", "__side"))
    key = F.struct(*[F.col(k) for k in keys])
    g = g1._with(rows, more_order=["riavvio"]).apply([
        Lag("__prev", F.struct(F.col("riavvio").alias("r"), F.col(ts).alias("t"), F.col("delta_dataora").alias("d"), key.alias("k")), group=[]),
        Running("conteggio", F.when(F.col("flag"), F.lit(1)), "count")], whole=True)
    nuova = (F.when((F.col("riavvio") == 1) & (F.col("__prev.r") == 0), F.col("__prev.t") + interval_seconds(restart_gap_seconds))
              .when((F.col("riavvio") == 2) & (F.col("__prev.r") == 1), F.col("__prev.t") - interval_micros(F.col("__prev.d"))))
    # the original running COUNT has a record's twin rows as peers: a class-0 row
    # counts the jump of its twin, which is next to it
    z = (g.df.withColumn("nuovadataora", nuova.cast("timestamp_ntz"))
             .withColumn("conteggio", F.col("conteggio") + F.when(F.col("__jump_next"), 1).otherwise(0))
             .withColumn("__pr", F.when(F.col("__prev.k").eqNullSafe(key), F.col("__prev.r")))
             .drop("__prev", "__jump_next"))
    # what follows stays within an island, so within a station
    for c, v in only.items():
        if c in keys:
            z = z.filter(F.col(c) == v)
    island = [*keys, "conteggio"]
    first2 = F.when(F.col("riavvio") == 2, F.struct(F.col(seq).alias("s"), F.col("nuovadataora").alias("v")))
    z = g._with(z).apply([
        Lag("__pnuova", "nuovadataora", group=island),
        Running("__first2", first2, "first_nonnull", group=island),
        Running("__possum", F.when(F.col("delta_dataora") > 0, F.col("delta_dataora")), "sum", group=island)], whole=True).result()
    nuova2 = (F.when((F.col("riavvio") == 2) & (F.col("__pr") == 1), F.col("__pnuova") + interval_micros(F.col("delta_dataora")))
               .when((F.col("riavvio") == 2) & (F.col("__pr") == 2), F.col("__first2.v") + interval_micros(F.col("__possum"))))
    return (z.withColumn("nuovadataora2", nuova2.cast("timestamp_ntz")).withColumn("idn", F.col(seq))
             .withColumn("delta_dataora", F.col("delta_dataora") / 1_000_000.0)
             .drop("__pr", "__pnuova", "__first2", "__possum"))
