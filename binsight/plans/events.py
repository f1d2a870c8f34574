"""Station-event reports: restarts, power changes, battery phases, label
printer alarms, lid openings, operator and access logs, silent stations.

Each report takes a :class:`~binsight.sources.bindings.Tables` mapping and
plain parameters and returns a lazy DataFrame.  Display ordering is left to
the caller: ``binsight.plans.display.sort_like_original`` applies the
original ORDER BY.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions.pg import (as_ts, day_start, interval_seconds, next_day_start, pg_concat, seconds_between,
                                   time_text, weekday_label)
from binsight.operators.filters import (exclude_time_of_day, in_days_expr, in_instants_expr,
                                        optional_eq)
from binsight.operators.presence import absent
from binsight.operators.sequence import Sequence, state_changes
from binsight.operators.totals import dominant_signal
from binsight.sources.bindings import Tables

# --- fixed values -------------------------------------------------------------
RESTART_PATTERNS = ("%AVVIO%", "%RESET%")
POWER_EVENT = "TENSIONE_RETE"
POWER_PATTERN = "%TENSIONE_RETE%"
LABEL_PATTERN = "%ETICHETTE%"
LABELS_FINISHED = "ETICHETTE TERMINATE"
LABELS_JAMMED = "ETICHETTE INCEPPATE"
LID_OPEN = "APERTURA"
LID_CLOSE = "CHIUSURA"
RESTART_NIGHT = ("02:59:59", "04:00:00")
POWER_NIGHT = ("02:50:00", "03:50:00")
OPERATOR_NOISE = ("%timeout%", "%logout%", "%login%")
# ------------------------------------------------------------------------------


def _restart_events(t: Tables, municipality, start, end) -> DataFrame:
    e = t.eventi
    is_restart = F.col("idevento").like(RESTART_PATTERNS[0]) | F.col("idevento").like(RESTART_PATTERNS[1])
    e = e.filter(is_restart & (F.col("idcomune") == municipality) & in_days_expr("dataora", start, end))
    return exclude_time_of_day(e, "dataora", *RESTART_NIGHT)


def restarts(t: Tables, municipality: int, start, end, gap_seconds: float = 30.0,
             literal: bool = False) -> DataFrame:
    """Restarts per station, counting a restart event only if it comes
    more than ``gap_seconds`` after the previous one at the same station (the
    first event of a station counts).  ``literal=True`` counts every event
    (the original ``CASE ... ELSE ''`` is never NULL)."""
    ev = _restart_events(t, municipality, start, end).select("id", "idcomune", "idstazione", "dataora")
    if literal:
        counted = ev.withColumn("__ok", F.lit(True))
    else:
        seq = Sequence(ev, order=["dataora", "id"], by=["idcomune", "idstazione"]).lag({"ultimadata": "dataora"})
        counted = seq.result().withColumn(
            "__ok", F.col("ultimadata").isNull() | (F.col("dataora") > F.col("ultimadata") + interval_seconds(gap_seconds)))
    per_station = counted.groupBy("idcomune", "idstazione").agg(F.count(F.when(F.col("__ok"), 1)).alias("n"))
    named = per_station.join(t.infocomune, F.col("idcomune") == F.col("id"))
    return (named.groupBy(pg_concat("nome", F.lit(" "), "idstazione").alias("nomestazione"))
                 .agg(F.sum("n").cast("long").alias("riavvii")))


def station_restart_history(t: Tables, municipality: int, station: int, start, end) -> DataFrame:
    """Distinct restart events of one station (newest first if sorted)."""
    ev = _restart_events(t, municipality, start, end).filter(F.col("idstazione") == station)
    return ev.select(F.col("note").alias("numeroevento"), F.col("idevento").alias("tipoevento"),
                     F.col("dataora").alias("data")).distinct()


def emptying_calendar(t: Tables) -> DataFrame:
    """The emptying calendar as delivered (all rows)."""
    return t.cal_svuotamenti


def label_alarms(t: Tables, start, end, literal: bool = False) -> DataFrame:
    """Label-printer alarms per station.

    Label events in [start, end + 1 day] are put in global time order; each
    keeps the time of the previous label event anywhere (``ultimadata``) and
    the first one is dropped.  Per station the dominant signal (finished vs
    jammed, compared on event sums) is reported with its count and the
    weekday/date of the latest ``ultimadata``.  ``literal=True`` compares
    ``COUNT``s of never-NULL columns, which always yields "jammed".
    """
    e = t.eventi.filter(F.col("idevento").like(LABEL_PATTERN)
                        & F.col("dataora").between(as_ts(start), next_day_start(end)))
    seq = Sequence(e.select("id", "idcomune", "idstazione", "idevento", "dataora"), order=["dataora", "id"])
    lagged = seq.lag({"ultimadata": "dataora"}).result().filter(F.col("ultimadata").isNotNull()
                                                               & F.lower("idevento").like(LABEL_PATTERN.lower()))
    com = t.infocomune.select(F.col("id").alias("__cid"), "nome")
    named = lagged.join(com, F.col("idcomune") == F.col("__cid"))
    day = F.max(F.to_date("ultimadata"))
    # literal: counts of never-NULL columns are equal, so "jammed" always wins
    shown = [LABELS_FINISHED, LABELS_JAMMED]
    out = dominant_signal(named, ["nome", "idstazione"], "idevento", shown, extra={"__day": day, "__jam": F.count(
        F.when(F.col("idevento") == LABELS_JAMMED, 1))})
    if literal:
        out = out.withColumns({"avviso": F.lit(LABELS_JAMMED), "segnalazioni": F.col("__jam")})
    return out.select("nome", "idstazione", "avviso", F.col("segnalazioni").cast("long").alias("segnalazioni"),
                      pg_concat(weekday_label("__day", "accented"), F.lit(" "), F.col("__day").cast("string")).alias("ultimoinvio"))


def power_changes(t: Tables, municipality: int, start, end, station: int | None = None,
                  literal: bool = False) -> DataFrame:
    """Mains-power state changes per station (night window excluded),
    for stations registered in ``infostazioni``.  The first event of a
    station counts as a change (its previous state is empty).
    ``literal=True`` keeps the original unpartitioned LAG ordered by station
    and time, so a station's first event is compared with the previous
    station's last note."""
    e = t.eventi.filter(F.col("idevento").like(POWER_PATTERN) & (F.col("idcomune") == municipality)
                        & in_days_expr("dataora", start, end))
    e = optional_eq(e, "idstazione", station)
    e = exclude_time_of_day(e, "dataora", *POWER_NIGHT)
    st = t.infostazioni.select(F.col("idcomune").alias("__c"), F.col("codicestazione").alias("__s"))
    e = (e.join(st, (e.idcomune == st.__c) & (e.idstazione == st.__s), "left_semi")
          .select("idcomune", "idstazione", "idevento", "note", "dataora").distinct())
    # a NULL note reads as an empty one on both sides of the comparison
    e = e.withColumn("__state", F.coalesce("note", F.lit("")))
    if literal:
        prev = Sequence(e, order=["idstazione", "dataora", "note", "idevento"]).lag({"__prev": "__state"}).result()
        ch = prev.filter(F.col("__state") != F.coalesce("__prev", F.lit("")))
    else:
        ch = state_changes(e, ["idcomune", "idstazione"], "dataora", "__state", tie=["note", "idevento"])
        ch = ch.filter(F.col("prev_state").isNotNull() | (F.col("__state") != ""))
    ch = ch.withColumn("evento", pg_concat("idevento", F.lit(" "), "note"))
    named = ch.join(t.infocomune, F.col("idcomune") == F.col("id"))
    return (named.select("nome", F.col("idstazione").alias("stazione"), "evento",
                         weekday_label("dataora", "accented").alias("giorno"), F.col("dataora").alias("orario"))
                 .distinct())


def power_changes_asof(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """Power events whose note differs from the note of the latest
    strictly earlier event of any kind at the same station (ties on the time
    resolved by the larger id).  Of the time before ``start`` only each
    station's newest event can be that event."""
    columns = ["id", "idcomune", "idstazione", "idevento", "dataora", "note"]
    e = optional_eq(t.eventi.filter(F.col("idcomune") == municipality), "idstazione", station).select(*columns)
    newest = (e.filter(F.col("dataora") < day_start(start)).groupBy("idcomune", "idstazione")
               .agg(F.max_by(F.struct("id", "idevento", "dataora", "note"), F.struct("dataora", "id")).alias("__r"))
               .select("idcomune", "idstazione", "__r.*"))
    e = e.filter(in_days_expr("dataora", start, end)).unionByName(newest)
    seq = Sequence(e, order=["dataora", "id"], by=["idcomune", "idstazione"])
    seq = seq.lag({"__pts": "dataora", "__pnote": "note"})
    # note of the last row of the previous timestamp, spread over a run of equal times
    seq = seq.running("__asof", F.when(F.col("__pts") < F.col("dataora"), F.col("__pnote")), "first",
                      group=["idcomune", "idstazione", "dataora"])
    out = seq.result().filter((F.col("idevento") == POWER_EVENT) & in_days_expr("dataora", start, end)
                              & (F.col("note") != F.col("__asof")))
    cols = ["idevento", "dataora"] + (["idstazione"] if station in (None, 0, "") else []) + ["note"]
    return out.select(*cols)


def silent_stations(t: Tables, start, end, municipalities=None) -> DataFrame:
    """Stations (of the listed municipalities, else of all) with no event
    at all in [start, end]; last time seen in each power state.  Aggregated
    per station first, so the anti joins see one row per station and state."""
    e = t.eventi
    power = e.filter(F.col("idevento") == POWER_EVENT)
    if municipalities is not None:
        power = power.filter(F.col("idcomune").isin(list(municipalities)))
    last = (power.groupBy("idcomune", "idstazione", F.col("note").alias("stato")).agg(F.max("dataora").alias("ultimavolta")))
    active = e.filter(in_days_expr("dataora", start, end)).select("idcomune", "idstazione")
    return absent(last, active, ["idcomune", "idstazione"], null_aware=True,
                  not_null=["idcomune"] if municipalities is not None else [])


def battery_phases(t: Tables, municipality: int, station: int, skip_month: str | None = None,
                   debounce_seconds: float = 50.0, total_hours: bool = False) -> DataFrame:
    """Battery charge / discharge phases of one station.

    Power events that come within ``debounce_seconds`` after the previous
    power-or-start event are dropped (the first event has no previous one and
    is dropped too); a row is a phase change when its (event, note) differs
    from the previous event's.  For each change: hours since the previous
    change labelled charge (OFF) or discharge (ON), and a cycle number on ON
    rows.  The hours are the interval's hour *field* (days dropped, as the
    original ``date_part``); ``total_hours=True`` gives whole elapsed hours.
    """
    e = t.eventi.filter((F.col("idcomune") == municipality) & (F.col("idstazione") == station)
                        & (F.col("idevento").like(POWER_PATTERN) | F.col("idevento").like("%AVVIO%")))
    e = e.select("id", "idcomune", "idstazione", "idevento", "note", "dataora")
    seq = Sequence(e, order=["dataora", "id"], by=["idcomune", "idstazione"]).lag({
        "__evento2": pg_concat("idevento", F.lit(" "), "note"), "__ultimadata": "dataora"})
    x = seq.result().filter(F.col("idevento").like(POWER_PATTERN))
    x = x.filter(~F.col("dataora").between(F.col("__ultimadata"),
                                           F.col("__ultimadata") + interval_seconds(debounce_seconds)))
    x = x.withColumn("evento", pg_concat("idevento", F.lit(" "), "note")).filter(F.col("evento") != F.col("__evento2"))
    if skip_month:
        x = x.filter(~F.col("dataora").cast("string").like(f"%{skip_month}%"))
    x = x.select("idcomune", "idstazione", F.col("dataora").alias("data"), "evento").distinct()
    seq2 = Sequence(x, order=["data", "evento"], by=["idcomune", "idstazione"]).lag({"__prev": "data"})
    seq2 = seq2.row_number("__rn")
    y = seq2.result()
    if total_hours:
        hours = F.floor(seconds_between("data", "__prev") / 3600)
    else:
        hours = F.extract(F.lit("HOUR"), F.col("data") - F.col("__prev"))
    on, off = f"{POWER_EVENT} ON", f"{POWER_EVENT} OFF"
    named = y.join(t.infocomune, F.col("idcomune") == F.col("id"))
    return named.select(
        "nome", "idstazione",
        weekday_label("data", "plain").alias("giorno"),
        F.when(F.col("evento") == off, pg_concat(hours, F.lit(" ORE DI CARICA")))
         .when(F.col("evento") == on, pg_concat(hours, F.lit(" ORE DI SCARICA"))).alias("batteria"),
        F.when(F.col("evento") == on, F.col("__rn") - F.floor(F.col("__rn") / 2)).cast("long").alias("ciclo"),
        F.to_date("data").alias("data"))


def _operator_log(t: Tables, municipality: int, start, end, station) -> DataFrame:
    log = t.logoperatore.filter((F.col("idcomune") == municipality) & in_instants_expr("dataora", start, end))
    log = optional_eq(log, "codicestazione", station)
    ops = t.infooperatori.select(F.col("codicetag").alias("__tag"), F.col("nome").alias("operatore"))
    com = t.infocomune.select(F.col("id").alias("__cid"), "nome")
    j = (log.join(com, log.idcomune == com.__cid)
            .join(ops, log.codicetag == ops.__tag, "left"))
    return j.select("nome", F.col("codicestazione").alias("stazione"),
                    weekday_label("dataora", "accented").alias("giorno"), F.col("dataora").alias("data"),
                    F.col("__tag").alias("codicetag"), "operatore", "info")


def operator_log(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """Operator log with operator name and weekday (instants)."""
    return _operator_log(t, municipality, start, end, station)


def operator_log_filtered(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """R13 without timeout / logout / login lines (NULL info dropped)."""
    out = _operator_log(t, municipality, start, end, station)
    for p in OPERATOR_NOISE:
        out = out.filter(~F.col("info").like(p))
    return out


def failed_reads(t: Tables, municipality: int, start, as_text: bool = False) -> DataFrame:
    """Failed tag reads since ``start``, one row per station and tag with
    their number and last time (a hash aggregation).  ``as_text=True`` gives
    the original sheet: one row per station with all its reads as one text
    (sorted tags, space separated), which is as long as the station has reads."""
    f = t.logfalliti.filter((F.col("idcomune") == municipality)
                            & (F.col("dataora") >= as_ts(start)))
    per_tag = f.groupBy("idcomune", "idstazione", "codicetag").agg(F.count("codicetag").alias("n"), F.max("dataora").alias("ultimo"))
    com = t.infocomune.select(F.col("id").alias("__cid"), "nome")
    j = per_tag.join(com, per_tag.idcomune == com.__cid, "left")
    if not as_text:
        return j.select(F.col("nome").alias("comune"), F.col("idstazione").alias("numerostazione"), "codicetag",
                        F.col("n").alias("numerofallimenti"), F.col("ultimo").alias("ultimodatoricevuto"))
    tag = F.col("codicetag").cast("string")
    texts = F.collect_list(F.when(F.col("n") > 0, F.struct(tag.alias("t"), F.array_join(F.array_repeat(tag, F.col("n").cast("int")), " ").alias("r"))))
    return (j.groupBy(F.col("nome").alias("comune"), F.col("idstazione").alias("numerostazione"))
             .agg(F.sum("n").cast("long").alias("numerofallimenti"),
                  F.when(F.sum("n") > 0, F.array_join(F.transform(F.array_sort(texts), lambda x: x["r"]), " ")).alias("letturefallite"),
                  F.max("ultimo").alias("ultimodatoricevuto")))


def failed_reads_chunks(t: Tables, municipality: int, start, limit: int = 4096) -> DataFrame:
    """R16's text per station in numbered chunks (``parte``) of bounded length: joined
    by a space in their order they are the text of ``failed_reads(as_text=True)``.

    A tag's reads are cut into pieces of at most ``limit`` characters, the pieces are
    laid out in order of (tag, piece) by a skew-proof running sum of their lengths,
    and a chunk is what begins in the same ``limit`` characters.  So a station with
    any number of reads is never held by one task."""
    f = t.logfalliti.filter((F.col("idcomune") == municipality) & (F.col("dataora") >= as_ts(start)) & F.col("codicetag").isNotNull())
    station = ["idcomune", "idstazione"]
    per_tag = f.groupBy(*station, F.col("codicetag").cast("string").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
    one = F.char_length("tag") + 1
    most = F.greatest(F.floor(F.lit(limit) / one), F.lit(1)).cast("long")
    pieces = (per_tag.withColumn("most", most).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div most"))))
                     .withColumn("reads", F.least("most", F.col("n") - F.col("piece") * F.col("most"))).withColumn("size", F.col("reads") * one))
    laid = Sequence(pieces.select(*station, "tag", "piece", "reads", "size"), order=["tag", "piece"], by=station).running("end", "size", "sum").result()
    text = F.array_join(F.array_repeat("tag", F.col("reads").cast("int")), " ")
    parts = (laid.withColumn("parte", F.floor((F.col("end") - F.col("size")) / limit).cast("long"))
                 .groupBy(*station, "parte").agg(F.collect_list(F.struct("tag", "piece", text.alias("text"))).alias("x"), F.sum("reads").alias("letture")))
    com = t.infocomune.select(F.col("id").alias("__cid"), "nome")
    return (parts.join(com, parts.idcomune == com.__cid, "left")
                 .select(F.col("nome").alias("comune"), F.col("idstazione").alias("numerostazione"), "parte", F.col("letture").cast("long").alias("letture"),
                         F.array_join(F.transform(F.array_sort("x"), lambda x: x["text"]), " ").alias("letturefallite")))


def admin_tester_log(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """Accesses of testers and administrators (UNION ALL of both lists)."""
    people = (t.infotesters.select("codicetag", "nome")
               .unionByName(t.infoamministratori.select("codicetag", "nome"))
               .select(F.col("codicetag").alias("codicetessera"), F.col("nome").alias("descrizione")))
    log = t.logadmintesters.filter((F.col("idcomune") == municipality) & in_instants_expr("dataora", start, end))
    log = optional_eq(log, "codicestazione", station)
    com = t.infocomune.select(F.col("id").alias("__cid"), "nome")
    j = (log.join(people, log.codicetag == people.codicetessera)
            .join(com, log.idcomune == com.__cid))
    return j.select("nome", "codicestazione", "descrizione", F.col("tipologiautente").alias("tipologia"),
                    F.col("dataora").alias("data"), "codicetessera")


def lid_openings(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """Lid openings with weekday, date and time."""
    e = t.eventi.filter((F.col("idevento") == LID_OPEN) & (F.col("idcomune") == municipality)
                        & in_days_expr("dataora", start, end))
    e = optional_eq(e, "idstazione", station)
    cols = [F.col("idevento"), weekday_label("dataora", "short").alias("gg"), F.to_date("dataora").alias("data"),
            time_text("dataora").alias("ora")]
    if station in (None, 0, ""):
        cols.append(F.col("idstazione").alias("stazione"))
    return e.select(*cols, "note")


def emptying_log(t: Tables, municipality: int, start, end) -> DataFrame:
    """Emptying log rows of a municipality between two instants."""
    c = t.cal_logoperatore
    return c.filter((F.col("idcomune") == municipality) & in_instants_expr("dataora", start, end))


