"""Deposit reports: duplicates, stuck scales, repeats, totals, listings,
label rolls, wrong-bin anomalies and stale stations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions.pg import as_ts, day_start, interval_seconds, pg_concat, time_text, weekday_label
from binsight.operators.filters import in_days_expr, in_instants_expr, optional_eq
from binsight.operators.matching import interval_match, total_seconds
from binsight.operators.presence import last_seen, stale
from binsight.operators.quality import exact_duplicates
from binsight.operators.sequence import Sequence, first_per_key, repeat_records, stuck_values
from binsight.operators.sink import crosstab
from binsight.operators.totals import CATEGORY_COLUMNS, averages_by, category_totals, period_counts, roll_counter
from binsight.sources.bindings import Tables

# --- fixed values -------------------------------------------------------------
DUPLICATE_KEY = ("idcomune", "codicestazione", "codicetag", "dataora", "peso", "tiporifiuto")
LID_OPEN = "APERTURA"
LID_CLOSE = "CHIUSURA"
ANOMALY, OK = "ANOMALIA", "OK"
# ------------------------------------------------------------------------------


def _named(df: DataFrame, t: Tables, on: str = "idcomune") -> DataFrame:
    com = t.infocomune.select(F.col("id").alias("__cid"), "nome")
    return df.join(com, F.col(on) == F.col("__cid")).drop("__cid")


def duplicate_deposits(t: Tables, start) -> DataFrame:
    """Exact duplicate deposits since ``start``: same municipality,
    station, tag, time, weight and type; ids listed ascending."""
    d = t.conferimenti.filter(F.col("dataora") >= as_ts(start))
    dup = exact_duplicates(d, DUPLICATE_KEY, "id")
    return (_named(dup, t).select("nome", "codicestazione", "codicetag", "dataora", "peso", "stringaid",
                                  F.col("conteggio")).distinct())


def stuck_weights(t: Tables, start, min_repeats: int = 3, days_back: int = 2, literal: bool = False) -> DataFrame:
    """Stuck scale -- a deposit weighing exactly what the previous
    deposit at the same station weighed, more than ``min_repeats`` times for
    that weight since ``start - days_back`` days.  Before the period only each
    station's newest deposit can be a previous one, so the history is reduced
    to it by an aggregation.  ``literal=True`` keeps the original unpartitioned
    LAG over (municipality, station, time), so a station's first deposit is
    compared with the previous station's last."""
    since = (as_ts(start) - F.expr(f"INTERVAL {int(days_back)} DAY")).cast("timestamp_ntz")
    station = ["idcomune", "codicestazione"]
    d = t.conferimenti.select(*station, "id", "dataora", "peso")
    newest = (d.filter(F.col("dataora") < since).groupBy(*station)
               .agg(F.max_by(F.struct("id", "dataora", "peso"), F.struct("dataora", "id")).alias("__r")).select(*station, "__r.*"))
    d = d.filter(F.col("dataora") >= since).unionByName(newest)
    if literal:
        rep = Sequence(d, order=[*station, "dataora", "id"]).lag({"__pp": "peso"}).result()
        rep = rep.filter((F.col("dataora") >= since) & (F.col("peso") == F.col("__pp")))
        g = (rep.groupBy(*station, "peso")
                .agg(F.count_distinct("dataora").alias("numeroconferimenti"), F.max("dataora").alias("ultimodato"))
                .filter(F.col("numeroconferimenti") > min_repeats))
    else:
        g = (stuck_values(d, station, "dataora", "peso", min_repeats, since=since, distinct_ts=True)
             .withColumnsRenamed({"repeats": "numeroconferimenti", "last_ts": "ultimodato"}))
    return _named(g, t).select(pg_concat("nome", F.lit(" "), "codicestazione").alias("identificativo"),
                               "peso", "numeroconferimenti", "ultimodato")


def deposit_crosstab(t: Tables, codes) -> DataFrame:
    """Weight per station (rows) and waste type: a column ``t<code>`` for
    each of ``codes``, and ``altri`` for every other type or none."""
    x = crosstab(t.conferimenti, ["idcomune", "codicestazione"], "tiporifiuto", "peso", values=codes, other="altri")
    return x.select("idcomune", "codicestazione", *[F.col(str(c)).alias(f"t{c}") for c in codes], "altri")


def _typed(t: Tables, d: DataFrame) -> DataFrame:
    rif = t.inforifiuti.select(F.col("idcomune").alias("__rc"), F.col("codicerifiuto").alias("__code"), "descrizione")
    return d.join(rif, (d.tiporifiuto == rif.__code) & (d.idcomune == rif.__rc)).drop("__rc", "__code")


def deposit_listing(t: Tables, municipality: int, start, end, station: int | None = None,
                    literal: bool = False) -> DataFrame:
    """Distinct deposits with municipality, type name and a weekday +
    date-time text (``'<weekday>  YYYY-MM-DD HH:mm:ss'``).  The original
    format printed the month where the minutes belong; ``literal=True`` keeps
    that (``HH:MM:ss``)."""
    d = t.conferimenti.filter((F.col("idcomune") == municipality) & in_days_expr("dataora", start, end))
    d = _named(_typed(t, optional_eq(d, "codicestazione", station)), t)
    fmt = " yyyy-MM-dd HH:MM:ss" if literal else " yyyy-MM-dd HH:mm:ss"
    when = F.concat(weekday_label("dataora", "plain"), F.lit(" "), F.date_format("dataora", fmt))
    return d.select(F.col("nome").alias("comune"), F.col("codicestazione").alias("stazione"), "codicetag",
                    when.alias("data"), "peso", "tiporifiuto", "descrizione", "codiceanomalia").distinct()


def repeat_deposits(t: Tables, municipality: int, start, end, station: int | None = None,
                    since=None, max_weight_diff: float = 1.0) -> DataFrame:
    """Deposits that directly follow, in global time order (all stations
    and municipalities, after ``since`` if given), a deposit of the same tag
    and type whose weight differs by less than ``max_weight_diff``.  Of the
    time before the period only the newest deposit matters."""
    columns = ["id", "idcomune", "codicestazione", "codicetag", "dataora", "peso", "tiporifiuto", "codiceanomalia"]
    d = t.conferimenti.select(*columns)
    if since is not None:
        d = d.filter(F.col("dataora") > as_ts(since))
    newest = (d.filter(F.col("dataora") < day_start(start))
               .agg(F.max_by(F.struct(*columns), F.struct("dataora", "id")).alias("__r")).filter("__r is not null").select("__r.*"))
    d = d.filter(in_days_expr("dataora", start, end)).unionByName(newest)
    x = repeat_records(d, order=["dataora", "id"], same=["codicetag", "tiporifiuto"], near={"peso": max_weight_diff})
    x = x.filter((F.col("idcomune") == municipality) & in_days_expr("dataora", start, end))
    x = optional_eq(x, "codicestazione", station)
    return x.select("codicetag", F.to_date("dataora").alias("data"), time_text("dataora").alias("ora"),
                    "tiporifiuto", (F.col("tiporifiuto") - F.col("tiporifiuto")).alias("flag"), F.abs("diff_peso").alias("diffpeso"),
                    "codiceanomalia", "codicestazione")


def _with_household(t: Tables, d: DataFrame) -> DataFrame:
    a = t.associazionenuclei.select(F.col("codicetag").alias("__tag"), "codicenucleo")
    return d.join(a, d.codicetag == a.__tag, "left").drop("__tag")


def _listing_cols():
    return [weekday_label("dataora", "short").alias("gg"), F.to_date("dataora").alias("data"),
            time_text("dataora").alias("ora"), "descrizione", "peso", "tiporifiuto", "codiceanomalia"]


def deposits_with_household(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """Deposits with type name and the tag's household, if any."""
    d = t.conferimenti.filter((F.col("idcomune") == municipality) & in_days_expr("dataora", start, end))
    d = _with_household(t, _typed(t, optional_eq(d, "codicestazione", station)))
    lead = [] if station not in (None, 0, "") else [F.col("codicestazione").alias("stazione")]
    return d.select(*lead, "codicetag", "codicenucleo", *_listing_cols())


def heavy_deposits(t: Tables, municipality: int, start, end, min_weight: float) -> DataFrame:
    """R18 restricted to weights >= ``min_weight``."""
    d = t.conferimenti.filter((F.col("idcomune") == municipality) & in_days_expr("dataora", start, end)
                              & (F.col("peso") >= min_weight))
    d = _with_household(t, _typed(t, d))
    return d.select("codicestazione", "codicetag", "codicenucleo", *_listing_cols())


def zero_weight_deposits(t: Tables, start, end) -> DataFrame:
    """Deposits weighing 0, with one type name per code (the smallest)."""
    names = t.inforifiuti.groupBy("codicerifiuto").agg(F.min("descrizione").alias("nome"))
    d = t.conferimenti.filter(in_days_expr("dataora", start, end) & (F.col("peso") == 0))
    j = d.join(names, d.tiporifiuto == names.codicerifiuto)
    return j.select("idcomune", "codicestazione", "codicetag", "dataora", "peso", "tiporifiuto", "nome",
                    "codiceanomalia", "data", "componenti")


def recent_totals(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """Weight per waste type, sorted weight (code > 0), total, count and
    last time -- per municipality when a station is given, else per station."""
    d = t.conferimenti.filter((F.col("idcomune") == municipality) & in_days_expr("dataora", start, end))
    d = optional_eq(d, "codicestazione", station)
    keys = ["idcomune"] if station not in (None, 0, "") else ["idcomune", "codicestazione"]
    extra = [F.count("id").alias("numconferimenti"), F.max("dataora").alias("ultimaora")]
    return category_totals(d, keys, "tiporifiuto", "peso", CATEGORY_COLUMNS, sorted_min=0, extra=extra)


def per_station_tag(t: Tables, start, end) -> DataFrame:
    """Count, weight and last time per (municipality, station, tag)."""
    d = t.conferimenti.filter(in_days_expr("dataora", start, end))
    return (d.groupBy("codicetag", "idcomune", "codicestazione")
             .agg(F.count(F.lit(1)).alias("conferimenti"), F.sum("peso").alias("totpeso"),
                  F.max("dataora").alias("ultimo")))


def label_rolls(t: Tables, as_of, keep_order: bool = False) -> DataFrame:
    """Label roll state per station and deposits in the last 7 days and
    the 7 days before (day ``as_of - 7`` belongs to both, as in the original);
    only stations with deposits in both weeks.  ``keep_order`` carries the
    municipality id for the display order."""
    import datetime as dt
    from binsight.functions.pg import to_datetime
    ref = to_datetime(as_of).date()
    w1 = (ref - dt.timedelta(days=7), ref)
    w2 = (ref - dt.timedelta(days=14), ref - dt.timedelta(days=7))
    c = (period_counts(t.conferimenti, ["idcomune", "codicestazione"], "dataora",
                       {"primasettimana": w1, "secondasettimana": w2}, value="peso", rows={"__n1": w1, "__n2": w2})
         .filter((F.col("__n1") > 0) & (F.col("__n2") > 0)))
    s = t.datistazione.filter((F.col("idcomune") > 0) & (F.col("idstazione") > 0))
    j = s.join(c, (s.idcomune == c.idcomune) & (s.idstazione == c.codicestazione)).drop(c.idcomune)
    j = _named(j, t)
    printed, left = roll_counter("numeroetichette", "maxetichette")
    return j.select(F.col("nome").alias("comune"), F.col("idstazione").alias("stazione"), "primasettimana",
                    "secondasettimana", left.alias("restanti"), printed.alias("stampate"), "maxetichette",
                    *([F.col("idcomune").alias("__order_idcomune")] if keep_order else []))


def bin_accumulation(t: Tables, municipality: int, start, end, station: int | None = None) -> DataFrame:
    """Bin accumulation log."""
    c = t.cumulopesi.filter((F.col("idcomune") == municipality) & in_days_expr("dataora", start, end))
    c = optional_eq(c, "codicestazione", station)
    return c.select(weekday_label("dataora", "short").alias("gg"), F.to_date("dataora").alias("data"),
                    time_text("dataora").alias("ora"), "codicestazione", "idrifiuto",
                    "nomerifiuto", "peso", "numerosacchetti", "idbidone")


def bin_averages(t: Tables) -> DataFrame:
    """Mean weight and mean bag count per station and waste name as
    decimal(6,3), and the last update (one aggregation)."""
    return averages_by(t.cumulopesi, ["idcomune", "codicestazione", "nomerifiuto"],
                       {"mediapeso": "peso", "mediasacchetti": "numerosacchetti"},
                       extra={"aggiornato": F.max("dataora")})


def stale_stations(t: Tables, as_of, within_hours: float = 12.0, deposits: str = "conferimenti",
                   literal: bool = False) -> DataFrame:
    """Stations whose newest deposit / event / operator-log time is
    neither on the day of ``as_of`` nor within ``within_hours`` before it.
    Sources are pre-aggregated per station and merged (a station missing
    from one source still counts).  ``literal=True`` keeps the original
    right-join chain keyed on the deposit side, which drops every station
    without deposits, and its NULL-unsafe three-way maximum."""
    dep = t[deposits].select("idcomune", "codicestazione", "dataora")
    ev = t.eventi.select("idcomune", F.col("idstazione").alias("codicestazione"), "dataora")
    log = t.logoperatore.select("idcomune", "codicestazione", "dataora")
    if literal:
        c = dep.groupBy("idcomune", "codicestazione").agg(F.max("dataora").alias("max1"))
        e = ev.groupBy(F.col("idcomune").alias("__ec"), F.col("codicestazione").alias("__es")).agg(
            F.max("dataora").alias("max2"))
        lg = log.groupBy(F.col("idcomune").alias("__lc"), F.col("codicestazione").alias("__ls")).agg(
            F.max("dataora").alias("max3"))
        j = (c.join(e, (e.__es == c.codicestazione) & (e.__ec == c.idcomune), "right")
              .join(lg, (lg.__ls == e.__es) & (lg.__lc == e.__ec), "right"))
        m1, m2, m3 = F.col("max1"), F.col("max2"), F.col("max3")
        top = F.when(m1 > m2, F.when(m1 > m3, m1).otherwise(m3)).otherwise(F.when(m2 > m3, m2).otherwise(m3))
        last = j.select("idcomune", "codicestazione", top.alias("ultimoinvio")).distinct()
    else:
        last = last_seen([dep, ev, log], ["idcomune", "codicestazione"], "dataora", "ultimoinvio")
    last = stale(last, "ultimoinvio", as_of, within_hours)
    st = t.infostazioni.filter(F.col("idcomune").isNotNull() & F.col("codicestazione").isNotNull()) \
                       .select("idcomune", "codicestazione")
    j = _named(st.join(last, ["idcomune", "codicestazione"]), t)
    return j.select("nome", "codicestazione", "ultimoinvio").distinct()


def _short_note(c: str):
    return F.when(F.octet_length(F.col(c)).between(1, 3), F.col(c))


def _cycles_of_any_station(dati: DataFrame, opens: DataFrame, c: DataFrame, b: DataFrame, open_before, close_after, pair_window) -> DataFrame:
    """R19's literal form: every opening with every closing within ``pair_window``, one
    pair per opening and closing time across all stations, then one row per deposit time."""
    pairs = interval_match(opens, c, ["comune", "stazione"], ["__cc", "__cs"], "data", "data2", 0, pair_window)
    pairs = pairs.select("comune", "stazione", pg_concat("idevento", F.lit(" "), _short_note("note")).alias("evento"),
                         "data", "data2", "evento2",
                         _short_note("note").try_cast("smallint").alias("__in1"),
                         F.col("__snote2").try_cast("smallint").alias("__in2")).distinct()
    # ON (open input = bin OR close input = bin): one equi join per candidate input
    cand = pairs.withColumn("__in", F.explode(F.array_distinct(F.array("__in1", "__in2")))).filter(F.col("__in").isNotNull())
    ev2 = cand.join(b, (cand.comune == b.__bc) & (cand.stazione == b.__bs) & (cand.__in == b.inputplc1))
    # DISTINCT ON (open, close): one row across all stations
    ev2 = (ev2.groupBy("data", "data2")
              .agg(F.min_by(F.struct("comune", "stazione", "inputplc1", "evento", "evento2", "__in2"),
                            F.struct("comune", "stazione", "inputplc1")).alias("__r"))
              .select("data", "data2", "__r.*"))
    # deposit <-> lid cycle: close in [dep, dep + close_after], open in [dep - open_before, dep]
    m = interval_match(dati, ev2, ["idcomune", "codicestazione", "input"], ["comune", "stazione", "inputplc1"],
                       "dataora", "data", -float(open_before), 0)
    m = m.filter(F.col("data2").between(F.col("dataora"), F.col("dataora") + interval_seconds(close_after)))
    m = m.withColumn("anomalia", F.when(F.lower("evento2").contains(F.col("input").cast("string")), F.lit(OK))
                                   .otherwise(F.lit(ANOMALY)))
    # DISTINCT ON (deposit time): one row across all stations
    return (m.groupBy("dataora")
             .agg(F.min_by(F.struct("comune", "stazione", "tiporifiuto", "anomalia"),
                           F.struct("comune", "stazione", "data", "data2", "tiporifiuto")).alias("__r"))
             .select("dataora", "__r.*"))


def _smallest_bin(events: DataFrame, stations: DataFrame, place: list[str], at: str, reported: str) -> DataFrame:
    """Per station and time of lid events and each bin input of the station (``__on``)
    the smallest bin input reported then (``__bin``, NULL if none is)."""
    # not a plain equality: the grouping then deals the rows anew, so the join may split a hot station
    seen = events.join(stations, F.col(place[0]).eqNullSafe(F.col("__bc")) & F.col(place[1]).eqNullSafe(F.col("__bs")))
    return (seen.groupBy(*place, at, "__inputs")
                .agg(F.min(F.when(F.array_contains("__inputs", F.col(reported)), F.col(reported))).alias("__bin"))
                .withColumn("__on", F.explode("__inputs")))


def _first_cycles(dati: DataFrame, opens: DataFrame, closes: DataFrame, inputs: DataFrame, open_before, close_after, pair_window) -> DataFrame:
    """For each deposit time and bin input its lid cycle: the earliest opening within
    ``open_before`` seconds before it with a closing within ``close_after`` seconds after
    it and within ``pair_window`` of the opening, and the earliest such closing.

    The input of an opening with a closing is the smaller of the smallest bin inputs
    the two report.  So a cycle is on ``input`` by its opening (whose smallest this is,
    the closing's is not below) or by its closing alone (whose smallest this is, the
    opening's is above).  On either side the first closing after the deposit does not
    depend on the opening, and the first opening only on that closing's time: two first
    matches instead of a row per opening and closing.  ``__ok``: a closing of that time
    reports ``input``."""
    by_opening, by_closing = "a", "c"
    stations = inputs.groupBy("__bc", "__bs").agg(F.array_sort(F.collect_set("inputplc1")).alias("__inputs"))
    on_it = F.coalesce(F.col("__bin") == F.col("__on"), F.lit(False))
    above = F.col("__bin").isNull() | (F.col("__bin") > F.col("__on"))
    o = _smallest_bin(opens, stations, ["comune", "stazione"], "data", "__in1").filter(on_it | above).select(
        "comune", "stazione", F.col("__on").alias("__oin"), F.when(on_it, by_opening).otherwise(by_closing).alias("__oside"), "data")
    c = _smallest_bin(closes, stations, ["__cc", "__cs"], "data2", "__in2").filter(on_it | above).select(
        "__cc", "__cs", F.col("__on").alias("__cin"), on_it.alias("__ok"), "data2",
        F.explode(F.when(on_it, F.array(F.lit(by_opening), F.lit(by_closing))).otherwise(F.array(F.lit(by_opening)))).alias("__cside"))
    place = ["idcomune", "codicestazione", "input", "__by"]
    d = dati.withColumn("__by", F.explode(F.array(F.lit(by_opening), F.lit(by_closing))))
    m = interval_match(d, c, place, ["__cc", "__cs", "__cin", "__cside"], "dataora", "data2", 0, close_after, first=True)
    m = m.drop("__cc", "__cs", "__cin", "__cside").withColumn(
        "__from", F.greatest(F.col("dataora") - interval_seconds(open_before), F.col("data2") - interval_seconds(total_seconds(pair_window))))
    m = interval_match(m, o, place, ["comune", "stazione", "__oin", "__oside"], "__from", "data", 0, open_before, first=True)
    return m.filter(F.col("data") <= F.col("dataora"))


def wrong_bin(t: Tables, start, end, open_before=10.0, close_after=120.0, pair_window=120.0,
              deposits: str = "conferimenti", literal: bool = False) -> DataFrame:
    """Deposits whose lid cycle (an opening within ``open_before``
    seconds before the deposit and a closing within ``close_after`` seconds
    after it, at the same station and on the bin expected for the waste type)
    reports a different bin input on the closing; anomalies per station and
    bin.  Stations are part of every de-duplication key, bin inputs are
    compared as integers, and non-numeric notes never break the cast.  Of several
    closings at one time it is enough that one reports the bin.

    ``literal=True`` keeps the original de-duplication keys (opening/closing
    times only, then the deposit time only -- simultaneous events at other
    stations vanish; the row kept is the one of the lowest station) and the
    substring test of the bin input in the closing text (input 1 matches a
    note "12").
    """
    dep = t[deposits].filter(in_instants_expr("dataora", start, end)).select(
        "idcomune", "codicestazione", "tiporifiuto", "codiceanomalia", "dataora").distinct()
    bins = t.infocassonetti
    dati = (dep.join(bins.select("idcomune", "codicestazione", "tiporifiuto", F.col("inputplc1").alias("input")),
                     ["idcomune", "codicestazione", "tiporifiuto"]))
    ev = t.eventi
    # a closing pairs with an earlier opening of the period: older ones never count
    closes = ev.filter((F.col("idevento") == LID_CLOSE) & (F.col("dataora") >= day_start(start))).select("idcomune", "idstazione", "idevento", "note", "dataora").distinct()
    # every closing is the previous one of another, but for the last of its station
    last = closes.groupBy(F.col("idcomune").alias("__lc"), F.col("idstazione").alias("__ls")).agg(F.max(F.struct("dataora", "note")).alias("__last"))
    c = closes.join(last, F.col("idcomune").eqNullSafe(F.col("__lc")) & F.col("idstazione").eqNullSafe(F.col("__ls"))).filter(
        F.struct("dataora", "note") != F.col("__last")).select(
        F.col("idcomune").alias("__cc"), F.col("idstazione").alias("__cs"), F.col("dataora").alias("data2"), _short_note("note").alias("__snote2"),
        F.col("note").alias("note2"), pg_concat("idevento", F.lit(" "), _short_note("note")).alias("evento2"))
    opens = ev.filter((F.col("idevento") == LID_OPEN) & in_days_expr("dataora", start, end)).select(
        F.col("idcomune").alias("comune"), F.col("idstazione").alias("stazione"), "idevento", "note",
        F.col("dataora").alias("data"))
    b = bins.select(F.col("idcomune").alias("__bc"), F.col("codicestazione").alias("__bs"), "inputplc1").distinct()
    if literal:
        one = _cycles_of_any_station(dati.distinct(), opens, c, b, open_before, close_after, pair_window)
    else:
        # of several waste types on one bin the lowest counts
        d = first_per_key(dati.select("idcomune", "codicestazione", "dataora", "input", "tiporifiuto"),
                          ["idcomune", "codicestazione", "dataora", "input"], ["tiporifiuto"])
        m = _first_cycles(d, opens.withColumn("__in1", _short_note("note").try_cast("smallint")),
                          c.withColumn("__in2", F.col("__snote2").try_cast("smallint")), b, open_before, close_after, pair_window)
        m = m.withColumn("anomalia", F.when(F.col("__ok"), F.lit(OK)).otherwise(F.lit(ANOMALY)))
        # DISTINCT ON (station, deposit time): earliest opening, then closing
        one = first_per_key(m.select("comune", "stazione", "dataora", "data", "data2", "tiporifiuto", "anomalia"),
                            ["comune", "stazione", "dataora"], ["data", "data2", "tiporifiuto"])
    rif = t.inforifiuti.select(F.col("idcomune").alias("__rc"), F.col("codicerifiuto").alias("__code"), "descrizione")
    j = one.join(rif, (one.comune == rif.__rc) & (one.tiporifiuto == rif.__code))
    j = _named(j, t, on="comune")
    out = (j.groupBy("nome", "stazione", "descrizione")
            .agg(F.count(F.when(F.col("anomalia") == ANOMALY, 1)).alias("numeroanomalie"))
            .filter(F.col("numeroanomalie") != 0))
    return out.select(pg_concat("nome", F.lit(" "), "stazione").alias("identificativo"),
                      pg_concat(F.lit("Cassonetto "), "descrizione").alias("rifiuto"), "numeroanomalie")
