"""Reports on hand-made fixture rows that hit the documented traps."""

import datetime as dt
import random

from binsight.plans import deposits as D
from binsight.plans import events as E
from binsight.plans import households as H
from binsight.sources.bindings import Tables

T = dt.datetime


def _events(spark, rows):
    return spark.createDataFrame(rows, "id long, idcomune int, idstazione int, idevento string, dataora timestamp_ntz, note string")


def _comuni(spark):
    return spark.createDataFrame([(1, "Alfa"), (2, "Beta")], "id int, nome string")


def test_restarts_gap_29_30_31_seconds(spark):
    base = T(2024, 1, 5, 10, 0, 0)
    rows = [(1, 1, 7, "RESET", base, None),
            (2, 1, 7, "RESET", base + dt.timedelta(seconds=29), None),    # too close
            (3, 1, 7, "AVVIO", base + dt.timedelta(seconds=59), None),    # 30 s after previous: not > 30
            (4, 1, 7, "RESET", base + dt.timedelta(seconds=90), None),    # 31 s: counts
            (5, 1, 8, "RESET", base + dt.timedelta(seconds=1), None),     # other station, first event counts
            (6, 1, 7, "RESET", T(2024, 1, 5, 3, 30), None)]               # night window: dropped
    t = Tables(eventi=_events(spark, rows), infocomune=_comuni(spark))
    got = {r.nomestazione: r.riavvii for r in E.restarts(t, 1, "2024-01-05", "2024-01-05").collect()}
    assert got == {"Alfa 7": 2, "Alfa 8": 1}
    lit = {r.nomestazione: r.riavvii for r in E.restarts(t, 1, "2024-01-05", "2024-01-05", literal=True).collect()}
    assert lit == {"Alfa 7": 4, "Alfa 8": 1}


def test_power_changes_asof_ties_and_history(spark):
    rows = [(1, 1, 3, "TENSIONE_RETE", T(2024, 1, 1, 9), "ON"),     # before the period: history only
            (2, 1, 3, "APERTURA", T(2024, 1, 5, 9), "1"),           # any kind counts as previous
            (3, 1, 3, "TENSIONE_RETE", T(2024, 1, 5, 10), "OFF"),   # differs from '1' -> reported
            (4, 1, 3, "TENSIONE_RETE", T(2024, 1, 5, 10), "ON"),    # same time: compares with row 2 ('1')
            (5, 1, 3, "TENSIONE_RETE", T(2024, 1, 5, 11), "ON")]    # previous is time 10, largest id 4 'ON'
    t = Tables(eventi=_events(spark, rows))
    got = sorted(r.dataora for r in E.power_changes_asof(t, 1, "2024-01-05", "2024-01-05").collect())
    assert got == [T(2024, 1, 5, 10), T(2024, 1, 5, 10)]


def test_households_without_form_null_key(spark):
    hh = spark.createDataFrame([(1, "A"), (1, "B")], "idcomune int, codicenucleo string")
    form_ok = spark.createDataFrame([(1, "A")], "idcomune int, codicenucleo string")
    form_null = spark.createDataFrame([(1, "A"), (1, None)], "idcomune int, codicenucleo string")
    t = Tables(datinuclei=hh, datiform=form_ok)
    assert [r.codicenucleo for r in H.households_without_form(t, 1).collect()] == ["B"]
    assert H.households_without_form(t, 1, form=form_null).count() == 0


def test_annual_sheet_sum_distinct_loses_equal_totals(spark):
    dep = spark.createDataFrame([
        (1, 1, "T1", T(1997, 5, 1), 10.0, 1), (2, 1, "T2", T(1997, 5, 1), 10.0, 1),
        (3, 1, "T1", T(1997, 5, 2), 4.0, 6)],                       # code 6 excluded from the sums
        "id long, idcomune int, codicetag string, dataora timestamp_ntz, peso double, tiporifiuto int")
    t = Tables(conferimenti=dep,
               inforifiuti=spark.createDataFrame([(1, 1, "CARTA"), (1, 6, "X")], "idcomune int, codicerifiuto int, descrizione string"),
               associazionenuclei=spark.createDataFrame([("T1", "H"), ("T2", "H")], "codicetag string, codicenucleo string"),
               datinuclei=spark.createDataFrame([(1, "H", "Anna ", "Rossi", "Via", "1", "2", "m")],
                                                "idcomune int, codicenucleo string, nome string, cognome string, indirizzo string, telefono string, cellulare string, mail string"))
    r = H.annual_sheet(t, 1, "1997-01-01", "1997-12-31").collect()
    assert len(r) == 1
    assert r[0].carta == 20.0 and r[0].nome == "Anna"
    # tag totals: T1 = 14, T2 = 10; rows per (household, type) sum them: 24 -> one distinct value
    assert r[0].tot == 24.0 and r[0].coef == 1


def test_wrong_bin_detects_other_input(spark):
    dep = spark.createDataFrame([(1, 1, 4, T(2024, 1, 5, 10, 0, 5), 2.0, 3, 0)],
                                "id long, idcomune int, codicestazione int, dataora timestamp_ntz, peso double, tiporifiuto int, codiceanomalia int")
    ev = _events(spark, [
        (10, 1, 4, "CHIUSURA", T(2024, 1, 5, 9, 0, 0), "1"),
        (11, 1, 4, "APERTURA", T(2024, 1, 5, 10, 0, 0), "2"),       # opened 5 s before: bin input 2
        (12, 1, 4, "CHIUSURA", T(2024, 1, 5, 10, 1, 0), "1"),       # closed 55 s after, note says 1
        (13, 1, 4, "CHIUSURA", T(2024, 1, 5, 12, 0, 0), "2")])
    bins = spark.createDataFrame([(1, 4, 3, 2)], "idcomune int, codicestazione int, tiporifiuto int, inputplc1 smallint")
    rif = spark.createDataFrame([(1, 3, "PLASTICA")], "idcomune int, codicerifiuto int, descrizione string")
    t = Tables(conferimenti=dep, eventi=ev, infocassonetti=bins, inforifiuti=rif, infocomune=_comuni(spark))
    got = [tuple(r) for r in D.wrong_bin(t, "2024-01-05", "2024-01-06").collect()]
    assert got == [("Alfa 4", "Cassonetto PLASTICA", 1)]


def test_stuck_weights_counts_repeats_per_station(spark):
    rows = [(i, 1, 2, T(2024, 1, 10, 8, i), 5.0) for i in range(6)] + [(10, 1, 3, T(2024, 1, 10, 9), 5.0)]
    dep = spark.createDataFrame(rows, "id long, idcomune int, codicestazione int, dataora timestamp_ntz, peso double")
    t = Tables(conferimenti=dep, infocomune=_comuni(spark))
    got = [tuple(r) for r in D.stuck_weights(t, "2024-01-10").select("identificativo", "numeroconferimenti").collect()]
    assert got == [("Alfa 2", 5)]


def test_label_rolls_and_stale(spark):
    dep = spark.createDataFrame([(1, 1, 4, T(1997, 6, 23, 12), 1.0), (2, 1, 4, T(1997, 6, 30, 23, 59, 59), 1.0)],
                                "id long, idcomune int, codicestazione int, dataora timestamp_ntz, peso double")
    ds = spark.createDataFrame([(1, 4, 1234, 500)], "idcomune int, idstazione int, numeroetichette int, maxetichette int")
    t = Tables(conferimenti=dep, datistazione=ds, infocomune=_comuni(spark))
    r = D.label_rolls(t, "1997-06-30").collect()
    assert [(x.primasettimana, x.secondasettimana, x.stampate, x.restanti) for x in r] == [(2, 1, 234, 266)]



def test_battery_phases_hour_field_vs_total(spark):
    rows = [(1, 1, 5, "TENSIONE_RETE", T(2024, 1, 1, 8), "ON"),
            (2, 1, 5, "TENSIONE_RETE", T(2024, 1, 2, 9), "OFF"),     # change after 1 day 1 hour
            (3, 1, 5, "TENSIONE_RETE", T(2024, 1, 4, 12), "ON")]     # change after 2 days 3 hours
    t = Tables(eventi=_events(spark, rows), infocomune=_comuni(spark))
    field = {r.data: r.batteria for r in E.battery_phases(t, 1, 5).collect()}
    total = {r.data: r.batteria for r in E.battery_phases(t, 1, 5, total_hours=True).collect()}
    # the first event has no previous event and is dropped by the debounce
    assert field == {dt.date(2024, 1, 2): " ORE DI CARICA", dt.date(2024, 1, 4): "3 ORE DI SCARICA"}
    assert total == {dt.date(2024, 1, 2): " ORE DI CARICA", dt.date(2024, 1, 4): "51 ORE DI SCARICA"}


def _bin_tables(spark, deposits, events, bins):
    dep = spark.createDataFrame(deposits, "id long, idcomune int, codicestazione int, dataora timestamp_ntz, "
                                          "peso double, tiporifiuto int, codiceanomalia int")
    b = spark.createDataFrame(bins, "idcomune int, codicestazione int, tiporifiuto int, inputplc1 smallint")
    rif = spark.createDataFrame([(1, 3, "PLASTICA"), (1, 4, "ORGANICO")], "idcomune int, codicerifiuto int, descrizione string")
    return Tables(conferimenti=dep, eventi=_events(spark, events), infocassonetti=b, inforifiuti=rif,
                  infocomune=_comuni(spark))


def test_wrong_bin_tolerance_edges(spark):
    """Opening at most 10 s before the deposit, closing at most 120 s after it,
    and the closing at most 120 s after the opening (all inclusive)."""
    d0 = T(2024, 1, 5, 10, 0, 0)
    s = dt.timedelta(seconds=1)
    cases = {4: (-10, 110), 5: (-11, 60), 6: (0, 120), 7: (0, 121)}   # station: (open, close) offsets
    deposits, events, bins = [], [], []
    for st, (o, c) in cases.items():
        deposits.append((st, 1, st, d0, 1.0, 3, 0))
        events += [(st * 10 + 1, 1, st, "CHIUSURA", d0 - 3600 * s, "9"),
                   (st * 10 + 2, 1, st, "APERTURA", d0 + o * s, "2"),
                   (st * 10 + 3, 1, st, "CHIUSURA", d0 + c * s, "7"),       # wrong bin reported
                   (st * 10 + 4, 1, st, "CHIUSURA", d0 + 3600 * s, "2")]
        bins.append((1, st, 3, 2))
    got = sorted(tuple(r) for r in
                 D.wrong_bin(_bin_tables(spark, deposits, events, bins), "2024-01-05", "2024-01-06").collect())
    assert got == [("Alfa 4", "Cassonetto PLASTICA", 1), ("Alfa 6", "Cassonetto PLASTICA", 1)]


def test_wrong_bin_integer_vs_substring_and_bad_notes(spark):
    d0 = T(2024, 1, 5, 10, 0, 0)
    s = dt.timedelta(seconds=1)
    deposits = [(1, 1, 4, d0, 1.0, 3, 0)]
    bins = [(1, 4, 3, 1)]
    events = [(1, 1, 4, "CHIUSURA", d0 - 3600 * s, "0"),
              (2, 1, 4, "APERTURA", d0 - 5 * s, "1"), (3, 1, 4, "CHIUSURA", d0 + 30 * s, "12"),
              (4, 1, 4, "CHIUSURA", d0 + 3600 * s, "1")]
    t = _bin_tables(spark, deposits, events, bins)
    # closing note "12" is another bin: an anomaly when compared as integers, "OK" as a substring
    assert [r.numeroanomalie for r in D.wrong_bin(t, "2024-01-05", "2024-01-06").collect()] == [1]
    assert D.wrong_bin(t, "2024-01-05", "2024-01-06", literal=True).count() == 0
    # a 4-byte and a non-numeric note never break the cast; they just do not match a bin
    bad = [e if e[0] != 3 else (3, 1, 4, "CHIUSURA", d0 + 30 * s, "1234") for e in events]
    bad += [(5, 1, 4, "APERTURA", d0 - 2 * s, "x1")]
    got = D.wrong_bin(_bin_tables(spark, deposits, bad, bins), "2024-01-05", "2024-01-06").collect()
    assert [r.numeroanomalie for r in got] == [1]


def test_wrong_bin_simultaneous_deposits_at_two_stations(spark):
    d0 = T(2024, 1, 5, 10, 0, 0)
    s = dt.timedelta(seconds=1)
    deposits = [(1, 1, 4, d0, 1.0, 3, 0), (2, 1, 6, d0, 1.0, 3, 0)]
    events = []
    for st, eid in ((4, 0), (6, 10)):
        events += [(eid + 1, 1, st, "CHIUSURA", d0 - 3600 * s, "9"),
                   (eid + 2, 1, st, "APERTURA", d0 - 5 * s, "2"), (eid + 3, 1, st, "CHIUSURA", d0 + 30 * s, "7"),
                   (eid + 4, 1, st, "CHIUSURA", d0 + 3600 * s, "2")]
    bins = [(1, 4, 3, 2), (1, 6, 3, 2)]
    t = _bin_tables(spark, deposits, events, bins)
    fixed = sorted(r.identificativo for r in D.wrong_bin(t, "2024-01-05", "2024-01-06").collect())
    literal = sorted(r.identificativo for r in D.wrong_bin(t, "2024-01-05", "2024-01-06", literal=True).collect())
    assert fixed == ["Alfa 4", "Alfa 6"]
    assert literal == ["Alfa 4"]            # DISTINCT ON without the station keeps one of the two


def _wrong_bins(deposits, events, bins, start, end, before, after, window):
    """R19 by all pairs of openings, closings and deposits; of a cycle's candidates the
    smallest matching input counts, then a closing that reports it."""
    s = lambda x: dt.timedelta(seconds=x)

    def reported(note):
        try:
            return int(note) if note is not None and 1 <= len(note.encode()) <= 3 else None
        except ValueError:
            return None
    found = {}
    for station in {b[1] for b in bins}:
        inputs = {b[3] for b in bins if b[1] == station} - {None}
        closes = sorted({(e[4], e[5]) for e in events if e[2] == station and e[3] == "CHIUSURA" and e[4] >= start},
                        key=lambda e: (e[0], e[1] is not None, e[1] or ""))[:-1]
        opens = [(e[4], e[5]) for e in events if e[2] == station and e[3] == "APERTURA" and start.date() <= e[4].date() <= end.date()]
        cycles = {}
        for a, note in opens:
            for b, note2 in closes:
                if a <= b <= a + s(window):
                    for x in {reported(note), reported(note2)} & inputs:
                        rank = (x, reported(note2) != x)
                        cycles[a, b] = min(cycles.get((a, b), rank), rank)
        first = {}
        for d in deposits:
            for x in {b[3] for b in bins if b[1] == station and b[2] == d[5]} if d[2] == station and start <= d[3] <= end else ():
                for (a, b), (on, wrong) in cycles.items():
                    if on == x and d[3] - s(before) <= a <= d[3] <= b <= d[3] + s(after):
                        first[d[3]] = min(first.get(d[3], (b + s(9e6),)), (a, b, d[5], wrong))
        for *_, tipo, wrong in first.values():
            if wrong:
                found[station, tipo] = found.get((station, tipo), 0) + 1
    return sorted((f"Alfa {st}", "Cassonetto " + {3: "PLASTICA", 4: "ORGANICO"}[tipo], n) for (st, tipo), n in found.items())


def test_wrong_bin_equals_all_pairs(spark):
    """Stations of every density: whole and broken seconds, several events at one time,
    notes that are no bin, too long, no number or NULL, waste types with two bins."""
    rnd = random.Random(19)
    base, deposits, events, bins = T(2024, 1, 5, 10), [], [], []
    notes = ["0", "1", "2", "3", "7", " 1", "12", "-1", "1234", "x", "", None]
    for st in range(40):
        span, micros = rnd.choice([30, 200, 600]), rnd.choice([0, 0, 500000, 123456])
        when = lambda: base + dt.timedelta(seconds=rnd.randint(0, span), microseconds=rnd.choice([0, micros]))  # noqa: B023, E731
        own = rnd.choice([notes[:4], notes[1:4], notes])
        for i in range(rnd.choice([3, 12, 40])):
            events += [(0, 1, st, "APERTURA", when(), rnd.choice(own)), (0, 1, st, "CHIUSURA", when(), rnd.choice(own))]
            deposits.append((0, 1, st, when(), 1.0, rnd.choice([3, 4, 5]), rnd.randint(0, 1)))
        events += rnd.sample(events, 3)
        bins += [(1, st, w, x) for w in (3, 4) for x in rnd.sample([0, 1, 2, 3, 12, None], rnd.choice([1, 1, 2]))]
    events += [(0, 1, None, "CHIUSURA", base, "1"), (0, 1, 2, "APERTURA", T(2024, 1, 4, 23, 59, 59), "1")]
    t = _bin_tables(spark, deposits, events, bins)
    for before, after, window in ((10, 120, 120), (60, 20, 45), (2.5, 30, 300)):
        got = sorted(map(tuple, D.wrong_bin(t, "2024-01-05", "2024-01-06", before, after, window).collect()))
        want = _wrong_bins(deposits, events, bins, T(2024, 1, 5), T(2024, 1, 6), before, after, window)
        assert len(want) > 5 and got == want


def _most_rows(plan) -> int:
    """The most rows any node of an executed plan made."""
    kind, found = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    below = ([plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec")
             else [plan.children().apply(i) for i in range(plan.children().size())])
    return max([found.get().value() if found.isDefined() else 0, *map(_most_rows, below)])


def test_wrong_bin_makes_no_row_per_opening_and_closing(spark):
    """One station, 800 openings and 800 closings within 100 seconds: 320,000 pairs."""
    d0 = T(2024, 1, 5, 10)
    at = lambda i, n: d0 + dt.timedelta(microseconds=100_000_000 * i // n)
    events = [(i, 1, 4, "APERTURA", at(i, 800), "2") for i in range(800)] + [(i, 1, 4, "CHIUSURA", at(i, 801), "7") for i in range(801)]
    deposits = [(i, 1, 4, at(i, 200), 1.0, 3, 0) for i in range(200)]
    report = D.wrong_bin(_bin_tables(spark, deposits, events, [(1, 4, 3, 2)]), "2024-01-05", "2024-01-06")
    assert [r.numeroanomalie for r in report.collect()] == [200]
    assert _most_rows(report._jdf.queryExecution().executedPlan()) < 10_000


def test_wrong_bin_of_several_closings_at_one_time_any_may_report_the_bin(spark):
    d0, s = T(2024, 1, 5, 10), dt.timedelta(seconds=1)
    late = (9, 1, 4, "CHIUSURA", d0 + 3600 * s, "7")
    for notes, wrong in ((["7", "2"], []), (["2", None], []), (["7", "8"], [1])):
        events = [(1, 1, 4, "APERTURA", d0 - 5 * s, "2"), late] + [(2, 1, 4, "CHIUSURA", d0 + 30 * s, x) for x in notes]
        t = _bin_tables(spark, [(1, 1, 4, d0, 1.0, 3, 0)], events, [(1, 4, 3, 2)])
        assert [r.numeroanomalie for r in D.wrong_bin(t, "2024-01-05", "2024-01-06").collect()] == wrong


def test_repeat_deposits_weight_difference_edge(spark):
    rows = [(1, 1, 2, "T1", T(2024, 1, 5, 8, 0), 10.0, 3, 0), (2, 1, 2, "T1", T(2024, 1, 5, 8, 1), 10.999, 3, 0),
            (3, 1, 2, "T1", T(2024, 1, 5, 8, 2), 11.999, 3, 0), (4, 1, 3, "T2", T(2024, 1, 5, 8, 3), 5.0, 3, 0),
            (5, 1, 2, "T1", T(2024, 1, 5, 8, 4), 5.5, 3, 0)]       # previous (globally) is T2: not a repeat
    dep = spark.createDataFrame(rows, "id long, idcomune int, codicestazione int, codicetag string, "
                                      "dataora timestamp_ntz, peso double, tiporifiuto int, codiceanomalia int")
    got = [(r.ora, round(r.diffpeso, 3)) for r in
           D.repeat_deposits(Tables(conferimenti=dep), 1, "2024-01-05", "2024-01-05", since="2020-01-01").collect()]
    assert got == [("08:01:00", 0.999)]    # 0.999 apart counts, 1.000 does not


def test_idle_households_before_inside_after(spark):
    a = spark.createDataFrame([(1, "H1", "A"), (1, "H1", "B"), (1, "H2", "C"), (1, "H3", "D"), (2, "H4", "E")],
                              "idcomune int, codicenucleo string, codicetag string")
    dep = spark.createDataFrame([("A", T(2024, 1, 3)), ("C", T(2024, 1, 10)), ("D", T(2024, 1, 31, 23, 59, 59)),
                                 ("B", T(2024, 2, 1))], "codicetag string, dataora timestamp_ntz")
    t = Tables(associazionenuclei=a, conferimenti=dep)
    got = {r.codicenucleo: r.codicitag for r in H.idle_households(t, 1, "2024-01-05", "2024-01-31").collect()}
    # H1: deposits only before (A) and after (B) the period -> idle; H2, H3: inside (last second counts)
    assert got == {"H1": "A, B"}


def test_clock_repair_station_change_fixed_vs_literal(spark):
    from binsight.operators.repair import clock_repair
    d = dt.date(2017, 1, 1)
    rows = [(1, 2, 1, T(2017, 3, 1, 10), d), (2, 2, 1, T(2017, 3, 1, 11), d),
            (3, 2, 2, T(2017, 2, 1, 9), d), (4, 2, 2, T(2017, 2, 1, 10), d)]   # station 2 starts earlier
    df = spark.createDataFrame(rows, "id long, idcomune int, codicestazione int, dataora timestamp_ntz, data date")
    fixed = {r.idn: r.riavvio for r in clock_repair(df, cutoff="2016-12-31").collect()}
    literal = {(r.idn, r.riavvio) for r in clock_repair(df, cutoff="2016-12-31", literal=True).collect()}
    assert 3 not in fixed                  # first row of a station has no previous row there
    assert (3, 1) in literal               # globally it follows station 1's last row: a jump back
