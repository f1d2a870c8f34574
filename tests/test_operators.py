"""Operators against brute force on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from binsight.operators.matching import interval_match
from binsight.operators.presence import absent
from binsight.operators.quality import exact_duplicates
from binsight.operators.repair import clock_repair
from binsight.operators.totals import roll_counter, sorted_share


def test_absent_null_aware_vs_plain(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right_no_null = spark.createDataFrame([(2,)], "k int")
    right_null = spark.createDataFrame([(2,), (None,)], "k int")
    assert sorted(r.k for r in absent(left, right_no_null, "k").collect()) == [1]
    assert absent(left, right_null, "k").count() == 0                      # NOT IN with a NULL
    assert sorted((r.k for r in absent(left, right_null, "k", null_aware=False).collect()),
                  key=lambda x: (x is None, x)) == [1, None]                 # NOT EXISTS


def test_interval_match_equals_naive(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    left = [(i, rnd.randint(0, 2), base + dt.timedelta(seconds=rnd.randint(0, 3000))) for i in range(120)]
    right = [(j, rnd.randint(0, 2), base + dt.timedelta(seconds=rnd.randint(0, 3000))) for j in range(150)]
    L = spark.createDataFrame(left, "lid int, lk int, lt timestamp_ntz")
    R = spark.createDataFrame(right, "rid int, rk int, rt timestamp_ntz")
    for lo, hi in [(0, 120), (-10, 0), (-300, 45)]:
        got = {(r.lid, r.rid) for r in interval_match(L, R, ["lk"], ["rk"], "lt", "rt", lo, hi).collect()}
        exp = {(a, b) for a, ka, ta in left for b, kb, tb in right
               if ka == kb and ta + dt.timedelta(seconds=lo) <= tb <= ta + dt.timedelta(seconds=hi)}
        assert got == exp, (lo, hi)


@pytest.mark.parametrize("lo, hi, split", [(0, 120, 1), (-10, 0, 1), (-300, 45, 4), (-0.75, 0.5, 1), (7, 7, 1), (0, 1000, 3)])
def test_interval_match_first_is_the_earliest_pair(spark, lo, hi, split):
    """Repeated left rows stay, repeated right rows count once, NULL keys and times match nothing."""
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    some = lambda: base + dt.timedelta(seconds=rnd.randint(0, 400), milliseconds=rnd.choice([0, 0, 250, 999]))
    left = [(i, rnd.choice([0, 1, 2, None]), some()) for i in range(150)]
    left += left[:9] + [(500, 0, None)]
    right = [(j, rnd.choice([0, 1, 1, None]), some()) for j in range(90)]
    right += [(j + 1000, k, ts) for j, k, ts in right[:30]] + right[:5] + [(2000, 0, None)]
    L = spark.createDataFrame(left, "lid int, lk int, lt timestamp_ntz")
    R = spark.createDataFrame(right, "rid int, rk int, rt timestamp_ntz")
    got = interval_match(L, R, ["lk"], ["rk"], "lt", "rt", lo, hi, split=split, first=True)
    assert got.columns == [*L.columns, *R.columns]
    want = []
    for a, ka, ta in left:
        near = [(tb, b) for b, kb, tb in right if None not in (ka, kb, ta, tb) and ka == kb
                and ta + dt.timedelta(seconds=lo) <= tb <= ta + dt.timedelta(seconds=hi)]
        if near:
            at = min(near)[0]
            want.append((a, ka, ta, min(b for tb, b in near if tb == at), ka, at))
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_duplicates_lists_ids_numerically(spark):
    df = spark.createDataFrame([(10, "a"), (9, "a"), (100, "a"), (5, "b")], "id long, k string")
    r = exact_duplicates(df, ["k"], "id").collect()
    assert len(r) == 1 and r[0].stringaid == "9 10 100" and r[0].conteggio == 3


def test_roll_counter_matches_div_case(spark):
    df = spark.createDataFrame([(0, 500), (499, 500), (500, 500), (1234, 500), (7, 3)], "n int, m int")
    used, left = roll_counter("n", "m")
    got = [(r.u, r.l) for r in df.select(used.alias("u"), left.alias("l")).collect()]
    exp = []
    for n, m in [(0, 500), (499, 500), (500, 500), (1234, 500), (7, 3)]:
        d = n // m
        exp.append((n, m - n) if d < 1 else (n - d * m, m - (n - d * m)))
    assert got == exp


def test_sorted_share(spark):
    df = spark.createDataFrame([(10.0, 3.0), (0.0, 0.0), (3.0, 1.0), (10000.0, 9565.0), (None, 1.0)], "tot double, ind double")
    got = [None if r[0] is None else str(r[0]) for r in df.select(sorted_share("tot", "ind")).collect()]
    assert got == ["70.00", "0.00", "66.66", "4.35", None]
    # every hundredth from 0.01 to 100.00 comes out as it went in
    every = spark.range(1, 10001).selectExpr("10000.0D as tot", "cast(10000 - id as double) as ind", "id")
    assert every.filter(sorted_share("tot", "ind") * 100 != F.col("id")).count() == 0


def _deposits(spark, rows):
    return spark.createDataFrame(rows, "id long, idcomune int, codicestazione int, dataora timestamp_ntz, data date")


def test_clock_repair_monotone_clock_has_no_jumps(spark):
    t0 = dt.datetime(2017, 3, 1)
    rows = [(i, 2, 1, t0 + dt.timedelta(minutes=i), t0.date()) for i in range(1, 30)]
    out = clock_repair(_deposits(spark, rows), cutoff="2016-12-31")
    assert out.filter(F.col("riavvio") == 1).count() == 0
    assert out.filter(F.col("nuovadataora").isNotNull() | F.col("nuovadataora2").isNotNull()).count() == 0


def test_clock_repair_jump_back(spark):
    d = dt.date(2017, 1, 1)
    ts = [dt.datetime(2017, 3, 1, 10), dt.datetime(2017, 3, 1, 11),        # normal, after cutoff
          dt.datetime(2016, 1, 1, 0, 0), dt.datetime(2016, 1, 1, 0, 5),    # jump back, then old-dated rising
          dt.datetime(2016, 1, 1, 0, 7)]
    rows = [(i + 1, 2, 1, t, d) for i, t in enumerate(ts)]
    out = {r.idn: r for r in clock_repair(_deposits(spark, rows), cutoff="2016-12-31").collect()}
    assert out[3].riavvio == 1 and out[3].flag
    assert out[3].nuovadataora == dt.datetime(2017, 3, 1, 11, 0, 30)      # previous time + 30 s
    assert out[4].riavvio == 2 and out[5].riavvio == 2
    # class 2 right after the jump: previous time - previous (negative) step
    assert out[4].nuovadataora == dt.datetime(2017, 3, 1, 11, 0, 0)
    # carried along the island: jump's rebuilt time + own step (5 min) ...
    assert out[4].nuovadataora2 == dt.datetime(2017, 3, 1, 11, 5, 30)
    # ... then first class-2 rebuilt time + running sum of positive steps (5 + 2 min)
    assert out[5].nuovadataora2 == dt.datetime(2017, 3, 1, 11, 7, 0)
    assert out[3].conteggio == out[4].conteggio == out[5].conteggio


def test_sinks_and_crosstab(spark, tmp_path):
    from binsight.operators.sink import crosstab, write_rows_json
    df = spark.createDataFrame([(7, "11.0 , 22.5", None), (3, "x", "y")], "codice int, coordinate string, note string")
    path = str(tmp_path / "rows")
    write_rows_json(df, path)
    back = sorted(tuple(r.row) for r in spark.read.json(path).collect())
    assert back == [("3", "x", "y"), ("7", "11.0 , 22.5", None)]
    x = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0), (2, 0, 1.0), (1, 15, 5.0), (1, None, 7.0)], "st int, k int, v double")
    got = {r.st: (r["0"], r["1"], r["altri"]) for r in crosstab(x, "st", "k", "v", values=[0, 1], other="altri").collect()}
    assert got == {1: (2.0, 3.0, 12.0), 2: (1.0, None, None)}


def _sql_not_in(left_row, other_rows):
    """Three-valued ``left_row NOT IN other_rows``: True / False / None."""
    result = True
    for o in other_rows:
        eq = True
        for a, b in zip(left_row, o):
            if a is None or b is None:
                eq = None if eq is not False else False
            elif a != b:
                eq = False
        if eq is True:
            return False
        if eq is None:
            result = None
    return result


def test_absent_matches_three_valued_not_in(spark):
    rnd = random.Random(11)
    vals = [None, 1, 2]
    for k in (1, 2, 3):
        for trial in range(6):
            left = [tuple(rnd.choice(vals) for _ in range(k)) for _ in range(rnd.randint(0, 7))]
            other = [tuple(rnd.choice(vals) for _ in range(k)) for _ in range(rnd.randint(0, 4))]
            cols = [f"c{i}" for i in range(k)]
            schema = ", ".join(f"{c} int" for c in cols)
            L = spark.createDataFrame([(i, *r) for i, r in enumerate(left)], "rid int, " + schema)
            R = spark.createDataFrame(other, schema)
            got = sorted(r.rid for r in absent(L, R, cols).collect())
            exp = sorted(i for i, r in enumerate(left) if _sql_not_in(r, other) is True)
            assert got == exp, (k, left, other)


def test_absent_runs_no_job_while_built(spark):
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    left, other = spark.range(5).selectExpr("id a", "id b"), spark.range(3).selectExpr("id a", "id b")
    sc.setJobGroup("absent-build", "")
    try:
        out = absent(left, other, ["a", "b"])
        assert list(tracker.getJobIdsForGroup("absent-build")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 2


def test_absent_with_known_columns(spark):
    left = spark.createDataFrame([(1, 1), (1, None), (2, 5)], "a int, b int")
    other = spark.createDataFrame([(1, 1), (2, None)], "a int, b int")
    assert [tuple(r) for r in absent(left, other, ["a", "b"], not_null=["a"]).collect()] == []
    other = spark.createDataFrame([(1, 1)], "a int, b int")
    assert [tuple(r) for r in absent(left, other, ["a", "b"], not_null=["a"], other_not_null=["a", "b"]).collect()] == [(2, 5)]


def test_a_null_group_with_facts_is_not_absent(spark):
    from binsight.operators.presence import absent_in_period
    dim = spark.createDataFrame([("t1", 1, None), ("t2", 1, "h"), ("t3", 1, "g")], "tag string, c int, h string")
    fact = spark.createDataFrame([("t1", dt.datetime(2024, 1, 2)), ("t3", dt.datetime(2023, 1, 2))], "tag string, ts timestamp_ntz")
    assert sorted(r.tag for r in absent_in_period(dim, fact, "tag", "ts", "2024-01-01", "2024-01-31", ["c", "h"]).collect()) == ["t2", "t3"]


def test_clock_repair_sums_whole_microseconds(spark):
    """Ten steps of 0.1 s after a jump: doubles would miss the sum."""
    d, t0 = dt.date(2017, 1, 1), dt.datetime(2016, 1, 1)
    ts = [dt.datetime(2017, 3, 1)] + [t0 + dt.timedelta(microseconds=100_000 * i) for i in range(12)]
    out = {r.idn: r for r in clock_repair(_deposits(spark, [(i + 1, 2, 1, t, d) for i, t in enumerate(ts)]), cutoff="2016-12-31",
                                          only={"idcomune": 2, "codicestazione": 1}).collect()}
    base = out[3].nuovadataora
    assert out[13].nuovadataora2 == base + dt.timedelta(microseconds=100_000 * 11)
    assert clock_repair(_deposits(spark, [(1, 2, 1, t0, d)]), cutoff="2016-12-31", only={"idcomune": 3}).count() == 0


def test_literal_clock_repair_shuffles_its_rows_twice(spark):
    """All rows once, whatever columns they have, and the station's rows once:
    the summary and the result of a step share one exchange."""
    df = spark.range(400).selectExpr("id", "cast(id % 3 as int) as idcomune", "cast(id % 4 as int) as codicestazione", "cast(id as string) as codicetag",
                                     "timestamp_ntz'2016-12-01' + make_dt_interval(id * 7919 % 101) as dataora")
    aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for only in (None, {"idcomune": 2, "codicestazione": 1}):
            plan = clock_repair(df, cutoff="2016-12-31", literal=True, only=only)._jdf.queryExecution().executedPlan().toString()
            deals = [x.lstrip(" :+-") for x in plan.splitlines() if "direct_shuffle_partition_id" in x]
            assert sum(x.startswith("Exchange") for x in deals) == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)


def _literal_by_hand(rows, cut, min_id, only):
    us = lambda a, b: None if a is None or b is None else round((a - b) / dt.timedelta(microseconds=1))
    before, at_side, jumps, found = None, {}, 0, []
    for i, c, st, t, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        side = 0 if t is None or t == cut else 1 if t > cut else -1
        d_all, d_side = us(t, before), us(t, at_side.get(side)) if side else None
        before = t
        if side:
            at_side[side] = t
        if i <= min_id:
            continue
        jump = d_all is not None and d_all < 0
        jumps += jump
        kinds = [1] * jump + [1 - side] * (d_side is not None and d_side > 0)
        found += [(c, st, i, t, k, d_all if k == 1 else d_side, jumps) for k in sorted(kinds)]
    out, last, rebuilt, first2, total = {}, None, {}, {}, {}
    for c, st, i, t, k, d, n in found:
        pk, pt, pd, pst = last or (None, None, None, None)
        new = pt + dt.timedelta(seconds=30) if (k, pk) == (1, 0) else pt - dt.timedelta(microseconds=pd) if (k, pk) == (2, 1) else None
        island, same = (c, st, n), pst == (c, st)
        if k == 2:
            first2.setdefault(island, new)
        total[island] = total.get(island, 0) + max(d, 0)
        base = (rebuilt.get(island), d) if same and (k, pk) == (2, 1) else (first2.get(island), total[island]) if same and (k, pk) == (2, 2) else (None, 0)
        new2 = base[0] + dt.timedelta(microseconds=base[1]) if base[0] else None
        rebuilt[island], last = new, (k, t, d, (c, st))
        if not only or (c, st) == only:
            out[i, k] = (c, st, t, d / 1e6, k == 1, n, new, new2)
    return out


def test_literal_clock_repair_by_hand(spark):
    """Twin rows, jumps across stations, rows at the cutoff and without a time, one
    station and all, a smallest id."""
    rng, cut = random.Random(51), dt.datetime(2016, 12, 31)
    for n, parts, min_id, only in ((150, "3", None, None), (250, "9", 60, (2, 1))):
        rows = []
        for i in range(1, n + 1):
            t = cut + dt.timedelta(seconds=rng.choice([-3600, -60, 0, 60]) + (rng.randrange(120) if i % 9 else 0), microseconds=rng.choice([0, 250_001]))
            rows.append((i, rng.randrange(1, 4), rng.randrange(3), None if i % 37 == 0 else cut if i % 23 == 0 else t, None))
        was = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out = clock_repair(_deposits(spark, rows).repartition(3), cutoff="2016-12-31", literal=True, min_id=min_id,
                               only=only and dict(zip(("idcomune", "codicestazione"), only))).collect()
            got = {(r.idn, r.riavvio): (r.idcomune, r.codicestazione, r.dataora, r.delta_dataora, r.flag, r.conteggio, r.nuovadataora, r.nuovadataora2)
                   for r in out}
            assert len(got) == len(out) and got == _literal_by_hand(rows, cut, min_id or 0, only)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)


def test_active_inactive(spark):
    from binsight.operators.totals import active_inactive
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id int, tag string")
    fact = spark.createDataFrame([("a", dt.datetime(2024, 1, 5), 2.0), ("a", dt.datetime(2023, 1, 5), 9.0), ("b", dt.datetime(2023, 6, 1), 1.0),
                                  ("d", dt.datetime(2025, 1, 1), 4.0)], "tag string, ts timestamp_ntz, kg double")
    run = lambda **k: sorted((r.tag, r.n, r.last_ts and r.last_ts.year) for r in active_inactive(
        dim, fact, "tag", "ts", "2024-01-01", "2024-12-30", {"n": F.count("kg")}, **k).collect())
    assert run() == [("a", 1, 2024), ("b", 0, 2023), ("c", 0, None)]              # d: only later facts, in neither half
    assert run(always_idle=True) == [("a", 0, 2024), ("a", 1, 2024), ("b", 0, 2023), ("c", 0, None), ("d", 0, 2025)]


def test_small_totals(spark):
    from binsight.operators.filters import bad_format, bad_length
    from binsight.operators.quality import duplicate_summary
    from binsight.operators.totals import dominant_signal, pct_of_total, per_group_population, period_counts
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0)], "k string, v double")
    assert sorted(((r.k, r.v, r.tot, r.percent) for r in pct_of_total(df, ["k"], "v").collect()), key=repr) == [
        ("a", 1.0, 4.0, 25.0), ("a", 3.0, 4.0, 75.0), (None, 2.0, 2.0, 100.0)]
    assert [(r.k, r.n, r.m) for r in duplicate_summary(df, "k", {"m": F.max("v")}, min_count=2).collect()] == [("a", 2, 3.0)]
    s = spark.createDataFrame([("ab",), ("abc",), ("ABC\n",), ("ABC",), (None,)], "c string")
    assert sorted(r.c for r in bad_format(s, "c", "[A-Z]{3}").collect()) == ["ABC\n", "ab", "abc"]
    assert sorted(r.c for r in bad_length(s, "c", 3).collect()) == ["ABC\n", "ab"]
    e = spark.createDataFrame([(1, "x", dt.datetime(2024, 1, 1)), (1, "y", dt.datetime(2024, 1, 2)), (1, "y", dt.datetime(2024, 1, 3)), (2, "x", dt.datetime(2024, 1, 9)),
                               (2, None, dt.datetime(2024, 1, 9))], "st int, ev string, ts timestamp_ntz")
    assert sorted((r.st, r.avviso, r.segnalazioni) for r in dominant_signal(e, ["st"], "ev", ["x", "y"]).collect()) == [(1, "y", 2), (2, "x", 1)]
    got = period_counts(e, ["st"], "ts", {"p": ("2024-01-01", "2024-01-02"), "q": ("2024-01-02", "2024-01-09")}, "ev", rows={"r": ("2024-01-09", "2024-01-09")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 2, 0), (2, 0, 1, 2)]
    bridge = spark.createDataFrame([("a", "g"), ("b", "g"), ("z", "g")], "k string, grp string")
    fact = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    assert [tuple(r) for r in per_group_population(fact, bridge, "k", ["grp"], {"n": F.count("v"), "s": F.sum("v")}, {"tags": F.count("k"), "s": F.sum("s")}).collect()] == [("g", 2, 8)]


def test_bindings_of_two_folders_do_not_mix(spark):
    import os

    import pytest

    from binsight.sources.bindings import bind_driver_tables
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("driver test data not present")
    small = bind_driver_tables(spark, "/root/testdata/sf0.001")
    large = bind_driver_tables(spark, "/root/testdata/sf0.01")
    spark.range(3).createOrReplaceTempView("events")
    try:
        n = large.eventi.count()
        assert small.eventi.count() < n and small.eventi.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    finally:
        spark.catalog.dropTempView("events")


def test_title_columns(spark):
    from binsight.operators.sink import title_columns
    assert title_columns(spark.createDataFrame([(1, 2)], "nomestazione int, riavvii int")).columns == \
        ["Nomestazione", "Riavvii"]


def test_sort_like_original_pg_null_order(spark):
    from binsight.plans import display, events
    df = spark.createDataFrame([(1, None), (2, 5), (None, 3)], "stazione int, orario int")
    got = [tuple(r) for r in display.sort_like_original(df, "power_changes").collect()]
    assert got == [(1, None), (2, 5), (None, 3)]          # ASC: NULLs last; DESC: NULLs first
    # part of a text, carried columns, a report with two orders
    df = spark.createDataFrame([("Dom  2024-01-07 10:00:00",), ("Lun  2024-01-08 09:00:00",), ("Ven  2024-01-05 11:00:00",)], "data string")
    assert [r.data[:3] for r in display.sort_like_original(df, "deposit_listing").collect()] == ["Lun", "Dom", "Ven"]
    df = spark.createDataFrame([("a", 1.0, "5.00 %"), ("b", 9.0, "4.35 %"), ("c", 9.0, "10.00 %")], "tag string, __order_totale double, percentualedifferenziata string")
    out = display.sort_like_original(df, "household_sheet")
    assert out.columns == ["tag", "percentualedifferenziata"] and [r.tag for r in out.collect()] == ["c", "b", "a"]      # the share sorts as text
    df = spark.createDataFrame([("2024-01-02", "1"), ("2024-01-01", "2")], "data string, ora string")
    assert [r.ora for r in display.sort_like_original(df, "deposits_with_household").collect()] == ["2", "1"]
    assert [r.ora for r in display.sort_like_original(df.selectExpr("*", "1 as stazione"), "deposits_with_household").collect()] == ["1", "2"]
    # every ordered report exists
    from binsight.operators import repair
    from binsight.plans import deposits, households, stations
    mods = (events, deposits, households, stations, repair)
    assert all(any(hasattr(m, name) for m in mods) for name in display.ORDER_BY)
