"""PostgreSQL behaviours the reports depend on."""

import datetime as dt

from pyspark.sql import functions as F

from binsight.functions import pg
from binsight.operators import filters
from binsight.plans.households import HOUSEHOLD_CODE_PATTERN


def test_similar_to_dot_is_literal(spark):
    df = spark.createDataFrame([("AB.1234.5678",), ("ABx1234x5678",), ("ABC.1234.5678",), (None,)], "c string")
    out = {r.c: r.m for r in df.select("c", pg.similar_to("c", HOUSEHOLD_CODE_PATTERN).alias("m")).collect()}
    assert out == {"AB.1234.5678": True, "ABx1234x5678": False, "ABC.1234.5678": True, None: None}


def test_similar_to_wildcards():
    assert pg.similar_to_regex("a%b_") == r"\A(?s:a.*b.)\z"


def test_concat_skips_null_but_pipe_propagates(spark):
    r = spark.range(1).select(pg.pg_concat(F.lit("A"), F.lit(" "), F.lit(None).cast("string")).alias("a"),
                              F.concat(F.lit("A"), F.lit(None).cast("string")).alias("b")).first()
    assert r.a == "A " and r.b is None


def test_weekday_labels(spark):
    # 2024-01-07 is a Sunday, 2024-01-09 a Tuesday
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 10),), (dt.datetime(2024, 1, 9, 10),)], "t timestamp_ntz")
    got = [tuple(r) for r in df.select(pg.weekday_label("t", "accented"), pg.weekday_label("t", "plain"),
                                       pg.weekday_label("t", "short")).collect()]
    sets = (pg.WEEKDAYS_ACCENTED, pg.WEEKDAYS_PLAIN, pg.WEEKDAYS_SHORT)
    assert got == [tuple(x[0] for x in sets), tuple(x[2] for x in sets)]


def test_truncated_ratio(spark):
    df = spark.createDataFrame([(45.678, 1.0), (-45.678, 1.0), (1.0, 3.0), (0.29, 1.0), (1.0, 0.0)], "x double, y double")
    got = [None if r[0] is None else str(r[0]) for r in df.select(pg.truncated_ratio("x", "y")).collect()]
    assert got == ["45.67", "-45.67", "0.33", "0.29", None]


def test_number_and_time_texts(spark):
    df = spark.createDataFrame([(0.0, dt.datetime(2024, 1, 5, 8)), (1.5, dt.datetime(2024, 1, 5, 8, 0, 0, 250000))], "x double, t timestamp_ntz")
    assert [tuple(r) for r in df.select(pg.num_text("x"), pg.time_text("t")).collect()] == [("0", "08:00:00"), ("1.500", "08:00:00.25")]


def test_similar_to_is_whole_string(spark):
    df = spark.createDataFrame([("AB\n",), ("AB",), ("A\nB",), ("50%",), ("50x",)], "c string")
    match = lambda p: [r[0] for r in df.select(pg.similar_to("c", p)).collect()]
    assert match("[A-Z]{2}") == [False, True, False, False, False]
    assert match("A%B") == [False, True, True, False, False]
    assert match("50\\%") == [False, False, False, True, False]


def test_decode_flag(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "f int")
    assert [r[0] for r in df.select(pg.decode_flag("f")).collect()] == ["NO", "SI", None, None]


def test_night_window_boundaries(spark):
    times = [dt.datetime(2024, 1, 5, 2, 59, 58), dt.datetime(2024, 1, 5, 2, 59, 59), dt.datetime(2024, 1, 5, 4, 0, 0),
             dt.datetime(2024, 1, 5, 4, 0, 0, 500000)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    kept = [r.t for r in filters.exclude_time_of_day(df, "t", "02:59:59", "04:00:00").collect()]
    assert kept == [times[0], times[3]]


def test_in_days_includes_last_second_in_instants_does_not(spark):
    times = [dt.datetime(2024, 1, 20, 0, 0, 0), dt.datetime(2024, 1, 20, 23, 59, 59), dt.datetime(2024, 1, 21)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    days = [r.t for r in filters.in_days(df, "t", "2024-01-05", "2024-01-20").collect()]
    inst = [r.t for r in filters.in_instants(df, "t", "2024-01-05", "2024-01-20").collect()]
    assert days == times[:2]
    assert inst == times[:1]


def test_in_days_reaches_parquet_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(dt.datetime(2024, 1, 5), 1)], "t timestamp_ntz, v int").write.parquet(path)
    plan = filters.in_days(spark.read.parquet(path), "t", "2024-01-05", "2024-01-06")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t," in plan


def test_optional_eq_falsy_means_all(spark):
    df = spark.range(5)
    assert filters.optional_eq(df, "id", 0).count() == 5
    assert filters.optional_eq(df, "id", None).count() == 5
    assert filters.optional_eq(df, "id", 3).count() == 1


def test_bindings_satisfy_domain_schemas(spark):
    import os

    import pytest

    from binsight.sources.bindings import bind_driver_tables
    from binsight.sources.schema import SCHEMAS, check_table, check_tables
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    t = bind_driver_tables(spark, sf)
    check_tables(t, [n for n in SCHEMAS if n in t and n != "rdannuale"])
    bad = spark.createDataFrame([(1, "x")], "id string, nome string")
    assert check_table("infocomune", bad) == ["infocomune.id: string is not int"]


def test_ntz_differences_ignore_session_time_zone(spark):
    """NTZ arithmetic must not see DST: 01:30 -> 03:30 on the US spring-forward
    day is two hours whatever the session time zone."""
    from binsight.operators.matching import epoch_seconds
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Europe/Rome"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 30), dt.datetime(2024, 3, 10, 3, 30)),
                                        (dt.datetime(2024, 10, 27, 3, 30), dt.datetime(2024, 10, 27, 1, 30))],
                                       "a timestamp_ntz, b timestamp_ntz")
            got = [r[0] for r in df.select(pg.seconds_between("b", "a")).collect()]
            assert got == [7200.0, -7200.0], tz
            e = df.select(epoch_seconds(F.col("a"))).first()[0]
            assert e == int((dt.datetime(2024, 3, 10, 1, 30) - dt.datetime(1970, 1, 1)).total_seconds()), tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
