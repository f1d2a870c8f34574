"""Partitioned and bucketed facts: the same rows, pruned folders, no exchange."""

import re

import pytest
from pyspark.sql import functions as F

from binsight.plans import deposits, households
from binsight.sources import bind_driver_tables
from binsight.sources.layout import attach_fact, from_layout, in_months, is_hot, write_fact

SF = "/root/testdata/sf0.001"
PERIOD = ("1997-01-10", "1997-03-31")


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    plain = bind_driver_tables(spark, SF)
    path = str(tmp_path_factory.mktemp("facts") / "conferimenti")
    assert write_fact(plain.conferimenti, "layout_conferimenti", path, buckets=8)
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")         # plans with their whole filters
    yield plain, from_layout(spark, {"conferimenti": "layout_conferimenti"}, plain), path
    spark.conf.set("spark.sql.maxMetadataStringLength", length)
    spark.sql("DROP TABLE layout_conferimenti")


def test_rows_and_columns_are_those_of_the_plain_table(tables):
    plain, laid, _ = tables
    assert set(laid.conferimenti.columns) == set(plain.conferimenti.columns)
    assert rows(laid.conferimenti.select(plain.conferimenti.columns)) == rows(plain.conferimenti)


def test_period_report_prunes_folders(spark, tables):
    plain, _, _ = tables
    laid = from_layout(spark, {"conferimenti": "layout_conferimenti"}, plain, period=PERIOD)
    out = deposits.recent_totals(laid, 1, *PERIOD)
    assert rows(out) == rows(deposits.recent_totals(plain, 1, *PERIOD)) and out.count()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(out), re.DOTALL).group(1)
    assert "idcomune" in filters and filters.count("mese") >= 2
    files = in_months(spark.table("layout_conferimenti").where("idcomune = 1"), *PERIOD).inputFiles()
    months = {re.search(r"mese=([0-9-]+)", f).group(1) for f in files}
    assert months <= {"1997-01-01", "1997-02-01", "1997-03-01", "1997-04-01"} and len(months) >= 3


def test_household_sheet_moves_no_deposits(spark, tables):
    plain, laid, _ = tables
    assert rows(households.household_sheet(laid, 1, *PERIOD)) == rows(households.household_sheet(plain, 1, *PERIOD))
    per_tag = laid.conferimenti.groupBy("codicetag").agg(F.sum("peso").alias("kg"))
    assert "Exchange" not in plan(per_tag) and "Exchange" in plan(plain.conferimenti.groupBy("codicetag").agg(F.sum("peso")))
    # in the report's plan no exchange has the fact's scan below it without an aggregation by tag between
    lines = plan(households.household_sheet(laid, 1, *PERIOD)).splitlines()
    depth = [len(re.match(r"[^A-Za-z*]*", x).group(0)) for x in lines]
    scans = [i for i, x in enumerate(lines) if "layout_conferimenti" in x]
    assert scans
    for i in scans:
        d = depth[i]
        for j in range(i - 1, -1, -1):
            if depth[j] < d:
                d = depth[j]
                assert "Exchange" not in lines[j], lines[j]
                if "Join" in lines[j]:
                    break


def test_attached_folder_reads_the_same(spark, tables):
    plain, _, path = tables
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table("layout_conferimenti").schema)
    again = attach_fact(spark, "layout_again", path, schema, buckets=8)
    try:
        assert rows(again.select(plain.conferimenti.columns)) == rows(plain.conferimenti)
        assert "Exchange" not in plan(again.groupBy("codicetag").count())
    finally:
        spark.sql("DROP TABLE layout_again")


def test_a_hot_tag_is_not_bucketed(spark, tmp_path):
    df = spark.range(900).selectExpr("cast(1 as int) idcomune", "case when id % 3 = 0 then 'hot' else 't' || id end codicetag",
                                     "timestamp_ntz'2024-01-31 23:59:59' + make_interval(0, 0, 0, 0, 0, 0, id) dataora")
    df = df.unionByName(spark.createDataFrame([(None, None, None)], "idcomune int, codicetag string, dataora timestamp_ntz"))
    assert is_hot(df, "codicetag", 64) and not is_hot(df, "codicetag", 4) and not is_hot(df.limit(0), "codicetag", 64)
    assert not write_fact(df, "layout_hot", str(tmp_path / "hot"))
    try:
        assert rows(spark.table("layout_hot").drop("mese").select(df.columns)) == rows(df)
        with pytest.raises(ValueError):
            write_fact(spark.table("layout_hot"), "layout_twice", str(tmp_path / "twice"))
    finally:
        spark.sql("DROP TABLE layout_hot")
