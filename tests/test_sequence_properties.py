"""Property test: the sequence engine equals plain windows for any data,
NULL keys/values, hot groups and any number of ranges."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from binsight.operators.sequence import Lag, Running, Sequence

rows_strategy = st.lists(
    st.tuples(st.one_of(st.none(), st.integers(0, 3)),          # group key (NULL allowed)
              st.integers(0, 20),                               # order value (ties allowed)
              st.one_of(st.none(), st.integers(-5, 5))),        # value
    min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 9))
def test_sequence_matches_plain_windows(spark, rows, parts):
    data = [(i, g, t, v) for i, (g, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g int, t int, v int")
    got = (Sequence(df, order=["t", "id"], by=["g"], partitions=parts)
           .apply([Lag("pv", "v"), Running("sv", "v", "sum"), Running("cv", "v", "count"),
                   Running("fv", "v", "first_nonnull"), Lag("gpv", "v", group=[]),
                   Running("lv", "v", "last_nonnull"), Running("lvx", "v", "last_nonnull", exclusive=True)])
           .result())
    w = Window.partitionBy("g").orderBy("t", "id")
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exp = df.select("*", F.lag("v").over(w).alias("pv"), F.sum("v").over(wr).alias("sv"),
                    F.count("v").over(wr).alias("cv"), F.first("v", ignorenulls=True).over(wr).alias("fv"),
                    F.lag("v").over(Window.orderBy(F.col("g").asc_nulls_first(), "t", "id")).alias("gpv"),
                    F.last("v", ignorenulls=True).over(wr).alias("lv"),
                    F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("lvx"))
    cols = ["id", "pv", "sv", "cv", "fv", "gpv", "lv", "lvx"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=25),
       right=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 400)), min_size=1, max_size=25),
       lo=st.integers(-90, 60), width=st.integers(0, 120), frac=st.sampled_from([0, 250000]))
def test_interval_match_equals_naive_join(spark, left, right, lo, width, frac):
    import datetime as dt

    from binsight.operators.matching import interval_match
    base = dt.datetime(2024, 1, 1)
    L = [(i, k, base + dt.timedelta(seconds=s, microseconds=frac)) for i, (k, s) in enumerate(left)]
    R = [(j, k, base + dt.timedelta(seconds=s)) for j, (k, s) in enumerate(right)]
    hi = lo + width
    ldf = spark.createDataFrame(L, "lid int, lk int, lt timestamp_ntz")
    rdf = spark.createDataFrame(R, "rid int, rk int, rt timestamp_ntz")
    got = {(r.lid, r.rid) for r in interval_match(ldf, rdf, ["lk"], ["rk"], "lt", "rt", lo, hi).collect()}
    exp = {(a, b) for a, ka, ta in L for b, kb, tb in R
           if ka == kb and ta + dt.timedelta(seconds=lo) <= tb <= ta + dt.timedelta(seconds=hi)}
    assert got == exp
