"""As-of join, range bounds and chunked texts against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from binsight.operators.asof import asof_join
from binsight.operators.matching import interval_match
from binsight.operators.presence import absent
from binsight.operators.quality import exact_duplicates
from binsight.operators.sequence import RP, Sequence, range_bounds, range_id

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else BASE + dt.timedelta(seconds=seconds)


def rows(rng, n, keys=(1, 1, 1, 2, 3, None)):
    return [(i, rng.choice(keys), rng.choice([None, *range(0, 60)] * 1)) for i in range(n)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("equal", [True, False])
@pytest.mark.parametrize("tolerance", [None, 4])
def test_asof_equals_brute_force(spark, direction, equal, tolerance):
    rng = random.Random(f"{direction}{equal}{tolerance}")
    left, right = rows(rng, 60) + [(7, 1, 30), (7, 1, 30)], rows(rng, 40)
    L = spark.createDataFrame([(i, k, at(s)) for i, k, s in left], "lid int, k int, t timestamp_ntz")
    R = spark.createDataFrame([(i, k, at(s)) for i, k, s in right], "rid int, k int, rt timestamp_ntz")
    want = []
    for i, k, s in left:
        fits = [(rs, j) for j, rk, rs in right if None not in (k, rk, s, rs) and rk == k and (rs == s and equal or (rs < s if direction == "backward" else rs > s))
                and (tolerance is None or abs(rs - s) <= tolerance)]
        # nearest time; of equal times the largest id
        best = max(fits, key=lambda f: ((f[0] if direction == "backward" else -f[0]), f[1]), default=(None, None))
        want.append(repr((i, k, at(s), best[1], at(best[0]))))
    for n in (1, 5):
        got = asof_join(L, R, ["k"], "t", "rt", ["rid", "rt"], direction, equal, tie=["rid"], tolerance_seconds=tolerance, partitions=n)
        assert got.columns == ["lid", "k", "t", "rid", "rt"]
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(want)


def test_asof_without_rows(spark):
    L = spark.createDataFrame([(1, at(5))], "k int, t timestamp_ntz")
    R = spark.createDataFrame([], "k int, rt timestamp_ntz, v string")
    assert [tuple(r) for r in asof_join(L, R, ["k"], "t", "rt", ["v"]).collect()] == [(1, at(5), None)]
    assert asof_join(L.limit(0), R, ["k"], "t", "rt", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(L, R.withColumnRenamed("v", "t"), ["k"], "t", "rt", ["t"])


def test_a_hot_key_is_spread_over_ranges(spark):
    L = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50 + 1).alias("k"),
                                  (F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 7919 % 20011).cast("decimal(18,6)"))).alias("t"))
    plan = asof_join(L, L.select("k", F.col("t").alias("rt")), ["k"], "t", "rt", ["rt"], partitions=8)
    assert plan.filter("rt = t").count() == 20000
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")


@pytest.mark.parametrize("n", [2, 7, 64, 65, 200])
def test_bounds_cut_ranges_of_equal_size(spark, n):
    df = spark.range(40000).select((F.col("id") * 7919 % 40009).alias("a"), "id")
    sizes = [r["count"] for r in Sequence(df, order=["a", "id"], partitions=n).df.groupBy(RP).count().collect()]
    assert len(sizes) == n and sum(sizes) == 40000 and max(sizes) < 2.2 * 40000 / n


def test_bounds_come_from_a_bounded_sample(spark):
    """No top-k, and as many sampled keys whatever the size of the table."""
    for n in (8, 100):
        df = spark.range(100).select(F.col("id").alias("a"))
        plan = df.withColumn("b", range_bounds(df, ["a"], n))._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan
    taken = []
    for size in (20_000, 200_000):
        df = spark.range(size).select(F.col("id").alias("a"))
        code = F.shiftrightunsigned(F.xxhash64("a"), 33)
        taken.append(df.filter(code < F.lit(64 * 8 * 2.0 ** 31 / size)).count())
    assert all(350 < x < 700 for x in taken)


def test_range_id_is_a_search_of_the_bounds(spark):
    for size in (0, 1, 2, 3, 6, 9):
        bounds = [3 * i for i in range(size)]
        df = spark.range(-2, 40).withColumn("b", F.array(*map(F.lit, bounds)).cast("array<bigint>"))
        got = {r.id: r.x for r in df.select("id", range_id("b", F.col("id"), 10).alias("x")).collect()}
        assert got == {i: sum(b <= i for b in bounds) for i in range(-2, 40)}


@pytest.mark.parametrize("n", [2, 7, 65])
def test_sequence_ranges_are_those_of_range_id(spark, n):
    df = spark.range(5000).select(F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 409).alias("a"), "id")
    got = Sequence(df, order=["a", "id"], partitions=n).df.withColumn("b", range_bounds(df, ["a", "id"], n))
    assert got.count() == 5000 and got.filter(F.col(RP) != range_id("b", F.struct("a", "id"), n)).count() == 0
    assert got.select(RP).distinct().count() == n


def test_equal_keys_and_no_rows(spark):
    same = spark.range(3000).select(F.lit(1).alias("a"), F.lit(2).alias("b"))
    assert Sequence(same, order=["a", "b"], partitions=5).row_number("n").result().agg(F.max("n")).first()[0] == 3000
    assert Sequence(same.limit(0), order=["a"], partitions=70).lag({"p": "b"}).result().count() == 0


def test_absent_takes_two_joins(spark):
    left, other = (spark.createDataFrame([(1, 2, 3)], "a int, b int, c int") for _ in range(2))
    plan = absent(left, other, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Left") <= 2 and "Join Inner" not in plan
    plan = absent(left, other, ["a", "b", "c"], not_null=["a", "b", "c"], other_not_null=["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Left") == 1


def test_absent_compares_across_types(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "a int, b string")
    other = spark.createDataFrame([(2, "b"), (7, "x")], "a bigint, b string")
    assert sorted(r.a for r in absent(left, other, ["a", "b"]).collect()) == [1, 3]


def test_duplicates_list_ids_of_repeated_rows_only(spark):
    rng = random.Random(5)
    data = [(i, rng.randint(0, 400), rng.choice(["x", None])) for i in range(600)]
    df = spark.createDataFrame(data, "id long, a int, b string")
    want = {}
    for i, a, b in data:
        want.setdefault((a, b), []).append(i)
    got = {(r.a, r.b): (r.conteggio, r.stringaid) for r in exact_duplicates(df, ["a", "b"]).collect()}
    assert got == {k: (len(v), " ".join(map(str, sorted(v)))) for k, v in want.items() if len(v) > 1}
    plan = exact_duplicates(df, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan


@pytest.mark.parametrize("split", [1, 4])
def test_finer_buckets_find_the_same_pairs(spark, split):
    rng = random.Random(8)
    left, right = ([(i, rng.choice([0, 0, 1]), rng.randint(0, 400)) for i in range(150)] for _ in range(2))
    L = spark.createDataFrame([(i, k, at(s)) for i, k, s in left], "lid int, lk int, lt timestamp_ntz")
    R = spark.createDataFrame([(i, k, at(s)) for i, k, s in right], "rid int, rk int, rt timestamp_ntz")
    got = sorted((r.lid, r.rid) for r in interval_match(L, R, ["lk"], ["rk"], "lt", "rt", -30, 90, split=split).collect())
    assert got == sorted((i, j) for i, k, s in left for j, rk, rs in right if k == rk and s - 30 <= rs <= s + 90)


def test_ordered_rows_come_back_in_display_order(spark, tmp_path):
    from binsight.operators.sink import read_ordered_rows, write_ordered_rows_json
    from binsight.plans.display import pg_order
    rng = random.Random(4)
    data = [(i, rng.choice([None, "a", "b", "ß"]), rng.choice([None, 1, 2, 30])) for i in range(500)]
    df = spark.createDataFrame(data, "id int, s string, n int").repartition(7)
    path = str(tmp_path / "rows")
    write_ordered_rows_json(df, path, [pg_order("s", True), pg_order("n")])
    got = [(r.position, tuple(r.row)) for r in read_ordered_rows(spark, path).orderBy("position").collect()]
    # PostgreSQL: NULLs first when descending, last when ascending
    want = sorted(data, key=lambda r: ({None: 0, "ß": 1, "b": 2, "a": 3}[r[1]], r[2] is None, r[2] or 0, r[0]))
    assert got == [(i, tuple(None if v is None else str(v) for v in r)) for i, r in enumerate(want)]
    # the first rows of the display: a top-k, no full sort
    top = df.orderBy(pg_order("s", True), pg_order("n"), "id").limit(5)
    assert [r.id for r in top.collect()] == [r[0] for r in want[:5]]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()
    empty = str(tmp_path / "none")
    write_ordered_rows_json(df.limit(0), empty, [pg_order("s")])
    assert read_ordered_rows(spark, empty).count() == 0
