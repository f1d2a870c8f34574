"""A station holding a third of all rows must not land in one task."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from binsight.operators.sequence import RP, Sequence


def test_hot_station_is_spread_over_ranges(spark):
    n = 30000
    df = spark.range(0, n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97 + 1).alias("st"),   # station 0: 1/3
        (F.col("id") * 7919 % 100003).alias("t"))
    seq = Sequence(df, order=["t", "id"], by=["st"], partitions=8)
    sizes = [r["count"] for r in seq.df.groupBy(RP).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * (n / 8)             # ranges stay balanced
    hot_ranges = seq.df.filter(F.col("st") == 0).select(RP).distinct().count()
    assert hot_ranges >= 3                                          # the hot station is split
    # and the split does not change the answer
    got = seq.lag({"pt": "t"}).result().select("id", "pt")
    exp = df.select("id", F.lag("t").over(Window.partitionBy("st").orderBy("t", "id")).alias("pt"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
