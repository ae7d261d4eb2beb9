import datetime as dt

from pyspark.sql import functions as F

from courtside.operators import sketches as SK
from tests.conftest import rows


def test_estimates_are_within_the_bound(spark):
    """Days are united: values that come back on other days count once."""
    df = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"), (F.col("id") * 7919 % 25013).alias("v"),
                                   F.date_add(F.lit(dt.date(2020, 12, 1)), (F.col("id") % 60).cast("int")).alias("day"))
    daily = SK.daily_sketches(df, ["k"], "day", "v", lg_k=12)
    assert daily.count() == 60 and [r.year for r in daily.select("year").distinct().orderBy("year").collect()] == [2020, 2021]
    for since in (dt.date(2020, 12, 1), dt.date(2021, 1, 10)):
        exact = dict(rows(df.where(F.col("day") >= since).groupBy("k").agg(F.count_distinct("v").alias("n"))))
        got = dict(rows(SK.distinct_estimate(daily.where(F.col("day") >= since), ["k"], "n")))
        assert got.keys() == exact.keys() and all(abs(got[k] - n) <= 3 * SK.relative_error(12) * n for k, n in exact.items())


def test_small_counts_are_exact_and_nulls_do_not_count(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, d), v) for d in (1, 2, 3) for v in ("x", "y", None, f"d{d}")] + [("b", None, "x")],
                               "k string, day date, v string")
    assert rows(SK.distinct_estimate(SK.daily_sketches(df, ["k"], "day", "v"), ["k"], "n")) == [("a", 5), ("b", 1)]
    assert SK.distinct_estimate(SK.daily_sketches(df.limit(0), ["k"], "day", "v"), ["k"], "n").count() == 0
