from pyspark.sql import Window
from pyspark.sql import functions as F

from courtside.operators import core as O
from tests.conftest import rows


def test_filter_group_extreme_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2), ("b", None)], "k string, v int")
    assert rows(O.filter_group_extreme(df, "k", "v")) == [("a", 3), ("a", 3), ("b", 2)]
    assert rows(O.filter_group_extreme(df, "k", "v", "min")) == [("a", 1), ("b", 2)]


def test_filter_global_extreme_and_having(spark):
    df = spark.createDataFrame([(1, "x"), (3, "y"), (3, "z")], "d int, s string")
    assert rows(O.filter_global_extreme(df, "d"), "s") == [("y",), ("z",)]
    g = spark.createDataFrame([("a", 30), ("a", 10), ("b", 5)], "k string, v int")
    assert rows(O.filter_having(g, "k", {"m": F.avg("v")}, F.col("m") >= 20)) == [("a", 10), ("a", 30)]


def test_top_n_with_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([50, 40, 40, 30, 30, 30, 10, None])],
                               "id int, v int")
    # competition rank <= 4 keeps 50, 40, 40 and all three 30s
    assert len(O.top_n_with_ties(df, 4, "v").collect()) == 6
    assert len(O.top_n_with_ties(df, 1, "v").collect()) == 1
    grp = df.withColumn("g", F.col("id") % 2)
    assert len(O.top_n_with_ties(grp, 1, "v", partition="g").collect()) == 2


def test_null_aware_rank(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None), ("c", 5.0), ("d", 5.0)], "k string, v double")
    out = dict((r["k"], r["r"]) for r in df.select("k", O.null_aware_rank("v").alias("r")).collect())
    assert out == {"c": 1, "d": 1, "a": 3, "b": None}
    out = dict((r["k"], r["r"]) for r in
               df.select("k", O.null_aware_rank("v", ascending=True, kind="percent_rank").alias("r")).collect())
    assert out == {"a": 0.0, "c": 0.5, "d": 0.5, "b": None}


def test_band_percent_rank_matches_window(spark):
    data = [("x", float(v % 7) if v % 5 else None) for v in range(40)] + [("y", 1.0), ("z", 2.0), ("z", 2.0)]
    df = spark.createDataFrame(data, "band string, v double").withColumn("id", F.monotonically_increasing_id())
    got = O.band_percent_rank(df, "band", "v", "pr")
    ref = df.withColumn("pr", O.null_aware_rank("v", partition="band", ascending=True, kind="percent_rank"))
    assert rows(got, "id", "pr") == rows(ref, "id", "pr")


def test_running_sum_chunked_equals_window(spark):
    data = [(k, d, (k * 7 + d * 3) % 5) for k in range(3) for d in range(60)]
    df = spark.createDataFrame(data, "k int, d int, v int")
    plain = O.running_sum(df, "k", ["d"], {"s": F.col("v")})
    chunked = O.running_sum(df, "k", ["d"], {"s": F.col("v")}, chunk=(F.col("d") / 7).cast("int"))
    assert rows(plain, "k", "d", "s") == rows(chunked, "k", "d", "s")


def test_running_sum_with_nulls_at_chunk_starts(spark):
    data = [("a", 0, None), ("a", 1, 1), ("a", 2, None), ("a", 3, 1), ("a", 4, None), ("a", 5, 1), ("b", 0, None), ("b", 3, None)]
    df = spark.createDataFrame(data, "k string, d int, v int")
    got = O.running_sum(df, "k", ["d"], {"s": F.col("v")}, chunk=F.floor(F.col("d") / 2))
    assert rows(got, "k", "d", "s") == rows(O.running_sum(df, "k", ["d"], {"s": F.col("v")}), "k", "d", "s")
    assert sorted((r.d, r.s) for r in got.where("k = 'a'").collect() if r.d) == [(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)]


def test_current_run_length(spark):
    df = spark.createDataFrame([("a", 1, "W"), ("a", 2, "L"), ("a", 3, "W"), ("a", 4, "W"),
                                ("b", 1, "W"), ("b", 2, "W"), ("c", 1, "W"), ("c", 2, "L")],
                               "t string, d int, o string")
    got = O.current_run_length(df, "t", [F.col("d")], F.col("o") == "W", "streak")
    assert rows(got) == [("a", 2), ("b", 2), ("c", 0)]


def test_first_per_key(spark):
    df = spark.createDataFrame([("n", 1, 10), ("n", 2, 30), ("n", 3, 30), ("m", 4, 5)], "name string, id int, pop int")
    got = O.first_per_key(df, "name", [F.col("pop"), -F.col("id")])
    assert rows(got) == [("m", 4, 5), ("n", 2, 30)]


def test_opponent_totals_and_share(spark):
    df = spark.createDataFrame([(1, "a", 100), (1, "b", 90), (2, "a", 80)], "g int, t string, pts int")
    got = O.with_opponent_totals(df, "g", ["pts"])
    assert rows(got, "g", "t", "opp_pts") == [(1, "a", 90), (1, "b", 100)]
    # an unknown value stays unknown and does not hide the other side's; lone sides and triples go
    odd = spark.createDataFrame([(1, "a", 10), (1, "b", None), (2, "a", None), (2, "b", None), (3, "c", 5), (4, "x", 1),
                                 (4, "y", 2), (4, "z", 3), (5, "a", 7), (5, "b", 7)], "g int, t string, pts int")
    assert rows(O.with_opponent_totals(odd, ["g"], ["pts"]), "g", "t", "pts", "opp_pts") == sorted(
        [(1, "a", 10, None), (1, "b", None, 10), (2, "a", None, None), (2, "b", None, None), (5, "a", 7, 7), (5, "b", 7, 7)], key=repr)
    s = O.share_of_total(spark.createDataFrame([("x", 1), ("y", 3)], "k string, n long"), "n")
    assert rows(s, "k", "share") == [("x", 0.25), ("y", 0.75)]


def test_separate_unite_unpivot(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a")], "id int, s string")
    sep = O.separate(df, "s", ["f", "g", "h"], " ")
    assert rows(sep, "id", "f", "g", "h") == [(1, "a", "b", "c"), (2, "a", None, None)]
    un = O.unite(sep, "gh", ["g", "h"])
    assert rows(un, "id", "gh") == [(1, "bc"), (2, "")]
    wide = spark.createDataFrame([(1, "x", None)], "id int, h string, v string")
    long = O.unpivot(wide, "id", ["h", "v"], "side", "text")
    assert rows(long) == [(1, "h", "x"), (1, "v", None)]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k string, d int, v int")
    assert O.filter_group_extreme(df, "k", "d").count() == 0
    assert O.running_sum(df, "k", ["d"], {"s": F.col("v")}, chunk=F.col("d")).count() == 0
    assert O.current_run_length(df, "k", [F.col("d")], F.col("v") > 0, "s").count() == 0
    w = Window.partitionBy("k")
    assert df.withColumn("x", F.sum("v").over(w)).count() == 0


def test_global_row_number_matches_window(spark):
    data = [(i, (i * 37) % 11, None if i % 9 == 0 else float((i * 13) % 7)) for i in range(200)]
    df = spark.createDataFrame(data, "id int, g int, v double")
    for order in ([F.col("v").desc_nulls_last(), F.col("id")], [F.col("g"), F.col("v"), F.col("id").desc()]):
        got = O.global_row_number(df, order, "rn")
        ref = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
        assert got.columns == ref.columns and rows(got, "id", "rn") == rows(ref, "id", "rn")
    assert O.global_row_number(df.limit(0), [F.col("id")], "rn").count() == 0


def test_global_row_number_of_hashed_ids(spark):
    """Ids over all 64 bits, a third of the rows of one value: no stretch of ids
    or values is guessed, and the only window is over one row a partition."""
    df = spark.range(5000, numPartitions=7).select(F.xxhash64("id").alias("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("v"))
    order = [F.col("v").desc(), F.col("id")]
    got = O.global_row_number(df, order, "rn")
    assert rows(got, "id", "rn") == rows(df.withColumn("rn", F.row_number().over(Window.orderBy(*order))), "id", "rn")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate [__part" in plan.split("Window [")[1]


def naive_top(data, n):
    """Rows fewer than n of whose group are greater."""
    return sorted((g, i, v) for g, i, v in data if v is not None and sum(h == g and w is not None and w > v for h, _, w in data) < n)


def test_group_top_n_of_a_hot_group(spark):
    data = [("hot", i, (i * 7919) % 500) for i in range(1200)] + [("ties", i, 5) for i in range(300)]
    data += [("few", 1, 3), ("few", 2, None), ("none", 3, None), (None, 4, 8), (None, 5, 8), (None, 6, 7)]
    df = spark.createDataFrame(data, "g string, id int, v int").repartition(5)
    for n in (1, 3, 40):
        got = O.top_n_with_ties(df, n, "v", partition="g")
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(naive_top([d for d in data if d[0]], n) + [d for d in data if d[0] is None][:2 if n < 3 else 3], key=repr)


def test_band_percent_rank_of_unrounded_values(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("band"), (F.xxhash64("id") / 7.0).alias("v"), "id")
    got = O.band_percent_rank(df, "band", "v", "pr")
    ref = df.withColumn("pr", O.null_aware_rank("v", partition="band", ascending=True, kind="percent_rank"))
    assert rows(got, "id", "pr") == rows(ref, "id", "pr")


def test_ranged_running_sum_equals_window(spark):
    data = [(k, i, (i * 31) % 17 - 3 if i % 5 else None) for k in ("a", "b", None) for i in range(150 if k else 9)] + [("hot", i, i) for i in range(700)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    got = O.ranged_running_sum(df.where("k is not null"), "k", [F.col("i")], {"s": F.col("v")})
    assert rows(got, "k", "i", "s") == rows(O.running_sum(df.where("k is not null"), "k", ["i"], {"s": F.col("v")}), "k", "i", "s")


def test_join_sides_are_measured(spark):
    """A side below the threshold is sent to every task, one above it is not."""
    left = spark.range(1000).withColumn("team", F.col("id") % 40)
    side = spark.range(40).select(F.col("id").alias("team"), (F.col("id") * 2).alias("x")).groupBy("team").agg(F.max("x").alias("x"))
    small = left.join(O.measured(side), "team", "left")
    assert "BroadcastHashJoin" in small._jdf.queryExecution().sparkPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100)
    try:
        large = left.join(O.measured(side), "team", "left")
        assert "Broadcast" not in large._jdf.queryExecution().sparkPlan().toString()
        assert rows(large) == rows(small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_strict_aggregates(spark):
    from courtside.functions.exprs import strict_avg, strict_sum
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    got = rows(df.groupBy("k").agg(strict_avg("v").alias("m"), strict_sum("v").alias("s")))
    assert got == [("a", None, None), ("b", 3.0, 6.0)]
