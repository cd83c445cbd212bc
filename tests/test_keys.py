from collections import Counter

from row_bags import rows
from pyspark.sql import functions as F

from lastro.operators.keys import append_counts, first_per_key, new_records, with_key
from lastro.operators.skew import BLOCK, SALT, bounded_blocks, heavy_keys, skew_join


def test_composite_key(spark):
    df = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z"), ("a|b", "c")], "A string, B string")
    assert [r[2] for r in rows(with_key(df, ["A", "B"]).select("A", "B", "_PK"))] == ["1|x", "2|y", "a|b|c", "|z"]
    assert with_key(df, []).columns == ["A", "B"]


def test_append_of_50_new_and_50_known_onto_100(spark):
    stored = with_key(spark.range(100).toDF("k"), ["k"])
    batch = with_key(spark.range(50, 150).toDF("k"), ["k"])
    assert sorted(r.k for r in new_records(batch, stored).collect()) == list(range(100, 150))
    assert tuple(append_counts(batch, stored).first()) == (100, 50, 50)


def test_repeats_inside_the_batch_stay(spark):
    stored = with_key(spark.createDataFrame([("1",)], "k string"), ["k"])
    batch = with_key(spark.createDataFrame([("1",), ("2",), ("2",)], "k string"), ["k"])
    assert [r.k for r in new_records(batch, stored).collect()] == ["2", "2"]
    # Appending what was appended adds nothing.
    assert new_records(batch, stored.unionByName(new_records(batch, stored))).isEmpty()


def test_dedup_on_real_columns_tells_joined_keys_apart(spark):
    stored = spark.createDataFrame([("a|b", "c")], "x string, y string")
    batch = spark.createDataFrame([("a", "b|c")], "x string, y string")
    assert new_records(with_key(batch, ["x", "y"]), with_key(stored, ["x", "y"])).isEmpty()
    assert new_records(batch, stored, ["x", "y"]).count() == 1


def skewed(spark, n=30_000):
    """A third of the rows share one key, some of them whole copies of one row."""
    return spark.range(n, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 500 AS STRING) END AS k",
        "CASE WHEN id % 6 = 0 THEN 0 ELSE id END AS v",
    )


def test_heavy_keys_are_found(spark):
    df = skewed(spark)
    found = df.select("k", F.map_contains_key(heavy_keys(df, ["k"], 1000), F.xxhash64("k")).alias("heavy"))
    assert {r.k for r in found.filter("heavy").select("k").distinct().collect()} == {"hot"}
    none = df.select(F.size(heavy_keys(df, ["k"])).alias("n")).first().n
    assert none == 0


def test_skewed_joins_equal_plain_ones(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3), ("nobody", 4)], "k string, w int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left", "left_semi", "left_anti"):
            want = Counter(tuple(r) for r in left.join(right, "k", how).collect())
            got = Counter(tuple(r) for r in skew_join(left, right, ["k"], how, min_rows=1000).collect())
            assert got == want, how
        want = Counter(tuple(r) for r in left.join(right, "k", "left_anti").collect())
        got = Counter(tuple(r) for r in new_records(left, right, ["k"], min_rows=1000).collect())
        assert got == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_heavy_rows_spread_over_the_salts(spark):
    df = skewed(spark)
    parts = bounded_blocks(df, ["k"], 100, ["v"], min_rows=1000)
    sizes = parts.filter("k = 'hot'").groupBy(SALT).count().collect()
    # Half of the hot rows are copies of one row; only the task number can spread those.
    assert len(sizes) > 32 and max(r["count"] for r in sizes) < 10_000 / 3
    assert parts.filter("k <> 'hot'").select(SALT).distinct().count() == 1


def test_salting_frames_with_maps_and_nulls(spark):
    left = spark.range(3000, numPartitions=3).selectExpr(
        "CASE WHEN id % 2 = 0 THEN NULL ELSE id % 9 END AS k", "map('a', id) AS m", "id AS `v.w`"
    )
    right = spark.createDataFrame([(1,), (None,)], "k long")
    got = skew_join(left, right, ["k"], "left_anti", min_rows=100)
    assert got.count() == left.join(right, "k", "left_anti").count()


def test_blocks_are_bounded_and_whole(spark):
    df = skewed(spark)
    parts = bounded_blocks(df, ["k"], 50, ["v"], min_rows=1000)
    grouped = parts.groupBy("k", SALT, BLOCK).agg(F.count("*").alias("n"), F.collect_list("v").alias("vs"))
    assert grouped.agg(F.max("n")).first()[0] <= 50
    back = Counter(tuple(r) for r in grouped.select("k", F.explode("vs")).collect())
    assert back == Counter(tuple(r) for r in df.collect())


def test_a_small_key_stays_in_one_block(spark):
    df = spark.range(300).selectExpr("id % 100 AS k", "id AS v")
    assert bounded_blocks(df, ["k"], 3, ["v"]).groupBy("k", SALT, BLOCK).count().count() == 100


def test_blocks_group_without_another_exchange(spark):
    df = skewed(spark)
    grouped = bounded_blocks(df, ["k"], 50, ["v"]).groupBy("k", SALT, BLOCK).agg(F.collect_list("v"))
    main = grouped._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert main.count("Exchange hashpartitioning") == 1


def test_first_per_key(spark):
    df = spark.createDataFrame(
        [(1, "b", 2.0, None), (1, "a", 3.0, "z"), (1, "a", 1.0, "y"), (2, None, 5.0, "q")],
        "k int, o string, v double, w string",
    )
    assert rows(first_per_key(df, ["k"], ["o"])) == [(1, "a", 1.0, "y"), (2, None, 5.0, "q")]
    assert first_per_key(df, ["k"], ["o"]).columns == df.columns


def test_first_per_key_combines_before_the_shuffle(spark):
    plan = first_per_key(skewed(spark), ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning")
    assert "Window" not in plan


def test_salts_follow_the_share_of_the_key(spark):
    for n in (30_000, 120_000):
        salts = spark.range(1).select(heavy_keys(skewed(spark, n), ["k"], 1000).alias("h")).first().h
        assert len(salts) == 1 and abs(next(iter(salts.values())) - 16 * n / 3 / 1000) < 0.05 * n


def test_no_rows_have_no_heavy_keys(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert spark.range(1).select(heavy_keys(empty, ["k"]).alias("h")).first().h == {}
    assert new_records(empty, skewed(spark), ["k"]).isEmpty()
