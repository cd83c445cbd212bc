"""Replacing several tables as one step, key indexes, landings without a key, mergeable inference, the compact registry."""

import pytest
from pyspark.sql import functions as F
from row_bags import rows

from lastro.operators import registry
from lastro.operators.infer import column_facts, infer_types, merged_facts, proposed_types
from lastro.operators.registry import compact_registry, current_registry, key_columns, register_key
from lastro.plans import commit as commits
from lastro.plans.commit import SWAP, recover, written_beside
from lastro.plans.load import append_tables, replace_tables
from lastro.session import drop_folder, shared_folder
from lastro.sources.key_index import build_key_index, has_key_index, index_name, stored_keys
from lastro.sources.pending import begin, unfinished
from lastro.streaming.landing import append_landed


def two(spark, mark, n=2):
    return {name: spark.createDataFrame([(str(i), mark) for i in range(n)], "k string, v string") for name in ("t1", "t2")}


def content(spark, *names):
    return [sorted(tuple(r) for r in spark.table(n).select("k", "v").collect()) for n in names]


OLD, NEW = [[("0", "old"), ("1", "old")]] * 2, [[("0", "new"), ("1", "new"), ("2", "new")]] * 2


@pytest.mark.parametrize("at", range(4))
def test_an_error_at_any_rename_leaves_all_old_tables(fresh, monkeypatch, at):
    spark = fresh
    replace_tables(spark, two(spark, "old"), keys={"t1": ["k"]})
    plain, calls = commits._rename, []

    def failing(spark, name, to):
        calls.append(name)
        if len(calls) == at + 1:
            raise RuntimeError("no metastore")
        plain(spark, name, to)

    monkeypatch.setattr(commits, "_rename", failing)
    with pytest.raises(RuntimeError):
        replace_tables(spark, two(spark, "new", 3), keys={"t2": ["k"]})
    assert content(spark, "t1", "t2") == OLD
    assert key_columns(spark, "t1") == ["k"] and key_columns(spark, "t2") is None
    assert sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith("_")) == ["t1", "t2"]
    assert unfinished(spark, SWAP, "t1") == []


@pytest.mark.parametrize("done", range(5))
def test_a_driver_that_dies_on_the_way(fresh, done):
    """After ``done`` renames nothing more happens; the next load carries the step on."""
    spark = fresh
    replace_tables(spark, two(spark, "old"), keys={"t1": ["k"]})
    swaps = [written_beside(df, name, ["k"] if name == "t2" else None, 1000) for name, df in two(spark, "new", 3).items()]
    begin(spark, SWAP, [(s.name, [s.fresh, s.old, *s.key]) for s in swaps])
    steps = [x for s in swaps for x in ((s.name, s.old), (s.fresh, s.name))]
    for name, to in steps[:done]:
        spark.sql(f"ALTER TABLE {name} RENAME TO {to}")
    assert recover(spark, "t1") == 1 and recover(spark, "t1") == 0
    assert content(spark, "t1", "t2") == NEW
    assert key_columns(spark, "t1") is None and key_columns(spark, "t2") == ["k"]
    assert sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith("_")) == ["t1", "t2"]


def test_an_input_that_fails_leaves_nothing(fresh):
    spark = fresh
    replace_tables(spark, two(spark, "old"))
    broken = two(spark, "new", 3)
    broken["t2"] = broken["t2"].withColumn("v", F.when(F.col("k") == "2", F.raise_error(F.lit("bad"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="bad"):
        replace_tables(spark, broken)
    assert content(spark, "t1", "t2") == OLD
    assert sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith("_")) == ["t1", "t2"]


def keyed(spark, numbers):
    return spark.createDataFrame([(None if i is None else str(i), "x") for i in numbers], "k string, v string")


def test_a_small_append_reads_the_buckets_of_its_keys(fresh):
    spark = fresh
    replace_tables(spark, {"t1": keyed(spark, [*range(200), 7, 7])}, keys={"t1": ["k"]})
    build_key_index(spark, "t1", buckets=50)
    assert spark.table(index_name("t1")).count() == 200
    batch = spark.createDataFrame([("3",), ("900",)], "_PK string")
    known = stored_keys(spark, "t1", batch)
    buckets = {r[0] for r in batch.select(F.pmod(F.xxhash64("_PK"), F.lit(50))).collect()}
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in known.inputFiles()}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert read >= buckets & read and "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "3" in {r[0] for r in known.collect()} and known.count() < 40
    for numbers, written in (([3, 900, 900], 2), ([3, 900, 901], 1), ([], 0)):
        (done,) = append_tables(spark, {"t1": keyed(spark, numbers)})
        assert done.written == written
    assert spark.table("t1").count() == 205 and spark.table(index_name("t1")).count() == 202


def test_an_append_that_was_cut_off_renews_the_index(fresh):
    spark = fresh
    replace_tables(spark, {"t1": keyed(spark, range(5))}, keys={"t1": ["k"]})
    build_key_index(spark, "t1", buckets=4)
    begin(spark, "append", [("t1", [])])
    # rows that were stored before the keys were
    spark.table("t1").limit(1).withColumn("_PK", F.lit("50")).withColumn("k", F.lit("50")).write.mode("append").saveAsTable("t1")
    (done,) = append_tables(spark, {"t1": keyed(spark, [50, 51])})
    assert done.written == 1 and unfinished(spark, "append", "t1") == []
    replace_tables(spark, {"t1": keyed(spark, range(2))}, keys={"t1": ["k"]})
    assert not has_key_index(spark, "t1")


def test_a_replayed_batch_adds_only_what_is_missing(fresh):
    spark = fresh
    replace_tables(spark, two(spark, "old"))
    checkpoint = shared_folder(spark, "state")
    spark.range(1).select(F.lit('{"id":"stream-a"}').alias("value")).coalesce(1).write.text(f"{checkpoint}/metadata")
    batch = spark.createDataFrame([("5", "a"), ("5", "a"), (None, None)], "k string, v string")
    append_landed(batch, "t1", checkpoint, 0)
    want = rows(spark.table("t1").select("k", "v"))
    assert spark.table("t1").count() == 5
    append_landed(batch, "t1", checkpoint, 0)
    assert rows(spark.table("t1").select("k", "v")) == want
    # a write that was cut off half way
    half = spark.createDataFrame(spark.table("t1").where("k IS NOT NULL").collect(), spark.table("t1").schema)
    half.write.mode("overwrite").saveAsTable("t1")
    append_landed(batch, "t1", checkpoint, 0)
    assert rows(spark.table("t1").select("k", "v")) == want
    append_landed(batch, "t1", checkpoint, 1)
    assert spark.table("t1").count() == 8
    drop_folder(spark, checkpoint)


def test_facts_of_batches_merge(spark):
    texts = [("1", "Sim", "03/02/2024", "", "007"), ("2", "não", "13/02/2024", " ", "12"), ("x", "Sim", "", None, "13"), (None, "Não", "01/12/2023", "", "14")]
    df = spark.createDataFrame(texts, "a string, b string, d string, e string, z string")
    parts = [column_facts(spark.createDataFrame(texts[i:j], df.schema)) for i, j in ((0, 1), (1, 2), (2, 4), (0, 0))]
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    assert rows(proposed_types(merged_facts(facts))) == rows(infer_types(df))
    assert rows(proposed_types(merged_facts(parts[3]))) == rows(infer_types(df.limit(0)))


def test_the_registry_keeps_few_files(fresh, monkeypatch):
    spark = fresh
    monkeypatch.setattr(registry, "MOST_FILES", 3)
    for i in range(5):
        register_key(spark, f"t{i % 2}", [f"c{i}"])
        compact_registry(spark, None, 3)
    register_key(spark, "t0", None)
    assert len(spark.table(registry.REGISTRY).inputFiles()) <= 4
    assert rows(current_registry(spark).select("table_name", F.concat_ws(",", "key_columns"))) == rows(spark.createDataFrame([("t1", "c3")], "t string, k string"))
