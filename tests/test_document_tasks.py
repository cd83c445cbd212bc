"""How documents and texts are dealt to tasks and files."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from row_bags import rows

from checks import order_documents, queries
from checks.order_documents import cte_documents, nfe_documents
from lastro.sources.xml_batches import tag_counts
from lastro.sources.xml_folder import read_xml_folder



def tables(spark, orders: int):
    keys = spark.range(orders)
    lineitem = keys.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2)))).selectExpr(
        "id AS l_orderkey", "n AS l_linenumber", "id AS l_partkey", "id % 3 AS l_suppkey", "1 AS l_quantity",
        "10.0 AS l_extendedprice", "0.05 AS l_discount", "0.1 AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus",
    )
    order = keys.selectExpr("id AS o_orderkey", "id % 5 AS o_custkey", "date'2024-01-02' AS o_orderdate", "9.5 AS o_totalprice")
    customer = spark.range(5).selectExpr("id AS c_custkey", "'c' AS c_name", "id AS c_nationkey")
    supplier = spark.range(3).selectExpr("id AS s_suppkey", "'s' AS s_name", "id AS s_nationkey")
    return lineitem, order, customer, supplier


def test_documents_are_made_by_as_many_tasks_as_their_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(order_documents, "ROWS_PER_TASK", 20)
    lineitem, order, customer, supplier = tables(spark, 100)
    nfe, cte = nfe_documents(lineitem, order, customer, supplier), cte_documents(order, customer)
    assert nfe.rdd.getNumPartitions() == 11 and cte.rdd.getNumPartitions() == 6
    assert nfe.count() == 100 and cte.count() == 100
    assert nfe.where(F.regexp_count("text", F.lit("<det ")) == 2).count() == 100


def test_items_are_collected_as_rows_and_not_as_elements(spark):
    plan = nfe_documents(*tables(spark, 10))._jdf.queryExecution().optimizedPlan().toString()
    collected = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "ICMS" not in collected


def test_large_batches_are_whole_files_of_their_own(spark):
    docs = spark.range(50).selectExpr("concat('nfe/', id) AS path", "concat('<NFe><infNFe Id=\"', id, '\"/></NFe>') AS text")
    files = queries._large_batches(docs, 3)
    texts = [r.value for r in spark.read.text(f"{files}/*", wholetext=True).select("value").collect()]
    assert len(texts) == 3
    assert all(t.startswith("<?xml ") and t.endswith("</enviNFe>\n") and t.count("<enviNFe") == t.count("</enviNFe") == 1 for t in texts)
    assert sum(t.count("<NFe>") for t in texts) == 50
    found = read_xml_folder(spark, f"{files}/*", pattern="*.txt", split_bytes=1)
    assert found.count() == found.distinct().count() == 50


def test_texts_of_a_larger_table_go_to_several_files(spark, tmp_path, monkeypatch):
    folder, written = str(tmp_path), []
    texts = spark.range(400).selectExpr("id AS doc_id", "concat('a \"b\"\n', repeat(cast(id AS string), 20)) AS text", "'pt' AS lang")
    texts.repartition(8).write.parquet(f"{folder}/documents.parquet")
    real = queries._written_csv
    monkeypatch.setattr(queries, "_written_csv", lambda df: written.append(real(df)) or written[0])
    monkeypatch.setattr(queries, "BYTES_PER_FILE", queries._bytes(spark, f"{folder}/documents.parquet") // 3)
    found = queries.scan_multiline_split(spark, folder)
    assert len(spark.read.text(written[0]).inputFiles()) == 4
    assert rows(found) == rows(texts.selectExpr("cast(doc_id AS string) AS doc_id", "text", "lang"))


def test_tags_are_counted_by_the_patterns_alone(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><n:NFe a='1'><infNFe/></n:NFe ><CTe/><CTe></CTe><x/><!-- y --></r>")
    got = {(r.prefix, r.tag): (r.opens, r.closes, r.hides) for r in tag_counts(spark, [str(tmp_path / "a.xml")]).collect()}
    assert got == {("n", "NFe"): (1, 1, 0), ("", "CTe"): (1, 1, 0), ("", ""): (0, 0, 1)}


def test_documents_are_not_shuffled_into_their_batch_files(spark):
    docs = spark.range(0, 60, 1, 6).selectExpr("concat('nfe/', id) AS path", "concat('<NFe><infNFe Id=\"', id, '\"/></NFe>') AS text")
    files = queries._large_batches(docs, 3)
    found = [[int(i) for i in re.findall(r'Id="(\d+)"', r.value)] for r in spark.read.text(f"{files}/*", wholetext=True).select("value").collect()]
    assert sorted(found) == [list(range(a, a + 20)) for a in (0, 20, 40)]


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i}.xml").write_text(f"<NFe><infNFe Id='{i}'/></NFe>")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        docs = read_xml_folder(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        assert docs.distinct().count() == 40
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
