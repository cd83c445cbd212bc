from collections import Counter

from checks.oracles import ORACLES
from checks.queries import QUERIES
from row_bags import rows
from pyspark.sql import functions as F

from lastro.operators.fiscal import NFE, documents, flatten, parse
from checks.order_documents import nfe_documents

SMALL = "/root/testdata/sf0.001"


def tables(spark):
    return [spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("lineitem", "orders", "customer", "supplier")]


def test_an_order_with_a_third_of_all_items_becomes_bounded_documents(spark):
    lineitem, orders, customer, supplier = tables(spark)
    hot = F.when(F.monotonically_increasing_id() % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("l_orderkey"))
    items = lineitem.withColumn("l_orderkey", hot).repartition(4, "l_partkey").persist()
    docs = nfe_documents(items, orders, customer, supplier, min_rows=500, items_per_document=20)
    sizes = documents(parse(docs, [NFE], ["Chave_NFe"]), NFE).select(F.size("body.det").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 20
    got = Counter(tuple(r) for r in flatten(docs, NFE).select("No_NF", "Codigo_produto", "CNPJ_Emitente").collect())
    seller = items.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    text = [F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.lpad(F.col("s").cast("string"), 14, "0")]
    want = Counter(tuple(r) for r in items.join(seller, "l_orderkey").select(*text).collect())
    assert got == want and max(Counter(k for k, _, _ in want.elements()).values()) >= 2000
    items.unpersist()


def test_documents_shuffle_the_items_once(spark):
    lineitem, orders, customer, supplier = tables(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = nfe_documents(lineitem, orders, customer, supplier)
        plan = docs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_order_and_salt = [l for l in plan.split("\n") if "Exchange hashpartitioning(l_orderkey" in l and "_salt" in l]
    # One for the items, one for the headers they are joined with.
    assert len(by_order_and_salt) == 2


def test_every_order_with_items_has_one_document(spark):
    lineitem, orders, customer, supplier = tables(spark)
    docs = nfe_documents(lineitem, orders, customer, supplier)
    n = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select("l_orderkey").distinct().count()
    assert docs.count() == n and docs.select("path").distinct().count() == n


def test_queries_and_oracles_have_the_same_names():
    assert list(QUERIES) == [n for n in QUERIES if n in ORACLES] and set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert [r.CST_ICMS for r in entry.entry(spark).collect() if r.total_icms is not None] != []
    assert set(entry.queries()) >= set(entry.oracle_sql())
    assert rows(entry.entry(spark)) == rows(entry.queries()["nfe_tax_by_cst"](spark, SMALL))
