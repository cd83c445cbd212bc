"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores. Inputs that the tables do
not hold themselves, XML documents and CSV files, are written first and not counted.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from checks import queries as q
from lastro.functions.text import as_text
from lastro.operators.fiscal import CTE, NFE, flatten
from lastro.operators.reports import price_history, report_on, tax_by_code, top_suppliers
from lastro.operators.shape import coerce
from lastro.plans.fiscal import stage
from lastro.session import local_session
from lastro.sources.delimited import scan_delimited
from lastro.sources.xml_folder import read_xml_folder

TYPES = {
    "l_orderkey": "INTEGER", "l_partkey": "INTEGER", "l_suppkey": "INTEGER", "l_linenumber": "INTEGER",
    "l_quantity": "REAL", "l_extendedprice": "REAL", "l_discount": "REAL", "l_tax": "REAL", "l_shipdate": "DATETIME",
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = local_session(
        "bench",
        cpus,
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.warehouse.dir": f"{scratch}/warehouse",
            "spark.checkpoint.dir": f"{scratch}/shared",
            # The XML folder has many files of a few KB: let a task take more of them.
            "spark.sql.files.openCostInBytes": "65536",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    q.nfe_docs(spark, folder).write.parquet(f"{scratch}/nfe")
    q.cte_docs(spark, folder).write.parquet(f"{scratch}/cte")
    nfe, cte = spark.read.parquet(f"{scratch}/nfe"), spark.read.parquet(f"{scratch}/cte")
    csv = f"{scratch}/lineitem_csv"
    as_text(q.table(spark, folder, "lineitem")).write.options(**q.CSV_OUT).csv(csv)
    # One file for each document; Spark's text writer names them .txt.
    nfe.select("text").write.option("maxRecordsPerFile", 1).text(f"{scratch}/xml")

    headline = {
        "nfe_items_flatten": lambda: run(flatten(nfe, NFE)),
        "cte_flatten": lambda: run(flatten(cte, CTE)),
        "nfe_tax_by_cst": lambda: run(report_on(nfe, tax_by_code)),
        "nfe_top_suppliers": lambda: run(report_on(nfe, top_suppliers)),
        "nfe_price_history": lambda: run(report_on(nfe, price_history, q.PRODUCT_CODE)),
        "nfe_tables_to_report": lambda: run(q.nfe_tax_by_cst(spark, folder)),
        "xml_folder_to_records": lambda: run(stage(read_xml_folder(spark, f"{scratch}/xml", pattern="*.txt")).nfe),
        "csv_scan_to_typed": lambda: run(coerce(scan_delimited(spark, csv).rows, TYPES)),
        "infer_column_types": lambda: run(q.infer_column_types(spark, folder)),
        "composite_key": lambda: run(q.composite_key(spark, folder)),
        "append_dedup": lambda: run(q.append_dedup(spark, folder)),
        "append_dedup_counts": lambda: run(q.append_dedup_counts(spark, folder)),
        "enforce_key": lambda: run(q.enforce_key(spark, folder)),
        "align_schema": lambda: run(q.align_schema(spark, folder)),
        "key_registry_lookup": lambda: run(q.key_registry_lookup(spark, folder)),
        "load_replace_append": lambda: run(q.load_replace_append(spark, folder)),
    }
    seconds = {}
    for name, query in headline.items():
        start = time.perf_counter()
        query()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    n_nfe, n_cte = nfe.count(), cte.count()
    rates = {
        "nfe_documents_per_sec": round(n_nfe / seconds["nfe_items_flatten"]),
        "cte_documents_per_sec": round(n_cte / seconds["cte_flatten"]),
        "xml_files_per_sec": round(n_nfe / seconds["xml_folder_to_records"]),
        "csv_rows_per_sec": round(q.table(spark, folder, "lineitem").count() / seconds["csv_scan_to_typed"]),
    }
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
