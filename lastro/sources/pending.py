"""Work that must not be left half done: a log of what was begun and what was finished.

A line is written, as one file, before the first change of a piece of work, and another after the last one. What has
begun and not finished was cut off, and whoever comes next mends it. One writer a database is assumed, as for tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG, MOST_FILES = "_pending", 64
SCHEMA = "run string, kind string, table_name string, detail array<string>, finished boolean"


def log_of(table: str) -> str:
    """The log beside a table, in its database."""
    database, _, _ = table.rpartition(".")
    return f"{database}.{LOG}" if database else LOG


def _write(spark: SparkSession, log: str, rows: list) -> None:
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").saveAsTable(log)


def begin(spark: SparkSession, kind: str, work: Sequence[tuple[str, Sequence[str]]]) -> str:
    """Record pieces of work, ``(table, detail)`` each, as one run; the log is beside the first table."""
    run = uuid.uuid4().hex
    _write(spark, log_of(work[0][0]), [(run, kind, name, list(detail), False) for name, detail in work])
    return run


def finish(spark: SparkSession, kind: str, table: str, run: str) -> None:
    log = log_of(table)
    _write(spark, log, [(run, kind, None, None, True)])
    if len(spark.table(log).inputFiles()) > MOST_FILES and _open(spark.table(log)).isEmpty():
        spark.sql(f"DROP TABLE {log}")


def _open(log: DataFrame) -> DataFrame:
    return log.where("NOT finished").join(log.where("finished").select("run"), "run", "left_anti")


def unfinished(spark: SparkSession, kind: str, table: str) -> list:
    """Rows ``(run, table_name, detail)`` of runs that were cut off: a few, since each is mended before the next begins."""
    log = log_of(table)
    if not spark.catalog.tableExists(log):
        return []
    return _open(spark.table(log)).where(F.col("kind") == kind).select("run", "table_name", "detail").collect()
