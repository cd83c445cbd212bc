"""The key registry: which columns make up the key of each table.

Stored as a log of states: an upsert appends a row and the latest one per table counts. So a write
never rewrites a path that is being read, and a failed write leaves the former state. A log of many files is
written again as one, which takes its place when complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.sources.catalog import put_table

REGISTRY, MOST_FILES, ROWS_PER_FILE = "_key_registry", 32, 5_000_000
SCHEMA = "table_name string, key_columns array<string>, created_at timestamp"


def latest_state(log: DataFrame) -> DataFrame:
    """The current registry: the newest entry per table; an entry without columns removes it.

    A maximum combines before the shuffle, so a table with very many entries is no bottleneck.
    """
    newest = log.groupBy("table_name").agg(F.max(F.struct("created_at", "key_columns")).alias("last"))
    return newest.filter(F.col("last.key_columns").isNotNull()).select(
        "table_name", F.col("last.key_columns").alias("key_columns"), F.col("last.created_at").alias("created_at")
    )


def _split(table: str) -> tuple[str | None, str]:
    """Database, if named, and table; every database has a registry of its own."""
    database, _, name = table.rpartition(".")
    return database or None, name


def qualified(name: str, database: str | None = None) -> str:
    return f"{database}.{name}" if database else name


def current_registry(spark: SparkSession, database: str | None = None) -> DataFrame:
    stored = qualified(REGISTRY, database)
    return latest_state(spark.table(stored)) if spark.catalog.tableExists(stored) else spark.createDataFrame([], SCHEMA)


def register_key(spark: SparkSession, table: str, columns: Sequence[str] | None) -> None:
    """Record the key columns of a table; ``None`` or none at all removes its entry."""
    database, name = _split(table)
    schema = "table_name string, key_columns array<string>"
    entry = spark.createDataFrame([(name, list(columns) if columns else None)], schema)
    stamped = entry.withColumn("created_at", F.current_timestamp()).coalesce(1)
    stamped.write.mode("append").saveAsTable(qualified(REGISTRY, database))
    compact_registry(spark, database)


def compact_registry(spark: SparkSession, database: str | None = None, most_files: int = MOST_FILES) -> None:
    """Write the log again as the newest entry of each table, once it has more than ``most_files`` files.

    So a lookup reads a bounded number of files however often keys were registered. The log changes places with the
    old one when it is complete; entries of one database are written by one writer at a time.
    """
    stored = qualified(REGISTRY, database)
    if len(spark.table(stored).inputFiles()) > most_files:
        put_table(latest_state(spark.table(stored)).coalesce(1), stored, ROWS_PER_FILE)


def key_columns(spark: SparkSession, table: str) -> list[str] | None:
    """The key columns of one table: a single registry row reaches the driver."""
    database, name = _split(table)
    row = current_registry(spark, database).filter(F.col("table_name") == name).first()
    return list(row.key_columns) if row else None


def with_key_columns(tables: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``key_columns`` to a list of table names; NULL where none is registered.

    The registry has one row per table, so Spark broadcasts it as long as its size allows.
    """
    return tables.join(registry.select("table_name", "key_columns"), "table_name", "left")
