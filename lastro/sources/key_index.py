"""The keys of a table by bucket, kept beside it, so that a small append reads only the buckets of its own keys.

The index holds each key once, in partitions by its hash. An append writes a line in the log first (``sources.pending``), then
its rows, then their keys; a line without an end means keys may be missing, and the index is built again. Tables
written to in other ways than by ``append_tables`` need ``build_key_index`` again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.operators.keys import KEY
from lastro.sources.catalog import table_exists, table_keys
from lastro.sources.pending import begin, finish, unfinished

BUCKETS, APPEND = 256, "append"
BUCKET, OF = "bucket", "of_buckets"


def index_name(table: str) -> str:
    database, _, name = table.rpartition(".")
    return f"{database}._keys_{name}" if database else f"_keys_{name}"


def has_key_index(spark: SparkSession, table: str) -> bool:
    return table_exists(spark, index_name(table))


def drop_key_index(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {index_name(table)}")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


def _entries(keys: DataFrame, buckets: int) -> DataFrame:
    """One row a key; distinct first, so a key that many rows share travels once a task."""
    return keys.where(F.col(KEY).isNotNull()).distinct().withColumn(BUCKET, _bucket(buckets)).repartition(BUCKET)


def build_key_index(spark: SparkSession, table: str, buckets: int = BUCKETS) -> None:
    """Make the index from the stored keys; ``buckets`` should leave some megabytes to each."""
    name = index_name(table)
    drop_key_index(spark, table)
    entries = _entries(table_keys(spark, table), buckets)
    entries.write.partitionBy(BUCKET).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{OF}' = '{buckets}')")
    for row in unfinished(spark, APPEND, table):
        if row.table_name == table:
            finish(spark, APPEND, table, row.run)


def buckets_of(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {index_name(table)} ('{OF}')").first()["value"])


def ready(spark: SparkSession, table: str) -> None:
    """Build the index again if an append was cut off."""
    if any(row.table_name == table for row in unfinished(spark, APPEND, table)):
        build_key_index(spark, table, buckets_of(spark, table))


def stored_keys(spark: SparkSession, table: str, batch: DataFrame) -> DataFrame:
    """Those stored keys that lie in a bucket with keys of ``batch``; the other partitions are not read.

    The driver sees one number a bucket.
    """
    wanted = batch.where(F.col(KEY).isNotNull()).select(_bucket(buckets_of(spark, table)).alias(BUCKET)).distinct()
    touched = [row[BUCKET] for row in wanted.collect()]
    return spark.table(index_name(table)).where(F.col(BUCKET).isin(touched)).select(KEY)


def begin_append(spark: SparkSession, table: str) -> str:
    return begin(spark, APPEND, [(table, [])])


def end_append(spark: SparkSession, table: str, added: DataFrame, run: str) -> None:
    """Add the keys of the rows that were appended."""
    entries = _entries(added.select(KEY), buckets_of(spark, table))
    entries.write.mode("append").partitionBy(BUCKET).saveAsTable(index_name(table))
    finish(spark, APPEND, table, run)
