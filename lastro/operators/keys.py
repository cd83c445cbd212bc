"""Composite keys: building them, keeping new records only, enforcing uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.functions.text import composite_key
from lastro.operators.skew import MIN_ROWS, skew_join

KEY = "_PK"


def with_key(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Add ``_PK`` made of ``columns``; without columns the data stays as it is."""
    return df.withColumn(KEY, composite_key(columns)) if columns else df


def new_records(
    batch: DataFrame,
    existing: DataFrame,
    keys: Sequence[str] = (KEY,),
    *,
    heavy: Column | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``existing``. Repeats inside the batch all stay.

    Only the key columns of ``existing`` are read, and they are deduplicated before the exchange.
    """
    kept = skew_join(
        batch,
        existing.select(*keys),
        list(keys),
        "left_anti",
        distinct_right=True,
        heavy=heavy,
        min_rows=min_rows,
    )
    return kept.select(*batch.columns)


def append_counts(
    batch: DataFrame, existing: DataFrame, keys: Sequence[str] = (KEY,), *, min_rows: int = MIN_ROWS
) -> DataFrame:
    """One row: incoming, kept and skipped rows of an append, in a single pass over the batch.

    The batch is counted per key first, so a key repeated a billion times joins as one row.
    """
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = existing.select(*keys).distinct().withColumn("known", F.lit(True))
    return (
        per_key.join(known, list(keys), "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("incoming"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("kept"),
        )
        .withColumn("skipped", F.col("incoming") - F.col("kept"))
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order_by``, ties broken by the remaining columns.

    A minimum over structs instead of ``row_number``: it combines before the shuffle, so a heavy key
    sends one row per task where a window would sort all of its rows in one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    payload = [c for c in order_by if c not in keys] + rest
    if not payload:
        return df.distinct()
    first = df.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("first"))
    return first.select(*[F.col(c) if c in keys else F.col("first")[c].alias(c) for c in df.columns])
