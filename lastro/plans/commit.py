"""Several tables change places with their old ones as one step: all of them do, or none.

New tables are written in full beside the old ones. Then one line of the log names them all (``sources.pending``), and they
change places. An error on the way puts the old tables back; a driver that dies on the way leaves the line, by which
``recover`` carries the step on. A reader finds no table for the moment between the two renames of one name.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lastro.operators.registry import register_key
from lastro.sources.catalog import table_exists
from lastro.sources.key_index import drop_key_index
from lastro.sources.pending import begin, finish, unfinished

SWAP = "replace"


@dataclass(frozen=True)
class Swap:
    """``fresh`` is to take the place of ``name``, whose old content is set aside as ``old``; ``key``: its key columns."""

    name: str
    fresh: str
    old: str
    key: Sequence[str] = field(default=())


def written_beside(df: DataFrame, name: str, key: Sequence[str] | None, rows_per_file: int) -> Swap:
    """Write the new content of ``name`` as a table of its own."""
    mark = uuid.uuid4().hex[:12]
    swap = Swap(name, f"{name}_new_{mark}", f"{name}_old_{mark}", tuple(key or ()))
    try:
        df.write.option("maxRecordsPerFile", rows_per_file).saveAsTable(swap.fresh)
    except Exception:
        discard(df.sparkSession, [swap])
        raise
    return swap


def discard(spark: SparkSession, swaps: Sequence[Swap]) -> None:
    """Drop new tables that did not take their place."""
    for swap in swaps:
        spark.sql(f"DROP TABLE IF EXISTS {swap.fresh}")


def _rename(spark: SparkSession, name: str, to: str) -> None:
    spark.sql(f"ALTER TABLE {name} RENAME TO {to}")


def _forward(spark: SparkSession, swap: Swap) -> None:
    """Bring one table to its end from wherever it was left."""
    if table_exists(spark, swap.fresh):
        if table_exists(spark, swap.name):
            _rename(spark, swap.name, swap.old)
        _rename(spark, swap.fresh, swap.name)
    drop_key_index(spark, swap.name)


def _back(spark: SparkSession, swap: Swap) -> None:
    """The state before, from wherever ``_forward`` was left."""
    if not table_exists(spark, swap.fresh) and table_exists(spark, swap.name):
        _rename(spark, swap.name, swap.fresh)
    if table_exists(spark, swap.old):
        _rename(spark, swap.old, swap.name)


def _finished(spark: SparkSession, swaps: Sequence[Swap], run: str) -> None:
    for swap in swaps:
        register_key(spark, swap.name, swap.key)
    finish(spark, SWAP, swaps[0].name, run)
    for swap in swaps:
        spark.sql(f"DROP TABLE IF EXISTS {swap.old}")


def commit(spark: SparkSession, swaps: Sequence[Swap]) -> None:
    """Let all new tables take their places, with their keys."""
    if not swaps:
        return
    run = begin(spark, SWAP, [(s.name, [s.fresh, s.old, *s.key]) for s in swaps])
    try:
        for swap in swaps:
            _forward(spark, swap)
    except Exception:
        for swap in reversed(swaps):
            _back(spark, swap)
        finish(spark, SWAP, swaps[0].name, run)
        discard(spark, swaps)
        raise
    _finished(spark, swaps, run)


def recover(spark: SparkSession, table: str) -> int:
    """Carry on the replacements that were cut off in the database of ``table``; gives their number."""
    runs: dict[str, list[Swap]] = {}
    for row in unfinished(spark, SWAP, table):
        runs.setdefault(row.run, []).append(Swap(row.table_name, row.detail[0], row.detail[1], tuple(row.detail[2:])))
    for run, swaps in runs.items():
        for swap in swaps:
            _forward(spark, swap)
        _finished(spark, swaps, run)
    return len(runs)
