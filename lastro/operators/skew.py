"""Joins and groups that hold when one key owns a large part of the rows.

A one-row sketch finds the heavy keys. Its result holds at most ``TOP`` hashes whatever the data
size, reaches the plan as a scalar subquery (no driver round trip), and only steers the salting: a
key it misses or names needlessly costs time, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 200
# Counts are off by at most about 2.6 / TRACKED of the rows, well below the share that is looked for.
TRACKED = 4_000
MERGERS = 512
# A heavy key gets so many salts that about this part of ``min_rows`` falls to each.
PARTS = 16
MIN_ROWS = 1_000_000

SALT = "_salt"
BLOCK = "_block"


def heavy_keys(df: DataFrame, keys: Sequence[str], min_rows: int = MIN_ROWS) -> Column:
    """The keys that own at least 1/``TOP`` of the rows and ``min_rows`` of them: a map of hash to number of salts.

    The number follows the key's own count, so a salted task gets about as many rows at any size.

    Each task keeps one small sketch. They are merged in ``MERGERS`` groups first, so that no task
    receives the sketches of all tasks.
    """
    hashed = df.select(F.xxhash64(*keys).alias("h"), F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger"))
    # One more row, of no key, gives the sketch a form when there are no rows at all.
    hashed = hashed.unionByName(df.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("merger")))
    merged = hashed.groupBy("merger").agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("sketch")
    )
    whole = merged.agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    floor = f"greatest({int(min_rows)}, n div {TOP})"
    top = f"approx_top_k_estimate(sketch, {TOP})"
    return whole.select(
        F.expr(
            f"map_from_entries(transform(filter({top}, t -> t.count >= {floor}), "
            f"t -> struct(t.item, cast(ceil(t.count * {PARTS}D / {max(int(min_rows), 1)}) AS int))))"
        ).alias("heavy")
    ).scalar()


def _salts(keys: Sequence[str], heavy: Column) -> Column:
    """The number of salts of a row's key; 1 for light keys."""
    return F.coalesce(F.try_element_at(heavy, F.xxhash64(*keys)), F.lit(1))


def _salted(df: DataFrame, keys: Sequence[str], heavy: Column) -> DataFrame:
    """Add the salt: 0 for light keys, spread for heavy ones.

    The spread depends on the row's content (rows differ) and on the task's number (copies of one
    row sit in different tasks). Both are the same when a lost task runs again.
    """
    kinds = ((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    hashable = [F.col(f"`{name}`") for name, kind in kinds if "map<" not in kind and "variant" not in kind]
    salts = _salts(keys, heavy)
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), salts).cast("int")
    return df.withColumn(SALT, F.when(salts > 1, spread).otherwise(F.lit(0)))


def replicated(df: DataFrame, keys: Sequence[str], heavy: Column) -> DataFrame:
    """Repeat the rows of heavy keys once per salt; light rows stay single."""
    return df.withColumn(SALT, F.explode(F.sequence(F.lit(0), _salts(keys, heavy) - 1)))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    distinct_right: bool = False,
    heavy: Column | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Equi-join on same-named columns; ``how`` is inner, left, left_semi or left_anti.

    ``distinct_right`` removes repeats of ``right`` after the salt is added, so that the partial
    aggregate runs before the only exchange of that side, which the join then reuses.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not supported: {how}")
    keys = list(keys)
    # Both sides hash the key, so they must agree on its type.
    types = dict(left.dtypes)
    right = right.withColumns({k: F.col(k).cast(types[k]) for k in keys})
    heavy = heavy_keys(left, keys, min_rows) if heavy is None else heavy
    salted = _salted(left, keys, heavy)
    copies = replicated(right, keys, heavy)
    if distinct_right:
        copies = copies.distinct()
    return salted.join(copies, [*keys, SALT], how).drop(SALT)


def bounded_blocks(
    df: DataFrame,
    keys: Sequence[str],
    limit: int,
    order_by: Sequence[str],
    *,
    heavy: Column | None = None,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Add salt and block columns so that no (key, salt, block) group exceeds ``limit`` rows.

    A key with at most ``limit`` rows stays in one block. Rows are numbered per (key, salt), so the
    later ``groupBy`` of these columns needs no further exchange.
    """
    heavy = heavy_keys(df, keys, min_rows) if heavy is None else heavy
    numbered = Window.partitionBy(*keys, SALT).orderBy(*order_by)
    block = F.floor((F.row_number().over(numbered) - 1) / F.lit(limit)).cast("int")
    return _salted(df, keys, heavy).withColumn(BLOCK, block)
