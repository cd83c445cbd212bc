"""Type proposal per column, as one aggregate over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.functions.values import BOOLEAN_TOKENS, CLOCK, DATE_FORMATS, DIGITS, is_boolean_token, is_number, to_timestamp

MAX_INTEGER_DIGITS = 18
LONGEST_TOKEN = max(map(len, BOOLEAN_TOKENS))
DATE_LIKE = r"^\s*([0-9]{1,4}[-/.][0-9]{1,2}[-/.]|[0-9]{2}:[0-9]{2})"


def _identifier(i: int) -> str:
    """Digits that a number type would damage: leading zeros, or more of them than a long holds."""
    return f"((startswith(v{i}, '0') AND length(v{i}) > 1) OR length(v{i}) > {MAX_INTEGER_DIGITS})"


def _aggregates(source: DataFrame) -> DataFrame:
    """One row; per column what all, or some, of its filled cells have in common.

    Blank cells are NULL and do not vote. The tests are projected first and the aggregates only
    combine booleans, so no test runs twice for a cell.
    """
    width = range(len(source.columns))
    texts = source.toDF(*[f"c{i}" for i in width]).select(
        *[F.expr(f"CASE WHEN trim(CAST(c{i} AS STRING)) <> '' THEN CAST(c{i} AS STRING) END AS v{i}") for i in width]
    )
    tests = []
    for i in width:
        value = F.col(f"v{i}")
        # Cheap tests stand in front of costly ones, so most cells meet two or three patterns.
        digits = value.rlike(DIGITS)
        dated = ~digits & value.rlike(DATE_LIKE)
        tests.append(value)
        tests.append(digits.alias(f"digits{i}"))
        tests.append((digits | is_number(value)).alias(f"number{i}"))
        tests.append(((F.length(value) <= LONGEST_TOKEN) & is_boolean_token(value)).alias(f"token{i}"))
        tests.append((dated & value.rlike(CLOCK)).alias(f"clock_seen{i}"))
        for f in DATE_FORMATS:
            tests.append(F.when(value.isNotNull(), dated & to_timestamp(value, f).isNotNull()).alias(f"{f}{i}"))
    facts = []
    for i in width:
        parts = [
            f"'filled', count(v{i})",
            f"'numbers', bool_and(number{i})",
            f"'digits', bool_and(digits{i})",
            f"'identifiers', bool_or(digits{i} AND {_identifier(i)})",
            f"'clock_seen', bool_or(clock_seen{i})",
            f"'tokens', bool_and(token{i})",
            # Only tokens are collected, so the set is bounded by their spellings, not by the data.
            f"'spellings', sort_array(collect_set(CASE WHEN token{i} THEN v{i} END))",
            *[f"'{f}', bool_and({f}{i})" for f in DATE_FORMATS],
        ]
        facts.append(F.expr(f"named_struct({', '.join(parts)}) AS f{i}"))
    return texts.select(*tests).agg(*facts)


def column_facts(df: DataFrame) -> DataFrame:
    """What the cells of each column have in common: ``(column_name, f)``, one small row a column.

    All columns are judged in one pass with a map-side combine; each task emits a single row. Facts of several batches
    can be stored and merged (``merged_facts``), so that a new file is read alone and the proposal follows from all.
    """
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"f{i}").alias("f")) for i, c in enumerate(df.columns)]
    return _aggregates(df).select(F.inline(F.array(*pairs)))


def merged_facts(facts: DataFrame) -> DataFrame:
    """The facts of all batches together; equals the facts of the batches' rows in one frame, whatever their number.

    The only sets are those of spellings of boolean words, which are few.
    """
    every = [F.bool_and(f"f.{c}").alias(c) for c in ("numbers", "digits")]
    some = [F.bool_or(f"f.{c}").alias(c) for c in ("identifiers", "clock_seen")]
    spellings = F.sort_array(F.array_distinct(F.flatten(F.collect_set("f.spellings")))).alias("spellings")
    dates = [F.bool_and(f"f.{f}").alias(f) for f in DATE_FORMATS]
    parts = [F.sum("f.filled").alias("filled"), *every, *some, F.bool_and("f.tokens").alias("tokens"), spellings, *dates]
    merged = facts.groupBy("column_name").agg(*parts)
    return merged.select("column_name", F.struct(*[c for c in merged.columns if c != "column_name"]).alias("f"))


def infer_types(df: DataFrame, sample_rows: int | None = None, day_first: bool | None = None) -> DataFrame:
    """One row per column: ``column_name``, ``declared_type`` and, for dates, ``date_format``.

    Where every day is 12 or less, day and month cannot be told apart: ``day_first`` decides, and without it
    the column stays TEXT. ``sample_rows`` limits the look to the first rows, as a preview does; the default is all.
    """
    return proposed_types(column_facts(df if sample_rows is None else df.limit(sample_rows)), day_first)


def proposed_types(facts: DataFrame, day_first: bool | None = None) -> DataFrame:
    """The proposal that follows from the facts of each column."""
    either = F.coalesce(F.col("f.mdy") & F.col("f.dmy"), F.lit(False))
    chosen = F.lit(None).cast("string") if day_first is None else F.lit("dmy" if day_first else "mdy")
    date_format = F.when(either, chosen).otherwise(F.coalesce(*[F.when(F.col(f"f.{f}"), F.lit(f)) for f in DATE_FORMATS]))
    number = F.col("f.numbers") & ~F.col("f.identifiers")
    declared = (
        F.when(F.col("f.filled") == 0, "TEXT")
        .when(number & F.col("f.digits"), "INTEGER")
        .when(number, "REAL")
        .when(date_format.isNotNull(), F.when(F.col("f.clock_seen"), "DATETIME").otherwise("DATE"))
        .when(F.col("f.tokens") & (F.size("f.spellings") == 2), "BOOLEAN")
        .otherwise("TEXT")
    )
    typed = facts.select("column_name", declared.alias("declared_type"), date_format.alias("fmt"))
    is_date = F.col("declared_type").isin("DATE", "DATETIME")
    return typed.select("column_name", "declared_type", F.when(is_date, F.col("fmt")).alias("date_format"))


def type_map(df: DataFrame, sample_rows: int | None = None, day_first: bool | None = None) -> dict[str, str]:
    """The proposal as a map for ``coerce``: one small row per column reaches the driver."""
    out = {}
    for row in infer_types(df, sample_rows, day_first).collect():
        ordered = row.date_format in (None, "ymd")
        out[row.column_name] = row.declared_type if ordered else f"{row.declared_type}:{row.date_format}"
    return out
