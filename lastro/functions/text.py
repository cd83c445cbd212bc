"""Small text expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_SEPARATOR = "|"


def filled(value: Column) -> Column:
    """NULL as the empty text."""
    return F.coalesce(value, F.lit(""))


def present(value: Column) -> Column:
    """The empty text as NULL, so that ``coalesce`` moves on to the next candidate."""
    return F.nullif(value, F.lit(""))


def composite_key(columns: Iterable[str]) -> Column:
    """The columns as text, joined by ``|``.

    NULLs are filled first: ``concat_ws`` skips them, which would shift the later parts.
    """
    return F.concat_ws(KEY_SEPARATOR, *[filled(F.col(c).cast("string")) for c in columns])


def date_part(stamp: Column) -> Column:
    """The local date of an ISO stamp as written, without shifting it by the zone."""
    return F.substring_index(stamp, "T", 1)


def without(value: Column, prefix: str) -> Column:
    return F.replace(value, F.lit(prefix), F.lit(""))


def padded_number(value: Column, width: int = 2) -> Column:
    """Whole-number text without leading zeros, padded to ``width`` and never cut to it."""
    digits = F.trim(value).try_cast("decimal(38,0)").cast("string")
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def as_text(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Stringify the given columns (default: all that are not text yet)."""
    chosen = set(columns) if columns is not None else {c for c, t in df.dtypes if t != "string"}
    return df.select(*[F.col(c).cast("string").alias(c) if c in chosen else F.col(c) for c in df.columns])
