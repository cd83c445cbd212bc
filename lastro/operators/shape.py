"""Schemas: alignment to a target, ragged union, conversion by a declared type map."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastro.functions.values import DECLARED_TYPES, converted, converted_to

# The Spark type of each declared type name.
SPARK_TYPES = {
    "TEXT": T.StringType(),
    "INTEGER": T.LongType(),
    "REAL": T.DoubleType(),
    "NUMERIC": T.DecimalType(38, 10),
    "BLOB": T.BinaryType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampType(),
    "TIME": T.StringType(),
    "BOOLEAN": T.IntegerType(),
}


def declared_schema(columns: Iterable[str], types: Mapping[str, str], keep_text: bool = False) -> T.StructType:
    """The table schema for a type map; unlisted columns are TEXT."""
    changed = ("INTEGER", "REAL", "BOOLEAN") if keep_text else DECLARED_TYPES
    fields = []
    for column in columns:
        name = types.get(column, "TEXT").partition(":")[0]
        fields.append(T.StructField(column, SPARK_TYPES[name if name in changed else "TEXT"]))
    return T.StructType(fields)


#: Column metadata that remembers how a column's text is read; tables keep it with their schema.
DECLARED, KEPT_TEXT = "declared_type", "kept_text"


def coerce(df: DataFrame, types: Mapping[str, str], keep_text: bool = False) -> DataFrame:
    """Convert the listed columns to their declared types; others, and unknown names, are left.

    The declaration stays with the column as metadata, so that ``align`` reads later text alike.
    """
    out = []
    for c in df.columns:
        if c in types:
            note = {DECLARED: types[c], KEPT_TEXT: keep_text}
            out.append(converted(F.col(c), types[c], keep_text).alias(c, metadata=note))
        else:
            out.append(F.col(c))
    return df.select(*out)


def read_as(value: Column, field: T.StructField) -> Column:
    """Text as the values of a stored column: by its declaration, or else by its type."""
    declared = field.metadata.get(DECLARED)
    if declared:
        return converted(value, declared, field.metadata.get(KEPT_TEXT, False)).try_cast(field.dataType)
    return converted_to(value, field.dataType.simpleString())


def unread_cells(df: DataFrame, target: T.StructType) -> Column:
    """An aggregate: filled text cells that become NULL in the target's columns."""
    have = {f.name.lower(): f for f in df.schema.fields}
    lost = F.lit(0)
    for field in target.fields:
        source = have.get(field.name.lower())
        if source is not None and isinstance(source.dataType, T.StringType) and (field.dataType != source.dataType or DECLARED in field.metadata):
            value = F.col(f"`{source.name}`")
            lost = lost + F.when((F.trim(value) != "") & read_as(value, field).isNull(), 1).otherwise(0)
    return F.coalesce(F.sum(lost), F.lit(0))


def align(df: DataFrame, target: T.StructType) -> DataFrame:
    """Exactly the target's columns, order and types: extras drop, missing ones are typed NULLs."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for field in target.fields:
        source = have.get(field.name.lower())
        if source is None:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(source.dataType, T.StringType) and (source.dataType != field.dataType or DECLARED in field.metadata):
            value = read_as(F.col(source.name), field)
        elif source.dataType == field.dataType:
            value = F.col(source.name)
        else:
            value = F.col(source.name).try_cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def union_ragged(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames; a column missing in one is NULL there. Repeats stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
