import pytest
from row_bags import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lastro.functions.text import as_text
from lastro.functions.values import DECLARED_TYPES
from lastro.operators.shape import SPARK_TYPES, align, coerce, declared_schema, union_ragged


def kinds(schema):
    return [(f.name, f.dataType) for f in schema]


def test_align(spark):
    target = declared_schema(["a", "b", "c"], {"c": "INTEGER"})
    batch = spark.createDataFrame([("7.9", "x", "e")], "c string, A string, extra string")
    out = align(batch, target)
    assert kinds(out.schema) == kinds(target) and rows(out) == [("x", None, 7)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), unique=True, min_size=1), st.lists(st.sampled_from("abcdef"), unique=True, min_size=1))
def test_aligned_frames_have_exactly_the_target(spark, have, want):
    df = spark.createDataFrame([tuple("1" for _ in have)], have)
    target = T.StructType([T.StructField(c, T.LongType()) for c in want])
    out = align(df, target)
    assert kinds(out.schema) == kinds(target)
    assert tuple(out.first()) == tuple(1 if c in have else None for c in want)


def test_declared_schema():
    schema = declared_schema(["a", "b", "c"], {"a": "REAL", "b": "DATE:dmy"})
    assert [f.dataType.simpleString() for f in schema] == ["double", "date", "string"]
    kept = declared_schema(["a", "b"], {"a": "REAL", "b": "DATE"}, keep_text=True)
    assert [f.dataType.simpleString() for f in kept] == ["double", "string"]
    assert set(SPARK_TYPES) == set(DECLARED_TYPES)


def test_coerced_types_match_the_declared_schema(spark):
    columns = [t.lower() for t in DECLARED_TYPES]
    types = dict(zip(columns, DECLARED_TYPES))
    df = spark.createDataFrame([tuple("1" for _ in columns)], columns)
    for keep in (False, True):
        got = [f.dataType for f in coerce(df, types, keep).schema]
        assert got == [f.dataType for f in declared_schema(columns, types, keep)]


def test_ragged_union_keeps_repeats(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1,)], "k int")
    assert rows(union_ragged([a, b, a])) == [(1, "x"), (1, "x"), (1, None)]


def test_as_text(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    assert rows(as_text(df)) == [("1", "2.5", "x")]
    assert as_text(df, ["a"]).dtypes == [("a", "string"), ("b", "double"), ("c", "string")]


def test_unknown_type_is_an_error(spark):
    with pytest.raises(ValueError):
        coerce(spark.createDataFrame([("1",)], ["a"]), {"a": "FLOAT"})
