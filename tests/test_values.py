import datetime
import decimal

import pytest
from row_bags import rows
from pyspark.sql import functions as F

from lastro.functions.text import date_part, padded_number
from lastro.functions.values import converted, converted_to
from lastro.operators.infer import infer_types, type_map
from lastro.operators.shape import coerce


def convert(spark, texts, declared, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", converted(F.col("t"), declared, **options).alias("v")).orderBy("i").collect()]


def test_integer(spark):
    texts = ["12", "12.7", "-12.7", "x", "", None, " 7 ", "1e3", "1d", "9007199254740993", "1e30", "1,5"]
    assert convert(spark, texts, "INTEGER") == [12, 12, -12, 0, 0, 0, 7, 1000, 0, 9007199254740993, 0, 0]


def test_real(spark):
    assert convert(spark, ["12", "12.7", "-12.7", "x", "", "1d", ".5", "5."], "REAL") == [
        12.0, 12.7, -12.7, None, None, None, 0.5, 5.0,
    ]
    assert convert(spark, ["inf", "-Infinity"], "REAL") == [float("inf"), float("-inf")]


def test_boolean(spark):
    texts = ["Sim", "não", "TRUE", "false", "1", "0", "NÃO", "yes", "No", "talvez", ""]
    assert convert(spark, texts, "BOOLEAN") == [1, 0, 1, 0, 1, 0, 0, 1, 0, None, None]


def test_other_types(spark):
    assert convert(spark, ["1.5", "x"], "NUMERIC") == [decimal.Decimal("1.5"), None]
    day = datetime.date(2024, 1, 5)
    assert convert(spark, ["2024-01-05", "2024/1/5", "2024-02-30", "x"], "DATE") == [day, day, None, None]
    assert convert(spark, ["05/01/2024"], "DATE:dmy") == [day]
    assert convert(spark, ["01/05/2024"], "DATE:mdy") == [day]
    stamp = datetime.datetime(2024, 1, 5, 10, 30)
    assert convert(spark, ["2024-01-05 10:30:00", "2024-01-05T10:30"], "DATETIME") == [stamp, stamp]
    assert convert(spark, ["14:30", "23:59:59", "25:00"], "TIME") == ["14:30", "23:59:59", None]
    assert convert(spark, ["ab"], "BLOB") == [bytearray(b"ab")]
    with pytest.raises(ValueError):
        convert(spark, ["x"], "MONEY")


def test_keep_text_changes_only_three_types(spark):
    for declared in ("NUMERIC", "BLOB", "DATE", "DATETIME", "TIME", "TEXT"):
        assert convert(spark, ["31/31/2024"], declared, keep_text=True) == ["31/31/2024"]
    assert convert(spark, ["7"], "INTEGER", keep_text=True) == [7]


def test_conversion_to_an_existing_type(spark):
    df = spark.createDataFrame([("12.7", "Sim", "2024-01-05")], "a string, b string, c string")
    out = df.select(
        converted_to(F.col("a"), "bigint"), converted_to(F.col("b"), "int"), converted_to(F.col("c"), "date"),
        converted_to(F.col("a"), "decimal(9,1)"), converted_to(F.col("b"), "boolean"), converted_to(F.col("b"), "double"),
    )
    assert tuple(out.first()) == (12, 1, datetime.date(2024, 1, 5), decimal.Decimal("12.7"), True, None)


def test_text_helpers(spark):
    df = spark.createDataFrame([("1",), ("100",), ("07",), ("12345",)], "n string")
    assert rows(df.select(padded_number(F.col("n")))) == [("01",), ("07",), ("100",), ("12345",)]
    stamps = spark.createDataFrame([("2024-01-31T23:30:00-03:00",), ("2024-01-31",)], "s string")
    assert {r[0] for r in stamps.select(date_part(F.col("s"))).collect()} == {"2024-01-31"}


TYPES = {
    "integer": (["1", "2", "3"], "INTEGER"),
    "real": (["1.5", "2.3", "3.7"], "REAL"),
    "signed": (["-5", "7", "7"], "REAL"),
    "date": (["2024-01-01", "2024-12-31", ""], "DATE"),
    "datetime": (["2024-01-01 10:00:00", "2024-01-02", ""], "DATETIME"),
    "boolean": (["Sim", "Não", "Sim"], "BOOLEAN"),
    "zero_one": (["0", "1", "0"], "INTEGER"),
    "three_spellings": (["sim", "Sim", "não"], "TEXT"),
    "one_token": (["sim", "sim", "sim"], "TEXT"),
    "leading_zero": (["00123", "5", "6"], "TEXT"),
    "key_44": (["1" * 44, "2" * 44, "3" * 44], "TEXT"),
    "blank_only": (["", " ", ""], "TEXT"),
    "with_blank": (["1", "", "3"], "INTEGER"),
    "mixed_dates": (["2024-01-01", "31/12/2024", ""], "TEXT"),
    "bad_date": (["2024-02-30", "2024-01-01", ""], "TEXT"),
    "brazilian": (["31/12/2024", "01/02/2024", ""], "DATE"),
    "american": (["12/31/2024", "01/02/2024", ""], "DATE"),
    "clock": (["14:30", "08:00", ""], "DATETIME"),
    "words": (["a", "b", "1"], "TEXT"),
    "comma_decimal": (["1,5", "2", "3"], "TEXT"),
}


def typed_input(spark):
    columns = list(TYPES)
    return spark.createDataFrame(list(zip(*[TYPES[c][0] for c in columns])), columns)


def test_inference(spark):
    got = {r.column_name: r for r in infer_types(typed_input(spark)).collect()}
    assert {c: got[c].declared_type for c in TYPES} == {c: t for c, (_, t) in TYPES.items()}
    assert got["brazilian"].date_format == "dmy" and got["american"].date_format == "mdy"


def test_inferred_map_feeds_coercion(spark):
    df = typed_input(spark)
    types = type_map(df)
    assert types["brazilian"] == "DATE:dmy" and types["date"] == "DATE"
    typed = coerce(df, types)
    assert typed.schema["integer"].dataType.simpleString() == "bigint"
    assert rows(typed.select("brazilian"))[0] == (None,)
    assert typed.filter("leading_zero = '00123'").count() == 1


def test_sampled_inference_looks_at_the_first_rows(spark):
    df = spark.range(300).selectExpr("CASE WHEN id < 200 THEN CAST(id AS STRING) ELSE 'x' END AS v").coalesce(1)
    assert infer_types(df, 100).first().declared_type == "INTEGER"
    assert infer_types(df).first().declared_type == "TEXT"
