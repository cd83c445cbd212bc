import pytest
from row_bags import rows
from pyspark.sql import functions as F

from lastro.operators.registry import current_registry, key_columns, latest_state, register_key, with_key_columns
from lastro.plans.load import append_tables, replace_tables
from lastro.sources.catalog import catalog_report, table_exists, table_schema
from lastro.sources.delimited import read_inputs
from lastro.streaming.landing import append_delimited


def orders(spark, *data):
    return spark.createDataFrame(list(data), "`Nº Doc` string, Material string, Quantidade string")


def test_replace_then_append(fresh):
    spark = fresh
    first = orders(spark, ("12345", "ABC123", "10"), ("12346", "ABC123", "x"))
    done = replace_tables(spark, {"pedidos": first}, {"pedidos": {"Quantidade": "INTEGER"}}, {"pedidos": ["No_Doc", "Material"]})
    assert [(r.table, r.incoming, r.written, r.skipped) for r in done] == [("pedidos", 2, 2, 0)]
    assert rows(spark.table("pedidos")) == [("12345", "ABC123", 10, "12345|ABC123"), ("12346", "ABC123", 0, "12346|ABC123")]
    assert key_columns(spark, "pedidos") == ["No_Doc", "Material"]

    more = spark.createDataFrame(
        [("7", "12345", "ABC123", "e"), ("8", "99", "Z", "e"), ("bad", "100", "Z", "e")],
        "quantidade string, `Nº Doc` string, Material string, extra string",
    )
    done = append_tables(spark, {"pedidos": more})
    assert [(r.incoming, r.written, r.skipped) for r in done] == [(3, 2, 1)]
    assert rows(spark.table("pedidos").filter("_PK like '%Z'")) == [("100", "Z", 0, "100|Z"), ("99", "Z", 8, "99|Z")]
    # Appending once more adds nothing.
    assert append_tables(spark, {"pedidos": more})[0].written == 0


def test_append_100_50_50(fresh):
    spark = fresh
    text = lambda a, b: spark.range(a, b).selectExpr("CAST(id AS STRING) AS k", "'x' AS v")
    replace_tables(spark, {"t": text(0, 100)}, keys={"t": ["k"]})
    done = append_tables(spark, {"t": text(50, 150)})[0]
    assert (done.incoming, done.written, done.skipped) == (100, 50, 50)
    assert spark.table("t").count() == 150


def test_append_checks_all_targets_before_writing(fresh):
    spark = fresh
    df = spark.createDataFrame([("1",)], ["k"])
    replace_tables(spark, {"here": df})
    with pytest.raises(ValueError, match="absent"):
        append_tables(spark, {"here": df, "absent": df})
    assert spark.table("here").count() == 1 and not table_exists(spark, "absent")


def test_replace_checks_all_keys_before_writing(fresh):
    spark = fresh
    df = spark.createDataFrame([("1",)], ["k"])
    with pytest.raises(ValueError, match="nope"):
        replace_tables(spark, {"a": df, "b": df}, keys={"b": ["nope"]})
    assert not table_exists(spark, "a")


def test_key_is_built_from_the_text_as_read(fresh):
    spark = fresh
    df = spark.createDataFrame([("007", "x")], ["n", "v"])
    replace_tables(spark, {"t": df}, {"t": {"n": "INTEGER"}}, {"t": ["n"]})
    assert rows(spark.table("t")) == [(7, "x", "007")]


def test_append_reads_dates_as_declared(fresh):
    spark = fresh
    df = lambda *data: spark.createDataFrame(list(data), ["k", "d"])
    types = {"t": {"d": "DATE:dmy"}}
    replace_tables(spark, {"t": df(("1", "31/12/2024"))}, types, {"t": ["k"]})
    append_tables(spark, {"t": df(("2", "01/02/2024"))}, types)
    assert [(r.k, str(r.d)) for r in spark.table("t").orderBy("k").collect()] == [("1", "2024-12-31"), ("2", "2024-02-01")]


def test_unkeyed_append_keeps_everything(fresh):
    spark = fresh
    df = spark.createDataFrame([("1",), ("1",)], ["k"])
    replace_tables(spark, {"t": df})
    append_tables(spark, {"t": df})
    assert spark.table("t").count() == 4


def test_key_column_without_registry_entry(fresh):
    spark = fresh
    df = spark.createDataFrame([("1",)], ["k"])
    replace_tables(spark, {"t": df}, keys={"t": ["k"]})
    register_key(spark, "t", None)
    with pytest.warns(UserWarning, match="no registered key"):
        append_tables(spark, {"t": df})
    assert rows(spark.table("t")) == [("1", "1"), ("1", None)]


def test_replace_without_key_removes_the_registry_entry(fresh):
    spark = fresh
    df = spark.createDataFrame([("1",)], ["k"])
    replace_tables(spark, {"t": df, "u": df}, keys={"t": ["k"], "u": ["k"]})
    replace_tables(spark, {"t": df})
    assert key_columns(spark, "t") is None and key_columns(spark, "u") == ["k"]
    assert [r.table_name for r in current_registry(spark).collect()] == ["u"]
    assert table_schema(spark, "t").fieldNames() == ["k"]
    assert table_schema(spark, "missing") is None


def test_latest_registry_state(spark):
    log = spark.createDataFrame(
        [("a", ["x"], 1), ("a", ["y", "z"], 2), ("b", ["x"], 1), ("b", None, 2), ("c", None, 1), ("c", ["q"], 2)],
        "table_name string, key_columns array<string>, t int",
    ).selectExpr("table_name", "key_columns", "timestamp_seconds(t) AS created_at")
    now = latest_state(log)
    assert rows(now.select("table_name", "key_columns")) == [("a", ["y", "z"]), ("c", ["q"])]
    asked = spark.createDataFrame([("a",), ("b",), ("zz",)], ["table_name"])
    assert rows(with_key_columns(asked, now)) == [("a", ["y", "z"]), ("b", None), ("zz", None)]


def test_catalog_report(fresh):
    spark = fresh
    df = spark.createDataFrame([("1", "2")], ["k", "v"])
    replace_tables(spark, {"t": df, "xunderscore": df}, {"t": {"v": "REAL"}}, {"t": ["k", "v"]})
    report = catalog_report(spark, current_registry(spark), counts=True)
    got = {r.table_name: r for r in report.collect() if r.table_name in ("t", "xunderscore")}
    assert got["t"].columns == "k (string), v (double), _PK (string)"
    assert (got["t"].key_columns, got["t"].has_key_column, got["t"].n_rows) == ("k + v", True, 1)
    assert got["xunderscore"].key_columns is None
    assert not [r for r in report.collect() if r.table_name.startswith("_")]


def test_csv_end_to_end(fresh, tmp_path):
    (tmp_path / "in.csv").write_text("Código,Valor (R$)\n001,1.5\n002,x\n", encoding="utf-8")
    replace_tables(fresh, read_inputs(fresh, str(tmp_path / "in.csv")), {"Sheet1": {"Valor_R": "REAL"}}, {"Sheet1": ["Codigo"]})
    assert rows(fresh.table("Sheet1")) == [("001", 1.5, "001"), ("002", None, "002")]


def test_rows_per_file(fresh):
    replace_tables(fresh, {"t": fresh.range(100).coalesce(1).select(F.col("id").cast("string"))}, rows_per_file=30)
    assert len(fresh.table("t").inputFiles()) == 4


def test_landing_folder(fresh, tmp_path):
    spark = fresh
    text = lambda a, b: spark.range(a, b).selectExpr("CAST(id AS STRING) AS k", "'x' AS v")
    replace_tables(spark, {"t": text(0, 10)}, keys={"t": ["k"]})
    landing, state = str(tmp_path / "in"), str(tmp_path / "state")
    for a, b in ((5, 20), (15, 30)):
        text(a, b).coalesce(1).write.mode("append").option("header", True).csv(landing)
        append_delimited(spark, landing, "t", ["k", "v"], state, files_per_batch=1).awaitTermination()
    append_delimited(spark, landing, "t", ["k", "v"], state).awaitTermination()
    assert sorted(int(r.k) for r in spark.table("t").collect()) == list(range(30))


def test_landing_stops_at_a_long_record(fresh, tmp_path):
    spark = fresh
    replace_tables(spark, {"t": spark.createDataFrame([("1", "x")], ["k", "v"])}, keys={"t": ["k"]})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("k,v\n2,x\n3,y,z\n")
    with pytest.raises(Exception, match="more than 2 cells"):
        append_delimited(spark, str(tmp_path / "in"), "t", ["k", "v"], str(tmp_path / "state")).awaitTermination()
    assert spark.table("t").count() == 1


def test_each_database_has_its_own_registry(fresh, tmp_path):
    spark = fresh
    df = spark.createDataFrame([("1", "x")], ["k", "v"])
    for name in ("one", "two"):
        spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/{name}'")
    try:
        replace_tables(spark, {"one.t": df, "two.t": df}, keys={"one.t": ["k"], "two.t": ["v"]})
        assert key_columns(spark, "one.t") == ["k"] and key_columns(spark, "two.t") == ["v"]
        assert key_columns(spark, "t") is None
        report = catalog_report(spark, current_registry(spark, "two"), database="two", counts=True).first()
        assert (report.table_name, report.key_columns, report.n_rows) == ("t", "v", 1)
    finally:
        for name in ("one", "two"):
            spark.sql(f"DROP DATABASE {name} CASCADE")


def test_append_remembers_how_cells_are_read(fresh):
    spark = fresh
    df = lambda *data: spark.createDataFrame(list(data), ["k", "d", "b", "t"])
    replace_tables(spark, {"t": df(("1", "31/12/2024", "Sim", "10:30"))}, {"t": {"d": "DATE:dmy", "b": "BOOLEAN", "t": "TIME"}}, {"t": ["k"]})
    done = append_tables(spark, {"t": df(("2", "01/02/2024", "talvez", "99:99"), ("3", "x", "", ""))})[0]
    got = [(r.k, str(r.d), r.b, r.t) for r in spark.table("t").orderBy("k").collect()]
    assert got == [("1", "2024-12-31", 1, "10:30"), ("2", "2024-02-01", None, None), ("3", "None", None, None)]
    assert (done.written, done.unread) == (2, 3)
    assert append_tables(spark, {"t": df().limit(0) if False else spark.createDataFrame([], "k string, d string, b string, t string")})[0].written == 0


def test_a_mistake_in_one_input_leaves_all_tables_alone(fresh):
    spark = fresh
    df = spark.createDataFrame([("1", "x")], ["k", "v"])
    with pytest.raises(ValueError, match="unknown types"):
        replace_tables(spark, {"a": df, "b": df}, {"b": {"k": "NUMBER"}})
    with pytest.raises(ValueError, match="no such columns"):
        replace_tables(spark, {"a": df, "b": df}, {"b": {"K_": "REAL"}})
    assert not spark.catalog.tableExists("a")
    replace_tables(spark, {"a": df, "b": df}, keys={"a": ["k"], "b": ["k"]})
    with pytest.raises(ValueError, match="no such key column"):
        append_tables(spark, {"a": spark.createDataFrame([("2", "y")], ["k", "v"]), "b": df.drop("k")})
    assert spark.table("a").count() == 1


def test_a_failed_replace_keeps_the_old_table(fresh):
    spark = fresh
    replace_tables(spark, {"t": spark.createDataFrame([("1",)], ["k"])})
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.lit("2")).cast("string").alias("k"))
    with pytest.raises(Exception, match="broken"):
        replace_tables(spark, {"t": broken})
    assert rows(spark.table("t")) == [("1",)]
    assert [t.name for t in spark.catalog.listTables() if "_new_" in t.name or "_old_" in t.name] == []


def test_inputs_named_like_sheets(fresh):
    spark = fresh
    df = spark.createDataFrame([("1",)], ["k"])
    done = replace_tables(spark, {"Plan 1": df, "Ação v1.2": df}, keys={"Plan 1": ["k"]})
    assert [r.table for r in done] == ["Plan_1", "Acao_v12"]
    assert append_tables(spark, {"Plan 1": df})[0].written == 0
    with pytest.raises(ValueError, match="share a table"):
        replace_tables(spark, {"Plan 1": df, "Plan_1": df})
