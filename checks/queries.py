"""One query per operator over the whole test tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.functions.names import with_clean_names
from lastro.functions.text import as_text
from lastro.functions.values import converted
from lastro.operators.fiscal import CTE, NFE, flatten, rejects, root_name, type_counts, with_type
from lastro.operators.infer import column_facts, infer_types, merged_facts, proposed_types
from lastro.operators.keys import append_counts, first_per_key, new_records, with_key
from lastro.operators.registry import latest_state, with_key_columns
from lastro.operators.reports import freight_links, price_history, report_on, row_counts, tax_by_code, top_suppliers
from lastro.operators.shape import align, coerce, declared_schema, union_ragged
from lastro.plans.fiscal import CSV_OUT, FiscalData, export_by_type, load_documents, load_folder, stage
from lastro.plans.load import append_tables, replace_tables
from checks.order_documents import cte_documents, mixed_documents, nfe_documents
from lastro.session import drop_folder, shared_folder
from lastro.sources.catalog import catalog_report
from lastro.sources.delimited import preview, read_inputs, scan_delimited
from lastro.sources.key_index import build_key_index
from lastro.sources.xml_folder import decoded_text, read_xml_folder
from lastro.streaming.landing import append_delimited, append_xml

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
BROKEN_EVERY = 97
PRODUCT_CODE = "00000007"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nfe_docs(spark: SparkSession, folder: str, **options) -> DataFrame:
    names = ("lineitem", "orders", "customer", "supplier")
    return nfe_documents(*[table(spark, folder, n) for n in names], **options)


def cte_docs(spark: SparkSession, folder: str) -> DataFrame:
    return cte_documents(table(spark, folder, "orders"), table(spark, folder, "customer"))


# --- fiscal documents ---------------------------------------------------------------------------


def nfe_items_flatten(spark, folder):
    return flatten(nfe_docs(spark, folder), NFE)


def nfe_items_typed(spark, folder):
    return flatten(nfe_docs(spark, folder), NFE, typed=True)


def nfe_tax_by_cst(spark, folder):
    return report_on(nfe_docs(spark, folder), tax_by_code)


def nfe_top_suppliers(spark, folder):
    return report_on(nfe_docs(spark, folder), top_suppliers)


def nfe_price_history(spark, folder):
    return report_on(nfe_docs(spark, folder), price_history, PRODUCT_CODE)


def freight_invoice_links(spark, folder):
    freight = flatten(cte_docs(spark, folder), CTE, ["Chave_CTE", "NF_ref", "VLR_Servico"])
    return freight_links(freight, flatten(nfe_docs(spark, folder), NFE, ["Chave_NFe", "Vlr_Produto"]))


def nfe_decode_labels(spark, folder):
    labels = ["Tipo_de_NF", "Local_Operacao", "Regime_Tributario", "Modalidade_Frete"]
    items = flatten(nfe_docs(spark, folder), NFE, labels)
    return items.groupBy(*labels).agg(F.count(F.lit(1)).alias("n_items"))


def nfe_reject_invalid(spark, folder):
    bad = rejects(nfe_docs(spark, folder, broken_every=BROKEN_EVERY))
    return bad.groupBy("doc_type", "reason").agg(F.count(F.lit(1)).alias("n_documents"))


def nfe_keep_valid(spark, folder):
    docs = nfe_docs(spark, folder, broken_every=BROKEN_EVERY)
    return flatten(docs, NFE, ["Chave_NFe", "No_Item", "Codigo_produto"])


def cte_flatten(spark, folder):
    return flatten(cte_docs(spark, folder), CTE)


def cte_typed(spark, folder):
    return flatten(cte_docs(spark, folder), CTE, typed=True)


def doc_classify(spark, folder):
    return type_counts(mixed_documents(table(spark, folder, "orders")))


def doc_types(spark, folder):
    docs = with_type(mixed_documents(table(spark, folder, "orders")))
    return docs.select("path", root_name(F.col("text")).alias("root"), "doc_type")


def mixed_split_counts(spark, folder):
    """Both document types in one input, flattened into the two tables."""
    data = stage(nfe_docs(spark, folder).unionByName(cte_docs(spark, folder)))
    return row_counts({"NFe": data.nfe, "CTe": data.cte})


def export_roundtrip(spark, folder):
    """Write one folder per type and scan it again as text."""
    docs = nfe_docs(spark, folder).unionByName(cte_docs(spark, folder))
    nfe = flatten(docs, NFE, ["Chave_NFe", "No_Item", "Descricao_produto", "Vlr_ICMS"])
    cte = flatten(docs, CTE, ["Chave_CTE", "Tomador", "Tipo_do_servico", "Vlr_ICMS"])
    out = shared_folder(spark, "export")
    export_by_type(FiscalData(nfe, cte, nfe.limit(0)), out)
    scans = [
        scan_delimited(spark, f"{out}/{t}", multiline=False).rows.withColumn("doc_type", F.lit(t)) for t in (NFE, CTE)
    ]
    return union_ragged(scans)


# --- delimited text -----------------------------------------------------------------------------


def _written_csv(df: DataFrame) -> str:
    path = shared_folder(df.sparkSession, "csv")
    df.write.options(**CSV_OUT).csv(path)
    return path


def _order_text(spark, folder) -> DataFrame:
    """Orders as a text input with the labels and blanks of a hand-kept sheet."""
    o = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("Nº do Pedido"),
        F.when(key % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("Prioridade (nível)"),
        F.when(key % 7 == 0, "NA").otherwise(F.col("o_orderstatus")).alias("Situação"),
        F.when(key % 3 == 0, ' a "b", c ').otherwise(F.lit(" x")).alias("% de Nota"),
        F.col("o_orderdate").cast("date").cast("string").alias("Data"),
    )


def scan_text_roundtrip(spark, folder):
    return scan_delimited(spark, _written_csv(_order_text(spark, folder))).rows


def scan_text_multiline(spark, folder):
    """Whole texts with line breaks inside the cells."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    return scan_delimited(spark, _written_csv(docs)).rows


#: Bytes of the table whose rows share a CSV file, and items whose documents share an XML file: more than one split.
BYTES_PER_FILE, ITEMS_PER_FILE = 128 << 20, 300_000


def _bytes(spark, path: str) -> int:
    return spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]


def scan_multiline_split(spark, folder):
    """The same in few large files, one for a small table, which many tasks cut into records."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")
    path = _written_csv(docs.coalesce(_bytes(spark, f"{folder}/documents.parquet") // BYTES_PER_FILE + 1))
    size, setting = _bytes(spark, path), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, min(64 << 20, size // 8 + 1))
        return scan_delimited(spark, path).rows
    finally:
        spark.conf.set(setting, before)


def scan_long_rows(spark, folder):
    """Short rows are padded, rows with too many cells are set apart."""
    key = F.col("o_orderkey")
    k = key.cast("string")
    line = (
        F.when(key % 10 == 0, F.concat(k, F.lit(",x,y,z")))
        .when(key % 10 == 1, F.concat(k, F.lit(",x")))
        .when(key % 10 == 2, F.concat(k, F.lit(',"a, ""b""",c')))
        .when(key % 10 == 3, F.concat(k, F.lit(',"a,b",c,')))
        .otherwise(F.concat(k, F.lit(",NA,")))
    )
    raw = table(spark, folder, "orders").select(line.alias("a,b,c"))
    path = shared_folder(spark, "raw")
    # A separator and quote that never occur leave the lines as they are.
    raw.write.option("header", True).option("sep", "\x01").option("quote", "\x00").csv(path)
    scan = scan_delimited(spark, path, on_long_row="reject")
    return union_ragged([scan.rows, scan.rejects])


def preview_rows(spark, folder):
    return preview(table(spark, folder, "part").orderBy("p_partkey").select("p_partkey", "p_name", "p_size"))


def named_inputs(spark, folder):
    """Several named inputs at once, as the sheets of one workbook."""
    names = ("region", "nation", "customer", "supplier")
    return row_counts(read_inputs(spark, {n: f"{folder}/{n}.parquet" for n in names}))


# --- names, types, keys, shape ------------------------------------------------------------------


def normalize_names(spark, folder):
    labels = ["Código@Cliente", "Nome  do Cliente", "País", "% de Saldo", "PAÍS"]
    return with_clean_names(table(spark, folder, "customer").toDF(*labels))


def _untyped(spark, folder) -> DataFrame:
    """All kinds of text columns for type inference."""
    o = table(spark, folder, "orders")
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    extra = {
        "paid": F.when(key % 2 == 0, "Sim").otherwise("Não"),
        "flag": (key % 2),
        "code": F.lpad(key.cast("string"), 8, "0"),
        "long_id": F.lpad((key + 1).cast("string"), 44, "7"),
        "signed": -key - 1,
        "with_blanks": F.when(key % 4 == 0, "").otherwise(key.cast("string")),
        "blank": F.lit(" "),
        "day": day.cast("date"),
        "day_br": F.date_format(day, "dd/MM/yyyy"),
        "day_mixed": F.when(key % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(day.cast("date").cast("string")),
        "clock": F.lit("14:30"),
        "three": F.element_at(F.array(F.lit("yes"), F.lit("no"), F.lit("YES")), (key % 3 + 1).cast("int")),
    }
    return as_text(o.select(*o.columns, *[c.alias(n) for n, c in extra.items()]))


def infer_column_types(spark, folder):
    return infer_types(_untyped(spark, folder))


def _raw_values(spark, folder) -> DataFrame:
    li = table(spark, folder, "lineitem")
    part, turn = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 7
    day = F.col("l_shipdate").cast("date").cast("string")
    number = (
        F.when(turn == 0, F.col("l_quantity").cast("decimal(18,1)").cast("string"))
        .when(turn == 1, F.concat(F.lit("-"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")))
        .when(turn == 2, F.concat(F.lit("x"), part))
        .when(turn == 3, "")
        .when(turn == 4, F.concat(F.lit(" "), part, F.lit(" ")))
        .when(turn == 5, F.concat(part, F.lit("e2")))
        .otherwise(F.concat(part, F.lit("d")))
    )
    token = (
        F.when(turn == 0, "TRUE").when(turn == 1, "não").when(turn == 2, "Sim").when(turn == 3, "")
        .when(turn == 4, "0").when(turn == 5, " no ").otherwise("talvez")
    )
    date = (
        F.when(turn < 3, day).when(turn == 3, "").when(turn == 4, F.concat(day, F.lit(" 10:30:00")))
        .when(turn == 5, F.replace(day, F.lit("-"), F.lit("/"))).otherwise("2024-02-30")
    )
    return li.select("l_orderkey", "l_linenumber", number.alias("number"), token.alias("token"), date.alias("date"))


def _converted(spark, folder, source: str, declared: str) -> DataFrame:
    raw = _raw_values(spark, folder)
    return raw.select("l_orderkey", "l_linenumber", source, converted(F.col(source), declared).alias("value"))


def coerce_integer(spark, folder):
    return _converted(spark, folder, "number", "INTEGER")


def coerce_real(spark, folder):
    return _converted(spark, folder, "number", "REAL")


def coerce_numeric(spark, folder):
    return _converted(spark, folder, "number", "NUMERIC")


def coerce_boolean(spark, folder):
    return _converted(spark, folder, "token", "BOOLEAN")


def coerce_date(spark, folder):
    return _converted(spark, folder, "date", "DATE")


def coerce_datetime(spark, folder):
    return _converted(spark, folder, "date", "DATETIME")


def coerce_by_type_map(spark, folder):
    raw = as_text(table(spark, folder, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"))
    types = {"p_partkey": "INTEGER", "p_size": "REAL", "p_name": "INTEGER"}
    return coerce(raw, types).drop("p_retailprice")


def stringify_cells(spark, folder):
    return as_text(table(spark, folder, "events").select("event_id", "ts", "event_type"))


def _keyed_items(spark, folder, columns=("l_orderkey", "l_linenumber")) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return with_key(items, columns)


def composite_key(spark, folder):
    items = _keyed_items(spark, folder).withColumn("part", F.nullif("l_partkey", F.lit(7).cast("bigint")))
    return with_key(items.drop("_PK", "l_partkey"), ["l_orderkey", "part", "l_linenumber"])


def _batch_and_stored(spark, folder) -> tuple[DataFrame, DataFrame]:
    items = _keyed_items(spark, folder)
    return items.filter("l_orderkey % 2 = 0 OR l_orderkey % 3 <> 0"), items.filter(F.col("l_orderkey") % 3 == 0)


def append_dedup(spark, folder):
    return new_records(*_batch_and_stored(spark, folder))


def append_dedup_counts(spark, folder):
    return append_counts(*_batch_and_stored(spark, folder))


def enforce_key(spark, folder):
    items = table(spark, folder, "lineitem")
    return first_per_key(items, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


def align_schema(spark, folder):
    target = declared_schema(
        ["c_custkey", "c_name", "c_phone", "c_nationkey"], {"c_custkey": "INTEGER", "c_nationkey": "REAL"}
    )
    return align(as_text(table(spark, folder, "customer")), target)


def union_ragged_tables(spark, folder):
    buyers = table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")
    )
    sellers = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return union_ragged([buyers, sellers])


# --- registry, catalog, loads -------------------------------------------------------------------


def key_registry_lookup(spark, folder):
    """Each event registers a key for one of its type's tables; the last one counts."""
    e = table(spark, folder, "events")
    name = F.concat_ws("_", "event_type", (F.col("user_id") % 50).cast("string"))
    columns = F.when(F.col("event_id") % 5 != 0, F.array(F.lit("user"), (F.col("event_id") % 9).cast("string")))
    log = e.select(name.alias("table_name"), columns.alias("key_columns"), F.col("ts").alias("created_at"))
    asked = e.select(F.concat_ws("_", "event_type", (F.col("user_id") % 60).cast("string")).alias("table_name")).distinct()
    found = with_key_columns(asked, latest_state(log))
    return found.select("table_name", F.array_join("key_columns", ",").alias("key_columns"))


def catalog_report_tables(spark, folder):
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)
    schema = "table_name string, key_columns array<string>"
    registry = spark.createDataFrame([("lineitem", ["l_orderkey", "l_linenumber"]), ("gone", ["x"])], schema)
    return catalog_report(spark, registry, TABLES, counts=True)


def table_row_counts(spark, folder):
    return row_counts({name: table(spark, folder, name) for name in TABLES})


def _new_database(spark) -> str:
    """A database of its own per run, in the shared folder."""
    path = shared_folder(spark, "check")
    name = f"check_{path[-12:]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


def load_replace_append(spark, folder):
    """Replace a keyed, typed table, then append an overlapping batch with another column order."""
    name = f"{_new_database(spark)}.orders"
    text = as_text(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    key = F.col("o_orderkey").cast("bigint")
    first = text.filter(key % 3 == 0)
    again = text.filter((key % 2 == 0) | (key % 3 != 0)).select("o_orderpriority", "o_orderkey", F.lit("extra").alias("extra"))
    replace_tables(spark, {name: first}, {name: {"o_custkey": "INTEGER"}}, {name: ["o_orderkey"]})
    append_tables(spark, {name: again})
    return spark.table(name)


def load_documents_append(spark, folder):
    """Load the even orders' documents, then append all of them: each document once, with all items."""
    database = _new_database(spark)
    docs = nfe_docs(spark, folder).unionByName(cte_docs(spark, folder))
    even = F.split("path", "/")[1].cast("bigint") % 2 == 0
    load_documents(spark, docs.filter(even), database=database, typed=True)
    load_documents(spark, docs, database=database, typed=True, append=True)
    nfe = spark.table(f"{database}.NFe").select("_PK", "No_Item", "Vlr_Produto")
    cte = spark.table(f"{database}.CTe").select("_PK", F.lit(0).alias("No_Item"), F.col("VLR_Servico").alias("Vlr_Produto"))
    return nfe.unionByName(cte)


def incremental_append(spark, folder):
    """Two overlapping landings in one folder, taken up by a stream one file at a time."""
    name = f"{_new_database(spark)}.landing"
    text = as_text(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"))
    key = F.col("p_partkey").cast("bigint")
    landing, checkpoint = shared_folder(spark, "landing"), shared_folder(spark, "landing-state")
    replace_tables(spark, {name: text.limit(0)}, {name: {"p_size": "INTEGER"}}, {name: ["p_partkey"]})
    for batch in (text.filter(key % 2 == 0), text.filter((key % 2 != 0) | (key % 3 == 0))):
        batch.write.mode("append").options(**CSV_OUT).csv(landing)
        append_delimited(spark, landing, name, text.columns, checkpoint).awaitTermination()
    return spark.table(name)


def _append(spark, name: str, text: DataFrame, types: dict, key: str) -> DataFrame:
    """Replace with a third of the rows and declared types, then append all rows without any."""
    target = f"{_new_database(spark)}.{name}"
    replace_tables(spark, {target: text.filter(F.col(key).cast("bigint") % 3 == 0)}, {target: types}, {target: [key]})
    append_tables(spark, {target: text})
    return spark.table(target)


def append_typed_dates(spark, folder):
    """Day-first dates: the table remembers the order."""
    o = table(spark, folder, "orders")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = o.select(F.col("o_orderkey").cast("string").alias("k"), day.alias("d"), F.concat(day, F.lit(" 10:30")).alias("at"))
    return _append(spark, "dates", text, {"d": "DATE:dmy", "at": "DATETIME:dmy"}, "k")


def append_booleans(spark, folder):
    """Unknown words and blanks are NULL on append as on replace."""
    words = F.element_at(F.array(*map(F.lit, ("Sim", "não", "talvez", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    text = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("k"), words.alias("b"))
    return _append(spark, "flags", text, {"b": "BOOLEAN"}, "k")


def append_empty_batch(spark, folder):
    target = f"{_new_database(spark)}.customer"
    text = as_text(table(spark, folder, "customer").select("c_custkey", "c_name"))
    replace_tables(spark, {target: text}, keys={target: ["c_custkey"]})
    append_tables(spark, {target: text.limit(0)})
    return spark.table(target)


def append_key_index(spark, folder):
    """A stored table with a key index, and an append that asks only the buckets of its own keys."""
    name = f"{_new_database(spark)}.items"
    batch, stored = (df.drop("_PK") for df in _batch_and_stored(spark, folder))
    replace_tables(spark, {name: stored}, keys={name: ["l_orderkey", "l_linenumber"]})
    build_key_index(spark, name, buckets=16)
    append_tables(spark, {name: batch})
    return spark.table(name)


def replace_two_tables(spark, folder):
    """Two tables replaced in one run; a second run, whose last input fails while it is written, changes neither."""
    database = _new_database(spark)
    names = [f"{database}.{n}" for n in ("customer", "supplier")]
    customer = as_text(table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label")))
    supplier = as_text(table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("label")))
    replace_tables(spark, dict(zip(names, (customer, supplier), strict=True)), keys={n: ["k"] for n in names})
    broken = supplier.withColumn("label", F.when(F.col("k") != "", F.raise_error(F.lit("unreadable"))).otherwise(F.col("label")))
    try:
        replace_tables(spark, dict(zip(names, (customer.limit(0), broken), strict=True)))
    except PySparkException:
        return spark.table(names[0]).unionByName(spark.table(names[1]))
    raise AssertionError("the broken input was loaded")


def landing_replayed(spark, folder):
    """Two landings in a table without a key; the second batch is run again as after a failure, and adds nothing."""
    name = f"{_new_database(spark)}.landing"
    text = as_text(table(spark, folder, "part").select("p_partkey", "p_name", "p_size"))
    landing, checkpoint = shared_folder(spark, "landing"), shared_folder(spark, "landing-state")
    replace_tables(spark, {name: text.limit(0)}, {name: {"p_size": "INTEGER"}})
    for batch in (text.where("p_partkey % 2 = 0"), text):
        batch.write.mode("append").options(**CSV_OUT).csv(landing)
        append_delimited(spark, landing, name, text.columns, checkpoint, ledger=True).awaitTermination()
    drop_folder(spark, f"{checkpoint}/commits/1")
    append_delimited(spark, landing, name, text.columns, checkpoint, ledger=True).awaitTermination()
    return spark.table(name).drop("_landed")


def infer_incremental(spark, folder):
    """Facts of three batches, each read and stored alone, merged to one proposal."""
    path, whole = shared_folder(spark, "facts"), _untyped(spark, folder)
    for i in range(3):
        column_facts(whole.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(3)) == i)).write.mode("append").parquet(path)
    return proposed_types(merged_facts(spark.read.parquet(path)))


def load_named_sheets(spark, folder):
    """Inputs named like sheets, replaced twice in one run each; the second state counts."""
    text = {"Plan 1": as_text(table(spark, folder, "nation")), "Ação v1.2": as_text(table(spark, folder, "region"))}
    before = spark.catalog.currentDatabase()
    database = _new_database(spark)
    spark.catalog.setCurrentDatabase(database)
    try:
        for frames in ({k: df.limit(2) for k, df in text.items()}, text):
            done = replace_tables(spark, frames)
        return union_ragged([spark.table(f"{database}.{r.table}").withColumn("sheet", F.lit(r.table)) for r in done])
    finally:
        spark.catalog.setCurrentDatabase(before)


def coerce_date_dmy(spark, folder):
    """The written day, whatever the offset behind it."""
    text = F.concat(F.date_format("o_orderdate", "d/M/yyyy"), F.lit(" 23:30:00-03:00"))
    return table(spark, folder, "orders").select("o_orderkey", converted(text, "DATE:dmy").alias("d"))


def coerce_time(spark, folder):
    text = F.format_string("%02d:%02d", F.col("o_orderkey") % 30, F.col("o_orderkey") % 60)
    return table(spark, folder, "orders").select("o_orderkey", converted(text, "TIME").alias("t"))


def xml_folder_encodings(spark, folder):
    """Each customer's document in one of the encodings that files come in."""
    names = ("UTF-8", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE")
    texts, which = [], F.col("c_custkey") % len(names)
    for i, name in enumerate(names):
        prolog = F.lit(f'<?xml version="1.0"{" " * 250}encoding="{name}"?>')
        texts.append(F.when(which == i, F.encode(F.concat(prolog, F.lit("<a>Ação "), F.col("c_name"), F.lit("</a>")), name)))
    docs = table(spark, folder, "customer").select("c_custkey", decoded_text(F.coalesce(*texts)).alias("text"))
    return docs.select("c_custkey", F.regexp_extract("text", "<a>(.*)</a>", 1).alias("inside"))


def load_documents_replayed(spark, folder):
    """One batch loaded twice: its items and its rejects once."""
    database, docs = _new_database(spark), nfe_docs(spark, folder, broken_every=BROKEN_EVERY)
    for _ in range(2):
        load_documents(spark, docs, database=database, append=True)
    listed = spark.table(f"{database}._fiscal_rejects").groupBy("doc_type", "reason").agg(F.count(F.lit(1)).alias("n_documents"))
    kept = spark.table(f"{database}.NFe").agg(F.lit("NFe").alias("doc_type"), F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n_documents"))
    return listed.unionByName(kept)


# --- folders of XML files -----------------------------------------------------------------------

#: Orders whose documents share a file.
BATCH = 40
NFE_ROOT = r"</?nfeProc[^>]*>"


def _written_texts(texts: DataFrame, per_file: int | None = 1, folder: str | None = None) -> str:
    """A folder of files with these texts; Spark's text files end in ``.txt``."""
    path = folder or shared_folder(texts.sparkSession, "xml")
    writer = texts.write.mode("append")
    (writer.option("maxRecordsPerFile", per_file) if per_file else writer).text(path)
    return path


def _order_of(path: str = "path"):
    return F.split(path, "/")[1].cast("bigint")


def _batched(docs: DataFrame, root: str) -> DataFrame:
    """Documents of ``BATCH`` orders in one text under ``root``, bare as they come from their own roots."""
    inside = F.array_join(F.collect_list(F.regexp_replace("text", NFE_ROOT, "")), "\n")
    grouped = docs.groupBy(F.floor(_order_of() / BATCH).alias("batch")).agg(inside.alias("inside"))
    return grouped.select(F.concat(F.lit(f"<{root}>"), "inside", F.lit(f"</{root}>")).alias("text"))


def _as_found(docs: DataFrame) -> DataFrame:
    """Documents in the forms that folders hold: wrapped, bare, prefixed and in batches, with more tax groups."""
    k = _order_of()
    group = F.element_at(F.array(*map(F.lit, ("ICMS10", "ICMS20", "ICMS30", "ICMS40", "ICMS50", "ICMS90"))), (k % 6 + 1).cast("int"))
    docs = docs.select("path", F.replace("text", F.lit("ICMS20"), group).alias("text"))
    bare = F.regexp_replace("text", NFE_ROOT, "")
    prefixed = F.concat(F.lit('<n:nfeProc xmlns:n="urn:x">'), F.regexp_replace(bare, r"<(/?)([A-Za-z])", "<$1n:$2"), F.lit("</n:nfeProc>"))
    sound = k % BROKEN_EVERY != 0
    single = docs.where((k % 4 < 3) | ~sound)
    text = F.when(sound & (k % 4 == 1), bare).when(sound & (k % 4 == 2), prefixed).otherwise(F.col("text"))
    return single.select(text.alias("text")).unionByName(_batched(docs.where((k % 4 == 3) & sound), "enviNFe"))


def xml_folder_load(spark, folder):
    """A folder of files in all forms, some of them broken: the rows of table NFe, and the ledger of rejects by reason."""
    database = _new_database(spark)
    files = _written_texts(_as_found(nfe_docs(spark, folder, broken_every=BROKEN_EVERY)))
    load_folder(spark, files, pattern="*.txt", database=database)
    rows = spark.table(f"{database}.NFe").select("Chave_NFe", "No_Item", "Codigo_produto", "CST_ICMS", "Vlr_ICMS")
    listed = spark.table(f"{database}._fiscal_rejects").groupBy("doc_type", "reason").agg(F.count(F.lit(1)).alias("n_documents"))
    return union_ragged([rows, listed])


def xml_landing(spark, folder):
    """Two landings of batch files that overlap, taken up by a stream: every document once, with all its items."""
    database, docs, k = _new_database(spark), nfe_docs(spark, folder), _order_of()
    landing, checkpoint = shared_folder(spark, "xml-landing"), shared_folder(spark, "xml-landing-state")
    for part in (docs.where(k % 3 != 0), docs.where(k % 2 == 0), docs.where(k % 2 != 0)):
        _written_texts(_batched(part, "enviNFe"), folder=landing)
        append_xml(spark, landing, checkpoint, database=database, pattern="*.txt").awaitTermination()
    return spark.table(f"{database}.NFe").drop("_PK")


def _large_batches(docs: DataFrame, files: int) -> str:
    """Documents ``(path, text)`` in that many batch files, each written by one task with its opening and closing.

    The tasks that make the documents are put together, so no text is shuffled.
    """
    opening, closing = '<?xml version="1.0" encoding="UTF-8"?><enviNFe xmlns="urn:x"><idLote>1</idLote>', "</enviNFe>"

    def framed(texts):
        batch = lambda column: pa.RecordBatch.from_arrays([column.cast(pa.string())], names=["text"])
        yield batch(pa.array([opening]))
        for t in texts:
            yield batch(t.column("text"))
        yield batch(pa.array([closing]))

    path = shared_folder(docs.sparkSession, "xml")
    docs.select("text").coalesce(files).mapInArrow(framed, "text string").write.text(f"{path}/batches")
    return path


def xml_batch_split(spark, folder):
    """All documents in few large files, one for small tables, each read by many tasks."""
    docs = nfe_docs(spark, folder).select("path", F.regexp_replace("text", NFE_ROOT, "").alias("text"))
    files = _large_batches(docs, table(spark, folder, "lineitem").count() // ITEMS_PER_FILE + 1)
    return flatten(read_xml_folder(spark, f"{files}/*", pattern="*.txt", split_bytes=1), NFE)


def xml_entities(spark, folder):
    """Values by way of entities, nested ones too; documents whose entities never end or explode are rejects."""
    k = _order_of()
    bomb = "".join(f'<!ENTITY b{i} "{f"&b{i - 1};" * 20}">' for i in range(1, 8))
    subset = (
        F.when(k % BROKEN_EVERY == 0, F.lit(f'<!ENTITY b0 "{"x" * 50}">{bomb}<!ENTITY op "&b7;">'))
        .when(k % BROKEN_EVERY == 1, F.lit('<!ENTITY op "&other;"><!ENTITY other "&op;">'))
        .when(k % 3 == 0, F.lit("""<!ENTITY op 'V&end;'><!ENTITY end "enda"><!ENTITY un "UN">"""))
    )
    body = F.replace(F.replace("text", F.lit("<natOp>Venda<"), F.lit("<natOp>&op;<")), F.lit("<uCom>UN<"), F.when((k % BROKEN_EVERY > 1), F.lit("<uCom>&un;<")).otherwise(F.lit("<uCom>UN<")))
    declared = F.concat(F.lit("<!DOCTYPE nfeProc [\n"), subset, F.lit("]>\n"), body)
    docs = nfe_docs(spark, folder).select("path", F.when(subset.isNotNull(), declared).otherwise(F.col("text")).alias("text"))
    columns = ["Chave_NFe", "No_Item", "Natureza_da_Operacao", "Unid_medida", "Vlr_Produto"]
    data = stage(docs)
    listed = data.rejects.groupBy("doc_type", "reason").agg(F.count(F.lit(1)).alias("n_documents"))
    return union_ragged([data.nfe.select(*columns), listed])


def xml_repeated_elements(spark, folder):
    """Second elements at every depth, with other values: the first of each counts."""
    text = F.replace("text", F.lit("</natOp>"), F.lit("</natOp><natOp>Outra</natOp>"))
    second = "<prod><cProd>outro</cProd><CEST>1</CEST></prod><imposto><IPI><IPITrib><CST>98</CST></IPITrib></IPI></imposto></det>"
    text = F.replace(text, F.lit("</det>"), F.lit(second))
    text = F.replace(text, F.lit("</infNFe>"), F.lit("<ide><natOp>Outra</natOp><serie>9</serie></ide><emit><IM>9</IM></emit></infNFe>"))
    return flatten(nfe_docs(spark, folder).select("path", text.alias("text")), NFE)


QUERIES = {
    f.__name__: f
    for f in (
        nfe_items_flatten, nfe_items_typed, nfe_tax_by_cst, nfe_top_suppliers, nfe_price_history,
        nfe_decode_labels, nfe_reject_invalid, nfe_keep_valid, cte_flatten, cte_typed, doc_classify,
        doc_types, mixed_split_counts, export_roundtrip, scan_text_roundtrip, scan_text_multiline,
        scan_multiline_split,
        scan_long_rows, preview_rows, named_inputs, normalize_names, infer_column_types, coerce_integer,
        coerce_real, coerce_numeric, coerce_boolean, coerce_date, coerce_datetime, coerce_by_type_map,
        stringify_cells, composite_key, append_dedup, append_dedup_counts, enforce_key, align_schema,
        union_ragged_tables, key_registry_lookup, catalog_report_tables, table_row_counts,
        load_replace_append, load_documents_append, incremental_append, append_typed_dates, append_booleans,
        append_empty_batch, load_named_sheets, coerce_date_dmy, coerce_time, xml_folder_encodings,
        load_documents_replayed, freight_invoice_links, xml_folder_load, xml_landing, xml_batch_split, xml_entities, xml_repeated_elements,
        append_key_index, replace_two_tables, landing_replayed, infer_incremental,
    )
}
