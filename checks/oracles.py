"""ANSI SQL for DuckDB: what each query must return, written from the tables alone."""

from __future__ import annotations

from lastro.functions import codes

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def label(expression: str, table: dict[str, str]) -> str:
    """A CASE over a code table, unknown codes unchanged."""
    whens = " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in table.items())
    return f"CASE {expression} {whens} ELSE {expression} END"


# --- NFe ----------------------------------------------------------------------------------------

PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
TAX = "CAST(l_tax AS DECIMAL(9,4))"
DISCOUNT = "CAST(l_discount AS DECIMAL(9,4))"


def share(rate: str) -> str:
    rate = rate if rate.startswith("CAST") else f"CAST({rate} AS DECIMAL(9,4))"
    return f"CAST(CAST({PRICE} * {rate} AS DECIMAL(18,2)) AS VARCHAR)"


BASE = f"""
WITH seller AS (SELECT l_orderkey AS k, min(l_suppkey) AS s_suppkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
head AS (
  SELECT k, n, o_orderdate, o_custkey, c_name, c_nationkey, s.s_suppkey, s_name, s_nationkey
  FROM seller JOIN orders ON o_orderkey = k
  JOIN customer ON c_custkey = o_custkey JOIN supplier s ON s.s_suppkey = seller.s_suppkey
),
item AS (
  SELECT h.*, l.*, {PRICE} AS price, l_linenumber IN (4,5,6,7) AS special,
    l_linenumber <> 1 AS has_ipi, {DISCOUNT} >= 0.05 AS high
  FROM lineitem l JOIN head h ON k = l_orderkey
)
"""

NORMAL = "(NOT special OR l_linenumber = 4)"
TAXED = "has_ipi AND l_linestatus = 'F'"
PAID = "(high OR l_linestatus = 'F')"


def when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


CST = (
    "CASE WHEN l_linenumber = 4 THEN '70' WHEN l_linenumber = 5 THEN '61' WHEN l_linenumber = 6 THEN '60' "
    "WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN '00' WHEN l_returnflag = 'N' THEN '20' "
    "WHEN l_returnflag = 'R' THEN '51' END"
)
KNOWN = f"({CST}) IS NOT NULL"
TEXT_PRICE = "CAST(price AS VARCHAR)"
CONTRIBUTION = "CASE WHEN high THEN '01' WHEN l_linestatus = 'F' THEN '99' ELSE '07' END"

# Column, SQL, and the type of the typed view.
NFE_COLUMNS = [
    ("Natureza_da_Operacao", "'Venda'", None),
    ("Serie", "'1'", None),
    ("No_NF", "CAST(k AS VARCHAR)", None),
    ("Data", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "DATE"),
    ("Tipo_de_NF", label("CAST(k % 3 AS VARCHAR)", codes.INVOICE_DIRECTION), None),
    ("Local_Operacao", label("CAST(1 + k % 4 AS VARCHAR)", codes.OPERATION_SCOPE), None),
    ("NF_Ref", when("k % 10 = 0", "lpad(CAST(k + 1 AS VARCHAR), 44, '0')"), None),
    ("CNPJ_Emitente", "lpad(CAST(s_suppkey AS VARCHAR), 14, '0')", None),
    ("Emitente", "s_name", None),
    ("UF_Emitente", "lpad(CAST(s_nationkey AS VARCHAR), 2, '0')", None),
    ("IE_Emitente", "'IE' || s_suppkey", None),
    ("Insc_Municipal_Emitente", when("s_suppkey % 2 = 0", "'IM' || s_suppkey"), None),
    ("IE_Substituta_Emitente", when("s_suppkey % 3 = 0", "'ST' || s_suppkey"), None),
    ("Regime_Tributario", label("CAST(1 + k % 3 AS VARCHAR)", codes.TAX_REGIME), None),
    ("CNPJ_Destinatario", "lpad(CAST(o_custkey AS VARCHAR), 14, '0')", None),
    ("Nome_destinatario", "c_name", None),
    ("UF_Destinatario", "lpad(CAST(c_nationkey AS VARCHAR), 2, '0')", None),
    ("IE_destinatario", "'IE' || o_custkey", None),
    ("No_Item", "CASE WHEN l_linenumber < 10 THEN '0' || l_linenumber ELSE CAST(l_linenumber AS VARCHAR) END", "INTEGER"),
    ("Codigo_produto", "CAST(l_partkey AS VARCHAR)", None),
    ("Descricao_produto", "'Item ' || l_partkey", None),
    ("NCM", "lpad(CAST(l_partkey % 20 AS VARCHAR), 8, '0')", None),
    ("CFOP", "CASE WHEN l_returnflag = 'R' THEN '5202' ELSE '5102' END", None),
    ("Unid_medida", "'UN'", None),
    ("Quantidade", "CAST(CAST(l_quantity AS DECIMAL(18,4)) AS VARCHAR)", "DECIMAL(18,4)"),
    ("Vlr_Unitario", "CAST(CAST(price AS DECIMAL(21,10)) AS VARCHAR)", "DECIMAL(21,10)"),
    ("Vlr_Produto", TEXT_PRICE, "DECIMAL(18,2)"),
    ("CEST", when("l_partkey % 5 = 0", "lpad(CAST(l_partkey % 100 AS VARCHAR), 7, '0')"), None),
    ("Origem", when(KNOWN, "CAST(l_linenumber % 3 AS VARCHAR)"), None),
    ("CST_ICMS", CST, None),
    ("Red_BC_ICMS", when(f"({CST}) IN ('20', '70')", f"CAST({DISCOUNT} AS VARCHAR)"), "DECIMAL(9,4)"),
    ("BC_ICMS", when(NORMAL, TEXT_PRICE), "DECIMAL(18,2)"),
    ("Aliq_ICMS", when(NORMAL, f"CAST({TAX} AS VARCHAR)"), "DECIMAL(9,4)"),
    ("Vlr_ICMS", when(NORMAL, share(TAX)), "DECIMAL(18,2)"),
    ("MVA_ICMS", when("l_linenumber = 4", "'40.0000'"), "DECIMAL(9,4)"),
    ("BC_ICMS_ST", when("l_linenumber = 4", share("1.4")), "DECIMAL(18,2)"),
    ("Aliq_ST_ICMS", when("l_linenumber = 4", "'18.0000'"), "DECIMAL(9,4)"),
    ("Vlr_ICMS_ST", when("l_linenumber = 4", share("0.252")), "DECIMAL(18,2)"),
    ("Parte_Diferida_ICMS", when(f"({CST}) = '51'", "'33.3300'"), "DECIMAL(9,4)"),
    ("Vlr_ICMS_Dif", when(f"({CST}) = '51'", share("0.01")), "DECIMAL(18,2)"),
    ("BC_ICMS_Monofasico", when("l_linenumber = 5", "CAST(CAST(l_quantity AS DECIMAL(18,4)) AS VARCHAR)"), "DECIMAL(18,4)"),
    ("Aliq_AdRem", when("l_linenumber = 5", "'1.2500'"), "DECIMAL(9,4)"),
    ("Vlr_ICMS_Monofasico", when("l_linenumber = 5", share("0.03")), "DECIMAL(18,2)"),
    ("BC_ICMS_Retido", when("l_linenumber = 6", TEXT_PRICE), "DECIMAL(18,2)"),
    ("Aliq_ICMS_Retido", when("l_linenumber = 6", "'18.0000'"), "DECIMAL(9,4)"),
    ("Vlr_ICMS_Retido", when("l_linenumber = 6", share("0.18")), "DECIMAL(18,2)"),
    ("CST_IPI", when("has_ipi", "CASE WHEN l_linestatus = 'F' THEN '50' ELSE '53' END"), None),
    ("BC_IPI", when(TAXED, TEXT_PRICE), "DECIMAL(18,2)"),
    ("Aliq_IPI", when(TAXED, "'5.0000'"), "DECIMAL(9,4)"),
    ("Vlr_IPI", when(TAXED, share("0.05")), "DECIMAL(18,2)"),
    ("CST_Pis", CONTRIBUTION, None),
    ("BC_Pis", when(PAID, TEXT_PRICE), "DECIMAL(18,2)"),
    ("Aliq_Pis", when(PAID, "'1.6500'"), "DECIMAL(9,4)"),
    ("Vlr_Pis", when(PAID, share("0.0165")), "DECIMAL(18,2)"),
    ("CST_Cofins", CONTRIBUTION, None),
    ("BC_Cofins", when(PAID, TEXT_PRICE), "DECIMAL(18,2)"),
    ("Aliq_Cofins", when(PAID, "'7.6000'"), "DECIMAL(9,4)"),
    ("Vlr_Cofins", when(PAID, share("0.076")), "DECIMAL(18,2)"),
    ("Modalidade_Frete", label("CAST(k % 6 AS VARCHAR)", codes.FREIGHT_MODE), None),
    ("Chave_NFe", "lpad(CAST(k AS VARCHAR), 44, '0')", None),
]
NFE = {name: sql for name, sql, _ in NFE_COLUMNS}


def select(columns, typed: bool = False) -> str:
    return ",\n  ".join(
        f'CAST({sql} AS {kind}) AS "{name}"' if typed and kind else f'{sql} AS "{name}"' for name, sql, kind in columns
    )


_DECODED = ("Tipo_de_NF", "Local_Operacao", "Regime_Tributario", "Modalidade_Frete")
_KIND = "CAST(floor(k / 97.0) AS BIGINT) % 4"

# --- CTe ----------------------------------------------------------------------------------------

TOTAL = "CAST(o_totalprice AS DECIMAL(18,2))"
TAX_BLOCK = "k % 13 <> 0"
CTE_BASE = "WITH o AS (SELECT o_orderkey AS k, * FROM orders JOIN customer ON c_custkey = o_custkey)\n"
CTE_NORMAL = f"{TAX_BLOCK} AND k % 7 IN (0, 1, 3, 4, 6)"
CTE_COLUMNS = [
    ("CFOP", "'6352'", None),
    ("NAT_Operacao", "'Transporte'", None),
    ("Serie", "'1'", None),
    ("Numero_CTE", "CAST(k AS VARCHAR)", None),
    ("Data_Emissao", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "DATE"),
    ("Tipo_CTE", label("CAST(k % 4 AS VARCHAR)", codes.FREIGHT_DOCUMENT_TYPE), None),
    ("Tipo_do_servico", label("CAST(k % 6 AS VARCHAR)", codes.FREIGHT_SERVICE), None),
    ("Mun_Inicio", "'Cidade ' || (k % 27)", None),
    ("UF_Inicio", "lpad(CAST(k % 27 AS VARCHAR), 2, '0')", None),
    ("Mun_Fim", "'Cidade ' || (k % 26)", None),
    ("UF_Fim", "lpad(CAST(k % 26 AS VARCHAR), 2, '0')", None),
    (
        "Tomador",
        "CASE WHEN k % 11 = 0 THEN NULL WHEN k % 2 = 0 THEN CAST(k % 4 AS VARCHAR) "
        "ELSE lpad(CAST(o_custkey AS VARCHAR), 14, '0') END",
        None,
    ),
    ("CNPJ_emit", "lpad(CAST(k % 100 AS VARCHAR), 14, '0')", None),
    ("IE_emit", "'IE' || (k % 100)", None),
    ("Emitente", "'Transportadora ' || (k % 100)", None),
    ("CNPJ_rem", "lpad(CAST(o_custkey AS VARCHAR), 14, '0')", None),
    ("IE_rem", "'IE' || o_custkey", None),
    ("Remetente", "c_name", None),
    ("CNPJ_dest", "lpad(CAST(o_custkey + 1 AS VARCHAR), 14, '0')", None),
    ("IE_dest", "'IE' || (o_custkey + 1)", None),
    ("Destinatario", "'Dest ' || (o_custkey + 1)", None),
    ("VLR_Servico", f"CAST({TOTAL} AS VARCHAR)", "DECIMAL(18,2)"),
    ("Optante_SN", when(TAX_BLOCK, "CASE WHEN k % 7 = 5 AND (k + 1) % 2 = 1 THEN 'Sim' ELSE 'Não' END"), None),
    (
        "CST",
        when(
            TAX_BLOCK,
            "CASE k % 7 WHEN 0 THEN '00' WHEN 1 THEN '20' WHEN 2 THEN '45' WHEN 3 THEN '60' ELSE '90' END",
        ),
        None,
    ),
    ("BC_ICMS", when(CTE_NORMAL, f"CAST({TOTAL} AS VARCHAR)"), "DECIMAL(18,2)"),
    ("Aliq_ICMS", when(CTE_NORMAL, "'12.0000'"), "DECIMAL(9,4)"),
    (
        "Vlr_ICMS",
        f"CASE WHEN {CTE_NORMAL} THEN CAST(CAST({TOTAL} * CAST(0.12 AS DECIMAL(9,4)) AS DECIMAL(18,2)) AS VARCHAR) "
        f"WHEN {TAX_BLOCK} THEN '0' END",
        "DECIMAL(18,2)",
    ),
    ("NF_ref", when("k % 3 <> 0", "lpad(CAST(k AS VARCHAR), 44, '0')"), None),
    ("Chave_CTe_Subs", when("k % 5 = 0", "lpad(CAST(k + 5 AS VARCHAR), 44, '0')"), None),
    ("Chave_CTE", "lpad(CAST(k AS VARCHAR), 44, '0')", None),
]
CTE = {name: sql for name, sql, _ in CTE_COLUMNS}

# --- text ---------------------------------------------------------------------------------------

NUMBER = (
    r"^\s*[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|"
    r"[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])\s*$"
)
TOKENS = "('true', 'false', '1', '0', 'sim', 'não', 'yes', 'no')"
CLOCK_TAIL = r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?"
YMD = rf"^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}{CLOCK_TAIL}$"
SLASHED = rf"^[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{4}}{CLOCK_TAIL}$"
ONLY_CLOCK = r"^[0-9]{2}:[0-9]{2}(:[0-9]{2})?$"


def matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern}')"


def inferred(name: str) -> str:
    v = "v"
    dates = {
        "ymd": f"{matches(v, YMD)} AND try_cast(replace(v, '/', '-') AS TIMESTAMP) IS NOT NULL",
        "mdy": f"{matches(v, SLASHED)} AND try_strptime(substr(v, 1, 10), '%m/%d/%Y') IS NOT NULL",
        "dmy": f"{matches(v, SLASHED)} AND try_strptime(substr(v, 1, 10), '%d/%m/%Y') IS NOT NULL",
        "clock": matches(v, ONLY_CLOCK),
    }
    facts = ", ".join(f"bool_and({sql}) AS {f}" for f, sql in dates.items())
    date_format = "CASE " + " ".join(f"WHEN {f} THEN '{f}'" for f in dates) + " END"
    identifier = f"{matches(v, '^[0-9]+$')} AND ((v LIKE '0%' AND length(v) > 1) OR length(v) > 18)"
    return f"""
SELECT '{name}' AS column_name, declared_type,
  CASE WHEN declared_type IN ('DATE', 'DATETIME') THEN fmt END AS date_format
FROM (SELECT *, {date_format} AS fmt,
    CASE WHEN filled = 0 THEN 'TEXT'
      WHEN numbers AND NOT identifiers AND digits THEN 'INTEGER'
      WHEN numbers AND NOT identifiers THEN 'REAL'
      WHEN {date_format} IS NOT NULL THEN CASE WHEN clock_seen THEN 'DATETIME' ELSE 'DATE' END
      WHEN tokens AND spellings = 2 THEN 'BOOLEAN' ELSE 'TEXT' END AS declared_type
  FROM (SELECT count(v) AS filled, bool_and({matches(v, NUMBER)}) AS numbers,
      bool_and({matches(v, '^[0-9]+$')}) AS digits, bool_or({identifier}) AS identifiers, {facts},
      bool_or({matches(v, '[0-9]{2}:[0-9]{2}')}) AS clock_seen,
      bool_and(lower(v) IN {TOKENS}) AS tokens, count(DISTINCT v) AS spellings
    FROM (SELECT CASE WHEN trim("{name}") <> '' THEN "{name}" END AS v FROM untyped)))"""


UNTYPED = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)",
    "o_custkey": "CAST(o_custkey AS VARCHAR)",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": "CAST(o_totalprice AS VARCHAR)",
    "o_orderdate": "CAST(o_orderdate AS VARCHAR)",
    "o_orderpriority": "o_orderpriority",
    "paid": "CASE WHEN o_orderkey % 2 = 0 THEN 'Sim' ELSE 'Não' END",
    "flag": "CAST(o_orderkey % 2 AS VARCHAR)",
    "code": "lpad(CAST(o_orderkey AS VARCHAR), 8, '0')",
    "long_id": "lpad(CAST(o_orderkey + 1 AS VARCHAR), 44, '7')",
    "signed": "CAST(-o_orderkey - 1 AS VARCHAR)",
    "with_blanks": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END",
    "blank": "' '",
    "day": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
    "day_br": "strftime(o_orderdate, '%d/%m/%Y')",
    "day_mixed": "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') "
    "ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END",
    "clock": "'14:30'",
    "three": "CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'YES' END",
}

RAW = """
WITH raw AS (
  SELECT l_orderkey, l_linenumber,
    CASE l_linenumber % 7
      WHEN 0 THEN CAST(CAST(l_quantity AS DECIMAL(18,1)) AS VARCHAR)
      WHEN 1 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
      WHEN 2 THEN 'x' || l_partkey WHEN 3 THEN '' WHEN 4 THEN ' ' || l_partkey || ' '
      WHEN 5 THEN l_partkey || 'e2' ELSE l_partkey || 'd' END AS number,
    CASE l_linenumber % 7 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'não' WHEN 2 THEN 'Sim' WHEN 3 THEN ''
      WHEN 4 THEN '0' WHEN 5 THEN ' no ' ELSE 'talvez' END AS token,
    CASE l_linenumber % 7 WHEN 3 THEN '' WHEN 4 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || ' 10:30:00'
      WHEN 5 THEN replace(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), '-', '/') WHEN 6 THEN '2024-02-30'
      ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS "date"
  FROM lineitem)
"""
IS_NUMBER = matches("number", NUMBER)


def value(source: str, sql: str) -> str:
    return f'{RAW}SELECT l_orderkey, l_linenumber, "{source}", {sql} AS value FROM raw'


ITEM = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_orderkey || '|' || l_linenumber AS _PK FROM lineitem"


def counts(names=TABLES) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in names)


# The columns of the test tables, as the catalog report lists them.
COLUMNS = {
    "region": "r_regionkey (int), r_name (string)",
    "nation": "n_nationkey (int), n_name (string), n_regionkey (int)",
    "customer": "c_custkey (bigint), c_name (string), c_nationkey (int), c_acctbal (double), c_mktsegment (string)",
    "supplier": "s_suppkey (bigint), s_name (string), s_nationkey (int), s_acctbal (double)",
    "part": "p_partkey (bigint), p_name (string), p_brand (string), p_type (string), p_size (int), p_retailprice (double)",
    "orders": "o_orderkey (bigint), o_custkey (bigint), o_orderstatus (string), o_totalprice (double), "
    "o_orderdate (timestamp_ntz), o_orderpriority (string)",
    "lineitem": "l_orderkey (bigint), l_partkey (bigint), l_suppkey (bigint), l_linenumber (int), l_quantity (double), "
    "l_extendedprice (double), l_discount (double), l_tax (double), l_returnflag (string), l_linestatus (string), "
    "l_shipdate (timestamp_ntz)",
    "events": "event_id (bigint), ts (timestamp_ntz), user_id (bigint), event_type (string), value (double), props (string)",
    "documents": "doc_id (bigint), text (string), lang (string), source (string), n_chars (bigint)",
    "embeddings": "vec_id (bigint), embedding (array<float>), label (int)",
    "pages": "page_id (bigint), url (string), html (string)",
    "benchmark": "item_id (bigint), text (string)",
    "labels": "doc_id (bigint), quality (int), toxic (int)",
    "conversations": "conv_id (bigint), turn (bigint), role (string), text (string)",
}


def report() -> str:
    rows = []
    for name, columns in COLUMNS.items():
        keys = "'l_orderkey + l_linenumber'" if name == "lineitem" else "NULL"
        rows.append(
            f"SELECT '{name}' AS table_name, '{columns}' AS columns, {columns.count('(')} AS n_columns, "
            f"false AS has_key_column, {keys} AS key_columns, count(*) AS n_rows FROM {name}"
        )
    return " UNION ALL ".join(rows)


ORACLES = {
    "nfe_items_flatten": f"{BASE}SELECT {select(NFE_COLUMNS)} FROM item",
    "nfe_items_typed": f"{BASE}SELECT {select(NFE_COLUMNS, typed=True)} FROM item",
    "nfe_tax_by_cst": f"{BASE}, t AS (SELECT {CST} AS CST_ICMS, CAST({NFE['Vlr_ICMS']} AS DECIMAL(18,2)) AS v FROM item) "
    "SELECT CST_ICMS, sum(v) AS total_icms FROM t WHERE CST_ICMS IS NOT NULL GROUP BY CST_ICMS",
    "nfe_top_suppliers": f"{BASE}SELECT s_name AS Emitente, sum(price) AS total_purchases FROM item WHERE k % 3 = 0 "
    "GROUP BY s_name ORDER BY total_purchases DESC, Emitente LIMIT 10",
    "nfe_price_history": f"{BASE}SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS Data, "
    "CAST(round(sum(CAST(price AS DECIMAL(21,10))) / count(*), 4) AS DECIMAL(18,4)) AS mean_price "
    "FROM item WHERE l_partkey % 20 = 7 GROUP BY 1",
    "nfe_decode_labels": f"{BASE}SELECT {', '.join(f'{NFE[c]} AS {c}' for c in _DECODED)}, count(*) AS n_items "
    "FROM item GROUP BY 1, 2, 3, 4",
    "nfe_reject_invalid": f"{BASE}, b AS (SELECT {_KIND} AS kind, ceil(n / 990.0) AS parts FROM head WHERE k % 97 = 0) "
    "SELECT 'NFe' AS doc_type, CASE kind WHEN 0 THEN 'malformed' WHEN 1 THEN 'no ide' "
    "WHEN 2 THEN 'item without imposto' ELSE 'bad item number' END AS reason, CAST(sum(parts) AS BIGINT) AS n_documents "
    "FROM b GROUP BY kind",
    "nfe_keep_valid": f"{BASE}SELECT {NFE['Chave_NFe']} AS Chave_NFe, {NFE['No_Item']} AS No_Item, "
    "CAST(l_partkey AS VARCHAR) AS Codigo_produto FROM item WHERE k % 97 <> 0",
    "cte_flatten": f"{CTE_BASE}SELECT {select(CTE_COLUMNS)} FROM o",
    "cte_typed": f"{CTE_BASE}SELECT {select(CTE_COLUMNS, typed=True)} FROM o",
    "doc_classify": "SELECT CASE WHEN o_orderkey % 8 < 4 THEN 'NFe' WHEN o_orderkey % 8 < 6 THEN 'CTe' ELSE 'other' END "
    "AS doc_type, count(*) AS n_documents FROM orders GROUP BY 1",
    "doc_types": "SELECT 'doc/' || o_orderkey AS path, CASE o_orderkey % 8 WHEN 0 THEN 'nfeProc' WHEN 1 THEN 'NFe' "
    "WHEN 2 THEN 'enviNFe' WHEN 3 THEN 'procEventoNFe' WHEN 4 THEN 'cteProc' WHEN 5 THEN 'CTe' WHEN 6 THEN 'retorno' "
    "ELSE 'nfe' END AS root, CASE WHEN o_orderkey % 8 < 4 THEN 'NFe' WHEN o_orderkey % 8 < 6 THEN 'CTe' END AS doc_type "
    "FROM orders",
    "mixed_split_counts": "SELECT 'NFe' AS table_name, count(*) AS n_rows FROM lineitem JOIN orders ON o_orderkey = l_orderkey "
    "UNION ALL SELECT 'CTe', count(*) FROM orders JOIN customer ON c_custkey = o_custkey",
    "export_roundtrip": f"""{BASE}, o AS (SELECT o_orderkey AS k, * FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'NFe' AS doc_type, {NFE['Chave_NFe']} AS Chave_NFe, {NFE['No_Item']} AS No_Item,
  {NFE['Descricao_produto']} AS Descricao_produto, coalesce({NFE['Vlr_ICMS']}, '') AS Vlr_ICMS,
  NULL AS Chave_CTE, NULL AS Tomador, NULL AS Tipo_do_servico FROM item
UNION ALL SELECT 'CTe', NULL, NULL, NULL, coalesce({CTE['Vlr_ICMS']}, ''), {CTE['Chave_CTE']},
  coalesce({CTE['Tomador']}, ''), {CTE['Tipo_do_servico']} FROM o""",
    "scan_text_roundtrip": "SELECT CAST(o_orderkey AS VARCHAR) AS No_do_Pedido, "
    "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS Prioridade_nivel, "
    "CASE WHEN o_orderkey % 7 = 0 THEN 'NA' ELSE o_orderstatus END AS Situacao, "
    "CASE WHEN o_orderkey % 3 = 0 THEN ' a \"b\", c ' ELSE ' x' END AS _de_Nota, "
    "CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS Data FROM orders",
    "scan_text_multiline": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, lang FROM documents",
    "scan_long_rows": """
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS t FROM orders)
SELECT CAST(k AS VARCHAR) AS a, CASE WHEN t = 1 THEN 'x' WHEN t = 2 THEN 'a, "b"' ELSE 'NA' END AS b,
  CASE WHEN t = 2 THEN 'c' ELSE '' END AS c, NULL AS record, NULL AS reason FROM o WHERE t NOT IN (0, 3)
UNION ALL SELECT NULL, NULL, NULL, CASE WHEN t = 0 THEN k || ',x,y,z' ELSE k || ',"a,b",c,' END,
  'more than 3 cells' FROM o WHERE t IN (0, 3)""",
    "preview_rows": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM "
    "(SELECT * FROM part ORDER BY p_partkey LIMIT 100)",
    "named_inputs": counts(("region", "nation", "customer", "supplier")),
    "normalize_names": "SELECT c_custkey AS \"CodigoCliente\", c_name AS \"Nome_do_Cliente\", c_nationkey AS \"Pais\", "
    "c_acctbal AS \"_de_Saldo\", c_mktsegment AS \"PAIS_2\" FROM customer",
    "infer_column_types": "WITH untyped AS (SELECT "
    + ", ".join(f'{sql} AS "{n}"' for n, sql in UNTYPED.items())
    + " FROM orders)"
    + " UNION ALL ".join(inferred(n) for n in UNTYPED),
    "coerce_integer": value(
        "number",
        f"CASE WHEN {IS_NUMBER} THEN CAST(coalesce(trunc(try_cast(trim(number) AS DOUBLE)), 0) AS BIGINT) ELSE 0 END",
    ),
    "coerce_real": value("number", f"CASE WHEN {IS_NUMBER} THEN try_cast(trim(number) AS DOUBLE) END"),
    "coerce_numeric": value(
        "number", f"CASE WHEN {IS_NUMBER} THEN try_cast(try_cast(trim(number) AS DOUBLE) AS DECIMAL(38,10)) END"
    ),
    "coerce_boolean": value(
        "token",
        "CASE WHEN lower(trim(token)) IN ('true', '1', 'sim', 'yes') THEN 1 "
        "WHEN lower(trim(token)) IN ('false', '0', 'não', 'no') THEN 0 END",
    ),
    "coerce_date": value("date", "CAST(try_cast(replace(\"date\", '/', '-') AS TIMESTAMP) AS DATE)"),
    "coerce_datetime": value("date", "try_cast(replace(\"date\", '/', '-') AS TIMESTAMP)"),
    "coerce_by_type_map": "SELECT p_partkey, CAST(0 AS BIGINT) AS p_name, CAST(p_size AS DOUBLE) AS p_size FROM part",
    "stringify_cells": "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS VARCHAR) AS ts, event_type FROM events",
    "composite_key": "SELECT l_orderkey, l_linenumber, l_quantity, nullif(l_partkey, 7) AS part, l_orderkey || '|' || "
    "coalesce(CAST(nullif(l_partkey, 7) AS VARCHAR), '') || '|' || l_linenumber AS _PK FROM lineitem",
    "append_dedup": f"WITH i AS ({ITEM}) SELECT * FROM i b WHERE (l_orderkey % 2 = 0 OR l_orderkey % 3 <> 0) AND NOT EXISTS "
    "(SELECT 1 FROM i e WHERE e.l_orderkey % 3 = 0 AND e._PK = b._PK)",
    "append_dedup_counts": f"WITH i AS ({ITEM}), b AS (SELECT *, EXISTS (SELECT 1 FROM i e WHERE e.l_orderkey % 3 = 0 "
    "AND e._PK = i._PK) AS known FROM i WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 <> 0) SELECT count(*) AS incoming, "
    "count(*) FILTER (NOT known) AS kept, count(*) FILTER (known) AS skipped FROM b",
    "enforce_key": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    "l_linestatus) AS rn FROM lineitem) WHERE rn = 1",
    "align_schema": "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS c_phone, CAST(c_nationkey AS DOUBLE) AS c_nationkey "
    "FROM customer",
    "union_ragged_tables": "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer "
    "UNION ALL BY NAME SELECT s_name AS name, s_nationkey AS nation FROM supplier",
    "key_registry_lookup": """
WITH log AS (SELECT event_type || '_' || (user_id % 50) AS table_name,
    CASE WHEN event_id % 5 <> 0 THEN 'user,' || (event_id % 9) END AS key_columns,
    row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts DESC) AS age FROM events),
asked AS (SELECT DISTINCT event_type || '_' || (user_id % 60) AS table_name FROM events)
SELECT table_name, key_columns FROM asked LEFT JOIN (SELECT * FROM log WHERE age = 1) l USING (table_name)""",
    "catalog_report_tables": report(),
    "table_row_counts": counts(),
    "load_replace_append": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS o_custkey, "
    "o_orderpriority, _PK FROM (SELECT CAST(o_orderkey AS VARCHAR) AS _PK, * FROM orders)",
    "load_documents_append": "SELECT lpad(CAST(l_orderkey AS VARCHAR), 44, '0') AS _PK, l_linenumber AS No_Item, "
    f"{PRICE} AS Vlr_Produto FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL "
    f"SELECT lpad(CAST(o_orderkey AS VARCHAR), 44, '0'), 0, {TOTAL} FROM orders JOIN customer ON c_custkey = o_custkey",
    "incremental_append": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, "
    "CAST(p_partkey AS VARCHAR) AS _PK FROM part",
}
ORACLES["load_replace_append"] = ORACLES["load_replace_append"].replace(
    "SELECT o_orderkey,", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,", 1
)
ORACLES |= {
    "append_typed_dates": "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_orderdate AS DATE) AS d, "
    "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL '10 hours 30 minutes' AS at, CAST(o_orderkey AS VARCHAR) AS _PK FROM orders",
    "append_booleans": "SELECT CAST(o_orderkey AS VARCHAR) AS k, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS b, "
    "CAST(o_orderkey AS VARCHAR) AS _PK FROM orders",
    "append_empty_batch": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_custkey AS VARCHAR) AS _PK FROM customer",
    "load_named_sheets": "SELECT COLUMNS(*)::VARCHAR, 'Plan_1' AS sheet FROM nation UNION ALL BY NAME SELECT COLUMNS(*)::VARCHAR, 'Acao_v12' AS sheet FROM region",
    "freight_invoice_links": f"WITH t AS (SELECT l_orderkey, sum({PRICE}) AS total_goods FROM lineitem JOIN orders ON o_orderkey = l_orderkey "
    f"GROUP BY l_orderkey) SELECT lpad(CAST(o_orderkey AS VARCHAR), 44, '0') AS Chave_CTE, CASE WHEN o_orderkey % 3 <> 0 THEN "
    f"lpad(CAST(o_orderkey AS VARCHAR), 44, '0') END AS NF_ref, {TOTAL} AS freight, CASE WHEN o_orderkey % 3 <> 0 THEN total_goods END AS total_goods "
    "FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN t ON l_orderkey = o_orderkey",
    "coerce_date_dmy": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders",
    "coerce_time": "SELECT o_orderkey, CASE WHEN o_orderkey % 30 < 24 THEN lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || "
    "lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') END AS t FROM orders",
    "xml_folder_encodings": "SELECT c_custkey, 'Ação ' || c_name AS inside FROM customer",
    "load_documents_replayed": f"{ORACLES['nfe_reject_invalid']} UNION ALL SELECT 'NFe', 'kept', count(*) FROM ({ORACLES['nfe_keep_valid']})",
}

_LOADED = ("Chave_NFe", "No_Item", "Codigo_produto", "CST_ICMS", "Vlr_ICMS")
_RESOLVED = ("Chave_NFe", "No_Item", "Natureza_da_Operacao", "Unid_medida", "Vlr_Produto")
# The same rows by other ways of reading.
ORACLES |= {
    "scan_multiline_split": ORACLES["scan_text_multiline"],
    "xml_batch_split": ORACLES["nfe_items_flatten"],
    "xml_landing": ORACLES["nfe_items_flatten"],
    "xml_repeated_elements": ORACLES["nfe_items_flatten"],
    "xml_folder_load": f"""{BASE}, t AS (SELECT {", ".join(f"{NFE[c]} AS {c}" for c in _LOADED)}, k FROM item WHERE k % 97 <> 0)
SELECT {", ".join(_LOADED)}, NULL AS doc_type, NULL AS reason, NULL AS n_documents FROM t
UNION ALL SELECT {", ".join("NULL" for _ in _LOADED)}, doc_type, reason, n_documents FROM ({ORACLES["nfe_reject_invalid"]})""",
    "xml_entities": f"""{BASE}, t AS (SELECT {", ".join(f"{NFE[c]} AS {c}" for c in _RESOLVED)}, k FROM item WHERE k % 97 > 1)
SELECT {", ".join(_RESOLVED)}, NULL AS doc_type, NULL AS reason, NULL AS n_documents FROM t
UNION ALL SELECT {", ".join("NULL" for _ in _RESOLVED)}, 'NFe', 'malformed', CAST(sum(ceil(n / 990.0)) AS BIGINT) FROM head WHERE k % 97 < 2""",
}
ORACLES |= {
    "append_key_index": ORACLES["append_dedup"].replace("SELECT * FROM i b", "SELECT * FROM i WHERE l_orderkey % 3 = 0 UNION ALL SELECT * FROM i b", 1),
    "replace_two_tables": "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS label, CAST(c_custkey AS VARCHAR) AS _PK FROM customer "
    "UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, CAST(s_suppkey AS VARCHAR) FROM supplier",
    "landing_replayed": "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part "
    "UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, CAST(p_size AS BIGINT) FROM part WHERE p_partkey % 2 = 0",
    "infer_incremental": ORACLES["infer_column_types"],
}
