"""Fiscal documents written from order tables: the XML inputs of queries, tests and benchmarks.

Each order becomes an NFe with its line items and a CTe for its transport. Codes and tax groups
vary with the keys, so every branch of the flattening has rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.operators.skew import BLOCK, MIN_ROWS, SALT, bounded_blocks, heavy_keys, replicated

# The official layout allows at most 990 items per document; larger orders become several.
ITEMS_PER_DOCUMENT = 990
NAMESPACE = "http://www.portalfiscal.inf.br/"
# Rows that one task makes into documents. Their text is many times as large as the rows that are shuffled, by which
# adaptive execution would put hundreds of megabytes of it into one task and leave cores without any.
ROWS_PER_TASK = 20_000
ITEM_FIELDS = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus",
)
# What is written of an item, and from what: numbers become decimals once, before the elements are made.
WRITTEN = {
    "l_linenumber": "l_linenumber", "l_partkey": "l_partkey", "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus",
    "quantity": "CAST(l_quantity AS DECIMAL(18,4))", "price": "CAST(l_extendedprice AS DECIMAL(18,2))",
    "discount": "CAST(l_discount AS DECIMAL(9,4))", "tax": "CAST(l_tax AS DECIMAL(9,4))",
}


def _sql_text(sql: str) -> str:
    return f"CAST({sql} AS STRING)"


def _sql_padded(sql: str, width: int) -> str:
    return f"lpad({_sql_text(sql)}, {width}, '0')"


def _sql_share(amount: str, rate: str) -> str:
    return _sql_text(f"CAST({amount} * CAST({rate} AS DECIMAL(9,4)) AS DECIMAL(18,2))")


def _sql_stamp(day: str) -> str:
    return f"concat({_sql_text(f'CAST({day} AS DATE)')}, 'T12:00:00-03:00')"


def _escaped(name: str) -> str:
    """Text of a table as it stands in XML."""
    text = f"replace(replace({name}, '&', '&amp;'), '<', '&lt;')"
    text = f"replace(regexp_replace({text}, '(^|\\\\])>', '$1&gt;'), '\\r', '&#xd;')"
    return f"CASE WHEN {name} RLIKE '[&<>\\r]' THEN {text} ELSE {name} END"


@dataclass(frozen=True)
class Group:
    """An element that is there only where the SQL condition holds."""

    condition: str
    inside: dict


def _element(name: str, inside: str | dict | Group, attribute: str = "") -> str:
    """SQL for the text of an element: a leaf from SQL for its text, or a group. A leaf without text, and a group whose
    condition does not hold, are NULL. ``attribute`` is SQL for the text behind the name. A repeated element has ``#`` and a number.

    The text is put together here, because ``to_xml`` would make rows of all elements first and write them one by one.
    """
    name = name.partition("#")[0]
    if isinstance(inside, Group):
        return f"CASE WHEN {inside.condition} THEN {_element(name, inside.inside)} END"
    opening = f"'<{name}', {attribute}, '>'" if attribute else f"'<{name}>'"
    if isinstance(inside, str):
        return f"concat({opening}, {inside}, '</{name}>')"
    whole = f"concat_ws('', {opening}, {', '.join(_element(n, x) for n, x in inside.items())}, '</{name}>')"
    if attribute or any(isinstance(x, str) and x.startswith("'") for x in inside.values()):
        return whole
    return f"replace({whole}, '<{name}></{name}>', '<{name}/>')"


def _items(broken: str) -> str:
    """SQL for the ``det`` elements of the rows in ``items``."""
    orig = {"orig": _sql_text("l_linenumber % 3")}
    normal = {"vBC": _sql_text("price"), "pICMS": _sql_text("tax"), "vICMS": _sql_share("price", "tax")}
    reduced = {"pRedBC": _sql_text("discount")}
    share = lambda rate: _sql_share("price", rate)
    substituted = {"pMVAST": "'40.0000'", "vBCST": share("1.4"), "pICMSST": "'18.0000'", "vICMSST": share("0.252")}
    retained = {"vBCSTRet": _sql_text("price"), "pST": "'18.0000'", "vICMSSTRet": share("0.18")}
    per_unit = {"qBCMonoRet": _sql_text("quantity"), "adRemICMSRet": "'1.2500'", "vICMSMonoRet": share("0.03")}
    deferred = {"pDif": "'33.3300'", "vICMSDif": share("0.01")}
    by_flag = "l_linenumber NOT IN (4, 5, 6, 7) AND l_returnflag"
    icms = {
        "ICMS00": Group(f"{by_flag} = 'A'", orig | {"CST": "'00'"} | normal),
        "ICMS20": Group(f"{by_flag} = 'N'", orig | {"CST": "'20'"} | reduced | normal),
        "ICMS51": Group(f"{by_flag} = 'R'", orig | {"CST": "'51'"} | deferred | normal),
        "ICMS60": Group("l_linenumber = 6", orig | {"CST": "'60'"} | retained),
        "ICMS61": Group("l_linenumber = 5", orig | {"CST": "'61'"} | per_unit),
        "ICMS70": Group("l_linenumber = 4", orig | {"CST": "'70'"} | reduced | normal | substituted),
        "ICMSSN101": Group("l_linenumber = 7", orig | {"CSOSN": "'101'"}),
    }
    taxed = {"CST": "'50'", "vBC": _sql_text("price"), "pIPI": "'5.0000'", "vIPI": share("0.05")}
    ipi = {"IPITrib": Group("l_linestatus = 'F'", taxed), "IPINT": Group("l_linestatus <> 'F'", {"CST": "'53'"})}

    def contribution(name: str, percent: str, rate: str) -> dict:
        amount = {"vBC": _sql_text("price"), f"p{name}": f"'{percent}'", f"v{name}": share(rate)}
        high, status = "discount >= 0.05", "l_linestatus"
        return {
            f"{name}Aliq": Group(high, {"CST": "'01'"} | amount),
            f"{name}Outr": Group(f"NOT ({high}) AND {status} = 'F'", {"CST": "'99'"} | amount),
            f"{name}NT": Group(f"NOT ({high}) AND {status} <> 'F'", {"CST": "'07'"}),
        }

    product = {
        "cProd": _sql_text("l_partkey"),
        "xProd": f"concat('Item ', {_sql_text('l_partkey')})",
        "NCM": _sql_padded("l_partkey % 20", 8),
        "CFOP": "CASE WHEN l_returnflag = 'R' THEN '5202' ELSE '5102' END",
        "uCom": "'UN'",
        "qCom": _sql_text("quantity"),
        "vUnCom": _sql_text("CAST(price AS DECIMAL(21,10))"),
        "vProd": _sql_text("price"),
        "CEST": f"CASE WHEN l_partkey % 5 = 0 THEN {_sql_padded('l_partkey % 100', 7)} END",
    }
    taxes = {
        "ICMS": icms,
        "IPI": Group("l_linenumber <> 1", ipi),
        "PIS": contribution("PIS", "1.6500", "0.0165"),
        "COFINS": contribution("COFINS", "7.6000", "0.076"),
    }
    number = f"CASE WHEN {broken} = 3 THEN 'x' ELSE {_sql_text('l_linenumber')} END"
    item = _element("det", {"prod": product, "imposto": Group(f"coalesce({broken} <> 2, true)", taxes)}, f"""concat(' nItem="', {number}, '"')""")
    fields = "|".join(WRITTEN)
    return f"array_join(transform(items, i -> {re.sub(rf'\b({fields})\b', r'i.\1', item)}), '')"


def _broken(broken_every: int | None) -> str:
    """SQL for which of four ways a document is broken; NULL for a sound one."""
    if broken_every is None:
        return "CAST(NULL AS INT)"
    every = int(broken_every)
    return f"CASE WHEN l_orderkey % {every} = 0 THEN CAST((l_orderkey DIV {every}) % 4 AS INT) END"


def _tasks(rows: DataFrame) -> int:
    return rows.count() // ROWS_PER_TASK + 1


def nfe_documents(
    lineitem: DataFrame,
    orders: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    *,
    broken_every: int | None = None,
    min_rows: int = MIN_ROWS,
    items_per_document: int = ITEMS_PER_DOCUMENT,
) -> DataFrame:
    """One NFe ``(path, text)`` per order with items, in parts of ``items_per_document`` items.

    The items are shuffled by order key and salt; numbering, grouping and the join with the order's header all reuse
    that partitioning. No group is collected beyond the item limit. Items are sorted, collected, joined and dealt to a
    number of tasks as they come; their elements, thirty times as wide, are made last.
    """
    key = ["l_orderkey"]
    heavy = heavy_keys(lineitem, key, min_rows)
    blocks = bounded_blocks(lineitem.select(*key, *ITEM_FIELDS), key, items_per_document, ITEM_FIELDS, heavy=heavy)
    grouped = blocks.groupBy("l_orderkey", SALT, BLOCK).agg(
        F.collect_list(F.struct(*[F.expr(sql).alias(name) for name, sql in WRITTEN.items()])).alias("items")
    )

    # Customers and suppliers have one row per key. A heavy one sits on the order side of a plain
    # exchange, which adaptive execution splits.
    seller = lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    header = (
        seller.join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
        .join(customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
        .join(supplier, "s_suppkey")
        .select(
            "l_orderkey", "o_orderdate", "o_custkey", "c_name", "c_nationkey", "s_suppkey", "s_name", "s_nationkey"
        )
    )
    order = grouped.join(replicated(header, key, heavy), ["l_orderkey", SALT])
    order = order.repartition(_tasks(lineitem), "l_orderkey", SALT, BLOCK)

    broken = _broken(broken_every)
    ide = {
        "natOp": "'Venda'",
        "serie": "'1'",
        "nNF": _sql_text("l_orderkey"),
        "dhEmi": _sql_stamp("o_orderdate"),
        "tpNF": _sql_text("l_orderkey % 3"),
        "idDest": _sql_text("1 + l_orderkey % 4"),
    }
    for n in (1, 2):
        ide |= {f"NFref#{n}": Group("l_orderkey % 10 = 0", {"refNFe": _sql_padded(f"l_orderkey + {n}", 44)})}
    emit = {
        "CNPJ": _sql_padded("s_suppkey", 14),
        "xNome": _escaped("s_name"),
        "enderEmit": {"UF": _sql_padded("s_nationkey", 2)},
        "IE": f"concat('IE', {_sql_text('s_suppkey')})",
        "IEST": f"CASE WHEN s_suppkey % 3 = 0 THEN concat('ST', {_sql_text('s_suppkey')}) END",
        "IM": f"CASE WHEN s_suppkey % 2 = 0 THEN concat('IM', {_sql_text('s_suppkey')}) END",
        "CRT": _sql_text("1 + l_orderkey % 3"),
    }
    dest = {
        "CNPJ": _sql_padded("o_custkey", 14),
        "xNome": _escaped("c_name"),
        "enderDest": {"UF": _sql_padded("c_nationkey", 2)},
        "IE": f"concat('IE', {_sql_text('o_custkey')})",
    }
    written = order.selectExpr(
        f"concat_ws('/', 'nfe', l_orderkey, {SALT}, {BLOCK}) AS path",
        f"""concat_ws('', '<nfeProc><NFe xmlns="{NAMESPACE}nfe"><infNFe Id="NFe', {_sql_padded("l_orderkey", 44)}, '">',
            CASE WHEN coalesce({broken} <> 1, true) THEN {_element("ide", ide)} END, {_element("emit", emit)}, {_element("dest", dest)},
            {_items(broken)}, {_element("transp", {"modFrete": _sql_text("l_orderkey % 6")})},
            '</infNFe></NFe></nfeProc>\\n') AS text""",
        f"{broken} AS broken",
    )
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return written.select("path", F.when(F.col("broken") == 0, half).otherwise(F.col("text")).alias("text"))


def cte_documents(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One CTe ``(path, text)`` per order; the tax group goes by the key modulo seven."""
    order = orders.join(customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    order = order.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "c_name").repartition(_tasks(orders), "o_orderkey")
    total = "CAST(o_totalprice AS DECIMAL(18,2))"
    normal = {"vBC": _sql_text(total), "pICMS": "'12.0000'", "vICMS": _sql_share(total, "0.1200")}
    other = {f"{name}OutraUF": value for name, value in normal.items()}
    turn = "o_orderkey % 7 ="
    icms = {
        "ICMS00": Group(f"{turn} 0", {"CST": "'00'"} | normal),
        "ICMS20": Group(f"{turn} 1", {"CST": "'20'"} | normal),
        "ICMS45": Group(f"{turn} 2", {"CST": "'45'"}),
        "ICMS60": Group(f"{turn} 3", {"CST": "'60'"} | normal),
        "ICMS90": Group(f"{turn} 4", {"CST": "'90'"} | normal),
        "ICMSSN": Group(f"{turn} 5", {"CST": "'90'", "indSN": _sql_text("(o_orderkey + 1) % 2")}),
        "ICMSOutraUF": Group(f"{turn} 6", {"CST": "'90'"} | other),
    }
    town = lambda n: f"concat('Cidade ', {_sql_text(f'o_orderkey % {n}')})"
    ide = {
        "CFOP": "'6352'",
        "natOp": "'Transporte'",
        "serie": "'1'",
        "nCT": _sql_text("o_orderkey"),
        "dhEmi": _sql_stamp("o_orderdate"),
        "tpCTe": _sql_text("o_orderkey % 4"),
        "tpServ": _sql_text("o_orderkey % 6"),
        "xMunIni": town(27),
        "UFIni": _sql_padded("o_orderkey % 27", 2),
        "xMunFim": town(26),
        "UFFim": _sql_padded("o_orderkey % 26", 2),
        "toma3": Group("o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0", {"toma": _sql_text("o_orderkey % 4")}),
        "toma4": Group("o_orderkey % 11 <> 0 AND o_orderkey % 2 = 1", {"toma": "'4'", "CNPJ": _sql_padded("o_custkey", 14)}),
    }

    def party(number: str, name: str) -> dict:
        return {"CNPJ": _sql_padded(number, 14), "IE": f"concat('IE', {_sql_text(number)})", "xNome": name}

    links = {"infNFe#0": {"chave": _sql_padded("o_orderkey", 44)}, "infNFe#1": {"chave": _sql_padded("o_orderkey + 1", 44)}}
    body = {
        "ide": ide,
        "emit": party("o_orderkey % 100", f"concat('Transportadora ', {_sql_text('o_orderkey % 100')})"),
        "rem": party("o_custkey", _escaped("c_name")),
        "dest": party("o_custkey + 1", f"concat('Dest ', {_sql_text('o_custkey + 1')})"),
        "vPrest": {"vTPrest": _sql_text(total)},
        "imp": Group("o_orderkey % 13 <> 0", {"ICMS": icms}),
        "infCTeNorm": {
            "infDoc": Group("o_orderkey % 3 <> 0", links),
            "infCteSub": Group("o_orderkey % 5 = 0", {"chCte": _sql_padded("o_orderkey + 5", 44)}),
        },
    }
    named = f"""concat(' Id="CTe', {_sql_padded("o_orderkey", 44)}, '"')"""
    text = f"""concat('<cteProc><CTe xmlns="{NAMESPACE}cte">', {_element("infCte", body, named)}, '</CTe></cteProc>\\n')"""
    return order.selectExpr("concat_ws('/', 'cte', o_orderkey) AS path", f"{text} AS text")


def mixed_documents(orders: DataFrame) -> DataFrame:
    """One small document per order under eight kinds of root, to tell the types apart."""
    k = F.col("o_orderkey")
    # Opening and closing text by the key modulo eight.
    kinds = [
        ('<?xml version="1.0" encoding="UTF-8"?><nfeProc><NFe>', "</NFe></nfeProc>"),
        ("<NFe>", "</NFe>"),
        ('<n:enviNFe xmlns:n="urn:x">', "</n:enviNFe>"),
        ("<procEventoNFe>", "</procEventoNFe>"),
        ("<!-- <NFe> --><cteProc>", "</cteProc>"),
        ("\n<CTe>", "</CTe>"),
        ('<!DOCTYPE retorno><NFe:retorno xmlns:NFe="urn:x">', "</NFe:retorno>"),
        ("<nfe>", "</nfe>"),
    ]
    text = None
    for turn, (opening, closing) in enumerate(kinds):
        whole = F.concat(F.lit(f"{opening}<v>"), k.cast("string"), F.lit(f"</v>{closing}"))
        text = F.when(k % 8 == turn, whole) if text is None else text.when(k % 8 == turn, whole)
    return orders.select(F.concat_ws("/", F.lit("doc"), "o_orderkey").alias("path"), text.alias("text"))
