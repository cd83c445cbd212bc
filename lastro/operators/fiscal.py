"""Fiscal XML: classify documents, parse them once, and flatten them into records.

NFe (goods invoice): one record per item, 60 columns. CTe (freight document): one record per
document, 30 columns. Everything up to the record is a map over documents, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lastro.functions import codes
from lastro.functions.text import date_part, padded_number, without
from lastro.operators.entities import with_entities
from lastro.operators.paths import ITEM, RECORD, Field, Node, at, branch_field, field, first_field, schema_of, text_at, variant_field
from lastro.operators.plain import Kind, of_item, output_schema, read_plain, record_column

# Names of the wanted columns, for all types or by type; None stands for all.
Columns = Sequence[str] | Mapping[str, Sequence[str]] | None

NFE, CTE = "NFe", "CTe"
MONEY, QUANTITY, UNIT_PRICE, RATE, WHOLE, DAY = (
    "decimal(18,2)",
    "decimal(18,4)",
    "decimal(21,10)",
    "decimal(9,4)",
    "int",
    "date",
)

# Tax groups in the order in which the first filled value wins.
NFE_ICMS_GROUPS = ["ICMS00", "ICMS10", "ICMS20", "ICMS30", "ICMS40", "ICMS50", "ICMS51", "ICMS60", "ICMS61", "ICMS70", "ICMS90"]
PIS_GROUPS = ["PISAliq", "PISOutr", "PISNT"]
COFINS_GROUPS = ["COFINSAliq", "COFINSOutr", "COFINSNT"]
CTE_ICMS_GROUPS = ["ICMS00", "ICMS20", "ICMS45", "ICMS60", "ICMS90", "ICMSSN", "ICMSOutraUF"]


def _icms(name: str, leaf: str, cast: str | None = None) -> Field:
    return variant_field(name, "det/imposto/ICMS", NFE_ICMS_GROUPS, [leaf], cast)


def _ipi(name: str, leaf: str, cast: str) -> Field:
    return field(name, f"det/imposto/IPI/IPITrib/{leaf}", cast=cast)


def _pis(name: str, leaf: str, cast: str | None = None) -> Field:
    return variant_field(name, "det/imposto/PIS", PIS_GROUPS, [leaf], cast)


def _cofins(name: str, leaf: str, cast: str | None = None) -> Field:
    return variant_field(name, "det/imposto/COFINS", COFINS_GROUPS, [leaf], cast)


def _decode(table: dict[str, str]):
    return lambda code: codes.decoded(code, table)


def _document_key(name: str, prefix: str) -> Field:
    return Field(name, ("@Id",), lambda: F.expr(f"coalesce({at('@Id')}, '')"), lambda n: n.text_at("@Id"), then=lambda v: without(v, prefix))


# Paths start at infNFe; under det/ they mean the one item of the record.
NFE_FIELDS: tuple[Field, ...] = (
    field("Natureza_da_Operacao", "ide/natOp"),
    field("Serie", "ide/serie"),
    field("No_NF", "ide/nNF"),
    field("Data", "ide/dhEmi", date_part, DAY),
    field("Tipo_de_NF", "ide/tpNF", _decode(codes.INVOICE_DIRECTION)),
    field("Local_Operacao", "ide/idDest", _decode(codes.OPERATION_SCOPE)),
    first_field("NF_Ref", "ide/NFref", "refNFe"),
    field("CNPJ_Emitente", "emit/CNPJ"),
    field("Emitente", "emit/xNome"),
    field("UF_Emitente", "emit/enderEmit/UF"),
    field("IE_Emitente", "emit/IE"),
    field("Insc_Municipal_Emitente", "emit/IM"),
    field("IE_Substituta_Emitente", "emit/IEST"),
    field("Regime_Tributario", "emit/CRT", _decode(codes.TAX_REGIME)),
    field("CNPJ_Destinatario", "dest/CNPJ"),
    field("Nome_destinatario", "dest/xNome"),
    field("UF_Destinatario", "dest/enderDest/UF"),
    field("IE_destinatario", "dest/IE"),
    Field("No_Item", ("det/@nItem",), lambda: F.expr(f"coalesce({at('det/@nItem')}, '0')"), lambda n: n.text_at("det/@nItem"), WHOLE, padded_number),
    field("Codigo_produto", "det/prod/cProd"),
    field("Descricao_produto", "det/prod/xProd"),
    field("NCM", "det/prod/NCM"),
    field("CFOP", "det/prod/CFOP"),
    field("Unid_medida", "det/prod/uCom"),
    field("Quantidade", "det/prod/qCom", cast=QUANTITY),
    field("Vlr_Unitario", "det/prod/vUnCom", cast=UNIT_PRICE),
    field("Vlr_Produto", "det/prod/vProd", cast=MONEY),
    field("CEST", "det/prod/CEST"),
    _icms("Origem", "orig"),
    _icms("CST_ICMS", "CST"),
    _icms("Red_BC_ICMS", "pRedBC", RATE),
    _icms("BC_ICMS", "vBC", MONEY),
    _icms("Aliq_ICMS", "pICMS", RATE),
    _icms("Vlr_ICMS", "vICMS", MONEY),
    _icms("MVA_ICMS", "pMVAST", RATE),
    _icms("BC_ICMS_ST", "vBCST", MONEY),
    _icms("Aliq_ST_ICMS", "pICMSST", RATE),
    _icms("Vlr_ICMS_ST", "vICMSST", MONEY),
    _icms("Parte_Diferida_ICMS", "pDif", RATE),
    _icms("Vlr_ICMS_Dif", "vICMSDif", MONEY),
    _icms("BC_ICMS_Monofasico", "qBCMonoRet", QUANTITY),
    _icms("Aliq_AdRem", "adRemICMSRet", RATE),
    _icms("Vlr_ICMS_Monofasico", "vICMSMonoRet", MONEY),
    _icms("BC_ICMS_Retido", "vBCSTRet", MONEY),
    _icms("Aliq_ICMS_Retido", "pST", RATE),
    _icms("Vlr_ICMS_Retido", "vICMSSTRet", MONEY),
    # The taxed group wins once it is there, even without a code.
    branch_field("CST_IPI", "det/imposto/IPI/IPITrib", "CST", "det/imposto/IPI/IPINT/CST"),
    _ipi("BC_IPI", "vBC", MONEY),
    _ipi("Aliq_IPI", "pIPI", RATE),
    _ipi("Vlr_IPI", "vIPI", MONEY),
    _pis("CST_Pis", "CST"),
    _pis("BC_Pis", "vBC", MONEY),
    _pis("Aliq_Pis", "pPIS", RATE),
    _pis("Vlr_Pis", "vPIS", MONEY),
    _cofins("CST_Cofins", "CST"),
    _cofins("BC_Cofins", "vBC", MONEY),
    _cofins("Aliq_Cofins", "pCOFINS", RATE),
    _cofins("Vlr_Cofins", "vCOFINS", MONEY),
    field("Modalidade_Frete", "transp/modFrete", _decode(codes.FREIGHT_MODE)),
    _document_key("Chave_NFe", "NFe"),
)

_CTE_ICMS = "imp/ICMS"


def _cte_icms(name: str, leaf: str, cast: str) -> Field:
    """The plain leaf or its other-state twin, whichever group comes first."""
    return variant_field(name, _CTE_ICMS, CTE_ICMS_GROUPS, [leaf, f"{leaf}OutraUF"], cast)


def _in_tax_block(name: str, paths: Sequence[str], default: str, cast: str | None = None, then=None) -> Field:
    """The first filled text, or the default where a tax block has none; NULL without a block."""
    sql = f"CASE WHEN {at(_CTE_ICMS)} IS NOT NULL THEN coalesce({', '.join(text_at(p) for p in paths)}, '{default}') END"

    def pick(node: Node) -> int | str | None:
        found = node.first_text(paths)
        return default if found is None and node.at(_CTE_ICMS) else found

    return Field(name, tuple(paths), lambda: F.expr(sql), pick, cast, then)


def _simples(flag: Column) -> Column:
    """Yes for flag 1, no for another one or none."""
    return F.when(flag == "1", codes.YES).when(flag.isNotNull(), codes.NO)


# Paths start at infCte.
CTE_FIELDS: tuple[Field, ...] = (
    field("CFOP", "ide/CFOP"),
    field("NAT_Operacao", "ide/natOp"),
    field("Serie", "ide/serie"),
    field("Numero_CTE", "ide/nCT"),
    field("Data_Emissao", "ide/dhEmi", date_part, DAY),
    field("Tipo_CTE", "ide/tpCTe", _decode(codes.FREIGHT_DOCUMENT_TYPE)),
    field("Tipo_do_servico", "ide/tpServ", _decode(codes.FREIGHT_SERVICE)),
    field("Mun_Inicio", "ide/xMunIni"),
    field("UF_Inicio", "ide/UFIni"),
    field("Mun_Fim", "ide/xMunFim"),
    field("UF_Fim", "ide/UFFim"),
    # The code of the short form once it is there, else the taker's own number.
    branch_field("Tomador", "ide/toma3", "toma", "ide/toma4/CNPJ"),
    field("CNPJ_emit", "emit/CNPJ"),
    field("IE_emit", "emit/IE"),
    field("Emitente", "emit/xNome"),
    field("CNPJ_rem", "rem/CNPJ"),
    field("IE_rem", "rem/IE"),
    field("Remetente", "rem/xNome"),
    field("CNPJ_dest", "dest/CNPJ"),
    field("IE_dest", "dest/IE"),
    field("Destinatario", "dest/xNome"),
    field("VLR_Servico", "vPrest/vTPrest", cast=MONEY),
    _in_tax_block("Optante_SN", [f"{_CTE_ICMS}/ICMSSN/indSN"], "", then=_simples),
    variant_field("CST", _CTE_ICMS, CTE_ICMS_GROUPS, ["CST"]),
    _cte_icms("BC_ICMS", "vBC", MONEY),
    _cte_icms("Aliq_ICMS", "pICMS", RATE),
    _in_tax_block("Vlr_ICMS", _cte_icms("Vlr_ICMS", "vICMS", MONEY).paths, "0", MONEY),
    first_field("NF_ref", "infCTeNorm/infDoc/infNFe", "chave"),
    field("Chave_CTe_Subs", "infCTeNorm/infCteSub/chCte"),
    _document_key("Chave_CTE", "CTe"),
)

DOCUMENT_KEY = {NFE: "Chave_NFe", CTE: "Chave_CTE"}
FIELDS = {NFE: NFE_FIELDS, CTE: CTE_FIELDS}
_BODY = {NFE: "infNFe", CTE: "infCte"}
# Parsed in any case: the document checks need them.
_REQUIRED = {NFE: ("ide/natOp", "det/@nItem", "det/imposto/ICMS/ICMS00/CST"), CTE: ("ide/natOp",)}

# Everything that may stand before the root element, then the root's prefix. The prefix is possessive:
# it must not be taken for the name when the rest fails.
_PROLOG = r"(?s)^\x{FEFF}?\s*(?:(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>)\s*)*"
_BEFORE_ROOT = _PROLOG + r"<(?:[\w.-]+:)?+"
ROOT_NAME = _BEFORE_ROOT + r"([A-Za-z_][\w.-]*)"
# What a root's name must contain to be of a type; case counts.
_ROOT_MARKS = {NFE: "NFe|nfeProc", CTE: "CTe|cteProc"}
# Columns that one generated method may make.
GENERATED = 15
ITEM_NUMBER = r"^\s*[+-]?[0-9]+\s*$"

MALFORMED, UNREADABLE, NO_DOCUMENT = "malformed", "unreadable encoding", "no document inside"
NO_KEY = "no key"
NO_IDE, NO_TAX_BLOCK, BAD_ITEM_NUMBER, NO_ITEMS = "no ide", "item without imposto", "bad item number", "no items"


def root_name(text: Column) -> Column:
    return F.regexp_extract(text, ROOT_NAME, 1)


def _root_contains(text: Column, doc_type: str) -> Column:
    return text.rlike(rf"{_BEFORE_ROOT}(?=[\w.-]*(?:{_ROOT_MARKS[doc_type]}))[A-Za-z_]")


def is_type(text: Column, doc_type: str) -> Column:
    """A root naming both types counts as NFe."""
    named = _root_contains(text, doc_type)
    return named if doc_type == NFE else named & ~_root_contains(text, NFE)


def document_type(text: Column) -> Column:
    """``NFe``, ``CTe`` or NULL by the root's name."""
    return F.when(is_type(text, NFE), NFE).when(is_type(text, CTE), CTE)


def with_type(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_type", document_type(F.col("text")))


def type_counts(docs: DataFrame) -> DataFrame:
    """Documents per type; unrelated XML is counted under ``other``."""
    kind = F.coalesce(document_type(F.col("text")), F.lit("other"))
    return docs.groupBy(kind.alias("doc_type")).agg(F.count(F.lit(1)).alias("n_documents"))


def _body_schema(doc_type: str, fields: Iterable[Field]) -> T.StructType:
    paths = [*_REQUIRED[doc_type], *(p for f in fields for p in f.paths)]
    return schema_of(paths)


def _chosen(doc_type: str, columns: Sequence[str] | None) -> list[Field]:
    fields = FIELDS[doc_type]
    if columns is None:
        return list(fields)
    unknown = set(columns) - {f.name for f in fields}
    if unknown:
        raise ValueError(f"no such {doc_type} column: {', '.join(sorted(unknown))}")
    return [f for f in fields if f.name in columns]


def _wanted(doc_type: str, columns: Columns) -> Sequence[str] | None:
    return columns[doc_type] if isinstance(columns, Mapping) else columns


def _schemas(doc_type: str, columns: Sequence[str] | None) -> tuple[T.StructType, T.StructType]:
    """The schema inside the root and the schema of one document body."""
    body, schema = _BODY[doc_type], _body_schema(doc_type, _chosen(doc_type, columns))
    wrapper = T.ArrayType(T.StructType([T.StructField(body, T.ArrayType(schema))]))
    return T.StructType().add(doc_type, wrapper).add("_bad", "string"), schema


def _rooted(text: Column, doc_type: str) -> Column:
    """A bare document gets a root around it, so that one schema serves both forms.

    A second copy of the schema for bare roots would double the code generated for each task.
    """
    bare = text.rlike(rf"{_BEFORE_ROOT}{doc_type}[\s/>]")
    inside = F.regexp_replace(text, _PROLOG, "")
    return F.when(bare, F.concat(F.lit("<root>"), inside, F.lit("</root>"))).otherwise(text)


def _ended(text: Column) -> Column:
    """Whether the text ends with a tag; the common endings are checked without a scan."""
    return text.endswith(">") | text.endswith(">\n") | text.endswith(">\r\n") | text.rlike(r">\s*\z")


def parse(docs: DataFrame, doc_types: Sequence[str] = (NFE, CTE), columns: Columns = None, *, keep: Sequence[str] = ()) -> DataFrame:
    """Parse each document of the given types once: ``(path, doc_type, NFe and/or CTe)``, beside the columns ``keep``.

    A type's column is an array of ``(reason, body)``, so that a batch root gives all of its
    documents; it is NULL for files of another type. ``reason`` is NULL for good documents. A file that
    could not be decoded has the type ``unreadable encoding``. ``columns`` may be given by type. No filter
    removes the other files here: it would be pushed below the column that makes the text, and the
    text be decoded twice.
    """
    docs = docs.select("path", *keep, with_entities(F.col("text")).alias("text"))
    text = F.col("text")
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "_bad",
        "ignoreNamespace": "true",
        "ignoreSurroundingSpaces": "false",
    }
    schemas = {t: _schemas(t, _wanted(t, columns)) for t in doc_types}
    named = document_type(text) if len(doc_types) > 1 else F.when(is_type(text, doc_types[0]), doc_types[0])
    named = F.when(text.isNull(), UNREADABLE).otherwise(named)
    # The parser stops at the end of the root; text behind it makes a document malformed.
    typed = docs.select("path", *keep, "text", named.alias("doc_type"), _ended(text).alias("ended"))
    xml = typed.select(
        "path",
        *keep,
        "doc_type",
        "ended",
        *[F.when(F.col("doc_type") == t, F.from_xml(_rooted(text, t), schemas[t][0], options)).alias(t) for t in doc_types],
    )
    return xml.select("path", *keep, "doc_type", *[_checked(t, schemas[t][1]).alias(t) for t in doc_types])


def _checked(doc_type: str, schema: T.StructType) -> Column:
    x, body = F.col(doc_type), _BODY[doc_type]

    def failed(reason: str) -> Column:
        return F.array(F.struct(F.lit(reason).alias("reason"), F.lit(None).cast(schema).alias("body")))

    bodies = F.filter(F.transform(x[doc_type], lambda d: F.get(d[body], 0)), lambda b: b.isNotNull())
    good = F.transform(bodies, lambda b: F.struct(_reason(b, doc_type).alias("reason"), b.alias("body")))
    broken = x["_bad"].isNotNull() | ~F.col("ended")
    found = F.when(F.size(bodies) > 0, good).otherwise(failed(NO_DOCUMENT))
    return F.when(F.col("doc_type") == doc_type, F.when(broken, failed(MALFORMED)).otherwise(found))


def documents(parsed_docs: DataFrame, doc_type: str) -> DataFrame:
    """One row ``(path, body, reason)`` per document; a file without any has a NULL body.

    Files of other types leave after the explode: a plain explode would infer a filter on the
    parsed column and have every document parsed twice.
    """
    one = parsed_docs.select("path", F.explode_outer(doc_type).alias("d")).filter(F.col("d").isNotNull())
    return one.select("path", F.col("d.body").alias("body"), F.col("d.reason").alias("reason"))


def _reason(body: Column, doc_type: str) -> Column:
    """Why a document yields no records: the first of the checks that fails."""
    reason = F.when(F.get(body["ide"], 0).isNull(), NO_IDE)
    if doc_type == CTE:
        return reason
    items = body["det"]
    number = lambda d: F.coalesce(d["_nItem"], F.lit("0")).rlike(ITEM_NUMBER)
    return (
        reason.when(F.exists(items, lambda d: F.get(d["imposto"], 0).isNull()), NO_TAX_BLOCK)
        .when(F.exists(items, lambda d: ~number(d)), BAD_ITEM_NUMBER)
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, NO_ITEMS)
    )


def _kinds(doc_types: Sequence[str], columns: Columns) -> list[Kind]:
    kinds = []
    for t in doc_types:
        fields = _chosen(t, _wanted(t, columns))
        # A root naming both types counts as NFe.
        marks = _ROOT_MARKS[t] if t == NFE else rf"^(?!.*(?:{_ROOT_MARKS[NFE]})).*(?:{_ROOT_MARKS[t]})"
        kinds.append(Kind(t, _BODY[t], marks, _body_schema(t, fields), tuple(sorted(fields, key=of_item)), t == NFE))
    return kinds


def _unread(docs: DataFrame, doc_types: Sequence[str], columns: Columns, *, keep: bool) -> DataFrame:
    """Documents that are not plain, and with ``keep`` the texts of the records of the plain ones. A document whose own
    entities could be put in place has no declarations left, so it may be plain."""
    chosen = {t: tuple(f.name for f in _chosen(t, _wanted(t, columns))) for t in doc_types}
    key = (keep, *chosen.items())
    return docs.select("path", with_entities(F.col("text")).alias("text")).mapInArrow(
        lambda batches: read_plain(batches, key, lambda: _kinds(list(chosen), chosen), keep), output_schema(_kinds(doc_types, columns))
    )


def read_records(docs: DataFrame, doc_types: Sequence[str] = (NFE, CTE), columns: Columns = None) -> DataFrame:
    """Read each document once: a row for each record, and one for each document that yields none.

    NFe: one record per item; CTe: one per document. ``is_NFe``, ``is_CTe`` tell the records; their texts lie in the struct
    ``plain_NFe``, ``plain_CTe`` or, for documents that are not plain, in the array ``other_NFe``, ``other_CTe``.
    ``reason`` is why there is no record; unrelated XML has neither.
    """
    kinds = _kinds(doc_types, columns)
    held = ["plain", *[record_column(k.doc_type) for k in kinds]]
    found = parse(_unread(docs, doc_types, columns, keep=True), doc_types, columns, keep=held)
    held += ["path", "doc_type"]
    reasons = [F.when(F.col("plain").isNull() & (F.col("doc_type") == UNREADABLE), UNREADABLE)]
    for i, kind in enumerate(kinds):
        t, later = kind.doc_type, [k.doc_type for k in kinds[i + 1 :]]
        # Plain records have no body, which an outer explode keeps as one row. As in ``documents``: no filter may reach below the parse.
        found = found.select(*held, *later, F.explode_outer(t).alias("d"))
        good = F.col("d.reason").isNull()
        reason = F.col("d.reason").alias(f"reason_{t}")
        if kind.has_items:
            # The header is split from the items first: kept together, every item would drag all items of its document along.
            header = [n for n in kind.schema.fieldNames() if n != ITEM]
            parts = F.struct(*[F.col(f"d.body.{n}").alias(n) for n in header])
            found = found.select(*held, *later, reason, parts.alias("h"), F.explode_outer(F.when(good, F.col(f"d.body.{ITEM}"))).alias("item"))
            record = F.struct(*[F.col(f"h.{n}").alias(n) for n in header], F.col("item").alias(ITEM))
            found = found.select(*held, *later, f"reason_{t}", record.alias(RECORD), F.col("item").isNotNull().alias("there"))
        else:
            found = found.select(*held, *later, reason, F.col("d.body").alias(RECORD), (good & F.col("d.body").isNotNull()).alias("there"))
        # A lambda is run and not generated: some hundred paths would make a method that is too long to be compiled.
        other = F.when(F.col("there"), F.transform(F.array(*[f.raw() for f in kind.fields]), lambda text: text))
        is_record = ((F.col("plain") == t) & F.col("plain").isNotNull()) | F.col("there")
        held = [*held, f"reason_{t}", f"other_{t}", f"is_{t}"]
        found = found.select(*held[:-2], *later, other.alias(f"other_{t}"), is_record.alias(f"is_{t}"))
        reasons.append(F.col(f"reason_{t}"))
    return found.withColumn("reason", F.coalesce(*reasons))


def record_values(doc_type: str, columns: Columns = None, *, typed: bool = False) -> list[Column]:
    """The fields of a record of ``read_records``. All values are text as written; ``typed`` casts amounts, quantities, rates and dates."""
    kind = _kinds([doc_type], columns)[0]
    texts = {f.name: F.coalesce(F.col(f"{record_column(doc_type)}.{f.name}"), F.get(f"other_{doc_type}", F.lit(i))) for i, f in enumerate(kind.fields)}
    chosen = _chosen(doc_type, _wanted(doc_type, columns))
    if len(chosen) > GENERATED:
        # One lambda among them, which is run and not generated, keeps all of them out of one method too long to be compiled.
        first = chosen[0].name
        texts[first] = F.get(F.transform(F.array(texts[first]), lambda text: text), 0)
    return [f.value(texts[f.name], typed=typed) for f in chosen]


def flatten(docs: DataFrame, doc_type: str, columns: Sequence[str] | None = None, *, typed: bool = False) -> DataFrame:
    """Documents ``(path, text)`` to records; only what ``columns`` need is parsed."""
    found = read_records(docs, [doc_type], columns).filter(F.col(f"is_{doc_type}"))
    return found.select(*record_values(doc_type, columns, typed=typed))


def rejected(parsed_docs: DataFrame, doc_types: Sequence[str] = (NFE, CTE)) -> DataFrame:
    """Documents that yield no records, each with the reason, in one pass. Unrelated XML is not listed."""
    kind = "array<struct<doc_type string, reason string>>"
    named = lambda t: lambda d: F.struct(F.lit(t).alias("doc_type"), d["reason"].alias("reason"))
    of_type = [F.transform(t, named(t)) for t in doc_types]
    unreadable = F.when(F.col("doc_type") == UNREADABLE, F.array(F.struct(F.lit(None).alias("doc_type"), F.lit(UNREADABLE).alias("reason"))).cast(kind))
    found = F.concat(*[F.coalesce(c, F.array().cast(kind)) for c in (*of_type, unreadable)])
    # As in ``documents``: the filter must not reach below the parse.
    one = parsed_docs.select("path", F.explode_outer(found).alias("r")).filter(F.col("r.reason").isNotNull())
    return one.select("path", "r.doc_type", "r.reason")


def rejects(docs: DataFrame) -> DataFrame:
    """All documents that yield no records; parses once, and only what the checks need."""
    columns = {t: [DOCUMENT_KEY[t]] for t in (NFE, CTE)}
    return rejected(parse(_unread(docs, (NFE, CTE), columns, keep=False), (NFE, CTE), columns))
