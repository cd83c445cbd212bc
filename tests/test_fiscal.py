import pytest
from row_bags import rows

from lastro.operators.fiscal import (
    CTE,
    CTE_FIELDS,
    NFE,
    NFE_FIELDS,
    document_type,
    documents,
    flatten,
    parse,
    rejects,
    root_name,
    type_counts,
)
from lastro.operators.keys import KEY
from lastro.operators.registry import key_columns
from lastro.operators.reports import price_history, tax_by_code, top_suppliers
from lastro.plans.fiscal import REJECTS, export_by_type, load_folder, process_folder, stage
from lastro.sources.delimited import scan_delimited
from lastro.sources.xml_folder import read_xml_folder
from lastro.streaming.landing import append_xml

NS = 'xmlns="http://www.portalfiscal.inf.br/nfe"'
IDE = "<ide><natOp>Venda</natOp><dhEmi>2024-01-05T23:10:00-03:00</dhEmi><tpNF>0</tpNF></ide>"
ICMS = "<ICMS><ICMS00><orig>0</orig><CST>00</CST><vICMS>1.50</vICMS></ICMS00></ICMS>"


def det(n="1", taxes=ICMS, prod="<prod><cProd>p</cProd><vProd>2.50</vProd></prod>"):
    return f'<det nItem="{n}">{prod}<imposto>{taxes}</imposto></det>'


def nfe(key="1", items=None, ide=IDE, ns=NS):
    items = det() if items is None else items
    return f'<NFe {ns}><infNFe Id="NFe{key}">{ide}<emit><xNome>Loja</xNome></emit>{items}</infNFe></NFe>'


def proc(body, ns=NS, root="nfeProc"):
    return f'<?xml version="1.0" encoding="UTF-8"?><{root} {ns}>{body}</{root}>'


def cte(key="9", inside="", ide="<ide><natOp>Frete</natOp></ide>"):
    return f'<cteProc><CTe><infCte Id="CTe{key}">{ide}{inside}</infCte></CTe></cteProc>'


PREFIXED = (
    '<n:nfeProc xmlns:n="urn:x"><n:NFe><n:infNFe Id="NFe3"><n:ide><n:natOp>Venda</n:natOp></n:ide>'
    '<n:det nItem="1"><n:imposto><n:ICMS><n:ICMS20><n:CST>20</n:CST></n:ICMS20></n:ICMS></n:imposto></n:det>'
    "</n:infNFe></n:NFe></n:nfeProc>"
)
LINKS = "<infCTeNorm><infDoc><infNFe><chave>k1</chave></infNFe><infNFe><chave>k2</chave></infNFe></infDoc></infCTeNorm>"


def frame(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def nfe_rows(spark, text, *columns):
    columns = columns or ("Chave_NFe", "No_Item", "CST_ICMS")
    return rows(flatten(frame(spark, d=text), NFE).select(*columns))


def cte_row(spark, text):
    return flatten(frame(spark, d=text), CTE).first()


def test_record_shapes(spark):
    docs = frame(spark, a=proc(nfe()), b=cte())
    assert (len(NFE_FIELDS), len(CTE_FIELDS)) == (60, 30)
    assert flatten(docs, NFE).dtypes == [(f.name, "string") for f in NFE_FIELDS]
    assert flatten(docs, CTE).dtypes == [(f.name, "string") for f in CTE_FIELDS]
    typed = dict(flatten(docs, NFE, typed=True).dtypes)
    assert (typed["Data"], typed["No_Item"], typed["Vlr_ICMS"]) == ("date", "int", "decimal(18,2)")


def test_namespaces_and_roots(spark):
    assert nfe_rows(spark, proc(nfe())) == [("1", "01", "00")]
    assert nfe_rows(spark, proc(nfe(ns=""), ns="")) == [("1", "01", "00")]
    assert nfe_rows(spark, PREFIXED) == [("3", "01", "20")]
    assert nfe_rows(spark, nfe("2")) == [("2", "01", "00")]
    assert nfe_rows(spark, '<?xml version="1.0"?><!-- <CTe> -->\n' + nfe("2") + "\n <!-- end -->\n") == [("2", "01", "00")]
    assert nfe_rows(spark, proc(nfe("5") + nfe("6"), root="enviNFe")) == [("5", "01", "00"), ("6", "01", "00")]


def test_classification(spark):
    kinds = {
        proc(nfe()): ("nfeProc", "NFe"),
        "﻿<NFe/>": ("NFe", "NFe"),
        "<!-- <NFe> --><cteProc/>": ("cteProc", "CTe"),
        "<!DOCTYPE a [<!ENTITY b '<NFe>'>]><CTe/>": ("CTe", "CTe"),
        "<procEventoNFe/>": ("procEventoNFe", "NFe"),
        '<NFe:retorno xmlns:NFe="u"/>': ("retorno", None),
        "<nfe/>": ("nfe", None),
        "plain": ("", None),
        "": ("", None),
    }
    docs = spark.createDataFrame([(t,) for t in kinds], ["text"])
    got = docs.select("text", root_name(docs.text), document_type(docs.text)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == kinds
    assert {r.doc_type: r.n_documents for r in type_counts(docs).collect()} == {"NFe": 3, "CTe": 2, "other": 4}


def test_rejects_with_reasons(spark):
    docs = frame(
        spark,
        good=proc(nfe()),
        event="<procEventoNFe><x/></procEventoNFe>",
        malformed=proc(nfe()).replace("</emit>", ""),
        trailing=proc(nfe()) + "tail",
        no_ide=proc(nfe(ide="")),
        no_imposto=proc(nfe(items=det() + '<det nItem="2"><prod/></det>')),
        bad_nitem=proc(nfe(items=det("x"))),
        no_items=proc(nfe(items="")),
        other="<retorno/>",
        cte_no_ide=cte(ide=""),
    )
    assert rows(rejects(docs).select("path", "reason")) == [
        ("bad_nitem", "bad item number"),
        ("cte_no_ide", "no ide"),
        ("event", "no document inside"),
        ("malformed", "malformed"),
        ("no_ide", "no ide"),
        ("no_imposto", "item without imposto"),
        ("no_items", "no items"),
        ("trailing", "malformed"),
    ]
    assert flatten(docs, NFE).count() == 1 and flatten(docs, CTE).count() == 0


def test_item_numbers(spark):
    items = det("100") + det("7") + det("007") + det("").replace('nItem=""', "")
    assert [r[1] for r in nfe_rows(spark, proc(nfe(items=items)))] == ["00", "07", "07", "100"]


def test_tax_groups(spark):
    def one(taxes, *columns):
        return nfe_rows(spark, proc(nfe(items=det(taxes=taxes))), *columns)[0]

    assert one("", "CST_ICMS", "CST_IPI", "CST_Pis") == (None, None, None)
    assert one("<ICMS><ICMSSN101><CST>1</CST></ICMSSN101></ICMS>", "CST_ICMS") == (None,)
    two = "<ICMS><ICMS20><CST>20</CST><vBC>7</vBC></ICMS20><ICMS00><CST></CST><vICMS>5</vICMS></ICMS00></ICMS>"
    assert one(two, "CST_ICMS", "BC_ICMS", "Vlr_ICMS") == ("20", "7", "5")
    taxed = "<IPI><IPINT><CST>53</CST></IPINT><IPITrib><vIPI>2</vIPI></IPITrib></IPI>"
    assert one(taxed, "CST_IPI", "Vlr_IPI") == (None, "2")
    assert one("<IPI><IPINT><CST>53</CST></IPINT></IPI>", "CST_IPI", "Vlr_IPI") == ("53", None)
    pis = "<PIS><PISNT><CST>07</CST></PISNT><PISOutr><CST>99</CST><vPIS>1</vPIS></PISOutr></PIS>"
    assert one(pis, "CST_Pis", "Vlr_Pis") == ("99", "1")


def test_header_values(spark):
    ide = (
        "<ide><natOp>Devolução &amp; troca</natOp><dhEmi>2024-01-31T23:30:00-03:00</dhEmi><tpNF>7</tpNF><idDest>3</idDest>"
        "<NFref><refCTe>c</refCTe></NFref><NFref><refNFe>r1</refNFe></NFref><NFref><refNFe>r2</refNFe></NFref></ide>"
    )
    columns = ("Natureza_da_Operacao", "Data", "Tipo_de_NF", "Local_Operacao", "NF_Ref", "Vlr_Produto")
    assert nfe_rows(spark, proc(nfe(ide=ide)), *columns) == [
        ("Devolução & troca", "2024-01-31", "7", "Exterior", "r1", "2.50")
    ]


def test_cte_values(spark):
    toma3 = "<ide><natOp>f</natOp><toma3/><toma4><CNPJ>1</CNPJ></toma4></ide>"
    assert cte_row(spark, cte(ide=toma3)).Tomador is None
    toma4 = "<ide><toma4><toma>4</toma><CNPJ>123</CNPJ></toma4><tpCTe>1</tpCTe><tpServ>9</tpServ></ide>"
    row = cte_row(spark, cte(ide=toma4))
    assert (row.Tomador, row.Tipo_CTE, row.Tipo_do_servico) == ("123", "CTe Complemento", "9")
    assert (row.Optante_SN, row.CST, row.Vlr_ICMS) == (None, None, None)
    other = "<imp><ICMS><ICMSOutraUF><CST>90</CST><vBCOutraUF>5</vBCOutraUF></ICMSOutraUF></ICMS></imp>"
    row = cte_row(spark, cte(inside=other))
    assert (row.Optante_SN, row.CST, row.BC_ICMS, row.Vlr_ICMS) == ("Não", "90", "5", "0")
    simples = "<imp><ICMS><ICMSSN><indSN>1</indSN></ICMSSN></ICMS></imp>"
    assert cte_row(spark, cte(inside=simples)).Optante_SN == "Sim"
    row = cte_row(spark, cte(inside=LINKS + "<x><infNFe><chave>z</chave></infNFe></x>"))
    assert (row.NF_ref, row.Chave_CTE) == ("k1", "9")
    assert flatten(frame(spark, d=cte(inside=LINKS)), NFE).count() == 0


def test_a_report_parses_only_what_it_reads(spark):
    docs = frame(spark, d=proc(nfe()))
    plan = flatten(docs, NFE, ["CST_ICMS", "Vlr_ICMS"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    for absent in ("COFINS", "xNome", "vProd", "pICMS,"):
        assert absent not in plan
    assert flatten(docs, NFE)._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_unknown_column_is_an_error(spark):
    with pytest.raises(ValueError, match="nope"):
        flatten(frame(spark, d=""), NFE, ["nope"])


def test_reports(spark):
    data = [
        ("00", "1.5", "Entrada", "B", "10", "2024-01-01", "1", "5"),
        ("00", "2.5", "Entrada", "A", "10", "2024-01-01", "1", "6"),
        ("20", None, "Saída", "A", "99", "2024-01-02", "1", "7"),
        (None, "9", "Entrada", "C", "3", "2024-01-02", "2", "8"),
    ]
    items = spark.createDataFrame(
        data, ["CST_ICMS", "Vlr_ICMS", "Tipo_de_NF", "Emitente", "Vlr_Produto", "Data", "NCM", "Vlr_Unitario"]
    )
    assert [(c, float(v) if v is not None else None) for c, v in rows(tax_by_code(items))] == [("00", 4.0), ("20", None)]
    assert [r.Emitente for r in top_suppliers(items, 2).collect()] == ["A", "B"]
    assert [(d, float(m)) for d, m in rows(price_history(items, "1"))] == [("2024-01-01", 5.5), ("2024-01-02", 7.0)]


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "xml"
    out.mkdir()
    (out / "a.xml").write_text(proc(nfe("1", det("1") + det("2"))), encoding="utf-8")
    (out / "b.xml").write_text(cte("9", LINKS), encoding="utf-8")
    (out / "bad.xml").write_text("<nfeProc><NFe>", encoding="utf-8")
    latin = proc(nfe("4", ide="<ide><natOp>Devolução</natOp></ide>")).replace("UTF-8", "ISO-8859-1")
    (out / "latin.xml").write_bytes(latin.encode("latin-1"))
    windows = proc(nfe("5", ide="<ide><natOp>Preço €</natOp></ide>")).replace("UTF-8", "windows-1252")
    (out / "windows.xml").write_bytes(windows.encode("cp1252"))
    (out / "bytes.xml").write_bytes(proc(nfe("6")).encode()[:-5] + b"\xff\xfe>")
    (out / "ignored.txt").write_text(proc(nfe("7")))
    (out / "sub").mkdir()
    (out / "sub" / "deep.xml").write_text(proc(nfe("8")))
    return str(out)


def test_folder_scan(spark, folder, tmp_path):
    nfe_items, cte_docs = process_folder(spark, folder)
    got = nfe_items.select("Chave_NFe", "No_Item", "Natureza_da_Operacao")
    assert rows(got) == [("1", "01", "Venda"), ("1", "02", "Venda"), ("4", "01", "Devolução"), ("5", "01", "Preço €")]
    assert rows(cte_docs.select("Chave_CTE", "NF_ref")) == [("9", "k1")]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no XML file"):
        read_xml_folder(spark, str(tmp_path / "none"))


def test_load_folder_and_append(fresh, folder, tmp_path):
    spark = fresh
    load_folder(spark, folder)
    assert rows(spark.table("NFe").select("Chave_NFe", KEY)) == [("1", "1"), ("1", "1"), ("4", "4"), ("5", "5")]
    assert spark.table("CTe").count() == 1
    assert key_columns(spark, "NFe") == ["Chave_NFe"] and key_columns(spark, "CTe") == ["Chave_CTE"]
    found = {r.path.split("/")[-1]: r.reason for r in spark.table(REJECTS).collect()}
    assert found == {"bad.xml": "malformed", "bytes.xml": "unreadable encoding"}

    more = tmp_path / "more"
    more.mkdir()
    (more / "again.xml").write_text(proc(nfe("1", det("1") + det("2"))), encoding="utf-8")
    (more / "new.xml").write_text(proc(nfe("20", det("1") + det("2"))), encoding="utf-8")
    load_folder(spark, str(more), append=True)
    assert spark.table("NFe").count() == 6 and spark.table("CTe").count() == 1
    load_folder(spark, str(more))
    assert spark.table("NFe").count() == 4 and spark.table("CTe").count() == 1


def test_folder_without_fiscal_documents(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<retorno/>")
    data = stage(read_xml_folder(spark, str(tmp_path)))
    assert data.nfe.isEmpty() and data.cte.isEmpty() and data.rejects.isEmpty()


def test_export(spark, folder, tmp_path):
    data = stage(read_xml_folder(spark, folder))
    out = str(tmp_path / "out")
    assert export_by_type(data, out) == ["NFe", "CTe"]
    back = scan_delimited(spark, f"{out}/NFe").rows
    assert back.columns == [f.name for f in NFE_FIELDS] and back.count() == 4


def test_landing_xml(fresh, folder, tmp_path):
    spark = fresh
    for _ in range(2):
        append_xml(spark, folder, str(tmp_path / "state")).awaitTermination()
    assert spark.table("NFe").count() == 4 and spark.table("CTe").count() == 1


def test_batch_root_with_one_bad_document_keeps_the_other(spark):
    parsed = parse(frame(spark, d=proc(nfe("5") + nfe("6", ide=""), root="enviNFe")), [NFE])
    assert rows(documents(parsed, NFE).select("body._Id", "reason")) == [("NFe5", None), ("NFe6", "no ide")]


def test_files_are_packed_by_spark(spark, tmp_path):
    for i in range(64):
        (tmp_path / f"{i}.xml").write_text(nfe(str(i)))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
    try:
        assert files.rdd.getNumPartitions() == 64
        docs = read_xml_folder(spark, str(tmp_path))
        assert docs.rdd.getNumPartitions() == 64
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert flatten(docs, NFE).select("Chave_NFe").distinct().count() == 64


def test_encodings(spark, tmp_path):
    body = "<a>Ação</a>"
    long = '<?xml version="1.0" ' + " " * 300 + 'encoding="ISO-8859-1"?>'
    files = {
        "long": (long + body).encode("latin-1"), "bom_le": body.encode("utf-16"), "bom_be": b"\xfe\xff" + body.encode("utf-16-be"),
        "plain_le": body.encode("utf-16-le"), "plain_be": body.encode("utf-16-be"), "odd": body.encode("utf-16") + b"x",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.xml").write_bytes(data)
    got = {r.path.split("/")[-1][:-4]: r.text for r in read_xml_folder(spark, str(tmp_path)).collect()}
    assert got.pop("odd") is None and got.pop("long").endswith(body)
    assert {t.removeprefix("\ufeff") for t in got.values()} == {body}


def test_documents_without_id_and_replays(fresh, tmp_path):
    spark = fresh
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.xml").write_text(proc(nfe("") if i else nfe("7")).replace('Id="NFe"', ""))
    (tmp_path / "in" / "bad.xml").write_text("<nfeProc><NFe>")
    first = load_folder(spark, str(tmp_path / "in"))
    again = load_folder(spark, str(tmp_path / "in"), append=True)
    assert [(r.incoming, r.written) for r in (*first, *again)] == [(2, 2), (2, 1)]
    assert rows(spark.table("NFe").select(KEY)) == [("7",), (None,), (None,)]
    assert spark.table(REJECTS).count() == 1


def test_first_of_repeated_elements_counts_at_every_depth(spark):
    twice = lambda name, a, b: f"<{name}>{a}</{name}><{name}>{b}</{name}>"
    ide = f"<ide><natOp/><natOp>B</natOp>{twice('serie', 1, 2)}</ide><ide><natOp>C</natOp><nNF>5</nNF></ide>"
    group = lambda code: f"<ICMS00><orig>0</orig><CST>{code}</CST></ICMS00>"
    taxes = f"<ICMS>{group('00')}{group('20')}</ICMS><ICMS><ICMS10><CST>10</CST><vICMS>9</vICMS></ICMS10></ICMS>"
    item = det(taxes=taxes, prod=twice("prod", "<cProd>p</cProd>", "<cProd>q</cProd><NCM>7</NCM>"))
    refs = "".join(f"<NFref>{r}</NFref>" for r in ("", "<refNFe/>", twice("refNFe", "r1", "r2"), "<refNFe>r3</refNFe>"))
    text = nfe(items=item.replace("</det>", "<imposto><IPI><IPITrib><CST>50</CST></IPITrib></IPI></imposto></det>"), ide=ide.replace("</ide>", f"{refs}</ide>", 1))
    text = text.replace("</infNFe>", '<emit><xNome>Outra</xNome><IE>1</IE></emit></infNFe><infNFe Id="NFe9"/>')
    columns = ["Natureza_da_Operacao", "Serie", "No_NF", "NF_Ref", "Emitente", "IE_Emitente", "Codigo_produto", "NCM", "CST_ICMS", "Vlr_ICMS", "CST_IPI", "Chave_NFe"]
    got = flatten(spark.createDataFrame([("a", text)], "path string, text string"), NFE, columns)
    assert [tuple(r) for r in got.collect()] == [(None, "1", None, "r1", "Loja", None, "p", None, "00", None, None, "1")]
    cte = '<CTe><infCte Id="CTe1"><ide><CFOP>1</CFOP><natOp>x</natOp><CFOP>2</CFOP></ide><imp/><imp><ICMS><ICMSSN><indSN>1</indSN></ICMSSN></ICMS></imp></infCte></CTe>'
    got = flatten(spark.createDataFrame([("a", cte)], "path string, text string"), CTE, ["CFOP", "Optante_SN"])
    assert [tuple(r) for r in got.collect()] == [("1", None)]
