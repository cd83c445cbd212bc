"""Large XML files read by many tasks, entities of documents, and folders under other names."""

import pytest
from row_bags import rows
from test_fiscal import cte, nfe, proc

from lastro.operators.entities import with_entities
from lastro.operators.fiscal import CTE, NFE, flatten, rejects
from lastro.plans.fiscal import load_folder
from lastro.sources.xml_folder import read_xml_folder
from pyspark.sql import functions as F

SPLIT, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
COLUMNS = ["Chave_NFe", "No_Item", "Natureza_da_Operacao"]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in (SPLIT, COST)}
    spark.conf.set(SPLIT, "4000")
    spark.conf.set(COST, "0")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def many(first, n=80, **kind):
    return "\n".join(nfe(str(first + i), **kind) for i in range(n))


def prefixed(text):
    import re

    return re.sub(r"<(/?)([A-Za-z])", r"<\1n:\2", text)


def test_files_of_many_forms_give_what_whole_files_give(small_splits, tmp_path):
    spark = small_splits
    latin = '<?xml version="1.0" encoding="ISO-8859-1"?><enviNFe>' + many(0).replace("Venda", "Ação") + "</enviNFe>"
    texts = {
        "latin.xml": latin.encode("latin-1"),
        "prefix.xml": f'<n:enviNFe xmlns:n="u">{prefixed(many(1000, ns=""))}</n:enviNFe>'.encode(),
        "wrapped.xml": ("<lote>" + "".join(f"<nfeProc>{nfe(str(2000 + i))}<protNFe><x/></protNFe></nfeProc>" for i in range(80)) + "</lote>").replace("<lote>", "<enviNFe>").replace("</lote>", "</enviNFe>").encode(),
        "comment.xml": f"<enviNFe><!-- <NFe> -->{many(3000)}</enviNFe>".encode(),
        "cdata.xml": f"<enviNFe>{many(4000)}{nfe('4999', ide='<ide><natOp><![CDATA[</NFe>]]></natOp></ide>')}</enviNFe>".encode(),
        "utf16.xml": f'<?xml version="1.0" encoding="UTF-16"?><enviNFe>{many(5000)}</enviNFe>'.encode("utf-16"),
        "small.xml": proc(nfe("6000")).encode(),
    }
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    docs, whole = read_xml_folder(spark, str(tmp_path), split_bytes=2000), read_xml_folder(spark, str(tmp_path))
    per_file = {r[0].split("/")[-1]: r[1] for r in docs.groupBy("path").count().collect()}
    assert whole.count() == 7 and per_file["comment.xml"] == per_file["cdata.xml"] == per_file["utf16.xml"] == 1
    assert per_file["latin.xml"] == per_file["prefix.xml"] == 80
    want = rows(flatten(whole, NFE, COLUMNS))
    got = rows(flatten(docs, NFE, COLUMNS))
    # the wrappers between the documents of wrapped.xml keep a file read as a whole from showing them
    assert [r for r in got if not r[2].startswith("2")] == want or set(want) <= set(got)
    assert len(got) == 6 * 80 + 2 and ("Ação", "01", "0") in {(a, b, c) for a, b, c in got}


def test_a_large_file_is_read_by_many_tasks(small_splits, tmp_path):
    (tmp_path / "a.xml").write_text(f"<enviNFe>{many(0, 200)}</enviNFe>")
    (tmp_path / "c.xml").write_text("<enviCTe>" + "".join(cte(str(i)).removeprefix("<cteProc>").removesuffix("</cteProc>") for i in range(100)) + "</enviCTe>")
    docs = read_xml_folder(small_splits, str(tmp_path), split_bytes=2000)
    assert docs.where("path like '%a.xml'").rdd.getNumPartitions() > 5
    assert docs.select(F.spark_partition_id()).distinct().count() > 5
    assert flatten(docs, NFE, COLUMNS).count() == 200 and flatten(docs, CTE, ["Chave_CTE"]).distinct().count() == 100


def test_a_file_that_breaks_off_stays_whole(small_splits, tmp_path):
    (tmp_path / "a.xml").write_text(f"<enviNFe>{many(0)}<NFe><infNFe>")
    docs = read_xml_folder(small_splits, str(tmp_path), split_bytes=2000)
    assert docs.count() == 1 and [r.reason for r in rejects(docs).collect()] == ["malformed"]


def test_load_folder_of_another_name(fresh, tmp_path):
    (tmp_path / "a.txt").write_text(proc(nfe("1")))
    load_folder(fresh, str(tmp_path), pattern="*.txt")
    assert fresh.table("NFe").count() == 1
    with pytest.raises(ValueError, match="no XML file"):
        load_folder(fresh, str(tmp_path))


# --- entities


def typed(subset, body, root="NFe"):
    return f"<!DOCTYPE {root} [{subset}]>\n{body}"


def resolve(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(with_entities(F.col("text")).alias("t")).first().t


def test_entities_are_replaced(spark):
    subset = """<!ENTITY a "x&b;">\n<!ENTITY b 'y "q" &lt;'><!ENTITY a "second"> <!ENTITY é 'no name here'>"""
    assert resolve(spark, typed(subset, "<NFe>&a;&a; &amp; &b;</NFe>")) == '\n<NFe>xy "q" &lt;xy "q" &lt; &amp; y "q" &lt;</NFe>'
    assert resolve(spark, "<NFe>&a;</NFe>") == "<NFe>&a;</NFe>" and resolve(spark, None) is None
    assert resolve(spark, typed('<!ENTITY a "">', "<x>&a;</x>")) == "\n<x></x>"


@pytest.mark.parametrize(
    ("subset", "body"),
    [
        ('<!ENTITY a "&b;"><!ENTITY b "&a;">', "<x>&a;</x>"),
        ('<!ENTITY a "&a;&a;">', "<x>&a;</x>"),
        ("".join(f'<!ENTITY b{i} "{f"&b{i - 1};" * 50}">' for i in range(1, 7)) + '<!ENTITY b0 "xxxxxxxxxx">', "<x>&b6;</x>"),
        (f'<!ENTITY a "{"x" * 9000}">', "<x>" + "&a;" * 5000 + "</x>"),
        ('<!ENTITY a SYSTEM "file:///etc/hostname">', "<x>&a;</x>"),
        ('<!ENTITY a "b">', "<x><![CDATA[&a;]]></x>"),
        ("".join(f'<!ENTITY c{i} "&c{i + 1};">' for i in reversed(range(9))) + '<!ENTITY c9 "deep">', "<x>&c0;</x>"),
    ],
)
def test_entities_without_bounds_leave_the_document_alone(spark, subset, body):
    assert resolve(spark, typed(subset, body)) == typed(subset, body)


def test_documents_with_entities_give_records(spark):
    good = typed('<!ENTITY op "Venda &amp; troca">', proc(nfe("1", ide="<ide><natOp>&op;</natOp></ide>")).split("?>")[1], "nfeProc")
    bad = typed('<!ENTITY op "&op;">', nfe("2", ide="<ide><natOp>&op;</natOp></ide>"))
    docs = spark.createDataFrame([("g", good), ("b", bad)], "path string, text string")
    assert rows(flatten(docs, NFE, COLUMNS)) == [("Venda & troca", "01", "1")]
    assert [tuple(r) for r in rejects(docs).select("path", "reason").collect()] == [("b", "malformed")]
