"""Plain documents are read by their shape; what comes out must be what ``from_xml`` gives."""

from __future__ import annotations

import random

import pytest
from row_bags import rows

from lastro.operators.fiscal import CTE, NFE, _kinds, _unread, flatten, rejects
from lastro.operators.plain import NotPlain, Reader
from lastro.plans.fiscal import stage

ITEM = (
    '<det nItem="{n}"><prod><cProd>p{n}</cProd><xProd>Caf\u00e9 "{n}"</xProd><NCM>0{n}</NCM><qCom>1.0000</qCom><vProd>2.50</vProd></prod><imposto>'
    "<ICMS><ICMS20><orig>1</orig><CST>20</CST><pRedBC>1.00</pRedBC><vBC>9.00</vBC><vICMS>1.10</vICMS></ICMS20></ICMS>"
    "<IPI><IPITrib><CST>50</CST><vIPI>0.10</vIPI></IPITrib></IPI><PIS><PISNT><CST>07</CST></PISNT></PIS>"
    "<COFINS><COFINSOutr><CST>99</CST><vCOFINS>3.00</vCOFINS></COFINSOutr></COFINS></imposto></det>"
)
HEAD = (
    '<ide><natOp>Venda</natOp><nNF>7</nNF><dhEmi>2024-01-05T23:10:00-03:00</dhEmi><tpNF>0</tpNF><NFref><refNFe>r1</refNFe></NFref>'
    "<NFref><refNFe>r2</refNFe></NFref></ide><emit><CNPJ>1</CNPJ><xNome>Loja</xNome><enderEmit><UF>SP</UF></enderEmit><CRT>3</CRT></emit>"
    "<dest><CNPJ>2</CNPJ><xNome>Eu</xNome></dest>"
)
NOTE = '<NFe xmlns="urn:n"><infNFe Id="NFe{k}" versao="4.00">' + HEAD + "{items}<total><vNF>1</vNF></total><transp><modFrete>9</modFrete></transp></infNFe></NFe>"
FREIGHT = (
    '<CTe xmlns="urn:c"><infCte Id="CTe{k}"><ide><CFOP>6352</CFOP><natOp>Frete</natOp><dhEmi>2024-01-05T00:00:00</dhEmi><tpCTe>1</tpCTe>'
    "<toma3><toma>0</toma></toma3></ide><emit><xNome>T</xNome></emit><vPrest><vTPrest>5.00</vTPrest></vPrest><imp><ICMS><ICMSSN><CST>90</CST>"
    "<indSN>1</indSN></ICMSSN></ICMS></imp><infCTeNorm><infDoc><infNFe><chave>k1</chave></infNFe></infDoc></infCTeNorm></infCte></CTe>"
)


def note(k=1, n=2):
    return NOTE.format(k=k, items="".join(ITEM.format(n=i + 1) for i in range(n)))


def sound():
    both = note(3, 1) + "\n" + note(4, 3)
    named = note(5).replace("<", "<n:").replace("<n:/", "</n:").replace(' xmlns="urn:n"', "")
    return [
        note(), f"<nfeProc>{note()}</nfeProc>", f'<?xml version="1.0" encoding="UTF-8"?>\n<nfeProc versao="4.00">{note()}<protNFe><x a="1">\u00e7</x></protNFe></nfeProc>\n',
        f"<enviNFe><idLote>1</idLote>{both}</enviNFe>", f'<n:nfeProc xmlns:n="urn:n">{named}</n:nfeProc>', FREIGHT.format(k=1),
        f"<cteProc>{FREIGHT.format(k=2)}</cteProc>", note(6).replace("Loja", "Loja &amp; Filhos &lt;x&gt;"),
    ]


def slow(text):
    """The same document, which a comment before its root keeps from being read by its shape."""
    at = text.find("?>") + 2 if text.lstrip("\ufeff").startswith("<?xml") and "?>" in text else text.startswith("\ufeff")
    return f"{text[:at]}<!-- c -->{text[at:]}"


def is_plain(text, doc_types=(NFE, CTE)):
    try:
        Reader(_kinds(doc_types, None)).read(text)
    except NotPlain:
        return False
    return True


def mutated(seed: int) -> str:
    """A sound document with a few changes of the kinds that documents in the wild have."""
    r = random.Random(seed)
    text = r.choice(sound())
    for _ in range(r.randint(1, 3)):
        cuts = [i for i, c in enumerate(text) if c == "<"] or [0]
        a = r.choice(cuts)
        end = text.find(">", a) + 1
        name = text[a + 1 : end - 1].split(" ")[0]
        kind = r.randrange(16)
        close = text.find(f"</{name}>", a)
        whole = text[a : close + len(name) + 3] if close > 0 and not name.startswith("/") else ""
        if kind == 0 and whole:
            text = text.replace(whole, "", 1)
        elif kind == 1 and whole:
            text = text.replace(whole, whole * 2, 1)
        elif kind == 2 and whole:
            text = text.replace(whole, f"<{name}/>", 1)
        elif kind == 3 and whole:
            text = text.replace(whole, f"<{name}></{name}>", 1)
        elif kind == 4:
            text = text[:a] + r.choice([" ", "\n", "x", "\u00a0", "&amp;", "&#65;", "]]>", ">", "7", "\r\n", "\ufeff", "\U0001f600", "&nada;", "\x01"]) + text[a:]
        elif kind == 5:
            text = text[:end] + r.choice([" ", "\n  ", "y", "1", "&lt;", "&amp;&amp;", " z", "q ", "\x85", "<!-- c -->", "<![CDATA[1]]>", "<?p x?>"]) + text[end:]
        elif kind == 6:
            text = text[:a] + text[end:]
        elif kind == 7 and not name.startswith("/"):
            text = text[: a + 1 + len(name)] + r.choice([' a="1"', ' xmlns:z="u"', ' z:b="1"', ' Id="9"', ' versao="2"', ' xmlns="q"', ' nItem="8"', " a='>'", ' _bad="x"', ' bad="x"', " b", ' a="1" a="2"']) + text[a + 1 + len(name) :]
        elif kind == 8:
            text = text.replace(name, r.choice([name.lower(), name.upper(), "z:" + name, name + "x", "\u00e9" + name]), r.choice([1, 2, -1]))
        elif kind == 9:
            text = text[: r.randrange(len(text))] + r.choice(["", ">"])
        elif kind == 10:
            text = text + r.choice(["x", "<a/>", "\n", " ", "<!-- e -->", "\u00a0", ">"])
        elif kind == 11:
            text = r.choice([" ", "\n", "\ufeff", "<?xml version='1.0'?>", '<?xml version="1.1"?>', "x"]) + text
        elif kind == 12 and whole:
            text = text.replace(whole, f"<{r.choice(['NFe', 'infNFe', 'det', 'w', 'ide', 'CTe', '_bad'])}>{whole}</{r.choice(['NFe', 'infNFe', 'det', 'w', 'ide'])}>", 1)
        elif kind == 13 and whole:
            wrap = r.choice(["NFe", "infNFe", "det", "w", "ide", "imposto", "prod", "ICMS"])
            text = text.replace(whole, f"<{wrap}>{whole}</{wrap}>", 1)
        elif kind == 14 and whole:
            other = r.choice(cuts)
            text = text[:other] + whole + text[other:]
        elif kind == 15:
            text = text.replace('nItem="1"', r.choice(['nItem="01"', 'nItem="x"', "nItem='1'", 'nItem=" 1"', 'nItem=""', 'a="1" nItem="1"', 'nItem="1" a="2"', 'nItem = "1"', 'nItem="1234567890"', 'NITEM="1"', ""]))
    return text


def compared(spark, texts):
    frame = lambda change: spark.createDataFrame([(str(i), change(t)) for i, t in enumerate(texts)], "path string, text string").repartition(4)
    fast, other = frame(str), frame(slow)
    for doc_type, columns in ((NFE, None), (CTE, None), (NFE, ["CST_ICMS", "Vlr_ICMS"])):
        assert rows(flatten(fast, doc_type, columns)) == rows(flatten(other, doc_type, columns))
    a, b = stage(fast), stage(other)
    assert rows(a.nfe) == rows(b.nfe) and rows(a.cte) == rows(b.cte)
    assert rows(a.rejects) == rows(b.rejects) == rows(rejects(fast))
    return a


def test_sound_documents_are_read_by_their_shape(spark):
    assert all(is_plain(t) for t in sound())
    assert not any(is_plain(slow(t)) for t in sound())
    found = compared(spark, sound())
    assert (found.nfe.count(), found.cte.count(), found.rejects.count()) == (14, 2, 0)


@pytest.mark.parametrize("seed", [0, 1000])
def test_changed_documents_give_what_the_other_parser_gives(spark, seed):
    texts = [mutated(seed + i) for i in range(400)]
    assert sum(map(is_plain, texts)) > 40
    compared(spark, texts)


def test_a_document_is_read_once_and_only_odd_ones_reach_the_parser(spark):
    docs = spark.createDataFrame([("a", note()), ("b", slow(note(2)))], "path string, text string")
    plan = flatten(docs, NFE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("from_xml") == 1
    assert [r[0] for r in rows(flatten(docs, NFE, ["Chave_NFe"]))] == ["1", "1", "2", "2"]


def test_documents_whose_entities_are_in_place_are_read_by_their_shape(spark):
    declared = lambda subset: f"<!DOCTYPE nfeProc [{subset}]>\n<nfeProc>{note().replace('Venda', '&op;')}</nfeProc>"
    docs = spark.createDataFrame([("a", declared('<!ENTITY op "Venda">')), ("b", declared('<!ENTITY op "&op;">'))], "path string, text string")
    assert [r.path for r in _unread(docs, [NFE], None, keep=False).collect()] == ["b"]
    assert rows(flatten(docs, NFE, ["Natureza_da_Operacao"])) == [("Venda",), ("Venda",)]
