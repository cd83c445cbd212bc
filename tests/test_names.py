from hypothesis import given
from hypothesis import strategies as st

from lastro.functions.names import clean_name, clean_names, header_labels, with_clean_names


def test_documented_names():
    cases = {
        "São Paulo": "Sao_Paulo",
        "Preço (R$)": "Preco_R",
        "Código@Fornecedor": "CodigoFornecedor",
        "Número do Documento": "Numero_do_Documento",
        "% de Desconto": "_de_Desconto",
        " a  b ": "_a_b_",
    }
    assert {label: clean_name(label) for label in cases} == cases


def test_fallback_and_collisions():
    assert clean_names(["x", "日本", "a", "A", "a"]) == ["x", "column_2", "a", "A_2", "a_3"]


def test_collision_with_a_name_that_looks_suffixed():
    assert clean_names(["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]


def test_header_labels():
    assert header_labels(["a", "a", None, "b"]) == ["a", "a.1", "Unnamed: 2", "b"]
    assert clean_names(header_labels(["a", "a", "", "b"])) == ["a", "a1", "Unnamed_2", "b"]
    assert header_labels(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]


@given(st.text(max_size=30))
def test_cleaning_twice_changes_nothing(label):
    once = clean_name(label)
    assert clean_name(once) == once
    assert all(ch.isascii() and (ch.isalnum() or ch == "_") for ch in once)


@given(st.lists(st.text(max_size=6), max_size=8))
def test_names_are_unique_without_case(labels):
    names = clean_names(labels)
    assert len({n.lower() for n in names}) == len(labels)


def test_frame(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["País", "pais", "% x"])
    assert with_clean_names(df).columns == ["Pais", "pais_2", "_x"]
