"""Scores, repeats, near duplicates, tokens and packing against brute force."""

import random
import zlib

import pytest
import public_tokenizers
from plain_versions import base_scores, check_pieces, near_duplicates, repeats_digest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lastro.llm.common import gram_hashes, hash_words, inside, table
from lastro.llm.lm_score import op1_lm_score, score_documents
from lastro.llm.minhash import components, linked
from lastro.llm.packing import op8_packing, pack_documents
from lastro.llm.substring import Automaton, match_references, op3_substring_dedup, remove_repeats
from lastro.llm.token_counts import count_tokens, op10_token_counts, read_cache
from lastro.session import shared_folder

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "a  b", " a", "a ", "\n\n a b", "x <|endoftext|> y", "x<|endoftext|>y z", "it's 's 's", "a  b", "é ́a b", "ΟΔΟΣ ΣΑΣ",
    "don 't ... 12 34", "a\x1c b", "a\x00 b c", "日本 語 x", "", "a ́b 1 2", "  x y", "word. word, (word) wördß!", "A_b c_D", "\t\x0b\x0c\r\n", "<|startoftext|> b", "x" * 5000,
]


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def whole(spark):
    return [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")


# --- language-model scores


def test_scores_of_the_table(spark):
    got = {r.doc_id: r for r in op1_lm_score(spark, FOLDER).collect()}
    for d, n, known, total, base in base_scores(whole(spark), lambda d: crc(d) % 7 == 2):
        r = got.pop(d)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(d) % 7 == 2, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        # the mixture knows at least as much as its unigram part
        assert r.score < 0 and (r.held_out or r.score > base)
    assert not got


def test_scores_at_the_edges(docs):
    rows = [(1, None), (2, ""), (3, "A b"), (3, "a B"), (None, "a b"), (4, "zzz " * 3000)]
    got = key((r.doc_id, r.n_tokens, r.n_known) for r in score_documents(docs(rows), F.col("doc_id") == 4).collect())
    assert got == key([(1, 1, 1), (2, 1, 1), (3, 3, 3), (3, 3, 3), (None, 3, 3), (4, 3001, 1)])
    assert score_documents(docs([]), F.lit(False)).count() == 0
    nothing = score_documents(docs([(1, "a")]), F.lit(True)).first()
    assert (nothing.base_score, nothing.score, nothing.train_tokens) == (0.0, 0.0, 0)


def test_probabilities_sum_to_one(docs):
    """Over all words, after a context: the scores of its continuations, the unknown word included."""
    train = [(i, "a b") for i in range(5)] + [(9, "a c")]
    asked = [(100 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "new"])] + [(99, "a")]
    p = {r.doc_id: 10**r.score for r in score_documents(docs(train + asked), F.col("doc_id") >= 99).collect()}
    assert 0 < sum(p[d] for d in range(100, 104)) < 1
    assert p[101] > p[102] > p[103]


# --- passages


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_random_texts(docs, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.choice([0, 3, 35, 40, 80])))) for i in range(60)]
    base = " ".join(map(str, range(100)))
    rows += [(100, None), (101, ""), (102, "a " * 200), (None, "b " * 36), (103, "x y z " * 30), (200, base), (201, base), (201, base)]
    rows += [(202, " ".join(map(str, range(20, 100))) + " q"), (203, " ".join(map(str, range(50, 85)))), (204, " ".join(map(str, range(50, 84))))]
    assert key(remove_repeats(docs(rows)).collect()) == key(repeats_digest(rows, 35))
    assert key(remove_repeats(docs(rows), words=5).collect()) == key(repeats_digest(rows, 5))


def test_repeats_of_the_table(spark):
    assert key(op3_substring_dedup(spark, FOLDER).collect()) == key(repeats_digest(whole(spark), 35))


def test_no_documents(docs):
    assert remove_repeats(docs([])).count() == linked(docs([])).count() == 0


def test_matching_statistics():
    rng = random.Random(3)
    refs = [[rng.choice("abc") for _ in range(30)] for _ in range(5)]
    a = Automaton()
    for r in refs:
        a.add(r)
    text = [rng.choice("abcd") for _ in range(300)]
    subs = {tuple(r[i:j]) for r in refs for i in range(30) for j in range(i + 1, 31)}
    for end, n in enumerate(a.matches(text), 1):
        assert n == max(k for k in range(31) if k == 0 or tuple(text[end - k : end]) in subs and k <= end)


def test_references_are_removed(spark, docs):
    base = [str(i) for i in range(60)]
    rows = [(1, " ".join(["p", *base, "q"])), (2, " ".join(base[:34])), (3, None), (4, "")]
    refs = spark.createDataFrame([(" ".join(base),), (None,)], "text string")
    got = key(match_references(docs(rows), refs).collect())
    assert got == key([(1, 60, "p q"), (2, 0, " ".join(base[:34])), (3, 0, ""), (4, 0, "")])
    with pytest.raises(ValueError, match="60 words"):
        match_references(docs(rows), refs, most_words=59)


def test_gram_hashes_know_their_words():
    import numpy as np

    h = hash_words([b"a", b"b"])[np.random.default_rng(1).integers(0, 2, 400)]
    for n in (1, 2, 5, 12, 35):
        grams = gram_hashes(h, n)
        assert len({(g, tuple(h[i : i + n])) for i, g in enumerate(grams)}) == len(set(grams)) == len({tuple(h[i : i + n]) for i in range(len(grams))})
    assert inside(np.array([0, 3, 3, 7]), 3).tolist() == [True, False, False, True, True]


# --- near duplicates


def test_near_duplicates(docs):
    rng = random.Random(1)
    base = [str(i) for i in range(60)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "A b"), (5, "a"), (None, "a"), (None, None), (10, "É é"), (11, "é é")]
    rows += [(6, " ".join(base)), (7, " ".join(base[:-1])), (8, " ".join(base)), (8, " ".join(base)), (9, " ".join([*base[:-2], "x"]))]
    rows += [(None, "q w e r t y u i o p")] * 2
    for i in range(40):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"z{rng.randrange(9999)}"
        rows.append((100 + i, " ".join(w)))
    assert key(linked(docs(rows)).collect()) == key(near_duplicates(rows))


def test_near_duplicates_of_the_table(spark):
    got = linked(table(spark, FOLDER, "documents").select("doc_id", "text"))
    assert key(got.collect()) == key(near_duplicates(whole(spark)))


def test_near_duplicates_at_another_percent(docs):
    base = [f"w{i}" for i in range(204)]
    edited = lambda at: " ".join("x" if i in at else w for i, w in enumerate(base))
    # 200 shingles, of which an edit changes 5: 180 of 220 in common, then 175 of 225
    rows = [(1, " ".join(base)), (2, edited({20, 60, 100, 140})), (3, edited({10, 30, 50, 70, 90}))]
    got = linked(docs(rows), percent=80)
    assert key(got.collect()) == key(near_duplicates(rows, 80))
    assert {r.doc_id for r in got.where("kept").collect()} == {1, 3}


def test_near_duplicates_with_any_ids(docs):
    base = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(base), " ".join([*base[:-1], "x"]), "q w e r t y u i"
    big = 1 << 62
    rows = [(big, other), (big + 5, text), (2 * big - 1, near), (-7, "one two three four five six"), (-2 * big, near), (3, "a b c d e"), (3, "f g h i j"), (None, "k l m n o"), (None, text)]
    got = key(linked(docs(rows)).collect())
    assert got == key(near_duplicates(rows))


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert {got.get(i, i) for i in range(100, 161)} == {100} and got.get(201) == 200


# --- tokens


@pytest.mark.parametrize(("file", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_counts_equal_whole_texts(spark, docs, file, spaces):
    path, cache = public_tokenizers.path(file), shared_folder(spark, "cache")
    rows = [*enumerate(ODD), (None, None), (0, ODD[0])]
    whole_text = Tokenizer.from_file(path)
    want = key((d, len((t or "").encode()), len(whole_text.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert key(count_tokens(docs(rows), cache, path, spaces).collect()) == want
    held = read_cache(spark, cache)
    assert held.count() == len({t or "" for _, t in rows})
    # nothing is encoded again, and new texts join the cache
    assert key(count_tokens(docs(rows), cache, path, spaces).collect()) == want
    assert read_cache(spark, cache).count() == held.count()
    assert count_tokens(docs([(1, "brand new")]), cache, path, spaces).first().n_tokens > 0
    assert read_cache(spark, cache).count() == len({t or "" for _, t in rows}) + 1
    assert count_tokens(docs([]), cache, path, spaces).count() == 0


def test_counts_of_the_table(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in whole(spark)]
    assert key(op10_token_counts(spark, FOLDER).collect()) == key(want)


def test_packing_of_the_table(spark):
    check_pieces(op8_packing(spark, FOLDER).collect(), whole(spark), public_tokenizers.path("word_bpe_49k.json"))


def test_packing_at_the_edges(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, None), (2, ""), (3, "one two three " * 50), (None, "x"), (4, "a b c d e f g")]
    pieces = pack_documents(docs(rows), path, 2, window=8, with_ids=True).collect()
    check_pieces(pieces, rows, path, 8)
    assert all(len(r.ids) == 4 * r.length and r.opens_inside == (r.start > 0) and r.goes_on == (r.start + r.length < r.doc_tokens) for r in pieces)
    assert pack_documents(docs([]), path, 2).count() == 0
