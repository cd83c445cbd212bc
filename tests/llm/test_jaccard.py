"""The n-gram Jaccard join against comparing all pairs."""

import random

import numpy as np
import pytest
from plain_versions import near_duplicates

from lastro.llm import jaccard
from lastro.llm.common import table
from lastro.llm.jaccard import folded, jaccard_classes, op11_ngram_jaccard, room, signature, tiled, width

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain(texts, percent=90, shingle=3):
    return sorted((r[:3] for r in near_duplicates(texts, percent, shingle)), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed, bases=4, copies=40):
    """Groups of copies with few to many edits, so that similarities lie on both sides of the threshold."""
    rng, texts = random.Random(seed), []
    for _ in range(bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 200))]
        texts += [edited(rng, base, rng.randint(0, len(base) // 20)) for _ in range(copies)]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.choice([1, 2, 3, 5, 40]))) for _ in range(60)]
    rng.shuffle(texts)
    out = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(5000, texts[3].upper()), (5001, texts[3]), (5001, texts[3])]
    # one id with two texts joins their groups
    return out + [(6000, texts[10]), (6000, texts[11]), ((1 << 62) + 5, texts[12]), ((1 << 63) - 1, "only here once"), (-4, texts[13]), (7000, None), (7001, ""), (7001, " "), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_of_random_texts(docs, seed):
    texts = corpus(seed)
    assert rows(jaccard_classes(docs(texts))) == plain(texts)


def test_other_sizes_and_thresholds(docs):
    texts = corpus(3, bases=3, copies=25)
    assert rows(jaccard_classes(docs(texts), shingle=2, percent=75)) == plain(texts, 75, 2)


def test_tiles_find_what_the_hub_does_not(spark, monkeypatch):
    """Families of sets around one common set, too far from it and from each other to link; all share one mark."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    rng = np.random.default_rng(9)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    base, sets, members = draw(200), [], []
    for family in range(15):
        own = np.concatenate([base[: 200 - 24], draw(24)])
        for i in range(6):
            s = np.sort(np.concatenate([own[:-2], draw(2)]) if i else own)
            node = family * 10 + i
            sets.append((node, len(s), bytearray(signature(s)), bytearray(s.tobytes())))
            members.append((1, 3, node, len(s), 0 if family == 0 else node))
    sets = spark.createDataFrame(sets, "node long, n long, bits binary, shingles binary")
    members = spark.createDataFrame(members, "mark long, at int, node long, n long, root long")
    want = {(f * 10 + i, f * 10 + j) for f in range(1, 15) for i in range(6) for j in range(i + 1, 6)}
    pairs = tiled(members, sets, 90)
    got = {tuple(r) for r in pairs.collect()}
    assert want <= got and len(got) < 2 * len(want)
    assert {tuple(r) for r in jaccard.confirmed(pairs, sets, 90).collect()} == want


def test_the_table(spark):
    texts = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    assert rows(op11_ngram_jaccard(spark, FOLDER)) == plain(texts)


def test_no_documents_and_clashing_columns(spark, docs):
    assert jaccard_classes(docs([])).count() == 0
    odd = spark.createDataFrame([(2, "a b c", 1, "x", 7), (1, "a b c", 2, "y", 8)], "doc_id int, text string, node int, class string, root int")
    assert rows(jaccard_classes(odd)) == [(1, 1, 1), (2, 1, 1)]


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m, common in [(10, 12, 8), (100, 110, 99), (1000, 1100, 990), (40, 900, 3), (64, 65, 0)]:
        both = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        a, b = np.sort(both[:n]), np.sort(both[n - common : n - common + m])
        narrow = min(width(len(a)), width(len(b)))
        x, y = folded([signature(a), signature(b)], narrow)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert room(np.int64(90), np.int64(100), 90) >= 10 and room(np.int64(89), np.int64(100), 90) == -1
