"""Collocations and periodic runs against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from plain_versions import LOWER, words

from lastro.llm import common, phrases
from lastro.llm.common import blocks, table
from lastro.llm.phrases import collocations, frequent_phrases
from lastro.llm.runs import op13_periodic_runs, periodic_runs

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def counted(texts):
    """Counts of all phrases of up to five words and of all words, by language."""
    f, n = Counter(), Counter()
    for lang, text in texts:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    return f, n


def plain_collocations(texts, least, top):
    f, n = counted(texts)
    out, longer = {}, {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    for (lang, p), a in longer.items():
        inner = any(x == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in longer.items())
        if not inner:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return sorted(
        ((lang, i + 1, p.decode(), -a, l, r, m, -s) for lang, found in out.items() for i, (s, a, p, l, r, m) in enumerate(sorted(found)[:top])), key=repr
    )


TEXTS = "lang string, text string, n long, words string, doc_id string"


@pytest.mark.parametrize(("seed", "top"), [(1, 2000), (2, 5)])
def test_collocations_of_random_texts(spark, seed, top):
    rng = random.Random(seed)
    bits = ["a", "b", "C", "c", "d e f", "d e f g h", ".", ", ", "\t", "é", "É", "x\x0by", "\n", "!?", "z\xa0z", "q w e r t y u"]
    texts = [(rng.choice(["en", "de", None]), " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for _ in range(60)]
    texts += [("en", None), ("fr", None), ("fr", ""), (None, " . "), ("one", "lone"), ("es", "a " * 3000), ("es", "a " * 3000)] + texts[:5]
    docs = spark.createDataFrame([(a, b, 1, "w", "d") for a, b in texts], TEXTS)
    for least in (3, 12):
        assert rows(collocations(docs, least=least, top=top)) == plain_collocations(texts, least, top)
    f, _ = counted(texts)
    got = rows(frequent_phrases(docs, least=5, longest=4).select("lang", "phrase", "n"))
    assert got == sorted(((lang, " ".join(p), n) for (lang, p), n in f.items() if n >= 5 and len(p) < 5), key=repr)


def test_no_texts_have_no_collocations(spark):
    assert collocations(spark.createDataFrame([], TEXTS)).collect() == []


def test_equal_fingerprints_are_told_apart_by_their_words(spark, monkeypatch):
    docs = spark.createDataFrame([(7, 0, "a b . a b . c d . a b . c d"), (8, 0, "a b")], "doc_id long, flag int, text string")
    row = blocks(docs.coalesce(1)).first().asDict()
    monkeypatch.setattr(phrases.Prints, "of", lambda self, at, n: np.full(len(at), 64, np.uint64))
    got = phrases.materialised(row, np.array([64 | 2], np.uint64), 2).to_pylist()
    assert sorted((r["lang_hash"], r["phrase"], r["n"]) for r in got) == [(7, "a b", 3), (7, "c d", 2), (8, "a b", 1)]


def test_fingerprints_of_few_bits_lose_no_phrase(spark, monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["a", "b", "cd", "é", "."]) for _ in range(3000))
    row = blocks(spark.createDataFrame([(7, 0, text)], "doc_id long, flag int, text string")).first().asDict()
    monkeypatch.setattr(phrases, "KEY_BITS", 6)
    made = phrases.Prints(row)
    own = np.unique(np.concatenate([phrases.labelled(made.of(made.starts(n, np.ones(len(made.codes), bool)), n), n) for n in (1, 2, 3)]))
    want = Counter(" ".join(w[i : i + n]) for piece in text.split(" . ") for w in [[x for x in piece.split() if x != "."]] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    got = phrases.materialised(row, own, 3).to_pylist()
    assert len(own) <= 24 < len(want) and {r["phrase"]: r["n"] for r in got} == want and len(got) == len(want)


def test_bytes_of_a_key_do_not_follow_the_number_of_shards():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << phrases.KEY_BITS, 200_000, dtype=np.uint64))
    for shards in (8, 200):
        where = common.shard_of(keys, shards, phrases.KEY_BITS)
        parts = [keys[where == s] for s in range(shards)]
        assert min(map(len, parts)) > 0.8 * len(keys) / shards and where.max() < shards
        assert sum(len(common.pack_sorted(p)) for p in parts) < 4.5 * len(keys)
        assert all((common.unpack_sorted(common.pack_sorted(p)) == p).all() for p in parts)
    assert common.shard_of(np.array([0, (1 << 44) - 1], np.uint64), 7, 44).tolist() == [0, 6]
    assert common.found([(0, common.pack_sorted(keys[:0]))]).tolist() == [] and common.found([]).tolist() == []


def test_texts_come_back():
    made = pa.RecordBatch.from_pylist([{"lang_hash": -5, "phrase": "a é", "n": 1 << 40}, {"lang_hash": 7, "phrase": "x", "n": 2}])
    assert phrases.opened_texts(*phrases.packed_texts(made)).to_pylist() == made.to_pylist()


# --- periodic runs


def plain_runs(w, least=6, power=4):
    out = {}
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, power * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((i, n, q) for (i, n), q in out.items())


def plain_query(doc_id, text):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_the_table(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    want = sorted((plain_query(*d) for d in docs), key=repr)
    assert rows(op13_periodic_runs(spark, FOLDER)) == want
    assert sum(r[1] for r in want) > 20


def test_runs_of_random_texts(docs):
    rng, texts = random.Random(3), []
    for i in range(400):
        w = []
        while len(w) < rng.randint(0, 150):
            w += [rng.choice("abc") for _ in range(rng.randint(1, 14))] * rng.choice([1, 1, 1, 3, 4, 5, 9])
        texts.append((i, " ".join(w)))
    texts += [(1000, None), (1001, ""), (1002, " \t\n"), (None, "a " * 6), (1003, "a " * 5), (1004, "x " + "a b " * 4), (1004, "x " + "a b " * 4)]
    got = {}
    for r in periodic_runs(docs(texts)).collect():
        got.setdefault((r.doc_id, r.n_words), []).append([tuple(x) for x in r.runs])
    for d, t in texts:
        w = words(t)
        assert got[d, len(w)].pop() == plain_runs(w)


def test_runs_of_very_long_texts(docs):
    rng = random.Random(4)
    long = [str(rng.randrange(10**6)) for _ in range(3000)]
    texts = [(1, "a " * 60_000), (2, " ".join(long * 5)), (3, " ".join(long * 3)), (4, "a b b " * 20_000)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(docs(texts)).collect()}
    assert got == {1: [(0, 60_000, 1)], 2: [(0, 15_000, 3000)], 3: [], 4: [(0, 60_000, 3)]}
    assert [r.collapsed for r in periodic_runs(docs(texts[3:])).collect()] == ["a b b"]


def test_no_texts_have_no_runs(docs):
    assert periodic_runs(docs([])).count() == 0
    with pytest.raises(ValueError, match="four periods"):
        periodic_runs(docs([]), power=3)
