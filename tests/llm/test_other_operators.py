"""Toxicity, archives, mixing, quality, search and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from plain_versions import check_pieces, near_duplicates, repeats, words
from pyspark.sql import functions as F

import corpus_pipeline
from lastro.llm.common import stored, table
from lastro.llm.mixing import BLOCK, SHARDS, mixed
from lastro.llm.quality import judged
from lastro.llm.stages import dedup
from lastro.llm.topk import searched
from lastro.llm.toxicity import fitted, op2_toxicity, subwords, toxicity
from lastro.llm.warc import read_records, revisits, write_archives
from lastro.session import shared_folder

# A few thousand labelled rows.
FOLDER = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    scored = op2_toxicity(spark, FOLDER)
    docs = table(spark, FOLDER, "documents").count()
    rows = scored.collect()
    assert len(rows) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = scored.where("held_out").join(table(spark, FOLDER, "labels"), "doc_id").collect()
    toxic, clean = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above > 0.95, above
    assert sum(s >= 0.3 for s in toxic) >= 0.85 * len(toxic) and sum(s >= 0.3 for s in clean) <= 0.03 * len(clean)


def test_unseen_spellings_share_runs(spark, docs):
    train = [(i, f"some words that are clean number{i} " * 4 + ("you moronic moron " if i % 3 == 0 else "you kindly friend ")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None), (999, 1)], "doc_id long, toxic int")
    model = fitted(docs(train), labels)
    asked = [(1, "some words that are clean you xmoronx"), (2, "some words that are clean you friendly"), (3, None), (4, ""), (None, "a"), (1, "moron " * 9000)]
    got = [(r.doc_id, r.score) for r in toxicity(docs(asked), model).collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got)
    by = dict(got[1:4])
    assert got[0][1] > by[2] and by[3] == by[4]
    one_class = fitted(docs(train), labels.where("toxic = 0"))
    assert toxicity(docs(asked), one_class).where("score > 0.01").count() == 0
    assert toxicity(docs([]), model).count() == 0
    assert len(subwords("moron")) == 1 + 4 + 3 + 2 and subwords("moron") == subwords("moron.")


def test_rare_and_changed_words_count(spark, docs):
    """A toxic word in 4 of 1600 rows, and a short one with a changed inner letter."""
    sign = lambda i: "zorkblat" if i < 4 else "dork"
    train = [(i, "plain words of any text " * 3 + (sign(i) if i < 600 else "kind")) for i in range(1600)]
    model = fitted(docs(train), spark.createDataFrame([(i, int(i < 600)) for i in range(1600)], "doc_id long, toxic int"))
    # each beside an unseen word of its length, which has as many subwords
    asked = ["zorkblat", "qvqvwxwx", "d0rk", "q9wx"]
    rare, as_rare, changed, as_changed = (r.score for r in toxicity(docs([(i, f"plain words of any text {w}") for i, w in enumerate(asked)]), model).orderBy("doc_id").collect())
    assert rare > as_rare and changed > as_changed, (rare, as_rare, changed, as_changed)


def test_a_repeated_id_teaches_once(spark, docs):
    train = [(i, f"some words number{i} " * 4 + ("you moron" if i % 3 == 0 else "you friend")) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    once, often = fitted(docs(train), labels), fitted(docs(train + [train[1]] * 500), labels)
    assert (once[0] == often[0]).all() and once[1] == often[1]


def test_archives_round_trip(spark):
    rows = [(1, "u\r\nx", "a"), (2, None, "a"), (2, "v", "a"), (3, "w", None), (4, "w", ""), (None, "n", "a"), (None, "n", "zé"), (7, "é", "zé\r\n\r\n")]
    rows += [(100 + i, f"http://x/{i}", f"<p>{i % 40}" * 3000) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_folder(spark, "archives")
    index = write_archives(revisits(pages), folder)
    got = read_records(index, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    newest = defaultdict(lambda: -1)
    for p, _, h in rows:
        newest[h or ""] = max(newest[h or ""], -1 if p is None else p)
    want = Counter()
    for p, _, h in rows:
        h = h or ""
        again = newest[h] >= 0 and p != newest[h]
        want[p, len(h.encode()), "revisit" if again else "response", newest[h] if again else None, b"" if again else h.encode()] += 1
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    some = index.where("page_id % 7 = 3")
    assert read_records(some, folder).count() == some.count()
    # records lie one behind the other
    for name in {r.file for r in index.select("file").collect()}:
        at = 0
        for r in index.where(F.col("file") == name).orderBy("offset").collect():
            assert r.offset == at
            at += r.length
    assert read_records(write_archives(revisits(pages.where("false")), folder), folder).count() == 0
    assert revisits(pages, least=2).where("html = 'a' AND record_type = 'revisit'").count() == 0


def test_a_broken_archive_is_noticed(spark):
    folder = shared_folder(spark, "archives")
    index = write_archives(revisits(spark.createDataFrame([(1, "u", "x" * 50)], "page_id long, url string, html string")), folder)
    with pytest.raises(Exception, match="no WARC record"):
        read_records(index.withColumn("length", F.col("length") - 1), folder).collect()


def test_targets_and_takes(spark):
    rows = [(i, "w " * (50 + i % 90), None if i % 11 == 0 else f"s{i % 5}") for i in range(2000)] + [(1, None, "tiny"), (None, "a b c", "tiny"), (7, "", "tiny"), (1, "x y", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    total = sum(sizes.values())
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    want, open_ = {}, set(names)
    while True:
        left = total - sum(want.values())
        shares = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        over = {x for x in open_ if shares[x] > 3 * sizes[x]}
        if not over:
            break
        want |= {x: 3 * sizes[x] for x in over}
        open_ -= over
    want |= shares
    for x in names:
        assert math.isclose(target[x], want[x], rel_tol=1e-12)
        assert abs(taken[x] - want[x]) <= BLOCK or want[x] == 3 * sizes[x]
    shuffled = mixed(docs.repartition(7)).select("doc_id", "size", "taken")
    assert Counter(map(tuple, shuffled.collect())) == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixed(docs.where("false")).count() == 0 and SHARDS > 1


def test_quality_lines(spark):
    prose = "The first of many words that make up a longer line of clean prose, which ends well. " * 5
    clean = "\n".join(prose.replace("first", f"f{i}").replace("many", f"m{i}").replace("clean", f"c{i}") for i in range(1))
    spread = " ".join(f"word{i}" for i in range(60)) + "."
    nav = "home | news | about | sign in | more"
    rows = [(1, spread), (2, spread + "\n" + nav), (3, nav + "\n" + " | ".join(f"x{i}" for i in range(80))), (4, None), (5, ""), (6, clean), (7, spread + "\nshort one\n" + spread), (None, "é " * 70000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in judged(docs).select("doc_id", "rules.*").collect()}
    assert got[1].kept and got[1].cleaned == spread
    assert got[2].kept and got[2].cleaned == spread and got[2].n_symbols == 4
    assert not got[3].kept and not got[3].base_failed
    assert got[4].base_failed and got[5].base_failed and got[4].n_words == got[4].n_repeat_words == 0
    assert got[6].base_failed and got[6].n_repeat_words > 40
    assert got[7].n_dup_lines == 1 and got[7].base_failed and got[7].n_repeat_words == 120
    assert got[None].n_words == got[None].n_repeat_words == 70000 and got[None].word_chars == 70000
    assert judged(docs.where("false")).count() == 0


def test_search_at_the_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [math.nan, 1.0]), (1, [3.0, -1.0]), (1, [3.0, -1.0]), (2, [0.5]), (0, [1.0, 2.0]), (None, [1.0, 1.0]), (80, []), (100, [math.inf, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, searched(docs, F.col("vec_id") % 20 == 0).collect()))
    assert got == sorted([(0, 1, 0, 20480), (0, 2, 1, 4096), (0, 3, 1, 4096)] * 2)
    assert searched(docs.where("false"), F.lit(True)).count() == 0


def test_search_against_all_scores(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.floor(64 * rng.normal(0, 0.2, (700, 8)).astype(np.float32).astype(float))
    rows = [(i, (v[i] / 64).tolist()) for i in range(700)]
    got = defaultdict(list)
    for r in searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    for q in range(0, 700, 20):
        order = sorted((i for i in range(700) if i != q), key=lambda i: (-(v[q] @ v[i]), i))[:5]
        assert sorted(got[q]) == [(n, i, v[q] @ v[i]) for n, i in enumerate(order, 1)]


# --- the pipeline


def test_pipeline_stage_by_stage(spark):
    """Each stage on what the one before kept, against brute force."""
    folder = "/root/testdata/sf0.001"
    docs, outs = table(spark, folder, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
        outs.append(docs)
    quality, dedup, passages, mix, pack = outs
    source = table(spark, folder, "documents")
    for out in outs[:4]:
        assert out.columns == source.columns
    clean = {r.doc_id: r.cleaned for r in judged(source).where("rules.kept").select("doc_id", "rules.cleaned").collect()}
    rows = {r.doc_id: r for r in quality.collect()}
    assert {d: r.text for d, r in rows.items()} == clean and all(r.n_chars == len(r.text) for r in rows.values())
    kept = {d for d, _, _, k in near_duplicates(list(clean.items())) if k}
    assert {r.doc_id: r.text for r in dedup.collect()} == {d: clean[d] for d in kept}
    left = {d: clean[d] if not gone else " ".join(w) for d, _, gone, w in repeats([(d, clean[d]) for d in kept], 35)}
    assert {r.doc_id: r.text for r in passages.collect()} == left
    taken = {r.doc_id: r.taken for r in mixed(passages).collect()}
    size = Counter()
    for r in mix.collect():
        size[r.doc_id] += len(words(r.text))
        assert " ".join(words(r.text)) in " ".join(words(left[r.doc_id]))
    assert size == Counter({d: n for d, n in taken.items() if n})
    numbered = stored(mix.withColumn("doc_id", F.monotonically_increasing_id()), "numbered")
    pieces = corpus_pipeline.STAGES[-1][1](spark, numbered, folder).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in numbered.collect()], public_tokenizers.path("word_bpe_49k.json"))
    assert pack.agg(F.sum("length")).first()[0] == sum(r.length for r in pieces)


def test_pipeline_with_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(90)) + "."
    rows = [(1, text, "s", 1, "x", "y", 2, 3), (None, None, None, 1, "x", "y", 2, 3), (1, text, "s", 1, "x", "y", 2, 3), (None, text + " tail.", None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rules int, `kept` string, `a.b` string, row int, size int")
    for start, n in ((docs, 2), (docs.where("false"), 0)):
        out = start
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stored(stage(spark, out, ""), "odd")
            assert out.columns == docs.columns, name
        assert (out.count() >= n) and corpus_pipeline.STAGES[4][1](spark, out, "").count() >= n


def test_dedup_tells_rows_apart(spark):
    """One row of each group of near duplicates, whatever ids its rows have."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (None, a + " end"), (None, c), (None, c), (None, c + " end"), (None, None), (None, None), (9, ""), (5, b + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, dedup(spark, docs, "").collect()), key=repr)
    assert [d for d, _ in got] == [3, 5, 9, None, None, None]
    assert (3, a) in got and [t for d, t in got if d == 5 and t.startswith(b)] and [t for d, t in got if d is None and (t or "").startswith(c)]
