"""Toxicity scores: subword vectors averaged over a text, then a linear softmax.

A word's subwords are the word itself and the runs of 4 to 6 characters of the word in angle brackets, for words of up to
``SHORT`` letters from 3 on, so that a changed letter leaves a run; each is hashed to one of ``BUCKETS`` vectors. A text is the mean of the vectors of all its subwords. Vectors and softmax are trained jointly in
numpy on a bounded sample of labelled documents: at most ``MOST`` of each class, those of the least hash of their id, one
row each, weighted back to the classes' true shares. Subwords of fewer than ``LEAST_ROWS`` sampled rows have no vector, which counts as zero; an unseen spelling is scored by the runs it shares with known ones.

As the model is linear after the mean, each subword reduces to one number, and a word to its subwords' sum; the table of
numbers has a fixed size and is what the tasks get. Whole texts are scored; a null or empty text gets the score of the
bias alone. Scores depend on the text only. A ``doc_id`` that occurs twice in the labels counts as toxic if one row says
so; labels without a document and null labels teach nothing. With no labels of one class the score is the share
of toxic labels, 0 without any.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import pack, slices, strings, table, unpack, word_codes

BUCKETS, WIDTH, LEAST_RUN, MOST_RUN = 1 << 17, 4, 4, 6
SHORT, SHORT_RUN = 4, 3
#: Labelled rows to learn from, clean and toxic, and the number of them in which a subword must occur to have a vector.
MOST, LEAST_ROWS = (6000, 2000), 3
EPOCHS, BATCH, RATE, SCALE, DECAY = 20, 128, 0.03, 200.0, 1e-5
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MEMO = 500_000


def subwords(word: str) -> list[int]:
    """Buckets of a word's subwords."""
    w = word.strip(MARKS) or word
    whole = f"<{w}>"
    least = LEAST_RUN if len(w) > SHORT else SHORT_RUN
    grams = [whole, *(whole[i : i + n] for n in range(least, MOST_RUN + 1) for i in range(len(whole) - n + 1) if n < len(whole))]
    return [zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams]


def features(batches):
    """Buckets and counts of each text, packed."""
    for batch in slices(batches, "text"):
        offsets, codes, words = word_codes(batch.column("text"), lower=True)
        units = [np.array(subwords(w), np.int64) for w in strings(words)]
        ids, counts = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            u, n = np.unique(np.concatenate([units[c] for c in codes[a:b].tolist()]) if b > a else np.zeros(0, np.int64), return_counts=True)
            ids.append(pack(u.astype(np.uint32)))
            counts.append(pack(n.astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["toxic", "ids", "counts"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], weights: tuple[float, float]) -> tuple[np.ndarray, float]:
    """Each subword's number, and the bias, of the difference between the two classes."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.01, (BUCKETS, WIDTH)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, softmax, bias)]
    labels = np.array([r[0] for r in rows])
    share = np.array(weights, np.float32)[labels]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            chosen = order[at : at + BATCH]
            sizes = np.array([len(rows[i][1]) for i in chosen])
            ids = np.concatenate([rows[i][1] for i in chosen])
            part = np.concatenate([rows[i][2] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            mean = np.stack([np.bincount(owner, weights=vectors[ids, d] * part, minlength=len(chosen)) for d in range(WIDTH)], 1).astype(np.float32)
            logits = mean @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p *= (share[chosen] / share[chosen].sum())[:, None]
            back = p @ softmax.T
            grad = np.stack([np.bincount(ids, weights=back[owner, d] * part, minlength=BUCKETS) for d in range(WIDTH)], 1).astype(np.float32)
            step += 1
            for x, g, (m, v) in zip((vectors, softmax, bias), (grad + DECAY * vectors, mean.T @ p, p.sum(0)), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    difference = softmax[:, 1] - softmax[:, 0]
    return (vectors @ difference * SCALE).astype(np.float32), float(bias[1] - bias[0])


def fitted(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = MOST) -> tuple[np.ndarray, float]:
    """Train on ``labels(doc_id, toxic)`` of ``docs(doc_id, text)``; both must hold training rows only."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return np.zeros(BUCKETS, np.float32), 20.0 if 1 in n else -20.0
    chosen = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[c]) for c in (0, 1)]
    # at most ``sum(most)`` ids, and of each the row whose text has the least hash
    sample = docs.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text")
    rows = []
    for r in sample.mapInArrow(features, "toxic int, ids binary, counts binary").toLocalIterator():
        ids, counts = unpack(r["ids"], np.uint32).astype(np.int32), unpack(r["counts"], np.uint32).astype(np.float32)
        rows.append((r["toxic"], ids, SCALE * counts / max(counts.sum(), 1)))
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    seen = np.zeros(BUCKETS, np.int64)
    for _, ids, _ in rows:
        seen[ids] += 1
    common = seen >= LEAST_ROWS
    rows = [(c, ids[common[ids]], part[common[ids]]) for c, ids, part in rows]
    taken = [sum(r[0] == c for r in rows) for c in (0, 1)]
    numbers, bias = train(rows, (n[0] / max(taken[0], 1), n[1] / max(taken[1], 1)))
    return np.where(common, numbers, 0).astype(np.float32), bias


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], carry: list[str] = ()) -> DataFrame:
    """``docs(doc_id, text)`` with ``score``."""
    sent, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def score(batches):
        numbers, memo = sent.value, {}
        for batch in slices(batches, "text"):
            offsets, codes, words = word_codes(batch.column("text"), lower=True)
            words = strings(words).tolist()
            if len(memo) > MEMO:
                memo.clear()
            for w in words:
                if w not in memo:
                    u = subwords(w)
                    memo[w] = (float(numbers[u].sum()), len(u))
            both = np.array([memo[w] for w in words], np.float64).reshape(-1, 2)[codes] if len(codes) else np.zeros((0, 2))
            sums = np.concatenate([np.zeros((1, 2)), np.cumsum(both, 0)])
            per = sums[offsets[1:]] - sums[offsets[:-1]]
            logit = per[:, 0] / np.maximum(per[:, 1], 1) + bias
            out = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(out)], names=["doc_id", *carry, "score"])

    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "text", *carry).mapInArrow(score, ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)) + ", score double")


def op2_toxicity(spark, folder: str, threshold: float = 0.3) -> DataFrame:
    def held(docs):
        return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)

    docs, labels = held(table(spark, folder, "documents").select("doc_id", "text")), held(table(spark, folder, "labels"))
    model = fitted(docs.where("not held_out").select("doc_id", "text"), labels.where("not held_out").select("doc_id", "toxic"))
    return toxicity(docs, model, ["held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
