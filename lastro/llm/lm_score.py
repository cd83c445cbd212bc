"""Language-model scores by deleted interpolation.

A bigram model: ``P(w|h) = l2[b] c(hw)/c(h) + l1[b] c(w)/N + l0[b] / (V+1)``, where ``b`` is the bucket of the context's
frequency. The weights are learned by expectation-maximisation on held-out counts: every training token is held out once,
that is, deleted from the counts it is predicted with. What EM reads of all training tokens is a table of at most
``BUCKETS * CELLS * CELLS`` sums over cells of the two estimates' logarithms, so its size does not grow with the corpus.

Counts cover all training texts. They are summed by ``common.totals``; no vocabulary is broadcast or collected.
Null texts are empty: their only token is the end. Rows that repeat count as often as they occur. A null ``doc_id`` counts
as the text '' for the split. Without training texts every probability is 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import blocks, hash_words, merge, mix, number, opened, shards_for, stored, table, totals, with_totals

BUCKETS, CELLS, PER_OCTAVE, ROUNDS = 12, 128, 3, 60
START, END = np.uint64(0x517CC1B727220A95), np.uint64(0x2545F4914F6CDD1D)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def token_arrays(row: dict) -> tuple:
    """Per token, words then one end a text: its word and context as positions in ``h``, and its document."""
    offsets, codes, words = opened(row)
    hashes = hash_words(words)
    n = np.diff(offsets)
    h = np.concatenate([hashes, [END, START]])
    doc = np.repeat(np.arange(len(n)), n + 1)
    ends = np.cumsum(n + 1) - 1
    w = np.full(len(doc), len(hashes), np.int64)
    inner = np.ones(len(doc), bool)
    inner[ends] = False
    w[inner] = codes
    ctx = np.concatenate([[len(hashes) + 1], w[:-1]]) if len(w) else w
    ctx[ends - n] = len(hashes) + 1
    return h, w, ctx, doc


def cell(p: np.ndarray) -> np.ndarray:
    """0 for zero, else a cell of the logarithm."""
    with np.errstate(divide="ignore"):
        x = np.rint(-np.log2(p) * PER_OCTAVE) + 1
    return np.where(p > 0, np.clip(x, 1, CELLS - 1), 0).astype(np.int64)


def value(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, 2.0 ** (-(c - 1.0) / PER_OCTAVE), 0.0)


def bucket(c: np.ndarray) -> np.ndarray:
    """Of a context's frequency: 0, 1, 2-3, 4-7 and so on; the last is open."""
    return np.minimum(np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


def learn(table: np.ndarray, v: int) -> np.ndarray:
    """Weights (pair, token, uniform) by bucket from ``table[bucket, cell of pair, cell of token]``."""
    f2, f1 = value(np.arange(CELLS))[:, None], value(np.arange(CELLS))[None, :]
    f0 = 1.0 / (v + 1)
    pooled = table.sum(0)
    out = np.zeros((BUCKETS, 3))
    for b in range(BUCKETS):
        counts = table[b] if table[b].sum() >= 1 else pooled
        lam = np.array([0.4, 0.4, 0.2])
        for _ in range(ROUNDS):
            parts = np.stack([lam[0] * f2 + 0 * f1, lam[1] * f1 + 0 * f2, np.full(counts.shape, lam[2] * f0)])
            got = (parts / parts.sum(0) * counts).sum((1, 2))
            if not got.sum():
                break
            lam = got / got.sum()
        out[b] = lam
    out[0, 0] = 0.0  # a context never seen has no estimate
    out[:, 2] = np.maximum(out[:, 2], 1e-6)
    total = out.sum(1, keepdims=True)
    return out / total


def pairs_and_tokens(row: dict) -> tuple:
    """Sorted keys with training counts, both kinds in one array: a token's key is even, a pair's is odd.

    Also for each token of the block: the places of its word, its context and its pair among the keys, and its document.
    """
    h, w, ctx, doc = token_arrays(row)
    train = (1 - np.asarray(row["flags"], np.int64))[doc]
    tokens, pairs = h[:-1] & ~np.uint64(1), mix(h[ctx], h[w]) | np.uint64(1)
    keys, place = np.unique(np.concatenate([tokens, pairs]), return_inverse=True)
    of_word, of_pair = place[: len(tokens)], place[len(tokens) :]
    counts = np.bincount(of_word[w], weights=train, minlength=len(keys)) + np.bincount(of_pair, weights=train, minlength=len(keys))
    # every text begins in START and ends in END, so START is followed as often as END occurs
    followed = np.append(of_word, of_word[-1])
    return keys, counts.astype(np.int64), of_word[w], followed[ctx], of_pair, doc, train


def estimates(row: dict, rows: list, shards: int) -> tuple:
    """Counts of word, context and pair for each token of a block, its document, and 1 if it is a training token."""
    keys, _, w, ctx, pair, doc, train = pairs_and_tokens(row)
    total = merge(keys, shards, rows)
    return total[w], total[ctx], total[pair], doc, train


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """``docs(doc_id, text)`` scored; ``held_out`` is a boolean column, true for rows that teach nothing."""
    spark = docs.sparkSession
    held = blocks(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).cast("int").alias("flag"), "text"), lower=True)
    shards = shards_for(spark, held.count())
    sums = stored(totals(held, lambda row: pairs_and_tokens(row)[:2], shards), "lm-totals")
    n, v = (int(x) for x in number(sums, n=F.col("n_sum"), v=F.col("n_keys")))

    def cells(row, rows):
        """Each training token, deleted from its own counts, falls into a cell of its two estimates."""
        cw, ch, cp, _, train = estimates(row, rows, shards)
        cw, ch, cp = (x[train > 0] for x in (cw, ch, cp))
        p2 = (cp - 1) / np.maximum(ch - 1, 1)
        p1 = (cw - 1) / max(n - 1, 1)
        at, tokens = np.unique((bucket(ch - 1) * CELLS + cell(p2)) * CELLS + cell(p1), return_counts=True)
        return pa.table({"cell": pa.array(at, pa.int32()), "tokens": pa.array(tokens, pa.int64())})

    seen = np.zeros(BUCKETS * CELLS * CELLS)
    for r in with_totals(held, sums, cells, "cell int, tokens long").groupBy("cell").agg(F.sum("tokens").alias("tokens")).toLocalIterator():
        seen[r["cell"]] = r["tokens"]
    weights = learn(seen.reshape(BUCKETS, CELLS, CELLS), v)

    def scores(row, rows):
        cw, ch, cp, doc, _ = estimates(row, rows, shards)
        lam = weights[bucket(ch)]
        p = lam[:, 0] * cp / np.maximum(ch, 1) + lam[:, 1] * cw / max(n, 1) + lam[:, 2] / (v + 1) if n else np.ones(len(cw))
        k = len(row["doc_ids"])
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(np.asarray(row["flags"]) > 0),
                "n_tokens": np.bincount(doc, minlength=k).astype(np.int64), "n_known": np.bincount(doc, weights=cw > 0, minlength=k).astype(np.int64),
                "base_score": np.bincount(doc, weights=np.log10((cw + 1) / (n + v + 1)), minlength=k), "score": np.bincount(doc, weights=np.log10(p), minlength=k),
            }
        )

    return with_totals(held, sums, scores, SCHEMA).withColumn("train_tokens", F.lit(n).cast("long"))


def op1_lm_score(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    return score_documents(docs, split == 2)
