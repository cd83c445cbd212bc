"""Removing passages that repeat: every word covered by a window of ``WORDS`` words that starts anywhere else too.

All documents are searched against all. Streaming every document past a suffix automaton of every shard would take
documents times shards, so windows are not broadcast but routed. Two steps, each one exchange of packed keys:

1. Every window is known by the least hash among its runs of ``GRAM`` words. Equal windows share it, so only windows
   whose least hash occurs at two places or more can repeat. About one word in twelve starts such a run.
2. The windows that remain are counted by their own hash; those with a count of 2 or more repeat.

``match_references`` is the same removal against a bounded set of references, by broadcast suffix automata.

Documents shorter than the window lose nothing. Null texts have no words. A text that occurs in two rows loses all its
windows in both; periodic text loses windows that overlap themselves. Hashes have 64 bits: a window that occurs
once is taken for a repeated one with a chance of the number of routed windows over 2**64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import among, blocks, found, gram_hashes, hash_words, inside, opened, remove, shards_for, slices, split_words, stored, strings, table, totals, with_totals

WORDS, GRAM = 35, 12
#: A block's arrays of 64-bit hashes take about a hundred bytes a word.
BLOCK_WORDS, BLOCK_KEYS = 300_000, 90_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def running(x: np.ndarray, n: int, pick) -> np.ndarray:
    """Of each ``n`` neighbours the least or greatest; shorter by ``n - 1``."""
    if len(x) < n:
        return x[:0]
    size, out = 1, x
    while 2 * size <= n:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    rest = n - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def windows(row: dict, words: int) -> tuple:
    """Of a block: where windows start, the least gram hash of each window, its own hash, and each gram's hash."""
    offsets, codes, distinct = opened(row)
    h = hash_words(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    starts = inside(offsets, words)
    grams = gram_hashes(h, min(GRAM, words))
    least = running(grams, words - min(GRAM, words) + 1, np.minimum)
    return offsets, codes, distinct, h, starts, grams, least


def anchors(row: dict, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams that are the least of some window, with the number of places at which they are."""
    *_, starts, grams, least = windows(row, words)
    if not starts.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    span = len(grams) - len(least)
    padded = np.concatenate([np.zeros(span, np.uint64), np.where(starts, least, 0).astype(np.uint64), np.zeros(span, np.uint64)])
    chosen = grams[(running(padded, span + 1, np.maximum) == grams) & (grams > 0)]
    return np.unique(chosen, return_counts=True)


def spans(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The stored blocks, and for each block the hashes of its windows that repeat anywhere."""
    held = blocks(docs.select("doc_id", F.lit(0).alias("flag"), "text"), block_words=BLOCK_WORDS)
    shards = shards_for(docs.sparkSession, held.count(), BLOCK_KEYS)
    first = totals(held, lambda row: anchors(row, words), shards, repeated=True)

    def candidates(row, rows):
        _, _, _, h, starts, _, least = windows(row, words)
        chosen = gram_hashes(h, words)[starts & among(least, found(rows))]
        k, c = np.unique(chosen, return_counts=True)
        return pa.table({"block": pa.array([row["block"]], pa.int64()), "k": pa.array([k.tobytes()], pa.binary()), "c": pa.array([c.astype(np.int64).tobytes()], pa.binary())})

    sent = with_totals(held, first, candidates, "block long, k binary, c binary")
    return held, totals(sent, lambda row: (np.frombuffer(row["k"], np.uint64), np.frombuffer(row["c"], np.int64)), shards, repeated=True)


def covered(starts: np.ndarray, total: int, words: int) -> np.ndarray:
    """Words that lie in one of the windows."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + words, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, words: int, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """The stored blocks, and ``remove_repeats`` as a query over them."""

    def keep(row, rows):
        offsets, codes, distinct, h, starts, _, _ = windows(row, words)
        hit = np.flatnonzero(starts & among(gram_hashes(h, words), found(rows))) if starts.any() else np.zeros(0, np.int64)
        gone = covered(hit, len(codes), words)
        n = np.diff(offsets)
        ends = np.concatenate([[0], np.cumsum(gone)])
        kept_at = (offsets - ends[offsets]).tolist()
        kept = [distinct[c] for c in codes[~gone].tolist()]
        texts = [b" ".join(kept[a:b]) for a, b in zip(kept_at, kept_at[1:], strict=False)]
        out = {
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(ends[offsets[1:]] - ends[offsets[:-1]], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if with_text:
            out["kept"] = pa.array([t.decode() for t in texts], pa.string())
        return pa.table(out)

    held, repeated = spans(docs, words)
    return held, with_totals(held, repeated, keep, SCHEMA + ", kept string" * with_text)


def remove_repeats(docs: DataFrame, words: int = WORDS, with_text: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` with counts and the digest of what stays; ``with_text`` adds that text."""
    return without_repeats(docs, words, with_text)[1]


def changed_texts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, kept)`` of the documents that lose words, stored; the blocks are removed."""
    held, out = without_repeats(docs, words, with_text=True)
    changed = stored(out.where("n_removed > 0").select("doc_id", "kept"), "changed-texts")
    remove(held)
    return changed


def op3_substring_dedup(spark, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


class Automaton:
    """Suffix automaton of sequences of words: every sequence of words that occurs in one of them is a path."""

    def __init__(self) -> None:
        self.next, self.link, self.length = [{}], [-1], [0]

    def add(self, words: list) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for w in words:
            to = nxt[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            fresh = None
            if to is None:
                fresh = self.state({}, 0, length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = fresh
                p = link[p]
            if p < 0:
                last = fresh
                continue
            q = nxt[p][w]
            if length[q] > length[p] + 1:
                copy = self.state(dict(nxt[q]), link[q], length[p] + 1)
                link[q] = copy
                while p >= 0 and nxt[p].get(w) == q:
                    nxt[p][w] = copy
                    p = link[p]
                q = copy
            if fresh is not None:
                link[fresh] = q
            last = fresh if fresh is not None else q

    def state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def matches(self, words: list) -> list[int]:
        """Matching statistics: the length of the longest path that ends at each word."""
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
            else:
                at, n = 0, 0
            out.append(n)
        return out


def match_references(docs: DataFrame, references: DataFrame, words: int = WORDS, shard_words: int = 500_000, most_words: int = 20_000_000) -> DataFrame:
    """``docs(doc_id, text)`` without the maximal spans of ``words`` words or more that occur in ``references(text)``.

    References are a bounded set, such as benchmark passages: beyond ``most_words`` words an error says so. Each shard's
    automaton is built from words broadcast once, and each task streams its documents past all shards.
    """
    spark = docs.sparkSession
    size = references.agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"references have {size} words; {most_words} are the most to broadcast")
    texts = [r["text"] for r in references.where("text is not null").select("text").toLocalIterator()]
    shards, held = [[]], 0
    for t in texts:
        w = t.split()
        if held and held + len(w) > shard_words:
            shards.append([])
            held = 0
        shards[-1].append(t)
        held += len(w)
    sent = spark.sparkContext.broadcast(shards)

    def stream(batches):
        automata = []
        for shard in sent.value:
            a = Automaton()
            for t in shard:
                _, w = split_words(pa.array([t]))
                a.add(strings(w).tolist())
            automata.append(a)
        for batch in slices(batches, "text"):
            offsets, flat = split_words(batch.column("text"))
            flat, removed, kept = strings(flat).tolist(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ends = np.max([x.matches(flat[a:b]) for x in automata], axis=0) if b > a else np.zeros(0, np.int64)
                gone = np.zeros(b - a + 1, np.int64)
                for end in np.flatnonzero(ends >= words):
                    gone[end + 1 - ends[end]] += 1
                    gone[end + 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(" ".join(w for w, g in zip(flat[a:b], gone, strict=True) if not g))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(stream, "doc_id long, n_removed long, kept string")
