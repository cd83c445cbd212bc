"""Periodic runs: maximal stretches of words that repeat with some period, found by dyadic square catching.

A *catcher* holds one completed block of ``B = 2**k`` words, counted from the start of its text. From ``B`` words behind
the block's start up to ``2B - 1`` it compares the last ``B`` words read with its block; where they agree, and the next
block's catcher agrees at the same distance ``q``, the text has words ``q`` apart that are equal: a square begins. A run
of period ``q`` and ``POWER * q`` words or more holds two such neighbouring blocks whatever its start, so none is missed.
Each word has one catcher a level to answer, and a task advances all words of a slice of texts at once, level by level:
a word costs a few array operations a level, and texts too short for a level leave it.

Suffixes are compared by a hash of their words, doubled from level to level, and every catch is then checked on the words
themselves: all stretches of the text with that distance are measured, and those that are long enough are merged into the
runs. A multiple of a run's period gives the run's own bounds again, so the smallest period of equal bounds stands.

Everything happens within a text; there is no shuffle. Null and empty texts have no words and no runs. Rows that repeat
are searched each. A text of one repeated word is one run of period 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import hash_words, mix, slices, strings, table, word_codes

LEAST, POWER = 6, 4
SLICE = 4 << 20
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def catches(h: np.ndarray, lengths: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """By level: documents, block starts within them and distances of the catches, and the block's size.

    ``h`` has a hash per word of all documents, one after the other.
    """
    docs, size = np.arange(len(lengths)), 1
    while True:
        long = lengths >= max(least, power * size)
        if not long.any():
            return
        if not long.all():
            h, docs, lengths = h[np.repeat(long, lengths)], docs[long], lengths[long]
        ends = np.cumsum(lengths)
        at = np.arange(len(h))
        local = at - np.repeat(ends - lengths, lengths)
        left = np.repeat(ends, lengths) - at
        held = (local // size - 1) * size  # the block whose catcher this word answers
        seen = (held >= 0) & (left >= size)
        seen &= h == h[np.maximum(at - local + held, 0)]
        hit = np.flatnonzero(seen[:-size] & seen[size:] & (left[:-size] >= 2 * size)) if len(h) > size else at[:0]
        if len(hit):
            yield docs[np.searchsorted(ends, hit, side="right")], held[hit], (local - held)[hit], size
        # words behind a document's end mix into the next one; no catch reads them
        h = mix(h, np.concatenate([h[size:], h[:size]]))
        size *= 2


def stretches(words: np.ndarray, q: int, least: int, power: int) -> list[tuple[int, int]]:
    """Starts and ends of the maximal stretches of period ``q`` that are long enough for a run."""
    same = np.concatenate([[False], words[:-q] == words[q:], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + q
    good = ends - starts >= max(least, power * q)
    return list(zip(starts[good].tolist(), ends[good].tolist(), strict=True))


def runs_of(codes: np.ndarray, offsets: np.ndarray, h: np.ndarray, least: int = LEAST, power: int = POWER) -> dict[int, list[tuple[int, int, int]]]:
    """``(start, length, period)`` of all runs of each document that has any, by start, then period."""
    out: dict[int, dict[tuple[int, int], int]] = {}
    for docs, starts, periods, size in catches(h, np.diff(offsets), least, power):
        bounds = np.flatnonzero(np.diff(docs)) + 1
        for d, s, q in zip(docs[np.concatenate([[0], bounds])].tolist(), np.split(starts, bounds), np.split(periods, bounds), strict=True):
            words, known = codes[offsets[d] : offsets[d + 1]], out.setdefault(d, {})

            def outside(s, q, found, p, size=size):
                """Catches that are not inside a run whose period divides theirs."""
                a, b = found
                return ~((q % p == 0) & (s >= a) & (s + q + size <= b))

            for found, p in known.items():
                keep = outside(s, q, found, p)
                s, q = s[keep], q[keep]
            while len(q):
                least_q = int(q.min())
                for found in stretches(words, least_q, least, power):
                    if found not in known:
                        known[found] = least_q
                        keep = outside(s, q, found, least_q)
                        s, q = s[keep], q[keep]
                s, q = s[q > least_q], q[q > least_q]
    return {d: sorted((a, b - a, p) for (a, b), p in known.items()) for d, known in out.items() if known}


def periodic_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """``docs(doc_id, text)`` with its runs and ``collapsed``, the text without what lies behind the first period of a run.

    A run has ``least`` words and ``power`` times its period at least, and no neighbouring word continues it. ``collapsed``
    joins the words that stay by one space.
    """
    if power < 4:
        raise ValueError("two neighbouring catches are only sure in runs of four periods or more")

    def search(batches):
        for batch in slices(batches, "text", SLICE):
            offsets, codes, distinct = word_codes(batch.column("text"))
            text = strings(distinct)
            h = hash_words([w.encode() for w in text])[codes] if len(codes) else np.zeros(0, np.uint64)
            found = runs_of(codes, offsets, h, least, power)
            edge = np.zeros(len(codes) + 1, np.int64)
            for d, runs in found.items():
                for start, length, period in runs:
                    edge[offsets[d] + start + period] += 1
                    edge[offsets[d] + start + length] -= 1
            stays = np.cumsum(edge)[:-1] == 0
            kept = text[codes[stays]].tolist() if len(codes) else []
            at = np.concatenate([[0], np.cumsum(stays)])[offsets].tolist()
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(d, ())] for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()),
                    pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))),
                    pa.array([" ".join(kept[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, SCHEMA)


def looped(doc_id: Column, text: Column) -> Column:
    """The query's texts: where the checksum of the id ends in 0, the words from a place on are replaced by a loop of the first of them.

    A null id has no checksum, and its text stays.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)

    def loop(w):
        n, g = F.size(w), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        i = F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
        return F.array_join(F.transform(i, lambda x: F.get(w, F.when(x < a, x).otherwise(a + (x - a) % p).cast("int"))), " ")

    chosen = F.when((h % 10 == 0) & text.rlike(WORD), F.get(F.transform(F.array(words), loop), 0))
    return F.coalesce(chosen, text)


def op13_periodic_runs(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found, best = periodic_runs(docs), F.col("best")
    longer = lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", none, longer).alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
