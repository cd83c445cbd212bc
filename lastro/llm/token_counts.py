"""Token counts through a digest cache, and the tokenizer helper that packing shares.

``count_tokens`` joins the SHA-256 of each text, with the digest of the tokenizer's file and version, to the counts in a
cache table, encodes each distinct text that the cache lacks once, and appends its count. The content is digested as it
is, apart from null, which is the empty text: any further normalising would change counts.

A tokenizer's own splitting makes words independent of each other, so within a task each distinct word is encoded once
(``Encoder``); the sums equal encoding the whole text, which the tests check on awkward texts.
Rows that repeat get a row each. Two runs that append the same digest at once leave two equal cache rows, which count once.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import slices, stored, strings, table, word_codes
from lastro.session import shared_folder

#: Bytes that one worker's memo may hold, and what an entry takes beside its characters.
MEMO_BYTES, ENTRY_BYTES = 64 << 20, 200
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Characters beside a single space at which both sides are encoded alike apart or together.
EDGE = r"[\pL\pN_!-/:-@\[-`{-~]"
#: Words of Latin letters, stable under NFC, with at most marks behind them: their splitting is known.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a tokenizer file of the tokenizers library, word by word.

    ``spaces``: True for a byte-level vocabulary, whose words carry the space before them; False for one whose
    splitting drops white space.
    """

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces, self.memo, self.marks = Tokenizer.from_file(path), spaces, {}, {}
        self.held = 0
        self.model, self.letters = self.tokenizer.model, byte_letters()

    def part(self, text: str) -> list[int]:
        """Ids of what the tokenizer's splitting leaves whole."""
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def learn(self, words: list[str]) -> None:
        """Add the words' ids to the memo, as bytes of unsigned 32-bit numbers."""
        rest = []
        for w in words:
            m = PLAIN.fullmatch(w)
            if not m:
                rest.append(w)
                continue
            ids = self.part(m[1] if self.spaces else m[1].lower())
            if m[2]:
                if m[2] not in self.marks:
                    self.marks[m[2]] = self.part(m[2])
                ids += self.marks[m[2]]
            self.memo[w] = array("I", ids).tobytes()
        for i in range(0, len(rest), 20_000):
            part = rest[i : i + 20_000]
            for w, x in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.memo[w] = array("I", x.ids).tobytes()
        if len(self.marks) > 10_000:
            self.marks.clear()

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of each text's independent pieces, the code of each piece, and the pieces by code."""
        if not self.spaces:
            offsets, codes, words = word_codes(texts)
            return offsets, codes, strings(words)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, flat = np.concatenate([[0], np.cumsum(counts)]), parts.flatten()
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        opens, closes = (pc.match_substring_regex(coded.dictionary, x).to_numpy(zero_copy_only=False) for x in ("^" + EDGE, EDGE + "$"))
        apart = np.ones(len(flat), bool)  # from what is before it
        apart[1:] = closes[codes[:-1]] & opens[codes[1:]]
        apart[offsets[:-1]] = True
        inner = np.ones(len(flat), bool)
        inner[offsets[:-1]] = False
        # the first word of a text has no space before it: its own code, behind those of words with a space
        first = codes[offsets[:-1]]
        words = strings(coded.dictionary)
        distinct, place = np.unique(first, return_inverse=True)
        out = codes.astype(np.int64)
        out[offsets[:-1]] = len(words) + place
        vocabulary = np.concatenate([" " + words, words[distinct]]) if len(words) else words
        if apart.all():
            return offsets, out, vocabulary
        starts = np.flatnonzero(apart)
        ends = np.append(starts[1:], len(flat))
        joined = out[starts]
        extra = []
        for i in np.flatnonzero(ends - starts > 1):
            text = " ".join(words[codes[starts[i] : ends[i]]])
            extra.append(" " + text if inner[starts[i]] else text)
            joined[i] = len(vocabulary) + len(extra) - 1
        return np.concatenate([[0], np.cumsum(np.add.reduceat(apart.astype(np.int64), offsets[:-1]))]), joined, np.concatenate([vocabulary, np.array(extra, object)])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
        """Offsets of each text's pieces, the code of each piece, and the ids by code as bytes."""
        offsets, codes, words = self.pieces(texts)
        used = np.zeros(len(words), bool)
        used[codes] = True
        place = np.cumsum(used) - 1
        codes, words, memo = place[codes], words[used].tolist(), self.memo
        missing = [w for w in words if w not in memo]
        # a token takes four bytes and has a character or more in most words
        size = sum(map(len, missing)) * 5 + len(missing) * ENTRY_BYTES
        if self.held + size > MEMO_BYTES and memo:
            memo.clear()
            missing, self.held = words, 0
            size = sum(map(len, missing)) * 5 + len(missing) * ENTRY_BYTES
        self.learn(missing)
        self.held += size
        return offsets, codes, [memo[w] for w in words]


@lru_cache(maxsize=4)
def encoder(path: str, spaces: bool) -> Encoder:
    """One for each worker process."""
    return Encoder(path, spaces)


def tokenizer_digest(path: str) -> str:
    """Of the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def read_cache(spark, cache: str) -> DataFrame:
    """The cache table, empty where nothing was written yet."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache: str, path: str, spaces: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` with ``n_bytes`` and ``n_tokens``; counts not in ``cache`` are made and appended."""
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))

    def first_seen(batches: Iterator[pa.RecordBatch]):
        """Drop a task's own repetitions, so that a text that many rows share is shuffled once per task."""
        seen = set()
        for batch in slices(batches, "text"):
            keep = [d not in seen and not seen.add(d) for d in batch.column("digest").to_pylist()]
            yield batch.filter(pa.array(keep))

    def encode(batches: Iterator[pa.RecordBatch]):
        seen, tokens = set(), encoder(path, spaces)
        for batch in slices(batches, "text"):
            keep = [d not in seen and not seen.add(d) for d in batch.column("digest").to_pylist()]
            batch = batch.filter(pa.array(keep))
            offsets, codes, ids = tokens(batch.column("text"))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            sums = np.concatenate([[0], np.cumsum(lengths[codes])])
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * batch.num_rows, pa.string()), batch.column("digest"), pa.array(sums[offsets[1:]] - sums[offsets[:-1]])],
                names=["tokenizer", "digest", "n_tokens"],
            )

    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest")
    texts = keyed.select("digest", "text").mapInArrow(first_seen, "digest binary, text string").repartition("digest")
    misses = texts.join(known, "digest", "left_anti").mapInArrow(encode, CACHE_SCHEMA)
    misses.write.mode("append").parquet(cache)
    counted = read_cache(spark, cache).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.select("doc_id", "n_bytes", "digest").join(stored(counted, "token-counts"), "digest").select("doc_id", "n_bytes", "n_tokens")


def op10_token_counts(spark, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents")
    counted = count_tokens(docs, shared_folder(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
