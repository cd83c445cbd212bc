"""Collocations: frequent phrases of a language whose words occur together more often than apart.

Fingerprints are those of Rabin and Karp. Prefix polynomials over the hashes of a block's words, modulo 2**64, give the
fingerprint of every phrase in a few array operations per length. Blocks send distinct fingerprints with their counts and
get sums back (``common.totals``), so a phrase that is in every text travels once per block. Words and pairs go first; a
longer phrase is only fingerprinted where all of its pairs are frequent.

Fingerprints have ``KEY_BITS`` bits, and blocks send the gaps between them: what a key takes depends neither on the input's
size nor on the number of shards.

Then each block goes to the places of its frequent fingerprints: a fingerprint's first place in the block is its pointer,
every other place is compared with the words there, and places that differ are counted apart, under their own words. So
two phrases with one fingerprint do no harm: sums per text decide what is frequent, and only frequent texts are made.

Separators cut texts into pieces, and phrases lie within pieces. Lower case is A-Z only. A null language is ``und``, a null
text is empty. Rows that repeat count as often as they occur. All arithmetic is exact: products of counts are decimals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastro.llm.common import (
    NEWLINE, among, blocks, found, hash_words, mix, opened, pack, pack_sorted, remove, shard_of, shards_for, stored, table, totals, unpack, unpack_sorted,
    with_totals,
)

LONGEST, LEAST, TOP = 5, 100, 2000
BLOCK_WORDS, SHARD_KEYS = 500_000, 1_000_000
#: Of a fingerprint with its length. Phrases with one fingerprint cost comparisons, never rows.
KEY_BITS = 44
SEPARATORS = r"[.,;:!?\x0A-\x0D]+"
#: Stands for separators in a block; no word can be equal to it.
CUT = b"."
NO_LANG = "und"
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), base, np.uint64)]))[:n]


class Prints:
    """Fingerprints of the phrases that start at each word of a block."""

    def __init__(self, row: dict):
        offsets, self.codes, self.words = opened(row)
        n = len(self.codes)
        h = hash_words(self.words)[self.codes] if n else np.zeros(0, np.uint64)
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(h * powers(BASE, n), dtype=np.uint64)])
        self.back = powers(pow(BASE, -1, 1 << 64), n)
        # how many words from here on lie in the same piece of the same text
        cuts = np.array([w == CUT for w in self.words], bool)[self.codes] if n else np.zeros(0, bool)
        stops = np.union1d(np.flatnonzero(cuts), offsets[1:])
        at = np.arange(n)
        self.room = np.where(cuts, 0, stops[np.searchsorted(stops, at, side="right")] - at) if n else at
        self.lang = np.repeat(np.asarray(row["doc_ids"], np.int64).view(np.uint64), np.diff(offsets))

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the phrases of ``n`` words that start at ``at``, by language."""
        value = (self.prefix[at + n] - self.prefix[at]) * self.back[at]
        return mix(value, self.lang[at] + np.uint64(n)) >> np.uint64(64 - KEY_BITS)

    def starts(self, n: int, pairs: np.ndarray | None) -> np.ndarray:
        """Where phrases of ``n`` words start; those of three or more only where all of their ``pairs`` are frequent."""
        at = np.flatnonzero(self.room >= n)
        for k in range(n - 1) if n > 2 else ():
            at = at[pairs[at + k]]
        return at


def labelled(keys: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of phrases of several lengths in one set: the last three bits tell the length."""
    return (keys & ~np.uint64(7)) | np.uint64(n)


def of_length(keys: np.ndarray, n: int) -> np.ndarray:
    return keys[(keys & np.uint64(7)) == np.uint64(n)]


def packed_texts(made: pa.RecordBatch) -> tuple[bytes, bytes, bytes]:
    """Languages, phrases and counts; words hold no line ends."""
    phrases = NEWLINE.join(x.encode() for x in made.column("phrase").to_pylist())
    return pack(made.column("lang_hash").to_numpy()), zstandard.compress(phrases, 3), pack(made.column("n").to_numpy())


def opened_texts(langs: bytes, phrases: bytes, ns: bytes) -> pa.Table:
    phrase = pc.split_pattern(pa.array([zstandard.decompress(phrases)], pa.binary()).cast(pa.string()), "\n").flatten()
    return pa.table({"lang_hash": pa.array(unpack(langs, np.int64)), "phrase": phrase, "n": pa.array(unpack(ns, np.int64))})


def materialised(row: dict, own: np.ndarray, longest: int) -> pa.RecordBatch:
    """The texts of a block's frequent fingerprints ``own`` with their counts; places whose words differ from the pointer's are counted apart."""
    prints = Prints(row)
    langs, words = prints.lang.view(np.int64), np.array([*prints.words, b""], object)
    parts = [pa.RecordBatch.from_pylist([], MADE)]
    for n in range(1, longest + 1):
        at = np.flatnonzero(prints.room >= n)
        key = labelled(prints.of(at, n), n)
        hit = among(key, of_length(own, n))
        at, key = at[hit], key[hit]
        while len(at):
            distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
            start = at[first]
            pointer = start[back]
            same = langs[at] == langs[pointer]
            for k in range(n):
                same &= prints.codes[at + k] == prints.codes[pointer + k]
            pieces = [words[prints.codes[start + k]].tolist() for k in range(n)]
            phrases = [b" ".join(w).decode() for w in zip(*pieces, strict=True)]
            times = np.bincount(back, weights=same).astype(np.int64)
            parts.append(pa.RecordBatch.from_arrays([pa.array(langs[start]), pa.array(np.full(len(start), n, np.int32)), pa.array(phrases, pa.string()), pa.array(times), pa.array(distinct)], schema=MADE))
            at, key = at[~same], key[~same]
    return pa.concat_batches(parts)


MADE = pa.schema([("lang_hash", pa.int64()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("key", pa.uint64())])


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``docs(lang, text)``: ``(lang, words, phrase, n)`` of all phrases of up to ``longest`` words that occur ``least`` times or more.

    ``longest`` is 5 at most. Words of a phrase are joined by one space.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    spark = docs.sparkSession
    lang = F.coalesce("lang", F.lit(NO_LANG))
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pieces = F.regexp_replace(lower, SEPARATORS, " . ")
    held = blocks(docs.select(F.xxhash64(lang).alias("doc_id"), F.lit(0).alias("flag"), pieces.alias("text")), block_words=BLOCK_WORDS)
    shards = shards_for(spark, held.count(), BLOCK_WORDS, SHARD_KEYS)

    def counts(lengths):
        """Keys of the phrases of these lengths, with counts; long ones only where all of their pairs are frequent."""

        def keys(row):
            prints = Prints(row)
            pairs = np.unpackbits(np.frombuffer(row["pairs"], np.uint8), count=len(prints.codes)).astype(bool) if "pairs" in row else None
            return np.unique(np.concatenate([labelled(prints.of(prints.starts(n, pairs), n), n) for n in lengths]), return_counts=True)

        return keys

    def with_pairs(row, rows):
        """The block, its frequent fingerprints, and where in it pairs are frequent."""
        keys, prints = found(rows), Prints(row)
        at = np.flatnonzero(prints.room >= 2)
        pairs = np.zeros(len(prints.codes), bool)
        pairs[at] = among(labelled(prints.of(at, 2), 2), of_length(keys, 2))
        block = {c: pa.array([row[c]], t) for c, t in BLOCK_TYPES.items()}
        return pa.table({**block, "pairs": pa.array([np.packbits(pairs).tobytes()], pa.binary()), "prints": pa.array([pack_sorted(keys)], pa.binary())})

    def texts(row, rows):
        """The block's frequent texts, packed into one row a shard."""
        own = np.sort(np.concatenate([unpack_sorted(row["prints"]) if "prints" in row else np.zeros(0, np.uint64), found(rows)]))
        made = materialised(row, own, longest)
        where = shard_of(made.column("key").to_numpy(), shards, KEY_BITS)
        order = np.argsort(where, kind="stable")
        made, where = made.select(["lang_hash", "phrase", "n"]).take(pa.array(order)), where[order]
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        parts = [packed_texts(made.slice(a, b - a)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(where)], strict=False)]
        langs, phrases, ns = zip(*parts, strict=True) if parts else ((), (), ())
        return pa.table({"shard": pa.array(where[starts], pa.int32()), "langs": pa.array(langs, pa.binary()), "phrases": pa.array(phrases, pa.binary()), "ns": pa.array(ns, pa.binary())})

    def summed(group: pa.Table) -> pa.Table:
        rows = pa.concat_tables([opened_texts(*x) for x in zip(*(group.column(c).to_pylist() for c in ("langs", "phrases", "ns")), strict=True)])
        sums = rows.group_by(["lang_hash", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang_hash", "phrase", "n"])
        sums = sums.filter(pc.greater_equal(sums.column("n"), least))
        words = pc.add(pc.count_substring(sums.column("phrase"), " "), 1)
        return sums.append_column("words", words.cast(pa.int32())).select(["lang_hash", "words", "phrase", "n"])

    sums = totals(held, counts([1, 2]), shards, repeated=True, least=least, bits=KEY_BITS)
    if longest > 2:
        paired = stored(with_totals(held, sums, with_pairs, PAIRED), "phrase-pairs")
        remove(held)
        held, sums = paired, totals(paired, counts(range(3, longest + 1)), shards, repeated=True, least=least, bits=KEY_BITS)
    parts = with_totals(held, sums, texts, "shard int, langs binary, phrases binary, ns binary").groupBy("shard")
    counted = stored(parts.applyInArrow(summed, "lang_hash long, words int, phrase string, n long"), "phrase-texts")
    remove(held)
    # one row a language
    names = docs.select(lang.alias("lang")).distinct().withColumn("lang_hash", F.xxhash64("lang"))
    return counted.join(names, "lang_hash").select("lang", "words", "phrase", "n")


BLOCK_TYPES = {
    "block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "flags": pa.list_(pa.int32()), "offsets": pa.binary(), "codes": pa.binary(), "words": pa.binary(),
}
PAIRED = "block long, doc_ids array<bigint>, flags array<int>, offsets binary, codes binary, words binary, pairs binary, prints binary"


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by score: ``(lang, rank, phrase, a, l, r, n, score)``.

    ``a`` counts the phrase, ``l`` and ``r`` the two parts of its weakest cut, ``n`` the language's words. A phrase that
    occurs in a longer frequent phrase every time it occurs is dropped: then a phrase of one word more holds it as often.
    """
    lang = F.coalesce("lang", F.lit(NO_LANG))
    all_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D.,;:!?]+"))
    sizes = docs.select(lang.alias("lang"), all_words.cast("long").alias("w")).groupBy("lang").agg(F.sum("w").alias("n_lang"))
    known = stored(frequent_phrases(docs, least, longest), "frequent-phrases")
    counts = known.select("lang", "phrase", "n")
    long = known.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))

    def part(a, b):
        return F.array_join(F.slice("w", a, b), " ")

    # Both parts of a cut are at least as frequent as the whole, so they are known.
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    scored = cuts.join(sizes, "lang").withColumn("score", F.expr("CAST(CAST(1000 AS DECIMAL(38,0)) * a AS DECIMAL(38,0)) * n_lang").cast("decimal(38,0)"))
    scored = scored.withColumn("lr", (exact("l") * exact("r")).cast("decimal(38,0)")).withColumn("score", F.expr("score div lr"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("n_lang").alias("n"))).alias("s")).select("lang", "phrase", "s.*")
    inner = long.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    dropped = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    ranked = weakest.join(dropped, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A part of a language's phrases first, so that no task sorts all of them.
    ranked = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents").select("lang", "text"))


PHRASE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '{NO_LANG}') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT r, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
sizes AS (SELECT lang, sum(len(w)) AS n FROM q GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM q, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
known AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM known WHERE k > 1),
scored AS (SELECT c.lang, c.phrase, c.f, c.cut, a.f AS l, b.f AS r, s.n,
    (1000 * c.f::HUGEINT * s.n::HUGEINT) // (a.f::HUGEINT * b.f::HUGEINT) AS score
    FROM cuts c JOIN sizes s USING (lang) JOIN known a ON a.lang = c.lang AND a.phrase = array_to_string(c.w[1 : c.cut], ' ')
    JOIN known b ON b.lang = c.lang AND b.phrase = array_to_string(c.w[c.cut + 1 :], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM known y WHERE y.lang = x.lang AND y.f >= x.f AND len(y.phrase) > len(x.phrase)
    AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, f AS a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {TOP}
"""
