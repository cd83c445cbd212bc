"""Quality rules, line first: lines are judged one by one, failing lines go, and a document that loses too much goes.

A line fails when

* punctuation: more than ``SYMBOLS`` percent of its characters are symbols, or it has fewer than ``SHORT`` words and no
  closing mark;
* navigation: bars between its words, one for every four words or more;
* boilerplate: up to ``PHRASE_WORDS`` words with one of ``PHRASES``, or it equals an earlier line of the text.

A document is rejected when the lines that stay hold less than ``KEEP`` percent of its characters in words, or when it
fails the base rules: fewer than 50 words, or more than half of its words in 3-word windows that occur twice or more.

Only built-in functions. Everything happens within a row, so there is no shuffle at all. Three-word windows are sorted
with their places, so a text of n words costs n log n. Null and empty texts have no words and fail. Rows that repeat are
judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLIC = r"[#*$%&|<>]"
CLOSING = r"""[.!?:;,"')\]][\x20\x09-\x0D]*\z"""
SYMBOLS, SHORT, PHRASE_WORDS, KEEP = 15, 4, 20, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Phrases of page furniture, in lower case.
PHRASES = ("all rights reserved", "accept cookies", "click here", "cookie policy", "enable javascript", "privacy policy", "sign in", "subscribe to", "terms of use")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row."""
    return F.get(F.transform(F.array(value), body), 0)


def characters(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words that the text has twice or more."""

    def windows(w):
        """The hash goes first: words are only compared where hashes are equal."""

        def window(x, i):
            y, z = F.get(w, i + 1), F.get(w, i + 2)
            return F.struct(F.xxhash64(x, y, z).alias("h"), x.alias("a"), y.alias("b"), z.alias("c"), i.alias("i"))

        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), window)

    def same(x, y):
        return F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def places(s):
        """Where windows start that equal a neighbour in sorted order."""
        marked = F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"]))
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    def covered(p):
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(words, lambda w: let(F.sort_array(windows(w)), lambda s: let(places(s), covered)))


def measured(line: Column) -> Column:
    """A line with its number of words and their characters; its words are sought once."""
    return let(F.regexp_extract_all(line, F.lit(WORD), 0), lambda w: F.struct(line.alias("line"), F.size(w).alias("words"), characters(w).alias("solid")))


def passes(x: Column) -> Column:
    """Whether a ``measured`` line passes; bars are symbols, so they are only counted in lines with symbols."""
    line, words = x["line"], x["words"]

    def fails(symbols):
        bars = F.when(symbols == 0, 0).otherwise(F.regexp_count(line, F.lit(r"\|")))
        phrase = F.lower(line).rlike("|".join(PHRASES))
        return (
            (F.lit(100) * symbols > F.lit(SYMBOLS) * x["solid"])
            | ((words < SHORT) & ~line.rlike(CLOSING))
            | (F.lit(4) * bars >= words)
            | ((words <= PHRASE_WORDS) & phrase)
        )

    return ~let(F.regexp_count(line, F.lit(SYMBOLIC)), fails)


def judged(docs: DataFrame, into: str = "rules") -> DataFrame:
    """``docs(text, ...)`` with a struct ``into``: the counts, both verdicts, and ``cleaned``, the text without its failing lines."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    first = docs.withColumn(into, F.struct(F.regexp_extract_all(whole, F.lit(WORD), 0).alias("words"), F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD)).alias("lines")))

    def counts(r):
        n_words, chars = F.size(r["words"]).cast("long"), characters(r["words"]).cast("long")
        distinct = F.array_distinct(r["lines"])

        def verdict(good):
            kept_chars = F.aggregate(good, F.lit(0).cast("long"), lambda a, x: a + x["solid"])
            return F.struct(kept_chars.alias("kept_chars"), F.when(kept_chars == chars, whole).otherwise(F.array_join(good["line"], "\n")).alias("cleaned"))

        return F.struct(
            n_words.alias("n_words"), chars.alias("word_chars"), F.regexp_count(whole, F.lit(SYMBOLIC)).cast("long").alias("n_symbols"),
            (F.size(r["lines"]) - F.size(distinct)).cast("long").alias("n_dup_lines"), repeated_words(r["words"]).alias("n_repeat_words"),
            let(F.filter(F.transform(distinct, measured), passes), verdict).alias("lines"),
        )

    return verdicts(first.withColumn(into, let(F.col(into), counts)), into)


def verdicts(counted: DataFrame, into: str) -> DataFrame:
    def both(x):
        base = (x["n_words"] < 50) | (F.lit(100) * x["n_repeat_words"] > F.lit(50) * x["n_words"])
        lost = F.lit(100) * x["lines"]["kept_chars"] < F.lit(KEEP) * x["word_chars"]
        return F.struct(*[x[c].alias(c) for c in COUNTS], base.alias("base_failed"), (~(base | lost)).alias("kept"), x["lines"]["cleaned"].alias("cleaned"))

    return counted.withColumn(into, let(F.col(into), both))


def op7_quality_rules(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", *[f"rules.{c}" for c in (*COUNTS, "base_failed", "kept")])
