"""The stages of the corpus pipeline: each applies one operator to all documents and returns their columns.

``docs`` needs ``doc_id``, ``text`` and ``source``; other columns pass through, whatever their names. ``n_chars``, where
it is a column, follows the text. Rows are told apart by a number of their own, so null and repeated ids do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import fresh, stored
from lastro.llm.minhash import linked
from lastro.llm.mixing import mixed
from lastro.llm.packing import pack_documents
from lastro.llm.quality import WORD, judged
from lastro.llm.substring import changed_texts


def with_text(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``docs`` with another text, as the columns of documents."""
    changed = {"text": text} | ({"n_chars": F.length(text).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in columns else {})
    return docs.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in columns])


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failing lines."""
    name = fresh(docs, "rules")
    # A plain filter would be pushed below the rules, and judge every text a second time.
    kept = F.explode_outer(F.filter(F.array(F.col(name)), lambda r: r["kept"]))
    one = judged(docs, into=name).select(*[f"`{c}`" for c in docs.columns], kept.alias(name)).where(F.col(name).isNotNull())
    return with_text(one, docs.columns, F.col(name)["cleaned"])


def dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, the first of those that share it."""
    name = fresh(docs, "row")
    rowed = stored(docs.withColumn(name, F.monotonically_increasing_id()), "rowed")
    groups = linked(rowed.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias(name), "component_id")
    ids = rowed.select(name, F.col("doc_id").isNull().alias("without"), "doc_id").join(groups, name)
    kept = ids.groupBy("component_id").agg(F.min(F.struct("without", "doc_id", name)).alias("first")).select(F.col("first")[name].alias(name))
    return rowed.join(kept, name, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def remove_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of repeated windows; texts that lose nothing stay as they are."""
    name, kept_name = fresh(docs, "row"), fresh(docs, "kept")
    rowed = stored(docs.withColumn(name, F.monotonically_increasing_id()), "rowed")
    changed = changed_texts(rowed.select(F.col(name).alias("doc_id"), "text"))
    joined = rowed.join(changed.select(F.col("doc_id").alias(name), F.col("kept").alias(kept_name)), name, "left")
    return with_text(joined, docs.columns, F.coalesce(kept_name, "text"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole pass over a document and for each part of it that the mix takes."""
    taken = mixed(docs.select("doc_id", "text", "source", F.struct(*[f"`{c}`" for c in docs.columns]).alias("document")), ["document"])
    words = F.regexp_extract_all(F.col("document")["text"], F.lit(WORD), 0)
    part = lambda a, b: F.when(F.col(b) > F.col(a), F.array_join(F.slice(words, (F.col(a) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int")), " "))
    texts = F.concat(F.array_repeat(F.col("document")["text"], F.col("passes").cast("int")), F.filter(F.array(part("from_1", "to_1"), part("from_2", "to_2")), lambda t: t.isNotNull()))
    rows = taken.where("taken > 0").select("document", F.explode(texts).alias("new_text"))
    name = fresh(docs, "new_text")
    return with_text(rows.select("document.*", F.col("new_text").alias(name)), docs.columns, F.col(name))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into windows."""
    import public_tokenizers

    return pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
