"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in order of their names, null last, weigh 5, 2, 1 and so on, and share the whole size. A target stops at
``TIMES`` times its source's size; the excess goes to the others by weight until none is above. Targets then become
integer quotas of blocks of ``BLOCK`` words: each next block goes to the highest quotient target / (2 k + 1), where k
is what the source has. Each source is dealt over shards by a digest of the document's id, in numbers that follow its
size, and its blocks go to its shards in the same way. Within a shard documents lie in seeded order on a line; the quota
takes whole passes over it and, for the rest, blocks in a row from a seeded one on.

Only built-in functions. Quotients are not dealt one by one: a divisor that gives too few blocks by at most the number of
sources is known, and only the few quotients beyond it are ranked. Windows sort the documents of one shard; the number of
shards is a parameter that grows with the cluster, and a source of a third of all words has a third of them.

Null texts and texts without words have size 0 and are never taken. Rows that repeat lie side by side. Equal quotients go to
the earlier source or shard. A null ``doc_id`` counts as the text ''. Reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lastro.llm.common import stored, table
from lastro.llm.quality import WORD

WEIGHTS, TIMES, BLOCK, SHARDS, SEED = (5, 2, 1), 3, 64, 1024, "mix-1"


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def number_of(digest: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """``(source, number, source_size, target)`` of each source of ``sized(source, size)``."""
    everything, rising = Window.partitionBy(), Window.orderBy("ratio", "number")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("number") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", weight)
    big = "decimal(38,0)"
    per = per.withColumns({"ratio": F.col("source_size") / F.col("weight"), "cap": (F.lit(TIMES) * F.col("source_size")).cast(big), "total": F.sum("source_size").over(everything).cast(big)})
    # in the order in which they reach their caps: what those before have taken, and the weight from here on
    per = per.withColumns({
        "taken": F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)),
        "left": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("taken", F.coalesce("taken", F.lit(0).cast(big)))
    per = per.withColumn("capped", F.col("cap").cast("double") * F.col("left") <= (F.col("total") - F.col("taken")).cast("double") * F.col("weight"))
    rest = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0).cast(big))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(free.cast("double") * F.col("weight") / rest)
    return per.select("source", "number", "source_size", target.alias("target"))


def apportion(shares: DataFrame, by: list[str], order: str, share: str, seats: str) -> DataFrame:
    """Deal ``seats`` among the rows of each group ``by`` to the highest quotients of ``share``: adds ``quota``."""
    group = Window.partitionBy(*by)
    held = shares.where(F.col(share) > 0)
    total, n = F.sum(share).over(group), F.count("*").over(group)
    held = held.withColumns({"all_": total, "n_": n})
    # dividing by this gives at most the wanted number of seats, and too few by n at most
    divisor = F.col("all_") / (F.col(seats) - F.col("n_") / 2)
    held = held.withColumn("base_", F.when(F.col(seats) * 2 > F.col("n_"), F.floor(F.col(share) / divisor + F.lit(0.5))).otherwise(F.lit(0)).cast("long"))
    held = held.withColumn("missing_", F.greatest(F.col(seats) - F.sum("base_").over(group), F.lit(0)))
    more = F.least(F.col("missing_"), F.floor((F.col("missing_") + F.col("n_")) * F.col(share) / F.col("all_")) + 2)
    asked = held.select(*by, order, share, "base_", "missing_", F.explode(F.sequence(F.lit(0), more.cast("int"))).alias("k_"))
    quotient = F.col(share) / (2 * (F.col("base_") + F.col("k_") - 1) + 1)
    # k_ = 0 stands for the row itself, so that rows without a further seat stay
    real = F.col("k_") > 0
    rank = F.row_number().over(Window.partitionBy(*by, real).orderBy(F.desc(quotient), order))
    won = asked.withColumn("won_", (real & (rank <= F.col("missing_"))).cast("long"))
    return won.groupBy(*by, order).agg((F.first("base_") + F.sum("won_")).alias("quota"))


def mixed(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """``docs(doc_id, text, source)`` with size, source_size, target, and what the mix takes of each document.

    ``taken`` words are ``passes`` whole copies and the words ``[from_1, to_1)`` and ``[from_2, to_2)`` once more.
    ``carry`` names further columns to keep.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), seeded(F.col("doc_id")).alias("key"), *carry), "mix-sizes")
    per = targets(sized)
    total = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumns({"all": F.lit(0), "blocks": F.ceil(total / BLOCK), "shards": F.greatest(F.ceil(F.lit(SHARDS) * F.col("source_size") / total), F.lit(1))})
    per = stored(per, "mix-targets")
    quotas = apportion(per, ["all"], "number", "target", "blocks").select("number", F.col("quota").alias("source_quota"))
    per = stored(per.join(quotas, "number", "left").select("source", "number", "source_size", "target", "shards", F.coalesce("source_quota", F.lit(0)).alias("source_quota")), "mix-quotas")

    named = per.withColumnRenamed("source", "name")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("shard", F.pmod(number_of(F.col("key")), F.coalesce("shards", F.lit(1))))
    shards = placed.groupBy("number", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = stored(shards, "mix-shards")
    dealt = apportion(shards, ["number"], "shard", "shard_size", "source_quota")
    # words, not blocks: the last block of a shard may be short, and no pass beyond the allowed ones is made
    quota = F.least(F.coalesce("quota", F.lit(0)) * BLOCK, F.lit(TIMES) * F.col("shard_size"))
    start = F.pmod(number_of(seeded(F.col("number"), F.col("shard"))), F.greatest(F.ceil(F.col("shard_size") / BLOCK), F.lit(1))) * BLOCK
    plan = shards.join(dealt, ["number", "shard"], "left").select("number", "shard", "shard_size", quota.alias("quota"), start.alias("start"))
    placed = placed.join(stored(plan, "mix-plan"), ["number", "shard"])

    line = Window.partitionBy("number", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("begin", F.sum("size").over(line) - F.col("size"))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("rest", F.col("quota") - F.col("passes") * F.col("shard_size"))

    def within(low, high):
        """The document's words in the stretch [low, high) of the line."""
        a = F.least(F.greatest(low - F.col("begin"), F.lit(0)), F.col("size"))
        return a, F.greatest(F.least(high - F.col("begin"), F.col("size")), a)

    end = F.col("start") + F.col("rest")
    (from_1, to_1), (from_2, to_2) = within(F.col("start"), F.least(end, F.col("shard_size"))), within(F.lit(0), end - F.col("shard_size"))
    placed = placed.withColumns({"from_1": from_1, "to_1": to_1, "from_2": from_2, "to_2": to_2})
    taken = F.col("passes") * F.col("size") + F.col("to_1") - F.col("from_1") + F.col("to_2") - F.col("from_2")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "passes", "from_1", "to_1", "from_2", "to_2", *carry)


def op5_source_mix(spark, folder: str) -> DataFrame:
    return mixed(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS number FROM s0),
s2 AS (SELECT *, CAST(list_extract([5, 2, 1], CAST((number - 1) % 3 + 1 AS INT)) AS BIGINT) AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM s2),
s4 AS (SELECT *, 3 * source_size * left_ <= (total - before) * weight AS capped FROM s3),
s AS (
  SELECT source, number, source_size, total,
    CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE)
      ELSE CAST(total - coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0) AS DOUBLE) * weight / CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS DOUBLE) END AS target,
    greatest(CAST(ceil(CAST({SHARDS} * source_size AS DOUBLE) / total) AS BIGINT), 1) AS shards FROM s4),
seats AS (
  SELECT number, count(*) AS source_quota FROM (
    SELECT number, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, number) AS r, ceil(total / {BLOCK}.0) AS h
    FROM s, (SELECT unnest(generate_series(0, CAST((SELECT ceil(max(total) / {BLOCK}.0) FROM s) AS BIGINT))) AS k) WHERE target > 0)
  WHERE r <= h GROUP BY number),
p AS (
  SELECT d.*, s.number, s.source_size, s.target, coalesce(seats.source_quota, 0) AS source_quota, CAST('0x' || substr(key, 1, 8) AS BIGINT) % coalesce(shards, 1) AS shard
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN seats ON seats.number = s.number),
sh AS (SELECT number, shard, CAST(sum(size) AS BIGINT) AS shard_size, first(source_quota) AS source_quota FROM p GROUP BY number, shard),
dealt AS (
  SELECT number, shard, count(*) AS quota FROM (
    SELECT number, shard, source_quota, row_number() OVER (PARTITION BY number ORDER BY shard_size / (2 * k + 1) DESC, shard) AS r
    FROM (SELECT *, unnest(generate_series(0, source_quota)) AS k FROM sh WHERE shard_size > 0))
  WHERE r <= source_quota GROUP BY number, shard),
plan AS (
  SELECT number, shard, shard_size, least(coalesce(quota, 0) * {BLOCK}, 3 * shard_size) AS quota,
    {BLOCK} * (CAST('0x' || substr(md5('{SEED}|' || number || '|' || shard), 1, 8) AS BIGINT) % greatest(CAST(ceil(shard_size / {BLOCK}.0) AS BIGINT), 1)) AS start
  FROM sh LEFT JOIN dealt USING (number, shard)),
q AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, start, shard_size, CASE WHEN shard_size > 0 THEN quota // shard_size ELSE 0 END AS passes, quota,
    CAST(sum(size) OVER (PARTITION BY number, shard ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a FROM p JOIN plan USING (number, shard)),
e AS (SELECT *, start + quota - passes * shard_size AS stop, a + size AS b FROM q)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(least(b, stop, shard_size) - greatest(a, start), 0) + greatest(least(b, stop - shard_size) - a, 0) AS BIGINT) AS taken FROM e
"""
