"""Near-duplicate documents by min-max hashing.

Under each of ``HASHES`` permutations a document keeps the least and the greatest of its shingles' hashes, so one
evaluation gives two values whose agreement has the chance of the Jaccard similarity. ``BANDS`` bands of ``ROWS`` values
propose candidates; links are confirmed on the full shingle sets, at ``percent``. With 32 bands of 5 a pair at 0.85 is
missed with a chance of 8e-9, one at 0.8 with 3e-6.

Equal sets are one class, so copies cost one row each. No bucket lists its pairs:

1. ``HUB_ROUNDS`` times, the members of each bucket that spans several components are compared with one hub, and what
   links becomes one component.
2. What still spans several components is dealt to tiles and bounded by bitmap signatures, pairs of tiles as a whole in
   numpy (``rest``). Copies with so many edits that they link with nothing come out of no tile; the pairs that do are
   compared exactly.

Lower case is A-Z only. Fewer than 5 words are one shingle; without words or with a null text there is none and nothing
is linked. A null ``doc_id`` counts for its class but is never the smallest; a component without any has a null id, and
its rows stay. Rows that share a ``doc_id`` are one document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import PLACE_BITS, blocks, gram_hashes, hash_words, lean, opened, remove, stored, table, with_totals
from lastro.llm.components import components
from lastro.llm.jaccard import signature, tiled

SHINGLE, PERCENT = 5, 85
HASHES, BANDS, ROWS, HUB_ROUNDS = 80, 32, 5, 3


def shingle_sets(row: dict, only: list[int] | None = None) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block, or of those at ``only``."""
    offsets, codes, words = opened(row)
    h = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams, out = gram_hashes(h, SHINGLE), []
    bounds = offsets.tolist()
    for i in range(len(bounds) - 1) if only is None else only:
        a, b = bounds[i], bounds[i + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(gram_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    draw = lambda: rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BANDS`` keys for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = np.empty((2 * HASHES, len(sets)), np.uint64)
    for i, (m, x) in enumerate(zip(*multipliers(), strict=True)):
        # xor, multiply, fold: the order of the results is a permutation's order of the shingles
        y = (flat ^ x) * m
        y ^= y >> np.uint64(31)
        values[i] = np.minimum.reduceat(y, starts)
        values[HASHES + i] = np.maximum.reduceat(y, starts)
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for v in values[b * ROWS : (b + 1) * ROWS]:
            key = (key ^ v) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys[b] = key
    return keys.T


def signatures(batches):
    for batch in batches:
        for row in batch.to_pylist():
            sets = shingle_sets(row)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            first = list({d: i for i, d in reversed(list(enumerate(digests))) if d}.values())
            bands = [None] * len(sets)
            if first:
                for i, keys in zip(first, band_keys([sets[i] for i in first]).view(np.int64).tolist(), strict=True):
                    bands[i] = keys
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(row["block"] << PLACE_BITS) + i for i in range(len(sets))], pa.int64()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["place", "doc_id", "n_shingles", "class", "bands"],
            )


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the nodes' ``pairs(u, v)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("s"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("t"))
    n = F.size(F.array_intersect("s", "t"))
    near = F.lit(100) * n >= F.lit(percent) * (F.size("s") + F.size("t") - n)
    return pairs.join(left, "u").join(right, "v").where(near).select("u", "v")


def of_one_id(signed: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links ``(u, v)`` between the classes of rows that share an id, which are one document; None where ids do not repeat so."""
    rows = signed.where("class is not null AND doc_id is not null")
    several = stored(rows.groupBy("doc_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("doc_id", "lo"), "repeated-ids")
    if several.isEmpty():
        return None
    pairs = rows.join(several, "doc_id").where("class <> lo").select("lo", "class").distinct()
    first = classes.select(F.col("class").alias("lo"), F.col("node").alias("u"))
    return stored(pairs.join(first, "lo").join(classes, "class").select("u", F.col("node").alias("v")), "links")


def linked(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` with ``n_shingles``, ``component_id`` and ``kept``; documents link from ``percent`` on.

    Each table on the way is removed once nothing reads it; two small ones, from which the result is read, stay.
    """
    held = blocks(docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("flag"), "text"), lower=True)
    signed = stored(held.mapInArrow(lean(signatures), "place long, doc_id long, n_shingles long, class binary, bands array<bigint>"), "signatures")
    # a class goes by the place of its first row, since ids may be any number, null or repeated
    classes = signed.where("class is not null").groupBy("class").agg(F.min("place").alias("node"), F.min("doc_id").alias("least"))
    classes = stored(classes, "classes")
    # the first row of a class is the first of its block, so it has the bands
    banded = stored(signed.where("bands is not null").select(F.col("place").alias("node"), "bands").join(classes.select("node"), "node", "left_semi"), "bands")
    rows = stored(signed.select("doc_id", "n_shingles", "class"), "rows")
    remove(signed)

    each = banded.select("node", F.explode("bands").alias("band"))
    shared = stored(each.groupBy("band").count().where("count > 1").select("band"), "shared")
    members = stored(each.join(shared, "band"), "members")
    remove(banded)
    remove(shared)
    wanted = members.select("node").distinct()
    sets = stored(full_sets(held, wanted), "sets")
    remove(held)

    links = of_one_id(rows, classes)
    roots = None if links is None else components(links)
    scratch = [classes] if links is None else [classes, links]
    sized = members.join(sets.select("node", F.size("shingles").alias("n")), "node").withColumn("root", F.col("node"))
    open_members = stored(sized, "members")
    remove(members)
    for i in range(HUB_ROUNDS + 1):
        spread = open_members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("node", F.lit(i)), "node", "root")).alias("hub"))
        spread = stored(spread.where("lo < hi").select("band", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root")), "hubs")
        if spread.isEmpty():
            remove(spread)
            break
        if i < HUB_ROUNDS:
            pairs = open_members.join(spread, "band").where("root <> hub_root").select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v"))
        else:
            pairs = rest(open_members.join(spread.select("band"), "band", "left_semi"), sets, percent)
        pairs = stored(pairs.distinct(), "pairs")
        found = stored(confirmed(pairs, sets, percent), "links")
        remove(pairs)
        scratch.append(found)
        links = found if links is None else links.union(found)
        if roots is not None:
            remove(roots)
        roots = components(links)
        now = open_members.drop("root").join(roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
        now = stored(now.join(spread.select("band"), "band", "left_semi"), "members")
        remove(spread)
        remove(open_members)
        open_members = now
    remove(open_members)
    remove(sets)
    named = classes.select("class", "node", "least", F.col("node").alias("root"))
    if roots is not None:
        named = stored(named.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")
        scratch += [roots, named]
        # only components of several classes have another class's id
        several = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")).where("classes > 1")
        named = named.join(several.drop("classes"), "root", "left").withColumn("least", F.coalesce("component_id", "least"))
    named = stored(named.select("class", F.col("least").alias("component_id"), F.lit(True).alias("known")), "named")
    for done in scratch:
        remove(done)
    out = rows.join(named, "class", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def full_sets(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """The full shingle sets of the places ``wanted(node)``, made again from their blocks."""
    rows = wanted.select(F.shiftright("node", PLACE_BITS).alias("block"), F.lit(0).alias("shard"), F.unhex(F.lpad(F.hex("node"), 16, "0")).alias("total"))

    def make(row, rows):
        if not rows:
            return pa.table({"node": pa.array([], pa.int64()), "shingles": pa.array([], pa.list_(pa.int64()))})
        nodes = [int.from_bytes(t, "big") for _, t in rows]
        sets = shingle_sets(row, [node & ((1 << PLACE_BITS) - 1) for node in nodes])
        flat = np.concatenate(sets).view(np.int64)
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
        return pa.table({"node": pa.array(nodes, pa.int64()), "shingles": lists})

    return with_totals(held, rows, make, "node long, shingles array<bigint>")


def rest(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs ``(u, v)`` of different components that share a bucket and whose signatures leave room for a link.

    The members of a bucket are dealt to tiles, and pairs of tiles compared as a whole (``jaccard.tiled``). A signature has
    one bit per hashed value, the parity of the set's shingles there, so the bits in which two of them differ are no more
    than the shingles in which the sets do.
    """

    def sign(batches):
        for batch in batches:
            bits = [signature(s) for s in lists(batch.column("shingles"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.binary())], names=["node", "bits"])

    open_sets = sets.join(members.select("node").distinct(), "node", "left_semi").select("node", "shingles")
    signed = stored(open_sets.mapInArrow(lean(sign), "node long, bits binary"), "open-signatures")
    marked = members.select(F.col("band").alias("mark"), F.lit(0).alias("at"), "node", F.col("n").cast("long").alias("n"), "root")
    return tiled(marked, signed, percent)


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """The values of each list, without copies."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def op6_minhash_dedup(spark, folder: str) -> DataFrame:
    return linked(table(spark, folder, "documents"))
