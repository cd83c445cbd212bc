"""Documents that are alike from a Jaccard similarity on, over all pairs: an exact join that returns classes of linked documents.

Equal shingle sets are one class, so copies cost one row each. Sets A and B link when ``|A and B|`` is ``percent`` of
``|A or B|`` or more; then they differ in ``room = (100 - percent) (|A| + |B|) / (100 + percent)`` shingles at most, and
``percent`` of the larger size is no more than the smaller one.

1. All shingles are ordered by the number of sets that hold them, rarest first (``common.totals`` counts them). Two sets that
   link share one of the first ``|A| - ceil(percent |A|) + 1`` of each. Those are a set's *marks*; a shingle that no other
   set has marks nothing. Where the first shared mark is at places i and j, the sets differ in ``i + j`` shingles at least.
2. The sets with one mark in common are tried against one of them, the hub: that with the fewest rarer shingles.
   What links becomes one component.
3. In what still spans several components, members are dealt to tiles of about ``TILE`` sets, and pairs of tiles are compared as a whole in
   numpy; pairs within the hub's component are left out. A tile pair holds sets of compatible sizes only.

Pairs are bounded before they are compared: by size, by places, then by signatures. A signature has one bit per hashed
value, the parity of the set's shingles there; its width follows the size band of the set, and a wider one folds to the
narrower. The bits in which two signatures differ are no more than the shingles in which the sets differ, which bounds
the overlap from above. What passes is confirmed by intersecting the sorted arrays.

Lower case is A-Z only. Fewer words than a shingle are one shingle; without words or with a null text there is none and
nothing is linked. A null ``doc_id`` counts for its class but is never the smallest; a component without any has a null
id. Rows that share a ``doc_id`` are one document, whatever their texts.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lastro.llm.common import PLACE_BITS, blocks, gram_hashes, hash_words, merge, opened, remove, shards_for, stored, table, totals, with_totals
from lastro.llm.components import components

SHINGLE, PERCENT = 3, 90
BLOCK_WORDS, SHARD_KEYS, TILE = 400_000, 1_000_000, 512
NARROWEST = 64
SIGNED = "place long, doc_id long, n_shingles long, class binary, n long, bits binary, shingles binary, marks array<struct<mark: long, at: int>>"


def shingle_sets(row: dict, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a block."""
    offsets, codes, words = opened(row)
    h = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams, bounds, out = gram_hashes(h, n), offsets.tolist(), []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(gram_hashes(h[a:b], b - a) if b > a else h[:0])
    return out


def first_sets(row: dict, n: int) -> tuple[list, list, list]:
    """All sets of a block, their digests, and the first document of each digest."""
    sets = shingle_sets(row, n)
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    return sets, digests, list({d: i for i, d in reversed(list(enumerate(digests))) if d}.values())


def counted(row: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    sets, _, first = first_sets(row, n)
    return np.unique(np.concatenate([sets[i] for i in first]), return_counts=True) if first else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def width(n: int) -> int:
    """Bits of the signature of a set of ``n``: the power of two from ``2n`` on. Sets of one width are a size band."""
    return max(NARROWEST, 1 << (2 * n - 1).bit_length())


def signature(s: np.ndarray) -> bytes:
    bits = np.bincount(s.astype(np.int64) & (width(len(s)) - 1), minlength=width(len(s))) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(signatures: list[bytes], bits: int) -> np.ndarray:
    """Signatures of ``bits`` bits or more, a row each, folded to that width."""
    out = np.zeros((len(signatures), bits // 64), np.uint64)
    for i, s in enumerate(signatures):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, bits // 64), axis=0)
    return out


def room(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles sets of these sizes may differ at most; below 0 where the sizes alone exclude a link."""
    most = (100 - percent) * (n + m) // (100 + percent)
    return np.where(percent * np.maximum(n, m) <= 100 * np.minimum(n, m), most, -1)


def room_column(n: Column, m: Column, percent: int) -> Column:
    return F.when(F.lit(percent) * F.greatest(n, m) <= F.lit(100) * F.least(n, m), F.floor(F.lit(100 - percent) * (n + m) / F.lit(100 + percent))).otherwise(-1)


def signed_sets(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """One stored row a document; of equal sets in one block only the first has its signature, its shingles and its marks."""
    held = blocks(docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("flag"), "text"), lower=True, block_words=BLOCK_WORDS)
    shards = shards_for(docs.sparkSession, held.count(), BLOCK_WORDS, SHARD_KEYS)
    sums = totals(held, lambda row: counted(row, shingle), shards)

    def sign(row, rows):
        sets, digests, first = first_sets(row, shingle)
        keys, _ = counted(row, shingle)
        times = merge(keys, shards, rows)
        of_first = set(first)
        out = {c: [] for c in ("n", "bits", "shingles", "marks")}
        for i, s in enumerate(sets):
            marks = None
            if i in of_first:
                held_by = times[np.searchsorted(keys, s)]
                order = np.lexsort((s, held_by))[: len(s) - -(-percent * len(s) // 100) + 1]
                at = np.flatnonzero(held_by[order] > 1)
                marks = [{"mark": m, "at": a} for m, a in zip(s[order][at].view(np.int64).tolist(), at.tolist(), strict=True)]
            out["n"].append(len(s) if marks else None)
            out["bits"].append(signature(s) if marks else None)
            out["shingles"].append(s.tobytes() if marks else None)
            out["marks"].append(marks)
        return pa.table(
            {
                "place": pa.array([(row["block"] << PLACE_BITS) + i for i in range(len(sets))], pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "class": pa.array(digests, pa.binary()), "n": pa.array(out["n"], pa.int64()),
                "bits": pa.array(out["bits"], pa.binary()), "shingles": pa.array(out["shingles"], pa.binary()),
                "marks": pa.array(out["marks"], pa.list_(pa.struct([("mark", pa.int64()), ("at", pa.int32())]))),
            }
        )

    signed = stored(with_totals(held, sums, sign, SIGNED), "signed-sets")
    remove(held)
    return signed


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(u, v)`` that link: bounded by their signatures first, then intersected."""

    def joined(pairs, column):
        left = sets.select(F.col("node").alias("u"), F.col(column).alias("a"))
        right = sets.select(F.col("node").alias("v"), F.col(column).alias("b"))
        return pairs.join(left, "u").join(right, "v")

    def bounded(batches):
        for batch in batches:
            keep = []
            for a, b, n, m in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n", "m")), strict=True):
                x, y = folded([a, b], 8 * min(len(a), len(b)))
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= int(room(n, m, percent)))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    def intersected(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
                n = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * n >= percent * (len(x) + len(y) - n))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sizes = joined(joined(pairs, "n").withColumnsRenamed({"a": "n", "b": "m"}), "bits")
    close = sizes.mapInArrow(bounded, "u long, v long")
    return stored(joined(close, "shingles").mapInArrow(intersected, "u long, v long"), "links")


def with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes(node, ...)`` with ``root``, the least node of its component."""
    return nodes.join(roots.select("node", F.col("root").alias("root_")), "node", "left").withColumn("root", F.coalesce("root_", "node")).drop("root_")


def tiled(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(u, v)`` of different components that share a mark and pass all bounds.

    ``members(mark, at, node, n, root)``. Of a mark, ``others`` are the members outside the hub's component. Each pair of
    tiles with others in one of them at least is one group of about two tiles.
    """
    hub = members.groupBy("mark").agg(F.min(F.struct("at", "node", "root")).alias("hub"), F.max("n").alias("n_max"))
    marked = members.join(hub.select("mark", F.col("hub.root").alias("hub_root"), F.col("hub.at").alias("at_min"), "n_max"), "mark").withColumn("other", F.col("root") != F.col("hub_root"))
    # an other that differs too much from every member, by places alone
    most = F.floor(F.lit(100 - percent) * (F.col("n") + F.col("n_max")) / F.lit(100 + percent))
    marked = stored(marked.where(~F.col("other") | (F.col("at") + F.col("at_min") <= most)), "members")
    counts = marked.groupBy("mark").agg(
        F.count(F.when(F.col("other"), 1)).alias("others"), F.count(F.when(~F.col("other"), 1)).alias("same"), F.min(F.when(F.col("other"), F.col("at"))).alias("at_other"), F.max(F.when(F.col("other"), F.col("n"))).alias("n_other")
    ).where("others > 0 AND others + same > 1")
    near_other = F.col("at") + F.col("at_other") <= F.floor(F.lit(100 - percent) * (F.col("n") + F.col("n_other")) / F.lit(100 + percent))
    open_ = marked.join(counts, "mark").where(F.col("other") | near_other)
    tiles = lambda c: F.ceil(F.col(c) / TILE)
    own = F.when(F.col("other"), F.pmod(F.xxhash64("node", "mark"), tiles("others"))).otherwise(-1 - F.pmod(F.xxhash64("node", "mark"), F.greatest(tiles("same"), F.lit(1))))
    against = F.sequence(F.lit(0).cast("long"), tiles("others") - 1)
    # tiles of the hub's component have negative numbers, and meet tiles of others only
    against = F.when(F.col("other") & (F.col("same") > 0), F.concat(F.sequence(-tiles("same"), F.lit(-1).cast("long")), against)).otherwise(against)
    dealt = open_.withColumn("own", own).withColumn("against", F.explode(against))
    dealt = dealt.select("mark", "at", "node", "n", "root", "other", F.least("own", "against").alias("x"), F.greatest("own", "against").alias("y"), (F.col("own") <= F.col("against")).alias("first"))
    dealt = dealt.join(sets.select("node", "bits"), "node")

    def compare(group: pa.Table) -> pa.Table:
        at, node, n, root = (group.column(c).to_numpy() for c in ("at", "node", "n", "root"))
        bits = group.column("bits").to_pylist()
        widths = np.array([8 * len(b) for b in bits])
        first = group.column("first").to_numpy()
        one_tile = group.column("x")[0] == group.column("y")[0]
        left = np.flatnonzero(first)
        right = left if one_tile else np.flatnonzero(~first)
        out_u, out_v = [], []
        for w, v in itertools.product(np.unique(widths[left]), np.unique(widths[right])):
            narrow = int(min(w, v))
            ours, theirs = left[widths[left] == w], right[widths[right] == v]
            x, y = folded([bits[i] for i in ours], narrow), folded([bits[j] for j in theirs], narrow)
            for i, xi in zip(ours.tolist(), x, strict=True):
                most = room(n[i], n[theirs], percent)
                good = np.flatnonzero((root[theirs] != root[i]) & (at[theirs] + at[i] <= most) & (theirs > (i if one_tile else -1)))
                if len(good):
                    near = theirs[good[np.bitwise_count(xi ^ y[good]).sum(1) <= most[good]]]
                    out_u.append(np.minimum(node[i], node[near]))
                    out_v.append(np.maximum(node[i], node[near]))
        none = [np.zeros(0, np.int64)]
        return pa.table({"u": pa.array(np.concatenate(out_u or none), pa.int64()), "v": pa.array(np.concatenate(out_v or none), pa.int64())})

    return dealt.groupBy("mark", "x", "y").applyInArrow(compare, "u long, v long").distinct()


def jaccard_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` with ``n_shingles`` and ``component_id``, the smallest id that links reach."""
    signed = signed_sets(docs, shingle, percent)
    first = signed.where("class is not null").groupBy("class").agg(F.min("place").alias("node"))
    first = stored(first, "classes")
    sets = signed.where("marks is not null AND n is not null").join(first.select(F.col("node").alias("place")), "place", "left_semi")
    sets = stored(sets.select(F.col("place").alias("node"), "n", "bits", "shingles", "marks"), "sets")
    members = sets.select("node", "n", F.explode("marks").alias("m")).select("node", "n", F.col("m.mark").alias("mark"), F.col("m.at").alias("at"))
    hubs = members.groupBy("mark").agg(F.count("*").alias("sets"), F.min(F.struct("at", "node", "n")).alias("hub")).where("sets > 1")
    members = stored(members.join(hubs.select("mark", "hub"), "mark"), "marked")
    hub = F.col("hub")
    tried = members.where((F.col("node") != hub["node"]) & (F.col("at") + hub["at"] <= room_column(F.col("n"), hub["n"], percent)))
    pairs = stored(tried.select(F.least("node", hub["node"]).alias("u"), F.greatest("node", hub["node"]).alias("v")).distinct(), "pairs")
    # rows that share an id are one document
    of_row = signed.where("class is not null").select("doc_id", "class").join(first, "class")
    per_id = of_row.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    shared = of_row.join(per_id, "doc_id").where("node <> lo").select(F.col("lo").alias("u"), F.col("node").alias("v"))
    links = stored(confirmed(pairs, sets, percent).union(shared), "all-links")
    roots = components(links)
    more = confirmed(tiled(with_roots(members.drop("hub"), roots), sets, percent), sets, percent)
    if not more.isEmpty():
        roots = components(stored(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more), "all-links"))
    of_class = stored(with_roots(first, roots).select("class", "root"), "roots")
    least = signed.where("class is not null").select("class", "doc_id").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    least = of_class.join(least, "class").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(least, "root").select("class", "component_id", F.lit(True).alias("known"))
    out = signed.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_ngram_jaccard(spark, folder: str) -> DataFrame:
    return jaccard_classes(table(spark, folder, "documents").select("doc_id", "text"))


JACCARD_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i : i + {SHINGLE} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS x FROM d),
c AS (SELECT x, min(r) AS c, len(x) AS n FROM s WHERE len(x) > 0 GROUP BY x),
e AS (SELECT c, n, unnest(x) AS g FROM c),
p AS (SELECT a.c AS a, b.c AS b, a.n AS n, b.n AS m, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.c < b.c AND {PERCENT} * greatest(a.n, b.n) <= 100 * least(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= {PERCENT} * (n + m - i)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(c, t) AS (SELECT c, c FROM c UNION SELECT reach.c, both_ways.b FROM reach JOIN both_ways ON reach.t = both_ways.a),
rows_ AS (SELECT s.doc_id, len(s.x) AS n, c.c FROM s LEFT JOIN c ON c.x = s.x AND len(s.x) > 0),
ids AS (SELECT c, min(doc_id) AS d FROM rows_ WHERE c IS NOT NULL GROUP BY c),
best AS (SELECT reach.c, min(ids.d) AS d FROM reach JOIN ids ON ids.c = reach.t GROUP BY reach.c)
SELECT rows_.doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN rows_.c IS NULL THEN rows_.doc_id ELSE best.d END AS component_id FROM rows_ LEFT JOIN best USING (c)
"""
