"""What several operators share: reading, scratch tables, words in Arrow arrays, and counts by key over all blocks.

A *block* is a run of documents of one task, about ``BLOCK_WORDS`` words long, held as one row: document ids, word
offsets, word codes and the distinct words. Blocks are written to the shared folder once, so that
their numbers stay valid when executors are lost. ``totals`` sums counts of 64-bit keys over all blocks: each block
sends one packed row per shard, so a frequent key travels once per block whatever its number of occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lastro.session import drop_folder, shared_folder

BLOCK_WORDS = 1_000_000
SLICE_BYTES, SLICE_ROWS = 8 << 20, 20_000
# A block's number has the task's above 16 bits; a document's place in all blocks has the block's above 17.
TASK_BITS, PLACE_BITS, BLOCK_ROWS = 16, 17, 1 << 16
BLOCK_SCHEMA = "block long, doc_ids array<bigint>, flags array<int>, offsets binary, codes binary, words binary"
NEWLINE = b"\n"
MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Makes Spark delete a query's shuffle files when the query ends, instead of when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and fixes what depends on task numbers.

    What the write shuffled is deleted as it ends, since the table stands for it from then on.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, purpose), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def remove(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    drop_folder(df.sparkSession, df.stored_at)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return what Arrow's pool holds unused: workers wait beside the executor for the next stage, with the most they ever had."""
    pa.default_memory_pool().release_unused()


def lean(work: Callable) -> Callable:
    """``work`` for ``mapInArrow``, which gives back memory when the task ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice holds about ``limit`` bytes of ``column``, or a single longer value, and at most ``SLICE_ROWS`` rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start] - sizes[start]
            stop = min(max(start + 1, int(np.searchsorted(ends, base + limit, side="right"))), start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words and all words; words are runs other than space and 09-0D, null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(flat), 0)
    if pc.any(empty).as_py():
        keep = ~empty.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(keep))
    return np.concatenate([[0], np.cumsum(counts)]), flat


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, a code per word, and the distinct words by code; ``lower`` folds A-Z only."""
    offsets, flat = split_words(pc.ascii_lower(texts) if lower else texts)
    coded = flat.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary


def strings(words: pa.Array) -> np.ndarray:
    """As Python strings; far quicker than ``to_pylist``."""
    return words.cast(pa.large_string()).to_numpy(zero_copy_only=False)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each place of ``h``, built by doubling; shorter by ``n - 1``."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    powers, out, done = {1: h}, None, 0
    size = 1
    while 2 * size <= n:
        x = powers[size]
        powers[2 * size] = mix(x[:-size], x[size:])
        size *= 2
    for size in sorted(powers, reverse=True):
        if n & size:
            x = powers[size][done:]
            out = x if out is None else mix(out[: len(x)], x[: len(out)])
            done += size
    return out[: len(h) - n + 1]


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """True for each word at which ``n`` words of its own document start; as long as ``gram_hashes``."""
    total = int(offsets[-1])
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(total)
    return (left >= n)[: max(0, total - n + 1)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of the ordered pair; both sides are hashes already."""
    x = a * MIX + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype=kind)


def pack_codes(codes: np.ndarray) -> bytes:
    """Word codes byte plane by byte plane: the leading bytes are mostly zero."""
    return pack(codes.view(np.uint8).reshape(-1, 4).T)


def unpack_codes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as their gaps, byte plane by byte plane: the leading bytes of gaps are mostly zero."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return pack(gaps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(b: bytes) -> np.ndarray:
    planes = unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def blocks(docs: DataFrame, lower: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs(doc_id, flag, text)`` as stored blocks; every row of ``docs`` lies in exactly one."""

    def build(batches):
        n, base = 0, TaskContext.get().partitionId() << TASK_BITS
        held, words = [], 0

        def row():
            nonlocal n, held, words
            texts = pa.chunked_array([b.column("text").cast(pa.large_string()) for b in held]).combine_chunks()
            ids = [x for b in held for x in b.column("doc_id").to_pylist()]
            flags = [x for b in held for x in b.column("flag").to_pylist()]
            offsets, codes, distinct = word_codes(texts, lower)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([base + n], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.int32())),
                    pa.array([pack(offsets)], pa.binary()), pa.array([pack_codes(codes)], pa.binary()), pa.array([zstandard.compress(NEWLINE.join(x.encode() for x in strings(distinct)), 3)], pa.binary()),
                ],
                names=["block", "doc_ids", "flags", "offsets", "codes", "words"],
            )
            n, held, words = n + 1, [], 0
            return out

        for part in slices(batches, "text", block_words * 6):
            held.append(part)
            words += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if words >= block_words * 6 or sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield row()
        if held:
            yield row()

    return stored(docs.select("doc_id", "flag", "text").mapInArrow(lean(build), BLOCK_SCHEMA), "blocks")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word offsets by document, word codes and distinct words, in UTF-8, of a block's row."""
    return unpack(row["offsets"], np.int64), unpack_codes(row["codes"]), zstandard.decompress(row["words"]).split(NEWLINE)


def shards_for(spark: SparkSession, n_blocks: int, keys_per_block: int = BLOCK_WORDS, keys_per_shard: int = 4_000_000) -> int:
    """Enough shards that one holds a few million keys whatever the input's size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks * keys_per_block // keys_per_shard + 1)


def totals(
    frame: DataFrame, keys: Callable[[dict], tuple[np.ndarray, np.ndarray]], shards: int, repeated: bool = False, least: int = 2, bits: int = 64
) -> DataFrame:
    """Sums over all blocks of the counts of each block's keys: ``(block, shard, total, n_keys, n_sum)``.

    ``keys(row)`` gives a block's distinct keys, sorted, with counts. ``total`` packs the sums in the order of those
    keys within the shard; ``merge`` puts the shards together. ``n_keys`` and ``n_sum`` are the shard's number of even
    keys with a positive sum and their sum, in one row of the shard. With ``repeated``, ``total`` holds instead those
    of the block's keys whose sum is ``least`` or more. Keys of less than 64 ``bits`` are dealt to shards by ranges.
    """

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, c = keys(row)
                where = shard_of(k, shards, bits)
                order = np.argsort(where, kind="stable")
                k, c, where = k[order], c[order].astype(np.uint32), where[order]
                # only the shards that have keys of this block
                starts = np.flatnonzero(np.diff(where, prepend=-1))
                out = []
                for s, a, b in zip(where[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(k)], strict=False):
                    out.append((s, pack_sorted(k[a:b]), pack_codes(c[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()),
                        pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary()),
                    ],
                    names=["block", "shard", "ks", "cs"],
                )

    def reduce(group: pa.Table) -> pa.Table:
        ks = [unpack_sorted(x) for x in group.column("ks").to_pylist()]
        cs = [unpack_codes(x).view(np.uint32) for x in group.column("cs").to_pylist()]
        distinct, back = np.unique(np.concatenate(ks), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate(cs), minlength=len(distinct)).astype(np.int64)
        even = sums[(distinct & np.uint64(1)) == 0]
        out, at = [], 0
        for k in ks:
            total = sums[back[at : at + len(k)]]
            out.append(pack_sorted(k[total >= least]) if repeated else pack(total))
            at += len(k)
        first = [1] + [0] * (len(ks) - 1)
        return pa.table(
            {
                "block": group.column("block"), "shard": group.column("shard"), "total": pa.array(out, pa.binary()),
                "n_keys": pa.array([int((even > 0).sum()) * f for f in first], pa.int64()), "n_sum": pa.array([int(even.sum()) * f for f in first], pa.int64()),
            }
        )

    sent = frame.mapInArrow(lean(send), "block long, shard int, ks binary, cs binary")
    return sent.groupBy("shard").applyInArrow(reduce, "block long, shard int, total binary, n_keys long, n_sum long")


def shard_of(keys: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    """Keys of less than 64 bits by ranges: a block's gaps within a shard stay as small as in the whole, however many shards there are."""
    if bits < 64:
        return ((keys >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    return ((keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def merge(keys: np.ndarray, shards: int, rows: list[tuple[int, bytes]]) -> np.ndarray:
    """The totals of a block in the order of its sorted keys, from its ``(shard, total)`` rows."""
    order = np.argsort(shard_of(keys, shards), kind="stable")
    out = np.zeros(len(keys), np.int64)
    if rows:
        out[order] = np.concatenate([unpack(t, np.int64) for _, t in sorted(rows, key=lambda x: x[0])])
    return out


def found(rows: list[tuple[int, bytes]]) -> np.ndarray:
    """The repeated keys of a block, sorted."""
    return np.sort(np.concatenate([unpack_sorted(t) for _, t in rows])) if rows else np.zeros(0, np.uint64)


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is one of the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x


def with_totals(frame: DataFrame, sums: DataFrame, work: Callable[[dict, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """Bring the totals back to their blocks: ``work(block row, (shard, total) rows)`` gives a table."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = list(zip(right.column("shard").to_pylist(), right.column("total").to_pylist(), strict=True))
        out = pa.concat_tables([work(row, rows) for row in left.to_pylist()])
        give_back()
        return out

    return frame.groupBy("block").cogroup(sums.select("block", "shard", "total").groupBy("block")).applyInArrow(both, schema)


def number(df: DataFrame, **sums) -> tuple:
    """A few sums on the driver."""
    row = df.agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(k) for k, e in sums.items()]).first()
    return tuple(row)
