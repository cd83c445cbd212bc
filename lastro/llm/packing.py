"""Packing documents into fixed windows: concatenate and cut.

Two passes. The first encodes each document, closes it with the end id, and writes ids with the document's place in its
partition; partition totals then give each partition's place in the whole stream by prefix sums. The second cuts every
document where the stream passes a multiple of the window. A piece that touches a cut is a boundary record
(``opens_inside``: the document began in an earlier window; ``goes_on``: it ends in a later one).

All windows but the last are full, so the padding of the whole corpus is less than one window. A null text is empty: its
only id is the end. Repeated rows are packed each. The order is that of the stored first pass, so a recomputed task
cuts at the same places. Only one row per partition, of the stage that wrote the ids, is summed in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lastro.llm.common import lean, slices, stored, table
from lastro.llm.token_counts import encoder

WINDOW = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, opens_inside boolean, goes_on boolean"


def pack_documents(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, spaces: bool = False, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; ``with_ids`` adds the ids themselves, little-endian unsigned 32-bit."""

    def encode(batches):
        part, done, tokens = TaskContext.get().partitionId(), 0, encoder(path, spaces)
        end = np.array([end_id], np.uint32).tobytes()
        for batch in slices(batches, "text"):
            offsets, codes, ids = tokens(batch.column("text"))
            # each document's end is one more piece, and its ids are a run of the slice's
            codes = np.insert(codes, offsets[1:], len(ids))
            stream = pa.array([*ids, end], pa.large_binary()).take(pa.array(codes))
            bounds = np.frombuffer(stream.buffers()[1], np.int64)[stream.offset :][offsets + np.arange(len(offsets))]
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(bounds), stream.buffers()[2]])
            lengths = np.diff(bounds) // 4
            starts = done + np.cumsum(lengths) - lengths
            done += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(texts), pa.int32()), batch.column("doc_id"), pa.array(starts), pa.array(lengths), texts.cast(pa.binary())],
                names=["part", "doc_id", "at", "n", "ids"],
            )

    def cut(batches):
        for batch in slices(batches, "ids"):
            out = {k: [] for k in ("doc_id", "start", "length", "crc", "total", "sequence", "offset", "opens", "goes", "ids")}
            for doc, at, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                view, start = memoryview(ids), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    data = view[4 * start : 4 * (start + length)]
                    for k, x in zip(out, (doc, start, length, zlib.crc32(data), n, sequence, offset, start > 0, start + length < n, bytes(data) if with_ids else None), strict=True):
                        out[k].append(x)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()]
            columns = [pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)][: 10 if with_ids else 9]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in (PIECES + ", ids binary" * with_ids).split(", ")])

    encoded = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(encode), "part int, doc_id long, at long, n long, ids binary"), "packing-ids")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # one row per task of the stage before: small whatever the corpus
    placed = encoded.join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("at"), "n", "ids")
    return placed.mapInArrow(lean(cut), PIECES + ", ids binary" * with_ids)


def op8_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
