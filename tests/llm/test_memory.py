"""What tasks keep of memory when they end: workers wait beside the executor for the next Python stage."""

import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lastro.llm import common
from lastro.llm.packing import pack_documents


def held_mb() -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_tasks_give_back_what_arrow_holds():
    def work(batches):
        for batch in batches:
            parts = [pa.array(np.full(20_000, i)).take(pa.array(np.arange(20_000))) for i in range(1000)]
            assert len(parts) == 1000
            yield batch

    before = held_mb()
    out = list(common.lean(work)([pa.record_batch({"k": [1]})]))
    assert len(out) == 1 and held_mb() < before + 60


@pytest.mark.parametrize("fails", [True, False])
def test_tasks_give_back_in_any_case(monkeypatch, fails):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))

    def work(batches):
        yield from batches
        if fails:
            raise ValueError("bad row")

    if fails:
        with pytest.raises(ValueError, match="bad row"):
            list(common.lean(work)([1, 2]))
    else:
        assert list(common.lean(work)([1, 2])) == [1, 2]
    assert done == [1]


def test_ids_of_documents_without_words(docs):
    """Documents are runs of one array of ids, closed by the end id; empty ones at the ends and in a row."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = [(1, None), (2, ""), (3, "some words, some more"), (4, " \n "), (5, None), (6, "some"), (None, "naïve 日本 words " * 40), (8, "")]
    got = {r.doc_id: r for r in pack_documents(docs(rows).coalesce(1), path, 2, window=1 << 20, with_ids=True).collect()}
    assert len(got) == len(rows)
    at = 0
    for doc_id, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)
        r = got[doc_id]
        assert (bytes(r.ids), r.doc_tokens, r.offset, r.ids_crc32) == (ids.tobytes(), len(ids), at, zlib.crc32(ids.tobytes()))
        at += len(ids)
