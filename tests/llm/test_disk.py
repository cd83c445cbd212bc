"""What operators leave on disk: only tables that their results are read from, and no shuffle files of stored tables."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lastro.llm import common
from lastro.llm.minhash import linked
from lastro.llm.stages import dedup, remove_passages
from lastro.llm.substring import remove_repeats


@pytest.fixture
def left(tmp_path, monkeypatch):
    """The kinds of tables that are there."""
    made = iter(range(10**6))
    monkeypatch.setattr(common, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{next(made)}")
    return lambda: sorted(p.name.rpartition("-")[0] for p in tmp_path.iterdir())


def texts():
    base = [f"w{i}" for i in range(120)]
    near = [*base[:60], "other", *base[61:]]
    return [(5, " ".join(base)), (3, " ".join(near)), (3, " ".join(f"x{i}" for i in range(90))), (8, " ".join(base)), (9, "short"), (10, None), (None, " ".join(base[:50]))]


def test_near_duplicates_leave_what_is_read(docs, left):
    got = linked(docs(texts()))
    assert [t for t in left() if t not in ("rows", "named")] == ["repeated-ids"]
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(5, 3), (3, 3), (8, 3), (9, 9), (10, 10), (None, None)}


def test_stages_leave_what_is_read(spark, docs, left):
    rows = docs(texts())
    assert dedup(spark, rows, "").count() == 5
    assert "blocks" not in left() and "sets" not in left() and left().count("rowed") == 1
    out = remove_passages(spark, rows, "")
    assert "blocks" not in left() and left().count("changed-texts") == 1
    want = {r.doc_id: r.n_removed for r in remove_repeats(rows.where("doc_id = 9 OR doc_id = 10 OR doc_id = 5 OR doc_id = 8")).collect()}
    assert want == {5: 120, 8: 120, 9: 0, 10: 0}
    got = out.where("doc_id IN (5, 8, 9)").select("doc_id", "text").collect()
    assert {r.doc_id: r.text for r in got} == {5: "", 8: "", 9: "short"}


def test_stored_tables_leave_no_shuffle_files(spark, left):
    held = [Path(p) for p in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {p for h in held for p in h.rglob("shuffle_*.data")}
    before = files()
    out = common.stored(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 1000
    assert spark.conf.get(common.SHUFFLE_CLEANUP, "false") == "false"


@pytest.mark.parametrize("codes", [[], [0], [0, 255, 256, 70_000, 2**31 - 1, 3]])
def test_codes_come_back(codes):
    codes = np.array(codes, np.int32)
    assert common.unpack_codes(common.pack_codes(codes)).tolist() == codes.tolist()
