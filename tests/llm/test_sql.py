"""Queries that SQL expresses against that SQL, on the smallest tables."""

import duckdb
import pytest
from checks.compare import bag

from lastro.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    wanted = con.execute(ORACLES[name])
    want = bag(wanted.fetchall(), [c[0] for c in wanted.description])
    got = QUERIES[name](spark, FOLDER)
    assert bag(got.collect(), got.columns) == want


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
