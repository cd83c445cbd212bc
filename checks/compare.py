"""Run queries and oracles side by side: ``python -m checks.compare [folder] [query ...]``."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

from checks.oracles import ORACLES, TABLES
from checks.queries import QUERIES
from lastro.session import local_session


def plain(value):
    """One spelling per value, whichever engine it comes from."""
    if isinstance(value, decimal.Decimal):
        return str(value.normalize() if value else decimal.Decimal(0))
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    return None if value is None else str(value)


def bag(rows, names) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, folder: str, name: str) -> list[str]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    wanted = con.execute(ORACLES[name])
    want_names, want = bag(wanted.fetchall(), [c[0] for c in wanted.description])
    df = QUERIES[name](spark, folder)
    got_names, got = bag(df.collect(), df.columns)
    out = []
    if want_names != got_names:
        out.append(f"columns {got_names} instead of {want_names}")
    if want != got:
        out.append(f"rows {sum(got.values())} for {sum(want.values())}")
        out.append(f"  only here:    {list((got - want).items())[:3]}")
        out.append(f"  only in SQL:  {list((want - got).items())[:3]}")
    return out


def main(folder: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            found = differences(spark, folder, name)
        except Exception as error:
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, sep="\n     ", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
