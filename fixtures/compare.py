"""Run queries on Spark and their twins on DuckDB and compare names, types and all values.

    python -m fixtures.compare [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa

from .oracle import oracle_sql
from .queries import QUERIES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def _kind(t: pa.DataType) -> str:
    return "string" if pa.types.is_large_string(t) or pa.types.is_string(t) else str(t)


def _rows(table: pa.Table) -> Counter:
    names = sorted(table.column_names)
    # -0.0 and 0.0 are one value.
    cols = [[v + 0.0 if isinstance(v, float) else v for v in table[n].to_pylist()] for n in names]
    return Counter(zip(*cols))


def differences(ours: pa.Table, theirs: pa.Table) -> list[str]:
    out = []
    a = {f.name: _kind(f.type) for f in ours.schema}
    b = {f.name: _kind(f.type) for f in theirs.schema}
    if a != b:
        out.append(f"schema: {sorted(set(a.items()) ^ set(b.items()))}")
    if set(a) == set(b):
        mine, other = _rows(ours), _rows(theirs)
        if mine != other:
            out.append(f"rows: {ours.num_rows} against {theirs.num_rows}; only ours "
                       f"{list((mine - other).items())[:3]}; only theirs "
                       f"{list((other - mine).items())[:3]}; columns {sorted(a)}")
    return out


def main(sf_dir: str = "/root/testdata/sf0.01", *prefixes: str) -> int:
    from cashweave.session import local_session
    spark, con, sql = local_session(8), duck(sf_dir), oracle_sql()
    failed = 0
    for name, run in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            start = time.time()
            ours = run(spark, sf_dir).toArrow()
            mid = time.time()
            bad = (differences(ours, con.execute(sql[name]).to_arrow_table()) if name in sql
                   else ["no oracle"])
        except Exception as err:  # report and go on with the next query
            bad, mid = [f"{type(err).__name__}: {str(err)[:600]}"], time.time()
            ours = None
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name:40} rows={ours.num_rows if ours else '-'} "
              f"spark={mid - start:.1f}s duck={time.time() - mid:.1f}s", *bad, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
