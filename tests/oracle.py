"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


#: DuckDB's type names as Spark's.
KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return v


def _order(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def database() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(SF_DIR)):
        path = os.path.join(SF_DIR, name)
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def check(spark, query, sql: str | None) -> int:
    df = query(spark, SF_DIR)
    names = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*names).collect()), key=_order)
    if sql is not None:
        result = database().execute(sql)
        have = [c[0] for c in result.description]
        assert sorted(have) == names
        kinds = {c[0]: str(c[1]) for c in result.description}
        assert {n: KINDS.get(kinds[n], kinds[n]) for n in names} == {n: t for n, t in df.dtypes}, "types differ"
        at = [have.index(n) for n in names]
        want = sorted((tuple(_plain(r[i]) for i in at) for r in result.fetchall()), key=_order)
        assert got == want
    return len(got)
