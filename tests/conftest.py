"""One session for all tests, and a comparison of a query with its SQL in another engine."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

from engramlake.session import session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("local[4]", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")), spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    if isinstance(x, bool) or x is None:
        return x
    if hasattr(x, "as_tuple"):
        return round(float(x), 5)
    return x if isinstance(x, int) else str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def close(a, b) -> bool:
    number = isinstance(a, int | float) and isinstance(b, int | float)
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-5) if number else a == b


def assert_same(df, con, sql: str) -> None:
    got, rel = df.collect(), con.execute(sql)
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    a, b = rows_of(df.columns, got), rows_of(columns, rel.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(map(close, x, y)), (x, y)
