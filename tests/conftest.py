from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from loomdex.session import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same(spark, data, duck):
    """Compares a query with its SQL."""

    def check(query, sql: str) -> None:
        df = query(spark, data)
        names = sorted(df.columns)
        want = duck.sql(sql)
        at = [want.columns.index(n) for n in names]
        got = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
        assert names == sorted(want.columns)
        assert got == sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)

    return check
