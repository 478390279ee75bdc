"""Every core query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from routeloom.plans import catalog

duckdb = pytest.importorskip("duckdb")


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


#: Iterative or drawn: tested by what must hold of them (router_calibration, router_oof_checks, resampling on a fixture).
NO_SQL = {"router_logreg", "bootstrap_ci_20000"}


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - NO_SQL == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, db, name):
    df = catalog.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in NO_SQL:
        assert rows
        return
    cur = db.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(rows) == plain(tuple(r[i] for i in order) for r in cur.fetchall())


def test_entry_runs(spark, data):
    assert catalog.flagship(spark, data).count() > 0


def test_nothing_outside_imports_the_llm_package():
    root = Path(catalog.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "routeloom.llm" not in f.read_text() and "from .llm" not in f.read_text() and "from ..llm" not in f.read_text()
