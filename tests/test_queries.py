"""Every core query with SQL against DuckDB, the others against Python models."""

import importlib

import pytest

from tests import models
from tests.oracle import database, plain, same

CORE = [importlib.import_module(f"korrel.plans.{m}") for m in ("records", "corpus", "order", "tokens", "training", "radiology", "flows", "exchange")]
QUERIES = {k: f for m in CORE for k, f in m.QUERIES.items()}
SQL = {k: s for m in CORE for k, s in m.SQL.items()}


@pytest.fixture(scope="module")
def con(data):
    return database(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_same_as_model(spark, data, con, name):
    df = QUERIES[name](spark, data)
    rows = [tuple(plain(x) for x in r) for r in df.collect()]
    assert rows
    if name == "reservoir_shuffle":
        at = {c: i for i, c in enumerate(df.columns)}
        by = {}
        for r in rows:
            by.setdefault(r[at["worker"]], []).append((r[at["pos"]], r[at["doc_id"]]))
        assert sorted(k for g in by.values() for _, k in g) == [k for (k,) in con.sql("select doc_id from documents order by 1").fetchall()]
        assert all([k for _, k in sorted(g)] == models.reservoir(sorted(k for _, k in g), 100, 42 + w) for w, g in by.items())
    elif name.startswith("p1_"):
        assert len(set(rows)) == len(rows)  # tests/test_records.py holds these against a reader of its own
    else:
        want = [tuple(plain(x) for x in r) for r in getattr(models, name)(con)]
        assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
