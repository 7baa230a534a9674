import os

import duckdb
import pytest

import __spark_entry__ as entry
from rotativa.plans import registry


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


def plain(rows, names, order):
    return sorted(tuple("" if r[names.index(c)] is None else f"{float(r[names.index(c)]):.6g}" if isinstance(r[names.index(c)], (int, float)) and not isinstance(r[names.index(c)], bool) else str(r[names.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, data, db, name):
    got = registry.queries()[name](spark, data)
    cur = db.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(cols)
    order = sorted(cols)
    assert plain([tuple(r) for r in got.collect()], got.columns, order) == plain([tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in cur.fetchall()], cols, order)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rule_id", "notas", "mejor"]
    assert set(registry.oracle_sql()) <= set(registry.queries())
