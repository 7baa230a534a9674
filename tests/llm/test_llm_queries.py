import os

import duckdb
import pytest
from rotativa.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    got = QUERIES[name](spark, data)
    cur = c.execute(SQL[name])
    cols = sorted(d[0] for d in cur.description)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, (tuple(r[names.index(c)] for c in cols) for r in want)))


COLUMNS = {
    "p1_found": ["noticia_id"], "p2_found": ["noticia_id", "campo", "linea"], "p3_found": ["noticia_id", "linea"], "p4_found": ["noticia_id", "campo"],
    "p7_found": ["noticia_id", "campo"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)
