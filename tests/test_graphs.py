import random

from rotativa.operators import graphs as G


def test_indexes(spark):
    items = spark.createDataFrame(
        [("r", "a", "2026-02", True), ("r", "b", None, True), ("r", "x", "2026-01", False), ("a", "y", None, False), ("a", "r", None, True), ("a", "x", "2026-09", False), ("b", "z", None, False), ("y", "no", None, False)],
        "doc string, url string, fecha string, is_index boolean",
    )
    roots = spark.createDataFrame([("r",), ("r",), ("unfetched",)], "url string")
    got = {(r.url, r.nivel) for r in G.resolve_indexes(items, roots).collect()}
    assert got == {("x", 0), ("y", 1), ("z", 1)}
    assert {r.url for r in G.resolve_indexes(items, roots, budget=1).collect()} == {"x", "y"}
    assert {r.url for r in G.resolve_indexes(items, roots, depth=0).collect()} == {"x"}


def test_same_entity(spark):
    rnd = random.Random(5)
    rows = [(i, f"h{rnd.randrange(60)}" if rnd.random() < 0.6 else None, f"n{rnd.randrange(80)}" if rnd.random() < 0.5 else "") for i in range(90)]
    # a chain, longer than one round reaches
    rows += [(1000 + i, f"c{i}", f"c{i + 1}x") for i in range(20)] + [(2000 + i, f"c{i + 1}", f"c{i + 1}x") for i in range(19)]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for k, a, b in rows:
        for v in (("a", a), ("b", b)):
            if v[1]:
                o = first.setdefault(v, k)
                x, y = find(o), find(k)
                parent[max(x, y)] = min(x, y)
    got = {r.k: r.entidad for r in G.same_entity(spark.createDataFrame(rows, "k int, a string, b string"), "k", ["a", "b"]).collect()}
    assert got == {k: find(k) for k, _, _ in rows}


def test_manifest(spark):
    u = "0f0f0f0f-1111-2222-3333-444444444444"
    df = spark.createDataFrame([(f'{{"ids":["{u}","{u.upper()}"]}}',), ("a" * 40,), ("nota-suelta",), (None,)], "value string")
    got = {r.id: r.tipo for r in G.manifest_ids(df).collect()}
    assert got == {u: "uuid", "a" * 40: "hash", "nota-suelta": "invalid"}
    assert [r.id for r in G.missing_from(G.manifest_ids(df).where("tipo = 'uuid'"), spark.createDataFrame([("x",)], "i string"), "i").collect()] == [u]
