import pytest
import random
from datetime import date, datetime

from pyspark.sql import functions as F
from rotativa.functions import cells, text, url
from rotativa.operators import compare, keys, queue
from rotativa.sources import feeds
from rotativa.streaming import streams


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr).first()[0]


def test_urls(spark):
    u = "HTTPS://WWW.Ejemplo.com.mx:443/a/b-c-d/?utm_source=x&id=2&a=1#z"
    assert one(spark, url.host("c0"), u) == "ejemplo.com.mx"
    assert one(spark, url.domain("c0"), "http://noticias.ejemplo.com.mx/x") == "ejemplo.com.mx"
    assert one(spark, url.canonical("c0"), u) == "https://www.ejemplo.com.mx:443/a/b-c-d?id=2&a=1"
    assert one(spark, url.identity("c0"), u) == "ejemplo.com.mx/a/b-c-d?a=1&id=2"
    assert one(spark, url.path("c0"), "https://a.example") == "/"
    assert one(spark, url.is_listing("c0"), "https://a.example/deportes/") is True
    assert one(spark, url.is_listing("c0"), "https://a.example/?p=123") is False
    assert one(spark, url.canonical("c0"), None) is None


def test_text_and_cells(spark):
    assert one(spark, text.fold("c0"), "ÑANDÚ Àç") == "nandu ac"
    assert one(spark, text.cut_words("c0", 10), "uno dos tres cuatro") == "uno dos"
    assert one(spark, text.strip_html("c0"), "<p>a &amp; b</p><script>x</script>c") == "a & b c"
    assert one(spark, text.similarity(F.col("c0"), F.col("c1")), "", "") == 1.0
    assert one(spark, cells.boolean("c0"), " Sí ") is True and one(spark, cells.boolean("c0"), "quizá") is None
    assert one(spark, cells.integer("c0"), "1,200.0") == 1200 and one(spark, cells.integer("c0"), "x") is None
    assert one(spark, cells.id_list("c0"), "a| b;a,,c") == ["a", "b", "c"]


def test_write_by_key(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "q")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, v string, w string")
    assert sorted(map(tuple, keys.upsert(old, new, ["k"]).collect())) == [(1, "a", None), (2, "c", "q"), (3, "d", "z")]
    twice = new.unionByName(new).unionByName(spark.createDataFrame([(None, "n", None)], new.schema))
    assert sorted((r.k or 0) for r in keys.insert_ignore(old, twice, ["k"], F.col("v")).collect()) == [0, 3]
    plan = {(r.k, r.plan) for r in keys.append_plan(old, twice, "k", F.col("v")).collect()}
    assert plan == {(2, "present"), (3, "append"), (3, "repeated"), (None, "blank")}
    diff = {r.k: (r.estado, r.cambios) for r in keys.table_diff(old, new, "k", ["v", "w"]).collect()}
    assert diff == {1: ("ONLY_OLD", ""), 2: ("UPDATE", "v,w"), 3: ("CREATE", "")}
    assert {(r.k, r.campo) for r in keys.cell_changes(old, new, "k", ["v", "w"]).collect()} == {(2, "v"), (2, "w")}
    page = keys.page_after(old.unionByName(new), ["v", "k"], ["b", 2], 2)
    assert [(r.v, r.k) for r in page.collect()] == [("c", 2), ("d", 3)]


def brute_greedy(rows, least):
    heads, out = {}, {}
    for g, t, o in sorted(rows, key=lambda r: r[2]):
        for h, ho in heads.setdefault(g, []):
            if 1 - lev(t, h) / max(len(t), len(h), 1) >= least:
                out[o] = ho
                break
        else:
            heads[g].append((t, o))
            out[o] = o
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_greedy_clusters(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), "".join(rnd.choice("xy") for _ in range(rnd.randint(6, 9))), i) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, t string, o int")
    got = {r.o: r.cluster for r in compare.greedy_clusters(df, ["g"], "t", "o", 0.8).collect()}
    assert got == brute_greedy(rows, 0.8)


def test_candidates_and_matches(spark):
    rnd = random.Random(8)
    base = ["el alcalde entrego obra", "el alcalde entrego una obra", "lluvia en la sierra", "otra cosa distinta"]
    make = lambda n, s: [(f"{s}{i}", f"u{rnd.randrange(60)}", rnd.choice("mn"), date(2026, 1, 1 + rnd.randrange(12)), rnd.choice(base), i) for i in range(n)]
    A, B = make(40, "a"), make(40, "b")
    schema = "id string, url_key string, outlet string, day date, title string, ord long"
    a, b = spark.createDataFrame(A, schema), spark.createDataFrame(B, schema)
    got = {(r.a_id, r.b_id, r.tier) for r in compare.candidates(a, b).collect()}
    want = set()
    for x in A:
        for y in B:
            if x[1] == y[1]:
                want.add((x[0], y[0], 3))
            s = 1 - lev(x[4], y[4]) / max(len(x[4]), len(y[4]))
            if x[2] == y[2] and abs((x[3] - y[3]).days) <= 3 and s >= 0.6:
                want.add((x[0], y[0], 2 if s >= 0.85 else 1))
    assert got == want
    pairs = compare.candidates(a, b).join(a.selectExpr("id AS a_id", "outlet"), "a_id")
    ex = compare.exclusive_matches(pairs).collect()
    assert len({r.a_id for r in ex}) == len(ex)


def test_longest_prefix(spark):
    u = spark.createDataFrame([("1", "h", "/a/b/c"), ("2", "h", "/z"), ("3", "q", "/"), ("4", "d", "/x")], "url_id string, host string, path string")
    s = spark.createDataFrame([("h", "/", "S"), ("h", "/a/", "T"), ("d", "/", "U"), ("d", "", "V")], "host string, path string, source string")
    got = {r.url_id: (r.source, r.estado) for r in compare.longest_prefix(u, s).collect()}
    assert got == {"1": ("T", "RESOLVED"), "2": ("S", "RESOLVED"), "3": (None, "UNKNOWN"), "4": (None, "AMBIGUOUS")}


def test_queue(spark):
    t = datetime(2026, 1, 1)
    q = spark.createDataFrame([("a", "QUEUED", 0, None, t, None), ("b", "RETRY", 8, t, t, None), ("c", "PERSISTED", 1, None, t, None)], "clave string, estado string, intentos int, proximo timestamp, descubierto timestamp, reclamado string")
    assert [r.clave for r in queue.claimable(q, F.lit("2026-01-02").cast("timestamp"), 5).collect()] == ["a", "b"]
    res = spark.createDataFrame([("a", False, t), ("b", False, t)], "clave string, ok boolean, cuando timestamp")
    got = {r.clave: (r.estado, r.intentos, r.proximo) for r in queue.after_attempt(q, res).collect()}
    assert got["a"] == ("RETRY", 1, datetime(2026, 1, 1, 0, 15)) and got["b"][:2] == ("BLOCKED", 9) and got["c"][0] == "PERSISTED"
    log = spark.createDataFrame([("m", 1, True), ("m", 2, False), ("m", 3, False), ("n", 1, False)], "m string, o int, ok boolean")
    assert {r.m: r.fallos for r in queue.failures_in_a_row(log, "m", F.col("ok"), "o").collect()} == {"m": 2, "n": 1}


RSS = '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title><item><title>T&amp;U</title><link>https://a.example/1</link><dc:creator>Ana</dc:creator><category>Salud</category><pubDate>x</pubDate></item><item><guid>g</guid></item></channel></rss>'
MAP = '<urlset xmlns="s" xmlns:news="n"><url><loc>https://a.example/1</loc><news:news><news:publication_date>2026-01-01</news:publication_date></news:news></url><url><lastmod>x</lastmod></url></urlset>'
PAGE = '<html><head><title>Doc</title><meta property="og:title" content="Bueno"><link rel="canonical" href="https://a.example/n"></head><body><nav><p>menu</p></nav><article><h1>H</h1><p>' + "Texto del cuerpo. " * 20 + '</p><p><a href="/x">solo enlace</a></p><script>var x = "</p>"</script></article></body></html>'


def test_feeds(spark):
    items = feeds.feed_items(RSS)
    assert items[0] == {"url": "https://a.example/1", "titulo": "T&U", "resumen": None, "autor": "Ana", "fecha": "x", "seccion": "Salud"} and items[1]["url"] == "g"
    assert [x["fecha"] for x in feeds.sitemap_items(MAP)] == ["2026-01-01"]
    assert feeds.feed_items("<rss><bro") == feeds.feed_items(None) == feeds.feed_items("<!DOCTYPE x><rss/>") == []
    df = spark.createDataFrame([(1, RSS, "x"), (2, None, "x"), (3, "<a", "x")], "id int, xml string, url string")
    out = feeds.explode_items(df, "id", "xml", feeds.feed_items)
    assert [(r.id, r.posicion) for r in out.collect()] == [(1, 1), (1, 2)]
    assert [r.fecha for r in feeds.newest_first(out, "fecha", 1).collect()] == ["x"]
    page = feeds.page_fields(PAGE)
    assert page["titulo"] == "Bueno" and page["canonica"] == "https://a.example/n" and page["texto"].startswith("Texto") and "enlace" not in page["texto"]
    assert feeds.page_fields(None)["titulo"] is None and feeds.page_fields("<p")["texto"] is None
    got = feeds.read_pages(spark.createDataFrame([(1, PAGE), (2, None)], "id int, h string"), "id", "h").collect()
    assert got[0].titulo == "Bueno" and got[1].titulo is None
    links = one(spark, feeds.listing_links(F.col("c0"), F.lit("a.example")), '<a href="https://a.example/1"><a href=\'https://b.example/2\'><a href="https://www.a.example/1">')
    assert links == ["https://a.example/1", "https://www.a.example/1"]


def test_log_lines_and_headers(spark):
    df = spark.createDataFrame([('job  2026 {"event":"x","n":1}',), ("plain",), ('{"event":"y"',), (None,)], "value string")
    assert [tuple(r) for r in feeds.log_lines(df, "event string, n int").collect()] == [("x", 1)]
    src = spark.createDataFrame([("a", "b")], "`Nombre Medio` string, URL string")
    assert feeds.with_headers(src, {"nombre": ("nombre_medio",), "url": (), "estado": ("edo",)}).first().asDict() == {"nombre": "a", "url": "b", "estado": None}


def test_streams_equal_batch(spark, data):
    log = spark.read.parquet(f"{data}/logs_ingesta.parquet")
    got = streams.run_to_end(streams.first_seen(streams.stream_table(spark, data, "logs_ingesta"), ["log_id"], "llegada", "400 days"))
    assert got.count() == log.select("log_id").distinct().count()
    seen = []
    streams.run_to_end(streams.stream_table(spark, data, "logs_ingesta"), step=lambda b, n: seen.append(b.count()))
    assert sum(seen) == log.count()
    assert streams.new_only(log, log.limit(0), ["log_id"]).count() == log.select("log_id").distinct().count()


def test_shared_folder(spark, monkeypatch, tmp_path):
    import os

    from rotativa.sources import shared

    df = shared.keep(spark.range(5), "five")
    assert df.count() == 5 and shared.release(spark) > 0 and shared.release(spark) == 0
    conf = spark.sparkContext.getConf()
    monkeypatch.setattr(type(spark.sparkContext), "getConf", lambda self: conf.set("spark.master", "spark://host:7077"))
    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError):
            shared.folder(spark)
    monkeypatch.undo()
    assert os.path.isdir(shared.folder(spark)) or shared.folder(spark).startswith("file:")


def test_exclusive_matches_equal_greedy(spark):
    import random

    from rotativa.operators import compare

    rnd = random.Random(9)
    pairs = [(f"a{rnd.randrange(30)}", f"b{rnd.randrange(30)}", round(rnd.random(), 1)) for _ in range(200)]
    best = {}
    for a, b, s in pairs:
        best[a, b] = max(best.get((a, b), 0), s)
    want, ua, ub = set(), set(), set()
    for (a, b), s in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in ua and b not in ub:
            want.add((a, b, s))
            ua.add(a)
            ub.add(b)
    df = spark.createDataFrame(pairs, "a_id string, b_id string, score double")
    assert {tuple(r) for r in compare.exclusive_matches(df).collect()} == want
    assert compare.exclusive_matches(df.where("false")).count() == 0
