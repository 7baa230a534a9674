import random
from collections import defaultdict

from rotativa.llm import repeated as R


def form(x):
    return "".join(c for c in x.lower() if c not in "0123456789 \t\n\r\x0b\x0c")


def brute(rows):
    docs, size = defaultdict(set), defaultdict(set)
    for s, k, t in rows:
        if s is None or k is None:
            continue
        size[s].add(k)
        for x in (t or "").split("\n"):
            docs[s, form(x)].add(k)
    out = set()
    for s, k, t in rows:
        if s is not None and k is not None and t is not None:
            for i, x in enumerate(t.split("\n"), 1):
                n = len(docs[s, form(x)])
                if form(x) and n >= 5 and n * 100 >= 3 * len(size[s]):
                    out.add((k, i))
    return out


SCHEMA = "medio_id string, noticia_id string, texto_extraido string, s string, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA)


def test_equals_brute_force(spark):
    rnd = random.Random(6)
    legal = ["Aviso 1", "Aviso  22", "Copia 3 prohibida", "Ñandú", "", "7", "Volver"]
    rows = []
    for i in range(700):
        # one source holds most rows
        s = "m0" if rnd.random() < 0.6 else f"m{rnd.randrange(1, 30)}"
        body = [f"línea propia {rnd.choice('abcdefgh')}{chr(97 + i % 26)}{chr(97 + i // 26)}" for _ in range(rnd.randint(0, 3))]
        tail = rnd.sample(legal, rnd.randint(0, 5))
        rows.append((s, f"n{i}", "\n".join(body + tail * rnd.choice((1, 1, 2)))))
    rows += rows[:20] + [(None, "x", "Aviso"), ("m0", None, "Aviso"), ("m0", "nulo", None), ("m0", "vacio", "")]
    got = {tuple(r) for r in R.find_repeated(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_blocks_span_several_lines(spark):
    rows = [("m", f"n{i}", f"cuerpo {chr(97 + i)}\nuno\ndos\ntres\nfin {chr(97 + i)}") for i in range(8)] + [("m", "z", "uno\ndos")]
    docs = R.line_ids(frame(spark, rows))
    blocks = {(len(r.block), r.docs) for r in R.blocks(docs).collect()}
    assert (3, 8) in blocks and (2, 9) in blocks and (1, 9) in blocks


def test_blocks_longer_than_any_window(spark):
    block = [f"regla {a}{b}" for a in "abcdefg" for b in "abcdefg"]  # 49 lines
    rows = [("m", f"n{i}", "\n".join([f"cuerpo {chr(97 + i)}", *block, f"fin {chr(97 + i)}"])) for i in range(6)]
    docs = R.line_ids(frame(spark, rows))
    found = {len(r.lines): r.docs for r in R.long_blocks(docs).collect()}
    assert max(found) == 48 and set(found.values()) == {6}


def test_documents_are_counted_once(spark):
    # a line twice in a text, and a document with two texts: four documents, five windows
    rows = [("m", "a", "x\ny\nx\ny\nx"), ("m", "b", "x\nq"), ("m", "c", "x\nr"), ("m", "d", "x\ns"), ("m", "d", "x\nt")]
    assert R.find_repeated(frame(spark, rows)).count() == 0
    assert {tuple(r) for r in R.find_repeated(frame(spark, [*rows, ("m", "e", "x")])).collect()} == {("a", 1), ("a", 3), ("a", 5), *((k, 1) for k in "bcde")}


def test_blocks_alone_decide(spark, monkeypatch):
    rows = [("m", f"n{i}", f"propia {chr(97 + i)}\nAviso") for i in range(6)]
    assert R.find_repeated(frame(spark, rows)).count() == 6
    monkeypatch.setattr(R, "_common_prefixes", lambda batches: iter(()))
    assert R.find_repeated(frame(spark, rows)).count() == 0


def test_remove_empty_and_long(spark):
    rows = [("m", f"n{i}", f"propia {chr(97 + i)}\nAviso") for i in range(6)]
    out = {r.noticia_id: r.texto_sin_repetidas for r in R.remove_repeated(frame(spark, rows)).collect()}
    assert out["n0"] == "propia a"
    assert R.find_repeated(frame(spark, rows).where("false")).count() == 0
    assert R.find_repeated(frame(spark, [("m", "a", "x\n" * 20_000)])).count() == 0
