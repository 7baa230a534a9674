import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rotativa.llm import mojibake as M

TEXT = "La compañía de danza «Umbral» cerró su temporada; ¿quién pagará los daños? El Ñandú lo dijo así."
PAIRS = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "latin-1"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "cp850")]


def garble(t, w, r):
    return "".join(M._read(c.encode(w), r) if not c.isascii() else c for c in t)


@pytest.mark.parametrize("w,r", PAIRS)
def test_found_and_restored(w, r):
    bad = garble(TEXT, w, r)
    assert M.inspect(bad) == (True, False)
    assert M.repair(bad) == TEXT
    mixed = TEXT + "\n" + bad
    assert M.inspect(mixed)[0]
    if w == "utf-8":
        assert M.repair(mixed) == TEXT + "\n" + TEXT


def test_twice_and_entities():
    twice = garble(garble(TEXT, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert M.repair(twice) == TEXT
    assert M.repair("Pol&Atilde;&shy;tica y pag&Atilde;&sup3;") == "Política y pagó"


@pytest.mark.parametrize("t", ["Pol�tica", "Pol?tica", "gan? 3-0 en la final", "El ?rgano electoral"])
def test_lost(t):
    assert M.inspect(t) == (True, True) and M.repair(t) == t


@pytest.mark.parametrize(
    "t",
    [None, "", TEXT, "¿Qué sigue? la obra", "¿Quién? ¿Cómo? nadie sabe", "São João e a panadería Crème Brûlée", "INFORMAÇÃO ÑANDÚ Ærø", "√16 es 4, ±2 µm", "usa ├ y ┤", "https://a.example/n?id=3", "Que paso? Nadie sabe", "10 °C · 2.ª edición", "compañia sin acentos", "x" * 500_000],
)
def test_correct_text_is_left_alone(t):
    assert M.inspect(t) == (False, False) and M.repair(t) == t


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["cañada", "pagó", "niño", "así", "camión", "está", "sol", "mar"]), min_size=2, max_size=12), st.sampled_from(PAIRS[:4]))
def test_round_trip(words, pair):
    t = " ".join(words)
    bad = garble(t, *pair)
    assert M.repair(bad) == t and M.inspect(bad)[0] == (bad != t)


def test_frame(spark):
    bad = garble(TEXT, "utf-8", "cp1252")
    df = spark.createDataFrame([("a", bad, TEXT, 1), ("a", bad, TEXT, 1), ("b", None, bad, 2), (None, bad, bad, 3), ("c", "", None, 4)], "noticia_id string, titulo string, texto_extraido string, campo int")
    assert sorted(map(tuple, M.find_garbled(df).collect())) == [("a", "titulo"), ("b", "texto_extraido")]
    assert [r.t2 for r in M.repair_column(df, "titulo", "t2").collect()] == [TEXT, TEXT, None, TEXT, ""]
    assert M.find_garbled(df.where("false")).count() == 0


#: The two readings in which one form stands for two characters; the Spanish one is taken.
ALIKE = {("Ì", "cp1252"), ("è", "iso8859-15"), ("ý", "iso8859-15")}


def test_letters_of_other_languages_are_restored_or_left():
    restored = n = 0
    for c in M.OTHERS + M.LETTERS:
        for r in M.READ:
            bad = M._read(c.encode("utf-8"), r)
            for around in ("ab%scd", "%sbc", "Ab%s", "a %s b", "AB%sCD"):
                out = M.repair(around % bad)
                n += 1
                restored += out == around % c
                assert out in (around % bad, around % c) or (c, r) in ALIKE, (c, r, out)
    assert restored > 0.85 * n


@pytest.mark.parametrize("good", ["François", "São Paulo", "naïve crème", "Łódź i Kraków", "мир и труд", "El niño de Orléans"])
def test_foreign_names(good):
    bad = garble(good, "utf-8", "cp1252")
    assert M.repair(bad) == good or M.repair(bad).count("Ã") == 0 and all(x in good or x in bad for x in M.repair(bad))
    assert M.repair(good) == good


def test_garbled_many_times():
    t = "Política"
    for _ in range(6):
        t = garble(t, "utf-8", "cp1252")
    assert len(M.repair(t)) < len(t)


def test_restored(spark):
    rows = [("a", "FranÃ§ois", "bien"), ("a", "FranÃ§ois", "bien"), ("b", None, "SÃ£o"), (None, "Ã¡", None), ("c", "", "x")]
    got = {tuple(r) for r in M.restored(spark.createDataFrame(rows, "noticia_id string, titulo string, texto_extraido string")).collect()}
    assert got == {("a", "titulo", "François"), ("b", "texto_extraido", "São")}
