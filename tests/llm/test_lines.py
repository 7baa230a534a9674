import random

import pytest
from rotativa.llm import boilerplate as B
from rotativa.llm import lines as L
from rotativa.llm.residue import exclude_non_articles, is_non_article, non_articles, residue_rates
from pyspark.sql import functions as F

ARTICLE = "Salud\nLa clínica amplió su horario\nPor Ana Prieto\n3 de mayo de 2026\n" + "El municipio informó que la clínica atenderá hasta la noche y que el cambio será definitivo. " * 4
MOJIBAKE = {"wrong": lambda s: s.encode().decode("cp1252", "replace"), "bare": lambda s: s.translate(str.maketrans("áéíóúñ", "aeioun")), "lost": lambda s: s.replace("ó", "?").replace("í", "�"), "upper": str.upper}


@pytest.mark.parametrize("how", MOJIBAKE)
@pytest.mark.parametrize(
    "line,kind",
    [("Última actualización: 5 min", L.FURN), ("Queda prohibida la reproducción total o parcial", L.FURN), ("Más de esta sección", L.HEAD), ("Política | Economía | Opinión", L.NAV), ("Galerías", L.MENU1), ("Continúa leyendo después del anuncio", L.AD)],
)
def test_wording_in_any_encoding(line, kind, how):
    assert L.classify(MOJIBAKE[how](line)) == kind


def test_article_lines_are_text():
    for t in ("Por qué se retrasó la obra", "El hospital habilitó 4 camas.", "«Nadie vino», dijo Ana.", "- 12 familias", "Lo que falta por saber"):
        assert L.classify(t) == L.TEXT
    assert L.classify("") == L.BLANK and L.classify(" \r") in (L.BLANK, L.TEXT)


@pytest.mark.parametrize(
    "text",
    ["{{cuerpo}}", "Lorem ipsum dolor sit amet consectetur adipiscing elit", "404", "Error 404 - Not Found", "JavaScript is disabled in your browser", "{%block a%}{%endblock%}", "El equipo [LOCAL] venció a [VISITANTE]", "%TITULO% - %SECCION%", "Inicio | Cultura\n[object Object]\nundefined\nVolver arriba", "xxxxx xxxxx xxxxx", "Cargando…",
     "Inicio | Nacional | Cultura\nSitio en mantenimiento. Volvemos pronto.\nUn titular suelto de otra nota\nVolver arriba"],
)
def test_non_articles(text):
    assert is_non_article(text)


@pytest.mark.parametrize("text", [None, "", "  \n ", "Inicio | Nacional | Cultura\nVolver arriba", ARTICLE, ARTICLE + "\n{{ad_nota_3}}\nHabilita JavaScript para ver este video", ARTICLE.replace("El municipio", "El portal mostró «error 404» y la palabra {nombre}. El municipio", 1), "palabra " * 250_000])
def test_articles(text):
    assert not is_non_article(text)


def test_non_article_frame(spark):
    df = spark.createDataFrame([("a", "404", "m"), ("a", "404", "m"), ("b", ARTICLE, "m"), ("c", None, None), (None, "404", "m")], "noticia_id string, texto_extraido string, k string")
    assert [r[0] for r in non_articles(df).collect()] == ["a"]
    assert sorted(r[0] or "" for r in exclude_non_articles(df).collect()) == ["", "b", "c"]
    assert {r.grupo: (r.notas, r.no_articulos) for r in residue_rates(df.where("noticia_id IS NOT NULL"), F.col("k")).collect()} == {"m": (2, 1), None: (1, 0)}
    assert non_articles(df.where("false")).count() == 0


def brute_cut(score, edges):
    best, side = None, None
    n = len(score)
    for m in range(1 << n):
        cost = sum((-score[i] if m >> i & 1 else score[i]) if (score[i] > 0) != bool(m >> i & 1) else 0 for i in range(n))
        cost = sum(abs(score[i]) for i in range(n) if (score[i] > 0) != bool(m >> i & 1))
        cost += sum(w for i, j, w in edges if (m >> i & 1) != (m >> j & 1))
        if best is None or cost < best - 1e-9:
            best, side = cost, m
    return best, side


def cut_cost(score, edges, side):
    return sum(abs(s) for s, x in zip(score, side) if (s > 0) != x) + sum(w for i, j, w in edges if side[i] != side[j])


def test_min_cut_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(250):
        n = rnd.randint(1, 9)
        score = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 3)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4]
        best, _ = brute_cut(score, edges)
        assert abs(cut_cost(score, edges, B.min_cut(score, edges)) - best) < 1e-6
    assert B.min_cut([], []) == [] and B.min_cut([0.0], []) == [False]


PAGE = "Nacional | Cultura | Deportes\nUtilizamos cookies propias\nSALUD\nLa clínica amplió su horario\nPor Ana Prieto\nPublicidad\n" + "El municipio informó que atenderá hasta la noche. Será definitivo.\n" * 2 + "Qué sigue\n- 12 camas\nTemas: Salud, Clínica\nLo más leído\nOtra nota sobre el puente\nSegún el boletín, la obra sigue en pie.\n2. Una más\n© 2026 El Faro. Todos los derechos reservados."


def test_page():
    assert B.furniture_lines(PAGE, "La clínica amplió su horario", "Salud") == [1, 2, 6, 11, 12, 13, 14, 15, 16]
    assert B.furniture_lines(PAGE.replace("\n", "\r\n"), "La clínica amplió su horario", None) == [1, 2, 6, 11, 12, 13, 14, 15, 16]
    assert B.main_text(PAGE, "La clínica amplió su horario", "Salud").startswith("SALUD\nLa clínica")
    assert B.furniture_lines(None) == B.furniture_lines("") == [] and B.main_text(None) is None
    assert B.furniture_lines("uno\n" * 50_000) == []


def test_furniture_frame(spark):
    df = spark.createDataFrame([("a", "La clínica amplió su horario", "Salud", PAGE, None, "Otra nota sobre el puente\nEl municipio informó.", 1)] * 2 + [("b", None, None, "404", "Publicidad", None, 2), ("c", None, None, None, "Publicidad", "", 3)], "noticia_id string, titulo string, seccion string, texto_extraido string, texto_nota_limpia string, texto_cuerpo_nota string, linea int")
    got = sorted(map(tuple, B.find_furniture(df).collect()))
    assert [g for g in got if g[1] != "texto_extraido"] == [("a", "texto_cuerpo_nota", 1), ("c", "texto_nota_limpia", 1)]
    assert len(got) == 11
    assert B.find_furniture(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["%(titulo)s", "@Model.Title", "{$nota.cuerpo}", "<?= $titulo ?>", "*|TITULO|*", "[% cuerpo %]", "Page not found | El Diario", "The page you requested was not found", "JavaScript required", "Se requiere activar JavaScript", "This page could not be found.",
                                  "Please enable JavaScript to view this page. " + "Your browser has scripts disabled. Reload the page after you enable JavaScript. " * 5])
def test_residue_of_other_wordings(text):
    assert is_non_article(text)


@pytest.mark.parametrize("text", ["The article is available", "Nota disponible en el archivo", "Este sitio existe desde 1990"])
def test_likenesses_of_residue(text):
    assert L.classify(text) == L.TEXT


def test_code_blocks_are_no_residue():
    places = "{{titulo}}\n{{cuerpo}}\n{{autor}}"
    tutorial = "La plantilla muestra tres campos al editor.\n%s\nCon eso la portada queda lista."
    assert not is_non_article(tutorial % f"```\n{places}\n```") and not is_non_article(tutorial % f"<pre>\n{places}\n</pre>")
    assert is_non_article(places)


def test_long_lines_have_the_same_grammar():
    consent = "Utilizamos cookies propias y de terceros " + "para medir el uso del sitio " * 40
    assert len(consent) > 1000 and L.classify(consent) == L.FURN
    assert L.classify("Página no encontrada era el aviso. " + "El municipio explicó que el portal estuvo en obra y que la gente pudo pagar en caja. " * 6) == L.TEXT
    far = "\n".join(["Aviso suelto de la página"] * 60 + ["La clínica amplió su horario", "El municipio informó."])
    assert B.furniture_lines(far, "La clínica amplió su horario") == list(range(1, 60))  # the line above the title is its label


def test_fitted_classifier():
    # a class the body never holds becomes dearer, one it always holds cheaper; the same at every size
    few = {(L.TEXT, ""): (900, 20), (L.FURN, ""): (3, 300), (L.TEXT, "headline"): (5, 95)}
    shifts = B.fit_shifts(few)
    assert shifts[(L.TEXT, "headline")] > 0.3 and B.fit_shifts({}) == {}
    many = B.fit_shifts({k: (a * 10**7, b * 10**7) for k, (a, b) in few.items()})
    assert all(abs(many[k] - shifts[k]) < 1e-6 for k in few)
    page = "Nacional | Cultura\nLa clínica amplió\nUno dice algo.\nDos dice algo.\nTres dice algo.\nOtra nota"
    parts = page.split("\n")
    got = B.labelled(page, "Uno dice algo.\nDos dice algo.\nTres dice algo.", "La clínica amplió", L.classify_page(parts))
    assert [f for _, _, f in got] == [True, False, False, False, True]


def test_each_stage_changes_rows():
    # an entry between two sure lines follows its neighbours; without edges its own odds stand
    parts = ["Utilizamos cookies propias", "Boletín semanal", "Síguenos en redes", "El municipio informó."]
    classes = L.classify_page(parts)
    score, edges = B.scores(parts, classes, "", "", {}, {(classes[1], ""): 2.5})
    assert B.min_cut(score, edges)[1] != B.min_cut(score, [])[1]
    plain = B.scores(parts, classes, "", "", {})[0]
    assert plain != score
