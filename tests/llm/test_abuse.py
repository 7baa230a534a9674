import numpy as np
import pytest
from rotativa.llm import abuse as A


def test_disguises():
    for t in ("i.d.i.o.t.a", "1d10t4", "idiooooota", "Í D I O T A"):
        assert "idiota" in A.normal(f"eres un {t} siempre")
    assert A.normal("El año 2026 cerró con 14 casos.") == "el ano 2026 cerro con 14 casos."


def test_own_voice():
    assert "idiota" not in A.passages("El diputado fue llamado «idiota» por un colega.")[0]
    assert "idiota" in A.passages("@ana: eres un «idiota» total")[0]
    assert A.passages(None) == A.passages("  \n") == []


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.1
    rates = [(0.6, 0.002), (0.5, 0.004), (0.4, 0.002), (0.5, 0.003)]
    v = np.zeros((6000, 6), np.int8)
    for j, (p1, p0) in enumerate(rates):
        v[:, j] = rng.random(6000) < np.where(y, p1, p0)
    v[:, 4] = -1 * (rng.random(6000) < np.where(y, 0.02, 0.6)).astype(np.int8)
    v[:, 5] = v[:, 0]  # an echo of the first voter
    m = A.LabelModel().fit(v)
    hit = m.predict(v) > 0.5
    assert (hit & y).sum() / y.sum() > 0.85 and (hit & ~y).sum() / max(1, hit.sum()) < 0.1
    assert m.correlation[0, 5] > 0.8 and m.weight[5] < m.weight[3]


@pytest.fixture(scope="module")
def model(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    return A.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/muestras_moderacion.parquet"))


def test_held_out_accuracy(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    rows = sorted((r.texto, r.etiqueta != "ninguna") for r in spark.read.parquet(f"{d}/muestras_moderacion.parquet").collect())
    texts = sorted({t for t, _ in rows})
    held = set(texts[::3])
    m = A.fit(spark.read.parquet(f"{d}/documents.parquet"), None)
    train = A.fit_passages([p for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect() for p in A.passages(r[0])], [(t, y) for t, y in rows if t not in held])
    test = [(t, y) for t, y in rows if t in held]
    assert sum((train.document(t) >= A.THRESHOLD) == y for t, y in test) / len(test) >= 0.9
    # without any label the voters alone carry it
    assert sum((m.document(t) >= A.THRESHOLD) == y for t, y in rows) / len(rows) >= 0.85


def test_frame(spark, model):
    df = spark.createDataFrame([(1, "Eres un imbécil, no sirves para nada. Lárgate de aquí, idiota.", "a", 1.0), (2, None, "a", 1.0), (3, "", None, 1.0), (4, "La clínica amplió el horario.", "a", 1.0), (5, "palabra " * 300_000, "b", 1.0)], "doc_id long, text string, source string, puntaje double")
    got = {r.doc_id: r.puntaje for r in A.score(df, model).collect()}
    assert got[1] > 0.5 and got[2] == got[3] == 0 and got[4] < 0.5 and got[5] < 0.5
    rate = {r.source: (r.documentos, r.casos) for r in A.rates(df, A.score(df, model)).collect()}
    assert rate == {"a": (3, 1), "b": (1, 0), None: (1, 0)}
    empty = A.fit(df.where("false"), None)
    assert empty.document("hola") < 0.5 and A.score(df.where("false"), model).count() == 0


def of_words(weights, bias):
    return A.Model([int(A.features([w])[1][0]) for w in weights], list(weights.values()), bias)


def test_disguise_among_harmless_words():
    m = of_words({"pendejo": 20.0, "alcalde": -2.0, "comision": -2.0}, -2.0)
    for t in ("p.e.n.d.e.j.o", "p3nd3j0", "pen*dejo", "pendejooo"):
        text = f"La reunión siguió.\nEl alcalde de la comisión es un {t}"
        assert m.document(text) > 0.5 and m.document(text) == max(m.document("La reunión siguió."), m.passage(text.split("\n")[1]))
    assert not A.disguises("el ano 2026 cerro con 14 casos.") and A.disguises("1d10t4")
    # what stands undisguised isn't lost by undoing disguises
    assert of_words({"xxx": 9.0}, -2.0).document("videos xxx") > 0.5


def test_every_passage_trains(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD", 9_000, raising=False)
    letters = "translate(lpad(conv(id, 10, 16), 5, '0'), '0123456789ABCDEF', 'bcdfghjklmnpqrst')"
    docs = spark.range(24_000).selectExpr("id AS doc_id", f"concat('El informe cita a w', {letters}, IF(id % 800 = 0, '\\nEres un idiota, das asco v', '\\nLa obra sigue v'), {letters}) AS text")
    m = A.fit(docs, None)
    one = lambda w: float(m.weights[A.features([w])[1][0]])
    words = {w for r in docs.collect() for p in A.passages(r.text) for w in p.split() if w[0] in "wv" and len(w) > 4}
    assert len(words) > 47_000 and sum(one(w.strip(".")) != 0 for w in words) == len(words)
    # the 800th stands with an insult, the 801st doesn't
    assert one("vbbfdb") > one("vbbfdc")


def test_features_equal_plain_counting():
    ps = ["eres un idiota q x y", "", "ñandú 77", "a b"]
    row, bucket, size = A.features(ps)
    assert size.tolist() == [9, 0, 1, 0] and len(row) == len(bucket) == 10
    single = {w: int(A.features([w])[1][0]) for w in ("eres", "idiota", "que")}
    assert set(single.values()) <= set(bucket[row == 0].tolist())


def test_optimiser_reaches_the_ridge_optimum():
    rng = np.random.default_rng(4)
    ps = [" ".join(rng.choice(["alfa", "beta", "gama", "delta", "zeta"], 4)) for _ in range(400)]
    y = np.array([float("alfa" in p) for p in ps])
    names, w, b, often = A.train(ps, y, np.ones(400), rounds=400)
    m = A.Model(names, w, b)
    assert ((np.array([m.document(p) for p in ps]) > 0.5) == (y > 0.5)).mean() > 0.97 and often.sum() > 400


@pytest.mark.parametrize("t,bad", [("You are a stupid idiot", True), ("Los tolmecos son unos animales", True), ("Te voy a partir la cara si vuelves", True), ("\u0435res un idi\u043eta", True), ("i.d.i.o.t.a, eres un p.e.n.d.e.j.o", True),
                                   ("La policía detuvo a dos hombres por amenazas", False), ("El museo abre el martes", False), ("Voy a matar el tiempo leyendo", False), ("Погода в городе хорошая", False)])
def test_wordings_that_stand_in_no_table(spark, data, t, bad, wide):
    assert (wide.document(t) >= A.THRESHOLD) == bad


@pytest.fixture(scope="module")
def wide(spark, data):
    d = data.replace("sf0.001", "sf0.1")
    return A.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/muestras_moderacion.parquet"))


def test_votes_by_count():
    texts = ["eres un idiota", "el informe del hospital", "ñandú ª del gobierno", "nada"]
    v = A.votes(texts)
    assert (v == [[x if p.search(t) else 0 for _, x, p in A.VOTERS] for t in texts]).all() and (A._unpacked(A._packed(v).tolist()) == v).all()
    n = [3, 40, 7, 50]
    a, b = A.LabelModel().fit(v, None, np.array(n, float)), A.LabelModel().fit(np.repeat(v, n, 0))
    assert np.allclose(a.posterior, b.predict(v)) and np.allclose(a.on, b.on)


def test_all_sentences_of_a_labelled_text():
    assert A._known([("Hola a todos. Buen día.", False)]) == [("hola a todos.", 0.0), ("buen dia.", 0.0)]
    assert A._known([("Hola a todos. Eres un idiota.", True)]) == [("hola a todos.", -1.0), ("eres un idiota.", 1.0)]


def test_hints_miss_no_disguise():
    texts = [["eres un i.d.i.o.t.a"], ["1d10ta"], ["pen*dejo"], ["nooo"], ["nada que ver", "sin mas"], []]
    assert A.undisguise(texts) == [[A.undisguised(p) for p in ps if A.disguises(p)] for ps in texts]
