"""Queries of keyword matching and mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold, fold_words, snippet
from ..operators import rules as R
from ..operators.keys import first_by
from ..operators.packed import explode_packed
from ..sources.shared import keep
from ..sources.tables import table
from .text import _fold, _words

FIELDS = ("titulo", "resumen", "texto_extraido")
RULES = (
    R.Rule("agua", "exacta", ("agua", "aguas")),
    R.Rule("dengue", "exacta", ("casos de dengue",)),
    R.Rule("seguridad", "booleana", rule='(policia OR "guardia estatal") AND vehiculos NOT dengue'),
    R.Rule("festival", "exacta", ("festival", "museo"), exclude=("carretera", "carreteras")),
    R.Rule("contrato", "exacta", ("contrato",), include=("pesos",)),
    R.Rule("carret", "contiene", ("carreter",)),
)
MAIN = ("agua", "comision", "contrato")


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    # repeats fall away with the results: texts themselves are never compared or shuffled
    return table(spark, folder, "noticias").select("noticia_id", *FIELDS)


def rule_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every note a rule holds for, with its best field."""
    return R.matches(_notes(spark, folder), RULES, FIELDS, "noticia_id").distinct()


def mentions_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Notes and best score by rule."""
    return rule_matches(spark, folder).groupBy("rule_id").agg(F.count("*").alias("notas"), F.max("score").alias("mejor"))


def title_lane(spark: SparkSession, folder: str) -> DataFrame:
    """Matches in title and summary alone."""
    return R.matches(_notes(spark, folder), [r for r in RULES if r.kind == "exacta"], FIELDS[:2], "noticia_id").distinct()


def first_hit(spark: SparkSession, folder: str) -> DataFrame:
    """Position and surroundings of the first whole-word hit in the text."""
    n = _notes(spark, folder).withColumn("t", fold("texto_extraido"))
    at = F.regexp_instr("t", F.lit(R.word_pattern("contrato")))
    return n.withColumn("posicion", at).where("posicion > 0").select("noticia_id", "posicion", snippet(F.col("texto_extraido"), F.col("posicion"), 30).alias("fragmento")).distinct()


def proximity(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with an anchor word within 120 characters of a context word, in the folded words."""
    n = _notes(spark, folder).withColumn("t", fold_words("texto_extraido"))
    a, b = R.positions(F.col("t"), ["agua", "bebidas"]), R.positions(F.col("t"), ["impuesto", "comision"])
    return n.select("noticia_id", F.size(a).alias("anclas"), F.size(b).alias("contextos"), R.near(a, b, 120).alias("cerca")).where("cerca").distinct()


def hit_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Merged windows of 200 characters around the hits of a word."""
    n = _notes(spark, folder).withColumn("t", fold_words("texto_extraido")).withColumn("p", R.positions(F.col("t"), ["agua", "aguas"]))
    w = n.where(F.size("p") > 0).withColumn("w", R.merged_windows(F.col("p"), 200, F.length("t")))
    return w.select("noticia_id", F.size("w").alias("ventanas"), F.aggregate("w", F.lit(0), lambda acc, x: acc + x["e"] - x["s"] + 1).alias("caracteres")).distinct()


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "menciones").distinct()


def mention_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by client, counted once for each note and keyword."""
    m = _mentions(spark, folder).select("noticia_id", "keyword_id", "cliente_id").where("keyword_id IS NOT NULL").distinct()
    return m.groupBy("cliente_id").agg(F.count("*").alias("menciones"), F.count_distinct("noticia_id").alias("notas"), F.count_distinct("keyword_id").alias("keywords"))


def consolidated_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each client and note: best mention, keywords in order, alert, count."""
    m = _mentions(spark, folder)
    best = F.max_by(F.col("mencion_id"), F.struct("score_relevancia", "mencion_id"))
    return m.groupBy("cliente_id", "noticia_id").agg(
        best.alias("mejor"), F.round(F.max("score_relevancia"), 4).alias("score"), F.array_join(F.array_sort(F.collect_set("keyword")), "|").alias("keywords"),
        F.count_distinct("mencion_id").alias("menciones"), F.coalesce(F.bool_or("requiere_alerta"), F.lit(False)).alias("alerta"),
    )


def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Notes whose title, summary or text has an active keyword as whole words."""
    k = table(spark, folder, "keywords").where("activa").select("keyword_id", fold_words("keyword").alias("frase")).where("frase != ''").distinct()
    frases = k.select("frase").distinct().withColumn("frase_id", F.col("frase"))
    hit = keep(R.phrase_hits(_notes(spark, folder), frases, FIELDS, "noticia_id").select("noticia_id", F.col("frase_id").alias("frase")).distinct(), "hits")
    # notes are counted by phrase before its keywords come in; a keyword that stands in the table with several phrases counts each note once
    sets = k.groupBy("keyword_id").agg(F.array_sort(F.collect_set("frase")).alias("frases"))
    one = sets.where("size(frases) = 1").select("keyword_id", F.col("frases")[0].alias("frase")).join(hit.groupBy("frase").agg(F.count("*").alias("notas")), "frase").select("keyword_id", "notas")
    some = sets.where("size(frases) > 1")
    notes = some.select("frases").distinct().select("frases", F.explode("frases").alias("frase")).join(hit, "frase").groupBy("frases").agg(F.count_distinct("noticia_id").alias("notas"))
    return one.unionByName(some.join(notes, "frases").select("keyword_id", "notas"))


def keyword_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with a keyword of the table or one of its aliases, its best field, and no excluded context; an asked context must be there.

    Cells with several values are split as in problem 5.  All kinds of keywords
    are looked for as whole words.
    """
    k = table(spark, folder, "keywords").where("activa")
    cells = [k.select("keyword_id", F.lit("si").alias("rol"), F.col("keyword").alias("frase"))]
    for field, role in (("alias_o_variantes", "si"), ("contexto_excluir", "no"), ("contexto_incluir", "con")):
        cells.append(explode_packed(k, "keyword_id", field).select(F.col("clave").alias("keyword_id"), F.lit(role).alias("rol"), F.col("valor").alias("frase")))
    asked = reduce(DataFrame.unionByName, cells).withColumn("frase", fold_words("frase")).where("frase != ''").distinct()
    frases = keep(asked.select("frase").distinct().withColumn("frase_id", F.monotonically_increasing_id()), "frases")
    hit = R.phrase_hits(_notes(spark, folder), frases, FIELDS, "noticia_id")
    return R.keyword_documents(hit, asked.join(frases, "frase"), "noticia_id")


def lake_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 newest notes of a window of days that have a term in any of five columns."""
    n = table(spark, folder, "noticias").where((F.col("created_at") >= F.lit("2025-10-01").cast("timestamp")) & (F.col("created_at") < F.lit("2026-06-01").cast("timestamp")))
    hit = reduce(Column.__or__, (F.coalesce(F.contains(F.lower(c), F.lit("agua")), F.lit(False)) for c in ("titulo", "resumen", "texto_extraido", "seccion", "medio")))
    return n.where(hit).select("noticia_id", "created_at").distinct().orderBy(F.desc("created_at"), "noticia_id").limit(50).select("noticia_id")


def retrieval_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct folded keywords of three letters or more with their longest spelling."""
    k = table(spark, folder, "keywords").select(fold_words("keyword").alias("termino"), F.trim("keyword").alias("k")).where("length(termino) >= 3")
    return k.groupBy("termino").agg(F.max_by("k", F.struct(F.length("k"), "k")).alias("forma"), F.count("*").alias("filas"))


def mention_details(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions with their note, outlet and client: counts by outlet and client's industry."""
    m = _mentions(spark, folder).select("mencion_id", "noticia_id", "cliente_id").distinct()
    n = table(spark, folder, "noticias").select("noticia_id", "medio_id").distinct()
    o = table(spark, folder, "medios").select("medio_id", "nombre_medio", "categoria")
    c = table(spark, folder, "clientes").select("cliente_id", "industria")
    return m.join(n, "noticia_id").join(o, "medio_id", "left").join(c, "cliente_id", "left").groupBy("nombre_medio", "industria").agg(F.count_distinct("mencion_id").alias("menciones"))


def notes_without_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by outlet that no mention refers to."""
    n = table(spark, folder, "noticias").select("noticia_id", "medio_id").distinct()
    return n.join(_mentions(spark, folder).select("noticia_id").distinct(), "noticia_id", "left_anti").groupBy("medio_id").agg(F.count("*").alias("notas"))


def notes_with_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with a mention that asks for an alert."""
    n = table(spark, folder, "noticias").select("noticia_id", "medio_id").distinct()
    return n.join(_mentions(spark, folder).where("requiere_alerta").select("noticia_id"), "noticia_id", "left_semi")


def active_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords by what their scope makes of them: kept, inactive, of an inactive client or of none."""
    k = first_by(table(spark, folder, "keywords").select("keyword_id", "cliente_id", "activa"), ["keyword_id"], F.col("cliente_id"), F.col("activa"))
    c = table(spark, folder, "clientes").select("cliente_id", F.col("activo").alias("c_activo"))
    state = F.when(~F.col("activa"), "inactiva").when(F.col("c_activo").isNull(), "huerfana").when(~F.col("c_activo"), "cliente_inactivo").otherwise("vigente")
    return k.join(c, "cliente_id", "left").groupBy(state.alias("estado")).agg(F.count("*").alias("keywords"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_matches, mentions_by_rule, title_lane, first_hit, proximity, hit_windows, mention_counts, consolidated_mentions, keyword_hits, keyword_mentions, lake_search, retrieval_terms, mention_details,
        notes_without_mentions, notes_with_alerts, active_scope,
    )
}

_N = f"SELECT DISTINCT noticia_id, {_fold('titulo')} AS titulo, {_fold('resumen')} AS resumen, {_fold('texto_extraido')} AS texto, concat_ws(chr(10), {_fold('titulo')}, {_fold('resumen')}, {_fold('texto_extraido')}) AS todo FROM noticias"


def _re(c: str, *terms: str) -> str:
    return f"coalesce(regexp_matches({c}, '(^|[^\\p{{L}}\\p{{N}}])(" + "|".join(t.replace(" ", "\\s+") for t in terms) + ")($|[^\\p{L}\\p{N}])'), false)"


def _best(terms: tuple[str, ...], fields: tuple[tuple[str, str, float], ...]) -> tuple[str, str]:
    campo = "CASE " + " ".join(f"WHEN {_re(c, *terms)} THEN '{n}'" for c, n, _ in fields) + " END"
    score = "CASE " + " ".join(f"WHEN {_re(c, *terms)} THEN {w}" for c, _, w in fields) + " END"
    return campo, score


_F3 = (("titulo", "titulo", 1.0), ("resumen", "resumen", 0.6), ("texto", "texto_extraido", 0.4))


def _rule(rid: str, terms: tuple[str, ...], fields=_F3, also: str = "true") -> str:  # noqa: ANN001
    campo, score = _best(terms, fields)
    return f"SELECT noticia_id, '{rid}' AS rule_id, {campo} AS campo, CAST({score} AS DOUBLE) AS score FROM n WHERE {campo} IS NOT NULL AND {also}"


_SEG = f"({_re('todo', 'policia')} OR {_re('todo', 'guardia estatal')}) AND {_re('todo', 'vehiculos')} AND NOT {_re('todo', 'dengue')}"
_CONT = "CASE WHEN contains(titulo, 'carreter') THEN {0} WHEN contains(resumen, 'carreter') THEN {1} WHEN contains(texto, 'carreter') THEN {2} END"
_ALL = f"""WITH n AS ({_N}) {_rule('agua', ('agua', 'aguas'))} UNION ALL {_rule('dengue', ('casos de dengue',))} UNION ALL {_rule('seguridad', ('policia', 'guardia estatal', 'vehiculos', 'dengue'), also=_SEG)}
UNION ALL {_rule('festival', ('festival', 'museo'), also='NOT ' + _re('todo', 'carretera', 'carreteras'))} UNION ALL {_rule('contrato', ('contrato',), also=_re('todo', 'pesos'))}
UNION ALL SELECT noticia_id, 'carret', {_CONT.format("'titulo'", "'resumen'", "'texto_extraido'")}, CAST({_CONT.format(1.0, 0.6, 0.4)} AS DOUBLE) FROM n WHERE {_CONT.format(1, 1, 1)} = 1"""
_M = "(SELECT DISTINCT * FROM menciones)"

SQL = {
    "rule_matches": _ALL,
    "mentions_by_rule": f"SELECT rule_id, count(*) AS notas, max(score) AS mejor FROM ({_ALL}) GROUP BY 1",
    "title_lane": f"WITH n AS (SELECT noticia_id, titulo, resumen, concat_ws(chr(10), titulo, resumen) AS todo FROM ({_N})) "
    + " UNION ALL ".join(
        (_rule("agua", ("agua", "aguas"), _F3[:2]), _rule("dengue", ("casos de dengue",), _F3[:2]), _rule("festival", ("festival", "museo"), _F3[:2], "NOT " + _re("todo", "carretera", "carreteras")), _rule("contrato", ("contrato",), _F3[:2], _re("todo", "pesos")))
    ),
    "first_hit": f"""SELECT noticia_id, p AS posicion, CASE WHEN p > 31 THEN '…' ELSE '' END || trim(substr(raw, greatest(1, p - 30), least(length(raw), p + 30) - greatest(1, p - 30) + 1)) || CASE WHEN p + 30 < length(raw) THEN '…' ELSE '' END AS fragmento
  FROM (SELECT noticia_id, raw, length(string_split_regex(' ' || t || ' ', '[^\\p{{L}}\\p{{N}}]contrato[^\\p{{L}}\\p{{N}}]')[1]) + 1 AS p, t FROM (SELECT DISTINCT noticia_id, texto_extraido AS raw, {_fold('texto_extraido')} AS t FROM noticias)) WHERE {_re('t', 'contrato')}""",
    "proximity": f"""WITH w AS (SELECT noticia_id, string_split({_words('texto_extraido')}, ' ') AS ws FROM (SELECT DISTINCT noticia_id, titulo, resumen, texto_extraido FROM noticias) WHERE texto_extraido IS NOT NULL),
  p AS (SELECT noticia_id, u.w, coalesce(sum(length(u.w) + 1) OVER (PARTITION BY noticia_id ORDER BY u.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS at FROM w, LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) u),
  a AS (SELECT * FROM p WHERE w IN ('agua', 'bebidas')), b AS (SELECT * FROM p WHERE w IN ('impuesto', 'comision'))
  SELECT x.noticia_id, x.anclas, y.contextos, true AS cerca FROM (SELECT noticia_id, CAST(count(*) AS INTEGER) AS anclas FROM a GROUP BY 1) x JOIN (SELECT noticia_id, CAST(count(*) AS INTEGER) AS contextos FROM b GROUP BY 1) y USING (noticia_id)
  WHERE EXISTS (SELECT 1 FROM a JOIN b USING (noticia_id) WHERE a.noticia_id = x.noticia_id AND abs(a.at - b.at) <= 120)""",
    "mention_counts": "SELECT cliente_id, count(*) AS menciones, count(DISTINCT noticia_id) AS notas, count(DISTINCT keyword_id) AS keywords FROM (SELECT DISTINCT noticia_id, keyword_id, cliente_id FROM menciones WHERE keyword_id IS NOT NULL) GROUP BY 1",
    "consolidated_mentions": f"SELECT cliente_id, noticia_id, arg_max(mencion_id, (score_relevancia, mencion_id)) AS mejor, round(max(score_relevancia), 4) AS score, coalesce(string_agg(DISTINCT keyword, '|' ORDER BY keyword), '') AS keywords, count(DISTINCT mencion_id) AS menciones, coalesce(bool_or(requiere_alerta), false) AS alerta FROM {_M} GROUP BY 1, 2",
    "keyword_hits": f"""WITH k AS (SELECT DISTINCT keyword_id, {_words('keyword')} AS frase FROM keywords WHERE activa),
  f AS (SELECT DISTINCT noticia_id, unnest([' ' || {_words('titulo')} || ' ', ' ' || {_words('resumen')} || ' ', ' ' || {_words('texto_extraido')} || ' ']) AS t FROM noticias)
  SELECT keyword_id, count(DISTINCT noticia_id) AS notas FROM k JOIN f ON frase <> '' AND contains(t, ' ' || frase || ' ') GROUP BY 1""",
    "lake_search": """SELECT noticia_id FROM (SELECT DISTINCT noticia_id, created_at FROM noticias WHERE created_at >= TIMESTAMP '2025-10-01' AND created_at < TIMESTAMP '2026-06-01'
  AND (titulo ILIKE '%agua%' OR resumen ILIKE '%agua%' OR texto_extraido ILIKE '%agua%' OR seccion ILIKE '%agua%' OR medio ILIKE '%agua%')) ORDER BY created_at DESC, noticia_id LIMIT 50""",
    "retrieval_terms": f"SELECT w AS termino, arg_max(k, (length(k), k)) AS forma, count(*) AS filas FROM (SELECT {_words('keyword')} AS w, trim(keyword) AS k FROM keywords) WHERE length(w) >= 3 GROUP BY 1",
    "mention_details": f"SELECT nombre_medio, industria, count(DISTINCT mencion_id) AS menciones FROM {_M} m JOIN (SELECT DISTINCT noticia_id, medio_id FROM noticias) n USING (noticia_id) LEFT JOIN medios o USING (medio_id) LEFT JOIN clientes c ON m.cliente_id = c.cliente_id GROUP BY 1, 2",
    "notes_without_mentions": "SELECT medio_id, count(*) AS notas FROM (SELECT DISTINCT noticia_id, medio_id FROM noticias) n WHERE NOT EXISTS (SELECT 1 FROM menciones m WHERE m.noticia_id = n.noticia_id) GROUP BY 1",
    "notes_with_alerts": "SELECT noticia_id, medio_id FROM (SELECT DISTINCT noticia_id, medio_id FROM noticias) n WHERE EXISTS (SELECT 1 FROM menciones m WHERE m.noticia_id = n.noticia_id AND requiere_alerta)",
    "active_scope": """SELECT CASE WHEN NOT activa THEN 'inactiva' WHEN c.activo IS NULL THEN 'huerfana' WHEN NOT c.activo THEN 'cliente_inactivo' ELSE 'vigente' END AS estado, count(*) AS keywords
  FROM (SELECT keyword_id, cliente_id, activa FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY cliente_id NULLS FIRST, activa NULLS FIRST) AS r FROM keywords) WHERE r = 1) k LEFT JOIN clientes c USING (cliente_id) GROUP BY 1""",
}
