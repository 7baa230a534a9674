"""Queries of text, address, cell and time functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, clock, text, url
from ..sources.tables import table

NOW = "2026-06-01 00:00:00"


def _fold(x: str) -> str:
    return f"translate(lower({x}), '{text.MARKED}', '{text.BARE}')"


def _words(x: str) -> str:
    return f"trim(regexp_replace({_fold(x)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _ascii(x: str) -> str:
    return f"trim(regexp_replace({_fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def ascii_key(c: str):  # noqa: ANN201
    """Folded ASCII words; edit distances over these are the same in every engine."""
    return F.trim(F.regexp_replace(text.fold(c), "[^a-z0-9]+", " "))


def _notes(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return table(spark, folder, "noticias").select(*cols).distinct()


def fold_text(spark: SparkSession, folder: str) -> DataFrame:
    """Titles folded, with their length."""
    return _notes(spark, folder, "noticia_id", "titulo").select("noticia_id", text.fold("titulo").alias("plegado"), F.length(text.fold("titulo")).alias("largo"))


def content_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Content hash of title and summary."""
    return _notes(spark, folder, "noticia_id", "titulo", "resumen").select("noticia_id", text.content_key("titulo", "resumen").alias("clave"))


def best_text(spark: SparkSession, folder: str) -> DataFrame:
    """Length of the best text layer of each note and its state."""
    layers = ("texto_cuerpo_nota", "texto_nota_limpia", "texto_extraido")
    n = _notes(spark, folder, "noticia_id", "titulo", *layers)
    state = F.when(text.blank_to_null(layers[0]).isNotNull(), "BODY_READY").when(text.blank_to_null(layers[1]).isNotNull(), "CLEAN_ONLY").when(text.first_filled(layers[2], "titulo").isNotNull(), "TITLE_ONLY").otherwise("CONTENT_EMPTY")
    return n.select("noticia_id", F.length(text.first_filled(*layers)).alias("largo"), state.alias("estado"))


def cut_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries cut to 80 characters at a word."""
    return _notes(spark, folder, "noticia_id", "resumen").select("noticia_id", text.cut_words("resumen", 80).alias("corte"))


def title_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Edit similarity of title and the title its address spells."""
    n = _notes(spark, folder, "noticia_id", "titulo", "url_original").withColumn("slug", text.slug_title("url_original"))
    return n.select("noticia_id", F.round(text.similarity(ascii_key("titulo"), ascii_key("slug")), 6).alias("similitud"))


def token_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Word overlap of title and summary."""
    n = _notes(spark, folder, "noticia_id", "titulo", "resumen")
    return n.select("noticia_id", F.round(text.jaccard(text.token_set(F.coalesce("titulo", F.lit(""))), text.token_set(F.coalesce("resumen", F.lit("")))), 6).alias("jaccard"))


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Host, domain, first path segment and listing flag of addresses."""
    n = _notes(spark, folder, "noticia_id", "url_original")
    return n.select("noticia_id", url.host("url_original").alias("host"), url.domain("url_original").alias("dominio"), F.get(url.segments("url_original"), F.lit(0)).alias("seccion"), url.is_listing("url_original").alias("listado"))


def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical address and its hash."""
    n = _notes(spark, folder, "noticia_id", "url_original")
    return n.select("noticia_id", url.canonical("url_original").alias("canonica"), F.sha2(url.canonical("url_original"), 256).alias("hash_url"))


def url_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by the identity of their address across sources."""
    n = _notes(spark, folder, "noticia_id", "url_original")
    return n.groupBy(url.identity("url_original").alias("identidad")).agg(F.count_distinct("noticia_id").alias("notas"))


def cell_booleans(spark: SparkSession, folder: str) -> DataFrame:
    """Activity cells read as booleans."""
    m = table(spark, folder, "medios")
    return m.select("medio_id", cells.boolean(F.when(F.col("activo"), "Sí").otherwise("inactivo")).alias("activo"), cells.boolean(F.col("requiere_proxy").cast("string")).alias("proxy"), cells.integer(F.col("frecuencia_minutos").cast("string")).alias("minutos"))


def local_days(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by client and calendar day of Mexico City."""
    m = table(spark, folder, "menciones").select("mencion_id", "cliente_id", "created_at").distinct()
    return m.groupBy("cliente_id", clock.local_day("created_at").cast("string").alias("dia")).agg(F.count("*").alias("menciones"))


def arrival_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Latency of log rows by source: rows, median and 95th percentile minutes (nearest rank)."""
    log = table(spark, folder, "logs_ingesta").select("log_id", "medio_id", "fecha_hora", "llegada").distinct()
    m = clock.minutes_between("fecha_hora", "llegada")
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by m)")
    return log.withColumn("m", m).groupBy("medio_id").agg(F.count("*").alias("filas"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


def recovery_lanes(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows by recovery lane at a fixed instant."""
    log = table(spark, folder, "logs_ingesta").select("log_id", "llegada").distinct()
    return log.groupBy(clock.lane("llegada", F.lit(NOW).cast("timestamp")).alias("carril")).agg(F.count("*").alias("filas"))


def backoff_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Waits before each attempt."""
    return spark.range(1, 11).select(F.col("id").alias("intento"), clock.backoff_minutes(F.col("id")).alias("minutos"))


def text_search(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with all of some words, none of others, or a phrase, in title, summary or text."""
    n = table(spark, folder, "noticias").select("noticia_id", "titulo", "resumen", "texto_extraido")
    t = F.concat(F.lit(" "), text.fold_words(F.concat_ws(" ", "titulo", "resumen", "texto_extraido")), F.lit(" "))
    hit = lambda w: F.contains(t, F.lit(f" {w} "))
    return n.select("noticia_id", (hit("agua") & hit("comision") & ~hit("dengue")).alias("palabras"), hit("plazo de la investigacion").alias("frase")).where("palabras OR frase").distinct()


QUERIES = {
    "fold_text": fold_text, "content_keys": content_keys, "best_text": best_text, "cut_summary": cut_summary, "title_similarity": title_similarity,
    "token_jaccard": token_jaccard, "url_parts": url_parts, "url_canonical": url_canonical, "url_identity": url_identity, "cell_booleans": cell_booleans,
    "local_days": local_days, "arrival_latency": arrival_latency, "recovery_lanes": recovery_lanes, "backoff_schedule": backoff_schedule, "text_search": text_search,
}

_PARAMS = "list_filter(string_split(regexp_extract(url_original, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '^(utm_\\w+|fbclid|gclid|mc_cid|mc_eid|igshid|ref|ref_src)$'))"
_PATH = "regexp_extract(url_original, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1)"
_HOST = "regexp_replace(regexp_extract(lower(url_original), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '')"
_CANON = f"lower(regexp_extract(url_original, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url_original, '^[A-Za-z]+://([^/?#]+)', 1)) || CASE WHEN {_PATH} IN ('', '/') THEN '' ELSE regexp_replace({_PATH}, '/$', '') END || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string({_PARAMS}, '&') ELSE '' END"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(url_original, '[?#].*$', ''), '/([^/]+)/?$', 1), '\\.\\w{2,5}$', ''), '[-_]+', ' ', 'g'), '(^| )\\d{3,}( |$)', ' ', 'g')"
_NB = "SELECT DISTINCT noticia_id, "
_MIN = "greatest(0, CAST(floor((epoch_us(llegada) - epoch_us(fecha_hora)) / 60000000) AS BIGINT))"

SQL = {
    "fold_text": f"SELECT noticia_id, {_fold('titulo')} AS plegado, length({_fold('titulo')}) AS largo FROM ({_NB} titulo FROM noticias)",
    "content_keys": f"SELECT noticia_id, CASE WHEN length(w) > 0 THEN sha256(w) END AS clave FROM (SELECT noticia_id, {_words(chr(39) + chr(39) + ' || concat_ws(' + chr(39) + ' ' + chr(39) + ', titulo, resumen)')} AS w FROM ({_NB} titulo, resumen FROM noticias))",
    "best_text": f"""SELECT noticia_id, length(coalesce(nullif(trim(texto_cuerpo_nota), ''), nullif(trim(texto_nota_limpia), ''), nullif(trim(texto_extraido), ''))) AS largo,
  CASE WHEN trim(texto_cuerpo_nota) <> '' THEN 'BODY_READY' WHEN trim(texto_nota_limpia) <> '' THEN 'CLEAN_ONLY' WHEN trim(texto_extraido) <> '' OR trim(titulo) <> '' THEN 'TITLE_ONLY' ELSE 'CONTENT_EMPTY' END AS estado
  FROM ({_NB} titulo, texto_cuerpo_nota, texto_nota_limpia, texto_extraido FROM noticias)""",
    "cut_summary": f"""SELECT noticia_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substr(t, 1, 80), '\\s+\\S*$', '') END AS corte
  FROM (SELECT noticia_id, trim(regexp_replace(resumen, '\\s+', ' ', 'g')) AS t FROM ({_NB} resumen FROM noticias))""",
    "title_similarity": f"""SELECT noticia_id, round(CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(length(a), length(b)) = 0 THEN 1.0 WHEN length(a) = 0 OR length(b) = 0 THEN 0.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS similitud
  FROM (SELECT noticia_id, {_ascii('titulo')} AS a, {_ascii(_SLUG)} AS b FROM ({_NB} titulo, url_original FROM noticias))""",
    "token_jaccard": f"""SELECT noticia_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard
  FROM (SELECT noticia_id, list_distinct(list_filter(string_split({_words("coalesce(titulo, '')")}, ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split({_words("coalesce(resumen, '')")}, ' '), lambda x: x <> '')) AS b FROM ({_NB} titulo, resumen FROM noticias))""",
    "url_parts": f"""SELECT noticia_id, h AS host, CASE WHEN regexp_matches(h, '[^.]+\\.(com|org|gob|edu|net|co|gov|ac)\\.[a-z]{{2}}$') THEN regexp_extract(h, '([^.]+\\.(com|org|gob|edu|net|co|gov|ac)\\.[a-z]{{2}})$', 1) ELSE regexp_extract(h, '([^.]+\\.[^.]+)$', 1) END AS dominio,
  s[1] AS seccion, NOT regexp_matches(url_original, '[?&]p=\\d+') AND (len(s) = 0 OR (len(s) <= 2 AND NOT regexp_matches(s[-1], '-.*-|\\d{{4,}}|\\.html?$'))) AS listado
  FROM (SELECT noticia_id, url_original, {_HOST} AS h, list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS s FROM ({_NB} url_original FROM noticias))""",
    "url_canonical": f"SELECT noticia_id, c AS canonica, sha256(c) AS hash_url FROM (SELECT noticia_id, {_CANON} AS c FROM ({_NB} url_original FROM noticias))",
    "url_identity": f"SELECT {_HOST} || regexp_replace({_PATH}, '/+$', '') || CASE WHEN len({_PARAMS}) > 0 THEN '?' || array_to_string(list_sort({_PARAMS}), '&') ELSE '' END AS identidad, count(DISTINCT noticia_id) AS notas FROM ({_NB} url_original FROM noticias) GROUP BY 1",
    "cell_booleans": "SELECT medio_id, coalesce(activo, false) AS activo, requiere_proxy AS proxy, frecuencia_minutos AS minutos FROM medios",
    "local_days": "SELECT cliente_id, CAST(timezone('America/Mexico_City', timezone('UTC', CAST(created_at AS TIMESTAMP))) AS DATE)::VARCHAR AS dia, count(*) AS menciones FROM (SELECT DISTINCT mencion_id, cliente_id, created_at FROM menciones) GROUP BY 1, 2",
    "arrival_latency": f"SELECT medio_id, count(*) AS filas, quantile_disc({_MIN}, 0.5) AS p50, quantile_disc({_MIN}, 0.95) AS p95 FROM (SELECT DISTINCT log_id, medio_id, fecha_hora, llegada FROM logs_ingesta) GROUP BY 1",
    "recovery_lanes": f"SELECT CASE WHEN h <= 2 THEN 'live' WHEN h <= 24 THEN '24h' WHEN h <= 72 THEN '72h' ELSE 'lost' END AS carril, count(*) AS filas FROM (SELECT (epoch_us(TIMESTAMP '{NOW}') - epoch_us(llegada)) / 3600000000 AS h FROM (SELECT DISTINCT log_id, llegada FROM logs_ingesta)) GROUP BY 1",
    "backoff_schedule": "SELECT i AS intento, CASE WHEN i <= 8 THEN least(3600, 15 * 2 ** (i - 1)) END AS minutos FROM range(1, 11) t(i)",
    "text_search": f"""SELECT noticia_id, palabras, frase FROM (SELECT noticia_id, contains(t, ' agua ') AND contains(t, ' comision ') AND NOT contains(t, ' dengue ') AS palabras, contains(t, ' plazo de la investigacion ') AS frase
  FROM (SELECT noticia_id, ' ' || {_words("'' || concat_ws(' ', titulo, resumen, texto_extraido)")} || ' ' AS t FROM ({_NB} titulo, resumen, texto_extraido FROM noticias))) WHERE palabras OR frase""",
}
