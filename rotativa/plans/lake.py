"""Queries of filters, snapshots, checks, ingest and export over the news tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, text, url
from ..operators import graphs, queue
from ..sources import feeds
from ..sources.tables import table
from .text import _CANON, _HOST, _PATH, _ascii, ascii_key

CUT, FROM, TO = "2026-02-01 00:00:00", "2025-10-01 00:00:00", "2026-06-01 00:00:00"
# Path segments of pages that list notes, and endings of files that are none.
LISTS = {"etiqueta": ("tag", "tags", "etiqueta", "etiquetas", "tema", "temas"), "autor": ("autor", "autores", "author"), "buscador": ("search", "buscar", "busqueda"), "pagina": ("page", "pagina")}
FILES = r"\.(pdf|jpg|jpeg|png|gif|mp4|xml)$"
#: Patterns of addresses a source's crawler leaves out; ``*`` is every source.
REJECTS = (("*", "/galerias?/"), ("*", "/videos?/"), ("*", "[?&]page=[0-9]+"), ("*", "/clima/"))
# Headings at which a page's article ends, and lines that are none of it.
ENDS = r"^(te puede interesar|lo más leído|más noticias|notas relacionadas|más de esta sección|sigue leyendo)"
NOISE = r"^(publicidad|anuncio|compartir.*|síguenos.*|suscríbete.*)$"


def _n(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return table(spark, folder, "noticias").select(*cols).distinct()


def _t(x: str) -> Column:
    return F.lit(x).cast("timestamp")


def _filled(c: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))


def source_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a source is crawled, and the first reason why not."""
    m = table(spark, folder, "medios")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    why = F.when(~yes("activo"), "inactiva").when(yes("requiere_javascript"), "javascript").when(yes("requiere_proxy"), "proxy").when(~_filled("rss_url") & ~_filled("sitemap_url"), "sin_metodo").otherwise("incluida")
    return m.select("medio_id", (why == "incluida").alias("incluir"), why.alias("motivo"))


def source_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Sources by validity: active, without scripts or proxy, with a feed or site map over HTTP."""
    m = table(spark, folder, "medios")
    http = lambda c: F.coalesce(F.lower(c).startswith("http"), F.lit(False))
    good = F.coalesce(F.col("activo") & ~F.col("requiere_javascript") & ~F.col("requiere_proxy"), F.lit(False)) & (http("rss_url") | http("sitemap_url"))
    return m.groupBy(good.alias("valida")).agg(F.count("*").alias("medios"))


def url_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Notes whose address a rule of its source leaves out, by rule; the rules are a small table of patterns."""
    rules = spark.createDataFrame(list(REJECTS), "medio_regla string, patron string")
    n = _n(spark, folder, "noticia_id", "medio_id", "url_original")
    # a constant number of rules, evaluated in one pass
    hit = F.explode(F.array(*(F.when(((F.lit(m) == "*") | (F.col("medio_id") == m)) & F.col("url_original").rlike(p), F.lit(p)) for m, p in REJECTS))).alias("patron")
    found = n.select("noticia_id", hit).where("patron IS NOT NULL").groupBy("patron").agg(F.count_distinct("noticia_id").alias("notas"))
    return rules.select("patron").join(found, "patron", "left").select("patron", F.coalesce("notas", F.lit(0)).alias("notas"))


def address_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of each note's address by its path: the first of front page, list, file, section, else note."""
    s = F.transform(url.segments("url_original"), F.lower)
    kind = F.when(F.size(s) == 0, "portada")
    for name, words in LISTS.items():
        kind = kind.when(F.arrays_overlap(s, F.array(*map(F.lit, words))), name)
    kind = kind.when(F.lower(url.path("url_original")).rlike(FILES), "archivo").when((F.size(s) == 1) & ~F.element_at(s, 1).contains("-"), "seccion").otherwise("nota")
    return _n(spark, folder, "noticia_id", "url_original").select("noticia_id", kind.alias("clase"))


def pending_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Unprocessed notes with a body from active sources, by source."""
    m = table(spark, folder, "medios").where("activo").select("medio_id")
    n = table(spark, folder, "noticias").where(~F.coalesce("menciones_procesado", F.lit(False)) & _filled("texto_cuerpo_nota")).select("noticia_id", "medio_id").distinct()
    return n.join(m, "medio_id", "left_semi").groupBy("medio_id").agg(F.count("*").alias("notas"))


def window_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by their place against a window of capture."""
    n = _n(spark, folder, "noticia_id", "created_at")
    why = F.when(F.col("created_at").isNull(), "sin_fecha").when(F.col("created_at") < _t(FROM), "anterior").when(F.col("created_at") >= _t(TO), "posterior").otherwise("dentro")
    return n.groupBy(why.alias("ventana")).agg(F.count("*").alias("notas"))


def excluded_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of blocked sources and of all others."""
    n, blocked = _n(spark, folder, "noticia_id", "medio_id"), table(spark, folder, "medios").where("requiere_proxy").select("medio_id")
    count = lambda df, side: df.agg(F.count("*").alias("notas"), F.count_distinct("medio_id").alias("medios")).select(F.lit(side).alias("lado"), "notas", "medios")
    return count(n.join(blocked, "medio_id", "left_semi"), "bloqueadas").unionByName(count(n.join(blocked, "medio_id", "left_anti"), "restantes"))


def title_context(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with an anchor in the title and its context in the title or only in the text."""
    n = table(spark, folder, "noticias")
    word = lambda c, w: F.coalesce(F.concat(F.lit(" "), text.fold_words(c), F.lit(" ")).contains(f" {w} "), F.lit(False))
    anchor, near, far = word("titulo", "gobierno"), word("titulo", "obra"), word("texto_extraido", "obra")
    return n.select("noticia_id", F.when(anchor & near, "titulo").when(anchor & far, "texto").alias("contexto")).where("contexto IS NOT NULL").distinct()


def body_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with each layer of text, by capture method."""
    n = table(spark, folder, "noticias").select("noticia_id", "fuente_metodo", *(_filled(c).alias(a) for c, a in (("texto_cuerpo_nota", "c"), ("texto_nota_limpia", "l"), ("texto_extraido", "p"), ("titulo", "t")))).distinct()
    some = F.col("c") | F.col("l") | F.col("p")
    return n.groupBy("fuente_metodo").agg(F.count_if("c").alias("con_cuerpo"), F.count_if(~F.col("c") & F.col("l")).alias("solo_limpio"), F.count_if(~some & F.col("t")).alias("solo_titulo"), F.count_if(~some & ~F.col("t")).alias("vacias"))


def tolerance_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of feeds by the strictest way another note matches them: address, canonical address, title near in time, title, host and title.

    Each way is an equality against distinct keys, so pairs are never formed.
    """
    n = _n(spark, folder, "noticia_id", "medio_id", "titulo", "url_original", "created_at", "fuente_metodo").select(
        "noticia_id", "medio_id", ascii_key("titulo").alias("t"), F.trim("url_original").alias("u"), url.canonical("url_original").alias("c"), url.host("url_original").alias("h"), F.to_date("created_at").alias("d"), "fuente_metodo",
    )
    a, b = n.where("fuente_metodo = 'rss'"), n.where("fuente_metodo != 'rss'")
    days = b.select("medio_id", "t", F.explode(F.sequence(F.date_sub("d", 3), F.date_add("d", 3))).alias("d"))
    out = a
    for level, keys, side in ((5, ["u"], b), (4, ["c"], b), (3, ["medio_id", "t", "d"], days), (2, ["medio_id", "t"], b), (1, ["h", "t"], b)):
        known = side.select(*keys).dropna().where("t != ''" if "t" in keys else "true").distinct().withColumn(f"n{level}", F.lit(level))
        out = out.join(known, keys, "left")
    return out.groupBy("noticia_id").agg(F.max(F.coalesce(*(F.col(f"n{x}") for x in (5, 4, 3, 2, 1)), F.lit(0))).alias("nivel"))


def name_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings of outlets against the catalogue: the best name that shares a word, by edit distance or words."""
    have = table(spark, folder, "noticias").select(ascii_key("medio").alias("escrito")).where("escrito != ''").distinct()
    m = table(spark, folder, "medios").select(F.col("medio_id"), ascii_key("nombre_medio").alias("nombre")).where("nombre != ''")
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, " "), lambda x: F.length(x) > 3))).alias("w")
    pairs = have.select("escrito", words("escrito")).join(m.select("medio_id", "nombre", words("nombre")), "w").select("escrito", "medio_id", "nombre").distinct()
    score = F.greatest(text.similarity(F.col("escrito"), F.col("nombre")), text.jaccard(text.token_set("escrito"), text.token_set("nombre")))
    best = pairs.withColumn("s", F.round(score, 6)).groupBy("escrito").agg(F.max(F.struct("s", "medio_id")).alias("m"))
    state = F.when(F.col("m.s") == 1, "exacto").when(F.col("m.s") >= 0.9, "seguro").when(F.col("m.s") >= 0.8, "probable").otherwise("revisar")
    return best.select("escrito", "m.medio_id", F.col("m.s").alias("parecido"), state.alias("estado"))


def source_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of each source before and after an instant, and their difference where both are known."""
    n = _n(spark, folder, "noticia_id", "medio_id", "created_at").where("created_at IS NOT NULL")
    late = F.col("created_at") >= _t(CUT)
    g = n.groupBy("medio_id").agg(F.count_if(~late).alias("antes"), F.count_if(late).alias("despues"))
    whole = (F.col("antes") > 0) & (F.col("despues") > 0)
    return g.select("medio_id", "antes", "despues", F.when(whole, F.col("despues") - F.col("antes")).alias("cambio"), F.when(whole, "COMPLETO").otherwise("PARCIAL").alias("estado"))


def _clusters(spark: SparkSession, folder: str) -> DataFrame:
    n = _n(spark, folder, "noticia_id", "medio_id", "titulo", "resumen").withColumn("cluster_id", text.content_key("titulo", "resumen")).where("cluster_id IS NOT NULL")
    return n.groupBy("cluster_id").agg(F.count_distinct("noticia_id").alias("notas"), F.count_distinct("medio_id").alias("medios"))


def cluster_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of the clusters of republished notes."""
    c = _clusters(spark, folder)
    return c.agg(F.count("*").alias("grupos"), F.count_if(F.col("notas") == 1).alias("unicos"), F.count_if(F.col("notas") > 1).alias("repetidos"), F.count_if(F.col("medios") > 1).alias("entre_medios"), F.count_if(F.col("medios") >= 3).alias("sindicados"), F.max("notas").alias("mayor"), F.sum(F.col("notas") - 1).alias("sobrantes"))


def cluster_states(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters by state: syndicated from three outlets on, shared by two, repeated within one, single."""
    state = F.when(F.col("medios") >= 3, "sindicado").when(F.col("medios") == 2, "compartido").when(F.col("notas") > 1, "repetido").otherwise("unico")
    return _clusters(spark, folder).groupBy(state.alias("estado")).agg(F.count("*").alias("grupos"), F.sum("notas").alias("notas"))


def source_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, notes and texts of each source, and whether stated lengths drift from the texts."""
    n = table(spark, folder, "noticias").select("medio_id", "noticia_id", _filled("texto_nota_limpia").alias("l"), _filled("texto_cuerpo_nota").alias("c"), F.length("texto_cuerpo_nota").alias("largo"), "cuerpo_nota_chars")
    per = n.groupBy("medio_id", "noticia_id").agg(F.count("*").alias("filas"), F.bool_or("l").alias("l"), F.bool_or("c").alias("c"), F.bool_or(F.coalesce(F.col("largo") != F.col("cuerpo_nota_chars"), F.lit(False))).alias("d"))
    return per.groupBy("medio_id").agg(F.sum("filas").alias("filas"), F.count("*").alias("notas"), (F.sum("filas") - F.count("*")).alias("repetidas"), F.count_if("l").alias("limpias"), F.count_if("c").alias("cuerpos"), F.count_if("d").alias("desvios"))


def content_sanity(spark: SparkSession, folder: str) -> DataFrame:
    """Defects of each source's notes, their rate, the first example, and whether they block."""
    n = table(spark, folder, "noticias").select(
        "noticia_id", "medio_id", (~_filled("titulo")).alias("d1"), F.coalesce(F.trim("texto_cuerpo_nota") == F.trim("titulo"), F.lit(False)).alias("d2"),
        F.coalesce(F.length(F.trim("texto_cuerpo_nota")).between(1, 199), F.lit(False)).alias("d3"), (F.size(url.segments("url_original")) == 0).alias("d4"),
    ).distinct()
    bad = F.col("d1") | F.col("d2") | F.col("d3") | F.col("d4")
    g = n.groupBy("medio_id").agg(F.count("*").alias("notas"), *(F.count_if(d).alias(a) for d, a in (("d1", "sin_titulo"), ("d2", "solo_titulo"), ("d3", "cortas"), ("d4", "portadas"))), F.count_if(bad).alias("malas"), F.min(F.when(bad, F.col("noticia_id"))).alias("ejemplo"))
    rate = F.round(F.col("malas") / F.col("notas"), 6)
    return g.select("*", rate.alias("parte"), ((F.col("malas") >= 2) & (rate >= 0.05)).alias("bloquea"))


def availability_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios of each source over what is available; null where nothing is."""
    n = table(spark, folder, "noticias").select("noticia_id", "medio_id", _filled("texto_extraido").alias("p"), _filled("texto_nota_limpia").alias("l"), _filled("texto_cuerpo_nota").alias("c"), _filled("autor").alias("a"), F.col("fecha_publicacion").isNotNull().alias("f")).distinct()
    share = lambda x, of: F.round(F.count_if(x) / F.nullif(F.count_if(of), F.lit(0)), 6)
    every = F.lit(True)
    return n.groupBy("medio_id").agg(share(F.col("p"), every).alias("con_pagina"), share(F.col("l") & F.col("p"), F.col("p")).alias("limpia_de_pagina"), share(F.col("c") & F.col("l"), F.col("l")).alias("cuerpo_de_limpia"), share(F.col("a") & F.col("c"), F.col("c")).alias("autor_de_cuerpo"), share(F.col("f"), every).alias("con_fecha"))


def class_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and notes of each grade, those with a body apart from the others."""
    n = table(spark, folder, "noticias").select("noticia_id", "medio_id", "calidad_extraccion", _filled("texto_cuerpo_nota").alias("c")).distinct()
    return n.groupBy("calidad_extraccion").agg(F.count_distinct("medio_id").alias("medios"), F.count_if("c").alias("elegibles"), F.count_if(~F.col("c")).alias("excluidas"))


def interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Whether scores of mentions with and without alert overlap, by topic."""
    m = table(spark, folder, "menciones").where("score_relevancia IS NOT NULL AND requiere_alerta IS NOT NULL")
    side = lambda f, x: f(F.when(F.col("requiere_alerta") == x, F.col("score_relevancia")))
    g = m.groupBy("tema").agg(side(F.min, True).alias("a0"), side(F.max, True).alias("a1"), side(F.min, False).alias("b0"), side(F.max, False).alias("b1"))
    r = lambda c: F.round(c, 6)
    return g.select("tema", r(F.greatest("a0", "b0")).alias("desde"), r(F.least("a1", "b1")).alias("hasta"), F.coalesce((F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")), F.lit(False)).alias("traslapa"))


def digest_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of each client in groups of one sentiment and topic, and how much the groups shorten the list."""
    m = table(spark, folder, "menciones").where("requiere_alerta").select("mencion_id", "cliente_id", "sentimiento", "tema").distinct()
    g = m.groupBy("cliente_id", "sentimiento", "tema").agg(F.count("*").alias("n"))
    return g.groupBy("cliente_id").agg(F.sum("n").alias("alertas"), F.count("*").alias("grupos"), F.max("n").alias("mayor"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("reduccion"))


def client_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of each client with mentions: how many, the first and the last."""
    m = table(spark, folder, "menciones").where("keyword IS NOT NULL").groupBy("cliente_id").agg(F.count_distinct("keyword").alias("keywords"), F.min("keyword").alias("primera"), F.max("keyword").alias("ultima"))
    return table(spark, folder, "clientes").select("cliente_id", "nombre_cliente").join(m, "cliente_id")


def batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows by action and level, and those whose counts account for all addresses found."""
    log = table(spark, folder, "logs_ingesta").distinct()
    z = lambda c: F.coalesce(c, F.lit(0))
    whole = z("notas_nuevas") + z("duplicados") + z("errores") == z("urls_detectadas")
    return log.groupBy("accion", F.lower("nivel").alias("nivel")).agg(F.count("*").alias("filas"), F.count_if(whole).alias("cuadran"), F.sum(z("errores")).alias("errores"))


def query_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The slice of keywords a cursor comes to: twenty from the fortieth on, round the end."""
    k = table(spark, folder, "keywords").where("activa").select("keyword_id").distinct()
    # the catalogue's active keywords, ranked by hash
    r = k.withColumn("r", F.row_number().over(Window.orderBy(F.sha2("keyword_id", 256))) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    at = F.pmod(F.col("r") - 40, F.col("n"))
    return r.where(at < 20).select("keyword_id", at.cast("int").alias("orden"))


def view_order(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred notes of a view, newest publication, capture and row first, as strings."""
    n = _n(spark, folder, "noticia_id", "fecha_publicacion", "fecha_captura", "created_at")
    top = n.orderBy(F.desc(F.coalesce("fecha_publicacion", F.lit(""))), F.desc(F.coalesce("fecha_captura", F.lit(""))), F.desc_nulls_last("created_at"), "noticia_id").limit(100)
    return top.select("noticia_id")


def coverage_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The highest state of review any mention of a note has."""
    rank = F.when(F.lower("estado_revision").like("%aprob%"), 1).when(F.col("requiere_alerta"), 2).when(F.col("exportado_xml"), 3).otherwise(4)
    m = table(spark, folder, "menciones").groupBy("noticia_id").agg(F.min(rank).alias("r"))
    return m.groupBy(F.element_at(F.array(*map(F.lit, ("aprobada", "alerta", "exportada", "pendiente"))), F.col("r")).alias("estado")).agg(F.count("*").alias("notas"))


def ingest_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Late notes against earlier ones of the same address: new, promoted (they bring the first body) or duplicate."""
    n = table(spark, folder, "noticias").where("url_canonica IS NOT NULL").select("noticia_id", "url_canonica", "created_at", _filled("texto_cuerpo_nota").alias("c")).distinct()
    old = n.where(F.col("created_at") < _t(CUT)).groupBy("url_canonica").agg(F.bool_or("c").alias("tenia"))
    plan = F.when(F.col("tenia").isNull(), "nueva").when(F.col("c") & ~F.col("tenia"), "promovida").otherwise("duplicada")
    return n.where(F.col("created_at") >= _t(CUT)).join(old, "url_canonica", "left").groupBy(plan.alias("plan")).agg(F.count("*").alias("notas"))


def record_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of the six fields that make a captured note."""
    cols = ("fecha_publicacion", "medio", "titulo", "url_original", "autor", "seccion")
    return _n(spark, folder, "noticia_id", *cols).select("noticia_id", F.sha2(F.concat_ws("|", *(F.coalesce(F.trim(c), F.lit("")) for c in cols)), 256).alias("hash_registro")).distinct()


def source_identity(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of the catalogue by identity: new, alias of an earlier one of the same host, or edition of a domain's first."""
    m = table(spark, folder, "medios").select("medio_id", url.host("url_base").alias("h"), url.domain("url_base").alias("d")).where("h IS NOT NULL")
    by_host, by_domain = m.groupBy("h").agg(F.min("medio_id").alias("a")), m.groupBy("d").agg(F.min("medio_id").alias("b"))
    state = F.when(F.col("a") != F.col("medio_id"), "ALIAS_OF").when(F.col("b") != F.col("medio_id"), "REGIONAL_EDITION").otherwise("NEW")
    return m.join(by_host, "h").join(by_domain, "d").select("medio_id", state.alias("estado"), F.when(state == "ALIAS_OF", F.col("a")).when(state == "REGIONAL_EDITION", F.col("b")).alias("de"))


def dedupe_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions and their keys by the part that makes the key: note, else keyword, else the mention itself."""
    m = table(spark, folder, "menciones")
    key = F.coalesce(F.concat("cliente_id", F.lit("//"), "noticia_id", F.lit("//"), "keyword_id"), F.concat("cliente_id", F.lit("::"), "noticia_id"), F.col("mencion_id"))
    kind = F.when(F.col("keyword_id").isNotNull(), "keyword").when(F.col("noticia_id").isNotNull(), "nota").otherwise("mencion")
    return m.groupBy(kind.alias("por")).agg(F.count("*").alias("filas"), F.count_distinct(key).alias("claves"))


def clean_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of each page text up to the heading where its article ends, without noise lines, and its grade."""
    n = table(spark, folder, "noticias").where("texto_extraido IS NOT NULL")
    lines = F.transform(F.split(F.regexp_replace("texto_extraido", "\r", ""), "\n"), lambda x: F.trim(x))
    end = F.array_position(F.transform(lines, lambda x: F.lower(x).rlike(ENDS)), True)
    kept = F.filter(F.when(end > 0, F.slice(lines, F.lit(1), end - 1)).otherwise(lines), lambda x: (x != "") & ~F.lower(x).rlike(NOISE))
    size = F.aggregate(kept, F.lit(0), lambda acc, x: acc + F.length(x))
    grade = F.when(size >= 1200, "alta").when(size >= 400, "media").when(size > 0, "baja").otherwise("vacia")
    return n.select("noticia_id", F.size(kept).alias("lineas"), size.alias("largo"), grade.alias("calidad")).distinct()


def image_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of images made absolute against their note; none where they are data."""
    i, base = F.trim("imagen_url"), F.regexp_extract("url_original", r"^(https?://[^/]+)", 1)
    full = F.when(i.rlike("^https?://"), i).when(i.startswith("//"), F.concat(F.lit("https:"), i)).when(i.startswith("/"), F.concat(base, i)).when((i == "") | i.startswith("data:"), None).otherwise(F.concat(base, F.lit("/"), i))
    return _n(spark, folder, "noticia_id", "imagen_url", "url_original").select("noticia_id", full.alias("imagen"))


def unwrapped_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses taken out of a redirect's parameter; others as they are."""
    n = _n(spark, folder, "noticia_id", "url_original").withColumn("u", F.when(F.substring("noticia_id", 1, 1) < "8", F.concat(F.lit("https://noticias.example/url?q="), F.url_encode("url_original"), F.lit("&sa=1"))).otherwise(F.col("url_original")))
    inner = F.regexp_extract("u", r"^https://noticias\.example/url\?q=([^&]+)", 1)
    return n.select("noticia_id", F.when(inner != "", F.url_decode(inner)).otherwise(F.col("u")).alias("destino"))


def clamped_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by score kept between 0.2 and 0.9 and rounded to a tenth."""
    s = F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.2), F.col("score_relevancia"))), 1)
    return table(spark, folder, "menciones").select("mencion_id", "score_relevancia").distinct().where("score_relevancia IS NOT NULL").groupBy(s.alias("puntaje")).agg(F.count("*").alias("menciones"))


def retry_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds to wait by a Retry-After header: a number, a date against a fixed now, else a minute; at most an hour."""
    rows = [("120",), ("0",), ("Wed, 03 Jun 2026 10:05:00 GMT",), ("Wed, 03 Jun 2026 09:00:00 GMT",), ("pronto",), ("999999",)]
    v = spark.createDataFrame(rows, "cabecera string")
    # read by parts, so that neither locale nor parser settings matter
    part = lambda i: F.regexp_extract("cabecera", r"^\w{3}, (\d{2}) (\w{3}) (\d{4}) (\d{2}:\d{2}:\d{2}) GMT$", i)
    months = F.create_map(*(F.lit(x) for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1) for x in (m, f"{i:02d}")))
    when = F.try_to_timestamp(F.concat(part(3), F.lit("-"), F.try_element_at(months, part(2)), F.lit("-"), part(1), F.lit(" "), part(4)))
    wait = F.when(F.col("cabecera").rlike(r"^\d+$"), F.col("cabecera").cast("long")).when(when.isNotNull(), F.unix_seconds(when) - F.unix_seconds(_t("2026-06-03 10:00:00"))).otherwise(60)
    return v.select("cabecera", F.least(F.lit(3600), F.greatest(F.lit(0), wait)).cast("long").alias("segundos"))


def debt_states(spark: SparkSession, folder: str) -> DataFrame:
    """Sources by what became of their failed captures: paid by a later success, to be tried again, or escalated after three."""
    log = table(spark, folder, "logs_ingesta").where("medio_id IS NOT NULL").select("medio_id", "log_id", "fecha_hora", "nivel").distinct()
    h = queue.failures_in_a_row(log, "medio_id", ~F.lower("nivel").isin("error"), "fecha_hora", "log_id")
    return h.groupBy(F.when(F.col("fallos") >= 3, "escalada").when(F.col("fallos") > 0, "reintento").otherwise("pagada").alias("estado")).agg(F.count("*").alias("medios"))


def flat_export(spark: SparkSession, folder: str) -> DataFrame:
    """Notes in the columns of an export sheet."""
    n = _n(spark, folder, "noticia_id", "fecha_publicacion", "medio", "titulo", "url_canonica", "url_original", "seccion", "autor")
    blank = lambda *c: F.coalesce(*map(F.col, c), F.lit(""))
    return n.select(F.col("noticia_id").alias("id"), blank("fecha_publicacion").alias("fecha"), blank("medio").alias("medio"), blank("titulo").alias("titulo"), blank("url_canonica", "url_original").alias("url"), blank("seccion").alias("seccion"), blank("autor").alias("autor"))


def raw_export(spark: SparkSession, folder: str) -> DataFrame:
    """The first hundred notes since an instant that weren't processed yet, oldest first."""
    n = table(spark, folder, "noticias").where((F.col("created_at") >= _t(CUT)) & ~F.coalesce("menciones_procesado", F.lit(False)))
    return n.select("noticia_id", "created_at").distinct().orderBy("created_at", "noticia_id").limit(100).select("noticia_id")


def local_hours(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by hour of the day in Mexico City."""
    m = table(spark, folder, "menciones").select("mencion_id", "created_at").distinct()
    return m.groupBy(F.hour(F.from_utc_timestamp("created_at", clock.MEXICO)).alias("hora")).agg(F.count("*").alias("menciones"))


def _escaped(c: str) -> Column:
    out = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def feed_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Notes written as feeds of one item and read again."""
    n = _n(spark, folder, "noticia_id", "titulo", "url_original").where("trim(titulo) != '' AND url_original IS NOT NULL")
    xml = n.select("noticia_id", F.concat(F.lit("<rss><channel><item><title>"), _escaped("titulo"), F.lit("</title><link>"), _escaped("url_original"), F.lit("</link></item></channel></rss>")).alias("xml"))
    return feeds.explode_items(xml, "noticia_id", "xml", feeds.feed_items).select("noticia_id", "posicion", "url", F.trim("titulo").alias("titulo"))


def sitemap_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses written as site maps of one address and read again."""
    n = _n(spark, folder, "noticia_id", "url_original").where("url_original IS NOT NULL")
    xml = n.select("noticia_id", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), _escaped("url_original"), F.lit("</loc><lastmod>2026-01-02</lastmod></url></urlset>")).alias("xml"))
    return feeds.explode_items(xml, "noticia_id", "xml", feeds.sitemap_items).select("noticia_id", "url", "fecha")


def page_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Notes written as pages and read again: section and canonical address."""
    n = _n(spark, folder, "noticia_id", "seccion", "url_canonica").where("url_canonica IS NOT NULL")
    html = n.select("noticia_id", F.concat(F.lit('<html><head><link rel="canonical" href="'), _escaped("url_canonica"), F.lit('"><meta property="article:section" content="'), _escaped("seccion"), F.lit('"></head><body><p>x</p></body></html>')).alias("html"))
    return feeds.read_pages(html, "noticia_id", "html").select("noticia_id", "seccion", "canonica")


def log_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Log rows written as JSON lines behind a prefix and read again, by action."""
    log = table(spark, folder, "logs_ingesta").select("log_id", "accion", "errores").distinct()
    lines = log.select(F.concat(F.lit("[info] "), F.to_json(F.struct("log_id", "accion", "errores"))).alias("value"))
    return feeds.log_lines(lines, "log_id long, accion string, errores int").groupBy("accion").agg(F.count("*").alias("filas"), F.sum("errores").alias("errores"))


def manifest_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of a manifest of notes by kind, and how many the processed notes lack."""
    n = table(spark, folder, "noticias")
    ids = graphs.manifest_ids(n.select(F.concat(F.lit("- "), F.col("noticia_id")).alias("value")))
    gone = graphs.missing_from(ids, n.where("menciones_procesado").select(F.lower("noticia_id").alias("noticia_id")), "noticia_id").withColumn("falta", F.lit(1))
    return ids.join(gone.select("id", "falta"), "id", "left").groupBy("tipo").agg(F.count("*").alias("ids"), F.count("falta").alias("faltan"))


def _queue(spark: SparkSession, folder: str) -> DataFrame:
    n = _n(spark, folder, "noticia_id", "created_at").where("created_at IS NOT NULL")
    return n.select(F.col("noticia_id").alias("clave"), F.lit("QUEUED").alias("estado"), (F.substring("noticia_id", 1, 1) > "7").cast("int").alias("intentos"), F.lit(None).cast("timestamp").alias("proximo"), F.lit(None).cast("string").alias("reclamado"), F.col("created_at").alias("descubierto"))


def queue_claims(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty oldest due entries of a queue of notes."""
    return queue.claimable(_queue(spark, folder), _t(TO), 50).select("clave")


def queue_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """A queue of notes after attempts: done, to be retried later, or untouched."""
    q = _queue(spark, folder)
    done = q.where("substring(clave, 2, 1) < 'a'").select("clave", (F.substring("clave", 2, 1) < "5").alias("ok"), _t(CUT).alias("cuando"))
    after = queue.after_attempt(q, done)
    return after.groupBy("estado", "intentos", F.date_format("proximo", "yyyy-MM-dd HH:mm").alias("proximo")).agg(F.count("*").alias("filas"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of its own host that a page of two links names."""
    n = _n(spark, folder, "noticia_id", "url_original").where("url_original IS NOT NULL")
    html = F.concat(F.lit('<a href="'), F.col("url_original"), F.lit('">a</a><a href="https://otra.example/x">b</a>'))
    return n.select("noticia_id", F.size(feeds.listing_links(html, url.host("url_original"))).alias("propias"))


QUERIES = {
    f.__name__: f
    for f in (
        source_selection, source_validity, url_rejects, address_kinds, pending_notes, window_gate, excluded_partition, title_context, body_counters, tolerance_tiers, name_matches, source_delta,
        cluster_metrics, cluster_states, source_snapshot, content_sanity, availability_ratios, class_balance, interval_overlap, digest_groups, client_keywords, batch_summary, query_slices,
        view_order, coverage_rank, ingest_plan, record_hashes, source_identity, dedupe_keys, clean_lines, image_addresses, unwrapped_addresses, clamped_scores, retry_waits, debt_states,
        flat_export, raw_export, local_hours, feed_roundtrip, sitemap_roundtrip, page_roundtrip, log_roundtrip, manifest_gaps, queue_claims, queue_attempts, page_links,
    )
}

_F = lambda c: f"coalesce(length(trim({c})) > 0, false)"
_SEG = f"list_filter(string_split(lower({_PATH}), '/'), lambda x: x <> '')"
_K = "SELECT cluster_id, count(DISTINCT noticia_id) AS notas, count(DISTINCT medio_id) AS medios FROM (SELECT noticia_id, medio_id, sha256(w) AS cluster_id FROM (SELECT noticia_id, medio_id, trim(regexp_replace(translate(lower('' || concat_ws(' ', titulo, resumen)), '%s', '%s'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS w FROM noticias) WHERE length(w) > 0) GROUP BY 1" % (text.MARKED, text.BARE)
_FW = lambda c: f"' ' || trim(regexp_replace(translate(lower({c}), '{text.MARKED}', '{text.BARE}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_DOM = lambda h: f"CASE WHEN regexp_matches({h}, '[^.]+\\.(com|org|gob|edu|net|co|gov|ac)\\.[a-z]{{2}}$') THEN regexp_extract({h}, '([^.]+\\.(com|org|gob|edu|net|co|gov|ac)\\.[a-z]{{2}})$', 1) ELSE regexp_extract({h}, '([^.]+\\.[^.]+)$', 1) END"
_HB = _HOST.replace("url_original", "url_base")
SQL = {
    "source_selection": f"SELECT medio_id, motivo = 'incluida' AS incluir, motivo FROM (SELECT medio_id, CASE WHEN NOT coalesce(activo, false) THEN 'inactiva' WHEN coalesce(requiere_javascript, false) THEN 'javascript' WHEN coalesce(requiere_proxy, false) THEN 'proxy' WHEN NOT {_F('rss_url')} AND NOT {_F('sitemap_url')} THEN 'sin_metodo' ELSE 'incluida' END AS motivo FROM medios)",
    "source_validity": "SELECT coalesce(activo AND NOT requiere_javascript AND NOT requiere_proxy, false) AND (coalesce(lower(rss_url) LIKE 'http%', false) OR coalesce(lower(sitemap_url) LIKE 'http%', false)) AS valida, count(*) AS medios FROM medios GROUP BY 1",
    "url_rejects": "SELECT patron, count(DISTINCT noticia_id) AS notas FROM (VALUES " + ", ".join(f"('{p}')" for _, p in REJECTS) + ") r(patron) LEFT JOIN noticias ON regexp_matches(url_original, patron) GROUP BY 1",
    "address_kinds": f"SELECT noticia_id, CASE WHEN len(s) = 0 THEN 'portada' " + " ".join(f"WHEN list_has_any(s, {list(w)!r}) THEN '{k}'" for k, w in LISTS.items()) + f" WHEN regexp_matches(p, '{FILES}') THEN 'archivo' WHEN len(s) = 1 AND NOT contains(s[1], '-') THEN 'seccion' ELSE 'nota' END AS clase FROM (SELECT noticia_id, {_SEG} AS s, lower({_PATH}) AS p FROM (SELECT DISTINCT noticia_id, url_original FROM noticias))",
    "pending_notes": f"SELECT medio_id, count(*) AS notas FROM (SELECT DISTINCT noticia_id, medio_id FROM noticias WHERE NOT coalesce(menciones_procesado, false) AND {_F('texto_cuerpo_nota')}) WHERE medio_id IN (SELECT medio_id FROM medios WHERE activo) GROUP BY 1",
    "window_gate": f"SELECT CASE WHEN created_at IS NULL THEN 'sin_fecha' WHEN created_at < TIMESTAMP '{FROM}' THEN 'anterior' WHEN created_at >= TIMESTAMP '{TO}' THEN 'posterior' ELSE 'dentro' END AS ventana, count(*) AS notas FROM (SELECT DISTINCT noticia_id, created_at FROM noticias) GROUP BY 1",
    "excluded_partition": "SELECT CASE WHEN medio_id IN (SELECT medio_id FROM medios WHERE requiere_proxy) THEN 'bloqueadas' ELSE 'restantes' END AS lado, count(*) AS notas, count(DISTINCT medio_id) AS medios FROM (SELECT DISTINCT noticia_id, medio_id FROM noticias) GROUP BY 1",
    "title_context": f"SELECT DISTINCT noticia_id, CASE WHEN contains(t, ' obra ') THEN 'titulo' ELSE 'texto' END AS contexto FROM (SELECT noticia_id, {_FW('titulo')} AS t, {_FW('texto_extraido')} AS x FROM noticias) WHERE contains(t, ' gobierno ') AND (contains(t, ' obra ') OR contains(x, ' obra '))",
    "body_counters": f"SELECT fuente_metodo, count_if(c) AS con_cuerpo, count_if(NOT c AND l) AS solo_limpio, count_if(NOT (c OR l OR p) AND t) AS solo_titulo, count_if(NOT (c OR l OR p) AND NOT t) AS vacias FROM (SELECT DISTINCT noticia_id, fuente_metodo, {_F('texto_cuerpo_nota')} AS c, {_F('texto_nota_limpia')} AS l, {_F('texto_extraido')} AS p, {_F('titulo')} AS t FROM noticias) GROUP BY 1",
    "tolerance_tiers": f"""WITH n AS (SELECT DISTINCT noticia_id, medio_id, {_ascii('titulo')} AS t, trim(url_original) AS u, {_CANON} AS c, {_HOST} AS h, CAST(created_at AS DATE) AS d, fuente_metodo FROM noticias), b AS (SELECT * FROM n WHERE fuente_metodo <> 'rss')
  SELECT noticia_id, max(CASE WHEN u IN (SELECT u FROM b WHERE u IS NOT NULL) THEN 5 WHEN c IN (SELECT c FROM b WHERE c IS NOT NULL) THEN 4 WHEN t <> '' AND EXISTS (SELECT 1 FROM b WHERE b.medio_id = a.medio_id AND b.t = a.t AND abs(date_diff('day', a.d, b.d)) <= 3) THEN 3
    WHEN t <> '' AND EXISTS (SELECT 1 FROM b WHERE b.medio_id = a.medio_id AND b.t = a.t) THEN 2 WHEN t <> '' AND EXISTS (SELECT 1 FROM b WHERE b.h = a.h AND b.t = a.t) THEN 1 ELSE 0 END) AS nivel FROM n a WHERE fuente_metodo = 'rss' GROUP BY 1""",
    "name_matches": f"""WITH e AS (SELECT DISTINCT {_ascii('medio')} AS escrito FROM noticias WHERE {_ascii('medio')} <> ''), m AS (SELECT medio_id, {_ascii('nombre_medio')} AS nombre FROM medios WHERE {_ascii('nombre_medio')} <> ''),
  p AS (SELECT *, string_split(escrito, ' ') AS x, string_split(nombre, ' ') AS y FROM e, m WHERE list_has_any(list_filter(string_split(escrito, ' '), lambda w: length(w) > 3), list_filter(string_split(nombre, ' '), lambda w: length(w) > 3))),
  s AS (SELECT escrito, medio_id, round(greatest(1 - levenshtein(escrito, nombre) / greatest(length(escrito), length(nombre)), len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS s FROM p),
  b AS (SELECT escrito, max((s, medio_id)) AS m FROM s GROUP BY 1)
  SELECT escrito, m[2] AS medio_id, m[1] AS parecido, CASE WHEN m[1] = 1 THEN 'exacto' WHEN m[1] >= 0.9 THEN 'seguro' WHEN m[1] >= 0.8 THEN 'probable' ELSE 'revisar' END AS estado FROM b""",
    "source_delta": f"SELECT medio_id, antes, despues, CASE WHEN antes > 0 AND despues > 0 THEN despues - antes END AS cambio, CASE WHEN antes > 0 AND despues > 0 THEN 'COMPLETO' ELSE 'PARCIAL' END AS estado FROM (SELECT medio_id, count_if(created_at < TIMESTAMP '{CUT}') AS antes, count_if(created_at >= TIMESTAMP '{CUT}') AS despues FROM (SELECT DISTINCT noticia_id, medio_id, created_at FROM noticias WHERE created_at IS NOT NULL) GROUP BY 1)",
    "cluster_metrics": f"SELECT count(*) AS grupos, count_if(notas = 1) AS unicos, count_if(notas > 1) AS repetidos, count_if(medios > 1) AS entre_medios, count_if(medios >= 3) AS sindicados, max(notas) AS mayor, sum(notas - 1) AS sobrantes FROM ({_K})",
    "cluster_states": f"SELECT CASE WHEN medios >= 3 THEN 'sindicado' WHEN medios = 2 THEN 'compartido' WHEN notas > 1 THEN 'repetido' ELSE 'unico' END AS estado, count(*) AS grupos, sum(notas) AS notas FROM ({_K}) GROUP BY 1",
    "source_snapshot": f"SELECT medio_id, sum(filas) AS filas, count(*) AS notas, sum(filas) - count(*) AS repetidas, count_if(l) AS limpias, count_if(c) AS cuerpos, count_if(d) AS desvios FROM (SELECT medio_id, noticia_id, count(*) AS filas, bool_or({_F('texto_nota_limpia')}) AS l, bool_or({_F('texto_cuerpo_nota')}) AS c, bool_or(coalesce(length(texto_cuerpo_nota) <> cuerpo_nota_chars, false)) AS d FROM noticias GROUP BY 1, 2) GROUP BY 1",
    "content_sanity": f"""SELECT *, round(malas / notas, 6) AS parte, malas >= 2 AND round(malas / notas, 6) >= 0.05 AS bloquea FROM (SELECT medio_id, count(*) AS notas, count_if(d1) AS sin_titulo, count_if(d2) AS solo_titulo, count_if(d3) AS cortas, count_if(d4) AS portadas, count_if(d1 OR d2 OR d3 OR d4) AS malas, min(CASE WHEN d1 OR d2 OR d3 OR d4 THEN noticia_id END) AS ejemplo
  FROM (SELECT DISTINCT noticia_id, medio_id, NOT {_F('titulo')} AS d1, coalesce(trim(texto_cuerpo_nota) = trim(titulo), false) AS d2, coalesce(length(trim(texto_cuerpo_nota)) BETWEEN 1 AND 199, false) AS d3, len({_SEG}) = 0 AS d4 FROM noticias) GROUP BY 1)""",
    "availability_ratios": f"SELECT medio_id, round(count_if(p) / count(*), 6) AS con_pagina, round(count_if(l AND p) / nullif(count_if(p), 0), 6) AS limpia_de_pagina, round(count_if(c AND l) / nullif(count_if(l), 0), 6) AS cuerpo_de_limpia, round(count_if(a AND c) / nullif(count_if(c), 0), 6) AS autor_de_cuerpo, round(count_if(f) / count(*), 6) AS con_fecha FROM (SELECT DISTINCT noticia_id, medio_id, {_F('texto_extraido')} AS p, {_F('texto_nota_limpia')} AS l, {_F('texto_cuerpo_nota')} AS c, {_F('autor')} AS a, fecha_publicacion IS NOT NULL AS f FROM noticias) GROUP BY 1",
    "class_balance": f"SELECT calidad_extraccion, count(DISTINCT medio_id) AS medios, count_if(c) AS elegibles, count_if(NOT c) AS excluidas FROM (SELECT DISTINCT noticia_id, medio_id, calidad_extraccion, {_F('texto_cuerpo_nota')} AS c FROM noticias) GROUP BY 1",
    "interval_overlap": "SELECT tema, round(greatest(a0, b0), 6) AS desde, round(least(a1, b1), 6) AS hasta, coalesce(a0 <= b1 AND b0 <= a1, false) AS traslapa FROM (SELECT tema, min(score_relevancia) FILTER (requiere_alerta) AS a0, max(score_relevancia) FILTER (requiere_alerta) AS a1, min(score_relevancia) FILTER (NOT requiere_alerta) AS b0, max(score_relevancia) FILTER (NOT requiere_alerta) AS b1 FROM menciones WHERE score_relevancia IS NOT NULL AND requiere_alerta IS NOT NULL GROUP BY 1)",
    "digest_groups": "SELECT cliente_id, sum(n) AS alertas, count(*) AS grupos, max(n) AS mayor, round(1 - count(*) / sum(n), 6) AS reduccion FROM (SELECT cliente_id, sentimiento, tema, count(*) AS n FROM (SELECT DISTINCT mencion_id, cliente_id, sentimiento, tema FROM menciones WHERE requiere_alerta) GROUP BY 1, 2, 3) GROUP BY 1",
    "client_keywords": "SELECT cliente_id, nombre_cliente, count(DISTINCT keyword) AS keywords, min(keyword) AS primera, max(keyword) AS ultima FROM clientes JOIN menciones USING (cliente_id) WHERE keyword IS NOT NULL GROUP BY 1, 2",
    "batch_summary": "SELECT accion, lower(nivel) AS nivel, count(*) AS filas, count_if(coalesce(notas_nuevas, 0) + coalesce(duplicados, 0) + coalesce(errores, 0) = coalesce(urls_detectadas, 0)) AS cuadran, sum(coalesce(errores, 0)) AS errores FROM (SELECT DISTINCT * FROM logs_ingesta) GROUP BY 1, 2",
    "query_slices": "SELECT keyword_id, CAST(pos AS INTEGER) AS orden FROM (SELECT keyword_id, ((r - 40) % n + n) % n AS pos FROM (SELECT keyword_id, row_number() OVER (ORDER BY sha256(keyword_id)) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT keyword_id FROM keywords WHERE activa))) WHERE pos < 20",
    "view_order": "SELECT noticia_id FROM (SELECT DISTINCT noticia_id, fecha_publicacion, fecha_captura, created_at FROM noticias) ORDER BY coalesce(fecha_publicacion, '') DESC, coalesce(fecha_captura, '') DESC, created_at DESC NULLS LAST, noticia_id LIMIT 100",
    "coverage_rank": "SELECT ['aprobada', 'alerta', 'exportada', 'pendiente'][r] AS estado, count(*) AS notas FROM (SELECT noticia_id, min(CASE WHEN lower(estado_revision) LIKE '%aprob%' THEN 1 WHEN requiere_alerta THEN 2 WHEN exportado_xml THEN 3 ELSE 4 END) AS r FROM menciones GROUP BY 1) GROUP BY 1",
    "ingest_plan": f"""WITH n AS (SELECT DISTINCT noticia_id, url_canonica, created_at, {_F('texto_cuerpo_nota')} AS c FROM noticias WHERE url_canonica IS NOT NULL), o AS (SELECT url_canonica, bool_or(c) AS tenia FROM n WHERE created_at < TIMESTAMP '{CUT}' GROUP BY 1)
  SELECT CASE WHEN tenia IS NULL THEN 'nueva' WHEN c AND NOT tenia THEN 'promovida' ELSE 'duplicada' END AS plan, count(*) AS notas FROM n LEFT JOIN o USING (url_canonica) WHERE created_at >= TIMESTAMP '{CUT}' GROUP BY 1""",
    "record_hashes": "SELECT DISTINCT noticia_id, sha256(concat_ws('|', " + ", ".join(f"coalesce(trim({c}), '')" for c in ("fecha_publicacion", "medio", "titulo", "url_original", "autor", "seccion")) + ")) AS hash_registro FROM noticias",
    "source_identity": f"""WITH m AS (SELECT medio_id, h, {_DOM('h')} AS d FROM (SELECT medio_id, {_HB} AS h FROM medios WHERE url_base IS NOT NULL)), x AS (SELECT medio_id, min(medio_id) OVER (PARTITION BY h) AS a, min(medio_id) OVER (PARTITION BY d) AS b FROM m)
  SELECT medio_id, CASE WHEN a <> medio_id THEN 'ALIAS_OF' WHEN b <> medio_id THEN 'REGIONAL_EDITION' ELSE 'NEW' END AS estado, CASE WHEN a <> medio_id THEN a WHEN b <> medio_id THEN b END AS de FROM x""",
    "dedupe_keys": "SELECT CASE WHEN keyword_id IS NOT NULL THEN 'keyword' WHEN noticia_id IS NOT NULL THEN 'nota' ELSE 'mencion' END AS por, count(*) AS filas, count(DISTINCT coalesce(cliente_id || '//' || noticia_id || '//' || keyword_id, cliente_id || '::' || noticia_id, mencion_id)) AS claves FROM menciones GROUP BY 1",
    "clean_lines": f"""WITH a AS (SELECT DISTINCT noticia_id, list_transform(string_split(replace(texto_extraido, chr(13), ''), chr(10)), lambda x: trim(x)) AS l FROM noticias WHERE texto_extraido IS NOT NULL), b AS (SELECT noticia_id, l, list_position(list_transform(l, lambda x: regexp_matches(lower(x), '{ENDS}')), true) AS e FROM a),
  c AS (SELECT noticia_id, list_filter(CASE WHEN e > 0 THEN l[1:e - 1] ELSE l END, lambda x: x <> '' AND NOT regexp_matches(lower(x), '{NOISE}')) AS k FROM b)
  SELECT DISTINCT noticia_id, CAST(len(k) AS INTEGER) AS lineas, CAST(coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) AS INTEGER) AS largo, CASE WHEN coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) >= 1200 THEN 'alta' WHEN coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) >= 400 THEN 'media' WHEN coalesce(list_sum(list_transform(k, lambda x: length(x))), 0) > 0 THEN 'baja' ELSE 'vacia' END AS calidad FROM c""",
    "image_addresses": "SELECT noticia_id, CASE WHEN regexp_matches(i, '^https?://') THEN i WHEN i LIKE '//%' THEN 'https:' || i WHEN i LIKE '/%' THEN b || i WHEN i = '' OR i LIKE 'data:%' THEN NULL ELSE b || '/' || i END AS imagen FROM (SELECT DISTINCT noticia_id, trim(imagen_url) AS i, regexp_extract(url_original, '^(https?://[^/]+)', 1) AS b, imagen_url, url_original FROM noticias)",
    "unwrapped_addresses": "SELECT DISTINCT noticia_id, url_original AS destino FROM noticias",
    "clamped_scores": "SELECT round(least(0.9, greatest(0.2, score_relevancia)), 1) AS puntaje, count(*) AS menciones FROM (SELECT DISTINCT mencion_id, score_relevancia FROM menciones WHERE score_relevancia IS NOT NULL) GROUP BY 1",
    "retry_waits": "SELECT * FROM (VALUES ('120', 120::BIGINT), ('0', 0), ('Wed, 03 Jun 2026 10:05:00 GMT', 300), ('Wed, 03 Jun 2026 09:00:00 GMT', 0), ('pronto', 60), ('999999', 3600)) t(cabecera, segundos)",
    "debt_states": """WITH l AS (SELECT DISTINCT medio_id, log_id, fecha_hora, lower(nivel) <> 'error' AS ok FROM logs_ingesta WHERE medio_id IS NOT NULL), u AS (SELECT medio_id, max((fecha_hora, log_id)) AS o FROM l WHERE ok GROUP BY 1),
  f AS (SELECT medio_id, count_if(NOT ok AND (o IS NULL OR (fecha_hora, log_id) > o)) AS fallos FROM l LEFT JOIN u USING (medio_id) GROUP BY 1) SELECT CASE WHEN fallos >= 3 THEN 'escalada' WHEN fallos > 0 THEN 'reintento' ELSE 'pagada' END AS estado, count(*) AS medios FROM f GROUP BY 1""",
    "flat_export": "SELECT DISTINCT noticia_id AS id, coalesce(fecha_publicacion, '') AS fecha, coalesce(medio, '') AS medio, coalesce(titulo, '') AS titulo, coalesce(url_canonica, url_original, '') AS url, coalesce(seccion, '') AS seccion, coalesce(autor, '') AS autor FROM noticias",
    "raw_export": f"SELECT noticia_id FROM (SELECT DISTINCT noticia_id, created_at FROM noticias WHERE created_at >= TIMESTAMP '{CUT}' AND NOT coalesce(menciones_procesado, false)) ORDER BY created_at, noticia_id LIMIT 100",
    "local_hours": "SELECT CAST(hour(timezone('America/Mexico_City', timezone('UTC', CAST(created_at AS TIMESTAMP)))) AS INTEGER) AS hora, count(*) AS menciones FROM (SELECT DISTINCT mencion_id, created_at FROM menciones) GROUP BY 1",
    "feed_roundtrip": "SELECT DISTINCT noticia_id, 1 AS posicion, url_original AS url, trim(titulo) AS titulo FROM noticias WHERE trim(titulo) <> '' AND url_original IS NOT NULL",
    "sitemap_roundtrip": "SELECT DISTINCT noticia_id, url_original AS url, '2026-01-02' AS fecha FROM noticias WHERE url_original IS NOT NULL",
    "page_roundtrip": "SELECT DISTINCT noticia_id, nullif(seccion, '') AS seccion, url_canonica AS canonica FROM noticias WHERE url_canonica IS NOT NULL",
    "log_roundtrip": "SELECT accion, count(*) AS filas, sum(errores) AS errores FROM (SELECT DISTINCT log_id, accion, errores FROM logs_ingesta) GROUP BY 1",
    "manifest_gaps": "SELECT CASE WHEN regexp_full_match(id, '[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}') THEN 'uuid' WHEN regexp_full_match(id, '[0-9a-f]{40}|[0-9a-f]{64}') THEN 'hash' ELSE 'invalid' END AS tipo, count(*) AS ids, count_if(id NOT IN (SELECT lower(noticia_id) FROM noticias WHERE menciones_procesado)) AS faltan FROM (SELECT DISTINCT lower(noticia_id) AS id FROM noticias WHERE noticia_id IS NOT NULL) GROUP BY 1",
    "queue_claims": "SELECT noticia_id AS clave FROM (SELECT DISTINCT noticia_id, created_at FROM noticias WHERE created_at IS NOT NULL) ORDER BY created_at, noticia_id LIMIT 50",
    "queue_attempts": f"""SELECT estado, intentos, proximo, count(*) AS filas FROM (SELECT CASE WHEN x >= 'a' THEN 'QUEUED' WHEN x < '5' THEN 'PERSISTED' ELSE 'RETRY' END AS estado, CAST(i + CASE WHEN x < 'a' THEN 1 ELSE 0 END AS INTEGER) AS intentos,
  CASE WHEN x >= '5' AND x < 'a' THEN strftime(TIMESTAMP '{CUT}' + INTERVAL 15 MINUTE * CAST(2 ** i AS INTEGER), '%Y-%m-%d %H:%M') END AS proximo FROM (SELECT DISTINCT noticia_id, created_at, substr(noticia_id, 2, 1) AS x, CASE WHEN substr(noticia_id, 1, 1) > '7' THEN 1 ELSE 0 END AS i FROM noticias WHERE created_at IS NOT NULL)) GROUP BY 1, 2, 3""",
    "page_links": "SELECT DISTINCT noticia_id, 1 AS propias FROM noticias WHERE url_original IS NOT NULL",
}
