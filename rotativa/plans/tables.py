"""Relational queries: joins, aggregates, windows, sets, dedupe and writes by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url
from ..functions.text import content_key, first_filled, fold
from ..operators import compare, graphs, keys
from ..sources.tables import table
from .text import _CANON, _HOST, _PATH, _ascii, _fold, _words, ascii_key

CUT = "2026-02-01 00:00:00"


def _n(spark: SparkSession, folder: str, *cols: str) -> DataFrame:
    return table(spark, folder, "noticias").select(*cols).distinct()


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    n = _n(spark, folder, "noticia_id", "medio_id", "medio", "titulo", "url_original", "created_at", "fuente_metodo").select(
        F.col("noticia_id").alias("id"), url.canonical("url_original").alias("url_key"), F.coalesce(F.nullif(ascii_key("medio"), F.lit("")), F.lower("medio_id")).alias("outlet"), F.to_date("created_at").alias("day"), ascii_key("titulo").alias("title"),
        F.conv(F.substring(F.sha2("noticia_id", 256), 1, 12), 16, 10).cast("long").alias("ord"), "fuente_metodo",
    )
    return n.where("fuente_metodo = 'rss'").drop("fuente_metodo"), n.where("fuente_metodo != 'rss'").drop("fuente_metodo")


def fuzzy_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of feeds reconciled with all others by address, and by title within an outlet."""
    a, b = _sides(spark, folder)
    r = compare.reconcile(a, b, compare.best_match(compare.candidates(a, b)))
    return r.select("a_id", "b_id", "estado", F.round("score", 6).alias("score"))


def compare_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of feeds by the others."""
    r = fuzzy_compare(spark, folder)
    hit = F.count_if(F.col("estado").isin("MATCH", "MATCH_PROBABLE"))
    own = F.count_if(F.col("a_id").isNotNull())
    return r.agg(own.alias("propias"), hit.alias("casadas"), F.count_if(F.col("estado") == "SOLO_B").alias("solo_b"), F.round(hit * 100 / F.nullif(own, F.lit(0)), 2).alias("cobertura"))


def editorial_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy clusters of similar titles within keyword and day."""
    a, b = _sides(spark, folder)
    k = table(spark, folder, "menciones").where("keyword_id IS NOT NULL").select(F.col("noticia_id").alias("id"), "keyword_id").distinct()
    n = a.unionByName(b).where("title IS NOT NULL AND day IS NOT NULL").select("id", "day", "title", "ord").join(k, "id")
    return compare.greedy_clusters(n.select("id", "keyword_id", "day", "title", "ord"), ["keyword_id", "day"], "title", "ord")


def exclusive_match(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of feeds and others by address or title, each note used once, best scores first."""
    a, b = _sides(spark, folder)
    return compare.exclusive_matches(compare.candidates(a, b).select("a_id", "b_id", "score"))


def host_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Source of each note's address by host and longest path prefix of the catalogue."""
    m = table(spark, folder, "medios").where("url_base IS NOT NULL").select(url.host("url_base").alias("host"), url.path("url_base").alias("path"), F.col("medio_id").alias("source"))
    u = _n(spark, folder, "noticia_id", "url_original").select(F.col("noticia_id").alias("url_id"), url.host("url_original").alias("host"), url.path("url_original").alias("path"))
    return compare.longest_prefix(u, m)


def suffix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by how many sources of the catalogue own their host or a domain above it."""
    m = table(spark, folder, "medios").where("url_base IS NOT NULL").select(url.host("url_base").alias("s"), "medio_id")
    u = _n(spark, folder, "noticia_id", "url_original").withColumn("s", F.explode(url.host_suffixes(url.host("url_original"))))
    found = u.join(m, "s").groupBy("noticia_id").agg(F.count_distinct("medio_id").alias("k"))
    return _n(spark, folder, "noticia_id").join(found, "noticia_id", "left").groupBy(F.when(F.col("k").isNull(), "unknown").when(F.col("k") == 1, "unique").otherwise("ambiguous").alias("estado")).agg(F.count("*").alias("notas"))


def url_variant_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Notes found under another form of their address among the canonical ones."""
    n = _n(spark, folder, "noticia_id", "url_original", "url_canonica")
    ask = n.select("noticia_id", F.explode(url.variants("url_original")).alias("u"))
    have = n.select(F.col("url_canonica").alias("u"), F.col("noticia_id").alias("encontrada"))
    return ask.join(have, "u").groupBy("noticia_id").agg(F.min("encontrada").alias("primera"), F.count_distinct("encontrada").alias("encontradas"))


def route_fanout(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions by view through their keyword's active routes."""
    m = table(spark, folder, "menciones").select("mencion_id", F.upper("keyword_id").alias("k")).where("k IS NOT NULL").distinct()
    r = table(spark, folder, "mention_routes").where("activo AND vista_nombre IS NOT NULL").select(F.upper("keyword_id").alias("k"), "vista_tipo", "vista_nombre").distinct()
    return m.join(r, "k").groupBy("vista_tipo", "vista_nombre").agg(F.count_distinct("mencion_id").alias("menciones"))


def route_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords that are active without a route, and routes of keywords that don't exist."""
    k = table(spark, folder, "keywords").select("keyword_id", "activa").distinct()
    r = table(spark, folder, "mention_routes").select("route_id", "keyword_id").distinct()
    a = k.where("activa").join(r.select("keyword_id"), "keyword_id", "left_anti").select(F.lit("sin_ruta").alias("problema"), F.col("keyword_id").alias("clave")).distinct()
    b = r.join(k.select("keyword_id"), "keyword_id", "left_anti").select(F.lit("sin_keyword").alias("problema"), F.col("route_id").alias("clave")).distinct()
    return a.unionByName(b)


def day_client_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions, alerts, keywords and scores by client over days."""
    m = table(spark, folder, "menciones").distinct().withColumn("dia", F.to_date("created_at"))
    per = m.groupBy("cliente_id", "dia").agg(F.count_distinct("mencion_id").alias("n"), F.count_if("requiere_alerta").alias("a"), F.max("score_relevancia").alias("s"))
    keywords = m.groupBy("cliente_id").agg(F.count_distinct("keyword_id").alias("keywords"))
    out = per.groupBy("cliente_id").agg(F.sum("n").alias("menciones"), F.sum("a").alias("alertas"), F.count("*").alias("dias"), F.max("n").alias("pico"), F.round(F.max("s"), 4).alias("mejor"))
    return out.join(keywords, "cliente_id", "left")


def duplicate_surplus(spark: SparkSession, folder: str) -> DataFrame:
    """Notes beyond the first of each canonical address and of each title."""
    n = _n(spark, folder, "noticia_id", "url_canonica", "titulo")

    def extra(c, name: str) -> DataFrame:  # noqa: ANN001
        g = n.where(c.isNotNull()).groupBy(c.alias("g")).agg(F.count_distinct("noticia_id").alias("n")).where("n > 1")
        return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("sobrantes"), F.count("*").alias("grupos")).select(F.lit(name).alias("por"), "sobrantes", "grupos")

    return extra(F.col("url_canonica"), "url").unionByName(extra(ascii_key("titulo"), "titulo"))


def extraction_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Text quality by source: shares of empty and long texts, mean and median length, class."""
    n = _n(spark, folder, "noticia_id", "medio_id", "texto_nota_limpia").withColumn("c", F.length(F.coalesce(F.trim("texto_nota_limpia"), F.lit(""))))
    pct = lambda x: F.round(F.count_if(x) * 100 / F.count("*"), 1)
    q = n.groupBy("medio_id").agg(F.count("*").alias("notas"), pct(F.col("c") == 0).alias("vacias"), pct(F.col("c") >= 600).alias("c600"), pct(F.col("c") >= 1200).alias("c1200"), F.round(F.avg("c"), 2).alias("media"), F.median("c").alias("mediana"))
    kind = F.when(F.col("vacias") >= 60, "vacia").when((F.col("c1200") >= 70) & (F.col("mediana") >= 1200), "excelente").when((F.col("c600") >= 70) & (F.col("mediana") >= 600), "buena").when(F.col("c600") >= 40, "regular").otherwise("mala")
    return q.withColumn("clase", kind)


def clone_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of bodies whose first 400 characters stand under three titles or more."""
    n = _n(spark, folder, "noticia_id", "titulo", "texto_cuerpo_nota").where("length(trim(texto_cuerpo_nota)) >= 80").select("noticia_id", fold("titulo").alias("titulo"), F.sha2(F.substring(F.trim("texto_cuerpo_nota"), 1, 400), 256).alias("cuerpo"))
    many = n.groupBy("cuerpo").agg(F.count_distinct("titulo").alias("titulos"), F.count_distinct("noticia_id").alias("notas")).where("titulos >= 3")
    return n.join(many, "cuerpo").select("noticia_id", "cuerpo", "titulos", "notas").distinct()


def score_cohorts(spark: SparkSession, folder: str) -> DataFrame:
    """Score statistics by topic, and by topic and sentiment, in one pass."""
    m = table(spark, folder, "menciones").select("mencion_id", "tema", "sentimiento", "score_relevancia").distinct()
    m.createOrReplaceTempView("__score_cohorts")
    return spark.sql("""SELECT tema, sentimiento, grouping(sentimiento) = 1 AS todos, count(*) AS filas, count_if(score_relevancia IS NULL) AS nulos, round(avg(score_relevancia), 6) AS media, round(min(score_relevancia), 6) AS menor, round(max(score_relevancia), 6) AS mayor,
      round(percentile(score_relevancia, 0.25), 6) AS p25, round(percentile(score_relevancia, 0.75), 6) AS p75, round(percentile(score_relevancia, 0.1), 6) AS p10, round(percentile(score_relevancia, 0.5), 6) AS p50, round(percentile(score_relevancia, 0.9), 6) AS p90
      FROM __score_cohorts GROUP BY GROUPING SETS ((tema), (tema, sentimiento))""")


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts of every score threshold against the alert label, by running sums over distinct scores."""
    m = table(spark, folder, "menciones").select("mencion_id", "score_relevancia", "requiere_alerta").distinct().where("score_relevancia IS NOT NULL AND requiere_alerta IS NOT NULL")
    # scores are rounded to four places: their number has a bound, whatever the rows
    g = m.groupBy(F.round("score_relevancia", 4).alias("umbral")).agg(F.count_if("requiere_alerta").alias("p"), F.count("*").alias("n"))
    above = Window.orderBy(F.desc("umbral")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy(F.lit(1))
    tp, taken = F.sum("p").over(above), F.sum("n").over(above)
    pos, rows = F.sum("p").over(all_rows), F.sum("n").over(all_rows)
    fp, fn = taken - tp, pos - tp
    tn = rows - taken - fn
    recall, spared = tp / F.nullif(pos, F.lit(0)), tn / F.nullif(rows - pos, F.lit(0))
    return g.select("umbral", tp.alias("vp"), fp.alias("fp"), fn.alias("fn"), tn.alias("vn"), F.round(tp / taken, 6).alias("precision"), F.round(recall, 6).alias("exhaustividad"), F.round((recall + spared) / 2, 6).alias("exactitud_media"))


def label_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by whether their mentions agree on the sentiment."""
    m = table(spark, folder, "menciones").where("sentimiento IS NOT NULL").groupBy("noticia_id").agg(F.count_distinct("sentimiento").alias("k"), F.count_distinct("mencion_id").alias("n"))
    return m.groupBy(F.when(F.col("k") > 1, "conflicto").when(F.col("n") > 1, "repetido").otherwise("resuelto").alias("estado")).agg(F.count("*").alias("notas"))


def flood_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which one client holds more than 60 % of at least 8 mentions."""
    m = table(spark, folder, "menciones").select("mencion_id", "cliente_id", F.to_date("created_at").cast("string").alias("dia")).distinct()
    per = m.groupBy("dia", "cliente_id").agg(F.count("*").alias("n")).groupBy("dia").agg(F.max("n").alias("mayor"), F.sum("n").alias("total"))
    return per.withColumn("inunda", (F.col("total") >= 8) & (F.col("mayor") > F.floor(F.col("total") * 0.6)))


def log_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Sources and actions whose log rows of one instant contradict each other."""
    log = table(spark, folder, "logs_ingesta").where("medio_id IS NOT NULL").distinct()
    g = log.groupBy("medio_id", "accion", F.date_trunc("hour", "fecha_hora").alias("h")).agg(F.count_distinct(F.struct("nivel", "urls_detectadas", "notas_nuevas")).alias("k"))
    return g.groupBy("medio_id", "accion").agg(F.count_if(F.col("k") > 1).alias("ambiguas"), F.count("*").alias("ventanas"))


def ageing_debt(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that aren't done, by state and age at a fixed instant."""
    n = _n(spark, folder, "noticia_id", "estado_procesamiento", "created_at").where("estado_procesamiento != 'ok'")
    h = (F.unix_micros(F.lit("2026-06-01").cast("timestamp")) - F.unix_micros("created_at")) / 3_600_000_000
    return n.groupBy("estado_procesamiento", F.when(h < 6, "<6h").when(h < 24, "6-24h").when(h < 72, "24-72h").otherwise(">72h").alias("edad")).agg(F.count("*").alias("notas"))


def source_master(spark: SparkSession, folder: str) -> DataFrame:
    """Sources with their methods, first address and last capture."""
    m = table(spark, folder, "medios").select("medio_id", "grupo_medio", "nombre_medio")
    n = _n(spark, folder, "medio_id", "fuente_metodo", "url_original", "created_at")
    per = n.groupBy("medio_id").agg(F.array_join(F.array_sort(F.collect_set("fuente_metodo")), ",").alias("metodos"), F.min(url.host("url_original")).alias("host"), F.max("created_at").cast("string").alias("ultima"))
    return m.join(per, "medio_id", "left")


def first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The earliest note of each canonical address."""
    n = _n(spark, folder, "noticia_id", "url_canonica", "created_at").where("url_canonica IS NOT NULL")
    return keys.first_by(n, ["url_canonica"], F.col("created_at"), F.col("noticia_id")).select("url_canonica", "noticia_id")


def fair_queue(spark: SparkSession, folder: str, limit: int = 200, share: float = 0.7) -> DataFrame:
    """A queue of 200 notes: 70 % fresh and newest first, the rest from the backlog, oldest first; spare places go to the other lane."""
    n = _n(spark, folder, "noticia_id", "created_at", "menciones_procesado").where("NOT menciones_procesado")
    fresh = F.col("created_at") >= F.lit(CUT).cast("timestamp")
    # each lane needs no more than the limit, so only its first rows are ranked
    lane = lambda cond, *order: n.where(cond).orderBy(*order).limit(limit).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
    a = lane(fresh, F.desc("created_at"), F.col("noticia_id")).withColumn("carril", F.lit("fresco"))
    b = lane(~fresh, F.asc("created_at"), F.col("noticia_id")).withColumn("carril", F.lit("atraso"))
    both = a.unionByName(b)
    w = Window.partitionBy(F.lit(1))
    na, nb = F.count_if(F.col("carril") == "fresco").over(w), F.count_if(F.col("carril") == "atraso").over(w)
    goal = round(limit * share)
    take_a = F.least(na, F.greatest(F.lit(goal), limit - nb))
    take_b = F.least(nb, limit - F.least(na, F.lit(goal)))
    return both.withColumn("n", F.when(F.col("carril") == "fresco", take_a).otherwise(take_b)).where("r <= n").select("noticia_id", "carril", F.col("r").alias("orden"))


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Pass number of each unprocessed note when every source gives one note a pass.

    A source is ranked day by day, with the notes of earlier days as offset, so that no source has to fit in one task.
    """
    n = _n(spark, folder, "noticia_id", "medio_id", "created_at", "menciones_procesado").where("NOT menciones_procesado").withColumn("d", F.to_date("created_at"))
    days = n.groupBy("medio_id", "d").agg(F.count("*").alias("c"))
    before = Window.partitionBy("medio_id").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("medio_id").alias("m"), F.col("d").alias("dd"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("antes"))
    ranked = compare.rank_within(n, ["medio_id", "d"], F.col("created_at"), F.col("noticia_id"))
    return ranked.join(days, F.col("medio_id").eqNullSafe(F.col("m")) & F.col("d").eqNullSafe(F.col("dd"))).select("noticia_id", "medio_id", (F.col("n") + F.col("antes")).alias("vuelta"))


def top_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The three best mentions of each client."""
    m = table(spark, folder, "menciones").select("mencion_id", "cliente_id", "score_relevancia").distinct()
    return compare.rank_within(m, ["cliente_id"], F.desc_nulls_last("score_relevancia"), F.col("mencion_id")).where("n <= 3")


def next_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page of 100 notes beyond a cursor."""
    return keys.page_after(_n(spark, folder, "created_at", "noticia_id"), ["created_at", "noticia_id"], ["2026-01-01 00:00:00", "8"], 100).select("noticia_id")


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Five notes of each method, by hash."""
    n = _n(spark, folder, "noticia_id", "fuente_metodo").withColumn("h", F.sha2("noticia_id", 256))
    return compare.rank_within(n, ["fuente_metodo"], F.col("h")).where("n <= 5").select("fuente_metodo", "noticia_id", "n")


def shard_of_source(spark: SparkSession, folder: str) -> DataFrame:
    """Sources dealt to four shards by rank."""
    m = table(spark, folder, "medios").select("medio_id").distinct()
    return m.select("medio_id", F.pmod(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("medio_id")) - 1, F.lit(4)).alias("trozo"))


def window_union(spark: SparkSession, folder: str) -> DataFrame:
    """Notes captured late or processed badly, each once, with why."""
    n = _n(spark, folder, "noticia_id", "created_at", "estado_procesamiento")
    a = n.where(F.col("created_at") >= F.lit(CUT).cast("timestamp")).select("noticia_id", F.lit("reciente").alias("via"))
    b = n.where("estado_procesamiento = 'error'").select("noticia_id", F.lit("error").alias("via"))
    return a.unionByName(b).groupBy("noticia_id").agg(F.array_join(F.array_sort(F.collect_set("via")), "+").alias("via"))


def stale_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords that mentions name and the catalogue lacks, and the reverse."""
    m = table(spark, folder, "menciones").select("keyword_id").where("keyword_id IS NOT NULL").distinct()
    k = table(spark, folder, "keywords").select("keyword_id").distinct()
    return m.exceptAll(k).withColumn("lado", F.lit("menciones")).unionByName(k.exceptAll(m).withColumn("lado", F.lit("catalogo")))


def shared_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords that have both routes and mentions."""
    m = table(spark, folder, "menciones").select("keyword_id").where("keyword_id IS NOT NULL")
    return m.intersect(table(spark, folder, "mention_routes").select("keyword_id"))


def republication_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that share their content hash with another note."""
    n = _n(spark, folder, "noticia_id", "titulo", "resumen").withColumn("cluster_id", content_key("titulo", "resumen")).where("cluster_id IS NOT NULL")
    many = n.groupBy("cluster_id").agg(F.count_distinct("noticia_id").alias("tamano")).where("tamano > 1")
    return n.join(many, "cluster_id").select("noticia_id", "cluster_id", "tamano").distinct()


def note_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that are linked by a canonical address or a title, over any number of links, by their least id."""
    n = _n(spark, folder, "noticia_id", "url_canonica", "titulo").select("noticia_id", "url_canonica", ascii_key("titulo").alias("titulo"))
    return graphs.same_entity(n, "noticia_id", ["url_canonica", "titulo"])


def append_plan(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of late mentions appended to the earlier ones, by plan."""
    m = table(spark, folder, "menciones").select("mencion_id", "keyword_id", "created_at")
    old, new = m.where(F.col("created_at") < F.lit(CUT).cast("timestamp")), m.where(F.col("created_at") >= F.lit(CUT).cast("timestamp"))
    return keys.append_plan(old, new, "mencion_id", F.col("created_at")).groupBy("plan").agg(F.count("*").alias("filas"))


def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword states after upserting the later rows into the earlier ones, by priority."""
    k = keys.last_by(table(spark, folder, "keywords").select("keyword_id", "prioridad", "activa", "updated_at"), ["keyword_id"], F.col("updated_at"), F.col("prioridad"))
    t = F.lit(CUT).cast("timestamp")
    old, new = k.where(F.col("updated_at") < t), k.where((F.col("updated_at") >= t) | F.col("updated_at").isNull())
    return keys.upsert(old, new, ["keyword_id"]).groupBy("prioridad", "activa").agg(F.count("*").alias("keywords"))


def insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    """Late mentions of a note and keyword that weren't there before, by client."""
    m = table(spark, folder, "menciones").where("keyword_id IS NOT NULL").select("mencion_id", "noticia_id", "keyword_id", "cliente_id", "created_at")
    old, new = m.where(F.col("created_at") < F.lit(CUT).cast("timestamp")), m.where(F.col("created_at") >= F.lit(CUT).cast("timestamp"))
    return keys.insert_ignore(old, new, ["noticia_id", "keyword_id"], F.col("created_at"), F.col("mencion_id")).groupBy("cliente_id").agg(F.count("*").alias("menciones"))


def mark_processed(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by processed flag after marking those with mentions."""
    n = _n(spark, folder, "noticia_id", "menciones_procesado")
    return keys.set_flag(n, table(spark, folder, "menciones"), "noticia_id", "menciones_procesado").groupBy("menciones_procesado").agg(F.count("*").alias("notas"))


def catalogue_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Outlet names and places of the catalogue against those the notes carry."""
    o = table(spark, folder, "medios").select("medio_id", F.col("nombre_medio").alias("nombre"), "estado")
    n = table(spark, folder, "noticias").groupBy("medio_id").agg(F.min("medio").alias("nombre"), F.min("estado").alias("estado"))
    return keys.table_diff(o, n, "medio_id", ["nombre", "estado"])


def xml_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes with alerts as XML elements."""
    n = table(spark, folder, "noticias").select("noticia_id", first_filled("titulo", "noticia_id").alias("titulo"), "url_canonica").distinct()
    n = n.join(table(spark, folder, "menciones").where("requiere_alerta").select("noticia_id"), "noticia_id", "left_semi")
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return n.select("noticia_id", F.concat(F.lit("<nota><titulo>"), esc(F.col("titulo")), F.lit("</titulo><url>"), esc(F.col("url_canonica")), F.lit("</url></nota>")).alias("xml"))


def event_props(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type with the keys of their JSON properties."""
    e = table(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("eventos"), F.count_if(F.json_object_keys("props").isNotNull()).alias("con_json"), F.max(F.size(F.json_object_keys("props"))).cast("long").alias("claves"))


QUERIES = {
    f.__name__: f
    for f in (
        fuzzy_compare, compare_metrics, editorial_clusters, exclusive_match, host_sources, suffix_sources, url_variant_lookup, route_fanout, route_integrity, day_client_rollup,
        duplicate_surplus, extraction_quality, clone_bodies, score_cohorts, threshold_sweep, label_resolution, flood_gate, log_evidence, ageing_debt, source_master, first_wins,
        fair_queue, round_robin, top_scores, next_page, stratified_sample, shard_of_source, window_union, stale_keys, shared_keywords, republication_clusters, note_entities, append_plan,
        upsert_latest, insert_ignore, mark_processed, catalogue_diff, xml_notes, event_props,
    )
}

_D = "SELECT DISTINCT "
_S = f"""n AS (SELECT DISTINCT noticia_id AS id, {_CANON} AS url_key, coalesce(nullif({_ascii('medio')}, ''), lower(medio_id)) AS outlet, CAST(created_at AS DATE) AS day, {_ascii('titulo')} AS title, CAST('0x' || substr(sha256(noticia_id), 1, 12) AS BIGINT) AS ord, fuente_metodo FROM noticias),
a AS (SELECT * FROM n WHERE fuente_metodo = 'rss'), b AS (SELECT * FROM n WHERE fuente_metodo <> 'rss'),
c AS (SELECT a.id AS a_id, b.id AS b_id, b.ord, 3 AS tier, 1.0::DOUBLE AS score FROM a JOIN b USING (url_key) UNION ALL
  SELECT a_id, b_id, ord, CASE WHEN score >= 0.85 THEN 2 ELSE 1 END, score FROM (SELECT a.id AS a_id, b.id AS b_id, b.ord, CASE WHEN greatest(length(a.title), length(b.title)) = 0 THEN 1.0 WHEN least(length(a.title), length(b.title)) = 0 THEN 0.0 ELSE 1 - levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title)) END AS score
    FROM a JOIN b ON a.outlet = b.outlet AND abs(date_diff('day', a.day, b.day)) <= 3) WHERE score >= 0.6),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY tier DESC, score DESC, ord, b_id DESC) AS r FROM c) WHERE r = 1),
rec AS (SELECT a.id AS a_id, b_id, CASE tier WHEN 3 THEN 'MATCH' WHEN 2 THEN 'MATCH_PROBABLE' WHEN 1 THEN 'REVISAR' ELSE 'SOLO_A' END AS estado, round(score, 6) AS score FROM a LEFT JOIN best ON a.id = best.a_id
  UNION ALL SELECT NULL, id, 'SOLO_B', NULL FROM b WHERE id NOT IN (SELECT b_id FROM best))"""
_MD = "(SELECT DISTINCT * FROM menciones)"

SQL = {
    "fuzzy_compare": f"WITH {_S} SELECT * FROM rec",
    "compare_metrics": f"WITH {_S} SELECT count(a_id) AS propias, count_if(estado IN ('MATCH', 'MATCH_PROBABLE')) AS casadas, count_if(estado = 'SOLO_B') AS solo_b, round(count_if(estado IN ('MATCH', 'MATCH_PROBABLE')) * 100 / nullif(count(a_id), 0), 2) AS cobertura FROM rec",
    "host_sources": f"""WITH m AS (SELECT {_HOST.replace('url_original', 'url_base')} AS host, regexp_replace(CASE WHEN {_PATH.replace('url_original', 'url_base')} = '' THEN '/' ELSE {_PATH.replace('url_original', 'url_base')} END, '/+$', '') AS prefix, medio_id FROM medios WHERE url_base IS NOT NULL),
  u AS (SELECT DISTINCT noticia_id, {_HOST} AS host, {_PATH} AS path FROM noticias),
  j AS (SELECT noticia_id, medio_id, length(prefix) AS n FROM u JOIN m USING (host) WHERE prefix = '' OR path = prefix OR starts_with(path, prefix || '/')),
  t AS (SELECT noticia_id, max(medio_id) AS source, count(DISTINCT medio_id) AS k FROM j WHERE n = (SELECT max(n) FROM j x WHERE x.noticia_id = j.noticia_id) GROUP BY 1)
  SELECT noticia_id AS url_id, CASE WHEN k = 1 THEN source END AS source, CASE WHEN k IS NULL THEN 'UNKNOWN' WHEN k > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS estado FROM (SELECT DISTINCT noticia_id FROM u) LEFT JOIN t USING (noticia_id)""",
    "suffix_sources": f"""WITH m AS (SELECT {_HOST.replace('url_original', 'url_base')} AS s, medio_id FROM medios WHERE url_base IS NOT NULL), u AS (SELECT DISTINCT noticia_id, {_HOST} AS h FROM noticias)
  SELECT CASE WHEN k IS NULL OR k = 0 THEN 'unknown' WHEN k = 1 THEN 'unique' ELSE 'ambiguous' END AS estado, count(*) AS notas FROM (SELECT noticia_id, count(DISTINCT medio_id) AS k FROM u LEFT JOIN m ON h = s OR ends_with(h, '.' || s) GROUP BY 1) GROUP BY 1""",
    "url_variant_lookup": f"""WITH n AS (SELECT DISTINCT noticia_id, trim(url_original) AS raw, url_canonica, regexp_replace({_CANON}, '/$', '') AS u FROM noticias),
  v AS (SELECT DISTINCT noticia_id, unnest([raw, u, u || '/', CASE WHEN regexp_matches(u, '^https?://www[.]') THEN regexp_replace(u, '^(https?://)www\\.', '\\1') ELSE regexp_replace(u, '^(https?://)', '\\1www.') END]) AS f FROM n)
  SELECT v.noticia_id, min(n.noticia_id) AS primera, count(DISTINCT n.noticia_id) AS encontradas FROM v JOIN n ON f = url_canonica GROUP BY 1""",
    "route_fanout": "SELECT vista_tipo, vista_nombre, count(DISTINCT mencion_id) AS menciones FROM (SELECT DISTINCT mencion_id, upper(keyword_id) AS k FROM menciones WHERE keyword_id IS NOT NULL) JOIN (SELECT DISTINCT upper(keyword_id) AS k, vista_tipo, vista_nombre FROM mention_routes WHERE activo AND vista_nombre IS NOT NULL) USING (k) GROUP BY 1, 2",
    "route_integrity": "SELECT DISTINCT 'sin_ruta' AS problema, keyword_id AS clave FROM keywords k WHERE activa AND NOT EXISTS (SELECT 1 FROM mention_routes r WHERE r.keyword_id = k.keyword_id) UNION ALL SELECT DISTINCT 'sin_keyword', route_id FROM mention_routes r WHERE NOT EXISTS (SELECT 1 FROM keywords k WHERE r.keyword_id = k.keyword_id)",
    "day_client_rollup": f"""WITH m AS (SELECT *, CAST(created_at AS DATE) AS dia FROM {_MD}), p AS (SELECT cliente_id, dia, count(DISTINCT mencion_id) AS n, count_if(requiere_alerta) AS a, max(score_relevancia) AS s FROM m GROUP BY 1, 2)
  SELECT p.*, k.keywords FROM (SELECT cliente_id, sum(n) AS menciones, sum(a) AS alertas, count(*) AS dias, max(n) AS pico, round(max(s), 4) AS mejor FROM p GROUP BY 1) p LEFT JOIN (SELECT cliente_id, count(DISTINCT keyword_id) AS keywords FROM m GROUP BY 1) k USING (cliente_id)""",
    "duplicate_surplus": f"""WITH n AS (SELECT DISTINCT noticia_id, url_canonica, {_ascii('titulo')} AS t FROM noticias)
  SELECT 'url' AS por, coalesce(sum(c - 1), 0) AS sobrantes, count(*) AS grupos FROM (SELECT count(DISTINCT noticia_id) AS c FROM n WHERE url_canonica IS NOT NULL GROUP BY url_canonica) WHERE c > 1
  UNION ALL SELECT 'titulo', coalesce(sum(c - 1), 0), count(*) FROM (SELECT count(DISTINCT noticia_id) AS c FROM n WHERE t IS NOT NULL GROUP BY t) WHERE c > 1""",
    "extraction_quality": """SELECT *, CASE WHEN vacias >= 60 THEN 'vacia' WHEN c1200 >= 70 AND mediana >= 1200 THEN 'excelente' WHEN c600 >= 70 AND mediana >= 600 THEN 'buena' WHEN c600 >= 40 THEN 'regular' ELSE 'mala' END AS clase FROM (
  SELECT medio_id, count(*) AS notas, round(count_if(c = 0) * 100 / count(*), 1) AS vacias, round(count_if(c >= 600) * 100 / count(*), 1) AS c600, round(count_if(c >= 1200) * 100 / count(*), 1) AS c1200, round(avg(c), 2) AS media, median(c) AS mediana
  FROM (SELECT DISTINCT noticia_id, medio_id, texto_nota_limpia, length(coalesce(trim(texto_nota_limpia), '')) AS c FROM noticias) GROUP BY 1)""",
    "clone_bodies": f"""WITH n AS (SELECT DISTINCT noticia_id, {_fold('titulo')} AS titulo, sha256(substr(trim(texto_cuerpo_nota), 1, 400)) AS cuerpo FROM noticias WHERE length(trim(texto_cuerpo_nota)) >= 80)
  SELECT DISTINCT noticia_id, cuerpo, titulos, notas FROM n JOIN (SELECT cuerpo, count(DISTINCT titulo) AS titulos, count(DISTINCT noticia_id) AS notas FROM n GROUP BY 1 HAVING count(DISTINCT titulo) >= 3) USING (cuerpo)""",
    "score_cohorts": """SELECT tema, sentimiento, grouping(sentimiento) = 1 AS todos, count(*) AS filas, count_if(score_relevancia IS NULL) AS nulos, round(avg(score_relevancia), 6) AS media, round(min(score_relevancia), 6) AS menor, round(max(score_relevancia), 6) AS mayor, round(quantile_cont(score_relevancia, 0.25), 6) AS p25, round(quantile_cont(score_relevancia, 0.75), 6) AS p75, round(quantile_cont(score_relevancia, 0.1), 6) AS p10, round(quantile_cont(score_relevancia, 0.5), 6) AS p50, round(quantile_cont(score_relevancia, 0.9), 6) AS p90
  FROM (SELECT DISTINCT mencion_id, tema, sentimiento, score_relevancia FROM menciones) GROUP BY GROUPING SETS ((tema), (tema, sentimiento))""",
    "threshold_sweep": """WITH g AS (SELECT round(score_relevancia, 4) AS umbral, count_if(requiere_alerta) AS p, count(*) AS n FROM (SELECT DISTINCT mencion_id, score_relevancia, requiere_alerta FROM menciones WHERE score_relevancia IS NOT NULL AND requiere_alerta IS NOT NULL) GROUP BY 1)
  SELECT umbral, vp, n - vp AS fp, pos - vp AS fn, filas - n - pos + vp AS vn, round(vp / n, 6) AS precision, round(vp / nullif(pos, 0), 6) AS exhaustividad, round((vp / nullif(pos, 0) + (filas - n - pos + vp) / nullif(filas - pos, 0)) / 2, 6) AS exactitud_media
  FROM (SELECT umbral, sum(p) OVER w AS vp, sum(n) OVER w AS n, (SELECT sum(p) FROM g) AS pos, (SELECT sum(n) FROM g) AS filas FROM g WINDOW w AS (ORDER BY umbral DESC ROWS UNBOUNDED PRECEDING))""",
    "label_resolution": "SELECT CASE WHEN k > 1 THEN 'conflicto' WHEN n > 1 THEN 'repetido' ELSE 'resuelto' END AS estado, count(*) AS notas FROM (SELECT noticia_id, count(DISTINCT sentimiento) AS k, count(DISTINCT mencion_id) AS n FROM menciones WHERE sentimiento IS NOT NULL GROUP BY 1) GROUP BY 1",
    "flood_gate": "SELECT dia, mayor, total, total >= 8 AND mayor > floor(total * 0.6) AS inunda FROM (SELECT dia, max(n) AS mayor, sum(n) AS total FROM (SELECT CAST(created_at AS DATE)::VARCHAR AS dia, cliente_id, count(DISTINCT mencion_id) AS n FROM menciones GROUP BY 1, 2) GROUP BY 1)",
    "log_evidence": "SELECT medio_id, accion, count_if(k > 1) AS ambiguas, count(*) AS ventanas FROM (SELECT medio_id, accion, date_trunc('hour', fecha_hora) AS h, count(DISTINCT (nivel, urls_detectadas, notas_nuevas)) AS k FROM (SELECT DISTINCT * FROM logs_ingesta) WHERE medio_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "ageing_debt": "SELECT estado_procesamiento, CASE WHEN h < 6 THEN '<6h' WHEN h < 24 THEN '6-24h' WHEN h < 72 THEN '24-72h' ELSE '>72h' END AS edad, count(*) AS notas FROM (SELECT DISTINCT noticia_id, estado_procesamiento, created_at, (epoch_us(TIMESTAMP '2026-06-01') - epoch_us(created_at)) / 3600000000 AS h FROM noticias WHERE estado_procesamiento <> 'ok') GROUP BY 1, 2",
    "source_master": f"SELECT m.medio_id, m.grupo_medio, m.nombre_medio, p.metodos, p.host, p.ultima FROM medios m LEFT JOIN (SELECT medio_id, string_agg(DISTINCT fuente_metodo, ',' ORDER BY fuente_metodo) AS metodos, min({_HOST}) AS host, CAST(max(CAST(created_at AS TIMESTAMP)) AS VARCHAR) AS ultima FROM noticias GROUP BY 1) p USING (medio_id)",
    "first_wins": "SELECT url_canonica, noticia_id FROM (SELECT *, row_number() OVER (PARTITION BY url_canonica ORDER BY created_at, noticia_id) AS r FROM (SELECT DISTINCT noticia_id, url_canonica, created_at FROM noticias WHERE url_canonica IS NOT NULL)) WHERE r = 1",
    "fair_queue": f"""WITH n AS (SELECT DISTINCT noticia_id, created_at, created_at >= TIMESTAMP '{CUT}' AS f FROM noticias WHERE NOT menciones_procesado),
  r AS (SELECT noticia_id, 'fresco' AS carril, row_number() OVER (ORDER BY created_at DESC, noticia_id) AS orden FROM n WHERE f UNION ALL SELECT noticia_id, 'atraso', row_number() OVER (ORDER BY created_at, noticia_id) FROM n WHERE NOT f),
  c AS (SELECT least(200, count_if(f)) AS a, least(200, count_if(NOT f)) AS b FROM n)
  SELECT noticia_id, carril, orden FROM r, c WHERE orden <= CASE WHEN carril = 'fresco' THEN least(a, greatest(140, 200 - b)) ELSE least(b, 200 - least(a, 140)) END""",
    "round_robin": "SELECT noticia_id, medio_id, row_number() OVER (PARTITION BY medio_id ORDER BY created_at, noticia_id) AS vuelta FROM (SELECT DISTINCT noticia_id, medio_id, created_at FROM noticias WHERE NOT menciones_procesado)",
    "top_scores": "SELECT * FROM (SELECT mencion_id, cliente_id, score_relevancia, row_number() OVER (PARTITION BY cliente_id ORDER BY score_relevancia DESC NULLS LAST, mencion_id) AS n FROM (SELECT DISTINCT mencion_id, cliente_id, score_relevancia FROM menciones)) WHERE n <= 3",
    "next_page": "SELECT noticia_id FROM (SELECT DISTINCT created_at, noticia_id FROM noticias) WHERE created_at > TIMESTAMP '2026-01-01' OR (created_at = TIMESTAMP '2026-01-01' AND noticia_id > '8') ORDER BY created_at, noticia_id LIMIT 100",
    "stratified_sample": "SELECT fuente_metodo, noticia_id, n FROM (SELECT *, row_number() OVER (PARTITION BY fuente_metodo ORDER BY sha256(noticia_id)) AS n FROM (SELECT DISTINCT noticia_id, fuente_metodo FROM noticias)) WHERE n <= 5",
    "shard_of_source": "SELECT medio_id, (row_number() OVER (ORDER BY medio_id) - 1) % 4 AS trozo FROM (SELECT DISTINCT medio_id FROM medios)",
    "window_union": f"SELECT noticia_id, string_agg(DISTINCT via, '+' ORDER BY via) AS via FROM (SELECT noticia_id, 'reciente' AS via FROM noticias WHERE created_at >= TIMESTAMP '{CUT}' UNION ALL SELECT noticia_id, 'error' FROM noticias WHERE estado_procesamiento = 'error') GROUP BY 1",
    "stale_keys": "SELECT keyword_id, 'menciones' AS lado FROM (SELECT keyword_id FROM menciones WHERE keyword_id IS NOT NULL EXCEPT SELECT keyword_id FROM keywords) UNION ALL SELECT keyword_id, 'catalogo' FROM (SELECT keyword_id FROM keywords EXCEPT SELECT keyword_id FROM menciones)",
    "shared_keywords": "SELECT keyword_id FROM menciones WHERE keyword_id IS NOT NULL INTERSECT SELECT keyword_id FROM mention_routes",
    "republication_clusters": f"""WITH n AS (SELECT DISTINCT noticia_id, {_words("'' || concat_ws(' ', titulo, resumen)")} AS w FROM noticias), k AS (SELECT noticia_id, sha256(w) AS cluster_id FROM n WHERE length(w) > 0)
  SELECT DISTINCT noticia_id, cluster_id, tamano FROM k JOIN (SELECT cluster_id, count(DISTINCT noticia_id) AS tamano FROM k GROUP BY 1 HAVING count(DISTINCT noticia_id) > 1) USING (cluster_id)""",
    "note_entities": f"""WITH RECURSIVE n AS (SELECT DISTINCT noticia_id AS id, nullif(trim(url_canonica), '') AS u, nullif({_ascii('titulo')}, '') AS t FROM noticias),
  e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM n a JOIN n b ON a.id = b.id OR a.u = b.u OR a.t = b.t), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
  SELECT x AS noticia_id, min(y) AS entidad FROM r GROUP BY 1""",
    "append_plan": f"""SELECT plan, count(*) AS filas FROM (SELECT CASE WHEN mencion_id IN (SELECT mencion_id FROM menciones WHERE created_at < TIMESTAMP '{CUT}') THEN 'present' WHEN row_number() OVER (PARTITION BY mencion_id ORDER BY created_at) > 1 THEN 'repeated' ELSE 'append' END AS plan
  FROM menciones WHERE created_at >= TIMESTAMP '{CUT}') GROUP BY 1""",
    "upsert_latest": "SELECT prioridad, activa, count(*) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY updated_at DESC NULLS LAST, prioridad DESC NULLS LAST) AS r FROM keywords) WHERE r = 1 GROUP BY 1, 2",
    "insert_ignore": f"""SELECT cliente_id, count(*) AS menciones FROM (SELECT *, row_number() OVER (PARTITION BY noticia_id, keyword_id ORDER BY created_at, mencion_id) AS r FROM menciones WHERE keyword_id IS NOT NULL AND created_at >= TIMESTAMP '{CUT}') n
  WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM menciones o WHERE o.noticia_id = n.noticia_id AND o.keyword_id = n.keyword_id AND o.created_at < TIMESTAMP '{CUT}') GROUP BY 1""",
    "mark_processed": "SELECT coalesce(menciones_procesado, false) OR noticia_id IN (SELECT noticia_id FROM menciones) AS menciones_procesado, count(*) AS notas FROM (SELECT DISTINCT noticia_id, menciones_procesado FROM noticias) GROUP BY 1",
    "catalogue_diff": """SELECT coalesce(o.medio_id, n.medio_id) AS medio_id, CASE WHEN o.medio_id IS NULL THEN 'CREATE' WHEN n.medio_id IS NULL THEN 'ONLY_OLD' WHEN o.nombre IS DISTINCT FROM n.nombre OR o.estado IS DISTINCT FROM n.estado THEN 'UPDATE' ELSE 'UNCHANGED' END AS estado,
  CASE WHEN o.medio_id IS NULL OR n.medio_id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.nombre IS DISTINCT FROM n.nombre THEN 'nombre' END, CASE WHEN o.estado IS DISTINCT FROM n.estado THEN 'estado' END) END AS cambios
  FROM (SELECT medio_id, nombre_medio AS nombre, estado FROM medios) o FULL JOIN (SELECT medio_id, min(medio) AS nombre, min(estado) AS estado FROM noticias GROUP BY 1) n ON o.medio_id = n.medio_id""",
    "xml_notes": "SELECT noticia_id, '<nota><titulo>' || replace(replace(replace(coalesce(nullif(trim(titulo), ''), noticia_id), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</titulo><url>' || replace(replace(replace(coalesce(url_canonica, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</url></nota>' AS xml FROM (SELECT DISTINCT noticia_id, titulo, url_canonica FROM noticias) WHERE noticia_id IN (SELECT noticia_id FROM menciones WHERE requiere_alerta)",
    "event_props": "SELECT event_type, count(*) AS eventos, count_if(json_valid(props)) AS con_json, max(len(json_keys(props))) AS claves FROM events GROUP BY 1",
}
