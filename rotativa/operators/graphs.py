"""Walks over references: indexes of site maps, and records that share keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep


def resolve_indexes(items: DataFrame, roots: DataFrame, depth: int = 2, budget: int = 20) -> DataFrame:
    """(root, url, fecha, nivel): the addresses reached from root site maps, level by level.

    ``items`` has doc, url, fecha and is_index: what each fetched document
    lists.  An address is reached once for each root, on its first level; each
    level follows at most ``budget`` indexes of a root, newest first, undated
    last; a document that wasn't fetched lists nothing.
    """
    frontier = roots.select(F.col("url").alias("root"), F.col("url").alias("doc")).distinct()
    seen = None
    for level in range(depth + 1):
        reached = frontier.join(items, "doc").groupBy("root", "url").agg(F.max("fecha").alias("fecha"), F.bool_or("is_index").alias("is_index")).withColumn("nivel", F.lit(level))
        if seen is not None:
            reached = reached.join(seen.select("root", "url"), ["root", "url"], "left_anti")
        reached = keep(reached, "sitemap")
        seen = reached if seen is None else seen.unionByName(reached)
        # the newest indexes of each root: a bounded list, aggregated rather than sorted whole
        order = F.struct(F.coalesce("fecha", F.lit("")).alias("f"), F.col("url").alias("u"))
        nxt = reached.where("is_index").groupBy("root").agg(F.slice(F.reverse(F.array_sort(F.collect_set(order))), 1, budget).alias("top"))
        frontier = nxt.select("root", F.explode("top").alias("t")).select("root", F.col("t.u").alias("doc"))
    return seen.where("NOT is_index").select("root", "url", "fecha", "nivel")


def same_entity(records: DataFrame, key: str, shared: Sequence[str]) -> DataFrame:
    """(key, entidad): records that share a value of any of the columns are one entity, named by its least key.

    Each round a record takes the least name among those it shares a value
    with, and the name of that name; it ends when nothing changes.  A value is
    aggregated to its least name before it is joined back, so a value that many
    records share costs no pairs.
    """
    links = keep(
        records.select(F.col(key).alias("k"), F.explode(F.array(*(F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}="), F.trim(F.col(c).cast("string")))) for c in shared))).alias("v")).where("k IS NOT NULL AND v IS NOT NULL").distinct(),
        "links",
    )
    name = keep(records.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().withColumn("n", F.col("k")), "names")
    changed = True
    while changed:
        by_value = links.join(name, "k").groupBy("v").agg(F.min("n").alias("m"))
        least = links.join(by_value, "v").groupBy("k").agg(F.min("m").alias("m"))
        step = name.join(least, "k", "left").select("k", F.least("n", F.coalesce("m", "n")).alias("n"), F.col("n").alias("was"))
        jump = step.select(F.col("k").alias("n"), F.col("n").alias("far"))
        new = keep(step.join(jump, "n", "left").select("k", F.least("n", F.coalesce("far", "n")).alias("n"), "was"), "names")
        changed = not new.where("n != was").isEmpty()
        name = new.select("k", "n")
    return name.select(F.col("k").alias(key), F.col("n").alias("entidad"))


def manifest_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, tipo): the distinct identifiers of a manifest: uuid, hash or invalid."""
    token = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"[A-Za-z0-9-]{6,}"), F.lit(0)))
    ids = lines.select(token.alias("id")).select(F.lower("id").alias("id")).distinct()
    uuid = r"^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
    return ids.select("id", F.when(F.col("id").rlike(uuid), "uuid").when(F.col("id").rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$"), "hash").otherwise("invalid").alias("tipo"))


def missing_from(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The listed identifiers a table lacks."""
    return ids.join(table.select(F.col(key).alias("id")), "id", "left_anti")
