"""Queries over packed fields and timestamps (problems 5 and 6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import explode_packed
from ..operators.timestamps import normalise
from ..sources.tables import table

PACKED = (
    ("keywords", "keyword_id", "alias_o_variantes"),
    ("keywords", "keyword_id", "contexto_excluir"),
    ("medios", "medio_id", "secciones_urls"),
    ("mention_routes", "route_id", "notas"),
)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the four packed fields with its position."""
    parts = [
        explode_packed(table(spark, folder, t), k, f).select(F.lit(t).alias("tabla"), "clave", F.lit(f).alias("campo"), "posicion", "valor") for t, k, f in PACKED
    ]
    return reduce(DataFrame.unionByName, parts)


def _instants(spark: SparkSession, folder: str) -> DataFrame:
    return normalise(table(spark, folder, "noticias"), table(spark, folder, "medio_reloj"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """UTC instants of the values that give date and time of day."""
    return _instants(spark, folder).where("instante_utc IS NOT NULL").select("noticia_id", "campo", "instante_utc").distinct()


def p6_states(spark: SparkSession, folder: str) -> DataFrame:
    """Values of each field by how their time was resolved."""
    return _instants(spark, folder).groupBy("campo", "estado").agg(F.count("*").alias("valores"))


QUERIES = {"p5_found": p5_found, "p6_found": p6_found, "p6_states": p6_states}
