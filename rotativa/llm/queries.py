"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import abuse, sql
from .boilerplate import find_furniture
from .mixing import draw, reached
from .mojibake import find_garbled, restored
from .packing import fill, pack
from .repeated import find_repeated, repeated_blocks
from .residue import non_articles, residue_by_flags, residue_rates
from .truncation import cut_rates, verdicts


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that hold residue in place of an article."""
    return non_articles(table(spark, folder, "noticias"))


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of non-articles by source."""
    return residue_rates(table(spark, folder, "noticias"), F.col("medio_id")).withColumnRenamed("grupo", "medio_id")


def p1_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Share of non-articles by the source's need of scripts and the earlier grade."""
    return residue_by_flags(table(spark, folder, "noticias"), table(spark, folder, "medios"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Furniture lines of the three text fields of every article."""
    return find_furniture(table(spark, folder, "noticias"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that repeat within their source."""
    return find_repeated(table(spark, folder, "noticias"))


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of several repeated lines by source and length."""
    return repeated_blocks(table(spark, folder, "noticias"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values with characters changed by a wrong encoding."""
    return find_garbled(table(spark, folder, "noticias"))


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every value that could be restored, in whole or in part."""
    return restored(table(spark, folder, "noticias"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values that break off before their last sentence is complete."""
    return verdicts(table(spark, folder, "noticias")).select("noticia_id", "campo")


def p7_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut values by source and field."""
    return cut_rates(table(spark, folder, "noticias"))


def _containers(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    return [(r[0], r[1]) for r in table(spark, folder, "contenedores").select("contenedor", "capacidad_tokens").orderBy("capacidad_tokens").collect()]


def p8_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every document in containers of each size."""
    return pack(table(spark, folder, "documents"), _containers(spark, folder))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each size are."""
    sizes = _containers(spark, folder)
    return fill(pack(table(spark, folder, "documents"), sizes), sizes)


def p9_drawn(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the mix and how often each is used."""
    return draw(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares the mix reached."""
    return reached(p9_drawn(spark, folder), table(spark, folder, "mix_targets"))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return abuse.score(docs, abuse.fit(docs, table(spark, folder, "muestras_moderacion")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit passage."""
    return _scores(spark, folder).where(F.col("puntaje") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every document."""
    return _scores(spark, folder)


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of such documents by source."""
    return abuse.rates(table(spark, folder, "documents"), _scores(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p1_flags": p1_flags, "p2_found": p2_found, "p3_found": p3_found, "p3_blocks": p3_blocks, "p4_found": p4_found, "p4_restored": p4_restored, "p7_found": p7_found, "p7_rates": p7_rates, "p8_assignment": p8_assignment, "p8_fill": p8_fill, "p9_drawn": p9_drawn, "p9_shares": p9_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL = sql.SQL
