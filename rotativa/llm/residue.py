"""Template residue and error-page text in place of an article (problem 1).

A note is a *non-article* when, apart from page furniture, its text holds only
unfilled places of a template, filler, an error or access message, or a notice
that scripts are required.  Places are found by one grammar per delimiter,
messages by their wording; whether they make the note is decided by density
and surroundings: nothing like an article may stand before them, and after them
no more than a lone link of the page.  Articles that speak of errors or of
templates keep their paragraphs, and a leftover among an article's page lines
has no weight against them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines as L

#: Characters of article text, outside furniture and residue, that make an article.
ARTICLE_CHARS = 60
#: Lone links that may follow the residue of a page without being an article: how many, how long.
LINKS, LINK_CHARS = 2, 170

#: Printed values of nothing; a leftover in an article, residue where there is no other line.
VOIDS = frozenset(("undefined", "null", "nan", "[object object]"))


def is_non_article(text: str | None, classes: list[str] | None = None) -> bool:
    """Whether a page text holds residue in place of an article.

    Null, empty and blank texts are no cases, nor are texts of furniture alone.
    """
    if not text or text.isspace():
        return False
    before = after = found = links = longest = voids = 0
    parts = text.split("\n")
    for line, c in zip(parts, classes if classes is not None else L.classify_page(parts)):
        if c == L.HEAD and found:
            break  # what follows is a list of other notes
        if c == L.RES:
            found += 1
        elif c == L.EMBED:
            voids += L.key(line) in VOIDS
        elif c == L.LABEL:
            voids = -len(parts)
        elif c == L.TEXT:
            n = len(line.strip())
            longest = max(longest, n)
            if found:
                after += n
                links += 1
            else:
                before += n
            if before >= ARTICLE_CHARS and longest > LINK_CHARS:
                return False
    if not found:
        return voids > 0 and not before
    if before + after < ARTICLE_CHARS:
        return True
    return before < ARTICLE_CHARS and links <= LINKS and longest <= LINK_CHARS


def non_articles(notes: DataFrame, key: str = "noticia_id", text: str = "texto_extraido") -> DataFrame:
    """Keys of the notes whose text is residue, each once.

    Null keys and texts give no row; repeated rows count once; other columns
    are ignored, whatever their names.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [is_non_article(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["k"])

    picked = notes.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return picked.where("k IS NOT NULL AND t IS NOT NULL").mapInArrow(scan, "k string").distinct().withColumnRenamed("k", key)


def exclude_non_articles(notes: DataFrame, key: str = "noticia_id", text: str = "texto_extraido") -> DataFrame:
    """The rows of notes that aren't non-articles, all columns kept."""
    return notes.join(non_articles(notes, key, text), key, "left_anti")


def residue_rates(notes: DataFrame, by: Column, key: str = "noticia_id", text: str = "texto_extraido") -> DataFrame:
    """For each value of ``by``: notes, non-articles among them and their share."""
    all_notes = notes.select(F.col(f"`{key}`").alias(key), by.alias("grupo")).distinct()
    bad = non_articles(notes, key, text).withColumn("malo", F.lit(1))
    return all_notes.join(bad, key, "left").groupBy("grupo").agg(
        F.count("*").alias("notas"), F.count("malo").alias("no_articulos"), F.round(F.count("malo") / F.count("*"), 6).alias("parte"),
    )


def residue_by_flags(notes: DataFrame, sources: DataFrame, key: str = "noticia_id", text: str = "texto_extraido", grade: str = "calidad_extraccion", source: str = "medio_id", script: str = "requiere_javascript") -> DataFrame:
    """(script, grade, notas, no_articulos, parte): what the earlier grade and the source's need of scripts say of residue.

    Neither decides a note; a flag or grade that is null is a group of its own.
    """
    flags = sources.select(F.col(source), F.col(script)).groupBy(source).agg(F.bool_or(script).alias(script))
    all_notes = notes.select(F.col(f"`{key}`").alias("k"), F.col(source), F.col(grade)).distinct().join(flags, source, "left")
    bad = non_articles(notes, key, text).select(F.col(key).alias("k"), F.lit(1).alias("malo"))
    return all_notes.join(bad, "k", "left").groupBy(script, grade).agg(F.count("*").alias("notas"), F.count("malo").alias("no_articulos"), F.round(F.count("malo") / F.count("*"), 6).alias("parte"))
