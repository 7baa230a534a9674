"""Comparing two collections of notes: exact and fuzzy matches, reconciliation, clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..sources.shared import keep

#: Title similarity of a probable and of a weak match, and the days titles may lie apart.
PROBABLE, WEAK, DAYS = 0.85, 0.60, 3


def candidates(a: DataFrame, b: DataFrame, days: int = DAYS, least: float = WEAK) -> DataFrame:
    """(a_id, b_id, tier, score): pairs by equal address, or by title within the same outlet and a few days.

    Both sides have id, url_key, outlet, day, title and ord; folded titles.
    Titles are compared only within an outlet and a block of days: a day is
    joined with the blocks around it, so the join is an equality, and salted by
    nothing else than the days an outlet has.  Equal titles of a block are
    compared once.
    """
    by_url = a.alias("a").join(b.alias("b"), F.col("a.url_key") == F.col("b.url_key")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.col("b.ord").alias("ord"), F.lit(3).alias("tier"), F.lit(1.0).alias("score"))
    # one comparison for each pair of different titles, not for each pair of notes
    ta = a.where("day IS NOT NULL AND title IS NOT NULL").select("outlet", "day", "title").distinct()
    tb = b.where("day IS NOT NULL AND title IS NOT NULL").select("outlet", "day", "title").distinct()
    near = tb.select("outlet", F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("day"), F.col("day").alias("b_day"), F.col("title").alias("b_title"))
    longest = F.greatest(F.length("title"), F.length("b_title"))
    pairs = ta.join(near, ["outlet", "day"]).where(F.abs(F.length("title") - F.length("b_title")) <= longest * (1 - least))
    scored = pairs.withColumn("score", similarity(F.col("title"), F.col("b_title"))).where(F.col("score") >= least)
    back = scored.join(a.select("id", "outlet", "day", "title"), ["outlet", "day", "title"]).withColumnRenamed("id", "a_id")
    right = b.select(F.col("id").alias("b_id"), "outlet", F.col("day").alias("b_day"), F.col("title").alias("b_title"), "ord")
    by_title = back.join(right, ["outlet", "b_day", "b_title"]).select("a_id", "b_id", "ord", F.when(F.col("score") >= PROBABLE, 2).otherwise(1).alias("tier"), "score")
    return by_url.unionByName(by_title)


def best_match(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, tier, score): the best candidate of each a; ties go to the earliest b.

    An aggregate with partial results, not a window over all candidates.
    """
    best = F.max_by(F.struct("b_id", "tier", "score"), F.struct(F.col("tier"), F.col("score"), -F.col("ord"), F.col("b_id")))
    return pairs.groupBy("a_id").agg(best.alias("m")).select("a_id", "m.b_id", "m.tier", "m.score")


def reconcile(a: DataFrame, b: DataFrame, best: DataFrame) -> DataFrame:
    """(a_id, b_id, estado, score): MATCH, MATCH_PROBABLE, REVISAR, SOLO_A or SOLO_B; several a may share a b."""
    state = F.when(F.col("tier") == 3, "MATCH").when(F.col("tier") == 2, "MATCH_PROBABLE").when(F.col("tier") == 1, "REVISAR").otherwise("SOLO_A")
    left = a.select(F.col("id").alias("a_id")).join(best, "a_id", "left").select("a_id", "b_id", state.alias("estado"), "score")
    alone = b.select(F.col("id").alias("b_id")).join(best.select("b_id").distinct(), "b_id", "left_anti")
    return left.unionByName(alone.select(F.lit(None).cast(dict(a.dtypes)["id"]).alias("a_id"), "b_id", F.lit("SOLO_B").alias("estado"), F.lit(None).cast("double").alias("score")))


def greedy_clusters(df: DataFrame, group: list[str], title: str, order: str, least: float = PROBABLE) -> DataFrame:
    """The rows with ``cluster``: each joins the first cluster of its group whose first title is similar enough.

    Depends on the order within a group, which must have no ties.  Equal titles
    are merged before; a group's distinct titles go through one task in order.
    """
    kept = [*group, title]
    types = dict(df.dtypes)
    first = df.groupBy(*kept).agg(F.min(order).alias("__o"))
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", cluster {types[order]}"

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__o", kind="stable")
        heads: list[tuple[str, object]] = []
        out = []
        for t, o in zip(pdf[title], pdf["__o"]):
            s = t or ""
            hit = next((h for x, h in heads if _similar(s, x, least)), None)
            if hit is None:
                heads.append((s, o))
                hit = o
            out.append(hit)
        return pdf[kept].assign(cluster=out)

    clusters = first.groupBy(*group).applyInPandas(assign, schema)
    return df.join(clusters, [df[c].eqNullSafe(clusters[c]) for c in kept], "left").select(*(df[c] for c in df.columns), clusters["cluster"])


def _similar(a: str, b: str, least: float) -> bool:
    """Whether the normalised edit distance reaches a similarity."""
    n = max(len(a), len(b))
    if n == 0:
        return True
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        best = i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
            best = min(best, row[j])
        if best > most:
            return False
    return row[-1] <= most


def exclusive_matches(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id, score): pairs taken from the best score down, each side used once.

    A pair that is the best left for both its sides is taken whatever the order
    of the others, so a round takes all of these at once and drops what their
    sides stand in; rounds end when no pair is left.  Ties go to the lesser ids.
    """
    left = keep(pairs.groupBy("a_id", "b_id").agg(F.max("score").alias("score")), "pairs")
    taken = None
    best = F.min_by(F.struct("a_id", "b_id", "score"), F.struct(-F.col("score"), "a_id", "b_id"))
    while not left.isEmpty():
        a = left.groupBy("a_id").agg(best.alias("m")).select("m.*")
        b = left.groupBy("b_id").agg(best.alias("m")).select("m.*")
        now = keep(a.join(b.select("a_id", "b_id"), ["a_id", "b_id"], "left_semi"), "taken")
        taken = now if taken is None else taken.unionByName(now)
        left = keep(left.join(now.select("a_id"), "a_id", "left_anti").join(now.select("b_id"), "b_id", "left_anti"), "pairs")
    return left if taken is None else taken


def longest_prefix(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """(url_id, source, estado): the source of an address by host and longest matching path prefix.

    Both sides have host and path; a tie of two sources is AMBIGUOUS, no source UNKNOWN.
    """
    joined = urls.join(sources.select(F.col("host"), F.col("path").alias("prefix"), "source"), "host", "left")
    prefix = F.regexp_replace(F.coalesce("prefix", F.lit("")), "/+$", "")
    fits = (prefix == "") | (F.col("path") == prefix) | F.startswith(F.col("path"), F.concat(prefix, F.lit("/")))
    ranked = joined.withColumn("n", F.when(F.col("source").isNotNull() & fits, F.length(prefix)))
    best = ranked.groupBy("url_id").agg(F.max_by(F.col("source"), F.struct("n", "source")).alias("source"), F.max("n").alias("n"))
    ties = ranked.alias("r").join(best.select("url_id", F.col("n").alias("m")).alias("b"), "url_id").where("n = m").groupBy("url_id").agg(F.count_distinct("source").alias("k"))
    state = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("k") > 1, "AMBIGUOUS").otherwise("RESOLVED")
    return best.join(ties, "url_id", "left").select("url_id", F.when(state == "RESOLVED", F.col("source")).alias("source"), state.alias("estado"))


def rank_within(df: DataFrame, by: list[str], *order) -> DataFrame:  # noqa: ANN002
    """The rows with ``n``, their rank within a group."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

