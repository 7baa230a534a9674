"""Mixing sources to target weights (problem 9).

The mix is measured in blocks of equal token numbers.  Sainte-Laguë
apportionment gives them to the sources by the highest quotients of their target
shares, and the blocks of a source to its shards by the shards' supply.  Every
shard then draws its quota by itself: whole rounds of all its records, and in a
seeded order as many more as reach the quota.  No record is used more often
than its source allows, and what a scarce source can't give is reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep
from .tokens import VOCABULARY, token_counts

#: Tokens of a block at most; a small mix has smaller ones, so that it has this many.
BLOCK, BLOCKS = 1024, 20_000
#: Tokens of a shard, and shards of a source at most.
SHARD, SHARDS = 2_000_000, 4096


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by the highest quotients w / 1, w / 3, w / 5, ...; at most ``most`` each.

    A divisor that gives about the right number is found by bisection, the last
    seats go one by one; ties go to the earlier entry.  Where all are at their
    most, seats stay unused.
    """
    w = np.maximum(np.asarray(weights, float), 0.0)
    cap = np.full(len(w), seats) if most is None else np.maximum(np.asarray(most, np.int64), 0)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(w)
    given = lambda d: np.minimum(np.floor(w / d + 0.5).astype(np.int64), cap)
    lo, hi = w[w > 0].min() / (4.0 * (seats + 1)), w.max() * 4.0
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if given(mid).sum() > seats:
            lo = mid
        else:
            hi = mid
    s = given(hi)
    while s.sum() < seats:
        q = np.where(s < cap, w / (2 * s + 1), -1.0)
        s[int(q.argmax())] += 1
    return s.tolist()


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def largest_total(targets: Sequence[Target], supply: dict[str, int]) -> int:
    """Tokens of the largest mix in which no source that has documents falls short."""
    reach = [supply[t.source] * t.repeats / t.share for t in targets if t.share > 0 and supply.get(t.source, 0) > 0 and t.repeats > 0]
    return int(min(reach)) if reach else 0


def draw(
    docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1, key: str = "doc_id", text: str = "text", source: str = "source",
    share: str = "target_share", repeats: str = "max_repeats", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(key, source, tokens, veces): the drawn records and how often each is used.

    ``total`` is the size of the mix in tokens; by default the largest at which
    no source with documents falls short.  Null keys and sources, records
    without tokens and sources that aren't targets aren't drawn.  A record that
    stands in several rows counts once for each.  Targets are a small table of
    settings; of a source named twice the first by share counts.
    """
    wanted: dict[str, Target] = {}
    for r in targets.select(source, share, repeats).where(F.col(source).isNotNull()).orderBy(source, F.desc(share)).collect():
        wanted.setdefault(r[0], Target(r[0], float(r[1] or 0), int(r[2] or 0)))
    goals = list(wanted.values())
    counted = token_counts(docs.where(F.col(f"`{source}`").isin([t.source for t in goals])), key, text, (source,), vocabulary)
    counted = keep(counted.where(F.col(key).isNotNull() & (F.col("tokens") > 0)).select(F.col(key).alias("k"), F.col(source).alias("s"), "tokens"), "counted")
    supply = {r["s"]: r["n"] for r in counted.groupBy("s").agg(F.sum("tokens").alias("n")).collect()}
    size = largest_total(goals, supply) if total is None else int(total)
    block = max(1, min(BLOCK, size // BLOCKS))
    most = [supply.get(t.source, 0) * t.repeats // block for t in goals]
    # a source without documents keeps its blocks unused: they can't be made up for by others
    quota = sainte_lague([t.share for t in goals], size // block)
    quota = [min(q, m) for q, m in zip(quota, most)]
    shards = {t.source: max(1, min(SHARDS, -(-supply.get(t.source, 0) // SHARD))) for t in goals}
    spark = docs.sparkSession
    setting = spark.createDataFrame([(t.source, shards[t.source]) for t in goals], "s string, shards int")
    placed = counted.join(F.broadcast(setting), "s").select("k", "s", "tokens", F.pmod(F.xxhash64("k", F.lit(seed)), F.col("shards")).cast("int").alias("shard"))
    by_shard: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("s", "shard").agg(F.sum("tokens").alias("n")).orderBy("s", "shard").collect():  # at most SHARDS for each source
        by_shard.setdefault(r["s"], []).append((r["shard"], r["n"]))
    rows = []
    for t, q in zip(goals, quota):
        held = by_shard.get(t.source, [])
        if not held:
            continue
        seats = sainte_lague([n for _, n in held], q, [n * t.repeats // block for _, n in held])
        for (shard, n), x in zip(held, seats):
            rounds = min(x * block // n, t.repeats)
            rows.append((t.source, shard, int(rounds), int(x * block - rounds * n) if rounds < t.repeats else 0))
    quotas = spark.createDataFrame(rows, "s string, shard int, rounds int, rest long")
    order = Window.partitionBy("s", "shard").orderBy(F.xxhash64("k", F.lit(seed + 1)), "k")
    filled = placed.join(quotas, ["s", "shard"]).withColumn("before", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens"))
    times = F.col("rounds") + F.when(F.col("before") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    return filled.select(F.col("k").alias(key), F.col("s").alias(source), "tokens", times.alias("veces")).where("veces > 0")


def reached(drawn: DataFrame, targets: DataFrame, source: str = "source", share: str = "target_share") -> DataFrame:
    """(source, target_share, registros, usos, tokens, parte): the shares a mix reached, by source."""
    per = drawn.groupBy(source).agg(F.count("*").alias("registros"), F.sum("veces").alias("usos"), F.sum(F.col("tokens") * F.col("veces")).alias("tokens"))
    whole = per.agg(F.sum("tokens").alias("todo"))
    joined = targets.select(source, share).join(per, source, "left").crossJoin(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(source, share, zero("registros").alias("registros"), zero("usos").alias("usos"), zero("tokens").alias("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("todo"), F.lit(0.0)), 6).alias("parte"))
