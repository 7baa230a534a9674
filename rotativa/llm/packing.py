"""Filling fixed-capacity containers with items (problem 8).

A configuration is a multiset of lengths that fits into one container.  The
linear program that covers the histogram of item lengths with as few containers
as possible has a column for every configuration; multiplicative weights solve
it without listing them: lengths have prices, a knapsack by dynamic programming
finds the configurations worth most, they are used a little, and the prices of
the lengths they cover fall.  Every vector of prices bounds the number of
containers from below; the best bound's prices are kept.

Rounding uses the same pricing: a container takes the longest item that is left,
which has to go somewhere, and the knapsack under those prices fills the rest of
it; the configuration is used as often as its lengths last.  So every container
is a configuration found by the knapsack, and none is left to a greedy rule.

The histogram has at most one entry per length up to the capacity, so the plan is
made on the driver whatever the number of items.  Items take their places by
rank within their length; ranks are local counts of the written partitions plus
offsets, so that no length has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep
from .tokens import VOCABULARY, token_counts

#: Size classes the program is solved over; the lengths one knapsack of the rounding chooses from.
CLASSES = 256
#: Rounds of the weights, how far a round moves them, and how near the best a configuration must be to be used in it.
ROUNDS, STEP, NEAR = 200, 0.02, 0.01
#: A container is filled longest first until so many items of mean length fit, and by the knapsack from there.
LAST = 4

Plan = list[tuple[dict[int, int], int]]


class Knapsack:
    """Best contents of every room up to ``room``, sizes used at most ``most`` times.

    Each size enters in bundles of 1, 2, 4, ... pieces, every bundle one
    vectorised step over all rooms.
    """

    def __init__(self, size: np.ndarray, price: np.ndarray, most: np.ndarray, room: int):
        self.value = np.zeros(room + 1)
        self._bundles: list[tuple[int, int, int, np.ndarray]] = []
        for i in np.argsort(-price / size, kind="stable"):
            left, b = int(min(most[i], room // size[i])), 1
            while left > 0:
                n = min(b, left)
                w = n * int(size[i])
                other = self.value[: room + 1 - w] + n * price[i]
                better = other > self.value[w:] + 1e-12
                if better.any():
                    step = np.zeros(room + 1, bool)
                    step[w:] = better
                    self.value[w:] = np.where(better, other, self.value[w:])
                    self._bundles.append((int(i), n, w, step))
                left -= n
                b *= 2

    def content(self, room: int) -> dict[int, int]:
        """How often each size stands in the best content of a room."""
        out: dict[int, int] = {}
        for i, n, w, step in reversed(self._bundles):
            if step[room]:
                out[i] = out.get(i, 0) + n
                room -= w
        return out


def _classes(lengths: np.ndarray, counts: np.ndarray, limit: int) -> list[np.ndarray]:
    """Neighbouring lengths joined into classes of about equal volume."""
    if len(lengths) <= limit:
        return [np.array([i]) for i in range(len(lengths))]
    volume = np.cumsum(lengths * counts)
    at = np.minimum((volume - lengths * counts / 2) / volume[-1] * limit, limit - 1).astype(int)
    return [np.flatnonzero(at == k) for k in np.unique(at)]


@dataclass(frozen=True)
class Solution:
    """A fractional covering: its configurations and their use, the price of each size, and the bound these prove."""

    configurations: dict[tuple[tuple[int, int], ...], float]
    price: np.ndarray
    bound: float

    @property
    def containers(self) -> float:
        return sum(self.configurations.values())


def solve(size: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> Solution:
    """The covering program by multiplicative weights.

    One knapsack prices, for every size, the best configuration with that size
    in it; those near the best share the round.  The configurations are scaled
    until every size is covered, so they are feasible; ``bound`` is below every
    covering by weak duality.
    """
    weight = np.log(size / capacity)
    used: dict[tuple[tuple[int, int], ...], float] = {}
    covered = np.zeros(len(size))
    bound, price = 0.0, size / capacity
    for _ in range(rounds):
        p = np.exp(weight - weight.max())
        sack = Knapsack(size, p, demand, capacity)
        worth = p + sack.value[capacity - size]
        if (value := float((demand * p).sum() / worth.max())) > bound:
            bound, price = value, p / worth.max()
        found = set()
        for i in np.flatnonzero(worth >= worth.max() * (1 - NEAR)):
            c = sack.content(int(capacity - size[i]))
            c[int(i)] = c.get(int(i), 0) + 1
            if c[int(i)] <= demand[i]:
                found.add(tuple(sorted(c.items())))
        if not found:
            break
        got = np.zeros(len(size))
        for c in sorted(found):
            used[c] = used.get(c, 0.0) + 1 / len(found)
            for i, n in c:
                got[i] += n / len(found)
        covered += got
        got /= demand
        weight -= step * got / got.max()
    for i in np.flatnonzero(covered == 0):
        # a size in no configuration yet stands alone
        n = int(min(demand[i], capacity // size[i]))
        used[((int(i), n),)] = covered[i] = float(demand[i]) / n
        covered[i] *= n
    scale = float((demand / covered).max())
    return Solution({c: x * scale for c, x in used.items()}, price, bound)


def _program(lengths: np.ndarray, counts: np.ndarray, capacity: int, classes: int) -> tuple[Solution, np.ndarray]:
    """The program over classes as long as their longest, and the price of every length."""
    groups = _classes(lengths, counts, classes)
    size = np.array([lengths[g].max() for g in groups])
    s = solve(size, np.array([counts[g].sum() for g in groups], float), capacity)
    return s, lengths * np.interp(lengths, size, s.price / size)


def make_plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """Containers for a histogram of lengths: (pieces by length, how many such containers).

    Lengths are between 1 and the capacity.  Every item gets exactly one place.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    if not len(lengths):
        return []
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    _, price = _program(lengths, left, capacity, classes)
    # of contents worth about the same the one with longer pieces is better: short ones are easier to place later
    price = price * np.sqrt(lengths / capacity)
    plan: Plan = []
    count, total = int(left.sum()), int((left * lengths).sum())
    while count:
        live = np.flatnonzero(left)
        pick = {int(live[-1]): 1}
        room = capacity - int(lengths[live[-1]])
        while room > LAST * total / count:
            i = next((int(x) for x in live[: np.searchsorted(lengths[live], room, "right")][::-1] if left[x] > pick.get(int(x), 0)), None)
            if i is None:
                break
            pick[i] = pick.get(i, 0) + 1
            room -= int(lengths[i])
        live = live[: np.searchsorted(lengths[live], room, "right")]
        free = left[live] - np.array([pick.get(int(i), 0) for i in live], np.int64)
        live, free = live[free > 0], free[free > 0]
        if len(live) > classes:
            # of neighbouring lengths the one with most items left
            at = np.arange(len(live)) * classes // len(live)
            order = np.lexsort((free, at))
            chosen = np.sort(order[np.append(np.flatnonzero(np.diff(at[order])), len(live) - 1)])
            live, free = live[chosen], free[chosen]
        if len(live):
            for j, n in Knapsack(lengths[live], price[live], free, room).content(room).items():
                pick[int(live[j])] = pick.get(int(live[j]), 0) + n
        times = int(min(left[i] // n for i, n in pick.items()))
        for i, n in pick.items():
            left[i] -= n * times
            count -= n * times
            total -= n * times * int(lengths[i])
        plan.append(({int(lengths[i]): n for i, n in pick.items()}, times))
    return plan


def lower_bound(histogram: dict[int, int], capacity: int) -> float:
    """Containers any packing needs: by the program's prices over exact lengths, and by the items longer than half."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    if not len(lengths):
        return 0.0
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    return max(solve(lengths, counts.astype(float), capacity).bound, float(counts[2 * lengths > capacity].sum()))


class _Places:
    """Where the items of each length go, by their rank."""

    def __init__(self, plan: Plan):
        rows: dict[int, list[tuple[int, int, int]]] = {}
        number = 0
        given: dict[int, int] = {}
        for pick, times in plan:
            for n, m in pick.items():
                rows.setdefault(n, []).append((given.get(n, 0), number, m))
                given[n] = given.get(n, 0) + m * times
            number += times
        self.containers = number
        self.start = {n: np.array([r[0] for r in x], np.int64) for n, x in rows.items()}
        self.first = {n: np.array([r[1] for r in x], np.int64) for n, x in rows.items()}
        self.each = {n: np.array([r[2] for r in x], np.int64) for n, x in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.append([True], np.diff(length[order]) != 0)) if len(length) else []
        for a, b in zip(cuts, [*cuts[1:], len(length)]):
            at = order[a:b]
            n = int(length[at[0]])
            j = np.searchsorted(self.start[n], rank[at], "right") - 1
            out[at] = self.first[n][j] + (rank[at] - self.start[n][j]) // self.each[n][j]
        return out


def pack(docs: DataFrame, sizes: Sequence[tuple[str, int]], key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(contenedor, numero, key, parte, tokens): the place of every document in containers of each size.

    A document longer than the container alone fills ``parte`` 1, 2, ... whole
    containers, numbered below zero, and what remains is an item; all others
    have ``parte`` 0.  Null keys, and texts without tokens, need no place and
    give no row; repeated rows are packed as often as they stand.
    """
    sizes = [(str(n), int(c)) for n, c in sizes if c is not None and int(c) > 0]
    kind = docs.schema[key].dataType.simpleString()
    counted = token_counts(docs, key, text, vocabulary=vocabulary).where(F.col(key).isNotNull() & (F.col("tokens") > 0)).select(F.col(key).alias("k"), "tokens")

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(c + 1, np.int64) for _, c in sizes]
        whole = [0] * len(sizes)
        for b in batches:
            n = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            part = b.column(2)
            for j, (_, c) in enumerate(sizes):
                full, item = np.where(n > c, n // c, 0), np.where(n > c, n % c, n)
                # ranks of equal lengths: a stable sort, counted from the start of each run and on from the batch before
                order = np.argsort(item, kind="stable")
                values, start, count = np.unique(item[order], return_index=True, return_counts=True)
                local = np.empty(len(n), np.int64)
                local[order] = np.arange(len(n)) - np.repeat(start, count) + np.repeat(seen[j][values], count)
                seen[j][values] += count
                before = np.cumsum(full) - full + whole[j]
                whole[j] += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n.astype(np.int32)), part, pa.array(np.full(len(n), j, np.int32)), pa.array(item.astype(np.int32)), pa.array(local), pa.array(full.astype(np.int32)), pa.array(before)],
                    names=["k", "tokens", "pid", "size", "item", "local", "full", "before"],
                )

    schema = f"k {kind}, tokens int, pid int, size int, item int, local long, full int, before long"
    # written once: ranks within a partition hold only for the rows as they lie there
    items = keep(counted.withColumn("pid", F.spark_partition_id()).mapInArrow(ranks, schema), "items")
    per = items.where("item > 0").groupBy("size", "item", "pid").agg(F.count("*").alias("n"))
    offset = Window.partitionBy("size", "item").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("size", "item", "pid", F.coalesce(F.sum("n").over(offset), F.lit(0)).alias("offset"))
    wholes = items.where("full > 0").groupBy("size", "pid").agg(F.sum("full").alias("n"))
    front = Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    wholes = wholes.select("size", "pid", F.coalesce(F.sum("n").over(front), F.lit(0)).alias("whole"))
    # at most one entry per length up to each capacity
    histograms: list[dict[int, int]] = [{} for _ in sizes]
    for r in per.groupBy("size", "item").agg(F.sum("n").alias("n")).collect():
        histograms[r["size"]][r["item"]] = r["n"]
    places = [_Places(make_plan(h, c)) for h, (_, c) in zip(histograms, sizes)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, item = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            rank = b.column(3).to_numpy(zero_copy_only=False)
            number = np.zeros(len(size), np.int64)
            for j in np.unique(size):
                at = size == j
                number[at] = places[j].of(item[at].astype(np.int64), rank[at])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(number + 1), b.column(4), b.column(2)], names=["k", "size", "numero", "parte", "tokens"])

    ranked = items.where("item > 0").join(offsets, ["size", "item", "pid"]).select("k", "size", "item", (F.col("local") + F.col("offset")).alias("rank"), (F.when(F.col("full") > 0, F.col("full") + 1).otherwise(0)).alias("parte"))
    packed = ranked.mapInArrow(place, f"k {kind}, size int, numero long, parte int, tokens int")
    capacity = F.element_at(F.array(*(F.lit(c) for _, c in sizes)), F.col("size") + 1)
    alone = items.where("full > 0").join(wholes, ["size", "pid"]).select("k", "size", F.explode(F.sequence(F.lit(1), F.col("full"))).alias("parte"), (F.col("before") + F.col("whole")).alias("at"))
    alone = alone.select("k", "size", (-(F.col("at") + F.col("parte"))).alias("numero"), "parte", capacity.cast("int").alias("tokens"))
    name = F.element_at(F.array(*(F.lit(n) for n, _ in sizes)), F.col("size") + 1)
    return packed.unionByName(alone).select(name.alias("contenedor"), "numero", F.col("k").alias(key), "parte", "tokens")


def fill(packed: DataFrame, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """(contenedor, capacidad, contenedores, tokens, llenado): how full the containers of each size are."""
    table = packed.sparkSession.createDataFrame([(str(n), int(c)) for n, c in sizes], "contenedor string, capacidad int")
    # containers are numbered without gaps in both directions
    per = packed.groupBy("contenedor").agg(F.max(F.greatest("numero", F.lit(0))).alias("a"), F.min(F.least("numero", F.lit(0))).alias("b"), F.sum("tokens").alias("tokens"))
    return per.join(table, "contenedor").select("contenedor", "capacidad", (F.col("a") - F.col("b")).alias("contenedores"), "tokens", F.round(F.col("tokens") / ((F.col("a") - F.col("b")) * F.col("capacidad")), 6).alias("llenado"))
