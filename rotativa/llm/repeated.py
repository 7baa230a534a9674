"""Lines repeated across one site's documents (problem 3).

The lines of a source become identifiers; a suffix array over its documents'
identifier sequences brings equal beginnings together, and common prefixes of
neighbours give the blocks of lines that many documents share, together with
the number of distinct documents of each.  Blocks alone decide which lines go.

The array is distributed.  A suffix is compared over ``WINDOW`` lines; where a
block fills the window, the windows become names, and suffixes of names are
compared in the same way, until no block fills its window.  Equal suffixes are
merged before the shuffle; those of a source are partitioned by their first two
lines and sorted there, so that no source has to fit in one task; a partition is
read as a stream, with a stack no deeper than the window.

Distinct documents are counted without their keys: a suffix carries the longest
prefix that starts earlier in its own document, and counts as a new document
only for prefixes longer than that.  These counts add up over partitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep

#: A line is repeated from this many documents and this share of its source's documents on.
LEAST_DOCS, LEAST_PERCENT = 5, 3
#: Lines a suffix is compared over in one round; longer blocks take further rounds.
WINDOW = 4


def line_ids(notes: DataFrame, source: str = "medio_id", key: str = "noticia_id", text: str = "texto_extraido") -> DataFrame:
    """(s, k, ids): one row per document with the identifiers of its lines, 0 for an empty one.

    Lines are equal if they are after lower-casing and dropping ASCII digits
    and white space; a line then empty has no identifier.
    """
    stripped = lambda x: F.translate(F.lower(x), "0123456789 \t\n\r\x0b\x0c", "")
    ids = F.transform(F.split(F.col("t"), "\n", -1), lambda x: F.when(stripped(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(stripped(x))))
    picked = notes.select(F.col(f"`{source}`").cast("string").alias("s"), F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return picked.where("s IS NOT NULL AND k IS NOT NULL").select("s", "k", F.coalesce(ids, F.array().cast("array<bigint>")).alias("ids")).distinct()


def _windows(ids: Sequence[int], stride: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(window, seen) of every named position: its next names, and how many of them start an earlier window alike."""
    often = Counter(ids)
    before: set[tuple[int, ...]] = set()
    for i, x in enumerate(ids):
        if not x:
            continue
        w = [x]
        for j in range(i + stride, min(len(ids), i + stride * WINDOW), stride):
            if not ids[j]:
                break
            w.append(ids[j])
        seen = 0
        if often[x] > 1:
            for n in range(1, len(w) + 1):
                t = tuple(w[:n])
                if t in before:
                    seen = n
                else:
                    before.add(t)
        yield tuple(w), seen


def name_of(window: Sequence[int]) -> int:
    """The name of a full window in the next round."""
    return xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "little", signed=True) for x in window)) - (1 << 63) or 1


def _sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(s, n) documents of each source, and (s, k) of documents with several texts."""
    per = docs.groupBy("s", "k").agg(F.count("*").alias("texts"))
    return per.groupBy("s").agg(F.count("*").alias("n")), per.where("texts > 1").select("s", "k")


def blocks(docs: DataFrame, stride: int = 1) -> DataFrame:
    """(s, block, docs, full): blocks of names shared by enough documents of their source; ``full`` ones may go on."""
    sizes, several = _sizes(docs)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: Counter[tuple] = Counter()
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, seen in _windows(ids, stride):
                    got[s, w, seen] += 1
            cols = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(list(map(list, cols[1])), pa.list_(pa.int64())), pa.array(cols[2], pa.int32()), pa.array(list(got.values()), pa.int64())],
                names=["s", "suffix", "seen", "w"],
            )

    array = docs.select("s", "ids").mapInArrow(suffixes, "s string, suffix array<bigint>, seen int, w long").groupBy("s", "suffix", "seen").agg(F.sum("w").alias("w"))
    array = array.repartition("s", F.col("suffix")[0], F.try_element_at("suffix", F.lit(2))).sortWithinPartitions("s", "suffix")
    parts = array.mapInArrow(_common_prefixes, "s string, block array<bigint>, docs long")
    # single lines are spread over the partitions of their second lines
    whole = parts.groupBy("s", "block").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(s, k, list(t)) for s, k, ids in zip(*(c.to_pylist() for c in b.columns)) for t in {w[:n] for w, _ in _windows(ids, stride) for n in range(1, len(w) + 1)}]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.int64()))], names=["s", "k", "block"])

    # a document with several texts was counted once for each that has the block
    again = docs.join(several, ["s", "k"], "left_semi").select("s", "k", "ids").mapInArrow(prefixes, "s string, k string, block array<bigint>")
    again = again.groupBy("s", "k", "block").agg(F.count("*").alias("c")).where("c > 1").groupBy("s", "block").agg(F.sum(F.col("c") - 1).alias("again"))
    counted = whole.join(again, ["s", "block"], "left").withColumn("docs", F.col("docs") - F.coalesce("again", F.lit(0))).join(sizes, "s")
    return counted.where((F.col("docs") >= LEAST_DOCS) & (F.col("docs") * 100 >= F.col("n") * LEAST_PERCENT)).select("s", "block", "docs", (F.size("block") == WINDOW).alias("full"))


def _common_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted stream of suffixes: intervals of equal prefixes with their distinct documents.

    Blocks of one line are incomplete here and all reported; longer ones only from ``LEAST_DOCS`` documents on.
    """
    source, last = None, []
    stack: list[tuple[int, Counter[int]]] = []  # length, weight by lines seen before
    out: list[tuple] = []

    def close(upto: int) -> None:
        while stack and stack[-1][0] > upto:
            n, weight = stack.pop()
            docs = sum(w for seen, w in weight.items() if seen < n)
            if n == 1 and docs or docs >= LEAST_DOCS:
                out.append((source, last[:n], docs))
            if not stack or stack[-1][0] < upto:
                if upto:
                    stack.append((upto, Counter()))
            if stack:
                stack[-1][1].update(weight)

    for b in batches:
        for s, suffix, seen, w in zip(*(c.to_pylist() for c in b.columns)):
            if s != source:
                close(0)
                source, last = s, []
            same = 0
            for x, y in zip(last, suffix):
                if x != y:
                    break
                same += 1
            close(same)
            # a single line is a block of its own, however its suffixes go on
            if not stack:
                stack.append((1, Counter()))
            if len(suffix) > stack[-1][0]:
                stack.append((len(suffix), Counter()))
            stack[-1][1][seen] += w
            last = suffix
        if out:
            yield _pack(out)
            out.clear()
    close(0)
    if out:
        yield _pack(out)


def _pack(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.int64())], names=["s", "block", "docs"]
    )


def long_blocks(docs: DataFrame) -> DataFrame:
    """(s, lines, docs): the blocks of all lengths, as identifiers of their lines.

    A block of several windows comes out in steps of the window of its round;
    its last lines are those of the block that starts that much later.
    """
    stride, out = 1, None
    meaning = None  # (s, name, lines) of the names of this round
    while True:
        found = keep(blocks(docs, stride), "blocks")
        if meaning is None:
            spelt = found.withColumn("lines", F.col("block"))
        else:
            at = found.select("s", "block", "docs", "full", F.posexplode("block").alias("p", "name")).join(meaning, ["s", "name"])
            spelt = at.groupBy("s", "block", "docs", "full").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "lines"))), lambda x: x["lines"])).alias("lines"))
        spelt = keep(spelt, "spelt")
        # a single name of a later round is the full window of the round before
        new = spelt if out is None else spelt.where(F.size("block") > 1)
        out = new.select("s", "lines", "docs") if out is None else out.unionByName(new.select("s", "lines", "docs"))
        full = spelt.where("full")
        if full.isEmpty():
            return out

        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(name_of, b.column(1).to_pylist())), pa.int64()), b.column(2)], names=["s", "name", "lines"])

        meaning = keep(full.select("s", "block", "lines").mapInArrow(names, "s string, name long, lines array<bigint>"), "names")
        known = meaning.groupBy("s").agg(F.collect_list("name").alias("known"))
        step = stride

        def renamed(batches: Iterator[pa.RecordBatch], step: int = step) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for ids, names_ in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    good, new = set(names_), [0] * len(ids)
                    for i in range(len(ids) - step * (WINDOW - 1)):
                        w = ids[i : i + step * WINDOW : step]
                        if all(w) and (x := name_of(w)) in good:
                            new[i] = x
                    rows.append(new)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["s", "k", "ids"])

        docs = keep(docs.join(known, "s").select("s", "k", "ids", "known").mapInArrow(renamed, "s string, k string, ids array<bigint>"), "renamed")
        stride *= WINDOW


def find_repeated(notes: DataFrame, source: str = "medio_id", key: str = "noticia_id", text: str = "texto_extraido") -> DataFrame:
    """(key, linea) of the lines that repeat within their source: those of its blocks.

    A document with several texts counts once.  Null sources, keys and texts
    give no rows; an empty text only counts as a document of its source.
    """
    docs = keep(line_ids(notes, source, key, text), "lines")
    # at most 100 / LEAST_PERCENT times the mean number of lines of a document are in blocks of a source: a row is small
    found = blocks(docs).select("s", F.explode("block").alias("line")).groupBy("s").agg(F.collect_set("line").alias("lines"))
    at = docs.join(found, "s").select(F.col("k").alias(key), F.posexplode(F.transform("ids", lambda x: F.array_contains(F.col("lines"), x))).alias("p", "hit"))
    return at.where("hit").select(key, (F.col("p") + 1).alias("linea")).distinct()


def repeated_blocks(notes: DataFrame, source: str = "medio_id", key: str = "noticia_id", text: str = "texto_extraido") -> DataFrame:
    """(source, lineas, bloques, documentos): per source and length, its blocks of several lines and the documents of the commonest."""
    found = long_blocks(keep(line_ids(notes, source, key, text), "lines")).where(F.size("lines") > 1)
    return found.groupBy(F.col("s").alias(source), F.size("lines").alias("lineas")).agg(F.count_distinct("lines").alias("bloques"), F.max("docs").alias("documentos"))


def remove_repeated(notes: DataFrame, source: str = "medio_id", key: str = "noticia_id", text: str = "texto_extraido", out: str = "texto_sin_repetidas") -> DataFrame:
    """The notes with ``out``: the text without the lines repeated in its source."""
    bad = find_repeated(notes, source, key, text).groupBy(key).agg(F.collect_set("linea").alias("__lineas"))
    joined = notes.join(bad, key, "left")
    kept = F.filter(F.transform(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda p: ~F.array_contains(F.col("__lineas"), p["i"]))
    return joined.withColumn(out, F.when(F.col("__lineas").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.transform(kept, lambda p: p["x"]), "\n"))).drop("__lineas")
