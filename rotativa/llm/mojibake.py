"""Garbled text from a wrong character encoding (problem 4).

All garbled forms of the letters of Latin-1, Latin-2 and Cyrillic and of the
marks of Spanish text are computed once for every pair of encodings, also for a
text decoded wrongly twice and for one whose garbled form was then written as
HTML entities.  A multi-pattern automaton finds them.  Long forms stand for
themselves; one that stands for several characters alike is Spanish or left.  A
form of a single character may also be a correct foreign letter; it counts only
where it can't be one - inside a word of another case or script, or a symbol
against a letter - and the pair it proves explains the other single forms of
that value, but for those inside a long form that isn't understood.  Only matched
spans are replaced, so that correct text beside them stays as it is.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of Spanish text outside ASCII, and the encodings that are mixed up.
LETTERS = "áéíóúüñÁÉÍÓÚÜÑ"
MARKS = "¿¡«»°ºª·©®€–—‘’“”…›‹•"
#: Letters of other languages, by the rule that these character sets name them.
OTHERS = "".join(sorted({c for e in ("iso8859-1", "iso8859-2", "iso8859-5") for c in bytes(range(0xA0, 0x100)).decode(e) if c.isalpha()} - set(LETTERS + MARKS)))
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp850")
READ = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "iso8859-15", "cp1250")

FIELDS = ("titulo", "texto_extraido")
LOST = "�"


_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def _read(raw: bytes, encoding: str) -> str:
    """Decode as lenient readers do: bytes without a meaning become control characters."""
    return "".join(_one(b, encoding) for b in raw)


def _one(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def _once(c: str) -> Iterator[tuple[str, str]]:
    for w in WRITTEN:
        try:
            raw = c.encode(w)
        except UnicodeEncodeError:
            continue
        for r in READ:
            if r != w:
                yield _read(raw, r), f"{w}>{r}"


@lru_cache(maxsize=1)
def tables() -> tuple[ahocorasick.Automaton, dict[str, dict[str, str]]]:
    """Automaton of the forms of several characters, and per pair the single ones."""
    long: dict[str, str] = {}
    single: dict[str, dict[str, str]] = {}
    correct = set(LETTERS + MARKS)
    for c in LETTERS + MARKS:
        for g, pair in _once(c):
            if len(g) > 1:
                long.setdefault(g, c)
                for r in ("cp1252", "latin-1"):
                    again = _read(g.encode("utf-8"), r)
                    long.setdefault(again, c)
                    twice = _read(again.encode("utf-8"), r)
                    long.setdefault(twice, c)
            elif g != c and not g.isascii():
                single.setdefault(pair, {})[g] = c
    others: dict[str, set[str]] = {}
    for c in OTHERS:
        for r in READ:
            g = _read(c.encode("utf-8"), r)
            # two Cyrillic letters may stand side by side in correct text
            if not all(map(_CYRILLIC.match, g)):
                others.setdefault(g, set()).add(c)
                for again in ("cp1252", "latin-1"):
                    others.setdefault(_read(g.encode("utf-8"), again), set()).add(c)
    for g, cs in others.items():
        if len(cs) == 1:
            long.setdefault(g, *cs)
    for g, c in list(long.items()):
        for named in _entities(g):
            long.setdefault(named, c)
    a = ahocorasick.Automaton()
    for g, c in long.items():
        # a form made of correct Spanish characters proves nothing
        if not all(x in correct or x.isascii() for x in g) or "&" in g:
            a.add_word(g, (len(g), c))
    a.make_automaton()
    return a, single


_NAMES = {v: f"&{k};" for k, v in reversed(list(html.entities.html5.items())) if k.isalnum() and len(v) == 1 and not v.isascii()}
_NAMES |= {chr(n): f"&{k};" for k, n in html.entities.name2codepoint.items() if n > 127}


def _entities(g: str) -> set[str]:
    """Forms of a garbled sequence of which all or the letter-like part was written as entities."""
    full = "".join(_NAMES.get(x, x) for x in g)
    bare = "".join(_NAMES.get(x, x) if x in "ÃÂâ" or x == "\xad" else x for x in g)
    soft = "".join(x if x == "\xad" else _NAMES.get(x, x) for x in g)
    num = "".join(f"&#{ord(x)};" for x in g)
    return {full, bare, soft, num} - {g}


_WORD_LOST = re.compile(r"(?<=[^\W\d_])\?{1,2}(?=[^\W\d_])")
_END_LOST = re.compile(r"(?<=[^\W\d_])\?(?=,? [a-záéíóúñü(\d]|,$|\.$|;)")
_START_LOST = re.compile(r"(?:^|(?<=[\s(]))\?(?=[^\W\d_])", re.M)
_URL = re.compile(r"(?:https?://|www\.)\S+|\S+\.(?:php|asp|html?|jsp|com|mx|org|example)\S*\?\S+|\S+\?\S*=\S*")
_LATIN_WORD = re.compile(r"[A-Za-z]")


def lost_letters(text: str) -> bool:
    """Whether letters were lost to replacement marks."""
    if LOST in text:
        return True
    if "?" not in text:
        return False
    t = _URL.sub(" ", text) if ("/" in text or "=" in text) else text
    if _WORD_LOST.search(t):
        return True
    # at the edge of a word only where no question is open
    for m in _END_LOST.finditer(t):
        before = t[: m.start()]
        if before.rfind("¿") <= max(before.rfind("?"), before.rfind("\n")) and "?" not in before[max(before.rfind("."), before.rfind("\n"), 0) :]:
            return True
    # Spanish has no question mark before a word
    return bool(_START_LOST.search(t))


def _strong(text: str, i: int, g: str, c: str) -> bool:
    """Whether a single form at i can't be a correct character of this place."""
    left = text[i - 1] if i else " "
    right = text[i + 1] if i + 1 < len(text) else " "
    if _CYRILLIC.match(g):
        return bool(_LATIN_WORD.match(left) or _LATIN_WORD.match(right))
    if c.isalpha() and c not in "ºª":
        if g == "Ð":
            return True  # no letter of the languages around
        if g == "ß":
            return left.isalpha() and left.lower() not in "aeiouáéíóúäöü"
        if g.isalpha():
            if g == "Õ" and left.isupper() and right != "E":
                return True
            if g.isupper() and left.islower() and left.isalpha():
                return True  # a capital inside or at the end of a word
            return g.isupper() and c.islower() and right.islower() and left.isalpha()
        if g in "·.'’-–°ºª´" or g in MARKS:
            return left.islower() and right.islower() and g not in "·'’-–" and g not in "ºª°"
        if left.isdigit() or right.isdigit():
            return False
        return left.isalpha() and (right.isalpha() or right in " .,;:\n»")
    # a quotation or question mark shown as another symbol, set against a word
    if g in "ª":
        return len(text[max(0, i - 2) : i].strip()) == 2 and text[max(0, i - 2) : i].isalpha()
    if g == "´":
        return not left.isalpha() and right.isalpha()
    if "─" <= g <= "▟":
        return left.isalpha() or right.isalpha() or left.isdigit()
    return g in "½¼¾" and right.isalpha() and not left.isalnum()


_OWN = frozenset(LETTERS + MARKS)


def _fits(text: str, i: int, g: str, c: str) -> bool:
    """Whether, under a proven pair, a correct character stands for another one here."""
    if g in MARKS and c.isalpha():
        return text[i - 1 : i].isalpha() or text[i + 1 : i + 2].isalpha()
    return _strong(text, i, g, c)


@lru_cache(maxsize=1)
def _suspects() -> tuple[re.Pattern[str], dict[str, list[tuple[str, str]]]]:
    _, single = tables()
    by: dict[str, list[tuple[str, str]]] = {}
    for pair, m in single.items():
        for g, c in m.items():
            by.setdefault(g, []).append((pair, c))
    return re.compile("[" + "".join(map(re.escape, by)) + "]"), by


_PLAIN = re.compile("[^\\x00-\\x7f" + LETTERS + MARKS + "]")


def _spans(text: str) -> list[tuple[int, int, str]]:
    """Longest garbled sequences, from the left."""
    a, _ = tables()
    best: dict[int, tuple[int, str]] = {}
    for end, (n, c) in a.iter(text):
        at = end - n + 1
        if best.get(at, (0, ""))[0] < n:
            best[at] = (n, c)
    out, done = [], 0
    for at in sorted(best):
        if at >= done:
            n, c = best[at]
            out.append((at, at + n, c))
            done = at + n
    return out


def proven_pairs(text: str) -> dict[str, int]:
    """Encoding pairs that single forms prove, with the number of proofs."""
    pattern, by = _suspects()
    votes: dict[str, int] = {}
    for m in pattern.finditer(text):
        g = m[0]
        for pair, c in by[g]:
            if _strong(text, m.start(), g, c):
                votes[pair] = votes.get(pair, 0) + 1
    return votes


def inspect(text: str | None) -> tuple[bool, bool]:
    """(garbled, lost): characters changed by a wrong encoding; letters lost to marks."""
    if not text:
        return False, False
    if text.isascii() and "?" not in text and "&" not in text:
        return False, False
    lost = lost_letters(text)
    if lost:
        return True, True
    if not _PLAIN.search(text) and "&" not in text:
        # nothing but correct characters; a symbol of these may still stand for a letter
        return bool(proven_pairs(text)) if _ODD.search(text) else False, False
    return bool(_spans(text)) or bool(proven_pairs(text)), False


_ODD = re.compile("(?<=[a-z])[" + re.escape(MARKS.replace("·", "").replace("’", "").replace("–", "").replace("…", "").replace("”", "").replace("»", "")) + "](?=[a-z])|(?<=[a-záéíóúüñ])[ÁÉÍÓÚÜÑ]")


@lru_cache(maxsize=1)
def _sequences() -> re.Pattern[str]:
    """UTF-8 sequences of any character in any of the encodings they may have been read in."""
    parts = []
    for r in READ:
        rest = "[" + "".join(re.escape(_one(b, r)) for b in range(0x80, 0xC0)) + "]"
        for first, last, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)):
            parts.append("[" + "".join(re.escape(_one(b, r)) for b in range(first, last + 1)) + "]" + rest * n)
    return re.compile("|".join(parts))


def repair(text: str | None) -> str | None:
    """The text with every matched span replaced; unchanged where nothing is garbled.

    A text garbled several times over is restored step by step until nothing is
    left to do.  Letters lost to replacement marks can't be restored and stay.
    """
    if not text or text.isascii() and "&" not in text:
        return text
    new: set[int] = set()  # places of restored characters
    # every step makes the text shorter
    while found := _spans(text):
        out, done, at, moved = [], 0, 0, set()
        for a, b, c in found:
            moved |= {i - done + at for i in range(done, a) if i in new} if new else set()
            at += a - done
            moved.add(at)
            at += 1
            out += [text[done:a], c]
            done = b
        moved |= {i - done + at for i in new if i >= done}
        text, new = "".join(out) + text[done:], moved
    votes = proven_pairs(text)
    if votes:
        # what was restored, and what looks like a sequence that wasn't understood, stays as it is
        whole = new | {i for q in _sequences().finditer(text) for i in range(*q.span())}
        foreign = [i for i, x in enumerate(text) if not x.isascii() and x not in LETTERS and x not in MARKS and i not in whole]
        pair = max(sorted(votes), key=lambda p: _explained(text, foreign, tables()[1][p], 2 * votes[p]))
        m = tables()[1][pair]
        # a correct Spanish character is replaced only where it can't be one
        text = "".join(m[x] if x in m and i not in whole and (x not in _OWN or _fits(text, i, x, m[x])) else x for i, x in enumerate(text))
    return text


def _explained(text: str, foreign: list[int], m: dict[str, str], proofs: int) -> tuple[int, int]:
    """How much a pair explains: its proofs and characters, and how many of its letters have the case of their surroundings."""
    cases = sum(m[x].islower() == text[i - 1 : i].islower() for i, x in enumerate(text) if x in m and text[i - 1 : i].isalpha())
    return proofs + sum(text[i] in m for i in foreign), cases


def find_garbled(notes: DataFrame, fields: Sequence[str] = FIELDS, key: str = "noticia_id") -> DataFrame:
    """(key, campo) of the values with characters changed by a wrong encoding.

    Null and empty values give no row; repeated rows count once.
    """
    names = list(fields)
    picked = notes.select(F.col(f"`{key}`").cast("string").alias("k"), *(_suspect(F.col(f"`{f}`").cast("string")).alias(f"f{i}") for i, f in enumerate(names)))
    some = picked.where(F.col("k").isNotNull() & F.coalesce(*(F.col(f"f{i}") for i in range(len(names)))).isNotNull())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(0).to_pylist()
            out_k, out_c = [], []
            for i, name in enumerate(names):
                hits = [k for k, t in zip(ks, b.column(i + 1).to_pylist()) if t and inspect(t)[0]]
                out_k += hits
                out_c += [name] * len(hits)
            yield pa.RecordBatch.from_arrays([pa.array(out_k, pa.string()), pa.array(out_c, pa.string())], names=["k", "campo"])

    return some.mapInArrow(scan, "k string, campo string").distinct().withColumnRenamed("k", key)


def _suspect(c: Column) -> Column:
    """The value where it may be garbled, else null: keeps clean text out of Python."""
    odd = "[^\\x00-\\x7f" + LETTERS + "¿¡«»°·©—–…" + "]|[\\p{L}]\\?[,.;]? ?[\\p{Ll}(\\d]|\\?\\p{L}|\\p{L}\\?\\?|&(?:[A-Za-z]+|#\\d+);|\\p{Ll}[ÁÉÍÓÚÜÑ¡¿«»©°]|\\p{L}\\?[.,;]"
    return F.when(c.rlike(odd), c)


def repair_column(notes: DataFrame, field: str, out: str) -> DataFrame:
    """The notes with ``out``: the field restored where it was garbled."""

    @F.pandas_udf("string")
    def fix(s):  # noqa: ANN001, ANN202
        return s.map(lambda t: repair(t) if t else t)

    return notes.withColumn(out, F.when(_suspect(F.col(f"`{field}`")).isNotNull(), fix(F.col(f"`{field}`"))).otherwise(F.col(f"`{field}`")))


def restored(notes: DataFrame, fields: Sequence[str] = FIELDS, key: str = "noticia_id") -> DataFrame:
    """(key, campo, restaurado) of the values that repairing changes; null keys and values give no row, repeated rows count once."""
    named = F.explode(F.array(*(F.struct(F.lit(f).alias("campo"), _suspect(F.col(f"`{f}`").cast("string")).alias("valor")) for f in fields))).alias("v")
    some = notes.select(F.col(f"`{key}`").cast("string").alias("k"), named).select("k", "v.campo", "v.valor").where("k IS NOT NULL AND valor IS NOT NULL")
    return repair_column(some, "valor", "restaurado").where("restaurado != valor").select(F.col("k").alias(key), "campo", "restaurado").distinct()
