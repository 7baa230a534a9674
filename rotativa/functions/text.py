"""Text functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters they fold to, one for one.
MARKED = "áàäâãåéèëêíìïîóòöôõúùüûñçý"
BARE = "aaaaaaeeeeiiiiooooouuuuncy"
_WORDS = r"[^\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Lower case without marks, of the same length, so that offsets hold."""
    return F.translate(F.lower(_col(c)), MARKED, BARE)


def fold_words(c: Column | str) -> Column:
    """Folded words separated by single spaces."""
    return F.trim(F.regexp_replace(fold(c), _WORDS, " "))


def content_key(*cols: Column | str) -> Column:
    """SHA-256 of the folded words of several fields; null where all are blank."""
    joined = fold_words(F.concat_ws(" ", *map(_col, cols)))
    return F.when(F.length(joined) > 0, F.sha2(joined, 256))


def blank_to_null(c: Column | str) -> Column:
    """Null for blank strings."""
    t = F.trim(_col(c))
    return F.when(F.length(t) > 0, t)


def first_filled(*cols: Column | str) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*map(blank_to_null, cols))


def cut_words(c: Column | str, most: int) -> Column:
    """At most ``most`` characters, without a word broken at the end."""
    t = F.trim(F.regexp_replace(_col(c), r"\s+", " "))
    cut = F.regexp_replace(F.substring(t, 1, most), r"\s+\S*$", "")
    return F.when(F.length(t) <= most, t).otherwise(cut)


def similarity(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length; 1 for two empty, 0 for one empty string."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_set(c: Column | str) -> Column:
    """Distinct folded words."""
    return F.array_distinct(F.filter(F.split(fold_words(c), " "), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_html(c: Column | str) -> Column:
    """Text without tags, scripts and the common entities."""
    t = F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def snippet(text: Column, at: Column, around: int = 90) -> Column:
    """The surroundings of a position (from 1), with ellipses where text was left out."""
    start = F.greatest(F.lit(1), at - around)
    stop = F.least(F.length(text), at + around)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substring(text, start, stop - start + 1)), F.when(stop < F.length(text), "…").otherwise(""))


def slug_title(url: Column | str) -> Column:
    """A readable title from the last path segment of an address."""
    last = F.regexp_extract(F.regexp_replace(_col(url), r"[?#].*$", ""), r"/([^/]+)/?$", 1)
    words = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"\.\w{2,5}$", ""), r"[-_]+", " "), r"(^| )\d{3,}( |$)", " "))
    return F.when(F.length(words) > 0, F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))))
