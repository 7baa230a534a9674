"""Functions over web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# Parameters that only track where a visit came from, and second-level suffixes.
TRACKING = r"^(utm_\w+|fbclid|gclid|mc_cid|mc_eid|igshid|ref|ref_src)$"
_SECOND_LEVEL = r"(com|org|gob|edu|net|co|gov|ac)\.[a-z]{2}"


def host(c: Column | str) -> Column:
    """Host in lower case without ``www.`` and port."""
    h = F.regexp_extract(F.lower(F.trim(_col(c))), r"^(?:[a-z][a-z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.when(F.length(h) > 0, F.regexp_replace(h, r"^www\.", ""))


def domain(c: Column | str) -> Column:
    """Registrable domain; two-part public suffixes such as ``com.mx`` count as one."""
    h = host(c)
    return F.coalesce(F.nullif(F.regexp_extract(h, rf"([^.]+\.{_SECOND_LEVEL})$", 1), F.lit("")), F.nullif(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1), F.lit("")), h)


def path(c: Column | str) -> Column:
    """Path without query and fragment, at least ``/``."""
    p = F.regexp_extract(F.trim(_col(c)), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?+[^/?#]+(/[^?#]*)", 1)
    return F.when(F.length(p) > 0, p).otherwise("/")


def _parameters(c: Column | str) -> Column:
    query = F.regexp_extract(_col(c), r"\?([^#]*)", 1)
    return F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.regexp_like(F.lower(F.split(x, "=")[0]), F.lit(TRACKING)))


def canonical(c: Column | str) -> Column:
    """Address for equality within a source: scheme and host in lower case, no
    fragment, no tracking parameters, one trailing slash less; parameters keep their order."""
    u = F.trim(_col(c))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    h = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    p = path(u)
    params = F.array_join(_parameters(u), "&")
    out = F.concat(scheme, F.lit("://"), h, F.when(p == "/", "").otherwise(F.regexp_replace(p, "/$", "")), F.when(F.length(params) > 0, F.concat(F.lit("?"), params)).otherwise(""))
    return F.when(F.length(scheme) > 0, out).otherwise(F.when(F.length(u) > 0, u))


def identity(c: Column | str) -> Column:
    """Address for equality across sources: without scheme, ``www.``, trailing slashes; parameters sorted."""
    params = F.array_join(F.array_sort(_parameters(c)), "&")
    out = F.concat(host(c), F.regexp_replace(path(c), "/+$", ""), F.when(F.length(params) > 0, F.concat(F.lit("?"), params)).otherwise(""))
    return F.when(host(c).isNotNull(), out)


def segments(c: Column | str) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path(c), "/"), lambda x: x != "")


def is_listing(c: Column | str) -> Column:
    """Whether an address is a home page or a section's listing rather than a note's."""
    s = segments(c)
    post = F.regexp_like(_col(c), F.lit(r"[?&]p=\d+"))
    return ~post & ((F.size(s) == 0) | ((F.size(s) <= 2) & ~F.regexp_like(F.element_at(s, -1), F.lit(r"-.*-|\d{4,}|\.html?$"))))


def host_suffixes(h: Column) -> Column:
    """A host and all the hosts it belongs to, longest first."""
    parts = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def variants(c: Column | str) -> Column:
    """Forms under which the same address may be stored."""
    u = F.regexp_replace(canonical(c), "/$", "")
    flip = F.when(F.regexp_like(u, F.lit("^https?://www[.]")), F.regexp_replace(u, r"^(https?://)www\.", "$1")).otherwise(F.regexp_replace(u, r"^(https?://)", "$1www."))
    return F.array_distinct(F.array(F.trim(_col(c)), u, F.concat(u, F.lit("/")), flip))
