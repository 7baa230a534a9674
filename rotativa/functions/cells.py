"""Reading cells of hand-kept tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, fold

# Words for yes and no in cells.
YES = ("si", "s", "true", "verdadero", "1", "x", "activo", "activa", "yes", "y", "on")
NO = ("no", "n", "false", "falso", "0", "inactivo", "inactiva", "off")


def boolean(c: Column | str) -> Column:
    """True, false, or null where a cell says neither."""
    t = F.trim(fold(_col(c).cast("string")))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def integer(c: Column | str) -> Column:
    """The number a cell holds, without separators; null where it holds none."""
    t = F.regexp_replace(F.trim(_col(c)), r"[ ,]", "")
    return F.when(F.regexp_like(t, F.lit(r"^[+-]?\d{1,9}(\.0+)?$")), F.regexp_replace(t, r"\.0+$", "").cast("int"))


def id_list(c: Column | str) -> Column:
    """Distinct identifiers of a cell, split at ``|``, ``,`` and ``;``, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(_col(c), r"[|,;]"), lambda x: F.trim(x)), lambda x: x != ""))


def header(c: Column | str) -> Column:
    """Normal form of a column heading."""
    return F.regexp_replace(F.trim(F.regexp_replace(fold(c), r"[^a-z0-9]+", " ")), " ", "_")
