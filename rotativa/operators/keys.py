"""Writing by key: upserts, insert-ignore, appends, flags, first-wins dedupe.

Tables without row locks or MERGE are changed by joins; every choice among rows
of a key is by an explicit order with a unique last entry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by an order; rows with a null in the key count as one key.

    Done as an aggregate with partial results before the shuffle, so that a hot
    key costs no more than any other.
    """
    cols = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *(F.col("__row")[c].alias(c) for c in cols)).select(*df.columns)


def last_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The last row of each key by an order."""
    cols = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *(F.col("__row")[c].alias(c) for c in cols)).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows with the values of new ones of the same key, and the new rows of new keys.

    A null in a new row leaves the old value.  New rows have distinct keys.
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return o.join(n, on, "full_outer").select(*(F.coalesce(F.col(f"n.{c}") if c in new.columns else F.lit(None), F.col(f"o.{c}")).alias(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The new rows whose key isn't there yet, each key once."""
    return first_by(new, keys, *order).join(old.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)


def append_plan(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """The new rows with what becomes of each: append, present, repeated or blank."""
    rank = Window.partitionBy(key).orderBy(*order)
    known = old.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("__known", F.lit(True))
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    ranked = new.join(known, key, "left").withColumn("__n", F.row_number().over(rank))
    plan = F.when(blank, "blank").when(F.col("__known"), "present").when(F.col("__n") > 1, "repeated").otherwise("append")
    return ranked.withColumn("plan", plan).drop("__known", "__n")


def set_flag(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """The rows with a flag set true where their key is listed."""
    listed = ids.select(F.col(key)).distinct().withColumn("__hit", F.lit(True))
    return df.join(listed, key, "left").withColumn(flag, F.coalesce(F.col("__hit"), F.col(flag))).drop("__hit").select(*df.columns)


def table_diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, estado, cambios): CREATE, UPDATE, UNCHANGED or ONLY_OLD, and the fields that differ."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    state = F.when(F.col(f"o.{key}").isNull(), "CREATE").when(F.col(f"n.{key}").isNull(), "ONLY_OLD").when(F.size(changed) > 0, "UPDATE").otherwise("UNCHANGED")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), state.alias("estado"), F.when(state == "UPDATE", F.array_join(changed, ",")).otherwise("").alias("cambios"))


def cell_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, campo, antes, ahora): the cells that differ between rows of the same key."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *(F.col(f).cast("string").alias(f) for f in fields)).unpivot(key, list(fields), "campo", name)

    return long(old, "antes").join(long(new, "ahora"), [key, "campo"]).where(~F.col("antes").eqNullSafe(F.col("ahora")))


def page_after(df: DataFrame, order: Sequence[str], after: Sequence[object], size: int) -> DataFrame:
    """The next page of a scan in an order with a unique last column, beyond a cursor."""
    beyond = F.lit(False)
    for i, c in enumerate(order):
        same = F.lit(True)
        for j in range(i):
            same = same & (F.col(order[j]) == F.lit(after[j]))
        beyond = beyond | (same & (F.col(c) > F.lit(after[i])))
    return df.where(beyond).orderBy(*order).limit(size)
