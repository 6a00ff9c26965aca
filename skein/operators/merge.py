"""Keyed merges on tables without MERGE: a new snapshot from the stored rows and the changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the one greatest in `order` (nulls least). Of rows equal in `order` the greatest in the remaining columns."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [*order, *[c for c in rest if c not in order and not dict(df.dtypes)[c].startswith("map")]]
    row = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*ranked)).alias("_row"))
    return row.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def keyed_merge(stored: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None) -> DataFrame:
    """Stored rows with the changes merged in by key, with the columns of `stored`.

    A key only in one table comes out as it is. On a match a column takes the changed value, or what its rule makes of
    (stored, changed). Columns that the changes lack keep the stored value, or null for new keys. Both sides must hold
    a key once (see newest); null keys never match.
    """
    rules = rules or {}
    s = stored.select(F.struct(*stored.columns).alias("s"), *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)])
    c = changes.select(F.struct(*changes.columns).alias("c"), *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)])
    on = [F.col(f"_s{i}") == F.col(f"_c{i}") for i in range(len(keys))]
    both = s.join(c, on, "full_outer")
    out = []
    for name in stored.columns:
        old = F.col(f"s.{name}")
        if name not in changes.columns:
            out.append(old.alias(name))
            continue
        new = F.col(f"c.{name}")
        merged = rules[name](old, new) if name in rules else new
        out.append(F.when(F.col("c").isNull(), old).when(F.col("s").isNull(), new).otherwise(merged).alias(name))
    return both.select(*out)


def keep_old(old: Column, new: Column) -> Column:
    return old


def fill(old: Column, new: Column) -> Column:
    """The changed value unless it is null."""
    return F.coalesce(new, old)


def sticky(old: Column, new: Column) -> Column:
    """True once it was true."""
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


#: How a message pushed again changes its stored row: heads are replaced, a body only by another one, the first time of indexing stays.
EMAIL_RULES: dict[str, Rule] = {"body": fill, "body_format": lambda o, n: F.coalesce(n, o), "body_fetched": sticky, "indexed_at": keep_old}


def invalidated(stored: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys whose `column` a change replaces by another, non-null value."""
    s = stored.select(*keys, F.col(column).alias("_old"))
    return changes.select(*keys, F.col(column).alias("_new")).where(F.col("_new").isNotNull()).join(s, keys).where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*keys)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose key is not in `gone`."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_where(stored: DataFrame, condition: Column, new: DataFrame) -> DataFrame:
    """Stored rows that don't meet the condition (null counts as not), and the new rows."""
    return stored.where(~F.coalesce(condition, F.lit(False))).unionByName(new)
