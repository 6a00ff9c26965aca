"""Reproducible samples: by a hash of the key for tables of any size, by a seeded shuffle for pools of bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import text_hash
from skein.operators.clustering import SeededRandom

#: Fixed value: what a second shuffle's seed differs by.
SECOND = 0x9E3779B9


def hash_ordered(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` rows whose key's FNV-1a hash is least; ties by the key itself, null keys are left out."""
    return df.where(F.col(key).isNotNull()).withColumn("_h", text_hash(F.col(key).cast("string"))).orderBy("_h", key).limit(limit).drop("_h")


def shuffled(items: list, seed: int) -> list:
    return [items[i] for i in SeededRandom(seed).shuffled(len(items))]


def diverse(items: list[tuple], n: int, seed: int) -> list[tuple]:
    """n of (key, domain) in the order of a seeded shuffle: first one a domain, then of the rest."""
    order = shuffled(items, seed)
    seen: set = set()
    first, rest = [], []
    for i in order:
        (rest if i[1] in seen else first).append(i)
        seen.add(i[1])
    return (first + rest)[:n]


def mixed(items: list[tuple], n: int, seed: int) -> list[tuple]:
    """n of (key, domain): half of them diverse, the rest in the order of a second shuffle, none twice."""
    out = diverse(items, -(-n // 2), seed)
    have = {k for k, _ in out}
    for i in shuffled(items, (seed ^ SECOND) & 0xFFFFFFFF):
        if len(out) >= n:
            break
        if i[0] not in have:
            out.append(i)
            have.add(i[0])
    return out


def sampled(df: DataFrame, group: str, key: str, domain: Column, order: list[Column], n: int, pool: int, seed: int, how=diverse) -> DataFrame:
    """(group, key, place): n rows of each group by `how`, from its first `pool` rows in `order`."""
    from pyspark.sql import Window

    few = df.select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), domain.alias("d"), F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("n")).where(F.col("n") <= pool)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        got = how(list(zip(pdf.k.tolist(), pdf.d.tolist())), n, seed)
        return pd.DataFrame({"g": pdf.g.iloc[0], "k": [k for k, _ in got], "place": range(1, len(got) + 1)})

    return few.groupBy("g").applyInPandas(take, "g string, k long, place long").withColumnsRenamed({"g": group, "k": key})
