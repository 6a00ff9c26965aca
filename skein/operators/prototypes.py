"""Nearest-prototype classification, centroids and their health."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import cosine, cosine_of_distance, l2_distance, norm


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, centroid, size): the normalised mean of each key's vectors, summed by axis before and after the shuffle."""
    axes = df.select(key, F.posexplode(vector).alias("axis", "v")).groupBy(key, "axis").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    held = axes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda x: x["m"]).alias("mean"), F.max("n").alias("size"))
    n = norm(F.col("mean"))
    return held.select(key, F.when(n == 0, F.col("mean")).otherwise(F.transform("mean", lambda x: x / n)).alias("centroid"), "size")


def ranked_categories(vectors: DataFrame, prototypes: DataFrame, key: str, vector: str = "embedding", first: int | None = None, block: int = 20_000) -> DataFrame:
    """(key, category, distance, place): each vector's categories by the distance to their nearest prototype, all or the first few; ties by category.

    prototypes (category, centroid) come to the driver in blocks of `block` rows; each goes to all tasks and meets the
    vectors in batches, so that only the first places leave a task. Beyond one block the blocks' finds are merged by key.
    Vectors that are null or not as long as the prototypes are left out.
    """
    spark = vectors.sparkSession
    held, parts = [], []
    category = vectors.sparkSession.createDataFrame([], prototypes.select("category").schema).schema[0].dataType.simpleString()
    ddl = f"{key} {vectors.schema[key].dataType.simpleString()}, category {category}, distance double, place int"

    def close():
        if not held:
            return
        names = sorted({r[0] for r in held})
        number = {c: i for i, c in enumerate(names)}
        order = sorted(held, key=lambda r: r[0])
        sent = spark.sparkContext.broadcast((names, np.array([number[r[0]] for r in order]), np.array([r[1] for r in order], float)))

        def rank(batches):
            names, of, m = sent.value
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for b in batches:
                v = b["v"].to_pylist()
                keep = [i for i, x in enumerate(v) if x is not None and len(x) == m.shape[1]]
                for at in range(0, len(keep), 1_024):
                    own = keep[at : at + 1_024]
                    x = np.array([v[i] for i in own], float)
                    d = np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in m], 1) if len(m) <= 64 else np.sqrt(np.maximum((x * x).sum(1)[:, None] + (m * m).sum(1) - 2 * x @ m.T, 0))
                    near = np.minimum.reduceat(d, starts, axis=1)
                    best = np.argsort(near, axis=1, kind="stable")[:, : first or len(names)]
                    w = best.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [b["k"].take(pa.array(np.repeat(own, w))), pa.array([names[c] for c in best.ravel()]).cast(types[1]), pa.array(np.take_along_axis(near, best, 1).ravel()), pa.array(np.tile(np.arange(1, w + 1), len(own)).astype(np.int32))],
                        [key, "category", "distance", "place"],
                    )

        parts.append(vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(rank, ddl))
        held.clear()

    from pyspark.sql.pandas.types import to_arrow_type

    types = [None, to_arrow_type(prototypes.schema["category"].dataType)]
    for r in prototypes.select("category", "centroid").where("category is not null and centroid is not null").toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) >= block:
            close()
    close()
    if not parts:
        return spark.createDataFrame([], ddl)
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy(key, "category").agg(F.min("distance").alias("distance"))
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("distance", "category")))
    return ranked if first is None else ranked.where(F.col("place") <= first)


def shortlist(ranking: DataFrame, key: str, few: int = 12, slack: float = 0.08) -> DataFrame:
    """The categories that a vector's closer reading starts from: all where they are at most `few`, or where more than `few` lie within `slack` of the best confidence; else the first `few`."""
    c = ranking.withColumn("confidence", cosine_of_distance(F.col("distance")))
    w = Window.partitionBy(key)
    c = c.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_best", F.max("confidence").over(w))
    close = F.count_if(F.col("_best") - F.col("confidence") <= slack).over(w)
    return c.withColumn("_close", close).where((F.col("_n") <= few) | (F.col("_close") > few) | (F.col("place") <= few)).drop("_n", "_best", "_close")


def collapsed(labels: DataFrame, centroids: DataFrame, key: str, most: int = 2, same: float = 0.92) -> DataFrame:
    """(key, category, place): of each key's categories in order, the first `most` that repeat none before, nor stand as near as `same` to one kept; categories without a centroid are kept.

    labels (key, category, place) hold a few rows a key; centroids (category, centroid) are broadcast after a count of at most 20,000.
    """
    if centroids.limit(20_001).count() > 20_000:
        raise ValueError("more than 20000 categories")
    of = {r[0]: np.array(r[1], float) for r in centroids.select("category", "centroid").collect()}
    sent = labels.sparkSession.sparkContext.broadcast({c: v / max(np.linalg.norm(v), 1e-12) for c, v in of.items()})

    def keep(categories: list) -> list:
        out: list = []
        for c in categories:
            v = sent.value.get(c)
            if len(out) < most and c not in out and not (v is not None and any((w := sent.value.get(o)) is not None and v @ w >= same for o in out)):
                out.append(c)
        return out

    kind = labels.schema["category"].dataType
    take = F.udf(keep, f"array<{kind.simpleString()}>", useArrow=True)
    lists = labels.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "category"))), lambda r: r["category"]).alias("c"))
    return lists.select(key, F.posexplode(take("c")).alias("n", "category")).select(key, "category", (F.col("n") + 1).alias("place"))


def folded_in(centroids: DataFrame, members: DataFrame) -> DataFrame:
    """(category, centroid, size): centroids (category, centroid, size) after the vectors of members (category, embedding) were averaged in, by weight; unit length."""
    new = members.select("category", F.posexplode("embedding").alias("axis", "v")).groupBy("category", "axis").agg(F.sum(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    old = centroids.select("category", F.col("size").alias("n"), F.posexplode("centroid").alias("axis", "v")).select("category", "axis", (F.col("v") * F.col("n")).alias("v"), "n")
    both = new.unionByName(old).groupBy("category", "axis").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    held = both.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", (F.col("v") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("mean"), F.max("n").alias("size"))
    n = norm(F.col("mean"))
    return held.select("category", F.when(n == 0, F.col("mean")).otherwise(F.transform("mean", lambda x: x / n)).alias("centroid"), "size")


def effective(prototypes: DataFrame, with_parts: bool = True) -> DataFrame:
    """The prototypes (category, part, centroid) that stand for a category: its parts 1, 2, .. where it has any and with_parts is set, else the whole, 0."""
    if not with_parts:
        return prototypes.where("part = 0")
    parts = F.max("part").over(Window.partitionBy("category"))
    return prototypes.withColumn("_parts", parts).where((F.col("_parts") == 0) | (F.col("part") > 0)).drop("_parts")


def gates(ranking: DataFrame, key: str, floor: float, margin: float | None = None, second_most: float | None = None) -> DataFrame:
    """(key, category, confidence): the first category, where it reaches `floor` and leads by `margin`, or the second stays within `second_most`."""
    w = Window.partitionBy(key).orderBy("place")
    c = ranking.where(F.col("place") <= 2).withColumn("confidence", cosine_of_distance(F.col("distance")))
    c = c.withColumn("second", F.lead("confidence").over(w)).where(F.col("place") == 1)
    ok = F.col("confidence") >= floor
    if margin is not None:
        ok &= F.col("second").isNull() | (F.col("confidence") - F.col("second") >= margin)
    if second_most is not None:
        ok &= F.col("second").isNull() | (F.col("second") <= second_most)
    return c.where(ok).select(key, "category", "confidence")


def multi_label(ranking: DataFrame, key: str, hard: float = 1.0, slack: float = 0.1, most: int = 3) -> DataFrame:
    """Categories within `slack` of the nearest and below `hard`, the first `most`; none where the nearest is not below `hard`."""
    best = F.min("distance").over(Window.partitionBy(key))
    return ranking.withColumn("_best", best).where((F.col("_best") < hard) & (F.col("distance") <= F.least(F.lit(hard), F.col("_best") + slack)) & (F.col("place") <= most)).drop("_best")


def nearest_other(prototypes: DataFrame) -> DataFrame:
    """(category, nearest, overlap): each category's nearest other one; prototypes are one row a category."""
    a, b = prototypes.select("category", F.col("centroid").alias("_a")), prototypes.select(F.col("category").alias("nearest"), F.col("centroid").alias("_b"))
    pair = a.join(b, F.col("category") != F.col("nearest")).withColumn("overlap", cosine(F.col("_a"), F.col("_b")))
    best = F.max_by(F.struct("nearest", "overlap"), F.struct("overlap", -F.col("nearest"))).alias("_n")
    return pair.groupBy("category").agg(best).select("category", F.col("_n.nearest").alias("nearest"), F.col("_n.overlap").alias("overlap"))
