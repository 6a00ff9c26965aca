"""Problem 3: the most similar vectors of every vector, by balanced posting lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.vectors import GROUP, Cells, current_vectors, hot_copies, matrix
from skein.runtime import materialize
from skein.sources import table


def take_part(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of email_embeddings and chunk_embeddings that count."""
    return current_vectors(table(spark, folder, "email_embeddings"), "email", "email_rowid").unionByName(current_vectors(table(spark, folder, "chunk_embeddings"), "chunk", "chunk_rowid"))


def nearest_in_list(ids: np.ndarray, posted: np.ndarray, x: np.ndarray, asked: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (asked id, neighbour id, distance) of one list: the k nearest posted rows, by distance, then id; no row is its own neighbour."""
    p = np.flatnonzero(posted)
    p = p[np.argsort(ids[p], kind="stable")]
    base, out = x[p], []
    asked = np.flatnonzero(asked)
    step = max(16, 2_000_000 // max(1, len(p)))
    for i in range(0, len(asked), step):
        q = asked[i : i + step]
        sim = x[q] @ base.T
        sim[ids[q][:, None] == ids[p][None, :]] = -9
        take = min(k, len(p))
        kth = np.partition(sim, len(p) - take, axis=1)[:, len(p) - take]
        row, col = np.nonzero((sim >= kth[:, None] - 1e-9) & (sim >= 1 - limit * limit / 2 - 1e-9) & (sim > -2))
        far = np.linalg.norm(x[q[row]] - base[col], axis=1)
        order = np.lexsort((col, np.round(far, 9), row))
        row, col, far = row[order], col[order], far[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        ok = (rank < k) & (far <= limit)
        out.append((ids[q[row[ok]]], ids[p[col[ok]]], far[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def neighbours(vectors: DataFrame, k: int = 10, limit: float = 2.0, list_rows: int = 2_048, ratios: tuple[float, ...] = (1.1, 1.3, 1.6), settled: float = 0.5, **cells) -> DataFrame:
    """Of every vector its k nearest of the same kind, model and account: (*GROUP, rowid, neighbour_rowid, distance, place).

    Vectors are scaled to unit length, distances are Euclidean in double precision, ties go to the smaller row id, and
    only distances up to `limit` come out. A group of at most `list_rows` vectors is one posting list and searched
    whole. A larger one is divided into lists of about that size: a vector asks all lists whose centre is at most
    ratios[0] times as far as the nearest one, however many, and is posted in the first two of these (boundary
    vectors therefore twice); the centres are searched by a graph in memory. A vector travels once to each list that it
    asks, serving there as query and, where posted, as posting. These lists miss hardly any neighbour up to `settled`
    apart, but more of the farther ones; so, where `limit` is greater, a vector whose k-th find is farther asks all
    lists up to ratios[1] times as far as well, and as long as a third of its finds are new, those of the next ratio. Of vectors with more than k + 1 copies, and more than a 100,000th of
    all rows, only the k + 1 of smallest row id are searched; the other copies' neighbours are k of these, at distance
    0. Empty input gives an empty result.
    """
    vectors, hot, copies = hot_copies(vectors, k + 1)
    index = Cells(vectors, list_rows, **cells)
    placed = index.place(vectors, ratios[0])
    if limit > settled:
        placed = materialize(placed)

    def lists(df):
        """One row a list that a vector asks, and a block of it; `home` tells the block it is posted in."""
        df = df.select(*GROUP, "rowid", "vec", F.posexplode("probes").alias("at", "list"), "blocks").withColumn("list_blocks", F.element_at("blocks", F.col("at") + 1)).drop("blocks")
        return df.withColumn("home", F.pmod(F.xxhash64("rowid", F.lit(3)), F.col("list_blocks")).cast("int"))

    def asking(df):
        return lists(df).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("list_blocks") - 1)))

    def search(key, t):
        ids = t["rowid"].to_numpy()
        asked = t["asked"].to_numpy(zero_copy_only=False)
        a, b, d = nearest_in_list(ids, t["posted"].to_numpy(zero_copy_only=False), matrix(t["vec"]), asked, k, limit)
        out = {g: pa.array([key[i].as_py()] * len(a), pa.string()) for i, g in enumerate(GROUP)}
        return pa.table(out | {"rowid": pa.array(a, pa.int64()), "neighbour_rowid": pa.array(b, pa.int64()), "distance": pa.array(d, pa.float64())})

    def ranked(found):
        # one shuffle serves both the merging of equal finds and the ranking
        best = found.repartition(*GROUP, "rowid").groupBy(*GROUP, "rowid", "neighbour_rowid").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
        w = Window.partitionBy(*GROUP, "rowid").orderBy(F.round("distance", 9), "neighbour_rowid")
        return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)

    text = ", ".join(f"{g} string" for g in GROUP)
    ddl = f"{text}, rowid long, neighbour_rowid long, distance double"
    by = [*GROUP, "list", "block"]
    every = asking(placed).withColumn("posted", (F.col("block") == F.col("home")) & (F.col("at") < 2)).withColumn("asked", F.lit(True))
    near = ranked(every.select(*by, "rowid", "vec", "posted", "asked").groupBy(*by).applyInArrow(search, ddl).withColumn("fresh", F.lit(1)))
    if limit > settled:
        near = materialize(near)
        large = index.counts.where(F.col("group_rows") > list_rows).select(*GROUP)
        held = lists(placed.join(large, GROUP, "left_semi")).where(F.col("at") < 2).select(*GROUP, "list", F.col("home").alias("block"), "rowid", "vec", F.lit(True).alias("posted"), F.lit(False).alias("asked"))
        rest = vectors.join(large, GROUP, "left_semi")
        for n in range(1, len(ratios)):
            found = near.groupBy(*GROUP, "rowid").agg(F.count_if(F.col("distance") <= settled).alias("close"), F.sum("fresh").alias("fresh"))
            done = found.where((F.col("close") >= k) | (F.col("fresh") < k / 3 if n > 1 else F.lit(False))).select(*GROUP, "rowid")
            rest = materialize(rest.join(done, [*GROUP, "rowid"], "left_anti"))
            more = asking(index.place(rest, ratios[n], ratios[n - 1])).select(*by, "rowid", "vec", F.lit(False).alias("posted"), F.lit(True).alias("asked"))
            new = held.unionByName(more).groupBy(*by).applyInArrow(search, ddl).withColumn("fresh", F.lit(1))
            near = materialize(ranked(near.drop("place").withColumn("fresh", F.lit(0)).unionByName(new)))
    near = near.drop("fresh")
    same = copies.join(F.broadcast(hot), "class").select(*GROUP, "rowid", F.posexplode(F.slice("rowids", 1, k)).alias("n", "neighbour_rowid"))
    return near.unionByName(same.select(*GROUP, "rowid", "neighbour_rowid", F.lit(0.0).alias("distance"), (F.col("n") + 1).alias("place")))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 nearest of every vector with their distances."""
    return neighbours(materialize(take_part(spark, folder))).withColumn("distance", F.round("distance", 9))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the 10 nearest of the other, at most 0.5 apart."""
    near = neighbours(materialize(take_part(spark, folder)), limit=0.5)
    return near.select(
        "vector_kind", "model_id", F.least("rowid", "neighbour_rowid").alias("left_rowid"), F.greatest("rowid", "neighbour_rowid").alias("right_rowid")
    ).distinct()


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours}
