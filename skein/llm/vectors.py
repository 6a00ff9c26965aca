"""Vectors that take part in search and clustering, and the coarse cells that spread a large group over many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import materialize

GROUP = ["vector_kind", "model_id", "account_id"]


def current_vectors(df: DataFrame, kind: str, key: str, dim: int = 64) -> DataFrame:
    """One row a key and model: the row with the latest created_at, if it has `dim` finite numbers that are not all zero.

    A model's suffix `:latest` is dropped. A null key, model or account takes no part; a null time counts as the
    earliest. Repeated rows and ties of time (equal vectors) give one row. Result: vector_kind, model_id, account_id,
    rowid, vec (array<float>); further columns of df are ignored.
    """
    rows = df.select(
        F.col(key).cast("long").alias("rowid"),
        F.regexp_replace(F.trim("model_id"), "(?i):latest$", "").alias("model_id"),
        F.col("account_id"),
        F.col("embedding").alias("vec"),
        F.coalesce("created_at", F.timestamp_seconds(F.lit(0))).alias("at"),
    ).dropna(subset=["rowid", "model_id", "account_id"])
    last = rows.groupBy("rowid", "model_id").agg(F.max_by(F.struct("account_id", "vec"), "at").alias("r"))
    vec = F.col("r.vec")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return last.where(vec.isNotNull() & (F.size(vec) == dim) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)).select(
        F.lit(kind).alias("vector_kind"), "model_id", F.col("r.account_id").alias("account_id"), "rowid", vec.alias("vec")
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of unit length, in double precision."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(col)
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def hot_copies(vectors: DataFrame, keep: int, share: int = 100_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Split off the copies that no search needs: (vectors without them, hot, copies).

    Equal vectors of a group are a class; classes of more than a 1/`share` of all rows, and more than `keep`, are hot: at most
    `share` of them, so that they may be broadcast. Of a hot class the `keep` rows of smallest rowid stay in the first
    table; hot has (class, rowids) with these; copies (*GROUP, rowid, class) are the others, without their vectors.
    """
    kind = F.xxhash64(*GROUP, "vec")
    sizes = vectors.select(kind.alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
    sizes = materialize(sizes.where(F.col("copies") > keep))
    if sizes.isEmpty():
        none = vectors.limit(0)
        return vectors, none.select(F.lit(0).cast("long").alias("class"), F.array("rowid").alias("rowids")), none.select(*GROUP, "rowid", F.lit(0).cast("long").alias("class"))
    rows = vectors.count()
    many = F.broadcast(sizes.where(F.col("copies") > rows / share).select("class"))
    own = vectors.select(kind.alias("class"), "rowid").join(many, "class")
    first = own.withColumn("n", F.row_number().over(Window.partitionBy("class").orderBy("rowid"))).where(F.col("n") <= keep)
    hot = materialize(first.groupBy("class").agg(F.array_sort(F.collect_list("rowid")).alias("rowids")))
    marked = vectors.withColumn("class", kind).join(F.broadcast(hot), "class", "left")
    spare = F.col("rowids").isNotNull() & ~F.array_contains(F.coalesce("rowids", F.array().cast("array<bigint>")), F.col("rowid"))
    return marked.where(~spare).select(*vectors.columns), hot, marked.where(spare).select(*GROUP, "rowid", "class")


def fit_flat(x: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Balanced k-means centres on unit vectors, seeded by the rows' order: each overfull cell hands a part of its rows to one of the emptiest."""
    cells = min(cells, len(x))
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        size = np.bincount(own, minlength=cells)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = [k for k in np.argsort(-size, kind="stable") if size[k] > 2 * max(1.0, len(x) / cells)]
        for high, low in zip(full, [k for k in np.argsort(size, kind="stable") if size[k] < 0.5 * len(x) / cells]):
            total[low] = x[np.flatnonzero(own == high)[size[high] // 2]]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def fit_cells(x: np.ndarray, cells: int, flat: int = 1_024) -> np.ndarray:
    """Centres of `cells` cells: of more than `flat` in two levels, each coarse cell getting its share of the centres."""
    if cells <= flat:
        return fit_flat(x, cells)
    coarse = fit_flat(x, int(np.ceil(np.sqrt(cells))))
    own = np.concatenate([(x[i : i + 4096] @ coarse.T).argmax(1) for i in range(0, len(x), 4096)])
    return np.concatenate([fit_cells(x[own == k], max(1, round(cells * int((own == k).sum()) / len(x))), flat) for k in np.unique(own)])


class CellGraph:
    """Centres with an in-memory neighbour graph: best-first search from a few entry points, in batches of queries."""

    def __init__(self, centres: np.ndarray, degree: int = 16):
        self.c = centres
        n = len(centres)
        self.near = np.empty((n, min(degree, n - 1)), np.int64)
        for i in range(0, n, 1024):
            sim = centres[i : i + 1024] @ centres.T
            sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -9
            if n > 1:
                self.near[i : i + 1024] = np.argpartition(-sim, self.near.shape[1] - 1, axis=1)[:, : self.near.shape[1]]
        self.entry = np.linspace(0, n - 1, max(1, int(2 * np.sqrt(n)))).astype(int)
        self.entry = np.unique(self.entry)

    def search(self, q: np.ndarray, width: int, hops: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the `width` nearest centres found and their distances, nearest first; far beyond 2 where fewer were found."""
        width = min(width, len(self.c))
        beam = max(8, 2 * width)
        first = q @ self.c[self.entry].T
        found = self.entry[np.argsort(-first, axis=1)[:, :beam]]
        sim = np.einsum("qd,qkd->qk", q, self.c[found])
        for _ in range(hops):
            grown = np.concatenate([found, self.near[found[:, : max(1, beam // 2)]].reshape(len(q), -1)], axis=1)
            grown.sort(axis=1)
            grown_sim = np.einsum("qd,qkd->qk", q, self.c[grown])
            grown_sim[:, 1:][grown[:, 1:] == grown[:, :-1]] = -9
            best = np.argsort(-grown_sim, axis=1)[:, :beam]
            new = np.take_along_axis(grown, best, 1)
            same = found.shape == new.shape and np.array_equal(found, new)
            found, sim = new, np.take_along_axis(grown_sim, best, 1)
            if same:
                break
        order = np.argsort(-sim, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(found, order, 1), np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sim, order, 1)))

    def within(self, q: np.ndarray, ratio: float, beyond: float = 0.0, width: int = 4) -> list[np.ndarray]:
        """Of each query the centres at most `ratio` times as far as its nearest one (and farther than `beyond` times), nearest first, however many."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        todo = np.arange(len(q))
        while len(todo):
            left = []
            for i in range(0, len(todo), max(1, 32_768 // width)):
                at = todo[i : i + max(1, 32_768 // width)]
                ids, far = self.search(q[at], width)
                ok = (far <= ratio * far[:, :1] + 1e-9) & (far <= 2.1)
                more = ok[:, -1] & (ids.shape[1] < len(self.c)) if ids.shape[1] == width else np.zeros(len(at), bool)
                keep = ok & (far > beyond * far[:, :1] + 1e-9) if beyond else ok
                for j in np.flatnonzero(~more):
                    out[at[j]] = ids[j][keep[j]]
                left.append(at[more])
            todo, width = np.concatenate(left), 2 * width
        return out


class Cells:
    """Cells of each group of vectors: centres fitted once, by which any vectors are then placed.

    A group of at most `cell_rows` vectors is one cell. Of a larger group a sample, taken by a hash of the row id, places the
    n / cell_rows centres: 65,536 vectors, or 8 a centre where that is more (a 256th of the rows at 2,048 a cell). Up to
    `broadcast_centres` centres (20 MB of 64 numbers) go to every task; beyond, slices of a group meet their centres in
    a cogroup. No group is gathered in one task.
    """

    def __init__(self, vectors: DataFrame, cell_rows: int, sample_rows: int = 65_536, slice_rows: int = 16_384, broadcast_centres: int = 40_000):
        self.cell_rows, self.slice_rows = cell_rows, slice_rows
        self.counts = materialize(vectors.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("group_rows")))
        large = vectors.join(self.counts.where(F.col("group_rows") > cell_rows), GROUP)
        u = F.pmod(F.xxhash64("rowid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        wanted = F.greatest(F.lit(float(sample_rows)), 8.0 * F.col("group_rows") / cell_rows)
        sample = large.where(u < wanted / F.col("group_rows")).select(*GROUP, "rowid", "vec", "group_rows")
        self.text = ", ".join(f"{g} string" for g in GROUP)

        def fit(key, t):
            t = t.sort_by("rowid")
            x, n = matrix(t["vec"]), t["group_rows"][0].as_py()
            c = fit_cells(x, max(2, -(-n // cell_rows)))
            own = np.concatenate([CellGraph(c).search(x[i : i + 4096], 1)[0][:, 0] for i in range(0, len(x), 4096)]) if len(c) > 4096 else np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
            share = np.bincount(own, minlength=len(c)) * (n / len(x))
            blocks = np.maximum(1, np.ceil(share / (2 * cell_rows))).astype(np.int32)
            slices = -(-n // max(slice_rows, 2 * len(c)))
            out = {g: pa.array([k.as_py()] * slices) for g, k in zip(GROUP, key)}
            return pa.table(out | {"slice": pa.array(range(slices), pa.int32()), "slices": pa.array([slices] * slices, pa.int32()), "centres": pa.array([c.ravel().tolist()] * slices, pa.list_(pa.float64())), "cell_blocks": pa.array([blocks.tolist()] * slices, pa.list_(pa.int32()))})

        self.centres = materialize(sample.groupBy(*GROUP).applyInArrow(fit, f"{self.text}, slice int, slices int, centres array<double>, cell_blocks array<int>"))
        of_group = self.centres.where(F.col("slice") == 0)
        self.sent = None
        if (of_group.agg(F.sum(F.size("cell_blocks"))).first()[0] or 0) <= broadcast_centres:
            self.sent = vectors.sparkSession.sparkContext.broadcast({tuple(r[g] for g in GROUP): (np.array(r["centres"]), r["cell_blocks"]) for r in of_group.toLocalIterator()})

    def place(self, vectors: DataFrame, ratio: float, beyond: float = 0.0) -> DataFrame:
        """(*GROUP, rowid, vec, cell, block, blocks, probes): the nearest cell, and as `probes` all cells whose centre is at most `ratio` (and more than `beyond`) times as far.

        A cell that holds more than its share is cut into `blocks` (one number a probe); a vector's block depends on its value.
        """
        sized = vectors.join(self.counts, GROUP)
        small = sized.where(F.col("group_rows") <= self.cell_rows).select(
            *GROUP, "rowid", "vec", F.lit(0).alias("cell"), F.lit(0).alias("block"), F.array(F.lit(1)).alias("blocks"), F.array(F.lit(0)).alias("probes")
        )
        if beyond:
            small = small.limit(0)
        large = sized.where(F.col("group_rows") > self.cell_rows)
        schema = pa.schema([(g, pa.string()) for g in GROUP] + [("rowid", pa.int64()), ("vec", pa.list_(pa.float32())), ("cell", pa.int32()), ("block", pa.int32()), ("blocks", pa.list_(pa.int32())), ("probes", pa.list_(pa.int32()))])
        ddl = f"{self.text}, rowid long, vec array<float>, cell int, block int, blocks array<int>, probes array<int>"

        def placed(t, graph, blocks):
            x = matrix(t["vec"])
            probes = graph.within(x, ratio, beyond)
            near = np.concatenate([graph.search(x[i : i + 4096], 1)[0][:, 0] for i in range(0, len(x), 4096)]) if beyond else np.array([p[0] for p in probes], np.int64)
            block = ((t["rowid"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % blocks[near].astype(np.uint64)
            cols = {g: t[g] for g in GROUP} | {"rowid": t["rowid"], "vec": t["vec"], "cell": pa.array(near.astype(np.int32)), "block": pa.array(block.astype(np.int32)), "blocks": pa.array([blocks[p].tolist() for p in probes], pa.list_(pa.int32())), "probes": pa.array([p.tolist() for p in probes], pa.list_(pa.int32()))}
            return pa.table(cols).cast(schema)

        def index(centres, cell_blocks):
            blocks = np.array(cell_blocks, np.int32)
            return CellGraph(np.array(centres).reshape(len(blocks), -1)), blocks

        if self.sent is not None:
            sent = self.sent

            def assign(batches):
                held = {}
                for b in batches:
                    t = pa.Table.from_batches([b])
                    for key in t.select(GROUP).group_by(GROUP).aggregate([]).to_pylist():
                        k = tuple(key[g] for g in GROUP)
                        if k not in sent.value:
                            continue
                        if k not in held:
                            held[k] = index(*sent.value[k])
                        own = t
                        for g in GROUP:
                            own = own.filter(pa.compute.equal(own[g], key[g]))
                        yield from placed(own, *held[k]).combine_chunks().to_batches()

            return small.unionByName(large.select(*GROUP, "rowid", "vec").mapInArrow(assign, ddl))

        slices = self.centres.where(F.col("slice") == 0).select(*GROUP, "slices")
        sliced = large.join(slices, GROUP).withColumn("slice", F.pmod(F.xxhash64("rowid", F.lit(7)), F.col("slices")).cast("int")).select(*GROUP, "slice", "rowid", "vec")

        def assign_slice(key, left, right):
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            return placed(left, *index(right["centres"][0].as_py(), right["cell_blocks"][0].as_py()))

        by = [*GROUP, "slice"]
        return small.unionByName(sliced.groupBy(*by).cogroup(self.centres.drop("slices").groupBy(*by)).applyInArrow(assign_slice, ddl))
