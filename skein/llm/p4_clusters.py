"""Problem 4: clusters of mutually similar emails by Gaussian mixtures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.vectors import GROUP, Cells, current_vectors, hot_copies, matrix
from skein.operators.components import connected_components
from skein.runtime import materialize
from skein.sources import table


def model_axes(vectors: DataFrame, keep: float = 0.95, most: int = 24, most_models: int = 1_000) -> dict:
    """Of each kind and model (mean, standard deviation, axes, variances): the leading principal axes of the standardised vectors that hold `keep` of the variance, `most` at most.

    A row counts `copies` times. The moments are summed in each task, then in groups of tasks; 64 sums a model come to the
    driver. More than `most_models` models are refused.
    """

    def moments(batches):
        held: dict[tuple, list] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            for key in t.select(GROUP[:2]).group_by(GROUP[:2]).aggregate([]).to_pylist():
                own = t
                for g in GROUP[:2]:
                    own = own.filter(pa.compute.equal(own[g], key[g]))
                x, times = matrix(own["vec"]), own["copies"].to_numpy().astype(np.float64)
                s = held.setdefault(tuple(key.values()), [0, 0.0, 0.0])
                s[0], s[1], s[2] = s[0] + times.sum(), s[1] + times @ x, s[2] + (x.T * times) @ x
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), pa.array([np.concatenate([[n], s, ss.ravel()]).tobytes() for n, s, ss in held.values()], pa.binary())], [*GROUP[:2], "sums"])

    def add(key, t):
        total = sum(np.frombuffer(v, np.float64) for v in t["sums"].to_pylist())
        return pa.table({g: pa.array([key[i].as_py()], pa.string()) for i, g in enumerate(GROUP[:2])} | {"sums": pa.array([total.tobytes()], pa.binary())})

    ddl = "vector_kind string, model_id string, sums binary"
    parts = vectors.select(*GROUP[:2], "vec", "copies").mapInArrow(moments, ddl).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    rows = parts.groupBy(*GROUP[:2], "salt").applyInArrow(add, ddl).limit(64 * most_models + 1).collect()
    sums: dict[tuple, np.ndarray] = {}
    for r in rows:
        sums[r[0], r[1]] = sums.get((r[0], r[1]), 0) + np.frombuffer(r["sums"], np.float64)
    if len(sums) > most_models:
        raise ValueError(f"more than {most_models} models")
    out = {}
    for key, s in sums.items():
        dim = int((np.sqrt(4 * len(s) - 3) - 1) / 2)
        mean = s[1 : dim + 1] / s[0]
        cov = s[dim + 1 :].reshape(dim, dim) / s[0] - np.outer(mean, mean)
        sd = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), 1e-6)
        value, axis = np.linalg.eigh(cov / np.outer(sd, sd))
        value, axis = np.maximum(value[::-1], 1e-9), axis[:, ::-1]
        r = min(most, int(np.searchsorted(np.cumsum(value), keep * value.sum())) + 1)
        out[key] = mean, sd, axis[:, :r], value[:r]
    return out


def mixture(y: np.ndarray, times: np.ndarray, seeds: list[np.ndarray], within: np.ndarray, over: np.ndarray, strength: float = 10.0, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation of diagonal Gaussians, one a seed set, and one background component at 0 with variances `over`.

    Covariances are drawn to `within`, as by `strength` further members. A row counts as `times` equal ones. Gives the
    component of each row (len(seeds) is the background), its log density and the Bayesian information criterion, in
    which a regularised variance counts as far as the members decide it.
    """
    n, r = times.sum(), y.shape[1]
    size = np.array([times[s].sum() for s in seeds], float)[:, None]
    mean = np.stack([*[times[s] @ y[s] / times[s].sum() for s in seeds], np.zeros(r)])
    var = np.stack([*[(strength * within + times[s] @ (y[s] - m) ** 2) / (strength + times[s].sum()) for s, m in zip(seeds, mean)], over])
    weight = np.append(size, max(1.0, n - size.sum()))
    weight /= weight.sum()
    y2 = y * y
    for step in range(rounds + 1):
        inv = 1 / var
        log = y @ (mean * inv).T - 0.5 * (y2 @ inv.T) - 0.5 * ((mean * mean * inv).sum(1) + np.log(var).sum(1) + r * np.log(2 * np.pi)) + np.log(weight)
        top = log.max(1)
        p = np.exp(log - top[:, None])
        total = p.sum(1)
        density = top + np.log(total)
        if step == rounds:
            break
        p *= (times / total)[:, None]
        mass = p.sum(0) + 1e-9
        size = mass[:-1, None]
        mean[:-1] = (p.T @ y)[:-1] / size
        var[:-1] = (strength * within + np.maximum((p.T @ y2)[:-1] - size * mean[:-1] ** 2, 0)) / (strength + size)
        weight = mass / mass.sum()
    free = len(seeds) * (r + 1) + (r * size / (strength + size)).sum()
    return log.argmax(1), density, free * np.log(max(n, 2)) - 2 * times @ density


def seed_sets(y: np.ndarray, times: np.ndarray, within: np.ndarray) -> list[np.ndarray]:
    """The neighbourhoods of the densest rows in turn, each without rows already taken: rows as far apart as members of one component of variances `within` are."""
    square = (y * y).sum(1)
    near = square[:, None] + square - 2 * y @ y.T <= 2.6 * within.sum()
    crowd, free, out = near @ times, np.ones(len(y), bool), []
    for i in np.argsort(-crowd, kind="stable"):
        if crowd[i] < 2:
            break
        if free[i]:
            own = np.flatnonzero(near[i] & free)
            free[own] = False
            if times[own].sum() > 1:
                out.append(own)
    return out


def components(x: np.ndarray, times: np.ndarray, axes: tuple, share: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """The mixture component of each unit vector (-1: none, the background) and its log density.

    Components are about as wide as `share` of the features' variance; their number, of the seed sets in the order of
    density, is that of least information criterion, found by halving steps down to one.
    """
    mean, sd, axis, over = axes
    y = (x - mean) / sd @ axis
    seeds = seed_sets(y, times, share * over)
    fits = {}

    def at(k):
        if k not in fits:
            fits[k] = mixture(y, times, seeds[:k], share * over, over)
        return fits[k][2]

    grid = sorted({round(len(seeds) * f / 4) for f in range(5)})
    while True:
        best = min(grid, key=at)
        place = grid.index(best)
        new = {(grid[o] + best) // 2 for o in (place - 1, place + 1) if 0 <= o < len(grid) and abs(grid[o] - best) > 1} - set(grid)
        if not new:
            break
        grid = sorted({*grid, *new})
    label, density, _ = fits[best]
    return np.where(label < best, label, -1), density


def spread(n: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n nodes along the links row-col (given both ways)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, row, low[col])
        new = np.minimum(new, new[new])
        if np.array_equal(new, low):
            return low
        low = new


def fragments(x: np.ndarray, times: np.ndarray, axes: tuple, least_cosine: float = 0.80) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label (the smallest place of a member), log density, whether the check moved it and whether its label is loose, of each unit vector.

    A row stands for `times` equal ones. Loose is what holds no row of a component of the mixture. The mixture's components are the clusters. The check by `least_cosine` then takes apart what no chain of such cosines
    links inside a component; a row that has none within its component, or is of the background, goes to the component of
    its most similar row, if linked; and rows of no component that are linked to each other come together. Links of single
    rows never join components; those whose means have such a cosine are joined.
    """
    n = len(x)
    label, density = components(x, times, axes)
    sim = x @ x.T
    np.fill_diagonal(sim, -1)
    linked = sim >= least_cosine
    # a component falls into the parts that are linked inside it; the largest keeps its label
    mixed = label.copy()
    row, col = np.nonzero(linked & (label[:, None] == label) & (label >= 0))
    part = spread(n, row, col)
    size = np.bincount(part, times, minlength=n)
    label = np.where((label >= 0) & (size[part] > 1), part, -1)
    main: dict[int, int] = {}
    for i in np.argsort(-size[part], kind="stable").tolist():
        main.setdefault(int(mixed[i]), int(part[i]))
    kept = np.array([m >= 0 and main[m] == q for m, q in zip(mixed.tolist(), label.tolist())], bool)
    for _ in range(n):
        free = np.flatnonzero(label < 0)
        to = np.where(linked[free] & (label >= 0), sim[free], -1) if len(free) else np.zeros((0, n))
        best = to.argmax(1) if len(free) else free
        ok = to[np.arange(len(free)), best] >= least_cosine
        if not ok.any():
            break
        label[free[ok]] = label[best[ok]]
    # what is left joins its own kind
    free = label < 0
    row, col = np.nonzero(linked & free[:, None] & free)
    low = spread(n, row, col)
    for k in np.unique(label[label >= 0]):
        own = np.flatnonzero(label == k)
        low[own] = own[0]
    moved = np.where(free, (mixed >= 0) | (np.bincount(low, times, minlength=n)[low] > 1), ~kept)
    heads = np.flatnonzero(low == np.arange(n))
    total = np.zeros_like(x)
    np.add.at(total, low, x * times[:, None])
    mean = total[heads] / np.maximum(np.linalg.norm(total[heads], axis=1, keepdims=True), 1e-12)
    row, col = np.nonzero(mean @ mean.T >= least_cosine)
    low = heads[spread(len(heads), row, col)][np.searchsorted(heads, low)]
    firm = np.zeros(n, bool)
    np.logical_or.at(firm, low, ~free)
    return low, density, moved, ~firm[low]


def close_pairs(rows: np.ndarray, times: np.ndarray, fragment: np.ndarray, loose: np.ndarray, fit: np.ndarray, block: np.ndarray, first: int, second: int, least_cosine: float = 0.80) -> tuple[np.ndarray, ...]:
    """Of fragments of two blocks, given by their unit vectors in the order of `fragment`, all pairs that come together: ids, whether they are loose, largest cosine of two rows (0 if less than least_cosine or not asked) and cosine of the means.

    A pair of one fit is left to that fit. Two fragments that are not loose need means with such a cosine; if one is loose,
    two such rows will do. Rows are compared unless the angle of the means shows that none can be near enough: by
    the triangle inequality it is then larger than the angle asked for and both fragments' radii.
    """
    start = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
    size = np.diff(np.append(start, len(fragment)))
    total = np.add.reduceat(rows * times[:, None], start, axis=0)
    length = np.linalg.norm(total, axis=1, keepdims=True)
    mean = total / np.maximum(length, 1e-12)
    radius = np.maximum.reduceat(np.arccos(np.clip((rows * np.repeat(mean, size, axis=0)).sum(1), -1, 1)), start)
    radius[size == 1] = 0
    radius[length[:, 0] < 1e-6] = np.pi
    loose, fit, block = loose[start], fit[start], block[start]
    rough, asked, margin = mean.astype(np.float32), np.arccos(least_cosine), 1e-4

    def nearest_rows(f, others):
        n = size[others]
        edge = np.append(0, np.cumsum(n)[:-1])
        at, x = np.repeat(start[others] - edge, n) + np.arange(n.sum()), rows[start[f] : start[f] + size[f]]
        return np.maximum.reduceat(np.concatenate([(rows[at[k : k + 2048]] @ x.T).max(1) for k in range(0, len(at), 2048)]), edge)

    of = lambda b, free: (own := np.flatnonzero((block == b) & (loose == free)))[np.argsort(radius[own], kind="stable")]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
    for free, also in ((False, False), (True, False), (False, True), (True, True)):
        if first == second and also > free:
            continue
        one, two, same = of(first, free), of(second, also), first == second and free == also
        # the radii count beside a loose fragment only
        reach = radius * (free or also)
        for a in range(0, len(one), 1024):
            p = one[a : a + 1024]
            for b in range(a if same else 0, len(two), 2048):
                q = two[b : b + 2048]
                wide = np.minimum(np.pi, asked + reach[p] + reach[q[-1]] + margin)
                i, j = np.nonzero(rough[p] @ rough[q].T >= (np.cos(wide) - 1e-5).astype(np.float32)[:, None])
                ok = (fit[p[i]] != fit[q[j]]) & (not same or a + i < b + j)
                i, j = p[i[ok]], q[j[ok]]
                cosine = (mean[i] * mean[j]).sum(1)
                best = np.zeros(len(i))
                if free or also:
                    ask = np.arccos(np.clip(cosine, -1, 1)) <= asked + reach[i] + reach[j] + margin
                    single = size[i] + size[j] == 2
                    best[single] = cosine[single]
                    side, other = (i, j) if free else (j, i)
                    todo = np.flatnonzero(ask & ~single)
                    todo = todo[np.argsort(side[todo], kind="stable")]
                    for own in np.split(todo, np.flatnonzero(np.diff(side[todo])) + 1) if len(todo) else []:
                        best[own] = nearest_rows(side[own[0]], other[own])
                    best[best < least_cosine] = 0
                ok = (best > 0) | (cosine >= least_cosine)
                found.append((i[ok], j[ok], best[ok], cosine[ok]))
    i, j, best, cosine = (np.concatenate(v) for v in zip(*found))
    return fragment[start[i]], fragment[start[j]], loose[i], loose[j], best, cosine


def joined(edges: DataFrame) -> DataFrame:
    """(vector_kind, model_id, fragment, joined): the smallest fragment that each fragment on an edge comes together with.

    As within a fit: fragments that are not loose are joined by each of their edges. A loose one goes to the nearest that is not, by
    rows before means, so that it joins no two others; then those near a loose one that has found its place, and so on.
    Loose ones that reach none are joined by their edges.
    """
    node = lambda c: F.struct(*GROUP[:2], F.col(c).alias("id"))
    edges = materialize(edges.select(node("left").alias("left"), node("right").alias("right"), "left_loose", "right_loose", "rows", "means"))
    turned = edges.select(F.col("right").alias("left"), F.col("left").alias("right"), F.col("right_loose").alias("left_loose"), F.col("left_loose").alias("right_loose"), "rows", "means")
    loose = edges.unionByName(turned).where("left_loose")
    nearest = lambda df: df.groupBy("left").agg(F.max_by("right", F.struct("rows", "means", "right")).alias("right"))
    chains = loose.where("right_loose")
    placed = new = materialize(nearest(loose.where("not right_loose")))
    while not new.isEmpty():
        reached = chains.join(placed.select("left"), "left", "left_anti").join(placed.select(F.col("left").alias("right")), "right", "left_semi")
        new = materialize(nearest(reached))
        placed = placed.unionByName(new)
    rest = chains.join(placed.select("left"), "left", "left_anti").select("left", "right")
    firm = edges.where("not left_loose and not right_loose").select("left", "right")
    same = connected_components(firm.unionByName(placed).unionByName(rest))
    return same.select(F.col("node.vector_kind").alias("vector_kind"), F.col("node.model_id").alias("model_id"), F.col("node.id").alias("fragment"), F.col("component.id").alias("joined"))


def clusters(vectors: DataFrame, least_cosine: float = 0.80, least_size: int = 3, cell_rows: int = 1_024, with_sums: bool = False, block_rows: int = 65_536) -> DataFrame:
    """Members (*GROUP, rowid, cluster_rowid, size, density, moved) of the clusters of each group; with_sums: and `total`, the sum of a fragment's unit vectors, on one row a fragment.

    A group is spread over cells of about `cell_rows` vectors (see Cells), and a mixture is fitted in each: EM on features
    standardised and reduced by model, components chosen by information criterion. `moved` tells of rows that the
    check by cosine put elsewhere (see fragments). What the cells cut apart is linked again: all fragments of a group are
    compared, whatever their cells, in pairs of blocks of about `block_rows` vectors (see close_pairs and joined).
    Clusters of fewer than `least_size` are left out. Of vectors with very many copies (see hot_copies) three are placed, one of
    which counts for all others in every sum; these follow it. Empty input gives empty results; ties of density go to the
    smaller row id.
    """
    vectors, hot, copies = hot_copies(vectors, max(2, least_size))
    first = copies.join(F.broadcast(hot.select("class", F.element_at("rowids", 1).alias("first"))), "class")
    counted = F.broadcast(materialize(first.groupBy(*GROUP, F.col("first").alias("rowid")).agg((F.count(F.lit(1)) + 1).alias("copies"))))
    weighted = lambda df: df.join(counted, [*GROUP, "rowid"], "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    axes = vectors.sparkSession.sparkContext.broadcast(model_axes(weighted(vectors)))
    cells = Cells(vectors, cell_rows)
    part = weighted(cells.place(vectors, 1.0).select(*GROUP, "cell", "block", "rowid", "vec"))
    text = ", ".join(f"{g} string" for g in GROUP)

    def fit(key, t):
        t = t.sort_by("rowid")
        x, ids, times = matrix(t["vec"]), t["rowid"].to_numpy(), t["copies"].to_numpy().astype(np.float64)
        low, density, moved, loose = fragments(x, times, axes.value[key[0].as_py(), key[1].as_py()], least_cosine)
        total = np.zeros_like(x)
        np.add.at(total, low, x * times[:, None])
        head = low == np.arange(len(low))
        out = {g: pa.array([key[i].as_py()] * len(low), pa.string()) for i, g in enumerate(GROUP)}
        return pa.table(out | {
            "fit": pa.array([key[3].as_py() << 32 | key[4].as_py()] * len(low), pa.int64()), "rowid": t["rowid"], "vec": t["vec"], "copies": t["copies"], "fragment": pa.array(ids[low], pa.int64()),
            "loose": pa.array(loose), "density": pa.array(density, pa.float64()), "moved": pa.array(moved),
            "total": pa.array([total[i].tolist() if h and with_sums else None for i, h in enumerate(head)], pa.list_(pa.float64())),
        })

    found = materialize(part.groupBy(*GROUP, "cell", "block").applyInArrow(fit, f"{text}, fit long, rowid long, vec array<float>, copies long, fragment long, loose boolean, density double, moved boolean, total array<double>"))
    # each two blocks of a group of several cells meet in one task
    blocks = F.ceil(F.col("group_rows") / block_rows).cast("int")
    cut = found.join(cells.counts.where(F.col("group_rows") > cell_rows), GROUP)
    cut = cut.select(*GROUP, "fit", "vec", "copies", "fragment", "loose", F.pmod(F.xxhash64("fragment"), blocks).cast("int").alias("of"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("to"))
    cut = cut.withColumns({"first": F.least("of", "to"), "second": F.greatest("of", "to")}).drop("to")

    def link(key, t):
        t = t.sort_by("fragment")
        column = lambda c: t[c].to_numpy()
        left, right, left_loose, right_loose, rows, means = close_pairs(matrix(t["vec"]), column("copies").astype(np.float64), column("fragment"), column("loose"), column("fit"), column("of"), key[3].as_py(), key[4].as_py(), least_cosine)
        return pa.table({g: pa.array([key[i].as_py()] * len(left), pa.string()) for i, g in enumerate(GROUP[:2])} | {
            "left": pa.array(left, pa.int64()), "right": pa.array(right, pa.int64()), "left_loose": pa.array(left_loose, pa.bool_()), "right_loose": pa.array(right_loose, pa.bool_()), "rows": pa.array(rows, pa.float64()), "means": pa.array(means, pa.float64()),
        })

    edges = cut.groupBy(*GROUP, "first", "second").applyInArrow(link, f"{GROUP[0]} string, {GROUP[1]} string, left long, right long, left_loose boolean, right_loose boolean, rows double, means double")
    same = joined(edges)
    columns = [*GROUP, "rowid", "density", "moved", "total"]
    members = found.join(same, [*GROUP[:2], "fragment"], "left").select(*columns, F.coalesce("joined", "fragment").alias("part"))
    # the many copies of a vector follow its first one
    lead = F.broadcast(members.join(F.broadcast(hot.select(F.element_at("rowids", 1).alias("rowid"))), "rowid", "left_semi").select(*GROUP, F.col("rowid").alias("first"), "density", "moved", "part"))
    members = members.unionByName(first.join(lead, [*GROUP, "first"]).select(*GROUP, "rowid", "density", "moved", F.lit(None).cast("array<double>").alias("total"), "part"))
    sizes = members.groupBy(*GROUP[:2], "part").agg(F.count(F.lit(1)).alias("size"), F.min("rowid").alias("cluster_rowid")).where(F.col("size") >= least_size)
    return members.join(sizes, [*GROUP[:2], "part"]).select(*GROUP, "rowid", "cluster_rowid", "size", "density", "moved", *["total"] * with_sums)


def email_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(current_vectors(table(spark, folder, "email_embeddings"), "email", "email_rowid"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each email of a cluster of three or more, with the cluster's smallest email_rowid."""
    return clusters(email_vectors(spark, folder)).select("model_id", F.col("rowid").alias("email_rowid"), "cluster_rowid")


def p4_clusters(spark: SparkSession, folder: str, typical: int = 3) -> DataFrame:
    """Each cluster's size, centroid, cohesion (mean cosine to the centroid), members of highest density and members that the check moved.

    The centroid is the direction of the sum of all members' unit vectors.
    """
    members = materialize(clusters(email_vectors(spark, folder), with_sums=True))
    key = [*GROUP, "cluster_rowid"]
    axes = members.where("total is not null").select(*key, F.posexplode("total").alias("axis", "v")).groupBy(*key, "axis").agg(F.sum("v").alias("total"))
    sums = axes.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "total"))), lambda a: a["total"]).alias("total"))
    length = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, v: s + v * v))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("density"), "rowid"))
    sized = members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.count_if("moved").alias("moved"))
    top = members.select(*key, "rowid", "density").withColumn("n", rank).where(F.col("n") <= typical).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "rowid"))), lambda a: a["rowid"]).alias("typical_rowids"))
    # the members' unit vectors sum to a vector of length size x mean cosine to the centroid
    return sized.join(sums, key).join(top, key).select(
        "model_id", "account_id", "cluster_rowid", "size", F.transform("total", lambda v: F.round(v / length, 6)).alias("centroid"), F.round(length / F.col("size"), 6).alias("cohesion"), "typical_rowids", "moved"
    )


QUERIES = {"p4_found": p4_found, "p4_clusters": p4_clusters}
