"""Order-dependent clustering of groups of bounded size, by seeded shuffles."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from skein.functions.text import fnv1a32


class SeededRandom:
    """A 32-bit generator (mulberry32) whose sequence depends on the seed only."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def next(self) -> float:
        mul = lambda a, b: (a * b) & 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & 0xFFFFFFFF
        t = self.state
        t = mul(t ^ (t >> 15), t | 1)
        t ^= (t + mul(t ^ (t >> 7), t | 61)) & 0xFFFFFFFF
        return ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296

    def shuffled(self, n: int) -> np.ndarray:
        order = np.arange(n)
        for i in range(n - 1, 0, -1):
            j = int(self.next() * (i + 1))
            order[[i, j]] = order[[j, i]]
        return order


def leaders(x: np.ndarray, seed: int, join: float = 0.75, core: int = 8_000, most: int = 256, least: int = 3) -> np.ndarray:
    """The cluster of each unit vector, -1 outside clusters of `least`.

    In seeded order, a vector joins the first leader with a dot product of at least `join`; else it opens one, as long as
    it is among the first `core` and there are fewer than `most`; else the nearest leader takes it, however far. A leader
    moves with the running mean of its members.
    """
    n, own = len(x), np.full(len(x), -1)
    centre, count = np.zeros((most, x.shape[1])), np.zeros(most, int)
    held = 0
    for step, i in enumerate(SeededRandom(seed).shuffled(n)):
        sim = centre[:held] @ x[i]
        near = np.flatnonzero(sim >= join)
        if len(near):
            c = int(near[0])
        elif step < core and held < most:
            c = held
            held += 1
        else:
            c = int(sim.argmax())
        own[i] = c
        centre[c] = centre[c] * count[c] + x[i]
        count[c] += 1
        centre[c] /= max(np.linalg.norm(centre[c]), 1e-12)
    size = np.bincount(own[own >= 0], minlength=most)
    own[(own >= 0) & (size[np.maximum(own, 0)] < least)] = -1
    return own


def leader_clusters(vectors: DataFrame, group: str, key: str, vector: str = "embedding", join: float = 0.75) -> DataFrame:
    """(group, key, cluster): leader clusters inside each group, numbered by their smallest key; vectors outside clusters are left out.

    A group must fit one task, as the clustering is sequential; rows are taken in the order of their keys before the
    seeded shuffle, null vectors are left out.
    """

    def cluster(pdf):
        pdf = pdf.dropna(subset=["v"]).sort_values("k").drop_duplicates("k")
        if not len(pdf):
            return pd.DataFrame({"g": [], "k": [], "cluster": []}, dtype=object)
        x = np.stack(pdf.v.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        own = leaders(x, fnv1a32(str(pdf.g.iloc[0])), join)
        keep = own >= 0
        first = {c: pdf.k.to_numpy()[own == c].min() for c in set(own[keep].tolist())}
        return pd.DataFrame({"g": pdf.g.to_numpy()[keep], "k": pdf.k.to_numpy()[keep], "cluster": [first[c] for c in own[keep].tolist()]})

    rows = vectors.selectExpr(f"cast({group} as string) as g", f"cast({key} as long) as k", f"{vector} as v")
    return rows.groupBy("g").applyInPandas(cluster, "g string, k long, cluster long").withColumnsRenamed({"g": group, "k": key})


def measures(x: np.ndarray, own: np.ndarray, seed: int, sample: int = 256) -> dict[int, tuple[int, float, float]]:
    """Of each cluster (own >= 0) its size, cohesion and separation, both within [0, 1].

    cohesion: the mean dot product with the cluster's centroid of its members, of a seeded sample where they are more
    than `sample`; separation: 1 less the nearest other centroid's dot product, 1 for a cluster alone.
    """
    names = sorted(set(own[own >= 0].tolist()))
    centre = np.stack([x[own == c].mean(0) for c in names]) if names else np.zeros((0, x.shape[1]))
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    near = centre @ centre.T
    np.fill_diagonal(near, -np.inf)
    out = {}
    for n, c in enumerate(names):
        members = np.flatnonzero(own == c)
        size = len(members)
        if size > sample:
            members = members[SeededRandom(seed + n + 1).shuffled(size)[:sample]]
        apart = 1.0 if len(names) == 1 else 1 - float(near[n].max())
        out[c] = size, min(1.0, max(0.0, float((x[members] @ centre[n]).mean()))), min(1.0, max(0.0, apart))
    return out


def grouped(fn, rows: DataFrame, schema: str) -> DataFrame:
    """fn(group, keys, unit vectors) of each group of rows (g, k, v), its keys in order; null vectors and repeated keys are left out, groups without any give nothing."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf):
        pdf = pdf.dropna(subset=["v"]).sort_values("k").drop_duplicates("k")
        out = []
        if len(pdf):
            x = np.stack(pdf.v.to_numpy()).astype(float)
            out = fn(str(pdf.g.iloc[0]), pdf.k.to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        return pd.DataFrame(out, columns=names) if out else pd.DataFrame({n: [] for n in names}, dtype=object)

    return rows.groupBy("g").applyInPandas(run, schema)


def discovered_clusters(vectors: DataFrame, account: str, model: str, key: str, vector: str = "embedding", join: float = 0.75) -> DataFrame:
    """(account, model, cluster, size, cohesion, separation): the leader clusters of each account and model, seeded by their names; the cluster is its smallest key.

    An account's vectors of one model must fit one task, as the clustering is sequential.
    """

    def run(name, keys, x):
        seed = fnv1a32(name.replace("\n", "|"))
        own = leaders(x, seed, join)
        return [(name, int(keys[own == c].min()), size, round(tight, 6), round(apart, 6)) for c, (size, tight, apart) in measures(x, own, seed).items()]

    rows = vectors.where(f"{account} is not null and {model} is not null").selectExpr(f"concat({account}, '\n', {model}) as g", f"cast({key} as long) as k", f"{vector} as v")
    found = grouped(run, rows, "g string, cluster long, size long, cohesion double, separation double")
    return found.selectExpr(f"substring_index(g, '\n', 1) as {account}", f"substring_index(g, '\n', -1) as {model}", "cluster", "size", "cohesion", "separation")


def split_children(vectors: DataFrame, group: str, key: str, vector: str = "embedding", least_members: int = 12, least: int = 5, most: int = 4, floor: float = 0.55, gain: float = 0.08, gap: float = 0.2, join: float = 0.75) -> DataFrame:
    """(group, part, size, cohesion): the parts that each group should be split into; nothing where it should stay.

    A group of `least_members` splits into its leader clusters of `least` or more that are tighter than the group by
    `gain` and than `floor`, the largest `most`; if there are two or more and any two are `gap` apart. A group must fit one task.
    """

    def run(name, keys, x):
        if len(x) < least_members:
            return []
        mean = x.mean(0) / max(np.linalg.norm(x.mean(0)), 1e-12)
        wanted = max(floor, float((x @ mean).mean()) + gain)
        own = leaders(x, 1337, join)
        found = sorted(((size, tight, c) for c, (size, tight, _) in measures(x, own, 1337).items() if size >= least and tight >= wanted), key=lambda r: (-r[0], r[2]))[:most]
        centres = [x[own == c].mean(0) for *_, c in found]
        centres = [c / max(np.linalg.norm(c), 1e-12) for c in centres]
        apart = [1 - a @ b for i, a in enumerate(centres) for b in centres[:i]]
        if not apart or min(apart) < gap:
            return []
        return [(name, n, size, round(tight, 6)) for n, (size, tight, _) in enumerate(found, 1)]

    rows = vectors.selectExpr(f"cast({group} as string) as g", f"cast({key} as long) as k", f"{vector} as v")
    return grouped(run, rows, "g string, part long, size long, cohesion double").withColumnRenamed("g", group)


def first_fit(x: np.ndarray, threshold: float, most: int = 400) -> np.ndarray:
    """Each vector's cluster: the first whose founding vector has a cosine of at least `threshold`; beyond `most` clusters the nearest."""
    founders, own = [], np.empty(len(x), int)
    for i, v in enumerate(x):
        sim = np.stack(founders) @ v if founders else np.zeros(0)
        near = np.flatnonzero(sim >= threshold)
        if len(near):
            own[i] = near[0]
        elif len(founders) < most:
            own[i] = len(founders)
            founders.append(v)
        else:
            own[i] = int(sim.argmax())
    return own


def sender_clusters(mails: DataFrame, sender: str, key: str, vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(sender, key, cluster): first-fit clusters of each sender's mails in the order of their keys; the cluster is its founder's key."""

    def cluster(pdf):
        pdf = pdf.dropna(subset=["v"]).sort_values("k").drop_duplicates("k")
        if not len(pdf):
            return pd.DataFrame({"g": [], "k": [], "cluster": []}, dtype=object)
        x = np.stack(pdf.v.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        own = first_fit(x, threshold)
        return pd.DataFrame({"g": pdf.g.to_numpy(), "k": pdf.k.to_numpy(), "cluster": [pdf.k.to_numpy()[own == c][0] for c in own.tolist()]})

    rows = mails.selectExpr(f"cast({sender} as string) as g", f"cast({key} as long) as k", f"{vector} as v").where("g is not null")
    return rows.groupBy("g").applyInPandas(cluster, "g string, k long, cluster long").withColumnsRenamed({"g": sender, "k": key})


def running_mean(start: np.ndarray, count: int, vectors: np.ndarray) -> np.ndarray:
    """A unit centroid of `count` members after each vector in turn was averaged in."""
    c = start.astype(float)
    for n, v in enumerate(vectors, count):
        c = (c * n + v) / (n + 1)
        c /= max(np.linalg.norm(c), 1e-12)
    return c


def sub_prototypes(vectors: DataFrame, group: str, key: str, vector: str = "embedding", join: float = 0.75, least: int = 3, cohesion: float = 0.55, most: int = 4, gap: float = 0.2) -> DataFrame:
    """(group, part, size, cohesion): up to `most` leader clusters of each group that are cohesive; none unless two remain and any two are `gap` apart.

    cohesion is the members' mean cosine to the part's centroid; the largest parts come first.
    """

    def split(pdf):
        pdf = pdf.dropna(subset=["v"]).sort_values("k").drop_duplicates("k")
        none = pd.DataFrame({"g": [], "part": [], "size": [], "cohesion": []}, dtype=object)
        if len(pdf) < 2 * least:
            return none
        x = np.stack(pdf.v.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        own = leaders(x, 4242, join, least=least)
        parts = []
        for c in sorted(set(own[own >= 0].tolist()), key=lambda c: (-int((own == c).sum()), c)):
            mean = x[own == c].mean(0)
            mean /= max(np.linalg.norm(mean), 1e-12)
            tight = float((x[own == c] @ mean).mean())
            if tight >= cohesion:
                parts.append((mean, int((own == c).sum()), tight))
        parts = parts[:most]
        apart = [1 - a[0] @ b[0] for i, a in enumerate(parts) for b in parts[:i]]
        if not apart or min(apart) < gap:
            return none
        return pd.DataFrame({"g": str(pdf.g.iloc[0]), "part": range(1, len(parts) + 1), "size": [p[1] for p in parts], "cohesion": [round(p[2], 6) for p in parts]})

    rows = vectors.selectExpr(f"cast({group} as string) as g", f"cast({key} as long) as k", f"{vector} as v")
    return rows.groupBy("g").applyInPandas(split, "g string, part long, size long, cohesion double").withColumnRenamed("g", group)


def running_means(vectors: DataFrame, group: str, key: str, vector: str = "embedding") -> DataFrame:
    """(group, size, axis, v): the running mean of each group's vectors in the order of their keys; null vectors are left out."""

    def fold(pdf):
        pdf = pdf.dropna(subset=["v"]).sort_values("k").drop_duplicates("k")
        if not len(pdf):
            return pd.DataFrame({"g": [], "size": [], "axis": [], "v": []}, dtype=object)
        x = np.stack(pdf.v.to_numpy()).astype(float)
        c = running_mean(np.zeros(x.shape[1]), 0, x)
        return pd.DataFrame({"g": str(pdf.g.iloc[0]), "size": len(x), "axis": range(x.shape[1]), "v": c})

    rows = vectors.selectExpr(f"cast({group} as string) as g", f"cast({key} as long) as k", f"{vector} as v")
    return rows.groupBy("g").applyInPandas(fold, "g string, size long, axis long, v double").withColumnRenamed("g", group)
