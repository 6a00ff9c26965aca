"""Problem 2: near-duplicate records by Order MinHash, verified by banded alignment."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.wordlists import mixed, plain, slices, word_numbers
from skein.operators.components import connected_components
from skein.runtime import materialize, spread
from skein.sources import table

#: Entries of the table of word frequencies that every task gets: 4 MB whatever the collection's size.
BUCKETS = 1 << 20
#: By how much a k-mer may outweigh the one at four fifths of its text's weights.
HEAVIER = 3.0


def packed(words: np.ndarray) -> bytes:
    """Word numbers as three bytes each."""
    return words.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 3).astype(np.uint32)
    return raw[:, 0] | (raw[:, 1] << 8) | (raw[:, 2] << 16), np.array([len(d) // 3 for d in data], np.int64)


def worded(df: DataFrame, key: str, text_columns: list[str], min_words: int) -> DataFrame:
    """(rowid, copies, words): rows of at least min_words words in their text columns together, without markup.

    `copies` is equal for rows with the same words and counts, whatever the order. Null texts count as empty, null keys
    are dropped, repeated rows stay repeated.
    """
    rows = df.select(F.col(key).cast("long").alias("rowid"), F.concat_ws("\n", *text_columns).alias("text")).where(F.col("rowid").isNotNull())

    def read(batches):
        for b in slices(batches):
            words, counts = word_numbers([plain(t or "") for t in b["text"].to_pylist()])
            words &= np.uint32(0xFFFFFF)
            at = np.concatenate([[0], np.cumsum(counts)])
            take = [i for i in range(len(counts)) if counts[i] >= min_words]
            own = [words[at[i] : at[i + 1]] for i in take]
            copies = np.array([xxhash.xxh64_intdigest(np.sort(w).tobytes()) for w in own], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b["rowid"].take(pa.array(take, pa.int64())), pa.array(copies, pa.int64()), pa.array([packed(w) for w in own], pa.binary())], ["rowid", "copies", "words"])

    return spread(rows).mapInArrow(read, "rowid long, copies long, words binary")


def word_weights(words: DataFrame, power: float = 2.5) -> np.ndarray:
    """Inverse document frequency of each bucket of words, over all rows, to `power`; 0 for words of a single text, which none can share."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        n = 0
        for b in batches:
            for i in range(0, b.num_rows, 2_000):
                ids, counts = unpacked(b["words"].slice(i, 2_000).to_pylist())
                doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
                each = np.unique((doc << 20) | (ids & np.uint32(BUCKETS - 1)).astype(np.int64))
                total += np.bincount(each & (BUCKETS - 1), minlength=BUCKETS)
                n += len(counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["bucket", "n"])

    got = words.select("words").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    own = got[got.bucket >= 0]
    df[own.bucket.to_numpy()] = own.n.to_numpy()
    rows = float(got.n[got.bucket < 0].sum())
    return np.where(df > 1, np.log((rows + 1) / (df + 0.5)) ** power, 0).astype(np.float32)


def sketches(ids: np.ndarray, counts: np.ndarray, weights: np.ndarray, number: int, k: int) -> np.ndarray:
    """Order MinHash keys, texts x number: of each sketch the two least occurrence-labelled k-mers in their text order.

    A k-mer's chance to be least is in proportion to its rarest word's weight.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    h = mixed(ids.astype(np.uint64) + np.uint64(1))
    w = weights[ids & np.uint32(len(weights) - 1)]
    mer, weight = h[: len(h) - k + 1].copy(), w[: len(h) - k + 1].copy()
    shared = weight > 0
    for j in range(1, k):
        mer = mixed(mer * np.uint64(3) + h[j : len(h) - k + 1 + j])
        weight = np.maximum(weight, w[j : len(h) - k + 1 + j])
        shared &= w[j : len(h) - k + 1 + j] > 0
    weight[~shared] = 0
    whole = doc[: len(mer)] == doc[k - 1 :]
    mer, weight, doc = mer[whole], weight[whole], doc[: len(whole)][whole]
    # no k-mer outweighs the heavier ones of its text by far: where a third of all texts are variants of one, only the edits have rare words
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(starts, len(doc)))
    rank = np.lexsort((weight, doc))
    most = HEAVIER * weight[rank][starts + (0.8 * (length - 1)).astype(int)]
    weight = np.where(weight > 0, np.minimum(weight, np.maximum(np.repeat(most, length), 1e-3)), 0)
    # label: the how-manieth of its kind in the text
    own = mixed(mer ^ mixed(doc.astype(np.uint64) + np.uint64(77)))
    order = np.argsort(own, kind="stable")
    run = np.concatenate([[True], own[order][1:] != own[order][:-1]])
    start = np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))
    nth = np.empty(len(own), np.uint64)
    nth[order] = (np.arange(len(run)) - start).astype(np.uint64)
    label = mixed(mer + nth * np.uint64(0x9E3779B97F4A7C15))
    inverse = 1 / np.maximum(weight, 1e-3)
    out = np.empty((len(starts), number), np.int64)
    for s in range(number):
        u = ((mixed(label ^ mixed(np.array([s + 1], np.uint64))) >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)
        v = -np.log(u) * inverse
        first = np.minimum.reduceat(v, starts)
        hit = v == np.repeat(first, length)
        a = np.maximum.reduceat(np.where(hit, np.arange(len(v)), -1), starts)
        v[a] = np.inf
        second = np.minimum.reduceat(v, starts)
        b = np.maximum.reduceat(np.where(v == np.repeat(second, length), np.arange(len(v)), -1), starts)
        low, high = label[np.minimum(a, b)], label[np.maximum(a, b)]
        out[:, s] = mixed(low * np.uint64(3) + high + mixed(np.array([s + 101], np.uint64))).astype(np.int64)
    return out


def aligned(a: list[int], b: list[int], band: int) -> int:
    """Words matched by the best alignment of two texts that shifts no word by more than `band` places."""
    at: dict[int, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    v = full = (1 << len(a)) - 1
    width = (1 << (2 * band + 1)) - 1
    for j, w in enumerate(b):
        m = at.get(w)
        if m:
            u = v & m & ((width << (j - band)) if j > band else (width >> (band - j)))
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def similarity(a: list[int], b: list[int], least: float) -> float:
    """Shared over all words, counted with repeats; a lower bound of it where the alignment alone reaches `least`."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    n = aligned(a, b, max(8, int((1 - least) * max(len(a), len(b)))))
    s = n / (len(a) + len(b) - n)
    if s >= least:
        return s
    x, y = Counter(a), Counter(b)
    n = sum((x & y).values())
    return n / (len(a) + len(b) - n)


def shared_at_most(a: list[bytes], b: list[bytes], buckets: int = 2_048) -> np.ndarray:
    """Of each pair of texts an upper bound of shared over all words, counted by buckets of words, many pairs at once."""
    (x, nx), (y, ny) = unpacked(a), unpacked(b)
    pair = np.arange(len(a), dtype=np.int64) * buckets
    hist = [np.bincount(np.repeat(pair, n) + (w & np.uint32(buckets - 1)), minlength=len(a) * buckets) for w, n in ((x, nx), (y, ny))]
    inter = np.minimum(*hist).reshape(len(a), buckets).sum(1)
    return inter / np.maximum(nx + ny - inter, 1)


def near_duplicates(rows: DataFrame, least: float = 0.7, number: int = 32, k: int = 2, hits: int = 2, every_link: bool = True) -> tuple[DataFrame, DataFrame]:
    """Links between different texts, and the membership of rows in groups of equal words.

    rows: see worded(). Result: links (left, right, similarity) between representatives - the smallest rowid of each set
    of rows with equal words - that share at least `least` of their words, and members (rowid, representative). Copies
    are one text before candidates are sought. A sketch holds two k-mers; texts of fitting lengths that share `hits` of
    `number` sketches are candidates, whatever the number of texts that share them; an alignment within a band accepts, and where moved
    passages defeat it, the exact share of words decides. Without every_link the links are fewer but connect the same texts: texts that
    share a sketch are compared with the smallest of them, and only those that are no link of it with all others, so
    that a mailing of many variants costs its number and not its square. Empty input gives empty results.
    """
    words = materialize(rows)
    members = words.groupBy("copies").agg(F.min("rowid").alias("representative"))
    weights = words.sparkSession.sparkContext.broadcast(word_weights(words.groupBy("copies").agg(F.min_by("words", "rowid").alias("words"))))

    def sketch(batches):
        seen: set[int] = set()  # a task sends each text's sketches once; more than so many texts are forgotten, and told apart after the shuffle
        for b in batches:
            for i in range(0, b.num_rows, 1_000):
                part = b.slice(i, 1_000)
                data, fresh = part["words"].to_pylist(), []
                for j, w in enumerate(data):
                    h = xxhash.xxh64_intdigest(w)
                    if h not in seen:
                        seen.add(h)
                        fresh.append(j)
                if len(seen) > 1_000_000:
                    seen.clear()
                if not fresh:
                    continue
                ids, counts = unpacked([data[j] for j in fresh])
                keys = sketches(ids, counts, weights.value, number, k)
                yield pa.RecordBatch.from_arrays([part["copies"].take(pa.array(fresh)), pa.array(counts.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), number).cast(pa.list_(pa.int64()))], ["copies", "size", "keys"])

    keyed = words.where(F.octet_length("words") >= 3 * (k + 1)).select("copies", "words").mapInArrow(sketch, "copies long, size int, keys array<long>")
    # equal texts have equal words but maybe another order, so each order's sketches stay
    # one shuffle, by sketch, serves the removal of repeats and the join
    bands = keyed.select(F.explode("keys").alias("key"), "copies", "size").repartition("key").distinct()
    text = words.groupBy("copies").agg(F.min_by("words", "rowid").alias("words"))
    side = lambda df, c, n: df.select("key", F.col("copies").alias(c), F.col("size").alias(n))

    def candidates(asking, held):
        """(left, right) of texts of fitting lengths that share `hits` sketches, one of `asking` and one of `held`."""
        fits = (F.col("left") != F.col("right")) & (F.col("m") >= least * F.col("n")) & (F.col("n") >= least * F.col("m"))
        met = side(asking, "left", "m").join(side(held, "right", "n"), "key").where(fits)
        if every_link:
            met = met.where(F.col("left") < F.col("right"))
        else:
            met = met.select("key", F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).distinct()
        return met.groupBy("left", "right").agg(F.count(F.lit(1)).alias("hits"))

    def verify(batches):
        for b in batches:
            s = np.zeros(b.num_rows)
            for i in range(0, b.num_rows, 500):
                x, y = b["a"].slice(i, 500).to_pylist(), b["b"].slice(i, 500).to_pylist()
                for j in np.flatnonzero(shared_at_most(x, y) >= least):
                    s[i + j] = similarity(unpacked([x[j]])[0].tolist(), unpacked([y[j]])[0].tolist(), least)
            yield pa.RecordBatch.from_arrays([b["left"], b["right"], pa.array(s, pa.float64())], ["left", "right", "similarity"])

    def verified(pairs):
        both = pairs.join(text.select(F.col("copies").alias("left"), F.col("words").alias("a")), "left").join(text.select(F.col("copies").alias("right"), F.col("words").alias("b")), "right")
        return both.select("left", "right", "a", "b").mapInArrow(verify, "left long, right long, similarity double").where(F.col("similarity") >= least)

    if every_link:
        links = verified(candidates(bands, bands).where(F.col("hits") >= hits).select("left", "right"))
    else:
        bands = materialize(bands)
        hubs = bands.groupBy("key").agg(F.min(F.struct("copies", "size")).alias("hub")).select("key", "hub.copies", "hub.size")
        links = materialize(verified(candidates(bands, hubs).where(F.col("hits") >= hits).select("left", "right")))
        tied = links.select(F.col("left").alias("hub"), F.col("right").alias("copies"))
        loose = bands.join(hubs.select("key", F.col("copies").alias("hub")), "key").where("copies <> hub").join(tied, ["hub", "copies"], "left_anti").select("key", "copies", "size")
        more = candidates(loose, bands).where(F.col("hits") >= hits).select("left", "right").join(links, ["left", "right"], "left_anti")
        links = links.unionByName(verified(more))
    rep = lambda c: members.select(F.col("copies").alias(c), F.col("representative").alias(f"{c}_rep"))
    links = links.join(rep("left"), "left").join(rep("right"), "right").select(
        F.least("left_rep", "right_rep").alias("left"), F.greatest("left_rep", "right_rep").alias("right"), "similarity"
    )
    return materialize(links), words.select("rowid", "copies").distinct().join(members, "copies").select("rowid", "representative")


def emails_worded(spark: SparkSession, folder: str) -> DataFrame:
    return worded(table(spark, folder, "emails"), "email_rowid", ["subject", "body"], 40)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of emails that share at least 70 % of their words; equal copies are pairs too."""
    links, members = near_duplicates(emails_worded(spark, folder))
    members = materialize(members)
    l, r = members.select(F.col("rowid").alias("l"), F.col("representative").alias("left")), members.select(F.col("rowid").alias("r"), F.col("representative").alias("right"))
    between = links.join(l, "left").join(r, "right").select("l", "r")
    within = l.join(r, F.col("left") == F.col("right")).where(F.col("l") < F.col("r")).select("l", "r")
    return between.unionByName(within).select(F.least("l", "r").alias("left_rowid"), F.greatest("l", "r").alias("right_rowid")).distinct()


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each email of 40 words or more with its group: the smallest email_rowid reachable over links and equal texts."""
    links, members = near_duplicates(emails_worded(spark, folder), every_link=False)
    group = connected_components(links).withColumnRenamed("node", "representative")
    return members.join(group, "representative", "left").select(F.col("rowid").alias("email_rowid"), F.coalesce("component", "representative").alias("group_rowid"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
