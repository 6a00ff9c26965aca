"""Problem 7: evaluation passages in a corpus, by latent semantic retrieval."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.p2_near_duplicates import aligned
from skein.llm.wordlists import slices
from skein.runtime import materialize, spread
from skein.sources import table

MARK = re.compile(r"[̀-ͯ­​-‍﻿]")
WORD_OR_END = re.compile(r"[^\W_]+|\x00")


def folded_words(texts: list[str]) -> list[str]:
    """All texts' words without case and accents; after each text a "\\x00"."""
    big = "\x00".join(t.replace("\x00", " ") for t in texts) + "\x00"
    if not big.isascii():
        big = MARK.sub("", unicodedata.normalize("NFKD", big))
    return WORD_OR_END.findall(big.casefold())


class Items:
    """Evaluation items: their vocabulary, passages of `run` words, and all runs for the exact check."""

    def __init__(self, rows: list[tuple[int, str]], run: int = 13, step: int = 4):
        self.run = run
        self.words = {i: w for i, t in rows if (w := folded_words([t or ""])[:-1])}
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for ws in self.words.values() for w in ws}))}
        self.ids = {i: np.array([self.vocabulary[w] for w in ws], np.int32) for i, ws in self.words.items()}
        self.width = np.int16 if len(self.vocabulary) < 1 << 15 else np.int32
        self.shortest = min([run, *(len(w) for w in self.ids.values())])
        self.runs: dict[bytes, list[int]] = {}
        self.passages, self.of = [], []
        for i, w in self.ids.items():
            n = min(run, len(w))
            for a in range(len(w) - n + 1):
                have = self.runs.setdefault(w[a : a + n].tobytes(), [])
                if i not in have:
                    have.append(i)
            for a in sorted({*range(0, len(w) - n + 1, step), len(w) - n}):
                self.passages.append(w[a : a + n])
                self.of.append(i)
        self.lengths = sorted({min(run, len(w)) for w in self.ids.values()})
        # multilinear hashes of the runs of each length: 20 bits as a table, all bits sorted
        self.factors = np.random.default_rng(7).integers(0, 1 << 64, run, np.uint64) | np.uint64(1)
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.lengths:
            every = np.frombuffer(b"".join(k for k in self.runs if len(k) == 4 * n), np.int32).reshape(-1, n)
            h = np.unique((every.astype(np.uint64) * self.factors[:n]).sum(1, dtype=np.uint64))
            table = np.zeros(1 << 20, bool)
            table[h >> np.uint64(44)] = True
            self.hashes[n] = table, h

    def found(self, ids: np.ndarray, lengths: np.ndarray) -> set[tuple[int, int]]:
        """(place of the document, item) of every run in some documents' words, whatever stands around it."""
        x, doc, out = ids.astype(np.uint64), np.repeat(np.arange(len(lengths)), lengths), set()
        h = np.zeros(len(x) + 1, np.uint64)
        for n in range(1, self.lengths[-1] + 1):
            h = h[:-1] + x[n - 1 :] * self.factors[n - 1]
            if n in self.hashes:
                table, known = self.hashes[n]
                at = np.flatnonzero(table[h >> np.uint64(44)])
                at = at[np.isin(h[at], known) & (doc[at] == doc[at + n - 1])]
                for a in at.tolist():
                    out.update((int(doc[a]), i) for i in self.runs.get(ids[a : a + n].tobytes(), ()))
        return out


def coded(documents: DataFrame, items: Items) -> DataFrame:
    """(doc_id, ids): each document's words as numbers of the items' vocabulary, -1 for other words; in 16 bits where they suffice."""
    vocabulary = documents.sparkSession.sparkContext.broadcast(items.vocabulary)

    width = items.width

    def read(batches):
        get = vocabulary.value.get
        for b in slices(batches):
            enc = pa.array(folded_words([t or "" for t in b["text"].to_pylist()]), pa.string()).dictionary_encode()
            names = enc.dictionary.to_pylist()
            number = np.array([get(w, -1) for w in names], width)
            codes = enc.indices.to_numpy()
            ids, end = number[codes], np.flatnonzero(codes == names.index("\x00"))
            start = np.concatenate([[0], end[:-1] + 1])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([ids[s:e].tobytes() for s, e in zip(start, end)], pa.binary())], ["doc_id", "ids"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return spread(rows).mapInArrow(read, "doc_id long, ids binary")


def chunks(batches, width, rows: int = 1_000, words: int = 2_000_000):
    """(doc ids, all words in one array, lengths) of some documents at a time."""
    size = np.dtype(width).itemsize
    for b in batches:
        docs, data = b["doc_id"].to_pylist(), b["ids"].to_pylist()
        i = 0
        while i < len(data):
            j, n = i + 1, len(data[i]) // size
            while j < len(data) and j - i < rows and n + len(data[j]) // size <= words:
                n += len(data[j]) // size
                j += 1
            yield docs[i:j], np.frombuffer(b"".join(data[i:j]), width).astype(np.int32), np.array([len(d) // size for d in data[i:j]], np.int64)
            i = j


def blocks_of(ids: np.ndarray, lengths: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's block (runs of `run` words, none across documents), each document's first block and block count."""
    count = -(-lengths // run)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(len(ids)) - np.repeat(start, lengths)
    return np.repeat(first, lengths) + within // run, first, count


def summed(parts: DataFrame, salts: int = 64) -> DataFrame:
    """(part, data): the sum of equally long arrays of float64 for each part: of some tasks each, then of all."""

    def add(key, t):
        total = np.zeros(0)
        for v in t["data"]:
            v = np.frombuffer(v.as_buffer(), np.float64)
            total = v.copy() if not len(total) else total + v
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    ddl = "part int, data binary"
    some = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("part", "salt").applyInArrow(add, ddl)
    return some.groupBy("part").applyInArrow(add, ddl)


def gathered(docs: DataFrame, size: int, columns: int, fill, part_rows: int = 4_096) -> np.ndarray:
    """The sum over all documents of size x columns numbers that fill(batches, total) adds up in each task.

    A task sends its sum in parts of `part_rows` rows. Many small files are read by few tasks (two a core, one after another), so that
    the sums grow with the cores and not with the files.
    """

    def run(batches):
        total = np.zeros((size, columns))
        fill(batches, total)
        for p in range(0, size, part_rows):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([total[p : p + part_rows].tobytes()], pa.binary())], ["part", "data"])

    few = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    out = np.zeros((size, columns))
    for r in summed(few.mapInArrow(run, "part int, data binary")).toLocalIterator():
        own = np.frombuffer(r["data"], np.float64).reshape(-1, columns)
        out[r["part"] : r["part"] + len(own)] = own
    return out


def frequencies(docs: DataFrame, size: int, run: int, width) -> np.ndarray:
    """Inverse document frequency of each vocabulary word over all blocks of all documents."""

    def fill(batches, total):
        for _, ids, lengths in chunks(batches, width):
            block, _, c = blocks_of(ids, lengths, run)
            total[size] += int(c.sum())
            own = ids >= 0
            total[:size, 0] += np.bincount(np.unique(block[own] * size + ids[own]) % size, minlength=size)

    got = gathered(docs, size + 1, 1, fill)[:, 0]
    return np.log((got[size] + 1) / (got[:size] + 0.5)).astype(np.float32)


def through(docs: DataFrame, idf: np.ndarray, basis: np.ndarray, run: int, width) -> np.ndarray:
    """A'A times `basis`, where A is the TF-IDF matrix of all blocks; each task sums its own rows first."""
    size, k = basis.shape
    sent = docs.sparkSession.sparkContext.broadcast((idf, (basis * idf[:, None]).astype(np.float32)))

    def fill(batches, total):
        rows = sent.value[1]
        for _, ids, lengths in chunks(batches, width):
            block, _, _ = blocks_of(ids, lengths, run)
            own = ids >= 0
            w, b = ids[own], block[own]
            if not len(w):
                continue
            fresh = np.concatenate([[True], b[1:] != b[:-1]])
            y = np.add.reduceat(rows[w], np.flatnonzero(fresh))
            order = np.argsort(w, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], w[order][1:] != w[order][:-1]]))
            total[w[order][first]] += np.add.reduceat(y[(np.cumsum(fresh) - 1)[order]], first)

    return gathered(docs, size, k, fill) * idf[:, None]


def latent_basis(docs: DataFrame, idf: np.ndarray, rank: int, run: int, width, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors of A (words x rank) by a randomised range finder in one pass (Nystroem's approximation of A'A)."""
    k = min(rank, len(idf))
    test, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), k)))
    y = through(docs, idf, test, run, width)
    shift = 1e-6 * max(np.linalg.norm(y), 1e-9)
    y = y + shift * test
    core = test.T @ y
    value, turn = np.linalg.eigh((core + core.T) / 2)
    left, _, _ = np.linalg.svd(y @ (turn / np.sqrt(np.maximum(value, shift))), full_matrices=False)
    return left


def answers(passage: np.ndarray, idf: np.ndarray, numbers: np.ndarray) -> set[int]:
    """What a paraphrase must keep of a passage: its numbers and the rarest third of its words."""
    own = sorted(set(passage.tolist()), key=lambda v: (-idf[v], v))
    return {*own[: max(1, len(own) // 3)], *[v for v in own if numbers[v]]}


def leaks(documents: DataFrame, items: DataFrame, run: int = 13, rank: int = 64, least_cosine: float = 0.4, least_aligned: float = 0.5, least_answers: float = 0.75, block_items: int = 50_000, block_words: int = 400_000) -> DataFrame:
    """(doc_id, item_id, kind, words, share): the items that each document leaks.

    documents (doc_id, text) may be any number; items (item_id, text) are read to the driver in blocks of `block_items`
    and `block_words` different words (100 MB of latent vectors); each block reads the corpus once more. TF-IDF over the items' vocabulary with frequencies of all documents
    is reduced by a distributed randomised SVD; windows of 2 x `run` words, one every `run` words so that each run of
    that many lies in one, are compared with the items' passages by cosine. kind is `verbatim` where the document holds
    `run` consecutive words of the item, or all of a shorter one, which is looked up at every word whatever the cosine;
    else `paraphrase` where in a window of at least `least_cosine` the longest common subsequence holds `least_aligned`
    of a passage's words and the window holds `least_answers` of its answers: its numbers and rarest words. Windows
    without any of the rarest answers, one of which each passage's share of answers must include, are skipped. Null or empty texts and items leak nothing; equal item ids are one item; repeated
    documents give equal rows once.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull()).distinct().orderBy("item_id", "text")
    block, result = [], None
    names: set[str] = set()

    def search(block):
        known = Items(block, run)
        if not known.ids:
            return None
        width = known.width
        docs = materialize(coded(documents, known))
        idf = frequencies(docs, len(known.vocabulary), run, width)
        basis = latent_basis(docs, idf, rank, run, width)
        latent = (basis * idf[:, None]).astype(np.float32)
        q = np.stack([latent[p].sum(0) for p in known.passages])
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        numbers = np.array([w.isdigit() for w in known.vocabulary])
        kept = [answers(p, idf, numbers) for p in known.passages]
        # who holds n of a answers holds one of the a - n + 1 rarest
        asked = np.zeros(len(known.vocabulary) + 1, bool)
        for a in kept:
            asked[sorted(a, key=lambda v: (-idf[v], v))[: len(a) - int(np.ceil(least_answers * len(a) - 1e-9)) + 1]] = True
        sent = documents.sparkSession.sparkContext.broadcast((known, latent, q.astype(np.float32), np.array(known.of), kept, asked))

        def find(batches):
            known, latent, q, of, kept, asked = sent.value
            latent = np.vstack([latent, np.zeros((1, latent.shape[1]), np.float32)])  # -1: no vocabulary word
            lists = [p.tolist() for p in known.passages]
            for names, ids, lengths in chunks(batches, width):
                out = {(names[d], item): ("verbatim", run, 1.0) for d, item in known.found(ids, lengths)}
                b, first, count = blocks_of(ids, lengths, run)
                if len(b):
                    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                    mass = np.add.reduceat(asked[ids].astype(np.int32), starts)
                    doc = np.repeat(np.arange(len(count)), count)
                    follows = np.append(doc[1:] == doc[:-1], False)
                    ask = np.flatnonzero(mass + np.where(follows, np.roll(mass, -1), 0) > 0)
                else:
                    ask = np.zeros(0, np.int64)
                if len(ask):
                    # latent vectors of the blocks that are asked for only
                    wanted = np.union1d(ask, ask[follows[ask]] + 1)
                    place = np.full(len(doc), -1)
                    place[wanted] = np.arange(len(wanted))
                    own = place[b] >= 0
                    w_ids, w_block = ids[own], place[b[own]]
                    half = np.add.reduceat(latent[w_ids], np.flatnonzero(np.concatenate([[True], w_block[1:] != w_block[:-1]])))
                    z = half[place[ask]] + np.where(follows[ask, None], half[place[np.minimum(ask + 1, len(doc) - 1)]], 0)
                    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                    for i in range(0, len(ask), 2_048):
                        hit = z[i : i + 2_048] @ q.T >= least_cosine
                        for r in np.flatnonzero(hit.any(1)):
                            w = ask[i + r]
                            d = int(doc[w])
                            at = int(begin[d] + (w - first[d]) * run)
                            text = ids[at : min(at + 2 * run, begin[d] + lengths[d])].tolist()
                            have = frozenset(text)
                            for p in np.flatnonzero(hit[r]).tolist():
                                key, size = (names[d], int(of[p])), len(known.passages[p])
                                if out.get(key, ("",))[0] == "verbatim" or len(have & kept[p]) < least_answers * len(kept[p]) or sum(v in have for v in lists[p]) < least_aligned * size:
                                    continue
                                n = aligned(lists[p], text, 2 * run)
                                if n >= least_aligned * size and n > out.get(key, ("", 0, 0))[1]:
                                    out[key] = ("paraphrase", n, n / size)
                keys = list(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([out[k][0] for k in keys], pa.string()), pa.array([out[k][1] for k in keys], pa.int64()), pa.array([out[k][2] for k in keys], pa.float64())],
                    ["doc_id", "item_id", "kind", "words", "share"],
                )

        return docs.mapInArrow(find, "doc_id long, item_id long, kind string, words long, share double")

    def close():
        nonlocal block, result, names
        found = search(block) if block else None
        result = found if result is None else result if found is None else result.unionByName(found)
        block, names = [], set()

    for r in rows.toLocalIterator():
        own = set(folded_words([r["text"] or ""]))
        if block and (len(block) >= block_items or len(names | own) > block_words):
            close()
        block.append((r["item_id"], r["text"]))
        names |= own
    close()
    if result is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long, kind string, words long, share double")
    best = F.max(F.struct((F.col("kind") == "verbatim").alias("v"), "words", "share", "kind")).alias("b")
    return result.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.kind", "b.words", "b.share")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item of each document, verbatim or paraphrased."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).withColumn("share", F.round("share", 6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an item, or all of a shorter one."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).where(F.col("kind") == "verbatim").select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which test items leaked: documents with the item verbatim and paraphrased."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).groupBy("item_id").agg(F.count_if(F.col("kind") == "verbatim").alias("verbatim_docs"), F.count_if(F.col("kind") == "paraphrase").alias("paraphrase_docs"))


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_items": p7_items}
