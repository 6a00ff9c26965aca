"""Problem 8: a mix of sources at target shares of all tokens."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.wordlists import mixed, slices
from skein.runtime import materialize, spread
from skein.sources import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenising pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer of a .tiktoken file, loaded once a process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encodings[path] = tiktoken.Encoding("skein", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents that have a source and a text that isn't blank; source trimmed, in lower case."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    rows = rows.where(F.col("doc_id").isNotNull() & (F.length("source") > 0) & F.col("text").rlike(r"\S"))

    def count(batches):
        enc = encoding(tokenizer)
        for b in slices(batches):
            n = [len(t) for t in enc.encode_ordinary_batch(b["text"].to_pylist(), num_threads=1)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return spread(rows).mapInArrow(count, "doc_id long, source string, tokens long")


def packed_blocks(counts: DataFrame, block: int, seed: int, bucket_rows: int = 20_000) -> DataFrame:
    """(source, block, doc_id, first_token, tokens): each source's documents in pseudorandom order, packed into blocks of `block` tokens.

    The running sum is taken inside buckets of about bucket_rows documents and over the buckets' totals, so that a
    source with a third of all documents still spreads over many tasks.
    """
    sizes = counts.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).alias("buckets"))
    placed = counts.join(sizes, "source").withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), "buckets"))
    total = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = total.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id")) - F.col("tokens")
    start = placed.withColumn("within", within).join(before, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("within"))
    each = start.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("tokens") - 1) / block))))
    first = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    return each.select("source", "block", "doc_id", first.alias("first_token"), (F.least("tokens", (F.col("block") + 1) * block - F.col("start")) - first).alias("tokens"))


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at i: a Feistel network on the next power of four, walked until inside."""
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    mask, out, todo = np.uint64((1 << half) - 1), i.astype(np.uint64), np.ones(len(i), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            left, right = right, left ^ (mixed(right + mixed(np.array([(key * 4 + r) % (1 << 63)], np.uint64))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= n
    return out.astype(np.int64)


def plan(sources: pd.DataFrame, targets: pd.DataFrame, block: int, total_blocks: int | None) -> pd.DataFrame:
    """Quota of blocks a source: its share of the largest mix in which no source exceeds its repeats, or of total_blocks, cut at the repeats."""
    t = targets.dropna(subset=["source"]).assign(source=lambda d: d.source.str.strip().str.lower(), target_share=lambda d: d.target_share.astype(float).fillna(0).clip(lower=0))
    t = t.groupby("source", as_index=False).agg(target_share=("target_share", "sum"), max_repeats=("max_repeats", "min"))
    t["max_repeats"] = t.max_repeats.fillna(1).clip(lower=0).astype("int64")
    p = t.merge(sources, "left", "source").fillna({"tokens": 0})
    p["blocks"] = (-(-p.tokens // block)).astype("int64")
    cap = p.blocks * p.max_repeats
    have = (cap > 0) & (p.target_share > 0)
    share = np.where(have, p.target_share, 0.0)
    share = share / share.sum() if share.sum() else share
    most = int(np.floor((cap[have] / share[have]).min() + 1e-9)) if have.any() else 0
    wanted = share * (most if total_blocks is None else total_blocks)
    quota = np.floor(wanted + 1e-9).astype(np.int64)
    order = np.argsort(-(wanted - quota), kind="stable")
    quota[order[: max(0, int(round(wanted.sum())) - int(quota.sum()))]] += 1
    p["quota"] = np.minimum(quota, cap)
    return p.sort_values("source").reset_index(drop=True)


def mix(documents: DataFrame, targets: DataFrame, block: int = 256, shard_blocks: int = 64, seed: int = 11, total_blocks: int | None = None, group_shards: int = 64, tokenizer: str = TOKENIZER, most_sources: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, source, copy, block, doc_id, first_token, tokens) and its shares.

    Each slot of a shard holds one block of a source, given as the documents' token ranges that fill it. The counts of
    sources a shard are multinomial, drawn under the condition that the totals are the quotas (a multivariate
    hypergeometric draw: on the driver for up to 4,096 stretches of shards, by tasks for groups of `group_shards` shards
    in each, then for the shards of a group), so that the shares hold but for rounding. The n-th draw of a source is block permutation(n mod its blocks) of copy n div its
    blocks. Sources without documents, or with a target of 0, get nothing and the others their share of the rest;
    documents of sources without a target stay out; null or blank texts hold no tokens; targets named twice are summed
    and take the smaller cap, a null cap is 1. A table of more than `most_sources` targets is refused.
    """
    spark = documents.sparkSession
    wanted = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).limit(most_sources + 1).toPandas()
    if len(wanted) > most_sources:
        raise ValueError(f"more than {most_sources} targets")
    names = targets.select(F.lower(F.trim("source")).alias("source")).distinct()
    counts = materialize(token_counts(documents.join(F.broadcast(names.withColumnRenamed("source", "named")), F.lower(F.trim("source")) == F.col("named"), "left_semi"), tokenizer))
    held = counts.groupBy("source").agg(F.sum("tokens").alias("tokens")).toPandas()  # at most one row a target
    p = plan(held, wanted, block, total_blocks)
    quota, blocks, source = p.quota.to_numpy(), p.blocks.to_numpy(), p.source.tolist()
    shards = -(-int(quota.sum()) // shard_blocks)
    # each level parts a stretch of shards: (its random stream, first shard, end, blocks of each source, number of the first block)
    def parted(stretch, low, high, take, start, pieces):
        rng, left, at = np.random.default_rng([seed, *stretch]), np.array(take, np.int64), np.array(start, np.int64)
        edges = np.linspace(low, high, pieces + 1).astype(np.int64)
        for g in range(pieces):
            size = min(int((edges[g + 1] - edges[g]) * shard_blocks), int(left.sum()))
            own = rng.multivariate_hypergeometric(left, size, method="marginals") if size else np.zeros_like(left)
            yield [*stretch, g], int(edges[g]), int(edges[g + 1]), own.tolist(), at.tolist()
            left, at = left - own, at + own

    rows = list(parted([0], 0, shards, quota, np.zeros(len(quota), np.int64), min(4_096, max(1, -(-shards // group_shards)))))

    def groups_of(parts):
        for t in parts:
            for r in t.itertuples(index=False):
                pieces = max(1, -(-(r.high - r.low) // group_shards))
                yield pd.DataFrame(list(parted([int(v) for v in r.g], r.low, r.high, r.take, r.start, pieces)), columns=["g", "low", "high", "take", "start"])

    def draw(parts):
        for t in parts:
            for r in t.itertuples(index=False):
                rng, own, at = np.random.default_rng([seed, *[int(v) for v in r.g]]), np.array(r.take, np.int64), np.array(r.start, np.int64)
                for shard in range(r.low, r.high):
                    size = min(shard_blocks, int(own.sum()))
                    n = rng.multivariate_hypergeometric(own, size, method="marginals") if size else np.zeros_like(own)
                    who = rng.permutation(np.repeat(np.arange(len(n)), n))
                    number = np.empty(len(who), np.int64)
                    for s in np.flatnonzero(n):
                        number[who == s] = at[s] + np.arange(n[s])
                    copy = number // np.maximum(blocks[who], 1)
                    chosen = np.empty(len(who), np.int64)
                    for s in np.flatnonzero(n):
                        for c in np.unique(copy[who == s]):
                            k = (who == s) & (copy == c)
                            chosen[k] = permuted(number[k] % blocks[s], int(blocks[s]), seed + 1_000_003 * int(s) + int(c))
                    own, at = own - n, at + n
                    yield pd.DataFrame({"shard": shard, "slot": np.arange(len(who)), "source": [source[s] for s in who], "copy": copy, "block": chosen})

    ddl = "g array<long>, low long, high long, take array<long>, start array<long>"
    groups = spark.createDataFrame(rows, ddl).repartition(max(1, min(len(rows), 2 * spark.sparkContext.defaultParallelism))).mapInPandas(groups_of, ddl)
    if shards > 4_096 * group_shards:
        groups = groups.repartition(2 * spark.sparkContext.defaultParallelism, "low")
    slots = groups.mapInPandas(draw, "shard long, slot long, source string, copy long, block long")
    mixed_rows = slots.join(packed_blocks(counts, block, seed), ["source", "block"]).select("shard", "slot", "source", "copy", "block", "doc_id", "first_token", "tokens")
    plan_rows = spark.createDataFrame(p[["source", "target_share", "max_repeats", "tokens", "quota"]].astype({"tokens": "int64", "target_share": "float64"}), "source string, target_share double, max_repeats long, source_tokens long, quota long")
    got = mixed_rows.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), (F.max("copy") + 1).alias("repeats"))
    all_tokens = got.agg(F.sum("mix_tokens").alias("all_tokens"))
    shares = plan_rows.join(got, "source", "left").crossJoin(F.broadcast(all_tokens)).select(
        "source", "target_share", "max_repeats", "source_tokens", F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"), F.coalesce("repeats", F.lit(0)).alias("repeats"),
        F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
    )
    return mixed_rows, shares


def mix_tokens(mixed_rows: DataFrame, documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The mix's token ids: (shard, slot, doc_id, first_token, ids) of each range; repeated documents count once.

    The ranges of a document meet its text in one row (as many as its tokens fill blocks, times its copies), so that it is encoded once.
    """
    ranges = mixed_rows.groupBy("doc_id").agg(F.collect_list(F.struct("shard", "slot", "first_token", "tokens")).alias("ranges"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").dropDuplicates(["doc_id"])

    def encode(batches):
        enc = encoding(tokenizer)
        for b in slices(batches):
            out = []
            for doc, text, own in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["ranges"].to_pylist()):
                ids = enc.encode_ordinary(text)
                out += [(r["shard"], r["slot"], doc, r["first_token"], ids[r["first_token"] : r["first_token"] + r["tokens"]]) for r in own]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.list_(pa.int32()))], ["shard", "slot", "doc_id", "first_token", "ids"])

    return texts.join(ranges, "doc_id").select("doc_id", "text", "ranges").mapInArrow(encode, "shard long, slot long, doc_id long, first_token long, ids array<int>")


def p8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of the largest mix, one row a range."""
    documents = table(spark, folder, "documents")
    return mix_tokens(mix(documents, table(spark, folder, "mix_targets"))[0], documents)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mix that holds the target shares, as blocks' token ranges."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of each source."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1].withColumn("share", F.round("share", 6))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_tokens": p8_tokens}
