"""Keyword search, rank fusion and keyphrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, length, word, tf): the inverted index of an array of words a row. Rows without words have no postings."""
    held = df.select(F.col(key), words.alias("_words")).where(F.size("_words") > 0)
    return held.select(F.col(key), F.size("_words").alias("length"), F.explode("_words").alias("word")).groupBy(key, "length", "word").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, key: str, documents: Column | int, terms: list[str], average: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): sum over the query's distinct terms; document frequencies are those of the whole index, the idf is at least 1e-6."""
    hits = index.where(F.col("word").isin(terms))
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = F.lit(documents) if isinstance(documents, int) else documents
    idf = F.greatest(F.lit(1e-6), F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(average)))
    return hits.join(F.broadcast(df), "word").groupBy(key).agg(F.sum(part).alias("score"))  # at most one row a term


def bm25_counts(df: DataFrame, length: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """df with `score`, from a column of each text's length in words and one of each term's occurrences: no index and no shuffle of words.

    One pass gathers the number of texts, their mean length and each term's document frequency.
    """
    got = df.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"), *[F.count_if(F.col(t) > 0).alias(t) for t in terms])
    every = df.crossJoin(F.broadcast(got.select(F.col("n").alias("_n"), F.col("mean").alias("_mean"), *[F.col(t).alias(f"_df_{t}") for t in terms])))
    score = F.lit(0.0)
    for t in terms:
        idf = F.greatest(F.lit(1e-6), F.ln((F.col("_n") - F.col(f"_df_{t}") + 0.5) / (F.col(f"_df_{t}") + 0.5)))
        score = score + F.when(F.col(t) > 0, idf * F.col(t) * (k1 + 1) / (F.col(t) + k1 * (1 - b + b * F.col(length) / F.col("_mean")))).otherwise(0.0)
    return every.withColumn("score", score).select(*df.columns, "score")


def updated_index(index: DataFrame, key: str, changed: DataFrame, words: Column) -> DataFrame:
    """postings() after the rows of `changed` took the place of those with the same key; a row without words leaves the index."""
    return index.join(changed.select(key).distinct(), key, "left_anti").unionByName(postings(changed, key, words))


def keyword_search(texts: DataFrame, key: str, words: str, questions: DataFrame, limit: int, scope: Column | None = None, k1: float = 1.2, b: float = 0.75, most_terms: int = 100_000) -> DataFrame:
    """(question, key, score, place): the `limit` texts that match each question best, by BM25 over its distinct terms.

    texts hold an array of words a row, questions (question, terms) an array of terms; all terms together, at most
    `most_terms`, go to every task, so that only their occurrences are counted and shuffled. Document frequencies, number and
    mean length are those of all texts; `scope` narrows the finds afterwards. Ties go to the smaller key.
    """
    asked = questions.select("question", F.explode(F.array_distinct("terms")).alias("word"))
    terms = [r["word"] for r in asked.select("word").distinct().limit(most_terms + 1).collect()]
    if len(terms) > most_terms:
        raise ValueError(f"more than {most_terms} terms")
    rows = texts.withColumn("_length", F.size(words)).where(F.col("_length") > 0)
    whole = rows.agg(F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_mean"))
    kept = rows if scope is None else rows.withColumn("_in", scope)
    kept = kept.select(key, "_length", (F.lit(True) if scope is None else F.col("_in")).alias("_in"), F.explode(F.filter(words, lambda w: w.isin(terms) if terms else F.lit(False))).alias("word"))
    tf = kept.groupBy(key, "_length", "_in", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    hits = tf.where("_in").join(F.broadcast(df), "word").join(F.broadcast(asked), "word").crossJoin(F.broadcast(whole))
    idf = F.greatest(F.lit(1e-6), F.ln((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_length") / F.col("_mean")))
    scored = hits.groupBy("question", key).agg(F.round(F.sum(part), 6).alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), key))
    return scored.withColumn("place", place).where(F.col("place") <= limit)


def fused(arms: list[DataFrame], key: str, limit: int, k: int = 60) -> DataFrame:
    """(question, key, score, place): rank_fusion for each question of ranked lists (question, key, place), places from 1."""
    every = None
    for a, arm in enumerate(arms):
        part = arm.select("question", key, (F.col("place") - 1).alias("place"), F.lit(a).alias("arm"))
        every = part if every is None else every.unionByName(part)
    g = every.groupBy("question", key).agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("score"), F.min(F.struct("arm", "place")).alias("_s"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "_s"))
    return g.withColumn("place", place).where(F.col("place") <= limit).select("question", key, "score", "place")


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in `order`, with their 0-based place."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)


def rank_fusion(arms: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score, arm, place) of rows that come in ranked lists (key, place): the sum of 1 / (k + place); first seen breaks ties."""
    every = None
    for a, arm in enumerate(arms):
        part = arm.select(key, "place", F.lit(a).alias("arm"))
        every = part if every is None else every.unionByName(part)
    seen = F.min(F.struct("arm", "place"))
    return every.groupBy(key).agg(F.sum(1.0 / (k + F.col("place"))).alias("score"), seen.alias("_s")).select(key, "score", F.col("_s.arm").alias("arm"), F.col("_s.place").alias("place"))


def class_keyphrases(words: DataFrame, group: str, top: int = 8) -> DataFrame:
    """(group, word, tf, score, place): a group's words by tf x (1 + ln(groups / groups with the word)); words (group, word) once an occurrence."""
    tf = words.groupBy(group, "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct(group).alias("n"))
    scored = tf.join(df, "word").crossJoin(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * (1 + F.ln(F.col("n") / F.col("df"))), 6))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "word"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select(group, "word", "tf", "score", "place")
