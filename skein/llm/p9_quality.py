"""Problem 9: statistics of each text and the tails of their distributions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.wordlists import slices
from skein.runtime import materialize, spread
from skein.sources import table

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\x00")
BULLET = re.compile(r"[ \t]*(?:[-–—•*·▪◦‣+]|\[[ xX✓]?\]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+\S")
CELLS = re.compile(r"\t|[^|]\|[^|]|\S {3,}\S|(?<!-)-{3,}")
CLOSE_CELLS = re.compile(r"[^,\s],[^,\s]|[^;\s];[^;\s]")
LAST_WORD = re.compile(r"[^\W\d_]+$")
HEAD = re.compile(r"[A-Z][A-Za-zÀ-ÿ-]{1,14}\s?: \S")
MARKS = re.compile(r"^[ \t|]*>[ \t>|]*")
MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,400}>|&[a-z]{2,8};")
SENTENCE_END = re.compile(r"[.!?…:;][\"'»”’)\]*_]*[ \t]*(?::-\)|;-\)|!!|\W{1,3})?$")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+|\S{28,}")
BROKEN = re.compile(r"[ÃÂâ][\x80-\xbf€™¤¼©½¿§¶¡-]|�|ï¿½|¤")

STATISTICS = ("words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_ratio", "common_ratio", "list_ratio", "table_ratio", "repeat_ratio", "address_ratio", "broken_ratio", "fragment_ratio", "markup_ratio")


def text_statistics(texts: list[str | None], languages: list[str], common: dict[str, set[str]]) -> tuple[np.ndarray, list[str | None]]:
    """Statistics of each text, one row a text in the order of STATISTICS, and the language whose common words it has most of."""
    clean = [(t or "").replace("\x00", " ").replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    enc = pa.array(WORD.findall("\x00".join(clean) + "\x00"), pa.string()).dictionary_encode()
    names, codes = enc.dictionary.to_pylist(), enc.indices.to_numpy()
    end = np.flatnonzero(codes == names.index("\x00"))
    doc = np.searchsorted(end, np.arange(len(codes)))
    n = np.diff(np.concatenate([[-1], end])) - 1
    low = [w.lower() for w in names]
    own = np.ones(len(codes), bool)
    own[end] = False
    per = lambda values: np.bincount(doc[own], values[codes[own]], len(texts))
    at_least = np.maximum(n, 1)
    shares = np.stack([per(np.array([w in common[g] for w in low], float)) / at_least for g in languages], 1) if languages else np.zeros((len(texts), 1))
    out = np.zeros((len(texts), len(STATISTICS)))
    every = set().union(*common.values()) if common else set()
    out[:, 0], out[:, 1], out[:, 5] = n, per(np.array([len(w) for w in names], float)) / at_least, shares.max(1)
    for i, t in enumerate(clean):
        lines = [x for x in t.split("\n") if x and not x.isspace()]
        if not lines:
            continue
        chars = sum(map(len, lines))
        solid = max(1, sum(not c.isspace() for c in t))
        letters = sum(map(str.isalpha, t))
        digits = sum(map(str.isdigit, t))
        listed = tabled = ended = fragments = 0
        lines = [y for x in lines if (y := MARKS.sub("", x) if ">" in x else x)] or lines  # quoted prose is prose
        starts = [x.lstrip()[:1] for x in lines] + ["A"]
        for j, x in enumerate(lines):
            k = len(x)
            done = SENTENCE_END.search(x) is not None
            ended += done
            if j < 2 and HEAD.match(x):  # a mail's heading is neither prose nor list
                continue
            if BULLET.match(x) and not (k > 90 and done):
                listed += k
            elif len(CELLS.findall(x)) >= max(2, k / 60) or not done and k < 120 and len(CLOSE_CELLS.findall(x)) >= max(2, k / 25):
                tabled += k
            # a short line that neither goes on in the next one nor ends a sentence
            elif not done and k < 60 and not starts[j].islower() and not starts[j + 1].islower() and not ((w := LAST_WORD.search(x)) and w.group().lower() in every):
                fragments += k
        out[i, 2:5] = (solid - letters - digits) / solid, digits / solid, ended / len(lines)
        out[i, 6:13] = listed / chars, tabled / chars, 1 - sum(map(len, set(lines))) / chars, sum(len(m.group()) for m in ADDRESS.finditer(t)) / solid, 2 * len(BROKEN.findall(t)) / solid, fragments / chars, sum(len(m.group()) for m in MARKUP.finditer(t)) / solid if "<" in t or "&" in t else 0
    best = shares.argmax(1)
    return out, [languages[k] if languages and shares[i, k] > 0.08 else None for i, k in enumerate(best)]


def statistics(documents: DataFrame, common_words: DataFrame, most_words: int = 200_000) -> DataFrame:
    """(doc_id, language, *STATISTICS) of each document; whole texts are read.

    The language is that of most common words in the text, else the declared one's first two letters where the word table
    knows it, else "und". Null
    and blank texts have statistics of 0. The word table is read to the driver and refused beyond `most_words` rows.
    """
    rows = common_words.select(F.lower("lang").alias("lang"), F.lower("word").alias("word")).dropna().distinct().limit(most_words + 1).collect()
    if len(rows) > most_words:
        raise ValueError(f"more than {most_words} common words")
    common: dict[str, set[str]] = {}
    for r in rows:
        common.setdefault(r["lang"], set()).add(r["word"])
    languages = sorted(common)
    names = ["doc_id", "language", *STATISTICS]

    def read(batches):
        for b in slices(batches, rows=500):
            values, found = text_statistics(b["text"].to_pylist(), languages, common)
            lang = [f or (d if d in common else "und") for f, d in zip(found, b["declared"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lang, pa.string()), *[pa.array(values[:, k]) for k in range(len(STATISTICS))]], names)

    declared = F.coalesce(F.lower(F.regexp_extract("lang", "([A-Za-z]{2})", 1)), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(declared == "", "und").otherwise(declared).alias("declared"), "text").where(F.col("doc_id").isNotNull())
    return spread(docs).mapInArrow(read, "doc_id long, language string, " + ", ".join(f"{s} double" for s in STATISTICS))


#: What a tail weighs before any label is seen: standard deviations above (or, for common words, below) the language's median.
PRIOR = {
    "high": {"symbol_ratio": 0.6, "digit_ratio": 0.3, "list_ratio": 0.6, "table_ratio": 1.2, "repeat_ratio": 0.6, "address_ratio": 0.6, "broken_ratio": 0.6, "fragment_ratio": 0.6, "markup_ratio": 0.6},
    "low": {"common_ratio": 1.2},
}
PRIOR_BIAS = -4.5
#: The least scale of a statistic: shares that differ by less are the same to a reader.
RESOLUTION = np.array([0.2, 0.2] + [0.05] * 11)
POINTS = np.linspace(0, 1, 101)


def distributions(stats: DataFrame, least_rows: int = 50) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Percentiles (statistics x 101) of the statistics of each language, and of all texts.

    They come from mergeable KLL sketches, built map-side and merged in the shuffle. Blank texts count nowhere; a
    language of fewer than `least_rows` texts has none of its own. At most one row a language of the word table comes to
    the driver.
    """
    blank = F.col("words") == 0
    value = lambda s: F.log1p(s) if s == "words" else F.col(s)
    held = [F.count_if(~blank).alias("rows"), *[F.kll_sketch_agg_double(F.when(~blank, value(s))).alias(s) for s in STATISTICS]]
    points = F.array(*[F.lit(float(p)) for p in POINTS])
    read = [F.kll_sketch_get_quantile_double(s, points).alias(s) for s in STATISTICS]
    table_of = lambda r: np.array([r[s] for s in STATISTICS])
    by = stats.groupBy("language").agg(*held).where((F.col("rows") >= least_rows) & (F.col("language") != "und")).select("language", *read).collect()
    every = stats.groupBy().agg(*held).where(F.col("rows") > 0).select(*read).collect()
    return {r["language"]: table_of(r) for r in by}, table_of(every[0]) if every else np.zeros((len(STATISTICS), len(POINTS)))


def tail_features(values: np.ndarray, languages: list[str], known: dict[str, np.ndarray], every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust z-scores and percentiles of texts x STATISTICS within their languages, and the tails made of them.

    z is the distance from the median by IQR / 1.349 or the resolution. The tails are z above 0 and below 0, up to 10,
    and the percentile above 0.75 and below 0.25, from 0 to 1; the last column is 1.
    """
    x = values.copy()
    x[:, 0] = np.log1p(x[:, 0])
    z, rank = np.zeros_like(x), np.zeros_like(x)
    of = np.array([g if g in known else "" for g in languages], object)
    for g in set(of.tolist()):
        q, own = known.get(g, every), of == g
        scale = np.maximum((q[:, 75] - q[:, 25]) / 1.349, RESOLUTION)
        z[own] = (x[own] - q[:, 50]) / scale
        for k in range(x.shape[1]):
            rank[own, k] = (np.searchsorted(q[k], x[own, k], "left") + np.searchsorted(q[k], x[own, k], "right")) / (2 * len(POINTS))
    return z, rank, np.concatenate([np.clip(z, 0, 10), np.clip(-z, 0, 10), np.maximum(0, rank - 0.75) * 4, np.maximum(0, 0.25 - rank) * 4, np.ones((len(x), 1))], axis=1)


def prior_weights() -> np.ndarray:
    n = len(STATISTICS)
    w = np.zeros(4 * n + 1)
    for at, side in ((0, "high"), (n, "low")):
        for s, v in PRIOR[side].items():
            w[at + STATISTICS.index(s)] = v
    w[-1] = PRIOR_BIAS
    return w


def fit_weights(tails: np.ndarray, other: np.ndarray, strength: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights of the tails for log odds of not being prose: a logistic regression drawn to the prior, in which no tail speaks for prose.

    Projected Newton steps with halving; without labels the prior stays.
    """
    start = prior_weights()
    w, pull = start.copy(), np.append(np.full(len(start) - 1, strength), 1e-2)

    def loss(w):
        m = tails @ w
        return np.logaddexp(0, m).sum() - (other * m).sum() + 0.5 * (pull * (w - start) ** 2).sum()

    now = loss(w)
    for _ in range(rounds if len(other) else 0):
        p = 1 / (1 + np.exp(-np.clip(tails @ w, -30, 30)))
        slope = tails.T @ (p - other) + pull * (w - start)
        free = np.append((w[:-1] > 0) | (slope[:-1] < 0), True)
        a = tails[:, free]
        move = np.zeros(len(w))
        move[free] = -np.linalg.solve((a * (p * (1 - p) + 1e-4)[:, None]).T @ a + np.diag(pull[free]), slope[free])
        step = 1.0
        while step > 1e-6:
            new = w + step * move
            new[:-1] = np.maximum(new[:-1], 0)
            if (then := loss(new)) < now - 1e-9:
                break
            step /= 2
        else:
            break
        w, now = new, then
    return w


def with_tails(stats: DataFrame, labels: DataFrame | None = None, robust_z: float = 3.0, most_labels: int = 20_000) -> DataFrame:
    """stats with each statistic's robust z-score (z_*) and percentile (p_*) within its language, the tails beyond `robust_z`, and the log odds of not being prose.

    labels (doc_id, text_kind) weigh the tails: a sample of at most `most_labels` labelled documents, taken by a hash of
    their ids; documents with labels of both kinds, unknown and blank ones don't count. Without labels the prior weights
    hold. Blank texts have log odds of 100. Empty input gives an empty result.
    """
    known, every = distributions(stats)
    weights = prior_weights()
    if labels is not None:
        other = F.col("text_kind") != "prose"
        one = labels.where(F.col("text_kind").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a = b").select("doc_id", F.col("a").alias("other"))
        sample = one.orderBy(F.xxhash64("doc_id")).limit(most_labels)
        own = stats.where("words > 0").select("doc_id", "language", *STATISTICS).join(F.broadcast(sample), "doc_id").orderBy("doc_id", *STATISTICS).toPandas()
        if len(own):
            weights = fit_weights(tail_features(own[list(STATISTICS)].to_numpy(float), own.language.tolist(), known, every)[2], own.other.to_numpy(float))
    names = [*[f"z_{s}" for s in STATISTICS], *[f"p_{s}" for s in STATISTICS]]

    def score(batches):
        for b in batches:
            values = np.stack([b[s].to_numpy() for s in STATISTICS], 1) if b.num_rows else np.zeros((0, len(STATISTICS)))
            z, rank, tails = tail_features(values, b["language"].to_pylist(), known, every)
            odds = np.where(values[:, 0] == 0, 100.0, np.round(tails @ weights, 6))
            out = [[("high " if v > 0 else "low ") + STATISTICS[k] for k, v in zip(np.flatnonzero(np.abs(r) > robust_z), r[np.abs(r) > robust_z])] if n else [] for r, n in zip(z, values[:, 0])]
            cols = [b[c] for c in b.schema.names] + [pa.array(np.round(x[:, k], 6)) for x in (z, rank) for k in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.string())), pa.array(odds)], [*b.schema.names, *names, "tails", "other_log_odds"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields) + ", " + ", ".join(f"{n} double" for n in names)
    return stats.mapInArrow(score, f"{ddl}, tails array<string>, other_log_odds double")


def quality(spark: SparkSession, folder: str) -> DataFrame:
    return with_tails(materialize(statistics(table(spark, folder, "documents"), table(spark, folder, "common_words"))), table(spark, folder, "doc_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text is not mainly running prose: blank, or more likely not prose by the tails that they lie in."""
    return quality(spark, folder).where(F.col("other_log_odds") > 0).select("doc_id").distinct()


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """All statistics with z-scores, percentiles and tails."""
    return quality(spark, folder)


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics}
