"""Retrieval over mails and attachments: keyword and vector arms, fusion, time scopes, passages of attachments; and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import timescope
from skein.operators import search
from skein.plans.mail import EMAILS_SQL, HOT, chunk_knn, emails, recency
from skein.sources import table

#: Questions that the registered queries ask, and the moment from which their time ranges are seen.
QUESTIONS = ("projector boiler catalogue", "Rechnung für den Garten", "le rapport de la réunion", "factura de la biblioteca", "seating plan invoice", "wedding of the astronaut", "Élodie Vashard", "guest list")
NOW = datetime(2025, 6, 18, 14, 30)
SCOPED = ("mails of the last 3 days", "les 2 dernières semaines", "in may 2024", "invoices from yesterday", "last week", "ce mois", "anything recent", "since 2023", "order 2023", "rapport de mars 2025", "cette année", "last month")


def questions(spark) -> DataFrame:
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "question int, text string")
    return q.select("question", F.slice(F.array_distinct(T.index_words(F.col("text"))), 1, 16).alias("terms"))


def indexed(spark, folder, *columns: str) -> DataFrame:
    """Mails with the index words of subject, sender and body."""
    return emails(spark, folder, *columns, words=T.index_words(F.concat_ws(" ", "subject", "from_addr", "body")))


def chunk_words(spark, folder) -> DataFrame:
    c = table(spark, folder, "attachment_chunks").where("chunk_rowid is not null").groupBy("chunk_rowid").agg(F.max(F.struct("attachment_id", "account_id", "chunk_index", "text")).alias("r"))
    return c.select("chunk_rowid", "r.*").withColumn("words", T.index_words(F.col("text")))


def email_keyword_search(spark, folder):
    """The 30 mails of the largest account that match each question best, frequencies taken over all accounts."""
    found = search.keyword_search(indexed(spark, folder, "account_id"), "email_rowid", "words", questions(spark), 30, F.col("account_id").startswith(HOT))
    return found.select("question", "email_rowid", "score", "place")


def chunk_keyword_search(spark, folder):
    """The 8 passages of attachments that match each question best."""
    return search.keyword_search(chunk_words(spark, folder), "chunk_rowid", "words", questions(spark), 8).select("question", "chunk_rowid", "score", "place")


def index_terms(spark, folder):
    """The index of all subjects: each word's mails and occurrences."""
    return search.postings(emails(spark, folder, words=T.index_words(F.col("subject"))), "email_rowid", F.col("words")).groupBy("word").agg(F.count(F.lit(1)).alias("mails"), F.sum("tf").alias("occurrences"))


def index_after_update(spark, folder):
    """The subjects' index after every third mail got the subject "moved boiler" and every seventh lost its own: each word's mails."""
    df = emails(spark, folder, "subject")
    index = search.postings(df, "email_rowid", T.index_words(F.col("subject")))
    changed = df.where("email_rowid % 3 = 0 or email_rowid % 7 = 0").withColumn("subject", F.when(F.col("email_rowid") % 3 == 0, "moved boiler"))
    return search.updated_index(index, "email_rowid", changed, T.index_words(F.col("subject"))).groupBy("word").agg(F.count(F.lit(1)).alias("mails"))


def hybrid_search(spark, folder):
    """Two arms for each question - keywords, and the newest mails that hold all its terms - fused, the best 10."""
    e = indexed(spark, folder, "date_ms", "indexed_at")
    words = search.keyword_search(e, "email_rowid", "words", questions(spark), 30)
    q = F.broadcast(questions(spark).where(F.size("terms") > 0))
    whole = e.join(q, F.size(F.array_except("terms", "words")) == 0).select("question", "email_rowid", recency().alias("at"))
    newest = whole.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc_nulls_last("at"), "email_rowid"))).where("place <= 30")
    return search.fused([words, newest], "email_rowid", 10)


def attachment_arm(spark, folder):
    """Passages for each logged query: 12 by vector with a cosine of 0.45 or more, 12 by the words of its nearest passage, fused, the best 5."""
    near = chunk_knn(spark, folder, 12).where(1 - F.col("distance") * F.col("distance") / 2 >= 0.45)
    c = chunk_words(spark, folder).select("chunk_rowid", "words")
    first = near.where("place = 1").join(c, "chunk_rowid").select(F.col("query_id").alias("question"), F.slice(F.array_distinct(F.filter("words", lambda w: F.length(w) >= 6)), 1, 4).alias("terms"))
    words = search.keyword_search(c, "chunk_rowid", "words", first, 12).select("question", "chunk_rowid", "place")
    return search.fused([near.select(F.col("query_id").alias("question"), "chunk_rowid", "place"), words], "chunk_rowid", 5)


def expanded_attachments(spark, folder):
    """Of each mail with attachments the 3 passages, of its first 120, that hold most of its subject's words of four letters or more; equal texts once."""
    e = emails(spark, folder, "message_id", "account_id", "subject").select("email_rowid", "message_id", "account_id", F.array_distinct(F.filter(T.index_words(F.col("subject")), lambda w: F.length(w) >= 4)).alias("terms"))
    c = table(spark, folder, "attachment_chunks").where("text is not null and text <> ''").select("chunk_rowid", "message_id", "account_id", "chunk_index", T.fold_latin(F.col("text")).alias("t"), F.md5("text").alias("h")).distinct()
    hits = e.join(c, ["message_id", "account_id"])
    scan = Window.partitionBy("email_rowid").orderBy("chunk_index", "chunk_rowid")
    hits = hits.withColumn("n", F.row_number().over(scan)).where("n <= 120")
    hits = hits.withColumn("matches", F.size(F.filter("terms", lambda w: F.col("t").contains(w)))).where("matches > 0")
    once = F.row_number().over(Window.partitionBy("email_rowid", "h").orderBy(F.desc("matches"), "n"))
    best = F.row_number().over(Window.partitionBy("email_rowid").orderBy(F.desc("matches"), "n"))
    return hits.withColumn("once", once).where("once = 1").withColumn("place", best).where("place <= 3").select("email_rowid", "chunk_rowid", "matches", "place")


def named_documents(spark, folder):
    """Mails whose subject names an attachment of their account: shared distinctive words of five letters or more, the most letters first, then the newest file."""
    e = emails(spark, folder, "account_id", "subject").select("email_rowid", "account_id", F.explode(F.array_distinct(F.filter(T.index_words(F.col("subject")), lambda w: F.length(w) >= 5))).alias("word"))
    a = table(spark, folder, "attachments").where("filename is not null").groupBy("attachment_id").agg(F.max(F.struct("account_id", "filename", "indexed_at")).alias("r")).select("attachment_id", "r.*")
    words = a.select("attachment_id", "account_id", "indexed_at", F.explode(F.array_distinct(F.filter(F.split(T.filename_words(F.col("filename")), " "), lambda w: F.length(w) >= 5))).alias("word"))
    common = words.groupBy("account_id", "word").agg(F.count(F.lit(1)).alias("files"))
    words = words.join(common.where("files <= 3"), ["account_id", "word"])
    hits = e.join(words, ["account_id", "word"]).groupBy("email_rowid", "attachment_id").agg(F.sum(F.length("word")).alias("letters"), F.max("indexed_at").alias("at"))
    best = F.max_by(F.struct("attachment_id", "letters"), F.struct("letters", "at", "attachment_id")).alias("b")
    return hits.groupBy("email_rowid").agg(best).select("email_rowid", "b.attachment_id", "b.letters")


def question_scopes(spark, folder):
    """The days that questions name, and what is left to search for."""
    rows = []
    for i, q in enumerate(SCOPED):
        got = timescope.time_scope(q, NOW)
        rows.append((i, q, got and got[0].strftime("%Y-%m-%d"), got and got[1].strftime("%Y-%m-%d"), timescope.without_scope(q)))
    return spark.createDataFrame(rows, "question int, text string, first_day string, last_day string, topic string")


def scoped_counts(spark, folder):
    """Mails within the range that each question names; the newest of them. Questions without a range take all."""
    ranges = []
    for i, q in enumerate(SCOPED):
        got = timescope.time_scope(q, NOW)
        at = lambda d: int((d - datetime(1970, 1, 1)).total_seconds() * 1000)
        ranges.append((i, at(got[0]) if got else None, at(got[1]) if got else None))
    r = F.broadcast(spark.createDataFrame(ranges, "question int, low long, high long"))
    df = emails(spark, folder, "date_ms").where("date_ms is not null")
    inside = F.col("low").isNull() | F.col("date_ms").between(F.col("low"), F.col("high"))
    got = df.join(r, inside).groupBy("question").agg(F.count(F.lit(1)).alias("mails"), F.max(F.struct("date_ms", -F.col("email_rowid"))).alias("m")).select("question", "mails", (-F.col("m.col2")).alias("newest"))
    return r.join(got, "question", "left").select("question", F.coalesce("mails", F.lit(0)).alias("mails"), "newest")


def source_cards(spark, folder):
    """The finds of each logged query as sources: file, mail and a score from the distance."""
    near = chunk_knn(spark, folder, 5)
    c = table(spark, folder, "attachment_chunks").select("chunk_rowid", "attachment_id").distinct()
    a = table(spark, folder, "attachments").where("filename is not null").groupBy("attachment_id").agg(F.max("filename").alias("filename"))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("distance") * F.col("distance") / 2)), 6)
    return near.join(c, "chunk_rowid").join(a, "attachment_id", "left").select("query_id", "place", "chunk_rowid", "filename", score.alias("score"))


QUERIES = {f.__name__: f for f in (email_keyword_search, chunk_keyword_search, index_terms, index_after_update, hybrid_search, attachment_arm, expanded_attachments, named_documents, question_scopes, scoped_counts, source_cards)}

_W = r"regexp_extract_all(lower(strip_accents({c})), '[\pL\pN]+')"
_E = "with " + EMAILS_SQL
_Q = "q0 as (select * from (values " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUESTIONS)) + ") as t(question, text)), qt as (select distinct question, unnest(" + _W.format(c="text") + ") as word from q0)"


def _bm25(texts: str, key: str, scope: str, limit: int) -> str:
    return f"""s as (select *, len(w) as length from {texts} where len(w) > 0), a as (select count(*) as n, avg(length) as avgl from s), h as (select {key}, length, {scope} as inside, unnest(w) as word from s),
i as (select {key}, length, inside, word, count(*) as tf from h where word in (select word from qt) group by all), d as (select word, count(*) as df from i group by word),
x as (select question, {key}, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl))), 6) as score from i join d using (word) join qt using (word), a where inside group by question, {key}),
k as (select question, {key}, score, row_number() over (partition by question order by score desc, {key}) as place from x), kw as (select * from k where place <= {limit})"""


_ET = "t as (select email_rowid, account_id, date_ms, indexed_at, " + _W.format(c="concat_ws(' ', subject, from_addr, body)") + " as w from e)"
_CT = "c0 as (select *, row_number() over (partition by chunk_rowid order by attachment_id desc, account_id desc, chunk_index desc, text desc) as rn from attachment_chunks where chunk_rowid is not null), t as (select chunk_rowid, attachment_id, " + _W.format(c="text") + " as w from c0 where rn = 1)"
_SUB = "w as (select email_rowid, unnest(" + _W.format(c="subject") + ") as word from {src})"
_GOOD = "len({c}) = 64 and not list_bool_or(list_transform({c}, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform({c}, lambda x: x <> 0))"
_MODEL = "regexp_replace(trim(model_id), '(?i):latest$', '')"
_NEAR = f"""q1 as (select query_id, account_id, {_MODEL} as m, query_vector, row_number() over (partition by query_id order by account_id, {_MODEL}, query_vector) as k from chunk_hits where {_GOOD.format(c='query_vector')}),
v1 as (select chunk_rowid, account_id, {_MODEL} as m, embedding, row_number() over (partition by chunk_rowid, account_id, {_MODEL} order by created_at desc, embedding desc) as k from chunk_embeddings where {_GOOD.format(c='embedding')}),
n0 as (select query_id, chunk_rowid, round(list_distance(embedding::double[], query_vector::double[]), 6) as distance from v1 join q1 on v1.account_id = q1.account_id and v1.m = q1.m where v1.k = 1 and q1.k = 1),
n1 as (select *, row_number() over (partition by query_id order by distance, chunk_rowid) as place from n0)"""
_FUSED = "f as (select question, {key}, round(sum(1.0 / (60 + place - 1)), 9) as score, min(arm * 100000 + place) as seen from u group by question, {key}) select question, {key}, score, place from (select *, row_number() over (partition by question order by score desc, seen) as place from f) where place <= {limit}"
_SCOPES = [
    ("2025-06-15", "2025-06-18", "mails of the"), ("2025-06-04", "2025-06-18", "les"), ("2024-05-01", "2024-05-31", "in"), ("2025-06-17", "2025-06-17", "invoices from"), ("2025-06-09", "2025-06-15", ""), ("2025-06-01", "2025-06-30", ""),
    ("2025-05-19", "2025-06-18", "anything"), ("2023-01-01", "2023-12-31", ""), (None, None, "order 2023"), ("2025-03-01", "2025-03-31", "rapport de"), ("2025-01-01", "2025-12-31", ""), ("2025-05-01", "2025-05-31", ""),
]
_day = lambda d: f"'{d}'" if d else "null"
_SC = "select * from (values " + ", ".join(f"({i}, '{q}', {_day(a)}, {_day(b)}, '{t}')" for i, (q, (a, b, t)) in enumerate(zip(SCOPED, _SCOPES))) + ") as t(question, text, first_day, last_day, topic)"

ORACLE_SQL = {
    "email_keyword_search": f"{_E}, {_Q}, {_ET}, {_bm25('t', 'email_rowid', f'account_id like {chr(39)}{HOT}%{chr(39)}', 30)} select question, email_rowid, score, place from kw",
    "chunk_keyword_search": f"with {_Q}, {_CT}, {_bm25('t', 'chunk_rowid', 'true', 8)} select question, chunk_rowid, score, place from kw",
    "index_terms": f"{_E}, {_SUB.format(src='e')} select word, count(distinct email_rowid) as mails, count(*) as occurrences from w group by word",
    "index_after_update": f"{_E}, u as (select email_rowid, case when email_rowid % 3 = 0 then 'moved boiler' when email_rowid % 7 = 0 then null else subject end as subject from e), {_SUB.format(src='u')} select word, count(distinct email_rowid) as mails from w group by word",
    "hybrid_search": f"""{_E}, {_Q}, {_ET}, {_bm25('t', 'email_rowid', 'true', 30)}, ql as (select question, list(word) as terms from qt group by question),
n as (select question, email_rowid, row_number() over (partition by question order by coalesce(date_ms, epoch_ms(indexed_at)) desc nulls last, email_rowid) as place from t join ql on list_has_all(w, terms)), u as (select question, email_rowid, place, 0 as arm from kw union all select question, email_rowid, place, 1 from n where place <= 30), {_FUSED.format(key='email_rowid', limit=10)}""",
    "attachment_arm": f"""with {_NEAR}, near as (select * from n1 where place <= 12 and 1 - distance * distance / 2 >= 0.45), {_CT}, fw as (select query_id as question, list_filter(w, lambda x, i: length(x) >= 6 and list_position(w, x) = i)[1:4] as terms from near join t using (chunk_rowid) where place = 1), qt as (select question, unnest(terms) as word from fw),
{_bm25('t', 'chunk_rowid', 'true', 12)}, u as (select query_id as question, chunk_rowid, place, 0 as arm from near union all select question, chunk_rowid, place, 1 from kw), {_FUSED.format(key='chunk_rowid', limit=5)}""",
    "expanded_attachments": f"""{_E}, s as (select email_rowid, message_id, account_id, list_distinct(list_filter({_W.format(c='subject')}, lambda x: length(x) >= 4)) as terms from e), c as (select distinct chunk_rowid, message_id, account_id, chunk_index, lower(strip_accents(text)) as t, md5(text) as h from attachment_chunks where text <> ''),
j as (select *, row_number() over (partition by email_rowid order by chunk_index, chunk_rowid) as n from s join c using (message_id, account_id)), m as (select *, len(list_filter(terms, lambda x: contains(t, x))) as matches from j where n <= 120), o as (select *, row_number() over (partition by email_rowid, h order by matches desc, n) as once from m where matches > 0),
b as (select *, row_number() over (partition by email_rowid order by matches desc, n) as place from o where once = 1) select email_rowid, chunk_rowid, matches, place from b where place <= 3""",
    "named_documents": f"""{_E}, s as (select distinct email_rowid, account_id, unnest(list_filter({_W.format(c='subject')}, lambda x: length(x) >= 5)) as word from e), a as (select * from (select *, row_number() over (partition by attachment_id order by account_id desc, filename desc, indexed_at desc) as rn from attachments where filename is not null) where rn = 1),
w as (select distinct attachment_id, account_id, indexed_at, unnest(list_filter(string_split(trim(regexp_replace(lower(strip_accents(regexp_replace(filename, '(\\p{{Ll}}|\\d)(\\p{{Lu}})', '\\1 \\2', 'g'))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 5)) as word from a),
f as (select account_id, word from w group by all having count(*) <= 3), h as (select email_rowid, attachment_id, cast(sum(length(word)) as bigint) as letters, max(indexed_at) as seen from s join w using (account_id, word) join f using (account_id, word) group by all)
select email_rowid, attachment_id, letters from (select *, row_number() over (partition by email_rowid order by letters desc, seen desc, attachment_id desc) as k from h) where k = 1""",
    "question_scopes": _SC,
    "scoped_counts": f"{_E}, s as ({_SC}), r as (select question, epoch_ms(first_day::timestamp) as low, epoch_ms(last_day::timestamp + interval 1 day) - 1 as high from s), j as (select question, email_rowid, date_ms from e join r on date_ms is not null and (low is null or date_ms between low and high)), g as (select question, count(*) as mails, arg_min(email_rowid, (-date_ms, email_rowid)) as newest from j group by question) select question, coalesce(mails, 0) as mails, newest from r left join g using (question)",
    "source_cards": f"with {_NEAR}, c as (select distinct chunk_rowid, attachment_id from attachment_chunks), a as (select attachment_id, max(filename) as filename from attachments where filename is not null group by 1) select query_id, place, chunk_rowid, filename, round(greatest(0.0, least(1.0, 1 - distance * distance / 2)), 6) as score from n1 join c using (chunk_rowid) left join a using (attachment_id) where place <= 5",
}
