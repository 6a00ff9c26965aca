"""Queries over the mail tables and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.vectors import has_shape, l2_distance
from skein.operators import merge, search
from skein.runtime import spread
from skein.sources import table

#: One row an email: the one indexed last. The same in SQL for the checks below.
EMAILS_SQL = "e as (select * from (select *, row_number() over (partition by email_rowid order by indexed_at desc nulls last, folder desc nulls last) as rn from emails) where rn = 1)"
HOT = "acc-000"


def emails(spark: SparkSession, folder: str, *columns: str, **derived: Column) -> DataFrame:
    """(email_rowid, columns, derived) of each email as indexed last.

    Only the named columns are read, and what is derived from a row is computed before the shuffle, so that texts don't move.
    """
    df = spread(table(spark, folder, "emails")) if derived else table(spark, folder, "emails")
    need = [c for c in dict.fromkeys([*columns, "indexed_at", "folder"]) if c != "email_rowid"]
    one = merge.newest(df.select("email_rowid", *need, *[c.alias(n) for n, c in derived.items()]), ["email_rowid"], ["indexed_at", "folder"])
    return one.select("email_rowid", *columns, *derived)


def recency() -> Column:
    return F.coalesce("date_ms", F.unix_millis("indexed_at"))


def recency_page(spark, folder):
    """Third page of 50 of an account's mails, newest first, without bodies."""
    df = emails(spark, folder, "account_id", "subject", "date_ms", "indexed_at").where(F.col("account_id").startswith(HOT))
    return df.withColumn("sent_at", recency()).orderBy(F.desc_nulls_last("sent_at"), "email_rowid").offset(100).limit(50).select("email_rowid", "subject", "sent_at")


def range_scan(spark, folder):
    """Mails dated within a closed range."""
    return emails(spark, folder, "date_ms").where(F.col("date_ms").between(1_740_000_000_000, 1_750_000_000_000)).select("email_rowid", "date_ms")


def folder_counts(spark, folder):
    """Mails by folder, spelt one way."""
    name = F.lower(F.trim(F.split("folder", "/")[0]))
    return emails(spark, folder, "folder").groupBy(name.alias("folder_name")).agg(F.count(F.lit(1)).alias("mails"))


def folder_exclusion(spark, folder):
    """Mails outside folders one of whose path segments is excluded, whatever its case."""
    parts = F.transform(F.split(F.lower("folder"), "/"), lambda x: F.trim(x))
    hit = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("spam", "trash", "junk")]))
    return emails(spark, folder, "account_id", "folder").where(~F.coalesce(hit, F.lit(False))).groupBy("account_id").agg(F.count(F.lit(1)).alias("mails"))


def accounts(spark, folder):
    return table(spark, folder, "accounts").distinct()


def account_kinds(spark, folder):
    """Each account with the kind that its domain suggests."""
    domain = T.sender_domain(F.col("address"))
    kind = F.when(domain.rlike(r"(^|\.)(edu|ac|univ)(\.|$)"), "institutional").when(domain.rlike(r"^(gmail|outlook|hotmail|yahoo|gmx|icloud)\."), "personal").otherwise("work")
    return accounts(spark, folder).select("account_id", domain.alias("domain"), kind.alias("guessed_kind"), (kind == F.col("kind")).alias("as_stored"))


def account_eligibility(spark, folder):
    """Accounts open to discovery, by kind: personal ones only where they are not excluded."""
    ok = ~F.coalesce("exclude_from_discovery", F.lit(True))
    return accounts(spark, folder).groupBy("kind").agg(F.count_if(ok).alias("eligible"), F.count(F.lit(1)).alias("accounts"))


def domain_frequency(spark, folder):
    """Mails by sender domain, most first."""
    d = T.sender_domain(F.col("from_addr"))
    return emails(spark, folder, "from_addr").select(d.alias("domain"), "email_rowid").where(F.col("domain").isNotNull()).groupBy("domain").agg(F.count(F.lit(1)).alias("mails"), F.min("email_rowid").alias("first_rowid"))


def domain_like(spark, folder):
    """Mails from one domain, by a pattern without regard to case in which '_' and '%' stand for themselves."""
    return emails(spark, folder, "from_addr").where(F.expr("from_addr ilike '%!_%@%-mail.example%' escape '!'") | F.col("from_addr").ilike("%@ab%")).select("email_rowid", "from_addr")


def first_per_domain(spark, folder):
    """One mail a sender domain, in the order of a hash of its message id."""
    df = emails(spark, folder, "message_id", "from_addr").select("email_rowid", "message_id", T.sender_domain(F.col("from_addr")).alias("domain")).where(F.col("domain").isNotNull())
    return df.groupBy("domain").agg(F.min_by("email_rowid", F.struct(T.text_hash(F.col("message_id")), "email_rowid")).alias("email_rowid"))


def hash_sample(spark, folder):
    """200 mails in the order of a hash of the message id: the same sample each time."""
    df = emails(spark, folder, "account_id", "message_id").withColumn("h", T.text_hash(F.col("message_id")))
    return df.where("h is not null").orderBy("h", "email_rowid").limit(200).select("email_rowid", "account_id", F.col("h").alias("hash"))


def unembedded(spark, folder):
    """Mails with a body and no vector of a model, by account."""
    have = table(spark, folder, "email_embeddings").where((T.model_key(F.col("model_id")) == "atlas-embed-64") & F.col("embedding").isNotNull()).select("email_rowid").distinct()
    return emails(spark, folder, "account_id", chars=F.length("body")).where("chars > 0").select("email_rowid", "account_id").join(have, "email_rowid", "left_anti")


def needs_fetch(spark, folder):
    """Mails whose body is still to be fetched, by account and recency of indexing."""
    done = table(spark, folder, "emails").where("body_fetched").select("email_rowid").distinct()
    return emails(spark, folder, "account_id").join(done, "email_rowid", "left_anti").select("email_rowid", "account_id")


def vector_models(spark, folder):
    """Vectors by model, without the suffix."""
    return table(spark, folder, "email_embeddings").distinct().groupBy(T.model_key(F.col("model_id")).alias("model")).agg(F.count_distinct("email_rowid").alias("mails"))


def latest_vectors(spark, folder):
    """The state after all vector upserts: each key's latest time and whether its vector has the right length."""
    v = table(spark, folder, "email_embeddings").select("email_rowid", T.model_key(F.col("model_id")).alias("model"), "created_at", (F.size("embedding") == 64).alias("complete"))
    return v.groupBy("email_rowid", "model").agg(F.max("created_at").alias("created_at"), F.max_by(F.coalesce("complete", F.lit(False)), F.struct("created_at", F.coalesce("complete", F.lit(False)))).alias("complete")).select("email_rowid", "model", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "complete")


def orphan_vectors(spark, folder):
    """Chunk vectors whose chunk is gone."""
    return table(spark, folder, "chunk_embeddings").select("chunk_rowid").distinct().join(table(spark, folder, "attachment_chunks").select("chunk_rowid").distinct(), "chunk_rowid", "left_anti")


def attachment_stats(spark, folder):
    """Attachments by status, with their sizes and characters."""
    return table(spark, folder, "attachments").distinct().groupBy("status").agg(F.count(F.lit(1)).alias("attachments"), F.sum("size_bytes").alias("bytes"), F.sum("char_count").alias("chars"))


def attachment_context(spark, folder):
    """Chunks with their attachment's name and their mail's subject."""
    c = table(spark, folder, "attachment_chunks").select("chunk_rowid", "attachment_id", "chunk_index", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).distinct()
    a = table(spark, folder, "attachments").select("attachment_id", "filename", "message_id", "account_id").distinct()
    e = emails(spark, folder, "message_id", "account_id", "subject").select("message_id", "account_id", "subject")
    return c.join(a, "attachment_id").join(e, ["message_id", "account_id"], "left").select("chunk_rowid", "chunk_index", "chars", "filename", "subject")


def fetchable_attachments(spark, folder):
    """Attachments of a readable type of at most 10 MiB."""
    ok = F.lower("content_type").rlike("^(text/|application/pdf|application/vnd.openxml)") | F.lower("filename").rlike(r"\.(txt|md|csv|pdf|docx|html?)$")
    return table(spark, folder, "attachments").where(ok & (F.col("size_bytes") <= 10 * 1024 * 1024)).select("attachment_id", "size_bytes").distinct()


def failure_ledger(spark, folder):
    """Failures by account and kind; three make a permanent one."""
    f = table(spark, folder, "attachments").distinct().where(F.col("status").isin("error", "unsupported"))
    g = f.groupBy("account_id", "status").agg(F.count(F.lit(1)).alias("failures"), F.max("last_error").alias("last_error"))
    return g.withColumn("permanent", F.col("failures") >= 3)


def chunk_budget(spark, folder):
    """The chunks of each attachment that begin within a budget of 2000 characters."""
    c = table(spark, folder, "attachment_chunks").select("attachment_id", "chunk_index", "chunk_rowid", F.coalesce(F.length("text"), F.lit(0)).alias("chars")).distinct()
    w = Window.partitionBy("attachment_id").orderBy("chunk_index", "chunk_rowid").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("before", F.coalesce(F.sum("chars").over(w), F.lit(0))).where(F.col("before") < 2000).select("chunk_rowid", "attachment_id", "chars", "before")


def filename_versions(spark, folder):
    """The latest of the files of an account whose names differ in digits only."""
    a = table(spark, folder, "attachments").distinct().where(F.col("filename").isNotNull())
    sign = F.trim(F.regexp_replace(F.lower("filename"), "[0-9_ .-]+", " "))
    best = F.max_by(F.struct("attachment_id", "filename"), F.struct("indexed_at", "attachment_id")).alias("b")
    return a.groupBy("account_id", sign.alias("signature")).agg(F.count(F.lit(1)).alias("versions"), best).where("versions > 1").select("account_id", "signature", "versions", "b.attachment_id", "b.filename")


def stored_and_pushed(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Two states of the mails: every message as indexed first, and those pushed again (every third with its body cut)."""
    df = table(spark, folder, "emails").where("email_rowid is not null").select("email_rowid", "folder", "subject", "body", "body_format", "body_fetched", "indexed_at")
    ranked = F.struct("indexed_at", "folder")
    first = df.groupBy("email_rowid").agg(F.min_by(F.struct(*df.columns[1:]), ranked).alias("r")).select("email_rowid", "r.*")
    again = df.groupBy("email_rowid").agg(F.max_by(F.struct(*df.columns[1:]), ranked).alias("r")).select("email_rowid", "r.*").where("email_rowid % 3 <> 1")
    return first, again.withColumn("body", F.when(F.col("email_rowid") % 3 == 0, F.left("body", F.lit(40))).otherwise(F.lit(None).cast("string")))


def merge_upsert_state(spark, folder):
    """The mails after the push: bodies filled, first index times kept, fetched stays fetched."""
    stored, pushed = stored_and_pushed(spark, folder)
    m = merge.keyed_merge(stored, pushed, ["email_rowid"], merge.EMAIL_RULES)
    return m.select("email_rowid", "folder", F.coalesce(F.length("body"), F.lit(0)).alias("body_chars"), "body_format", "body_fetched", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def invalidated_vectors(spark, folder):
    """Vectors, of all models, that a push with another body makes stale."""
    stored, pushed = stored_and_pushed(spark, folder)
    gone = merge.invalidated(stored, pushed, ["email_rowid"], "body")
    return table(spark, folder, "email_embeddings").select("email_rowid", T.model_key(F.col("model_id")).alias("model")).distinct().join(gone, "email_rowid", "left_semi")


def html_text(spark, folder):
    """HTML bodies without markup, the basic entities as characters, white space made one blank."""
    text = F.trim(F.regexp_replace(T.basic_entities(T.strip_html(F.col("body"))), r"[ \t\r\n]+", " "))
    return emails(spark, folder, "body_format", chars=F.length(text), text_md5=F.md5(text)).where((F.col("body_format") == "html") & F.col("chars").isNotNull()).drop("body_format")


def quoteless_text(spark, folder):
    """Text bodies without quoted lines and what follows a signature delimiter."""
    text = T.strip_quotes(F.col("body"))
    return emails(spark, folder, "body_format", chars=F.length(text), text_md5=F.md5(text)).where((F.col("body_format") == "text") & F.col("chars").isNotNull()).drop("body_format")


def preprocessed_bodies(spark, folder):
    """What bodies are read as: without markup, quotes and signature, cut."""
    text = T.preprocessed(F.col("body"), F.col("body_format") == "html", 600)
    return emails(spark, folder, chars=F.length(text), text_md5=F.md5(text)).where("chars is not null")


def embedding_inputs(spark, folder):
    """What a mail's vector is made of: subject, sender and body."""
    return emails(spark, folder, input_md5=F.md5(T.embedding_input(F.col("subject"), F.col("from_addr"), F.col("body"))))


def content_hash(spark, folder):
    """A hash by which a cached summary is known to be current."""
    text = F.concat_ws("|", F.coalesce("subject", F.lit("")), F.coalesce("from_addr", F.lit("")), F.coalesce("body", F.lit("")))
    return emails(spark, folder, hash=F.sha2(text, 256))


TERMS = ["projector", "boiler", "catalogue"]


def keyword_bm25(spark, folder):
    """The 30 mails that match a question best, frequencies taken over all accounts."""
    text = F.lower(F.concat_ws(" ", "subject", "body"))
    counts = {f"tf{i}": F.regexp_count(text, F.lit(rf"{t}(?<![a-z0-9]{t})(?![a-z0-9])")) for i, t in enumerate(TERMS)}
    df = emails(spark, folder, "account_id", length=F.regexp_count(text, F.lit("[a-z0-9]+")), **counts).where("length > 0")
    scored = search.bm25_counts(df, "length", list(counts)).where(F.col("account_id").startswith(HOT) & (F.col("score") > 0))
    return scored.select("email_rowid", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "email_rowid").limit(30)


def rrf_fusion(spark, folder):
    """Two rankings of an account's mails, the newest and those with most of a word, fused."""
    df = emails(spark, folder, "account_id", "date_ms", "indexed_at", n=F.size(F.split(F.lower("body"), "projector")) - 1).where(F.col("account_id").startswith(HOT))
    newest = search.ranked(df.select("email_rowid", recency().alias("at")), [F.desc_nulls_last("at"), F.asc("email_rowid")], 40)
    most = search.ranked(df.select("email_rowid", "n").where("n > 0"), [F.desc("n"), F.asc("email_rowid")], 40)
    return search.rank_fusion([newest, most], "email_rowid").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "arm", "place").limit(20).select("email_rowid", "score")


def keyphrases(spark, folder):
    """Words that tell the accounts' subjects apart."""
    df = emails(spark, folder, "account_id", "subject")
    words = df.select("account_id", F.explode(F.regexp_extract_all(F.lower("subject"), F.lit("([a-z]{3,})"), 1)).alias("word"))
    return search.class_keyphrases(words, "account_id")


def chunk_knn(spark, folder, limit=8):
    """The 8 nearest chunks of the same account and model for every logged query vector."""
    good = lambda c: has_shape(F.col(c), 64) & F.exists(c, lambda x: x != 0)
    q = table(spark, folder, "chunk_hits").where(good("query_vector")).groupBy("query_id").agg(F.min(F.struct("account_id", T.model_key(F.col("model_id")).alias("model"), "query_vector")).alias("q")).select("query_id", "q.*")
    v = table(spark, folder, "chunk_embeddings").where(good("embedding")).groupBy("chunk_rowid", "account_id", T.model_key(F.col("model_id")).alias("model")).agg(F.max_by("embedding", F.struct("created_at", "embedding")).alias("embedding"))
    near = v.join(q, ["account_id", "model"]).select("query_id", "chunk_rowid", F.round(l2_distance(F.col("embedding"), F.col("query_vector")), 6).alias("distance"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_rowid"))
    return near.withColumn("place", place).where(F.col("place") <= limit)


def canonical_keys(spark, folder):
    """A key for each account's name, made unique by a number."""
    key = T.canonical_key(F.coalesce("display_name", F.lit("")))
    rn = F.row_number().over(Window.partitionBy("base").orderBy("created_at", "account_id"))
    return accounts(spark, folder).select("account_id", "created_at", key.alias("base")).withColumn("rn", rn).select("account_id", F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("rn").cast("string"))).alias("canonical_key"))


def label_twins(spark, folder):
    """Subjects of an account (of three words or more) that share three fifths of their words or more, of all accounts.

    Candidates share one of their rarest words: of n words, two labels that share three fifths have one of the
    n - ceil(0.6 n) + 1 rarest in common.
    """
    label = F.lower(F.trim("subject"))
    words = F.array_distinct(F.regexp_extract_all("label", F.lit("([a-z0-9]+)"), 1))
    s = emails(spark, folder, "account_id", label=label).select("account_id", "label").distinct().withColumn("w", words).where(F.size("w") >= 3)
    word = s.select("account_id", "label", "w", F.explode("w").alias("word"))
    rare = word.join(word.groupBy("account_id", "word").agg(F.count(F.lit(1)).alias("n")), ["account_id", "word"])
    rare = rare.groupBy("account_id", "label").agg(F.first("w").alias("w"), F.array_sort(F.collect_list(F.struct("n", "word"))).alias("by"))
    rare = rare.select("account_id", "label", "w", F.explode(F.slice("by.word", F.lit(1), (F.size("w") - F.ceil(F.size("w") * F.lit(0.6) - 1e-6) + 1).cast("int"))).alias("word"))
    a, b = (rare.select("account_id", "word", F.col("label").alias(f"{side}_label"), F.col("w").alias(f"{side}_w")) for side in ("left", "right"))
    pair = a.join(b, ["account_id", "word"]).where(F.col("left_label") < F.col("right_label"))
    pair = pair.select("account_id", "left_label", "right_label", F.round(T.label_similarity(F.col("left_w"), F.col("right_w")), 6).alias("similarity"))
    return pair.where("similarity >= 0.6").distinct()


def thread_trim(spark, folder):
    """The newest mails of each thread, at most 8 and, but for the newest, within 4000 characters."""
    thread = F.lower(F.trim(F.regexp_replace("subject", "(?i)^((re|aw|fwd) *: *)+", "")))
    df = emails(spark, folder, "account_id", thread=thread, at=recency(), chars=F.coalesce(F.length("body"), F.lit(0))).where(F.length("thread") > 0)
    w = Window.partitionBy("account_id", "thread").orderBy(F.desc("at"), "email_rowid")
    df = df.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.where((F.col("place") <= 8) & ((F.col("place") == 1) | (F.col("used") <= 4000))).select("email_rowid", "place", "used")


def time_scoped_search(spark, folder):
    """Mails with a word, dated within a range, newest first; where none is in the range, the newest with the word."""
    df = emails(spark, folder, "date_ms", hit=F.lower("body").contains("projector")).where("hit").select("email_rowid", "date_ms")
    inside = F.col("date_ms").between(1_740_000_000_000, 1_750_000_000_000)
    some = df.agg(F.coalesce(F.max(inside), F.lit(False)).alias("some"))
    scoped = df.crossJoin(F.broadcast(some)).where(F.coalesce(inside, F.lit(False)) | ~F.col("some"))
    return scoped.select("email_rowid", "date_ms").orderBy(F.desc_nulls_last("date_ms"), "email_rowid").limit(40)


def subject_terms(spark, folder):
    """How many search terms each subject makes, and the first."""
    terms = T.search_terms(F.col("subject"))
    return emails(spark, folder, terms=F.coalesce(F.size(F.when(F.col("subject").isNotNull(), terms)), F.lit(0)), first_term=F.try_element_at(terms, F.lit(1))).withColumn("terms", F.greatest("terms", F.lit(0)))


def decoded_chunks(spark, folder):
    """Chunks sent as base64 and decoded: their bytes, and whether they are within the limit."""
    size = F.octet_length(F.unbase64(F.base64(F.encode("text", "UTF-8"))))
    return table(spark, folder, "attachment_chunks").where("text is not null").select("chunk_rowid", size.alias("bytes"), (size <= 1_000).alias("within")).distinct()


def cascaded_delete(spark, folder):
    """Mails, attachments and chunks that remain when an account goes."""
    gone = accounts(spark, folder).where(F.col("account_id").startswith(HOT)).select("account_id")
    keep = lambda name, key: merge.without(table(spark, folder, name).select("account_id", key).distinct(), gone, ["account_id"]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
    return keep("emails", "email_rowid").unionByName(keep("attachments", "attachment_id")).unionByName(keep("attachment_chunks", "chunk_rowid"))


QUERIES = {f.__name__: f for f in (preprocessed_bodies, time_scoped_search, subject_terms, decoded_chunks, cascaded_delete, recency_page, range_scan, folder_counts, folder_exclusion, account_kinds, account_eligibility, domain_frequency, domain_like, first_per_domain, hash_sample, unembedded, needs_fetch, vector_models, latest_vectors, orphan_vectors, attachment_stats, attachment_context, fetchable_attachments, failure_ledger, chunk_budget, filename_versions, merge_upsert_state, invalidated_vectors, html_text, quoteless_text, embedding_inputs, content_hash, keyword_bm25, rrf_fusion, keyphrases, chunk_knn, canonical_keys, label_twins, thread_trim)}

_E = "with " + EMAILS_SQL
_DOMAIN = r"nullif(regexp_extract(lower({c}), '@([^@\s>]+)[^@]*$', 1), '')"
_MODEL = "regexp_replace(trim(model_id), '(?i):latest$', '')"
_AT = "coalesce(date_ms, epoch_ms(indexed_at))"
_FNV = "list_reduce(list_prepend(2166136261::ubigint, list_transform(string_split(message_id, ''), lambda c: unicode(c)::ubigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)::bigint"
_SPACE = r"[\t-\r\x{85}\pZ]+"
_ENTITIES = "replace(replace(replace(replace(replace(replace({c}, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&amp;', '&')"
_PLAIN = _ENTITIES.format(c="regexp_replace(regexp_replace({c}, '(?is)<(?:style|script)[^>]*>.*?</(?:style|script)>', ' ', 'g'), '<[^>]+>', ' ', 'g')")
_QUOTELESS = r"regexp_replace(regexp_replace(replace({c}, chr(13) || chr(10), chr(10)), '(?s)(?:^|\n)-- ?(?:\n.*)?$', ''), '(?m)^>[^\n]*\n?', '', 'g')"
_PUSH = """with d as (select email_rowid, folder, subject, body, body_format, body_fetched, indexed_at from emails where email_rowid is not null),
s as (select * from (select *, row_number() over (partition by email_rowid order by indexed_at, folder) as rn from d) where rn = 1),
p0 as (select * from (select *, row_number() over (partition by email_rowid order by indexed_at desc, folder desc) as rn from d) where rn = 1 and email_rowid % 3 <> 1),
p as (select * exclude (body), case when email_rowid % 3 = 0 then left(body, 40) end as body from p0)"""

ORACLE_SQL = {
    "preprocessed_bodies": f"""{_E}, c as (select email_rowid, body_format, left(body, 2400) as body from e where body is not null), h as (select email_rowid, case when coalesce(body_format = 'html', false) then {_PLAIN.format(c='body')} else body end as x from c),
t as (select email_rowid, left(trim(regexp_replace({_QUOTELESS.format(c='x')}, '{_SPACE}', ' ', 'g')), 600) as x from h) select email_rowid, length(x) as chars, md5(x) as text_md5 from t""",
    "time_scoped_search": f"{_E}, h as (select email_rowid, date_ms, coalesce(date_ms between 1740000000000 and 1750000000000, false) as inside from e where contains(lower(body), 'projector')) select email_rowid, date_ms from h where inside or not (select bool_or(inside) from h) order by date_ms desc nulls last, email_rowid limit 40",
    "subject_terms": f"{_E}, t as (select email_rowid, regexp_extract_all(lower(subject), '[\\pL\\pN]{{2,}}') as w from e), d as (select email_rowid, list_filter(w, lambda x, i: list_position(w, x) = i) as w from t) select email_rowid, case when w is null then 0 else least(len(w), 16) end as terms, w[1] as first_term from d",
    "decoded_chunks": "select distinct chunk_rowid, strlen(text) as bytes, strlen(text) <= 1000 as within from attachment_chunks where text is not null",
    "cascaded_delete": f"select 'emails' as table_name, count(distinct (account_id, email_rowid)) as rows from emails where account_id not like '{HOT}%' union all select 'attachments', count(distinct (account_id, attachment_id)) from attachments where account_id not like '{HOT}%' union all select 'attachment_chunks', count(distinct (account_id, chunk_rowid)) from attachment_chunks where account_id not like '{HOT}%'",
    "recency_page": f"{_E} select email_rowid, subject, {_AT} as sent_at from e where account_id like '{HOT}%' order by sent_at desc nulls last, email_rowid limit 50 offset 100",
    "range_scan": f"{_E} select email_rowid, date_ms from e where date_ms between 1740000000000 and 1750000000000",
    "folder_counts": f"{_E} select lower(trim(split_part(folder, '/', 1))) as folder_name, count(*) as mails from e group by 1",
    "folder_exclusion": f"{_E} select account_id, count(*) as mails from e where not coalesce(list_has_any(list_transform(string_split(lower(folder), '/'), lambda x: trim(x)), ['spam', 'trash', 'junk']), false) group by 1",
    "account_kinds": f"""with a as (select distinct * from accounts), d as (select *, {_DOMAIN.format(c='address')} as domain from a),
k as (select *, case when regexp_matches(domain, '(^|\\.)(edu|ac|univ)(\\.|$)') then 'institutional' when regexp_matches(domain, '^(gmail|outlook|hotmail|yahoo|gmx|icloud)\\.') then 'personal' else 'work' end as guessed_kind from d)
select account_id, domain, guessed_kind, guessed_kind = kind as as_stored from k""",
    "account_eligibility": "select kind, count(*) filter (where not coalesce(exclude_from_discovery, true)) as eligible, count(*) as accounts from (select distinct * from accounts) group by kind",
    "domain_frequency": f"{_E} select {_DOMAIN.format(c='from_addr')} as domain, count(*) as mails, min(email_rowid) as first_rowid from e where {_DOMAIN.format(c='from_addr')} is not null group by 1",
    "domain_like": f"{_E} select email_rowid, from_addr from e where from_addr ilike '%!_%@%-mail.example%' escape '!' or from_addr ilike '%@ab%'",
    "first_per_domain": f"{_E}, r as (select email_rowid, {_FNV} as h, {_DOMAIN.format(c='from_addr')} as domain from e) select domain, email_rowid from (select *, row_number() over (partition by domain order by h, email_rowid) as k from r where domain is not null) where k = 1",
    "hash_sample": f"{_E} select email_rowid, account_id, {_FNV} as hash from e where message_id is not null order by hash, email_rowid limit 200",
    "unembedded": f"{_E} select email_rowid, account_id from e where length(body) > 0 and not exists (select 1 from email_embeddings v where v.email_rowid = e.email_rowid and {_MODEL} = 'atlas-embed-64' and embedding is not null)",
    "needs_fetch": f"{_E} select email_rowid, account_id from e where not exists (select 1 from emails x where x.email_rowid = e.email_rowid and x.body_fetched)",
    "vector_models": f"select {_MODEL} as model, count(distinct email_rowid) as mails from email_embeddings group by 1",
    "latest_vectors": f"select email_rowid, model, strftime(created_at, '%Y-%m-%d %H:%M:%S') as at, complete from (select *, row_number() over (partition by email_rowid, model order by created_at desc, complete desc) as k from (select email_rowid, {_MODEL} as model, created_at, coalesce(len(embedding) = 64, false) as complete from email_embeddings)) where k = 1",
    "orphan_vectors": "select distinct chunk_rowid from chunk_embeddings where chunk_rowid not in (select chunk_rowid from attachment_chunks where chunk_rowid is not null)",
    "attachment_stats": "select status, count(*) as attachments, cast(sum(size_bytes) as bigint) as bytes, cast(sum(char_count) as bigint) as chars from (select distinct * from attachments) group by status",
    "attachment_context": f"{_E}, c as (select distinct chunk_rowid, attachment_id, chunk_index, coalesce(length(text), 0) as chars from attachment_chunks), a as (select distinct attachment_id, filename, message_id, account_id from attachments) select chunk_rowid, chunk_index, chars, filename, subject from c join a using (attachment_id) left join e on e.message_id = a.message_id and e.account_id = a.account_id",
    "fetchable_attachments": "select distinct attachment_id, size_bytes from attachments where (regexp_matches(lower(content_type), '^(text/|application/pdf|application/vnd.openxml)') or regexp_matches(lower(filename), '\\.(txt|md|csv|pdf|docx|html?)$')) and size_bytes <= 10485760",
    "failure_ledger": "select account_id, status, count(*) as failures, max(last_error) as last_error, count(*) >= 3 as permanent from (select distinct * from attachments) where status in ('error', 'unsupported') group by account_id, status",
    "chunk_budget": "with c as (select distinct attachment_id, chunk_index, chunk_rowid, coalesce(length(text), 0) as chars from attachment_chunks), w as (select *, coalesce(sum(chars) over (partition by attachment_id order by chunk_index, chunk_rowid rows between unbounded preceding and 1 preceding), 0) as before from c) select chunk_rowid, attachment_id, chars, cast(before as bigint) as before from w where before < 2000",
    "filename_versions": "with a as (select distinct * from attachments where filename is not null), s as (select *, trim(regexp_replace(lower(filename), '[0-9_ .-]+', ' ', 'g')) as signature from a), r as (select *, count(*) over (partition by account_id, signature) as versions, row_number() over (partition by account_id, signature order by indexed_at desc, attachment_id desc) as k from s) select account_id, signature, versions, attachment_id, filename from r where k = 1 and versions > 1",
    "merge_upsert_state": f"""{_PUSH} select s.email_rowid, case when p.email_rowid is null then s.folder else p.folder end as folder, coalesce(length(coalesce(p.body, s.body)), 0) as body_chars,
coalesce(p.body_format, s.body_format) as body_format, case when p.email_rowid is null then s.body_fetched else coalesce(s.body_fetched, false) or coalesce(p.body_fetched, false) end as body_fetched, strftime(s.indexed_at, '%Y-%m-%d %H:%M:%S') as at
from s left join p on p.email_rowid = s.email_rowid""",
    "invalidated_vectors": f"{_PUSH}, g as (select p.email_rowid from p join s on s.email_rowid = p.email_rowid where p.body is not null and p.body is distinct from s.body) select distinct email_rowid, {_MODEL} as model from email_embeddings where email_rowid in (select email_rowid from g)",
    "html_text": f"{_E}, t as (select email_rowid, trim(regexp_replace({_PLAIN.format(c='body')}, '[ \\t\\r\\n]+', ' ', 'g')) as x from e where body_format = 'html' and body is not null) select email_rowid, length(x) as chars, md5(x) as text_md5 from t",
    "quoteless_text": f"{_E}, t as (select email_rowid, {_QUOTELESS.format(c='body')} as x from e where body_format = 'text' and body is not null) select email_rowid, length(x) as chars, md5(x) as text_md5 from t",
    "embedding_inputs": f"""{_E}, t as (select email_rowid, nullif(concat_ws(chr(10), case when length(trim(subject)) > 0 then 'Subject: ' || trim(subject) end, case when length(trim(from_addr)) > 0 then 'From: ' || trim(from_addr) end), '') as head,
nullif(left(trim(regexp_replace(body, '{_SPACE}', ' ', 'g')), 8000), '') as x from e) select email_rowid, md5(concat_ws(chr(10) || chr(10), head, x)) as input_md5 from t""",
    "content_hash": f"{_E} select email_rowid, sha256(concat_ws('|', coalesce(subject, ''), coalesce(from_addr, ''), coalesce(body, ''))) as hash from e",
    "keyword_bm25": f"""{_E}, t as (select email_rowid, account_id, regexp_extract_all(lower(concat_ws(' ', subject, body)), '[a-z0-9]+') as w from e), s as (select * from t where len(w) > 0),
a as (select count(*) as n, avg(len(w)) as avgl from s), h as (select email_rowid, account_id, len(w) as length, unnest(w) as word from s), i as (select email_rowid, account_id, length, word, count(*) as tf from h where word in ('projector', 'boiler', 'catalogue') group by all),
d as (select word, count(*) as df from i group by word),
x as (select email_rowid, account_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgl))), 6) as score from i join d using (word), a group by all)
select email_rowid, score from x where account_id like '{HOT}%' order by score desc, email_rowid limit 30""",
    "rrf_fusion": f"""{_E}, m as (select * from e where account_id like '{HOT}%'), n0 as (select email_rowid, {_AT} as sent_at from m order by sent_at desc nulls last, email_rowid limit 40), n1 as (select email_rowid, 0 as arm, row_number() over (order by sent_at desc nulls last, email_rowid) - 1 as place from n0),
k0 as (select email_rowid, len(string_split(lower(body), 'projector')) - 1 as n from m), k1 as (select * from k0 where n > 0 order by n desc, email_rowid limit 40), k2 as (select email_rowid, 1 as arm, row_number() over (order by n desc, email_rowid) - 1 as place from k1),
u as (select * from n1 union all select * from k2), g as (select email_rowid, round(sum(1.0 / (60 + place)), 9) as score, min(arm * 1000 + place) as seen from u group by 1)
select email_rowid, score from g order by score desc, seen limit 20""",
    "keyphrases": f"""{_E}, w as (select account_id, unnest(regexp_extract_all(lower(subject), '[a-z]{{3,}}')) as word from e), t as (select account_id, word, count(*) as tf from w group by all), d as (select word, count(*) as df from t group by 1), n as (select count(distinct account_id) as n from t),
s as (select account_id, word, tf, round(tf * (1 + ln(n / df)), 6) as score from t join d using (word), n), r as (select *, row_number() over (partition by account_id order by score desc, word) as place from s) select account_id, word, tf, score, place from r where place <= 8""",
    "chunk_knn": f"""with q0 as (select query_id, account_id, {_MODEL} as m, query_vector from chunk_hits where len(query_vector) = 64 and not list_bool_or(list_transform(query_vector, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform(query_vector, lambda x: x <> 0))), q as (select * from (select *, row_number() over (partition by query_id order by account_id, m, query_vector) as k from q0) where k = 1),
v0 as (select chunk_rowid, account_id, {_MODEL} as m, embedding, created_at from chunk_embeddings where len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))), v as (select * from (select *, row_number() over (partition by chunk_rowid, account_id, m order by created_at desc, embedding desc) as k from v0) where k = 1),
d as (select query_id, chunk_rowid, round(list_distance(embedding::double[], query_vector::double[]), 6) as distance from v join q on v.account_id = q.account_id and v.m = q.m) select query_id, chunk_rowid, distance, place from (select *, row_number() over (partition by query_id order by distance, chunk_rowid) as place from d) where place <= 8""",
    "canonical_keys": "with a as (select distinct * from accounts), b as (select account_id, created_at, coalesce(nullif(left(replace(trim(regexp_replace(lower(strip_accents(coalesce(display_name, ''))), '[^a-z0-9]+', ' ', 'g')), ' ', '_'), 60), ''), 'category') as base from a), r as (select *, row_number() over (partition by base order by created_at, account_id) as rn from b) select account_id, case when rn = 1 then base else base || '_' || rn end as canonical_key from r",
    "label_twins": f"""{_E}, l as (select distinct account_id, lower(trim(subject)) as label from e where length(trim(subject)) > 0), w as (select account_id, label, list_distinct(regexp_extract_all(label, '[a-z0-9]+')) as w from l), s as (select * from w where len(w) >= 3),
x as (select a.account_id, a.label as left_label, b.label as right_label, len(list_intersect(a.w, b.w)) as shared, len(a.w) as na, len(b.w) as nb from s a join s b on a.account_id = b.account_id and a.label < b.label) select account_id, left_label, right_label, round(shared / (na + nb - shared), 6) as similarity from x where round(shared / (na + nb - shared), 6) >= 0.6""",
    "thread_trim": f"""{_E}, t as (select email_rowid, account_id, lower(trim(regexp_replace(subject, '(?i)^((re|aw|fwd) *: *)+', ''))) as thread, {_AT} as sent_at, coalesce(length(body), 0) as chars from e), r as (select *, row_number() over (partition by account_id, thread order by sent_at desc, email_rowid) as place, sum(chars) over (partition by account_id, thread order by sent_at desc, email_rowid rows unbounded preceding) as used from t where length(thread) > 0)
select email_rowid, place, cast(used as bigint) as used from r where place <= 8 and (place = 1 or used <= 4000)""",
}
