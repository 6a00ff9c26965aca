"""State of mails: triage and its resolutions, assignments, attachments, jobs, audit; and their SQL.

Triage and assignments are derived from the mails' row ids, so that every mail has a known state: a fifth has no triage, a
tenth triage without metadata; each mail that no 7 divides is assigned to one or two of 12 categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import merge
from skein.plans.mail import EMAILS_SQL, accounts, emails, recency
from skein.sources import table

DAY = 86_400_000
#: The moment from which the registered queries see deadlines and snoozes: 2025-06-01, in ms.
NOW = 1_748_736_000_000
BUCKETS = ("urgent", "personal", "summarize", "newsletter", "spam")


def triaged(df: DataFrame) -> DataFrame:
    """Triage of mails (email_rowid, ..): bucket, importance, deadline, flags, resolution and metadata, from the row id."""
    r = F.col("email_rowid")
    ms = lambda c: F.col(c).cast("long")
    rows = df.where(r % 5 != 0)
    bucket = F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), (r % 5 + 1).cast("int"))
    return rows.select(
        *df.columns, bucket.alias("bucket"), (r * 37 % 101).cast("int").alias("importance"), F.when(r % 3 == 0, F.lit(NOW) + (r % 41 - 20) * DAY).alias("deadline"), (r % 4 == 1).alias("action_required"),
        F.when(r % 11 == 0, F.lit(NOW) - DAY).alias("dismissed_at"), F.when(r % 13 == 0, F.lit(NOW) - 2 * DAY).alias("done_at"), F.when(r % 6 == 1, F.lit(NOW) + (r % 9 - 4) * DAY).alias("snoozed_until"),
        F.when(r % 10 != 1, F.concat(F.lit('{"importanceScore": '), (r * 37 % 101).cast("string"), F.lit("}"))).alias("metadata"),
    )


def active(now: int = NOW) -> Column:
    """Not dismissed, not done, and not snoozed beyond now."""
    return F.col("dismissed_at").isNull() & F.col("done_at").isNull() & (F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= now))


def triage(spark, folder, *columns: str) -> DataFrame:
    return triaged(emails(spark, folder, *columns))


def assigned(df: DataFrame) -> DataFrame:
    """(email_rowid, .., category, confidence, assigned_by) of mails; by users for row ids that 4 divides."""
    r = F.col("email_rowid")
    user = r % 4 == 0
    one = df.where(r % 7 != 0).select(*df.columns, (r % 12).cast("int").alias("category"), F.when(user, 1.0).otherwise(0.5 + r % 5 / 10).alias("confidence"), F.when(user, "user").otherwise("auto").alias("assigned_by"))
    two = df.where((r % 7 != 0) & (r % 3 == 1)).select(*df.columns, ((r + 5) % 12).cast("int").alias("category"), F.lit(0.55).alias("confidence"), F.lit("auto").alias("assigned_by"))
    return one.unionByName(two)


def active_triage(spark, folder):
    """Mails whose triage is open, by bucket."""
    return triage(spark, folder).where(active()).groupBy("bucket").agg(F.count(F.lit(1)).alias("mails"), F.sum("importance").alias("importance"))


def pending_triage(spark, folder):
    """Mails that wait for triage: without any, or without metadata."""
    t = triage(spark, folder).select("email_rowid", F.col("metadata").isNotNull().alias("ready"))
    e = emails(spark, folder, "account_id")
    return e.join(t, "email_rowid", "left").where(~F.coalesce("ready", F.lit(False))).select("email_rowid", "account_id", F.col("ready").isNull().alias("unclassified"))


def uncategorized(spark, folder):
    """Mails without a category, by account."""
    e = emails(spark, folder, "account_id")
    return e.join(assigned(e).select("email_rowid").distinct(), "email_rowid", "left_anti").groupBy("account_id").agg(F.count(F.lit(1)).alias("mails"), F.min("email_rowid").alias("first_rowid"))


def category_emails(spark, folder):
    """The second page of 20 of category 3's mails, newest first, with all their categories."""
    a = assigned(emails(spark, folder, "date_ms", "indexed_at"))
    page = a.where("category = 3").select("email_rowid", recency().alias("at")).orderBy(F.desc_nulls_last("at"), "email_rowid").offset(20).limit(20)
    every = a.select("email_rowid", "category").join(F.broadcast(page), "email_rowid")
    return every.groupBy("email_rowid", "at").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("category")), lambda c: c.cast("string"))).alias("categories"))


def section() -> Column:
    return F.when((F.col("bucket") == "urgent") | F.col("action_required"), "needs_action").when((F.col("importance") >= 60) & (F.col("bucket") != "spam"), "important").when(F.col("bucket") == "summarize", "summaries").otherwise("low_priority")


def priority_view(spark, folder):
    """The first 50 open mails of each section: by deadline (none last), importance and date."""
    t = triage(spark, folder, "date_ms", "indexed_at").where(active()).withColumn("section", section())
    w = Window.partitionBy("section").orderBy(F.asc_nulls_last("deadline"), F.desc("importance"), F.desc_nulls_last(recency()), "email_rowid")
    return t.withColumn("place", F.row_number().over(w)).where("place <= 50").select("section", "place", "email_rowid", "deadline", "importance")


def triage_upsert(spark, folder):
    """Triage after every second mail was classified anew as personal: classes change, resolutions stay."""
    old = triage(spark, folder).select("email_rowid", "bucket", "importance", "dismissed_at", "done_at", "snoozed_until")
    new = emails(spark, folder).where("email_rowid % 2 = 0").select("email_rowid", F.lit("personal").alias("bucket"), F.lit(50).alias("importance"))
    return merge.keyed_merge(old, new, ["email_rowid"])


RESOLUTIONS = {"dismiss": ("dismissed_at",), "done": ("done_at",), "snooze": ("snoozed_until",), "reset": ()}


def resolved(triage: DataFrame, actions: DataFrame, now: int = NOW) -> DataFrame:
    """triage (email_rowid, dismissed_at, done_at, snoozed_until, ..) after actions (email_rowid, action, until), one a mail: each sets its time and clears the other two; unknown actions change nothing."""
    a = actions.where(F.col("action").isin(*RESOLUTIONS)).select("email_rowid", "action", "until")
    j = triage.join(a, "email_rowid", "left")
    when = {"dismissed_at": F.lit(now), "done_at": F.lit(now), "snoozed_until": F.col("until")}
    out = [F.when(F.col("action").isNull(), F.col(c)).when(F.col("action") == next(k for k, v in RESOLUTIONS.items() if v == (c,)), when[c]).alias(c) if c in when else F.col(c) for c in triage.columns]
    return j.select(*out)


def resolution_update(spark, folder):
    """Open mails by bucket after some were dismissed, done, snoozed for a week or reset."""
    t = triage(spark, folder).select("email_rowid", "bucket", "dismissed_at", "done_at", "snoozed_until")
    names = F.array(*[F.lit(a) for a in (*RESOLUTIONS, "unknown")])
    acts = emails(spark, folder).where("email_rowid % 3 = 0").select("email_rowid", F.element_at(names, (F.col("email_rowid") % 5 + 1).cast("int")).alias("action"), F.lit(NOW + 7 * DAY).alias("until"))
    return resolved(t, acts).groupBy("bucket").agg(F.count_if(active()).alias("open"), F.count("dismissed_at").alias("dismissed"), F.count("done_at").alias("done"), F.count("snoozed_until").alias("snoozed"))


def replaced_assignments(spark, folder):
    """Assignments by category and origin after a user chose category 11 for every mail that 9 divides: all others of these mails went."""
    a = assigned(emails(spark, folder)).select("email_rowid", "category", "confidence", "assigned_by")
    new = emails(spark, folder).where("email_rowid % 9 = 0").select("email_rowid", F.lit(11).alias("category"), F.lit(1.0).alias("confidence"), F.lit("user").alias("assigned_by"))
    return merge.without(a, new, ["email_rowid"]).unionByName(new).groupBy("category", "assigned_by").agg(F.count(F.lit(1)).alias("rows"))


def added_assignments(spark, folder):
    """Assignments by category after automatic ones to category 2 were added for every fourth mail: a user's row stays, an automatic one takes the new confidence."""
    a = assigned(emails(spark, folder)).select("email_rowid", "category", "confidence", "assigned_by")
    new = emails(spark, folder).where("email_rowid % 4 = 2").select("email_rowid", F.lit(2).alias("category"), F.lit(0.9).alias("confidence"), F.lit("auto").alias("assigned_by"))
    order = F.struct((F.col("assigned_by") == "user").cast("int"), "_new")
    rows = a.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    one = rows.groupBy("email_rowid", "category").agg(F.max_by(F.struct("confidence", "assigned_by"), order).alias("r"))
    return one.groupBy("category").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("r.confidence"), 4).alias("confidence"))


def cluster_assignments(spark, folder):
    """What the mails of each stored cluster's account and size class get: categories in order, with confidences from 1 down by a tenth each, a half at least."""
    c = table(spark, folder, "discovered_clusters").where("cluster_id is not null").select("cluster_id", F.array(*[((F.col("cluster_id") + i) % 12).cast("int") for i in range(3)]).alias("ids")).distinct()
    return c.select("cluster_id", F.posexplode("ids").alias("n", "category")).select("cluster_id", "category", F.greatest(F.lit(0.5), F.round(1 - F.col("n") * 0.1, 4)).alias("confidence"), F.lit("auto").alias("assigned_by"))


def hash_bucket(c: str, n: int) -> Column:
    """A number below n from the first 16 bits of a value's MD5."""
    return (F.conv(F.left(F.md5(c), F.lit(4)), 16, 10).cast("int") % n).cast("int")


def replaced_chunks(spark, folder):
    """Passages and their vectors after every third attachment was extracted anew into one passage: the old passages' vectors went with them."""
    c = table(spark, folder, "attachment_chunks").select("chunk_rowid", "attachment_id").distinct()
    again = hash_bucket("attachment_id", 3) == 0
    kept = c.where(~again)
    new = table(spark, folder, "attachments").where((F.col("status") == "extracted") & again).select("attachment_id").distinct()
    v = table(spark, folder, "chunk_embeddings").select("chunk_rowid", T.model_key(F.col("model_id")).alias("model")).distinct().join(kept.select("chunk_rowid").distinct(), "chunk_rowid", "left_semi")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("kind"), "rows")
    return one(kept, "kept").unionByName(one(new, "new")).unionByName(one(v, "vectors"))


def attachment_upsert(spark, folder):
    """Attachments by status after every second one was sent again under a longer name: status and id stay, sizes and names are new, unknown ones are pending."""
    a = table(spark, folder, "attachments").where("attachment_id is not null").groupBy("attachment_id").agg(F.max(F.struct("filename", "size_bytes", "status")).alias("r")).select("attachment_id", "r.*")
    odd = hash_bucket("attachment_id", 2) == 1
    sent = a.where(odd).select(F.when(hash_bucket("attachment_id", 20) == 1, F.concat("attachment_id", F.lit("-new"))).otherwise(F.col("attachment_id")).alias("attachment_id"), F.concat("filename", F.lit(".v2")).alias("filename"), (F.col("size_bytes") + 1).alias("size_bytes"), F.lit("pending").alias("status"))
    m = merge.keyed_merge(a, sent, ["attachment_id"], {"status": merge.keep_old})
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("attachments"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("filename").endswith(".v2")).alias("renamed"))


def status_update(spark, folder):
    """Attachments by status after those of 5,000 bytes or more failed: error set, characters cleared."""
    a = table(spark, folder, "attachments").where("attachment_id is not null").distinct()
    big = F.coalesce(F.col("size_bytes") >= 5_000, F.lit(False))
    return a.select(F.when(big, "error").otherwise(F.col("status")).alias("status"), F.when(big, "too large").otherwise(F.col("last_error")).alias("last_error"), F.when(~big, F.col("char_count")).alias("char_count")).groupBy("status").agg(F.count(F.lit(1)).alias("attachments"), F.count("last_error").alias("errors"), F.sum("char_count").alias("chars"))


def message_attachments(spark, folder):
    """The attachments of each message in order: name, then part."""
    a = table(spark, folder, "attachments").where("attachment_id is not null").select("message_id", "account_id", "attachment_id", "filename", "part_name").distinct()
    w = Window.partitionBy("message_id", "account_id").orderBy(F.asc_nulls_last("filename"), F.asc_nulls_last("part_name"), "attachment_id")
    return a.select("message_id", "account_id", "attachment_id", F.row_number().over(w).alias("place"))


def extracted_names(spark, folder):
    """The names of extracted attachments with their mail's time, the newest 100."""
    a = table(spark, folder, "attachments").where("status = 'extracted' and filename is not null").select("attachment_id", "filename", "message_id", "account_id").distinct()
    e = emails(spark, folder, "message_id", "account_id", "date_ms", "indexed_at").groupBy("message_id", "account_id").agg(F.max(recency()).alias("sent_at"))
    return a.join(e, ["message_id", "account_id"], "left").orderBy(F.desc_nulls_last("sent_at"), "attachment_id", "filename").limit(100).select("attachment_id", "filename", "sent_at")


def permanent_failures(spark, folder):
    """Attachments that failed and whose account failed three times or more, by kind of failure."""
    f = table(spark, folder, "attachments").where("attachment_id is not null and status in ('error', 'unsupported')").select("attachment_id", "account_id", "status").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy("account_id", "status"))
    return f.withColumn("n", n).where("n >= 3").select("attachment_id", "status")


def existing_ids(spark, folder):
    """Of the logged finds' passages those that still exist, and those that are gone."""
    want = table(spark, folder, "chunk_hits").where("chunk_rowid is not null").select("chunk_rowid").distinct()
    have = table(spark, folder, "attachment_chunks").select("chunk_rowid", F.lit(True).alias("there")).distinct()
    return want.join(have, "chunk_rowid", "left").select("chunk_rowid", F.coalesce("there", F.lit(False)).alias("there"))


def point_lookups(spark, folder):
    """The mail of each key (message id, account) that the attachments name, with its vector's time."""
    keys = table(spark, folder, "attachments").select("message_id", "account_id").dropna().distinct()
    e = emails(spark, folder, "message_id", "account_id", "subject")
    v = table(spark, folder, "email_embeddings").where("embedding is not null").groupBy("email_rowid").agg(F.max("created_at").alias("at"))
    return keys.join(e, ["message_id", "account_id"]).join(v, "email_rowid", "left").select("message_id", "account_id", "email_rowid", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("vector_at"))


def account_map(spark, folder):
    """Accounts of a mail program, known by addresses in any case, and the stored accounts that they are."""
    a = accounts(spark, folder).where("address is not null")
    client = a.select(F.upper("address").alias("client_address")).unionByName(a.where("kind = 'work'").select(F.concat(F.lit("x."), "address").alias("client_address"))).distinct()
    stored = a.groupBy(F.lower("address").alias("key")).agg(F.min("account_id").alias("account_id"))
    return client.join(stored, F.lower("client_address") == F.col("key"), "left").select("client_address", "account_id")


def finds_in_range(spark, folder):
    """Keyword finds in their order, of those only the mails dated within a range."""
    hits = emails(spark, folder, "date_ms", n=F.size(F.split(F.lower("body"), "invoice")) - 1).where("n > 0")
    place = F.row_number().over(Window.orderBy(F.desc("n"), "email_rowid"))
    top = hits.orderBy(F.desc("n"), "email_rowid").limit(200).withColumn("place", place)
    return top.where(F.col("date_ms").between(1_720_000_000_000, 1_750_000_000_000)).select("email_rowid", "place")


def bucket_progress(spark, folder):
    """How far each account's triage is: mails, classified, with metadata, and open by bucket."""
    e = emails(spark, folder, "account_id")
    t = triaged(e)
    n = e.groupBy("account_id").agg(F.count(F.lit(1)).alias("mails"))
    g = t.groupBy("account_id").agg(F.count(F.lit(1)).alias("classified"), F.count("metadata").alias("ready"), *[F.count_if((F.col("bucket") == b) & active()).alias(b) for b in BUCKETS])
    return n.join(g, "account_id", "left").select("account_id", "mails", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("classified", "ready", *BUCKETS)])


def patched(df: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df after JSON patches (key, patch): only keys present in a patch change their column, a JSON null clears it; at most one patch a key."""
    j = df.join(patches.select(key, F.from_json("patch", "map<string,string>").alias("_p")), key, "left")
    return j.select(*[F.when(F.map_contains_key("_p", F.lit(c)), F.col("_p")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def patched_accounts(spark, folder):
    """Accounts after patches: personal ones lose their name, work ones are renamed, others stay."""
    a = accounts(spark, folder).where("account_id is not null").select("account_id", "display_name", "kind")
    p = a.where("kind <> 'institutional'").select("account_id", F.when(F.col("kind") == "personal", '{"display_name": null}').otherwise(F.concat(F.lit('{"display_name": "W '), "account_id", F.lit('"}'))).alias("patch")).distinct()
    return patched(a, p, "account_id", ["display_name"])


def job_state(spark, folder):
    """Each account's job after its progress reports: the last one counts, what ran at start-up was interrupted."""
    e = emails(spark, folder, "account_id", "indexed_at")
    reports = e.select("account_id", "indexed_at", F.col("email_rowid").alias("done"), F.when(F.col("email_rowid") % 2 == 0, "running").otherwise("finished").alias("status"))
    last = merge.newest(reports, ["account_id"], ["indexed_at", "done"])
    return last.select("account_id", "done", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status")).alias("status"))


def audit_log(spark, folder):
    """The audit rows that the failures make: one each, in order of time."""
    f = table(spark, folder, "attachments").where("status in ('error', 'unsupported') and indexed_at is not null").select("attachment_id", "account_id", "status", "indexed_at").distinct()
    n = F.row_number().over(Window.partitionBy("account_id").orderBy("indexed_at", "attachment_id"))
    return f.select("account_id", n.alias("entry"), F.to_json(F.struct("attachment_id", "status")).alias("detail"))


def corrections(spark, folder):
    """Each mail's categories that a user's correction adds: those of users' choices that were not users' before."""
    a = assigned(emails(spark, folder)).select("email_rowid", "category", "assigned_by")
    chosen = emails(spark, folder).where("email_rowid % 5 = 0").select("email_rowid", F.explode(F.array_distinct(F.array((F.col("email_rowid") % 12).cast("int"), ((F.col("email_rowid") + 1) % 12).cast("int")))).alias("category"))
    return chosen.join(a.where("assigned_by = 'user'").select("email_rowid", "category"), ["email_rowid", "category"], "left_anti")


def discovery_pool(spark, folder):
    """The pool of a discovery: the newest 300 mails, one a sender domain and the first 300 without a category; each once, with the pool that it came from first."""
    e = emails(spark, folder, "from_addr", "date_ms", "indexed_at")
    newest = e.orderBy(F.desc_nulls_last(recency()), "email_rowid").limit(300).select("email_rowid", F.lit(1).alias("pool"))
    domain = e.select("email_rowid", T.sender_domain(F.col("from_addr")).alias("d")).where("d is not null").groupBy("d").agg(F.min("email_rowid").alias("email_rowid")).select("email_rowid", F.lit(2).alias("pool"))
    free = e.select("email_rowid").join(assigned(e.select("email_rowid")).select("email_rowid").distinct(), "email_rowid", "left_anti").orderBy("email_rowid").limit(300).select("email_rowid", F.lit(3).alias("pool"))
    return newest.unionByName(domain).unionByName(free).groupBy("email_rowid").agg(F.min("pool").alias("pool"))


QUERIES = {f.__name__: f for f in (active_triage, pending_triage, uncategorized, category_emails, priority_view, triage_upsert, resolution_update, replaced_assignments, added_assignments, cluster_assignments, replaced_chunks, attachment_upsert, status_update, message_attachments, extracted_names, permanent_failures, existing_ids, point_lookups, account_map, finds_in_range, bucket_progress, patched_accounts, job_state, audit_log, corrections, discovery_pool)}

_E = "with " + EMAILS_SQL
_T = f"""t as (select e.*, (['{"', '".join(BUCKETS)}'])[email_rowid % 5 + 1] as bucket, cast(email_rowid * 37 % 101 as int) as importance, case when email_rowid % 3 = 0 then {NOW} + (email_rowid % 41 - 20) * {DAY} end as deadline, email_rowid % 4 = 1 as action_required,
case when email_rowid % 11 = 0 then {NOW - DAY} end as dismissed_at, case when email_rowid % 13 = 0 then {NOW - 2 * DAY} end as done_at, case when email_rowid % 6 = 1 then {NOW} + (email_rowid % 9 - 4) * {DAY} end as snoozed_until, email_rowid % 10 <> 1 as ready from e where email_rowid % 5 <> 0)"""
_OPEN = f"(dismissed_at is null and done_at is null and (snoozed_until is null or snoozed_until <= {NOW}))"
_A = """a as (select email_rowid, cast(email_rowid % 12 as int) as category, case when email_rowid % 4 = 0 then 1.0 else 0.5 + (email_rowid % 5) / 10 end as confidence, case when email_rowid % 4 = 0 then 'user' else 'auto' end as assigned_by from e where email_rowid % 7 <> 0
union all select email_rowid, cast((email_rowid + 5) % 12 as int), 0.55, 'auto' from e where email_rowid % 7 <> 0 and email_rowid % 3 = 1)"""
_AT = "coalesce(date_ms, epoch_ms(indexed_at))"
_DOMAIN = r"nullif(regexp_extract(lower(from_addr), '@([^@\s>]+)[^@]*$', 1), '')"
_MODEL = "regexp_replace(trim(model_id), '(?i):latest$', '')"

_bucket = lambda n: f"(('0x' || substr(md5(attachment_id), 1, 4))::int % {n})"

ORACLE_SQL = {
    "active_triage": f"{_E}, {_T} select bucket, count(*) as mails, cast(sum(importance) as bigint) as importance from t where {_OPEN} group by bucket",
    "pending_triage": f"{_E}, {_T} select e.email_rowid, e.account_id, t.email_rowid is null as unclassified from e left join t using (email_rowid) where not coalesce(ready, false)",
    "uncategorized": f"{_E} select account_id, count(*) as mails, min(email_rowid) as first_rowid from e where email_rowid % 7 = 0 group by 1",
    "category_emails": f"{_E}, {_A}, p as (select email_rowid, {_AT} as sent from a join e using (email_rowid) where category = 3 order by sent desc nulls last, email_rowid limit 20 offset 20) select email_rowid, sent as at, list_aggregate(list_sort(list(distinct category)), 'string_agg', ',') as categories from p join a using (email_rowid) group by all",
    "priority_view": f"""{_E}, {_T}, s as (select *, case when bucket = 'urgent' or action_required then 'needs_action' when importance >= 60 and bucket <> 'spam' then 'important' when bucket = 'summarize' then 'summaries' else 'low_priority' end as section from t where {_OPEN})
select section, place, email_rowid, deadline, importance from (select *, row_number() over (partition by section order by deadline asc nulls last, importance desc, {_AT} desc nulls last, email_rowid) as place from s) where place <= 50""",
    "triage_upsert": f"{_E}, {_T} select e.email_rowid, case when e.email_rowid % 2 = 0 then 'personal' else bucket end as bucket, case when e.email_rowid % 2 = 0 then 50 else importance end as importance, dismissed_at, done_at, snoozed_until from e left join t using (email_rowid) where e.email_rowid % 2 = 0 or t.email_rowid is not null",
    "resolution_update": f"""{_E}, {_T}, r as (select email_rowid, bucket, email_rowid % 3 = 0 and email_rowid % 5 < 4 as acts, email_rowid % 5 as act, dismissed_at as a, done_at as b, snoozed_until as c from t),
u as (select bucket, case when not acts then a when act = 0 then {NOW} end as dismissed_at, case when not acts then b when act = 1 then {NOW} end as done_at, case when not acts then c when act = 2 then {NOW + 7 * DAY} end as snoozed_until from r)
select bucket, count(*) filter (where {_OPEN}) as open, count(dismissed_at) as dismissed, count(done_at) as done, count(snoozed_until) as snoozed from u group by bucket""",
    "replaced_assignments": f"{_E}, {_A}, u as (select category, assigned_by from a where email_rowid % 9 <> 0 union all select 11, 'user' from e where email_rowid % 9 = 0) select category, assigned_by, count(*) as rows from u group by all",
    "added_assignments": f"""{_E}, {_A}, u as (select *, 0 as fresh from a union all select email_rowid, 2, 0.9, 'auto', 1 from e where email_rowid % 4 = 2), k as (select *, row_number() over (partition by email_rowid, category order by (assigned_by = 'user') desc, fresh desc, confidence desc) as k from u)
select category, count(*) as rows, round(sum(confidence), 4) as confidence from k where k = 1 group by 1""",
    "cluster_assignments": "with c as (select distinct cluster_id from discovered_clusters where cluster_id is not null), n as (select cluster_id, unnest([0, 1, 2]) as n from c) select cluster_id, cast((cluster_id + n) % 12 as int) as category, greatest(0.5, round(1 - n * 0.1, 4)) as confidence, 'auto' as assigned_by from n",
    "replaced_chunks": f"with c as (select distinct chunk_rowid, attachment_id from attachment_chunks), k as (select * from c where {_bucket(3)} <> 0), n as (select distinct attachment_id from attachments where status = 'extracted' and {_bucket(3)} = 0), v as (select distinct chunk_rowid, {_MODEL} as model from chunk_embeddings where chunk_rowid in (select chunk_rowid from k)) select 'kept' as kind, count(*) as rows from k union all select 'new', count(*) from n union all select 'vectors', count(*) from v",
    "attachment_upsert": f"""with a0 as (select *, row_number() over (partition by attachment_id order by filename desc nulls last, size_bytes desc nulls last, status desc nulls last) as k from attachments where attachment_id is not null), a as (select attachment_id, filename, size_bytes, status from a0 where k = 1),
p as (select case when {_bucket(20)} = 1 then attachment_id || '-new' else attachment_id end as id, filename || '.v2' as filename, size_bytes + 1 as size_bytes from a where {_bucket(2)} = 1),
m as (select coalesce(a.status, case when a.attachment_id is null then 'pending' end) as status, case when p.id is null then a.filename else p.filename end as filename, case when p.id is null then a.size_bytes else p.size_bytes end as size_bytes from a full join p on a.attachment_id = p.id)
select status, count(*) as attachments, cast(sum(size_bytes) as bigint) as bytes, count(*) filter (where filename like '%.v2') as renamed from m group by 1""",
    "message_attachments": "with a as (select distinct message_id, account_id, attachment_id, filename, part_name from attachments where attachment_id is not null) select message_id, account_id, attachment_id, row_number() over (partition by message_id, account_id order by filename nulls last, part_name nulls last, attachment_id) as place from a",
    "status_update": "with a as (select distinct * from attachments where attachment_id is not null), u as (select *, coalesce(size_bytes >= 5000, false) as big from a) select case when big then 'error' else status end as status, count(*) as attachments, count(case when big then 'x' else last_error end) as errors, cast(sum(case when not big then char_count end) as bigint) as chars from u group by 1",
    "extracted_names": f"{_E}, a as (select distinct attachment_id, filename, message_id, account_id from attachments where status = 'extracted' and filename is not null), m as (select message_id, account_id, max({_AT}) as sent_at from e group by all) select attachment_id, filename, sent_at from a left join m using (message_id, account_id) order by sent_at desc nulls last, attachment_id, filename limit 100",
    "permanent_failures": "with f as (select distinct attachment_id, account_id, status from attachments where attachment_id is not null and status in ('error', 'unsupported')) select attachment_id, status from (select *, count(*) over (partition by account_id, status) as n from f) where n >= 3",
    "existing_ids": "with w as (select distinct chunk_rowid from chunk_hits where chunk_rowid is not null) select chunk_rowid, chunk_rowid in (select chunk_rowid from attachment_chunks where chunk_rowid is not null) as there from w",
    "point_lookups": f"{_E}, k as (select distinct message_id, account_id from attachments where message_id is not null and account_id is not null), v as (select email_rowid, max(created_at) as seen from email_embeddings where embedding is not null group by 1) select k.message_id, k.account_id, e.email_rowid, strftime(seen, '%Y-%m-%d %H:%M:%S') as vector_at from k join e on e.message_id = k.message_id and e.account_id = k.account_id left join v on v.email_rowid = e.email_rowid",
    "account_map": "with a as (select distinct * from accounts where address is not null), c as (select distinct upper(address) as client_address from a union select 'x.' || address from a where kind = 'work'), s as (select lower(address) as key, min(account_id) as account_id from a group by 1) select client_address, account_id from c left join s on lower(client_address) = key",
    "finds_in_range": f"{_E}, h as (select email_rowid, date_ms, len(string_split(lower(body), 'invoice')) - 1 as n from e), t as (select *, row_number() over (order by n desc, email_rowid) as place from h where n > 0) select email_rowid, place from t where place <= 200 and date_ms between 1720000000000 and 1750000000000",
    "bucket_progress": f"{_E}, {_T}, n as (select account_id, count(*) as mails from e group by 1), g as (select account_id, count(*) as classified, count(*) filter (where ready) as ready, " + ", ".join(f"count(*) filter (where bucket = '{b}' and {_OPEN}) as \"{b}\"" for b in BUCKETS) + " from t group by 1) select account_id, mails, " + ", ".join(f"coalesce(\"{c}\", 0) as \"{c}\"" for c in ("classified", "ready", *BUCKETS)) + " from n left join g using (account_id)",
    "patched_accounts": "with a as (select distinct * from accounts where account_id is not null) select account_id, case kind when 'personal' then null when 'work' then 'W ' || account_id else display_name end as display_name, kind from a",
    "job_state": f"{_E}, r as (select account_id, email_rowid as done, row_number() over (partition by account_id order by indexed_at desc nulls last, email_rowid desc) as k from e) select account_id, done, case when done % 2 = 0 then 'interrupted' else 'finished' end as status from r where k = 1",
    "audit_log": "with f as (select distinct attachment_id, account_id, status, indexed_at from attachments where status in ('error', 'unsupported') and indexed_at is not null) select account_id, row_number() over (partition by account_id order by indexed_at, attachment_id) as entry, '{\"attachment_id\":\"' || attachment_id || '\",\"status\":\"' || status || '\"}' as detail from f",
    "corrections": f"{_E}, {_A}, c as (select distinct email_rowid, cast(unnest([email_rowid % 12, (email_rowid + 1) % 12]) as int) as category from e where email_rowid % 5 = 0) select email_rowid, category from c where not exists (select 1 from a where a.email_rowid = c.email_rowid and a.category = c.category and assigned_by = 'user')",
    "discovery_pool": f"""{_E}, n as (select email_rowid, 1 as pool from e order by {_AT} desc nulls last, email_rowid limit 300), d as (select min(email_rowid) as email_rowid, 2 as pool from e where {_DOMAIN} is not null group by {_DOMAIN}), f as (select email_rowid, 3 as pool from e where email_rowid % 7 = 0 order by email_rowid limit 300)
select email_rowid, min(pool) as pool from (select * from n union all select * from d union all select * from f) group by 1""",
}
