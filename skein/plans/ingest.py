"""What comes in and goes out: folders, parts of messages, moves, event lines, queues and retries; and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.plans.mail import EMAILS_SQL, emails, recency
from skein.plans.state import NOW
from skein.runtime import scratch
from skein.sources import mime, table


def folder_tree(spark, folder):
    """Every folder above or at a mail's folder, with its depth and the mails in and below it."""
    parts = F.split(F.trim("folder"), "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    e = emails(spark, folder, "folder").where("folder is not null").select(F.explode(paths).alias("path"))
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("mails")).withColumn("depth", F.size(F.split("path", "/")))


def message_parts(spark, folder):
    """Mails with their parts: a text part (blank for row ids that 3 divides), an HTML part, a picture, and for row ids that 5 divides a file."""
    part = lambda kind, body, name, how: F.struct(F.lit(kind).alias("content_type"), body.cast("string").alias("body"), F.lit(name).cast("string").alias("filename"), F.lit(how).cast("string").alias("disposition"))
    r = F.col("email_rowid")
    parts = F.array(
        part("TEXT/plain", F.when(r % 3 != 0, F.left("subject", F.lit(20))).otherwise(F.lit(" ")), None, None), part("text/html", F.concat(F.lit("<p>"), F.left("subject", F.lit(20))), None, None),
        part("image/png", F.lit("x"), "logo.png", "inline"), F.when(r % 5 == 0, part("application/pdf", F.lit("x"), "a.pdf", None)).otherwise(part("text/plain", F.lit(""), "note.txt", None)),
    )
    return emails(spark, folder, "subject").select("email_rowid", parts.cast(mime.PARTS).alias("parts"))


def mime_bodies(spark, folder):
    """Each message's body, its format and whether it has attachments, from its parts."""
    p = F.col("parts")
    return message_parts(spark, folder).select("email_rowid", mime.body_text(p).alias("body"), mime.body_format(p).alias("format"), mime.has_attachments(p).alias("attached"))


def folder_moves(spark, folder):
    """The moves of an account's mails to the folder of their sender's domain, in batches of 100, newest first."""
    e = emails(spark, folder, "account_id", "from_addr", "date_ms", "indexed_at").select("email_rowid", "account_id", T.folder_name(T.sender_domain(F.col("from_addr"))).alias("target"), recency().alias("sent_at"))
    n = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc_nulls_last("sent_at"), "email_rowid"))
    return e.select("email_rowid", "account_id", "target", F.floor((n - 1) / 100).alias("batch"))


def event_lines(spark, folder):
    """The events written as JSON lines and read back: events and value by type."""
    path = f"{scratch(spark)}/lines"
    src = table(spark, folder, "events").select("event_id", "event_type", "value", "props")
    src.select(F.to_json(F.struct(*src.columns)).alias("value")).write.text(path)
    back = spark.read.schema(src.schema).json(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"), F.count_if(F.get_json_object("props", "$.k").isNotNull()).alias("with_k"))


def recent_queue(spark, folder, most: int = 20):
    """Each event type's queue of users to look at: every user once, at their last event, the newest 20."""
    last = table(spark, folder, "events").groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("m")))
    return last.select("event_type", "user_id", F.col("m.event_id").alias("event_id"), n.alias("place")).where(F.col("place") <= most)


def retry_schedule(spark, folder):
    """When each account's failed attachments are tried again: after 15 s, doubled with each failure, 5 minutes at most."""
    f = table(spark, folder, "attachments").distinct().where("status = 'error'").groupBy("account_id").agg(F.count(F.lit(1)).alias("failures"))
    return f.withColumn("wait_seconds", F.least(F.lit(300.0), 15 * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(20)))))


def deadline_instants(spark, folder):
    """The instants of deadlines given in hours (a tenth of each event's value): more than 0, at most 720, rounded; null for others."""
    h = F.col("value") / 10
    return table(spark, folder, "events").select("event_id", F.when((h > 0) & (h <= 720), F.lit(NOW) + F.floor(h + 0.5) * 3_600_000).alias("deadline"))


def folded_threads(spark, folder):
    """How many turns of each thread are folded into its summary: once more than 8 are not, all but the last 6."""
    thread = F.lower(F.trim(F.regexp_replace("subject", "(?i)^((re|aw|fwd) *: *)+", "")))
    n = emails(spark, folder, "account_id", thread=thread).where(F.length("thread") > 0).groupBy("account_id", "thread").agg(F.count(F.lit(1)).alias("turns"))
    return n.withColumn("folded", F.when(F.col("turns") > 8, F.col("turns") - 6).otherwise(0))


QUERIES = {f.__name__: f for f in (folder_tree, mime_bodies, folder_moves, event_lines, recent_queue, retry_schedule, deadline_instants, folded_threads)}

_E = "with " + EMAILS_SQL
_DOMAIN = r"nullif(regexp_extract(lower(from_addr), '@([^@\s>]+)[^@]*$', 1), '')"

ORACLE_SQL = {
    "folder_tree": f"{_E}, p as (select string_split(trim(folder), '/') as parts from e where folder is not null), x as (select parts, unnest(range(1, len(parts) + 1)) as n from p) select array_to_string(parts[1:n], '/') as path, count(*) as mails, len(string_split(array_to_string(parts[1:n], '/'), '/')) as depth from x group by 1",
    "mime_bodies": f"{_E} select email_rowid, case when email_rowid % 3 <> 0 and length(trim(left(subject, 20))) > 0 then left(subject, 20) else '<p>' || left(subject, 20) end as body, case when email_rowid % 3 <> 0 and length(trim(left(subject, 20))) > 0 then 'text' when subject is not null then 'html' end as format, email_rowid % 5 = 0 as attached from e",
    "folder_moves": f"{_E} select email_rowid, account_id, coalesce(nullif(left({_DOMAIN}, 100), ''), 'Category') as target, (row_number() over (partition by account_id order by coalesce(date_ms, epoch_ms(indexed_at)) desc nulls last, email_rowid) - 1) // 100 as batch from e",
    "event_lines": "select event_type, count(*) as events, round(sum(value), 4) as value, count(json_extract_string(props, '$.k')) as with_k from events group by 1",
    "recent_queue": "with l as (select event_type, user_id, arg_max(event_id, (ts, event_id)) as event_id, max((ts, event_id)) as m from events group by 1, 2), k as (select *, row_number() over (partition by event_type order by m desc) as place from l) select event_type, user_id, event_id, place from k where place <= 20",
    "retry_schedule": "with f as (select account_id, count(*) as failures from (select distinct * from attachments where status = 'error') group by 1) select account_id, failures, least(300.0, 15 * pow(2.0, least(failures - 1, 20))) as wait_seconds from f",
    "deadline_instants": f"select event_id, case when value / 10 > 0 and value / 10 <= 720 then {NOW} + cast(floor(value / 10 + 0.5) as bigint) * 3600000 end as deadline from events",
    "folded_threads": f"{_E}, t as (select account_id, lower(trim(regexp_replace(subject, '(?i)^((re|aw|fwd) *: *)+', ''))) as thread from e) select account_id, thread, count(*) as turns, case when count(*) > 8 then count(*) - 6 else 0 end as folded from t where length(thread) > 0 group by all",
}
