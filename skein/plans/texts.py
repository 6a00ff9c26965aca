"""Text operators over mails, file names and accounts, and the reading of model answers; and their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import answers
from skein.functions import text as T
from skein.plans.mail import EMAILS_SQL, accounts, emails
from skein.sources import table
from skein.streaming import incremental

#: Words without meaning for a label, and second-level domain labels that name no sender.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the to was with de la le les et du des un une en pour au aux der die das und ein eine im mit zu von el los las y por para con del".split()
GENERIC = "gmail outlook hotmail yahoo gmx icloud mail email example test".split()


def chunked_texts(spark, folder):
    """Every mail's body and every passage in overlapping chunks of 1,200 characters: each chunk's length and hash."""
    def of(name, kind, key, text):
        one = table(spark, folder, name).where(f"{key} is not null").groupBy(F.col(key).alias("item_rowid")).agg(F.max(text).alias("text"))
        return one.select(F.lit(kind).alias("item_kind"), "item_rowid", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "chunk"))

    both = of("emails", "email", "email_rowid", "body").unionByName(of("attachment_chunks", "chunk", "chunk_rowid", "text"))
    return both.select("item_kind", "item_rowid", "chunk_no", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


def filename_words(spark, folder):
    """File names as words, and how many files share them."""
    a = table(spark, folder, "attachments").where("filename is not null").select("attachment_id", "filename").distinct()
    return a.groupBy(T.filename_words(F.col("filename")).alias("words")).agg(F.count(F.lit(1)).alias("files"), F.min("filename").alias("first_name"))


def significant_tokens(spark, folder):
    """The words of all subjects that are no stop words, with their mails."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("subject"), F.lit("([a-z0-9]+)"), 1), lambda w: ~w.isin(STOP_WORDS)))
    return emails(spark, folder, "subject").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("mails"))


def brand_tokens(spark, folder):
    """The second-level labels, of three letters or more and not generic, of each account's 15 commonest sender domains."""
    d = emails(spark, folder, "account_id", "from_addr").select("account_id", T.sender_domain(F.col("from_addr")).alias("domain")).where("domain is not null")
    n = d.groupBy("account_id", "domain").agg(F.count(F.lit(1)).alias("mails"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("mails"), "domain"))).where("k <= 15")
    label = F.try_element_at(F.split("domain", r"\."), F.lit(-2))
    return top.select("account_id", label.alias("brand")).where((F.length("brand") >= 3) & ~F.col("brand").isin(GENERIC)).distinct()


def folder_names(spark, folder):
    """Subjects as names of folders, and how many subjects share them."""
    s = emails(spark, folder, "subject").select("subject").where("subject is not null").distinct()
    return s.groupBy(T.folder_name(F.col("subject")).alias("folder_name")).agg(F.count(F.lit(1)).alias("subjects"))


def tag_keys(spark, folder):
    """Accounts' names as keys of tags."""
    return accounts(spark, folder).select("account_id", T.tag_key("skein-", F.coalesce("display_name", F.lit(""))).alias("tag_key"))


def label_words(spark, folder):
    """Subjects as keys: without accents, words parted by '_', 60 characters; how many subjects share each."""
    s = emails(spark, folder, "subject").select("subject").where("subject is not null").distinct()
    return s.groupBy(T.canonical_key(F.col("subject")).alias("label_key")).agg(F.count(F.lit(1)).alias("subjects"))


def message_hash(spark, folder):
    """A hash of each mail with its attachments and their passages, by which a cached summary of all of it is known to be current."""
    a = table(spark, folder, "attachments").where("filename is not null").select("message_id", "account_id", "filename").distinct().groupBy("message_id", "account_id").agg(F.concat_ws("|", F.array_sort(F.collect_list("filename"))).alias("files"))
    c = table(spark, folder, "attachment_chunks").where("text is not null").select("message_id", "account_id", F.md5("text").alias("h")).distinct().groupBy("message_id", "account_id").agg(F.concat_ws("|", F.array_sort(F.collect_list("h"))).alias("chunks"))
    e = emails(spark, folder, "message_id", "account_id", h=F.md5(F.concat_ws("|", F.coalesce("subject", F.lit("")), F.coalesce("from_addr", F.lit("")), F.coalesce("body", F.lit("")))))
    j = e.join(a, ["message_id", "account_id"], "left").join(c, ["message_id", "account_id"], "left")
    return j.select("email_rowid", F.sha2(F.concat_ws("\n", "h", F.coalesce("files", F.lit("")), F.coalesce("chunks", F.lit(""))), 256).alias("hash"))


def json_rows(spark, folder):
    """Accounts as JSON lines and read back: what was written is what is read."""
    a = accounts(spark, folder).select("account_id", "display_name", "exclude_from_discovery")
    lines = a.select(F.to_json(F.struct(*a.columns), {"ignoreNullFields": "false"}).alias("line"))
    return lines.select(F.from_json("line", a.schema).alias("r")).select("r.*")


def model_answers(spark, folder) -> DataFrame:
    """Answers such as a model gives for every event: plain, fenced, after a reasoning block, wrapped, truncated or none."""
    k = F.col("event_id")
    core = F.concat(F.lit("["), (k % 7).cast("string"), F.lit(", "), (k % 5).cast("string"), F.lit("]"))
    answer = (
        F.when(k % 6 == 0, F.concat(F.lit("["), core, F.lit(", []]"))).when(k % 6 == 1, F.concat(F.lit("```json\n["), core, F.lit(", 3]\n```"))).when(k % 6 == 2, F.concat(F.lit('<think>[9]</think>{"1": '), core, F.lit(', "2": []}')))
        .when(k % 6 == 3, F.concat(F.lit('{"answers": {"0": '), core, F.lit("}}"))).when(k % 6 == 4, F.concat(F.lit("[["), (k % 7).cast("string"))).otherwise(F.lit("no answer"))
    )
    return table(spark, folder, "events").select("event_id", answer.alias("answer"))


def batch_answers(spark, folder):
    """What two questions of each batch were answered: lists of numbers, null without an answer."""

    def read(batches):
        for b in batches:
            got = [answers.batch_answers(t, 2) for t in b["answer"].to_pylist()]
            text = lambda v: None if v is None else ",".join(map(str, v))
            yield pa.RecordBatch.from_arrays([b["event_id"], *[pa.array([text(g[i]) for g in got], pa.string()) for i in (0, 1)]], ["event_id", "first", "second"])

    return model_answers(spark, folder).mapInArrow(read, "event_id long, first string, second string")


def rerank_orders(spark, folder):
    """The order in which each answer puts five finds: valid numbers once, then the rest as they stood."""

    def read(batches):
        for b in batches:
            got = [",".join(map(str, answers.rerank_order(t, 5))) for t in b["answer"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["event_id"], pa.array(got, pa.string())], ["event_id", "places"])

    return model_answers(spark, folder).mapInArrow(read, "event_id long, places string")


def stream_reasoning(spark, folder):
    """Characters of answer and reasoning in each type's output stream, pieced by events and replayed as a stream with state."""
    log = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "*events.parquet").parquet(folder)
    k = F.col("event_id")
    piece = F.when(k % 4 == 0, "say <thi").when(k % 4 == 1, "nk>deep ").when(k % 4 == 2, "thought</think").otherwise(">done. ")
    parts = incremental.split_streams(log.select((k - k % 4).cast("string").alias("stream_id"), k.alias("seq"), piece.alias("text")))
    got = incremental.replayed(parts, "append", "stream_id string, seq long, kind string, piece string")
    return got.groupBy("kind").agg(F.sum(F.length("piece")).alias("chars"), F.count_distinct("stream_id").alias("streams"))


QUERIES = {f.__name__: f for f in (chunked_texts, filename_words, significant_tokens, brand_tokens, folder_names, tag_keys, label_words, message_hash, json_rows, batch_answers, rerank_orders, stream_reasoning)}

_E = "with " + EMAILS_SQL
_DOMAIN = r"nullif(regexp_extract(lower(from_addr), '@([^@\s>]+)[^@]*$', 1), '')"
_list = lambda words: ", ".join(f"'{w}'" for w in words)
_last = lambda s: f"case when contains(w, {s}) then length(w) - strpos(reverse(w), reverse({s})) - length({s}) + 1 else -1 end"
_K = "event_id % 7 as a, event_id % 5 as b, event_id % 6 as m"

ORACLE_SQL = {
    "chunked_texts": rf"""with recursive i as (select 'email' as item_kind, email_rowid as item_rowid, max(body) as text from emails where email_rowid is not null group by 2 union all select 'chunk', chunk_rowid, max(text) from attachment_chunks where chunk_rowid is not null group by 2),
n as (select item_kind, item_rowid, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x0b\x1c-\x1f\x{{85}}\pZ]+|[\s\x0b\x1c-\x1f\x{{85}}\pZ]+$', '', 'g') as t from i where text is not null),
s as (select item_kind, item_rowid, t, 0 as chunk_no, cast(0 as bigint) as start, cast(-1 as bigint) as done from n where length(t) > 0 union all select item_kind, item_rowid, t, chunk_no + 1, greatest(stop - 150, start + 1), stop from (
  select *, case when start + 1200 >= length(t) then length(t) when brk > 600 then start + brk else start + 1200 end as stop from (
    select *, case when pp > -1 then pp + 2 when ss > -1 then ss + 1 when sp > -1 then sp + 1 else length(w) end as brk from (
      select *, {_last("chr(10) || chr(10)")} as pp, greatest({_last("'. '")}, {_last("'? '")}, {_last("'! '")}, {_last("'.' || chr(10)")}) as ss, {_last("' '")} as sp from (select *, substr(t, start + 1, 1200) as w from s)))) where stop < length(t) and length(t) > 1200),
c as (select *, lead(done) over (partition by item_kind, item_rowid order by chunk_no) as stop from s), p as (select item_kind, item_rowid, chunk_no, regexp_replace(substr(t, start + 1, coalesce(stop, length(t)) - start), '^[\s\x0b\x1c-\x1f\x{{85}}\pZ]+|[\s\x0b\x1c-\x1f\x{{85}}\pZ]+$', '', 'g') as x from c)
select item_kind, item_rowid, row_number() over (partition by item_kind, item_rowid order by chunk_no) - 1 as chunk_no, length(x) as chars, md5(x) as chunk_md5 from p where length(x) > 0""",
    "filename_words": r"with a as (select distinct attachment_id, filename from attachments where filename is not null) select trim(regexp_replace(lower(strip_accents(regexp_replace(filename, '(\p{Ll}|\d)(\p{Lu})', '\1 \2', 'g'))), '[^a-z0-9]+', ' ', 'g')) as words, count(*) as files, min(filename) as first_name from a group by 1",
    "significant_tokens": f"{_E}, w as (select email_rowid, unnest(list_distinct(regexp_extract_all(lower(subject), '[a-z0-9]+'))) as word from e) select word, count(*) as mails from w where word not in ({_list(STOP_WORDS)}) group by 1",
    "brand_tokens": f"{_E}, n as (select account_id, {_DOMAIN} as domain, count(*) as mails from e where {_DOMAIN} is not null group by all), t as (select *, row_number() over (partition by account_id order by mails desc, domain) as k from n), b as (select account_id, string_split(domain, '.')[-2] as brand from t where k <= 15) select distinct account_id, brand from b where length(brand) >= 3 and brand not in ({_list(GENERIC)})",
    "folder_names": rf"{_E}, s as (select distinct subject from e where subject is not null), f as (select left(trim(regexp_replace(regexp_replace(subject, '[/\\]', '-', 'g'), '\s+', ' ', 'g')), 100) as n from s) select coalesce(nullif(n, ''), 'Category') as folder_name, count(*) as subjects from f group by 1",
    "tag_keys": "with a as (select distinct * from accounts) select account_id, regexp_replace(lower('skein-' || coalesce(display_name, '')), '[^a-z0-9_-]', '_', 'g') as tag_key from a",
    "label_words": f"{_E}, s as (select distinct subject from e where subject is not null) select coalesce(nullif(left(replace(trim(regexp_replace(lower(strip_accents(subject)), '[^a-z0-9]+', ' ', 'g')), ' ', '_'), 60), ''), 'category') as label_key, count(*) as subjects from s group by 1",
    "message_hash": f"""{_E}, a as (select message_id, account_id, string_agg(distinct filename, '|' order by filename) as files from attachments where filename is not null group by all), c as (select message_id, account_id, string_agg(distinct md5(text), '|' order by md5(text)) as chunks from attachment_chunks where text is not null group by all)
select email_rowid, sha256(md5(concat_ws('|', coalesce(subject, ''), coalesce(from_addr, ''), coalesce(body, ''))) || chr(10) || coalesce(files, '') || chr(10) || coalesce(chunks, '')) as hash from e left join a using (message_id, account_id) left join c using (message_id, account_id)""",
    "json_rows": "select distinct account_id, display_name, exclude_from_discovery from accounts",
    "batch_answers": f"with k as (select event_id, {_K} from events) select event_id, case when m < 4 then a || ',' || b end as first, case m when 0 then '' when 1 then '3' when 2 then '' end as second from k",
    "rerank_orders": f"with k as (select event_id, {_K} from events), w as (select event_id, case when m < 4 then [a, b] || (case when m = 1 then [3] else [] end) else [] end as w from k), v as (select event_id, list_filter(list_filter(w, lambda x: x < 5), lambda x, i: list_position(list_filter(w, lambda y: y < 5), x) = i) as v from w) select event_id, array_to_string(v || list_filter([0, 1, 2, 3, 4], lambda x: not list_contains(v, x)), ',') as places from v",
    "stream_reasoning": "with s as (select event_id - event_id % 4 as s, list(event_id % 4 order by event_id) as p from events group by 1) select 'answer' as kind, cast(sum(case when p = [0, 1, 2, 3] then 10 end) as bigint) as chars, count(*) as streams from s union all select 'think', cast(sum(12) as bigint), count(*) from s",
}
