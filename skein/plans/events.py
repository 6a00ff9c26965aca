"""Queries over the event log, read as a triage of messages: account = user_id, bucket by event type, importance = props.k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.runtime import scratch
from skein.sources import table
from skein.streaming import incremental

DAY_START = "2024-01-15 00:00:00"
BUCKETS = ("urgent", "personal", "summarize", "spam", "newsletter")
PURPOSE = {"error": "urgent", "purchase": "personal", "view": "summarize", "click": "summarize", "signup": "spam"}


def triage(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, user_id, ts, bucket, value, importance, action_required); importance is 0 where the JSON lacks it."""
    bucket = F.element_at(F.create_map(*[F.lit(x) for kv in PURPOSE.items() for x in kv]), F.col("event_type"))
    importance = F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    return table(spark, folder, "events").select("event_id", "user_id", "ts", bucket.alias("bucket"), "value", importance.alias("importance"), (F.col("value") > 60).alias("action_required"))


def section():
    """Four sections that exclude each other."""
    return F.when((F.col("bucket") == "urgent") | F.col("action_required"), "needs_action").when((F.col("importance") >= 60) & (F.col("bucket") != "spam"), "important").when(F.col("bucket") == "summarize", "summaries").otherwise("low_priority")


def bucket_counts(spark, folder):
    """Events by bucket, buckets without events included."""
    dim = spark.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    n = triage(spark, folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("events"))


def section_counts(spark, folder):
    """Each user's sections in one pass; urgent overlaps the others."""
    s = section()
    return triage(spark, folder).groupBy("user_id").agg(*[F.count_if(s == x).alias(x) for x in ("needs_action", "important", "summaries", "low_priority")], F.count_if(F.col("bucket") == "urgent").alias("urgent"))


def priority_list(spark, folder):
    """The first 5 of each section on a day, by importance and time."""
    t = triage(spark, folder).where((F.col("ts") >= F.lit(DAY_START).cast("timestamp")) & (F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp"))).withColumn("section", section())
    w = Window.partitionBy("section").orderBy(F.desc("importance"), F.desc("ts"), "event_id")
    return t.withColumn("place", F.row_number().over(w)).where("place <= 5").select("section", "place", "event_id", "importance")


def carry_over(spark, folder):
    """Open actions of the 14 days before a day, the 50 most important."""
    since, until = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit(DAY_START).cast("timestamp")
    t = triage(spark, folder).where("action_required").where((F.col("ts") >= since) & (F.col("ts") < until))
    return t.orderBy(F.desc("importance"), F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "importance")


def json_importance(spark, folder):
    """Mean importance by bucket."""
    return triage(spark, folder).groupBy("bucket").agg(F.round(F.avg("importance"), 6).alias("importance"), F.count_if(F.col("importance") == 0).alias("without"))


def dashboard_counts(spark, folder):
    """Totals of the log and of its last day."""
    t = triage(spark, folder)
    last = t.agg(F.max("ts").alias("last"))
    return t.crossJoin(F.broadcast(last)).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("bucket") == "urgent").alias("urgent"), F.count_if(F.col("ts") > F.col("last") - F.expr("interval 1 day")).alias("last_day"))


def event_tumbling(spark, folder):
    """Events and value by day and type."""
    w = F.window("ts", "1 day")
    return table(spark, folder, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


def event_sessions(spark, folder):
    """Each user's sessions, ended by six hours without events."""
    s = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first"))
    return s.select("user_id", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


def running_bucket_counts(spark, folder):
    """Each user's running count by bucket and time."""
    w = Window.partitionBy("user_id", "bucket").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return triage(spark, folder).select("event_id", "bucket", F.count(F.lit(1)).over(w).alias("so_far"))


def pending(spark, folder):
    """Events that no later event of their user follows within a day."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, folder, "events").withColumn("next", F.lead("ts").over(w))
    return t.where(F.col("next").isNull() | (F.col("next") > F.col("ts") + F.expr("interval 1 day"))).select("event_id", "user_id")


def priced_orders(spark, folder):
    """Revenue and customers by nation and year of order."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    line = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).alias("revenue"))
    # lines are summed by order before the join
    by = line.groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"))
    j = o.join(by, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("revenue").cast("double").alias("revenue"), F.count_distinct("o_custkey").alias("customers"))


def stream_bucket_counts(spark, folder):
    """The running counts by bucket after the log was replayed as a stream of files."""
    counts = incremental.running_counts(triage_stream(spark, folder), "bucket")
    return incremental.replayed(counts, "complete", "bucket string, events long")


def stream_sessions(spark, folder):
    """Each user's sessions, six hours apart, from the stream: closed ones and, where the log ends, those still open."""
    log = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "*events.parquet").parquet(folder)
    s = incremental.session_batches(log.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "6 hours", "1 hour")
    got = incremental.replayed(s, "complete", "user_id long, started timestamp, ended timestamp, events long")
    return got.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


def stream_state(spark, folder):
    """Each user's last event, kept as snapshots that micro-batches merge into: a batch that is replayed changes nothing."""
    schema = table(spark, folder, "events").schema
    root = scratch(spark)
    state = incremental.Snapshots(f"{root}/state", ["user_id"], {c: lambda o, n: F.when((n["ts"] > o["ts"]) | (n["ts"] == o["ts"]) & (n["event_id"] > o["event_id"]), n).otherwise(o) for c in ("last",)})
    log = spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(folder).select("user_id", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type").alias("last"))

    def write(batch: DataFrame, n: int) -> None:
        state.merge(batch, n)
        state.merge(batch, n)  # a replay of the same batch

    log.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = state.read(spark)
    return out.select("user_id", "last.event_id", "last.event_type")


def triage_stream(spark, folder):
    """The log as a stream, with its buckets."""
    log = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "*events.parquet").parquet(folder)
    return log.withColumn("bucket", F.element_at(F.create_map(*[F.lit(x) for kv in PURPOSE.items() for x in kv]), F.col("event_type")))


QUERIES = {f.__name__: f for f in (stream_bucket_counts, stream_sessions, stream_state, bucket_counts, section_counts, priority_list, carry_over, json_importance, dashboard_counts, event_tumbling, event_sessions, running_bucket_counts, pending, priced_orders)}

_T = """t as (select event_id, user_id, ts, case event_type when 'error' then 'urgent' when 'purchase' then 'personal' when 'signup' then 'spam' when 'view' then 'summarize' when 'click' then 'summarize' end as bucket, value, coalesce(cast(json_extract_string(props, '$.k') as double), 0) as importance, value > 60 as action_required from events),
s as (select *, case when bucket = 'urgent' or action_required then 'needs_action' when importance >= 60 and bucket <> 'spam' then 'important' when bucket = 'summarize' then 'summaries' else 'low_priority' end as section from t)"""

_SESSIONS = """with g as (select *, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 6 hours then 0 else 1 end as fresh from events), n as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as started, count(*) as events from n group by user_id, s"""

ORACLE_SQL = {
    "stream_sessions": _SESSIONS,
    "stream_state": "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1",
    "stream_bucket_counts": f"with {_T} select bucket, count(*) as events from t group by 1",
    "bucket_counts": f"with {_T} select b.bucket, count(t.event_id) as events from (select unnest(['urgent', 'personal', 'summarize', 'spam', 'newsletter']) as bucket) b left join t on t.bucket = b.bucket group by 1",
    "section_counts": f"with {_T} select user_id, count(*) filter (where section = 'needs_action') as needs_action, count(*) filter (where section = 'important') as important, count(*) filter (where section = 'summaries') as summaries, count(*) filter (where section = 'low_priority') as low_priority, count(*) filter (where bucket = 'urgent') as urgent from s group by 1",
    "priority_list": f"with {_T} select section, place, event_id, importance from (select *, row_number() over (partition by section order by importance desc, ts desc, event_id) as place from s where ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16') where place <= 5",
    "carry_over": f"with {_T} select event_id, user_id, importance from t where action_required and ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-15' order by importance desc, ts desc, event_id limit 50",
    "json_importance": f"with {_T} select bucket, round(avg(importance), 6) as importance, count(*) filter (where importance = 0) as without from t group by 1",
    "dashboard_counts": f"with {_T} select count(*) as events, count(distinct user_id) as users, count(*) filter (where bucket = 'urgent') as urgent, count(*) filter (where ts > (select max(ts) from t) - interval 1 day) as last_day from t",
    "event_tumbling": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 4) as value from events group by 1, 2",
    "event_sessions": _SESSIONS,
    "running_bucket_counts": f"with {_T} select event_id, bucket, count(*) over (partition by user_id, bucket order by ts, event_id rows unbounded preceding) as so_far from t",
    "pending": "select event_id, user_id from (select *, lead(ts) over (partition by user_id order by ts, event_id) as nxt from events) where nxt is null or nxt > ts + interval 1 day",
    "priced_orders": "select n_name as nation, year(o_orderdate) as year, cast(sum(l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2))) as double) as revenue, count(distinct o_custkey) as customers from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2",
}
