"""Prototypes, clusters and samples over vectors and mails; and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import model_key, sender_domain
from skein.functions.vectors import cosine, has_shape
from skein.operators import clustering, merge, prototypes, sampling
from skein.plans.mail import emails, recency
from skein.plans.taxonomy import _A, _C, _R, assignments, centroids, ranking, vectors
from skein.sources import table


def current(spark, folder) -> DataFrame:
    """(email_rowid, account_id, model, embedding): the latest vector of each mail and model, if it is whole."""
    v = table(spark, folder, "email_embeddings").select("email_rowid", "account_id", model_key(F.col("model_id")).alias("model"), "embedding", "created_at").where("email_rowid is not null and account_id is not null and model is not null")
    v = v.groupBy("email_rowid", "model").agg(F.max_by(F.struct("account_id", "embedding"), F.struct("created_at", "embedding")).alias("r")).select("email_rowid", "r.account_id", "model", "r.embedding")
    return v.where(has_shape(F.col("embedding"), 64) & F.exists("embedding", lambda x: x != 0))


def stored_parts(spark, folder) -> DataFrame:
    """Prototypes (category, part, centroid, size): each label's whole as part 0, and the halves of even labels by parity of the vector as parts 1 and 2."""
    v = vectors(spark, folder)
    whole = prototypes.mean_vectors(v, "category").withColumn("part", F.lit(0))
    half = v.where("category % 2 = 0").withColumn("cp", F.col("category") * 10 + 1 + F.col("vec_id") % 2)
    parts = prototypes.mean_vectors(half, "cp").select(F.floor(F.col("cp") / 10).cast("int").alias("category"), "centroid", "size", (F.col("cp") % 10).cast("int").alias("part"))
    return whole.unionByName(parts).select("category", "part", "centroid", "size")


def effective_prototypes(spark, folder):
    """The prototypes that stand for each category: its parts, else the whole."""
    return prototypes.effective(stored_parts(spark, folder)).select("category", "part", "size")


def nearest_part(spark, folder):
    """The part of its label's prototypes that each vector is most similar to; ties to the first part."""
    p = prototypes.effective(stored_parts(spark, folder)).select("category", "part", "centroid")
    v = vectors(spark, folder).join(F.broadcast(p), "category").select("vec_id", "category", "part", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))
    return v.groupBy("vec_id", "category").agg(F.max_by(F.struct("part", "similarity"), F.struct("similarity", -F.col("part"))).alias("b")).select("vec_id", "category", "b.part", "b.similarity")


def replaced_prototypes(spark, folder):
    """The prototypes after category 4 got one part, category 6 none, and category 8 was deleted: parts are replaced as a set, the whole stays."""
    p = stored_parts(spark, folder).select("category", "part", "size")
    new = p.where("category = 4 and part = 1").withColumn("size", F.col("size") + 1)
    kept = p.where(~(F.col("category").isin(4, 6) & (F.col("part") > 0)) & (F.col("category") != 8))
    return kept.unionByName(new)


def collapsed_labels(spark, folder):
    """Of each vector's five nearest categories the first two that differ: none as near as a cosine of 0.3 to one before."""
    near = ranking(spark, folder, 5).select("vec_id", "category", "place")
    return prototypes.collapsed(near, centroids(spark, folder), "vec_id", same=0.3)


def folded_centroids(spark, folder):
    """Each label's centroid of the vectors that 3 does not divide, after the others were averaged in by weight; one row an axis."""
    v = vectors(spark, folder)
    old = prototypes.mean_vectors(v.where("vec_id % 3 <> 0"), "category")
    got = prototypes.folded_in(old, v.where("vec_id % 3 = 0").select("category", "embedding"))
    return got.select("category", "size", F.posexplode("centroid").alias("axis", "v")).withColumn("v", F.round("v", 6))


def category_separation(spark, folder):
    """The least distance, 1 less the cosine, of any two labels' centroids."""
    c = prototypes.nearest_other(centroids(spark, folder).select("category", "centroid"))
    return c.agg(F.count(F.lit(1)).alias("categories"), F.round(1 - F.max("overlap"), 6).alias("separation"))


def category_drift(spark, folder):
    """How far each label's centroid, stored when only even vectors were known, is from the centroid of all; and from its nearest stored neighbour."""
    v = vectors(spark, folder)
    old = prototypes.mean_vectors(v.where("vec_id % 2 = 0"), "category").select("category", F.col("centroid").alias("stored"))
    new = prototypes.mean_vectors(v, "category").select("category", "centroid", "size")
    near = prototypes.nearest_other(old.select("category", F.col("stored").alias("centroid")))
    j = new.join(old, "category", "left").join(near, "category", "left")
    return j.select("category", "size", F.round(1 - cosine(F.col("stored"), F.col("centroid")), 6).alias("drift"), F.round(F.coalesce(1 - F.col("overlap"), F.lit(1.0)), 6).alias("separation"), "nearest")


def rebuilt_centroids(spark, folder, least: int = 3):
    """What each category is rebuilt from: its users' members, if three or more; else, where no user filed any, its automatic ones, if three or more; else it stays. With the rebuilt centroid's cosine to the label's."""
    a = assignments(spark, folder).join(vectors(spark, folder).select("vec_id", "embedding"), "vec_id")
    n = a.groupBy("category").agg(F.count_if(F.col("assigned_by") == "user").alias("users"), F.count_if(F.col("assigned_by") != "user").alias("autos"))
    n = n.select("category", F.when(F.col("users") >= least, "user").when((F.col("users") == 0) & (F.col("autos") >= least), "auto").otherwise("none").alias("source"))
    members = a.join(F.broadcast(n.where("source <> 'none'").select("category", F.col("source").alias("assigned_by"))), ["category", "assigned_by"], "left_semi")
    new = prototypes.mean_vectors(members, "category").select("category", F.col("centroid").alias("new"), "size")
    c = centroids(spark, folder).select("category", "centroid")
    return n.join(new, "category", "left").join(c, "category", "left").select("category", "source", "size", F.round(cosine(F.col("new"), F.col("centroid")), 6).alias("similarity"))


def batch_categories(spark, folder):
    """How many vectors each category takes when all that no user filed are categorised anew, and how many were scored."""
    locked = assignments(spark, folder).where("assigned_by = 'user'").select("vec_id").distinct()
    r = ranking(spark, folder).join(locked, "vec_id", "left_anti")
    m = prototypes.multi_label(r, "vec_id", hard=1.3501)
    scored = r.agg(F.count_distinct("vec_id").alias("scored"))
    return m.groupBy("category").agg(F.count(F.lit(1)).alias("matches")).crossJoin(F.broadcast(scored))


def embedding_upserts(spark, folder):
    """The vectors after every second mail's were written again, whole: rows and complete ones by model."""
    v = table(spark, folder, "email_embeddings").where("email_rowid is not null and model_id is not null")
    old = merge.newest(v.select("email_rowid", model_key(F.col("model_id")).alias("model"), "created_at", F.coalesce(F.size("embedding") == 64, F.lit(False)).alias("complete")), ["email_rowid", "model"], ["created_at", "complete"])
    new = old.where("email_rowid % 2 = 0").select("email_rowid", "model", (F.col("created_at") + F.expr("interval 1 day")).alias("created_at"), F.lit(True).alias("complete"))
    return merge.keyed_merge(old, new, ["email_rowid", "model"]).groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.count_if("complete").alias("complete"))


def discovered_clusters(spark, folder):
    """The leader clusters of each account's mails and model, with their cohesion and separation."""
    return clustering.discovered_clusters(current(spark, folder), "account_id", "model", "email_rowid")


def split_children(spark, folder):
    """The parts that labels should be split into, by limits that suit these vectors."""
    return clustering.split_children(vectors(spark, folder), "category", "vec_id", floor=0.1, gain=0.02, gap=0.1, join=0.2)


def cluster_first_sample(spark, folder, most: int = 120):
    """Of each account one mail a cluster of its senders' like mails (first-fit at 0.86), the largest clusters first, 120 at most."""
    v = current(spark, folder).where("model = 'atlas-embed-64'")
    d = emails(spark, folder, "from_addr").select("email_rowid", F.coalesce(sender_domain(F.col("from_addr")), F.lit("")).alias("domain"))
    rows = v.join(d, "email_rowid").withColumn("by", F.concat("account_id", F.lit("\n"), "domain"))
    c = clustering.sender_clusters(rows, "by", "email_rowid", threshold=0.86)
    n = c.groupBy(F.substring_index("by", "\n", 1).alias("account_id"), "cluster").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy("account_id").orderBy(F.desc("size"), "cluster")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("account_id", F.col("cluster").alias("email_rowid"), "size", "place")


def _sample(spark, folder, how):
    df = emails(spark, folder, "account_id", "from_addr", "date_ms", "indexed_at").where("account_id is not null")
    domain = F.coalesce(sender_domain(F.col("from_addr")), F.lit(""))
    return sampling.sampled(df, "account_id", "email_rowid", domain, [F.desc_nulls_last(recency()), F.asc("email_rowid")], 20, 400, 7, how)


def diverse_sample(spark, folder):
    """20 mails of each account's newest 400 after a seeded shuffle, one a sender domain first."""
    return _sample(spark, folder, sampling.diverse)


def mixed_sample(spark, folder):
    """20 mails of each account's newest 400: half of them diverse, half at random."""
    return _sample(spark, folder, sampling.mixed)


QUERIES = {f.__name__: f for f in (effective_prototypes, nearest_part, replaced_prototypes, collapsed_labels, folded_centroids, category_separation, category_drift, rebuilt_centroids, batch_categories, embedding_upserts, discovered_clusters, split_children, cluster_first_sample, diverse_sample, mixed_sample)}

_mean = lambda name, src, key: f"{name}x as (select {key} as category, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as axis from {src}), {name}m as (select category, axis, avg(v::double) as m, count(*) as size from {name}x group by all), {name}l as (select category, sqrt(sum(m * m)) as len from {name}m group by 1), {name} as (select category, list(m / len order by axis) as centroid, max(size) as size from {name}m join {name}l using (category) group by 1)"
_H = _mean("h", "(select *, label * 10 + 1 + vec_id % 2 as cp from embeddings where label % 2 = 0)", "cp")
_PARTS = f"{_C}, {_H}, p as (select category, 0 as part, centroid, size from c union all select cast(floor(category / 10) as int), category % 10, centroid, size from h), ef as (select *, max(part) over (partition by category) as parts from p), pe as (select category, part, centroid, size from ef where parts = 0 or part > 0)"
_FOLD = _mean("o", "(select * from embeddings where vec_id % 3 <> 0)", "label")

ORACLE_SQL = {
    "effective_prototypes": f"with {_PARTS} select category, part, size from pe",
    "nearest_part": f"with {_PARTS}, s as (select vec_id, category, part, round(list_cosine_similarity(embedding::double[], centroid), 6) as similarity from embeddings join pe on category = label) select vec_id, category, part, similarity from (select *, row_number() over (partition by vec_id order by similarity desc, part) as k from s) where k = 1",
    "replaced_prototypes": f"with {_PARTS} select category, part, case when category = 4 and part = 1 then size + 1 else size end as size from p where category <> 8 and not (category = 6 and part > 0) and not (category = 4 and part = 2)",
    "collapsed_labels": f"""with recursive {_R}, o as (select a.category as x, b.category as y, list_cosine_similarity(a.centroid, b.centroid) as s from c a, c b), t as (select vec_id, category, place from r where place <= 5),
k as (select vec_id, 1 as place, [category] as kept from t where place = 1 union all select k.vec_id, k.place + 1, case when len(kept) < 2 and not exists (select 1 from o where o.x = t.category and list_contains(kept, o.y) and (o.s >= 0.3 or o.x = o.y)) then list_append(kept, t.category) else kept end from k join t on t.vec_id = k.vec_id and t.place = k.place + 1)
select vec_id, kept[i] as category, i as place from (select vec_id, kept, unnest(range(1, len(kept) + 1)) as i from k where place = 5)""",
    "folded_centroids": f"with {_FOLD}, w as (select category, generate_subscripts(centroid, 1) - 1 as axis, unnest(centroid) * size as v, size as n from o union all select label, generate_subscripts(embedding, 1) - 1, unnest(embedding)::double, 1 from embeddings where vec_id % 3 = 0), m as (select category, axis, sum(v) / sum(n) as m, sum(n) as size from w group by all), l as (select category, sqrt(sum(m * m)) as len from m group by 1) select category, cast(size as bigint) as size, axis, round(m / len, 6) as v from m join l using (category)",
    "category_separation": f"with {_C} select (select count(*) from c) as categories, round(1 - max(list_cosine_similarity(p.centroid, q.centroid)), 6) as separation from c p join c q on p.category <> q.category",
    "category_drift": f"with {_C}, {_mean('s', '(select * from embeddings where vec_id % 2 = 0)', 'label')}, n as (select p.category, q.category as nearest, list_cosine_similarity(p.centroid, q.centroid) as overlap from s p join s q on p.category <> q.category), b as (select * from (select *, row_number() over (partition by category order by overlap desc, nearest) as k from n) where k = 1) select c.category, c.size, round(1 - list_cosine_similarity(s.centroid, c.centroid), 6) as drift, round(coalesce(1 - overlap, 1), 6) as separation, nearest from c left join s on s.category = c.category left join b on b.category = c.category",
    "rebuilt_centroids": f"with {_A}, {_C}, n as (select category, count(*) filter (where assigned_by = 'user') as users, count(*) filter (where assigned_by <> 'user') as autos from a group by 1), f as (select category, case when users >= 3 then 'user' when users = 0 and autos >= 3 then 'auto' else 'none' end as source from n), mm as (select a.category as label, embedding from a join f on f.category = a.category and f.source = a.assigned_by join embeddings using (vec_id)), {_mean('g', 'mm', 'label')} select f.category, source, g.size, round(list_cosine_similarity(g.centroid, c.centroid), 6) as similarity from f left join g on g.category = f.category left join c on c.category = f.category",
    "batch_categories": f"with {_A}, {_R}, u as (select * from r where vec_id not in (select vec_id from a where assigned_by = 'user')), b as (select *, min(distance) over (partition by vec_id) as best from u) select category, count(*) as matches, (select count(distinct vec_id) from u) as scored from b where best < 1.3501 and distance <= least(1.3501, best + 0.1) and place <= 3 group by category",
    "embedding_upserts": "with v as (select email_rowid, regexp_replace(trim(model_id), '(?i):latest$', '') as model, coalesce(len(embedding) = 64, false) as complete, row_number() over (partition by email_rowid, regexp_replace(trim(model_id), '(?i):latest$', '') order by created_at desc nulls last, coalesce(len(embedding) = 64, false) desc) as k from email_embeddings where email_rowid is not null and model_id is not null) select model, count(*) as rows, count(*) filter (where complete or email_rowid % 2 = 0) as complete from v where k = 1 group by 1",
}
