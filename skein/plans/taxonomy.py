"""Queries over vectors and their categories (embeddings.label) and their SQL.

Assignments are derived from the vectors: each is filed under its own label, by a user for every third row id, and under
the next label with a confidence that depends on the row id. Thresholds are set where these vectors have values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import model_key
from skein.functions.vectors import cosine, has_shape, l2_distance, unit
from skein.operators import clustering, prototypes
from skein.operators.search import ranked
from skein.sources import table


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", F.col("label").cast("int").alias("category"))


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select("vec_id", "label")
    user = F.col("vec_id") % 3 == 0
    own = v.select("vec_id", F.col("label").alias("category"), F.when(user, 1.0).otherwise(0.6).alias("confidence"), F.when(user, "user").otherwise("auto").alias("assigned_by"))
    other = v.where("vec_id % 4 = 1").select("vec_id", ((F.col("label") + 1) % 10).alias("category"), ((F.col("vec_id") * 37 % 100) / 100).alias("confidence"), F.lit("auto").alias("assigned_by"))
    return own.unionByName(other)


def centroids(spark, folder) -> DataFrame:
    return prototypes.mean_vectors(vectors(spark, folder), "category")


def ranking(spark, folder, first: int | None = 3) -> DataFrame:
    return prototypes.ranked_categories(vectors(spark, folder), centroids(spark, folder).select("category", "centroid"), "vec_id", first=first)


def knn_topk(spark, folder):
    """The 10 vectors nearest to vector 0."""
    v = vectors(spark, folder)
    q = v.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    return v.crossJoin(F.broadcast(q)).select("vec_id", F.round(l2_distance(F.col("embedding"), F.col("q")), 6).alias("distance")).orderBy("distance", "vec_id").limit(10)


def knn_per_label(spark, folder):
    """The 5 vectors nearest to each centroid, below a distance of 1.35."""
    c = centroids(spark, folder).select("category", "centroid")
    near = vectors(spark, folder).select("vec_id", "embedding").crossJoin(F.broadcast(c)).withColumn("distance", F.round(l2_distance(F.col("embedding"), F.col("centroid")), 6))
    near = near.where("distance < 1.35").withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("distance", "vec_id")))
    return near.where("place <= 5").select("category", "vec_id", "distance", "place")


def label_centroids(spark, folder):
    """Each label's centroid, one row an axis."""
    return centroids(spark, folder).select("category", "size", F.posexplode("centroid").alias("axis", "v")).select("category", "size", "axis", F.round("v", 6).alias("v"))


def rank_categories(spark, folder):
    """The three categories nearest to each vector."""
    return ranking(spark, folder).where("place <= 3").select("vec_id", "category", F.round("distance", 6).alias("distance"), "place")


def multi_label_match(spark, folder):
    return prototypes.multi_label(ranking(spark, folder), "vec_id", hard=1.3501).select("vec_id", "category", F.round("distance", 6).alias("distance"))


def fast_gate(spark, folder):
    return prototypes.gates(ranking(spark, folder), "vec_id", 0.3001, margin=0.1001).withColumn("confidence", F.round("confidence", 6))


def strict_gate(spark, folder):
    return prototypes.gates(ranking(spark, folder), "vec_id", 0.3001, second_most=0.2001).withColumn("confidence", F.round("confidence", 6))


def shortlist_counts(spark, folder):
    """How many categories a vector's closer reading starts from: the first three, or all where more than three are within 0.08 of the best."""
    return prototypes.shortlist(ranking(spark, folder, None), "vec_id", few=3).groupBy("vec_id").agg(F.count(F.lit(1)).alias("categories"), F.round(F.min("confidence"), 6).alias("least"))


def nearest_category(spark, folder):
    return prototypes.nearest_other(centroids(spark, folder).select("category", "centroid")).withColumn("overlap", F.round("overlap", 6))


def category_health(spark, folder):
    """Size, members filed by users, cohesion, nearest other category and share of all members."""
    c = centroids(spark, folder)
    a = assignments(spark, folder).where("confidence >= 0.6")
    v = vectors(spark, folder).select("vec_id", "embedding")
    m = a.join(v, "vec_id").join(F.broadcast(c.select("category", "centroid")), "category")
    g = m.groupBy("category").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("assigned_by") == "user").alias("user_members"), F.round(F.avg(cosine(F.col("embedding"), F.col("centroid"))), 6).alias("cohesion"))
    return g.join(prototypes.nearest_other(c.select("category", "centroid")), "category").select("category", "members", "user_members", "cohesion", "nearest", F.round("overlap", 6).alias("overlap"), F.round(F.col("members") / F.sum("members").over(Window.partitionBy()), 6).alias("share"))


def residual_selection(spark, folder):
    """Vectors that no user filed and that are near to none of their categories."""
    a = assignments(spark, folder)
    filed = a.where("assigned_by = 'user'").select("vec_id").distinct()
    near = a.join(vectors(spark, folder).select("vec_id", "embedding"), "vec_id").join(F.broadcast(centroids(spark, folder).select("category", "centroid")), "category")
    best = near.groupBy("vec_id").agg(F.max(cosine(F.col("embedding"), F.col("centroid"))).alias("best"))
    return vectors(spark, folder).select("vec_id").join(filed, "vec_id", "left_anti").join(best, "vec_id", "left").where(F.coalesce("best", F.lit(-9.0)) < 0.2053).select("vec_id", F.round("best", 6).alias("best"))


def category_counts(spark, folder):
    """Members of each of twelve categories, two of them empty."""
    dim = spark.range(12).select(F.col("id").cast("int").alias("category"))
    return dim.join(assignments(spark, folder), "category", "left").groupBy("category").agg(F.count("vec_id").alias("members"))


def primary_category(spark, folder):
    """Each vector's first category: by confidence, then a user's choice, then the label."""
    order = F.struct("confidence", (F.col("assigned_by") == "user").cast("int"), -F.col("category"))
    return assignments(spark, folder).groupBy("vec_id").agg(F.max_by(F.struct("category", "confidence"), order).alias("p")).select("vec_id", "p.category", "p.confidence")


def folder_plan(spark, folder):
    """How many vectors each first category takes."""
    return primary_category(spark, folder).groupBy("category").agg(F.count(F.lit(1)).alias("moves"))


def memberships(spark, folder):
    """Each vector's categories in order, as text."""
    return assignments(spark, folder).groupBy("vec_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col("category").cast("string")))).alias("categories"))


def label_cooccurrence(spark, folder):
    """How often two categories share a vector."""
    a = assignments(spark, folder).select("vec_id", "category")
    b = a.withColumnRenamed("category", "other")
    return a.join(b, "vec_id").where("category < other").groupBy("category", "other").agg(F.count(F.lit(1)).alias("vectors"))


def correction_examples(spark, folder):
    """The 20 vectors that users filed last, with all their categories."""
    a = assignments(spark, folder)
    last = a.where("assigned_by = 'user'").groupBy("vec_id").agg(F.max("vec_id").alias("filed")).orderBy(F.desc("filed")).limit(20)
    return a.join(F.broadcast(last), "vec_id", "left_semi").select("vec_id", "category", "assigned_by")


def merged_categories(spark, folder):
    """The assignments after category 3 was merged into 4: a user's row wins, then the higher confidence, which stays."""
    a = assignments(spark, folder).withColumn("target", F.when(F.col("category") == 3, 4).otherwise(F.col("category")))
    order = F.struct((F.col("assigned_by") == "user").cast("int"), "confidence", (F.col("category") == F.col("target")).cast("int"))
    return a.groupBy("vec_id", F.col("target").alias("category")).agg(F.max("confidence").alias("confidence"), F.max_by("assigned_by", order).alias("assigned_by"))


def swapped_assignments(spark, folder):
    """The assignments after all automatic ones were replaced by the fast gate's."""
    from skein.operators.merge import replace_where

    a = assignments(spark, folder)
    new = fast_gate(spark, folder).select("vec_id", F.col("category").cast("int").alias("category"), "confidence", F.lit("auto").alias("assigned_by"))
    return replace_where(a, F.col("assigned_by") == "auto", new.join(a.where("assigned_by = 'user'"), ["vec_id", "category"], "left_anti"))


def single_child_members(spark, folder):
    """Members that exactly one of two overlapping groups lists."""
    v = table(spark, folder, "embeddings").select("vec_id")
    both = v.where("vec_id % 2 = 0").unionAll(v.where("vec_id % 3 = 0"))
    return both.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("vec_id")


def backlog_diagnosis(spark, folder):
    """The share of vectors within a distance of 1.3 of a centroid."""
    r = ranking(spark, folder).where("place = 1")
    return r.agg(F.count(F.lit(1)).alias("vectors"), F.round(F.avg((F.col("distance") < 1.3001).cast("double")), 6).alias("share"))


def closest_categories(spark, folder):
    """Pairs of categories by the cosine of their centroids, the closest first."""
    c = centroids(spark, folder).select("category", "centroid")
    p = c.join(c.select(F.col("category").alias("other"), F.col("centroid").alias("c2")), F.col("category") < F.col("other")).select("category", "other", F.round(cosine(F.col("centroid"), F.col("c2")), 6).alias("overlap"))
    return ranked(p, [F.desc("overlap"), F.asc("category"), F.asc("other")], 10)


def leader_clusters(spark, folder):
    """Leader clusters inside each label."""
    return clustering.leader_clusters(vectors(spark, folder), "category", "vec_id", join=0.25)


def sender_clusters(spark, folder):
    """First-fit clusters of each sender domain's mails by their latest vectors of each model; headers without '@' are their own key, none is ''."""
    tail = F.lower(F.substring_index(F.coalesce(F.max("from_addr"), F.lit("")), "@", -1))
    e = table(spark, folder, "emails").groupBy("email_rowid").agg(F.trim(F.regexp_replace(tail, r"(?s)[>\s].*$", "")).alias("domain"))
    v = table(spark, folder, "email_embeddings").where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0))
    model = F.regexp_replace(F.trim("model_id"), "(?i):latest$", "").alias("model")
    v = v.groupBy("email_rowid", model).agg(F.max_by("embedding", "created_at").alias("embedding")).where("model is not null")
    found = clustering.sender_clusters(e.join(v, "email_rowid").withColumn("by", F.concat("model", F.lit("\n"), "domain")), "by", "email_rowid")
    part = lambda n: F.substring_index("by", "\n", n)
    return found.select(part(1).alias("model_id"), part(-1).alias("sender_domain"), "email_rowid", "cluster")


def sub_prototypes(spark, folder):
    """The parts of each label that are dense and apart enough to stand for it, with their centroids' sizes."""
    return clustering.sub_prototypes(vectors(spark, folder), "category", "vec_id", join=0.2, cohesion=0.3, gap=0.1)


def running_means(spark, folder):
    """Each label's centroid after its vectors were averaged in one by one, in the order of their ids; one row an axis."""
    return clustering.running_means(vectors(spark, folder), "category", "vec_id").withColumn("v", F.round("v", 6))


def filled_distances(spark, folder):
    """Distances to vector 0 of all mails with a word: from the mail's current vector, else the square root of two."""
    q = vectors(spark, folder).where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    hits = table(spark, folder, "emails").where(F.lower("body").contains("projector")).select("email_rowid").distinct()
    good = has_shape(F.col("embedding"), 64) & F.exists("embedding", lambda x: x != 0)
    v = table(spark, folder, "email_embeddings").where(good & (model_key(F.col("model_id")) == "atlas-embed-64")).groupBy("email_rowid").agg(F.max_by("embedding", F.struct("created_at", "embedding")).alias("v"))
    near = hits.join(v, "email_rowid", "left").crossJoin(F.broadcast(q))
    return near.select("email_rowid", F.round(F.coalesce(l2_distance(unit(F.col("v")), F.col("q")), F.sqrt(F.lit(2.0))), 6).alias("distance"))


def vector_lengths(spark, folder):
    """Vectors by dimension, and how many are not of unit length."""
    n = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return table(spark, folder, "embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(F.abs(n - 1) > 0.001).alias("off"))


def tag_plan(spark, folder):
    """Each vector's tags after the categories' tags were set anew: others' tags stay, stale ones go."""
    want = assignments(spark, folder).groupBy("vec_id").agg(F.collect_set(F.concat(F.lit("cat_"), F.col("category").cast("string"))).alias("want"))
    have = F.array(F.lit("important"), F.concat(F.lit("cat_"), (F.col("vec_id") % 10).cast("string")), F.concat(F.lit("user_"), (F.col("vec_id") % 3).cast("string")))
    tags = F.array_sort(F.array_union(F.filter(have, lambda t: ~t.startswith("cat_")), F.col("want")))
    return want.select("vec_id", F.concat_ws(",", tags).alias("tags"), F.array_contains("want", F.concat(F.lit("cat_"), (F.col("vec_id") % 10).cast("string"))).alias("kept"))


QUERIES = {f.__name__: f for f in (sub_prototypes, running_means, filled_distances, vector_lengths, tag_plan, knn_topk, knn_per_label, label_centroids, rank_categories, multi_label_match, fast_gate, strict_gate, shortlist_counts, nearest_category, category_health, residual_selection, category_counts, primary_category, folder_plan, memberships, label_cooccurrence, correction_examples, merged_categories, swapped_assignments, single_child_members, backlog_diagnosis, closest_categories, leader_clusters, sender_clusters)}

_A = """a as (select vec_id, label as category, case when vec_id % 3 = 0 then 1.0 else 0.6 end as confidence, case when vec_id % 3 = 0 then 'user' else 'auto' end as assigned_by from embeddings
union all select vec_id, (label + 1) % 10, (vec_id * 37 % 100) / 100, 'auto' from embeddings where vec_id % 4 = 1)"""
_C = """x as (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as axis from embeddings), m as (select label as category, axis, avg(v::double) as m, count(*) as size from x group by all),
l as (select category, sqrt(sum(m * m)) as len from m group by 1), ca as (select category, axis, size, m / len as v from m join l using (category)), c as (select category, list(v order by axis) as centroid, max(size) as size from ca group by 1)"""
_R = _C + """, d as (select vec_id, category, list_distance(embedding::double[], centroid) as distance from embeddings, c), r as (select *, row_number() over (partition by vec_id order by distance, category) as place from d)"""
_P = _C + """, pair as (select p.category, q.category as nearest, list_cosine_similarity(p.centroid, q.centroid) as overlap from c p join c q on p.category <> q.category), n as (select * from (select *, row_number() over (partition by category order by overlap desc, nearest) as k from pair) where k = 1)"""
_GATE = _R + """, f as (select *, greatest(0, least(1, 1 - distance * distance / 2)) as confidence from r), g as (select a.vec_id, a.category, a.confidence, b.confidence as second from f a left join f b on b.vec_id = a.vec_id and b.place = 2 where a.place = 1)"""

ORACLE_SQL = {
    "filled_distances": """with h as (select distinct email_rowid from emails where contains(lower(body), 'projector') and email_rowid is not null), v0 as (select email_rowid, embedding::double[] as v, created_at, embedding from email_embeddings where regexp_replace(trim(model_id), '(?i):latest$', '') = 'atlas-embed-64' and len(embedding) = 64 and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
v as (select * from (select *, row_number() over (partition by email_rowid order by created_at desc, embedding desc) as k from v0) where k = 1), u as (select email_rowid, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from v)
select h.email_rowid, round(case when v is null then sqrt(2.0) else list_distance(v, (select embedding::double[] from embeddings where vec_id = 0)) end, 6) as distance from h left join u using (email_rowid)""",
    "vector_lengths": "select len(embedding) as dim, count(*) as vectors, count(*) filter (where abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 0.001) as off from embeddings group by 1",
    "tag_plan": f"with {_A}, w as (select distinct vec_id, 'cat_' || category as tag from a), o as (select distinct vec_id, unnest(['important', 'user_' || (vec_id % 3)]) as tag from a), u as (select * from w union select * from o) select vec_id, string_agg(tag, ',' order by tag) as tags, bool_or(tag = 'cat_' || (vec_id % 10)) as kept from u group by 1",
    "knn_topk": "select vec_id, round(list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as distance from embeddings order by distance, vec_id limit 10",
    "knn_per_label": f"with {_R} select category, vec_id, distance, place from (select category, vec_id, round(distance, 6) as distance, row_number() over (partition by category order by round(distance, 6), vec_id) as place from d where round(distance, 6) < 1.35) where place <= 5",
    "label_centroids": f"with {_C} select category, size, axis, round(v, 6) as v from ca",
    "rank_categories": f"with {_R} select vec_id, category, round(distance, 6) as distance, place from r where place <= 3",
    "multi_label_match": f"with {_R}, b as (select *, min(distance) over (partition by vec_id) as best from r) select vec_id, category, round(distance, 6) as distance from b where best < 1.3501 and distance <= least(1.3501, best + 0.1) and place <= 3",
    "fast_gate": f"with {_GATE} select vec_id, category, round(confidence, 6) as confidence from g where confidence >= 0.3001 and (second is null or confidence - second >= 0.1001)",
    "strict_gate": f"with {_GATE} select vec_id, category, round(confidence, 6) as confidence from g where confidence >= 0.3001 and (second is null or second <= 0.2001)",
    "shortlist_counts": f"with {_R}, f as (select *, greatest(0, least(1, 1 - distance * distance / 2)) as confidence from r), b as (select *, max(confidence) over (partition by vec_id) as best, count(*) over (partition by vec_id) as n from f), k as (select *, count(*) filter (where best - confidence <= 0.08) over (partition by vec_id) as close from b) select vec_id, count(*) as categories, round(min(confidence), 6) as least from k where n <= 3 or close > 3 or place <= 3 group by 1",
    "nearest_category": f"with {_P} select category, nearest, round(overlap, 6) as overlap from n",
    "category_health": f"""with {_A}, {_P}, h as (select a.category, count(*) as members, count(*) filter (where assigned_by = 'user') as user_members, round(avg(list_cosine_similarity(embedding::double[], centroid)), 6) as cohesion from a join embeddings using (vec_id) join c on c.category = a.category where confidence >= 0.6 group by 1)
select h.category, members, user_members, cohesion, nearest, round(overlap, 6) as overlap, round(members / sum(members) over (), 6) as share from h join n using (category)""",
    "residual_selection": f"""with {_A}, {_C}, b as (select vec_id, max(list_cosine_similarity(embedding::double[], centroid)) as best from a join embeddings using (vec_id) join c on c.category = a.category group by 1)
select vec_id, round(best, 6) as best from embeddings left join b using (vec_id) where vec_id not in (select vec_id from a where assigned_by = 'user') and coalesce(best, -9) < 0.2053""",
    "category_counts": f"with {_A} select g.category, count(a.vec_id) as members from (select unnest(range(12)) as category) g left join a on a.category = g.category group by 1",
    "primary_category": f"with {_A} select vec_id, category, confidence from (select *, row_number() over (partition by vec_id order by confidence desc, (assigned_by = 'user') desc, category) as k from a) where k = 1",
    "folder_plan": f"with {_A} select category, count(*) as moves from (select *, row_number() over (partition by vec_id order by confidence desc, (assigned_by = 'user') desc, category) as k from a) where k = 1 group by 1",
    "memberships": f"with {_A} select vec_id, string_agg(category::varchar, ',' order by category::varchar) as categories from (select distinct vec_id, category from a) group by 1",
    "label_cooccurrence": f"with {_A} select p.category, q.category as other, count(*) as vectors from a p join a q on p.vec_id = q.vec_id and p.category < q.category group by all",
    "correction_examples": f"with {_A} select vec_id, category, assigned_by from a where vec_id in (select distinct vec_id from a where assigned_by = 'user' order by vec_id desc limit 20)",
    "merged_categories": f"""with {_A}, t as (select *, case when category = 3 then 4 else category end as target from a), r as (select vec_id, target as category, max(confidence) over (partition by vec_id, target) as confidence, assigned_by, row_number() over (partition by vec_id, target order by (assigned_by = 'user') desc, confidence desc, (category = target) desc) as k from t)
select vec_id, category, confidence, assigned_by from r where k = 1""",
    "swapped_assignments": f"""with {_A}, {_GATE}, f2 as (select vec_id, category, round(confidence, 6) as confidence, 'auto' as assigned_by from g where confidence >= 0.3001 and (second is null or confidence - second >= 0.1001)), u as (select * from a where assigned_by = 'user')
select * from u union all select f2.* from f2 where not exists (select 1 from u where u.vec_id = f2.vec_id and u.category = f2.category)""",
    "single_child_members": "select vec_id from (select vec_id from embeddings where vec_id % 2 = 0 union all select vec_id from embeddings where vec_id % 3 = 0) group by 1 having count(*) = 1",
    "backlog_diagnosis": f"with {_R} select count(*) as vectors, round(avg(case when distance < 1.3001 then 1.0 else 0.0 end), 6) as share from r where place = 1",
    "closest_categories": f"with {_C}, p as (select p.category, q.category as other, round(list_cosine_similarity(p.centroid, q.centroid), 6) as overlap from c p join c q on p.category < q.category) select category, other, overlap, row_number() over (order by overlap desc, category, other) - 1 as place from p order by overlap desc, category, other limit 10",
}
