"""Operators on small fixtures, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import answers
from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import clustering, merge, search
from skein.operators.components import connected_components
from skein.streaming import incremental


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 40)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {n: find(n) for n in parent}
    got = connected_components(spark.createDataFrame(edges, "left long, right long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "left long, right long")).count() == 0


def test_keyed_merge_rules_and_new_keys(spark):
    cols = "k long, body string, body_fetched boolean, indexed_at long"
    stored = spark.createDataFrame([(1, "a", True, 5), (2, "b", False, 6), (None, "n", None, 1)], cols)
    pushed = spark.createDataFrame([(1, None, False, 9), (2, "c", True, 9), (3, "d", None, 9)], cols)
    got = {r.k: (r.body, r.body_fetched, r.indexed_at) for r in merge.keyed_merge(stored, pushed, ["k"], merge.EMAIL_RULES).collect()}
    assert got == {1: ("a", True, 5), 2: ("c", True, 6), 3: ("d", None, 9), None: ("n", None, 1)}
    assert [r.k for r in merge.invalidated(stored, pushed, ["k"], "body").collect()] == [2]


def test_newest_takes_one_row_a_key_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "z"), (2, None, None), (2, None, None)], "k long, at long, x string")
    assert sorted((r.k, r.at, r.x) for r in merge.newest(df, ["k"], ["at"]).collect()) == [(1, 5, "b"), (2, None, None)]


def test_vector_expressions(spark):
    a, b = np.array([1.0, 2.0, 2.0]), np.array([0.5, -1.0, 4.0])
    r = spark.createDataFrame([(a.tolist(), b.tolist(), [0.0] * 3)], "a array<double>, b array<double>, z array<double>").select(
        V.l2_distance(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.has_shape(F.col("a"), 3), V.unit(F.col("a"))
    ).first()
    assert np.isclose(r[0], np.linalg.norm(a - b)) and np.isclose(r[1], a @ b / np.linalg.norm(a) / np.linalg.norm(b)) and r[2] == 0 and r[3] and np.allclose(r[4], a / 3)


def test_text_functions(spark):
    r = spark.createDataFrame([("<style>p{}</style><p>A&amp;B</p>", "Élan Vital-9", "x\n> y\nz\n-- \nme", "Foo@Bar.Example> x")], "h string, f string, q string, d string").select(
        T.decode_entities(T.normalize_space(T.strip_html(F.col("h")))), T.fold_accents(F.col("f")), T.strip_quotes(F.col("q")), T.sender_domain(F.col("d")), T.text_hash(F.lit("a"))
    ).first()
    assert list(r) == ["A&B", "elan vital 9", "x\nz", "bar.example", T.fnv1a32("a")]
    assert T.fnv1a32("") == 0x811C9DC5 and T.fold(None) is None


def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None)], "k long, w array<string>")
    index = search.postings(docs, "k", F.col("w"))
    got = {r.k: r.score for r in search.bm25(index, "k", 10, ["a", "b"], 2.0).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0
    arm = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "k string, place long")
    fused = search.rank_fusion([arm("abc"), arm("bda")], "k").orderBy(F.desc("score"), "arm", "place").collect()
    assert [r.k for r in fused][:2] == ["b", "a"]


def test_leaders_find_blobs_and_skip_noise():
    r = np.random.default_rng(1)
    x = np.concatenate([np.eye(16)[i] + r.normal(0, 0.02, (30, 16)) for i in range(5)] + [np.eye(16)[12:14]])
    own = clustering.leaders(x / np.linalg.norm(x, axis=1, keepdims=True), 7)
    assert all(len(set(own[30 * i : 30 * i + 30])) == 1 for i in range(5)) and len(set(own[:150])) == 5 and (own[150:] == -1).all()
    assert (clustering.first_fit(np.eye(4)[[0, 1, 0, 2]], 0.9) == [0, 1, 0, 2]).all()


def test_answers():
    assert answers.salvaged('x {"a": "}"} {"b": {"c": 1}} {"d": ') == [{"a": "}"}, {"b": {"c": 1}}]
    assert answers.batch_answers('```json\n{"answers": {"1": [2], "3": []}}\n```', 3) == [[2], None, []]
    assert answers.batch_answers("[[1], 2]", 2) == [[1], [2]] and answers.batch_answers("no", 2) == [None, None]


@pytest.mark.parametrize("cut", [1, 3, 7, 50])
def test_reasoning_is_split_whatever_the_pieces(cut):
    text, got, phase, hold = "hi <think>a < b</think>done</think", {"answer": "", "think": ""}, "answer", ""
    for i in range(0, len(text), cut):
        found, phase, hold = incremental.split_reasoning(text[i : i + cut], phase, hold)
        for kind, piece in found:
            got[kind] += piece
    got[phase] += hold
    assert got == {"answer": "hi done</think", "think": "a < b"}


def test_snapshots_replay_gives_the_same_state(spark, tmp_path):
    s = incremental.Snapshots(str(tmp_path / "t"), ["k"])
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    s.merge(frame((1, "a"), (2, "b"), (2, "c")), 0)
    s.merge(frame((2, "d"), (3, "e")), 1)
    s.merge(frame((2, "d"), (3, "e")), 1)
    assert sorted((r.k, r.v) for r in s.read(spark).collect()) == [(1, "a"), (2, "d"), (3, "e")]


@pytest.mark.parametrize(
    "question, days",
    [
        ("mails of the last 3 days", ("2026-06-14", "2026-06-17")), ("les 3 derniers jours", ("2026-06-14", "2026-06-17")), ("in may 2024", ("2024-05-01", "2024-05-31")), ("yesterday", ("2026-06-16", "2026-06-16")),
        ("last week", ("2026-06-08", "2026-06-14")), ("ce mois", ("2026-06-01", "2026-06-30")), ("anything recent", ("2026-05-18", "2026-06-17")), ("since 2023", ("2023-01-01", "2023-12-31")), ("order 2023", None), ("", None),
    ],
)
def test_time_scope(question, days):
    from datetime import datetime

    from skein.functions.timescope import time_scope, without_scope

    got = time_scope(question, datetime(2026, 6, 17, 14, 30))
    assert (got and (got[0].strftime("%Y-%m-%d"), got[1].strftime("%Y-%m-%d"))) == days
    assert without_scope("invoices from last week") == "invoices from"


def test_stateful_split_over_a_stream(spark, tmp_path):
    from skein.streaming.incremental import replayed, split_streams

    rows = [("a", 0, "hi <thi"), ("a", 1, "nk>deep</th"), ("a", 2, "ink>done"), ("b", 0, "plain")]
    spark.createDataFrame(rows, "stream_id string, seq long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id string, seq long, text string").parquet(str(tmp_path / "in"))
    got = replayed(split_streams(stream), "append", "stream_id string, seq long, kind string, piece string").orderBy("stream_id", "seq").collect()
    joined = {}
    for r in got:
        joined[r.stream_id, r.kind] = joined.get((r.stream_id, r.kind), "") + r.piece
    assert joined == {("a", "answer"): "hi done", ("a", "think"): "deep", ("b", "answer"): "plain"}


def test_prototype_operators_handle_ties_and_nothing(spark):
    from skein.operators import prototypes

    protos = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "category int, centroid array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "k long, embedding array<float>")
    r = prototypes.ranked_categories(v.where("embedding is not null"), protos, "k").orderBy("place").collect()
    assert [(x.category, x.place) for x in r] == [(1, 1), (2, 2), (3, 3)]
    none = v.where("k > 9")
    assert prototypes.ranked_categories(none, protos, "k").count() == 0 and prototypes.mean_vectors(none.withColumn("c", F.lit(1)), "c").count() == 0


def test_clusters_of_empty_groups(spark):
    v = spark.createDataFrame([], "g string, k long, embedding array<float>")
    assert clustering.leader_clusters(v, "g", "k").count() == 0 and clustering.sender_clusters(v, "g", "k").count() == 0
    one = spark.createDataFrame([("a", 1, None), ("a", 2, [1.0, 0.0]), ("a", 2, [1.0, 0.0])], "g string, k long, embedding array<float>")
    assert clustering.leader_clusters(one, "g", "k").count() == 0 and [(r.k, r.cluster) for r in clustering.sender_clusters(one, "g", "k").collect()] == [(2, 2)]


def test_leaders_take_in_what_overflows():
    r = np.random.default_rng(4)
    x = r.normal(0, 1, (900, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = clustering.leaders(x, 3, core=300, most=40, least=1)
    assert (own >= 0).all() and len(set(own.tolist())) == 40
    # against a plain rendering: the first leader near enough, else a new one, else the nearest
    centres, counts, want = [], [], {}
    for step, i in enumerate(clustering.SeededRandom(3).shuffled(len(x)).tolist()):
        sims = [float(c @ x[i]) for c in centres]
        c = next((k for k, s in enumerate(sims) if s >= 0.75), None)
        if c is None and step < 300 and len(centres) < 40:
            centres.append(np.zeros(64)), counts.append(0)
            c = len(centres) - 1
        elif c is None:
            c = int(np.argmax(sims))
        m = centres[c] * counts[c] + x[i]
        centres[c], counts[c], want[i] = m / np.linalg.norm(m), counts[c] + 1, c
    assert own.tolist() == [want[i] for i in range(len(x))]


def test_measures_of_clusters():
    x = np.concatenate([np.tile(np.eye(4)[0], (5, 1)), np.tile(np.eye(4)[1], (3, 1))])
    assert clustering.measures(x, np.array([0] * 5 + [2] * 3), 1) == {0: (5, 1.0, 1.0), 2: (3, 1.0, 1.0)}
    assert clustering.measures(x, np.array([0] * 5 + [-1] * 3), 1) == {0: (5, 1.0, 1.0)} and clustering.measures(x, np.full(8, -1), 1) == {}
    big = np.random.default_rng(2).normal(1, 0.2, (700, 8))
    big /= np.linalg.norm(big, axis=1, keepdims=True)
    (size, tight, apart), = clustering.measures(big, np.zeros(700, int), 5).values()
    assert size == 700 and 0.9 < tight < 1 and apart == 1


def test_splits_need_members_gain_and_gap(spark):
    r = np.random.default_rng(7)
    near = lambda axis, n: [(np.eye(16)[axis] + r.normal(0, 0.03, 16)).tolist() for _ in range(n)]
    rows = [("two", i, v) for i, v in enumerate(near(0, 8) + near(1, 7))] + [("one", 100 + i, v) for i, v in enumerate(near(2, 15))] + [("few", 200 + i, v) for i, v in enumerate(near(0, 5) + near(1, 5))] + [("none", 300, None)]
    got = clustering.split_children(spark.createDataFrame(rows, "g string, k long, embedding array<double>"), "g", "k").collect()
    assert sorted((x.g, x.part, x.size) for x in got) == [("two", 1, 8), ("two", 2, 7)]


def test_samples_are_diverse_and_repeat():
    from skein.operators import sampling

    items = [(i, f"d{i % 5}") for i in range(50)]
    got = sampling.diverse(items, 8, 3)
    assert len({d for _, d in got[:5]}) == 5 and got == sampling.diverse(items, 8, 3) != sampling.diverse(items, 8, 4)
    both = sampling.mixed(items, 9, 3)
    assert both[:5] == sampling.diverse(items, 5, 3) and len(set(both)) == 9 and len(sampling.mixed(items[:3], 9, 3)) == 3
    assert clustering.SeededRandom(1).next() == 0.6270739405881613


def test_ranking_in_blocks_equals_ranking_at_once(spark):
    from skein.operators import prototypes

    r = np.random.default_rng(1)
    protos = spark.createDataFrame([(i % 7, r.normal(0, 1, 6).tolist()) for i in range(20)] + [(None, [0.0] * 6), (3, None)], "category int, centroid array<double>")
    v = spark.createDataFrame([(i, r.normal(0, 1, 6).tolist()) for i in range(30)] + [(98, None), (99, [1.0])], "k long, embedding array<double>")
    show = lambda df: sorted((x.k, x.category, round(x.distance, 9), x.place) for x in df.collect())
    whole = show(prototypes.ranked_categories(v, protos, "k"))
    assert len(whole) == 30 * 7 and whole == show(prototypes.ranked_categories(v, protos, "k", block=6))
    assert [x for x in whole if x[3] <= 2] == show(prototypes.ranked_categories(v, protos, "k", first=2)) == show(prototypes.ranked_categories(v, protos, "k", first=2, block=6))
    assert prototypes.ranked_categories(v, protos.where("category > 99"), "k").count() == 0


def test_shortlists(spark):
    from skein.operators import prototypes

    rows = [(1, c, 0.1 + 0.001 * c, c + 1) for c in range(14)] + [(2, c, 0.1 * (c + 1), c + 1) for c in range(14)] + [(3, c, 0.3, c + 1) for c in range(10)]
    got = prototypes.shortlist(spark.createDataFrame(rows, "k long, category int, distance double, place int"), "k").groupBy("k").count().collect()
    assert {x["k"]: x["count"] for x in got} == {1: 14, 2: 12, 3: 10}


def test_text_functions_by_examples(spark):
    r = spark.createDataFrame([("Élan_Überblick2024Final.PDF", "a&lt;b&#33;&#x41;&nbsp;&amp;lt;&bogus;", "Hi  all\n> q\nbye\n-- \nme", "Ünïcode & Co./Ltd\\x", "")], "f string, e string, b string, l string, n string").select(
        T.filename_words(F.col("f")), T.basic_entities(F.col("e")), T.preprocessed(F.col("b"), F.lit(False), 100), T.canonical_key(F.col("l")), T.folder_name(F.col("l")), T.tag_key("T-", F.col("l")), T.canonical_key(F.col("n")), T.folder_name(F.col("n")), T.index_words(F.col("l"))
    ).first()
    assert list(r) == ["elan uberblick2024 final pdf", "a<b!A\xa0&lt;&bogus;", "Hi all bye", "unicode_co_ltd_x", "Ünïcode & Co.-Ltd-x", "t-_n_code___co__ltd_x", "category", "Category", ["unicode", "co", "ltd", "x"]]
    assert T.safe_slice("ab\U0001f600c", 3) == "ab" and T.safe_slice("ab\U0001f600c", 4) == "ab\U0001f600" and T.safe_slice(None, 3) is None
    assert T.chunked(None) == [] and T.chunked(" \n ") == [] and T.chunked("x" * 1200) == ["x" * 1200] and [len(c) for c in T.chunked("x" * 3000)] == [1200, 1200, 900]
    assert T.chunked("a" * 700 + "\n\n" + "b" * 900)[0] == "a" * 700


def test_answers_as_orders():
    assert answers.rerank_order("[3, 1, 1, 9, -2]", 4) == [3, 1, 0, 2] and answers.rerank_order('```\n{"order": [[2], 0]}\n```', 3) == [2, 0, 1] and answers.rerank_order("no", 2) == [0, 1] and answers.rerank_order(None, 0) == []


def test_tables_are_discarded(spark):
    import os

    from skein.runtime import discard, materialize

    df = materialize(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 3 and os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)


def test_index_updates_and_searches_of_nothing(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, None)], "k long, w array<string>")
    index = search.updated_index(search.postings(docs, "k", F.col("w")), "k", spark.createDataFrame([(1, ["c"]), (2, None), (9, ["a"])], "k long, w array<string>"), F.col("w"))
    assert sorted((r.k, r.word) for r in index.collect()) == [(1, "c"), (9, "a")]
    q = spark.createDataFrame([(0, ["a", "a"]), (1, []), (2, ["zz"])], "question int, terms array<string>")
    assert [(r.question, r.k, r.place) for r in search.keyword_search(docs, "k", "w", q, 5).collect()] == [(0, 1, 1)]
    assert search.keyword_search(docs.limit(0), "k", "w", q, 5).count() == 0
