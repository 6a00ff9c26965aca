"""Every core query against its SQL, on the smallest tables."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.plans import catalog


def plain(x):
    if x is None or (isinstance(x, (float, np.floating)) and np.isnan(x)) or str(x) == "<NA>":
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)):
        return round(float(x), 6)
    return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([plain(x) for x in r]) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, data, duck, name):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_label_twins_of_all_accounts(spark, tmp_path):
    r = random.Random(5)
    mails = [(i, f"acc-{i % 3:03}", "inbox", " ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8)))) for i in range(240)] + [(900, "acc-000", "inbox", None), (901, "acc-000", "inbox", "")]
    spark.createDataFrame(mails, "email_rowid long, account_id string, folder string, subject string").withColumn("indexed_at", F.current_timestamp()).write.parquet(f"{tmp_path}/emails.parquet")
    labels = {(account, s): set(s.split()) for _, account, _, s in mails if s and len(set(s.split())) >= 3}
    want = {(c, x, y, round(len(v & w) / len(v | w), 6)) for (c, x), v in labels.items() for (d, y), w in labels.items() if c == d and x < y and len(v & w) >= 0.6 * len(v | w)}
    got = catalog.QUERIES["label_twins"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) and len({x[0] for x in want}) == 3


def test_sender_clusters_by_domain_and_model(spark, tmp_path):
    r = np.random.default_rng(3)
    base = r.normal(0, 1, (3, 64))
    senders = ["a@x.example", "B <b@X.example>", None, "no address", "c@y.example"]
    mails = [(i, senders[i % 5]) for i in range(60)]
    vecs = [(i, m, (base[r.integers(3)] + r.normal(0, 0.02, 64)).tolist()) for i in range(60) for m in ("atlas-embed-64:latest", "brio-embed-64")]
    spark.createDataFrame(mails, "email_rowid long, from_addr string").write.parquet(f"{tmp_path}/emails.parquet")
    spark.createDataFrame(vecs, "email_rowid long, model_id string, embedding array<float>").withColumn("created_at", F.current_timestamp()).write.parquet(f"{tmp_path}/email_embeddings.parquet")
    domains, founders, want = ["x.example", "x.example", "", "no", "y.example"], {}, set()
    for i, m, v in vecs:
        key, v = (m.split(":")[0], domains[i % 5]), np.array(v) / np.linalg.norm(v)
        own = next((j for j, f in founders.setdefault(key, []) if f @ v >= 0.95), i)
        if own == i:
            founders[key].append((i, v))
        want.add((*key, i, own))
    got = catalog.QUERIES["sender_clusters"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == want and len(got) == 120 and any(i % 5 == 1 and c % 5 == 0 for *_, i, c in want)


def test_entry(spark, data):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
