"""Every query with SQL equals DuckDB on the small tables."""

import collections
import datetime as dt
import math
import os
import re

import duckdb
import pandas as pd
import pytest

from plenum.plans import catalogue, record  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (dt.datetime, pd.Timestamp)):
        return v.isoformat()
    return v


def bag(df):
    df = df[sorted(df.columns)].astype(object)
    return collections.Counter(tuple(plain(x) for x in row) for row in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert bag(got) == bag(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() >= 0


def edits(a, b):
    """Damerau distance with neighbours swapped as one edit."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_did_you_mean_asks_every_rare_word(spark, tmp_path):
    text = "parliament parliament parlaimemt vote votes votes votse minister ministre ministry session sessions sessoin budget budgte oath oaths abc abd"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    n = collections.Counter(w for w in text.split() if len(w) >= 4)
    want = {}
    for a in n:
        near = [(edits(a, w), -n[w], w) for w in n if w != a and edits(a, w) <= (2 if len(a) >= 8 else 1)]
        if n[a] == 1 and near:
            want[a] = (min(near)[2], min(near)[0])
    assert want["parlaimemt"] == ("parliament", 2)
    assert {r.asked: (r.word, r.d) for r in catalogue.QUERIES["did_you_mean"](spark, str(tmp_path)).collect()} == want


def test_search_asks_every_whole_question(spark, tmp_path):
    asked = [(k, " ".join(f"com{(k + j) % 9}mon" for j in range(8)) + f" only{k}word last{k % 7}part") for k in range(40)]
    docs = [(k, f"before {q} after {'more ' * (k % 5)}") for k, q in asked if k % 3] + [(100 + k, f"com{k % 9}mon last{k % 7}part filler") for k in range(30)]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {i: re.findall("[a-z0-9]{3,}", t) for i, t in docs}
    mean, ranked = sum(map(len, tokens.values())) / len(docs), {}
    for q, t in asked:
        scores = collections.Counter()
        for term in set(re.findall("[a-z0-9]{3,}", t)):
            tf = {i: n for i, w in tokens.items() if (n := sum(x.startswith(term) for x in w))}
            idf = math.log(1 + (len(docs) - len(tf) + 0.5) / (len(tf) + 0.5))
            for i, n in tf.items():
                scores[i] += idf * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(tokens[i]) / mean))
        ranked[q] = sorted(((round(x, 4), i) for i, x in scores.items()), reverse=True)
    got = {(r.query, r.doc): r.score for r in catalogue.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()}
    want = {(q, i): x for q, r in ranked.items() for x, i in r[:10]}
    assert got.keys() == want.keys() and all(abs(got[k] - x) < 2e-4 for k, x in want.items())
    every = {(q, i) for q, t in asked for i, w in tokens.items() if set(t.split()) <= set(w)}
    assert {(r.query, r.doc) for r in catalogue.QUERIES["every_term_search"](spark, str(tmp_path)).collect()} == every
    relevant = {q: {i for i, x in docs if t in x} for q, t in asked}
    relevant = {q: r for q, r in relevant.items() if r}
    places = {q: [k for k, (_, i) in enumerate(ranked[q], 1) if i in r] for q, r in relevant.items()}
    recall = sum(sum(k <= 10 for k in places[q]) / min(10, len(r)) for q, r in relevant.items()) / len(relevant)
    mrr = sum(1 / min(x) if x else 0 for x in places.values()) / len(relevant)
    row = catalogue.QUERIES["search_eval"](spark, str(tmp_path)).first()
    assert row.questions == len(relevant) == 26 and abs(row.recall - recall) < 1e-5 and abs(row.mrr - mrr) < 1e-5


def test_seats_in_force_answers_every_day(spark):
    orders = pd.read_parquet(f"{FOLDER}/orders.parquet", columns=["o_orderkey", "o_orderdate"])
    days = pd.to_datetime(orders.o_orderdate).dt.normalize()
    spans = [(a, None if k % 3 == 0 else a + pd.Timedelta(days=k % 90)) for k, a in zip(orders.o_orderkey, days, strict=True)]
    want = {}
    for day in sorted(set(days)):
        n = sum(a <= day and (z is None or z >= day) for a, z in spans)
        want[str(day.date())] = (n, n if 0.9 * 386 <= n <= 386 else 386)
    assert {r.on_date: (r.n, r.seats) for r in catalogue.QUERIES["seats_in_force"](spark, FOLDER).collect()} == want
