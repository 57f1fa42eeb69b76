"""Queries on tables that the small folders don't have: later keys, many rows of a key."""

import datetime as dt
import random

import duckdb
import pandas as pd
import pytest

from plenum.plans import catalogue, record  # noqa: F401
from tests.test_catalogue import bag


def agrees(spark, folder, name, **tables):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return bag(catalogue.QUERIES[name](spark, str(folder)).toPandas()) == bag(con.execute(catalogue.ORACLE_SQL[name]).df())


def test_collated_words_of_one_nation(spark, tmp_path):
    customer = [{"c_custkey": k, "c_nationkey": 1, "c_acctbal": -1.0 if k % 3 else 1.0} for k in range(60)]
    assert agrees(spark, tmp_path, "collated_customers", customer=customer)


def test_member_numbers_of_four_digits(spark, tmp_path):
    supplier = [{"s_suppkey": k, "s_nationkey": k % 2, "s_name": f"S{k}", "s_acctbal": float(k % 5 - 1)} for k in (5, 999, 1000, 1234, 9500, 1_234_567)]
    assert agrees(spark, tmp_path, "member_list", supplier=supplier)


def test_short_given_names_meet_on_an_equality(spark):
    """No step of the resolution compares all names that share their other words."""
    from plenum.operators import relational

    people = spark.createDataFrame([(1, None, "Kiss Alexandra"), (2, None, "Kiss Alex"), (3, None, "Nagy Zsuzsanna"), (4, None, "Tóth Ann"), (5, None, "Szabó Zsolti"), (6, None, "Szabó Zsoltika")], "id long, listed string, name string")
    labels = spark.createDataFrame([("Nagy Zsuzsann (G)", 1), ("Nagy Zsuzs (G)", 1), ("Tóth Anna (G)", 1), ("Szabó Zsolt (G)", 1), ("Kiss Alexandr (G)", 1), ("Nagy Zsuzsannaka (G)", 1)], "label string, term int")
    history = people.selectExpr("id", "1 AS term", "'G' AS grp")
    out = relational.resolve(labels, people, history)
    assert {r.label: (r.id, r.step) for r in out.collect()} == {
        "Nagy Zsuzsann (G)": (3, 4), "Nagy Zsuzs (G)": (None, None), "Tóth Anna (G)": (None, None), "Szabó Zsolt (G)": (None, None), "Kiss Alexandr (G)": (1, 4), "Nagy Zsuzsannaka (G)": (3, 4),
    }
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "startswith(last" not in plan


def test_composition_has_no_row_a_member_and_day(spark):
    from plenum.operators import membership

    rng, d = random.Random(3), dt.date(2024, 1, 1)
    day = lambda n: d + dt.timedelta(days=n)
    span = lambda: (rng.choice([None, *map(day, range(40))]), rng.choice([None, *map(day, range(60))]))
    mandates = [(rng.choice([*"abcdef", None]), *span()) for _ in range(25)]
    groups = [(rng.choice([*"abcdef", None]), rng.choice(["S", "T", "U", None]), *span()) for _ in range(60)]
    days = [day(n) for n in (3, 7, 7, 20, 33, 34, 50)] + [None]
    holds = lambda on, since, until: since is not None and since <= on and (until is None or on <= until)
    want = {}
    for on in {x for x in days if x}:
        for who in {m for m, *s in mandates if holds(on, *s)}:
            of = [(-s.toordinal(), g or "", g) for m, g, s, u in groups if m == who and m is not None and holds(on, s, u)]
            grp = min(of)[2] if of else None
            want[on, grp or "independent"] = want.get((on, grp or "independent"), 0) + 1
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = membership.composition(frame([(x,) for x in days], "day date"), frame(mandates, "member string, since date, until date"), frame(groups, "member string, grp string, since date, until date"))
    assert {(r.day, r.grp): r.members for r in out.collect()} == want
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rising_run_streams(spark):
    from plenum.operators import textual

    rng = random.Random(8)
    rows = [(rng.choice([1, 2, 3, None]), n, rng.choice([None, *range(30)])) for n in range(200)]
    out = textual.rising_run(spark.createDataFrame(rows, "k int, n int, v int").repartition(3), "k", "n", "v")
    got = sorted(map(tuple, out.collect()), key=str)
    for key in (1, 2, 3, None):
        best = {}
        values = [v for k, _, v in rows if k == key and v is not None]
        for i, v in enumerate(values):
            best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
        run = sorted((n, v) for k, n, v in got if k == key)
        assert len(run) == max(best.values()) and all(a[1] < b[1] for a, b in zip(run, run[1:], strict=False)) and all((key, n, v) in rows for n, v in run)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_turns_are_numbered_without_their_texts(spark):
    from plenum.operators import house

    events = spark.createDataFrame([(1, "a", 5, 2), (1, "b", 5, 1), (1, "b", 5, 1), (1, "c", 6, 9), (2, "a", 5, 3)], "bill int, label string, sitting int, seq int")
    held = spark.createDataFrame([(5, 1, "x"), (5, 2, "y"), (5, 3, "")], "sitting int, seq int, text string")
    out = house.exchanges(events, held)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 5, 1, "b", "x"), (1, 2, 5, 2, "a", "y")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_parts_grow_with_rows(spark):
    from plenum.operators import textual

    rows = spark.range(100)
    assert textual.dealt(rows, 40 * textual.PART, "id").rdd.getNumPartitions() == 40


def test_headings_are_looked_for_once(spark, monkeypatch):
    from plenum.operators import billtext

    pages = spark.createDataFrame([(1, 1, "1. §\n2. § [A]"), (1, 2, "ÁLTALÁNOS INDOKOLÁS\n3. §"), (1, 3, "4. §")], "bill int, page int, body string")
    out = billtext.units(pages)
    assert sorted((r.kind, r.number, r.page) for r in out.collect()) == [("section", 1, 1), ("section", 2, 1)]
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()
