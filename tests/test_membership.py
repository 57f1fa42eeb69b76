"""Composition, rosters, liveness and histories against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plenum.operators import membership
from plenum.sources.versions import Versions
from plenum.streaming import liveness


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(n)


def test_days_meet_each_span_once(spark):
    rnd = random.Random(2)
    spans = [(k, day(a), None if k % 5 == 0 else day(a + rnd.choice([0, 1, 40, 900, -3]))) for k in range(120) for a in [rnd.randrange(-900, 900)]] + [(999, None, day(3))]
    days = sorted({rnd.randrange(600) for _ in range(90)})
    df = spark.createDataFrame(spans, "member int, since date, until date")
    asked = spark.createDataFrame([(day(n),) for n in days] * 2 + [(None,)], "day date")
    for width in (1, 32, 5000):
        out = membership.on_days(asked, df, width=width)
        assert sorted((r.member, r.day) for r in out.collect()) == sorted((k, day(n)) for n in days for k, a, z in spans if a and a <= day(n) and (z is None or day(n) <= z))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_composition(spark):
    d = dt.date(2026, 5, 9)
    mandates = spark.createDataFrame([("a", d, None), ("b", d, dt.date(2026, 6, 1)), ("c", dt.date(2026, 7, 1), None), ("d", None, None)], "member string, since date, until date")
    groups = spark.createDataFrame([("a", "T", d, None), ("a", "S", dt.date(2026, 6, 1), None), ("c", "F", dt.date(2026, 7, 1), None)], "member string, grp string, since date, until date")
    days = spark.createDataFrame([(d,), (dt.date(2026, 6, 2),), (dt.date(2026, 7, 1),)], "day date")
    got = {(str(r.day), r.grp): r.members for r in membership.composition(days, mandates, groups).collect()}
    assert got == {("2026-05-09", "T"): 1, ("2026-05-09", "independent"): 1, ("2026-06-02", "S"): 1, ("2026-07-01", "S"): 1, ("2026-07-01", "F"): 1}


def test_rosters(spark):
    rows = [
        ("a", 1, "tag", day(0), None), ("b", 1, "Elnök", day(5), None), ("c", 1, "társelnök", day(1), None), ("d", 1, "elnök", day(0), day(4)),
        ("a", 1, "elnök", day(900), None), ("e", 3, "tag", day(0), day(2)), ("f", 9, "tag", day(2000), None), (None, 1, "tag", day(0), None), ("d", 2, None, None, None),
    ]
    df = spark.createDataFrame(rows, "member string, committee int, role string, since date, until date")
    listed = spark.createDataFrame([(1, "B", None), (2, "A sub", 1), (4, "A", None)], "committee int, name string, parent int")
    out = membership.rosters(df, listed, F.lit(day(10)))
    got = {r.committee: (r.listed, r.members, r.former, r.chair) for r in out.collect()}
    assert got == {1: (True, 3, 1, "b"), 2: (True, 0, 0, None), 3: (False, 0, 1, None), 4: (True, 0, 0, None), 9: (False, 0, 0, None)}
    assert [r.committee for r in membership.under_parents(out.filter("listed")).collect()] == [4, 1, 2]


NOW = dt.datetime(2024, 3, 10, 12)


def at(hours):
    return NOW + dt.timedelta(hours=hours)


def test_problems_of_the_last_report(spark):
    rows = [
        (1, at(-5), at(-24), "7"), (2, at(-61), at(-24), "7"), (3, at(2), at(-24), "7"), (4, None, None, None), (5, at(-60), at(-24 * 7 - 36), "x"),
        (6, at(-1), at(-24 * 7 - 37), "-2"), (7, at(0), at(-24 * 7 - 37), "9"), (8, at(1), at(-24 - 37), "1"),
    ]
    df = spark.createDataFrame(rows, "k int, checked timestamp, published timestamp, refresh string")
    found = liveness.problems(F.col("checked"), F.col("published"), F.col("refresh"), F.lit(NOW))
    got = {r.k: r.p for r in df.select("k", found.alias("p")).collect()}
    assert got == {1: [], 2: ["silent"], 3: ["future clock"], 4: ["unreadable", "never published"], 5: [], 6: ["late publication"], 7: [], 8: ["late publication"]}
    steps = df.select("k", liveness.issue_step(found, F.col("k") % 2 == 0).alias("s")).collect()
    assert {r.k: r.s for r in steps if r.k in (1, 2, 3, 6)} == {1: "none", 2: "update", 3: "open", 6: "update"}


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_alarms_come_when_their_timers_fire(spark, tmp_path, rocks):
    schema = "source string, arrived timestamp, checked timestamp, published timestamp, refresh double"
    batches = [
        [("a", at(0), at(0), at(0), 7.0), ("b", at(0), at(0), at(0), 1.0), ("c", at(0), at(3), at(0), 7.0), ("e", at(0), None, at(0), 7.0)],
        [("a", at(24), at(24), at(0), 7.0), ("b", at(24), at(24), at(0), 1.0)],
        [("b", at(61.5), at(61), at(0), 1.0)],  # b publishes late at 24 + 36 hours
        [("b", at(90), at(90), at(89), 1.0), ("a", at(90), at(20), at(0), 7.0)],  # a's report is an old one: it is silent from 84 on
        [("z", at(300), at(300), at(300), 7.0)],  # time goes on: b is silent from 150 on, and late from 149
    ]
    folder, seen = tmp_path / "in", []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = liveness.watch(spark.readStream.schema(schema).parquet(str(folder))).writeStream.outputMode("append")
        stream = stream.foreachBatch(lambda b, _, k=k: seen.extend((k, r.source, r.alarm, r["at"]) for r in b.collect()))
        query = stream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((s, alarm, t) for _, s, alarm, t in seen)
    want = [
        ("a", "late publication", at(24 * 7 + 36)), ("a", "silent", at(84)), ("b", "late publication", at(60)), ("b", "late publication", at(89 + 60)),
        ("b", "silent", at(150)), ("c", "future clock", at(0)), ("e", "unreadable", at(0)),
    ]
    assert got == sorted(want)
    assert min(k for k, s, alarm, _ in seen if (s, alarm) == ("b", "late publication")) == 2


def test_null_never_overwrites_a_history(spark, tmp_path):
    schema, folder = "member string, period string, gross long, seq long", str(tmp_path / "in")
    for rows in ([("a", "2024-01", 5, 1), ("a", "2024-02", None, 2)], [("a", "2024-01", None, 3), ("b", "2024-01", 7, 4)], [("a", "2024-01", 4, 0), ("b", "2024-01", 8, 5), ("a", None, None, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        sink = liveness.history_sink(spark, str(tmp_path / "out"), ["member", "period"], "gross", "seq", 4)
        spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.member, r.period, r.gross) for r in Versions(spark, str(tmp_path / "out"), ["member", "period"]).read().collect())
    assert got == [("a", "2024-01", 5), ("b", "2024-01", 8)]
