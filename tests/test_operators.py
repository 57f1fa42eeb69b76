"""Operators on small tables: ties, windows, resolution, repair, payloads, logs, streams."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from plenum.operators import groups, idealpoint, operations, ranking, relational, series, switches, textual
from plenum.plans import console
from plenum.sources import files, payloads
from plenum.sources.versions import Versions
from plenum.streaming import ingest


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_ties_have_no_plurality(spark):
    pos = spark.createDataFrame([(1, m, "A", "yes" if m < 5 else "no") for m in range(10)], "vote int, member int, grp string, position string")
    row = groups.vote_cohesion(pos).first()
    assert (row.plurality, row.dissent, row.majority_share) == (None, 0, 0.5)
    assert groups.dissents(pos).count() == 0
    assert {(r.with_group, r.against_group) for r in groups.member_alignment(pos).collect()} == {(0, 0)}


def test_dissents_agree_three_ways(spark):
    pos = spark.createDataFrame([(v, m, "AB"[m % 2], ["yes", "no", "abstain", "absent"][(v * m + m) % 4]) for v in range(9) for m in range(8)], "vote int, member int, grp string, position string")
    a = groups.cohesion(pos).agg(F.sum("dissent")).first()[0]
    b = groups.member_alignment(pos).agg(F.sum("against_group")).first()[0]
    assert a == b == groups.dissents(pos).count()


def test_recent_window(spark):
    def n(per_day, total):
        rows = spark.createDataFrame([(i, day(i // per_day)) for i in range(total)], "k int, d date")
        return series.recent(rows, "d", "k").count()

    assert (n(40, 400), n(170, 170), n(1000, 1000), n(40, 30)) == (200, 170, 600, 30)


def test_islands_and_latest_run(spark):
    d = lambda y: dt.date(y, 1, 1)
    spans = spark.createDataFrame([("m", d(1990), d(1994)), ("m", d(1998), d(2002)), ("m", d(2002), d(2010))], "k string, a date, b date")
    last = series.latest_run(series.islands(spans, "k", "a", "b"), "k").first()
    assert (last.run_start.year, last.run_end.year) == (1998, 2010)


def test_switch_window_ends_at_the_next_row(spark):
    rows = spark.createDataFrame([("m", day(0), "A"), ("m", day(5), "B"), ("m", day(9), "C")], "member string, since date, grp string")
    moves = series.changes(rows, ["member"], "since", "grp").orderBy("since").collect()
    assert [(r.before, r.after, r.until) for r in moves] == [("A", "B", day(9)), ("B", "C", None)]
    cases = [
        ([(0, "A"), (5, "A"), (6, "B")], ("old label on the day", 0)), ([(0, "A"), (6, "B")], ("agrees", None)), ([(0, "A"), (5, "B"), (7, "A")], ("keeps old label", 2)),
        ([(5, "A"), (6, "B")], ("no list", None)), ([(0, "A"), (9, "C")], ("no list", None)), ([], ("no list", None)),
        ([(0, "C"), (6, "B")], ("names another group", None)), ([(0, "A"), (1, "B"), (6, "B")], ("names another group", None)), ([(0, "A"), (6, "D"), (7, "A")], ("names another group", None)),
    ]
    stints = spark.createDataFrame([(k, day(n), g) for k in range(len(cases)) for n, g in ((0, "A"), (5, "B"), (9, "C"))], "member int, since date, grp string")
    seen = spark.createDataFrame([(k, day(n), g) for k, (rows, _) in enumerate(cases) for n, g in rows], "member int, day date, grp string")
    out = switches.reconcile(series.changes(stints, ["member"], "since", "grp"), seen).filter("after = 'B'").collect()
    assert {r.member: (r.verdict, r.lag_days) for r in out} == {k: want for k, (_, want) in enumerate(cases)}


def test_as_of_takes_the_first_before_any(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (1, 9), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 3, "a"), (1, 9, "b")], "k int, u int, v string")
    assert sorted((r.k, r.t, r.v) for r in series.as_of(left, right, "k", "t", "u", "v").collect()) == [(1, 0, "a"), (1, 5, "a"), (1, 9, "b"), (2, 1, None)]


def test_names_are_never_guessed(spark):
    people = spark.createDataFrame([("a", "Kiss Kata (X)", "Kiss Katalin"), ("b", None, "Nagy Anna"), ("c", None, "Nagy Anna"), ("d", None, "Dr. Szabó Pál"), ("e", None, "Varga Katalin")], "id string, listed string, name string")
    history = spark.createDataFrame([(i, 42, "X") for i in "abcde"], "id string, term int, grp string")
    labels = spark.createDataFrame([(x, 42) for x in ("Kiss Kata (X)", "Nagy Anna (X)", "Szabó Pál (X)", "Varga Kata (X)", "Varga Katalin (Y)", "Nobody (X)")], "label string, term int")
    got = {r.label: r.id for r in relational.resolve(labels, people, history).collect()}
    assert got == {"Kiss Kata (X)": "a", "Nagy Anna (X)": None, "Szabó Pál (X)": "d", "Varga Kata (X)": "e", "Varga Katalin (Y)": None, "Nobody (X)": None}


def test_dates_move_as_a_file(spark):
    rows = [("f", day(i), (day(i + 1).weekday() if i else day(i).weekday())) for i in range(10)] + [("g", day(0), day(0).weekday()), ("g", day(1), day(2).weekday()), ("g", day(2), None)]
    out = relational.repaired_dates(spark.createDataFrame(rows, "file string, printed date, wd int"), "file", "printed", "wd").collect()
    assert all(r.date_corrected for r in out if r.file == "f")
    assert sorted((r.printed, r.date_corrected) for r in out if r.file == "g") == [(day(0), False), (day(1), True), (day(2), False)]


VOTE = """<szavazas><szavazas idopont="2026.06.15.17:20:04"><tulajdonsagok><tulajdonsag nev="Szavazási mód" ertek="Listás {}"/>
<tulajdonsag nev="Eredmény" ertek="a"/><tulajdonsag nev="Eredmény" ertek="b"/></tulajdonsagok><inditvanyok><inditvany><iromany>T/71</iromany><cim>X</cim></inditvany></inditvanyok>
<kepvcsop_szerint><szavazat frakcio="P"><igen_db>2</igen_db></szavazat><szavazat frakcio="Összesen"><igen_db>2</igen_db></szavazat></kepvcsop_szerint>
<nev_szerint><szavazat kepviselo="Minta Anna (P)" frakcio="P" szavazat="Igen"/><szavazat kepviselo="Minta Pál" frakcio="" szavazat="Más"/></nev_szerint></szavazas></szavazas>"""


def test_vote_payloads(spark):
    raw = spark.createDataFrame([("ok", VOTE.format("x")), ("amp", VOTE.format("a & b")), ("quote", VOTE.format('"idézet" x')), ("broken", "<szavazas")], "path string, raw string")
    rows = payloads.votes(raw).orderBy("path")
    got = {r.path: r for r in rows.collect()}
    assert set(got) == {"ok", "amp", "quote"} and got["amp"].repaired and not got["ok"].repaired
    assert got["ok"].result == "b" and got["ok"].slug == "2026-06-15T17-20-04" and "idézet" in got["quote"].mode
    one = rows.filter("path = 'ok'")
    assert [(r.grp, r.position) for r in payloads.roll_positions(one).collect()] == [("P", "yes"), ("független", "unknown:Más")]
    assert [(r.kind, r.number) for r in payloads.motions(one).collect()] == [("motion", 71)]
    assert [r.is_total for r in payloads.group_rows(one).collect()] == [False, True]
    twice = raw.filter("path = 'quote'").select(payloads.repair_quotes("raw").alias("raw")).select("raw", payloads.repair_quotes("raw").alias("again")).first()
    assert twice.raw == twice.again


def test_logs_and_csv(spark, tmp_path):
    (tmp_path / "a.log").write_text("#Version: 1.0\n#Fields: date c-ip sc-status\n2024-01-01\t1.2.3.4\t200\nshort\n")
    rows = files.read_access_log(spark, str(tmp_path / "a.log"), ["c-ip", "sc-status", "absent"]).collect()
    assert [(r["c-ip"], r["sc-status"], r["absent"]) for r in rows] == [("1.2.3.4", "200", None)]
    files.write_csv(spark.createDataFrame([(1, None)], "a int, b string").coalesce(1), str(tmp_path / "c"), ["a", "b"])
    assert next((tmp_path / "c").glob("part*")).read_bytes() == "﻿a,b\n1,\n".encode()
    assert files.publish(spark.range(10), str(tmp_path / "p"), ["id"]) == {"rows": 10, "columns": ["id"], "first": 0, "last": 9}


def test_echo_runs_and_bm25(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "a", "x " + passage + " y"), (2, "b", passage), (3, "a", "other words here")], "doc int, speaker string, body string")
    assert [(r.doc, r.at, r.words) for r in textual.echo_runs(docs, 30).collect()] == [(1, 1, 40)]
    asked = spark.createDataFrame([(1, "oth word")], "query int, question string")
    assert [r.doc for r in ranking.Ranking(docs, asked).top(10).collect()] == [3]
    near = textual.did_you_mean(spark.createDataFrame([("oktatsa",)], "word string"), spark.createDataFrame([("oktatas", 5), ("kutatas", 9)], "word string, n int"))
    assert [(r.word, r.d) for r in near.collect()] == [("oktatas", 1)]


def test_rising_run(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([3, 1, 2, 9, 4, 5, 5])], "k int, o int, v int")
    assert sorted(r.v for r in textual.rising_run(rows, "k", "o", "v").collect()) == [1, 2, 4, 5]


def test_freshness_order(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    t = dt.datetime(2024, 1, 31)
    rows = [(1, [], None, t), (2, None, t, t), (3, [day(30)], dt.datetime(2024, 1, 2), t), (4, [day(1)], t, dt.datetime(2024, 1, 1)), (5, [day(1)], t, t), (6, [], t, t), (7, [dt.date(2024, 2, 1)], t, t), (8, [dt.date(2024, 2, 2)], t, t)]
    state = spark.createDataFrame(rows, "k int, sitting_days array<date>, newest_vote timestamp, last_sync timestamp")
    assert [r.status for r in operations.freshness(state, now).orderBy("k").collect()] == ["empty", "unknown", "behind", "stale", "current", "unknown", "behind", "unknown"]


def test_console(spark):
    folder = "/root/testdata/sf0.001"
    spark.sql("DROP VIEW IF EXISTS nation")
    out = console.run(spark, folder, "SELECT n_name, n_regionkey FROM nation")
    assert out.count() == 25 and console.shape(out) == console.Shape("n_name", ["n_regionkey"], False)


def test_streams(spark, tmp_path):
    first = spark.createDataFrame([(1, "a", day(0)), (2, "b", day(0))], "k int, v string, d date")
    first.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, "c", day(1))], "k int, v string, d date").write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.read_rows(spark, str(tmp_path / "in"), "k int, v string, d date")
    q = stream.writeStream.foreachBatch(ingest.upsert_sink(spark, str(tmp_path / "out"), ["k"], "d")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.v) for r in Versions(spark, str(tmp_path / "out"), ["k"]).read().collect()) == [(1, "c"), (2, "b")]
    assert ingest.changed(first, first, "k", "v").count() == 0


def test_charsets_and_quotes(spark, tmp_path):
    for name in ("iso-8859-2", "windows-1250", "iso-8859-1"):
        (tmp_path / f"{name}.xml").write_bytes(f'<?xml version="1.0" encoding="{name}"?><a nev="x">{"Őri Űr é" if name != "iso-8859-1" else "é ü"}</a>'.encode(name))
    got = {r.path.rsplit("/", 1)[1]: r.raw.split(">")[-2] for r in payloads.read_payloads(spark, str(tmp_path)).collect()}
    assert got == {"iso-8859-2.xml": "Őri Űr é</a", "windows-1250.xml": "Őri Űr é</a", "iso-8859-1.xml": "é ü</a"}
    raw = spark.createDataFrame([('<a szavazat="I "x" n" frakcio="A "B""/>',)], "raw string")
    assert raw.select(payloads.repair_quotes("raw")).first()[0] == '<a szavazat="I &quot;x&quot; n" frakcio="A &quot;B&quot;"/>'


def test_last_group_follows_the_order(spark):
    rng = np.random.default_rng(3)
    side = rng.normal(size=30)
    rows = [("t", 10 * v, m, "late" if v >= 60 and m == 0 else "g", "yes" if rng.random() < 1 / (1 + np.exp(-4 * side[m] * a)) else "no") for v in range(80) for a in [rng.choice([-1, 1])] for m in range(30)]
    pos = spark.createDataFrame(rows, "term string, vote long, member long, grp string, position string")
    out = idealpoint.ideal_points(pos, least=20).toPandas().set_index("member")
    assert out.grp[0] == "late" and (out.grp[1:] == "g").all()
    assert abs(np.corrcoef(out.position.sort_index(), side)[0, 1]) > 0.9 and (out.accuracy > out.null_accuracy).all()


def test_sessions_and_late_answers(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, 1, h) + dt.timedelta(d)
    spark.createDataFrame([("a", at(0, 1)), ("a", at(0, 2)), ("a", at(0, 9)), ("b", at(0, 1)), ("a", at(0, 2))], "k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    got = sorted((r.k, r.start.hour, r.n) for r in ingest.sessions(rows, "ts", "k", "3 hours").collect())
    assert got == [("a", 1, 3), ("a", 9, 1), ("b", 1, 1)]
    stream = ingest.once(ingest.read_rows(spark, str(tmp_path / "in"), "k string, ts timestamp"), "ts", ["k", "ts"])
    stream.writeStream.format("parquet").option("path", str(tmp_path / "once")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == 4
    asked = [(day(0), at(1, 0), 0), (day(0), at(2, 0), 3), (day(1), at(3, 0), 0), (day(2), at(60, 0), 0)]
    spark.createDataFrame(asked, "day date, at timestamp, rows long").write.parquet(str(tmp_path / "ask"))
    seen = {}
    query = ingest.ask_again(ingest.read_rows(spark, str(tmp_path / "ask"), "day date, at timestamp, rows long")).writeStream.outputMode("update")
    query.foreachBatch(lambda b, _: seen.update({r.day: (r.asked, r.final) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert seen == {day(0): (2, True), day(1): (1, False), day(2): (1, True)}
