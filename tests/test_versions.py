"""Published tables: readers see whole versions only; what didn't change isn't computed again."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from plenum.plans.gate import Gate, Input, Output
from plenum.sources.versions import CheckFailed, Versions, at_least, refers_to, unique


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_a_failed_check_leaves_readers_on_the_old_version(spark, tmp_path):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    table = Versions(spark, str(tmp_path / "t"), ["vote"], 4)
    assert table.version() == 0 and table.read() is None
    checks = [at_least(2), unique("vote", "member"), refers_to("member", parents, "id")]
    good = spark.createDataFrame([(10, 1, "yes"), (10, 2, "no"), (11, 1, None)], "vote long, member long, position string")
    assert table.rebuild(good, checks) == 1 and table.rebuild(good.repartition(3), checks) == 1  # the same rows are no new version
    kept = len(glob.glob(str(tmp_path / "t/data/*")))
    for bad in ([(10, 1, "yes")], [(10, 1, "yes"), (10, 1, "no")], [(10, 1, "yes"), (11, 9, "no")]):
        with pytest.raises(CheckFailed):
            table.rebuild(spark.createDataFrame(bad, good.schema), checks)
        assert table.version() == 1 and rows_of(table) == sorted(map(tuple, good.collect()))
    assert len(glob.glob(str(tmp_path / "t/data/*"))) == kept == 1


def test_children_are_replaced_and_other_parents_stay(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), ["vote"], 8)
    schema = "vote long, member long, position string"
    table.rebuild(spark.createDataFrame([(v, m, "yes") for v in range(20) for m in range(3)], schema))
    before = {k: os.path.getmtime(k) for k in glob.glob(str(tmp_path / "t/data/*/*/*.parquet"))}
    came = spark.createDataFrame([(4, 0, "no"), (21, 0, "yes")], schema)
    assert table.replace_children(came) == 2 and table.replace_children(came) == 2
    want = [(v, m, "yes") for v in range(20) if v != 4 for m in range(3)] + [(4, 0, "no"), (21, 0, "yes")]
    assert rows_of(table) == sorted(want)
    new = [f for f in glob.glob(str(tmp_path / "t/data/*/*/*.parquet")) if f not in before]
    assert {os.path.basename(os.path.dirname(f)) for f in new} == {f"bucket={r.b}" for r in came.select(F.pmod(F.hash("vote"), F.lit(8)).alias("b")).collect()}
    table.replace(spark.createDataFrame([(k,) for k in range(20)], "vote long"), came.limit(0))
    assert rows_of(table) == [(21, 0, "yes")]


def test_upsert_keeps_the_newest_row_of_a_key(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), ["k"], 4)
    schema = "k long, at long, v string"
    table.upsert(spark.createDataFrame([(1, 5, "a"), (2, 1, "b"), (1, 4, "old")], schema), "at")
    table.upsert(spark.createDataFrame([(1, 3, "late"), (2, 9, None), (3, 1, "c")], schema), "at")
    assert rows_of(table) == [(1, 5, "a"), (2, 9, None), (3, 1, "c")]


def lines(spark, paths):
    lines.read += [os.path.basename(p) for p in paths]
    return spark.read.text(paths)


def test_only_what_follows_from_a_change_is_built(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for term in (40, 41, 42):
        for day in range(3):
            (src / f"t{term}_d{day}.txt").write_text(f"{term} {day}\nx\n")
    counted = lambda given: given["votes"].groupBy("part").agg(F.count("*").alias("n"))
    total = lambda given: given["per_term"].agg(F.sum("n").alias("n"))
    inputs = [Input("votes", str(src), lines, "*.txt", r"/t(\d+)_")]
    outputs = [Output("per_term", ("votes",), counted), Output("total", ("per_term",), total, whole=True)]

    def run(these=None):
        lines.read = []
        report = Gate(spark, str(tmp_path / "state"), 4).run(inputs, these or outputs)
        gate = Gate(spark, str(tmp_path / "state"), 4)
        return report, {tuple(r) for r in gate.table("per_term").read().select("part", "n").collect()}, gate.table("total").read().first().n

    report, per, n = run()
    assert report[0] == {"name": "", "files": 9, "opened": 9} and report[1]["built"] == ["40", "41", "42"] and report[2]["built"] == [""]
    assert per == {("40", 6), ("41", 6), ("42", 6)} and n == 18
    report, per, n = run()
    assert report[0]["opened"] == 0 and lines.read == [] and all(r["built"] == [] for r in report[1:]) and n == 18
    for f in src.glob("t40_*"):
        f.write_text(f.read_text())  # the same bytes with a new time are read again, and nothing follows
        os.utime(f, (1_800_000_000, 1_800_000_000))
    report, _, _ = run()
    assert report[0]["opened"] == 3 and lines.read == [] and all(r["built"] == [] for r in report[1:])
    (src / "t41_d1.txt").write_text("41 1\nx\ny\n")
    report, per, n = run()
    assert report[0]["opened"] == 1 and report[1] == {"name": "per_term", "built": ["41"], "kept": 2} and report[2]["built"] == [""]
    assert sorted(lines.read) == ["t41_d0.txt", "t41_d1.txt", "t41_d2.txt"] and per == {("40", 6), ("41", 7), ("42", 6)} and n == 19
    (src / "t42_d0.txt").write_text("4242\nx\n")  # other content that gives the same count: the total isn't built again
    report, _, n = run()
    assert report[1]["built"] == ["42"] and report[2]["built"] == [] and n == 19
    for f in src.glob("t42_*"):
        f.unlink()
    report, per, n = run()
    assert report[1]["built"] == ["42"] and per == {("40", 6), ("41", 7)} and n == 13 and lines.read == []
    report, per, n = run([Output("per_term", ("votes",), counted, code="2"), outputs[1]])
    assert report[1]["built"] == ["40", "41"] and report[2]["built"] == [] and n == 13
