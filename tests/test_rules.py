"""Golden values and properties of thresholds, verdicts, indices and parsers."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plenum.functions import rules, text
from plenum.operators import groups


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_thresholds(spark):
    df = spark.createDataFrame([(r, n) for n in (199, 176) for r in ("egyszeru", "abszolut", "ketharmad_osszes", "negyotod_osszes", "relativ")], "rule string, n int")
    assert [x[0] for x in rows(df.select(rules.needed(F.col("rule"), F.col("n"))))] == [100, 100, 133, 160, None, 89, 89, 118, 141, None]


def test_verdicts(spark):
    df = spark.createDataFrame([("ketharmad_osszes", 135, 191, 199), ("egyszeru", 0, 0, 199), ("relativ", 5, 9, 199)], "rule string, yes int, present int, seats int")
    v = rules.verdict(*[F.col(c) for c in ("rule", "yes", "present", "seats")])
    assert rows(df.select(v["needed"], v["margin"], v["passed"])) == [(133, 2, True), (1, -1, False), (None, None, None)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 400), st.integers(0, 400)), min_size=1, max_size=40))
def test_threshold_properties(spark, tallies):
    df = spark.createDataFrame([(*t, r) for t in tallies for r in rules.RULES if r != "relativ"], "yes int, no int, abstain int, rule string")
    n = F.col("yes") + F.col("no") + F.col("abstain")
    v = rules.verdict(F.col("rule"), F.col("yes"), n, n)
    bad = df.select("*", v["needed"].alias("needed"), v["passed"].alias("passed"), n.alias("n")).filter(
        "needed < 0 or (n > 0 and needed > n) or (passed and (n = 0 or yes <= no)) or passed <> (n > 0 and yes >= needed)"
    )
    assert bad.count() == 0
    index = groups.agreement_index(F.col("yes"), F.col("no"), F.col("abstain"))
    assert df.filter((index < 0) | (index > 1)).count() == 0


def test_indices(spark):
    df = spark.createDataFrame([(0, 23, 16), (10, 10, 10), (135, 0, 0), (0, 0, 0)], "y int, n int, a int")
    got = rows(df.select(groups.agreement_index(F.col("y"), F.col("n"), F.col("a")), groups.rice(F.col("y"), F.col("n"))))
    assert got == [(15 / 39, 1.0), (0.0, 0.0), (1.0, 1.0), (None, None)]


def test_classify(spark):
    data = [("Listás az összes képviselő 2/3-ával", None), ("Listás", None), (None, "Házszabálytól eltérés"), (None, None)]
    c = rules.classify(F.col("m"), F.lit("x"), F.col("s"), F.lit(None).cast("string"))
    got = rows(spark.createDataFrame(data, "m string, s string").select(c["rule"], c["source"]))
    assert got == [("ketharmad_osszes", "payload"), ("egyszeru", "payload"), ("negyotod_jelenlevo", "keyword"), ("egyszeru", "default")]


def test_parsers(spark):
    written = ["25:40", "1:02:03", "1::03", "25:40:", "²:30", ":30", "", None]
    df = spark.createDataFrame([(x,) for x in written], "c string")
    assert [x[0] for x in rows(df.select(text.duration_seconds(F.col("c"))))] == [1540, 3723, None, 1540, None, 30, None, None]
    df = spark.createDataFrame([("2026.05.28.",), ("2026.05.28",), ("x",), ("",)], "c string")
    assert [str(x[0]) for x in rows(df.select(text.dotted_date(F.col("c"))))] == ["2026-05-28", "2026-05-28", "None", "None"]
    df = spark.createDataFrame([(x,) for x in ("1990-94", "2022-2026", " 2026-", "1998-x", "1985-90", "x", None)], "c string")
    assert [x[0] for x in rows(df.select(text.term_of_label(F.col("c"))))] == [34, 42, 43, 36, None, None, None]
    df = spark.createDataFrame([(x,) for x in ("Országos lista", "Fejér 3. OEVK", "német nemzetiségi lista", "x", "", None)], "c string")
    assert [x[0] for x in rows(df.select(text.mandate_kind(F.col("c"))))] == ["lista", "egyeni", "nemzetisegi", "other", "other", "other"]
    df = spark.createDataFrame([("T/71",), ("56/4",), ("zz",), (" t/71 ",), ("ék/2",), (None,), ("",), ("1/2/3",)], "c string")
    m = text.motion_number(F.col("c"))
    assert rows(df.select(m["kind"], m["prefix"], m["number"], m["part"])) == [
        ("motion", "T", 71, None), ("amendment", None, 56, 4), ("other", None, None, None), ("motion", "T", 71, None), ("motion", "ÉK", 2, None),
        (None, None, None, None), (None, None, None, None), ("other", None, None, None),
    ]
    df = spark.createDataFrame([("Az OKTATÁSÜGY, a MÁV és a gyermekvédelem — 2026-ban!",)], "c string")
    assert df.select(text.tokens(F.col("c"))).first()[0] == ["oktatasugy", "mav", "gyermekvedelem", "2026", "ban"]
    df = spark.createDataFrame([("Általános vita folytatása T/4181 Magyarország költségvetése", "T/4181"), ("Napirend előtt", None), (None, "T/1")], "e string, n string")
    p = text.split_event(F.col("e"), F.col("n"))
    assert rows(df.select(p["stage"], p["subject"])) == [("Általános vita folytatása", "Magyarország költségvetése"), (None, "Napirend előtt"), (None, None)]
