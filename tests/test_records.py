"""Adapters of members, committees and bills; passages and their summary; places by postcode or name."""

import datetime as dt

from pyspark.sql import functions as F

from plenum.operators import floor, textual
from plenum.sources import records


def raw(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, raw string")


def test_members(spark):
    xml = """<kepviselok><kepviselo p_azon="a1" nev="Minta Anna" kepv_csop="P" vmegye="Országos lista" vkorzet="" sorszam="1"/>
    <kepviselo p_azon="b2" nev="Minta Pál" kepv_csop="Q" vmegye="Fejér" vkorzet="3"/><kepviselo p_azon="c3" nev="X"/></kepviselok>"""
    got = [(r.member, r.mandate, r.county, r.district, r.ord) for r in records.members(raw(spark, xml, "<kepviselok/>")).orderBy("member").collect()]
    assert got == [("a1", "lista", "Országos lista", None, 1), ("b2", "egyeni", "Fejér", 3, None), ("c3", "other", None, None, None)]


def test_member_record(spark):
    xml = """<kepviselo><nev>Minta Anna</nev><honlap/><ulohely szektor="2" sor="1" szek="14"/>
    <kepvcsop-tagsagok><tagsag ciklus="2022-2026" kepvcsop="P" tol_datum="2022.05.02." ig_datum=""/><tagsag ciklus="2026-" kepvcsop="Q" tol_datum="2026.05.09"/></kepvcsop-tagsagok>
    <tisztsegek><tisztseg megnevezes=" jegyző " tol_datum="2022.05.02."/><tisztseg megnevezes=""/></tisztsegek>
    <iskolak><legmagasabb-elismert>egyetem</legmagasabb-elismert><iskola vegzettseg_kepzettseg="jogász" intezmeny="" ev="1999"/></iskolak>
    <vagyonnyilatkozatok><vagyonnyilatkozat cim="2024" href="" beadva=""/><vagyonnyilatkozat cim="2025" href="h" beadva="igen"/></vagyonnyilatkozatok>
    <javadalmazas><javadalom idoszak="2026.05" brutto_tiszteletdij="-1 200"/></javadalmazas></kepviselo>"""
    rows = records.member_records(raw(spark, xml))
    r = rows.first()
    assert (r.name, r.website, r.highest_degree, tuple(r.seat)) == ("Minta Anna", None, "egyetem", (2, 1, 14))
    assert [(x.grp, x.since, x.until) for x in r.groups] == [("P", dt.date(2022, 5, 2), None), ("Q", dt.date(2026, 5, 9), None)]
    assert [x.office for x in r.offices] == ["jegyző"] and r.languages == [] and r.schools[0].institution is None and r.schools[0].year == 1999
    assert [(x.title, x.url, x.filed) for x in records.section(rows, "declarations").orderBy("ord").collect()] == [("2024", None, False), ("2025", "h", True)]
    assert r.pay[0].gross == -1200


def test_committees_and_spokespersons(spark):
    xml = '<kepviselok><szoszolo p_azon="z" nev="B"/><szoszolo p_azon="y" nev="A" sorszam="2" nemzetiseg="német"/><szoszolo nev="none"/></kepviselok>'
    assert [(r.member, r.place) for r in records.spokespersons(raw(spark, xml)).orderBy("place").collect()] == [("y", 1), ("z", 2)]
    listed = '<bizottsagok><bizottsag id="1" title="T"><albizottsagok><albizottsag id="2" title="S"/></albizottsagok></bizottsag><bizottsag id="3" title="U"/></bizottsagok>'
    assert [(r.id, len(r.subcommittees)) for r in records.committee_list(raw(spark, listed)).orderBy("id").collect()] == [("1", 1), ("3", 0)]
    one = '<bizottsag nev="T" letrehozas="2026.05.09."><elnok p_azon="a" nev="A" frakcio="P"/><tagok><tag p_azon="b" nev="B" frakcio=""/></tagok><meghivo_datum/></bizottsag>'
    r = records.committees(raw(spark, one)).first()
    assert (r.name, r.created, r.parent, r.chair.member, r.members[0].grp, r.vice_chairs, r.next_meeting) == ("T", dt.date(2026, 5, 9), None, "a", None, [], None)


BILL = """<iromany szam="T/71" izon="9"><cim>Cím</cim><tulajdonsagok><tulajdonsag nev="Főtípus" ertek="törvényjavaslat"/><tulajdonsag nev="Benyújtva" ertek="2026.05.20."/>
<tulajdonsag nev="Kihirdetés dátuma" ertek="2026.06.30."/><tulajdonsag nev="Kihirdetés száma" ertek="{}"/><tulajdonsag nev="Benyújtó(k)" ertek="Minta Anna (P), Minta Pál (P)" href="/x/m12"/>
<tulajdonsag nev="Tárgyalási mód" ertek="sürgős, kivételes"/><tulajdonsag nev="Irományszöveg" ertek="PDF" href="/t.pdf"/></tulajdonsagok>
<esemenyek><esemeny><datum>2026.06.01.</datum><leiras>vita</leiras><felszolalas>5/12</felszolalas></esemeny></esemenyek>
<szavazasok><szavazas><datum>2026.06.10.10:00:00</datum><ok>önálló indítvány elfogadva</ok><igen_db>100</igen_db></szavazas>
<szavazas><datum>2026.06.15.10:00:00</datum><ok>önálló indítvány megismételve</ok></szavazas><szavazas><datum>2026.06.16.10:00:00</datum><ok>módosító</ok></szavazas></szavazasok></iromany>"""


def test_bills(spark):
    rows = records.bills(raw(spark, BILL.format("XII"), BILL.format("12"), '<iromany szam="x"><cim/></iromany>')).orderBy("path")
    a, b, c = rows.collect()
    assert (a.law, a.procedure_kind, a.submitter_kind, a.submitter_id, a.text_href, a.number) == ("2026. évi XII. törvény", "kiveteles", "kepviselo", "m12", "/t.pdf", 71)
    assert (a.final_vote, a.days_to_final_vote, a.days_to_promulgation, a.votes[0].yes) == ("2026.06.15.10:00:00", 26, 41, 100)
    assert b.law is None and (c.law, c.submitters, c.submitter_kind, c.final_vote, c.votes, c.events) == (None, [], None, None, [], [])
    speeches = spark.createDataFrame([(5, 12, "s"), (5, 13, "t")], "ulnap int, seq int, speaker string")
    assert {r.speaker for r in records.event_speeches(rows.limit(1), speeches).collect()} == {"s"}


def test_submitter_kind(spark):
    cases = [(["Kormány"], "kormany"), (["igazságügyi miniszter"], "kormany"), (["Gazdasági Bizottság elnöke"], "bizottsag"), (["köztársasági elnök"], "other"), (["Elnök Anna (P)"], "kepviselo"), (["korelnök (P)"], "other"), (["a Kormány"], "kepviselo"), ([], None), (None, None)]
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "i int, n array<string>")
    assert [r.k for r in rows.select("i", records.submitter_kind(F.col("n")).alias("k")).orderBy("i").collect()] == [k for _, k in cases]


def test_technical_kinds(spark):
    rows = spark.createDataFrame([("Expozé", False), ("expozé", True), ("ülésvezetés", False), (None, False)], "kind string, reprint boolean")
    assert [r.t for r in rows.select(floor.technical(F.col("kind"), F.col("reprint")).alias("t")).collect()] == [False, True, True, True]


def test_passages_and_summary(spark):
    passage = " ".join(f"w{i}" for i in range(8))
    day = dt.date(2024, 1, 1)
    rows = [
        (1, "a", "x " + passage + " y", day, "speech", "P"), (2, "b", passage, day + dt.timedelta(3), "speech", "P"), (3, "c", "other words here that nobody else says", day, "speech", "Q"),
        (4, "d", "one two three four five six", day, "speech", "P"), (5, "e", "one two three four five six", day, "question", "Q"), (6, "e", "", day, "question", None), (7, None, None, None, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc int, speaker string, body string, day date, kind string, grp string")
    out = {r.doc: r for r in textual.echo_records(docs, 5).collect()}
    assert set(out) == {1, 4}
    a, b = out[1], out[4]
    assert (a.passage, a.words, a.speakers, a.speeches, a.days, a.lag_days, a.same_day, a.same_kind, a.groups, a.one_group) == (passage, 8, 2, 2, 2, 3, False, True, 1, True)
    assert (b.passage, b.speakers, b.days, b.lag_days, b.same_day, b.same_kind, b.groups, b.one_group) == ("one two three four five six", 2, 1, 0, True, False, 2, False)
    assert tuple(textual.echo_summary(textual.echo_records(docs, 5)).first()) == (2, 1, 1, 1, 1, 1)
    assert tuple(textual.echo_summary(textual.echo_records(docs.limit(0), 5)).first()) == (0, 0, 0, 0, 0, 0)


def test_places(spark):
    towns = spark.createDataFrame([("Győr", ["9021", "9022"]), ("Győrújbarát", ["9081"]), ("Pér", ["9021"]), ("Gyöngyös", None)], "name string, codes array<string>")
    find = lambda typed: [r.name for r in textual.places(towns, typed).orderBy("rank", "name").collect()]
    assert find("9021") == ["Győr", "Pér"] and find("gyor") == ["Győr", "Győrújbarát"] and find("902") == [] and find("g") == [] and find(" GYŐR ") == ["Győr", "Győrújbarát"]
    assert len(textual.places(spark.createDataFrame([(f"Ab{i:02}", []) for i in range(30)], "name string, codes array<string>"), "ab").collect()) == 12
