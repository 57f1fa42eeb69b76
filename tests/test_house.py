"""Pages' operators on small tables: ties, ends, lost references, ids in links."""

import datetime as dt

from pyspark.sql import functions as F

from plenum.functions import text
from plenum.operators import house, operations, ranking, textual
from plenum.sources import records


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_references_are_resolved_from_their_page(spark):
    html = """<a href="../a.html#x">1</a><img src='b%20c.png'><a href="/d/?q=1"><a href="https://x.example/y"><video poster = "../../up.jpg">
      <a href="e.csv"><a href="e.csv?again"><a href="mailto:x@y.example"><a href="#top"><a href='sub/./f'><a href="javascript:void(0)">"""
    pages = spark.createDataFrame([("p/q.html", html), ("r.html", "<a href=\"a.html\">")], "path string, html string")
    have = spark.createDataFrame([("a.html",), ("p/b c.png",), ("p/q.html",)], "path string")
    assert rows(operations.broken_references(pages, have)) == [
        ("csv", 1, 1, "p/q.html → e.csv"), ("escapes the site root", 1, 0, "p/q.html → ../../up.jpg"), ("no extension", 2, 0, "p/q.html → /d/"),
    ]
    assert rows(operations.broken(operations.links(pages, "path"), have.select(F.col("path").alias("href")).limit(0)))[0][0] == "../../up.jpg"


def test_readers_scanners_and_beacons(spark):
    def line(ip, path, agent="Firefox", referrer=None, status="200", verb="GET", query="-", day="2024-01-01"):
        return day, ip, agent, path, referrer, verb, status, query

    own = ("own.example",)
    log = [
        line("1", "/"), line("1", "/assets/site.css"), line("1", "/x.html", status="404"), line("1", "/x.html", verb="POST"),
        line("2", "/"), line("3", "/", referrer="https://Other.example/?x=own.example"), line("4", "/", referrer="https://www.own.example/"),
        line("5", "/assets/site.css"), line("5", "/"), line("5", "/.env"), line("6", "/", agent="Googlebot"), line("6", "/assets/site.css", agent="Googlebot"),
        line("7", "/assets/site.css"), *[line("7", "/", day=f"2024-01-0{k}") for k in (1, 1, 2, 2)],
    ]
    schema = "day string, ip string, agent string, path string, referrer string, verb string, status string, query string"
    df = spark.createDataFrame(log, schema)
    page = F.col("path").rlike(r"^/[^.]*(?:\.html)?$")
    seen = operations.views(df, page, "^/assets/", own)
    assert sorted(r.ip for r in seen.collect()) == ["1", "3", "7", "7", "7", "7"]
    assert rows(operations.traffic(seen, heavy=3)) == [("2024-01-01", 2, 2, 1, 2), ("2024-01-02", 0, 0, 1, 2)]
    assert rows(operations.referrers(seen, own, heavy=3)) == [("other.example", 1)]
    more = df.unionByName(spark.createDataFrame([line("8", "/count.txt", query="p=%252Fsz%252F1.html&r=news.example"), line("5", "/count.txt", query="p=/"), line("9", "/count.txt", query="p=evil"), line("9", "/count.txt")], schema))
    counted = operations.views(more, page, "^/assets/", own, beacon="/count.txt")
    assert rows(counted.select("ip", "path", "referrer", "method")) == [("8", "/sz/1.html", "https://news.example/", "beacon"), ("9", "/", None, "beacon")]


def test_strips_and_directories(spark):
    votes = spark.createDataFrame([(k, dt.date(2024, 1, 1)) for k in range(7)] + [(100, dt.date(2024, 1, 2))], "vote int, on_date date")
    got = {r.vote: (r.place, r.first, r["last"], r.previous, r.next) for r in house.day_strips(votes, 4).collect()}
    assert got[0] == (1, 1, 4, None, 1) and got[3] == (4, 2, 5, 2, 4) and got[6] == (7, 4, 7, 5, None) and got[100] == (1, 1, 1, None, None)
    listed = house.directory(spark.createDataFrame([(k, k // 2) for k in range(6)], "k int, v int"), F.col("v"), 3)
    assert {r.k for r in listed.filter("inline").collect()} == {0, 1, 2, 3}
    assert house.directory(listed.drop("inline").limit(0), F.col("v"), 3).count() == 0


def test_small_lookups(spark):
    motions = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (1, 1, "a")], "vote int, motion int, number string")
    votes = spark.createDataFrame([(1,), (2,)], "vote int")
    assert rows(house.with_motions(votes, motions)) == [(1, 1, "a"), (2, None, None)]
    days = spark.createDataFrame([(1, dt.date(2024, 2, 29)), (2, dt.date(2024, 3, 1)), (3, dt.date(2024, 2, 1))], "k int, d date")
    assert sorted(r.k for r in house.in_month(days, "d", "2024-02").collect()) == [1, 3]
    sittings = spark.createDataFrame([(dt.date(2024, 3, 1), 9), (dt.date(2024, 3, 1), 4)], "day date, sitting int")
    assert rows(house.sitting_of(days.select("k", F.col("d").alias("on_date")), sittings).select("k", "sitting")) == [(1, None), (2, 4), (3, None)]
    members = spark.createDataFrame([("a", "A")], "member string, name string")
    cast = spark.createDataFrame([("a", "x"), ("b", "Z"), ("b", "Y"), (None, "n")], "member string, name string")
    assert rows(house.with_stubs(members, cast)) == [("a", "A", False), ("b", "Y", True)]


def test_submitters_and_mandates(spark):
    kind = "struct<benyujto:array<struct<text:string,_href:string>>>"
    ind = spark.createDataFrame(
        [(1, ([("Kiss Éva", "x?p=%7B%22id%22%3A%22k001%22%7D"), ("", None), ("Nagy Pál", "plain")],), ("Bizottság",)), (2, None, None), (3, (None,), ("",))], f"k int, benyujtok {kind}, benyujto struct<_nev:string>"
    )
    got = {r.k: (r.names, r.ids) for r in records.submitters(ind).collect()}
    assert got == {1: (["Kiss Éva", "Nagy Pál", "Bizottság"], ["k001"]), 2: ([], []), 3: ([], [])}
    df = spark.createDataFrame([(x,) for x in ("Fejér 3. OEVK", "Országos lista", "", None)], "c string")
    m = text.mandate_of_record(F.col("c"))
    assert [tuple(r) for r in df.select(*m.values()).collect()] == [("egyeni", "Fejér", 3, None), ("lista", None, None, "Országos lista"), (None,) * 4, (None,) * 4]
    seats = spark.createDataFrame([(dt.date(2014, 5, 5),), (dt.date(2014, 5, 6),)], "d date").select(text.seats_of(F.col("d"))).collect()
    assert [x[0] for x in seats] == [386, 199]


def test_collation_of_cells(spark):
    cells = ["csap", "cukor", "czar", "10", "9", "2.5x", "-1", "állat", "alma", "Zeller", "zsír", ""]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    order = [r.c for r in df.orderBy(text.collation_key(F.col("c"))).collect()]
    assert order[:4] == ["-1", "2.5x", "9", "10"] and order.index("czar") < order.index("csap") < order.index("Zeller") < order.index("zsír")


def test_containing_equals_a_plain_search(spark):
    texts = ["one two three four five six", "x one two three four five y", "one  two three four five", "two three", "a two three b", "four", None, ""]
    asked = ["one two three four five", "two three four", "wo thre", "four", "two three", "e t", "", "none of these words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, body string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query int, question string")
    got = {(r["query"], r.doc) for r in textual.containing(docs, queries).collect()}
    assert got == {(q, d) for q, a in enumerate(asked) for d, t in enumerate(texts) if a and t and a in t}
    assert textual.containing(docs, queries.limit(0)).count() == 0


def test_first_places_beyond_the_top(spark):
    docs = spark.createDataFrame([(k, "word " * (20 - k) + "other") for k in range(15)], "doc long, body string")
    asked = ranking.Ranking(docs, spark.createDataFrame([(1, "word"), (2, "absent"), (3, "oth")], "query long, question string"))
    places = {r["query"]: r.place for r in asked.first_places(spark.createDataFrame([(1, 14), (1, 12), (2, 0), (3, 5)], "query long, doc long")).collect()}
    order = [r.doc for r in asked.top(15).filter("query = 1").orderBy(F.desc("score"), F.desc("doc")).collect()]
    assert places[1] == 1 + min(order.index(14), order.index(12)) and 2 not in places and places[3] >= 1
    assert asked.top(2).filter("query = 2").count() == 0 and ranking.Ranking(docs.limit(0), docs.limit(0), query="doc", question="body").top(3).count() == 0
