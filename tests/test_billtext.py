"""Bill structure against a plain reading of the whole text, page by page."""

import random
import re

import numpy as np
import pytest

from plenum.operators import billtext

PAGES = [
    "T/1. számú törvényjavaslat\nIndokolás\n1. § [Cím]\nszöveg\n 12. § (1) A törvény",
    "2. § (1) bekezdésében foglalt\n2. §\n7. § Idézett\n1",
    "3. § (1) A\n4. § Az idézett szöveg itt kez-\ndődik és",
    "a következő oldalon „végződik”.\n6. § Hatály\n3. cikk Nem sajátja",
    "1. melléklet a 2024. évi ... törvényhez\n1. cikk bármi\n2. cikk más\n8. § A mellékletben",
    "2. melléklet a 2024. évi … törvényhez\n1. cikk\n1. cikk",
    "Általános indokolás\n9. § Az indokolásban\n1. § A törvény\na következő oldalon végződik.",
]


@pytest.fixture(scope="module")
def pages(spark):
    other = ["1. cikk Alaptörvény\n2. cikk (1) A\n2. cikk (1) bekezdés", "3. cikk\nsemmi", None]
    rows = [("a", k, p) for k, p in enumerate(PAGES, 1)] + [("b", k, p) for k, p in enumerate(other, 1)] + [("c", 1, None)]
    return spark.createDataFrame(rows, "bill string, page int, body string").repartition(3)


def test_units(pages):
    got = {(r.bill, r.kind, r.annex, r.number): r.page for r in billtext.units(pages).collect()}
    assert got == {
        ("a", "section", 0, 1): 1, ("a", "section", 0, 2): 2, ("a", "section", 0, 3): 3, ("a", "section", 0, 4): 3, ("a", "section", 0, 6): 4,
        ("a", "annex", 0, 1): 5, ("a", "annex", 0, 2): 6, ("a", "annex article", 1, 1): 5, ("a", "annex article", 1, 2): 5, ("a", "annex article", 2, 1): 6,
        ("b", "article", 0, 1): 1, ("b", "article", 0, 2): 1, ("b", "article", 0, 3): 2,
    }
    assert {(r.bill, tuple(r["at"])) for r in billtext.reasons(pages).collect()} == {("a", (7, 0))}


def test_citations(spark, pages):
    cites = [("a", c) for c in ("2. § (3)", "4–13. §", "5. §", "1. melléklet 2. cikk", "2. melléklet", "2. cikk", "3. melléklet", "az indokolás", "99. §", None)]
    cites += [("b", "3. cikk"), ("b", "2. Cikk"), ("b", "1. §"), ("d", "1. §"), ("a", "2. § (3)")]
    df = spark.createDataFrame(cites, "bill string, cite string")
    got = sorted((r.bill, r.cite or "", r.page) for r in billtext.cited_pages(df, billtext.units(pages)).collect())
    want = {"2. § (3)": 2, "4–13. §": 3, "5. §": None, "1. melléklet 2. cikk": 5, "2. melléklet": 6, "2. cikk": 5, "3. melléklet": None, "az indokolás": None, "99. §": None}
    want = [("a", c or "", want.get(c)) for b, c in cites if b == "a"] + [("b", "3. cikk", 2), ("b", "2. Cikk", 1), ("b", "1. §", None), ("d", "1. §", None)]
    assert got == sorted(want, key=lambda r: r[:2]) and len(got) == len(cites)
    near = spark.createDataFrame([("x", "section", 0, 4, 3), ("x", "section", 0, 6, 3)], "bill string, kind string, annex int, number int, page int")
    assert billtext.cited_pages(spark.createDataFrame([("x", "5. §")], "bill string, cite string"), near).first().page == 3
    problems = {r.cite: r.problem for r in billtext.cite_problems(df).collect()}
    assert problems["az indokolás"] == "the reasoning" and problems[None] == "no unit of the bill" and problems["4–13. §"] is None


def test_quotes(spark, pages):
    asked = [("a", q) for q in ("idézett szöveg itt kezdődik és a következő oldalon végződik.", "a következő oldalon", "«A törvény»", "Idézett", "nincs ilyen", "", None)]
    got = {r.quote: (r.page, r.problem) for r in billtext.quoted_pages(spark.createDataFrame(asked, "bill string, quote string"), pages).collect()}
    assert got == {
        asked[0][1]: (3, "not from the reasoning"), "a következő oldalon": (7, None), "«A törvény»": (7, None), "Idézett": (2, "not from the reasoning"),
        "nincs ilyen": (None, "not verbatim"), "": (None, "not verbatim"), None: (None, "not verbatim"),
    }


def test_quotes_over_many_short_pages_equal_a_whole_text_search(spark):
    rnd = random.Random(1)
    words = ["ab", "a", "b", "ba", ""]
    pages = {b: [" ".join(rnd.choices(words, k=rnd.randint(0, 4))) for _ in range(30)] for b in "xyz"}
    plain = lambda s: re.sub(r"\s+", " ", s).strip()
    asked, want = [], {}
    for b, texts in pages.items():
        starts, joined = [], ""
        for t in texts:
            starts.append(len(joined))
            joined += plain(t) + " "
        for _ in range(40):
            at = rnd.randrange(len(joined) - 8)
            q = plain(joined[at : at + rnd.randint(2, 25)]) if rnd.random() < 0.8 else plain(" ".join(rnd.choices(words[:4], k=5)))
            if q and (b, q) not in want:
                asked.append((b, q))
                hit = joined.find(q)
                want[b, q] = max(k for k, s in enumerate(starts, 1) if s <= hit) if hit >= 0 else None
    rows = spark.createDataFrame([(b, k, t) for b, texts in pages.items() for k, t in enumerate(texts, 1)], "bill string, page int, body string")
    got = {(r.bill, r.quote): r.page for r in billtext.quoted_pages(spark.createDataFrame(asked, "bill string, quote string"), rows.repartition(5)).collect()}
    assert got == want and None in want.values() and len(want) > 60


def test_growing_runs_equal_all_pairs():
    rng = np.random.default_rng(0)
    for n in [0, 1, *rng.integers(2, 30, 60)]:
        x = rng.integers(0, 12, n)
        best = [(1, -1)] * n
        for k in range(n):
            for j in range(k):
                if x[j] < x[k] and best[j][0] + 1 > best[k][0]:
                    best[k] = (best[j][0] + 1, j)
        want, at = [], max(range(n), key=lambda k: best[k][0]) if n else -1
        while at >= 0:
            want.append(at)
            at = best[at][1]
        assert billtext.growing(x.tolist()) == want[::-1]


def test_annexes_are_blanked(pages):
    got = {(r.bill, r.page): r.body for r in billtext.without_annexes(pages).collect()}
    assert got["a", 5] == got["a", 6] == "" and got["a", 7] == PAGES[6] and got["a", 4] == PAGES[3] and got["b", 1] and len(got) == 11
