"""Steps whose work grew faster than their input, or that were taken several times."""

import random  # noqa: F401

from pyspark.sql import functions as F  # noqa: F401


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_parsed_once(spark):
    from plenum.sources import payloads

    rows = [("a", '<x><cim nev="1"/></x>'), ("b", '<x><cim nev="a "b" & c"/></x>'), ("c", "<x><cim"), ("d", None)]
    out = payloads.parse(spark.createDataFrame(rows, "path string, raw string"), "cim:struct<_nev:string>").filter("doc is not null or path <> 'z'")
    got = {r.path: (r.doc and r.doc.cim and r.doc.cim._nev, r.repaired) for r in out.collect()}
    assert got == {"a": ("1", False), "b": ('a "b" & c', True), "c": (None, True), "d": (None, True)}
    assert plan(out.select("doc.cim._nev", "repaired")).lower().count("xml") == 2


def test_echoes_count_only_what_several_speakers_may_have_said(spark):
    from plenum.operators import textual

    rng = random.Random(5)
    shared = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)] for n in (6, 9, 14)]
    docs = []
    for n in range(40):
        own = [f"w{n}x{k}" for k in range(90)]
        for passage in rng.sample(shared, 2):
            own[(at := rng.randrange(80)) : at] = passage
        docs.append((n, None if n % 9 == 0 else f"s{n % 4}", " ".join(own)))
    df = spark.createDataFrame(docs + [(90, "s1", None), (91, "s1", "(left out)")], "doc long, speaker string, body string").repartition(3)
    for k in (1, 5, 8):
        want, every = {}, 0
        for doc, speaker, body in docs:
            w = body.split()
            for at in range(len(w) - k + 1):
                every += 1
                want.setdefault(tuple(w[at : at + k]), []).append((doc, speaker))
        want = sorted((len(v), len({d for d, _ in v}), len({s for _, s in v if s}), min(v)[0]) for v in want.values() if len({s for _, s in v if s}) >= 2)
        got = textual.echoes(df, k).select("occurrences", "docs", "speakers", "first_doc").collect()
        assert sorted(map(tuple, got)) == want
        n = textual.grams(df, k).count(), textual.grams(df, k, 2).count()
        assert n[0] == every and n[1] < every / 2, (k, n)


def test_two_edits_are_for_words_with_nothing_within_one(spark):
    from plenum.operators import textual
    from tests.test_catalogue import edits

    rng = random.Random(2)
    known = list({"".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(300)})
    asked = [w for w in known if rng.random() < 0.4] + ["ab", "", "ccc", "zzzzzzzz", None]
    vocabulary = [(w, rng.randint(1, 9)) for w in known]
    out = textual.did_you_mean(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(vocabulary, "word string, n long"), itself=False)
    want = {}
    for a in filter(None, asked):
        near = [(d, -n, w) for w, n in vocabulary if w != a and (d := edits(a, w)) <= (2 if len(a) >= 8 else 1)]
        if near:
            want[a] = (min(near)[2], min(near)[0])
    assert {d for _, d in want.values()} == {1, 2}
    assert {r.asked: (r.word, r.d) for r in out.collect()} == want
    assert "explode" not in plan(out).lower()  # no row of text a cut-out


def test_a_task_looks_at_few_tokens_together(spark, monkeypatch):
    import pyarrow as pa

    from plenum.operators import ranking

    rng = random.Random(4)
    lists = [["t"] * rng.choice([0, 1, 5, 40]) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(lists, pa.list_(pa.string()))], names=["doc", "t"]).slice(3, 50)
    monkeypatch.setattr(ranking, "TOKENS", 20)
    pieces = list(ranking._pieces(batch, 1))
    assert [d for p in pieces for d in p.column(0).to_pylist()] == list(range(3, 53))
    assert all(len(p) == 1 or len(p.column(1).flatten()) <= 20 for p in pieces) and len(pieces) > 10
    assert list(ranking._pieces(batch.slice(0, 0), 1)) == []


def test_text_ahead_is_found_once(spark, monkeypatch):
    from plenum.operators import billtext

    made = []
    monkeypatch.setattr(billtext, "containing", lambda text, *a, real=billtext.containing, **b: (made.append(plan(text)), real(text, *a, **b))[1])
    pages = spark.createDataFrame([(1, 1, "one two three four"), (1, 2, "five six seven"), (2, 1, "one two")], "bill int, page int, body string")
    quotes = spark.createDataFrame([(1, "two three four five"), (1, "six seven"), (2, "two three four five")], "bill int, quote string")
    got = {(r.bill, r.quote): r.page for r in billtext.quoted_pages(quotes, pages).collect()}
    assert got == {("1", "two three four five"): 1, ("1", "six seven"): 2, ("2", "two three four five"): None}
    assert made and "MapInArrow" not in made[0]


def test_rows_of_one_document_are_one_posting(spark):
    from plenum.operators import textual

    docs = [(1, "alpha beta"), (1, "alpha gamma delta"), (2, "alpha " * 300), (3, None), (None, "beta"), (None, "beta gamma")]
    out = textual.index_shards(spark.createDataFrame(docs, "doc int, body string").repartition(3), block=65_536)
    got = {r.token: (r.df, [tuple(p) for p in r.postings]) for r in out.collect()}
    assert got == {"alpha": (2, [(1, 2), (2, 255)]), "beta": (2, [(None, 2), (1, 1)]), "gamma": (2, [(None, 1), (1, 1)]), "delta": (1, [(1, 1)])}
