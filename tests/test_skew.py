"""Operators whose one key may have most rows: the same answers, in bounded pieces."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from plenum.operators import groups, relational, series, textual


def test_as_of_of_one_hot_key(spark):
    rnd = random.Random(6)
    right = sorted({rnd.randrange(5000) for _ in range(700)})
    rows = [("hot", t, None if t % 13 == 0 else t * 10) for t in right] + [("cold", 900, 5), ("none", 3, None)]
    left = [(k, rnd.choice(["hot", "hot", "hot", "cold", "none", "lost"]), rnd.randrange(-50, 5100)) for k in range(900)]
    r = spark.createDataFrame(rows, "k string, at long, v long")
    l = spark.createDataFrame(left, "id int, k string, t long")  # noqa: E741
    got = {x.id: x.v for x in series.as_of(l, r, "k", "t", "at", "v", pieces=8).collect()}
    by = collections.defaultdict(list)
    for k, t, v in rows:
        by[k].append((t, v))
    want = {}
    for i, k, t in left:
        held = [v for at, v in by[k] if at <= t and v is not None]
        first = by[k][0][1] if by[k] else None
        want[i] = held[-1] if held else first
    assert got == want
    # no piece of the hot key has more than a part of it
    pieces = series.as_of(l, r, "k", "t", "at", "v", pieces=8)._jdf.queryExecution().analyzed().toString()
    assert "__piece" in pieces


def test_pairs_of_a_large_group_meet_in_tiles(spark):
    rnd = random.Random(7)
    rows = [(v, m, "big" if m < 40 else "small", rnd.choice(["yes", "no", "absent"])) for v in range(6) for m in range(50)]
    df = spark.createDataFrame(rows, "vote int, member int, grp string, position string")
    want = collections.Counter()
    same = collections.Counter()
    for v in range(6):
        cast = [(m, g, p) for w, m, g, p in rows if w == v and p != "absent"]
        for a, ga, pa in cast:
            for b, gb, pb in cast:
                if a < b and ga == gb:
                    want[a, b] += 1
                    same[a, b] += pa == pb
    for tile in (1000, 7):
        got = {(r.a, r.b): (r.n, r.same) for r in groups.member_pairs(df, least=2, tile=tile).collect()}
        assert got == {k: (n, same[k]) for k, n in want.items() if n >= 2}


def test_digest_trees_grow_with_their_lines(spark):
    rows = [("big", k, f"text {k}") for k in range(3000)] + [("small", k, "x") for k in range(3)] + [(None, 1, "y")]
    df = spark.createDataFrame(rows, "service string, name int, body string")
    got = {r.service: (r.n, r.digest) for r in relational.chain_digest(df.repartition(5), "service", "name", F.col("body"), leaf=5).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = collections.defaultdict(list)
    for s, k, body in rows:
        if s == "big":
            level[hashlib.md5(str(k).encode()).hexdigest()[:4]].append(f"{k} {sha(body)}")
    nodes = {p: sha("\n".join(sorted(x))) for p, x in level.items()}
    up = collections.defaultdict(list)
    for p, d in nodes.items():
        up[p[:2]].append(f"{p} {d}")
    top = sorted(f"{p} {sha(chr(10).join(sorted(x)))}" for p, x in up.items())
    assert got["big"] == (3000, sha("\n".join(top))) and got["small"][0] == 3 and got[None][0] == 1
    assert max(map(len, level.values())) < 10


def test_postings_of_a_frequent_token_are_in_blocks(spark):
    docs = spark.createDataFrame([(k, "common " * (k % 3 + 1) + f"rare{k}") for k in range(200)], "doc int, body string")
    got = textual.index_shards(docs, block=30).toPandas()
    common = got[got.token == "common"]
    assert len(common) == 7 and set(common.df) == {200} and max(len(p) for p in common.postings) < 60
    assert sorted((d, tf) for p in common.postings for d, tf in p) == [(k, k % 3 + 1) for k in range(200)]
    assert all(list(p) == sorted(p) for p in got.postings) and len(got[got.token != "common"]) == 200
