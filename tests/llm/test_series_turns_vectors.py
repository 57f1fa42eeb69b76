"""Change points, conversation repair and the prefix forest against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from plenum.llm import change_points, conversation_repair, prefix_forest, queries

SPACE = " \t\n\v\f\r"


def cost_of(part):
    n, total, squares = len(part), sum(part), sum(v * v for v in part)
    spread = 1 + (n * squares - total * total) // (n * n)
    return spread, n * math.floor(1000 * math.log(spread))


def best_cut(x, least=5, penalty=10_000):
    """(cost, segments, starts from the last backwards), by all predecessors of each position."""
    n = len(x)
    if n < least:
        return [0], cost_of(x)[1]
    best = {0: (0, 0, ())}
    for j in range(least, n + 1):
        some = [
            (best[i][0] + cost_of(x[i:j])[1] + (penalty if i else 0), best[i][1] + 1, (i, *best[i][2]))
            for i in range(j - least + 1) if i in best
        ]
        if some:
            best[j] = min(some)
    return list(best[n][2][::-1]), best[n][0]


@pytest.mark.parametrize("penalty", [10_000, 300, 0])
def test_cuts_equal_brute_force(penalty):
    rng = np.random.default_rng(penalty)
    series = [
        np.concatenate([rng.integers(0, int(rng.choice([1, 2, 9, 1000])), size=int(rng.integers(1, 20))) for _ in range(5)])[: int(rng.integers(1, 80))]
        for _ in range(50)
    ]
    series += [np.zeros(30, int), np.full(12, 7), np.array([2**40, 1, 2**41, 5, 2**40, 7, 8, 9, 2**33, 0, 0, 0, 0, -5])]
    series = [x.astype(np.int64) for x in series]
    assert change_points.cut_series(series, 5, penalty) == [best_cut([int(v) for v in x], 5, penalty) for x in series]


def test_cuts_of_series_longer_than_a_block():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, m, size=45) for m in (3, 400, 2, 90, 5)]).astype(np.int64)
    assert change_points.cut_series([x, x[:150]]) == [best_cut(list(map(int, x))), best_cut(list(map(int, x[:150])))]


def test_change_points_of_odd_rows(spark):
    rows = [(1, f"2024-01-{d:02d} 10:00:00", 1 if d < 12 else 900 * (d % 2), "a") for d in range(1, 25)]
    rows += [rows[3], rows[3], (None, "2024-02-01 00:00:00", 4, None), (2, None, 5, "b"), (2, "2024-03-01 00:00:00", None, "b"), (3, "2024-05-01 23:59:59", 2, "c")]
    df = spark.createDataFrame(rows, "vendor_id long, shipped_at string, quantity int, k string").selectExpr("vendor_id", "cast(shipped_at as timestamp_ntz) shipped_at", "quantity", "k", "1 as d", "2 as v")
    got = {}
    for r in change_points.change_points(df).collect():
        got.setdefault(r.vendor_id, []).append(tuple(r)[1:])
    assert set(got) == {1, None, 3} and got[3] == [(1, 19844, 1, 2, 1, 0, 1, 0)] and got[None][0][3:6] == (4, 1, 0)
    days = [1 if d < 12 else 900 * (d % 2) for d in range(1, 25)]
    days[3] = 3
    starts, best = best_cut(days)
    want = []
    for no, (a, z) in enumerate(zip(starts, [*starts[1:], 24], strict=True), 1):
        spread, cost = cost_of(days[a:z])
        want.append((no, 19723 + a, z - a, sum(days[a:z]), spread, cost, len(starts), best))
    assert sorted(got[1]) == want and len(want) > 1
    assert change_points.change_points(df.limit(0)).count() == 0


def test_change_points_query_sums_what_the_table_has(spark):
    folder = "/root/testdata/sf0.001"
    got = queries.QUERIES["op11_change_points"](spark, folder).toPandas()
    lines = spark.read.parquet(f"{folder}/sale_lines.parquet").toPandas()
    lines = lines[lines.flag.isin(["kept", "swapped"]) & lines.quantity.notna() & lines.shipped_at.notna()]
    for vendor, part in lines.groupby("vendor_id"):
        day = part.shipped_at.dt.normalize().astype("datetime64[s]").astype("int64") // 86_400
        sums = part.quantity.groupby(day).sum()
        x = [int(sums.get(d, 0)) for d in range(day.min(), day.max() + 1)]
        starts, best = best_cut(x)
        mine = got[got.vendor_id == vendor].sort_values("segment_no")
        assert list(mine.first_day - day.min()) == starts and set(mine.best_cost) == {best} and list(mine.total) == [sum(x[a : a + n]) for a, n in zip(starts, mine.n_days, strict=True)]
    assert got.vendor_id.nunique() == lines.vendor_id.nunique()


LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, repaired rows) of the cheapest edits of (role, text, fault), by trying all of them."""
    best = None

    def step(i, out, cost, audit, new):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and LEGAL.match("".join(r[:1] for r, _ in out)):
            best = min(best, (cost, audit, out)) if best else (cost, audit, out)
        if new < 2:
            for who in ("user", "assistant"):
                step(i, [*out, (who, "")], cost + 3, audit + "I", new + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            step(i + 1, out, cost + 4, audit + "D", 0)
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                step(i + 1, [*out, (role, text)], cost + more, audit + "K", 0)
                for who in ("user", "assistant"):
                    step(i + 1, [*out, (who, text)], cost + more + 3, audit + "R", 0)

    step(0, [], 0, "", 0)
    return best


def test_audits_equal_all_edits():
    rnd = random.Random(5)
    signatures = ["", *conversation_repair.SYMBOLS, *("".join(rnd.choices(conversation_repair.SYMBOLS, k=k)) for k in (2, 3, 4, 4, 4) for _ in range(40))]
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for signature in signatures:
        rows = [(names[conversation_repair.ROLES[k // 4]], f"t{j}", k % 4) for j, k in enumerate(map(conversation_repair.SYMBOLS.index, signature))]
        cost, audit, out = cheapest(rows)
        assert conversation_repair.solve(signature) == (cost, audit)
        assert [x[1:] for x in conversation_repair.replay([r[:2] for r in rows], audit)] == out


def test_long_signatures_are_solved():
    clean = conversation_repair.symbol("user", 0) + conversation_repair.symbol("assistant", 0)
    assert conversation_repair.solve(clean * 50_000) == (0, "K" * 100_000)
    assert conversation_repair.solve(conversation_repair.symbol("user", 1) * 5000) == (20_000, "D" * 5000)


def repaired_by_hand(rows):
    """The query's rows for (conv_id, turn, role, text), in plain Python."""
    word = lambda x: " " if x is None else str(x)
    convs = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = word(role), word(text)
        fate = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        convs[c] += [(t, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, flagged = set(), []
        for _, role, text in turns:
            body = text.strip(SPACE)
            flagged.append((role, text, 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
            seen.add((role, text))
        known = {t for t, _, _ in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        initials = [r[:1] for r, _, _ in flagged]
        illegal = sum("".join(x) not in ("su", "ua", "au") for x in itertools.pairwise(initials))
        cost, audit, out = cheapest(flagged)
        faults = [f for _, _, f in flagged]
        yield c, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_conversations_equal_all_edits(spark, tmp_path):
    rnd = random.Random(3)
    texts = ["Well.", "Well.", "No end", "Why?\n", " ", "", None, "Ends. ", "a\x85", "Long " * 3000 + "!", "é." ]
    rows = [(c, t, rnd.choice(["user", "assistant", "user", "assistant", "system", None, "tool"]), rnd.choice(texts)) for c in range(150) for t in rnd.sample(range(9), rnd.randint(1, 4))]
    rows += [rows[0], rows[0], (None, None, "user", "x."), (None, 1, "assistant", "y."), (7000, None, None, None), (2**62, -5, "user", "z"), (7001, 3, "user", "é.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.selectExpr("*", "1 as conv", "'x' as audit", "true as head").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(repaired_by_hand(rows), key=key)
    assert any(r[7] == "" for r in got) and {x for r in got for x in r[7]} == set("DIKR")


def test_repair_returns_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi there."), (1, 2, "assistant", "Bye.")], "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in conversation_repair.repair(df).orderBy("conv", "place").collect()]
    assert got == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hello."), (1, 2, "K", "user", "Hi there."), (1, 3, "K", "assistant", "Bye.")]
    assert conversation_repair.repair(df.limit(0)).count() == 0 and conversation_repair.digests(df.limit(0), every=df.limit(0)).count() == 0


def nearest_by_hand(rows, asked, k):
    out = {}
    for q, x in asked:
        scores = sorted(((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in rows if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def test_forest_of_a_small_table_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.float32(rng.standard_normal(6) * rng.uniform(0.2, 3))]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)] + [(2000, [1.0, 2.0]), (2001, [0.0, -0.0, 0.5, 0.0, 0.0, 0.0])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [1.0, None]), (3004, [float("nan")] * 6), (3005, [float("inf")] * 6), (None, [1.0] * 6), rows[5]]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, id string")
    got = {}
    for r in prefix_forest.nearest(df, df.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = nearest_by_hand(rows, [(i, v) for i, v in rows if i % 20 == 0], 20)
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in best] and np.allclose([s for _, s in got[q]], [s for _, s in best], atol=1e-9)
    assert prefix_forest.nearest(df.limit(0), df, k=3).count() == 0 and prefix_forest.nearest(df, df.limit(0), k=3).count() == 0
    assert prefix_forest.nearest(df.filter("vec_id in (0, 1, 2)"), df.filter("vec_id = 0")).count() == 2


def test_forest_descends_chunks_and_asks_again(spark, monkeypatch):
    """Cells that begin at a prefix, large cells in chunks and parts, and queries that find too little there."""
    monkeypatch.setattr(prefix_forest, "CELL", 150)
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 6))
    points = np.vstack([centres[rng.integers(0, 12, 3900)] + 0.3 * rng.standard_normal((3900, 6)), rng.standard_normal((100, 6))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0")
    shape = prefix_forest.Shape(4000, 6, 1.0, 24, 2.0)
    assert shape.start() > 0
    found = prefix_forest.nearest(df, asked, k=5, trees=24, budget=2.0).cache()
    assert found.groupBy("query_id").count().filter("count = 5").count() == 200
    assert prefix_forest.recall(df, asked, found, k=5) > 0.6
    more = prefix_forest.nearest(df, asked, k=5, trees=24, budget=40.0)
    assert prefix_forest.recall(df, asked, more, k=5) > 0.97


def test_forest_reaches_its_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = queries.QUERIES["op13_prefix_forest"](spark, "/root/testdata/sf0.1").cache()
    assert prefix_forest.recall(table, table.filter("vec_id % 20 = 0"), found) >= 0.95
