"""The corpus operators against brute force, on small tables with nulls, empties, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenum.llm import byte_bpe, exact_dedup, mixing, near_dedup, pieces, pseudonyms, queries, search, substring_dedup, suffix, token_store, toxicity, warc

SCHEMA = "doc_id long, text string, source string, __id string, kept string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 3}", "x", "y") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(30))
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "one two"), (5, "Öl, 漢字   \x1c <|endoftext|> a  b\n\nc 😀")]
    base = [word() for _ in range(60)]
    for i in range(6, 40):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(60)] = word()
        body = " ".join(word() for _ in range(rng.randint(1, 80)))
        out.append((i, " ".join(near) if i % 3 == 0 else body + " " + passage + " " + word() if i % 3 == 1 else body))
    out += [(40, out[10][1]), (41, out[11][1].replace(" ", "\n") + " "), (42, "a " * 30_000)]
    return out


@pytest.mark.parametrize("run", [4096, 2])
def test_exact_dedup(spark, texts, monkeypatch, run):
    monkeypatch.setattr(exact_dedup, "RUN", run)
    monkeypatch.setattr(exact_dedup, "FAN", 3)
    monkeypatch.setattr(exact_dedup, "RANGE", 16)
    rows = texts + [(50, texts[20][1]), (50, texts[20][1]), (None, texts[21][1]), ((1 << 63) - 1, "last"), (None, "last"), (None, "no id"), (None, "no id")]
    rows += [(200 + k, "hot text") for k in range(30)]
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append((-len(t or ""), 1 << 63 if i is None else i))
    best = {p: min(g) for p, g in groups.items()}
    keep = lambda t: best[plain(t)][1] if best[plain(t)][1] < 1 << 63 else None
    stays = lambda i, t: best[plain(t)] == (-len(t or ""), 1 << 63 if i is None else i)
    want = sorted(str((i, keep(t), len(groups[plain(t)]), stays(i, t), hashlib.sha256(plain(t).encode()).hexdigest())) for i, t in rows)
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == want
    stay = exact_dedup.keep_rows(table(spark, rows))
    assert sorted(str(r.doc_id) for r in stay.collect()) == sorted(str(i if i < 1 << 63 else None) for _, i in best.values())
    assert stay.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def components(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and den * both >= num * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_near_dedup(spark, texts, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 5)
    monkeypatch.setattr(near_dedup, "PART", 3)
    for width, num in ((3, 85), (5, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(table(spark, texts), width=width, num=num).collect()}
        assert got == components(texts, width, num, 100)
    one = near_dedup.near_dedup(table(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in one) == [("1", 1, True), ("1", 1, True), ("None", None, True)]


def test_bayes_bounds():
    plan = near_dedup.Plan(85, 100)
    assert all(0 < m < n for m, n in zip(plan.least, plan.looks, strict=True))
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for share, alive in ((0.95, True), (0.4, False)):
        n = int(2000 * share)
        other = np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)]))
        sig = [plan.signature(np.unique(x)).astype("<u2") for x in (base, other)]
        assert (len(plan.alive(sig[0], sig[1][None, :])) == 1) == alive


def test_suffix_arrays(monkeypatch):
    rng = random.Random(2)
    for turn in range(400):
        monkeypatch.setattr(suffix, "LONG", rng.choice([4, 1000]))
        made = [bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        ends = np.cumsum([0] + [len(t) for t in made])
        got = suffix.suffix_arrays(np.frombuffer(b"".join(made), np.uint8), ends)
        for a, t in zip(ends.tolist(), made, strict=False):
            assert [x - a for x in got[a : a + len(t)].tolist()] == sorted(range(len(t)), key=lambda i: t[i:])


@pytest.mark.parametrize("hot", [2, 256])
def test_substring_dedup(spark, texts, monkeypatch, hot):
    for name, value in (("HOT", hot), ("PACK", 3000), ("HOME", 6), ("WAVE", 500), ("SLICE", 700)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = texts + [(60, "ab" * 200), (61, "xab" + "ab" * 40 + "y"), (62, texts[20][1]), (62, texts[20][1]), (63, "a " * 3000 + "b"), (None, texts[25][1]), (None, texts[25][1] + "q" * 60), (None, "q" * 60)]
    rows = [(1 << 62 if i is None else i, t) for i, t in rows]
    first = {}
    raw = sorted((i, (t or "").encode()) for i, t in rows)
    for i, t in raw:
        for s in range(len(t) - 49):
            first.setdefault(t[s : s + 50], i)
    want = []
    for i, t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        want.append((None if i == 1 << 62 else i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    got = substring_dedup.remove_repeats(table(spark, [(None if i == 1 << 62 else i, t) for i, t in rows])).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize(("first", "then"), [(0, 1), (1, 0)])
def test_substring_dedup_of_a_text_of_one_string(spark, first, then):
    """A document of just ``width`` bytes and one that holds it within a longer passage share a home."""
    rng = random.Random(11)
    long = "".join(rng.choice("abcdefghij ") for _ in range(400))
    one = long[150:200]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, [(first, one), (then, long)])).collect()}
    later = max(first, then)
    assert {i: r.n_removed for i, r in got.items()} == {later: 50, 1 - later: 0}
    assert got[later].kept_sha256 == hashlib.sha256((long[:150] + long[200:] if later == then else "").encode()).hexdigest()


def test_substring_dedup_cuts_texts_to_what_they_share(monkeypatch):
    """Twenty texts with one core and edges of their own: the core is not in the array twenty times, and flags are those of plain search."""
    rng, entered, arrays = random.Random(5), [0], substring_dedup.suffix_arrays
    monkeypatch.setattr(substring_dedup, "suffix_arrays", lambda buf, bounds: entered.append(len(buf)) or arrays(buf, bounds))
    some = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    core = some(400)
    texts = [bytes([128 + k]) * 30 + (core if k % 3 else core[60:330]) + bytes([160 + k]) * 30 for k in range(20)]
    docs = [rng.randint(0, 9) for _ in texts]
    own, later = substring_dedup.repeats(texts, docs, [7] * 20, 50)
    holders: dict[bytes, int] = {}
    for text, doc in zip(texts, docs, strict=True):
        for a in range(len(text) - 49):
            holders[text[a : a + 50]] = min(doc, holders.get(text[a : a + 50], doc))
    want = [a + 50 <= len(t) and d > holders[t[a : a + 50]] for t, d in zip(texts, docs, strict=True) for a in range(len(t))]
    assert own.tolist() == want and any(want)
    assert later.tolist() == [a + 50 <= len(t) for t in texts for a in range(len(t))]
    assert 0 < sum(entered) <= 2 * len(core)


def test_substring_dedup_is_decided_by_suffix_arrays(spark, texts, monkeypatch):
    def none(texts, docs, homes, width):
        return (np.zeros(sum(map(len, texts)), bool),) * 2

    monkeypatch.setattr(substring_dedup, "repeats", none)
    assert substring_dedup.remove_repeats(table(spark, texts + [(62, texts[20][1])])).agg(F.sum("n_removed")).first()[0] == 0


def test_byte_bpe(spark, texts):
    import tiktoken

    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pieces.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in byte_bpe.round_trip(table(spark, texts), path, pattern).collect()}
    for i, t in texts:
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(table(spark, texts), path, pattern), path, pattern)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in texts}
    bpe = byte_bpe.load(path, pattern)
    rng = random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice("a'sé1. \n\t\r\x0b\x85\xa0 \x1c　!ñ漢😀the") for _ in range(rng.randint(0, 14)))
        assert bpe.encode_batch([t.encode()])[0].tolist() == enc.encode_ordinary(t)
    stream = byte_bpe.StreamDecoder(bpe)
    ids = bpe.encode_batch(["漢😀é".encode()])[0].tolist()
    assert "".join(stream.feed([i]) for i in ids) == "漢😀é" and bpe.offsets("né")[-1][2] == 3


def test_token_store(spark, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SHARD_BYTES", 20_000)
    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = str(tmp_path / "store")
    token_store.write_store(table(spark, texts), out, path, end_id=2)
    want, at = {}, 0
    for i, t in sorted(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_summary(spark, out).collect()} == want
    twice = [(None, "a b"), (7, "c d e"), (7, "c d e"), (2, "")]
    token_store.write_store(table(spark, twice), out + "2", path, end_id=2)
    sizes = [len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in ("a b", "", "c d e", "c d e")]
    assert sorted((r.start, str(r.doc_id), r.n_tokens) for r in token_store.read_summary(spark, out + "2").collect()) == [(sum(sizes[:k]), i, sizes[k]) for k, i in enumerate(["None", "2", "7", "7"])]
    assert token_store.lookup(spark, out, [5]) == {5: tok.encode(texts[5][1], add_special_tokens=False).ids + [2]}


def test_token_store_composes_before_lower_case():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    tok, enc = Tokenizer.from_file(path), token_store.WordEncoder(path, None)
    pairs = ["T\u0308", "H\u0331", "J\u030c", "W\u030a", "Y\u030a"]
    texts = pairs + [x.lower() for x in pairs] + [" ".join(f"One {x}wo, ABC{x}. É E\u0301 I\u0307 THE end." for x in pairs), "ASCII Only. Text", "T\u0323\u0308 T\u1dc2\u0308 T\u0344 ABT\u0308CD"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("aTHJWYKSİ .,é\u0308\u0331\u030c\u030a\u0323\u1dc2\u05b0\u0344") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert np.frombuffer(enc.encode_batch([t.encode()])[0], enc.width).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_search(spark, texts, monkeypatch):
    import math
    from collections import Counter

    monkeypatch.setattr(search, "SHARD_BYTES", 3000)
    monkeypatch.setattr(search, "QUERY_BYTES", 2000)
    monkeypatch.setattr(search, "BLOCK", 4)
    texts = texts + [(70, "x\u0301y\u00b2 z\u0345 caf\u00e9 cafe\u0301"), (71, texts[20][1]), (71, texts[20][1]), (None, "one two")]
    rows = [(i, Counter(re.findall(r"\w+", (t or "").lower()))) for i, t in texts if i is not None]
    n, df, mean = len(rows), Counter(t for _, c in rows for t in c), sum(sum(c.values()) for _, c in rows) / len(rows)
    got = {}
    for r in search.top_k(table(spark, texts), table(spark, texts[:20] + texts[-4:-1] + [(None, "one")]), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 4)))
    for q, qc in rows[:20] + rows[-3:]:
        scored = []
        for i, c in rows:
            dl = sum(c.values())
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * dl / mean)) for t, m in qc.items() if t in c)
            if s > 0:
                scored.append((-round(s, 6), i))
        assert got.get(q, []) == [(i, round(-s, 4)) for s, i in sorted(scored)[:3]]


def test_search_scores_queries_together(monkeypatch):
    """A shard's best for 300 queries are those of plain sums, with any share of terms as a matrix; with high scores already found, steps don't grow with queries."""
    rng, k, mean = np.random.default_rng(5), 3, 9.0
    monkeypatch.setattr(search, "BLOCK", 16)
    counts = rng.poisson(rng.zipf(1.3, 80).clip(1, 50)[::-1] ** -1.0, (203, 80)) * rng.integers(0, 2, (203, 80))
    counts[150:160] = counts[7]  # equal scores: the smaller ids are first
    docs, terms = np.nonzero(counts)
    turn = np.lexsort((docs, terms))
    ends = np.cumsum(np.bincount(terms, minlength=80))
    shard = {"ids": rng.permutation(203) + 1000, "lengths": counts.sum(axis=1), "terms": np.arange(80) * 3, "ends": ends, "docs": docs[turn], "counts": counts[docs, terms][turn]}
    vocabulary = np.sort(np.append(np.arange(0, 80, 2) * 3, [5, 500]))
    asked = rng.random((300, len(vocabulary))) < 0.2
    asked[:, -1], asked[17] = True, False
    owner, rows = np.nonzero(asked)
    factor, stops = rng.random(len(rows)) * 9 + 0.1, np.cumsum(asked.sum(axis=1))
    weights = counts * 2.2 / (counts + 1.2 * (0.25 + 0.75 * counts.sum(axis=1) / mean)[:, None])
    place = {t: i for i, t in enumerate(shard["terms"].tolist())}
    value = np.zeros((300, 203))
    for q, row, f in zip(owner.tolist(), rows.tolist(), factor.tolist(), strict=True):
        value[q] += f * weights[:, place[t]] if (t := int(vocabulary[row])) in place else 0.0
    want = [sorted((-round(x, 6), int(i)) for x, i in zip(v, shard["ids"], strict=True) if round(x, 6) > 0)[:k] for v in value]
    steps, spread = [], search._spread
    monkeypatch.setattr(search, "_spread", lambda *a: (steps.append(1), spread(*a))[1])

    def best(top):
        out = [[] for _ in range(300)]
        for q, ids, scores in search.Shard(shard, vocabulary, mean).best(rows, factor, stops, k, top):
            out[q] = sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:k]
        return out

    for shared, most, postings in ((320, 16 << 20, 4 << 20), (10**9, 16 << 20, 4 << 20), (10, 30 * 300, 50), (0, 0, 7)):
        for name, v in (("SHARED", shared), ("CELLS", most), ("POSTINGS", postings)):
            monkeypatch.setattr(search, name, v)
        got = best(np.zeros((300, k)))
        assert [[i for _, i in g] for g in got] == [[i for _, i in w] for w in want] and got[17] == []
        assert all(abs(a[0] - b[0]) < 2e-6 for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))
    monkeypatch.setattr(search, "POSTINGS", 4 << 20)
    top = np.array([[-x for x, _ in w] + [0.0] * (k - len(w)) for w in want])
    steps.clear()
    assert all(not g for g in best(np.repeat(top[:, :1] * 1.01 + 0.01, k, axis=1))) and len(steps) < 40
    again = best(top)  # as if another shard had the same scores: the first is still among the first k
    assert all(w[0][1] == g[0][1] for g, w in zip(again, want, strict=True) if w)


def test_pseudonyms(spark):
    rows = [(1, "4785380592391139 +1 (743) 555-3824 10.0.0.1 2024-02-29"), (2, "x 4785-3805-9239-1139, 29.02.2024; 123-45-6789"), (3, "4785380592391138 2023-02-30 999.1.1.1 000-12-3456"), (4, None), (5, "")]
    out = pseudonyms.pseudonymise(table(spark, rows), "k")
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].kinds for i in (1, 2, 3, 4, 5)] == [["card", "phone", "ip", "date"], ["card", "date", "ssn"], [], [], []]
    assert got[3].text == rows[2][1] and got[4].text is None
    card = got[1].text.split()[0]
    assert card == got[2].text[2:21].replace("-", "") != rows[0][1].split()[0]
    digits = [int(x) for x in card[::-1]]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(out.select("doc_id", "text"), "k", undo=True).collect()} == dict(rows)
    days = spark.range(pseudonyms.DAYS).select("id", F.date_add(F.lit(pseudonyms.DAY_0).cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pseudonyms.pseudonymise(days, "k", id_col="id").select("text").distinct().count() == pseudonyms.DAYS


def test_pseudonym_key_is_not_in_the_plan(spark):
    """Repeated ids and a null one stay rows; no form of the plan shows the key, before or after it ran."""
    key = "a key that nobody may see"
    out = pseudonyms.pseudonymise(table(spark, [(1, "10.0.0.1"), (1, "10.0.0.1"), (None, "at 10.0.0.1"), (2, None), (3, "")]), key)
    rows = out.collect()
    assert len(rows) == 5 and len({r.text.removeprefix("at ") for r in rows if r.n_values}) == 1
    assert key not in out._jdf.queryExecution().toString() and key not in out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    other = pseudonyms.pseudonymise(table(spark, [(1, "10.0.0.1")]), "another key").first()
    assert other.text not in {r.text for r in rows}


def test_pseudonyms_beside_other_characters(spark):
    card, cases = "4785380592391139", [
        ("card {} 12 items", ["card"]), ("{} 123", ["card"]), ("paid 3 {} ok", ["card"]), ("{}/123 {}:12", ["card", "card"]),
        ("3 4785 3805 9239 1139 12", ["card"]), ("{} 12/05/2024", ["card", "date"]), ("3 {} 10.0.0.1:80", ["card", "ip"]), ("{} {}", ["card", "card"]),
        ("10.0.0.1:8080", ["ip"]), ("http://10.0.0.1/1", ["ip"]), ("2024-02-29T12:00:00Z", ["date"]), ("3 2024-02-29 1234", ["date"]), ("12 123-45-6789 99", ["ssn"]),
        ("4785380592391138 12", []), ("2024-02-29x", []), ("10.0.0.1.5", []), ("{}.5", []), ("{}x", []),
    ]
    rows = [(k, t.replace("{}", card)) for k, (t, _) in enumerate(cases)]
    out = pseudonyms.pseudonymise(table(spark, rows), "k")
    got = {r.doc_id: r for r in out.collect()}
    assert [got[k].kinds for k in range(len(cases))] == [kinds for _, kinds in cases]
    new = got[1].text[:16]
    for k, (t, kinds) in enumerate(cases):
        if set(kinds) == {"card"} and "{}" in t:
            assert got[k].text == t.replace("{}", new)
        assert (got[k].text == rows[k][1]) == (not kinds) and got[k].n_values == len(kinds)
    assert got[4].text == f"3 {new[:4]} {new[4:8]} {new[8:12]} {new[12:]} 12"
    assert got[8].text.endswith(":8080") and got[9].text.endswith("/1") and got[10].text.endswith("T12:00:00Z")
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(out.select("doc_id", "text"), "k", undo=True).collect()} == dict(rows)


def test_mixing(spark):
    weights = {"s0": 5.0, "s1": 2.0, "s2": 1.0}
    rows = [(i, "t") for i in range(900)] + [(None, "t"), (7, "t")]
    got = mixing.mix(table(spark, rows), weights=weights, block=4).toPandas()
    assert len(got) == 902 and got["position"].is_unique
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    blocks = got.drop_duplicates(["source", "block"])
    end = blocks.groupby("source").slot.max().min()
    for source, own in blocks.groupby("source"):
        w, slots = own.weight.iloc[0], set(own.slot)
        done = 0
        for t in range(end):
            done += t in slots
            assert abs(done - w * (t + 1)) < 1
    docs = table(spark, rows)
    mixed = mixing.mixed_rows(docs, weights=weights, block=4)
    assert mixed.columns == docs.columns and mixed.count() == 902
    share = mixing.shares({f"x{k}": 1.0 + k for k in range(30)}, 1000)
    plan = mixing.schedule(share, 1000)
    assert len(plan) == 1000 == len({t for _, _, t in plan})
    assert all(j * 1000 // share[s] <= t < -(-(j + 1) * 1000 // share[s]) for s, j, t in plan)


def test_toxicity(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 40))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "zorgal" + rng.choice(["us", "ak", "em", ""]))
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(i % 3 == 0)))
    rows += [(700, None), (None, "zorgalax zorgalak"), (701, "zorgalus. " * 5000), (702, "abc " * 20_000), (702, "abc " * 20_000)]
    tagged = spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(table(spark, rows), tagged).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(600))
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert got[701].predicted == 1 and got[702].predicted == 0
    assert got[700].predicted == 0 and got[None].held_out and got[None].predicted == 1
    assert toxicity.keep_rows(table(spark, rows), tagged).filter("doc_id = 0").count() == 0


def test_toxicity_contexts():
    """The composed transducer against the rules, told one by one, for each context."""
    g = toxicity.Grammar({"zorg": 2.0, "blek$": 1.0}, [1.0] * len(toxicity.FEATURES), 0.0)
    f = lambda t: dict(zip(toxicity.FEATURES, g.features(t.lower()) or [0.0] * 9, strict=True))
    assert g.features("a nice day. kill the light.") is None and g.features("blekk") is None
    assert f("the zorgal stands")["matched"] == 2 and f("the zorgal stands")["targeted"] == 0
    assert f("you zorgal")["targeted"] == 2 == f("zorgal, you")["targeted"]
    assert f("not a zorgal")["negated"] == 2 and f("not in the house a zorgal")["negated"] == 0
    assert f("he said: zorgal")["reported"] == 2 == f("zorgal, he said")["reported"] == f('"zorgal", he wrote')["reported"]
    assert f('she wrote "go. zorgal! blek." blek')["reported"] == 3 and f('she wrote "go." zorgal')["reported"] == 0
    assert f('a "zorgal" he likes')["reported"] == 0 and f("he said go. zorgal")["reported"] == 0
    assert f("i will kill you")["threats"] == 1 and f("i will kill you")["matched"] == 0
    assert f("i will never kill you")["threats"] == 0 == f("he said: i will kill you")["threats"] == f("kill it")["threats"]
    assert f("kill you zorgal")["threatened"] == 2 and f("zorgal. zorg; blek")["clauses"] == 3
    assert toxicity.Grammar({}, toxicity.PRIOR, -1.0).score("I will kill you") > 0.5 > toxicity.Grammar({}, toxicity.PRIOR, -1.0).score("I like you")
    rng = random.Random(8)
    words = ["you", "kill", "not", "said", "zorgal", "blek", "tree", ":", '"', ".", "house"]
    for _ in range(500):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        clause = [w for w in clause if w not in ('"', ":", ".")]
        got, own = f(" ".join(clause)), [{"zorgal": 2.0, "blek": 1.0}.get(w, 0.0) for w in clause]
        near = [any(v == "not" for v in clause[max(0, k - 2) : k]) for k in range(len(clause))]
        threats = sum(w == "kill" and not n for w, n in zip(clause, near, strict=True)) if "you" in clause and "said" not in clause else 0
        want = [sum(own), 0, sum(own) * ("you" in clause), sum(own) * ("kill" in clause), sum(w for w, n in zip(own, near, strict=True) if n), sum(own) * ("said" in clause), threats]
        assert [got[k] for k in ("matched", "targeted", "threatened", "negated", "reported", "threats")] == [want[0], *want[2:]], clause
    long = "you zorgal. " * 20_000
    assert f(long)["clauses"] == 20_000


def test_warc(spark, tmp_path):
    page = '<html><head><title>A &amp; b</title><script>var x="</p>";</script></head><body><p>One <b>two</b></p><!-- c --><ul><li><a href="/x?a=1&amp;b=2">L</a></ul></body></html>'
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (1, "http://h/1", page)], "page_id long, url string, html string")
    out = warc.pages_to_derivatives(pages).collect()
    assert len(out) == 6
    text = next(r for r in out if r.page_id == 1 and r.record_type == "conversion")
    assert text.record.endswith(b"\r\n\r\nOne two\nL\r\n\r\n") and text.content_length == 9
    source = warc.responses(pages, "2024-01-01T00:00:00Z").filter("page_id = 1").first()
    assert text.refers_to == source.record_id
    meta = next(r for r in out if r.page_id == 1 and r.record_type == "metadata")
    assert b"title: A & b\r\n" in meta.record and b"outlink: /x?a=1&b=2 L a/@href" in meta.record
    assert warc.digest(page.encode()).encode() in meta.record
    path = str(tmp_path / "x.warc")
    derived = warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z"))
    assert warc.save(derived, path) == 6
    back = warc.read_warc(spark, path).collect()
    assert sorted(r.record_id for r in back) == sorted(r.record_id for r in out)


def test_warc_damaged(spark, tmp_path):
    import gzip
    import zlib as z

    record = lambda i, length, body: f"WARC/1.0\r\nwarc-type: Response\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Concurrent-To: <urn:a>\r\nwarc-concurrent-to: <urn:b>\r\nX-Long: one\r\n two\r\n{length}\r\n\r\n{body}\r\n\r\n".encode()
    raw = record(1, "Content-Length: x", "first") + record(2, "content-length: 6", "second") + record(3, "Content-Length: 500", "cut off")
    got = list(warc.parse(raw))
    assert [(r["record_id"], r["record_type"], r["block"]) for r in got] == [("<urn:1>", "response", b"first"), ("<urn:2>", "response", b"second"), ("<urn:3>", "response", b"cut off\r\n\r\n")]
    assert [v for n, v in got[0]["headers"] if n.lower() == "warc-concurrent-to"] == ["<urn:a>", "<urn:b>"] and ("X-Long", "one two") in got[0]["headers"]
    members = gzip.compress(record(1, "Content-Length: 5", "first")) + gzip.compress(record(2, "Content-Length: 6", "second"))
    assert [r["block"] for r in warc.parse(members)] == [b"first", b"second"]
    assert [r["block"] for r in warc.parse(members[:-20])][0] == b"first" and list(warc.parse(b"")) == list(warc.parse(b"WARC/1.0\r\n")) == []
    (tmp_path / "a.warc").write_bytes(raw)
    meta = warc.derive(warc.read_warc(spark, str(tmp_path / "a.warc"))).filter("record_type = 'metadata'").collect()
    assert len(meta) == 3 and all(bytes(r.block).count(b"-concurrent-to: <urn:") + bytes(r.block).count(b"-Concurrent-To: <urn:") == 2 for r in meta)
    page = "<p>Caf\u00e9 " + "long " * 50_000 + "</p>"
    for headers, body in (
        ("Content-Encoding: gzip", gzip.compress(page.encode())), ("Content-Encoding: deflate", z.compress(page.encode())),
        ("Transfer-Encoding: chunked", b"5\r\n" + page.encode()[:5] + b"\r\n" + f"{len(page.encode()) - 5:x};x=1\r\n".encode() + page.encode()[5:] + b"\r\n0\r\n\r\n"), ("X: y", page.encode()),
    ):
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{headers}\r\n\r\n".encode() + body
        made = warc.derive_one({"record_id": "<urn:1>", "target_uri": None, "warc_date": None, "headers": None, "block": block})
        assert made[1]["block"].decode() == "Caf\u00e9 " + ("long " * 50_000).strip() and warc.digest(body).encode() in made[0]["block"]
    assert warc.derive_one({"record_id": None, "target_uri": None, "warc_date": None, "headers": [], "block": None})[0]["record_type"] == "metadata"
    none = spark.createDataFrame([], "page_id long, url string, html string, record string")
    assert warc.pages_to_derivatives(none).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files_in_pieces(spark, tmp_path, packed):
    """Records of files that are read in pieces against the reader of whole files: blocks that look like records, end in blank lines, or are bytes."""
    import gzip

    rng, shelf = random.Random(3), tmp_path / "warc"
    shelf.mkdir()
    expected = []
    for f in range(4):
        raw = []
        for k in range(60):
            block = rng.choice([b"", b"\r\n", b"\r\n\r\n", b"x\r\n\r\n\r\n", bytes(rng.randrange(256) for _ in range(rng.randrange(4000))), b"y\r\n" * 20_000])
            if f == 1 and k % 20 == 7:
                block += b"\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" + block
            raw.append(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{f}:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
            expected.append((f"<urn:{f}:{k}>", block))
        name = shelf / (f"{f}.warc.gz" if packed else f"{f}.warc")
        name.write_bytes(b"".join(map(gzip.compress, raw)) if packed else b"".join(raw))
    (shelf / "none.warc").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        got = warc.read_warc(spark, str(shelf)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.record_id, bytes(r.block)) for r in got) == sorted(expected)


def plain_derivatives(page_id, url, page):
    """Both records of a page by a parser of its own: the standard library's, tag by tag."""
    import base64
    import hashlib
    import uuid
    from html.parser import HTMLParser

    blocks = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.text, self.title, self.links, self.hidden, self.in_title = "", "", [], 0, False

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style", "noscript", "template"):
                self.hidden += 1
            self.in_title |= tag == "title"
            if tag in blocks:
                self.text += "\n"
            if tag == "a" and not self.hidden and dict(attrs).get("href") is not None:
                self.links.append(dict(attrs)["href"].strip())

        def handle_endtag(self, tag):
            if tag in ("script", "style", "noscript", "template"):
                self.hidden -= 1
            self.in_title &= tag != "title"
            if tag in blocks:
                self.text += "\n"

        def handle_data(self, data):
            if self.in_title:
                self.title += data
            elif not self.hidden:
                self.text += data.replace("\n", " ").replace("\r", " ")

    r = Reader()
    r.feed(page)
    r.close()
    text = "\n".join(" ".join(line.split()) for line in r.text.split("\n") if line.split()).encode()
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    payload = page.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = hashlib.sha256("\n".join([str(page_id), url or "", hashlib.md5(payload).hexdigest()]).encode()).hexdigest()
    source = f"<urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>"
    lines = ["httpStatus: HTTP/1.1 200 OK", "httpHeader-Content-Type: text/html; charset=utf-8", f"httpHeader-Content-Length: {len(payload)}"]
    lines += [f"sourceBlockDigest: {sha(head + payload)}", f"sourcePayloadDigest: {sha(payload)}", "sourceHeader-Content-Type: application/http; msgtype=response"]
    title = " ".join(r.title.split())
    lines += [f"title: {title}"] if title else []
    lines += [f"outlink: {' '.join(x.split())} L a/@href" for x in r.links]
    meta = "".join(x + "\r\n" for x in lines).encode()
    ids, out = {k: f"<urn:uuid:{uuid.uuid5(warc._SPACE, f'{k} {source}')}>" for k in ("metadata", "conversion")}, []
    for kind, block, own in (("metadata", meta, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
        day = "2024-01-01T00:00:00Z"
        fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: {ids[kind]}", f"WARC-Date: {day}", *([f"WARC-Target-URI: {url}"] if url else []), f"WARC-Refers-To: {source}"]
        fields += [*([f"WARC-Refers-To-Target-URI: {url}"] if url else []), f"WARC-Refers-To-Date: {day}"]
        if kind == "conversion":
            fields += [f"WARC-Concurrent-To: {ids['metadata']}", f"WARC-Payload-Digest: {sha(block)}", f"WARC-Source-Payload-Digest: {sha(payload)}"]
        fields += [f"WARC-Block-Digest: {sha(block)}", f"Content-Type: {own}", f"Content-Length: {len(block)}"]
        out.append((page_id, kind, ids[kind], source, url, len(block), sha(block), ("WARC/1.1\r\n" + "".join(x + "\r\n" for x in fields) + "\r\n").encode() + block + b"\r\n\r\n"))
    return out


def test_warc_against_plain_builder(spark, tmp_path):
    """The whole query against a builder of its own, over all given pages; what is written as files can be read again."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    expected = [x for r in pages.collect() for x in plain_derivatives(r.page_id, r.url, r.html or "")]
    got = queries.op2_warc(spark, "/root/testdata/sf0.001")
    assert sorted((*r[:7], bytes(r.record)) for r in got.collect()) == sorted(expected)
    warc.write_warc(got, str(tmp_path / "out"))
    back = warc.read_warc(spark, str(tmp_path / "out" / "part-*"))
    assert sorted(r.record_id for r in back.collect()) == sorted(x[2] for x in expected)
    with pytest.raises(ValueError):
        warc.derive(warc.responses(pages, "2024-01-01T00:00:00Z"), keep=("block",))


def test_feistel_is_a_permutation_of_each_kind(spark):
    """Each kind's values against what makes it valid, and against each other."""
    import ipaddress

    luhn = lambda d: sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(d[::-1])) % 10 == 0
    rng = random.Random(1)
    cards = {c for c in ("4" + "".join(rng.choice("0123456789") for _ in range(15)) for _ in range(4000)) if luhn(c)}
    ips = {str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(400)} | {"0.0.0.0", "255.255.255.255", "10.0.0.1"}
    ssns = {f"{a:03}-{b:02}-{c:04}" for a in (1, 665, 667, 899) for b in (1, 99) for c in range(1, 60)}
    phones = {f"+1 (743) 555-{k:04}" for k in range(400)}
    rows = [(k, t) for k, t in enumerate([*sorted(cards), *sorted(ips), *sorted(ssns), *sorted(phones), "010.0.0.1", "long " * 20_000 + "10.0.0.1", "10.0.0.1", "10.0.0.1"])]
    out = pseudonyms.pseudonymise(table(spark, rows), "k")
    got = {r.doc_id: r.text for r in out.collect()}
    new = {t: got[k] for k, t in rows}
    assert new["010.0.0.1"] == "010.0.0.1" and new["long " * 20_000 + "10.0.0.1"].endswith(" " + new["10.0.0.1"])
    for kind, valid in (
        (cards, luhn), (ips, lambda x: str(ipaddress.ip_address(x)) == x), (phones, lambda x: re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", x)),
        (ssns, lambda x: x[:3] not in ("000", "666") and x < "900" and x[4:6] != "00" and x[7:] != "0000"),
    ):
        assert len({new[t] for t in kind}) == len(kind) and all(valid(new[t]) for t in kind) and any(new[t] != t for t in kind)
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymise(out.select("doc_id", "text"), "k", undo=True).collect()} == dict(rows)


def test_shards_hold_like_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 1000)
    rows = [(i, "x" * 100) for i in [*range(0, 50), *range(10**12, 10**12 + 50), -(1 << 62), (1 << 62) + 5]] + [(7, "y" * 5000)]
    bounds, n = token_store._shard_bounds(token_store.documents(table(spark, rows)))
    size = np.bincount([int(np.searchsorted(bounds, i, side="right")) for i, t in rows for _ in t], minlength=n)
    assert n == len(bounds) + 1 >= 8 and sorted(size)[-2] <= 3500
    assert token_store._shard_bounds(token_store.documents(table(spark, [(None, "x")])))[1] == 1


@pytest.mark.parametrize("extra", [[], [(None, None), (None, "one two"), (3, "one"), (3, "one")]])
def test_pipeline_of_odd_rows(spark, texts, tmp_path, extra):
    import corpus_pipeline

    rows = (texts if extra else []) + extra
    docs = spark.createDataFrame([(i, t, None if i == 3 else "s", "x", "y") for i, t in rows], "doc_id long, text string, source string, position string, __row string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == ["doc_id", "text", "source", "position", "__row"]
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    kept = sorted(str(r.doc_id) for r in docs.collect())
    assert kept == sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) and kept.count("3") == (1 if extra else 0)


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).filter("doc_id = 2")
    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frames = [
        exact_dedup.exact_dedup(none), near_dedup.near_dedup(none), substring_dedup.remove_repeats(none), byte_bpe.round_trip(none, path, pattern),
        mixing.mix(none), pseudonyms.pseudonymise(none, "k"), toxicity.toxicity(none, labels), search.top_k(none, none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    out = queries.work_dir(spark, "empty")
    token_store.write_store(none, out, queries.tokenizer_path("word_bpe_49k.json"))
    assert token_store.read_summary(spark, out).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert out.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs.count(), spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_pipeline_returns_the_mix(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    assert "position" in out.columns
    rows = [(r.doc_id, r.position) for r in out.collect()]
    assert [p for _, p in rows] == sorted({p for _, p in rows})
    source = {r.doc_id: r.source or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source").collect()}
    slots = {}
    for i, p in rows:
        slots.setdefault(source[i], set()).add(p // 8)
    sizes = {s: sum(source[i] == s for i, _ in rows) for s in slots}
    share = mixing.shares({s: n**0.5 for s, n in sizes.items()}, mixing.PERIOD)
    end = min(max(x) for x in slots.values())
    assert len(slots) > 1 and end > 0
    for s, x in slots.items():
        assert all(abs(sum(t <= k for t in x) - share[s] / mixing.PERIOD * (k + 1)) < 1 for k in range(end))
