"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Every text becomes its set of word shingles; equal sets are one class, whose smallest doc_id stands
   for it.  A class has a signature of minima; ``rows`` of them make a band, and the number of bands
   follows from the threshold and the chosen miss probability.
2. In every bucket (classes that share a band), each class is compared with the bucket's smallest one.
   Signature batches are compared one after another: once the posterior probability (uniform prior)
   that the similarity reaches the threshold falls below its share of ``miss``, the pair is pruned.  Survivors are
   confirmed on the full sets.  The links found give components.
3. Only buckets that still hold more than one component are compared further, inside workers, in tiles of
   bounded size: classes of different components, by signatures, and survivors at once on the full sets.
   A pair is looked at in the first band that it shares; once a link joins two components their other
   pairs are passed over.  What leaves a worker are links, never candidate pairs.

So no group emits all its pairs, large groups are dealt out in salted parts, and only a link that no
band shows (probability ``miss``) can be lost.

Cases: null texts count as empty; a text without words is linked with nothing.  Equal sets are linked.
Rows that repeat a doc_id are one document.  A row without doc_id is linked with nothing and kept.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm import shingles
from plenum.llm.common import cut, documents, small
from plenum.llm.components import components

#: Signature values compared between two looks at the posterior.
LOOK = 32
#: Members of a group that one task compares with its pivot, and members and bytes of text of one tile.
PART, TILE, TILE_BYTES = 256, 1024, 8 << 20


class Plan:
    """Bands and pruning bounds for a threshold given as a fraction."""

    def __init__(self, num: int, den: int, rows: int = 6, miss: float = 1e-7):
        self.num, self.den, self.rows, self.miss = num, den, rows, miss
        t, looks = num / den, 0
        while True:  # the bands and every look have an equal share of ``miss``
            self.share = miss / (1 + looks)
            self.bands = math.ceil(math.log(self.share) / math.log1p(-(t**rows)))
            self.size = self.bands * rows
            if -(-self.size // LOOK) <= looks:
                break
            looks = -(-self.size // LOOK)
        rng = np.random.default_rng(7)
        self.a = rng.integers(0, 1 << 31, self.size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.size, dtype=np.uint32)
        self.looks = [min(k + LOOK, self.size) for k in range(0, self.size, LOOK)]
        self.least = [self._least(n, t) for n in self.looks]

    def _least(self, n: int, t: float) -> int:
        """The fewest matches of n with which P(similarity >= t) is still its share of ``miss``; that is
        P(Binomial(n + 1, t) <= matches), by the identity with the incomplete beta function."""
        total, m = 0.0, -1
        while total < self.share:
            m += 1
            total += math.exp(
                math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log1p(-t)
            ) if t < 1 else float(m > n)
        return m

    def signature(self, s: np.ndarray) -> np.ndarray:
        out = np.full(self.size, 0xFFFFFFFF, np.uint32)
        low = (s >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(low), 1024):
            h = np.multiply.outer(self.a, low[k : k + 1024])
            h += self.b[:, None]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            np.minimum(out, h.min(axis=1), out=out)
        return out

    def band_keys(self, sig: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band of each signature (one a row), of the 16 bits that are kept."""
        parts = (sig & np.uint32(0xFFFF)).reshape(len(sig), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(self.rows):
            key = shingles.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
        return key.view(np.int64)

    def alive(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Row numbers of ``many`` whose similarity with ``one`` may reach the threshold."""
        rows = np.arange(len(many))
        found = np.zeros(len(many), np.int64)
        low = 0
        for high, least in zip(self.looks, self.least, strict=True):
            found += (many[rows, low:high] == one[low:high]).sum(axis=1)
            stay = found >= least
            rows, found = rows[stay], found[stay]
            low = high
            if not len(rows):
                break
        return rows

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if self.den * min(len(a), len(b)) < self.num * max(len(a), len(b)):
            return False
        both = shingles.common(a, b)
        return both > 0 and self.den * both >= self.num * (len(a) + len(b) - both)


SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, signature binary"


def sketch(docs: DataFrame, width: int, plan: Plan) -> DataFrame:
    """One row a document: size and key of its shingle set, band keys and signature (16 bits a value)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for k in range(0, len(texts), 256):
                part = shingles.sets(texts.slice(k, 256).to_pylist(), width)
                sig = np.array([plan.signature(s) for s in part], np.uint32)
                keys = plan.band_keys(sig)
                some = np.array([len(s) > 0 for s in part])
                ends = np.concatenate([[0], np.cumsum(some * plan.bands)]).astype(np.int32)
                low = sig.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(k, len(part)),
                        pa.array([len(s) for s in part], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in part], pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(keys[some].ravel(), pa.int64())),
                        pa.array([x.tobytes() if y else None for x, y in zip(low, some, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands", "signature"],
                )

    return docs.mapInArrow(run, SKETCH)


def confirm(pairs: DataFrame, texts: DataFrame, width: int, plan: Plan) -> DataFrame:
    """Those of ``pairs`` (a, b) that are linked.  ``texts``: (node, signature, text) of all of them.

    The members of one ``a`` are dealt to parts; each part has a's text first and then its members.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    heads = parts.select("a", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    heads = heads.join(texts, heads.a == texts.node).select("a", "part", F.lit(0).alias("rank"), "node", "signature", "text")
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(texts, dealt.b == texts.node).select("a", "part", F.lit(1).alias("rank"), "node", "signature", "text")
    rows = heads.union(members).repartition("a", "part").sortWithinPartitions("a", "part", "rank")

    def run(batches: Iterator[pa.RecordBatch]):
        at, head = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("a", "part", "rank", "node", "signature")]
            texts = batch.column("text")
            out: list[tuple[int, int]] = []
            for k, (a, part, rank, node, signature) in enumerate(zip(*cols, strict=True)):
                if (a, part) != at:
                    at, head = (a, part), []
                sig = np.frombuffer(signature, "<u2")
                if rank == 0:
                    head.append([sig, texts[k].as_py().encode(), None])
                    continue
                own = None
                for h in head:
                    if len(plan.alive(h[0], sig[None, :])):
                        if h[2] is None:
                            h[2] = shingles.sets([h[1]], width)[0]
                        if own is None:
                            own = shingles.sets([texts[k].as_py().encode()], width)[0]
                        if plan.linked(h[2], own):
                            out.append((a, node))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def left_over(members: DataFrame, width: int, plan: Plan) -> DataFrame:
    """Links (a, b) between different components in one bucket.

    ``members``: (key, band, pivot, node, component, signature, text, tiles).  A member of tile t goes to the
    tile pairs that t is in, so a task holds two tiles at most.  Pairs with the pivot were confirmed before.
    """
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cols = ["key", "t", "u", "band", "pivot", "own", "node", "component", "signature", "text"]
    rows = dealt.withColumns({"t": F.least("own", "other"), "u": F.greatest("own", "other")}).select(*cols)
    rows = rows.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u")

    def compare(group: list[dict]) -> list[tuple[int, int]]:
        t, u, band, pivot, out = group[0]["t"], group[0]["u"], group[0]["band"], group[0]["pivot"], []
        sig = np.array([np.frombuffer(x["signature"], "<u2") for x in group])
        bands = sig.reshape(len(group), plan.bands, plan.rows)
        tile, node = np.array([x["own"] for x in group]), np.array([x["node"] for x in group])
        root, sets = {}, {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        def shingled(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles.sets([group[i]["text"].encode()], width)[0]
            return sets[i]

        comp = np.array([x["component"] for x in group])
        for i in range(len(group)):
            if node[i] == pivot or t != u and tile[i] != t:
                continue
            others = np.flatnonzero((comp != comp[i]) & (node != pivot) & (node != node[i]) & ((tile != t) if t != u else (np.arange(len(group)) > i)))
            if not len(others):
                continue
            hit = others[plan.alive(sig[i], sig[others])]
            if len(hit):  # only in the first band that the two share
                hit = hit[(bands[hit] == bands[i]).all(axis=2).argmax(axis=1) == band]
            for j in hit.tolist():
                x, y = find(int(comp[i])), find(int(comp[j]))
                if x != y and plan.linked(shingled(i), shingled(j)):
                    out.append((int(node[i]), int(node[j])))
                    root[max(x, y)] = min(x, y)
        return out

    def run(batches):
        group: list[dict] = []
        out: list[tuple[int, int]] = []

        def made():
            rows = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            out.clear()
            return rows

        for batch in batches:
            for k in range(0, len(batch), 256):
                for x in batch.slice(k, 256).to_pylist():
                    if group and any(group[0][c] != x[c] for c in ("key", "t", "u")):
                        out.extend(compare(group))
                        group = []
                    group.append(x)
            if out:
                yield made()
        if group:
            out.extend(compare(group))
        yield made()

    return rows.mapInArrow(run, "a long, b long")


def near_dedup(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, rows: int = 6, miss: float = 1e-7,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.  Links: den * intersection >= num * union."""
    plan = Plan(num, den, rows, miss)
    docs = documents(docs, id_col, text_col)
    sketches = cut(sketch(docs, width, plan), "sketch")
    named = sketches.filter("doc_id is not null and n_shingles > 0")
    classes = cut(named.groupBy("set_key").agg(F.min("doc_id").alias("node")), "classes")
    stand = named.join(classes.withColumnRenamed("set_key", "k"), (F.col("k") == F.col("set_key")) & (F.col("node") == F.col("doc_id")))

    dealt = stand.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = dealt.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last")
    members = cut(dealt.join(buckets.select("key", "pivot"), "key").distinct(), "members")
    pairs = members.filter("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    nodes = cut(members.select("node").distinct(), "nodes")
    n = nodes.count()
    if n == 0:
        labels = classes.select("node", F.col("node").alias("component")).limit(0)
    else:
        side = small(nodes, n)
        signed = stand.join(side, "node", "left_semi").select("node", "signature").distinct()
        plain = docs.join(side.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
        texts = cut(plain.join(signed, "node").select("node", "signature", "text"), "texts")
        links = cut(confirm(pairs, texts, width, plan), "links")
        first = components(links)
        length = texts.select("node", F.octet_length("text").cast("long").alias("n_bytes"))
        labelled = members.join(length, "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = labelled.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"), F.min("component").alias("x"), F.max("component").alias("y"))
        tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("size") / TILE_BYTES)).cast("int")
        mixed = mixed.filter("x <> y and n > 2").select("key", tiles.alias("tiles"))
        rest = cut(labelled.drop("n_bytes").join(mixed, "key"), "rest")
        labels = first
        if not rest.isEmpty():
            more = cut(left_over(rest.join(texts, "node"), width, plan), "links")
            if not more.isEmpty():
                labels = components(links.union(more))

    member = classes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    own = sketches.select("doc_id", "n_shingles", "set_key")
    found = own.join(member, "set_key", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    found = found.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all its columns and one document of each group of near duplicates."""
    found = near_dedup(docs, id_col=id_col, text_col=text_col, **how)
    out = cut(found.filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "dropped")
    n = out.count()
    if not n:
        return docs
    named = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))  # no clash of names
    return named.join(small(out, n), F.col("id") == F.col("gone"), "left_anti").select("row.*")
