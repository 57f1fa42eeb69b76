"""Approximate nearest neighbours by a forest of hash strings (largest inner product).

Index: each vector has one long hash string a tree.  A symbol of a string is the corner of a random cross-polytope that is
nearest to the vector (the largest of its random projections, and the sign of it), so one symbol deals the vectors to twice
as many parts as they have components.  Vectors get one more component that makes all norms equal to the largest, by which the
nearest corner serves the inner product, not only the angle.  All vectors are indexed; nothing is learned.

Search, for all queries at once:

1. Trees are dealt to tasks by a common prefix (a cell), cells of more than ``CELL`` strings in chunks by id, which
   queries then visit all.  In a task the strings are a sorted array; a query descends by binary search to the strings
   that share its longest prefix, and the counts of strings that share 0, 1, 2, ... symbols are summed over tasks.
2. All trees of a query ascend in step, one symbol a step, until ``budget * sqrt(rows)`` strings or more share the prefix in
   all trees together; of the last step only as many trees ascend as are needed.  Cells begin at a prefix that is expected
   to have enough; a query that doesn't find enough there is asked again with shorter ones, down to none.
3. The tasks score the strings found by their vectors, rounded to a byte a component, and keep some for each query and
   chunk; what is kept of all is scored again on the original vectors in double precision.

Recall is a matter of ``trees`` and ``budget``; ``recall`` measures it against all candidates.

Copies: of equal vectors only the k + 1 smallest ids can be among the nearest k of any query, so others aren't indexed; equal
queries are asked once and each row gets the answer less its own id.

Cases: rows without id take no part, nor vectors that are null, empty or zero or hold null, NaN or infinite components; missing
components of shorter vectors are 0; rows that repeat (id and vector) are one; ties go to the smaller id; an empty table, or one
without queries, gives an empty result.  Only the two columns named are read, so others may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.llm.common import cut, small

TREES = 64
BUDGET = 96.0
#: Strings, or queries, that one task has of a cell at most.
CELL = 32_768
SEED = 11


class Shape:
    """What follows from the number of rows, the longest vector and the largest norm."""

    def __init__(self, rows: int, size: int, norm: float, trees: int, budget: float):
        self.rows, self.size, self.norm, self.trees = rows, size, norm, trees
        self.corners = 2 * (size + 1)
        self.bits = max(1, (self.corners - 1).bit_length())
        self.symbols = max(1, min(62 // self.bits, 2 + math.ceil(math.log(max(2, rows), self.corners))))
        self.enough = math.ceil(budget * math.sqrt(rows))

    def start(self) -> int:
        """The longest prefix that four times as many strings as are enough are expected to share."""
        p = 0
        while p + 1 < self.symbols and self.trees * self.rows / self.corners ** (p + 1) >= 4 * self.enough:
            p += 1
        return p

    def shift(self, level: int) -> int:
        return self.bits * (self.symbols - level)

    def corners_of(self, tree: int) -> np.ndarray:
        """The random projections of a tree, those of one symbol after another."""
        return np.random.default_rng([SEED, tree]).standard_normal((self.size + 1, self.symbols * (self.size + 1))).astype(np.float32)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    out = np.zeros((len(column), size))
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(size)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _bytes(x: np.ndarray) -> np.ndarray:
    """A byte a component, each row scaled to its largest; then the scale's four bytes."""
    scale = np.abs(x).max(axis=1, keepdims=True).astype(np.float32) / 127
    small_ints = np.rint(x / np.maximum(scale, np.finfo(np.float32).tiny)).astype(np.int8)
    return np.hstack([small_ints.view(np.uint8), np.ascontiguousarray(scale).view(np.uint8)])


def _floats(column: pa.Array, size: int) -> np.ndarray:
    """The rows of ``_bytes``, scaled back."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), size + 4)
    return raw[:, :size].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, size:]).view(np.float32)


def _hashed(rows: DataFrame, shape: Shape, queries: bool) -> DataFrame:
    """(id, codes, packed): a code for each tree, the symbols of its string one below the other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [shape.corners_of(t) for t in range(shape.trees)] if shape.trees * shape.size**2 < 2**22 else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x = _matrix(some.column(1), shape.size)
                square = (x * x).sum(axis=1)
                last = np.zeros(len(x)) if queries else np.sqrt(np.maximum(shape.norm - square, 0))
                y = np.hstack([x, last[:, None]]).astype(np.float32)
                codes = np.zeros((len(x), shape.trees), dtype=np.int64)
                for t in range(shape.trees):
                    seen = (y @ (shape.corners_of(t) if trees is None else trees[t])).reshape(len(x), shape.symbols, shape.size + 1)
                    far = np.abs(seen).argmax(axis=2)
                    sign = np.take_along_axis(seen, far[:, :, None], axis=2)[:, :, 0] > 0
                    for s in range(shape.symbols):
                        codes[:, t] = (codes[:, t] << shape.bits) | (2 * far[:, s] + sign[:, s])
                ends = pa.array(np.arange(0, codes.size + 1, shape.trees), pa.int32())
                packed = [row.tobytes() for row in _bytes(x)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.ListArray.from_arrays(ends, pa.array(codes.ravel())), pa.array(packed, pa.binary())],
                    names=["id", "codes", "packed"],
                )

    return rows.select("id", "vec").mapInArrow(each, "id long, codes array<long>, packed binary")


def _strings(hashed: DataFrame, shape: Shape, level: int) -> DataFrame:
    return hashed.select("id", "packed", F.posexplode("codes").alias("tree", "code")).withColumn("cell", F.shiftright("code", shape.shift(level)))


def _dealt(items: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (chunk, part): strings of a large cell in chunks by id, its queries in parts; each chunk meets each part."""
    spread = lambda c: F.ceil(F.count("*") / CELL).cast("int").alias(c)
    chunks = items.groupBy("tree", "cell").agg(spread("chunks")).filter("chunks > 1")
    parts = queries.groupBy("tree", "cell").agg(spread("parts")).filter("parts > 1")
    large = cut(chunks.join(parts, ["tree", "cell"], "full"), "cells")
    large = small(large, large.count())
    many = lambda c: F.coalesce(F.col(c), F.lit(1))
    own: Column = F.xxhash64("id")

    def deal(side: DataFrame, of: str, by: str, all_of: str, each: str) -> DataFrame:
        side = side.join(large, ["tree", "cell"], "left").withColumn(by, F.pmod(own, many(of)).cast("int"))
        return side.withColumn(each, F.explode(F.sequence(F.lit(0), many(all_of) - 1))).drop("chunks", "parts")

    return deal(items, "chunks", "chunk", "parts", "part"), deal(queries, "parts", "part", "chunks", "chunk")


_KEYS = ["tree", "cell", "chunk", "part"]


def _ranges(codes: np.ndarray, asked: np.ndarray, shift: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings lie in a sorted array that share the prefix of each one asked for."""
    low = (asked >> shift) << shift
    return np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << shift))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _counted(items: DataFrame, queries: DataFrame, shape: Shape, level: int) -> DataFrame:
    """(query, tree, c: strings that share level, level + 1, ... symbols)."""
    levels = range(level, shape.symbols + 1)

    def descend(have: pa.Table, ask: pa.Table) -> pa.Table:
        codes, asked = np.sort(_numbers(have, "code")), _numbers(ask, "code")
        found = [z - a for a, z in (_ranges(codes, asked, np.int64(shape.shift(x))) for x in levels)]
        return pa.table([ask.column("id"), ask.column("tree"), *(pa.array(x.astype(np.int64)) for x in found)], names=["query", "tree", *(f"c{x}" for x in levels)])

    schema = "query long, tree int, " + ", ".join(f"c{x} long" for x in levels)
    narrow = lambda df: df.select(*_KEYS, "id", "code").groupBy(*_KEYS)
    per_tree = narrow(items).cogroup(narrow(queries)).applyInArrow(descend, schema)
    per_tree = per_tree.groupBy("query", "tree").agg(*[F.sum(f"c{x}").alias(f"c{x}") for x in levels])
    return per_tree.select("query", "tree", F.array(*[f"c{x}" for x in levels], F.lit(0)).alias("c"))


def _ascended(counted: DataFrame, shape: Shape, level: int) -> DataFrame:
    """(query, tree, prefix, found): the prefix at which a tree stops, and the strings of all trees at the shortest."""
    steps = shape.symbols - level + 1
    mine = Window.partitionBy("query")
    total = [F.sum(F.col("c")[x]).over(mine) for x in range(steps)]
    both = counted.select("*", F.array(*total, F.lit(0)).alias("total"))
    reached = F.size(F.filter(F.slice("total", 1, steps), lambda x: x >= shape.enough))
    both = both.withColumn("step", F.greatest(reached - 1, F.lit(0)))
    gain = F.expr("c[step] - c[step + 1]")
    before = F.coalesce(F.sum(gain).over(mine.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = F.lit(shape.enough) - F.expr("total[step + 1]")
    up = F.when(before < need, F.col("step")).otherwise(F.col("step") + 1)
    return both.select("query", "tree", (up + level).alias("prefix"), F.expr("total[0]").alias("found"))


def _scored(items: DataFrame, queries: DataFrame, shape: Shape, keep: int) -> DataFrame:
    """(query, id, near): of each query, and chunk of each tree, the ``keep`` best strings that share its prefix."""

    def score(have: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if have.num_rows and ask.num_rows:
            codes = _numbers(have, "code")
            order = np.argsort(codes, kind="stable")
            ids, vectors = _numbers(have, "id")[order], _floats(have.column("packed").combine_chunks(), shape.size)[order]
            asked, names = _floats(ask.column("packed").combine_chunks(), shape.size), _numbers(ask, "id")
            shift = np.int64(shape.bits) * (shape.symbols - _numbers(ask, "prefix").astype(np.int64))
            low, high = _ranges(codes[order], _numbers(ask, "code"), shift)
            spans, of = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
            for k, (a, z) in enumerate(spans):
                if a == z:
                    continue
                whose = np.flatnonzero(of.ravel() == k)
                step = max(1, 2**21 // (z - a))
                for at in range(0, len(whose), step):
                    some = whose[at : at + step]
                    near = asked[some] @ vectors[a:z].T
                    if z - a > keep:
                        best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                        near = np.take_along_axis(near, best, axis=1)
                    else:
                        best = np.broadcast_to(np.arange(z - a), near.shape)
                    out.append((np.repeat(names[some], near.shape[1]), ids[a:z][best].ravel(), near.ravel()))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.array([], np.int64), np.array([], np.int64), np.array([], np.float32)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float32()), strict=True)], names=["query", "id", "near"])

    left = items.select(*_KEYS, "id", "code", "packed").groupBy(*_KEYS)
    right = queries.select(*_KEYS, "id", "code", "packed", "prefix").groupBy(*_KEYS)
    return left.cogroup(right).applyInArrow(score, "query long, id long, near float")


def _clean(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec double): rows with an id and a vector of finite components, not all zero; those that repeat once."""
    vec = F.transform(F.col(f"`{vec_col}`").cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).filter("id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(fine & F.exists("vec", lambda x: x != 0))


def _dot(a: str, b: str) -> Column:
    product = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def _first(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, budget: float = BUDGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): of each of ``queries`` the k nearest found of ``rows``, but the row of its own id."""
    items = _first(_clean(rows, id_col, vec_col).distinct(), "vec", k + 1, F.col("id"))
    asking = _clean(queries, id_col, vec_col).distinct()
    facts = items.agg(F.count("*"), F.max(F.size("vec")), F.max(_dot("vec", "vec"))).first()
    if not facts[0]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = asking.agg(F.max(F.size("vec"))).first()[0] or 1
    shape = Shape(facts[0], max(facts[1], longest), float(facts[2]), trees, budget)
    index = cut(_hashed(items, shape, queries=False), "forest")
    classes = asking.groupBy("vec").agg(F.min("id").alias("id"))
    todo = cut(_hashed(classes, shape, queries=True), "queries")
    found = []
    for level in range(shape.start(), -1, -1):
        strings, asked = _dealt(_strings(index, shape, level), _strings(todo, shape, level))
        ascended = cut(_ascended(_counted(strings, asked, shape, level), shape, level), "ascended")
        if level:
            ascended = ascended.filter(F.col("found") >= shape.enough)
        stops = ascended.filter(F.col("prefix") <= shape.symbols).select(F.col("query").alias("id"), "tree", "prefix")
        found.append(cut(_scored(strings, asked.join(stops, ["id", "tree"]), shape, 2 * k + 2), "found"))
        if level:
            todo = cut(todo.join(ascended.select(F.col("query").alias("id")).distinct(), "id", "left_anti"), "queries")
            if todo.isEmpty():
                break
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    near = near.groupBy("query", "id").agg(F.max("near").alias("near"))
    near = _first(near, "query", 4 * k + 4, F.desc("near"), F.col("id")).select("query", "id")
    exact = near.join(items.select("id", "vec"), "id").join(classes.select(F.col("id").alias("query"), F.col("vec").alias("asked")), "query")
    exact = _first(exact.select("query", "id", _dot("asked", "vec").alias("score")), "query", k + 1, F.desc("score"), F.col("id"))
    lists = exact.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    answers = classes.join(lists, classes["id"] == lists["query"]).select("vec", "best")
    own = asking.join(answers, "vec").select(F.col("id").alias("query_id"), F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), "hit.score"
    )


def recall(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Share of the true k nearest of ``queries`` that ``found`` has; for a bounded sample of queries, each read against all rows."""
    asked = [(r.id, r.vec) for r in _clean(queries, id_col, vec_col).distinct().collect()]
    if not asked:
        return 1.0
    size, names = max(len(v) for _, v in asked), np.array([i for i, _ in asked])
    matrix = np.array([v + [0.0] * (size - len(v)) for _, v in asked])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            wide = max(size, int(np.diff(batch.column(1).offsets.to_numpy()).max()))
            scores = matrix @ _matrix(batch.column(1), wide)[:, :size].T
            scores[names[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            kept = np.take_along_axis(scores, top, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, top.shape[1])), pa.array(ids[top].ravel()), pa.array(kept.ravel())], names=["query", "id", "score"])

    true = _clean(rows, id_col, vec_col).distinct().mapInArrow(best, "query long, id long, score double").filter("score > double('-inf')")
    true = _first(true, "query", k, F.desc("score"), F.col("id"))
    hits = true.join(found.select(F.col("query_id").alias("query"), F.col("vec_id").alias("id"), F.lit(1).alias("hit")), ["query", "id"], "left")
    row = hits.agg(F.count("*"), F.count("hit")).first()
    return row[1] / row[0] if row[0] else 1.0
