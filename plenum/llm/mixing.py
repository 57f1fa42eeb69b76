"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source's documents are dealt, in a fixed random order, to blocks of ``block`` documents.  With the
target weight of a source rounded to ``share`` of ``period`` slots, its block j is released at
floor(j * period / share) and due at ceil((j + 1) * period / share).  Earliest deadline first gives every
slot to one released block; every block then meets its deadline, so at any slot a source is less than one
block away from its weight times the slots so far.  The schedule repeats after ``period`` slots, so it
is worked out for one period (a bounded table) and applied to any number of blocks by a join.

Once a source has no blocks left its slots are empty and the others go on in the same order; no row is
dropped, repeated or sampled.

Cases: a null source is the source ''.  Without weights, a source's weight is its number of rows to
the power ``alpha``; with weights, each source that is present needs one above 0.  Null texts and other
columns don't matter.  Rows that repeat, and rows without doc_id, each have a place of their own, ordered by
doc_id and then by the hash of the text.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sources that one mix can have; the schedule's table has 4 slots a source at most beyond ``PERIOD``.
SOURCES, PERIOD = 10_000, 1_000
#: Documents that share a hash prefix when rows are numbered.
RUN = 2_000


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Slots of each source in a period: the largest remainders round up, none is left without a slot."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] - math.floor(exact[s])), s))
    k = 0
    while sum(out.values()) < period:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > period:
        out[max(out, key=lambda s: (out[s] - exact[s] if out[s] > 1 else -math.inf, s))] -= 1
    return out


def schedule(share: Mapping[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, block in the period, slot) by earliest deadline first; ties go to the smaller name."""
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // share[s]), s, j))
        if not ready:
            continue
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        if j + 1 < share[s]:
            heapq.heappush(waiting, ((j + 1) * period // share[s], s, j + 1))
    return out


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def place(
    docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = 8, alpha: float = 0.5, period: int = PERIOD,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", whole: bool = False,
) -> DataFrame:
    """doc_id, __source, __weight, __block, __release, __deadline, __slot, __position; with ``whole``, also
    ``__row`` with all columns of ``docs``, in one, so that no name of theirs can clash."""
    spark = docs.sparkSession
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    key = F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(text).cast("string"))))
    named = docs.select(
        *([F.struct("*").alias("__row")] if whole else []), doc_id.alias("doc_id"), F.xxhash64(text).alias("__hash"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("__source"), key.alias("__key"),
    )
    sizes = {r[0]: r.n for r in named.groupBy("__source").agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()}
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    target = {s: float(weights[s]) for s in sizes} if weights is not None else {s: n**alpha for s, n in sizes.items()}
    if any(w <= 0 for w in target.values()):
        raise ValueError("every source needs a weight above 0")
    period = max(period, 4 * len(sizes))
    share = shares(target, period) if sizes else {}
    slots = [{"__source": s, "__turn": j, "__at": t, "__share": share[s]} for s, j, t in schedule(share, period)]
    table = _table(spark, slots, "__source: string, __turn: long, __at: long, __share: long")
    owned = _table(spark, [{"__source": s, "__share": a} for s, a in share.items()], "__source: string, __share: long")

    digits = max(0, math.ceil(math.log(max(1, max(sizes.values(), default=1)) / RUN, 16)))
    named = named.withColumns({"__run": F.substring("__key", 1, digits), "__part": F.substring("__key", 1, digits // 2)})
    runs = named.groupBy("__source", "__part", "__run").agg(F.count("*").alias("n"))
    parts = runs.groupBy("__source", "__part").agg(F.sum("n").alias("n"))
    parts = parts.select("__source", "__part", F.coalesce(F.sum("n").over(W.partitionBy("__source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("a"))
    runs = runs.select("__source", "__part", "__run", F.coalesce(F.sum("n").over(W.partitionBy("__source", "__part").orderBy("__run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    first = runs.join(parts, ["__source", "__part"]).select("__source", "__run", (F.col("a") + F.col("b")).alias("__first"))
    own = F.row_number().over(W.partitionBy("__source", "__run").orderBy("__key", "doc_id", "__hash"))
    rows = named.drop("__part").withColumn("__own", own - 1).join(first, ["__source", "__run"])
    rows = rows.withColumn("__seq", F.col("__first") + F.col("__own"))
    rows = rows.withColumn("__block", F.floor(F.col("__seq") / block).cast("long")).join(F.broadcast(owned), "__source")
    rows = rows.withColumn("__turn", F.col("__block") % F.col("__share")).join(F.broadcast(table.drop("__share")), ["__source", "__turn"])
    slot = F.expr(f"(__block div __share) * {period} + __at")
    return rows.withColumns({
        "__weight": F.col("__share") / period,
        "__release": F.expr(f"__block * {period} div __share"),
        "__deadline": F.expr(f"((__block + 1) * {period} + __share - 1) div __share"),
        "__slot": slot,
        "__position": slot * block + F.col("__seq") % block,
    }).drop("__turn", "__at", "__share", "__seq", "__first", "__own", "__run", "__key", "__hash")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, weight, block, release, deadline, slot, position: one row for each row of ``docs``.

    Reading in the order of ``position`` gives the mix.
    """
    names = ["source", "weight", "block", "release", "deadline", "slot", "position"]
    return place(docs, **how).select("doc_id", *[F.col(f"__{n}").alias(n) for n in names])


def placed_rows(docs: DataFrame, **how) -> DataFrame:
    """``__row`` with all columns of ``docs``, and position, in the order of the mix."""
    rows = place(docs, whole=True, **how).repartitionByRange("__position").sortWithinPartitions("__position")
    return rows.select("__row", F.col("__position").alias("position"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all its columns, in the order of the mix; files written and read again can lose the order."""
    return placed_rows(docs, **how).select("__row.*")
