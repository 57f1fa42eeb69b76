"""Penalised change points of many daily series: the optimal cut of each series into segments.

Spark sums the values of each series and day, so the rows of a hot series are merged before they are shuffled, and
a series reaches one task as one number a day, however many rows it has.  Tasks then solve packs of series of like
length together.  The recurrence

    best[j] = min over i <= j - least of best[i] + cost(i, j) + (penalty if i > 0)

is solved by divide and conquer (CDQ): solve the left half of the positions, push what its positions contribute to
all positions of the right half by min-plus kernels over blocks, then solve the right half.  Blocks bound the memory:
a pack needs its series and a few blocks, never a matrix of all pairs of days.  Keys are (cost, segments) in one
integer, and a contribution replaces another only if it is less; as contributions come to a position in ascending order
of predecessors, the earliest of equal predecessors stays.  Time grows with the square of the days of a series.

Cases: rows without a day or value take no part; a null key is a series of its own; rows that repeat all count; days
between the first and the last without rows count 0; a series with fewer days than ``least`` is one segment; an empty
table gives an empty result.  Only the three columns named are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Series solved together, and positions a side of a kernel's block: 32 * 64 * 64 numbers are 1 MiB.
PACK = 32
BLOCK = 64
#: Larger than every key; keys stay below as long as days * days * 44,000 does.
_NEVER = np.int64(2**61)
#: Sums of squares stay exact in 64 bits below this; larger series are solved with Python's integers.
_EXACT = 2**62


class _Pack:
    """Series of like length, padded with zeros to the longest: solved together, position 0 before the first day."""

    def __init__(self, series: list[np.ndarray], least: int, penalty: int):
        self.least, self.penalty = least, penalty
        self.days = np.array([len(x) for x in series])
        n = int(self.days.max())
        # a variance doesn't change when its values are shifted, and the products stay small
        shifts = [int(x.min()) for x in series]
        most = max(int(x.max()) - low for x, low in zip(series, shifts, strict=True))
        kind = np.int64 if (n * most) ** 2 < _EXACT else object
        values = np.zeros((len(series), n + 1), dtype=kind)
        for row, x, low in zip(values, series, shifts, strict=True):
            row[1 : len(x) + 1] = x.astype(kind) - low
        self.sums, self.squares = values.cumsum(axis=1), (values * values).cumsum(axis=1)
        self.scale = np.int64(n + 2)  # more than a series has segments
        self.key = np.full((len(series), n + 1), _NEVER, dtype=np.int64)
        self.key[:, 0] = 0
        self.before = np.zeros((len(series), n + 1), dtype=np.int64)

    def spread_cost(self, n, total, squares):
        """V = 1 + floor of the variance, and days * floor(1000 ln V)."""
        spread = 1 + (n * squares - total * total) // (n * n)
        return spread, n.astype(np.int64) * np.floor(1000 * np.log(spread.astype(np.float64))).astype(np.int64)

    def push(self, i: slice, j: slice) -> None:
        """Contributions of the positions i, which are solved, to the later positions j."""
        n = np.arange(j.start, j.stop)[None, :] - np.arange(i.start, i.stop)[:, None]
        far = n >= self.least
        if not far.any():
            return
        total = self.sums[:, None, j] - self.sums[:, i, None]
        squares = self.squares[:, None, j] - self.squares[:, i, None]
        days = np.maximum(n, 1)
        cost = self.spread_cost(days if total.dtype != object else days.astype(object), total, squares)[1]
        cost = (cost + np.where(np.arange(i.start, i.stop) > 0, self.penalty, 0)[None, :, None]) * self.scale + 1
        keys = np.where(far[None] & (self.key[:, i] < _NEVER)[:, :, None], self.key[:, i, None] + cost, _NEVER)
        first = keys.argmin(axis=1)  # the first of equals
        best = np.take_along_axis(keys, first[:, None], axis=1)[:, 0]
        less = best < self.key[:, j]
        self.key[:, j] = np.where(less, best, self.key[:, j])
        self.before[:, j] = np.where(less, first + i.start, self.before[:, j])

    def solve(self, start: int, stop: int) -> None:
        if stop - start <= self.least:  # no two of these positions are a segment apart
            return
        middle = (start + stop) // 2
        self.solve(start, middle)
        for i in range(start, middle, BLOCK):
            for j in range(middle, stop, BLOCK):
                self.push(slice(i, min(i + BLOCK, middle)), slice(j, min(j + BLOCK, stop)))
        self.solve(middle, stop)

    def segments(self) -> list[tuple[list[int], int]]:
        """Each series' starts, and its best cost with penalties."""
        self.solve(0, self.key.shape[1])
        out = []
        for row, n in enumerate(map(int, self.days)):
            if n < self.least:
                days = np.array([n], dtype=self.sums.dtype)
                cost = self.spread_cost(days, self.sums[row, [n]], self.squares[row, [n]])[1]
                out.append(([0], int(cost[0])))
                continue
            starts, at = [], n
            while at > 0:
                at = int(self.before[row, at])
                starts.append(at)
            out.append((starts[::-1], int(self.key[row, n] // self.scale)))
        return out


def _dense(days: np.ndarray, totals: np.ndarray) -> np.ndarray:
    out = np.zeros(int(days[-1] - days[0]) + 1, dtype=np.int64)
    out[days - days[0]] = totals
    return out


def cut_series(series: list[np.ndarray], least: int = 5, penalty: int = 10_000) -> list[tuple[list[int], int]]:
    """For each series of whole numbers, the starts of its segments and the cost of the best cut."""
    order = sorted(range(len(series)), key=lambda k: len(series[k]))
    out: list = [None] * len(series)
    for at in range(0, len(order), PACK):
        some = order[at : at + PACK]
        for k, got in zip(some, _Pack([series[k] for k in some], least, penalty).segments(), strict=True):
            out[k] = got
    return out


def change_points(
    rows: DataFrame, key: str = "vendor_id", day: str = "shipped_at", value: str = "quantity", least: int = 5, penalty: int = 10_000
) -> DataFrame:
    """(key, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost): each series' best cut into segments.

    A segment has ``least`` days or more; its cost is its days times floor(1000 ln V), V = 1 + floor of the variance of its
    days' sums; each cut costs ``penalty``.  Ties: fewest segments, then the earliest starts, compared from the last segment on.
    """
    spark = rows.sparkSession
    daily = (
        rows.select(F.col(f"`{key}`").alias("k"), F.unix_date(F.to_date(F.col(f"`{day}`"))).alias("d"), F.col(f"`{value}`").cast("long").alias("v"))
        .filter("d is not null and v is not null").groupBy("k", "d").agg(F.sum("v").alias("v"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    series = (
        daily.repartition(parts, "k").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("s"))
        .select("k", "s.d", "s.v")
    )
    kind = daily.schema["k"].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("segment_no", T.IntegerType())]
        + [T.StructField(x, T.LongType()) for x in ("first_day", "n_days", "total", "spread", "cost", "n_segments", "best_cost")]
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            days = [np.asarray(x.values) for x in batch.column(1)]
            series = [_dense(d, np.asarray(v.values)) for d, v in zip(days, batch.column(2), strict=True)]
            at, cols = [], [[] for _ in range(8)]
            for row, (starts, best) in enumerate(cut_series(series, least, penalty)):
                for no, (a, z) in enumerate(zip(starts, [*starts[1:], len(series[row])], strict=True), 1):
                    part = [int(x) for x in series[row][a:z]]
                    n, total = z - a, sum(part)
                    spread = 1 + (n * sum(x * x for x in part) - total * total) // (n * n)
                    cost = n * int(np.floor(1000 * np.log(float(spread))))
                    at.append(row)
                    for col, x in zip(cols, (no, int(days[row][0]) + a, n, total, spread, cost, len(starts), best), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])],
                names=schema.names,
            )

    return series.mapInArrow(solve, schema)
