"""Where members sit: coordinates of a horseshoe from sector, row and seat numbers, and places from the outlines of a plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Radius of the first row, distance of rows, angle of an aisle, angle of the horseshoe, rows by which the front bench is further in.
R0, GAP, AISLE, SPAN, FRONT_ROWS = 66.0, 7.6, 0.07, math.pi * 1.06, 2.1
FRONT = 0


def orientation(seats: DataFrame, government: str, front: int = FRONT) -> DataFrame:
    """(sector, spot): sectors from the Speaker's left to the right, so that the government's centroid is to the right.

    ``seats`` are (sector, row, seat, grp); the front bench has no spot.  A house has some ten sectors.
    """
    per = seats.filter(F.col("sector") != front).groupBy("sector").agg(F.count_if(F.col("grp") == government).alias("own"))
    whole = per.agg(
        F.coalesce(F.try_divide(F.sum(F.col("sector") * F.col("own")), F.sum("own")), F.lit(0.0)).alias("centroid"), ((F.min("sector") + F.max("sector")) / 2).alias("middle")
    )
    rows = per.join(F.broadcast(whole))  # one row
    flipped = F.col("centroid") < F.col("middle")
    order = W.orderBy(F.when(flipped, -F.col("sector")).otherwise(F.col("sector")))  # sectors, not seats
    return rows.select("sector", F.row_number().over(order).alias("spot"), flipped.alias("flipped"))


def wedges(seats: DataFrame, sectors: DataFrame, front: int = FRONT, r0: float = R0, gap: float = GAP, aisle: float = AISLE, span: float = SPAN) -> DataFrame:
    """(sector, pitch, left, right): each sector's edges as angles, as wide as its tightest row needs at one pitch for all seats."""
    rows = seats.filter(F.col("sector") != front).groupBy("sector", "row").agg(F.max("seat").alias("k"))
    need = rows.groupBy("sector").agg(F.max(F.greatest("k", F.lit(1)) / (r0 + (F.col("row") - 1) * gap)).alias("need"))
    both = need.join(F.broadcast(sectors), "sector")
    every = W.orderBy("spot")  # a row a sector
    usable = span - aisle * (F.max("spot").over(W.partitionBy()) - 1)
    both = both.withColumn("pitch", usable / F.sum("need").over(W.partitionBy()))
    before = F.coalesce(F.sum(F.col("need") * F.col("pitch") + aisle).over(every.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.lit(math.pi / 2 + span / 2) - before
    return both.select("sector", "pitch", left.alias("left"), (left - F.col("need") * F.col("pitch")).alias("right"))


def _point(r: Column, angle: Column) -> list[Column]:
    return [F.round(r * F.cos(angle), 2).alias("x"), F.round(-r * F.sin(angle), 2).alias("y")]


def layout(seats: DataFrame, sectors: DataFrame, front: int = FRONT, r0: float = R0, gap: float = GAP, aisle: float = AISLE, span: float = SPAN, empty: bool = False) -> DataFrame:
    """``seats`` (sector, row, seat, ...) with x, y and front: the platform at the origin, seats above it, y downwards.

    Rows are concentric; a row is centred in its sector's wedge at the common pitch, or narrower if the wedge is.  The front bench is a
    half circle further in.  With ``empty``, the numbers that a row skips below its highest seat instead, as (sector, row, seat).
    """
    edges = wedges(seats, sectors, front, r0, gap, aisle, span)
    longest = seats.filter(F.col("sector") != front).groupBy("sector", "row").agg(F.max("seat").alias("__k"))
    bench = seats.filter(F.col("sector") == front).agg(F.coalesce(F.max("seat"), F.lit(1)).alias("__bench"))
    if empty:
        taken = seats.select("sector", "row", "seat").distinct()
        rows = longest.select("sector", "row", F.explode(F.sequence(F.lit(1), "__k")).alias("seat"))
        chairs = bench.select(F.lit(front).alias("sector"), F.lit(0).alias("row"), F.explode(F.sequence(F.lit(1), "__bench")).alias("seat"))
        chairs = chairs.join(taken.filter(F.col("sector") == front).select("seat"), "seat", "left_anti").select("sector", "row", "seat")
        has_bench = seats.filter(F.col("sector") == front).limit(1).select(F.lit(1).alias("one"))
        seats = rows.join(taken, ["sector", "row", "seat"], "left_anti").unionByName(chairs.join(has_bench, how="cross").drop("one"))
    rows = seats.join(F.broadcast(edges), "sector", "left").join(longest, ["sector", "row"], "left").crossJoin(F.broadcast(bench))  # a row a sector; one row
    at_front = F.col("sector") == front
    k, r = F.coalesce("__k", "seat"), r0 + (F.col("row") - 1) * gap
    wide = F.least(F.col("left") - F.col("right"), k * F.col("pitch") / r)
    angle = (F.col("left") + F.col("right")) / 2 + wide / 2 - wide * (F.col("seat") - 0.5) / k
    bench_angle = F.lit(math.pi) - math.pi * (F.col("seat") - 0.5) / F.col("__bench")
    x, y = _point(F.when(at_front, r0 - FRONT_ROWS * gap).otherwise(r), F.when(at_front, bench_angle).otherwise(angle))
    return rows.select(*seats.columns, x, y, at_front.alias("front"))


#: A command of an outline and its numbers.
_COMMAND, _NUMBER = r"([MmLlCcZz][^MmLlCcZz]*)", r"(-?\d*\.?\d+(?:e-?\d+)?)"


def outline(path: Column, samples: int = 4) -> Column:
    """The points of an outline of the commands M, L, C and Z in either case, as an array of (x, y): curves by ``samples`` points.

    Small letters count from where the pen is.  A move with more than one point goes on as lines.
    """
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(_NUMBER), F.lit(1)), lambda x: x.cast("double"))
    none = F.array().cast("array<struct<x:double,y:double>>")
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), none.alias("points"))

    def step(state: Column, command: Column) -> Column:
        kind, n = F.lower(F.substring(command, 1, 1)), numbers(command)
        relative = F.substring(command, 1, 1) == kind
        size = F.when(kind == "c", 6).otherwise(2)
        groups = F.when(F.size(n) >= size, F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / size).cast("int") - 1), lambda g: F.slice(n, g * size + 1, size)))
        groups = F.coalesce(groups, F.array().cast("array<array<double>>"))
        first = F.struct(state["x"].alias("x"), state["y"].alias("y"), none.alias("points"))

        def draw(pen: Column, g: Column) -> Column:
            ox, oy = F.when(relative, pen["x"]).otherwise(0.0), F.when(relative, pen["y"]).otherwise(0.0)
            at = lambda k: F.try_element_at(g, F.lit(k))
            point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
            line = F.array(point(ox + at(1), oy + at(2)))

            def curve(j: Column) -> Column:
                t = j / samples
                mix = lambda a, b, c, d: (1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * b + 3 * (1 - t) * t**2 * c + t**3 * d
                return point(mix(pen["x"], ox + at(1), ox + at(3), ox + at(5)), mix(pen["y"], oy + at(2), oy + at(4), oy + at(6)))

            new = F.when(kind == "c", F.transform(F.sequence(F.lit(1), F.lit(samples)), curve)).otherwise(line)
            end = F.element_at(new, -1)
            return F.struct(end["x"].alias("x"), end["y"].alias("y"), F.concat(pen["points"], new).alias("points"))

        drawn = F.aggregate(groups, first, draw)
        moved = kind == "m"
        home = F.element_at(drawn["points"], 1)
        begun = moved & (F.size(drawn["points"]) > 0)
        closed = kind == "z"
        return F.struct(
            F.when(closed, state["sx"]).otherwise(drawn["x"]).alias("x"), F.when(closed, state["sy"]).otherwise(drawn["y"]).alias("y"),
            F.when(begun, home["x"]).otherwise(state["sx"]).alias("sx"), F.when(begun, home["y"]).otherwise(state["sy"]).alias("sy"),
            F.concat(state["points"], F.coalesce(drawn["points"], none)).alias("points"),
        )

    return F.aggregate(F.regexp_extract_all(F.coalesce(path, F.lit("")), F.lit(_COMMAND), F.lit(1)), start, step, lambda s: s["points"])


def centroid(points: Column) -> Column:
    """The centroid (x, y) of a closed outline by the shoelace formula; of one without area, the mean of its points."""
    n = F.size(points)
    following = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    total = lambda f: F.aggregate(F.zip_with(points, following, f), F.lit(0.0), lambda s, v: s + v)
    twice = total(cross)
    cx, cy = total(lambda p, q: (p["x"] + q["x"]) * cross(p, q)), total(lambda p, q: (p["y"] + q["y"]) * cross(p, q))
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / n
    flat = F.abs(twice) < 1e-9
    return F.when(n > 0, F.struct(F.when(flat, mean("x")).otherwise(cx / (3 * twice)).alias("x"), F.when(flat, mean("y")).otherwise(cy / (3 * twice)).alias("y")))


def on_plan(seats: DataFrame, plan: DataFrame, width: float = 260.0, below: float = 40.0) -> DataFrame:
    """Each place of ``plan`` (sector, row, seat, path) with x, y and member: the centroids of the outlines, scaled to ``width`` across.

    The platform, ``below`` units under the last places and in the middle, is the origin.  ``seats`` are (sector, row, seat, member); a
    member whose seat the plan lacks has a row without x and y, an empty place one without member.
    """
    shapes = plan.select("sector", "row", "seat", outline(F.col("path")).alias("points")).withColumn("c", centroid(F.col("points")))
    each = lambda c: F.transform("points", lambda p: p[c])
    extent = shapes.agg(
        F.min(F.array_min(each("x"))).alias("x0"), F.max(F.array_max(each("x"))).alias("x1"), F.max(F.array_max(each("y"))).alias("y1")
    )
    scale = width / (F.col("x1") - F.col("x0"))
    placed = shapes.crossJoin(F.broadcast(extent)).select(  # one row
        "sector", "row", "seat", F.round((F.col("c.x") - (F.col("x0") + F.col("x1")) / 2) * scale, 2).alias("x"), F.round((F.col("c.y") - F.col("y1") - below) * scale, 2).alias("y")
    )
    return placed.join(seats.select("sector", "row", "seat", "member"), ["sector", "row", "seat"], "full")
