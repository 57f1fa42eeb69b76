"""Seating, named files and manifests against plain Python and pyarrow."""

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plenum.operators import seating
from plenum.sources import manifest, named


def points_of(path, samples=4):
    pen, start, out = (0.0, 0.0), (0.0, 0.0), []
    for command, rest in re.findall(r"([MmLlCcZz])([^MmLlCcZz]*)", path):
        n = np.array([float(x) for x in re.findall(r"-?\d*\.?\d+(?:e-?\d+)?", rest)])
        if command in "zZ":
            pen = start
            continue
        for k, g in enumerate(n.reshape(-1, 6 if command in "cC" else 2)):
            g = g.reshape(-1, 2) + (pen if command.islower() else (0, 0))
            if len(g) == 3:
                t = (np.arange(1, samples + 1) / samples)[:, None]
                new = (1 - t) ** 3 * pen + 3 * (1 - t) ** 2 * t * g[0] + 3 * (1 - t) * t**2 * g[1] + t**3 * g[2]
            else:
                new = g
            out += [tuple(p) for p in new]
            pen = tuple(new[-1])
            if command in "mM" and k == 0:
                start = pen
    return out


def middle_of(points):
    x, y = np.array(points).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    if abs(cross.sum()) < 1e-9:
        return x.mean(), y.mean()
    return tuple(((v + np.roll(v, -1)) * cross).sum() / (3 * cross.sum()) for v in (x, y))


PATHS = [
    "M10 10L20 10L20 20L10 20Z", "m10,10l10,0 0,10 -10,0z", "M0 0C0 10 10 10 10 0Z", "m5 5c1,2 3,4 5,0c0-3-4-2-5,0z", "M1 1 2 2 3 3", "M1.5-2e-1l.5.5z m4 4 l2 0 0 2z", "M3 3",
]


def test_outlines_and_centroids(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate(PATHS)] + [(99, None), (98, "")], "k int, p string")
    points = seating.outline(F.col("p"))
    for r in df.select("k", points.alias("pts"), seating.centroid(points).alias("c")).collect():
        if r.k >= 98:
            assert r.pts == [] and r.c is None
            continue
        want = points_of(PATHS[r.k])
        assert np.allclose([tuple(p) for p in r.pts], want) and np.allclose(tuple(r.c), middle_of(want))


def test_places_on_a_plan(spark):
    plan = [(1, 1, k, f"M{10 * k} {5 * k}l8 0 0 4 -8 0z") for k in range(1, 5)]
    seats = spark.createDataFrame([(1, 1, 2, "a"), (1, 9, 9, "b")], "sector int, row int, seat int, member string")
    got = {(r.sector, r.row, r.seat): (r.x, r.y, r.member) for r in seating.on_plan(seats, spark.createDataFrame(plan, "sector int, row int, seat int, path string")).collect()}
    scale = 260 / 38
    want = {(1, 1, k): (round((10 * k + 4 - 29) * scale, 2), round((5 * k + 2 - 64) * scale, 2), "a" if k == 2 else None) for k in range(1, 5)} | {(1, 9, 9): (None, None, "b")}
    assert got == want


def test_layout_of_a_horseshoe(spark):
    rnd = random.Random(4)
    seats = sorted({(s, r, n) for s in range(1, 6) for r in range(1, 4) for n in rnd.sample(range(1, 12), 6)}) + [(0, 0, n) for n in (1, 3, 7)]
    rows = [(s, r, n, "gov" if s <= 2 and s > 0 else "opp", k) for k, (s, r, n) in enumerate(seats)]
    df = spark.createDataFrame(rows, "sector int, row int, seat int, grp string, member int")
    order = seating.orientation(df, "gov")
    assert [r.sector for r in order.orderBy("spot").collect()] == [5, 4, 3, 2, 1]
    assert [r.sector for r in seating.orientation(df, "opp").orderBy("spot").collect()] == [1, 2, 3, 4, 5]
    got = {r.member: (r.x, r.y, r.front) for r in seating.layout(df, order).collect()}
    radius = lambda r: 66 + (r - 1) * 7.6
    most = {(s, r): max(n for a, b, n in seats if (a, b) == (s, r)) for s, r, _ in seats if s}
    need = {s: max(k / radius(r) for (a, r), k in most.items() if a == s) for s in range(1, 6)}
    pitch = (math.pi * 1.06 - 0.07 * 4) / sum(need.values())
    left, at = {}, math.pi / 2 + math.pi * 1.06 / 2
    for s in (5, 4, 3, 2, 1):
        left[s] = at
        at -= need[s] * pitch + 0.07
    for s, r, n, _, member in rows:
        if s == 0:
            rad, angle = 66 - 2.1 * 7.6, math.pi - math.pi * (n - 0.5) / 7
        else:
            k, rad = most[s, r], radius(r)
            wide = min(need[s] * pitch, k * pitch / rad)
            angle = left[s] - need[s] * pitch / 2 + wide / 2 - wide * (n - 0.5) / k
        assert np.allclose(got[member][:2], (rad * math.cos(angle), -rad * math.sin(angle)), atol=0.011) and got[member][2] == (s == 0)
    free = {(r.sector, r.row, r.seat) for r in seating.layout(df, order, empty=True).collect()}
    assert free == {(s, r, n) for (s, r), k in most.items() for n in range(1, k) if (s, r, n) not in seats} | {(0, 0, n) for n in (2, 4, 5, 6)}


def opened(df):
    """How many files the scans of a query that has run have read."""
    df._jdf.queryExecution().executedPlan().execute().count()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()) if leaves.apply(k).metrics().contains("numFiles"))


def test_a_filter_on_names_opens_only_its_files(spark, tmp_path):
    for term in (42, 43):
        for sitting in (9, 10, 100):
            (tmp_path / f"ckl{term}_nap{sitting}_f1.xml").write_text(f"<a>{term} {sitting}</a>")
    (tmp_path / "other.xml").write_text("<b/>")
    (tmp_path / "ckl42_napx_f1.xml").write_text("<b/>")
    rows = named.named_files(spark, str(tmp_path), named.SPEECHES, {"term": "int", "sitting": "int", "seq": "int"}, "*.xml")
    got = [(r.term, r.sitting, r.seq, bytes(r.content).decode()) for r in named.in_order(rows, "term", "sitting", "seq").collect()]
    assert got == [(t, s, 1, f"<a>{t} {s}</a>") for t in (42, 43) for s in (9, 10, 100)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert opened(rows.filter("term = 43 and sitting < 50").select("content")) == 2
        assert opened(rows.filter("term = 44").select("content")) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for k in (1, 2):
        (tmp_path / f"cache/term={k}").mkdir(parents=True)
        (tmp_path / f"cache/term={k}/x.json").write_text("{}")
    assert [r.term for r in named.partitioned_files(spark, str(tmp_path / "cache"), ".json").filter("term = 2").collect()] == [2]


def test_manifest_equals_the_footers(spark, tmp_path):
    df = spark.range(50_000).selectExpr("id", "id % 7 as k", "cast(id as string) as s").repartition(5)
    manifest.write_groups(df, str(tmp_path / "t"), ["id"], files=3, group_rows=4000)
    got = {r.file: r for r in manifest.manifest(spark, str(tmp_path / "t"), "id").collect()}
    files = sorted((tmp_path / "t").glob("*.parquet"))
    assert set(got) == {f.name for f in files} and len(files) == 3
    for f in files:
        meta, r = pq.read_metadata(f), got[f.name]
        spans = [meta.row_group(k).column(0).statistics for k in range(meta.num_row_groups)]
        assert (r.bytes, r.rows, r.row_groups, r.columns, r.codec) == (f.stat().st_size, meta.num_rows, meta.num_row_groups, ["id", "k", "s"], "ZSTD")
        assert (r.first, r.last) == (str(min(s.min for s in spans)), str(max(s.max for s in spans))) and r.largest_group == max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 4000
    one = manifest.summary(manifest.manifest(spark, str(tmp_path / "t"), "id")).first()
    assert (one.files, one.rows, one["first"], one["last"]) == (3, 50_000, 0, 49_999) and one.bytes == sum(f.stat().st_size for f in files)
