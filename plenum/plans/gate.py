"""Recomputing only what changed: inputs are known by their content, outputs by what they were built from.

``Gate`` keeps two versioned tables in its folder: what each input file held (size, time, SHA-256, part), and for each
part of each output a digest of all it was built from.  A run lists the files without opening them; only files whose size or
time moved are read again, on executors.  A part of an output is built again if the digest of its inputs moved; an output
that another needs counts with the digests of its parts, so what follows from a change is built too, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.sources.versions import Check, Versions


@dataclass(frozen=True)
class Input:
    """Files below ``folder`` that match ``glob``; the first group of ``part`` in a path is the part the file belongs to."""

    name: str
    folder: str
    read: Callable[[SparkSession, list[str]], DataFrame]
    glob: str = "*"
    part: str = ""


@dataclass(frozen=True)
class Output:
    """A table with a column ``part``, built from the parts of what it needs; ``code`` stands for the builder's version.

    ``build`` gets a DataFrame for each need, with the rows of the stale parts only.  With ``whole``, any change of a need builds all
    of it again, as one part ''.
    """

    name: str
    needs: tuple[str, ...]
    build: Callable[[dict[str, DataFrame]], DataFrame]
    code: str = ""
    whole: bool = False
    checks: tuple[Check, ...] = field(default=())


class Gate:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.files = Versions(spark, f"{self.folder}/files", ["input", "path"], buckets)
        self.built = Versions(spark, f"{self.folder}/built", ["output"], buckets)

    def table(self, output: str) -> Versions:
        return Versions(self.spark, f"{self.folder}/outputs/{output}", ["part"], self.buckets)

    def scan(self, inputs: list[Input]) -> tuple[DataFrame, int]:
        """(input, path, size, at, digest, part) of all files as they are, and how many of them had to be read."""
        listed = None
        for x in inputs:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", x.glob).load(x.folder)
            part = F.regexp_extract("path", x.part, 1) if x.part else F.lit("")
            one = files.select(F.lit(x.name).alias("input"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("at"), part.alias("part"))
            listed = one if listed is None else listed.unionByName(one)
        known = self.files.read()
        if known is None:
            known = listed.limit(0).withColumn("digest", F.lit(""))
        same = ["input", "path", "size", "at"]
        kept = listed.join(known.select(*same, "digest"), same, "left")
        moved = [r.path for r in kept.filter("digest is null").select("path").distinct().collect()]  # paths that Spark is to read are the driver's
        if not moved:
            return kept.select(*same, "digest", "part"), 0
        read = self.spark.read.format("binaryFile").load(moved).select("path", F.sha2("content", 256).alias("now"))
        rows = kept.join(read, "path", "left").select(*same, F.coalesce("digest", "now").alias("digest"), "part")
        return rows, len(moved)

    def run(self, inputs: list[Input], outputs: list[Output]) -> list[dict]:
        """Bring all outputs up to date, in their order; says for each which parts were built and how many stayed.

        The first row is about the inputs: files, and files whose content was read.
        """
        rows, opened = self.scan(inputs)
        self.files.rebuild(rows)
        now = self.files.read()
        report = [{"name": "", "files": now.count(), "opened": opened}]
        by_part = now.groupBy(F.col("input").alias("name"), "part").agg(self._digest(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "digest"))), "\n")))
        state = by_part
        for out in outputs:
            mine = state.filter(F.col("name").isin(*out.needs)).withColumn("part", F.lit("") if out.whole else F.col("part"))
            lines = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "name", "digest"))), "\n")
            want = mine.groupBy("part").agg(self._digest(F.concat(F.lit(out.code + "\n"), lines)))
            done = self.built.read()
            was = None if done is None else done.filter(F.col("output") == out.name).select("part", F.col("digest").alias("was"))
            both = want.withColumn("was", F.lit(None).cast("string")) if was is None else want.join(was, "part", "full")
            both = both.select("part", "digest", "was", (~F.col("digest").eqNullSafe(F.col("was"))).alias("stale")).collect()  # a row a part
            stale = sorted(r.part for r in both if r.stale)
            if stale:
                gone = [r.part for r in both if r.digest is None]
                self._build(out, inputs, outputs, now, stale, gone)
                fresh = [(out.name, r.part, r.digest) for r in both if r.digest is not None]
                self.built.replace_children(self.spark.createDataFrame(fresh or [(out.name, "", "")], "output string, part string, digest string"))
            report.append({"name": out.name, "built": stale, "kept": sum(not r.stale for r in both)})
            content = self.table(out.name).read()
            if content is not None:
                each = F.xxhash64(F.to_json(F.struct(*sorted(content.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
                made = content.groupBy("part").agg(self._digest(F.concat_ws(" ", F.sum(each).cast("string"), F.count("*").cast("string"))))
                state = state.unionByName(made.select(F.lit(out.name).alias("name"), "part", "digest"))
        return report

    def _build(self, out: Output, inputs: list[Input], outputs: list[Output], files: DataFrame, stale: list[str], gone: list[str]) -> None:
        given = {}
        for need in out.needs:
            source = next((x for x in inputs if x.name == need), None)
            if source is None:
                rows = self.table(need).read()
                given[need] = rows if out.whole else rows.filter(F.col("part").isin(*stale))
                continue
            chosen = files.filter(F.col("input") == need)
            chosen = chosen if out.whole else chosen.filter(F.col("part").isin(*stale))
            paths = [r.path for r in chosen.select("path").orderBy("path").collect()]
            if paths:
                part = F.regexp_extract(F.input_file_name(), source.part, 1) if source.part else F.lit("")
                given[need] = source.read(self.spark, paths).withColumn("part", part)
        if not given:
            rows = None
        else:
            rows = out.build(given)
            rows = rows.withColumn("part", F.lit("")) if out.whole else rows
        table = self.table(out.name)
        old = table.read()
        if rows is None and old is None:
            return
        parts = self.spark.createDataFrame([(p,) for p in sorted({*stale, *gone})], "part string")
        table.replace(parts, old.limit(0) if rows is None else rows, list(out.checks))  # a part may have fewer rows than before, or none

    @staticmethod
    def _digest(c):
        return F.sha2(c, 256).alias("digest")
