"""Tables that readers never see half written: staged, checked, then pointed to.

A table is a folder with data below ``data/<commit>/bucket=<k>``, one file of JSON a version that names each bucket's commit, and
a pointer to the version that counts.  The pointer is renamed into place last, so a run that fails a check, or dies, leaves
readers on the version before.  Rows are dealt to buckets by a hash of the key; a change writes the buckets it touches only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plenum.sources.work import delete

#: A check gets the rows that would be published and gives what is wrong, or None.
Check = Callable[[DataFrame], "str | None"]


class CheckFailed(ValueError):
    """What was staged isn't published."""


def at_least(rows: int) -> Check:
    def check(df: DataFrame) -> str | None:
        n = df.limit(rows).count()
        return None if n >= rows else f"{n} rows, {rows} at least"

    return check


def refers_to(column: str, parents: DataFrame, parent: str) -> Check:
    """Every value of ``column`` that isn't null is a ``parent``."""

    def check(df: DataFrame) -> str | None:
        lost = df.filter(F.col(column).isNotNull()).join(parents.select(F.col(parent).alias(column)), column, "left_anti").limit(3).collect()
        return f"{column} without a row: {[r[column] for r in lost]}" if lost else None

    return check


def unique(*columns: str) -> Check:
    def check(df: DataFrame) -> str | None:
        twice = df.groupBy(*columns).count().filter("count > 1").limit(3).collect()
        return f"not unique: {[tuple(r)[:-1] for r in twice]}" if twice else None

    return check


class Versions:
    """The table below ``path``, its rows dealt by ``key`` to ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _read(self, name: str) -> str | None:
        path = self._file(name)
        fs = path.getFileSystem(self._conf)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """A new file, renamed over the old one when it is whole."""
        part, path = self._file(f"{name}.{uuid.uuid4().hex}"), self._file(name)
        stream = part.getFileSystem(self._conf).create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self._conf)
        overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, path, overwrite)

    def version(self) -> int:
        """The version that counts; 0 before the first."""
        return int(self._read("current") or 0)

    def _manifest(self) -> dict:
        n = self.version()
        return json.loads(self._read(f"versions/{n}.json")) if n else {"schema": None, "commits": {}, "digests": {}}

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        chosen = [f"{self.path}/data/{commit}/bucket={k}" for k, commit in manifest["commits"].items() if buckets is None or int(k) in buckets]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The rows of the version that counts; None before the first."""
        return self._rows(self._manifest())

    def _bucket(self):
        return F.pmod(F.hash(*self.key), F.lit(self.buckets)).alias("bucket")

    def _publish(self, rows: DataFrame, kept: dict[str, str], digests: dict[str, str], checks: list[Check]) -> int:
        """Stage ``rows``, check them together with the buckets that are kept, and point to both."""
        commit = uuid.uuid4().hex
        staged = f"{self.path}/data/{commit}"
        names = rows.columns
        rows.withColumn("bucket", self._bucket()).repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(staged)
        # order of rows and files doesn't count: a digest is the number of a bucket's rows and the sum of their hashes
        each = F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
        back = self.spark.read.schema(StructType([*rows.schema.fields, StructField("bucket", IntegerType())])).parquet(staged)
        per = back.groupBy("bucket").agg(F.concat_ws(" ", F.count("*").cast("string"), F.sum(each).cast("string")).alias("d"))
        new = {str(r.bucket): r.d for r in per.collect()}
        manifest = {"schema": rows.schema.jsonValue(), "commits": kept | {k: commit for k in new}, "digests": digests | new}
        before = self._manifest()
        if before["schema"] == manifest["schema"] and before["digests"] == manifest["digests"]:
            delete(self.spark, staged)
            return self.version()  # nothing changed: readers stay where they are
        whole = self._rows(manifest)
        wrong = [w for w in (check(whole) for check in checks) if w]
        if wrong:
            delete(self.spark, staged)
            raise CheckFailed("; ".join(wrong))
        n = self.version() + 1
        self._write(f"versions/{n}.json", json.dumps(manifest))
        self._write("current", str(n))
        return n

    def rebuild(self, rows: DataFrame, checks: list[Check] | tuple[Check, ...] = ()) -> int:
        """All rows anew; returns the version that counts afterwards."""
        return self._publish(rows, {}, {}, list(checks))

    def _changed(self, keys: DataFrame, merge: Callable[[DataFrame | None], DataFrame], checks) -> int:
        """The buckets of ``keys`` anew, from their old rows; the others stay as they are."""
        manifest = self._manifest()
        touched = [r.bucket for r in keys.select(self._bucket()).distinct().collect()]  # the number of buckets is a parameter
        kept = {k: v for k, v in manifest["commits"].items() if int(k) not in touched}
        return self._publish(merge(self._rows(manifest, touched)), kept, {k: manifest["digests"][k] for k in kept}, list(checks))

    def replace(self, keys: DataFrame, came: DataFrame, checks: list[Check] | tuple[Check, ...] = ()) -> int:
        """The rows of ``keys`` go, those that came are there; the rows of other keys stay."""
        gone = keys.select(*self.key).distinct()

        def merge(old: DataFrame | None) -> DataFrame:
            return came if old is None else old.join(gone, self.key, "left_anti").select(*came.columns).unionByName(came)

        return self._changed(keys, merge, checks)

    def replace_children(self, came: DataFrame, checks: list[Check] | tuple[Check, ...] = ()) -> int:
        """All rows of each key that came are the ones that came."""
        return self.replace(came, came, checks)

    def upsert(self, came: DataFrame, order: str, checks: list[Check] | tuple[Check, ...] = ()) -> int:
        """Of the rows of each key, old and new, the one with the largest ``order``; of equal ones that with the largest columns."""

        def merge(old: DataFrame | None) -> DataFrame:
            rows = came if old is None else old.select(*came.columns).unionByName(came)
            rest = [c for c in came.columns if c not in self.key]
            best = rows.groupBy(*self.key).agg(F.max(F.struct(order, F.struct(*rest).alias("r"))).alias("m"))
            return best.select(*self.key, "m.r.*").select(*came.columns)

        return self._changed(came, merge, checks)
