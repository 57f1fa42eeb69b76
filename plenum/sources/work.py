"""The shared work folder, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is missing, a temporary folder of this machine does if Spark runs in this process (tests); a
    cluster without it is an error, since other folders may be each machine's own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("plenum.work.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="plenum-")
            spark.conf.set("plenum.work.dir", base)
    return f"{base.rstrip('/')}/plenum-{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors then cost one read."""
    path = work_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any store that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/plenum-" in folder:
            delete(df.sparkSession, folder)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint where its known number of rows is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
