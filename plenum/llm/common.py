"""What the corpus operators share: the work folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many rows of a few numbers each (about 16 bytes a row).
BROADCAST_ROWS = 1_000_000


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is missing and Spark runs in this process (tests) is it a temporary
    folder of this machine; a cluster without it is an error, since other folders may be each machine's own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
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


def remove(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/plenum-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint where its known number of rows is within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """(doc_id long, text string), and position long from ``place_col``: null texts are empty, other columns are left out."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *([] if place_col is None else [F.col(f"`{place_col}`").cast("long").alias("position")]),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
