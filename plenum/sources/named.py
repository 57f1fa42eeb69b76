"""Payload files whose names say what they hold: fields from names, and only the files that a filter leaves are opened."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The names of cached payloads: term, sitting day, number of the speech.
SPEECHES = r"^ckl(\d+)_nap(\d+)_f(\d+)\.xml$"


def named_files(spark: SparkSession, folder: str, pattern: str, fields: Mapping[str, str], glob: str = "*") -> DataFrame:
    """(name, path, *fields, size, at, content) of the files below ``folder`` whose name matches ``pattern``.

    ``fields`` are the pattern's groups in order, with their types.  All but content follow from the file's metadata, and
    Spark drops files by filters on them when it lists the folder; content is read only if it is asked for.
    """
    name = F.col("_metadata.file_name")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    cells = [F.regexp_extract(name, pattern, k).try_cast(kind).alias(field) for k, (field, kind) in enumerate(fields.items(), 1)]
    return rows.filter(name.rlike(pattern)).select(
        name.alias("name"), F.col("_metadata.file_path").alias("path"), *cells, F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at"), "content"
    )


def in_order(rows: DataFrame, *fields: str) -> DataFrame:
    """Files in the order of their fields, then of their names: numbers as numbers, so 9 is before 10."""
    return rows.orderBy(*fields, "name")


def partitioned_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, content, *keys) of a cache laid out as key=value folders; keys are pruned as partitions are."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return rows.drop("modificationTime", "length")
