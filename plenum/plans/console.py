"""The SQL console: views over published tables, any SQL, a capped display and what chart a result suits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Register every table of ``folder`` as a view of its name."""
    for name in names or TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """The result of ``sql``; if a view is missing, all are registered again and it is tried once more."""
    try:
        return spark.sql(sql)
    except AnalysisException as e:
        if "TABLE_OR_VIEW_NOT_FOUND" not in str(e):
            raise
        views(spark, folder)
        return spark.sql(sql)


def display(df: DataFrame, rows: int = 500) -> tuple[list, int]:
    """The first rows, and the true number of rows."""
    return df.limit(rows).collect(), df.count()


@dataclass
class Shape:
    """The label column, the value columns, and whether the labels are an ordered axis."""

    label: str | None
    values: list[str]
    ordered: bool


def shape(df: DataFrame) -> Shape:
    """What a chart of ``df`` would show, from its types alone."""
    numeric = [c for c, t in df.dtypes if t.startswith(("int", "bigint", "smallint", "tinyint", "double", "float", "decimal"))]
    labels = [c for c, _ in df.dtypes if c not in numeric]
    label = labels[0] if labels else (numeric[0] if len(numeric) > 1 else None)
    kinds = dict(df.dtypes)
    ordered = label is not None and (kinds[label] in ("date", "timestamp") or label in numeric)
    return Shape(label, [c for c in numeric if c != label], ordered)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop the jobs that were started under ``spark.addTag(tag)``."""
    spark.interruptTag(tag)
