"""Files of rows in and out: access logs, JSON lines, CSV, JSON, Parquet with a manifest, Atom entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, also gzipped ones."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_access_log(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Tab-separated log lines whose ``#Fields:`` header names the columns; short lines are dropped.

    Each file is read whole as a row, so its header holds for its own lines; logs are rolled by the hour.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("lines"))
    header = F.element_at(F.filter("lines", lambda x: x.startswith("#Fields:")), 1)
    names = F.split(F.trim(F.substring(header, F.lit(9), F.length(header))), r"\s+")
    rows = files.filter(F.size(F.filter("lines", lambda x: x.startswith("#Fields:"))) > 0).select("file", names.alias("names"), F.explode(F.filter("lines", lambda x: (x != "") & ~x.startswith("#"))).alias("line"))
    rows = rows.withColumn("cells", F.split("line", "\t")).filter(F.size("cells") >= F.size("names"))
    at = lambda f: F.array_position("names", f).cast("int")
    return rows.select("file", *[F.when(at(f) > 0, F.get("cells", at(f) - 1)).alias(f) for f in fields])


def write_csv(df: DataFrame, path: str, columns: list[str], gzip: bool = False) -> None:
    """CSV with a header, empty for null, columns in a fixed order; each file starts with a byte-order mark."""
    marked = df.select(*[F.col(c).cast("string").alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(columns)])
    marked.write.option("header", True).option("nullValue", "").option("emptyValue", "").option("compression", "gzip" if gzip else "none").csv(path)


def to_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def publish(df: DataFrame, path: str, sort: list[str]) -> dict:
    """Parquet sorted for pruning by ``sort``, and the manifest: rows, columns, first and last sort key."""
    df.repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    row = back.agg(F.count("*").alias("n"), F.min(sort[0]).alias("a"), F.max(sort[0]).alias("z")).first()
    return {"rows": row.n, "columns": back.columns, "first": row.a, "last": row.z}


def atom_entry(urn: str, key: Column, title: Column, href: Column, updated: Column, content: Column) -> Column:
    """One Atom entry as text; ids are stable and nothing depends on the clock."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(
        F.lit("<entry><id>urn:"), F.lit(urn), F.lit(":"), escape(key), F.lit("</id><title>"), escape(title), F.lit('</title><link href="'), escape(href),
        F.lit('"/><updated>'), F.date_format(updated, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('</updated><content type="html">'), escape(content), F.lit("</content></entry>"),
    )


def bindings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a SPARQL JSON result: the value of each named binding, null where a row lacks it."""
    cell = T.StructType([T.StructField("value", T.StringType())])
    row = T.StructType([T.StructField(n, cell) for n in names])
    schema = T.StructType([T.StructField("results", T.StructType([T.StructField("bindings", T.ArrayType(row))]))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("results.bindings").alias("ord", "b"))
    return rows.select("ord", *[F.col(f"b.{n}.value").alias(n) for n in names])
