"""Parquet files as they are published, and the manifest that says what is in them, from their footers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_ROWS = 200_000


def write_groups(df: DataFrame, path: str, sort: list[str], files: int | None = None, group_rows: int = GROUP_ROWS, level: int = 9) -> None:
    """``df`` sorted by ``sort`` into files of row groups of ``group_rows`` rows, so that readers can skip groups."""
    rows = df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)
    out = rows.sortWithinPartitions(*sort).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level)
    out.option("parquet.block.row.count.limit", group_rows).option("maxRecordsPerFile", 50 * group_rows).parquet(path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, footer): the last part of each file, with its footer.  Files are cut to it before they leave the JVM."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path)
    # the footer's size: four bytes, the lowest first
    size = F.expr("conv(concat_ws('', reverse(regexp_extract_all(hex(substring(content, -8, 4)), '..', 0))), 16, 10)").cast("int")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), size.alias("n"), "content")
    return rows.select("file", "bytes", F.expr("substring(content, -(n + 8), n + 8)").alias("footer"))


MANIFEST = "file string, bytes long, rows long, row_groups int, largest_group long, columns array<string>, codec string, first string, last string, created_by string"


def manifest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One row a file: bytes, rows, row groups, columns, codec and the span of ``key``, as the footers have them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, size, footer in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                meta = pq.read_metadata(pa.BufferReader(b"PAR1" + footer))
                names = meta.schema.to_arrow_schema().names
                groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                chunks = [g.column(k) for g in groups for k in range(g.num_columns)]
                spans = [c.statistics for c in chunks if c.path_in_schema == key and c.statistics is not None and c.statistics.has_min_max]
                first, last = (min(s.min for s in spans), max(s.max for s in spans)) if spans else (None, None)
                codecs = sorted({c.compression for c in chunks})
                rows.append((file, size, meta.num_rows, len(groups), max((g.num_rows for g in groups), default=0), names, ",".join(codecs), None if first is None else str(first), None if last is None else str(last), meta.created_by))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), *[pa.string()] * 4]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.strip().split()[0] for x in MANIFEST.split(", ")])

    return footers(spark, path).mapInArrow(read, MANIFEST)


def summary(files: DataFrame, numeric: bool = True) -> DataFrame:
    """One row for a table: files, bytes, rows, row groups, largest group, and the span of the key over all files."""
    as_is = (lambda c: F.col(c).cast("double")) if numeric else F.col
    return files.agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.sum("row_groups").alias("row_groups"), F.max("largest_group").alias("largest_group"),
        F.min(as_is("first")).alias("first"), F.max(as_is("last")).alias("last"),
    )
