"""Incremental processing with Structured Streaming: daily counts, deduplication, upsert, change capture, late answers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plenum.sources.versions import Versions

#: An empty answer is asked for again for so long, and a row may come so late.
LATE = "45 days"


def read_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_counts(rows: DataFrame, ts: str, kind: str, late: str = LATE) -> DataFrame:
    """Rows by day and kind: a day is final once the watermark has passed it."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), kind, "n")


def sessions(rows: DataFrame, ts: str, key: str, gap: str, late: str = LATE) -> DataFrame:
    """Runs of a key's rows with less than ``gap`` between them."""
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(rows: DataFrame, ts: str, key: list[str], late: str = LATE) -> DataFrame:
    """The first of the rows with the same key inside the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def newest(target: DataFrame | None, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """Upsert: of the rows with the same key the one with the largest ``order``."""
    rows = batch if target is None else target.unionByName(batch)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct(order, F.struct(*rest).alias("r"))).alias("m")).select(*key, "m.r.*")


def changed(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Change capture: keys whose content's sha256 moved, with both digests; the same content gives no change."""
    a = old.select(F.col(key).alias("key"), F.sha2(F.col(content), 256).alias("was"))
    b = new.select(F.col(key).alias("key"), F.sha2(F.col(content), 256).alias("now"))
    return a.join(b, "key").filter("was <> now")


def upsert_sink(spark: SparkSession, path: str, key: list[str], order: str, buckets: int = 64):
    """A ``foreachBatch`` function: a batch rewrites the buckets its keys are in, and a repeated batch changes nothing."""
    table = Versions(spark, path, key, buckets)

    def write(batch: DataFrame, version: int) -> None:
        table.upsert(batch, order)

    return write


def ask_again(answers: DataFrame, days: int = 45) -> DataFrame:
    """(day, asked, final) of a stream of (day date, at timestamp, rows long): state remembers how often a day's
    list was empty; it is final once it has rows or ``days`` have gone by."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, final = state.get if state.exists else (0, False)
        for pdf in frames:
            asked += len(pdf)
            age = (pdf["at"].max().date() - key[0]).days
            final = bool(final or (pdf["rows"] > 0).any() or age > days)
        state.update((asked, final))
        yield pd.DataFrame({"day": [key[0]], "asked": [asked], "final": [final]})

    return answers.groupBy("day").applyInPandasWithState(step, "day date, asked long, final boolean", "asked long, final boolean", "update", GroupStateTimeout.NoTimeout)
