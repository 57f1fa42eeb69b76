r"""Exact dedup by a tree merge of sorted digest runs, in DataFrame operations only.

Texts are equal when they are identical after deleting every character of ``[\x20\x09-\x0D]``.
Each row becomes one entry (digest, witness, id, 1); the witness is the length and a second hash of the normalised text.

1. Rows are dealt to ranges of digests (``bucket``), and the rows of a bucket to runs of ``RUN`` rows at most, on average,
   whatever their digest.  A run is one sorted array.  A bucket has as many rounds as its runs need: one or none as a rule, and
   more only where a digest has many rows, which are then spread over all runs of its bucket.
2. In each round ``FAN`` runs of a bucket are sent to the first of them and merged: their arrays, each sorted,
   are merged into one sorted array, and neighbours with the same digest and the same witness become one entry, with the
   first identifier and the sum of the rows.  A bucket that is one run takes no part in further rounds; it has about ``RANGE``
   digests, so no array grows with the corpus.
3. What became of groups of several rows goes back by the same tree: to the ``FAN`` runs that were merged, round by
   round, and at last to the rows of each run.  Nothing ever joins on the digest alone.

Cases: null texts count as empty, and all empty texts are equal.  A null doc_id sorts after all others.
Rows that repeat a doc_id with an equal text are one document given twice: both get the same verdict and
``keep_rows`` retains one of them.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, documents, small

#: Deleted before texts are compared (fixed by the contract).
BLANKS = "[\\x20\\x09-\\x0D]"
#: What equal texts share; the last two are the witness.
KEY = ["digest", "n_plain", "witness"]
#: Rows of a run, runs that are merged in a round, and digests of a bucket.
RUN, FAN, RANGE = 4096, 8, 32_768
#: What a group retains: the identifier that stays (most code points, then a doc_id, then the smallest).
BEST = ["less_points", "no_id", "id"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, code points of the original, digest and witness of the normalised text, and its number."""
    plain = documents(docs, id_col, text_col).select(
        "doc_id", F.length("text").alias("n_points"), F.regexp_replace("text", BLANKS, "").alias("plain")
    )
    return plain.select(
        "doc_id",
        "n_points",
        F.unhex(F.sha2("plain", 256)).alias("digest"),
        F.octet_length("plain").alias("n_plain"),
        F.xxhash64("plain").alias("witness"),
        F.monotonically_increasing_id().alias("number"),
    )


def _dealt(entries: DataFrame) -> tuple[DataFrame, int]:
    """``entries`` (written, so their numbers hold) with bucket, the rounds that make one run of it, and run; the most rounds."""
    n = entries.count()
    buckets = max(1, -(-n // RANGE))
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    placed = entries.withColumn("bucket", F.shiftright(first * F.lit(buckets), 32).cast("int"))
    needed = F.greatest(F.lit(0), F.ceil(F.log(F.count("*") / RUN) / math.log(FAN))).cast("int")
    sizes = cut(placed.groupBy("bucket").agg(needed.alias("rounds")), "buckets")
    run = F.pmod(F.xxhash64("number"), F.pow(F.lit(float(FAN)), "rounds").cast("long"))
    return placed.join(small(sizes, buckets), "bucket").withColumn("run", run), sizes.agg(F.max("rounds").alias("most")).first().most or 0


def _merged(entries: Column) -> Column:
    """A sorted array of entries in which neighbours with the same key are one, the first."""
    size = F.size(entries)
    at = F.sequence(F.lit(0), size - 1)
    differs = lambda i: (i == 0) | (F.struct(*[F.get(entries, i)[c] for c in KEY]) != F.struct(*[F.get(entries, i - 1)[c] for c in KEY]))
    heads = F.filter(at, differs)

    def group(heads: Column) -> Column:
        def one(head: Column, k: Column) -> Column:
            n = F.coalesce(F.get(heads, k + 1), size) - head
            rows = F.aggregate(F.slice(entries, head + 1, n), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
            return F.struct(*[F.get(entries, head)[c].alias(c) for c in (*KEY, *BEST)], rows.alias("n"))

        return F.transform(heads, one)

    return F.element_at(F.transform(F.array(heads), group), 1)


def merge_runs(dealt: DataFrame, rounds: int) -> list[DataFrame]:
    """(bucket, rounds, run, entries): the sorted runs of each level, the first runs first.

    Level k has the buckets of at least k rounds; those of k rounds are one run there.
    """
    best = [(-F.col("n_points")).alias("less_points"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")]
    entry = F.struct(*KEY, *best, F.lit(1).cast("long").alias("n"))
    runs = dealt.groupBy("bucket", "rounds", "run").agg(F.sort_array(F.collect_list(entry)).alias("sorted"))
    levels = []
    for k in range(rounds + 1):
        levels.append(cut(runs.select("bucket", "rounds", "run", _merged(F.col("sorted")).alias("entries")), "runs"))
        to = F.floor(F.col("run") / FAN).alias("run")
        # sorting an array made of sorted ones merges them: it finds the ascending runs and merges neighbours
        runs = levels[-1].filter(F.col("rounds") > k).groupBy("bucket", "rounds", to).agg(F.sort_array(F.flatten(F.collect_list("entries"))).alias("sorted"))
    return levels


def verdicts(entries: DataFrame) -> DataFrame:
    """``entries`` with keep_id, group_size and stays."""
    dealt, rounds = _dealt(entries)
    levels = merge_runs(dealt, rounds)
    place = ["bucket", "run", *KEY]
    told = None
    for k in range(rounds, -1, -1):
        done = levels[k].filter(F.col("rounds") == k).select("bucket", "run", F.inline(F.filter("entries", lambda x: x["n"] > 1)))
        own = levels[k].filter(F.col("rounds") > k)
        own = own.select("bucket", F.col("run").alias("to"), F.floor(F.col("run") / FAN).alias("run"), F.inline(F.transform("entries", lambda x: F.struct(*[x[c].alias(c) for c in KEY]))))
        told = done if told is None else own.join(told, place).select("bucket", F.col("to").alias("run"), *KEY, *BEST, "n").unionByName(done)
    found = dealt.join(told, place, "left")
    alone = F.col("n").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("n_points") == -F.col("less_points")))
    return found.select(
        "doc_id", "n_points", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("stays"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs``.

    Of equal texts the row with the most code points in the original, then the smallest doc_id, stays.
    """
    found = verdicts(cut(digests(docs, id_col, text_col), "digests"))
    return found.select("doc_id", "keep_id", "group_size", F.col("stays").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and one row of each group of equal texts."""
    row = ["doc_id", "n_points", "digest"]
    found = verdicts(cut(digests(docs, id_col, text_col), "digests")).filter("group_size > 1")
    marked = found.groupBy(*row).agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
    marked = cut(marked.filter(~F.col("stays") | (F.col("n") > 1)), "marked")
    out, twice = marked.filter(~F.col("stays")), marked.filter("stays")
    n_out, n_twice = out.count(), twice.count()
    whole = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    named = docs.select(  # all columns in one, so no name of theirs can clash
        F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.length(whole).alias("points"),
        F.unhex(F.sha2(F.regexp_replace(whole, BLANKS, ""), 256)).alias("hash"),
    )

    def keyed(df: DataFrame, n: int) -> tuple[DataFrame, Column]:
        same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(("id", "points", "hash"), row, strict=True)]
        return small(df.select(*row), n), same[0] & same[1] & same[2]

    kept = named.join(*keyed(out, n_out), "left_anti") if n_out else named
    if n_twice:
        side = keyed(twice, n_twice)
        once = kept.join(*side, "left_semi").dropDuplicates(["id", "points", "hash"])
        kept = kept.join(*side, "left_anti").unionByName(once)
    return kept.select("row.*")
