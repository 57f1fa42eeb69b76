"""Series and windows: months, weeks, spans, runs, recent items, as-of values, first and last values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def month(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def monthly(votes: DataFrame, sittings: DataFrame | None = None) -> DataFrame:
    """Votes (on_date, kind, rule, roll_call) by month: votes, decisions, qualified, roll_calls, vote_days and rates.

    ``sittings`` (on_date) adds sittings by number; without any they are null for the whole term.
    """
    decision = F.col("kind") == "decision"
    out = votes.groupBy(month("on_date").alias("month")).agg(
        F.count("*").alias("votes"), F.count_if(decision).alias("decisions"),
        F.count_if(decision & ~F.coalesce(F.col("rule"), F.lit("egyszeru")).isin("egyszeru", "relativ")).alias("qualified"),
        F.count_if("roll_call").alias("roll_calls"), F.count_distinct("on_date").alias("vote_days"),
    )
    if sittings is None:
        out = out.withColumn("sittings", F.lit(None).cast("long"))
    else:
        out = out.join(sittings.groupBy(month("on_date").alias("month")).agg(F.count("*").alias("sittings")), "month", "left")
    return out.withColumns({
        "per_sitting": F.try_divide(F.col("votes").cast("double"), F.col("sittings")),
        "per_vote_day": F.try_divide(F.col("votes").cast("double"), F.col("vote_days")),
    })


def outside_months(rows: DataFrame, day: str, months: DataFrame) -> DataFrame:
    """Rows whose month isn't one of ``months`` (month): those of which a listing has only a part.  Rows without a day stay."""
    return rows.join(F.broadcast(months.select(F.col("month").alias("__month"))), month(day) == F.col("__month"), "left_anti")  # a row a month


def weeks(days: DataFrame) -> DataFrame:
    """ISO weeks of the distinct days (on_date): year, week, days, first and last day."""
    year = F.expr("extract(yearofweek from on_date)").cast("int")
    return days.groupBy(year.alias("iso_year"), F.weekofyear("on_date").alias("iso_week")).agg(
        F.count_distinct("on_date").alias("days"), F.min("on_date").alias("first_day"), F.max("on_date").alias("last_day")
    )


def recent(items: DataFrame, day: str, order: str, least: int = 100, days: int = 5, most: int = 600) -> DataFrame:
    """The newest items: at least ``least`` and all of the newest ``days`` days, ``most`` at most."""
    newest = W.orderBy(F.desc(day), F.desc(order))
    top = items.orderBy(F.desc(day), F.desc(order)).limit(most)  # a top-k: the window sees ``most`` rows
    ranked = top.withColumns({"rn": F.row_number().over(newest), "day_rank": F.dense_rank().over(W.orderBy(F.desc(day)))})
    return ranked.filter((F.col("rn") <= least) | (F.col("day_rank") <= days))


def around(rows: DataFrame, partition: str, order: str, value: str, k: int) -> DataFrame:
    """Each row with previous and next key and the sum of ``value`` over k rows on either side."""
    w = W.partitionBy(partition).orderBy(order)
    return rows.withColumns({
        "previous": F.lag(order).over(w), "next": F.lead(order).over(w), "window_sum": F.sum(value).over(w.rowsBetween(-k, k)),
    })


def first_last(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The first and the last value of each key, by ``order``."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))


def islands(spans: DataFrame, key: str, start: str, end: str, gap: int = 1) -> DataFrame:
    """Spans of a key merged where the next begins at most ``gap`` days after all before have ended."""
    w = W.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = (reach.isNull() | (F.datediff(F.col(start), reach) > gap)).cast("int")
    numbered = spans.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min(start).alias("run_start"), F.max(end).alias("run_end"), F.count("*").alias("spans"))


def latest_run(runs: DataFrame, key: str) -> DataFrame:
    return runs.groupBy(key).agg(F.max_by(F.struct("run_start", "run_end", "spans"), "run").alias("r")).select(key, "r.*")


def as_of(left: DataFrame, right: DataFrame, on: str, when_left: str, when_right: str, value: str, pieces: int = 64) -> DataFrame:
    """The last ``value`` of ``right`` at or before each row of ``left``; before the first one, the first.

    A sorted union and a running last value: no range join, so nothing is multiplied.  Time is cut into ``pieces`` of like numbers of
    rows; a key's pieces run on their own, and begin with what the pieces before ended with, so a key with most rows is no one
    task's.
    """
    kind = dict(right.dtypes)[when_right]
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) if kind == "date" else F.col(c)
    shares = [k / pieces for k in range(1, pieces)]
    cuts = sorted(set(right.agg(F.percentile_approx(number(when_right), shares)).first()[0] or []))  # one row
    cuts = cuts[:: max(1, len(cuts) // pieces)]
    piece = lambda c: sum(((number(c) >= x).cast("int") for x in cuts), F.lit(0))
    first = right.groupBy(on).agg(F.min_by(value, when_right).alias("__first"))
    a = left.withColumns({"__t": F.col(when_left), "__side": F.lit(1), "__v": F.lit(None).cast(dict(right.dtypes)[value])})
    empty = [F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c != on]
    b = right.select(F.col(on), *empty, F.col(when_right).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = W.partitionBy(on, "__piece").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__piece", piece("__t"))
    held = both.withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    ends = right.filter(F.col(value).isNotNull()).groupBy(F.col(on), piece(when_right).alias("__piece")).agg(F.max_by(value, when_right).alias("__end"))
    # each piece a key has rows in carries its end to the next; a key has ``pieces`` at most
    every = held.select(on, "__piece").distinct().join(ends, [on, "__piece"], "full")
    carry = F.last("__end", ignorenulls=True).over(W.partitionBy(on).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1))
    before = every.withColumn("__before", carry).select(on, "__piece", "__before")
    out = held.join(before, [on, "__piece"], "left").join(first, on, "left")
    return out.withColumn(value, F.coalesce("__last", "__before", "__first")).drop("__t", "__piece", "__side", "__v", "__last", "__before", "__end", "__first")


def in_force(days: DataFrame, spans: DataFrame, seats: Column) -> DataFrame:
    """How many spans (start, end; null: open) cover each distinct day (on_date), and the seats that count.

    Starts and ends are summed once by day and accumulated, so no day meets every span.  A number below nine
    tenths of the seats of the era, or above them, is a gap in the records: then the era's seats count.
    """
    moves = spans.select(F.col("start").alias("day"), F.lit(1).alias("move")).unionAll(
        spans.filter("end is not null").select(F.date_add("end", 1), F.lit(-1))
    ).groupBy("day").agg(F.sum("move").alias("move"))
    wanted = days.select(F.col("on_date").alias("day")).distinct()
    every = moves.join(wanted.withColumn("wanted", F.lit(True)), "day", "full_outer")
    total = F.coalesce(F.sum("move").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)), F.lit(0))  # one row a calendar day
    out = every.withColumn("n", total).filter("wanted").select(F.col("day").alias("on_date"), F.col("n").cast("long").alias("n"))
    return out.withColumn("seats", F.when((F.col("n") >= 0.9 * seats) & (F.col("n") <= seats), F.col("n")).otherwise(seats).cast("long"))


def overlaps(spans: DataFrame, terms: DataFrame) -> DataFrame:
    """Spans (start, end; null: open) and the terms (term, began, ended) that they overlap, half open."""
    hit = (F.col("start") < F.col("ended")) & (F.col("end").isNull() | (F.col("end") >= F.col("began")))
    return spans.join(F.broadcast(terms), hit)  # a table of terms has a dozen rows


def changes(rows: DataFrame, key: list[str], start: str, value: str) -> DataFrame:
    """Where the value of a key changes: before, after, began (the start of the row before), since, until (that of the row after).

    Rows are the distinct (start, value) of a key in order; ``until`` is taken over all of them, also those
    whose value is the same.
    """
    seq = rows.select(*key, start, value).distinct()
    w = W.partitionBy(*key).orderBy(start, value)
    seq = seq.withColumns({"before": F.lag(value).over(w), "began": F.lag(start).over(w), "until": F.lead(start, 1).over(w)})
    return seq.filter(F.col("before") != F.col(value)).select(*key, "before", F.col(value).alias("after"), "began", F.col(start).alias("since"), "until")
