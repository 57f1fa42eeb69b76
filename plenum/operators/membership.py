"""Who belongs to what on a day: pairs of days and spans, the composition of the house, rosters of committees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spans and days meet in buckets of so many days.
WIDTH = 32
#: The last day of an open span, as a number.
OPEN = 100_000_000


def on_days(days: DataFrame, spans: DataFrame, day: str = "day", since: str = "since", until: str = "until", width: int = WIDTH) -> DataFrame:
    """Each row of ``spans`` with each of ``days`` in [since, until]: the columns of both; no day is given twice.

    A null ``until`` is an open span, a null ``since`` has none.  A span is cut into buckets of ``width`` days, as far as there are days,
    and meets the days of a bucket there, so that neither side is broadcast; adaptive execution splits a bucket with very many spans.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    bucket = lambda c: F.floor(number(c) / width).cast("int")
    these = days.filter(F.col(day).isNotNull()).dropDuplicates([day]).withColumn("__bucket", bucket(F.col(day)))
    ends = these.agg(F.min(day).alias("__first"), F.max(day).alias("__last"))
    rows = spans.crossJoin(F.broadcast(ends))  # one row
    start, stop = F.greatest(F.col(since), F.col("__first")), F.least(F.coalesce(F.col(until), F.col("__last")), F.col("__last"))
    rows = rows.filter(F.col(since).isNotNull() & (start <= stop))
    rows = rows.withColumn("__bucket", F.explode(F.sequence(bucket(start), bucket(stop)))).drop("__first", "__last")
    met = rows.join(these, "__bucket")
    inside = (F.col(day) >= F.col(since)) & (F.col(until).isNull() | (F.col(day) <= F.col(until)))
    return met.filter(inside).drop("__bucket")


def composition(days: DataFrame, mandates: DataFrame, memberships: DataFrame, alone: str = "independent") -> DataFrame:
    """(day, grp, members): how many members of each group sit on each day.

    ``mandates`` (member, since, until) say who sits, ``memberships`` (member, grp, since, until) for which group; both ends belong to a
    span.  A mandate without a group that day is ``alone``; of several groups on a day the one that began last counts, then the
    first by name.  A member's time is cut where a span begins or ends, and the house is a running sum of what begins and ends, so
    rows are as many as spans, not members times days.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    held = lambda rows, *keys: rows.filter("since is not null and (until is null or since <= until)").groupBy(
        *keys, number(F.col("since")).alias("low")
    ).agg(F.max(F.coalesce(number(F.col("until")), F.lit(OPEN))).alias("high"))
    sits, of = held(mandates.select("member", "since", "until"), "member"), held(memberships.select("member", "grp", "since", "until"), "member", "grp")
    # pieces of a member's time in which nothing begins or ends; how many mandates hold is a running sum
    edge = lambda rows, at, by: rows.select("member", at.alias("low"), F.lit(by).alias("by"))
    low, after = F.col("low"), F.col("high") + 1
    edges = edge(sits, low, 1).unionByName(edge(sits, after, -1)).unionByName(edge(of, low, 0)).unionByName(edge(of, after, 0))
    own = W.partitionBy("member").orderBy("low")
    pieces = edges.groupBy("member", "low").agg(F.sum("by").alias("by")).select("member", "low", F.lead("low").over(own).alias("next"), F.sum("by").over(own).alias("sits"))
    pieces = pieces.filter("sits > 0")
    a, m = pieces.alias("a"), of.alias("m")
    inside = (F.col("a.member") == F.col("m.member")) & (F.col("a.low") >= F.col("m.low")) & (F.col("a.low") <= F.col("m.high"))
    met = a.join(m, inside, "left").groupBy(F.col("a.member"), F.col("a.low"), F.col("a.next")).agg(F.min_by(F.col("m.grp"), F.struct(-F.col("m.low"), F.col("m.grp"))).alias("grp"))
    group = F.coalesce("grp", F.lit(alone)).alias("grp")
    steps = met.select(group, F.col("low").alias("at"), F.lit(1).alias("by")).unionByName(met.select(group, F.col("next").alias("at"), F.lit(-1).alias("by")))
    steps = steps.groupBy("grp", "at").agg(F.sum("by").alias("by"))  # a row a group and day, however many members
    asked = days.select("day").filter("day is not null").distinct()
    shown = steps.select("grp").distinct().crossJoin(asked).select("grp", number(F.col("day")).alias("at"), F.lit(0).alias("by"), "day")
    every = steps.withColumn("day", F.lit(None).cast(asked.schema["day"].dataType)).unionByName(shown)
    total = F.sum("by").over(W.partitionBy("grp").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow))
    return every.select("day", "grp", total.alias("members")).filter("day is not null and members > 0")


def in_span(on: Column, since: str = "since", until: str = "until") -> Column:
    return (F.col(since) <= on) & (F.col(until).isNull() | (F.col(until) >= on))


def rosters(memberships: DataFrame, committees: DataFrame, on: Column, chairs: tuple[str, ...] = ("elnök", "társelnök")) -> DataFrame:
    """(committee, name, parent, listed, members, former, chair): one row a committee that is listed or that anyone sat on.

    ``memberships`` (member, committee, role, since, until) are the members' own records, ``committees`` (committee, name, parent) the
    list.  ``members`` sit on it on the day ``on``, ``former`` did before and don't now; the chair is who sits in the first of the roles
    ``chairs`` that anyone has, longest first.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in chairs]), F.lower("role"))
    rows = memberships.filter("committee is not null and member is not null").withColumns({"now": in_span(on), "began": F.col("since") <= on, "rank": rank})
    one = rows.groupBy("committee", "member").agg(
        F.max("now").alias("now"), F.max("began").alias("began"), F.min(F.when(F.col("now") & (F.col("rank") > 0), F.struct("rank", "since", "member"))).alias("lead"),
    )
    each = one.groupBy("committee").agg(
        F.count_if("now").alias("members"), F.count_if(F.coalesce("began", F.lit(False)) & ~F.coalesce("now", F.lit(False))).alias("former"), F.min("lead").alias("lead"),
    )
    listed = committees.select("committee", "name", "parent").withColumn("listed", F.lit(True))
    none = lambda c: F.coalesce(c, F.lit(0))
    return each.join(listed, "committee", "full").select(
        "committee", "name", "parent", F.coalesce("listed", F.lit(False)).alias("listed"), none("members").alias("members"), none("former").alias("former"), F.col("lead.member").alias("chair")
    )


def under_parents(rosters: DataFrame) -> DataFrame:
    """Rosters in the order in which they are listed: a committee, then its own subcommittees, each by name."""
    top = F.coalesce("parent", "committee")
    names = rosters.select(F.col("committee").alias("__top"), F.col("name").alias("__top_name"))
    rows = rosters.withColumn("__top", top).join(names, "__top", "left")
    return rows.orderBy(F.coalesce("__top_name", F.col("__top").cast("string")), "__top", F.col("parent").isNotNull(), "name", "committee").drop("__top", "__top_name")
