"""What pages say about the House, from votes, motions, speeches and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenum.operators import decisions, groups, series
from plenum.operators.floor import substantive
from plenum.operators.textual import bounded, dealt

#: A strip of a day's votes has so many at most.
STRIP = 160


def first_motions(motions: DataFrame) -> DataFrame:
    """The first motion of each vote by its place ``motion``, with all columns; a minimum, so no vote's motions are gathered."""
    rest = [c for c in motions.columns if c != "vote"]
    first = motions.groupBy("vote").agg(F.min_by(F.struct(*rest), F.struct("motion", *[c for c in rest if c != "motion"])).alias("m"))
    return first.select("vote", "m.*")


def with_motions(votes: DataFrame, motions: DataFrame) -> DataFrame:
    """Votes with their first motion; a vote without any has nulls, one with several isn't repeated."""
    return votes.join(first_motions(motions), "vote", "left")


def sitting_of(rows: DataFrame, sittings: DataFrame, day: str = "on_date") -> DataFrame:
    """``rows`` with the number of the sitting of their day: of several numbers of a day the smallest, null without any."""
    one = sittings.groupBy(F.col("day").alias(day)).agg(F.min("sitting").alias("sitting"))
    return rows.join(one, day, "left")


def stubs(positions: DataFrame, members: DataFrame, id_col: str = "member", name_col: str = "name") -> DataFrame:
    """Members (id, name) who have voted and aren't listed, each once, with the least of the names they were called."""
    return positions.filter(F.col(id_col).isNotNull()).join(members.select(id_col), id_col, "left_anti").groupBy(id_col).agg(F.min(name_col).alias(name_col))


def with_stubs(members: DataFrame, positions: DataFrame, id_col: str = "member", name_col: str = "name") -> DataFrame:
    """The list of members and, marked, those who only appear in positions."""
    more = stubs(positions, members, id_col, name_col).withColumn("stub", F.lit(True))
    return members.withColumn("stub", F.lit(False)).unionByName(more, allowMissingColumns=True)


def in_month(rows: DataFrame, day: str, month: str) -> DataFrame:
    """Rows of one month, given as 'YYYY-MM'; a range of days, so that files can be skipped."""
    first = F.to_date(F.lit(month + "-01"))
    return rows.filter((F.col(day) >= first) & (F.col(day) < F.add_months(first, 1)))


def day_strips(votes: DataFrame, most: int = STRIP) -> DataFrame:
    """(vote, on_date, place, of, first, last, previous, next): each vote's neighbours on its day, in order, and the strip around it.

    A day of ``most`` votes or fewer is one strip; on a longer day the strip is the ``most`` places around the vote, moved inwards
    at the ends of the day.
    """
    w = W.partitionBy("on_date").orderBy("vote")
    rows = votes.select(
        "vote", "on_date", F.row_number().over(w).alias("place"), F.count("*").over(W.partitionBy("on_date")).alias("of"), F.lag("vote").over(w).alias("previous"), F.lead("vote").over(w).alias("next")
    )
    first = F.greatest(F.lit(1), F.least(F.col("place") - most // 2, F.col("of") - most + 1))
    return rows.withColumn("first", first.cast("int")).withColumn("last", F.least(F.col("of"), F.col("first") + most - 1).cast("int"))


def group_months(positions: DataFrame, votes: DataFrame) -> DataFrame:
    """(month, grp, cast, in_roll, participation, dissent, ai): groups month by month; a month without positions has a row without group.

    ``dissent`` is the share of votes cast against the own group's plurality; ``ai`` the agreement weighted by votes cast.
    """
    per = groups.vote_cohesion(positions).join(votes.select("vote", "on_date"), "vote")
    out = per.groupBy(series.month("on_date").alias("month"), "grp").agg(
        F.sum("cast").alias("cast"), F.sum("n").alias("in_roll"), F.try_divide(F.sum("cast"), F.sum("n")).alias("participation"),
        F.try_divide(F.sum("dissent"), F.sum("cast")).alias("dissent"), F.try_divide(F.sum(F.col("ai") * F.col("cast")), F.sum("cast")).alias("ai"),
    )
    months = votes.select(series.month("on_date").alias("month")).distinct()
    return months.join(out, "month", "left")


def group_floor_shares(speeches: DataFrame, seats: DataFrame, members: str = "members") -> DataFrame:
    """(year, grp, seconds, share_of_time, share_of_house, ratio, unattributed): of each year the groups' share of the attributed time.

    ``seats`` (grp, members) is the house; time of speeches without group is the year's ``unattributed``.
    """
    rows = substantive(speeches).groupBy(F.year("day").alias("year"), "grp").agg(F.sum("seconds").alias("seconds"))
    year = W.partitionBy("year")  # a row a group
    whole = F.sum(F.when(F.col("grp").isNotNull(), F.col("seconds"))).over(year)
    rows = rows.withColumns({"whole": whole, "unattributed": F.coalesce(F.sum(F.when(F.col("grp").isNull(), F.col("seconds"))).over(year), F.lit(0))}).filter("grp is not null")
    house = seats.crossJoin(F.broadcast(seats.agg(F.sum(members).alias("all_members")))).select("grp", (F.col(members) / F.col("all_members")).alias("share_of_house"))  # one row
    both = rows.join(F.broadcast(house), "grp", "left").withColumn("share_of_time", F.try_divide("seconds", "whole"))  # groups
    return both.select("year", "grp", "seconds", "share_of_time", "share_of_house", F.try_divide("share_of_time", "share_of_house").alias("ratio"), "unattributed")


def speaking_by_group(speeches: DataFrame) -> DataFrame:
    """(grp, seconds, substantive, speeches, reprints_skipped): reprints count for nothing but their number, technical speeches only in ``seconds``."""
    own = ~F.col("reprint")
    return speeches.groupBy("grp").agg(
        F.coalesce(F.sum(F.when(own, F.col("seconds"))), F.lit(0)).alias("seconds"), F.coalesce(F.sum(F.when(own & ~F.col("technical"), F.col("seconds"))), F.lit(0)).alias("substantive"),
        F.count_if(own & ~F.col("technical")).alias("speeches"), F.count_if("reprint").alias("reprints_skipped"),
    )


def week_alignments(positions: DataFrame, votes: DataFrame) -> DataFrame:
    """(iso_year, iso_week, member, in_roll, cast, against): a member's weeks; their sums are the term's."""
    tally = groups.plurality(positions).select("vote", "grp", "plurality")
    rows = positions.join(tally, ["vote", "grp"]).join(votes.select("vote", "on_date"), "vote")
    cast = F.col("position") != "absent"
    return rows.groupBy(F.expr("extract(yearofweek from on_date)").cast("int").alias("iso_year"), F.weekofyear("on_date").alias("iso_week"), "member").agg(
        F.count("*").alias("in_roll"), F.count_if(cast).alias("cast"), F.count_if(cast & (F.col("plurality") != F.col("position"))).alias("against")
    )


def last_week(days: DataFrame, until: Column) -> DataFrame:
    """One row (first_day, last_day): Monday and Sunday of the last week with a sitting day up to ``until``."""
    last = days.filter(F.col("day") <= until).agg(F.max("day").alias("day"))
    monday = F.date_sub("day", F.weekday("day"))
    return last.filter("day is not null").select(monday.alias("first_day"), F.date_add(monday, 6).alias("last_day"))


def press_week(votes: DataFrame, positions: DataFrame, until: Column) -> DataFrame:
    """One row on the last sitting week: first_day, last_day, votes, decisions, qualified (decisions by more than a simple majority), sunk
    (of those, with more yes than no and not enough), dissents (cast against the own group), dissenters."""
    week = last_week(votes.select(F.col("on_date").alias("day")), until)
    mine = votes.join(F.broadcast(week), F.col("on_date").between(F.col("first_day"), F.col("last_day")))  # one row
    ruled = decisions.verdicts(mine)
    decided = F.col("kind") == "decision"
    qualified = decided & ~F.col("rule").isin("egyszeru", "relativ")
    counts = ruled.groupBy("first_day", "last_day").agg(
        F.count("*").alias("votes"), F.count_if(decided).alias("decisions"), F.count_if(qualified).alias("qualified"), F.count_if(qualified & ~F.col("passed") & (F.col("yes") > F.col("no"))).alias("sunk")
    )
    against = groups.dissents(positions.join(mine.filter(decided).select("vote"), "vote", "left_semi"))
    both = against.agg(F.count("*").alias("dissents"), F.count_distinct("member").alias("dissenters"))
    return counts.crossJoin(F.broadcast(both))  # one row


def exchanges(events: DataFrame, speeches: DataFrame) -> DataFrame:
    """(bill, turn, sitting, seq, label, text): the turns of a bill that have a text, in the order of the transcript.

    ``events`` are (bill, label, sitting, seq); neither the event's date nor its label orders them.  A reprinted speech counts once.
    """
    held = speeches.filter(F.coalesce(F.col("text"), F.lit("")) != "").groupBy("sitting", "seq").agg(F.min("text").alias("text"))
    rows = events.filter("sitting is not null and seq is not null").dropDuplicates(["bill", "label", "sitting", "seq"])
    rows = rows.join(bounded(held.select("sitting", "seq")), ["sitting", "seq"], "left_semi")
    w = W.partitionBy("bill").orderBy("sitting", "seq", "label")  # a bill has some turns; they are sorted without their texts
    turns = dealt(rows, events.count(), "bill").withColumn("turn", F.row_number().over(w))
    return turns.join(held, ["sitting", "seq"]).select("bill", "turn", "sitting", "seq", "label", "text")


def hero(votes: DataFrame) -> DataFrame:
    """One vote to show: the last passed decision by two thirds of all members with a roll call, else the last roll call."""
    ruled = decisions.verdicts(votes).filter("roll_call")
    best = (F.col("rule") == "ketharmad_osszes") & F.coalesce(F.col("passed"), F.lit(False)) & (F.col("kind") == "decision")
    return ruled.orderBy(F.desc(best), F.desc("on_date"), F.desc("vote")).limit(1)


def directory(rows: DataFrame, key: Column, shown: int = 100) -> DataFrame:
    """``rows`` with ``inline``: whether a long list shows them at once: the ``shown`` first by ``key``.

    The border is found by a top-k, so no task sorts the whole list; equal keys at the border are all shown.
    """
    keyed = rows.withColumn("__key", key)
    border = keyed.select("__key").orderBy(F.col("__key")).limit(shown).agg(F.max("__key").alias("__border"))
    return keyed.crossJoin(F.broadcast(border)).withColumn("inline", F.col("__key") <= F.col("__border")).drop("__key", "__border")  # one row


def alignment(positions: DataFrame, votes: DataFrame, checks: bool = True) -> DataFrame:
    """Members' alignment, with quorum checks counted like other votes, or (not ``checks``) only in the roll."""
    if checks:
        return groups.member_alignment(positions)
    kinds = votes.select("vote", (F.col("kind") == "quorum").alias("check"))
    rows = positions.join(kinds, "vote", "left").withColumn("check", F.coalesce("check", F.lit(False)))
    decided = groups.member_alignment(rows.filter("not check").drop("check"))
    roll = rows.groupBy("member", "grp").agg(F.count("*").alias("all_rolls"))
    return roll.join(decided, ["member", "grp"], "left").select(
        "member", "grp", F.col("all_rolls").alias("in_roll"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cast", "abstained", "absent", "with_group", "against_group")]
    )
