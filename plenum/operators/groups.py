"""Groups in roll calls: tallies, plurality, alignment, cohesion, agreement of groups and of members.

Input rows are positions (vote, member, grp, position), one for each member and vote, where position is one of
``yes``, ``no``, ``abstain`` (cast) or anything else (not cast).  Column names are parameters of ``rolls``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAST = ("yes", "no", "abstain")


def rolls(df: DataFrame, vote: str = "vote", member: str = "member", grp: str = "grp", position: str = "position") -> DataFrame:
    """The canonical column names for any table of positions."""
    return df.select(F.col(vote).alias("vote"), F.col(member).alias("member"), F.col(grp).alias("grp"), F.col(position).alias("position"))


def _count(value: str) -> Column:
    return F.count_if(F.col("position") == value).alias(value)


def rice(yes: Column, no: Column) -> Column:
    """|yes - no| / (yes + no); null where nobody took a side."""
    return F.try_divide(F.abs(yes - no).cast("double"), yes + no)


def agreement_index(yes: Column, no: Column, abstain: Column) -> Column:
    """(max - (total - max) / 2) / total of the three cast positions."""
    total, most = yes + no + abstain, F.greatest(yes, no, abstain)
    return F.try_divide(most - (total - most) / 2, total)


def tallies(pos: DataFrame) -> DataFrame:
    """vote, grp, yes, no, abstain, other, n."""
    return pos.groupBy("vote", "grp").agg(
        *[_count(p) for p in CAST], F.count_if(~F.col("position").isin(*CAST)).alias("other"), F.count("*").alias("n")
    )


def plurality(pos: DataFrame) -> DataFrame:
    """Tallies with cast, plurality (null where two positions tie for the most) and majority_share."""
    return _with_plurality(tallies(pos))


def _with_plurality(rows: DataFrame) -> DataFrame:
    most = F.greatest("yes", "no", "abstain")
    tops = sum((F.col(p) == most).cast("int") for p in CAST)
    cast = F.col("yes") + F.col("no") + F.col("abstain")
    which = F.when(F.col("yes") == most, "yes").when(F.col("no") == most, "no").otherwise("abstain")
    return rows.withColumns({
        "cast": cast,
        "plurality": F.when((cast > 0) & (tops == 1), which),
        "majority_share": F.try_divide(most.cast("double"), cast),
    })


def aligned(pos: DataFrame) -> DataFrame:
    """Positions with ``align``: with, against, or null (not cast, or the group has no plurality).

    The group's tallies are summed beside its own rows, so nothing is joined: a group in one vote is a bounded window.
    """
    own = W.partitionBy("vote", "grp")
    rows = pos.withColumns({p: F.sum((F.col("position") == p).cast("int")).over(own) for p in CAST})
    return _with_plurality(rows).drop(*CAST, "cast", "majority_share").withColumn(
        "align",
        F.when(F.col("position").isin(*CAST) & F.col("plurality").isNotNull(), F.when(F.col("position") == F.col("plurality"), "with").otherwise("against")),
    )


def member_alignment(pos: DataFrame) -> DataFrame:
    """For each member and group: in_roll, cast, abstained, absent, with and against the group's plurality."""
    cast = F.col("position").isin(*CAST)
    return aligned(pos).groupBy("member", "grp").agg(
        F.count("*").alias("in_roll"), F.count_if(cast).alias("cast"), F.count_if(F.col("position") == "abstain").alias("abstained"),
        F.count_if(~cast).alias("absent"), F.count_if(F.col("align") == "with").alias("with_group"), F.count_if(F.col("align") == "against").alias("against_group"),
    )


def dissents(pos: DataFrame) -> DataFrame:
    """The positions cast against the plurality of the member's own group."""
    return aligned(pos).filter("align = 'against'").select("vote", "member", "grp", "position", "plurality")


def vote_cohesion(pos: DataFrame) -> DataFrame:
    """Plurality rows with the rice and agreement indices and the number of dissents (0 without a plurality)."""
    y, n, a = (F.col(p) for p in CAST)
    own = F.when(F.col("plurality").isNull(), 0).otherwise(F.col("cast") - F.greatest("yes", "no", "abstain"))
    return plurality(pos).withColumns({"rice": rice(y, n), "ai": agreement_index(y, n, a), "dissent": own})


def cohesion(pos: DataFrame) -> DataFrame:
    """Each group over all votes: the rice index weighted by yes and no, the agreement index by cast votes."""
    rows = vote_cohesion(pos).filter("cast > 0")
    sides = F.col("yes") + F.col("no")
    return rows.groupBy("grp").agg(
        F.count("*").alias("votes"), F.sum("cast").alias("cast"), F.sum("dissent").alias("dissent"),
        F.count_if(F.col("dissent") > 0).alias("votes_with_dissent"),
        F.count_if(F.greatest("yes", "no", "abstain") == F.col("cast")).alias("unanimous"),
        F.try_divide(F.sum(F.col("rice") * sides), F.sum(sides)).alias("rice"),
        F.try_divide(F.sum(F.col("ai") * F.col("cast")), F.sum("cast")).alias("ai"),
    )


def group_pairs(pos: DataFrame) -> DataFrame:
    """a, b, n, same, share over the votes in which both groups have a plurality; the busier group is a."""
    side = plurality(pos)
    weight = side.groupBy("grp").agg(F.sum("cast").alias("volume"))
    side = side.filter("plurality is not null").select("vote", "grp", "plurality").join(F.broadcast(weight), "grp")
    a, b = side.alias("a"), side.alias("b")
    first = (F.col("a.volume") > F.col("b.volume")) | ((F.col("a.volume") == F.col("b.volume")) & (F.col("a.grp") < F.col("b.grp")))
    pairs = a.join(b, (F.col("a.vote") == F.col("b.vote")) & first)
    return pairs.groupBy(F.col("a.grp").alias("a"), F.col("b.grp").alias("b")).agg(
        F.count("*").alias("n"), F.count_if(F.col("a.plurality") == F.col("b.plurality")).alias("same")
    ).withColumn("share", F.col("same") / F.col("n"))


def member_pairs(pos: DataFrame, least: int = 20, tile: int = 1000) -> DataFrame:
    """Pairs of members of one group: shared cast votes, same position, share; ``least`` shared votes at least.

    Two members meet on (group, vote), so the work is the sum of squared group sizes.  A group of more than ``tile`` members is
    dealt to blocks, and each pair of blocks meets on its own, so that no task has all pairs of a large group; pairs are summed
    before they are shuffled.
    """
    cast = pos.filter(F.col("position").isin(*CAST)).select("grp", "vote", "member", "position")
    largest = cast.groupBy("grp", "vote").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-largest // tile)
    own = F.pmod(F.xxhash64("member"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = cast.withColumn("low", own).withColumn("high", every).filter("low <= high").alias("a")
    b = cast.withColumn("high", own).withColumn("low", every).filter("low <= high").alias("b")
    keys = ["grp", "vote", "low", "high"]
    meet = F.lit(True)
    for k in keys:
        meet = meet & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    # blocks are met in one order; within a block the smaller member comes first
    meet = meet & ((F.col("a.low") < F.col("a.high")) & (F.col("a.member") != F.col("b.member")) | (F.col("a.member") < F.col("b.member")))
    both = a.join(b, meet)
    return both.groupBy(F.col("a.grp").alias("grp"), F.least("a.member", "b.member").alias("a"), F.greatest("a.member", "b.member").alias("b")).agg(
        F.count("*").alias("n"), F.count_if(F.col("a.position") == F.col("b.position")).alias("same")
    ).filter(F.col("n") >= least).withColumn("share", F.col("same") / F.col("n"))


def divided(pos: DataFrame, share: float = 0.025, least: int = 2) -> DataFrame:
    """Votes whose smaller side has at least ``least`` votes and ``share`` of yes and no."""
    sides = pos.groupBy("vote").agg(_count("yes"), _count("no"))
    small = F.least("yes", "no")
    return sides.filter((small >= least) & (small >= share * (F.col("yes") + F.col("no"))))
