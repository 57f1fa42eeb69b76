"""Decisions: verdicts, close votes, motions sunk by their threshold, and what absences could have changed.

Votes are rows (vote, kind, rule, yes, no, abstain, present, seats, recorded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions import rules
from plenum.operators import groups

QUALIFIED = [r for r in rules.RULES if r not in ("egyszeru", "relativ")]


def verdicts(votes: DataFrame) -> DataFrame:
    """base, needed, margin, passed, present_assumed, and whether the recorded result agrees."""
    present = rules.present_or_cast(F.col("present"), F.col("yes"), F.col("no"), F.col("abstain"))
    v = rules.verdict(F.col("rule"), F.col("yes"), present, F.col("seats"))
    return votes.withColumns(v).withColumns({
        "present_assumed": F.col("present").isNull(), "agrees": rules.agrees(F.col("passed"), F.col("recorded")),
    })


def what_if(votes: DataFrame) -> DataFrame:
    """Every rule but the plurality among candidates against each tally."""
    every = F.explode(F.array(*[F.lit(r) for r in rules.RULES if r != "relativ"]))
    return verdicts(votes.drop("rule").withColumn("rule", every))


def close(votes: DataFrame) -> DataFrame:
    """Decisions with a verdict, the closest first: rank by the distance from the threshold, then by vote."""
    known = verdicts(votes).filter("kind = 'decision' and needed is not null and passed is not null")
    return known.withColumn("distance", F.abs("margin")).orderBy("distance", "vote")


def list_verdicts(votes: DataFrame, listed: str) -> DataFrame:
    """Verdicts of decisions from the numbers of a listing alone: ``listed``, the votes cast, stands for those present."""
    return verdicts(votes.filter("kind = 'decision' and yes is not null").withColumn("present", F.col(listed))).withColumn("present_basis", F.lit("list"))


def sunk(votes: DataFrame) -> DataFrame:
    """Decisions under a qualified rule with more yes than no that failed."""
    return verdicts(votes).filter(F.col("rule").isin(*QUALIFIED) & ~F.col("passed") & (F.col("yes") > F.col("no")) & (F.col("kind") == "decision"))


def counterfactual(votes: DataFrame, pos: DataFrame) -> DataFrame:
    """Would the result have flipped had each member who didn't cast followed the group's plurality?

    A rule on those present counts these members as present too; other bases stay.
    """
    idle = pos.filter(~F.col("position").isin(*groups.CAST)).groupBy("vote", "grp").agg(F.count("*").alias("idle"))
    side = groups.plurality(pos).filter("plurality is not null").select("vote", "grp", "plurality")
    extra = idle.join(side, ["vote", "grp"]).groupBy("vote").agg(
        F.sum("idle").alias("extra_present"), F.sum(F.when(F.col("plurality") == "yes", F.col("idle")).otherwise(0)).alias("extra_yes")
    )
    base = verdicts(votes).filter("kind = 'decision' and passed is not null").join(extra, "vote", "left").fillna(0, ["extra_present", "extra_yes"])
    on_present = F.col("rule").isin(*[r for r, k in rules.RULES.items() if k == "present"])
    n = F.col("base") + F.when(on_present, F.col("extra_present")).otherwise(0)
    hypo = F.col("yes") + F.col("extra_yes")
    need = rules.needed(F.col("rule"), n)
    return base.withColumns({"hypo_yes": hypo, "hypo_needed": need, "hypo_passed": (n > 0) & (hypo >= need)}).withColumn("flip", F.col("hypo_passed") != F.col("passed"))


def unanimous(votes: DataFrame, least: int = 190) -> DataFrame:
    """Roll calls in which ``least`` or more voted yes and nobody else: the largest first."""
    return votes.filter((F.col("yes") >= least) & (F.col("no") == 0) & (F.col("abstain") == 0) & F.col("roll_call")).orderBy(F.desc("yes"), "vote")
