"""Bills and floor time.

Motions are rows (vote, at, motion, number, prefix, title, outcome); speeches are rows (day, seq, speaker, grp,
kind, event, numbers, seconds, technical, reprint).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions import text

INDEPENDENT = "független"


def own_stage(outcome: str, prefix: str):
    """Is a motion the bill itself?  Its outcome says so, or else its number has a type."""
    low = F.lower(F.coalesce(F.col(outcome), F.lit("")))
    return F.when(low.contains("önálló"), True).when(low.contains("módosító"), False).otherwise(F.col(prefix).isNotNull())


def bill_journeys(motions: DataFrame) -> DataFrame:
    """One row a bill: each vote about it counts once, as its own stage if any of its motions is one."""
    rows = motions.filter("number is not null").withColumn("own", own_stage("outcome", "prefix"))
    per_vote = rows.groupBy("number", "vote").agg(
        F.min("at").alias("at"), F.max("own").alias("own"), F.min_by("outcome", "motion").alias("outcome"),
    )
    place = F.struct("at", "vote", "motion")
    names = rows.groupBy("number").agg(
        F.min_by("prefix", F.when(F.col("prefix").isNotNull(), place)).alias("prefix"), F.min_by("title", F.when(F.col("title").isNotNull(), place)).alias("title")
    )
    turn = F.struct("at", "vote")
    out = per_vote.groupBy("number").agg(
        F.count("*").alias("votes"), F.count_if("own").alias("own_votes"), F.count_if(~F.col("own")).alias("amendment_votes"),
        F.min("at").alias("first"), F.max("at").alias("last"), F.max_by("outcome", turn).alias("final_outcome"),
    )
    return out.join(names, "number").withColumn("label", F.when(F.col("prefix").isNotNull(), F.concat_ws("/", "prefix", F.col("number").cast("string"))).otherwise(F.col("number").cast("string")))


# The kinds of speeches that count as speaking on a matter.
SUBSTANTIVE = [
    "felszólalás", "kétperces felszólalás", "vezérszónoki felszólalás", "napirend előtti felszólalás", "napirend előttihez hozzászólás",
    "napirend utáni felszólalás", "napirend utánihoz hozzászólás", "elhangzik az interpelláció/kérdés/azonnali kérdés", "kérdés megválaszolva",
    "interpelláció szóban megválaszolva", "azonnali kérdésre adott képviselői viszonválasz", "azonnali kérdésre adott miniszteri viszonválasz",
    "képviselő elfogadta a választ", "képviselő elutasította a választ", "előadói válasz", "előterjesztő nyitóbeszéde",
    "ismerteti a bizottság véleményét", "bizottság kisebbségi véleményének ismertetése", "ügyrendi javaslat", "ügyrendi kérdés",
    "bejelentés helyettes válaszadó elutasításáról", "expozé", "önálló indítvány indokolása", "sürgősség indoklása", "kivételes eljárás indoklása",
]


def technical(kind: Column, reprint: Column) -> Column:
    """Does a speech not count as speaking on a matter?  A reprint doesn't, nor does a kind that isn't listed, or none."""
    return reprint | ~F.lower(F.coalesce(kind, F.lit(""))).isin(*SUBSTANTIVE)


def substantive(speeches: DataFrame) -> DataFrame:
    return speeches.filter(~F.col("technical") & ~F.col("reprint"))


def speaking_time(speeches: DataFrame) -> DataFrame:
    """For each speaker: seconds of all rows but reprints, the substantive part, and their number."""
    part = ~F.col("technical")
    return speeches.filter(~F.col("reprint")).groupBy("speaker").agg(
        F.sum("seconds").alias("seconds"), F.sum(F.when(part, F.col("seconds")).otherwise(0)).alias("substantive"),
        F.count_if(part).alias("speeches"), F.count_distinct("kind").alias("kinds"),
    )


def floor_time(speeches: DataFrame) -> DataFrame:
    """Long form of where the time of each year went: by debate or slot, stage, form and group.

    Each dimension's rows add up to the year, since every second is in exactly one of them.
    """
    parts = text.split_event(F.col("event"), F.col("numbers"))
    rows = substantive(speeches).filter("seconds > 0").withColumns(parts)
    debate = F.when(F.coalesce(F.col("numbers"), F.lit("")) != "", F.concat_ws(" | ", "numbers", F.coalesce("subject", F.lit("")))).otherwise(F.concat(F.lit("slot: "), F.coalesce("subject", F.lit("—"))))
    rows = rows.select(
        F.year("day").alias("year"), debate.alias("debate"), F.coalesce("stage", F.lit("—")).alias("stage"),
        F.coalesce("kind", F.lit("—")).alias("form"), F.coalesce("grp", F.lit("—")).alias("grp"), "seconds",
    )
    year = F.col("year")
    sets = [[year], *[[year, F.col(c)] for c in ("debate", "stage", "form", "grp")]]
    return rows.groupingSets(sets, "year", "debate", "stage", "form", "grp").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("speeches"))


def expected_share(speeches: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each group's share of the House, weighted by the seconds spoken while it had it.

    ``speeches``: (day, seconds); ``snapshots``: (day, counts map group -> members): the day's last roll call.
    The snapshot in force is the last one up to the day, before the first one the first.
    """
    from plenum.operators.series import as_of

    per_day = speeches.groupBy("day").agg(F.sum("seconds").alias("seconds")).withColumn("one", F.lit(1))
    house = as_of(per_day, snapshots.withColumn("one", F.lit(1)), "one", "day", "day", "counts")  # one row a day
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = house.withColumn("house", total).select("seconds", "house", F.explode("counts").alias("grp", "n"))
    rows = rows.groupBy("grp").agg(F.sum(F.col("seconds") * F.col("n") / F.col("house")).alias("w"), F.sum(F.col("seconds") * F.col("n")).alias("s"))
    all_seconds = per_day.agg(F.sum("seconds").alias("t"))
    return rows.join(F.broadcast(all_seconds)).select("grp", (F.col("w") / F.col("t")).alias("expected"), (F.col("s") / F.col("t")).alias("seats"))  # one row
