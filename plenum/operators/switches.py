"""Group switches: what one source says of them, and whether roll calls agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(switches: DataFrame, observed: DataFrame, member: str = "member") -> DataFrame:
    """Verdict and lag of each switch (member, before, after, began, since, until), by the groups seen in votes.

    ``observed``: (member, day, grp).  ``began`` is the first day of the stint that ends with the switch, ``since`` the day
    of the switch.  Verdicts, in this order: no list: nothing seen in [began, since) or nothing in [since, until); names
    another group: anything but the old group seen before, or a third one after; agrees: the old group isn't seen
    after; old label on the day: it is last seen on the day itself; keeps old label: later than that.  ``lag_days``
    counts from ``since`` to the last day with the old label, where a verdict gets that far.
    """
    seen = observed.select(F.col(member).alias("m"), "day", "grp")
    inside = (F.col(member) == F.col("m")) & (F.col("day") >= F.col("began")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    earlier, old = F.col("day") < F.col("since"), F.col("grp") == F.col("before")
    per = switches.join(seen, inside, "left").groupBy(member, "began", "since", "before", "after", "until").agg(
        F.count_if(earlier).alias("n_before"), F.count_if(~earlier).alias("n_after"), F.count_if(earlier & ~old).alias("others_before"),
        F.count_if(~earlier & ~old & (F.col("grp") != F.col("after"))).alias("others_after"), F.max(F.when(~earlier & old, F.col("day"))).alias("last_old"),
    )
    lag = F.datediff("last_old", "since")
    out = per.withColumn(
        "verdict",
        F.when((F.col("n_before") == 0) | (F.col("n_after") == 0), "no list").when((F.col("others_before") > 0) | (F.col("others_after") > 0), "names another group")
        .when(lag.isNull(), "agrees").when(lag == 0, "old label on the day").otherwise("keeps old label"),
    )
    settled = F.col("verdict").isin("old label on the day", "keeps old label")
    return out.withColumn("lag_days", F.when(settled, lag)).drop("n_before", "n_after", "others_before", "others_after", "last_old")
