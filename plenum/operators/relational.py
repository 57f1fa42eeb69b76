"""Loading and checking: first wins, merges, keys, integrity, sets, digests, name resolution, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenum.functions import text


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first by ``order``.  Minima of structs combine before the shuffle."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = F.min(F.struct(*order, *([F.struct(*rest).alias("__row")] if rest else []))).alias("__best")
    at = {c: f"__best.{c}" if c in order else f"__best.__row.{c}" for c in rows.columns if c not in key}
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(x).alias(c) for c, x in at.items()])


def merge(listing: DataFrame, detail: DataFrame, key: str, listed: list[str], detailed: list[str]) -> DataFrame:
    """Upsert: ``listed`` columns are overwritten by the newer listing, ``detailed`` only by values that aren't null."""
    a, b = listing.alias("a"), detail.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(
        F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key),
        *[F.when(F.col(f"a.{key}").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in listed],
        *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in detailed],
    )


def dangling(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows of ``child`` whose key isn't null and names no row of ``parent``."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias("__pk")), F.col(fk) == F.col("__pk"), "left_anti")


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def surrogate(rows: DataFrame, natural: str, identity: list[str], seen: str) -> DataFrame:
    """A key for each identity that shares a natural key: the natural one, then natural#2, #3 as first seen."""
    ids = rows.groupBy(natural, *identity).agg(F.min(seen).alias("seen"))
    n = F.row_number().over(W.partitionBy(natural).orderBy("seen", *identity))
    return ids.withColumn("key", F.when(n == 1, F.col(natural).cast("string")).otherwise(F.concat(F.col(natural).cast("string"), F.lit("#"), n.cast("string"))))


def reprints(rows: DataFrame, day: str, key: list[str], order: str) -> DataFrame:
    """Flags a row whose number and speaker were already printed that day."""
    n = F.row_number().over(W.partitionBy(day, *key).orderBy(order))
    return rows.withColumn("reprint", F.col(key[0]).isNotNull() & (n > 1))


def chain_digest(rows: DataFrame, service: str, name: str, content: Column, leaf: int = 65_536) -> DataFrame:
    """A digest of each service over its sorted (name, sha256 of content) lines, as a tree over prefixes of the names' hashes.

    A service has 256 leaves, or 256 times as many for each time that its lines are 256 times as many as leaves of ``leaf`` lines
    hold; a node is the digest of its children's.  So no task gathers more than about ``leaf`` lines, however large a service is.
    """
    line = F.concat_ws(" ", F.col(name).cast("string"), F.sha2(content, 256))
    lines = rows.select(F.col(service).alias("service"), F.md5(F.col(name).cast("string")).alias("hash"), line.alias("line"))
    depth = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.log(256.0, F.col("n") / leaf)))).cast("int")
    sizes = rows.groupBy(F.col(service).alias("s")).agg(F.count("*").alias("n")).select("s", depth.alias("depth"))
    deepest = sizes.agg(F.max("depth")).first()[0] or 1
    cut = lines.join(sizes, F.col("service").eqNullSafe(F.col("s")))
    parts = cut.select("service", "line", F.substring("hash", F.lit(1), F.col("depth") * 2).alias("part"))
    nodes = parts.groupBy("service", "part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("d"))
    child = F.concat_ws(" ", "part", "d")
    for level in range(deepest - 1, 0, -1):  # a node has 256 children at most
        up = nodes.filter(F.length("part") == 2 * (level + 1)).groupBy("service", F.substring("part", 1, 2 * level).alias("part"))
        folded = up.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("d"))
        nodes = nodes.filter(F.length("part") <= 2 * level).unionByName(folded)
    return nodes.groupBy("service").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256).alias("digest"))


def fingerprint(fields: dict[str, Column]) -> Column:
    """16 hex digits of a row's canonical JSON: sorted keys, nulls kept."""
    packed = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(packed, 256), 1, 16)


def fold_bindings(rows: DataFrame, key: str, order: str, values: list[str], label: str) -> DataFrame:
    """Several rows of a key to one: distinct values in the order first seen, and the first label there is."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(order, c)))), lambda x: x[c])
    return rows.groupBy(key).agg(*[F.array_distinct(ordered(v)).alias(v) for v in values], F.min_by(label, F.when(F.col(label).isNotNull(), F.col(order))).alias(label))


def repaired_dates(days: DataFrame, file: str, printed: str, weekday: str) -> DataFrame:
    """Dates printed one day early, moved to the day that their weekday (0 is Monday) names.

    A row's shift is 0 or 1 where its weekday names the printed or the next day, else null.  If nine tenths of a
    file's rows with a shift say 1, all its dates move; else only the rows that say so.
    """
    shift = F.when(F.weekday(printed) == F.col(weekday), 0).when(F.weekday(F.date_add(printed, 1)) == F.col(weekday), 1)
    rows = days.withColumn("shift", shift)
    share = rows.groupBy(F.col(file).alias("__file")).agg(F.try_divide(F.count_if(F.col("shift") == 1).cast("double"), F.count("shift")).alias("share"))
    rows = rows.join(share, F.col(file).eqNullSafe(F.col("__file"))).drop("__file")
    moves = F.col(printed).isNotNull() & ((F.coalesce(F.col("share"), F.lit(0.0)) >= 0.9) | F.coalesce(F.col("shift") == 1, F.lit(False)))
    day = F.when(moves, F.date_add(printed, 1)).otherwise(F.col(printed))
    return rows.withColumns({"on_date": day, "date_corrected": moves}).withColumn("weekday_conflict", F.weekday("on_date") != F.col(weekday))


def resolve(labels: DataFrame, people: DataFrame, history: DataFrame) -> DataFrame:
    """(label, term) to a person's id, or null: a name is never guessed.

    ``people``: (id, listed, name): the label of the current list and the printed name.  ``history``: (id, term, grp).
    Steps, of which the first that leaves exactly one consistent candidate decides: the list's label; the
    printed name; the name without its title; a short given name (one a prefix of the other, both of at
    least four letters, three apart at most, all other words equal).  A candidate is consistent if its history
    has the label's group in that term, or has no rows at all; a label without a group stops after step two.
    """
    name, grp = F.regexp_extract("label", r"^(.*?)\s*\(([^()]*)\)\s*$", 1), F.regexp_extract("label", r"^(.*?)\s*\(([^()]*)\)\s*$", 2)
    asked = labels.select("label", "term").distinct().withColumns({"bare": F.when(name != "", name).otherwise(F.trim("label")), "grp": F.when(grp != "", grp)})
    words = lambda c: F.split(F.trim(text.fold(text.honorific_stripped(c))), r"\s+")
    head = lambda w: F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " ")
    folded = words(F.col("bare"))
    asked = asked.withColumns({"plain": F.array_join(folded, " "), "head": head(folded), "last": F.element_at(folded, -1)})
    own = words(F.col("name"))
    known = people.withColumns({"plain_p": F.array_join(own, " "), "head_p": head(own), "last_p": F.element_at(own, -1)})
    # a name and one that begins with it meet on an equality: the longer one is cut by one, two and three letters
    cuts = lambda c: F.explode(F.filter(F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.substring(c, F.lit(1), F.length(c) - n)), lambda x: F.length(x) >= 4))
    q, p = asked, known
    q4 = q.filter("grp is not null").select("label", "term", "grp", "head", "last")
    p4 = p.select("id", "head_p", "last_p").filter(F.length("last_p") >= 4)
    longer = q4.withColumn("begins", cuts(F.col("last"))).join(p4, (F.col("head") == F.col("head_p")) & (F.col("begins") == F.col("last_p")))
    shorter = q4.join(p4.withColumn("begins", cuts(F.col("last_p"))), (F.col("head") == F.col("head_p")) & (F.col("last") == F.col("begins")))
    steps = [
        (1, q.join(p, F.col("label") == F.col("listed"))),
        (2, q.join(p, F.col("bare") == F.col("name"))),
        (3, q.filter("grp is not null").join(p, F.col("plain") == F.col("plain_p"))),
        (4, longer),
        (4, shorter),
    ]
    found = None
    for step, rows in steps:
        part = rows.select("label", "term", "grp", "id", F.lit(step).alias("step"))
        found = part if found is None else found.union(part)
    has = history.select("id").distinct().withColumn("has", F.lit(True))
    inside = history.select("id", "term", F.col("grp").alias("hgrp")).distinct()
    found = found.distinct().join(has, "id", "left").join(inside, ["id", "term"], "left")
    fits = F.col("has").isNull() | F.coalesce(F.when(F.col("grp").isNull(), F.col("hgrp").isNotNull()).otherwise(F.col("hgrp") == F.col("grp")), F.lit(False))
    fitting = found.filter(fits | (F.col("step") == 1)).select("label", "term", "step", "id").distinct()
    per = fitting.groupBy("label", "term", "step").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    one = per.filter("n = 1").groupBy("label", "term").agg(F.min(F.struct("step", "id")).alias("s")).select("label", "term", "s.step", "s.id")
    return labels.select("label", "term").distinct().join(one, ["label", "term"], "left")


def same_person(a: Column, b: Column) -> Column:
    """One name's words contain the other's, and they share at least two."""
    x, y = F.array_distinct(F.split(F.trim(text.fold(a)), r"[\s-]+")), F.array_distinct(F.split(F.trim(text.fold(b)), r"[\s-]+"))
    shared = F.size(F.array_intersect(x, y))
    return (shared >= 2) & (shared == F.least(F.size(x), F.size(y)))


def expanded(ranges: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """One row for each number of a range, for an equality join."""
    return ranges.filter(F.col(low) <= F.col(high)).withColumn(name, F.explode(F.sequence(low, high)))
