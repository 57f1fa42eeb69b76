"""The record's tables, bound to the star-schema tables: positions, votes, motions, speeches, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.operators import groups, textual

RULE_BY_SIZE = ["egyszeru", "abszolut", "ketharmad_jelenlevo", "ketharmad_osszes", "negyotod_jelenlevo"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """A part is a vote, a supplier a member, its region the group; one row for each vote and member, the first line.

    Order, line number (1 to 7) and the position's code are one number, so the first line is a minimum in a hash
    aggregate.  Rows are dealt by vote once, in parts of bounded size: all that is grouped by vote and something else needs
    no other exchange.
    """
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    home = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: 25 rows
    code = F.when(F.col("l_linestatus") == "O", 3).when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 0).otherwise(1)
    packed = (F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")) * 4 + code
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", packed.alias("packed"))
    n = lines.count()  # from the footers
    with_home = lines.join(textual.bounded(home), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "l_suppkey", "n_regionkey", "packed")
    first = textual.dealt(with_home, n, "l_partkey").groupBy("l_partkey", "l_suppkey", "n_regionkey").agg(F.min("packed").alias("packed"))
    position = F.element_at(F.array(*[F.lit(p) for p in ("no", "abstain", "yes", "absent")]), (F.col("packed") % 4 + 1).cast("int"))
    return first.select(F.col("l_partkey").alias("vote"), F.col("l_suppkey").alias("member"), F.col("n_regionkey").alias("grp"), position.alias("position"))


def votes(spark: SparkSession, folder: str) -> DataFrame:
    """Headers of the votes: rule by size, some quorum checks, some without a stated presence, a recorded result."""
    own = positions(spark, folder).groupBy(F.col("vote").alias("v")).agg(
        *[F.count_if(F.col("position") == p).alias(p) for p in groups.CAST], F.count("*").alias("n")
    )
    size, key = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, folder, "part").select("p_partkey", "p_size").join(own, F.col("v") == key)
    rule = F.element_at(F.array(*[F.lit(r) for r in RULE_BY_SIZE]), (size % 5 + 1).cast("int"))
    cast = F.col("yes") + F.col("no") + F.col("abstain")
    return rows.select(
        key.alias("vote"), F.when(size % 11 == 0, "quorum").otherwise("decision").alias("kind"), rule.alias("rule"), "yes", "no", "abstain",
        F.when(size % 7 != 0, cast).alias("present"), (F.col("n") + 1).alias("seats"),
        F.when(key % 3 == 1, True).when(key % 3 == 2, False).alias("recorded"),
        F.date_add(F.lit("1995-01-01").cast("date"), (key % 1500).cast("int")).alias("on_date"), (cast > 0).alias("roll_call"),
    )


def motions(spark: SparkSession, folder: str) -> DataFrame:
    """An order is a vote about the bill of its customer."""
    o, status, first = table(spark, folder, "orders"), F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
    outcome = F.when(first == "1", "önálló indítvány elfogadva").when(first == "2", "módosító javaslat elutasítva")
    return o.select(
        F.col("o_orderkey").alias("vote"), F.col("o_orderdate").cast("date").alias("at"), (F.col("o_orderkey") % 3).alias("motion"), F.col("o_custkey").alias("number"),
        F.when(status == "F", "T").alias("prefix"), F.when(first != "3", F.col("o_orderpriority")).alias("title"), outcome.alias("outcome"),
    )


def speeches(spark: SparkSession, folder: str) -> DataFrame:
    """An event is a speech of its user, a value its length in seconds."""
    key, user = F.col("event_id"), F.col("user_id")
    number = F.concat(F.lit("T/"), (key % 37).cast("string"))
    return table(spark, folder, "events").select(
        F.col("ts").cast("date").alias("day"), key.alias("seq"), user.alias("speaker"), F.concat(F.lit("g"), (user % 5).cast("string")).alias("grp"),
        F.col("event_type").alias("kind"),
        F.when(key % 4 == 0, F.concat(F.lit("Matter "), (user % 7).cast("string"))).otherwise(F.concat(F.lit("Debate "), number, F.lit(" - Matter "), (user % 11).cast("string"))).alias("event"),
        F.when(key % 4 != 0, number).alias("numbers"), F.floor(F.abs("value")).cast("long").alias("seconds"),
        (F.col("event_type") == "click").alias("technical"), (key % 10 == 0).alias("reprint"), "ts",
    )


def stints(spark: SparkSession, folder: str) -> DataFrame:
    """The status of a customer's orders in time: (member, since, grp)."""
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderdate").cast("date").alias("since"), F.col("o_orderstatus").alias("grp"))


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of days by order: a third of them open."""
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("member"), key.alias("span"), day.alias("start"), F.when(key % 3 != 0, F.date_add(day, (key % 90).cast("int"))).alias("end"))


# -- the same bindings in SQL ------------------------------------------------------------------

POSITIONS = """pos AS (
  SELECT vote, member, grp, position FROM (
    SELECT l_partkey AS vote, l_suppkey AS member, n_regionkey AS grp,
           CASE WHEN l_linestatus = 'O' THEN 'absent' WHEN l_returnflag = 'R' THEN 'yes' WHEN l_returnflag = 'A' THEN 'no' ELSE 'abstain' END AS position,
           row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus) AS rn
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) WHERE rn = 1)"""

TALLIES = POSITIONS + """, tal AS (
  SELECT vote, grp, count(*) FILTER (position = 'yes') AS yes, count(*) FILTER (position = 'no') AS no, count(*) FILTER (position = 'abstain') AS abstain,
         count(*) FILTER (position = 'absent') AS other, count(*) AS n FROM pos GROUP BY vote, grp),
plu AS (
  SELECT *, yes + no + abstain AS "cast", greatest(yes, no, abstain) AS most,
         CASE WHEN yes + no + abstain > 0 AND (yes = greatest(yes, no, abstain))::int + (no = greatest(yes, no, abstain))::int + (abstain = greatest(yes, no, abstain))::int = 1
              THEN CASE WHEN yes = greatest(yes, no, abstain) THEN 'yes' WHEN no = greatest(yes, no, abstain) THEN 'no' ELSE 'abstain' END END AS plurality
  FROM tal)"""

VOTES = POSITIONS + """, hd AS (
  SELECT p_partkey AS vote, CASE WHEN p_size % 11 = 0 THEN 'quorum' ELSE 'decision' END AS kind,
         ['egyszeru', 'abszolut', 'ketharmad_jelenlevo', 'ketharmad_osszes', 'negyotod_jelenlevo'][p_size % 5 + 1] AS rule,
         yes, no, abstain, CASE WHEN p_size % 7 <> 0 THEN yes + no + abstain END AS present, n + 1 AS seats,
         CASE p_partkey % 3 WHEN 1 THEN true WHEN 2 THEN false END AS recorded,
         DATE '1995-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS on_date, yes + no + abstain > 0 AS roll_call
  FROM part JOIN (SELECT vote, count(*) FILTER (position = 'yes') AS yes, count(*) FILTER (position = 'no') AS no,
                         count(*) FILTER (position = 'abstain') AS abstain, count(*) AS n FROM pos GROUP BY vote) ON vote = p_partkey)"""


def verdict_sql(votes: str) -> str:
    """base, needed, margin, passed over the table ``votes`` of headers."""
    return f"""
  SELECT *, yes - needed AS margin, base > 0 AND yes >= needed AS passed FROM (
    SELECT *, CASE WHEN rule IN ('egyszeru', 'abszolut') THEN base // 2 + 1 WHEN rule IN ('ketharmad_jelenlevo', 'ketharmad_osszes') THEN (2 * base + 2) // 3
                   WHEN rule IN ('negyotod_jelenlevo', 'negyotod_osszes') THEN (4 * base + 4) // 5 END AS needed FROM (
      SELECT *, CASE WHEN rule IN ('egyszeru', 'ketharmad_jelenlevo', 'negyotod_jelenlevo') THEN coalesce(present, yes + no + abstain)
                     WHEN rule <> 'relativ' THEN seats END AS base FROM {votes}))"""


VERDICTS = VOTES + f", ver AS ({verdict_sql('hd')})"

SPEECHES = """sp AS (
  SELECT CAST(ts AS DATE) AS day, event_id AS seq, user_id AS speaker, 'g' || (user_id % 5) AS grp, event_type AS kind,
         CASE WHEN event_id % 4 = 0 THEN 'Matter ' || (user_id % 7) ELSE 'Debate T/' || (event_id % 37) || ' - Matter ' || (user_id % 11) END AS event,
         CASE WHEN event_id % 4 <> 0 THEN 'T/' || (event_id % 37) END AS numbers, CAST(floor(abs(value)) AS BIGINT) AS seconds,
         event_type = 'click' AS technical, event_id % 10 = 0 AS reprint, ts FROM events)"""

MOTIONS = """mo AS (
  SELECT o_orderkey AS vote, CAST(o_orderdate AS DATE) AS "at", o_orderkey % 3 AS motion, o_custkey AS number, CASE WHEN o_orderstatus = 'F' THEN 'T' END AS prefix,
         CASE WHEN o_orderpriority[1] <> '3' THEN o_orderpriority END AS title,
         CASE o_orderpriority[1] WHEN '1' THEN 'önálló indítvány elfogadva' WHEN '2' THEN 'módosító javaslat elutasítva' END AS outcome FROM orders)"""

STINTS = "st AS (SELECT o_custkey AS member, CAST(o_orderdate AS DATE) AS since, o_orderstatus AS grp FROM orders)"

SPANS = """spn AS (SELECT o_custkey AS member, o_orderkey AS span, CAST(o_orderdate AS DATE) AS "start",
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS "end" FROM orders)"""
