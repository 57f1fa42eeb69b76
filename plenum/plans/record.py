"""Queries of the record's structure: bill texts, composition and rosters, published tables, liveness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plenum.functions import text
from plenum.operators import billtext, house, membership, operations
from plenum.plans import bindings as b
from plenum.plans.gate import Gate, Input, Output
from plenum.plans.registry import query
from plenum.sources import records
from plenum.sources.versions import Versions, at_least, refers_to
from plenum.sources.work import work_dir
from plenum.streaming import liveness

# -- bill texts ----------------------------------------------------------------------------------

_BODY = """CASE WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN (l_partkey % 3 + 1) || '. melléklet a 2024. évi ... törvényhez' || chr(10) || (l_suppkey % 5 + 1) || '. cikk Tárgy'
    WHEN l_linestatus = 'F' AND l_linenumber = 6 THEN 'Általános INDOKOLÁS' || chr(10) || '1. § [Cím]'
    WHEN l_returnflag = 'A' THEN (l_linenumber * 2) || '. § (1) bekezdésében foglalt' || chr(10) || ' ' || l_linenumber || '. § (1) A törvény'
    ELSE l_linenumber || '. §' || chr(10) || '2. cikk kisbetű' END"""


def _bills(s, d):
    """An order is a bill, a line its page: headings, references that look like headings, annexes, the reasoning."""
    flag, no = F.col("l_returnflag"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    body = (
        F.when((flag == "R") & (no > 3), F.concat(text(F.col("l_partkey") % 3 + 1), F.lit(". melléklet a 2024. évi ... törvényhez\n"), text(F.col("l_suppkey") % 5 + 1), F.lit(". cikk Tárgy")))
        .when((F.col("l_linestatus") == "F") & (no == 6), F.lit("Általános INDOKOLÁS\n1. § [Cím]"))
        .when(flag == "A", F.concat(text(no * 2), F.lit(". § (1) bekezdésében foglalt\n "), text(no), F.lit(". § (1) A törvény")))
        .otherwise(F.concat(text(no), F.lit(". §\n2. cikk kisbetű")))
    )
    return b.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("bill"), F.col("l_linenumber").alias("page")).agg(F.min(body).alias("body"))


_UNITS = f"""pg AS (SELECT l_orderkey AS bill, l_linenumber AS page, min({_BODY}) AS body FROM lineitem GROUP BY 1, 2),
  ln AS (SELECT bill, page, unnest(string_split(body, chr(10))) AS t, unnest(range(len(string_split(body, chr(10))))) AS line FROM pg),
  en AS (SELECT bill, min(page * 100 + line) AS stop FROM ln JOIN (SELECT bill, min(page) AS first FROM pg GROUP BY 1) USING (bill) WHERE page > first AND lower(t) = 'általános indokolás' GROUP BY 1),
  hd AS (SELECT ln.*, CASE WHEN t LIKE '%melléklet a%' THEN 'annex' WHEN t LIKE '%§%' THEN 'section' WHEN t LIKE '%cikk%' THEN 'article' END AS kind, CAST(regexp_extract(t, '([0-9]+)', 1) AS INTEGER) AS number
    FROM ln LEFT JOIN en USING (bill) WHERE stop IS NULL OR page * 100 + line < stop),
  an AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'annex' THEN number END IGNORE NULLS) OVER (PARTITION BY bill ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS annex FROM hd WHERE kind IS NOT NULL),
  kp AS (SELECT * FROM an WHERE kind = 'annex' OR (annex > 0 AND kind = 'article') OR (annex = 0 AND t NOT LIKE '%bekezdés%' AND t NOT LIKE '%kisbetű%'))"""


@query("bill_headings", f"WITH {_UNITS} SELECT bill, page, CAST(line AS INTEGER) AS line, kind, number, annex FROM kp")
def _(s, d):
    return billtext.headings(_bills(s, d))


@query("bill_units", f"""WITH {_UNITS} SELECT bill, 'section' AS kind, 0 AS annex, number, min(page) AS page FROM kp WHERE kind = 'section' AND annex = 0 GROUP BY ALL
  UNION ALL SELECT bill, 'annex', 0, number, min(page) FROM kp WHERE kind = 'annex' GROUP BY ALL UNION ALL SELECT bill, 'annex article', annex, number, min(page) FROM kp WHERE kind = 'article' AND annex > 0 GROUP BY ALL""")
def _(s, d):
    """The sections' numbers grow with the pages here, so the longest growing run has all of them."""
    return billtext.units(_bills(s, d))


@query("bill_citations", f"""WITH {_UNITS}, se AS (SELECT DISTINCT bill, number, page FROM kp WHERE kind = 'section' AND annex = 0), ax AS (SELECT bill, number, min(page) AS page FROM kp WHERE kind = 'annex' GROUP BY ALL),
  ci AS (SELECT o_orderkey AS bill, o_custkey % 8 AS n, o_orderstatus AS st FROM orders)
  SELECT ci.bill, CASE st WHEN 'F' THEN n || '. § (2)' WHEN 'O' THEN n || '. melléklet' ELSE 'indokolás ' || n END AS cite, CASE st WHEN 'F' THEN se.page WHEN 'O' THEN ax.page END AS page
  FROM ci LEFT JOIN se ON se.bill = ci.bill AND se.number = n LEFT JOIN ax ON ax.bill = ci.bill AND ax.number = n""")
def _(s, d):
    status, n = F.col("o_orderstatus"), (F.col("o_custkey") % 8).cast("string")
    cite = F.when(status == "F", F.concat(n, F.lit(". § (2)"))).when(status == "O", F.concat(n, F.lit(". melléklet"))).otherwise(F.concat(F.lit("indokolás "), n))
    cites = b.table(s, d, "orders").select(F.col("o_orderkey").alias("bill"), cite.alias("cite"))
    return billtext.cited_pages(cites, billtext.units(_bills(s, d)))


@query("bill_quotes")
def _(s, d):
    """A source is a bill, a document a page: on which page of each source does each passage of the benchmark first stand?"""
    docs = b.table(s, d, "documents").select(F.col("source").alias("bill"), F.col("doc_id").alias("page"), F.col("text").alias("body"))
    quotes = docs.select("bill").distinct().crossJoin(F.broadcast(b.table(s, d, "benchmark").select(F.col("text").alias("quote"))))  # a row a source and passage
    return billtext.quoted_pages(quotes, docs).filter("page is not null")


# -- membership ----------------------------------------------------------------------------------


@query("composition_on_days", f"""WITH {b.STINTS}, q AS (SELECT member, since, min(grp) AS grp FROM st GROUP BY 1, 2), m AS (SELECT member, min(since) AS a, max(since) AS z FROM st GROUP BY 1),
  g AS (SELECT member, grp, since, lead(since) OVER (PARTITION BY member ORDER BY since) - 1 AS "until" FROM q), dy AS (SELECT DISTINCT since AS day FROM st)
  SELECT day, coalesce(grp, 'independent') AS grp, count(*) AS members FROM dy JOIN m ON day BETWEEN a AND z LEFT JOIN (SELECT * FROM g WHERE grp <> 'P') g ON g.member = m.member AND day >= since AND ("until" IS NULL OR day <= "until") GROUP BY 1, 2""", days=("day",))
def _(s, d):
    """A customer sits from the first order to the last, for the group of the order before; who is at P sits for none."""
    from pyspark.sql import Window as W

    stints = b.stints(s, d)
    mandates = stints.groupBy("member").agg(F.min("since").alias("since"), F.max("since").alias("until"))
    one = stints.groupBy("member", "since").agg(F.min("grp").alias("grp"))
    spans = one.withColumn("until", F.date_sub(F.lead("since").over(W.partitionBy("member").orderBy("since")), 1)).filter("grp <> 'P'")
    return membership.composition(stints.select(F.col("since").alias("day")), mandates, spans)


@query("committee_rosters", """WITH r AS (SELECT o_custkey AS member, c_nationkey * 2 + o_custkey % 2 + CASE WHEN o_orderstatus = 'P' THEN 30 ELSE 0 END AS committee, o_orderpriority[1] AS p, CAST(o_orderdate AS DATE) AS since, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 400 END AS "until" FROM orders JOIN customer ON c_custkey = o_custkey),
  n AS (SELECT *, since <= DATE '1996-06-01' AND ("until" IS NULL OR "until" >= DATE '1996-06-01') AS now FROM r),
  o AS (SELECT committee, member, bool_or(now) AS now, bool_or(since <= DATE '1996-06-01') AS began, min((CASE p WHEN '1' THEN 1 WHEN '2' THEN 2 END, since, member)) FILTER (now AND p IN ('1', '2')) AS lead FROM n GROUP BY 1, 2),
  e AS (SELECT committee, count(*) FILTER (now) AS members, count(*) FILTER (began AND NOT now) AS former, min(lead) AS lead FROM o GROUP BY 1),
  l AS (SELECT n_nationkey * 2 AS committee, n_name AS name, CASE WHEN n_regionkey > 0 THEN n_regionkey * 2 END AS parent FROM nation)
  SELECT coalesce(e.committee, l.committee) AS committee, name, parent, name IS NOT NULL AS listed, coalesce(members, 0) AS members, coalesce(former, 0) AS former, lead[3] AS chair FROM e FULL JOIN l ON e.committee = l.committee""")
def _(s, d):
    homes = b.table(s, d, "customer").select("c_custkey", "c_nationkey")
    day, p = F.col("o_orderdate").cast("date"), F.substring("o_orderpriority", 1, 1)
    committee = F.col("c_nationkey") * 2 + F.col("o_custkey") % 2 + F.when(F.col("o_orderstatus") == "P", 30).otherwise(0)
    rows = b.table(s, d, "orders").join(homes, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("member"), committee.alias("committee"), F.when(p == "1", "Elnök").when(p == "2", "társelnök").otherwise("tag").alias("role"),
        day.alias("since"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, 400)).alias("until"),
    )
    listed = b.table(s, d, "nation").select((F.col("n_nationkey") * 2).alias("committee"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 0, F.col("n_regionkey") * 2).alias("parent"))
    return membership.rosters(rows, listed, F.lit(dt.date(1996, 6, 1)))


# -- published tables ----------------------------------------------------------------------------


@query("replaced_children", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
  UNION ALL SELECT o_orderkey, 1, o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def _(s, d):
    """Orders at P come again with one line of all they cost; every line has to have its order."""
    orders, lines = b.table(s, d, "orders"), b.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    table = Versions(s, work_dir(s, "children"), ["l_orderkey"])
    checks = [at_least(1), refers_to("l_orderkey", orders, "o_orderkey")]
    table.rebuild(lines, checks)
    again = orders.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity"))
    table.replace_children(again.select(*[F.col(f.name).cast(f.dataType) for f in lines.schema]), checks)
    return table.read()


@query("gated_recompute", """WITH n AS (SELECT n_nationkey, n_regionkey = 0 AS again FROM nation) SELECT CAST(n_nationkey AS VARCHAR) AS part, count(*) * CASE WHEN again THEN 2 ELSE 1 END AS customers, again AS built_again
  FROM customer JOIN n ON n_nationkey = c_nationkey GROUP BY n_nationkey, again""")
def _(s, d):
    """Customers as files by nation; then those of one region come a second time: only their nations are counted again."""
    folder, names = work_dir(s, "gate-in"), b.table(s, d, "nation").select("n_nationkey", "n_regionkey")
    customers = b.table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    customers.write.partitionBy("nation").parquet(folder)
    source = Input("customers", folder, lambda spark, paths: spark.read.parquet(*paths), "*.parquet", r"/nation=(\d+)/")
    counted = Output("per_nation", ("customers",), lambda given: given["customers"].groupBy("part").agg(F.count("*").alias("customers")))
    gate = Gate(s, work_dir(s, "gate"))
    gate.run([source], [counted])
    more = customers.join(F.broadcast(names.filter("n_regionkey = 0")), F.col("nation") == F.col("n_nationkey"), "left_semi")  # nations: 25 rows
    more.write.mode("append").partitionBy("nation").parquet(folder)
    built = gate.run([source], [counted])[1]["built"]
    return gate.table("per_nation").read().select("part", "customers", F.col("part").isin(*built).alias("built_again"))


# -- liveness ------------------------------------------------------------------------------------


@query("liveness_status", """WITH h AS (SELECT client_id, arg_max(ts, (ts, click_id)) AS checked, max(ts) FILTER (kind = 'view') AS published FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1),
  p AS (SELECT client_id, CASE WHEN checked > TIMESTAMP '2024-05-01 01:00:00' THEN 'future clock' WHEN checked < TIMESTAMP '2024-05-01' - INTERVAL 60 HOUR THEN 'silent' END AS a,
    CASE WHEN published IS NULL THEN 'never published' WHEN published < TIMESTAMP '2024-05-01' - INTERVAL 204 HOUR THEN 'late publication' END AS b FROM h)
  SELECT client_id, concat_ws(', ', a, b) AS problems, CASE WHEN a IS NULL AND b IS NULL THEN CASE WHEN client_id % 2 = 0 THEN 'close' ELSE 'none' END WHEN client_id % 2 = 0 THEN 'update' ELSE 'open' END AS step FROM p""")
def _(s, d):
    """A client's clicks are its reports, its views what it publishes."""
    clicks = b.table(s, d, "clicks").filter("client_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    last = clicks.groupBy("client_id").agg(F.max("ts").alias("checked"), F.max(F.when(F.col("kind") == "view", F.col("ts"))).alias("published"))
    found = liveness.problems(F.col("checked"), F.col("published"), F.lit("7"), F.lit("2024-05-01 00:00:00").cast("timestamp"))
    rows = last.select("client_id", found.alias("found"))
    return rows.select("client_id", F.array_join("found", ", ").alias("problems"), liveness.issue_step(F.col("found"), F.col("client_id") % 2 == 0).alias("step"))


# -- the House -----------------------------------------------------------------------------------

_TALLIED = f"{b.TALLIES.split(', tal AS', 1)[1].join(['tal AS', ''])}"


@query("votes_with_motions", """WITH l AS (SELECT l_orderkey AS vote, l_linenumber AS motion, l_partkey AS number FROM lineitem), f AS (SELECT vote, min((motion, number)) AS m FROM l GROUP BY 1)
  SELECT o_orderkey AS vote, m[1] AS motion, m[2] AS number FROM orders LEFT JOIN f ON vote = o_orderkey""")
def _(s, d):
    """An order is a vote, its lines the motions; some lines are there twice."""
    motions = b.table(s, d, "lineitem").select(F.col("l_orderkey").alias("vote"), F.col("l_linenumber").alias("motion"), F.col("l_partkey").alias("number"))
    return house.with_motions(b.table(s, d, "orders").select(F.col("o_orderkey").alias("vote")), motions)


@query("sitting_lookup", """SELECT o_orderkey, (SELECT min(event_id) FROM events WHERE CAST(ts AS DATE) = CAST(o_orderdate AS DATE) + 10000 - 10000 + CAST(DATE '2024-01-01' - DATE '1995-01-01' AS INTEGER)) AS sitting FROM orders WHERE o_orderstatus = 'F'""")
def _(s, d):
    """Sittings of 2024 looked up for orders of 1995: days that sat have several numbers, most days none."""
    moved = F.date_add(F.col("o_orderdate").cast("date"), (dt.date(2024, 1, 1) - dt.date(1995, 1, 1)).days)
    rows = b.table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", moved.alias("on_date"))
    sittings = b.table(s, d, "events").select(F.col("ts").cast("date").alias("day"), F.col("event_id").alias("sitting"))
    return house.sitting_of(rows, sittings).select("o_orderkey", "sitting")


@query("stub_members", """WITH l AS (SELECT c_custkey AS member, c_name AS name FROM customer WHERE c_acctbal >= 0), p AS (SELECT o_custkey AS member, o_orderpriority AS name FROM orders)
  SELECT member, name, false AS stub FROM l UNION ALL SELECT member, min(name), true FROM p WHERE member NOT IN (SELECT member FROM l) GROUP BY 1""")
def _(s, d):
    listed = b.table(s, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("member"), F.col("c_name").alias("name"))
    return house.with_stubs(listed, b.table(s, d, "orders").select(F.col("o_custkey").alias("member"), F.col("o_orderpriority").alias("name")))


@query("day_strips", """WITH v AS (SELECT o_orderkey AS vote, CAST(date_trunc('month', o_orderdate) AS DATE) AS on_date FROM orders),
  r AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY on_date) AS "of", lag(vote) OVER w AS previous, lead(vote) OVER w AS "next" FROM v WINDOW w AS (PARTITION BY on_date ORDER BY vote)),
  f AS (SELECT *, greatest(1, least(place - 80, "of" - 159)) AS first FROM r)
  SELECT vote, on_date, CAST(place AS INTEGER) AS place, "of", previous, "next", CAST(first AS INTEGER) AS first, CAST(least("of", first + 159) AS INTEGER) AS last FROM f""", days=("on_date",))
def _(s, d):
    """A month stands for a day, so that days are longer than a strip."""
    votes = b.table(s, d, "orders").select(F.col("o_orderkey").alias("vote"), F.trunc("o_orderdate", "month").cast("date").alias("on_date"))
    return house.day_strips(votes)


@query("group_months", f"""WITH {b.VOTES}, {_TALLIED}, h AS (SELECT vote, CASE WHEN kind = 'quorum' THEN on_date + 3650 ELSE on_date END AS on_date, kind FROM hd), g AS (
    SELECT strftime(on_date, '%Y-%m') AS month, plu.grp, CAST(sum("cast") AS BIGINT) AS "cast", CAST(sum(plu.n) AS BIGINT) AS in_roll, round(sum("cast") / sum(plu.n), 6) AS participation,
      round(sum(CASE WHEN plurality IS NULL THEN 0 ELSE "cast" - most END) / nullif(sum("cast"), 0), 6) AS dissent, round(sum(most - ("cast" - most) / 2) / nullif(sum("cast"), 0), 6) AS ai
    FROM plu JOIN (SELECT * FROM h WHERE kind <> 'quorum') h USING (vote) GROUP BY 1, 2)
  SELECT m.month, grp, "cast", in_roll, participation, dissent, ai FROM (SELECT DISTINCT strftime(on_date, '%Y-%m') AS month FROM h) m LEFT JOIN g ON g.month = m.month""")
def _(s, d):
    """Quorum checks are of other months, for which no positions are known."""
    check = F.col("kind") == "quorum"
    votes = b.votes(s, d).select("vote", F.when(check, F.date_add("on_date", 3650)).otherwise(F.col("on_date")).alias("on_date"), check.alias("check"))
    named = b.positions(s, d).join(votes.filter("not check").select("vote"), "vote", "left_semi")
    out = house.group_months(named, votes)
    return out.withColumns({c: F.round(c, 6) for c in ("participation", "dissent", "ai")})


@query("floor_shares_by_year", f"""WITH {b.SPEECHES}, x AS (SELECT CAST(year(day) AS INTEGER) AS year, CASE WHEN grp <> 'g4' THEN grp END AS grp, sum(seconds) AS s FROM sp WHERE NOT technical AND NOT reprint GROUP BY 1, 2),
  h AS (SELECT 'g' || (c_nationkey % 5) AS grp, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT year, sum(s) FILTER (grp IS NOT NULL) AS whole, coalesce(sum(s) FILTER (grp IS NULL), 0) AS un FROM x GROUP BY 1)
  SELECT x.year, x.grp, CAST(s AS BIGINT) AS seconds, round(s / whole, 6) AS share_of_time, round(n / (SELECT sum(n) FROM h), 6) AS share_of_house, round((s / whole) / (n / (SELECT sum(n) FROM h)), 6) AS ratio, CAST(un AS BIGINT) AS unattributed
  FROM x JOIN t USING (year) LEFT JOIN h ON h.grp = x.grp WHERE x.grp IS NOT NULL""")
def _(s, d):
    speeches = b.speeches(s, d).withColumn("grp", F.when(F.col("grp") != "g4", F.col("grp")))
    seats = b.table(s, d, "customer").groupBy(F.concat(F.lit("g"), (F.col("c_nationkey") % 5).cast("string")).alias("grp")).agg(F.count("*").alias("members"))
    return house.group_floor_shares(speeches, seats).withColumns({c: F.round(c, 6) for c in ("share_of_time", "share_of_house", "ratio")})


@query("speaking_by_group", f"""WITH {b.SPEECHES} SELECT grp, CAST(coalesce(sum(seconds) FILTER (NOT reprint), 0) AS BIGINT) AS seconds, CAST(coalesce(sum(seconds) FILTER (NOT reprint AND NOT technical), 0) AS BIGINT) AS substantive,
  count(*) FILTER (NOT reprint AND NOT technical) AS speeches, count(*) FILTER (reprint) AS reprints_skipped FROM sp GROUP BY 1""")
def _(s, d):
    return house.speaking_by_group(b.speeches(s, d))


@query("week_alignments", f"""WITH {b.VOTES}, {_TALLIED} SELECT CAST(isoyear(on_date) AS INTEGER) AS iso_year, CAST(week(on_date) AS INTEGER) AS iso_week, member, count(*) AS in_roll, count(*) FILTER (position <> 'absent') AS "cast",
  count(*) FILTER (position <> 'absent' AND plurality <> position) AS against FROM pos JOIN plu ON plu.vote = pos.vote AND plu.grp = pos.grp JOIN hd ON hd.vote = pos.vote GROUP BY 1, 2, 3""")
def _(s, d):
    return house.week_alignments(b.positions(s, d), b.votes(s, d))


@query("alignment_without_checks", f"""WITH {b.VOTES}, {_TALLIED} SELECT member, pos.grp, count(*) AS in_roll, count(*) FILTER (kind <> 'quorum' AND position <> 'absent') AS "cast", count(*) FILTER (kind <> 'quorum' AND position = 'abstain') AS abstained,
  count(*) FILTER (kind <> 'quorum' AND position = 'absent') AS absent, count(*) FILTER (kind <> 'quorum' AND position <> 'absent' AND plurality = position) AS with_group,
  count(*) FILTER (kind <> 'quorum' AND position <> 'absent' AND plurality <> position) AS against_group FROM pos JOIN hd ON hd.vote = pos.vote LEFT JOIN plu ON plu.vote = pos.vote AND plu.grp = pos.grp GROUP BY 1, 2""")
def _(s, d):
    return house.alignment(b.positions(s, d), b.votes(s, d), checks=False)


@query("press_week", f"""WITH {b.VERDICTS}, {_TALLIED}, w AS (SELECT max(on_date) - (isodow(max(on_date)) - 1)::INTEGER AS a FROM hd WHERE on_date <= DATE '1995-03-15'), m AS (SELECT ver.* FROM ver, w WHERE on_date BETWEEN a AND a + 6),
  x AS (SELECT pos.member FROM pos JOIN m ON m.vote = pos.vote AND kind = 'decision' JOIN plu ON plu.vote = pos.vote AND plu.grp = pos.grp WHERE position <> 'absent' AND position <> plurality)
  SELECT a AS first_day, a + 6 AS last_day, count(*) AS votes, count(*) FILTER (kind = 'decision') AS decisions, count(*) FILTER (kind = 'decision' AND rule NOT IN ('egyszeru', 'relativ')) AS qualified,
    count(*) FILTER (kind = 'decision' AND rule NOT IN ('egyszeru', 'relativ') AND NOT passed AND yes > no) AS sunk, (SELECT count(*) FROM x) AS dissents, (SELECT count(DISTINCT member) FROM x) AS dissenters FROM m, w GROUP BY a""", days=("first_day", "last_day"))
def _(s, d):
    return house.press_week(b.votes(s, d), b.positions(s, d), F.lit("1995-03-15").cast("date"))


@query("exchanges", """WITH e AS (SELECT DISTINCT l_partkey AS bill, l_returnflag AS label, l_suppkey % 20 AS sitting, l_linenumber AS seq FROM lineitem), h AS (SELECT conv_id AS sitting, turn AS seq, min(text) AS text FROM conversations WHERE text <> '' GROUP BY 1, 2)
  SELECT bill, CAST(row_number() OVER (PARTITION BY bill ORDER BY e.sitting, e.seq, label) AS INTEGER) AS turn, e.sitting, CAST(e.seq AS BIGINT) AS seq, label, text FROM e JOIN h ON h.sitting = e.sitting AND h.seq = e.seq""")
def _(s, d):
    """A conversation is a sitting; the lines of a part refer to its turns."""
    events = b.table(s, d, "lineitem").select(F.col("l_partkey").alias("bill"), F.col("l_returnflag").alias("label"), (F.col("l_suppkey") % 20).alias("sitting"), F.col("l_linenumber").cast("long").alias("seq"))
    return house.exchanges(events, b.table(s, d, "conversations").select(F.col("conv_id").alias("sitting"), F.col("turn").alias("seq"), "text"))


@query("hero_vote", f"WITH {b.VERDICTS} SELECT vote, rule, passed FROM ver WHERE roll_call ORDER BY (rule = 'ketharmad_osszes' AND coalesce(passed, false) AND kind = 'decision') DESC, on_date DESC, vote DESC LIMIT 1")
def _(s, d):
    return house.hero(b.votes(s, d)).select("vote", "rule", "passed")


@query("long_directory", """WITH k AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT day, o_orderkey FROM k ORDER BY day DESC, o_orderkey DESC LIMIT 100)
  SELECT o_orderkey, (day, o_orderkey) >= (SELECT min((day, o_orderkey)) FROM e) AS inline FROM k""")
def _(s, d):
    day = F.col("o_orderdate").cast("date")
    newest = F.struct(-F.datediff(day, F.lit("1970-01-01").cast("date")), -F.col("o_orderkey"))
    return house.directory(b.table(s, d, "orders").select("o_orderkey", "o_orderdate"), newest).select("o_orderkey", "inline")


@query("month_votes", f"WITH {b.VOTES} SELECT vote, on_date FROM hd WHERE strftime(on_date, '%Y-%m') = '1995-02'", days=("on_date",))
def _(s, d):
    return house.in_month(b.votes(s, d), "on_date", "1995-02").select("vote", "on_date")


@query("written_days", """WITH m AS (SELECT ['január', 'február', 'március', 'április', 'május', 'június', 'július', 'augusztus', 'szeptember', 'október', 'november', 'december'] AS hu,
    ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'] AS en), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, day(o_orderdate) AS n, o_totalprice FROM orders)
  SELECT o_orderkey, year(d) || '. ' || hu[month(d)] || ' ' || n || '.' AS plain, n || ' ' || en[month(d)] || ' ' || year(d) AS english,
    year(d) || '. ' || hu[month(d)] || ' ' || n || CASE WHEN n = 1 THEN '-jén' WHEN n IN (2, 3, 6, 8, 13, 16, 18, 20, 23, 26, 28, 30) THEN '-án' ELSE '-én' END AS "on",
    year(d) || '. ' || hu[month(d)] || ' ' || n || CASE WHEN n = 1 THEN '-jéig' ELSE '-ig' END AS "until", replace(format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)), ',', chr(160)) AS price FROM o, m""")
def _(s, d):
    day = F.col("o_orderdate").cast("date")
    return b.table(s, d, "orders").select(
        "o_orderkey", text.hungarian_date(day).alias("plain"), text.english_date(day).alias("english"), text.date_on(day).alias("on"), text.date_until(day).alias("until"), text.thousands(F.col("o_totalprice")).alias("price")
    )


@query("past_mandates", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN 'lista' ELSE 'egyeni' END AS mandate,
  CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'NATION ' || c_nationkey END AS county, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN CAST(c_custkey % 12 AS INTEGER) END AS district,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Országos lista 3. OEVK-n kívül' END AS list_label FROM customer""")
def _(s, d):
    segment, place = F.col("c_mktsegment"), F.concat(F.lit("NATION "), F.col("c_nationkey").cast("string"), F.lit(" "), (F.col("c_custkey") % 12).cast("string"), F.lit(". OEVK"))
    written = F.when(segment == "BUILDING", F.lit("")).when(segment == "MACHINERY", "Országos lista 3. OEVK-n kívül").otherwise(place)
    return b.table(s, d, "customer").select("c_custkey", *[c.alias(n) for n, c in text.mandate_of_record(written).items()])


@query("broken_references", r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '\b(?:href|src|poster)\s*=\s*"([^"#?]+)', 1)) AS href FROM pages), c AS (SELECT page_id, href, 'p' || (page_id % 3) || '/' AS folder FROM l WHERE NOT regexp_matches(href, '^(https?://|mailto:|data:|//|javascript:)')),
  t AS (SELECT *, CASE WHEN starts_with(href, '/') THEN ltrim(href, '/') ELSE folder || href END AS target FROM c)
  SELECT coalesce(nullif(regexp_extract(target, '\.([^./]*)$', 1), ''), 'no extension') AS kind, count(*) AS n, count(*) FILTER (regexp_matches(href, '\.(csv|json|xml|parquet|csv\.gz)$')) AS twins,
    min(folder || page_id || '.html → ' || href) AS example FROM t WHERE target NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) GROUP BY 1""")
def _(s, d):
    pages = b.table(s, d, "pages").select(F.concat(F.lit("p"), (F.col("page_id") % 3).cast("string"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), "html")
    return operations.broken_references(pages, b.table(s, d, "documents").select(F.col("source").alias("path")).distinct())


# -- adapters over payloads that are written from the tables ---------------------------------------


def _payloads(rows, *cells):
    return rows.select(F.col("key").cast("string").alias("path"), F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cells]).alias("raw"))


@query("member_list", """SELECT CAST(s_nationkey AS VARCHAR) AS path, CAST(s_suppkey AS VARCHAR) AS member, s_name AS name, CASE WHEN s_acctbal < 0 THEN '' ELSE 'G' || s_nationkey END AS grp,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Országos lista' WHEN s_suppkey % 3 = 1 THEN 'Fejér' END AS county, CASE WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey % 12 AS INTEGER) END AS district,
  CASE s_suppkey % 3 WHEN 0 THEN 'lista' WHEN 1 THEN 'egyeni' ELSE 'other' END AS mandate, CAST(s_suppkey + 1000 AS INTEGER) AS ord FROM supplier""")
def _(s, d):
    """A nation's suppliers as a list of members."""
    k = F.col("s_suppkey")
    county, district = F.when(k % 3 == 0, "Országos lista").when(k % 3 == 1, " Fejér ").otherwise(""), F.when(k % 3 == 1, (k % 12).cast("string")).otherwise("")
    grp = F.when(F.col("s_acctbal") < 0, "").otherwise(F.concat(F.lit("G"), F.col("s_nationkey").cast("string")))
    text_of = lambda c: c.cast("string")
    item = F.concat(F.lit('<kepviselo p_azon="'), text_of(k), F.lit('" nev="'), "s_name", F.lit('" kepv_csop="'), grp, F.lit('" vmegye="'), county, F.lit('" vkorzet="'), district, F.lit('" sorszam="'), F.translate(F.format_number(k + 1000, 0), ",", " "), F.lit('"/>'))
    lists = b.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.array_join(F.collect_list(item), "").alias("items"))  # a nation's members
    return records.members(_payloads(lists, "<kepviselok>", F.col("items"), "</kepviselok>")).drop("photo")


@query("bill_details", """SELECT CAST(o_orderkey AS VARCHAR) AS path, 'T/' || o_orderkey AS iromany, CAST(o_orderkey AS INTEGER) AS number, CASE o_orderstatus WHEN 'F' THEN 'surgos' WHEN 'O' THEN 'kiveteles' END AS procedure_kind,
  CAST(o_orderdate AS DATE) AS submitted_on, CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate + INTERVAL 30 DAY) || '. évi XV. törvény' END AS law, CASE o_orderpriority[1] WHEN '1' THEN 'kormany' WHEN '2' THEN 'bizottsag' WHEN '3' THEN NULL ELSE 'kepviselo' END AS submitter_kind,
  CASE o_orderpriority[1] WHEN '1' THEN 1 WHEN '2' THEN 1 WHEN '3' THEN 0 ELSE 2 END AS submitters, CASE WHEN o_orderstatus = 'F' THEN 30 END AS days_to_promulgation, CASE WHEN o_orderstatus <> 'P' THEN 9 END AS days_to_final_vote FROM orders""", days=("submitted_on",))
def _(s, d):
    """An order as a bill's record: its properties, and votes of which the last about the bill itself counts."""
    status, p, day = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.col("o_orderdate").cast("date")
    prop = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'<tulajdonsag nev="{name}" ertek="'), value, F.lit('"/>'))).otherwise("")
    on = lambda c: F.date_format(c, "yyyy.MM.dd.")
    by = F.when(p == "1", "kormány (igazságügyi miniszter)").when(p == "2", "Törvényalkotási bizottság").when(p != "3", F.concat(F.lit("Kiss Éva, Nagy "), F.col("o_custkey").cast("string")))
    vote = lambda n, why: F.concat(F.lit("<szavazas><datum>"), F.date_format(F.date_add(day, n), "yyyy.MM.dd.10:00:00"), F.lit(f"</datum><ok>{why}</ok><igen_db>1 00</igen_db></szavazas>"))
    voted = F.when(status != "P", F.concat(vote(4, "önálló indítvány elfogadva"), vote(9, "önálló indítvány elfogadva"), vote(12, "módosító javaslat elutasítva"))).otherwise("")
    bills = b.table(s, d, "orders").select(
        F.col("o_orderkey").alias("key"), prop("Főtípus", F.lit("törvényjavaslat")).alias("a"), prop("Benyújtva", on(day)).alias("b"), prop("Benyújtó(k)", by).alias("c"),
        prop("Tárgyalási mód", F.when(status == "F", "sürgős").when(status == "O", "kivételes eljárás")).alias("e"), F.when(status == "F", F.concat(prop("Kihirdetés dátuma", on(F.date_add(day, 30))), prop("Kihirdetés száma", F.lit("XV")))).otherwise("").alias("f"), voted.alias("v"),
    )
    raw = _payloads(bills, '<iromany szam="T/', F.col("key").cast("string"), '"><cim>Cím</cim><tulajdonsagok>', F.col("a"), F.col("b"), F.col("c"), F.col("e"), F.col("f"), "</tulajdonsagok><szavazasok>", F.col("v"), "</szavazasok></iromany>")
    out = records.bills(raw)
    return out.select("path", "iromany", "number", "procedure_kind", "submitted_on", "law", "submitter_kind", F.size("submitters").alias("submitters"), "days_to_promulgation", "days_to_final_vote")
