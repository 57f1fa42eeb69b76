"""Running the record: freshness, late answers, rotation, links, traffic, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of robots, in the order in which they are tried.
ROBOTS: list[tuple[str, str]] = [
    ("Googlebot", r"Googlebot|Google-InspectionTool|Storebot-Google"),
    ("Bingbot", r"bingbot|BingPreview|adidxbot"),
    ("GPTBot", r"GPTBot"),
    ("ClaudeBot", r"ClaudeBot|Claude-Web|anthropic-ai"),
    ("CCBot", r"CCBot"),
    ("PerplexityBot", r"PerplexityBot"),
    ("Applebot", r"Applebot"),
    ("YandexBot", r"YandexBot"),
    ("DuckDuckBot", r"DuckDuckBot|DuckAssistBot"),
    ("SeznamBot", r"SeznamBot"),
    ("AhrefsBot", r"AhrefsBot"),
    ("SemrushBot", r"SemrushBot"),
    ("MJ12bot", r"MJ12bot"),
    ("Bytespider", r"Bytespider"),
    ("Meta", r"meta-externalagent|facebookexternalhit"),
    ("Twitter", r"Twitterbot"),
    ("feed reader", r"Feedly|Inoreader|NewsBlur|Miniflux|FreshRSS|Tiny Tiny RSS"),
    ("monitor", r"UptimeRobot|Pingdom|StatusCake|curl/|wget|python-requests|okhttp|Go-http-client"),
    ("other robot", r"[Bb]ot\b|[Ss]pider|[Cc]rawler|scrapy|HeadlessChrome"),
]


def robot(agent: Column) -> Column:
    """The first class of robots whose pattern the agent matches; null for a reader."""
    out = None
    for name, pattern in ROBOTS:
        hit = agent.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# Fixed value: what in a path only a scanner asks for.
PROBES = r"(?i)/\.|\.env|config|wp-|\.php|/api/|/admin|/cgi|actuator|server-status|debug/|/v2/|/-/"


def views(log: DataFrame, pages: Column, assets: str, hosts: tuple[str, ...], beacon: str | None = None, probes: str = PROBES) -> DataFrame:
    """(day, ip, agent, path, referrer, method): the page views of readers of a log (day, ip, agent, path, referrer, and verb, status, query).

    Robots are left out, and scanners: whoever (ip, agent) asked for a path that matches ``probes`` anywhere in the log.  Where the
    log has requests for ``beacon``, each is a view of the page that its query names (p, and r for the host it came from); else
    a view is an answered page of a reader, who has loaded an asset or come from a host that isn't one of ``hosts``.
    """
    rows = log.withColumn("robot", robot(F.coalesce("agent", F.lit("")))).filter("robot is null").drop("robot")
    who = ["ip", "agent"]
    same = lambda a, b: F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))
    scanners = log.filter(F.col("path").rlike(probes)).select(*who).distinct()
    rows = rows.alias("a").join(scanners.alias("b"), same("ip", "ip") & same("agent", "agent"), "left_anti")
    columns = ["day", *who, "path", "referrer", "method"]
    if beacon is not None:
        asked = rows.filter(F.col("path") == beacon)
        if not asked.limit(1).isEmpty():
            part = lambda name: F.url_decode(F.nullif(F.regexp_extract(F.concat(F.lit("&"), F.url_decode("query")), f"[?&]{name}=([^&]*)", 1), F.lit("")))
            path, host = F.coalesce(part("p"), F.lit("/")), part("r")
            counted = asked.select("day", *who, path.alias("path"), F.concat(F.lit("https://"), host, F.lit("/")).alias("referrer"), F.lit("beacon").alias("method"))
            return counted.filter(F.col("path").startswith("/"))
    host = F.lower(F.parse_url("referrer", F.lit("HOST")))
    own = F.lit(False)
    for h in hosts:
        own = own | host.endswith(h)
    outside = pages & host.isNotNull() & (host != "") & ~own
    readers = rows.filter(F.col("path").rlike(assets) | outside).select(*who).distinct()
    answered = pages & (F.coalesce("verb", F.lit("GET")) == "GET") & F.coalesce(F.col("status").isin("200", "304"), F.lit(True))
    seen = rows.filter(answered).alias("a").join(readers.alias("b"), same("ip", "ip") & same("agent", "agent"), "left_semi")
    return seen.withColumn("method", F.lit("log")).select(*columns)


def traffic(seen: DataFrame, heavy: int = 150) -> DataFrame:
    """(day, readers, pages, heavy, heavy_pages) of page views: those of more than ``heavy`` views in the whole log are counted apart."""
    per = seen.groupBy("day", "ip", "agent").agg(F.count("*").alias("n"))
    total = per.groupBy("ip", "agent").agg(F.sum("n").alias("all"))
    both = per.alias("a").join(total.alias("b"), F.col("a.ip").eqNullSafe(F.col("b.ip")) & F.col("a.agent").eqNullSafe(F.col("b.agent"))).select("day", "n", "all")
    much = F.col("all") > heavy
    return both.groupBy("day").agg(
        F.count_if(~much).alias("readers"), F.sum(F.when(~much, F.col("n")).otherwise(0)).alias("pages"), F.count_if(much).alias("heavy"), F.sum(F.when(much, F.col("n")).otherwise(0)).alias("heavy_pages")
    )


def referrers(seen: DataFrame, hosts: tuple[str, ...], heavy: int = 150) -> DataFrame:
    """(host, views): the hosts that readers came from, ``www.`` left out; not the site's own, nor of heavy readers."""
    w = seen.groupBy("ip", "agent").agg(F.count("*").alias("all")).filter(F.col("all") <= heavy)
    rows = seen.alias("a").join(w.alias("b"), F.col("a.ip").eqNullSafe(F.col("b.ip")) & F.col("a.agent").eqNullSafe(F.col("b.agent")), "left_semi")
    host = F.regexp_replace(F.lower(F.parse_url("referrer", F.lit("HOST"))), r"^www\.", "")
    rows = rows.withColumn("host", host).filter("host is not null and host <> ''")
    for h in hosts:
        rows = rows.filter(~F.col("host").endswith(h))
    return rows.groupBy("host").agg(F.count("*").alias("views"))


def freshness(state: DataFrame, now: Column, stale_hours: int = 48) -> DataFrame:
    """status of (sitting_days array<date>, newest_vote timestamp, last_sync timestamp): in this order, empty, unknown (no
    list, or none of its days has come), behind (a sitting day up to today is after the newest vote's), stale, current."""
    occurred = F.filter("sitting_days", lambda d: d <= now.cast("date"))
    missed = F.filter(occurred, lambda d: d > F.col("newest_vote").cast("date"))
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_sync")) / 3600
    return state.withColumns({"missed": F.size(missed), "sync_hours": age}).withColumn(
        "status",
        F.when(F.col("newest_vote").isNull(), "empty").when(F.coalesce(F.size(occurred), F.lit(0)) <= 0, "unknown").when(F.size(missed) > 0, "behind")
        .when(F.col("last_sync").isNull() | (age > stale_hours), "stale").otherwise("current"),
    )


def ask_again(day: Column, rows: Column, refreshed: Column, today: Column, days: int = 45) -> Column:
    """An empty answer for a day that has sat is asked for again for 45 days, once a run."""
    return (rows == 0) & ~refreshed & (day < today) & (F.datediff(today, day) <= days)


def rotation(items: DataFrame, state: DataFrame, key: str, n: int) -> DataFrame:
    """The n items checked longest ago; those never checked come first."""
    return items.join(state, key, "left").orderBy(F.col("checked").asc_nulls_first(), key).limit(n)


# How references begin that aren't the site's own files, and files that pages offer for download.
ELSEWHERE = r"^(?:https?://|mailto:|data:|#|//|javascript:)"
TWINS = r"\.(?:csv|json|xml|parquet|csv\.gz)$"


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, href): the distinct references of each page (href, src and poster, in either quotes), without fragment and query."""
    pattern = r"""\b(?:href|src|poster)\s*=\s*(?:"([^"]+)"|'([^']+)')"""
    double, single = (F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(k)) for k in (1, 2))
    found = F.transform(F.concat(double, single), lambda x: F.regexp_extract(x, r"^[^#?]*", 0))
    return pages.select(F.col(id_col).alias("page"), F.explode(F.array_distinct(found)).alias("href")).filter("href <> ''")


def resolved(href: Column, folder: Column) -> Column:
    """The file a reference names, from the folder of its page: '.' and '..' worked out, escapes decoded; '..' first if it leaves the site."""
    whole = F.when(href.startswith("/"), F.ltrim(href, F.lit("/"))).otherwise(F.concat_ws("/", F.when(folder != "", folder), href))
    parts = F.filter(F.split(whole, "/"), lambda x: (x != "") & (x != "."))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    path = F.array_join(F.aggregate(parts, none, step), "/")
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def broken(found: DataFrame, files: DataFrame) -> DataFrame:
    """Local links that name no file: href, pages that have it, and the first of them."""
    local = found.filter(~F.col("href").rlike(ELSEWHERE) & ~F.col("href").rlike("^[a-z]+:"))
    return local.join(files, "href", "left_anti").groupBy("href").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("first_page"))


def broken_references(pages: DataFrame, files: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """(kind, n, twins, example): references of pages (path, html) to files (path) that don't exist, by the kind of file they name.

    kind is the extension, or 'escapes the site root', or 'no extension'; ``twins`` are those that offer data for download.
    """
    found = links(pages, path, html).filter(~F.col("href").rlike(ELSEWHERE))
    folder = F.regexp_replace("page", r"/?[^/]*$", "")
    named = found.withColumn("target", resolved(F.col("href"), folder))
    lost = named.join(files.select(F.col("path").alias("target")), "target", "left_anti")
    last = F.element_at(F.split("target", "/"), -1)
    kind = F.when(F.col("target").startswith(".."), "escapes the site root").when(last.contains("."), F.regexp_extract(last, r"\.([^.]*)$", 1)).otherwise("no extension")
    example = F.concat_ws(" → ", "page", "href")
    return lost.groupBy(F.when(kind == "", "no extension").otherwise(kind).alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.col("href").rlike(TWINS)).alias("twins"), F.min(example).alias("example"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the number of rows of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.union(part)
    return out


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(value, n): how many rows have each value of a column."""
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def sectors(seats: DataFrame) -> DataFrame:
    """Seats (sector, row, seat, grp, member): members by sector and group, doubly taken seats, and where each sector leans."""
    twice = seats.groupBy("sector", "row", "seat").agg(F.count("*").alias("n")).groupBy("sector").agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    per = seats.groupBy("sector").agg(F.count("*").alias("members"), F.count_distinct("grp").alias("groups"), F.max("row").alias("rows"), F.avg("seat").alias("mean_seat"))
    return per.join(twice, "sector")
