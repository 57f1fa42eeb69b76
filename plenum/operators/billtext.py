"""The structure of a bill's text: where its units start, which page a citation means, and where a quote stands.

Pages are rows (bill, page, body); nothing needs a bill whole.  Headings are found line by line; what runs on over pages (that an
annex has begun, that the reasoning has) is a running last value over the few lines that look like headings.  Quotes that run
on over pages are found by a stream over each bill's pages, backwards, that carries as much of the text as the longest
quote has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.operators.textual import containing
from plenum.sources.work import cut

# How the lines look at which units, annexes, articles and the reasoning begin, and a page's number.
SECTION = r"(?U)^\s*(\d+)\.\s*§(?!-)(.*)$"
ANNEX = r"(?iU)^\s*(\d+)\.\s*melléklet\s+a\s+20\d\d\.\s*évi\s*[.…\s]+törvényhez"
ARTICLE = r"(?iU)^\s*(\d+)\.\s*cikk\b(.*)$"
REASONS = r"(?iU)^\s*(?:(?:általános|részletes)\s+)?indokolás\s*$"
FOOTER = r"(?mU)^[^\S\n]*\d{1,4}[^\S\n]*$\n?"
# What a citation looks like.
CITE_ANNEX = r"(?iU)^\s*(\d+)\.\s*melléklet\b[\s,]*(?:(\d+)\.\s*cikk\b)?"
CITE_UNIT = r"(?iU)^\s*(\d+)\.?\s*(?:[–-]\s*\d+\.)?\s*(§|cikk\b)"


def lines(pages: DataFrame) -> DataFrame:
    """(bill, page, line, text) of pages (bill, page, body); a null body has no lines."""
    return pages.select("bill", "page", F.posexplode(F.split("body", "\n")).alias("line", "text"))


def reasons(pages: DataFrame) -> DataFrame:
    """(bill, at): page and line where the submitter's reasoning begins, never on a bill's first page."""
    # pages without the word are not cut into lines
    begins = lines(pages.filter(F.lower("body").contains("ndokol"))).filter(F.col("text").rlike(REASONS))
    first = pages.join(begins.select("bill").distinct(), "bill", "left_semi").groupBy("bill").agg(F.min("page").alias("first"))
    begins = begins.join(first, "bill").filter("page > first")
    return begins.groupBy("bill").agg(F.min(F.struct("page", "line")).alias("at"))


def heads_line(rest: Column) -> Column:
    """Whether what follows a unit's number makes a heading: nothing, a bracket, a capital, or '(1)' and no small letter."""
    rest = F.trim(rest)
    upper, lower = r"^\p{Lu}", r"^\(\s*1\s*\)\s*\p{Ll}"
    return (rest == "") | rest.startswith("[") | rest.rlike(upper) | (rest.rlike(r"^\(\s*1\s*\)\s*\S") & ~rest.rlike(lower))


def headings(pages: DataFrame) -> DataFrame:
    """(bill, page, line, kind, number, annex): lines of the bill proper at which a unit may start.

    kind is section, article or annex; annex is the annex that had begun before the line, over all earlier pages, and 0 in the
    bill's body, where only lines shaped like a heading count.
    """
    t = F.col("text")
    kind = F.when(t.rlike(ANNEX), "annex").when(t.rlike(SECTION), "section").when(t.rlike(ARTICLE), "article")
    pattern = lambda p, n: F.regexp_extract("text", p, n)
    number = F.when(F.col("kind") == "annex", pattern(ANNEX, 1)).when(F.col("kind") == "section", pattern(SECTION, 1)).otherwise(pattern(ARTICLE, 1))
    rest = F.when(F.col("kind") == "section", pattern(SECTION, 2)).when(F.col("kind") == "article", pattern(ARTICLE, 2)).otherwise("")
    rows = lines(pages).withColumn("kind", kind).filter("kind is not null").withColumns({"number": number.try_cast("int"), "rest": rest}).filter("number is not null")
    end = reasons(pages)
    rows = rows.join(end, "bill", "left").filter(F.col("at").isNull() | (F.struct("page", "line") < F.col("at")))
    # a line is "5. § ..." or "3. cikk ...", so what stands before an annex is few rows a bill
    so_far = W.partitionBy("bill").orderBy("page", "line").rowsBetween(W.unboundedPreceding, -1)
    annex = F.coalesce(F.last(F.when(F.col("kind") == "annex", F.col("number")), ignorenulls=True).over(so_far), F.lit(0))
    rows = rows.withColumn("annex", annex)
    kept = (F.col("kind") == "annex") | ((F.col("annex") > 0) & (F.col("kind") == "article")) | ((F.col("annex") == 0) & heads_line(F.col("rest")))
    return rows.filter(kept).select("bill", "page", "line", "kind", "number", "annex")


def growing(numbers: list[int]) -> list[int]:
    """Places of the longest strictly growing run: of several the one that ends first, and whose members come first."""
    best, back = [1] * len(numbers), [-1] * len(numbers)
    for k, n in enumerate(numbers):
        for j in range(k):
            if numbers[j] < n and best[j] >= best[k]:
                best[k], back[k] = best[j] + 1, j
    out, at = [], best.index(max(best)) if best else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def units(pages: DataFrame) -> DataFrame:
    """(bill, kind, annex, number, page): where each unit starts.

    Sections (or articles, in a bill without sections) of the body are the longest run of numbers that only grows, since a heading
    quoted from another law breaks the run; annexes, and the articles inside an annex, start where they are first headed.
    """
    found = cut(headings(pages), "headings")  # few lines of a text, read five times below
    body = found.filter("annex = 0 and kind <> 'annex'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [growing([h["number"] for h in heads]) for heads in batch.column("heads").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("bill"), batch.column("kind"), batch.column("heads"), pa.array(kept, pa.list_(pa.int32()))], names=["bill", "kind", "heads", "kept"])

    # one bill's headings of one kind are in a row: their number is that of its units
    heads = body.groupBy("bill", "kind").agg(F.sort_array(F.collect_list(F.struct("page", "line", "number"))).alias("heads"))
    packed = heads.mapInArrow(run, T.StructType([*heads.schema.fields, T.StructField("kept", T.ArrayType(T.IntegerType()))]))
    each = packed.select("bill", "kind", F.explode(F.transform("kept", lambda k: F.get("heads", k))).alias("h"))
    runs = each.select("bill", "kind", F.col("h.number").alias("number"), F.col("h.page").alias("page"))
    sections = runs.filter("kind = 'section'")
    articles = runs.filter("kind = 'article'").join(sections.select("bill").distinct(), "bill", "left_anti")
    first = lambda rows, *keys: rows.groupBy(*keys).agg(F.min("page").alias("page"))
    annexes = first(found.filter("kind = 'annex'"), "bill", "number").withColumn("annex", F.lit(0))
    inside = first(found.filter("kind = 'article' and annex > 0"), "bill", "annex", "number")
    shape = lambda rows, kind: rows.select("bill", F.lit(kind).alias("kind"), "annex", "number", "page")
    out = shape(sections.withColumn("annex", F.lit(0)), "section").unionByName(shape(articles.withColumn("annex", F.lit(0)), "article"))
    return out.unionByName(shape(annexes, "annex")).unionByName(shape(inside, "annex article"))


def cited_pages(cites: DataFrame, found: DataFrame) -> DataFrame:
    """``cites`` (bill, cite, ...) with page: where the first unit that a citation names starts, null if that can't be said.

    A section or article whose heading the text lost is placed only if the units either side of it start on the same page.
    """
    c = F.col("cite")
    annex = F.regexp_extract(c, CITE_ANNEX, 1).try_cast("int")
    inner = F.regexp_extract(c, CITE_ANNEX, 2).try_cast("int")
    number, sign = F.regexp_extract(c, CITE_UNIT, 1).try_cast("int"), F.regexp_extract(c, CITE_UNIT, 2)
    kinds = F.when(c.rlike(CITE_ANNEX), F.when(inner.isNotNull(), "annex article").otherwise("annex")).when(sign == "§", "section").when(c.rlike(CITE_UNIT), "article")
    asked = cites.withColumn("__row", F.monotonically_increasing_id()).select(
        "*", kinds.alias("__kind"), F.when(c.rlike(CITE_ANNEX), F.coalesce(inner, annex)).otherwise(number).alias("__number"),
        F.when(inner.isNotNull(), annex).otherwise(0).alias("__annex"),
    )
    found = cut(found, "units")  # read twice below
    has = found.filter("kind = 'article'").select("bill").distinct().withColumn("__own", F.lit(True))
    asked = asked.join(has, "bill", "left")
    other = (F.col("__kind") == "article") & F.col("__own").isNull()  # without articles of its own, the first annex's are meant
    asked = asked.withColumns({"__annex": F.when(other, 1).otherwise(F.col("__annex")), "__kind": F.when(other, "annex article").otherwise(F.col("__kind"))})
    u = found.select(F.col("bill").alias("__bill"), F.col("kind").alias("__k"), F.col("annex").alias("__a"), F.col("number").alias("__n"), F.col("page").alias("__p"))
    near = asked.join(u, (asked.bill == u["__bill"]) & (asked["__kind"] == u["__k"]) & (asked["__annex"] == u["__a"]), "left")
    n, wanted = F.col("__n"), F.col("__number")
    spots = near.groupBy("__row").agg(
        F.max(F.when(n == wanted, F.col("__p"))).alias("exact"),
        F.max_by("__p", F.when(n < wanted, n)).alias("low"), F.min_by("__p", F.when(n > wanted, n)).alias("high"),
    )
    between = F.when(F.col("__kind").isin("section", "article") & (F.col("low") == F.col("high")), F.col("low"))
    out = asked.join(spots, "__row")
    return out.select(*cites.columns, F.coalesce("exact", between).alias("page"))


def normalised(c: Column) -> Column:
    """Text as quotes are compared: no page numbers, soft hyphens, hyphens or quotation marks; blanks as one."""
    c = F.regexp_replace(F.regexp_replace(c, "­", ""), FOOTER, "\n")
    c = F.regexp_replace(c, r"(?U)-\s*\n\s*", "")
    c = F.regexp_replace(c, ",,|''|[„”“\"«»‚’'\\-–]", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def with_ahead(pages: DataFrame, most: int) -> DataFrame:
    """(bill, page, own, ahead): a page's normalised text with a blank behind it, and ``most`` characters of what follows.

    Pages stream through a task from a bill's last to its first; the task holds the text ahead, not the bill.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col("bill").cast("string").alias("bill"), F.col("page").cast("long").alias("page"), F.concat(normalised(F.coalesce("body", F.lit(""))), F.lit(" ")).alias("own"))
    rows = rows.repartition(parts, "bill").sortWithinPartitions("bill", F.desc("page"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tail = object(), ""
        for batch in batches:
            ahead = []
            for bill, own in zip(batch.column("bill").to_pylist(), batch.column("own").to_pylist(), strict=True):
                tail = tail if bill == at else ""
                at = bill
                ahead.append(tail)
                tail = (own + tail)[:most]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ahead, pa.string())], names=["bill", "page", "own", "ahead"])

    return rows.mapInArrow(stream, "bill string, page long, own string, ahead string")


def quoted_pages(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(bill, quote, page, problem) for (bill, quote): the page where the quote starts, in the reasoning if it stands there.

    problem is 'not verbatim', or 'not from the reasoning' where the bill has one and the quote stands before it only, else null.  An
    empty quote is not verbatim.
    """
    asked = quotes.select(F.col("bill").cast("string").alias("bill"), "quote", normalised(F.coalesce("quote", F.lit(""))).alias("q")).distinct()
    most = asked.agg(F.max(F.length("q"))).first()[0] or 0
    begins = reasons(pages).select(F.col("bill").cast("string").alias("bill"), F.col("at.page").cast("long").alias("from"))
    text = with_ahead(pages.join(asked.select("bill").distinct(), "bill", "left_semi"), most)
    text = cut(text.withColumn("text", F.concat("own", "ahead")), "ahead")  # read three times below
    pairs = containing(text, asked.withColumn("id", F.col("q")), doc="page", body="text", query="id", question="q", on=("bill",))
    met = pairs.join(asked.filter("q <> ''"), (pairs["query"] == asked["q"]) & (pairs["bill"] == asked["bill"])).select(pairs["bill"], "quote", "q", F.col("doc").alias("page"))
    met = met.join(text, ["bill", "page"])
    place = F.expr("instr(text, q)")
    hits = met.filter((place > 0) & (place <= F.length("own"))).join(begins, "bill", "left")
    spots = hits.groupBy("bill", "quote").agg(F.min("page").alias("any"), F.min(F.when(F.col("page") >= F.col("from"), F.col("page"))).alias("inside"))
    out = asked.join(spots, ["bill", "quote"], "left").join(begins, "bill", "left")
    page = F.coalesce("inside", "any")
    problem = F.when(page.isNull(), "not verbatim").when(F.col("from").isNotNull() & (page < F.col("from")), "not from the reasoning")
    return out.select("bill", "quote", page.alias("page"), problem.alias("problem"))


def cite_problems(cites: DataFrame) -> DataFrame:
    """``cites`` with problem: null for a section, article or annex; else what it is."""
    low = F.lower("cite")
    own = F.col("cite").rlike(r"(?iU)^\s*\d+\.?\s*(?:[–-]\s*\d+\.)?\s*(§|melléklet|cikk\b)")
    return cites.withColumn("problem", F.when(low.contains("indokol"), "the reasoning").when(~F.coalesce(own, F.lit(False)), "no unit of the bill"))


def without_annexes(pages: DataFrame) -> DataFrame:
    """Pages of long bills as they are read whole: those from the first annex to the reasoning are blank, numbers stay."""
    first = units(pages).filter("kind = 'annex'").groupBy("bill").agg(F.min("page").alias("__first"))
    ends = reasons(pages).select("bill", F.col("at.page").alias("__end"))
    both = pages.join(first, "bill", "left").join(ends, "bill", "left")
    cut = (F.col("page") >= F.col("__first")) & (F.col("__end").isNull() | ((F.col("page") < F.col("__end")) & (F.col("__first") < F.col("__end"))))
    return both.select("bill", "page", F.when(F.coalesce(cut, F.lit(False)), "").otherwise(F.col("body")).alias("body"))
