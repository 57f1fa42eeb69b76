"""Text reuse and search over speeches."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import text
from plenum.sources.work import cut, small

K1, B = 1.5, 0.75
#: Rows for each part of an exchange: parts grow with the table, a part doesn't.
PART = 500_000


#: Words of documents that a task looks at together.
WORDS = 250_000
#: Multiplier of the rolling hashes: odd, so that it can be divided out again.
ODD = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits of all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _rolled(words: np.ndarray, *lengths: int) -> Iterator[np.ndarray]:
    """For each length the hashes of all runs of so many words, by sums modulo 2^64."""
    powers = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), x, np.uint64)]))
    up, down = powers(ODD), powers(pow(ODD, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * up[:-1])])
    for n in lengths:
        yield _mixed((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` neighbours."""
    have = 1
    while have < n:
        step = min(have, n - have)
        h, have = np.minimum(h[:-step], h[step:]), have + step
    return h


def packed_grams(docs: DataFrame, k: int, doc: str = "doc", speaker: str = "speaker", body: str = "body") -> DataFrame:
    """(doc, speaker, at, anchor, grams): hashes of the runs of k words that begin at ``at`` and after, as far as they share an anchor.

    The anchor of a run is the least hash of the shorter runs (a third of k) inside it: equal runs have equal anchors.
    """
    third = (k + 2) // 3
    rows = docs.select(F.col(doc).alias("doc"), F.col(speaker).alias("speaker"), F.transform(text.words(F.col(body)), lambda w: F.xxhash64(w)).alias("w")).filter(F.size("w") >= k)
    schema = T.StructType([rows.schema["doc"], rows.schema["speaker"], *T._parse_datatype_string("at int, anchor long, grams array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            a, ends = 0, whole.column(2).offsets.to_numpy()
            while a < len(whole):  # pieces of documents with so many words together, or one with more
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + WORDS, side="right")) - 1)
                batch, starts = whole.slice(a, z - a), ends[a : z + 1].astype(np.int64) - ends[a]
                a = z
                grams, shorter = _rolled(batch.column(2).flatten().to_numpy().view(np.uint64), k, third)
                anchor = _least(shorter, k - third + 1)
                owner = np.repeat(np.arange(len(batch)), np.diff(starts))[: len(grams)]
                at = np.arange(len(grams)) - starts[owner]
                kept = np.flatnonzero(at + k <= np.diff(starts)[owner])
                owner, at, anchor, grams = owner[kept], at[kept], anchor[kept].view(np.int64), grams[kept].view(np.int64)
                first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (anchor[1:] != anchor[:-1])])
                of = pa.array(owner[first])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(kept)], pa.int32()), pa.array(grams))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(at[first], pa.int32()), pa.array(anchor[first]), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def grams(docs: DataFrame, k: int, least: int = 1, **names) -> DataFrame:
    """(doc, speaker, at, gram): the hash of every run of k words; with ``least`` of 2 or more only those that several speakers may have said.

    Those are the runs whose anchor several speakers have, a twelfth of the rows to count; a run that one speaker alone said is not shuffled.
    """
    packed = packed_grams(docs, k, **names)
    if least >= 2:
        packed = cut(packed, "grams")
        said = packed.groupBy("anchor").agg(F.min("speaker").alias("one"), F.max("speaker").alias("other")).filter("one <> other").select("anchor")
        packed = packed.join(said, "anchor", "left_semi")
    rows = packed.select("doc", "speaker", "at", F.posexplode("grams").alias("n", "gram"))  # numbers leave a text, not words
    return rows.select("doc", "speaker", (F.col("at") + F.col("n")).alias("at"), "gram")


def echoes(docs: DataFrame, k: int = 30, least: int = 2, **names) -> DataFrame:
    """Runs of k words that ``least`` speakers or more said: gram, occurrences, docs, speakers, first doc."""
    return grams(docs, k, least, **names).groupBy("gram").agg(
        F.count("*").alias("occurrences"), F.count_distinct("doc").alias("docs"), F.count_distinct("speaker").alias("speakers"), F.min("doc").alias("first_doc")
    ).filter(F.col("speakers") >= least)


def echo_runs(docs: DataFrame, k: int = 30, least: int = 2, rows: DataFrame | None = None, **names) -> DataFrame:
    """Maximal passages: neighbouring grams that occur at the same sites, shifted by one, are one run.

    A run is (first doc, place, words, sites, speakers).  Sites that only some of the grams have start a
    run of their own; that rule doesn't depend on the order of rows.  ``rows``: the documents' grams, if they are known.
    """
    rows = cut(grams(docs, k, least, **names), "shared") if rows is None else rows  # read twice
    shared = rows.groupBy("gram").agg(F.count_distinct("speaker").alias("speakers"), F.count("*").alias("sites"), F.min(F.struct("doc", "at")).alias("first")).filter(F.col("speakers") >= least)
    hits = rows.join(shared.select("gram", "first", "sites", "speakers"), "gram")
    # a set of sites as the sums of two hashes of them: 128 bits, summed before the shuffle
    site = ["doc", (F.col("at") - F.col("first.at")).cast("int")]
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    origin = F.struct(wide(F.xxhash64(*site)).alias("a"), wide(F.xxhash64(F.lit(7), *site)).alias("b")).alias("sites_key")
    keyed = hits.groupBy("gram", "first", "sites", "speakers").agg(origin)
    place = keyed.select("gram", "sites", "speakers", "sites_key", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"))
    w = W.partitionBy("doc", "sites", "speakers", "sites_key").orderBy("at")
    runs = place.withColumn("run", F.col("at") - F.row_number().over(w))
    return runs.groupBy("doc", "sites", "speakers", "sites_key", "run").agg(F.min("at").alias("at"), (F.count("*") + k - 1).alias("words")).select("doc", "at", "words", "sites", "speakers")


def echo_records(docs: DataFrame, k: int = 30, least: int = 2) -> DataFrame:
    """A row for each maximal passage of (doc, speaker, body, day, kind, grp), with its text and what its speeches have in common.

    words, passage, sites, speakers, speeches, days, first_day, last_day, lag_days, same_day, same_kind, groups (their number,
    empty ones not counted), one_group.  A missing kind is a kind of its own; without any day there is no lag.
    """
    rows = cut(grams(docs, k, least), "shared")
    runs = cut(echo_runs(docs, k, least, rows), "runs")
    begins = runs.join(rows.select("doc", "at", "gram"), ["doc", "at"])
    sites = begins.select("doc", "at", "gram").join(rows.select("gram", F.col("doc").alias("said")).distinct(), "gram")
    meta = docs.select(F.col("doc").alias("said"), "speaker", "day", "kind", F.when(F.col("grp") != "", F.col("grp")).alias("grp"))
    per = sites.join(meta, "said").groupBy("doc", "at").agg(
        F.count("*").alias("speeches"), F.count_distinct("day").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        (F.count_distinct(F.struct("kind")) == 1).alias("same_kind"), F.count_distinct("grp").alias("groups"),
    )
    text_of = docs.select("doc", text.words(F.col("body")).alias("w"))
    out = runs.join(per, ["doc", "at"]).join(text_of, "doc").withColumn("passage", F.array_join(F.slice("w", F.col("at") + 1, F.col("words").cast("int")), " ")).drop("w")
    return out.withColumns({
        "lag_days": F.datediff("last_day", "first_day"), "same_day": F.col("days") == 1, "one_group": (F.col("groups") == 1) & (F.col("speeches") > 1),
    })


def echo_summary(found: DataFrame) -> DataFrame:
    """One row: echoes, those of one day and of several, of one kind of speech, of one group on several days, across groups."""
    return found.agg(
        F.count("*").alias("echoes"), F.count_if("same_day").alias("same_day"), F.count_if(~F.col("same_day")).alias("later_day"), F.count_if("same_kind").alias("one_kind"),
        F.count_if(F.col("one_group") & ~F.col("same_day")).alias("one_group_later_day"), F.count_if(F.col("groups") > 1).alias("across_groups"),
    )


def echo_top(found: DataFrame, most: int = 400) -> DataFrame:
    """The passages that most speakers said, the longest first among them."""
    return found.orderBy(F.desc("speakers"), F.desc("words"), "doc", "at").limit(most)


def places(towns: DataFrame, typed: str, most: int = 12) -> DataFrame:
    """Towns (name, codes) for what a reader types: four digits are a postcode; else the town of that name (rank 0) and
    ``most`` whose names begin with it (rank 1).  Other numbers and a single letter find nothing."""
    typed = typed.strip()
    if typed.isdigit():
        return towns.filter(F.array_contains("codes", typed) if len(typed) == 4 else F.lit(False)).withColumn("rank", F.lit(0))
    low, wanted = text.fold(F.col("name")), text.fold(F.lit(typed))
    if len(typed) < 2:
        return towns.filter(F.lit(False)).withColumn("rank", F.lit(0))
    exact = towns.filter(low == wanted).withColumn("rank", F.lit(0))
    return exact.unionAll(towns.filter(low.startswith(wanted) & (low != wanted)).orderBy(low, "name").limit(most).withColumn("rank", F.lit(1)))


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it is known to have so many rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` (``n``, about) dealt by ``keys`` in parts of about ``PART`` rows; few rows in as many parts as Spark takes."""
    parts = -(-n // PART)
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys) if parts > usual else rows.repartition(*keys)


def shard_of(token: Column, size: Column, most: int) -> Column:
    """Two letters of a token, or three where that shard has more than ``most`` postings."""
    return F.when(size > most, F.substring(token, 1, 3)).otherwise(F.substring(token, 1, 2))


def inverted(docs: DataFrame, doc: str = "doc", body: str = "body") -> DataFrame:
    """(token, postings): the (doc, tf) of a token in some documents, tf 255 at most; each batch of documents is inverted where it is.

    Rows of one doc count as one document; only such documents are brought together.
    """
    rows = docs.select(F.col(doc).alias("doc"), text.tokens(F.coalesce(F.col(body), F.lit(""))).alias("t"))
    again = cut(rows.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias("again")), "again")
    if not again.isEmpty():
        same = F.col("doc").eqNullSafe(F.col("again"))
        whole = rows.join(again, same, "left_semi").groupBy("doc").agg(F.flatten(F.collect_list("t")).alias("t"))  # a document's rows
        rows = rows.join(again, same, "left_anti").unionByName(whole)
    entry = T.StructType([rows.schema["doc"], T.StructField("tf", T.IntegerType())])
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("postings", T.ArrayType(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            a, ends = 0, whole.column(1).offsets.to_numpy()
            while a < len(whole):  # pieces of documents with so many tokens together, or one with more
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + WORDS, side="right")) - 1)
                batch, owner = whole.slice(a, z - a), np.repeat(np.arange(z - a), np.diff(ends[a : z + 1]))
                a = z
                coded = pc.dictionary_encode(batch.column(1).flatten())
                met, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(batch) + owner, return_counts=True)
                token = met // len(batch)
                first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]][: len(token)])
                entries = pa.StructArray.from_arrays([batch.column(0).take(pa.array(met % len(batch))), pa.array(np.minimum(tf, 255), pa.int32())], names=["doc", "tf"])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(token)], pa.int32()), entries)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(token[first])).cast(pa.string()), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def index_shards(docs: DataFrame, most: int = 5000, block: int = 65_536, **names) -> DataFrame:
    """(shard, token, df, block, postings): the index by shards, postings as arrays of (doc, tf), of about ``block`` at most.

    The postings of a token that more documents have are dealt to several blocks, so that no array and no task has to hold all.  Others are
    shuffled as the arrays that batches of documents gave.
    """
    p = cut(inverted(docs, **names), "inverted")
    tokens = p.groupBy("token").agg(F.sum(F.size("postings")).alias("df"))
    two = F.substring("token", 1, 2).alias("two")
    sizes = tokens.groupBy(two).agg(F.sum("df").alias("size"))
    known = cut(tokens.withColumn("two", two).join(sizes, "two").select("token", "df", shard_of(F.col("token"), F.col("size"), most).alias("shard")), "known")
    keys = ["shard", "token", "df", "block"]
    few = p.join(known.filter(F.col("df") <= block), "token").withColumn("block", F.lit(0))
    few = few.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("postings"))).alias("postings"))
    many = p.join(small(known.filter(F.col("df") > block), known.filter(F.col("df") > block).count()), "token").select("shard", "token", "df", F.explode("postings").alias("posting"))
    many = many.withColumn("block", F.pmod(F.xxhash64("posting.doc"), F.ceil(F.col("df") / block)).cast("int"))
    return few.unionByName(many.groupBy(*keys).agg(F.sort_array(F.collect_list("posting")).alias("postings")))


def every_term(docs: DataFrame, queries: DataFrame, newest: str, doc: str = "doc", body: str = "body", query: str = "query", question: str = "question") -> DataFrame:
    """The older search: documents that have every term, the newest first."""
    terms = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(text.tokens(F.col(question)))).alias("token"))
    n = terms.groupBy("query").agg(F.count("*").alias("terms"))
    asked = bounded(terms.select("token").distinct())
    words = docs.select(F.col(doc).alias("doc"), F.explode(F.array_distinct(text.tokens(F.col(body)))).alias("token"))
    hits = words.join(asked, "token", "left_semi").join(terms, "token").groupBy("query", "doc").agg(F.count("*").alias("found"))
    return hits.join(n, "query").filter("found = terms").join(docs.select(F.col(doc).alias("doc"), F.col(newest).alias("newest")), "doc").select("query", "doc", "newest")


#: Questions meet texts on so many neighbouring words, less where they have fewer.
ANCHOR = 4


def containing(docs: DataFrame, questions: DataFrame, doc: str = "doc", body: str = "body", query: str = "query", question: str = "question", on: tuple[str, ...] = ()) -> DataFrame:
    """(query, doc, *on): the texts that hold a question's text, to the letter; both sides have the columns ``on`` if any.

    All words of a question but its first and last stand in such a text as whole words, so they meet on the hash of some of them, an
    equality, and only those pairs are looked through.  Questions of one or two words, which have none inside, meet every text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    asked = questions.select(*on, F.col(query).alias("query"), F.col(question).alias("q")).filter("q <> ''").withColumn("w", words(F.col("q")))
    inner = asked.withColumn("k", F.least(F.size("w") - 2, F.lit(ANCHOR))).withColumn("gram", F.when(F.col("k") > 0, F.xxhash64(F.array_join(F.slice("w", 2, F.col("k")), " "))))
    texts = docs.select(*on, F.col(doc).alias("doc"), F.col(body).alias("t"))
    sizes = sorted(r.k for r in inner.filter("k > 0").select("k").distinct().collect())  # ANCHOR at most
    out = None
    for k in sizes:
        anchors = inner.filter(F.col("k") == k).select(*on, "query", "q", "gram")
        grams = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, k), " ")))  # noqa: B023
        met = texts.withColumn("w", words(F.col("t"))).filter(F.size("w") >= k).select(*on, "doc", F.explode(F.array_distinct(grams)).alias("gram"))
        pairs = met.join(bounded(anchors.select(*on, "gram", "query")), [*on, "gram"]).select(*on, "doc", "query")
        one = pairs.join(asked.select(*on, "query", "q"), [*on, "query"]).join(texts, [*on, "doc"]).filter(F.col("t").contains(F.col("q")))
        out = one if out is None else out.unionByName(one)
    short = inner.filter("k <= 0").select(*on, "query", "q")
    if not short.isEmpty():
        one = short.join(texts, list(on)) if on else short.crossJoin(texts)
        one = one.filter(F.col("t").contains(F.col("q")))
        out = one.select(*on, "query", "q", "doc", "t") if out is None else out.unionByName(one.select(*out.columns))
    if out is None:
        return questions.limit(0).join(docs.limit(0), list(on)).select(F.col(query).alias("query"), F.col(doc).alias("doc"), *on) if on else questions.limit(0).crossJoin(docs.limit(0)).select(F.col(query).alias("query"), F.col(doc).alias("doc"))
    return out.select("query", "doc", *on).distinct()


# Short words that readers type, and what they stand for.
SHORT = {
    "btk": "bunteto torvenykonyv", "ptk": "polgari torvenykonyv", "szja": "szemelyi jovedelemado", "tao": "tarsasagi ado",
    "gdpr": "adatvedelmi", "mnb": "magyar nemzeti bank", "hhsz": "hazszabaly", "afa": "altalanos forgalmi ado",
}


def variants(word: Column) -> Column:
    """A folded word and what else it is looked up as: what a short word stands for, the stem of a long word in -elem or
    -alom with its m, and a bill's number with a slash ('t961')."""
    meant = F.try_element_at(F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv]), word)
    stem = F.when((F.length(word) >= 6) & word.rlike("(elem|alom)$"), F.concat(F.substring(word, F.lit(1), F.length(word) - 2), F.lit("m")))
    bill = F.when(word.rlike("^[a-z]{1,2}[0-9]+$"), F.regexp_replace(word, "^([a-z]+)([0-9]+)$", "$1/$2"))
    return F.array_compact(F.array(word, meant, stem, bill))


def question_set(titles: DataFrame, docs: DataFrame, title_over: int = 40, body_least: int = 600, docs_least: int = 3) -> DataFrame:
    """(bill, title, docs): the questions a search can be judged by, from (bill, title) and documents (bill, body).

    A bill's question is its first title of more than ``title_over`` characters (by ``at``, if there is such a column); it counts if
    ``docs_least`` documents or more of at least ``body_least`` characters are about the bill.
    """
    at = F.struct("at", "title") if "at" in titles.columns else F.col("title")
    long = titles.filter(F.length("title") > title_over).groupBy("bill").agg(F.min_by("title", at).alias("title"))
    n = docs.filter((F.col("bill") != "") & (F.length("body") >= body_least)).groupBy("bill").agg(F.count("*").alias("docs")).filter(F.col("docs") >= docs_least)
    return n.join(long, "bill").select("bill", "title", "docs")


def directory_score(typed: list[list[str]], long_field: Column, short_field: Column) -> Column:
    """Every word of ``typed`` (with its variants) must occur: 4 each for the word itself, and 3, 2 or 1 if the short field is it, begins with it or has it."""
    long_, short = text.fold(long_field), text.fold(short_field)
    total, every = F.lit(0), F.lit(True)
    for variants in typed:
        word = variants[0]
        anywhere = None
        for v in variants:
            anywhere = long_.contains(v) if anywhere is None else anywhere | long_.contains(v)
        every = every & anywhere
        total = total + F.when(long_.contains(word), 4).otherwise(0) + F.when(short == word, 3).when(short.startswith(word), 2).when(short.contains(word), 1).otherwise(0)
    return F.when(every, total)


@F.pandas_udf(T.IntegerType())
def damerau(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance in which swapping two neighbours is one edit; no builtin has it."""

    def one(x, y):
        if x is None or y is None:
            return None
        before, last = None, list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i]
            for j, d in enumerate(y, 1):
                best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, before[j - 2] + 1)
                row.append(best)
            before, last = last, row
        return last[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def _cut_keys(words: DataFrame, edits: int) -> DataFrame:
    """(word, n, key): hashes of a word (word, n) and of what is left of it without one letter, or two if ``edits`` is 2."""
    schema = T.StructType([words.schema["word"], words.schema["n"], T.StructField("key", T.LongType())])
    odd, back = np.uint64(ODD), np.uint64(pow(ODD, -1, 1 << 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes = np.array([len(x) for x in texts], np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                for part in np.array_split(rows, -(-len(rows) * (size * size // 2 + 1) // 1_000_000)):
                    letters = np.array([[ord(c) for c in texts[r]] for r in part], np.uint64).reshape(len(part), size)
                    up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, odd)]))
                    sums = np.concatenate([np.zeros((len(part), 1), np.uint64), np.cumsum(_mixed(letters + np.uint64(1)) * up, axis=1, dtype=np.uint64)], 1)
                    whole = sums[:, size]
                    keys = [whole, *(sums[:, i] + (whole - sums[:, i + 1]) * back for i in range(size))]
                    if edits == 2:
                        keys += [sums[:, i] + (sums[:, j] - sums[:, i + 1]) * back + (whole - sums[:, j + 1]) * back * back for i in range(size) for j in range(i + 1, size)]
                    table = np.sort(np.stack(keys, 1), 1)
                    kept = np.concatenate([np.ones((len(part), 1), bool), table[:, 1:] != table[:, :-1]], 1)  # letters that repeat leave the same
                    row, at = np.nonzero(kept)
                    of = pa.array(part[row])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(_mixed(table[row, at]).view(np.int64))], names=["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, schema)


def _nearest(asked: DataFrame, known: DataFrame, edits: int, itself: bool) -> DataFrame:
    """(asked, word, d) for words (word, n) that have one within ``edits``: the nearest, of these the most frequent, then the first."""
    mine = _cut_keys(asked, edits).select(F.col("word").alias("asked"), "key")
    # plans don't know how many keys a word has: words with a million keys together are broadcast at most
    mine = F.broadcast(mine) if asked.count() <= (100_000 if edits == 1 else 15_000) else mine.hint("merge")
    met = mine.join(_cut_keys(known, edits), "key").filter(F.abs(F.length("asked") - F.length("word")) <= edits)
    met = met if itself else met.filter("asked <> word")
    # d edits with swaps are 2 d without at most: most that meet are told apart here
    pairs = met.filter(F.levenshtein("asked", "word", 2 * edits) >= 0).groupBy("asked", "word").agg(F.max("n").alias("n"))
    best = F.min(F.struct("d", (-F.col("n")).alias("neg"), "word")).alias("b")
    return pairs.withColumn("d", damerau("asked", "word")).filter(F.col("d") <= edits).groupBy("asked").agg(best).select("asked", F.col("b.word").alias("word"), F.col("b.d").alias("d"))


def did_you_mean(words: DataFrame, vocabulary: DataFrame, itself: bool = True) -> DataFrame:
    """For each unknown word the nearest vocabulary word (word, n) within one edit, two from eight letters on.

    Without ``itself``, a word that is in the vocabulary too is not its own suggestion.
    Candidates share a cut-out of the word: with two words within d edits, some cut-outs of at most d letters are equal, so they meet
    on the equality of hashes and are then measured.  Two edits, with their many cut-outs, are for the words that have nothing within one.
    """
    known = cut(vocabulary.filter(F.length("word") >= 4), "vocabulary")
    asked = cut(words.filter(F.length("word") >= 3).select("word").distinct().withColumn("n", F.lit(0)), "asked")
    one = cut(_nearest(asked, known, 1, itself), "near")
    left = cut(asked.filter(F.length("word") >= 8).join(one.select(F.col("asked").alias("word")), "word", "left_anti"), "left")
    return one.unionByName(_nearest(left, known.filter(F.length("word") >= 6), 2, itself))


def rising_run(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The longest strictly increasing run of values in reading order of each key: (key, order, value).

    Rows stream through a task sorted by key and order, and a task holds those of one key; rows without a value are in no run.
    """
    these = rows.select(key, order, value)

    def longest(at: list, values: list) -> list[int]:
        tails, ends, back = [], [], []
        for i, v in enumerate(values):
            k = bisect.bisect_left(tails, v)
            back.append(ends[k - 1] if k else -1)
            tails[k : k + 1], ends[k : k + 1] = [v], [i]
        out, i = [], ends[-1] if ends else -1
        while i >= 0:
            out.append(i)
            i = back[i]
        return out[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, values, schema = None, [], [], None
        out: list[list] = [[], [], []]

        def close():
            kept = longest(at, values)
            out[0].extend([now] * len(kept))
            out[1].extend([at[i] for i in kept])
            out[2].extend([values[i] for i in kept])
            at.clear(), values.clear()

        def made():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            schema = batch.schema
            for k, o, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    close()
                    now = k
                at.append(o)
                values.append(v)
            if out[0]:
                yield made()
        close()
        if out[0]:
            yield made()

    some = these.filter(F.col(value).isNotNull())
    return dealt(some, rows.count(), key).sortWithinPartitions(F.col(key), F.asc_nulls_last(order), F.col(value)).mapInArrow(run, these.schema)
