"""Ranking documents for many questions at once by BM25 with prefix terms, in passes over the documents.

A term of a question counts every token that begins with it.  The questions' terms, bounded in number, are known to every task, and
documents stay where they are: a pass finds each batch's distinct tokens once, the terms they begin with, and sums by document and
question.  Only counts a term, or the best documents a question and task, are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenum.functions import text
from plenum.operators.textual import K1, B
from plenum.sources.work import cut, small

#: Rows of (question, term) that tasks know; more questions are ranked in several goes.
TERMS = 500_000
#: Numbers of a table of scores, documents by questions, that a task has at a time.
CHUNK = 2_000_000
#: Tokens of documents that a task looks at together.
TOKENS = 250_000
SHORTEST = 3


class Asked:
    """The questions' terms: which questions have a term, and how often."""

    def __init__(self, rows: list[tuple[int, str, int]]):
        self.questions = sorted({q for q, _, _ in rows})
        number = {q: k for k, q in enumerate(self.questions)}
        self.terms = {t: k for k, t in enumerate(sorted({t for _, t, _ in rows}))}
        order = sorted((self.terms[t], number[q], n) for q, t, n in rows)
        self.of = np.array([q for _, q, _ in order], dtype=np.int64)
        self.times = np.array([n for _, _, n in order], dtype=float)
        self.start = np.searchsorted(np.array([t for t, _, _ in order]), np.arange(len(self.terms) + 1))
        self.idf = np.zeros(len(self.terms))
        self.mean = 1.0

    def only(self, keep: set[int]) -> Asked:
        """Some of the questions, with the weights of their terms as they are."""
        names = list(self.terms)
        term = np.repeat(np.arange(len(names)), np.diff(self.start))
        out = Asked([(q, names[t], int(n)) for t, k, n in zip(term.tolist(), self.of.tolist(), self.times.tolist(), strict=True) if (q := self.questions[k]) in keep])
        out.idf, out.mean = np.array([self.idf[self.terms[t]] for t in out.terms]), self.mean
        return out

    def begun(self, token: str) -> list[int]:
        """The terms that a token begins with."""
        return [k for n in range(SHORTEST, len(token) + 1) if (k := self.terms.get(token[:n])) is not None]


def _spread(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the groups ``which``, and for each the place of its group in ``which``."""
    n = start[which + 1] - start[which]
    owner = np.repeat(np.arange(len(which)), n)
    return start[which][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n), owner


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a batch, in pieces with about ``TOKENS`` tokens in ``column``, or one row with more."""
    ends, a = batch.column(column).offsets.to_numpy(), 0
    while a < len(batch):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + TOKENS, side="right")) - 1)
        yield batch.slice(a, z - a)
        a = z


def _term_counts(tokens: pa.ListArray, asked: Asked) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of the batch, term, tf) sorted by document, and the documents' lengths; a token counts 255 times at most."""
    lengths = np.diff(tokens.offsets.to_numpy())
    coded = pc.dictionary_encode(tokens.flatten())
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    begun = [asked.begun(w) for w in words]
    start = np.concatenate([[0], np.cumsum([len(x) for x in begun])]).astype(np.int64)
    terms = np.array([k for x in begun for k in x], dtype=np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    hit = (start[1:] > start[:-1])[codes] if len(words) else np.zeros(0, bool)
    pair, tf = np.unique(doc[hit] * max(1, len(words)) + codes[hit], return_counts=True)
    at, owner = _spread(start, pair % max(1, len(words)))
    key, back = np.unique((pair // max(1, len(words)))[owner] * max(1, len(asked.terms)) + terms[at], return_inverse=True)
    total = np.bincount(back, np.minimum(tf, 255)[owner], len(key)) if len(key) else np.zeros(0)
    return key // max(1, len(asked.terms)), key % max(1, len(asked.terms)), total, lengths


def _scores(tokens: pa.ListArray, asked: Asked) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, scores of some documents by all questions)."""
    doc, term, tf, lengths = _term_counts(tokens, asked)
    norm = K1 * (1 - B + B * lengths / asked.mean)
    weight = asked.idf[term] * tf * (K1 + 1) / (tf + norm[doc])
    width = max(1, len(asked.questions))
    step = max(1, CHUNK // width)
    for a in range(0, len(lengths), step):
        z = min(a + step, len(lengths))
        low, high = np.searchsorted(doc, [a, z])
        at, owner = _spread(asked.start, term[low:high])
        cell = (doc[low:high][owner] - a) * width + asked.of[at]
        yield a, np.round(np.bincount(cell, weight[low:high][owner] * asked.times[at], (z - a) * width), 4).reshape(z - a, width)


FOUND = "query long, doc long, score double"


def _candidates(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(question, doc, score) of a chunk: the k best of each question, with the ties at the end."""
    if len(scores) > k:
        some = np.argpartition(-scores, k - 1, axis=0)[:k]
        least = np.take_along_axis(scores, some, axis=0).min(axis=0)
        where = np.argwhere(scores >= np.maximum(least, 1e-12))
    else:
        where = np.argwhere(scores > 0)
    return where[:, 1], ids[where[:, 0]], scores[where[:, 0], where[:, 1]]


def _marked(asked: Asked, ids: np.ndarray, mine: pa.ListArray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
    """(question, doc, score) of a chunk's documents with the questions that they are marked with."""
    row = np.repeat(np.arange(len(mine)), mine.value_lengths().fill_null(0).to_numpy())
    query, names = mine.flatten().to_numpy(), np.array(asked.questions, dtype=np.int64)
    at = np.minimum(np.searchsorted(names, query), len(names) - 1)
    row, at = row[names[at] == query], at[names[at] == query]
    some = scores[row, at] > 0
    row, at = row[some], at[some]
    return at, ids[row], scores[row, at]


def _merged(state: list, new: tuple[np.ndarray, ...], k: int) -> list:
    """The first k of each question, of those so far and the new ones."""
    q, d, s = (np.concatenate(x) for x in zip(state, new, strict=True)) if state else new
    order = np.lexsort((-d, -s, q))
    q, d, s = q[order], d[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return [q[place < k], d[place < k], s[place < k]]


def _named(asked: Asked, state: list) -> Iterator[pa.RecordBatch]:
    if state:
        names = np.array(asked.questions, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[state[0]]), pa.array(state[1].astype(np.int64)), pa.array(state[2])], names=["query", "doc", "score"])


def _placed(found: DataFrame, k: int) -> DataFrame:
    """The first k of each question, of the first k of each task."""
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.desc("doc")))
    return found.withColumn("place", place).filter(F.col("place") <= k)


class Ranking:
    """Questions (query long, question) against documents (doc long, body)."""

    def __init__(self, docs: DataFrame, queries: DataFrame, doc: str = "doc", body: str = "body", query: str = "query", question: str = "question", distinct: bool = True):
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(doc).cast("long").alias("doc"), text.tokens(F.coalesce(F.col(body), F.lit(""))).alias("t"))
        terms = queries.select(F.col(query).cast("long").alias("query"), F.explode(text.tokens(F.col(question))).alias("term"))
        self.terms = terms.groupBy("query", "term").agg((F.lit(1) if distinct else F.count("*")).cast("long").alias("qtf"))
        self.weighed: Asked | None = None

    def _goes(self) -> Iterator[Asked]:
        """The questions, as many at a time as tasks may know the terms of; with the idf of their terms."""
        if self.weighed is not None:
            yield self.weighed
            return
        sizes = self.terms.groupBy("query").agg(F.count("*").alias("n"))
        goes = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // TERMS))
        for go in range(goes):
            part = self.terms if goes == 1 else self.terms.filter(F.pmod(F.xxhash64("query"), F.lit(goes)) == go)
            asked = Asked([(r["query"], r.term, r.qtf) for r in part.collect()])
            if asked.questions:
                self._weigh(asked)
                self.weighed = asked if goes == 1 else None
                yield asked

    def _weigh(self, asked: Asked) -> None:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n, total = np.zeros(len(asked.terms), dtype=np.int64), 0, 0
            for batch in (piece for whole in batches for piece in _pieces(whole, 0)):
                _, term, _, lengths = _term_counts(batch.column(0), asked)
                df += np.bincount(term, minlength=len(df))
                n, total = n + len(lengths), total + int(lengths.sum())
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([*some, -1, -2], pa.int64()), pa.array([*df[some], n, total], pa.int64())], names=["term", "n"])

        # a row a term of the questions
        rows = self.docs.select("t").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        got = {r.term: r.n for r in rows}
        n = got.get(-1, 0)
        asked.mean = max(got.get(-2, 0) / n if n else 1.0, 1e-9)
        df = np.array([got.get(k, 0) for k in range(len(asked.terms))], dtype=float)
        asked.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def _pass(self, asked: Asked, schema: str, finish: Callable, step: Callable, docs: DataFrame | None = None) -> DataFrame:
        """A pass over the documents: ``step`` sees the rows and scores of a chunk, ``finish`` gives the task's rows."""
        known = self.spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: list = []
            for batch in (piece for whole in batches for piece in _pieces(whole, 1)):
                for a, scores in _scores(batch.column(1), known.value):
                    state = step(known.value, state, batch.slice(a, len(scores)), scores)
            yield from finish(known.value, state)

        return (self.docs.select("doc", "t") if docs is None else docs).mapInArrow(run, schema)

    def top(self, k: int = 10) -> DataFrame:
        """(query, doc, score): the k best documents of each question, of equal scores (to four digits) the larger id."""

        def step(asked: Asked, state: list, rows: pa.RecordBatch, scores: np.ndarray) -> list:
            return _merged(state, _candidates(rows.column(0).to_numpy(), scores, k), k)

        def finish(asked: Asked, state: list) -> Iterator[pa.RecordBatch]:
            yield from _named(asked, state)

        out = None
        for asked in self._goes():
            one = self._pass(asked, FOUND, finish, step)
            out = one if out is None else out.unionByName(one)
        return _placed(self._none(FOUND) if out is None else out, k).select("query", "doc", "score")

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def places(self, relevant: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """(query, doc, score, place) of the k best of each question, and (query, place): where in the whole ranking the best of a
        question's ``relevant`` (query, doc) stands; none without a score.

        One pass finds both, since most of these are among the k best.  Another one counts, for the questions where they are not, what
        stands above.  A document knows the questions it is relevant to, by a join.
        """
        marks = relevant.groupBy(F.col("doc").cast("long").alias("doc")).agg(F.collect_set(F.col("query").cast("long")).alias("mine"))
        marks = cut(marks, "marks")
        docs = self.docs.join(small(marks, marks.count()), "doc", "left").select("doc", "t", "mine")

        def step(asked: Asked, state: list, rows: pa.RecordBatch, scores: np.ndarray) -> list:
            ids, (tops, leads) = rows.column(0).to_numpy(), state or ([], [])
            return [_merged(tops, _candidates(ids, scores, k), k), _merged(leads, _marked(asked, ids, rows.column(2), scores), 1)]

        def finish(asked: Asked, state: list) -> Iterator[pa.RecordBatch]:
            for lead, part in enumerate(state):
                for rows in _named(asked, part):
                    yield rows.append_column("lead", pa.array(np.full(len(rows), bool(lead))))

        best, firsts = self._none(FOUND + ", place int"), self._none("query long, place long")
        for asked in self._goes():
            found = cut(self._pass(asked, FOUND + ", lead boolean", finish, step, docs), "found")
            tops = _placed(found.filter("not lead").drop("lead"), k)
            leads = found.filter("lead").groupBy("query").agg(F.max(F.struct("score", "doc")).alias("b")).select("query", "b.score", "b.doc")
            met = tops.groupBy("query", "doc").agg(F.min("place").cast("long").alias("place"))
            leads = cut(leads.join(met, ["query", "doc"], "left"), "leads")
            best, firsts = best.unionByName(tops), firsts.unionByName(leads.filter("place is not null").select("query", "place"))
            bar = {r["query"]: (r.score, r.doc) for r in leads.filter("place is null").collect()}  # a row a question of this go
            if bar:
                firsts = firsts.unionByName(self._above(asked.only(set(bar)), bar))
        return best, firsts

    def _above(self, asked: Asked, bar: dict[int, tuple[float, int]]) -> DataFrame:
        """(query, place): one more than the documents above a question's (score, doc)."""
        limits = np.array([bar[q][0] for q in asked.questions]), np.array([bar[q][1] for q in asked.questions], dtype=np.int64)

        def step(asked: Asked, state: list, rows: pa.RecordBatch, scores: np.ndarray) -> list:
            (score, doc), ids = limits, rows.column(0).to_numpy()[:, None]
            n = ((scores > score) | ((scores == score) & (ids > doc))).sum(axis=0)
            return [n if not state else state[0] + n]

        def finish(asked: Asked, state: list) -> Iterator[pa.RecordBatch]:
            for n in state:
                yield pa.RecordBatch.from_arrays([pa.array(asked.questions, pa.int64()), pa.array(n, pa.int64())], names=["query", "n"])

        return self._pass(asked, "query long, n long", finish, step).groupBy("query").agg((F.sum("n") + 1).alias("place"))

    def first_places(self, relevant: DataFrame) -> DataFrame:
        """(query, place): where in the whole ranking the best of a question's ``relevant`` (query, doc) stands; none without a score."""
        return self.places(relevant)[1]


def evaluate(ranking: Ranking, relevant: DataFrame, k: int = 10) -> DataFrame:
    """recall@k (of k or of all relevant ones, if fewer) and mean reciprocal rank over the questions that have relevant documents."""
    relevant = cut(relevant.select("query", "doc"), "relevant")  # it is read three times
    best, firsts = ranking.places(relevant, k)
    hits = best.join(relevant, ["query", "doc"]).groupBy("query").agg(F.count("*").alias("hits"))
    n = relevant.groupBy("query").agg(F.count("*").alias("relevant"))
    per = n.join(hits, "query", "left").join(firsts, "query", "left")
    per = per.select((F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), F.col("relevant"))).alias("r"), F.coalesce(1 / F.col("place"), F.lit(0.0)).alias("m"))
    return per.agg(F.count("*").alias("questions"), F.avg("r").alias("recall"), F.avg("m").alias("mrr"))
