r"""Exact top-k search by BM25: an inverted index in each shard, block-max WAND pruning, exact merge.

Terms are the runs of ``\w`` of the lower-cased text.  A document's score is the sum over the query's
different terms t of idf(t) * qtf(t) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)), with
idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)); N, df and the mean length are those of all documents, so scores
of different shards compare.  Scores are rounded to 6 decimals; ties go to the smaller doc_id.

1. Documents are dealt to shards of bounded size, and each text is cut into terms once.  A shard's index is a row:
   its terms, their postings, and its documents in the order of their commonest term and length, in blocks of
   ``BLOCK``.  The index is written; N, df and the mean length are summed up from it.
2. For each query, a shard adds up the largest contributions that its terms have in each block.  The pivot moves through the
   blocks in document order, for up to ``QUERIES`` queries together: at each block are those whose sum there reaches their k-th best score so
   far; for the others it is skipped with all its postings.  The documents of the block are scored for these queries from all their terms, and
   the k-th best scores go up.  Terms that many of the queries and documents have are multiplied as a matrix of single precision, the others
   posting by posting; a rigorous bound on the rounding says which documents may be among the first k, and these are scored again
   in double precision, term by term.
3. A task's shards are taken one after the other, each from the k-th best scores of those before; each task's first k are merged.

Queries go out in blocks, cut by a running sum of their terms at ``QUERY_BYTES`` (a longer query goes alone), so what is
broadcast has a proven bound, and each block is run against the written index.

Cases: null texts count as empty; an empty query, or one without a common term, gives no rows.
A query or document without id takes no part.  Rows that repeat a doc_id are documents of their own, as queries they are
one.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, documents
from plenum.llm.suffix import _spread

K1, B = 1.2, 0.75
#: Documents of a block, and queries that the pivot moves for together.
BLOCK, QUERIES = 512, 4096
#: A term is part of the matrix if one in so many pairs of a query and a document, at least, have it in common; the matrix has at most so many cells; and
#: so many postings are multiplied together.
SHARED, CELLS, POSTINGS = 640, 16 << 20, 1 << 17
#: Tasks for each core that the shards of an index are dealt to.
TASKS = 2
#: Text of one shard, and of the terms of one block of queries.
SHARD_BYTES, QUERY_BYTES = 24 << 20, 32 << 20
_TERM = re.compile(r"\w+")


def terms_of(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode()) - (1 << 63)


class _Hashes(dict):
    """Term -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, term: str) -> int:
        h = _hash(term)
        if len(self) < 500_000:
            self[term] = h
        return h


def query_terms(queries: DataFrame) -> DataFrame:
    """(doc_id, term, qtf): the terms of each query."""

    def run(batches):
        for batch in batches:
            rows = [(i, _hash(t), n) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t, n in terms_of(text).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["doc_id", "term", "qtf"])

    return queries.mapInArrow(run, "doc_id long, term long, qtf long")


INDEX = "ids binary, lengths binary, terms binary, ends binary, docs binary, counts binary"
_KINDS = {"ids": "<i8", "lengths": "<i4", "terms": "<i8", "ends": "<i8", "docs": "<i4", "counts": "<i4"}


def index(docs: DataFrame, shards: int) -> DataFrame:
    """A row a shard: document ids and lengths in index order, the sorted term hashes, where each one's postings end,
    and the postings: document numbers, ascending, and term frequencies."""

    def run(batches):
        ids, tops, lengths, sizes, terms, counts, hashes = [], [], [], [], [], [], _Hashes()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                c = terms_of(text.as_py())
                ids.append(i)
                lengths.append(c.total())
                tops.append(max(c, key=lambda t: (c[t], t)) if c else "")
                sizes.append(len(c))
                terms.append(np.fromiter((hashes[t] for t in c), np.int64, len(c)))
                counts.append(np.fromiter(c.values(), np.int32, len(c)))
        if not ids:
            return
        order = sorted(range(len(ids)), key=lambda i: (tops[i], lengths[i], ids[i]))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        term, doc = np.concatenate(terms), np.repeat(rank, sizes)
        turn = np.lexsort((doc, term))
        term = term[turn]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        made = {"ids": np.array(ids)[order], "lengths": np.array(lengths)[order], "terms": term[first], "ends": np.append(first[1:], len(term)), "docs": doc[turn], "counts": np.concatenate(counts)[turn]}
        yield pa.RecordBatch.from_arrays([pa.array([made[c].astype(k).tobytes()], pa.binary()) for c, k in _KINDS.items()], list(_KINDS))

    return docs.repartitionById(shards, F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).mapInArrow(run, INDEX)


def _shards(batches):
    for batch in batches:
        for k in range(len(batch)):
            yield {c: np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in _KINDS.items()}


def frequencies(shards: DataFrame) -> DataFrame:
    """(term, df, n, length): in how many documents of a shard each term occurs; a row without a term has
    the number of its documents and of their terms."""

    def run(batches):
        for s in _shards(batches):
            size = np.diff(s["ends"], prepend=0)
            yield pa.RecordBatch.from_arrays([pa.array(s["terms"]), pa.array(size), *[pa.array(np.zeros(len(size), np.int64))] * 2], ["term", "df", "n", "length"])
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, 0, len(s["ids"]), int(s["lengths"].sum(dtype=np.int64)))], ["term", "df", "n", "length"])

    return shards.mapInArrow(run, "term long, df long, n long, length long")


class Shard:
    """The part of a shard's index that the terms of a block of queries have: postings in blocks of documents, by term in each, and their largest weights."""

    def __init__(self, s: dict[str, np.ndarray], vocabulary: np.ndarray, mean: float):
        self.ids, self.n, self.n_terms = s["ids"], len(s["ids"]), len(vocabulary)
        self.blocks = -(-self.n // BLOCK)
        at = np.minimum(np.searchsorted(s["terms"], vocabulary), max(0, len(s["terms"]) - 1))
        known = s["terms"][at] == vocabulary if len(s["terms"]) else np.zeros(len(vocabulary), bool)
        ends = np.concatenate([[0], s["ends"]])
        size = np.where(known, ends[at + 1] - ends[at], 0) if len(s["terms"]) else np.zeros(len(vocabulary), np.int64)
        place = _spread(ends[at] if len(at) else size, size)
        doc, tf, row = s["docs"][place], s["counts"][place], np.repeat(np.arange(len(vocabulary)), size)
        norm = K1 * (1 - B + B * s["lengths"] / max(mean, 1e-9))
        weight = tf * (K1 + 1) / (tf + norm[doc])
        # the largest weight of each term in each block: term by term, blocks ascending
        pair = row * self.blocks + doc // BLOCK
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        self.top = row[first], pair[first] % max(1, self.blocks), np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
        turn = np.argsort((doc // BLOCK).astype(np.uint16 if self.blocks < 1 << 16 else np.int64), kind="stable")
        self.df, self.row, self.doc, self.weight = size, row[turn], doc[turn], weight[turn]
        self.ends = np.cumsum(np.bincount(self.doc // BLOCK, minlength=self.blocks))

    def best(self, rows: np.ndarray, factor: np.ndarray, ends: np.ndarray, k: int, top: np.ndarray):
        """Yields query, document ids and scores of what may be among the first k of some queries.  A query's terms are given as rows of the vocabulary with
        idf * qtf, and its best scores so far as a row of ``top`` (0 where there is none)."""
        n, owner, top = len(ends), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), top.copy()
        common = self.df * np.bincount(rows, minlength=self.n_terms)  # pairs of a query and a document that have a term in common
        dense = np.flatnonzero(common * SHARED > self.n * n)
        if len(dense) > (most := CELLS // max(n, BLOCK, self.blocks)):
            dense = np.sort(dense[np.argsort(-common[dense], kind="stable")[:most]])
        column = np.full(self.n_terms, -1, np.int32)
        column[dense] = np.arange(len(dense))
        shared, rare = column[rows] >= 0, (column[rows] < 0) & (self.df[rows] > 0)
        matrix = np.zeros((n, len(dense)), np.float32)
        matrix[owner[shared], column[rows[shared]]] = factor[shared]
        rare_owner, rare_row, rare_factor = owner[rare], rows[rare], factor[rare]
        # all terms of a sum are positive, so it is off by this share of itself at most: three roundings a product, one a sum
        off = (len(dense) + 64) * 2.0**-23

        def product(some: np.ndarray, row: np.ndarray, at: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
            """Sums of factor * weight for some of the queries and each place ``at`` below ``width``; rows ascend."""
            own = column[row]
            many = own >= 0
            other = np.zeros((len(dense), width), np.float32)
            other[own[many], at[many]] = weight[many]
            out = ((matrix if len(some) == n else matrix[some]) @ other).astype(float).ravel()
            row, at, weight = row[~many], at[~many], weight[~many]
            count, place = np.bincount(row, minlength=self.n_terms), np.full(n, -1)
            first, place[some] = np.cumsum(count) - count, np.arange(len(some))
            pairs = np.flatnonzero((count[rare_row] > 0) & (place[rare_owner] >= 0))
            total = np.cumsum(count[rare_row[pairs]])
            cuts = np.searchsorted(total, np.arange(POSTINGS, total[-1], POSTINGS)) if len(total) else []
            for some_pairs in np.split(pairs, cuts):
                if not len(some_pairs):
                    continue
                size = count[rare_row[some_pairs]]
                posting = _spread(first[rare_row[some_pairs]], size)
                query = place[rare_owner[some_pairs]]  # ascending
                low, high = int(query[0]) * width, int(query[-1] + 1) * width
                cell = np.repeat(query * width - low, size) + at[posting]
                out[low:high] += np.bincount(cell, weight[posting] * np.repeat(rare_factor[some_pairs], size), high - low)
            return out.reshape(-1, width)

        # what a block can score at most, with some room for the order in which numbers are added
        bound = product(np.arange(n), *self.top, self.blocks) * (1 + 2 * off) + 1e-6 if self.blocks else np.zeros((n, 0))
        limit, found = top.min(axis=1), []
        for block in range(self.blocks):
            some = np.flatnonzero(bound[:, block] >= np.maximum(limit, 1e-6))
            if not len(some):
                continue
            part = slice(self.ends[block - 1] if block else 0, self.ends[block])
            low, width = block * BLOCK, min(BLOCK, self.n - block * BLOCK)
            near = product(some, self.row[part], self.doc[part] - low, self.weight[part], width)
            hit = near >= np.maximum(limit[some] * (1 - 2 * off) - 2e-6, 4e-7)[:, None]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            found.append((some[i], low + j, near[i, j]))
            new = np.flatnonzero(hit.any(axis=1))
            both = np.concatenate([top[some[new]], np.where(hit[new], near[new], 0.0)], axis=1)
            both.partition(both.shape[1] - k, axis=1)
            top[some[new]] = both[:, -k:]
            limit[some[new]] = np.maximum(limit[some[new]], both[:, -k:].min(axis=1) * (1 - 2 * off) - 1e-6)
        if not found:
            return
        query, doc, near = (np.concatenate(c) for c in zip(*found, strict=True))
        kept = near >= limit[query] * (1 - 2 * off) - 2e-6
        turn = np.argsort(query[kept], kind="stable")
        query, doc = query[kept][turn], doc[kept][turn]
        # the postings of these documents, by document, terms ascending
        asked = np.zeros(self.n, bool)
        asked[doc] = True
        own = np.flatnonzero(asked[self.doc])
        own = own[np.argsort(self.doc[own], kind="stable")]
        row, weight, count = self.row[own], self.weight[own], np.bincount(self.doc[own], minlength=self.n)
        first, value, starts = np.cumsum(count) - count, np.zeros(self.n_terms), np.append(0, ends[:-1])
        whose, begins = np.unique(query, return_index=True)
        for q, docs in zip(whose.tolist(), np.split(doc, begins[1:]), strict=True):
            terms = slice(starts[q], ends[q])
            value[rows[terms]] = factor[terms]
            size = count[docs]
            posting = _spread(first[docs], size)
            score = np.round(np.bincount(np.repeat(np.arange(len(docs)), size), weight[posting] * value[row[posting]], len(docs)), 6)
            value[rows[terms]] = 0.0
            there = score >= 1e-6
            yield q, self.ids[docs[there]], score[there]


def _first(found: DataFrame, n_shards: int, k: int) -> DataFrame:
    """(query_id, at, hit): the first k of each query, merged in two levels, so that no group has an answer of every shard."""
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))), 1, k).alias("best")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(math.ceil(math.sqrt(n_shards)))).alias("salt")
    some = found.groupBy("query_id", salt).agg(top).select("query_id", F.explode("best").alias("hit"))
    best = some.select("query_id", (-F.col("hit.s")).alias("score"), "hit.doc_id").groupBy("query_id").agg(top)
    return best.select("query_id", F.posexplode("best").alias("at", "hit"))


def _run_block(shards: DataFrame, block: pa.Table, n: int, mean: float, k: int, n_shards: int) -> DataFrame:
    """(query_id, doc_id, score): the first k of each query of the block in the shards of each task.

    A task has several shards, one after the other, and each begins with the k-th best scores of those before it.
    """
    query, term, qtf, df = (block.column(c).to_numpy() for c in ("doc_id", "term", "qtf", "df"))
    order = np.lexsort((term, query))
    vocabulary, row = np.unique(term[order], return_inverse=True)
    ids, first = np.unique(query[order], return_index=True)
    factor = (qtf * np.log(1 + (n - df + 0.5) / (df + 0.5)))[order]
    queries = (ids, np.append(first, len(order)), row.astype(np.int32), factor)
    context = shards.sparkSession.sparkContext
    shipped = context.broadcast((vocabulary, queries))  # QUERY_BYTES, or one query

    tasks = max(1, min(n_shards, TASKS * context.defaultParallelism))
    shards = shards.coalesce(tasks)

    def answers(batches):
        vocabulary, (ids, ends, at, factor) = shipped.value
        best: list[list[tuple[float, int]]] = [[] for _ in ids]  # of each query (-score, doc_id), ascending
        for s in _shards(batches):
            shard = Shard(s, vocabulary, mean)
            for low in range(0, len(ids), QUERIES):
                high, part = min(low + QUERIES, len(ids)), slice(ends[low], ends[min(low + QUERIES, len(ids))])
                top = np.array([[*(-x for x, _ in b), *[0.0] * (k - len(b))] for b in best[low:high]])
                for q, docs, scores in shard.best(at[part], factor[part], ends[low + 1 : high + 1] - ends[low], k, top):
                    best[low + q] = sorted([*best[low + q], *zip((-scores).tolist(), docs.tolist(), strict=True)])[:k]
        out = [(q, d, -x) for q, found in zip(ids.tolist(), best, strict=True) for x, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["query_id", "doc_id", "score"])

    return shards.mapInArrow(answers, "query_id long, doc_id long, score double")


def _blocks(sizes: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of query ids with at most so many terms, or one query: running sums over (doc_id, terms)."""
    out, low, last, total = [], None, None, 0
    for r in sizes.orderBy("doc_id").toLocalIterator():
        if low is not None and total + r.terms > most:
            out.append((low, last))
            low, total = None, 0
        low, last, total = r.doc_id if low is None else low, r.doc_id, total + r.terms
    return [*out, *([(low, last)] if low is not None else [])]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the first k documents of ``docs`` for each row of ``queries``."""
    docs = documents(docs, id_col, text_col).filter("doc_id is not null")
    queries = documents(queries, id_col, text_col).filter("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size")).first().size
    n_shards = max(1, -(-size // SHARD_BYTES))
    shards = cut(index(docs, n_shards), "index")
    counted = frequencies(shards).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("df", "n", "length")])
    counted = cut(counted, "terms")
    whole = counted.filter("term is null").first()
    n, mean = (whole.n, whole.length / whole.n) if whole else (0, 0.0)
    terms = query_terms(queries).groupBy("doc_id", "term").agg(F.max("qtf").alias("qtf"))
    terms = cut(terms.join(counted.filter("term is not null").select("term", "df"), "term").select("doc_id", "term", "qtf", "df"), "terms")
    found = terms.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    for low, high in _blocks(terms.groupBy("doc_id").agg(F.count("*").alias("terms")), QUERY_BYTES // 32):
        block = terms.filter(F.col("doc_id").between(low, high)).toArrow()
        found = found.union(cut(_run_block(shards, block, n, mean, k, n_shards), "found"))
    return _first(found, n_shards, k).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("hit.doc_id").alias("doc_id"), (-F.col("hit.s")).alias("score")
    )
