"""Toxicity by a weighted finite-state pattern grammar over clauses.

The lexicon transducer (an automaton over characters) reads lower-cased text and writes one symbol a word or sign:
insult, threat, target, negation, report, quote, colon or any other word.  Insults are learned from the labels, as stems
(a stem stands for every word that begins with it) or whole words, with weights; the other classes are fixed lists.

Five transducers read these symbols: ``TARGET`` and ``THREAT`` remember that a clause has one, ``NEGATION`` reaches over the
next two words, ``REPORT`` remembers a verb of saying, before or after, and ``QUOTE`` whether words stand in quotes that such a
verb or a colon after it opened; quotes go on over ends of clauses.  They are composed into one (``GRAMMAR``),
whose states are the reachable combinations, so a clause is read once.  A clause matches if it has an insult, or a
threat and a target.  Its features are the weight of its insults, and the parts of it that come with a target, with a threat,
after a negation and in reported speech, and its threats.  What these contexts add or take away is learned too (logistic
weights, drawn to ``PRIOR`` where the labels don't say), so a matched clause is scored, not a word.

Fitting uses at most ``FIT_ROWS`` labelled rows of each label, those with the smallest hashes; texts that
repeat count once, and a stem needs ``SUPPORT`` different neighbourhoods, so copies don't make stems.  A stem
has 4 to 12 letters, a whole word any number.

Cases: null texts count as empty; a text without a matched clause gets the base score.  A label of a
document that is missing, or a null label, isn't used; of several labels of a document the larger holds.
Without two classes among the labels every score is the share of toxic labels, or 0.  A null doc_id
counts as held out.  Rows that repeat stay rows.  A text of any length is read whole, in time that grows with it.
Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Hashable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import cut, documents

#: Bounds of the fit: labelled rows of each label, and the support that a stem needs.
FIT_ROWS, SUPPORT = 20_000, 6
#: A stem is this many times as frequent among toxic texts, and this long at least (whole words: 2).
LIFT, SHORTEST, LONGEST = 25.0, 4, 12

#: Fixed word lists of the clause grammar.
TARGETS = "you your you're u they them he she him her dich du dir euch ihr sie tu te toi vous votre usted ustedes ti tus ellos".split()
THREATS = "kill hurt destroy burn beat shoot stab crush töten schlagen umbringen tuer frapper brûler matar golpear quemar".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called wrote quoted claims reported according sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
CLASSES = {w: k for k, ws in (("target", TARGETS), ("threat", THREATS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
FEATURES = ["matched", "clauses", "targeted", "threatened", "negated", "reported", "threats", "strongest", "density"]
#: Of these the first come from the clauses and add up; the others belong to the text.
SUMS = 7
#: What the weights of the features are drawn to.
PRIOR = [0.0, 0.0, 0.0, 0.0, -0.5, -0.5, 4.0, 0.0, 0.0]

_SIGN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»:]")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]+")
_NO_WORD = ("quote", "colon", "end")
SYMBOLS = ["insult", "threat", "target", "negation", "report", "word", *_NO_WORD]


class Transducer(NamedTuple):
    """``step`` gives the next state and what is written for a symbol, ``final`` what is written at the end of a clause."""

    start: Hashable
    step: Callable[[Hashable, str], tuple[Hashable, frozenset]]
    final: Callable[[Hashable], frozenset]


_NOTHING = frozenset()


def _remembers(symbol: str) -> Transducer:
    """Writes ``symbol`` at the end of a clause that has one."""
    return Transducer(False, lambda s, x: ((s or x == symbol) and x != "end", _NOTHING), lambda s: frozenset([symbol]) if s else _NOTHING)


def _negates(reach: int = 2) -> Transducer:
    """Writes ``negated`` for an insult or a threat up to ``reach`` words after a negation."""

    def step(left: int, x: str) -> tuple[int, frozenset]:
        written = frozenset(["negated"]) if left and x in ("insult", "threat") else _NOTHING
        if x in ("quote", "colon"):
            return left, written
        return (reach if x == "negation" else 0 if x == "end" else max(0, left - 1)), written

    return Transducer(0, step, lambda s: _NOTHING)


def _quotes() -> Transducer:
    """Writes ``reported`` inside quotes, and after a colon, that a verb of saying opened."""

    def step(state: tuple[bool, str], x: str) -> tuple[tuple[bool, str], frozenset]:
        said, where = state
        written = frozenset(["reported"]) if where in ("speech", "quoted speech") and x in ("insult", "threat") else _NOTHING
        if x == "quote":
            where = ("quoted speech" if said or where == "speech" else "quoted") if where in ("", "speech") else ""
        elif x == "colon" and said and where == "":
            where = "speech"
        elif x == "end":
            return (False, where if where.startswith("quoted") else ""), written
        return (said or x == "report", where), written

    return Transducer((False, ""), step, lambda s: _NOTHING)


def compose(*parts: Transducer) -> tuple[list[dict[str, tuple[int, frozenset]]], list[frozenset]]:
    """One transducer that does what all parts do: for each of its states the steps, and what is written at the end."""
    number, steps, finals = {tuple(p.start for p in parts): 0}, [], []
    for state in (todo := list(number)):
        row = {}
        for x in SYMBOLS:
            done = [p.step(s, x) for p, s in zip(parts, state, strict=True)]
            to = tuple(d[0] for d in done)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[x] = (number[to], _NOTHING.union(*[d[1] for d in done]))
        steps.append(row)
        finals.append(_NOTHING.union(*[p.final(s) for p, s in zip(parts, state, strict=True)]))
    return steps, finals


#: The composed grammar: steps and ends.
GRAMMAR = compose(_remembers("target"), _remembers("threat"), _remembers("report"), _negates(), _quotes())


class Grammar:
    """The lexicon with weights of stems, and the weights of the clause features."""

    def __init__(self, stems: dict[str, float], weights: list[float], base: float):
        import ahocorasick

        self.stems, self.weights, self.base = stems, weights, base
        self.automaton = ahocorasick.Automaton()
        for word in THREATS:
            self.automaton.add_word(word, (word + "$", len(word), None))
        for stem, weight in stems.items():
            self.automaton.add_word(stem.rstrip("$"), (stem, len(stem.rstrip("$")), weight))
        self.automaton.make_automaton()

    def matches(self, low: str) -> list[tuple[int, int, str, float | None]]:
        """(start, end, stem, weight) of the longest stem at each word start of a lower-cased text; threats have no weight."""
        found: dict[int, tuple[int, int, str, float | None]] = {}
        for last, (stem, size, weight) in self.automaton.iter(low):
            start = last - size + 1
            if start and low[start - 1].isalpha():
                continue
            if stem[-1] == "$" and last + 1 < len(low) and low[last + 1].isalpha():
                continue
            if start not in found or found[start][1] <= last:
                found[start] = (start, last + 1, stem, weight)
        return sorted(found.values(), key=lambda h: h[0])

    def features(self, low: str) -> list[float] | None:
        """The sums over the matched clauses of a lower-cased text; None without a match."""
        hits = self.matches(low)
        if not hits:
            return None
        out, at, a, state = [0.0] * SUMS, 0, 0, 0
        weight_at = {h[0]: h[3] for h in hits if h[3] is not None}
        for z in (*(m.end() for m in _CLAUSE.finditer(low)), len(low)):
            begins = at
            while at < len(hits) and hits[at][0] < z:
                at += 1
            if at > begins:
                found, state = self.clause(low, a, z, weight_at, state)
                for i, v in enumerate(found or ()):
                    out[i] += v
            else:  # quotes go on
                state = self._after(low, a, z, state)
            a = z
            if at == len(hits):
                break
        if not out[1]:
            return None
        return [*out, max(weight_at.values(), default=0.0), 1000 * out[0] / len(low)]

    def _after(self, low: str, a: int, z: int, state: int) -> int:
        """The state after a clause without a match: only quotes, and verbs of saying before them, can matter."""
        steps, _ = GRAMMAR
        if any(q in low[a:z] for q in "\"“”„«»"):
            return self.clause(low, a, z, {}, state)[1]
        return steps[state]["end"][0]

    def clause(self, low: str, a: int, z: int, weight_at: dict[int, float], state: int = 0) -> tuple[list[float] | None, int]:
        """The clause ``low[a:z]`` read by the composed transducer from ``state`` on: its features, if it matches, and the
        state that the next clause begins with."""
        steps, finals = GRAMMAR
        total = negated = reported = threats = told = 0.0
        for m in _SIGN.finditer(low, a, z):
            sign = m.group()
            w = weight_at.get(m.start())
            x = "insult" if w is not None else "colon" if sign == ":" else "quote" if sign in "\"“”„«»" else CLASSES.get(sign, "word")
            state, written = steps[state][x]
            if w is not None:
                total += w
                negated += w if "negated" in written else 0.0
                reported += w if "reported" in written else 0.0
            elif x == "threat" and "negated" not in written:
                threats += 1
                told += "reported" in written
        ends = finals[state]
        state = steps[state]["end"][0]
        if "report" in ends:  # before or after: all of the clause is what somebody said
            reported, told = total, threats
        threats = threats - told if "target" in ends else 0.0
        if not total and not threats:
            return None, state
        return [total, 1.0, total if "target" in ends else 0.0, total if "threat" in ends else 0.0, negated, reported, threats], state

    def score(self, text: str) -> float:
        f = self.features(text.lower())
        z = self.base + (sum(w * math.log1p(v) for w, v in zip(self.weights, f, strict=True)) if f else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def to_json(self) -> str:
        return json.dumps([self.stems, self.weights, self.base])

    @classmethod
    def from_json(cls, data: str) -> Grammar:
        return cls(*json.loads(data))


_LOADED: dict[str, Grammar] = {}


def _grammar(data: str) -> Grammar:
    if data not in _LOADED:
        _LOADED.clear()
        _LOADED[data] = Grammar.from_json(data)
    return _LOADED[data]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def fit_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(toxic, low) of the labelled rows that the fit uses, FIT_ROWS of each label at most; all rows of each label."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    known = cut(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "known")
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("toxic = 1").orderBy(*order).limit(FIT_ROWS).union(known.filter("toxic = 0").orderBy(*order).limit(FIT_ROWS))
    rows = docs.join(F.broadcast(picked), "doc_id").select("toxic", F.lower("text").alias("low"))  # 2 * FIT_ROWS ids at most
    return cut(rows.dropDuplicates(["low"]), "labelled"), totals


def _counts(rows: DataFrame, toxic: int, clean: int) -> list:
    """Stems that are LIFT times as frequent among toxic texts, with their counts."""

    def run(batches):
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            for y, low in zip(batch.column("toxic").to_pylist(), batch.column("low").to_pylist(), strict=True):
                found = set()
                for w in set(_WORD.findall(low)):
                    found.add(w + "$")
                    found.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
                for s in found:
                    seen[s][y] += 1
        some = list(seen.items())
        for k in range(0, len(some), 50_000):
            part = some[k : k + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in part]), pa.array([n[0] for _, n in part], pa.int64()), pa.array([n[1] for _, n in part], pa.int64())],
                ["stem", "clean", "toxic"],
            )

    sums = rows.mapInArrow(run, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = sums.filter(F.col("toxic") >= SUPPORT).filter((F.col("toxic") / toxic) >= LIFT * (F.col("clean") + 0.5) / clean)
    return sums.collect()  # SUPPORT of 2 * FIT_ROWS rows at least have each


def _supported(rows: DataFrame, stems: list[str]) -> dict[str, int]:
    """In how many different neighbourhoods (words before and after) each stem is found in toxic texts."""

    def run(batches):
        grammar = _grammar(Grammar(dict.fromkeys(stems, 1.0), [0.0] * len(FEATURES), 0.0).to_json())
        for batch in batches:
            out = set()
            for low in batch.column("low").to_pylist():
                words = [(m.start(), m.group()) for m in _WORD.finditer(low)]
                at = {s: k for k, (s, _) in enumerate(words)}
                for start, _, stem, weight in grammar.matches(low):
                    if weight is not None and (k := at.get(start)) is not None:
                        near = " ".join(w for _, w in words[max(0, k - 2) : k] + words[k + 1 : k + 3])
                        out.add((stem, zlib.crc32(near.encode())))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["stem", "near"])

    found = rows.filter("toxic = 1").mapInArrow(run, "stem string, near long").groupBy("stem").agg(F.count_distinct("near").alias("n"))
    return {r.stem: r.n for r in found.collect()}  # a row a stem


def general(counts: dict[str, tuple[int, int]]) -> list[str]:
    """The shortest stems: those of which no proper prefix is as good a stem itself."""
    out = []
    for stem in sorted(counts):
        word = stem.rstrip("$")
        if not any(word[:k] in counts for k in range(SHORTEST, len(word) + (stem[-1] == "$"))):
            out.append(stem)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar learned from the labels of documents that are not held out.  ``docs``: (doc_id, text)."""
    rows, totals = fit_rows(docs, labels)
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Grammar({}, [0.0] * len(FEATURES), 30.0 if toxic else -30.0)
    counts = {r.stem: (r.toxic, r.clean) for r in _counts(rows, toxic, clean)}
    stems = general(counts)
    support = _supported(rows, stems)
    weight = {s: math.log((counts[s][0] + 0.5) / (toxic + 1)) - math.log((counts[s][1] + 0.5) / (clean + 1)) for s in stems if support.get(s, 0) >= SUPPORT}
    blank = Grammar(weight, [0.0] * len(FEATURES), 0.0)
    data = blank.to_json()

    def run(batches):
        grammar = _grammar(data)
        for batch in batches:
            seen: Counter = Counter()
            for y, low in zip(batch.column("toxic").to_pylist(), batch.column("low").to_pylist(), strict=True):
                seen[(y, *(round(v, 3) for v in grammar.features(low) or [0.0] * len(FEATURES)))] += 1
            yield pa.RecordBatch.from_pylist([{"row": list(map(float, k)), "n": n} for k, n in seen.items()], pa.schema([("row", pa.list_(pa.float64())), ("n", pa.int64())]))

    table = rows.mapInArrow(run, "row array<double>, n long").collect()  # 2 * FIT_ROWS rows at most
    x = np.log1p(np.array([r.row[1:] for r in table]))
    y, n = np.array([r.row[0] for r in table]), np.array([r.n for r in table], float)
    weights, base = _logistic(x, y, n * np.where(y == 1, totals[1] / toxic, totals[0] / clean))
    return Grammar(weight, weights, base)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression by Newton steps, drawn to ``PRIOR``; the base is not."""
    z = np.hstack([x, np.ones((len(x), 1))])
    prior, shrink = np.append(PRIOR, 0.0), np.append(np.full(x.shape[1], ridge), 1e-6)
    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (n * (y - p)) - shrink * (beta - prior)
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag(shrink)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(b) for b in beta[:-1]], float(beta[-1])


def scorer(grammar: Grammar):
    """A column function: the score of a text."""
    data = grammar.to_json()

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        g = _grammar(data)
        return pd.Series([g.score(t) for t in texts], dtype=float)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    docs = documents(docs, id_col, text_col)
    score = scorer(fit(docs, labels))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows whose text scores 0.5 or more."""
    score = scorer(fit(documents(docs, id_col, text_col), labels))
    return docs.filter(score(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))) < 0.5)
