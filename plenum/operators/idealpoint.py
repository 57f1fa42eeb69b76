"""Ideal points of members by a two-parameter item response model, for all terms at once.

P(yes) = logistic(a * x - b): x is a member's position, a and b a vote's slope and cut, with normal priors.  The fit alternates
damped Newton steps on all votes and on all members.  Terms and the draws of the bootstrap are keys.  A term of ``CELLS`` cells
(who voted how) or fewer is fitted in memory, a task for each term and for a few of its draws: a vote comes as lists of its members, a cell
is a few bytes there, and a step looks at a piece of the cells at a time.  In a larger one a step is sums over the cells by vote or
by member: a join with the coefficients and an aggregation, written after each step, so that no term has to fit into a task.
Both take the same steps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.sources.work import cut, remove, small

ITERATIONS, DRAWS, DRAW_ITERATIONS, SECOND_ITERATIONS, POWER_ITERATIONS = 60, 40, 25, 40, 60
PRIOR = 16.0
#: A term with more cells is fitted by joins and aggregations; a cell takes 21 bytes in a task, 5 of them while it is fitted.
CELLS = 20_000_000
#: Cells whose votes are gathered together, and cells that a step looks at together, at least.
ROW, PIECE = 1 << 17, 1 << 15
#: Rounds end when no position moves by so much.
STILL, DRAW_STILL = 1e-5, 1e-3
#: Tasks for each core, about, that the draws are dealt to.
TASKS = 4
#: The share of votes that a draw with replacement, as many as there are, has at least once.
TAKEN = 1 - math.exp(-1)


def _clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def _chance(logit: Column) -> Column:
    return 1 / (1 + F.exp(-_clip(logit, -30.0, 30.0)))


def _members(pos: DataFrame, least: int, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, member, yes, no, grp, votes): lists of the divided votes of members with ``least`` of them; (term, vote, yes, n): their sums; and
    (term, n), the cells of each term with ``least`` members and votes.  ``pos`` is computed once."""
    from plenum.operators.groups import divided

    named = pos.filter("position in ('yes', 'no')").select(
        F.col("term").cast("string").alias("term"), F.col("vote").cast("string").alias("vote"), F.col("member").cast("long").alias("member"), F.col("grp").cast("string").alias("grp"),
        (F.col("position") == "yes").alias("y"), F.col(order).alias("turn"),
    ).dropna(subset=["term", "vote", "member"])
    named = cut(named, "named")
    sides = named.select(F.struct("term", "vote").alias("vote"), F.when(F.col("y"), "yes").otherwise("no").alias("position"))
    split = cut(divided(sides).select("vote.term", "vote.vote"), "divided")
    side = lambda y: F.collect_list(F.when(F.col("y") == y, F.col("vote")))
    lists = named.join(small(split, split.count()), ["term", "vote"]).groupBy("term", "member").agg(side(True).alias("yes"), side(False).alias("no"), F.max_by("grp", "turn").alias("grp"))
    members = cut(lists.withColumn("votes", (F.size("yes") + F.size("no")).cast("long")).filter(F.col("votes") >= least), "members")
    remove(named)
    sums = cut(_flat(members).groupBy("term", "vote").agg(F.sum("y").alias("yes"), F.count("*").alias("n")), "sums")
    enough = members.groupBy("term").count().filter(F.col("count") >= least).join(sums.groupBy("term").agg(F.count("*").alias("v"), F.sum("n").alias("n")), "term")
    return members, sums, cut(enough.filter(F.col("v") >= least).select("term", "n"), "terms")


def _flat(members: DataFrame) -> DataFrame:
    """(term, member, vote, y): a row a cell."""
    cell = lambda y: lambda v: F.struct(v.alias("vote"), F.lit(y).alias("y"))
    return members.select("term", "member", F.explode(F.concat(F.transform("yes", cell(1.0)), F.transform("no", cell(0.0)))).alias("cell")).select("term", "member", "cell.*")


def cells(pos: DataFrame, least: int = 20, order: str = "vote") -> tuple[DataFrame, DataFrame]:
    """(term, vote, member, y, n: cells of the term) of yes and no in divided votes, by members with ``least`` of them, of terms with ``least`` members
    and votes; and (term, member, grp, votes): a member's group is the last by ``order``."""
    members, _, terms = _members(pos, least, order)
    members = members.join(F.broadcast(terms), "term")  # a term is a row of this side
    return _flat(members).join(F.broadcast(terms), "term"), members.select("term", "member", "grp", "votes")


def _taken(draw: Column) -> Column:
    """Whether a draw has a vote: a rule of their names."""
    return F.pmod(F.xxhash64("term", "vote", draw), F.lit(1 << 30)) / float(1 << 30) < TAKEN


class _Fit:
    """Coefficients as they are after a step: x (term, draw, member, x) and ab (term, draw, vote, a, b)."""

    def __init__(self, rows: DataFrame, x: DataFrame, ab: DataFrame):
        self.rows, self.x, self.ab = rows, x, ab
        self.n_x, self.n_ab = x.count(), ab.count()

    def met(self) -> DataFrame:
        """Cells with the coefficients of each draw that has their vote."""
        draws = self.rows.join(small(self.x, self.n_x), ["term", "member"])
        return draws.join(small(self.ab, self.n_ab), ["term", "draw", "vote"])

    def step_votes(self) -> None:
        p = _chance(F.col("a") * F.col("x") - F.col("b"))
        rows = self.met().withColumns({"r": F.col("y") - p, "w": p * (1 - p)})
        sums = rows.groupBy("term", "draw", "vote").agg(
            F.sum(F.col("r") * F.col("x")).alias("rx"), F.sum("r").alias("r"), F.sum(F.col("w") * F.col("x") ** 2).alias("wxx"),
            F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w"), F.first("a").alias("a"), F.first("b").alias("b"),
        )
        a, b = F.col("a"), F.col("b")
        ga, gb = F.col("rx") - a / PRIOR, -F.col("r") - b / PRIOR
        haa, hab, hbb = F.col("wxx") + 1 / PRIOR, -F.col("wx"), F.col("w") + 1 / PRIOR
        det = haa * hbb - hab * hab
        step = lambda g: _clip(g / det, -5.0, 5.0)
        new = sums.select(
            "term", "draw", "vote", _clip(a + step(hbb * ga - hab * gb), -20.0, 20.0).alias("a"), _clip(b + step(haa * gb - hab * ga), -20.0, 20.0).alias("b")
        )
        old, self.ab = self.ab, cut(new, "votes")
        remove(old)

    def step_members(self) -> None:
        p = _chance(F.col("a") * F.col("x") - F.col("b"))
        sums = self.met().groupBy("term", "draw", "member").agg(F.sum((F.col("y") - p) * F.col("a")).alias("g"), F.sum(p * (1 - p) * F.col("a") ** 2).alias("h"))
        both = self.x.join(sums, ["term", "draw", "member"], "left")  # a draw may have none of a member's votes
        g, h = F.coalesce("g", F.lit(0.0)) - F.col("x"), F.coalesce("h", F.lit(0.0)) + 1
        moved = both.select("term", "draw", "member", F.col("x").alias("was"), (F.col("x") + _clip(g / h, -2.0, 2.0)).alias("x"))
        middle = moved.groupBy("term", "draw").agg(F.avg("x").alias("mean"))
        moved = moved.join(F.broadcast(middle), ["term", "draw"])  # a term's draw is a row of this side
        new = cut(moved.select("term", "draw", "member", (F.col("x") - F.col("mean")).alias("x"), F.abs(F.col("x") - F.col("mean") - F.col("was")).alias("far")), "members")
        old, self.x = self.x, new
        remove(old)

    def run(self, iterations: int, still: float) -> None:
        for _ in range(iterations):
            self.step_votes()
            self.step_members()
            if (self.x.agg(F.max("far")).first()[0] or 0.0) < still:
                return


def _started(rows: DataFrame) -> _Fit:
    """Positions begin at the standardised share of yes, slopes at a half, cuts at nought."""
    share = rows.groupBy("term", "member").agg(F.avg("y").alias("share"))
    scale = share.groupBy("term").agg(F.avg("share").alias("mean"), F.stddev_pop("share").alias("sd"))
    x = share.join(F.broadcast(scale), "term").select("term", F.lit(0).alias("draw"), "member", ((F.col("share") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("x"))
    ab = rows.select("term", F.lit(0).alias("draw"), "vote").distinct().withColumns({"a": F.lit(0.5), "b": F.lit(0.0)})
    return _Fit(rows, cut(x.withColumn("far", F.lit(0.0)), "members"), cut(ab, "votes"))


def _drawn(whole: _Fit, draws: int) -> _Fit:
    """A fit for each draw of votes, from where the whole ended; a vote's draws follow from its name."""
    each = F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")
    ab = whole.ab.select("term", each, "vote", "a", "b").filter(_taken(F.col("draw")))
    x = whole.x.select("term", each, "member", "x", F.lit(0.0).alias("far"))
    return _Fit(whole.rows, cut(x, "members"), cut(ab, "votes"))


def _second(rows: DataFrame, x: DataFrame, ab: DataFrame) -> DataFrame:
    """(term, second): the further share of cells called right with a second axis, orthogonal to the first; 0 at least.

    It begins at the leading singular pair of the residuals (absent cells are 0), found by power iteration, then members
    and votes alternate as before, with the first axis held.
    """
    n_x, n_ab = x.count(), ab.count()
    base = F.col("a") * F.col("x") - F.col("b")
    rows = rows.join(small(x.select("term", "member", "x"), n_x), ["term", "member"]).join(small(ab.select("term", "vote", "a", "b"), n_ab), ["term", "vote"])
    rows = cut(rows.select("term", "vote", "member", "y", "x", base.alias("base"), (F.col("y") - _chance(base)).alias("r")), "residuals")
    seed = (F.pmod(F.xxhash64("member", "term"), F.lit(2001)) - 1000) / 1000.0
    u = cut(x.select("term", "member", "x", seed.alias("u")), "u")

    def votes_of(u: DataFrame) -> DataFrame:
        return rows.join(small(u.select("term", "member", "u"), n_x), ["term", "member"]).groupBy("term", "vote").agg(F.sum(F.col("r") * F.col("u")).alias("v"))

    for _ in range(POWER_ITERATIONS):
        back = rows.join(small(votes_of(u), n_ab), ["term", "vote"]).groupBy("term", "member").agg(F.sum(F.col("r") * F.col("v")).alias("new"))
        norm = back.groupBy("term").agg(F.sqrt(F.sum(F.col("new") ** 2)).alias("norm"))
        next_ = u.join(back, ["term", "member"]).join(F.broadcast(norm), "term").filter("norm > 0")
        old, u = u, cut(next_.select("term", "member", "x", (F.col("new") / F.col("norm")).alias("u"), F.abs(F.col("new") / F.col("norm") - F.col("u")).alias("far")), "u")
        remove(old)
        if (u.agg(F.max("far")).first()[0] or 0.0) < 1e-6:
            break
    v = votes_of(u)
    size = u.groupBy("term").agg(F.stddev_pop("u").alias("sd"))
    most = v.groupBy("term").agg(F.max(F.abs("v")).alias("most"))
    x2 = cut(u.join(F.broadcast(size), "term").select("term", "member", "x", (F.col("u") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("x2")), "members")
    a2 = cut(v.join(F.broadcast(most), "term").select("term", "vote", (F.col("v") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0)).alias("a2")), "votes")

    def met() -> DataFrame:
        return rows.join(small(x2.select("term", "member", "x2"), n_x), ["term", "member"]).join(small(a2, n_ab), ["term", "vote"])

    p = _chance(F.col("base") + F.col("a2") * F.col("x2"))
    for _ in range(SECOND_ITERATIONS):
        sums = met().groupBy("term", "member").agg(F.sum((F.col("y") - p) * F.col("a2")).alias("g"), F.sum(p * (1 - p) * F.col("a2") ** 2).alias("h"))
        moved = x2.join(sums, ["term", "member"]).withColumn("was", F.col("x2")).withColumn("x2", F.col("x2") + _clip((F.col("g") - F.col("x2")) / (F.col("h") + 1), -2.0, 2.0))
        by = moved.groupBy("term").agg(F.avg("x2").alias("mean"), F.sum(F.col("x2") * F.col("x")).alias("along"), F.sum(F.col("x")).alias("sum"), F.sum(F.col("x") ** 2).alias("xx"))
        straight = F.col("x2") - F.col("mean") - F.when(F.col("xx") > 0, (F.col("along") - F.col("mean") * F.col("sum")) / F.col("xx")).otherwise(0.0) * F.col("x")
        old, x2 = x2, cut(moved.join(F.broadcast(by), "term").select("term", "member", "x", straight.alias("x2"), F.abs(straight - F.col("was")).alias("far")), "members")
        remove(old)
        sums = met().groupBy("term", "vote").agg(F.sum((F.col("y") - p) * F.col("x2")).alias("g"), F.sum(p * (1 - p) * F.col("x2") ** 2).alias("h"), F.first("a2").alias("was"))
        old, a2 = a2, cut(sums.select("term", "vote", _clip(F.col("was") + _clip((F.col("g") - F.col("was") / PRIOR) / (F.col("h") + 1 / PRIOR), -2.0, 2.0), -20.0, 20.0).alias("a2")), "votes")
        remove(old)
        if (x2.agg(F.max("far")).first()[0] or 0.0) < STILL:
            break
    right = lambda c: F.avg(((c >= 0) == (F.col("y") > 0.5)).cast("double"))
    one, two = right(F.col("base")), right(F.col("base") + F.col("a2") * F.col("x2"))
    return met().groupBy("term").agg(F.greatest(F.lit(0.0), two - one).alias("second"))


def _joined(rows: DataFrame, draws: int, second: bool) -> tuple[DataFrame, DataFrame]:
    """(term, draw, member, x), draw 0 being the whole, and (term, accuracy, second), by joins and aggregations."""
    whole = _started(rows.select("term", "vote", "member", "y"))
    whole.run(ITERATIONS, STILL)
    right = ((F.col("a") * F.col("x") - F.col("b") >= 0) == (F.col("y") > 0.5)).cast("double")
    facts = whole.met().groupBy("term").agg(F.avg(right).alias("accuracy"))
    if second:
        facts = facts.join(_second(whole.rows, whole.x.select("term", "member", "x"), whole.ab.select("term", "vote", "a", "b")), "term")
    else:
        facts = facts.withColumn("second", F.lit(None).cast("double"))
    x = whole.x.select("term", "draw", "member", "x")
    if draws:
        drawn = _drawn(whole, draws)
        drawn.run(DRAW_ITERATIONS, DRAW_STILL)
        x = x.unionByName(drawn.x.select("term", "draw", "member", "x"))
    return x, facts


def _logistic(z: np.ndarray) -> np.ndarray:
    np.clip(z, -30, 30, out=z)
    np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


class _Cells:
    """The cells of one term as arrays, a vote's cells side by side and its members ascending, and the sums of a step over them.

    ``read`` takes rows (vote, yes, no), the latter two lists of members; a vote may have several rows.
    """

    def __init__(self, votes: list[str], names: np.ndarray, ends: np.ndarray, member: np.ndarray, y: np.ndarray):
        self.votes, self.names, self.member, self.y = votes, names, member, y
        self.ends, self.n_votes = ends, len(votes)
        starts, n = np.append(0, ends[:-1]), len(y)
        # a piece of a vote that most members have holds members of a narrow range; else a piece has twice as many cells as there are members
        size = PIECE if 4 * n >= len(votes) * len(names) else max(PIECE, 2 * len(names))
        cuts = np.arange(0, n, size)
        if 4 * n >= len(votes) * size:  # large votes: no piece has cells of two
            cuts = np.union1d(cuts, starts)
        self.pieces = []
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True):
            one, last = np.searchsorted(ends, [low, high - 1], side="right")
            at = np.maximum(starts[one : last + 1], low)
            counts, j = np.minimum(ends[one : last + 1], high) - at, np.arange(one, last + 1)
            own = member[low:high]
            self.pieces.append((slice(low, high), j[counts > 0], at[counts > 0] - low, counts[counts > 0], int(own.min()), int(own.max()) + 1))

    @classmethod
    def read(cls, rows: pa.Table) -> _Cells:
        rows = rows.sort_by("vote")
        coded = rows["vote"].combine_chunks().dictionary_encode()
        code, votes = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        sides = [rows["yes"], rows["no"]]
        names = np.sort(pc.unique(pa.chunked_array([c.flatten() for side in sides for c in side.chunks], pa.int64())).to_numpy())
        sizes = np.stack([pc.list_value_length(side).to_numpy() for side in sides], axis=1).astype(np.int64)
        ends, at = np.cumsum(np.bincount(code, sizes.sum(axis=1), len(votes)).astype(np.int64)), 0
        key = np.empty(int(sizes.sum()), np.int64)  # of a cell: its member and y
        for k in range(len(rows)):
            for side, y in zip(sides, (1, 0), strict=True):
                own = side[k].values.to_numpy(zero_copy_only=False)
                key[at : at + len(own)] = np.searchsorted(names, own) * 2 + y
                at += len(own)
        for low, high in zip(np.append(0, ends[:-1]), ends, strict=True):
            key[low:high].sort()
        return cls(votes, names, ends, (key >> 1).astype(np.int32), (key & 1).astype(np.int8))

    def having(self, votes: set[str]) -> _Cells:
        """The cells of these votes, and the members who have any of them."""
        kept = [k for k, v in enumerate(self.votes) if v in votes]
        starts = np.append(0, self.ends[:-1])
        member, y = (np.concatenate([c[starts[k] : self.ends[k]] for k in kept] or [c[:0]]) for c in (self.member, self.y))
        there = np.zeros(len(self.names), bool)
        there[member] = True
        return _Cells([self.votes[k] for k in kept], self.names[there], np.cumsum((self.ends - starts)[kept]), (np.cumsum(there, dtype=np.int32) - 1)[member], y)

    def of_votes(self, what) -> np.ndarray:
        """Sums by vote of the arrays that ``what`` gives for members, votes and y of a piece."""
        out = None
        for (_, j, first, *_), part in zip(self.pieces, self.parts(), strict=True):
            sums = [np.add.reduceat(w, first) for w in what(*part)]
            out = np.zeros((len(sums), self.n_votes)) if out is None else out
            out[:, j] += sums
        return out

    def of_members(self, what) -> np.ndarray:
        out = None
        for (*_, low, high), (i, j, y) in zip(self.pieces, self.parts(), strict=True):
            sums = what(i, j, y)
            out = np.zeros((len(sums), len(self.names))) if out is None else out
            own = i - low
            for k, w in enumerate(sums):
                out[k, low:high] += np.bincount(own, w, high - low)
        return out

    def parts(self):
        """Members, votes (or the only one) and y of each piece, as NumPy takes them without another conversion."""
        for p, j, _, counts, *_ in self.pieces:
            yield self.member[p].astype(np.intp), np.repeat(j, counts) if len(j) > 1 else j[0], self.y[p].astype(float)

    def share(self, what) -> float:
        """The share of cells for which ``what`` holds."""
        return sum(int(np.count_nonzero(what(*part))) for part in self.parts()) / len(self.y)

    def first_axis(self, iterations: int, still: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        share = np.divide(*self.of_members(lambda i, j, y: (y, np.ones(len(y)))))
        x = (share - share.mean()) / (share.std() or 1.0)
        a, b = np.full(self.n_votes, 0.5), np.zeros(self.n_votes)

        def for_votes(i, j, y):
            at = x[i]
            p = _logistic(a[j] * at - b[j])
            r, w = y - p, p * (1 - p)
            along = w * at
            return r * at, r, along * at, along, w

        def for_members(i, j, y):
            slope = a[j]
            p = _logistic(slope * x[i] - b[j])
            return (y - p) * slope, p * (1 - p) * slope * slope

        for _ in range(iterations):
            was = x
            rx, r, wxx, wx, ww = self.of_votes(for_votes)
            ga, gb, haa, hbb = rx - a / PRIOR, -r - b / PRIOR, wxx + 1 / PRIOR, ww + 1 / PRIOR
            det = haa * hbb - wx * wx
            a = np.clip(a + np.clip((hbb * ga + wx * gb) / det, -5, 5), -20, 20)
            b = np.clip(b + np.clip((haa * gb + wx * ga) / det, -5, 5), -20, 20)
            g, h = self.of_members(for_members)
            x = x + np.clip((g - x) / (h + 1), -2, 2)
            x = x - x.mean()
            if np.abs(x - was).max() < still:
                break
        return x, a, b

    def right(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
        """The share of cells that one axis calls right."""
        return self.share(lambda i, j, y: (a[j] * x[i] - b[j] >= 0) == (y > 0))

    def second_axis(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
        """What another axis adds to the share of cells called right; begins where ``_second`` begins."""
        u = np.random.default_rng(0).standard_normal(len(x))
        left = lambda i, j, y: y - _logistic(a[j] * x[i] - b[j])
        r = np.concatenate([left(*part) for part in self.parts()]) if len(self.y) <= CELLS // 4 else None
        at = 0

        def rest(i, j, y):
            """The residuals of the next piece, kept or found again."""
            nonlocal at
            if r is None:
                return left(i, j, y)
            at = at % len(r) + len(i)
            return r[at - len(i) : at]

        for _ in range(POWER_ITERATIONS):
            was = u
            [v] = self.of_votes(lambda i, j, y: (rest(i, j, y) * was[i],))
            [u] = self.of_members(lambda i, j, y: (rest(i, j, y) * v[j],))
            u = u / (np.linalg.norm(u) or 1.0)
            if np.abs(u - was).max() < 1e-6:
                break
        [a2] = self.of_votes(lambda i, j, y: (rest(i, j, y) * u[i],))
        x2, a2 = u / (u.std() or 1.0), a2 / (np.abs(a2).max() or 1.0)
        both = lambda i, j: a[j] * x[i] - b[j] + a2[j] * x2[i]

        def along(what, i, j, y):
            p = _logistic(both(i, j))
            return (y - p) * what, p * (1 - p) * what * what

        for _ in range(SECOND_ITERATIONS):
            was = x2
            g, h = self.of_members(lambda i, j, y: along(a2[j], i, j, y))
            x2 = x2 + np.clip((g - x2) / (h + 1), -2, 2)
            x2 = x2 - x2.mean()
            x2 = x2 - (x2 @ x) / ((x @ x) or 1.0) * x
            g, h = self.of_votes(lambda i, j, y: along(x2[i], i, j, y))
            a2 = np.clip(a2 + np.clip((g - a2 / PRIOR) / (h + 1 / PRIOR), -2, 2), -20, 20)
            if np.abs(x2 - was).max() < STILL:
                break
        return max(0.0, self.share(lambda i, j, y: (both(i, j) >= 0) == (y > 0)) - self.right(x, a, b))


def _by_vote(members: DataFrame) -> DataFrame:
    """(term, vote, yes, no): lists of members, from each member's lists of votes; a vote has a row for each ``ROW`` cells or so, of all votes, that it is in."""

    def turned(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [pc.list_value_length(batch.column(c)).to_numpy() for c in ("yes", "no")]
        row, no = np.concatenate([np.repeat(np.arange(len(batch)), n) for n in sizes]), np.repeat([0, 1], [n.sum() for n in sizes])
        vote, term = pa.concat_arrays([batch.column(c).flatten() for c in ("yes", "no")]).dictionary_encode(), batch.column("term").dictionary_encode()
        key = (term.indices.to_numpy().astype(np.int64)[row] * len(vote.dictionary) + vote.indices.to_numpy()) * 2 + no
        turn = np.argsort(key, kind="stable")
        member, no = batch.column("member").to_numpy()[row[turn]], no[turn] > 0
        pair, at = np.unique(key[turn] >> 1, return_inverse=True)
        lists = [pa.ListArray.from_arrays(np.append(0, np.cumsum(np.bincount(at[own], minlength=len(pair)))).astype(np.int32), member[own]) for own in (~no, no)]
        names = [term.dictionary.take(pa.array(pair // len(vote.dictionary))), vote.dictionary.take(pa.array(pair % len(vote.dictionary)))]
        return pa.RecordBatch.from_arrays([*names, *lists], ["term", "vote", "yes", "no"])

    def run(batches):
        for batch in batches:
            many = np.cumsum(batch.column("votes").to_numpy())
            ends = [0, *(np.flatnonzero(np.diff(many // ROW)) + 1).tolist(), len(batch)]
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                if high > low:
                    yield turned(batch.slice(low, high - low))

    return members.select("term", "member", "yes", "no", "votes").mapInArrow(run, "term string, vote string, yes array<long>, no array<long>")


def _grouped(members: DataFrame, terms: int, draws: int, second: bool) -> tuple[DataFrame, DataFrame]:
    """As ``_joined``, the whole of a term in a task, and some of its draws, one after the other, in another: votes go to a task as lists, once."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        term, part, taken = key[0].as_py(), key[1].as_py(), {}
        for vote, own in zip(rows["vote"].to_pylist(), rows["draws"].to_pylist(), strict=True):
            for draw in own:
                taken.setdefault(draw, set()).add(vote)
        found, right, more, made = _Cells.read(rows), None, None, []
        del rows
        for draw, votes in sorted(taken.items()):
            own = found.having(votes) if part else found
            x, a, b = own.first_axis(*((DRAW_ITERATIONS, DRAW_STILL) if part else (ITERATIONS, STILL)))
            made.append((own.names, np.full(len(x), draw, np.int32), x))
            if not part:
                right, more = own.right(x, a, b), own.second_axis(x, a, b) if second else None
        member, draw, x = (np.concatenate(c) for c in zip(*made, strict=True))
        turn = np.argsort(member, kind="stable")
        names, first = np.unique(member[turn], return_index=True)
        points = pa.ListArray.from_arrays(np.append(first, len(turn)).astype(np.int32), pa.StructArray.from_arrays([pa.array(draw[turn]), pa.array(x[turn])], ["draw", "x"]))
        n = len(names)
        return pa.table([pa.array([term] * n, pa.string()), names, points, pa.array([right] * n, pa.float64()), pa.array([more] * n, pa.float64())], ["term", "member", "points", "accuracy", "second"])

    votes = cut(_by_vote(members), "votes")
    cores = members.sparkSession.sparkContext.defaultParallelism
    parts = min(draws, -(-TASKS * cores // max(1, terms)))
    drawn = F.filter(F.sequence(F.col("part"), F.lit(draws), F.lit(max(1, parts))), _taken) if draws else F.array().cast("array<int>")
    each = votes.select("term", "vote", "yes", "no", F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("part"))
    dealt = each.withColumn("draws", F.when(F.col("part") == 0, F.array(F.lit(0))).otherwise(drawn)).filter(F.size("draws") > 0)
    # more partitions than tasks: few have two of them
    dealt = dealt.repartition(4 * max(1, terms) * (parts + 1), "term", "part")
    schema = "term string, member long, points array<struct<draw: int, x: double>>, accuracy double, second double"
    out = cut(dealt.groupBy("term", "part").applyInArrow(one, schema), "points")
    remove(votes)
    facts = out.filter("accuracy is not null").groupBy("term").agg(F.first("accuracy").alias("accuracy"), F.first("second").alias("second"))
    return out.select("term", "member", "points"), facts


def ideal_points(pos: DataFrame, least: int = 20, anchors: tuple[str, ...] = (), order: str = "vote", draws: int = DRAWS, second: bool = True) -> DataFrame:
    """(term, member, grp, position, spread, votes, accuracy, null_accuracy, apre, second) from (term, vote, member, grp, position).

    Only yes and no of divided votes, and members with ``least`` of them, count; a term with fewer than ``least`` members or
    votes gives no rows.  A member's group is the last by ``order`` (a column, such as the time of a vote).  The anchor group (the
    first of ``anchors`` present, else the largest) has a mean of at least 0.  ``spread`` is the deviation over the draws; ``accuracy``
    the share of cells called right, ``null_accuracy`` that of each vote's majority, ``apre`` what the model saves of the latter's
    errors, ``second`` what another axis, orthogonal to the first, would add to ``accuracy`` (null unless asked for).
    """
    members, sums, terms = _members(pos, least, order)
    members = members.join(F.broadcast(terms), "term")  # a term is a row of this side
    sizes = [r.n for r in terms.select("n").collect()]  # a number a term
    n_large = sum(n > CELLS for n in sizes)
    x, facts = _grouped(members.filter(F.col("n") <= CELLS), len(sizes) - n_large, draws, second)
    if n_large:
        more, of_more = _joined(cut(_flat(members.filter(F.col("n") > CELLS)), "large"), draws, second)
        x, facts = x.unionByName(more.select("term", "member", F.array(F.struct("draw", "x")).alias("points"))), facts.unionByName(of_more)

    null = sums.join(F.broadcast(terms.select("term")), "term").groupBy("term").agg((F.sum(F.greatest("yes", F.col("n") - F.col("yes"))) / F.sum("n")).alias("null_accuracy"))
    whole = lambda p: p["draw"] == 0
    points = x.groupBy("term", "member").agg(F.flatten(F.collect_list("points")).alias("points")).withColumn("x", F.filter("points", whole)[0]["x"])
    named = cut(points.join(members.select("term", "member", "grp", "votes"), ["term", "member"]), "fitted")
    sides = named.groupBy("term", "grp").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in anchors]).cast("array<string>"), F.col("grp")), F.lit(0))
    first = F.when(rank > 0, rank).otherwise(len(anchors) + 1)
    anchor = sides.groupBy("term").agg(F.min_by("mean", F.struct(F.col("grp").isNull(), first, -F.col("n"), "grp")).alias("mean"))
    terms = facts.join(null, "term").join(anchor.select("term", F.when(F.col("mean") < 0, -1.0).otherwise(1.0).alias("sign")), "term")

    both = named.select("term", "member", "x", F.explode("points").alias("point")).select("term", "member", "x", "point.draw", F.col("point.x").alias("d")).filter("draw > 0")
    turn = both.groupBy("term", "draw").agg(F.when(F.sum(F.col("d") * F.col("x")) < 0, -1.0).otherwise(1.0).alias("turn"))
    spread = both.join(F.broadcast(turn), ["term", "draw"]).groupBy("term", "member").agg(F.stddev_pop(F.col("d") * F.col("turn")).alias("spread"))
    out = named.join(spread, ["term", "member"], "left").join(F.broadcast(terms), "term")  # a term, or its draw, is a row of these sides
    saved = F.when(F.col("null_accuracy") < 1, (F.col("accuracy") - F.col("null_accuracy")) / (1 - F.col("null_accuracy"))).otherwise(0.0)
    return out.select(
        "term", "member", "grp", F.round(F.col("x") * F.col("sign"), 4).alias("position"), F.round("spread", 4).alias("spread"), "votes", "accuracy", "null_accuracy", saved.alias("apre"), "second"
    )


def group_positions(points: DataFrame) -> DataFrame:
    """Mean and population deviation of each group's positions."""
    return points.groupBy("term", "grp").agg(F.count("*").alias("members"), F.round(F.avg("position"), 4).alias("mean"), F.round(F.stddev_pop("position"), 4).alias("sd"))
