"""Ideal points equal a dense fit, and find the axes that made the votes."""

import numpy as np
import pytest

from plenum.operators import idealpoint


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def dense(i, j, y, members, votes, x, a, b, rounds):
    """Alternating damped Newton steps on arrays: the same steps as the operator's."""
    for _ in range(rounds):
        p = logistic(a[j] * x[i] - b[j])
        r, w = y - p, p * (1 - p)
        ga, gb = np.bincount(j, r * x[i], votes) - a / 16, -np.bincount(j, r, votes) - b / 16
        haa, hab, hbb = np.bincount(j, w * x[i] ** 2, votes) + 1 / 16, -np.bincount(j, w * x[i], votes), np.bincount(j, w, votes) + 1 / 16
        det = haa * hbb - hab**2
        a, b = np.clip(a + np.clip((hbb * ga - hab * gb) / det, -5, 5), -20, 20), np.clip(b + np.clip((haa * gb - hab * ga) / det, -5, 5), -20, 20)
        p = logistic(a[j] * x[i] - b[j])
        x = x + np.clip((np.bincount(i, (y - p) * a[j], members) - x) / (np.bincount(i, p * (1 - p) * a[j] ** 2, members) + 1), -2, 2)
        x = x - x.mean()
    return x, a, b


def dense_second(i, j, y, x, a, b, rounds=40):
    """Singular value decomposition of the full residual matrix, then alternating steps with the first axis held."""
    base = a[j] * x[i] - b[j]
    matrix = np.zeros((len(x), len(a)))
    matrix[i, j] = y - logistic(base)
    u, _, v = np.linalg.svd(matrix, full_matrices=False)
    x2, a2 = u[:, 0] / u[:, 0].std(), v[0] / np.abs(v[0]).max()
    for _ in range(rounds):
        p = logistic(base + a2[j] * x2[i])
        x2 = x2 + np.clip((np.bincount(i, (y - p) * a2[j], len(x)) - x2) / (np.bincount(i, p * (1 - p) * a2[j] ** 2, len(x)) + 1), -2, 2)
        x2 = x2 - x2.mean()
        x2 = x2 - (x2 @ x) / (x @ x) * x
        p = logistic(base + a2[j] * x2[i])
        a2 = np.clip(a2 + np.clip((np.bincount(j, (y - p) * x2[i], len(a)) - a2 / 16) / (np.bincount(j, p * (1 - p) * x2[i] ** 2, len(a)) + 1 / 16), -2, 2), -20, 20)
    return max(0.0, ((base + a2[j] * x2[i] >= 0) == (y > 0.5)).mean() - ((base >= 0) == (y > 0.5)).mean())


@pytest.fixture(scope="module")
def record():
    """Two terms; in the second, half of the votes follow another axis; some cells are missing."""
    rng, rows = np.random.default_rng(8), []
    for term, n, m in (("a", 26, 60), ("b", 31, 80)):
        side, other = rng.normal(size=n), rng.normal(size=n)
        for v in range(m):
            axis = other if term == "b" and v % 2 else side
            a, cut = rng.choice([-3, 3]), rng.normal()
            for who in range(n):
                if rng.random() < 0.9:
                    rows.append((term, v, who, "left" if side[who] < 0 else "right", "yes" if rng.random() < logistic(a * axis[who] - cut) else "no"))
    return rows


def test_fit_equals_a_dense_fit(spark, record):
    pos = spark.createDataFrame(record, "term string, vote long, member long, grp string, position string")
    got = idealpoint.ideal_points(pos, anchors=("right",), draws=3).toPandas()
    rows, _ = idealpoint.cells(pos)
    kept = rows.toPandas()
    assert set(got.term) == {"a", "b"} and (got.spread > 0).all()
    for term in ("a", "b"):
        mine, c = got[got.term == term].sort_values("member"), kept[kept.term == term]
        i, names = c.member.factorize(sort=True)
        j, votes = c.vote.factorize(sort=True)
        y = c.y.to_numpy()
        share = np.bincount(i, y) / np.bincount(i)
        x, a, b = dense(i, j, y, len(names), len(votes), (share - share.mean()) / share.std(), np.full(len(votes), 0.5), np.zeros(len(votes)), 60)
        sign = np.sign(np.mean([x[k] for k, w in enumerate(names) if mine.grp.iloc[k] == "right"]))
        assert list(mine.member) == list(names) and list(mine.votes) == list(np.bincount(i))
        assert np.abs(mine.position - sign * x).max() < 2e-3
        right = ((a[j] * x[i] - b[j] >= 0) == (y > 0.5)).mean()
        yes, n = np.bincount(j, y), np.bincount(j)
        null = np.maximum(yes, n - yes).sum() / n.sum()
        first = mine.iloc[0]
        assert abs(first.accuracy - right) < 2e-3 and abs(first.null_accuracy - null) < 1e-9 and abs(first.apre - (right - null) / (1 - null)) < 1e-2
        assert abs(first.second - dense_second(i, j, y, x, a, b)) < 0.01
        assert first.second > 0.03 if term == "b" else first.second < 0.05


def test_large_terms_are_fitted_by_joins(spark, record, monkeypatch):
    """No term in memory gives what all terms in memory give."""
    monkeypatch.setattr(idealpoint, "STILL", 1e-3)
    pos = spark.createDataFrame([r for r in record if r[0] == "b"], "term string, vote long, member long, grp string, position string")
    want = idealpoint.ideal_points(pos, draws=0).toPandas().set_index("member")
    monkeypatch.setattr(idealpoint, "CELLS", 0)
    monkeypatch.setattr(idealpoint, "DRAW_ITERATIONS", 2)
    got = idealpoint.ideal_points(pos, draws=2).toPandas().set_index("member").loc[want.index]
    assert np.abs(got.position - want.position).max() < 1e-3 and (got.spread > 0).all()
    assert np.allclose(got[["accuracy", "apre"]], want[["accuracy", "apre"]]) and abs(got.second - want.second).max() < 0.01


def test_small_terms_and_parts_left_out(spark, record):
    few = spark.createDataFrame([r for r in record if r[1] < 15], "term string, vote long, member long, grp string, position string")
    assert idealpoint.ideal_points(few, draws=0, second=False).count() == 0
    pos = spark.createDataFrame([r for r in record if r[0] == "a"], "term string, vote long, member long, grp string, position string")
    one = idealpoint.ideal_points(pos, draws=0, second=False).first()
    assert one.spread is None and one.second is None
    sides = idealpoint.group_positions(idealpoint.ideal_points(pos, draws=0, second=False, anchors=("none", "left"))).toPandas().set_index("grp")
    assert sides["mean"]["left"] > 0 > sides["mean"]["right"] and sides.members.sum() == 26


def test_a_vote_may_come_in_rows_and_cells_in_pieces(spark, record, monkeypatch):
    """However votes are cut to rows and cells to pieces, the fit is the same, and no cell goes to a draw as a row."""
    pos = spark.createDataFrame([r for r in record if r[0] == "b"], "term string, vote long, member long, grp string, position string")
    want = idealpoint.ideal_points(pos, draws=2).toPandas().set_index("member")
    monkeypatch.setattr(idealpoint, "ROW", 300)
    monkeypatch.setattr(idealpoint, "PIECE", 7)
    sizes = []
    made = idealpoint.cut
    monkeypatch.setattr(idealpoint, "cut", lambda df, tag: (lambda out: (sizes.append(out.count()) if tag == "votes" else None, out)[1])(made(df, tag)))
    got = idealpoint.ideal_points(pos, draws=2).toPandas().set_index("member").loc[want.index]
    assert np.abs(got.position - want.position).max() < 2e-4 and np.abs(got.spread - want.spread).max() < 2e-4
    assert np.allclose(got[["accuracy", "second"]], want[["accuracy", "second"]])
    assert len(sizes) == 1 and 80 < sizes[0] <= 80 * 9 < want.votes.sum()


def test_positions_are_computed_once_and_a_task_fits_several_draws(spark, record, monkeypatch):
    """The rows that come in are computed once, and draws that share a task, its votes and members are those that have one each."""
    rows = [r for r in record if r[0] == "a"]
    pos = spark.createDataFrame(rows, "term string, vote long, member long, grp string, position string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    want = idealpoint.ideal_points(pos.mapInArrow(counted, pos.schema), draws=9, second=False).toPandas().set_index("member")
    assert seen.value == len(rows)
    monkeypatch.setattr(idealpoint, "TASKS", 1)
    got = idealpoint.ideal_points(pos, draws=9, second=False).toPandas().set_index("member").loc[want.index]
    assert (got.spread == want.spread).all() and (got.position == want.position).all()
    drawn = np.random.default_rng(1).random((7, 5)) < 0.5  # votes by members: another set of members in each draw
    ends, member = np.cumsum(drawn.sum(axis=1)), np.nonzero(drawn)[1].astype(np.int32)
    few = idealpoint._Cells(list("abcdefg"), np.arange(5) * 10, ends, member, (member % 2).astype(np.int8)).having({"b", "e"})
    assert [few.names[few.member[k:n]].tolist() for k, n in ((0, few.ends[0]), (few.ends[0], few.ends[1]))] == [(np.flatnonzero(drawn[v]) * 10).tolist() for v in (1, 4)]
