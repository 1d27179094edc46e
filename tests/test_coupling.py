"""Couplings of graphs against a plain matrix version, and their properties."""
import numpy as np
import pytest

from skelgraph.operators import coupling

NODE, COST, PAIR = "sample_id string, node_id int, vec array<double>", "sample_id string, i int, j int, cost double", "sample_a string, sample_b string"


def plain(x, y, da, db, alpha, reg, rounds, steps):
    """Score and coupling by whole matrices and log sums."""
    c = 1 - (np.divide(x, np.linalg.norm(x, axis=1, keepdims=True) + 1e-8) @ np.divide(y, np.linalg.norm(y, axis=1, keepdims=True) + 1e-8).T + 1) / 2
    n, m = c.shape
    t, g = np.full((n, m), 1 / n / m), np.zeros(m)
    for k in range(rounds):
        eps = max(reg, coupling.START / coupling.STEP ** k)
        cost = (1 - alpha) * c + 2 * alpha * ((da ** 2).sum(1)[:, None] / n + (db ** 2).sum(1)[None] / m - 2 * da @ t @ db)
        for _ in range(steps + 1):
            f = -eps * (np.log(n) + np.logaddexp.reduce((g[None] - cost) / eps, 1))
            g = -eps * (np.log(m) + np.logaddexp.reduce((f[:, None] - cost) / eps, 0))
        t = np.exp((f[:, None] + g[None] - cost) / eps)
    t *= np.minimum(1, 1 / n / t.sum(1))[:, None]
    t *= np.minimum(1, 1 / m / t.sum(0))[None]
    x, y = np.maximum(1 / n - t.sum(1), 0), np.maximum(1 / m - t.sum(0), 0)
    t += np.outer(x, y) / x.sum() if x.sum() > 0 else 0
    return min(1, max(0, 1 - (t * c).sum() / (c.max() + 1e-9))), t


@pytest.fixture(scope="module")
def graphs(spark):
    rng = np.random.default_rng(3)
    made = {}
    for name, n in (("a", 6), ("b", 4), ("one", 1)):
        d = rng.uniform(0.2, 2, (n, n))
        made[name] = (rng.normal(size=(n, 3)), np.triu(d, 1) + np.triu(d, 1).T)
    turn = rng.permutation(6)
    made["copy"] = (made["a"][0][turn], made["a"][1][turn][:, turn])
    h = spark.createDataFrame([(s, i, v.tolist()) for s, (x, _) in made.items() for i, v in enumerate(x)], NODE)
    costs = spark.createDataFrame([(s, i, j, float(v)) for s, (_, d) in made.items() for (i, j), v in np.ndenumerate(d)], COST)
    return made, h, costs, turn


@pytest.mark.parametrize("tile", [128, 2])
def test_coupling_equals_plain_matrices(spark, graphs, monkeypatch, tile):
    monkeypatch.setattr(coupling, "TILE", tile)
    made, h, costs, _ = graphs
    names = [("a", "b"), ("b", "a"), ("one", "a")]
    pairs = spark.createDataFrame([*names, names[0], ("a", "none"), (None, "a")], PAIR)
    scores, found = coupling.fgw_similarity(h, h, costs, costs, pairs, rounds=3, steps=4)
    scores, cells = {(r.sample_a, r.sample_b): r.score for r in scores.collect()}, found.collect()
    assert set(scores) == set(names)
    for a, b in names:
        want, t = plain(made[a][0], made[b][0], made[a][1], made[b][1], 0.8, 1e-3, 3, 4)
        got = np.zeros(t.shape)
        for r in cells:
            if (r.sample_a, r.sample_b) == (a, b):
                got[r.i, r.j] += r.w
        assert np.abs(got - t).max() < 1e-7 and scores[a, b] == pytest.approx(want, abs=1e-7)
        assert np.abs(got.sum(1) - 1 / len(got)).max() < 1e-9 and np.abs(got.sum(0) - 1 / len(got.T)).max() < 1e-9


def test_copies_score_one_and_find_their_nodes(spark, graphs):
    _, h, costs, turn = graphs
    scores, found = coupling.fgw_similarity(h, h, costs, costs, spark.createDataFrame([("a", "copy"), ("a", "a")], PAIR))
    assert [r.score for r in scores.collect()] == pytest.approx([1, 1], abs=1e-6)
    kept = {(r.i, r.j) for r in found.where("sample_b = 'copy' AND w > 1e-3").collect()}
    assert kept == {(int(i), j) for j, i in enumerate(turn)}


def test_no_pairs_no_costs_and_other_types(spark, graphs):
    made, h, costs, _ = graphs
    none = coupling.fgw_similarity(h, h, costs, costs, spark.createDataFrame([], PAIR), rounds=1, steps=1)
    assert none[0].count() == none[1].count() == 0
    wide = costs.selectExpr("sample_id", "CAST(i AS long) AS i", "CAST(j AS long) AS j", "cost")
    got = [coupling.fgw_similarity(h, h, c, c, spark.createDataFrame([("a", "b")], PAIR), rounds=2, steps=2)[0].first().score for c in (costs, wide)]
    assert got[0] == pytest.approx(got[1], abs=1e-12)
    score = coupling.fgw_similarity(h, h, costs.limit(0), costs.limit(0), spark.createDataFrame([("a", "b")], PAIR), rounds=2, steps=3)[0].first().score
    assert score == pytest.approx(plain(made["a"][0], made["b"][0], np.zeros((6, 6)), np.zeros((4, 4)), 0.8, 1e-3, 2, 3)[0], abs=1e-7)
