"""Assignment, shortest paths, medians, numbering and graph embedding against brute force and closed forms."""
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skelgraph import store
from skelgraph.operators import gnn, matching, numbering, paths
from skelgraph.operators.median import exact_median
from skelgraph.plans import accuracy

NODE = "sample_id string, node_id int, vec array<double>"


def cosine(a, b):
    a, b = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8) for x in (np.array(a), np.array(b)))
    return a @ b.T


def best(sims):
    """The greatest mean similarity of a matching of the shorter side."""
    if len(sims) > len(sims[0]):
        sims = sims.T
    n, m = sims.shape
    return max(np.mean([sims[i, c] for i, c in enumerate(p)]) for p in itertools.permutations(range(m), n))


def rounds(benefit, rows, least=1e-7):
    """The auction's rounds over blocks of `rows` rows of one matrix: the owners of its columns."""
    n, m = benefit.shape
    prices, owner, eps, done = np.zeros(m), np.full(m, -1), matching.EPSILON, False
    while not done:
        bids = {}
        for at in range(0, n, rows):
            ids = np.arange(at, min(n, at + rows))
            ids = ids[~np.isin(ids, owner)]
            if len(ids):
                for j, (i, price) in matching._bids(benefit[ids], ids, prices, owner, n, eps).items():
                    bids[j] = max(bids.get(j, (-1, -1)), (price, i))
        for j, (price, i) in bids.items():
            prices[j], owner[j] = price, i
        prices, owner, eps, done = matching._settle(n, prices, owner, eps, least)
    return owner


def test_blocks_that_bid_against_each_other_find_the_optimum():
    rng = np.random.default_rng(6)
    for k in range(60):
        n, m = sorted(rng.integers(1, 8, 2))
        benefit = rng.integers(0, 5, (n, m)) / 4 if k % 2 else rng.uniform(-1, 1, (n, m))
        for rows in (1, 2, 100):
            owner = rounds(benefit, rows)
            assert sorted(owner[owner >= 0]) == list(range(n))
            assert benefit[owner[owner >= 0], np.flatnonzero(owner >= 0)].mean() == pytest.approx(best(benefit), abs=1e-5)


def test_assignment_equals_brute_force(spark, monkeypatch):
    """Many matrices at once, tiles of three columns; equal vectors and ties."""
    monkeypatch.setattr(matching, "COLUMNS", 3)
    rng = np.random.default_rng(3)
    sides, shape = {}, {"one": 1, "five": 5, "six": 6, "seven": 7}
    for name, n in shape.items():
        sides[name] = rng.normal(size=(n, 4)).tolist()
    sides["same"] = [[1.0, 0.0, 0.0, 0.0]] * 4 + [[0.0, 1.0, 0.0, 0.0]] * 2
    sides["copy"] = [sides["seven"][k] for k in (3, 1, 6, 0, 2, 5, 4)]
    nodes = spark.createDataFrame([(s, 10 * k, v) for s, vs in sides.items() for k, v in enumerate(vs)], NODE)
    asked = [("seven", "seven"), ("seven", "copy"), ("five", "seven"), ("seven", "five"), ("one", "six"), ("same", "six"), ("same", "same"), ("six", "none"), ("seven", "five"), (None, "six")]
    scores, pairs = matching.node_assignment(nodes, nodes, spark.createDataFrame(asked, "sample_a string, sample_b string"))
    scores, pairs = {(r.sample_a, r.sample_b): r for r in scores.collect()}, pairs.collect()
    assert len(scores) == len(set(asked))
    for a, b in set(asked):
        got, own = scores[a, b], [r for r in pairs if (r.sample_a, r.sample_b) == (a, b)]
        if a is None or b == "none":
            assert (got.score, got.coverage, own) == (0, 0, [])
            continue
        sims = cosine(sides[a], sides[b])
        assert got.score == pytest.approx(best(sims), abs=1e-6)
        assert got.coverage == pytest.approx(min(sims.shape) / max(sims.shape)) and len(own) == min(sims.shape)
        assert len({r.i for r in own}) == len({r.j for r in own}) == len(own)
        assert all(r.sim == pytest.approx(sims[r.i // 10, r.j // 10]) for r in own)
    assert scores["seven", "copy"].score == pytest.approx(1, abs=1e-6)


def test_assignment_of_one_tile_writes_no_matrix(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng = np.random.default_rng(12)
    sides = {s: rng.normal(size=(n, 3)).round(1).tolist() for s, n in (("a", 4), ("b", 7), ("c", 7))}
    nodes = spark.createDataFrame([(s, 5 * k, v) for s, vs in sides.items() for k, v in enumerate(vs)], NODE)
    asked = spark.createDataFrame([(x, y) for x in "abc" for y in "abc"], "sample_a string, sample_b string")
    names = {}
    for rows in (2, 128):  # in blocks by rounds, and in one tile
        monkeypatch.setattr(matching, "ROWS", rows)
        before = set(os.listdir(tmp_path / "skelgraph" / spark.sparkContext.applicationId)) if names else set()
        scores, pairs = matching.node_assignment(nodes, nodes, asked)
        scores = {(r.sample_a, r.sample_b): r.score for r in scores.collect()}
        assert pairs.count() == 4 * 5 + 7 * 4 and all(got == pytest.approx(best(cosine(sides[x], sides[y])), abs=1e-6) for (x, y), got in scores.items())
        own = tmp_path / "skelgraph" / spark.sparkContext.applicationId
        names[rows] = {os.listdir(own / f)[0] for f in set(os.listdir(own)) - before}
    assert "blocks" in names[2] and names[128] == {"sizes", "matched"}


def test_assignment_of_given_similarities(spark):
    rng = random.Random(5)
    rows = [("g", "h", a, b, rng.random()) for a in range(5) for b in range(4)] + [("x", None, 1, 2, 0.5)]
    rows = [r for r in rows if r[2:4] != (3, 2)]  # a pair that is not given counts as 0
    got = matching.sample_assignment(spark.createDataFrame(rows, "group_a string, group_b string, a int, b int, sim double")).collect()
    sims = np.zeros((5, 4))
    for _, _, a, b, s in rows[:-1]:
        sims[a, b] = s
    own = [r for r in got if r.group_a == "g"]
    assert len(own) == 4 and np.mean([r.sim for r in own]) == pytest.approx(best(sims), abs=1e-6)
    assert [(r.a, r.b, r.sim) for r in got if r.group_a == "x"] == [(1, 2, 0.5)]


def test_accuracy_of_a_copy_is_one(spark):
    rows = [(s, k, f"n{k}", "Node", [math.cos(k), math.sin(k)]) for s in ("real", "copy") for k in range(6)] + [("other", 0, "z", "Path", [1.0, 0.0])]
    n = spark.createDataFrame(rows, "sample_id string, node_id int, name string, type string, vec array<double>")
    real = n.where("sample_id = 'real'")
    got = {r.sample_a: r for r in accuracy.accuracy(n, real, n, real).collect()}
    assert got["copy"].fidelity == pytest.approx(1, abs=1e-6) and got["copy"].coverage == 1
    assert got["other"].type == 0 and got["other"].struct == pytest.approx(1, abs=1e-6)


def test_shortest_paths_equal_floyd_warshall(spark):
    rng = random.Random(8)
    edges = [(s, rng.randrange(14), rng.randrange(14), rng.choice([0.0, 1e-9, 0.3, 1.0, 4.0])) for s in "ab" for _ in range(22)]
    nodes = spark.createDataFrame([(s, k) for s in "abc" for k in range(14)], "sample_id string, node_id int")
    got = paths.shortest_path_costs(spark.createDataFrame(edges, "sample_id string, src int, dst int, w double"), nodes).collect()
    assert len(got) == 3 * 14 * 14
    for s in "abc":
        d = np.full((14, 14), np.inf)
        np.fill_diagonal(d, 0)
        for _, a, b, w in (e for e in edges if e[0] == s):
            if w > 0 and a != b:
                d[a, b] = d[b, a] = min(d[a, b], 1 / max(w, 1e-6))
        for k in range(14):
            d = np.minimum(d, d[:, k:k + 1] + d[k:k + 1, :])
        d[np.isinf(d)] = 0
        d = d / (np.median(d[d > 0]) if (d > 0).any() else 1)
        assert all(r.cost == pytest.approx(d[r.i, r.j]) for r in got if r.sample_id == s)


def test_small_and_large_maps_take_the_same_paths(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    rng = random.Random(11)
    edges = [(s, rng.randrange(n), rng.randrange(n), rng.uniform(0.1, 3)) for s, n in (("a", 9), ("b", 30)) for _ in range(3 * n)]
    edges = spark.createDataFrame(edges, "sample_id string, src int, dst int, w double")
    nodes = spark.createDataFrame([(s, k) for s, n in (("a", 9), ("b", 30), ("one", 1)) for k in range(n)], "sample_id string, node_id int")

    def written():
        return [where for where, _, files in os.walk(tmp_path) if any(f.endswith(".parquet") for f in files)]

    whole = sorted(map(tuple, paths.shortest_path_costs(edges, nodes).collect()))
    assert len(whole) == 81 + 900 + 1 and written() == []  # nothing is written for maps that a task holds
    for small in (0, 10):
        got = sorted(map(tuple, paths.shortest_path_costs(edges, nodes, small).collect()))
        assert [r[:3] for r in got] == [r[:3] for r in whole] and np.allclose([r[3] for r in got], [r[3] for r in whole], rtol=1e-12)
    assert sorted(os.path.basename(w) for w in written()) == ["distances"] * 2 + ["ranges"] * 2  # what a result reads, not what each round wrote


def test_exact_median_of_large_groups(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5, -3.0, rng.random() * 1e9])) for g in ("x", "y", None) for _ in range(rng.randrange(150, 300))]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("none", None)] + [("ties", 7.0)] * 90 + [("ends", 0.0)] * 40 + [("ends", 1e300)] * 40
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: r.m for r in df.where("v IS NOT NULL").groupBy("g").agg(F.median("v").alias("m")).collect()}
    for few, bins in ((20, 4), (5, 16), (10 ** 6, 4)):
        got = exact_median(df, ["g"], "v", "m", few, bins).collect()
        assert {r.g: r.m for r in got} == pytest.approx(want) and len(got) == len(want)


def test_numbers_equal_a_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["big", "big", "big", "b", None]), rng.randrange(3), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, layer int, k int").repartition(5)
    for by in (["g"], []):
        want = df.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy("layer", "k")) - 1)
        got = numbering.numbered(df, "no", by, ["layer", "k"])
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert numbering.numbered(df.limit(0), "no", ["g"], ["k"]).count() == 0


def dense(x, edges, w, heads, stages=(lambda tag: True,)):
    """Node vectors of one graph by plain loops."""
    h = np.maximum(x @ w["enc"] + w["enc_b"], 0)
    for layer in w["layers"]:
        for stage in stages:
            some = [e for e in edges if stage(e[2])]
            if not some:
                continue
            q, k, v = h @ layer["q"], h @ layer["k"], h @ layer["v"]
            out = np.tile(layer["b"], (len(h), 1)).astype(float)
            size = len(layer["b"]) // heads
            for i in range(len(h)):
                into = [e for e in some if e[1] == i]
                for a in range(heads if into else 0):
                    part = slice(a * size, (a + 1) * size)
                    s = np.array([q[i, part] @ k[e[0], part] + q[i, part] @ (np.array(e[3]) @ layer["e"])[part] for e in into])
                    s = np.exp(np.where(s > 0, s, 0.2 * s))
                    out[i, part] += (s / s.sum()) @ v[[e[0] for e in into], part]
            h = gnn.norm(h + out, layer["scale"], layer["shift"])
    return h


@pytest.mark.parametrize("staged", [False, True])
def test_embedding_equals_plain_loops(spark, staged):
    """Two graphs, two layers of two heads, a target of many edges in small batches, a node without edges."""
    rng = np.random.default_rng(4)
    tags = ["SSG", "TOPO_on_line", "HYP_PATH_NODE", "REL_Gaze"]
    x = {s: rng.normal(size=(9, 5)) for s in "ab"}
    edges = {s: [(int(rng.integers(9)), int(rng.choice([0, 0, 1, 2, 3, 4, 5, 6, 7])), str(rng.choice(tags)), rng.normal(size=3).tolist()) for _ in range(120)] for s in "ab"}
    w = gnn.default_weights(5, 3, 8, 2)
    for layer in w["layers"]:
        layer["b"] = rng.normal(size=8)
    features = spark.createDataFrame([(s, k, v.tolist()) for s in "ab" for k, v in enumerate(x[s])], "sample_id string, node_id int, x array<double>").repartition(3)
    rows = spark.createDataFrame([(s, *e) for s in "ab" for e in edges[s]], "sample_id string, src int, dst int, tag string, attr array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        nodes, graphs = gnn.gnn_embed(features, rows, w, heads=2, staged=staged)
        nodes, graphs = nodes.collect(), {r.sample_id: r.vec for r in graphs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    stages = [lambda t: t == "HYP_DISTRICT_PATH", lambda t: t == "HYP_PATH_NODE", lambda t: t.startswith("TOPO"), lambda t: t in ("SSG", "REL_Gaze")] if staged else [lambda t: True]
    for s in "ab":
        want = dense(x[s], edges[s], w, 2, stages)
        assert len([r for r in nodes if r.sample_id == s]) == 9
        for r in nodes:
            if r.sample_id == s:
                assert r.vec == pytest.approx(want[r.node_id].tolist())
        g = np.maximum(want.mean(0) @ w["out1"], 0) @ w["out2"]
        assert graphs[s] == pytest.approx(g.tolist())


def test_star_of_equal_leaves_has_a_closed_form(spark):
    """Equal messages weigh alike, so the hub gets one of them; large scores do not overflow."""
    w = gnn.default_weights(2, 1, 4, 1)
    w["layers"][0]["q"] = w["layers"][0]["q"] * 1e3
    features = spark.createDataFrame([(1, 0, [1.0, 2.0])] + [(1, k, [300.0, -200.0]) for k in range(1, 6)], "sample_id int, node_id int, x array<double>")
    edges = spark.createDataFrame([(1, k, 0, "SSG", [1.0]) for k in range(1, 6)], "sample_id int, src int, dst int, tag string, attr array<double>")
    got = {r.node_id: r.vec for r in gnn.gnn_embed(features, edges, w, heads=1)[0].collect()}
    h = np.maximum(np.array([[1.0, 2.0], [300.0, -200.0]]) @ w["enc"], 0)
    layer = w["layers"][0]
    assert got[0] == pytest.approx(gnn.norm(h[:1] + h[1:] @ layer["v"], 1, 0)[0].tolist())
    assert got[3] == pytest.approx(gnn.norm(h[1:], 1, 0)[0].tolist())
