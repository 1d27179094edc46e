"""Neighbours and topology of uneven maps equal the plain joins; few copies of wide features."""
import random

from pyspark.sql import functions as F

from skelgraph.operators import boxes, skeleton, topology

RNG = random.Random(9)


def test_neighbours_with_outliers_and_clusters(spark):
    rows = [("far", k, RNG.gauss(0, 1), RNG.gauss(0, 1)) for k in range(300)] + [("far", 300, 1e6, -1e6), ("far", 301, 1e6, 1e6)]
    rows += [("knots", k, float(k % 4), 0.0) for k in range(120)] + [("line", k, 1.0, k * 1e-7) for k in range(90)]
    rows += [("few", k, float(k), 2.0) for k in range(3)] + [("one", 0, 1.0, 1.0)]
    nodes = spark.createDataFrame(rows, "sample_id string, node_id int, x double, y double")
    want = sorted(map(tuple, skeleton.knn(nodes).collect()))
    assert sorted(map(tuple, skeleton.knn_grid(nodes, per_cell=8).select("sample_id", "i", "j", "d", "rk").collect())) == want
    assert sorted(map(tuple, skeleton.knn(nodes, large=100).collect())) == want
    assert skeleton.knn_grid(nodes.limit(0)).count() == 0


def test_neighbours_on_the_side_of_the_square(spark):
    rng = random.Random(4)  # one after the other and with rounded differences, so that the last neighbour lies on the square's side or a bit beside it
    rows = [(f"s{s}", k, (1 - s) * 3 ** rng.uniform(-8, 8), s * 3 ** rng.uniform(-8, 8)) for s in (0, 1) for k in range(100)]
    nodes = spark.createDataFrame(rows, "sample_id string, node_id int, x double, y double")
    want = sorted(map(tuple, skeleton.knn(nodes).collect()))
    assert sorted(map(tuple, skeleton.knn_grid(nodes).select("sample_id", "i", "j", "d", "rk").collect())) == want


def shape(kind, points):
    return (kind, [[(float(x), float(y)) for x, y in points]])


def test_topology_of_wide_and_small_features(spark):
    rows, n = [], 0
    for _ in range(60):
        x, y = RNG.uniform(-20, 20), RNG.uniform(-20, 20)
        kind = RNG.choice(["Landmark", "Node", "Path", "Edge", "District"])
        w, h = RNG.choice([0.1, 1, 5, 30]), RNG.choice([0.1, 2, 40])
        geom = shape("Point", [(x, y)]) if kind in ("Landmark", "Node") else shape("LineString", [(x, y), (x + w, y + h)]) if kind in ("Path", "Edge") else shape("Polygon", [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])
        rows.append((RNG.choice("ab"), n, kind, x, y, 0.0, 0.0, 1.0, geom))
        n += 1
    rows.append(("a", n, "District", 0.0, 0.0, 0.0, 0.0, 1.0, shape("Polygon", [(-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6), (-1e6, -1e6)])))
    nodes = spark.createDataFrame(rows, "sample_id string, node_id int, type string, xn double, yn double, cx double, cy double, scale double, geom struct<kind: string, parts: array<array<struct<x: double, y: double>>>>")
    for edges in (topology.soft_topology_edges, topology.hard_topology_edges):
        a, b = (sorted(map(tuple, edges(nodes, 0.2, method=m).collect())) for m in ("cells", "join"))
        assert a == b and len(a) > 20
    wide = topology._scaled(nodes, "District", "Path", "Edge")
    flat = F.flatten("g.parts")
    placed = boxes._in_cells(boxes.boxed(wide, F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"]), 0.5, 0.5), 0.5, "level")
    assert max(r["count"] for r in placed.groupBy("sample_id", "dst").count().collect()) <= 4
    assert topology.hyper_edges(nodes).groupBy("sample_id", "src", "dst", "tag").count().where("count > 1").count() == 0
