"""Closed forms, brute force and the DuckDB oracles at sf0.001."""
import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skelgraph import registry
from skelgraph.functions import geometry as G
from skelgraph.functions import scalars as C
from skelgraph.operators import compare, relations, skeleton
from skelgraph.plans import graph, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 5) + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({registry.ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want) and want


def one(spark, wkt_parts, kind, expr):
    geom = G.geometry(kind, *[[G.point(F.lit(float(x)), F.lit(float(y))) for x, y in p] for p in wkt_parts])
    return spark.range(1).select(geom.alias("g")).select(expr(F.col("g")).alias("v")).first().v


def test_closed_forms(spark):
    square = [[(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]]
    holed = square + [[(.25, .25), (.75, .25), (.75, .75), (.25, .75), (.25, .25)]]
    assert one(spark, square, "Polygon", G.polygon_circularity) == pytest.approx(math.pi / 4)
    assert one(spark, holed, "Polygon", G.polygon_area) == pytest.approx(0.75)
    assert one(spark, [[(0, 0), (3, 0), (3, 4)]], "LineString", G.line_straightness) == pytest.approx(5 / 7)
    assert one(spark, [[(2, 2), (2, 2)]], "LineString", G.line_straightness) == 1.0
    assert one(spark, [[(2, 2), (2, 2)]], "LineString", G.line_curvature) == 1.0
    assert one(spark, holed, "Polygon", lambda g: G.point_polygon_distance(F.lit(.5), F.lit(.5), g)) == pytest.approx(0.25)
    assert one(spark, square, "Polygon", lambda g: G.point_polygon_distance(F.lit(.5), F.lit(.5), g)) == 0.0
    p = one(spark, square, "Polygon", G.representative_point)
    assert (p.x, p.y) == (0.5, 0.5)


def test_small_samples(spark):
    rows = [("one", 0, 0.0, 0.0, None), ("two", 0, 0.0, 0.0, None), ("two", 1, 3.0, 4.0, 0.0), ("same", 0, 1.0, 1.0, None), ("same", 1, 1.0, 1.0, None), ("same", 2, 1.0, 1.0, None)]
    n = spark.createDataFrame(rows, "sample_id string, node_id int, x double, y double, dir double")
    near = skeleton.knn(n)
    ssg = {tuple(r) for r in skeleton.ssg_edges(n).collect()}
    assert {x for x in ssg if x[0] == "two"} == {("two", 0, 1), ("two", 1, 0)} and not any(x[0] == "one" for x in ssg)
    norm = {(r.sample_id, r.node_id): r.scale for r in skeleton.normalize_coords(n, near).collect()}
    assert norm[("one", 0)] == 1.0 and norm[("two", 0)] == 5.0 and norm[("same", 0)] == 1.0
    sig = skeleton.angular_signature(skeleton.normalize_coords(n, near), skeleton.ssg_edges(n)).collect()
    assert len(sig) == 6 and all(abs(sum(r.sig) - (r.sample_id == "two")) < 1e-9 for r in sig)


def test_names(spark):
    n = spark.createDataFrame([(1, 0, " A"), (1, 1, "a"), (1, 2, None), (1, 3, " ")], "sample_id int, node_id int, name string")
    r = spark.createDataFrame([(1, "a", "A ", "Gaze"), (1, None, "a", "Gaze"), (1, "a", "a", "gaze"), (1, " ", "a", "Gaze"), (1, "a", "a", None)], "sample_id int, src_name string, dst_name string, rel_type string")
    ok, bad = relations.resolve_relations(r, n)
    assert [tuple(x) for x in ok.collect()] == [(1, 0, 0, "Gaze")] and bad.count() == 4
    assert {x.j for x in relations.match_by_name(n, n).collect()} == {1}


def test_sectors_at_exact_ties_and_of_a_self_relation(spark):
    """A bin holds its lower edge; an edge of no length points along the zero direction's negative."""
    rows = [(0, 0, 3.0, 3.0, None), (0, 1, 5.0, 3.0, None), (0, 2, 5.0, 5.0, None), (0, 3, 3.0, 5.0, None), (0, 4, 1.0, 5.0, None), (0, 5, 1.0, 3.0, None), (0, 6, 1.0, 1.0, None),
            (0, 7, 3.0, 1.0, None), (0, 8, 5.0, 1.0, None), (0, 9, 0.0, 0.0, math.atan2(4.5, 3.0))]
    nodes = spark.createDataFrame(rows, "sample_id int, node_id int, x double, y double, dir double")
    edges = spark.createDataFrame([(0, 0, j) for j in range(1, 9)] + [(0, 0, 0), (0, 9, 9)], "sample_id int, src int, dst int")
    got = {(r.src, r.dst): r for r in skeleton.edge_attributes(nodes, edges).collect()}
    assert [got[0, j].sector for j in range(1, 9)] == list(range(8))
    assert got[0, 0].sector == 0 and got[0, 0].d == pytest.approx(1e-6)
    assert got[9, 9].sector == math.floor(-math.atan2(4.5, 3.0) % (2 * math.pi) / (2 * math.pi) * 8)


def test_points_and_directions_of_the_table(spark, tmp_path):
    """Lines of slope one, whose corners are rounded, keep the table's direction and middle to the last bit."""
    rows = [(77 * k, 0, "signup", k * 0.73, '{"k": %d}' % (k % 90)) for k in range(1, 60)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.current_timestamp()).write.parquet(str(tmp_path / "events.parquet"))
    got = views.nodes(spark, str(tmp_path)).collect()
    assert len(got) == 59 and all(r.dir == math.atan2(1.0, 1.0) and r.x == r.ax + r.w * 0.5 and r.y == r.ay + r.h * 0.5 for r in got)
    n = [r for r in graph.nodes_of(views.features(spark, str(tmp_path)).drop("x", "y", "dir")).collect()]
    assert all(r.dir == pytest.approx(math.pi / 4) and r.x == pytest.approx(r.ax + 0.5) for r in n)


def test_an_angle_just_below_zero_lies_in_the_last_sector(spark):
    """As numpy's modulus and digitize have it: two pi, clipped to the last sector, or wrapped to the first."""
    for zero in (1e-16, 1e-3, 0.0):
        rel = (np.arctan2(0.0, 1.0) - zero) % (2 * np.pi)
        want = (int(np.clip(np.digitize([rel], np.linspace(0, 2 * np.pi, 9))[0] - 1, 0, 7)), int(np.floor(rel / (2 * np.pi) * 8)) % 8)
        got = spark.range(1).select(*[C.relative_sector(F.lit(1.0), F.lit(0.0), F.lit(zero), edge=e)["sector"].alias(e) for e in ("clip", "wrap")]).first()
        assert tuple(got) == want
