"""Vector comparison in blocks against plain sums."""
import math

import pytest
from pyspark.sql import functions as F

from skelgraph.operators import compare

SCHEMA = "sample_id long, vec array<double>, a string"


def _side(spark, ids):
    return spark.createDataFrame([(i, None if i % 7 == 3 else [float((i * k) % 11 - 5) for k in range(1, 6)], "x") for i in ids], SCHEMA)


def _plain(u, v, rescale):
    if u is None or v is None:
        return None
    d, nu, nv = sum(x * y for x, y in zip(u, v)), math.sqrt(sum(x * x for x in u)), math.sqrt(sum(x * x for x in v))
    return (d / (nu * nv + 1e-9) + 1) / 2 if rescale else d / ((nu + 1e-8) * (nv + 1e-8))


@pytest.mark.parametrize("rescale", [False, True])
def test_blocks_equal_plain(spark, rescale):
    a, b = _side(spark, range(1, 30)), _side(spark, range(30, 51))
    got = {(r.a, r.b): r.sim for r in compare.cosine_pairs(a, b, rescale, block=4).collect()}
    want = {(r.sample_id, s.sample_id): _plain(r.vec, s.vec, rescale) for r in a.collect() for s in b.collect()}
    assert got.keys() == want.keys() and compare.cosine_pairs(a, b, rescale, block=4).count() == len(want)
    assert all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    pairs = spark.createDataFrame([(1, 30), (3, 31), (8, 50), (99, 30)], "a long, b long")
    some = {(r.a, r.b): r.sim for r in compare.cosine_pairs(a, b, rescale, pairs=pairs).collect()}
    assert some.keys() == {(1, 30), (3, 31), (8, 50)} and some[3, 31] is None
    assert some[8, 50] == pytest.approx(want[8, 50], abs=1e-12)


def test_no_cross_join_and_empty_sides(spark):
    a, none = _side(spark, range(5)), spark.createDataFrame([], SCHEMA)
    assert compare.cosine_pairs(a, none).count() == 0 and compare.cosine_pairs(none, a).count() == 0
    plan = compare.cosine_pairs(a, a)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    same = a.where(F.col("vec").isNotNull())
    assert all(r.sim == pytest.approx(1, abs=1e-6) for r in compare.cosine_pairs(same, same).where("a = b").collect() if r.a)


def test_vectors_of_different_length_fail(spark):
    b = spark.createDataFrame([(1, [1.0, 2.0])], "sample_id long, vec array<double>")
    with pytest.raises(Exception, match="matmul|shape|size"):
        compare.cosine_pairs(_side(spark, [1]), b).collect()
