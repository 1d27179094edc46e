"""Loss metrics, calibrators and the new queries against DuckDB."""
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skelgraph import registry
from skelgraph.operators import losses, report

SF = "/root/testdata/sf0.001"
NEW = ["rotate", "anisotropic_scale", "write_records", "similarity_matrix", "topk_mismatches", "nt_xent", "supcon", "node_align_loss", "pair_loss",
       "topk_node_mismatches", "read_realmap", "elastic_waves", "contrastive_norms", "contrastive_turns", "fit_platt", "fit_isotonic"]


@pytest.mark.parametrize("name", NEW)
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def plain(x):
        return [plain(v) for v in x] if isinstance(x, list) else round(x, 4) + 0.0 if isinstance(x, float) else x

    def rows(values):
        return sorted(str([plain(x) for x in r]) for r in values)

    assert rows(got.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def _batch(spark, n):
    """A batch of n rows and one of 3, with two labels and a row without vectors."""
    rows = [(b, i, [math.sin(i * k + len(b)) for k in range(1, 6)], [math.cos(i + k) for k in range(1, 6)], i % 2) for b, m in (("big", n), ("small", 3)) for i in range(m)]
    return spark.createDataFrame([*rows, ("big", n, None, None, 0), (None, 0, [1.0] * 5, [1.0] * 5, 0)], "batch_id string, i long, z1 array<double>, z2 array<double>, label long")


@pytest.mark.parametrize("temperature", [0.2, 0.001])
def test_losses_in_blocks_equal_whole_matrices(spark, temperature):
    z = _batch(spark, 23)
    want_x, want_s = {}, {}
    for name in ("big", "small"):
        got = z.where(F.col("batch_id") == name).where("z1 IS NOT NULL").orderBy("i").collect()
        u, v = (np.array([r[c] for r in got]) for c in ("z1", "z2"))
        u, v = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (u, v))
        s = u @ v.T / temperature
        top = s.max(1)
        want_x[name] = (np.log(np.exp(s - top[:, None]).sum(1)) + top - s.diagonal()).mean()
        s, label = u @ u.T / temperature, np.array([r.label for r in got])
        off = ~np.eye(len(s), dtype=bool)
        pos = off & (label[:, None] == label)
        e = (np.exp(s - s.max(1, keepdims=True)) * off).sum(1)
        want_s[name] = -((pos * (s - np.log(e + 1e-9)[:, None])).sum(1) / (pos.sum(1) + 1e-9)).mean()
    for block in (4, 1024):
        assert {r.batch_id: r.loss for r in losses.nt_xent(z, temperature, block).collect()} == pytest.approx(want_x, rel=1e-9)
        assert {r.batch_id: r.loss for r in losses.supcon(z.withColumnRenamed("z1", "z"), temperature, block).collect()} == pytest.approx(want_s, rel=1e-6)
    plan = losses.nt_xent(z, block=4)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "NestedLoop" not in plan
    assert losses.nt_xent(z.limit(0)).count() == 0


def test_calibrators(spark):
    s = spark.createDataFrame([(-2.0, 0.0), (-1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (2.0, 1.0)], "logit double, label double")
    fit = report.fit_platt(s).first()
    p = [(1 / (1 + math.exp(-(fit.coef * r.logit + fit.intercept))), r.logit, r.label) for r in s.collect()]
    assert sum(q - y for q, _, y in p) == pytest.approx(0, abs=1e-4)
    assert sum((q - y) * x for q, x, y in p) + fit.coef == pytest.approx(0, abs=1e-4)
    iso = {r.x: r.y for r in report.fit_isotonic(s).collect()}
    assert iso[-2.0] == 0 and iso[-1.0] == iso[0.0] == 0.5 and iso[2.0] == 1


def test_edges(spark):
    with pytest.raises(ValueError):
        losses.pair_loss(spark.createDataFrame([], "logit double, label double"), "other")
    none = spark.createDataFrame([], "sample_id int, node_id int, vec array<double>")
    pairs = spark.createDataFrame([], "sample_a int, i int, sample_b int, j int")
    assert losses.node_align_loss(none, none, pairs).first().loss == 0.0
    n = spark.range(40).select((F.col("id") % 4).alias("sample_id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    one, two = (sorted(map(tuple, report.anisotropic_scale(n.repartition(k)).collect())) for k in (1, 7))
    assert one == two and all(0.8 <= r[1] < 1.2 for r in one)
