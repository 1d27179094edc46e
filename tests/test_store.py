"""Tables written in between and their removal."""
import os

from skelgraph import store
from skelgraph.operators import losses


def test_clear_removes_this_application_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    other = tmp_path / "skelgraph" / "another-application" / "x"
    other.mkdir(parents=True)
    z = spark.createDataFrame([("b", i, [float(i), 1.0], [1.0, float(i)]) for i in range(5)], "batch_id string, i long, z1 array<double>, z2 array<double>")
    assert losses.nt_xent(z).count() == 1
    kept, label = store.written(z, "bucketed", ["i"])
    assert kept.count() == 5
    store.dropped(spark, label)
    mine = store.session_dir(spark).removeprefix("file://")
    assert {n for _, folders, _ in os.walk(mine) for n in folders} >= {"batches", "sizes", "bucketed"}
    assert store.clear(spark) and not os.path.exists(mine) and other.is_dir()
    assert not store.clear(spark)
    assert losses.nt_xent(z).count() == 1  # later work starts a folder of its own
