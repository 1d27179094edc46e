"""Shortest paths between all nodes of every sample: small maps by matrices, a map a task; others by rounds of joins."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import deleted, dropped, written
from .median import exact_median

KEY = ["sample_id", "source", "node"]
SMALL = 400  # nodes of a map up to which one task holds its distances
CELLS = 1 << 20  # distances that are extended at once


def _kept(edges):
    return edges.where("w > 0 AND src <> dst").select("sample_id", F.col("src").alias("a"), F.col("dst").alias("b"), (1 / F.greatest("w", F.lit(1e-6))).alias("length"))


def lengths(edges: DataFrame) -> DataFrame:
    """(sample_id, a, b, length) in both directions of edges (sample_id, src, dst, w): 1 / max(w, 1e-6) of the strongest, w above 0, no loops."""
    kept = _kept(edges)
    both = kept.unionAll(kept.select("sample_id", F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    return both.groupBy("sample_id", "a", "b").agg(F.min("length").alias("length"))


def distances(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample_id, source, node, d) of all pairs that a path joins.

    A round extends only the distances that the round before improved; the table of distances is bucketed by its key, so that only
    these candidates are shuffled. There are at most as many rounds as a shortest path has edges, and one.
    """
    spark = edges.sparkSession
    step = written(lengths(edges), "lengths")
    ahead = nodes.select("sample_id", F.col("node_id").alias("source"), F.col("node_id").alias("node"), F.lit(0.0).alias("d"))
    known, label = written(ahead, "distances", by=KEY)
    ahead = known
    while True:
        far = ahead.join(step.withColumnRenamed("a", "node"), ["sample_id", "node"]).groupBy("sample_id", "source", F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("length")).alias("new"))
        better, name = written(known.join(far, KEY, "right").where("d IS NULL OR new < d").select(*KEY, "new"), "improved", by=KEY)
        if better.isEmpty():
            break
        after, next_label = written(known.join(better, KEY, "full").select(*KEY, F.coalesce("new", "d").alias("d")), "distances", by=KEY)
        last, ahead = ahead, written(better.withColumnRenamed("new", "d"), "ahead")
        for table in (better, known) if last is known else (better, known, last):
            deleted(table)
        dropped(spark, name)
        dropped(spark, label)
        known, label = after, next_label
    out = written(known, "distances")
    for table in (better, known, step) if ahead is known else (better, known, ahead, step):
        deleted(table)
    dropped(spark, name)
    dropped(spark, label)
    return out


def _relaxed(n, a, b, length, sources):
    """Distances from each of `sources` to all n places over the edges a to b; a pass extends every path by an edge, until none improves."""
    d = np.full((len(sources), n), np.inf)
    d[np.arange(len(sources)), sources] = 0.0
    order = np.argsort(b, kind="stable")
    a, b, length = a[order], b[order], length[order]
    start = np.flatnonzero(np.diff(b, prepend=-1))
    ends, some = b[start], max(1, CELLS // max(1, len(a)))
    for at in range(0, len(sources) if len(a) else 0, some):
        part = d[at:at + some]
        while True:
            new = np.minimum.reduceat(part[:, a] + length, start, axis=1)
            if not (new < part[:, ends]).any():
                break
            part[:, ends] = np.minimum(new, part[:, ends])
    return d


def _costs_of(rows: pd.DataFrame) -> pd.DataFrame:
    """(sample_id, i, j, cost) of a map from its edges (a, b, length), that lead both ways, and a loop for each node."""
    place, ids = pd.factorize(pd.concat([rows["a"], rows["b"]], ignore_index=True))
    a, b = place[:len(rows)], place[len(rows):]
    loop, length = a == b, rows["length"].to_numpy()
    own, length = a[loop], np.tile(length[~loop], 2)
    d = _relaxed(len(ids), np.concatenate([a[~loop], b[~loop]]), np.concatenate([b[~loop], a[~loop]]), length, own)
    some = np.sort(d[(d > 0) & np.isfinite(d)])
    m = some[(len(some) - 1) // 2] / 2 + some[len(some) // 2] / 2 if len(some) else 1.0
    cost = np.where(np.isfinite(d), d, 0.0)[:, own] / m
    names = ids[own]
    return pd.DataFrame({"sample_id": rows["sample_id"].iloc[0], "i": np.repeat(names, len(own)), "j": np.tile(names, len(own)), "cost": cost.ravel()})


def _small_costs(edges, nodes):
    kinds = dict(nodes.dtypes)
    own = nodes.where("sample_id IS NOT NULL").select("sample_id", F.col("node_id").alias("a"), F.col("node_id").alias("b"), F.lit(0.0).alias("length"))
    kept = _kept(edges).join(nodes.select("sample_id").distinct(), "sample_id", "left_semi")
    # dealt by map first, so that the strongest of repeated edges is found without a shuffle of its own
    rows = own.unionByName(kept).repartition("sample_id").groupBy("sample_id", "a", "b").agg(F.min("length").alias("length"))
    return rows.groupBy("sample_id").applyInPandas(_costs_of, f"sample_id {kinds['sample_id']}, i {kinds['node_id']}, j {kinds['node_id']}, cost double")


def shortest_path_costs(edges: DataFrame, nodes: DataFrame, small=SMALL) -> DataFrame:
    """(sample_id, i, j, cost) of all pairs of nodes of a sample: the distance over the median of the sample's positive ones, 0 where no path leads.

    Maps of more than `small` nodes go through rounds of joins, the others are held by a task each, with the same paths.
    """
    many = nodes.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("sample_id")
    if many.isEmpty():
        return _small_costs(edges, nodes)
    few = _small_costs(edges.join(many, "sample_id", "left_anti"), nodes.join(many, "sample_id", "left_anti"))
    return few.unionByName(_large_costs(edges.join(many, "sample_id", "left_semi"), nodes.join(many, "sample_id", "left_semi")))


def _large_costs(edges, nodes):
    d = distances(edges, nodes)
    median = exact_median(d.where("d > 0"), ["sample_id"], "d", "m")
    a = nodes.select("sample_id", F.col("node_id").alias("i"))
    pairs = a.join(a.withColumnRenamed("i", "j"), "sample_id")
    got = pairs.join(d.withColumnsRenamed({"source": "i", "node": "j"}), ["sample_id", "i", "j"], "left").join(median, "sample_id", "left")
    return got.select("sample_id", "i", "j", (F.coalesce("d", F.lit(0.0)) / F.coalesce("m", F.lit(1.0))).alias("cost"))
