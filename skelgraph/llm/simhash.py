"""SimHash near-duplicates: tiled exact comparison by exclusive-or and bit counts.

Distinct fingerprints are tiled by the population counts of their four 16-bit
quarters. Two tiles are compared only if the counts differ by at most the radius
in sum, since that sum never exceeds the Hamming distance. Tiles are cut into
blocks of bounded size, links are reduced to a forest inside each block pair, and
classes come from rounds of contraction. Null text is an empty text (fingerprint
zero); null doc_id rows share the class of their fingerprint; repeated rows give a row
each. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 2048
_SHINGLES = 1 << 16


def fingerprint(text, width=3) -> int:
    """The 64-bit fingerprint of the whole text, unsigned."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _SHINGLES):
        h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(a, min(n, a + _SHINGLES))]
        ones += np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width=3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.select("doc_id", fp(F.coalesce(F.col("text"), F.lit(""))).alias("fp"))


def _forest(a, b):
    """Edges to the least value of each local class, from links a[i]-b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    lab = np.arange(len(nodes))
    while True:
        m, old = np.minimum(lab[i], lab[j]), lab.copy()
        np.minimum.at(lab, i, m)
        np.minimum.at(lab, j, m)
        lab = lab[lab]
        if (lab == old).all():
            break
    keep = lab != np.arange(len(nodes))
    return nodes[keep], nodes[lab[keep]]


def _links(x, y, radius):
    found = []
    for k in range(0, len(x), 512):
        i, j = np.nonzero(np.bitwise_count(x[k:k + 512, None] ^ y[None, :]) <= radius)
        found.append((x[k + i], y[j]))
    a, b = (np.concatenate(z).view(np.int64) for z in zip(*found))
    return _forest(a[a != b], b[a != b])


def links(fps: DataFrame, radius=2, block=BLOCK) -> DataFrame:
    """(a, b): a forest over the distinct longs `fp`, joining all that differ in at most `radius` bits."""
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))).cast("int") for k in range(4)]
    tile = fps.select("fp", (quarters[0] + 17 * quarters[1] + 289 * quarters[2] + 4913 * quarters[3]).alias("tile"))
    sizes = tile.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    packed = (tile.join(F.broadcast(sizes), "tile")  # at most 17 ** 4 rows
              .withColumn("blk", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
              .groupBy("tile", "blk").agg(F.collect_list("fp").alias("fps")))
    packed = materialize(packed, "tiles")
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    offsets = sorted({s for d in steps if (s := d[0] + 17 * d[1] + 289 * d[2] + 4913 * d[3]) >= 0})
    left = packed.select(F.explode(F.array(*[F.lit(s) for s in offsets])).alias("s"), F.col("tile").alias("t"), F.col("blk").alias("blk_a"), F.col("fps").alias("xs"))
    left = left.withColumn("tile", F.col("t") + F.col("s"))
    pairs = (left.join(packed.withColumnsRenamed({"blk": "blk_b", "fps": "ys"}), "tile")
             .where((F.col("s") > 0) | (F.col("blk_a") <= F.col("blk_b"))).select("xs", "ys"))

    def compare(batches):
        for rec in batches:
            out = [[], []]
            for x, y in zip(rec.column(0), rec.column(1)):
                a, b = _links(x.values.to_numpy(zero_copy_only=False).view(np.uint64), y.values.to_numpy(zero_copy_only=False).view(np.uint64), radius)
                if len(a):
                    out[0].append(a)
                    out[1].append(b)
            if out[0]:
                import pyarrow as pa
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in out], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each class, for every node on an edge (a, b).

    In each round every node goes to its neighbour, or itself, of the least random
    priority, then twice on along such steps; edges are drawn anew between the goals.
    An expected constant share of the nodes goes in a round, whatever the diameter.
    """
    edges = materialize(edges.where("a <> b").select("a", "b"), "edges")
    maps = []
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        priority = F.struct(F.xxhash64("b", F.lit(len(maps))).alias("p"), F.col("b").alias("to"))
        least = both.unionAll(both.select("a", F.col("a").alias("b"))).groupBy("a").agg(F.min(priority).alias("m"))
        step = materialize(least.select(F.col("a").alias("node"), "m.to"), "step")
        for _ in range(2):
            onward = step.select(F.col("node").alias("to"), F.col("to").alias("on"))
            step = materialize(step.join(onward, "to").select("node", F.col("on").alias("to")), "step")
        maps.append(step)
        edges = (edges.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a")
                 .join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b").where("x <> y")
                 .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        edges = materialize(edges, "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].withColumnRenamed("to", "root")
    for step in reversed(maps[:-1]):  # a later map holds only what was still on an edge
        out = step.join(out.withColumnsRenamed({"node": "to"}), "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    out = materialize(out, "roots")
    names = out.groupBy("root").agg(F.min("node").alias("least"))
    return out.join(names, "root").select("node", F.col("least").alias("root"))


def labels(fps: DataFrame, radius=2) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of `fps` (doc_id, fp)."""
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "representatives")
    comp = components(links(reps.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = reps.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(ids, "root").select("fp", "component_id"), "labels")  # then a hot fingerprint can be split


def classes(docs: DataFrame, radius=2, width=3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    return fps.join(labels(fps, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
