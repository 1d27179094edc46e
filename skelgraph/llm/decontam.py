"""Benchmark decontamination: size-partitioned MinHash containment search.

Words are runs of letters and digits, lower-cased; shingles are five words, fewer words
are one shingle. Items of up to `BINS` shingles are exact: one that is contained misses
few of its shingles, so one of its n - ceil(threshold * n) + 1 rarest stands in the
document. Longer ones are partitioned by shingle count into powers of two. For each
class the document is cut into half-overlapping windows of four times the class size,
so a contained item has a Jaccard similarity of at least about 0.2 with some window
however long the document is. One-permutation MinHash gives `BINS` minima per window
and item; an item with an equal minimum is a candidate.

The index is a table of (key, item); tasks get two bitmaps of its hashes, of at most
`MAX_BITS` bits (a full bitmap only passes more), and read each document once, whatever
the number of items. What passes is joined with the index by key, and candidates are
verified by exact containment of their shingle strings. Nothing of the benchmark but
the bitmaps and a histogram of sizes reaches the driver.

Null, empty or wordless items and documents match nothing. Rows with one item_id are
one item with the shingles of all (each row of a long one names it as a candidate);
rows without item_id have none to report (the pipeline goes by rows and takes them
too). Documents without an id are reported with a null one; repeated rows and ids give
a row each. Extra columns are ignored, whatever their names.
"""
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, materialize

WIDTH = 5
THRESHOLD = 0.8
BINS = 64
MAX_BITS = 27  # 16 MB a bitmap
_BYTES = 8 << 20
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MEMO = 200_000  # words whose hash is kept
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text):
    return _WORD.findall(text.lower()) if text else []


def shingles(text, width=WIDTH):
    found = words(text)
    return [" ".join(found[i:i + width]) for i in range(max(1, len(found) - width + 1))] if found else []


class Hashes:
    """Shingle hashes of lists of words, rolled over the hashes of the words."""

    def __init__(self):
        self.memo = {}

    def __call__(self, found, width=WIDTH):
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(found).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
        n = max(1, len(h) - width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(width, len(h))):
            out = out * _BASE + h[k:k + n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def minima(hashes):
    """One-permutation MinHash: the set of the least hash of every bin."""
    order = np.sort(hashes)
    bins = order & np.uint64(BINS - 1)
    return order[np.unique(bins, return_index=True)[1]]


def size_class(n):
    return 1 << (n - 1).bit_length()


def _items(benchmark):
    """(item, n, row_n, s, h, minimum): the distinct shingles of every row of an item, and whether one is a minimum of its row."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def split(batches):
        hashes = Hashes()
        for pdf in batches:
            out = []
            for item, text in zip(pdf["item"], pdf["text"]):
                found = words(text)
                if found:
                    own = dict(zip(shingles(text), hashes(found)))
                    least = set(minima(np.array(list(own.values()), np.uint64)).tolist())
                    out += [(item, len(own), s, int(h) - (1 << 64) if h >> np.uint64(63) else int(h), int(h) in least) for s, h in own.items()]
            yield pd.DataFrame(out, columns=["item", "row_n", "s", "h", "minimum"])

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").alias("item"), "text")
    return materialize(rows.mapInPandas(split, f"item {kind}, row_n long, s string, h long, minimum boolean"), "item_shingles")


def _bitmap(keys: DataFrame, bits):
    """A bitmap of 2 ** bits bits, set by the low bits of column `h`, made of 2 ** (bits - 6) longs at most."""
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1))
    longs = keys.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(h & 63 AS INT))")).alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[longs["at"].to_numpy(np.int64)] = longs["set"].to_numpy(np.int64).view(np.uint64)
    return out


def _passes(bitmap, h):
    low = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[low >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def contained(docs: DataFrame, benchmark: DataFrame, threshold=THRESHOLD, doc_col="doc_id") -> DataFrame:
    """(doc_id, item_id, containment) for every item contained in a document."""
    every = _items(benchmark)
    whole = materialize(every.groupBy("item", "s").agg(F.first("h").alias("h"), F.max("row_n").alias("row_n")), "items")
    sizes = whole.groupBy("item").agg(F.count("*").alias("n"))
    known = whole.join(sizes, "item")
    common = known.where(F.col("n") <= BINS).groupBy("h").agg(F.count("*").alias("common"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("common", "h", "s"))
    most = F.col("n") - F.greatest(F.ceil(F.col("n") * min(threshold, 1.0) - 1e-9), F.lit(1)) + 1
    exact = known.where(F.col("n") <= BINS).join(common, "h").withColumn("rank", rank).where(F.col("rank") <= most).select(F.lit(0).alias("size"), "h", "item")
    rows = every.join(sizes.where(F.col("n") > BINS), "item")
    parts = rows.where(F.col("row_n") <= BINS).select(F.lit(0).alias("size"), "h", "item")  # short rows of long items
    size = F.pow(F.lit(2), F.ceil(F.log2("row_n") - 1e-9)).cast("int").alias("size")
    long = rows.where((F.col("row_n") > BINS) & F.col("minimum")).select(size, "h", "item")
    index = materialize(reduce(DataFrame.unionAll, [exact, parts, long]).distinct(), "index")
    classes = sorted(r["size"] for r in index.select("size").distinct().collect())  # at most one a power of two
    total = whole.count()
    bits = min(MAX_BITS, max(12, (16 * total).bit_length()))
    all_map, key_map = _bitmap(whole, bits), _bitmap(index, bits)
    long_map = _bitmap(index.where("size > 0"), bits)
    spark, kind = docs.sparkSession, docs.schema[doc_col].dataType.simpleString()
    maps = spark.sparkContext.broadcast((all_map, key_map, long_map))  # of fixed size

    def look(batches):
        all_map, key_map, long_map = maps.value
        hashes = Hashes()
        for rec in batches_of(batches, "text", _BYTES):
            out = []
            for row, text in enumerate(rec["text"].to_pylist()):
                found = words(text)
                if not found:
                    continue
                h = hashes(found)
                hits = np.flatnonzero(_passes(key_map, h))
                if not len(hits):
                    continue
                keys = [(0, k) for k in np.unique(h[hits]).tolist()] if 0 in classes else []
                near = hits[_passes(long_map, h[hits])]  # only windows around these can share a minimum
                for size in classes[bool(classes and classes[0] == 0):] if len(near) else ():
                    step, got = 2 * size, set()
                    for w in np.unique(np.concatenate([near // step, np.maximum(near // step - 1, 0)])):
                        m = minima(h[w * step:(w + 2) * step])
                        got.update(m[_passes(long_map, m)].tolist())
                    keys += [(size, k) for k in got]
                if keys:
                    own = {" ".join(found[i:i + WIDTH]) for i in np.flatnonzero(_passes(all_map, h))}
                    out.append((row, keys, sorted(own)))
            ids = rec["id"].take(pa.array([o[0] for o in out], pa.int64()))
            offsets = np.concatenate([[0], np.cumsum([len(o[1]) for o in out])]).astype(np.int32)
            flat = [k for o in out for k in o[1]]
            key = pa.StructArray.from_arrays([pa.array([k[0] for k in flat], pa.int32()), pa.array(np.array([k[1] for k in flat], np.uint64).view(np.int64))], names=["size", "h"])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(offsets), key), pa.array([o[2] for o in out], pa.list_(pa.string()))], names=["id", "keys", "own"])

    seen = docs.select(F.col(doc_col).alias("id"), "text").mapInArrow(look, f"id {kind}, keys array<struct<size: int, h: long>>, own array<string>")
    seen = materialize(seen.withColumn("row", F.monotonically_increasing_id()), "seen")
    asked = seen.select("row", F.explode("keys").alias("k")).select("row", "k.size", "k.h")
    candidates = materialize(asked.join(index, ["size", "h"]).select("row", "item").distinct(), "candidates")
    want = candidates.join(whole.select("item", "s"), "item")
    have = seen.select("row", F.explode("own").alias("s"))
    shared = want.join(have, ["row", "s"]).groupBy("row", "item").agg(F.count("*").alias("k"))
    share = (F.col("k") / F.col("n")).alias("containment")
    return shared.join(sizes, "item").where(F.col("k") / F.col("n") >= threshold).join(seen.select("row", "id"), "row").select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), share)
