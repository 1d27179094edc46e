"""Near copies: SimHash classes and MinHash bands as candidates, linked by the exact Jaccard similarity of five-word shingles.

Candidates are the texts of one SimHash class (five-word shingles, radius 2) or of
one of BANDS MinHash buckets: at similarity 0.8 two SimHash fingerprints differ by about ten
bits in the mean, where tiles no longer part anything. Two texts of similarity 0.8 share no
bucket in (1 - 0.8 ** ROWS) ** BANDS = 0.05 % of cases, and fewer above. What is compared are the
sets of shingle hashes of the candidates, written once. First every text of a bucket is compared with the
bucket's least one, each such pair once however many buckets it shares: what is linked to it need not be
compared among itself any more. Where a bucket has others, these are compared with all of it,
by products of incidence matrices in blocks of at most BLOCK texts. Buckets of the same texts are compared once.
A group is what is connected by links; its row of the least doc_id stays (ties: the least text id; of rows that
repeat both, the one whose columns have the least hash). Texts without words are equal. Null text is an empty text.
"""
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialize, text_id

WIDTH = 5
SHARE = 0.8
ROWS, BANDS = 6, 25
BLOCK = 256
_CHUNK = 1 << 12
_rng = np.random.default_rng(5)
_A = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def shingles(text, width=WIDTH):
    """The distinct 64-bit hashes of the shingles; fewer than `width` words are one."""
    words = text.encode().lower().split() if text else []
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[i:i + width])) for i in range(n)), np.uint64, n))


def bands(hashes):
    """BANDS bucket keys of a shingle set."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 2 ** 32 - 1, np.uint32)
    for k in range(0, len(low), _CHUNK):
        v = low[k:k + _CHUNK, None] * _A + _B
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(least, v.min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


def jaccard(a, b):
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def links(sets, share=SHARE):
    """Positions (i, j) of a forest over the shingle sets that joins all of similarity `share` or more."""
    if len(sets) == 2:
        near = jaccard(*sets) >= share
        return (np.array([1]), np.array([0])) if near else (np.array([], int), np.array([], int))
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, word, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n[word] > 1
    word, owner = np.unique(word[common], return_inverse=True)[1], owner[common]
    order = np.argsort(word, kind="stable")
    word, owner = word[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2 ** 24 are exact
    for k in range(0, int(word[-1]) + 1 if len(word) else 0, _CHUNK):
        a, z = np.searchsorted(word, (k, k + _CHUNK))
        has = np.zeros((len(sets), _CHUNK), np.float32)
        has[owner[a:z], word[a:z] - k] = 1
        both += has @ has.T
    every = size[:, None] + size[None, :] - both
    return simhash._forest(*np.nonzero(np.triu(both >= share * every - 1e-6, 1)))


def _candidates(sig: DataFrame, radius=2):
    """(band, lead, n) and (band, tid) of the buckets of more than one text, one per set of texts."""
    label = simhash.labels(sig.select(F.col("id").alias("doc_id"), "fp"), radius)
    each = sig.select(F.explode("keys").alias("band"), "tid").unionAll(
        sig.join(label, "fp").select(F.xxhash64(F.lit("class"), "component_id").alias("band"), "tid"))
    each = materialize(each, "each")
    sets = each.groupBy("band").agg(F.count("*").alias("n"), F.min("tid").alias("lead"), F.bit_xor(F.xxhash64("tid")).alias("x"))
    buckets = materialize(sets.where("n > 1").groupBy("lead", "n", "x").agg(F.min("band").alias("band")).select("band", "lead", "n"), "buckets")
    return buckets, each.join(buckets, "band")


def _sets(pdf):
    return [np.frombuffer(x, np.uint64) for x in pdf["set"]]


def _compared(places: DataFrame, sets: DataFrame, share) -> DataFrame:
    """Links (a, b) inside each cell of `places` (band, p, q, tid)."""
    def compare(batches):
        cell, tids, held = None, [], []

        def found():
            i, j = links(held, share) if len(held) > 1 else ([], [])
            return pd.DataFrame({"a": [tids[k] for k in i], "b": [tids[k] for k in j]})

        for pdf in batches:
            for key, tid, own in zip(zip(pdf["band"], pdf["p"], pdf["q"]), pdf["tid"], _sets(pdf)):
                if key != cell:
                    if len(held) > 1:
                        yield found()
                    cell, tids, held = key, [], []
                tids.append(tid)
                held.append(own)
        if len(held) > 1:
            yield found()

    rows = places.join(sets, "tid").repartition("band", "p", "q").sortWithinPartitions("band", "p", "q")
    return rows.select("band", "p", "q", "tid", "set").mapInPandas(compare, "a binary, b binary").distinct()


def _near_leads(members: DataFrame, sets: DataFrame, share, block) -> DataFrame:
    """Links (a, b) from texts to the least texts of their buckets; the texts of one lead are dealt over tasks by `block`."""
    def verify(batches):
        lead = None
        for pdf in batches:
            out = []
            for tid, other, own in zip(pdf["tid"], pdf["lead"], _sets(pdf)):
                if tid is None:  # comes ahead of the texts to compare with
                    lead = own
                elif jaccard(own, lead) >= share:
                    out.append((tid, other))
            yield pd.DataFrame(out, columns=["a", "b"])

    pairs = materialize(members.where("tid <> lead").select("tid", "lead").distinct(), "lead_pairs")
    parts = materialize(pairs.groupBy("lead").agg(F.ceil(F.count("*") / block).alias("parts")), "lead_parts")
    each = pairs.join(parts, "lead").select("tid", "lead", F.pmod(F.xxhash64("tid"), "parts").alias("part"))
    each = each.join(sets, "tid").select("lead", "part", "tid", "set")
    heads = parts.select("lead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("tid", "lead"), "lead")
    rows = heads.select("lead", "part", F.lit(None).cast("binary").alias("tid"), "set").unionAll(each)
    rows = rows.repartition("lead", "part").sortWithinPartitions("lead", "part", F.asc_nulls_first("tid"))
    return rows.select("tid", "lead", "set").mapInPandas(verify, "a binary, b binary")


def _cells(members: DataFrame, group: DataFrame, block) -> DataFrame:
    """(band, p, q, tid): every two texts of a bucket meet in a cell, unless both are in the group of its least one."""
    roots = members.join(group.withColumnsRenamed({"node": "lead", "root": "lead_root"}), "lead", "left").join(group.withColumnRenamed("node", "tid"), "tid", "left")
    roots = materialize(roots.select("band", "tid", F.coalesce(F.col("root") == F.col("lead_root"), F.lit(False)).alias("in")), "members")
    many = roots.groupBy("band").agg(F.ceil(F.count_if(~F.col("in")) / (block // 2)).alias("rest"), F.ceil(F.count_if("in") / (block // 2)).alias("near"))
    many = many.where("rest > 0")
    own = F.pmod(F.xxhash64("tid"), F.when(F.col("in"), F.col("near")).otherwise(F.col("rest"))) + F.when(F.col("in"), F.col("rest")).otherwise(0)
    at = roots.join(many, "band").withColumn("own", own)
    # blocks 0 .. rest - 1 hold what is not in the group, those from rest on what is; cells are pairs of different blocks, the first one of the rest
    other = F.when(F.col("rest") + F.col("near") == 1, F.array(F.lit(0).cast("long"))).when(
        F.col("in"), F.sequence(F.lit(0).cast("long"), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("rest") + F.col("near") - 1))
    cells = at.select("band", "tid", "own", (F.col("rest") + F.col("near")).alias("all"), F.explode(other).alias("other")).where("own <> other OR `all` = 1")
    return cells.select("band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "tid")


def distinct(docs: DataFrame, share=SHARE, width=WIDTH, block=BLOCK) -> DataFrame:
    """Of the rows of `docs` with a doc_id, one of every group of equal texts and near copies."""
    @F.pandas_udf("struct<keys: array<long>, fp: long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        fps = np.array([simhash.fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
        return pd.DataFrame({"keys": [bands(shingles(t, width)) for t in texts], "fp": fps})

    rows = docs.where("doc_id IS NOT NULL").select(F.struct("*").alias("row"), "doc_id", text_id().alias("tid"), F.coalesce("text", F.lit("")).alias("text"))
    sig = rows.select("tid", "doc_id", sketch("text").alias("s")).groupBy("tid").agg(F.min("doc_id").alias("id"), F.first("s").alias("s"))
    sig = materialize(sig.select("tid", "id", "s.keys", "s.fp"), "signatures")
    buckets, members = _candidates(sig)
    members = materialize(members, "candidates")

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, width).tobytes())

    sets = rows.select("tid", "text").join(members.select("tid").distinct(), "tid", "left_semi")
    sets = materialize(sets.groupBy("tid").agg(F.first("text").alias("text")).select("tid", hashed("text").alias("set")), "sets")
    first = materialize(_near_leads(members, sets, share, block), "near_leads")
    cells = _cells(members, simhash.components(first), block)
    rest = materialize(_compared(cells, sets, share), "links")
    group = simhash.components(first.unionAll(rest)).withColumnRenamed("node", "tid")
    keep = sig.join(group, "tid", "left").groupBy(F.coalesce("root", "tid")).agg(F.min(F.struct("id", "tid")).alias("k")).select(F.col("k.tid").alias("tid"), F.col("k.id").alias("doc_id"))
    kept = rows.join(keep, ["tid", "doc_id"], "left_semi").select("tid", "row")
    return kept.groupBy("tid").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
