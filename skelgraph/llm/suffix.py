"""Exact removal of repeated strings and passages.

A byte goes if some 400-byte string over it also starts anywhere else (`STRINGS`); a
word lies in a repeated passage if some run of 51 words over it does (`PASSAGES`, where
a text is the 64-bit hashes of its words, so that lengths, grams and places count words).
1. Sparse suffixes. Winnowing: every window of the length picks the least hash among
   its inner grams, so equal windows pick equal grams at equal places. Runs of windows
   with one pick are a region. The suffix at the pick stands for them.
2. A `Family` of logarithmic levels takes the texts in batches. A batch becomes a level
   sorted by the hash of the first gram of its suffixes, is merge-scanned against every
   level there is, and levels of one rank merge into one of the next, so n batches leave
   at most log2(n) + 1. Suffixes whose gram was met twice are looked at again.
3. Regions that occur twice as a whole are repeated in all their windows.
4. Picks that meet in different regions have one instance of each region opened
   into single windows, which are compared by a 128-bit hash: those of a pick in
   one task up to GROUP regions, beyond that spread by the hash of the window.
A place is told apart by two 64-bit hashes, of its pick and of its region, so
only keys that occur twice are looked at again. Counts pre-aggregate in their
tasks, so no group of copies meets in one task.

Null text is empty; shorter texts lose nothing; equal texts are searched once and
counted with their number; rows may repeat, and doc_id may be null or tied. Columns
of `docs` besides those named are kept by `strip_*` and ignored by `removed`; inside,
rows are carried in one struct, so no name clashes.
"""
import hashlib
import os
import re
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, materialize, remove, shared_dir, text_id

BATCHES = 3  # batches that one call adds to the family: two levels stay
# Ranges of the scripts written without spaces (Thai, Lao, Myanmar, Khmer, Kana, Han).
_BARE = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF"
WORD = re.compile(rf"[{_BARE}]|[^\s{_BARE}]+")  # a character of those scripts, or what stands between white space
_ANY_BARE = re.compile(f"[{_BARE}]")
GROUP = 2000  # regions of one pick compared in one task; more are spread by window
_BLOCK = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_BYTES = 8 << 20


class Search(NamedTuple):
    """Windows of `length` units that are repeated; `gram` units are hashed. A unit has 1 byte, or 8 (a word's hash)."""

    length: int
    gram: int
    unit: int


STRINGS = Search(400, 128, 1)
PASSAGES = Search(51, 16, 8)


def _rolling(b, size):
    """Wrapping polynomial hashes of all `size`-byte strings, by doubling."""
    h, have, power = b.astype(np.uint64) + np.uint64(1), 1, _BASE
    total, done, n = None, 0, len(b) - size + 1
    rest = size
    while rest:
        if rest & 1:
            part = h[done:done + n]
            total = part.copy() if total is None else total * np.uint64(power) + part
            done += have
        rest >>= 1
        if rest:
            h = h[:-have] * np.uint64(power) + h[have:]
            have, power = have * 2, power * power & (2 ** 64 - 1)
    return total


def _mix(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding_min(v, width):
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[:len(v) - (width - have)], v[width - have:]) if have < width else v


def words(text) -> bytes:
    """The 64-bit hashes of the words (`WORD`)."""
    found = text.split() if text.isascii() or not _ANY_BARE.search(text) else WORD.findall(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).tobytes()


CODES = {1: str.encode, 8: words}


def regions(data: bytes, search=STRINGS):
    """(keys, region hashes, places) of the runs of windows with one pick; a place is 1024 * first start + 2 * (last - first), + 1 for words."""
    length, gram, unit = search
    keys, hashes, places = [], [], []
    for lo in range(0, len(data) // unit - length + 1, _BLOCK):
        part = data[lo * unit:(lo + _BLOCK + length - 1) * unit]
        h = _mix(_rolling(np.frombuffer(part, np.uint8 if unit == 1 else np.uint64), gram))
        packed = (h & np.uint64(~((1 << 23) - 1) & (2 ** 64 - 1))) | np.arange(len(h), dtype=np.uint64)
        pick = (_sliding_min(packed, length - gram + 1) & np.uint64((1 << 23) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        last = np.append(first[1:], len(pick)) - 1
        keys.append((h[pick[first]] ^ np.uint64(unit)).view(np.int64))
        low, high = (first * unit).tolist(), ((last + length) * unit).tolist()
        hashes.append(np.fromiter((xxhash.xxh3_64_intdigest(part[a:z]) for a, z in zip(low, high)), np.uint64, len(low)).view(np.int64))
        places.append((first + lo) * 1024 + 2 * (last - first) + (unit > 1))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(keys), np.concatenate(hashes), np.concatenate(places)


def covered(spans, length):
    """Merged [a, z) runs under the windows that start in the given inclusive spans."""
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z + length)
        else:
            out.append([a, z + length])
    return out


def _repeated(key, held, searches):
    """(key, rh, starts) of the windows that stand in more than one place of the held regions."""
    first, hits = {}, [set() for _ in held]
    for r, (_, words, data) in enumerate(held):
        length, _, unit = searches[words]
        for d in range(len(data) // unit - length + 1):
            other = first.setdefault(xxhash.xxh3_128_digest(data[d * unit:(d + length) * unit]), (r, d))
            if other != (r, d):
                hits[r].add(d)
                hits[other[0]].add(other[1])
    return [(key, rh, sorted(h)) for (rh, _, _), h in zip(held, hits) if h]


class Family:
    """Logarithmic family of levels: bucketed and sorted tables (key, n) of n suffixes that begin with the gram of that key.

    `levels` are (rank, folder), highest rank first; an empty batch is a level like any
    other. They lie in `folder`, where `Family.open` finds them again in a later session.
    """

    def __init__(self, spark: SparkSession, folder=None, buckets=None, levels=()):
        self.spark, self.levels = spark, list(levels)
        self.folder = folder or os.path.join(shared_dir(spark), "skelgraph", uuid.uuid4().hex)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._names = []

    @classmethod
    def open(cls, spark, folder):
        rows = spark.read.parquet(os.path.join(folder, "levels")).orderBy(F.desc("rank")).collect()  # one row a level
        return cls(spark, folder, rows[0]["buckets"] if rows else None, [(r["rank"], r["path"]) for r in rows if r["path"]])

    def save(self):
        rows = [(rank, path, self.buckets) for rank, path in self.levels] or [(-1, None, self.buckets)]
        self.spark.createDataFrame(rows, "rank int, path string, buckets int").coalesce(1).write.mode("overwrite").parquet(os.path.join(self.folder, "levels"))

    def _write(self, rows):
        """Write (key, n), one row a key, as buckets of sorted files; returns their folder."""
        name = f"level_{uuid.uuid4().hex}"
        path = os.path.join(self.folder, name)
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return path

    def level(self, path) -> DataFrame:
        """A level as a bucketed table, so that joins by key neither shuffle it nor each other."""
        name = f"level_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} (key BIGINT, n BIGINT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self._names.append(name)
        return self.spark.table(name)

    def close(self):
        """Take the names of levels that `level` gave out from the catalog; their files stay."""
        while self._names:
            self.spark.sql(f"DROP TABLE {self._names.pop()}")

    def add(self, entries: DataFrame) -> DataFrame:
        """Index a batch of (key, n). Returns the keys that it repeats, in itself or from an earlier level."""
        rank, path = 0, self._write(entries.groupBy("key").agg(F.sum("n").cast("long").alias("n")))
        new = self.level(path)
        found = new.where("n > 1").select("key")
        for _, other in self.levels:
            found = found.unionAll(new.join(self.level(other), "key").select("key"))
        found = materialize(found.distinct(), "met")
        while self.levels and self.levels[-1][0] == rank:
            old = self.levels.pop()[1]
            both = self.level(old).withColumnRenamed("n", "m").join(self.level(path), "key", "full")
            merged = self._write(both.select("key", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n")))
            remove(self.spark, old, path)
            rank, path = rank + 1, merged
        self.levels.append((rank, path))
        self.close()
        return found


def repeats(docs: DataFrame, kinds, strings=STRINGS, passages=PASSAGES, batches=BATCHES) -> DataFrame:
    """(tid, spans): per text with any, the inclusive start spans (words, a, z) of its repeated windows, in bytes or words.

    `kinds` is a column: 1 to search a text for strings, 2 for passages, 3 for both.
    """
    searches = (strings, passages)
    if max(s.length - s.gram for s in searches) > 511:
        raise ValueError("a region has at most 512 windows")

    def find(batches):
        for rec in batches_of(batches, "text", _BYTES):
            got = []
            for text, kind in zip(rec["text"].to_pylist(), rec["kinds"].to_pylist()):
                both = [regions(CODES[s.unit](text), s) for k, s in enumerate(searches) if kind >> k & 1]
                got.append([np.concatenate(x) for x in zip(*both)] if both else [np.zeros(0, np.int64)] * 3)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(g[0]) for g in got])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([g[k] for g in got]))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([rec["tid"], *lists], names=["tid", "key", "rh", "place"])

    texts = docs.select(text_id().alias("tid"), F.col("text"), kinds.alias("kinds")).where(F.octet_length("text") >= min(s.length * min(s.unit, 2) for s in searches) - 1)
    found = texts.mapInArrow(find, "tid binary, key array<long>, rh array<long>, place array<long>").where(F.size("key") > 0)
    found = materialize(found.groupBy("tid").agg(F.count("*").alias("n"), F.first(F.arrays_zip("key", "rh", "place")).alias("r")), "regions")
    each = found.select("tid", "n", F.explode("r").alias("r")).select("tid", "n", "r.key", "r.rh", "r.place")
    family = Family(docs.sparkSession)
    met = [family.add(each.where(F.pmod(F.xxhash64("tid"), F.lit(batches)) == b).select("key", "n")) for b in range(batches)]
    twice = met[0]
    for m in met[1:]:
        twice = twice.unionAll(m)
    twice = materialize(twice.distinct(), "twice")  # so that the join is free to split a key of many suffixes
    again = materialize(each.join(twice, "key", "left_semi"), "again")
    remove(docs.sparkSession, found.folder, family.folder, *[m.folder for m in met])
    stats = materialize(again.groupBy("key", "rh").agg(F.sum("n").alias("n"), F.min(F.struct("tid", "place")).alias("rep")), "stats")
    sizes = stats.groupBy("key").agg(F.count("*").alias("regions")).where("regions > 1")
    mixed = stats.join(sizes, "key").select("key", "rh", (F.col("regions") > GROUP).alias("large"), "rep.tid", "rep.place")
    wanted = materialize(mixed.groupBy("tid").agg(F.collect_list(F.struct("key", "rh", "large", "place")).alias("rs")), "wanted")

    def slices(batches):
        seen = set()  # of this task: copies of a text are opened once
        for pdf in batches:
            out = []
            for tid, text, rs in zip(pdf["tid"], pdf["text"], pdf["rs"]):
                if tid in seen:
                    continue
                seen.add(tid)
                codes = {}
                for r in rs:
                    start, span, kind = r["place"] // 1024, r["place"] % 1024 // 2, r["place"] % 2
                    length, _, unit = searches[kind]
                    data = codes.get(kind) or codes.setdefault(kind, CODES[unit](text))
                    out.append((r["key"], r["rh"], r["large"], kind, data[start * unit:(start + span + length) * unit]))
            yield pd.DataFrame(out, columns=["key", "rh", "large", "words", "data"])

    # nothing above the join needs the copies of a text together, so a text of very many copies can be split; what tasks open alike is small
    opened = texts.select("tid", "text").join(wanted, "tid").mapInPandas(slices, "key long, rh long, large boolean, words int, data binary")
    opened = materialize(opened.dropDuplicates(["key", "rh"]), "slices")

    def meet(batches):
        """Rows come sorted by key: repeated windows among the at most GROUP regions of each key."""
        key, held = None, []
        for pdf in batches:
            out = []
            for k, rh, kind, data in zip(pdf["key"], pdf["rh"], pdf["words"], pdf["data"]):
                if k != key:
                    out += _repeated(key, held, searches)
                    key, held = k, []
                held.append((rh, kind, data))
            yield pd.DataFrame(out, columns=["key", "rh", "ds"])
        yield pd.DataFrame(_repeated(key, held, searches), columns=["key", "rh", "ds"])

    few = opened.where("NOT large").select("key", "rh", "words", "data").repartition("key").sortWithinPartitions("key")
    few = few.mapInPandas(meet, "key long, rh long, ds array<long>")

    def windows(batches):
        for pdf in batches:
            for key, rh, kind, data in zip(pdf["key"], pdf["rh"], pdf["words"], pdf["data"]):
                length, _, unit = searches[kind]
                wh = np.array([xxhash.xxh3_64_intdigest(data[i * unit:(i + length) * unit]) for i in range(len(data) // unit - length + 1)], np.uint64).view(np.int64)
                yield pd.DataFrame({"wh": wh, "key": key, "rh": rh, "d": np.arange(len(wh))})

    many = materialize(opened.where("large").mapInPandas(windows, "wh long, key long, rh long, d long"), "windows")
    place = F.struct("rh", "d")
    double = many.groupBy("key", "wh").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("key", "wh")
    hit = many.join(double, ["key", "wh"], "left_semi").groupBy("key", "rh").agg(F.collect_set("d").alias("ds"))
    partial = few.unionByName(hit)
    whole = stats.where("n > 1").select("key", "rh", F.lit(True).alias("whole"))
    marks = materialize(whole.join(partial, ["key", "rh"], "full"), "marks")
    start, kind = F.shiftright("place", 10), (F.col("place") % 2).cast("int").alias("words")
    full = F.array(F.struct(kind, start.alias("a"), (start + F.shiftright(F.col("place") % 1024, 1)).alias("z")))
    some = F.transform("ds", lambda d: F.struct(kind, (start + d).alias("a"), (start + d).alias("z")))
    got = again.join(marks, ["key", "rh"]).select("tid", F.when(F.col("whole"), full).otherwise(some).alias("spans"))
    return materialize(got.groupBy("tid").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def _joined(docs, kinds, strings, passages):
    """(row, text, spans) of every row of `docs`; `row` holds its columns."""
    spans = repeats(docs, kinds, strings, passages)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), text_id().alias("tid"))
    return rows.join(spans, "tid", "left").select("row", "text", "spans")


def _runs(spans, strings, passages):
    """(byte runs, word runs) of a text."""
    if spans is None:
        return [], []
    return [covered([(x["a"], x["z"]) for x in spans if x["words"] == k], s.length) for k, s in enumerate((strings, passages))]


def removed(docs: DataFrame, strings=STRINGS, passages=PASSAGES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words) of every row; passages are counted, not removed."""
    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans):
            runs, words = _runs(s, strings, passages)
            data = t.encode()
            out.append((sum(z - a for a, z in runs), len(runs), hashlib.sha256(_keep(data, runs)).hexdigest(), len(words), sum(z - a for a, z in words)))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"])

    text = F.coalesce(F.col("text"), F.lit(""))
    got = _joined(docs.select("doc_id", "text"), F.lit(3), strings, passages)
    return got.select("row.doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest(text, F.col("spans")).alias("d")).select("doc_id", "n_bytes", "d.*")


def _keep(data, runs):
    out, at = [], 0
    for a, z in runs:
        out.append(data[at:a])
        at = z
    return b"".join(out) + data[at:]


def _stripped(docs, kinds, strings, passages):
    @F.pandas_udf("string")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans):
            if s is not None:
                data, (runs, found) = t.encode(), _runs(s, strings, passages)
                if found:
                    at = np.cumsum([0] + [len(c.encode()) for c in t]) if len(data) != len(t) else range(len(t) + 1)
                    places = [m.span() for m in WORD.finditer(t)]
                    runs = runs + [[int(at[places[a][0]]), int(at[places[z - 1][1]])] for a, z in found]
                    runs = covered([(a, z - 1) for a, z in runs], 1)
                t = _keep(data, runs).decode(errors="ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    got = _joined(docs, kinds, strings, passages).withColumn("text", keep("text", "spans"))
    return got.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def strip_repeats(docs: DataFrame, strings=STRINGS) -> DataFrame:
    """`docs` with repeated bytes taken out of `text`; characters cut in half go too."""
    return _stripped(docs, F.lit(1), strings, PASSAGES)


def strip_passages(docs: DataFrame, strings=STRINGS, passages=PASSAGES) -> DataFrame:
    """`docs` without the words of repeated passages, whatever their bytes and white space; a character of a script without spaces is a word."""
    return _stripped(docs, F.lit(2), strings, passages)
