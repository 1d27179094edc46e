"""How the sources of a language differ: term stripes folded in the mappers and merged by key, divergences straight from the merged stripes.

Each task folds its documents, whole, into a table of stripes, (language, term) -> documents and counts by
source, and hands it on whenever it holds CELLS counts. Stripes of one key are added up after a
shuffle by key; those of fewer than LEAST documents go. What remains is dealt by language, pair of
source blocks and share of the terms, the sources with their totals ahead of the stripes, so a task holds
the totals of at most 2 x BLOCK sources and a matrix of BLOCK x BLOCK sums. Totals of a pair over
the shares of the terms are added up; terms are cut to the best of each share before.

Null text, language and source are ''. Repeated rows count each; ties go by name; a language without
kept terms has pairs of value 0; empty tables give no rows. Long texts are read in pieces. The
result grows with the square of a language's sources, as asked for; other columns are left out.
"""
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_table, words_of

LEAST, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
CELLS = 300_000  # counts that a task holds before it hands its stripes on
BLOCK = 512  # sources of one side of a pair of blocks
SHARE = 256  # terms of a share, at least
LETTERS = word_table(b"abcdefghijklmnopqrstuvwxyz")


def fold(docs: DataFrame, cells=CELLS) -> DataFrame:
    """(lang, term, df, sources, counts) of the documents (lang, source, text) of each task, some keys several times."""
    def run(batches):
        stripes, held = {}, 0

        def handed():
            rows = [(lang, term, df, list(own), list(own.values())) for lang, terms in stripes.items() for term, (df, own) in terms.items()]
            for at in range(0, len(rows), 20_000):
                lang, term, df, sources, counts = zip(*rows[at:at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([t.decode() for t in term], pa.string()), pa.array(df, pa.int64()), pa.array(sources, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                                                 ["lang", "term", "df", "sources", "counts"])

        for rec in batches:
            for lang, source, text in zip(rec["lang"].to_pylist(), rec["source"].to_pylist(), rec["text"]):
                found = Counter()
                for words in words_of(text.as_py(), LETTERS):
                    found.update(words)
                terms = stripes.setdefault(lang, {})
                for term, n in found.items():
                    stripe = terms.get(term)
                    if stripe is None:
                        stripe = terms[term] = [0, {}]
                    stripe[0] += 1
                    own = stripe[1]
                    if source in own:
                        own[source] += n
                    else:
                        own[source], held = n, held + 1
                if held >= cells:
                    yield from handed()
                    stripes, held = {}, 0
        yield from handed()

    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, term string, df long, sources array<string>, counts array<long>")


def merge(stripes: DataFrame, least=LEAST) -> DataFrame:
    """(lang, term, n, sources, counts): one stripe for each key of at least `least` documents."""
    each = stripes.repartition("lang", "term").select("lang", "term", "df", F.posexplode(F.arrays_zip("sources", "counts")).alias("k", "c"))
    each = each.groupBy("lang", "term", "c.sources").agg(F.sum("c.counts").alias("n"), F.sum(F.when(F.col("k") == 0, F.col("df")).otherwise(0)).alias("df"))
    whole = each.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("sources", "n"))).alias("c"))
    return whole.where(F.col("df") >= least).select("lang", "term", "n", F.col("c.sources").alias("sources"), F.col("c.n").alias("counts"))


def groups_of(docs: DataFrame, stripes: DataFrame) -> DataFrame:
    """(lang, source, place, total, lang_total, kept): every group with the sums of its counts, its place in its language, and the language's kept terms."""
    pairs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    langs = stripes.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    got = pairs.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    return got.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)


def portions(counts, total):
    """1 + floor(SCALE * counts / total), exact in 64 bits for counts up to total: long division by three digits a step."""
    out, rest = np.zeros(np.broadcast(counts, total).shape, np.int64), counts
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


class _Cell:
    """The sums of one (language, pair of blocks, share of terms)."""

    def __init__(self, lang, i, j):
        self.lang, self.i, self.j, self.names, self.totals, self.rows, self.top = lang, i, j, [[], []], [[], []], [], {}
        self.sums = None

    def source(self, block, name, total, lang_total, kept):
        self.lang_total, self.kept = lang_total, kept
        for side, b in ((0, self.i), (1, self.j)):
            if block == b:
                self.names[side].append(name)
                self.totals[side].append(total)

    def counted(self, side):
        column = {s: k for k, s in enumerate(self.names[side])}
        counts = np.zeros((len(self.rows), len(column)), np.int64)
        for r, (_, _, sources, values) in enumerate(self.rows):
            for s, v in zip(sources, values):
                if s in column:
                    counts[r, column[s]] = v
        return counts, portions(counts + PRIOR, np.array(self.totals[side], np.int64) + PRIOR * self.kept)

    def add(self):
        """Take the waiting stripes into the sums."""
        if self.sums is None:
            self.sums = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)
        if not self.rows:
            return
        counts, p = self.counted(0)
        q = p if self.i == self.j else self.counted(1)[1]
        for a in range(p.shape[1]):
            self.sums[a] += np.abs(p[:, a:a + 1] - q).sum(0)
        if self.i == self.j:
            whole = portions(np.array([n for _, n, _, _ in self.rows], np.int64) + PRIOR, self.lang_total + PRIOR * self.kept)
            for a, name in enumerate(self.names[0]):
                more = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > whole))
                best = self.top.get(name, []) + [(-int(p[r, a] - whole[r]), self.rows[r][0]) for r in more]
                self.top[name] = sorted(best)[:TOP]
        self.rows = []

    def out(self):
        self.add()
        for a, x in enumerate(self.names[0]):
            for b, y in enumerate(self.names[1]):
                if x != y:
                    yield self.lang, x, "pair", y, int(self.sums[a, b])
                    if self.i != self.j:
                        yield self.lang, y, "pair", x, int(self.sums[a, b])
        for name, best in self.top.items():
            for f, term in best:
                yield self.lang, name, "term", term, -f


def _emit(batches):
    cell, key, out = None, None, []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 4 + [pa.int64()])], ["lang", "source", "part", "item", "value"])

    for rec in batches:
        for row in rec.to_pylist():
            if (row["lang"], row["i"], row["j"], row["h"]) != key:
                for got in cell.out() if cell else ():
                    out.append(got)
                    if len(out) == 20_000:
                        yield batch(out)
                        out = []
                key = row["lang"], row["i"], row["j"], row["h"]
                cell = _Cell(*key[:3])
            if row["block"] is not None:
                cell.source(row["block"], row["name"], row["n"], row["lang_total"], row["kept"])
            else:
                cell.rows.append((row["name"], row["n"], row["sources"], row["counts"]))
                if len(cell.rows) == 1024:
                    cell.add()
    out += list(cell.out()) if cell else []
    for at in range(0, len(out), 20_000):
        yield batch(out[at:at + 20_000])


def audit(docs: DataFrame, least=LEAST, block=BLOCK, cells=CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): of every group the divergence from each other source of its language, and its TOP terms above the language's share."""
    stripes = materialize(merge(fold(docs, cells), least), "stripes")
    groups = materialize(groups_of(docs, stripes), "groups")
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"), F.ceil(F.max("kept") / F.greatest(F.lit(SHARE), F.least(F.count("*"), F.lit(block)))).alias("shares"))
    sizes = materialize(sizes.withColumn("shares", F.greatest("shares", F.lit(1).cast("long"))), "sizes")
    zero = F.lit(0).cast("long")
    head = groups.join(sizes, "lang").withColumns({"block": F.floor(F.col("place") / block), "h": F.explode(F.sequence(zero, F.col("shares") - 1))})
    head = head.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    none = F.lit(None)
    head = head.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "h", "block", F.col("source").alias("name"), F.col("total").alias("n"), "lang_total", "kept",
                       none.cast("array<string>").alias("sources"), none.cast("array<long>").alias("counts"))
    body = stripes.join(sizes, "lang").withColumns({"h": F.pmod(F.xxhash64("term"), F.col("shares")), "i": F.explode(F.sequence(zero, F.col("blocks") - 1))}).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    body = body.select("lang", "i", "j", "h", none.cast("long").alias("block"), F.col("term").alias("name"), "n", none.cast("long").alias("lang_total"), none.cast("long").alias("kept"), "sources", "counts")
    key = ["lang", "i", "j", "h"]
    rows = head.unionByName(body).repartition(*key).sortWithinPartitions(*key, F.asc_nulls_last("block"))
    parts = rows.mapInArrow(_emit, "lang string, source string, part string, item string, value long")
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= TOP))
