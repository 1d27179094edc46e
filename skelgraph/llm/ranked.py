"""Ranked search of a query set: term-at-a-time with limited accumulators, over an index that Spark keeps by slices of documents.

The queries come in blocks of about BLOCK (item, term) rows; a block is one pass over the documents.
First every document becomes a row of its counts of the block's terms, written once; from these rows come the number of
documents, their length and the weights. Then each task takes its rows in slices, turns a slice
into postings and runs every item through them, rarest terms first. A document gets an accumulator only
while what the terms ahead can add still reaches the k-th best score known so far (of the
slice's partial scores and of the slices before); then only those accumulators that can still reach it
are carried on, exactly. The best k of all tasks meet in two rounds.

A term's weight and a document's share are those of `weights` and `shares`. Null text is empty. Rows of
one item id (null included) are one query. Repeated document rows are ranked each; a null
doc_id stands behind the others among equal scores. Empty tables give no rows. Texts are
read whole, in pieces of about a megabyte. Other columns are left out.
"""
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, remove, word_table, words_of

K = 20
BLOCK = 1 << 17  # (item, term) rows of the queries of one pass
ALNUM = word_table(b"0123456789abcdefghijklmnopqrstuvwxyz")


def counted(text) -> Counter:
    found = Counter()
    for words in words_of(text, ALNUM):
        found.update(words)
    return found


def query_terms(queries: DataFrame, item_col="item_id", text_col="text") -> DataFrame:
    """(item_id, term, n): the terms of every item with their number."""
    kind = dict(queries.dtypes)[item_col]

    def split(batches):
        for rec in batches:
            rows = [(k, t, n) for k, text in enumerate(rec[1].to_pylist()) for t, n in counted(text).items()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([rec[0].take(at), pa.array([r[1].decode() for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "term", "n"])

    rows = queries.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(split, f"item_id {kind}, term string, n long")
    return rows.groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def index(docs: DataFrame, vocabulary: list, doc_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: its number of terms, and places in the vocabulary (sorted bytes) with their counts."""
    kind = dict(docs.dtypes)[doc_col]

    def count(batches):
        place = {t: i for i, t in enumerate(vocabulary)}
        for rec in batches:
            n, size, terms, tfs = [], [0], [], []
            for text in rec[1]:
                found = counted(text.as_py())
                n.append(found.total())
                for t in found.keys() & place.keys():
                    terms.append(place[t])
                    tfs.append(found[t])
                size.append(len(terms))
            ends = pa.array(size, pa.int32())
            yield pa.RecordBatch.from_arrays([rec[0], pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def weights(rows: DataFrame, documents: int) -> DataFrame:
    """(term, df, w) of the terms of an index: at most one row for each of the block's terms."""
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("w", F.floor(1000 * F.log((2.0 * documents + 2) / (2.0 * F.col("df") + 1))).cast("long"))


def shares(tf, n, documents, length):
    """What one occurrence's weight is multiplied by, for counts `tf` in documents of `n` terms."""
    m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Slice:
    """Postings of some documents: for each term the documents in order, and their shares."""

    def __init__(self, n, size, terms, tfs, vocabulary, documents, length):
        doc = np.repeat(np.arange(len(n)), size)
        share = shares(tfs, n[doc], documents, length)
        order = np.argsort(terms, kind="stable")
        self.documents, self.doc, self.share = len(n), doc[order], share[order]
        self.start = np.searchsorted(terms[order], np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        there = np.flatnonzero(np.diff(self.start))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.share, self.start[there])

    def search(self, terms, each, k, least=0):
        """(documents, scores) that hold all of the k best of this slice with scores of `least` or more, and the number of accumulators.

        `terms` with the weight times number `each` come rarest first.
        """
        bound = each * self.most[terms]
        ahead = np.append(np.cumsum(bound[::-1])[::-1], 0)  # what the terms from here on can add at most
        acc, made, made_n = np.zeros(self.documents, np.int64), None, 0
        for j, t in enumerate(terms):
            if made is None and ahead[j] < least:  # no new document can come among the best
                made = np.flatnonzero(acc)
                made_n, made = len(made), made[acc[made] + ahead[j] >= least]
            doc, add = self.doc[self.start[t]:self.start[t + 1]], each[j] * self.share[self.start[t]:self.start[t + 1]]
            if made is None:
                acc[doc] += add
                if ahead[j + 1] < acc.max(initial=0):
                    least = max(least, _kth(acc[acc > 0], k))
            elif len(made) and len(doc):
                at = np.minimum(np.searchsorted(doc, made), len(doc) - 1)
                hit = doc[at] == made
                acc[made[hit]] += add[at[hit]]
                least = max(least, _kth(acc[made], k))
                made = made[acc[made] + ahead[j + 1] >= least]
        if made is None:
            made = np.flatnonzero(acc)
            made_n = len(made)
        made = made[(acc[made] > 0) & (acc[made] >= least)]
        return made, acc[made], made_n


def _kth(scores, k):
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _best(rows: DataFrame, items, vocabulary, documents, length, k) -> DataFrame:
    """(item, doc_id, score): the k best of every task for each of `items` (terms, each)."""
    kind = dict(rows.dtypes)["doc_id"]

    def search(batches):
        best = [[] for _ in items]  # of each item the k best so far as (-score, null id, id)
        for rec in batches:
            n, ids = rec["n"].to_numpy().astype(np.int64), rec["doc_id"].to_pylist()
            size = np.diff(rec["terms"].offsets.to_numpy())
            part = Slice(n, size, rec["terms"].flatten().to_numpy(), rec["tfs"].flatten().to_numpy(), vocabulary, documents, length)
            turn = np.empty(len(ids), np.int64)
            turn[sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))] = np.arange(len(ids))
            for own, (terms, each) in zip(best, items):
                found, score, _ = part.search(terms, each, k, -own[-1][0] if len(own) == k else 0)
                if len(found):
                    first = np.lexsort((turn[found], -score))[:k]
                    own += [(-int(score[i]), ids[found[i]] is None, ids[found[i]]) for i in first]
                    own.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
                    del own[k:]
        out = [(i, r[2], -r[0]) for i, own in enumerate(best) for r in own]
        for at in range(0, len(out), 10_000):
            item, doc, score = zip(*out[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, rec.schema.field("doc_id").type), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return rows.where("size(terms) > 0").mapInArrow(search, f"item int, doc_id {kind}, score long")


def _block(docs, asked, doc_col, text_col, k):
    """(item, doc_id, score) candidates of one block of (item_id, term, n) rows, and its item ids."""
    spark = docs.sparkSession
    names = sorted(set(asked["term"].to_pylist()))
    place = {t: i for i, t in enumerate(names)}
    rows = materialize(index(docs, [t.encode() for t in names], doc_col, text_col), "index")
    documents, length = rows.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    known = weights(rows, documents).toArrow().to_pydict()
    w, df = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    w[known["term"]], df[known["term"]] = known["w"], known["df"]
    term, n = np.array([place[t] for t in asked["term"].to_pylist()], np.int64), asked["n"].to_numpy()
    ids = asked["item_id"].combine_chunks().dictionary_encode("encode")
    order = np.lexsort((term, df[term], ids.indices.to_numpy()))
    order = order[df[term[order]] > 0]
    item = ids.indices.to_numpy()[order]
    cuts = np.searchsorted(item, np.arange(len(ids.dictionary) + 1))
    items = [(term[order[a:z]], (n * w[term])[order[a:z]]) for a, z in zip(cuts, cuts[1:])]
    if not length:
        items = []
    best = _best(rows, items, len(names), documents, length, k)
    name = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids.dictionary)), pa.int32()), "item_id": ids.dictionary}))
    return materialize(best.join(F.broadcast(name), "item").select("item_id", "doc_id", "score"), "best"), rows.folder


def search(docs: DataFrame, queries: DataFrame, k=K, doc_col="doc_id", text_col="text", item_col="item_id", block=BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item the k documents of the highest scores above 0, equal ones by doc_id."""
    spark = docs.sparkSession
    asked = materialize(query_terms(queries, item_col), "queries")
    blocks = max(1, -(-asked.count() // block))
    every = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        got, folder = _block(docs, part, doc_col, text_col, k)
        remove(spark, folder)
        every = got if every is None else every.unionAll(got)
    last = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = Window.partitionBy("item_id", "deal").orderBy(*last)
    first = every.withColumn("deal", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).drop("rank")
    whole = F.row_number().over(Window.partitionBy("item_id").orderBy(*last))
    return first.withColumn("rank", whole).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
