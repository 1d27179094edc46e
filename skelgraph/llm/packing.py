"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of the tokens of its documents, of whatever number; one total
a source reaches the driver. Every window of `size` tokens owes each queue its target
share. A queue's deficit is what it was owed and has not given; a window takes the
whole tokens of each deficit and the rest from the largest ones, and what remains is
carried to the next window. Targets are the given `weights` (sources not named, or of
weight zero or less, go last in proportion to their tokens), else the corpus's own
shares. A queue that runs dry leaves its share to the others in proportion. The
deficits at every BLOCK-th window, and where a queue runs dry, have a closed form (the next token is the one due
first at 2 q + 1 over twice the weight), so partitions start with the exact deficits
that earlier ones left. All windows are full but the last.

Null text is empty (its end token only); null source is a queue of its own. Order in a
queue: hash chunk, doc_id, tokens; repeated rows are packed as often as they occur.
Extra columns are ignored, whatever their names; an empty table gives no pieces.
"""
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import batches_of, materialize

SIZE = 2048
END = 1
CHUNK_ROWS = 64  # of one queue, placed together
GROUP = 1024  # chunks whose sums are added up in one task
BLOCK = 1024  # windows from one closed-form state to the next
_BYTES = 8 << 20


class Schedule:
    """Tokens that each queue has given at each window; `weights` are whole numbers, larger for larger targets."""

    def __init__(self, totals, weights=None, size=SIZE):
        self.size, self.all = size, sum(totals)
        self.totals = [int(t) for t in totals]
        self.weights = self.totals if weights is None else [int(w) for w in weights]
        first = [max(w, 0) for w in self.weights]
        self.last = [t if w <= 0 else 0 for t, w in zip(self.totals, self.weights)]  # served when all the others are dry
        self.tiers = [([t if w else 0 for t, w in zip(self.totals, first)], first), (self.last, self.last)]
        self.windows = -(-self.all // size)
        self.states, self.blocks = {}, {}
        knots, done = {0, self.windows}, 0
        for totals, weights in self.tiers:  # windows around which a queue runs dry
            live = sorted((Fraction(t, w), t, w) for t, w in zip(totals, weights) if t)
            dry, share = 0, sum(w for _, _, w in live)
            for time, t, w in live:
                seats = done + dry + int(time * share)
                knots |= {seats // size, min(seats // size + 1, self.windows)}
                dry, share = dry + t, share - w
            done += dry
        self.knots = np.array(sorted(knots))

    @staticmethod
    def _due(totals, weights, seats):
        """How many of the first `seats` tokens in the order of their dues each queue gives."""
        live = sorted((k for k, t in enumerate(totals) if t), key=lambda k: Fraction(totals[k], weights[k]))
        left, share = seats, sum(weights[k] for k in live)
        time = Fraction(0)
        for k in live:  # queues run dry in this order
            time = Fraction(left, share)
            if time * weights[k] <= totals[k]:
                break
            left, share = left - totals[k], share - weights[k]
        got = [min(t, int(w * time + Fraction(1, 2))) if t else 0 for t, w in zip(totals, weights)]
        off = seats - sum(got)
        while off:
            if off > 0:
                k = min((k for k in live if got[k] < totals[k]), key=lambda k: (Fraction(2 * got[k] + 1, weights[k]), k))
            else:
                k = max((k for k in live if got[k]), key=lambda k: (Fraction(2 * got[k] - 1, weights[k]), k))
            got[k] += 1 if off > 0 else -1
            off += -1 if off > 0 else 1
        return got

    def state(self, window):
        """Tokens given before a window: the closed form."""
        got = self.states.get(window)
        if got is None:
            if len(self.states) > 4096:
                self.states.clear()
            seats, got = min(window * self.size, self.all), np.zeros(len(self.totals), np.int64)
            for totals, weights in self.tiers:
                part = min(seats, sum(totals))
                if part:
                    got += np.array(self._due(totals, weights, part), np.int64)
                seats -= part
            self.states[window] = got
        return got

    def _at_once(self, owed, whole, windows):
        """What `_rounds` counts window by window, for all windows together; None if a queue is ahead of its share in any.

        Else the whole tokens of all that a queue is owed so far are given, and the largest parts left over get one each.
        """
        due = np.minimum(np.arange(1, windows + 1) * self.size, whole)[:, None] * owed
        given = np.zeros((windows + 1, len(owed)), np.int64)
        given[1:], left = np.divmod(due, max(whole, 1))
        short = left.sum(axis=1) // max(whole, 1)
        order = np.argsort(-left, axis=1, kind="stable")
        np.put_along_axis(left, order, np.arange(len(owed)) < short[:, None], axis=1)
        given[1:] += left
        return given if (due >= given[:-1] * whole).all() else None

    def _rounds(self, first, last):
        """Tokens given before each window from `first` to `last`, between which every share stays the same."""
        base, owed = self.state(first), self.state(last) - self.state(first)
        whole = int(owed.sum())
        given = self._at_once(owed, whole, last - first)
        if given is not None:
            return given + base
        given = np.zeros((last - first + 1, len(owed)), np.int64)
        for w in range(last - first):
            seats = min(self.size, whole - w * self.size)
            deficit = owed * (w * self.size + seats) - given[w] * whole  # in parts of a token, `whole` of them each
            take = np.maximum(deficit // whole, 0)
            short = seats - int(take.sum())
            if short > 0:
                take[np.argsort(take * whole - deficit, kind="stable")[:short]] += 1
            while short < 0:  # queues ahead of their share owe nothing, so others may be owed too much
                order = np.argsort(-take, kind="stable")[:-short]
                order = order[take[order] > 0]
                take[order] -= 1
                short += len(order)
            given[w + 1] = given[w] + take
        return given + base

    def block(self, b):
        """(given, within): tokens given before each window of a block and its end, and each queue's place in the window."""
        got = self.blocks.get(b)
        if got is None:
            if sum(x[0].size for x in self.blocks.values()) > 1 << 22:
                self.blocks.clear()
            first, last = b * BLOCK, min((b + 1) * BLOCK, self.windows)
            cuts = [first, *self.knots[(self.knots > first) & (self.knots < last)].tolist(), last]
            parts = [self._rounds(i, j)[:-1] for i, j in zip(cuts, cuts[1:])]
            given = np.concatenate([*parts, [self.state(last)]])
            step = np.diff(given, axis=0)
            got = self.blocks[b] = (given, np.cumsum(step, axis=1) - step)
        return got

    def spans(self, s, a, z):
        """(position, window, offset) arrays: where the tokens [a, z) of queue s begin to fall into each window."""
        low, high = 0, -(-self.windows // BLOCK) - 1  # the last block that starts at or before a
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.state(mid * BLOCK)[s] <= a else (low, mid - 1)
        out, b = [], low
        while a < z:
            given, within = self.block(b)
            starts, ends = given[:-1, s], given[1:, s]
            w = np.flatnonzero((ends > a) & (starts < z) & (ends > starts))
            at = np.maximum(starts[w], a)
            out.append((at, w + b * BLOCK, within[w, s] + at - starts[w]))
            a, b = max(a, int(ends[-1])), b + 1
        return [np.concatenate(x) for x in zip(*out)]


def pack(docs: DataFrame, tokenizer_path: str, size=SIZE, weights=None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    `weights` maps sources to target proportions, as whole numbers.
    """
    def tokenize(batches):
        bpe = wordbpe.model(tokenizer_path)
        for rec in batches_of(batches, "text", _BYTES):
            ids, offsets = bpe.encode(rec["text"], END)
            data = pa.Array.from_buffers(pa.large_binary(), len(rec), [None, pa.py_buffer((2 * offsets).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rec["doc_id"], rec["source"], pa.array(np.diff(offsets)), data], names=["doc_id", "source", "n", "ids"])
        pa.default_memory_pool().release_unused()  # else the worker keeps about 100 MB for what it runs next

    kind = docs.schema["doc_id"].dataType.simpleString()
    toks = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    toks = materialize(toks.mapInArrow(tokenize, f"doc_id {kind}, source string, n long, ids binary"), "tokens")
    stats = toks.groupBy("source").agg(F.sum("n").alias("sum"), F.count("*").alias("rows"))
    found = sorted((r["source"] is not None, r["source"] or "", r["sum"], r["rows"]) for r in stats.collect())  # one row a source
    names = [x[1] if x[0] else None for x in found]
    given = None if weights is None else [weights.get(x, 0) for x in names]
    schedule = Schedule([x[2] for x in found], given, size)
    number = {x: k for k, x in enumerate(names)}
    queues = docs.sparkSession.createDataFrame([(k, x, max(1, found[k][3] // CHUNK_ROWS)) for x, k in number.items()], "queue int, source string, chunks long")
    toks = toks.join(F.broadcast(queues), toks["source"].eqNullSafe(queues["source"])).select("doc_id", "queue", "n", "ids", F.pmod(F.xxhash64("doc_id", "n", "ids"), "chunks").alias("chunk"))
    group = F.floor(F.col("chunk") / GROUP).alias("group")
    sums = materialize(toks.groupBy("queue", "chunk").agg(F.sum("n").alias("sum")).select("queue", "chunk", group, "sum"), "sums")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("queue", "group").agg(F.sum("sum").alias("sum"))
    groups = groups.withColumn("far", F.coalesce(F.sum("sum").over(before.partitionBy("queue").orderBy("group")), F.lit(0))).drop("sum")
    near = sums.withColumn("near", F.coalesce(F.sum("sum").over(before.partitionBy("queue", "group").orderBy("chunk")), F.lit(0)))
    base = near.join(groups, ["queue", "group"]).select("queue", "chunk", (F.col("near") + F.col("far")).alias("base"))
    order = Window.partitionBy("queue", "chunk").orderBy("doc_id", "n", F.xxhash64("ids"))
    placed = (toks.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
              .join(base, ["queue", "chunk"]).select("doc_id", "queue", "n", "ids", (F.col("base") + F.col("before")).alias("at")))

    def cut(batches):
        for rec in batches:
            if not len(rec):
                continue
            rec = rec.take(pa.array(np.lexsort((rec["at"].to_numpy(), rec["queue"].to_numpy()))))
            queue, at, n = (rec[c].to_numpy() for c in ("queue", "at", "n"))
            ids = np.frombuffer(b"".join(rec["ids"].to_pylist()), "<u2").astype("<u4")
            data, first = memoryview(ids.view(np.uint8)), np.cumsum(n) - n
            heads = np.flatnonzero(np.concatenate([[True], (queue[1:] != queue[:-1]) | (at[1:] != at[:-1] + n[:-1])]))
            cols = [[] for _ in range(6)]
            for i, j in zip(heads, [*heads[1:], len(rec)]):  # documents that follow each other in their queue
                s, end = int(queue[i]), int(at[j - 1] + n[j - 1])
                pos, window, offset = schedule.spans(s, int(at[i]), end)
                starts = np.union1d(at[i:j], pos)
                doc = np.searchsorted(at[i:j], starts, "right") - 1 + i
                span = np.searchsorted(pos, starts, "right") - 1
                for col, x in zip(cols, (doc, starts - at[doc], np.diff(np.append(starts, end)), window[span], offset[span] + starts - pos[span])):
                    col.append(x)
            doc, start, length, window, offset = (np.concatenate(c) for c in cols[:5])
            low = (4 * (first[doc] + start)).tolist()
            crc = [zlib.crc32(data[a:z]) for a, z in zip(low, (4 * (first[doc] + start + length)).tolist())]
            source = pa.array(names, pa.string()).take(pa.array(queue[doc]))
            yield pa.RecordBatch.from_arrays(
                [rec["doc_id"].take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), n[doc], window, offset)), source],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
