"""Mixing sources to target weights by pivotal rounding, in SQL functions only.

A source's words over its target give every one of its documents the same number of copies, most
often a fraction. The whole part is sure. The fractions are rounded in pairs: probability mass, counted in
words, moves from one document to the other until one of them holds 0 or 1, the direction drawn so that
both keep their expected copies; so no step changes the words that the source is expected to give.
Documents are dealt by hash into blocks of about FAN; a block folds its documents from long to short, so that what is left
at its end is one short document with a fraction. These go into blocks of FAN blocks, and so on, level by level,
each written once, until a source has one left, which a coin rounds. Thus a source misses its
target by less than that document's words.

Draws are hashes of the seed and of the rows' own values: the same for any partitioning. Null or wordless text has
size 0 and takes nothing; rows repeated in (doc_id, source, size) are drawn each; a null source is a source, the
last one; sources without words have target 0; empty tables give no rows.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..operators.numbering import numbered
from .common import materialize

MOST = 3  # copies of a document
FAN = 64  # documents or blocks that are folded together
FEW = 100_000  # sources that are broadcast at most


def uniform(seed, *keys):
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 50)) + 0.5) / float(1 << 50)


def sizes(docs: DataFrame, doc_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """(doc_id, source, size): the words of every row."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col(doc_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"))


def targets(sources: DataFrame, most=MOST) -> DataFrame:
    """(source, source_size, ...) with target: by weight the share of all words, at most `most` times the source's own; the excess goes to the others by weight."""
    sources = materialize(sources.withColumn("cap", most * F.col("source_size")), "sources")
    level, capped = 0.0, -1
    while True:  # the level of words a unit of weight rises until no further source is full
        full = F.col("cap") < level * F.col("weight")
        got = sources.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not got[0] or not got[2] or got[3] == capped:
            break
        level, capped = (got[0] - (got[1] or 0)) / got[2], got[3]
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))


def _fold(units, words, mass, seed, level, types):
    """struct<left, out, ...> of an array of (neg, h, doc_id, p) in order, of `words` in all and `mass` expected: the one left over (or null) and (doc_id, size, extra) of the others.

    What has moved to or from the shorter ones is kept as the map p -> scale * p + shift, the same for all of them.
    """
    def state(words, mass, scale, shift, left, out):
        return F.struct(words.alias("words"), mass.alias("mass"), scale.alias("scale"), shift.alias("shift"), left.alias("left"), out.alias("out"))

    def step(acc, e):
        size = -e["neg"]
        words, mass = acc["words"] - size, acc["mass"] - size * e["p"]
        p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), acc["scale"] * e["p"] + acc["shift"]))
        others = F.greatest(F.lit(0.0), F.least(words.cast("double"), acc["scale"] * mass + acc["shift"] * words))
        now = F.struct(words.alias("words"), mass.alias("mass"), p.alias("p"), (size * (1 - p)).alias("room"), (size * p).alias("held"), others.alias("give"), (words - others).alias("take"))

        def settled(extra):
            return F.concat(acc["out"], F.array(F.struct(e["doc_id"].alias("doc_id"), size.alias("size"), F.lit(extra).alias("extra"))))

        def kept(p):
            return F.struct(e["neg"].alias("neg"), e["h"].alias("h"), e["doc_id"].alias("doc_id"), p.alias("p"))

        def moved(m):
            up = uniform(seed, F.lit(level), e["h"]) * (F.least(m["room"], m["give"]) + F.least(m["held"], m["take"])) < F.least(m["held"], m["take"])
            gone, come = 1 - m["room"] / m["give"], 1 - m["held"] / m["take"]
            one, zero = F.lit(1.0), F.lit(0.0)
            same = acc["scale"], acc["shift"], acc["left"]
            return (F.when(m["p"] <= 0, state(m["words"], m["mass"], *same, settled(0)))
                    .when(m["p"] >= 1, state(m["words"], m["mass"], *same, settled(1)))
                    .when(up & (m["room"] <= m["give"]), state(m["words"], m["mass"], acc["scale"] * gone, acc["shift"] * gone, acc["left"], settled(1)))
                    .when(up, state(m["words"], m["mass"], zero, zero, kept(m["p"] + m["give"] / size), acc["out"]))
                    .when(m["held"] <= m["take"], state(m["words"], m["mass"], acc["scale"] * come, acc["shift"] * come + (one - come), acc["left"], settled(0)))
                    .otherwise(state(m["words"], m["mass"], zero, one, kept(m["p"] - m["take"] / size), acc["out"])))

        return let(now, moved)

    start = state(words, mass, F.lit(1.0), F.lit(0.0), F.lit(None).cast(types["left"]), F.array().cast(types["out"]))
    return F.aggregate(units, start, step)


def mix(docs: DataFrame, seed=42, fan=FAN, most=MOST, weights: DataFrame | None = None, doc_col="doc_id", source_col="source", text_col="text") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each row of `docs`.

    `weights` (source, weight) states the weights; a source without one has 0. By default they are 1, 2, 3, repeating, by the sources' order.
    """
    kind = dict(docs.dtypes)[doc_col]
    groups = materialize(sizes(docs, doc_col, source_col, text_col).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "groups")
    sources = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("units"))
    if weights is None:
        sources = numbered(sources, "place", [], [F.col("source").asc_nulls_last()]).withColumn("weight", F.col("place") % 3 + 1).drop("place")
    else:
        sources = sources.join(weights.select(F.col("source").alias("_s"), "weight"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").na.fill(0, ["weight"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = targets(sources, most).withColumns({"whole": F.floor(rate).cast("int"), "p": rate - F.floor(rate), "blocks": F.ceil(F.col("units") / fan)})
    sources = materialize(sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "p", "blocks"), "targets")
    count, widest = sources.agg(F.count("*"), F.coalesce(F.max("blocks"), F.lit(0))).first()
    own = F.broadcast(sources) if count <= FEW else sources
    units = groups.join(own, F.col("source").eqNullSafe(F.col("s"))).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    units = units.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "nth"))
    sure = (F.col("size") == 0) | (F.col("p") <= 0)
    done = [units.where(sure).select("doc_id", "source", "size", F.lit(0).alias("extra"))]
    one = F.struct((-F.col("size")).alias("neg"), "h", "doc_id", "p")
    types = {"left": f"struct<neg: long, h: long, doc_id: {kind}, p: double>", "out": f"array<struct<doc_id: {kind}, size: long, extra: int>>"}
    rest, level = units.where(~sure).select("source", F.pmod("h", "blocks").alias("block"), one.alias("u")), 0
    while True:
        folded = rest.groupBy("source", "block").agg(F.sort_array(F.collect_list("u")).alias("u"), F.sum(-F.col("u.neg")).alias("words"))
        mass = F.aggregate("u", F.lit(0.0), lambda m, e: m - e["neg"] * e["p"])  # in the array's order, so that reruns agree to the last bit
        folded = folded.select("source", "block", _fold(F.col("u"), F.col("words"), mass, seed, level, types).alias("f"))
        folded = materialize(folded.select("source", "block", "f.left", "f.out"), f"level{level}")
        done.append(folded.select("source", F.explode("out").alias("o")).select("o.doc_id", "source", "o.size", "o.extra"))
        if widest <= 1:
            break
        widest, level = -(-widest // fan), level + 1
        rest = folded.where("left IS NOT NULL").select("source", F.floor(F.col("block") / fan).alias("block"), F.col("left").alias("u"))
    coin = (uniform(seed, F.lit(-1), F.col("left.h")) < F.col("left.p")).cast("int")
    done.append(folded.where("left IS NOT NULL").select("left.doc_id", "source", (-F.col("left.neg")).alias("size"), coin.alias("extra")))
    every = done[0]
    for more in done[1:]:
        every = every.unionAll(more)
    copies = F.col("whole") + F.col("extra")
    return every.join(own, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
