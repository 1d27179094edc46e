"""Least-cost one-to-one assignment of many matrices at once, by auction.

A matrix lies in the shared folder as blocks of ROWS rows; its other state is one row of prices and owners, a
number for each column. In a round every block bids for its unassigned rows at the prices of the round's
start (a row bids its best column up to its second best and epsilon more; rows of a block bid one after the
other, against each other's bids, and hand on what they hold at the end). The highest bid of
each column wins. Since a price only rises, a bid at older prices is never too high, so rounds keep every row within epsilon
of its best column. When all rows are assigned, the columns left over must not cost more than those
taken: the rows that would pad the matrix to a square bid for the cheapest ones together. Then epsilon goes
down, prices stay, and all rows bid again; each matrix goes through its epsilons at its own pace.
The sum of costs is within (number of rows) * `least` of the optimum.

A task holds at most ROWS rows of a matrix, and its prices. Blocks that bid against each other take rounds; a matrix of
node vectors that is one tile is made and solved where it is, and neither written nor shuffled.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import dropped, written

ROWS = 128  # rows of a block; no task holds more of a matrix
COLUMNS = 1024  # columns that are multiplied at once with a block's rows
EPSILON, STEP, LEAST = 0.2, 10, 1e-8


def _violated(prices, owner, n, eps):
    """Do the columns left over cost more than those taken, although all rows are assigned?"""
    taken = owner >= 0
    return 0 < n < len(owner) and taken.sum() == n and prices[~taken].max() > prices[taken].min() + eps


def _level(prices, n, eps):
    """The price below which the padding rows take the cheapest columns."""
    return np.partition(prices, len(prices) - n)[len(prices) - n] + eps


def _bids(benefit, ids, prices, owner, n, eps):
    """{column: (row number, or -1 for a padding row, price)} held at the end by the rows of `benefit`, all unassigned at first."""
    prices, owner, place = prices.copy(), owner.copy(), {int(i): k for k, i in enumerate(ids)}
    waiting, touched = list(range(len(ids))), set()
    while waiting:
        row = waiting.pop()
        value = benefit[row] - prices
        best = int(value.argmax())
        top = value[best]
        value[best] = -np.inf
        second = value.max()
        prices[best] += eps + (top - second if np.isfinite(second) else 0.0)
        if int(owner[best]) in place:
            waiting.append(place[int(owner[best])])
        owner[best] = ids[row]
        touched.add(best)
        if not waiting and _violated(prices, owner, n, eps):
            level = _level(prices, n, eps)
            for j in np.flatnonzero(prices < level).tolist():
                if int(owner[j]) in place:
                    waiting.append(place[int(owner[j])])
                prices[j], owner[j] = level, -1
                touched.add(j)
    return {j: (int(owner[j]), prices[j]) for j in touched}


def _bid(batches):
    for pdf in batches:
        out = []
        for pair, n, ids, tiles, prices, owner, eps in zip(pdf["pair"], pdf["n"], pdf["ids"], pdf["tiles"], pdf["prices"], pdf["owner"], pdf["eps"]):
            free = ~np.isin(ids, owner)
            if free.any():
                benefit = np.hstack([np.frombuffer(t).reshape(len(ids), -1) for t in tiles])[free]
                out += [(pair, j, i, price) for j, (i, price) in _bids(benefit, ids[free], np.asarray(prices), np.asarray(owner), n, eps).items()]
        yield pd.DataFrame(out, columns=["pair", "j", "i", "bid"])


def _settle(n, prices, owner, eps, least):
    """(prices, owner, eps, done) after a round's bids: the padding rows' bids, or the next epsilon."""
    if (owner >= 0).sum() < n:
        return prices, owner, eps, False
    if _violated(prices, owner, n, eps):
        level = _level(prices, n, eps)
        owner = np.where(prices < level, -1, owner)
        return np.maximum(prices, level), owner, eps, False
    if eps <= least or not n:
        return prices, owner, eps, True
    return prices, np.full_like(owner, -1), max(least, eps / STEP), False


def _update(least):
    def run(batches):
        for pdf in batches:
            out = []
            for pair, n, prices, owner, eps, won in zip(pdf["pair"], pdf["n"], pdf["prices"], pdf["owner"], pdf["eps"], pdf["won"]):
                prices, owner = np.array(prices, float), np.array(owner, np.int32)
                for r in () if won is None else won:
                    prices[r["j"]], owner[r["j"]] = r["bid"], r["i"]
                out.append((pair, n, *_settle(n, prices, owner, eps, least)))
            yield pd.DataFrame(out, columns=["pair", "n", "prices", "owner", "eps", "done"])
    return run


def auction(blocks: DataFrame, sizes: DataFrame, least=LEAST) -> DataFrame:
    """(pair, i, j): the assignment of all rows of every matrix.

    `blocks` (pair, block, ids, tiles): the rows' numbers and their benefits, float64 by columns; `sizes`
    (pair, n, m) with n <= m rows and columns. Blocks are written by buckets of (pair, block), so that
    no round shuffles them: prices go to the blocks.
    """
    kind = dict(sizes.dtypes)["pair"]
    blocks, name = written(blocks, "blocks", by=["pair", "block"])
    places = written(blocks.select("pair", "block"), "places")
    start = sizes.select("pair", F.col("n").cast("int").alias("n"), F.array_repeat(F.lit(0.0), F.col("m").cast("int")).alias("prices"), F.array_repeat(F.lit(-1), F.col("m").cast("int")).alias("owner"),
                         F.lit(EPSILON).alias("eps"), ((F.col("n") == 0) | (F.col("m") == 0)).alias("done"))
    state, finished = written(start, "prices"), []
    while True:
        finished.append(state.where("done"))
        state = state.where("NOT done")
        if state.isEmpty():
            break
        asked = places.join(state, "pair").select("pair", "block", "n", "prices", "owner", "eps")
        bids = blocks.join(asked, ["pair", "block"]).select("pair", "n", "ids", "tiles", "prices", "owner", "eps").mapInPandas(_bid, f"pair {kind}, j int, i int, bid double")
        best = bids.groupBy("pair", "j").agg(F.max(F.struct("bid", "i")).alias("b")).groupBy("pair").agg(F.collect_list(F.struct("j", "b.i", "b.bid")).alias("won"))
        state = written(state.join(best, "pair", "left").select("pair", "n", "prices", "owner", "eps", "won").mapInPandas(_update(least), f"pair {kind}, n int, prices array<double>, owner array<int>, eps double, done boolean"), "prices")
    every = finished[0]
    for more in finished[1:]:
        every = every.unionAll(more)
    out = written(every.select("pair", F.posexplode("owner").alias("j", "i")).where("i >= 0").select("pair", "i", "j"), "assigned")
    dropped(blocks.sparkSession, name)
    return out


def _numbered(vectors: DataFrame) -> DataFrame:
    """Adds `at`, the place of a node in its side of its pair, by node id."""
    from .numbering import numbered

    return numbered(vectors, "at", ["pair"], ["node_id"])


def _sizes(ha, hb, pairs):
    """(pair, na, nb, swapped) of every pair."""
    pair = pairs.select("sample_a", "sample_b").distinct().withColumn("pair", F.struct("sample_a", "sample_b"))
    count_a = ha.groupBy(F.col("sample_id").alias("sample_a")).agg(F.count("*").alias("na"))
    count_b = hb.groupBy(F.col("sample_id").alias("sample_b")).agg(F.count("*").alias("nb"))
    sizes = pair.join(count_a, "sample_a", "left").join(count_b, "sample_b", "left").na.fill(0, ["na", "nb"])
    return written(sizes.withColumn("swapped", F.col("na") > F.col("nb")), "sizes")


def _sides(ha, hb, sizes):
    """Nodes (pair, swapped, node_id, vec) of the shorter and the longer side of every pair, and (pair, n, m, swapped)."""
    def side(own_a, own_b):
        a = sizes.where(own_a).select("pair", F.col("sample_a").alias("sample_id")).join(ha.select("sample_id", "node_id", "vec"), "sample_id")
        b = sizes.where(own_b).select("pair", F.col("sample_b").alias("sample_id")).join(hb.select("sample_id", "node_id", "vec"), "sample_id")
        return a.select("pair", "node_id", "vec").unionAll(b.select("pair", "node_id", "vec"))

    return side(~F.col("swapped"), F.col("swapped")), side(F.col("swapped"), ~F.col("swapped")), sizes.select("pair", F.least("na", "nb").alias("n"), F.greatest("na", "nb").alias("m"), "swapped")


def _unit(vectors):
    v = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)


def _tiles(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(pair, block, ids, tiles): cosines of the nodes of both sides, block of rows by block of columns."""
    def packed(df, size, name):
        at = df.withColumn(name, F.floor(F.col("at") / size).cast("int")).groupBy("pair", name).agg(F.sort_array(F.collect_list(F.struct("at", "vec"))).alias("g"))
        return at.select("pair", name, F.col("g.at").alias(f"{name}_ids"), F.col("g.vec").alias(f"{name}_vecs"))

    def multiply(batches):
        for pdf in batches:
            tiles = [(_unit(a) @ _unit(b).T).tobytes() for a, b in zip(pdf["block_vecs"], pdf["col_vecs"])]
            yield pdf[["pair", "block", "col"]].assign(ids=pdf["block_ids"], tile=tiles)

    kind = dict(rows.dtypes)["pair"]
    both = packed(rows, ROWS, "block").join(packed(columns, COLUMNS, "col").drop("col_ids"), "pair")
    made = both.mapInPandas(multiply, f"pair {kind}, block int, col int, ids array<int>, tile binary")
    return made.groupBy("pair", "block").agg(F.first("ids").alias("ids"), F.transform(F.sort_array(F.collect_list(F.struct("col", "tile"))), lambda t: t["tile"]).alias("tiles"))


def _solved(benefit, least):
    """The owner of each column of a matrix that is one block, by the same bids."""
    n, m = benefit.shape
    ids, prices, owner, eps, done = np.arange(n), np.zeros(m), np.full(m, -1), EPSILON, not n or not m
    while not done:
        free = ~np.isin(ids, owner)
        if free.any():
            for j, (i, price) in _bids(benefit[free], ids[free], prices, owner, n, eps).items():
                prices[j], owner[j] = price, i
        prices, owner, eps, done = _settle(n, prices, owner, eps, least)
    return owner


PAIRS = 100  # pairs of maps that a task hands on at once


def _small_pairs(ha, hb, sizes, least):
    """(sample_a, sample_b, i, j, sim) of pairs that are one tile: both maps' vectors meet as one flat array each."""
    def packed(h, sample, ids, flat):
        own = sizes.select(F.col(f"pair.{sample}").alias("sample_id")).distinct()
        g = h.join(own, "sample_id", "left_semi").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("node_id", F.col("vec").cast("array<double>").alias("vec")))).alias("g"))
        return g.select(F.col("sample_id").alias(sample), F.col("g.node_id").alias(ids), F.flatten("g.vec").alias(flat))

    def solve(batches):
        for pdf in batches:
            for at in range(0, len(pdf), PAIRS):
                out = []
                for row in pdf.iloc[at:at + PAIRS].itertuples(index=False):
                    sims = _unit(row.va.reshape(len(row.ia), -1)) @ _unit(row.vb.reshape(len(row.ib), -1)).T
                    owner = _solved(sims if len(row.ia) <= len(row.ib) else sims.T, least)
                    j, i = np.flatnonzero(owner >= 0), owner[owner >= 0]
                    i, j = (i, j) if len(row.ia) <= len(row.ib) else (j, i)
                    out.append(pd.DataFrame({"sample_a": row.sample_a, "sample_b": row.sample_b, "i": row.ia[i], "j": row.ib[j], "sim": sims[i, j]}))
                yield pd.concat(out, ignore_index=True)

    a, b = dict(ha.dtypes), dict(hb.dtypes)
    both = sizes.select("pair.sample_a", "pair.sample_b").join(packed(ha, "sample_a", "ia", "va"), "sample_a").join(packed(hb, "sample_b", "ib", "vb"), "sample_b")
    return both.mapInPandas(solve, f"sample_a {a['sample_id']}, sample_b {b['sample_id']}, i {a['node_id']}, j {b['node_id']}, sim double")


def node_assignment(ha: DataFrame, hb: DataFrame, pairs: DataFrame, least=LEAST):
    """(scores, pairs) of the nodes (sample_id, node_id, vec) of the two samples of each row (sample_a, sample_b) of `pairs`.

    scores (sample_a, sample_b, score, coverage, n): score is 1 - the mean cost 1 - cos, coverage the shorter count
    over the longer; 0 where a side has no node. pairs (sample_a, sample_b, i, j, sim). Rows of `pairs` may repeat; a null sample has no nodes.
    """
    sizes = _sizes(ha, hb, pairs)
    tile = (F.least("na", "nb") <= ROWS) & (F.greatest("na", "nb") <= COLUMNS)
    met = _small_pairs(ha, hb, sizes.where(tile), least)
    if not sizes.where(~tile).isEmpty():
        met = met.unionAll(_large_pairs(ha, hb, sizes.where(~tile), least))
    met = written(met, "matched")
    sums = met.groupBy(F.struct("sample_a", "sample_b").alias("pair")).agg(F.avg("sim").alias("mean"))
    ratio = F.when(F.col("m") > 0, F.col("n") / F.col("m")).otherwise(0.0)
    sizes = sizes.select("pair", F.least("na", "nb").alias("n"), F.greatest("na", "nb").alias("m"))
    scores = sizes.join(sums, "pair", "left").select("pair.sample_a", "pair.sample_b", F.coalesce("mean", F.lit(0.0)).alias("score"), ratio.alias("coverage"), "n")
    return scores, met


def _large_pairs(ha, hb, sizes, least):
    """(sample_a, sample_b, i, j, sim) of pairs of more than one tile, in rounds."""
    rows, columns, sizes = _sides(ha, hb, sizes)
    rows, columns = _numbered(rows), _numbered(columns)
    rows, columns = (written(df.withColumn("at", F.col("at").cast("int")), "side") for df in (rows, columns))
    found = auction(_tiles(rows, columns), sizes.select("pair", "n", "m"), least)
    r = rows.select("pair", F.col("at").alias("i"), F.col("node_id").alias("row"), F.col("vec").alias("u"))
    c = columns.select("pair", F.col("at").alias("j"), F.col("node_id").alias("column"), F.col("vec").alias("v"))
    met = found.join(r, ["pair", "i"]).join(c, ["pair", "j"]).join(sizes.select("pair", "swapped"), "pair")
    sim = _cosine(F.col("u"), F.col("v"))
    return met.select("pair.sample_a", "pair.sample_b", F.when(F.col("swapped"), F.col("column")).otherwise(F.col("row")).alias("i"), F.when(F.col("swapped"), F.col("row")).otherwise(F.col("column")).alias("j"), sim.alias("sim"))


def _cosine(u, v):
    from ..functions.scalars import dot, norm

    return dot(u, v) / ((norm(u) + 1e-8) * (norm(v) + 1e-8))


def sample_assignment(sims: DataFrame, keys=("group_a", "group_b"), least=LEAST) -> DataFrame:
    """(a, b, sim, keys): optimal pairs on 1 - sim for every group pair; a pair that is not in `sims` counts as sim 0."""
    key = F.struct(*keys)
    long = written(sims.select(key.alias("pair"), "a", "b", F.col("sim").cast("double").alias("sim")), "sims")
    count = long.groupBy("pair").agg(F.array_sort(F.collect_set("a")).alias("as"), F.array_sort(F.collect_set("b")).alias("bs"))
    count = written(count.withColumn("swapped", F.size("as") > F.size("bs")), "sides")
    sides = count.select("pair", "swapped", F.when(F.col("swapped"), F.col("bs")).otherwise(F.col("as")).alias("rows"), F.when(F.col("swapped"), F.col("as")).otherwise(F.col("bs")).alias("columns"))
    turned = long.join(count.select("pair", "swapped"), "pair").select("pair", F.when(F.col("swapped"), F.col("b")).otherwise(F.col("a")).alias("r"), F.when(F.col("swapped"), F.col("a")).otherwise(F.col("b")).alias("c"), "sim")
    lines = turned.groupBy("pair", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "sim"))).alias("v")).join(sides, "pair")
    lines = lines.select("pair", (F.array_position("rows", F.col("r")) - 1).cast("int").alias("at"), F.transform("columns", lambda c: F.coalesce(F.try_element_at("v", c), F.lit(0.0))).alias("vec"))
    blocks = lines.groupBy("pair", F.floor(F.col("at") / ROWS).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "vec"))).alias("g"))

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: np.array(r.tolist(), float).tobytes())

    blocks = blocks.select("pair", "block", F.col("g.at").alias("ids"), F.array(packed("g.vec")).alias("tiles"))
    found = auction(blocks, sides.select("pair", F.size("rows").alias("n"), F.size("columns").alias("m")), least)
    met = found.join(sides, "pair").select("pair", F.col("rows")[F.col("i")].alias("r"), F.col("columns")[F.col("j")].alias("c"), "swapped")
    met = met.select("pair", F.when(F.col("swapped"), F.col("c")).otherwise(F.col("r")).alias("a"), F.when(F.col("swapped"), F.col("r")).otherwise(F.col("c")).alias("b"))
    got = met.join(long, ["pair", "a", "b"], "left")
    return got.select("a", "b", F.coalesce("sim", F.lit(0.0)).alias("sim"), *[F.col("pair")[k].alias(k) for k in keys])
