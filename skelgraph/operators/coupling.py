"""Couplings of the nodes of two graphs by features and structure: entropic fused Gromov-Wasserstein.

The coupling T of a pair minimises (1 - alpha) * sum(T * C) + alpha * sum((DA[i,k] - DB[j,l])^2 * T[i,j] * T[k,l]) less an
entropy, with equal weights of the nodes of either side. Each round linearises the second term at the last coupling and
scales the matrix of the first order to both marginals. All pairs go through the rounds at once; a matrix is a table of cells
(pair, i, j) that aggregates by row and by column combine before they shuffle, so no task holds one.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, norm
from ..store import written

TILE = 128  # rows and columns of the tiles that are multiplied
START, STEP = 0.1, 4  # the entropy's weight in the first round, and what divides it from round to round


def _tiles(cells: DataFrame, r: str, c: str) -> DataFrame:
    """(pair, r, c, rows, cols, vals): the cells (pair, i, j, v), dealt by hash into tiles."""
    at = cells.select("pair", F.pmod(F.xxhash64("i"), F.col("_ni")).alias(r), F.pmod(F.xxhash64("j"), F.col("_nj")).alias(c), F.struct("i", "j", "v").alias("x"))
    at = at.groupBy("pair", r, c).agg(F.collect_list("x").alias("x"))
    return at.select("pair", r, c, F.col("x.i").alias(f"{r}{c}_i"), F.col("x.j").alias(f"{r}{c}_j"), F.col("x.v").alias(f"{r}{c}_v"))


def _multiply(batches):
    for pdf in batches:
        out = []
        for pair, i, k, v, k2, j, w in zip(pdf["pair"], pdf["rk_i"], pdf["rk_j"], pdf["rk_v"], pdf["kc_i"], pdf["kc_j"], pdf["kc_v"]):
            rows, ri = np.unique(i, return_inverse=True)
            cols, cj = np.unique(j, return_inverse=True)
            inner, at = np.unique(np.concatenate([k, k2]), return_inverse=True)
            left, right = np.zeros((len(rows), len(inner))), np.zeros((len(inner), len(cols)))
            left[ri, at[:len(k)]] = v
            right[at[len(k):], cj] = w
            out.append(pd.DataFrame({"i": np.repeat(rows, len(cols)), "j": np.tile(cols, len(rows)), "v": (left @ right).ravel()}).assign(pair=[pair] * (len(rows) * len(cols))))
        if out:
            yield pd.concat(out)[["pair", "i", "j", "v"]]


def product(left: DataFrame, right: DataFrame, sizes: DataFrame, dims) -> DataFrame:
    """(pair, i, j, v): the product of two matrices (pair, i, j, v) of every pair; `dims` are the columns of `sizes` with the counts of rows, inner places and columns.

    Tiles of about TILE x TILE cells meet by their inner number; partial products are summed by cell.
    """
    parts = [F.ceil(F.col(n) / TILE) for n in dims]
    size = sizes.select("pair", *[F.greatest(p, F.lit(1)).cast("long").alias(f"_p{k}") for k, p in enumerate(parts)])
    a = left.join(size.withColumnsRenamed({"_p0": "_ni", "_p1": "_nj"}), "pair")
    b = right.join(size.withColumnsRenamed({"_p1": "_ni", "_p2": "_nj"}), "pair")
    both = _tiles(a, "r", "k").join(_tiles(b, "k", "c"), ["pair", "k"])
    kinds = {f.name: f.dataType.simpleString() for f in left.schema} | {"j": right.schema["j"].dataType.simpleString()}
    made = both.mapInPandas(_multiply, f"pair {kinds['pair']}, i {kinds['i']}, j {kinds['j']}, v double")
    return made.groupBy("pair", "i", "j").agg(F.sum("v").alias("v"))


def _scaled(cells, eps, steps):
    """(cells with `f` and `g`, so that exp((f + g - cost) / eps) has nearly the marginals 1/n and 1/m): `steps` scalings of rows and columns.

    The first scaling of either side takes the greatest exponent out, by which every row and column keeps a sum above 0; later
    ones multiply by factors of at least 1/n or 1/m and cannot lose that again, so they need no further care.
    """
    def dual(rows, key, other, mass):
        gap = F.col("cost") - F.col(other)
        least = rows.groupBy("pair", key).agg(F.min(gap).alias("least"))
        rest = rows.join(least, ["pair", key])
        total = F.sum(F.exp((F.col("least") - gap) / eps))
        return written(rest.groupBy("pair", key, "least").agg((F.first("least") + eps * (F.log(F.first(mass)) - F.log(total))).alias("dual")).select("pair", key, "dual"), "dual")

    f = dual(cells, "i", "g", "p").withColumnRenamed("dual", "f")
    rows = cells.drop("f").join(f, ["pair", "i"])
    g = dual(rows, "j", "f", "q").withColumnRenamed("dual", "g")
    kernel = written(rows.drop("g").join(g, ["pair", "j"]).withColumn("k", F.exp((F.col("f") + F.col("g") - F.col("cost")) / eps)), "kernel")
    v = kernel.groupBy("pair", "j").agg(F.lit(1.0).alias("v"))
    for step in range(steps):
        u = kernel.join(v, ["pair", "j"]).groupBy("pair", "i").agg((F.first("p") / F.sum(F.col("k") * F.col("v"))).alias("u"))
        if step == steps - 1:
            u = written(u, "rows")
        v = kernel.join(u, ["pair", "i"]).groupBy("pair", "j").agg((F.first("q") / F.sum(F.col("k") * F.col("u"))).alias("v"))
    done = kernel.join(u, ["pair", "i"]).join(v, ["pair", "j"])
    return done.withColumns({"t": F.col("k") * F.col("u") * F.col("v"), "f": F.col("f") + eps * F.log("u"), "g": F.col("g") + eps * F.log("v")}).drop("k", "u", "v")


def _rounded(cells):
    """`t` with exact marginals: rows, then columns above their weight are scaled down, and what lacks is spread in proportion."""
    rows = cells.groupBy("pair", "i").agg(F.least(F.lit(1.0), F.first("p") / F.sum("t")).alias("x"))
    cells = written(cells.join(rows, ["pair", "i"]).withColumn("t", F.col("t") * F.col("x")).drop("x"), "by_rows")
    columns = cells.groupBy("pair", "j").agg(F.least(F.lit(1.0), F.first("q") / F.sum("t")).alias("y"))
    cells = written(cells.join(columns, ["pair", "j"]).withColumn("t", F.col("t") * F.col("y")).drop("y"), "by_columns")
    lack_i = cells.groupBy("pair", "i").agg(F.greatest(F.first("p") - F.sum("t"), F.lit(0.0)).alias("x"))
    lack_j = cells.groupBy("pair", "j").agg(F.greatest(F.first("q") - F.sum("t"), F.lit(0.0)).alias("y"))
    total = lack_i.groupBy("pair").agg(F.sum("x").alias("all"))
    got = cells.join(lack_i, ["pair", "i"]).join(lack_j, ["pair", "j"]).join(total, "pair")
    return got.withColumn("t", F.col("t") + F.when(F.col("all") > 0, F.col("x") * F.col("y") / F.col("all")).otherwise(0.0)).drop("x", "y", "all")


def fgw_similarity(ha: DataFrame, hb: DataFrame, costs_a: DataFrame, costs_b: DataFrame, pairs: DataFrame, alpha=0.8, reg=1e-3, rounds=6, steps=6):
    """(scores, coupling) of the graphs of each row (sample_a, sample_b) of `pairs`, from nodes (sample_id, node_id, vec) and costs (sample_id, i, j, cost).

    coupling (sample_a, sample_b, i, j, w): all pairs of nodes; w sums to 1 / n over each i's row and 1 / m over each j's column.
    scores (sample_a, sample_b, score): 1 - sum(w * C) / (max(C) + 1e-9) within 0 and 1, C = 1 - (cos + 1) / 2. The entropy's weight goes from
    START down to `reg`. Pairs of which a side has no node, or a null sample, have no row; repeated rows of `pairs` count once; costs that are not given are 0; a null vec has cosine 0.
    """
    pair = pairs.select("sample_a", "sample_b").distinct().select(F.struct("sample_a", "sample_b").alias("pair"))
    a = pair.join(ha.select("sample_id", F.col("node_id").alias("i"), F.col("vec").alias("x")), F.col("pair.sample_a") == F.col("sample_id")).drop("sample_id")
    b = pair.join(hb.select("sample_id", F.col("node_id").alias("j"), F.col("vec").alias("y")), F.col("pair.sample_b") == F.col("sample_id")).drop("sample_id")
    sizes = written(a.groupBy("pair").agg(F.count("*").alias("n")).join(b.groupBy("pair").agg(F.count("*").alias("m")), "pair"), "sizes")

    def structure(costs, side, nodes):
        kind = nodes.schema["node_id"].dataType  # tiles are dealt by hashes, which depend on the type
        met = pair.join(costs, F.col(f"pair.{side}") == F.col("sample_id"))
        return written(met.select("pair", F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), F.col("cost").alias("v")), "structure")

    da, db = structure(costs_a, "sample_a", ha), structure(costs_b, "sample_b", hb)
    square = F.sum(F.col("v") * F.col("v"))
    sa, sb = da.groupBy("pair", "i").agg(square.alias("sa")), db.groupBy("pair", F.col("i").alias("j")).agg(square.alias("sb"))
    cos = dot(F.col("x"), F.col("y")) / ((norm(F.col("x")) + 1e-8) * (norm(F.col("y")) + 1e-8))
    both = a.join(b, "pair").join(sizes, "pair").join(sa, ["pair", "i"], "left").join(sb, ["pair", "j"], "left")
    zero = F.lit(0.0)
    both = both.select("pair", "i", "j", (1 - (F.coalesce(cos, zero) + 1) / 2).alias("c"), (1 / F.col("n")).alias("p"), (1 / F.col("m")).alias("q"), (F.coalesce("sa", zero) / F.col("n") + F.coalesce("sb", zero) / F.col("m")).alias("s"))
    fixed = written(both.withColumn("fixed", (1 - alpha) * F.col("c") + 2 * alpha * F.col("s")).drop("s"), "cells")
    cells = fixed.withColumns({"t": F.col("p") * F.col("q"), "f": zero, "g": zero})
    eps = START
    for k in range(rounds):
        eps = max(reg, START / STEP ** k)
        across = written(product(da, cells.select("pair", "i", "j", F.col("t").alias("v")), sizes, ("n", "n", "m")), "across")
        bent = product(across, db, sizes, ("n", "m", "m")).withColumnRenamed("v", "bent")
        cost = F.col("fixed") - 4 * alpha * F.coalesce("bent", zero)
        cells = _scaled(written(cells.drop("t", "cost").join(bent, ["pair", "i", "j"], "left").withColumn("cost", cost).drop("bent"), "first_order"), eps, steps)
        cells = written(cells.drop("cost"), "coupling")
    cells = written(_rounded(cells), "coupling")
    scores = cells.groupBy("pair").agg((1 - F.sum(F.col("t") * F.col("c")) / (F.max("c") + 1e-9)).alias("s"))
    scores = scores.select("pair.sample_a", "pair.sample_b", F.least(F.greatest("s", zero), F.lit(1.0)).alias("score"))
    return scores, cells.select("pair.sample_a", "pair.sample_b", "i", "j", F.col("t").alias("w"))
