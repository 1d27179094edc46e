"""Vector comparison and pooling."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot, norm
from ..store import written

BLOCK = 512  # vectors of one side that are multiplied at once


def mean_pool(embeds: DataFrame) -> DataFrame:
    """One mean vector per sample."""
    sums = embeds.select("sample_id", F.posexplode("vec").alias("p", "v")).groupBy("sample_id", "p").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return sums.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda s: s["v"]).alias("vec"))


def _similarity(d, na, nb, rescale, eps):
    return (d / (na * nb + 1e-9) + 1) / 2 if rescale else d / ((na + eps) * (nb + eps))


def cosine_pairs(a: DataFrame, b: DataFrame, rescale=False, eps=1e-8, pairs: DataFrame | None = None, block=BLOCK) -> DataFrame:
    """(a, b, sim) of the vectors of two groups (sample_id, vec): of the rows (a, b) of `pairs` if given, else of all pairs.

    For all pairs both sides are written once and dealt by hash into blocks of about `block`
    vectors; two blocks meet by their numbers and are multiplied as matrices. A null vector has
    a null sim; vectors of one block must be equally long; extra columns are left out.
    """
    x = a.select(F.col("sample_id").alias("a"), F.col("vec").cast("array<double>").alias("va"))
    y = b.select(F.col("sample_id").alias("b"), F.col("vec").cast("array<double>").alias("vb"))
    if pairs is not None:
        met = pairs.select("a", "b").join(x, "a").join(y, "b")
        return met.select("a", "b", _similarity(dot(F.col("va"), F.col("vb")), norm(F.col("va")), norm(F.col("vb")), rescale, eps).alias("sim"))
    x, y = written(x, "left"), written(y, "right")
    nx, ny = (max(1, -(-side.count() // block)) for side in (x, y))
    x = x.select("a", "va", F.pmod(F.xxhash64("a"), F.lit(nx)).alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ny - 1).cast("long"))).alias("q"))
    y = y.select("b", "vb", F.pmod(F.xxhash64("b"), F.lit(ny)).alias("q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx - 1).cast("long"))).alias("p"))

    def rows(vectors):
        width = max((len(v) for v in vectors if v is not None), default=0)
        return np.array([np.full(width, np.nan) if v is None else v for v in vectors], float).reshape(len(vectors), width)

    def multiply(left, right):
        va, vb = rows(left["va"]), rows(right["vb"])
        some = va.shape[1] and vb.shape[1]  # else one side is empty or all null
        d = va @ vb.T if some else np.full((len(va), len(vb)), np.nan)
        sim = _similarity(d, np.linalg.norm(va, axis=1)[:, None], np.linalg.norm(vb, axis=1)[None, :], rescale, eps)
        none = np.logical_or.outer(left["va"].isna().to_numpy(bool), right["vb"].isna().to_numpy(bool))
        return pd.DataFrame({"a": left["a"].repeat(len(right)).to_numpy(), "b": np.tile(right["b"].to_numpy(), len(left)), "sim": pd.arrays.FloatingArray(sim.ravel(), none.ravel())})

    kinds = dict(x.dtypes) | dict(y.dtypes)
    return x.groupBy("p", "q").cogroup(y.groupBy("p", "q")).applyInPandas(multiply, f"a {kinds['a']}, b {kinds['b']}, sim double")


def pair_lookup(pairs: DataFrame, embeds: DataFrame) -> DataFrame:
    """Adds ga, gb; a missing sample leaves a null to be reported."""
    a = embeds.select(F.col("sample_id").alias("sample_a"), F.col("vec").alias("ga"))
    b = embeds.select(F.col("sample_id").alias("sample_b"), F.col("vec").alias("gb"))
    return pairs.join(a, "sample_a", "left").join(b, "sample_b", "left")


def dedupe_records(records: DataFrame) -> DataFrame:
    """The last record of each sample, by path."""
    last = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("path")))
    return records.withColumn("_r", last).where("_r = 1").drop("_r")
