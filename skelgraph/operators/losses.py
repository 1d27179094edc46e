"""Loss metrics of given embeddings and scores, one row per batch or kind."""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, norm
from ..store import written

BLOCK = 1024  # rows of a batch that are multiplied at once


def _unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def _numbers(vectors):
    """The vectors of a block as a matrix, each of length one (a zero vector stays)."""
    m = np.array(vectors.tolist(), float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _products(z, left, right, fold, gives, block):
    """`fold` of every two blocks of a batch: rows (batch_id, i, ...) of the columns `left` against `right`.

    A batch is dealt by the hash of i into blocks of about `block` rows, so a hot batch is many groups. What a
    pair of blocks gives is one row for each row of the left block, never one for a pair of rows.
    """
    z = written(z.where("batch_id IS NOT NULL"), "batches")
    sizes = written(z.groupBy("batch_id").agg(F.ceil(F.count("*") / block).alias("blocks")), "sizes")
    z = z.join(sizes, "batch_id").withColumns({"own": F.pmod(F.xxhash64("i"), "blocks"), "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))})
    a = z.select("batch_id", F.col("own").alias("p"), F.col("other").alias("q"), "i", *left)
    b = z.select(*[F.col(c).alias(n) for c, n in [("batch_id", "batch"), ("other", "r"), ("own", "s"), ("i", "i"), *zip(right, right)]])
    kinds = dict(z.dtypes)
    schema = f"batch_id {kinds['batch_id']}, i {kinds['i']}, " + ", ".join(f"{c} double" for c in gives)

    def multiply(x, y):
        if not len(x) or not len(y):
            return pd.DataFrame({c: [] for c in ["batch_id", "i", *gives]})
        return pd.DataFrame({"batch_id": x["batch_id"], "i": x["i"], **fold(x, y)})

    return a.groupBy("batch_id", "p", "q").cogroup(b.groupBy("batch", "r", "s")).applyInPandas(multiply, schema)


def _equal(x, y):
    """Which values of two columns are the same; null is equal to none."""
    return np.equal.outer(x.to_numpy(object), y.to_numpy(object)).astype(bool) & np.logical_and.outer(x.notna().to_numpy(), y.notna().to_numpy())


def _parts():
    """The largest maximum of a row's blocks, and (maximum, sum) of each."""
    return F.max("m").alias("top"), F.collect_list(F.struct("m", "e")).alias("parts")


def _merged():
    """The sums of a row's blocks, each below a maximum of its own, brought below the largest one."""
    return F.aggregate("parts", F.lit(0.0), lambda sum, p: sum + p["e"] * F.exp(p["m"] - F.col("top")))


def nt_xent(z: DataFrame, temperature=0.2, block=BLOCK) -> DataFrame:
    """(batch_id, loss) of rows (batch_id, i, z1, z2): cross-entropy of each z1 to the z2 of its own row.

    i is unique in its batch. Rows with a null batch, i or vector are left out; extra columns are ignored; an
    empty table has no batch. Blocks of rows are multiplied as matrices, and their (maximum, sum) merged, so
    that sums stay finite at any temperature.
    """
    def fold(x, y):
        s = _numbers(x["z1"]) @ _numbers(y["z2"]).T / temperature
        m, same = s.max(axis=1), _equal(x["i"], y["i"])
        return {"m": m, "e": np.exp(s - m[:, None]).sum(axis=1), "own": np.where(same, s, 0).sum(axis=1)}

    some = z.where("i IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL").select("batch_id", "i", "z1", "z2")
    parts = _products(some, ["z1"], ["z2"], fold, ["m", "e", "own"], block)
    rows = parts.groupBy("batch_id", "i").agg(*_parts(), F.sum("own").alias("own"))
    return rows.groupBy("batch_id").agg(F.avg(F.log(_merged()) + F.col("top") - F.col("own")).alias("loss"))


def supcon(z: DataFrame, temperature=0.2, block=BLOCK) -> DataFrame:
    """(batch_id, loss) of rows (batch_id, i, z, label); anchors without positives count as 0.

    Rows, nulls and blocks as in `nt_xent`; a null label is like no other.
    """
    def fold(x, y):
        s = _numbers(x["z"]) @ _numbers(y["z"]).T / temperature
        m, off = s.max(axis=1), ~_equal(x["i"], y["i"])
        pos = off & _equal(x["label"], y["label"])
        return {"m": m, "e": np.where(off, np.exp(s - m[:, None]), 0).sum(axis=1), "sp": np.where(pos, s, 0).sum(axis=1), "np": pos.sum(axis=1).astype(float)}

    some = z.where("i IS NOT NULL AND z IS NOT NULL").select("batch_id", "i", "z", "label")
    parts = _products(some, ["z", "label"], ["z", "label"], fold, ["m", "e", "sp", "np"], block)
    rows = parts.groupBy("batch_id", "i").agg(*_parts(), F.sum("sp").alias("sp"), F.sum("np").alias("np"))
    mean = (F.col("sp") - F.col("np") * F.log(_merged() + 1e-9)) / (F.col("np") + 1e-9)
    return rows.groupBy("batch_id").agg((-F.avg(mean)).alias("loss"))


def pair_loss(scored: DataFrame, kind="bce", margin=0.2) -> DataFrame:
    """(kind, loss) of rows (logit, label), unweighted."""
    x, y = F.col("logit"), F.col("label")
    s = 1 / (1 + F.exp(-x))
    zero = F.lit(0.0)
    forms = {"bce": F.greatest(x, zero) - x * y + F.log1p(F.exp(-F.abs(x))), "mse": (s - y) * (s - y),
             "margin": F.when(y > 0.5, F.greatest(margin - s, zero)).otherwise(F.greatest(s - (1 - margin), zero))}
    if kind not in forms:
        raise ValueError(f"unknown pair loss: {kind}")
    return scored.agg(F.avg(forms[kind]).alias("loss")).select(F.lit(kind).alias("kind"), "loss")


def node_align_loss(ha: DataFrame, hb: DataFrame, pairs: DataFrame, reduction="mean") -> DataFrame:
    """(loss) of 1 - cosine over pairs (sample_a, i, sample_b, j); no pair gives 0."""
    a = ha.select(F.col("sample_id").alias("sample_a"), F.col("node_id").alias("i"), _unit(F.col("vec")).alias("u"))
    b = hb.select(F.col("sample_id").alias("sample_b"), F.col("node_id").alias("j"), _unit(F.col("vec")).alias("v"))
    gap = 1 - dot(F.col("u"), F.col("v"))
    both = pairs.join(a, ["sample_a", "i"]).join(b, ["sample_b", "j"])
    return both.agg(F.coalesce(F.avg(gap) if reduction == "mean" else F.sum(gap), F.lit(0.0)).alias("loss"))
