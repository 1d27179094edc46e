"""Augmentation by given parameters, matrices, reports, records and calibrators."""
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotate(nodes: DataFrame, theta: Column) -> DataFrame:
    c, s, x, y = F.cos(theta), F.sin(theta), F.col("x"), F.col("y")
    return nodes.withColumns({"x": x * c - y * s, "y": x * s + y * c})


def anisotropic_scale(nodes: DataFrame, sx: Column = None, sy: Column = None, range_scale=(0.8, 1.2), seed=42) -> DataFrame:
    """Coordinates times the factors of their sample; without factors, hashed uniforms that no partitioning changes."""
    def drawn(axis):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), "sample_id"), F.lit(1 << 30)) / float(1 << 30)
        return range_scale[0] + u * (range_scale[1] - range_scale[0])

    return nodes.withColumns({"x": F.col("x") * (drawn("x") if sx is None else sx), "y": F.col("y") * (drawn("y") if sy is None else sy)})


def similarity_matrix(sims: DataFrame, values=None) -> DataFrame:
    """Wide matrix of (a, b, sim); give the column `values` for many columns, or stay with the long table."""
    return sims.groupBy("a").pivot("b", values).agg(F.first("sim"))


def topk_mismatches(coupling: DataFrame, names_a: DataFrame, names_b: DataFrame, topk=20) -> DataFrame:
    """(side, index, name, best_coupling): per side the topk nodes whose best coupling (i, j, w) is least."""
    def side(label, col, names):
        best = coupling.groupBy(F.col(col).alias("index")).agg(F.max("w").alias("best_coupling")).orderBy("best_coupling", "index").limit(topk)
        name = F.coalesce("name", F.concat(F.lit(label), F.col("index").cast("string")))
        return best.join(names.select(F.col("node_id").alias("index"), "name"), "index", "left").select(F.lit(label).alias("side"), "index", name.alias("name"), "best_coupling")

    return reduce(DataFrame.unionByName, [side("a", "i", names_a), side("b", "j", names_b)])


def records(nodes: DataFrame, sectors=8, use_relations=True) -> DataFrame:
    """One record per sample: parallel arrays in node order."""
    cols = ["name", "type", "x", "y", "dir"]
    rows = nodes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("node_id", *cols))).alias("r"))
    arrays = F.struct(*[F.col(f"r.{c}").alias(c) for c in cols])
    return rows.select("sample_id", arrays.alias("nodes"), F.lit(sectors).alias("sectors"), F.lit(use_relations).alias("use_relations"))


def write_records(nodes: DataFrame, path: str, sectors=8, use_relations=True):
    """Record files of samples, below a folder for each group if nodes have a group_id."""
    cols = ["Name", "Type", "x", "y", "dir"]
    groups = ["group_id"] if "group_id" in nodes.columns else []
    got = records(nodes, sectors, use_relations)
    if groups:
        got = got.join(nodes.select("sample_id", "group_id").distinct(), "sample_id")
    inner = F.struct(*[F.col(f"nodes.{c.lower()}").alias(c) for c in cols])
    got = got.select(F.col("sample_id").cast("string").alias("sample_dir"), inner.alias("nodes"), "sectors", "use_relations", *groups)
    (got.write.partitionBy(*groups) if groups else got.write).json(path, ignoreNullFields=False)


def write_reports(df: DataFrame, path: str, format="json"):
    """A report table as json, csv (with header) or parquet."""
    if format not in ("json", "csv", "parquet"):
        raise ValueError(f"unknown report format: {format}")
    df.write.format(format).options(**({"header": True} if format == "csv" else {"ignoreNullFields": False} if format == "json" else {})).save(path)


def group_fidelity(pairs: DataFrame) -> DataFrame:
    """(group_a, group_b, fidelity): mean similarity of the matched pairs of two groups."""
    return pairs.groupBy("group_a", "group_b").agg(F.avg("sim").alias("fidelity"))


def _target(scored):
    return VectorAssembler(inputCols=["logit"], outputCol="features").transform(scored.select("logit", "label"))


def fit_platt(scored: DataFrame) -> DataFrame:
    """(coef, intercept) of the logistic fit of label > 0.5 on the logit, L2 penalty of weight one in all."""
    rows = _target(scored).withColumn("y", (F.col("label") > 0.5).cast("double"))
    model = LogisticRegression(labelCol="y", regParam=1.0 / max(1, rows.count()), standardization=False, tol=1e-10, maxIter=200).fit(rows)
    return scored.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "coef double, intercept double")


def fit_isotonic(scored: DataFrame) -> DataFrame:
    """(x, y): thresholds of the isotonic fit of label on logit; outside them the end values hold."""
    model = IsotonicRegression(labelCol="label").fit(_target(scored))
    return scored.sparkSession.createDataFrame(list(zip(map(float, model.boundaries), map(float, model.predictions))), "x double, y double")
