"""Named relations, name matching and fidelity scores."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import REL_TYPES
from ..functions.scalars import broad_class


def _key(col):
    return F.lower(F.trim(col))


def resolve_relations(relations: DataFrame, nodes: DataFrame):
    """(mapped, unresolved): names to the lowest node id, blanks and unknown types unresolved."""
    look = nodes.where(F.trim("name") != "").groupBy("sample_id", _key("name").alias("key")).agg(F.min("node_id").alias("id"))
    src = look.withColumnsRenamed({"key": "_s", "id": "src"})
    dst = look.withColumnsRenamed({"key": "_d", "id": "dst"})
    got = (relations.withColumns({"_s": _key("src_name"), "_d": _key("dst_name"), "_t": F.trim("rel_type")})
           .join(src, ["sample_id", "_s"], "left").join(dst, ["sample_id", "_d"], "left"))
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull() & F.coalesce(F.col("_t").isin(REL_TYPES), F.lit(False))
    return got.where(ok).select("sample_id", "src", "dst", F.col("_t").alias("rel_type")), got.where(~ok).select(*relations.columns)


def relation_degree(mapped: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per node the share of each relation type at either end (a self-relation counts twice)."""
    ends = mapped.select("sample_id", F.col("src").alias("node_id"), "rel_type").unionAll(mapped.select("sample_id", F.col("dst").alias("node_id"), "rel_type"))
    n = ends.groupBy("sample_id", "node_id").agg(*[F.count(F.when(F.col("rel_type") == r, 1)).cast("double").alias(r) for r in REL_TYPES])
    total = sum((F.col(r) for r in REL_TYPES[1:]), F.col(REL_TYPES[0])) + 1e-6
    n = n.select("sample_id", "node_id", F.array(*[F.col(r) / total for r in REL_TYPES]).alias("rel_deg"))
    every = nodes.select("sample_id", "node_id").join(n, ["sample_id", "node_id"], "left")
    return every.withColumn("rel_deg", F.coalesce("rel_deg", F.array_repeat(F.lit(0.0), len(REL_TYPES))))


def match_by_name(nodes_a: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """(sample_a, i, j): each named node of A with the last node of B of that name."""
    b = nodes_b.where(F.trim("name") != "").groupBy(_key("name").alias("key")).agg(F.max("node_id").alias("j"))
    a = nodes_a.where(F.trim("name") != "").select(F.col("sample_id").alias("sample_a"), F.col("node_id").alias("i"), _key("name").alias("key"))
    return a.join(b, "key").select("sample_a", "i", "j")


def _typed(nodes_a, nodes_b, matches):
    a = nodes_a.select(F.col("sample_id").alias("sample_a"), F.col("node_id").alias("i"), F.col("type").alias("ta"))
    b = nodes_b.select(F.col("node_id").alias("j"), F.col("type").alias("tb"))
    return matches.join(a, ["sample_a", "i"]).join(b, "j")


def match_scores(nodes_a: DataFrame, nodes_b: DataFrame, matches: DataFrame) -> DataFrame:
    """Per sample: type consistency and topology fidelity; 0 without a match."""
    got = _typed(nodes_a, nodes_b, matches).groupBy("sample_a").agg(
        F.avg((F.col("ta") == F.col("tb")).cast("double")).alias("type"), F.avg((broad_class(F.col("ta")) == broad_class(F.col("tb"))).cast("double")).alias("topo"))
    every = nodes_a.select(F.col("sample_id").alias("sample_a")).distinct()
    return every.join(got, "sample_a", "left").na.fill(0.0, ["type", "topo"])


def per_class_scores(nodes_a: DataFrame, nodes_b: DataFrame, matches: DataFrame) -> DataFrame:
    """(sample_a, class, score): matched pairs within a class over the larger class count."""
    m = _typed(nodes_a, nodes_b, matches).where(broad_class(F.col("ta")) == broad_class(F.col("tb")))
    m = m.groupBy("sample_a", broad_class(F.col("ta")).alias("class")).agg(F.count("*").alias("m"))
    a = nodes_a.groupBy(F.col("sample_id").alias("sample_a"), broad_class(F.col("type")).alias("class")).agg(F.count("*").alias("a"))
    b = nodes_b.groupBy(broad_class(F.col("type")).alias("class")).agg(F.count("*").alias("b"))
    return m.join(a, ["sample_a", "class"]).join(F.broadcast(b), "class").select("sample_a", "class", (F.col("m") / F.greatest("a", "b")).alias("score"))


def fidelity(scores: DataFrame, struct=0.6, type=0.1, topo=0.2, shape=0.1) -> DataFrame:
    """Weighted score; shape fidelity equals topology fidelity."""
    return scores.withColumn("fidelity", struct * F.col("struct") + type * F.col("type") + topo * F.col("topo") + shape * F.col("topo"))
