"""Samples against one real map."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching
from ..operators import relations as R


def accuracy(nodes: DataFrame, real: DataFrame, vectors: DataFrame, real_vectors: DataFrame, **weights) -> DataFrame:
    """(sample_a, type, topo, struct, coverage, fidelity) of every sample: name matches for type and topology, the
    assignment of the node vectors (sample_id, node_id, vec) for struct; `weights` as in `fidelity`. Without a match or a node a score is 0."""
    pairs = vectors.select(F.col("sample_id").alias("sample_a")).distinct().join(F.broadcast(real_vectors.select(F.col("sample_id").alias("sample_b")).limit(1)))
    struct = matching.node_assignment(vectors, real_vectors, pairs)[0].select("sample_a", F.col("score").alias("struct"), "coverage")
    got = R.match_scores(nodes, real, R.match_by_name(nodes, real)).join(struct, "sample_a", "left").na.fill(0.0, ["struct", "coverage"])
    return R.fidelity(got, **weights)
