"""The whole per-sample graph build."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import line_direction, representative_point
from ..functions.scalars import edge_type_onehot, type_onehot
from ..functions.shapes import shape_descriptors
from ..operators import relations as R
from ..operators import skeleton as S
from ..operators import topology as T
from ..store import written


def nodes_of(features: DataFrame) -> DataFrame:
    """Features with a point: node_id, x, y and dir added, from the geometry where the features do not bring them; empty geometry is dropped."""
    # numbered first: its ranges deal the features evenly over the tasks that compute the points
    at = S.assign_node_ids(features.where(F.size(F.flatten("geom.parts")) > 0)).withColumn("at", representative_point(F.col("geom")))
    found = {"x": F.col("at.x"), "y": F.col("at.y"), "dir": line_direction(F.col("geom"))}
    return at.withColumns({c: F.coalesce(c, v) if c in features.columns else v for c, v in found.items()}).drop("at")


def node_features(sig: DataFrame, nodes: DataFrame, rel_deg=None, w_rel=0.2, w_type=0.2, w_shape=0.3) -> DataFrame:
    """signature ++ relation degree (if given) ++ type one-hot ++ shape descriptors (of nodes with geometry), weighted."""
    shape = [shape_descriptors(F.col("type"), F.col("geom")).alias("shape")] if "geom" in nodes.columns else []
    got = sig.join(nodes.select("sample_id", "node_id", "type", *shape), ["sample_id", "node_id"])
    parts = [F.col("sig")]
    if rel_deg is not None:
        got = got.join(rel_deg, ["sample_id", "node_id"])
        parts.append(F.transform("rel_deg", lambda v: v * w_rel))
    parts.append(F.transform(type_onehot(F.col("type")), lambda v: v * w_type))
    if shape:
        parts.append(F.transform("shape", lambda v: v * w_shape))
    return got.select("sample_id", "node_id", F.concat(*parts).alias("x"))


def _with_vector(edges: DataFrame, slot, sectors) -> DataFrame:
    """Adds attr: [d, cos, sin], sector one-hot and tag one-hot times `slot`, all times w."""
    onehot = F.transform(edge_type_onehot(F.col("tag")), lambda v: v * slot)
    sec = F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda s: (s == F.col("sector")).cast("double"))
    return edges.withColumn("attr", F.transform(F.concat(F.array("d", "cos_t", "sin_t"), sec, onehot), lambda v: v * F.col("w")))


def _attributed(nodes_n, edges, slot, sectors):
    return _with_vector(S.edge_attributes(nodes_n.select("sample_id", "node_id", "x", "y", "dir", "scale"), edges, sectors), slot, sectors)


def skeleton_edges(nodes_n: DataFrame, ssg: DataFrame, sectors=8) -> DataFrame:
    """Both directions of the skeleton with attributes."""
    return _attributed(nodes_n, S.both_ways(ssg).withColumns({"tag": F.lit("SSG"), "w": F.lit(1.0)}), 1.0, sectors)


def topology_edges(nodes_n: DataFrame, topo: DataFrame, sectors=8, w_topo=0.7) -> DataFrame:
    return _attributed(nodes_n, topo, w_topo, sectors)


def relation_edges(nodes_n: DataFrame, mapped: DataFrame, sectors=8, w_rel=0.5) -> DataFrame:
    tagged = mapped.select("sample_id", "src", "dst", F.concat(F.lit("REL_"), "rel_type").alias("tag"), F.lit(1.0).alias("w"))
    return _attributed(nodes_n, tagged, w_rel, sectors)


def hyper_edges(nodes_n: DataFrame, sectors=8, scale=0.6) -> DataFrame:
    """Optional edges between districts, lines and points close by, with attributes; their tags fall in slot 0, times `scale`."""
    return _attributed(nodes_n, T.hyper_edges(nodes_n), scale, sectors)


def all_edges(nodes_n: DataFrame, ssg: DataFrame, topo: DataFrame, mapped: DataFrame, sectors=8, w_rel=0.5, w_topo=0.7) -> DataFrame:
    """SSG, topology and relation edges with attributes, repeats kept."""
    return skeleton_edges(nodes_n, ssg, sectors).unionByName(topology_edges(nodes_n, topo, sectors, w_topo)).unionByName(relation_edges(nodes_n, mapped, sectors, w_rel))


def graph_build(features: DataFrame, relations: DataFrame = None, sectors=8, k=5, use_relations=True, topo_tol=0.5, mode="soft", large=False, hyper=False):
    """(nodes_n, edges, node_features, mapped, unresolved) of every sample, from features with geometry.

    Nodes, neighbours and the skeleton are written once and read by all that follows; with `large` every map's neighbours come from cells; `hyper` adds the hyper edges.
    """
    nodes = written(nodes_of(features), "nodes")
    near = written(S.knn(nodes, k, 0 if large else S.LARGE), "neighbours")
    nodes_n = written(S.normalize_coords(nodes, near), "normalized")
    ssg = written(S.ssg_edges(nodes, sectors, k, near=near), "skeleton")
    if relations is None:
        relations = features.sparkSession.createDataFrame([], "src_name string, dst_name string, rel_type string").join(features.select("sample_id").limit(0))
    mapped, unresolved = R.resolve_relations(relations, nodes)
    topo = (T.soft_topology_edges if mode == "soft" else T.hard_topology_edges)(nodes_n, topo_tol)
    degree = R.relation_degree(mapped, nodes) if use_relations else None
    x = node_features(S.angular_signature(nodes_n, ssg, sectors, near=near), nodes, degree)
    edges = all_edges(nodes_n, ssg, topo, mapped if use_relations else mapped.limit(0), sectors)
    return nodes_n, edges.unionByName(hyper_edges(nodes_n, sectors)) if hyper else edges, x, mapped, unresolved
