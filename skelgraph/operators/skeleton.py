"""Neighbours, normalisation and the sector skeleton graph, per sample."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import radial_gate, relative_angle, sector
from ..store import written
from .boxes import boxed, meet
from .median import exact_median
from .numbering import numbered


def assign_node_ids(features: DataFrame) -> DataFrame:
    """Adds node_id, by layer and place; no task holds a whole map."""
    return numbered(features, "node_id", ["sample_id"], ["layer", "feature_seq"]).withColumn("node_id", F.col("node_id").cast("int"))


def filter_layers(nodes: DataFrame, layer: str) -> DataFrame:
    """Nodes of a layer; lines and polygons only with a geometry of that kind, where there is one."""
    kinds = {"points": ("Landmark", "Node"), "lines": ("Path", "Edge"), "polygons": ("District",)}[layer]
    shape = {"lines": "LineString", "polygons": "Polygon"}.get(layer)
    got = nodes.where(F.col("type").isin(*kinds))
    return got.where(F.col("geom.kind") == shape) if shape and "geom" in nodes.columns else got


LARGE = 4000  # nodes of a map from which `knn` looks in cells
PER_CELL = 32


def _nearest(pairs: DataFrame, want: int) -> DataFrame:
    """(sample_id, i, j, d, rk) of the nearest of the pairs (sample_id, i, ax, ay, j, bx, by)."""
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    rk = F.row_number().over(Window.partitionBy("sample_id", "i").orderBy("d", "j"))
    return pairs.where("i <> j").select("sample_id", "i", "j", d.alias("d")).withColumn("rk", rk).where(F.col("rk") <= want)


def _ends_of(nodes, *more):
    """The nodes once as (i, ax, ay), once as (j, bx, by)."""
    return [nodes.select("sample_id", *more, F.col("node_id").alias(k), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for k, c in (("i", "a"), ("j", "b"))]


def knn(nodes: DataFrame, k=5, large=LARGE) -> DataFrame:
    """The kn - 1 nearest others, kn = max(8, k + 3); distance ties go by node id.

    All pairs of a map, or `knn_grid` for maps of more than `large` nodes, with the same rows.
    """
    want = max(8, k + 3) - 1
    many = nodes.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("sample_id")
    if not many.isEmpty():
        return _plain(nodes.join(many, "sample_id", "left_anti"), want).unionByName(knn_grid(nodes.join(many, "sample_id", "left_semi"), k))
    return _plain(nodes, want)


def _plain(nodes, want):
    a, b = _ends_of(nodes)
    return _nearest(a.join(b, "sample_id"), want)


def knn_grid(nodes: DataFrame, k=5, per_cell=PER_CELL) -> DataFrame:
    """`knn` for large and uneven maps.

    A map is cut into strips by x and the strips into cells by y, by number and not by width, so a cell has at
    most about twice `per_cell` nodes wherever they lie. The neighbours in its own cell bound how far a
    node has to look; the nodes in that square come from cells of the square's own size.
    """
    want = max(8, k + 3) - 1
    per_cell = max(per_cell, want + 1)
    at = numbered(nodes.select("sample_id", "node_id", "x", "y"), "no", ["sample_id"], ["x", "y", "node_id"])
    at = at.join(at.groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id")
    strips = F.greatest(F.floor(F.sqrt(F.col("n") / per_cell)), F.lit(1))
    at = numbered(at.withColumn("strip", F.floor(F.col("no") * strips / F.col("n"))).drop("no"), "no", ["sample_id", "strip"], ["y", "x", "node_id"])
    of = at.groupBy("sample_id", "strip").agg(F.greatest(F.floor(F.count("*") / per_cell), F.lit(1)).alias("cells"))
    at = written(at.join(of, ["sample_id", "strip"]).withColumn("cell", F.least(F.floor(F.col("no") / per_cell), F.col("cells") - 1)).select("sample_id", "strip", "cell", "node_id", "x", "y"), "cells")
    a, b = _ends_of(at, "strip", "cell")
    far = _nearest(a.join(b, ["sample_id", "strip", "cell"]), want).groupBy("sample_id", "i").agg(F.max("d").alias("far"))
    a, b = _ends_of(at)
    # a little wider than far: a neighbour right beside a node can lie on the square's side, which rounding may move inwards
    reach = F.col("far") + (F.abs("ax") + F.abs("ay") + F.col("far")) * 1e-14
    look = boxed(a.join(far, ["sample_id", "i"]), F.array(F.col("ax") - reach, F.col("ax") + reach), F.array(F.col("ay") - reach, F.col("ay") + reach), 0.0, 1e-6)
    look = written(look, "squares")
    return _nearest(meet(boxed(b, F.array("bx"), F.array("by"), 0.0, 1e-6), look, 1e-6), want)


def _ranked(near: DataFrame) -> DataFrame:
    """Neighbours from the second on; all where a sample has two nodes."""
    most = F.max("rk").over(Window.partitionBy("sample_id"))
    return near.withColumn("most", most).where("rk >= 2 OR most = 1")


def global_median(near: DataFrame) -> DataFrame:
    return exact_median(_ranked(near), ["sample_id"], "d", "g")


def local_median(near: DataFrame) -> DataFrame:
    """Of the few neighbours of each node."""
    return _ranked(near).groupBy("sample_id", "i").agg(F.median("d").alias("l"))


def normalize_coords(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Adds xn, yn, cx, cy, scale: centred by the mean, scaled by the median near distance."""
    centre = nodes.groupBy("sample_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    scale = exact_median(near.where("rk <= 4"), ["sample_id"], "d", "m")
    s = F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)
    stats = centre.join(scale, "sample_id", "left").select("sample_id", "cx", "cy", s.alias("scale"))
    return nodes.join(stats, "sample_id").withColumns({"xn": (F.col("x") - F.col("cx")) / F.col("scale"), "yn": (F.col("y") - F.col("cy")) / F.col("scale")})


def adaptive_knn_edges(near: DataFrame, k=5, adaptive=True) -> DataFrame:
    if not adaptive:
        return near.where(F.col("rk") <= k).select("sample_id", "i", "j")
    bad = F.col("l").isNull() | (F.col("l") <= 1e-8) | F.isnan("l")
    local = F.when(bad, F.col("g")).otherwise(F.col("l"))
    local = F.when(local.isNull() | (local <= 1e-8), 1.0).otherwise(local)
    both = local_median(near).join(global_median(near), "sample_id")
    ki = both.select("sample_id", "i", F.least(F.greatest(F.rint(k * F.col("g") / local), F.lit(3.0)), F.lit(8.0)).alias("ki"))
    return near.join(ki, ["sample_id", "i"]).where("rk <= ki").select("sample_id", "i", "j")


def _ends(pairs: DataFrame, nodes: DataFrame, x="x", y="y") -> DataFrame:
    """Adds dx, dy from i to j, and the direction (and scale, if any) of i."""
    own = [F.col(c).alias(f"{c}_i") for c in ("dir", "scale") if c in nodes.columns]
    a = nodes.select("sample_id", F.col("node_id").alias("i"), F.col(x).alias("_ax"), F.col(y).alias("_ay"), *own)
    b = nodes.select("sample_id", F.col("node_id").alias("j"), F.col(x).alias("_bx"), F.col(y).alias("_by"))
    got = pairs.join(a, ["sample_id", "i"]).join(b, ["sample_id", "j"])
    return got.withColumns({"dx": F.col("_bx") - F.col("_ax"), "dy": F.col("_by") - F.col("_ay")}).drop("_ax", "_ay", "_bx", "_by")


def sector_cover_edges(near: DataFrame, nodes: DataFrame, sectors=8) -> DataFrame:
    """The nearest neighbour in each sector; without a direction there is one sector."""
    rel = relative_angle(F.col("dx"), F.col("dy"), F.col("dir_i"))
    at = F.when(F.col("dir_i").isNull(), F.lit(0)).otherwise(sector(rel, sectors))
    best = Window.partitionBy("sample_id", "i", "sector").orderBy("rk")
    return _ends(near, nodes).withColumn("sector", at).withColumn("r", F.row_number().over(best)).where("r = 1").select("sample_id", "i", "j")


def ssg_edges(nodes: DataFrame, sectors=8, k=5, adaptive=True, near=None) -> DataFrame:
    near = knn(nodes, k) if near is None else near
    return adaptive_knn_edges(near, k, adaptive).union(sector_cover_edges(near, nodes, sectors)).distinct()


def angular_signature(nodes_n: DataFrame, ssg: DataFrame, sectors=8, radii=(0.75, 1.0, 1.5), near=None) -> DataFrame:
    """Per node, `len(radii) * sectors` radial-gate sums over skeleton neighbours, summing to one."""
    near = knn(nodes_n) if near is None else near
    first = near.where("rk = 1").select("sample_id", "i", F.col("j"))
    zero = _ends(first, nodes_n, "xn", "yn").select("sample_id", "i", F.coalesce("dir_i", F.atan2("dy", "dx")).alias("zero"))
    both = ssg.select("sample_id", "i", "j").unionAll(ssg.select("sample_id", F.col("j").alias("i"), F.col("i").alias("j")))
    got = _ends(both, nodes_n, "xn", "yn").withColumn("d", F.hypot("dx", "dy")).where("d >= 1e-8").join(zero, ["sample_id", "i"])
    at = sector(relative_angle(F.col("dx"), F.col("dy"), F.col("zero")), sectors)
    slots = F.explode(F.array(*[F.struct((at + r * sectors).alias("slot"), radial_gate(F.col("d"), v).alias("g")) for r, v in enumerate(radii)]))
    sums = got.select("sample_id", "i", slots.alias("s")).groupBy("sample_id", "i", "s.slot").agg(F.sum("s.g").alias("g"))
    whole = sums.groupBy("sample_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("slot", "g"))).alias("m"), F.sum("g").alias("t"))
    n = len(radii) * sectors
    sig = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: F.when(F.col("t") > 0, F.coalesce(F.try_element_at("m", s), F.lit(0.0)) / F.col("t")).otherwise(0.0))
    every = nodes_n.select("sample_id", "node_id").join(whole.withColumnRenamed("i", "node_id"), ["sample_id", "node_id"], "left")
    return every.select("sample_id", "node_id", F.coalesce(sig, F.array_repeat(F.lit(0.0), n)).alias("sig"))


def edge_attributes(nodes: DataFrame, edges: DataFrame, sectors=8, floor=1e-6) -> DataFrame:
    """Adds d, cos_t, sin_t, sector to directed (src, dst) rows; no direction counts as zero.

    With a `scale` of the nodes, d is in its units. Angles always come from x and y as they are: centring would
    change the last bit of a difference, which decides where an angle lies on a sector's edge.
    """
    got = _ends(edges.withColumnsRenamed({"src": "i", "dst": "j"}), nodes)
    rel = relative_angle(F.col("dx"), F.col("dy"), F.coalesce("dir_i", F.lit(0.0)))
    length = F.hypot("dx", "dy")
    if "scale" in nodes.columns:
        length = length / F.col("scale_i")
    got = got.withColumns({"d": length + floor, "cos_t": F.cos(rel), "sin_t": F.sin(rel), "sector": sector(rel, sectors, "clip")})
    return got.withColumnsRenamed({"i": "src", "j": "dst"}).drop("dx", "dy", "dir_i", "scale_i")


def both_ways(ssg: DataFrame) -> DataFrame:
    """(sample_id, src, dst): both directions of each edge, repeats kept."""
    one = ssg.select("sample_id", F.col("i").alias("src"), F.col("j").alias("dst"))
    return one.unionAll(one.select("sample_id", F.col("dst").alias("src"), F.col("src").alias("dst")))


def edge_attributes_ssg(nodes: DataFrame, ssg: DataFrame, sectors=8, tag="SSG") -> DataFrame:
    return edge_attributes(nodes, both_ways(ssg), sectors).withColumn("tag", F.lit(tag))
