"""Registered queries and their DuckDB oracles."""
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import scalars as C
from .functions import shapes as H
from .operators import augment as A
from .operators import compare as M
from .operators import gnn as E
from .operators import losses as L
from .operators import matching as N
from .operators import paths as O
from .operators import relations as R
from .operators import report as P
from .operators import skeleton as S
from .operators import topology as T
from .constants import EDGE_TAGS
from .plans import accuracy, graph, views
from .sources import readers
from .sources.shapefile import opened
from .store import fresh, written

QUERIES, ORACLES = {}, {}
_PI2 = "6.283185307179586e0"


def _mod(angle):
    """The angle from 0 to below two pi; two pi is added below zero only, so that angles in range keep their last bit."""
    return f"(CASE WHEN fmod({angle}, {_PI2}) < 0 THEN fmod(fmod({angle}, {_PI2}) + {_PI2}, {_PI2}) ELSE fmod({angle}, {_PI2}) END)"


CTES = {
    "base": views.BASE.replace("<json>", "json_extract_string"),
    "nodes": views.NODES,
    "relations": views.RELATIONS,
    "knn": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY d, j) AS rk FROM (
        SELECT a.sample_id, a.node_id AS i, b.node_id AS j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d
        FROM nodes a JOIN nodes b ON a.sample_id = b.sample_id AND a.node_id <> b.node_id)) WHERE rk <= 7""",
    "ranked": "SELECT * FROM (SELECT *, max(rk) OVER (PARTITION BY sample_id) AS most FROM knn) WHERE rk >= 2 OR most = 1",
    "gm": "SELECT sample_id, median(d) AS g FROM ranked GROUP BY sample_id",
    "lm": "SELECT sample_id, i, median(d) AS l FROM ranked GROUP BY sample_id, i",
    "nn": """SELECT n.*, cx, cy, scale, (x - cx) / scale AS xn, (y - cy) / scale AS yn FROM nodes n
        JOIN (SELECT sample_id, avg(x) AS cx, avg(y) AS cy FROM nodes GROUP BY sample_id) USING (sample_id)
        JOIN (SELECT sample_id, median(d) AS scale FROM knn WHERE rk <= 4 GROUP BY sample_id) USING (sample_id)""",
    "adaptive": """SELECT k.sample_id, i, j FROM knn k JOIN lm USING (sample_id, i) JOIN gm USING (sample_id)
        WHERE rk <= least(greatest(round_even(5 * g / CASE WHEN l <= 1e-8 THEN g ELSE l END, 0), 3), 8)""",
    "cover": f"""SELECT sample_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, i, s ORDER BY rk) AS r FROM (
        SELECT k.sample_id, i, j, rk, CASE WHEN a.dir IS NULL THEN 0 ELSE
          CAST(floor({_mod("atan2(b.y-a.y, b.x-a.x) - a.dir")} / {_PI2} * 8) AS INT) % 8 END AS s
        FROM knn k JOIN nodes a ON a.sample_id = k.sample_id AND a.node_id = i JOIN nodes b ON b.sample_id = k.sample_id AND b.node_id = j)) WHERE r = 1""",
    "ssg": "SELECT * FROM adaptive UNION SELECT * FROM cover",
    "look": "SELECT sample_id, lower(trim(name)) AS key, min(node_id) AS id, max(node_id) AS last FROM nodes GROUP BY ALL",
    "resolved": """SELECT r.*, s.id AS src, d.id AS dst, s.id IS NOT NULL AND d.id IS NOT NULL AND rel_type IN ('Gaze','Connection','Navigation','Fusion','Abruptness','Penetration') AS ok
        FROM relations r LEFT JOIN look s ON s.sample_id = r.sample_id AND s.key = lower(trim(src_name)) LEFT JOIN look d ON d.sample_id = r.sample_id AND d.key = lower(trim(dst_name))""",
    "realmap": "SELECT * FROM nodes WHERE sample_id = (SELECT min(sample_id) FROM nodes)",
    "matches": "SELECT n.sample_id AS sample_a, n.node_id AS i, l.last AS j FROM nodes n JOIN (SELECT lower(trim(name)) AS key, max(node_id) AS last FROM realmap GROUP BY ALL) l ON l.key = lower(trim(n.name))",
    "typed": """SELECT m.*, a.type AS ta, b.type AS tb, CASE WHEN a.layer = 0 THEN 'pt' WHEN a.layer = 1 THEN 'ln' ELSE 'pg' END AS ca, CASE WHEN b.layer = 0 THEN 'pt' WHEN b.layer = 1 THEN 'ln' ELSE 'pg' END AS cb
        FROM matches m JOIN nodes a ON a.sample_id = sample_a AND a.node_id = i JOIN realmap b ON b.node_id = j""",
    "pts": "SELECT sample_id, node_id AS src, xn AS px, yn AS py FROM nn WHERE layer = 0",
    "feat": "SELECT sample_id, node_id AS dst, layer, (ax-cx)/scale AS gx, (ay-cy)/scale AS gy, w/scale AS gw, h/scale AS gh FROM nn WHERE layer > 0",
    "lined": """SELECT sample_id, src, dst, sqrt((px-gx-t*gw)*(px-gx-t*gw)+(py-gy-t*gh)*(py-gy-t*gh)) AS d, sqrt((px-gx)*(px-gx)+(py-gy)*(py-gy)) AS d0,
        sqrt((px-gx-gw)*(px-gx-gw)+(py-gy-gh)*(py-gy-gh)) AS d1 FROM (SELECT *, least(greatest(((px-gx)*gw+(py-gy)*gh)/(gw*gw+gh*gh), 0), 1) AS t FROM pts JOIN feat USING (sample_id) WHERE layer = 1)""",
    "polyd": """SELECT sample_id, src, dst, sqrt(ox*ox+oy*oy) AS d, CASE WHEN ox = 0 AND oy = 0 THEN least(px-gx, gx+gw-px, py-gy, gy+gh-py) ELSE sqrt(ox*ox+oy*oy) END AS b
        FROM (SELECT *, greatest(gx-px, px-gx-gw, 0) AS ox, greatest(gy-py, py-gy-gh, 0) AS oy FROM pts JOIN feat USING (sample_id) WHERE layer = 2)""",
    "soft": """SELECT sample_id, src, dst, 'TOPO_in_district' AS tag, exp(-d/0.5) AS w FROM polyd WHERE exp(-d/0.5) > 1e-4
        UNION ALL SELECT sample_id, src, dst, 'TOPO_touches_boundary', exp(-b/0.5) FROM polyd WHERE exp(-b/0.5) > 1e-4
        UNION ALL SELECT sample_id, src, dst, 'TOPO_on_line', exp(-d/0.5) FROM lined WHERE exp(-d/0.5) > 1e-4
        UNION ALL SELECT sample_id, src, dst, 'TOPO_near_endpoint', 0.5*exp(-d0/0.5) FROM lined WHERE exp(-d0/0.5) > 1e-4
        UNION ALL SELECT sample_id, src, dst, 'TOPO_near_endpoint', 0.5*exp(-d1/0.5) FROM lined WHERE exp(-d1/0.5) > 1e-4""",
    "zero": "SELECT k.sample_id, i, coalesce(a.dir, atan2(b.yn-a.yn, b.xn-a.xn)) AS z FROM knn k JOIN nn a ON a.sample_id = k.sample_id AND a.node_id = i JOIN nn b ON b.sample_id = k.sample_id AND b.node_id = j WHERE rk = 1",
    "sig": f"""SELECT sample_id, node_id, slot, g / sum(g) OVER (PARTITION BY sample_id, node_id) AS v FROM (
        SELECT sample_id, i AS node_id, CAST(r * 8 + s AS INT) AS slot, sum(exp(-0.5 * pow((d / (rad + 1e-8) - 1) / 0.5, 2)) / (d + 1e-3)) AS g FROM (
          SELECT e.sample_id, e.i, sqrt((b.xn-a.xn)*(b.xn-a.xn)+(b.yn-a.yn)*(b.yn-a.yn)) AS d,
            CAST(floor({_mod("atan2(b.yn-a.yn, b.xn-a.xn) - z")} / {_PI2} * 8) AS INT) % 8 AS s
          FROM (SELECT sample_id, i, j FROM ssg UNION ALL SELECT sample_id, j, i FROM ssg) e JOIN nn a ON a.sample_id = e.sample_id AND a.node_id = e.i
          JOIN nn b ON b.sample_id = e.sample_id AND b.node_id = e.j JOIN zero z0 ON z0.sample_id = e.sample_id AND z0.i = e.i), (VALUES (0, 0.75e0), (1, 1e0), (2, 1.5e0)) v(r, rad)
        WHERE d >= 1e-8 GROUP BY ALL)""",
}
_SECTOR = f"least(CAST(floor({_mod('t')} / {_PI2} * 8) AS INT), 7)"
CTES["edges"] = f"""SELECT *, cos(t) AS cos_t, sin(t) AS sin_t, {_SECTOR} AS sector FROM (
    SELECT e.*, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) / a.scale + 1e-6 AS d, atan2(b.y-a.y, b.x-a.x) - coalesce(a.dir, 0) AS t FROM (
      SELECT sample_id, i AS src, j AS dst, 'SSG' AS tag, 1e0 AS w, 1e0 AS part FROM ssg UNION ALL SELECT sample_id, j, i, 'SSG', 1e0, 1e0 FROM ssg
      UNION ALL SELECT sample_id, src, dst, tag, w, 7e-1 FROM soft UNION ALL SELECT sample_id, src, dst, 'REL_' || rel_type, 1e0, 5e-1 FROM resolved WHERE ok) e
    JOIN nn a ON a.sample_id = e.sample_id AND a.node_id = src JOIN nn b ON b.sample_id = e.sample_id AND b.node_id = dst)"""
CTES["reldeg"] = "SELECT sample_id, node_id, [{}] AS rel_deg FROM nodes LEFT JOIN (SELECT sample_id, src AS node_id, rel_type FROM resolved WHERE ok UNION ALL SELECT sample_id, dst, rel_type FROM resolved WHERE ok) USING (sample_id, node_id) GROUP BY ALL".format(
    ", ".join(f"count(*) FILTER (rel_type = '{r}') / (count(rel_type) + 1e-6)" for r in ("Gaze", "Connection", "Navigation", "Fusion", "Abruptness", "Penetration")))
CTES["vector"] = """SELECT sample_id, node_id, list(coalesce(v, 0) ORDER BY slot) AS sig FROM (SELECT sample_id, node_id, CAST(unnest(range(24)) AS INT) AS slot FROM nodes) LEFT JOIN sig USING (sample_id, node_id, slot) GROUP BY ALL"""
_NAMES = list(CTES)


def register(name, sql=None, upto=None):
    """Register a query; its oracle has the views up to and with `upto` before it."""
    def put(f):
        QUERIES[name] = f
        if sql:
            head = "" if upto is None else "WITH " + ", ".join(f"{k} AS MATERIALIZED ({CTES[k]})" for k in _NAMES[:_NAMES.index(upto) + 1]) + " "
            ORACLES[name] = head + sql
        return f
    return put


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def _round_each(col, digits):
    return F.transform(col, lambda v: F.round(v, digits) + 0.0)


def _real(nodes):
    first = nodes.agg(F.min("sample_id").alias("_m"))
    return nodes.join(F.broadcast(first), nodes["sample_id"] == F.col("_m")).drop("_m")


@register("assign_node_ids", "SELECT sample_id, event_id, node_id FROM nodes", "nodes")
def _(spark, d):
    return S.assign_node_ids(views.base(spark, d).withColumn("feature_seq", F.col("event_id"))).select("sample_id", "event_id", "node_id")


@register("type_onehot", "SELECT type, count(*) AS n, [CAST(type='Landmark' AS DOUBLE), CAST(type='Node' AS DOUBLE), CAST(type='Path' AS DOUBLE), CAST(type='Edge' AS DOUBLE), CAST(type='District' AS DOUBLE)] AS v FROM base GROUP BY type", "base")
def _(spark, d):
    return views.base(spark, d).groupBy("type").agg(F.count("*").alias("n")).withColumn("v", C.type_onehot(F.col("type")))


@register("edge_type_onehot", """SELECT rel_type, count(*) AS n, [CASE WHEN rel_type = 'gaze' THEN 1e0 ELSE 0e0 END] || list_transform(['Gaze','Connection','Navigation','Fusion','Abruptness','Penetration'], lambda r: CAST(r = rel_type AS DOUBLE)) || [0e0, 0e0, 0e0, 0e0] AS v FROM relations GROUP BY rel_type""", "relations")
def _(spark, d):
    return views.relations(spark, d).groupBy("rel_type").agg(F.count("*").alias("n")).withColumn("v", C.edge_type_onehot(F.concat(F.lit("REL_"), "rel_type")))


@register("filter_layers", "SELECT sample_id, node_id, CASE WHEN layer = 0 THEN 'points' WHEN layer = 1 THEN 'lines' ELSE 'polygons' END AS layer_name FROM nodes", "nodes")
def _(spark, d):
    n = views.nodes(spark, d)
    a, b, c = (S.filter_layers(n, k).select("sample_id", "node_id", F.lit(k).alias("layer_name")) for k in ("points", "lines", "polygons"))
    return a.unionAll(b).unionAll(c)


@register("broad_class", "SELECT CASE layer WHEN 0 THEN 'pt' WHEN 1 THEN 'ln' ELSE 'pg' END AS class, count(*) AS n FROM base GROUP BY 1", "base")
def _(spark, d):
    return views.base(spark, d).groupBy(C.broad_class(F.col("type")).alias("class")).agg(F.count("*").alias("n"))


@register("representative_point", "SELECT sample_id, node_id, round(x, 6) AS px, round(y, 6) AS py FROM nodes", "nodes")
def _(spark, d):
    got = views.nodes(spark, d).withColumn("p", G.representative_point(F.col("geom")))
    return got.select("sample_id", "node_id", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@register("line_direction", "SELECT sample_id, node_id, round(dir, 6) AS dir FROM nodes", "nodes")
def _(spark, d):
    return views.nodes(spark, d).select("sample_id", "node_id", F.round(G.line_direction(F.col("geom")), 6).alias("dir"))


@register("line_shape", "SELECT event_id, round(sqrt(w*w+h*h)/(w+h), 6) AS straight, round(1 - sqrt(w*w+h*h)/(w+h), 6) AS curv FROM base WHERE layer = 1", "base")
def _(spark, d):
    g = F.col("geom")
    return views.bent(spark, d).where("layer = 1").select("event_id", F.round(G.line_straightness(g), 6).alias("straight"), F.round(G.line_curvature(g), 6).alias("curv"))


@register("polygon_circularity", "SELECT event_id, round(4 * pi() * 0.75 * w * h / pow(2 * (w + h), 2), 6) AS circ FROM base WHERE layer = 2", "base")
def _(spark, d):
    return views.bent(spark, d).where("layer = 2").select("event_id", F.round(G.polygon_circularity(F.col("geom")), 6).alias("circ"))


@register("knn", "SELECT sample_id, i, j, rk, round(d, 6) AS d FROM knn", "knn")
def _(spark, d):
    return _rounded(S.knn(views.nodes(spark, d)), "d")


@register("global_median", "SELECT sample_id, round(g, 6) AS g FROM gm", "gm")
def _(spark, d):
    return _rounded(S.global_median(_normal(spark, d)[1]), "g")


@register("local_median", "SELECT sample_id, i, round(l, 6) AS l FROM lm", "lm")
def _(spark, d):
    return _rounded(S.local_median(S.knn(views.nodes(spark, d))), "l")


@register("normalize_coords", "SELECT sample_id, node_id, round(xn, 6) AS xn, round(yn, 6) AS yn, round(scale, 6) AS scale FROM nn", "nn")
def _(spark, d):
    return _rounded(_normal(spark, d)[0].select("sample_id", "node_id", "xn", "yn", "scale"), "xn", "yn", "scale")


@register("adaptive_knn_edges", "SELECT * FROM adaptive", "adaptive")
def _(spark, d):
    return S.adaptive_knn_edges(S.knn(views.nodes(spark, d)))


@register("sector_cover_edges", "SELECT * FROM cover", "cover")
def _(spark, d):
    n = views.nodes(spark, d)
    return S.sector_cover_edges(S.knn(n), n)


@register("ssg_edges", "SELECT * FROM ssg", "ssg")
def _(spark, d):
    return S.ssg_edges(views.nodes(spark, d))


@register("angular_signature", "SELECT sample_id, node_id, list_transform(sig, lambda v: round(v, 6)) AS sig FROM vector", "vector")
def _(spark, d):
    n, near = _normal(spark, d)
    got = S.angular_signature(n, S.ssg_edges(n, near=near), near=near)
    return got.withColumn("sig", _round_each("sig", 6))


_ATTR = "list_transform([d * w, cos_t * w, sin_t * w] || list_transform(range(8), lambda k: CASE WHEN k = sector THEN w ELSE 0e0 END) || list_transform({}, lambda k: CASE WHEN k = tag THEN part * w ELSE 0e0 END), lambda v: round(v, 5) + 0e0)".format(EDGE_TAGS)


def _normal(spark, d):
    """(nodes with normalised coordinates, neighbours)"""
    n = views.nodes(spark, d)
    near = written(S.knn(n), "neighbours")
    return S.normalize_coords(n, near), near


@register("edge_attributes_ssg", f"SELECT sample_id, src, dst, tag, {_ATTR} AS attr FROM edges WHERE tag = 'SSG'", "edges")
def _(spark, d):
    n, near = _normal(spark, d)
    edges = graph.skeleton_edges(n, S.ssg_edges(n, near=near))
    return edges.select("sample_id", "src", "dst", "tag", _round_each("attr", 5).alias("attr"))


@register("edge_attributes_relation", f"SELECT sample_id, src, dst, tag, {_ATTR} AS attr FROM edges WHERE starts_with(tag, 'REL_')", "edges")
def _(spark, d):
    n, _near = _normal(spark, d)
    edges = graph.relation_edges(n, R.resolve_relations(views.relations(spark, d), n)[0])
    return edges.select("sample_id", "src", "dst", "tag", _round_each("attr", 5).alias("attr"))


@register("edge_attributes_topology", f"SELECT sample_id, src, dst, tag, round(w, 5) AS w, {_ATTR} AS attr FROM edges WHERE starts_with(tag, 'TOPO_')", "edges")
def _(spark, d):
    n, _near = _normal(spark, d)
    got = graph.topology_edges(n, T.soft_topology_edges(n))
    return got.select("sample_id", "src", "dst", "tag", F.round("w", 5).alias("w"), _round_each("attr", 5).alias("attr"))


def _names(spark, d):
    """Nodes without their geometry, for what goes by names and types."""
    return S.assign_node_ids(views.base(spark, d).select("sample_id", "layer", F.col("event_id").alias("feature_seq"), "name", "type"))


@register("resolve_relations", "SELECT sample_id, src, dst, rel_type FROM resolved WHERE ok", "resolved")
def _(spark, d):
    return R.resolve_relations(views.relations(spark, d), _names(spark, d))[0]


@register("unresolved_relations", "SELECT sample_id, src_name, dst_name, rel_type FROM resolved WHERE NOT ok", "resolved")
def _(spark, d):
    return R.resolve_relations(views.relations(spark, d), _names(spark, d))[1]


@register("relation_degree", "SELECT sample_id, node_id, list_transform(rel_deg, lambda v: round(v, 6)) AS rel_deg FROM reldeg", "reldeg")
def _(spark, d):
    n = _names(spark, d)
    return R.relation_degree(R.resolve_relations(views.relations(spark, d), n)[0], n).withColumn("rel_deg", _round_each("rel_deg", 6))


@register("match_by_name", "SELECT * FROM matches", "matches")
def _(spark, d):
    n = _names(spark, d)
    return R.match_by_name(n, _real(n))


_ANGLE = "(event_id * 7919 % 10007) / 10007e0 * 15e-1"


def _angles(spark, d):
    """Node vectors for assignment: unit vectors of the plane, by the event's number."""
    return views.base(spark, d).select("sample_id", F.col("event_id").alias("node_id"), F.expr(_ANGLE).alias("t")).select("sample_id", "node_id", F.array(F.cos("t"), F.sin("t")).alias("vec"))


def _optimum(pairs):
    """CTEs up to `best` (sample_a, sample_b, n, m, cost): the least total cost of matching the angles of two maps, found row by
    row. Angles lie within a right angle, where the cost is convex, so some optimum crosses nowhere."""
    return f"""angle AS MATERIALIZED (SELECT sample_id, t, row_number() OVER (PARTITION BY sample_id ORDER BY t) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM (SELECT sample_id, {_ANGLE} AS t FROM base)),
    size AS (SELECT DISTINCT sample_id, n FROM angle),
    pair AS MATERIALIZED (SELECT sample_a, sample_b, least(a.n, b.n) AS n, greatest(a.n, b.n) AS m, CASE WHEN a.n > b.n THEN sample_b ELSE sample_a END AS rows, CASE WHEN a.n > b.n THEN sample_a ELSE sample_b END AS columns
        FROM ({pairs}) p JOIN size a ON a.sample_id = sample_a JOIN size b ON b.sample_id = sample_b),
    step(sample_a, sample_b, i, j, f) AS (SELECT sample_a, sample_b, 0::BIGINT, unnest(range(0, m + 1)), 0e0 FROM pair
        UNION ALL SELECT s.sample_a, s.sample_b, s.i + 1, s.j, min(s.before + 1 - cos(x.t - y.t)) OVER (PARTITION BY s.sample_a, s.sample_b ORDER BY s.j)
        FROM (SELECT *, lag(f) OVER (PARTITION BY sample_a, sample_b ORDER BY j) AS before FROM step) s JOIN pair p ON p.sample_a = s.sample_a AND p.sample_b = s.sample_b AND s.i < p.n
        JOIN angle x ON x.sample_id = p.rows AND x.r = s.i + 1 LEFT JOIN angle y ON y.sample_id = p.columns AND y.r = s.j),
    best AS (SELECT p.sample_a, p.sample_b, p.n, p.m, f AS cost FROM pair p JOIN step s ON s.sample_a = p.sample_a AND s.sample_b = p.sample_b AND s.i = p.n AND s.j = p.m)"""


def _with(ctes, upto):
    return "WITH RECURSIVE " + ", ".join(f"{k} AS MATERIALIZED ({CTES[k]})" for k in _NAMES[:_NAMES.index(upto) + 1]) + ", " + ctes + " "


@register("node_assignment", _with(_optimum("SELECT a.sample_id AS sample_a, a.sample_id + 1 AS sample_b FROM (SELECT DISTINCT sample_id FROM base) a"), "base") + """
    SELECT sample_a, sample_b, n, round(cost, 3) + 0e0 AS cost, round(1 - cost / n, 5) AS score, round(n / m, 5) AS coverage
    FROM (SELECT * REPLACE (n - (n - cost) / pow(1 + 1e-8, 2) AS cost) FROM best)""")  # cosines divide by norms of 1 and 1e-8
def _(spark, d):
    h = _angles(spark, d)
    maps = h.select("sample_id").distinct()
    pairs = maps.select(F.col("sample_id").alias("sample_a"), (F.col("sample_id") + 1).alias("sample_b")).join(maps.withColumnRenamed("sample_id", "sample_b"), "sample_b")
    got = N.node_assignment(h, h, pairs)[0]
    cost = F.round((1 - F.col("score")) * F.col("n"), 3) + 0.0
    return got.select("sample_a", "sample_b", F.col("n").cast("long").alias("n"), cost.alias("cost"), F.round("score", 5).alias("score"), F.round("coverage", 5).alias("coverage"))


@register("fidelity", _with(_optimum("SELECT sample_id AS sample_a, (SELECT min(sample_id) FROM base) AS sample_b FROM (SELECT DISTINCT sample_id FROM base)"), "typed") + """SELECT s.sample_id AS sample_a, round(coalesce(t, 0), 6) AS type, round(coalesce(p, 0), 6) AS topo, round(1 - cost / n, 5) AS struct, round(6e-1 * (1 - cost / n) + 1e-1 * coalesce(t, 0) + 3e-1 * coalesce(p, 0), 5) AS fidelity
    FROM best JOIN (SELECT DISTINCT sample_id FROM nodes) s ON best.sample_a = s.sample_id LEFT JOIN (SELECT sample_a, avg(CAST(ta = tb AS DOUBLE)) AS t, avg(CAST(ca = cb AS DOUBLE)) AS p FROM typed GROUP BY sample_a) x ON x.sample_a = s.sample_id""")
def _(spark, d):
    n, h = _names(spark, d), _angles(spark, d)
    got = accuracy.accuracy(n, _real(n), h, _real(h)).select("sample_a", "type", "topo", "struct", "fidelity")
    return _rounded(_rounded(got, "type", "topo"), "struct", "fidelity", digits=5)


@register("per_class_scores", """SELECT sample_a, ca AS class, round(m / greatest(a, b), 6) AS score FROM (SELECT sample_a, ca, count(*) AS m FROM typed WHERE ca = cb GROUP BY ALL)
    JOIN (SELECT sample_id AS sample_a, CASE layer WHEN 0 THEN 'pt' WHEN 1 THEN 'ln' ELSE 'pg' END AS ca, count(*) AS a FROM nodes GROUP BY ALL) USING (sample_a, ca)
    JOIN (SELECT CASE layer WHEN 0 THEN 'pt' WHEN 1 THEN 'ln' ELSE 'pg' END AS ca, count(*) AS b FROM realmap GROUP BY ALL) USING (ca)""", "typed")
def _(spark, d):
    n = _names(spark, d)
    r = _real(n)
    return _rounded(R.per_class_scores(n, r, R.match_by_name(n, r)), "score")


@register("soft_topology_edges", "SELECT sample_id, src, dst, tag, round(w, 6) AS w FROM soft", "soft")
def _(spark, d):
    return _rounded(T.soft_topology_edges(_normal(spark, d)[0]), "w")


@register("hard_topology_edges", """SELECT sample_id, src, dst, CASE WHEN d < 0.5 THEN 'TOPO_in_district' ELSE 'TOPO_touches_boundary' END AS tag, 1e0 AS w FROM polyd WHERE d <= 1
    UNION ALL SELECT sample_id, src, dst, 'TOPO_on_line', 1e0 FROM lined WHERE d < 0.5 UNION ALL SELECT sample_id, src, dst, 'TOPO_near_endpoint', 1e0 FROM lined WHERE least(d0, d1) <= 0.5""", "polyd")
def _(spark, d):
    return T.hard_topology_edges(_normal(spark, d)[0])


def _graph(spark, d):
    return graph.graph_build(views.features(spark, d), views.relations(spark, d))


@register("graph_build", f"SELECT sample_id, src, dst, tag, round(w, 5) AS w, round(d, 5) AS d, round(cos_t, 5) + 0e0 AS cos_t, round(sin_t, 5) + 0e0 AS sin_t, sector, {_ATTR} AS attr FROM edges", "edges")
def _(spark, d):
    got = _graph(spark, d)[1]
    got = got.select("sample_id", "src", "dst", "tag", "w", "d", "cos_t", "sin_t", "sector", _round_each("attr", 5).alias("attr"))
    return got.withColumns({c: F.round(c, 5) + 0.0 for c in ("w", "d", "cos_t", "sin_t")})


_X = """sig || list_transform(rel_deg, lambda v: 2e-1 * v) || list_transform(['Landmark', 'Node', 'Path', 'Edge', 'District'], lambda t: CASE WHEN t = type THEN 2e-1 ELSE 0e0 END)
    || list_transform(CASE layer WHEN 0 THEN [0e0, 0e0, 0e0, 0e0] WHEN 1 THEN [1e0, 0e0, 0e0, 0e0] ELSE [4 * pi() * w * h / pow(2 * (w + h), 2), 1e0, 1e0, pi() / 2 / (pi() + 1e-6)] END, lambda v: 3e-1 * v)"""
_FEATURES = "nodes JOIN vector USING (sample_id, node_id) JOIN reldeg USING (sample_id, node_id)"


@register("node_features", f"SELECT sample_id, node_id, list_transform({_X}, lambda v: round(v, 5) + 0e0) AS x FROM {_FEATURES}", "vector")
def _(spark, d):
    return _graph(spark, d)[2].withColumn("x", _round_each("x", 5))


_HIDDEN = 4  # one head and one layer in the query: what its SQL can spell out
_W = E.default_weights(39, 22, _HIDDEN, 1)


def _times(vector, matrix):
    return "[" + ", ".join(f"list_dot_product({vector}, [{', '.join(f'{v:.17e}' for v in column)}])" for column in matrix.T.tolist()) + "]"


_LAYER = _W["layers"][0]
_GNN = f"""x AS (SELECT sample_id, node_id, {_X} AS x FROM {_FEATURES}),
    start AS MATERIALIZED (SELECT sample_id, node_id, list_transform({_times('x', _W['enc'])}, lambda v: greatest(v, 0e0)) AS h FROM x),
    ends AS MATERIALIZED (SELECT sample_id, node_id, {_times('h', _LAYER['q'])} AS q, {_times('h', _LAYER['k'])} AS k, {_times('h', _LAYER['v'])} AS v FROM start),
    scored AS MATERIALIZED (SELECT e.sample_id, dst, b.v, list_dot_product(a.q, b.k) + list_dot_product(a.q, e) AS s FROM (SELECT sample_id, src, dst, {_times(_ATTR.split(', lambda v: round')[0].replace('list_transform([d', '[d', 1), _LAYER['e'])} AS e FROM edges) e
        JOIN ends a ON a.sample_id = e.sample_id AND a.node_id = dst JOIN ends b ON b.sample_id = e.sample_id AND b.node_id = src),
    softened AS (SELECT sample_id, dst AS node_id, v, exp(l - max(l) OVER (PARTITION BY sample_id, dst)) AS p FROM (SELECT *, CASE WHEN s > 0 THEN s ELSE 2e-1 * s END AS l FROM scored)),
    got AS (SELECT sample_id, node_id, [{', '.join(f'sum(p * v[{k + 1}]) / sum(p)' for k in range(_HIDDEN))}] AS o FROM softened GROUP BY sample_id, node_id),
    added AS (SELECT sample_id, node_id, list_transform(list_zip(h, coalesce(o, [{', '.join(['0e0'] * _HIDDEN)}])), lambda z: z[1] + z[2]) AS h FROM start LEFT JOIN got USING (sample_id, node_id)),
    ended AS MATERIALIZED (SELECT sample_id, node_id, list_transform(h, lambda v: (v - list_avg(h)) / sqrt(list_aggregate(h, 'var_pop') + 1e-5)) AS h FROM added),
    pooled AS (SELECT sample_id, [{', '.join(f'avg(h[{k + 1}])' for k in range(_HIDDEN))}] AS g FROM ended GROUP BY sample_id)"""


def _embedded(spark, d):
    _, edges, x, _, _ = _graph(spark, d)
    return E.gnn_embed(x, written(edges, "edges"), _W, heads=1)


@register("gnn_embed", _with(_GNN, "vector").replace("WITH RECURSIVE", "WITH") + "SELECT sample_id, node_id, list_transform(h, lambda v: round(v, 4) + 0e0) AS vec FROM ended")
def _(spark, d):
    return _embedded(spark, d)[0].withColumn("vec", _round_each("vec", 4))


@register("gnn_graphs", _with(_GNN, "vector").replace("WITH RECURSIVE", "WITH") + f"SELECT sample_id, list_transform({_times('z', _W['out2'])}, lambda v: round(v, 4) + 0e0) AS vec FROM (SELECT sample_id, list_transform({_times('g', _W['out1'])}, lambda v: greatest(v, 0e0)) AS z FROM pooled)")
def _(spark, d):
    return _embedded(spark, d)[1].withColumn("vec", _round_each("vec", 4))


_HYPER = f""", kind AS (SELECT sample_id, node_id, type FROM nodes),
    cut AS (SELECT l.sample_id, d.dst AS district, l.dst AS line, least((d.gx+d.gw-l.gx)/l.gw, (d.gy+d.gh-l.gy)/l.gh, 1) >= greatest((d.gx-l.gx)/l.gw, (d.gy-l.gy)/l.gh, 0) AS meets,
        l.gx+l.gw/2 BETWEEN d.gx AND d.gx+d.gw AND l.gy+l.gh/2 BETWEEN d.gy AND d.gy+d.gh AS holds,
        list_min(list_transform([[l.gx, l.gy], [l.gx+l.gw, l.gy+l.gh]], lambda p: sqrt(pow(greatest(d.gx-p[1], p[1]-d.gx-d.gw, 0), 2) + pow(greatest(d.gy-p[2], p[2]-d.gy-d.gh, 0), 2)))
          || list_transform([[d.gx, d.gy], [d.gx+d.gw, d.gy], [d.gx, d.gy+d.gh], [d.gx+d.gw, d.gy+d.gh]], lambda p: sqrt(pow(p[1]-l.gx-least(greatest(((p[1]-l.gx)*l.gw+(p[2]-l.gy)*l.gh)/(l.gw*l.gw+l.gh*l.gh), 0), 1)*l.gw, 2)
            + pow(p[2]-l.gy-least(greatest(((p[1]-l.gx)*l.gw+(p[2]-l.gy)*l.gh)/(l.gw*l.gw+l.gh*l.gh), 0), 1)*l.gh, 2)))) AS gap FROM feat l JOIN feat d ON d.sample_id = l.sample_id AND l.layer = 1 AND d.layer = 2),
    one AS (SELECT sample_id, district AS a, line AS b, 'HYP_DISTRICT_EDGE' AS tag FROM cut JOIN kind USING (sample_id) WHERE node_id = line AND type = 'Edge' AND (meets OR gap < 1e-2)
      UNION ALL SELECT sample_id, district, line, 'HYP_DISTRICT_PATH' FROM cut WHERE meets OR holds
      UNION ALL SELECT l.sample_id, src, dst, 'HYP_PATH_LANDMARK' FROM lined l JOIN kind p ON p.sample_id = l.sample_id AND p.node_id = src JOIN kind q ON q.sample_id = l.sample_id AND q.node_id = dst WHERE d < 1e-1 AND p.type = 'Landmark' AND q.type = 'Path'
      UNION ALL SELECT sample_id, src, dst, 'HYP_PATH_NODE' FROM lined WHERE d < 1e-1),
    turned AS (SELECT *, cos(t) AS cos_t, sin(t) AS sin_t, {_SECTOR} AS sector, 1e0 AS w, 6e-1 AS part FROM (SELECT e.sample_id, src, dst, e.tag AS name, 'SSG' AS tag, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) / a.scale + 1e-6 AS d,
        atan2(b.y-a.y, b.x-a.x) - coalesce(a.dir, 0) AS t FROM (SELECT sample_id, a AS src, b AS dst, tag FROM one UNION ALL SELECT sample_id, b, a, tag FROM one) e JOIN nn a ON a.sample_id = e.sample_id AND a.node_id = src JOIN nn b ON b.sample_id = e.sample_id AND b.node_id = dst))
    SELECT sample_id, src, dst, name AS tag, {_ATTR} AS attr FROM turned"""


@register("hyper_edges", _HYPER, "edges")
def _(spark, d):
    return graph.hyper_edges(_normal(spark, d)[0]).select("sample_id", "src", "dst", "tag", _round_each("attr", 5).alias("attr"))


@register("knn_grid", "SELECT sample_id, i, j, rk, round(d, 6) AS d FROM knn", "knn")
def _(spark, d):
    return _rounded(S.knn_grid(views.nodes(spark, d)), "d")


@register("soft_topology_cells", "SELECT sample_id, src, dst, tag, round(w, 6) AS w FROM soft", "soft")
def _(spark, d):
    return _rounded(T.soft_topology_edges(_normal(spark, d)[0], method="cells"), "w")


_BENT = """SELECT event_id, list_transform(CASE WHEN layer = 1 THEN [sqrt(w*w+h*h)/(w+h), 1 - sqrt(w*w+h*h)/(w+h), 0e0, 0e0]
    ELSE [4 * pi() * 75e-2 * w * h / pow(2 * (w + h), 2), 75e-2, 6e0 / 7, 5e0 * pi() / 6 / (5e0 * pi() / 2 + 1e-6)] END, lambda v: round(v, 5) + 0e0) AS shape FROM base WHERE layer > 0"""


@register("shape_descriptors", _BENT, "base")
def _(spark, d):
    return views.bent(spark, d).select("event_id", _round_each(H.shape_descriptors(F.col("type"), F.col("geom")), 5).alias("shape"))


@register("coords_descriptors", _BENT, "base")
def _(spark, d):
    ring = F.col("geom.parts")[0]
    lines = F.concat(H.coords_line_descriptors(ring), F.array(F.lit(0.0), F.lit(0.0)))
    return views.bent(spark, d).select("event_id", _round_each(F.when(F.col("layer") == 1, lines).otherwise(H.coords_polygon_descriptors(ring)), 5).alias("shape"))


@register("polygon_hulls", "SELECT event_id, 75e-2 AS rectangularity, round(6e0 / 7, 6) AS convexity, round(5e0 * pi() / 6 / (5e0 * pi() / 2 + 1e-6), 6) AS turning FROM base WHERE layer = 2", "base")
def _(spark, d):
    g = F.col("geom")
    got = views.bent(spark, d).where("layer = 2").select("event_id", H.polygon_rectangularity(g).alias("rectangularity"), H.polygon_convexity(g).alias("convexity"), H.turning_function_fd(g).alias("turning"))
    return _rounded(got, "rectangularity", "convexity", "turning")


@register("line_polygon_relation", """SELECT sample_id, line, poly, round(sqrt(ox*ox + oy*oy), 6) AS centroid_distance, ox + oy = 0 AS contains_centroid, meets AS intersects, round(CASE WHEN meets THEN 0e0 ELSE gap END, 6) AS distance
    FROM (SELECT l.sample_id, l.node_id AS line, p.node_id AS poly, greatest(p.ax - l.x, l.x - p.ax - p.w, 0) AS ox, greatest(p.ay - l.y, l.y - p.ay - p.h, 0) AS oy,
        least((p.ax+p.w-l.ax)/l.w, (p.ay+p.h-l.ay)/l.h, 1) >= greatest((p.ax-l.ax)/l.w, (p.ay-l.ay)/l.h, 0) AS meets,
        list_min(list_transform([[l.ax, l.ay], [l.ax+l.w, l.ay+l.h]], lambda q: sqrt(pow(greatest(p.ax-q[1], q[1]-p.ax-p.w, 0), 2) + pow(greatest(p.ay-q[2], q[2]-p.ay-p.h, 0), 2)))
          || list_transform([[p.ax, p.ay], [p.ax+p.w, p.ay], [p.ax, p.ay+p.h], [p.ax+p.w, p.ay+p.h]], lambda q: sqrt(pow(q[1]-l.ax-least(greatest(((q[1]-l.ax)*l.w+(q[2]-l.ay)*l.h)/(l.w*l.w+l.h*l.h), 0), 1)*l.w, 2)
            + pow(q[2]-l.ay-least(greatest(((q[1]-l.ax)*l.w+(q[2]-l.ay)*l.h)/(l.w*l.w+l.h*l.h), 0), 1)*l.h, 2)))) AS gap
      FROM nodes l JOIN nodes p ON l.sample_id = p.sample_id AND l.layer = 1 AND p.layer = 2)""", "nodes")
def _(spark, d):
    n = views.nodes(spark, d)
    lines = n.where("layer = 1").select("sample_id", F.col("node_id").alias("line"), F.col("geom").alias("l"))
    polys = n.where("layer = 2").select("sample_id", F.col("node_id").alias("poly"), F.col("geom").alias("p"))
    both = lines.join(polys, "sample_id").withColumns({"r": H.line_polygon_relation(F.col("l"), F.col("p")), "c": H.line_centroid(F.col("l"))})
    gap = F.round(G.point_polygon_distance(F.col("c.x"), F.col("c.y"), F.col("p")), 6)
    return both.select("sample_id", "line", "poly", gap.alias("centroid_distance"), F.col("r.contains_centroid"), F.col("r.intersects"), F.round("r.distance", 6).alias("distance"))


@register("relative_sector", f"""SELECT sample_id, i, j, round(cos(t), 5) + 0e0 AS cos_t, round(sin(t), 5) + 0e0 AS sin_t, {_SECTOR} % 8 AS wrap, {_SECTOR} AS clip FROM (
    SELECT k.sample_id, i, j, atan2(b.y-a.y, b.x-a.x) - coalesce(a.dir, 0) AS t FROM knn k JOIN nodes a ON a.sample_id = k.sample_id AND a.node_id = i JOIN nodes b ON b.sample_id = k.sample_id AND b.node_id = j)""", "knn")
def _(spark, d):
    n = views.nodes(spark, d)
    ends = S._ends(S.knn(n), n)
    zero = F.coalesce("dir_i", F.lit(0.0))
    a, b = (C.relative_sector(F.col("dx"), F.col("dy"), zero, edge=e) for e in ("wrap", "clip"))
    return ends.select("sample_id", "i", "j", (F.round(a["cos"], 5) + 0.0).alias("cos_t"), (F.round(a["sin"], 5) + 0.0).alias("sin_t"), a["sector"].alias("wrap"), b["sector"].alias("clip"))


@register("jitter")
def _(spark, d):
    return A.jitter(views.nodes(spark, d)).select("sample_id", "node_id", "x", "y")


@register("elastic_deform")
def _(spark, d):
    return A.elastic_deform(views.nodes(spark, d)).select("sample_id", "node_id", "x", "y")


@register("contrastive_views")
def _(spark, d):
    return A.contrastive_views(views.nodes(spark, d)).select("sample_id", "view", "node_id", "x", "y")


_WAVE = "sin(6.283185307179586e0 * (x * {u} / (sqrt({u}*{u} + {v}*{v}) + 1e-6) + y * {v} / (sqrt({u}*{u} + {v}*{v}) + 1e-6) + {p})) * {w} / (sqrt({u}*{u} + {v}*{v}) + 1e-6) * 5e-2"
_WAVES = [{"u": "cos(sample_id * 3e-1)", "v": "sin(sample_id * 3e-1)", "p": "(sample_id % 10) * 1e-1"}, {"u": "(sample_id % 5 - 2e0)", "v": "(sample_id % 3 + 1e0)", "p": "25e-2"}]


@register("elastic_waves", "SELECT sample_id, node_id, " + ", ".join(f"round({c} + {' + '.join(_WAVE.format(w=k[d], **k) for k in _WAVES)}, 6) AS {c}" for c, d in (("x", "u"), ("y", "v"))) + " FROM nodes", "nodes")
def _(spark, d):
    waves = [tuple(F.expr(k[c]) for c in "uvp") for k in _WAVES]
    return _rounded(A.elastic_deform(views.nodes(spark, d), 0.0, 0.05, waves=waves).select("sample_id", "node_id", "x", "y"), "x", "y")


# the drawn angles keep every node's distance from the origin; given ones turn it to a stated place
@register("contrastive_norms", "SELECT sample_id, view, node_id, round(sqrt(x*x + y*y), 6) AS norm, true AS turned_together FROM nodes, (SELECT unnest([1, 2]) AS view)", "nodes")
def _(spark, d):
    n = views.nodes(spark, d).withColumns({"x0": F.col("x"), "y0": F.col("y")})
    got = A.contrastive_views(n, 0.0)
    c, s = (F.col("x") * F.col("x0") + F.col("y") * F.col("y0")), (F.col("y") * F.col("x0") - F.col("x") * F.col("y0"))
    size = F.hypot("x", "y")
    got = got.withColumns({"norm": F.round(size, 6), "c": c / size / size, "s": s / size / size})
    same = got.groupBy("sample_id", "view").agg(((F.max("c") - F.min("c") < 1e-6) & (F.max("s") - F.min("s") < 1e-6)).alias("turned_together"))
    return got.join(same, ["sample_id", "view"]).select("sample_id", "view", "node_id", "norm", "turned_together")


@register("contrastive_turns", """SELECT sample_id, view, node_id, round(x*cos(sample_id*1e-1 + view) - y*sin(sample_id*1e-1 + view), 6) AS x, round(x*sin(sample_id*1e-1 + view) + y*cos(sample_id*1e-1 + view), 6) AS y
    FROM nodes, (SELECT unnest([1, 2]) AS view)""", "nodes")
def _(spark, d):
    got = A.contrastive_views(views.nodes(spark, d), 0.0, theta=F.col("sample_id") * 0.1 + F.col("view"))
    return _rounded(got.select("sample_id", "view", "node_id", "x", "y"), "x", "y")


@register("mean_pool", "SELECT label AS sample_id, p, round(avg(v), 6) AS v FROM (SELECT label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL")
def _(spark, d):
    got = M.mean_pool(views.embeddings(spark, d)).select("sample_id", F.posexplode("vec").alias("p", "v"))
    return _rounded(got.withColumn("p", F.col("p").cast("long")), "v")


_POOL = """WITH pool AS (SELECT label AS s, list(v ORDER BY p) AS vec FROM (SELECT label, p, avg(v) AS v FROM (SELECT label, unnest(range(64)) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL) GROUP BY ALL) """


@register("cosine_pairs", _POOL + """SELECT a.s AS a, b.s AS b, round((list_cosine_similarity(a.vec, b.vec) + 1) / 2, 5) AS sim FROM pool a, pool b WHERE a.s % 2 = 0 AND b.s % 2 = 1""")
def _(spark, d):
    pool = M.mean_pool(views.embeddings(spark, d))
    return _rounded(M.cosine_pairs(pool.where("sample_id % 2 = 0"), pool.where("sample_id % 2 = 1"), rescale=True), "sim", digits=5)


@register("sample_assignment", _POOL + """, c AS (SELECT a.s AS a, b.s AS b, (list_cosine_similarity(a.vec, b.vec) + 1) / 2 AS sim FROM pool a, pool b WHERE a.s % 2 = 0 AND b.s % 2 = 1),
    p AS (SELECT x.a AS a0, x.b AS b0, y.a AS a1, y.b AS b1, z.a AS a2, z.b AS b2, u.a AS a3, u.b AS b3, v.a AS a4, v.b AS b4, x.sim + y.sim + z.sim + u.sim + v.sim AS total FROM c x, c y, c z, c u, c v
      WHERE x.a = 0 AND y.a = 2 AND z.a = 4 AND u.a = 6 AND v.a = 8 AND len(list_distinct([x.b, y.b, z.b, u.b, v.b])) = 5), best AS (SELECT * FROM p ORDER BY total DESC LIMIT 1)
    SELECT c.a, c.b, 'A' AS group_a, 'B' AS group_b, round(sim, 5) AS sim FROM best, c WHERE (c.a, c.b) IN ((a0, b0), (a1, b1), (a2, b2), (a3, b3), (a4, b4))""")
def _(spark, d):
    sims = _sims(spark, d)
    return _rounded(N.sample_assignment(sims.withColumns({"group_a": F.lit("A"), "group_b": F.lit("B")})), "sim", digits=5)


_HOPS = 30


@register("shortest_path_costs", "WITH RECURSIVE " + ", ".join(f"{k} AS MATERIALIZED ({CTES[k]})" for k in _NAMES[:_NAMES.index("ssg") + 1]) + f""",
    line AS MATERIALIZED (SELECT e.sample_id, i AS a, j AS b, sqrt((x.xn-y.xn)*(x.xn-y.xn)+(x.yn-y.yn)*(x.yn-y.yn)) + 1e-6 AS l FROM (SELECT sample_id, i, j FROM ssg UNION SELECT sample_id, j, i FROM ssg) e
        JOIN nn x ON x.sample_id = e.sample_id AND x.node_id = i JOIN nn y ON y.sample_id = e.sample_id AND y.node_id = j),
    walk(sample_id, i, j, hop, d) AS (SELECT sample_id, node_id, node_id, 0, 0e0 FROM nodes
        UNION ALL SELECT sample_id, i, j, hop, min(d) FROM (SELECT sample_id, i, j, hop + 1 AS hop, d FROM walk WHERE hop < {_HOPS} UNION ALL SELECT w.sample_id, w.i, l.b, w.hop + 1, w.d + l.l FROM walk w JOIN line l ON l.sample_id = w.sample_id AND l.a = w.j WHERE hop < {_HOPS}) GROUP BY sample_id, i, j, hop),
    far AS (SELECT sample_id, i, j, d FROM walk WHERE hop = {_HOPS}),
    middle AS (SELECT sample_id, median(d) AS m FROM far WHERE d > 0 GROUP BY sample_id)
    SELECT a.sample_id, a.node_id AS i, b.node_id AS j, round(coalesce(d, 0) / m, 4) AS cost FROM nodes a JOIN nodes b USING (sample_id) JOIN middle USING (sample_id) LEFT JOIN far f ON f.sample_id = a.sample_id AND f.i = a.node_id AND f.j = b.node_id""")
def _(spark, d):
    n, near = _normal(spark, d)
    # one direction: paths go both ways along an edge
    one = S.ssg_edges(n, near=near).withColumnsRenamed({"i": "src", "j": "dst"})
    edges = S.edge_attributes(n.select("sample_id", "node_id", "x", "y", "dir", "scale"), one)
    strong = edges.select("sample_id", "src", "dst", (1 / F.col("d")).alias("w"))
    return _rounded(O.shortest_path_costs(strong, n), "cost", digits=4)


@register("dedupe_records", """SELECT sample, path FROM (SELECT user_id AS sample, event_type || '/' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS path FROM events) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY path DESC) = 1""")
def _(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return M.dedupe_records(ev.select(F.col("user_id").alias("sample"), F.concat_ws("/", "event_type", F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("path")))


@register("rotate", "SELECT sample_id, node_id, round(x*cos(sample_id*1e-1) - y*sin(sample_id*1e-1), 6) AS x, round(x*sin(sample_id*1e-1) + y*cos(sample_id*1e-1), 6) AS y FROM nodes", "nodes")
def _(spark, d):
    return _rounded(P.rotate(views.nodes(spark, d), F.col("sample_id") * 0.1).select("sample_id", "node_id", "x", "y"), "x", "y")


@register("anisotropic_scale", "SELECT sample_id, node_id, round(x * 1.1e0, 6) AS x, round(y * (9e-1 + (sample_id % 3) * 1e-1), 6) AS y FROM nodes", "nodes")
def _(spark, d):
    got = P.anisotropic_scale(views.nodes(spark, d), F.lit(1.1), F.lit(0.9) + (F.col("sample_id") % 3) * 0.1)
    return _rounded(got.select("sample_id", "node_id", "x", "y"), "x", "y")


@register("write_records", "SELECT sample_id, list(name ORDER BY node_id) AS name, list(type ORDER BY node_id) AS type, list(round(x, 5) ORDER BY node_id) AS x, list(round(y, 5) ORDER BY node_id) AS y, list(round(dir, 5) ORDER BY node_id) AS dir, 8 AS sectors, true AS use_relations FROM nodes GROUP BY sample_id", "nodes")
def _(spark, d):
    got = P.records(views.nodes(spark, d))
    return got.select("sample_id", *[(_round_each(f"nodes.{c}", 5) if c in ("x", "y", "dir") else F.col(f"nodes.{c}")).alias(c) for c in ("name", "type", "x", "y", "dir")], "sectors", "use_relations")


def _wkt(geom):
    ring = F.array_join(F.transform(geom["parts"][0], lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.when(geom["kind"] == "Polygon", F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).otherwise(F.concat(F.upper(geom["kind"]), F.lit(" ("), ring, F.lit(")")))


def _text_files(spark, files, root):
    """Write rows (path below the root, text) as a file each; the tasks open and name them, so nothing goes file by file through the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    uri = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toString()

    def put(rows):
        system, base = opened(uri)
        for r in rows:
            system.create_dir(f"{base}/{r.path.rsplit('/', 1)[0]}", recursive=True)
            with system.open_output_stream(f"{base}/{r.path}") as out:
                out.write(r.text.encode())

    files.select("path", "text").foreachPartition(put)
    return root


def _lines(rows, by, order, head):
    """The lines of each group in order, below a head, as one text."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy(*by).agg(F.concat(F.lit(head + "\n"), text, F.lit("\n")).alias("text"))


def _map_files(spark, d):
    """A folder of samples, with a file of each layer in each, as text."""
    line = F.format_string('%s,%s,"%s"', "name", "type", _wkt(F.col("geom")))
    files = _lines(views.features(spark, d).select("sample_id", "layer", "event_id", line.alias("line")), ["sample_id", "layer"], "event_id", "NAME,Type,geometry")
    return _text_files(spark, files.withColumn("path", F.format_string("s=Sample%s/l=%s/features.csv", F.col("sample_id").cast("string"), F.col("layer").cast("string"))), fresh(spark, "maps"))


@register("discover_samples", "SELECT 's=Sample' || sample_id AS sample_id FROM (SELECT DISTINCT sample_id FROM base) ORDER BY 1", "base")
def _(spark, d):
    return readers.discover_samples(spark, _map_files(spark, d)).select("sample_id")


@register("read_features", "SELECT 's=Sample' || sample_id AS sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY layer, event_id) - 1 AS INT) AS feature_seq, layer, trim(name) AS name, type, round(x, 5) AS x, round(y, 5) AS y FROM nodes", "nodes")
def _(spark, d):
    got = readers.read_features(spark, _map_files(spark, d), "csv").withColumn("p", G.representative_point(F.col("geom")))
    return got.select("sample_id", "feature_seq", "layer", F.trim("name").alias("name"), "type", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@register("read_realmap", """SELECT 'RealMap' AS sample_id, CAST(row_number() OVER (ORDER BY layer, event_id) - 1 AS INT) AS feature_seq, layer, trim(name) AS name, type, round(x, 5) AS x, round(y, 5) AS y FROM nodes""", "nodes")
def _(spark, d):
    one = views.features(spark, d).select("layer", "event_id", "name", "type", F.col("geom").alias("geometry"))
    root = fresh(spark, "realmap")
    one.repartition("layer").sortWithinPartitions("layer", "event_id").drop("event_id").write.partitionBy("layer").parquet(root)
    got = readers.read_realmap(spark, root).withColumn("p", G.representative_point(F.col("geom")))
    return got.select("sample_id", "feature_seq", "layer", F.trim("name").alias("name"), "type", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@register("read_relations", "SELECT 's=sample' || sample_id AS sample_id, trim(src_name) AS src_name, trim(dst_name) AS dst_name, rel_type FROM relations", "relations")
def _(spark, d):
    rows = views.relations(spark, d).select("sample_id", F.format_string("%s,%s,%s", "src_name", "dst_name", "rel_type").alias("line"))
    files = _lines(rows, ["sample_id"], F.lit(0).alias("at"), "SRC_NAME,Dst_name,rel_type")
    root = _text_files(spark, files.withColumn("path", F.format_string("s=sample%s/relations.csv", F.col("sample_id").cast("string"))), fresh(spark, "relations"))
    got = readers.read_relations(spark, root)
    return got.select("sample_id", F.trim("src_name").alias("src_name"), F.trim("dst_name").alias("dst_name"), "rel_type")


@register("read_records", "SELECT CAST(sample_id AS VARCHAR) AS sample, node_id, name, type, round(x, 5) AS x, round(y, 5) AS y, round(dir, 5) AS dir, 8 AS sectors FROM nodes", "nodes")
def _(spark, d):
    root = fresh(spark, "records")
    n = views.nodes(spark, d)
    P.write_records(n.withColumn("group_id", F.when(F.col("sample_id") % 2 == 0, "A").otherwise("B")), root)
    # one JSON object a line here, so lines are read one by one
    got = readers.read_records(spark, root, multi_line=False)
    return _rounded(got.select("sample", "node_id", "name", "type", "x", "y", "dir", "sectors"), "x", "y", "dir", digits=5)


_PAIRS = "SELECT a.user_id AS a, a.user_id + 1 AS b, (a.user_id * 37 % 101) / 1e2 AS label FROM (SELECT DISTINCT user_id FROM events) a JOIN (SELECT DISTINCT user_id FROM events) b ON b.user_id = a.user_id + 1"


def _pair_rows(spark, d):
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("a")).distinct()
    return users.join(users.select((F.col("a") - 1).alias("a")), "a").select("a", (F.col("a") + 1).alias("b"), (F.col("a") * 37 % 101 / 100.0).alias("label"))


@register("read_pairs", f"SELECT CAST(a AS VARCHAR) AS sample_a, CAST(b AS VARCHAR) AS sample_b, label, 1e0 AS weight FROM ({_PAIRS})")
def _(spark, d):
    root = fresh(spark, "pairs")
    _pair_rows(spark, d).toDF(" Sample_A", "SAMPLE_B ", "Label").write.option("header", True).csv(root)
    return readers.read_pairs(spark, root)


@register("concat_layers", "SELECT sample_id, event_id, CASE WHEN layer = 1 THEN w END AS w, CASE WHEN layer = 2 THEN h END AS h FROM base WHERE layer > 0", "base")
def _(spark, d):
    b = views.base(spark, d)
    return readers.concat_layers([b.where("layer = 1").select("sample_id", "event_id", "w"), b.where("layer = 2").select("sample_id", "event_id", "h")])


@register("write_reports", "SELECT sample_id, round(scale, 5) AS scale FROM (SELECT DISTINCT sample_id, scale FROM nn)", "nn")
def _(spark, d):
    report, root = _normal(spark, d)[0].select("sample_id", "scale").distinct(), fresh(spark, "report")
    P.write_reports(report, root, "csv")
    return spark.read.option("header", True).schema("sample_id BIGINT, scale DOUBLE").csv(root).withColumn("scale", F.round("scale", 5))


def _sims(spark, d):
    pool = M.mean_pool(views.embeddings(spark, d))
    return M.cosine_pairs(pool.where("sample_id % 2 = 0"), pool.where("sample_id % 2 = 1"), rescale=True)


@register("similarity_matrix", _POOL + "SELECT a, " + ", ".join(f'max(CASE WHEN b = {k} THEN sim END) AS "{k}"' for k in range(1, 10, 2)) + """ FROM (
    SELECT a.s AS a, b.s AS b, round((list_cosine_similarity(a.vec, b.vec) + 1) / 2, 5) AS sim FROM pool a, pool b WHERE a.s % 2 = 0 AND b.s % 2 = 1) GROUP BY a""")
def _(spark, d):
    return P.similarity_matrix(_rounded(_sims(spark, d), "sim", digits=5))


@register("group_fidelity", _POOL + """SELECT 'even' AS group_a, 'odd' AS group_b, round(avg((list_cosine_similarity(a.vec, b.vec) + 1) / 2), 5) AS fidelity FROM pool a JOIN pool b ON b.s = a.s + 1 WHERE a.s % 2 = 0""")
def _(spark, d):
    pool = M.mean_pool(views.embeddings(spark, d))
    pairs = pool.where("sample_id % 2 = 0").select(F.col("sample_id").alias("a"), (F.col("sample_id") + 1).alias("b"))
    sims = M.cosine_pairs(pool, pool, rescale=True, pairs=pairs).withColumns({"group_a": F.lit("even"), "group_b": F.lit("odd")})
    return _rounded(P.group_fidelity(sims), "fidelity", digits=5)


def _looked_up(spark, d):
    pool = M.mean_pool(views.embeddings(spark, d))
    pairs = pool.select(F.col("sample_id").alias("sample_a"), (F.col("sample_id") + 1).alias("sample_b"))
    return M.pair_lookup(pairs, pool)


@register("pair_lookup", _POOL + """SELECT a.s AS sample_a, a.s + 1 AS sample_b, list_transform(a.vec, lambda v: round(v, 5) + 0e0) AS ga, list_transform(b.vec, lambda v: round(v, 5) + 0e0) AS gb FROM pool a LEFT JOIN pool b ON b.s = a.s + 1""")
def _(spark, d):
    return _looked_up(spark, d).withColumns({c: _round_each(c, 5) for c in ("ga", "gb")})


@register("pair_features", _POOL + """SELECT a.s AS sample_a, list_transform(a.vec || b.vec || list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])) || list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2]), lambda v: round(v, 5) + 0e0) AS x FROM pool a JOIN pool b ON b.s = a.s + 1""")
def _(spark, d):
    return _looked_up(spark, d).where("gb IS NOT NULL").select("sample_a", _round_each(C.pair_features(F.col("ga"), F.col("gb")), 5).alias("x"))


@register("topk_mismatches", _POOL + """, c AS (SELECT a.s AS i, b.s AS j, (list_cosine_similarity(a.vec, b.vec) + 1) / 2 AS w FROM pool a, pool b WHERE a.s % 2 = 0 AND b.s % 2 = 1)
    SELECT side, index, side || index AS name, round(w, 5) AS best_coupling FROM (SELECT 'a' AS side, i AS index, max(w) AS w FROM c GROUP BY i UNION ALL SELECT 'b', j, max(w) FROM c GROUP BY j)
    QUALIFY row_number() OVER (PARTITION BY side ORDER BY w, index) <= 3""")
def _(spark, d):
    names = views.embeddings(spark, d).select(F.col("sample_id").alias("node_id"), F.lit(None).cast("string").alias("name")).distinct()
    return _rounded(P.topk_mismatches(_sims(spark, d).toDF("i", "j", "w"), names, names, 3), "best_coupling", digits=5)


@register("topk_node_mismatches", """WITH c AS (SELECT a.vec_id AS i, b.vec_id AS j, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 AS w FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label = 1)
    SELECT side, index, CASE WHEN index % 3 = 0 THEN side || index ELSE 'v' || index END AS name, round(w, 5) AS best_coupling
    FROM (SELECT 'a' AS side, i AS index, max(w) AS w FROM c GROUP BY i UNION ALL SELECT 'b', j, max(w) FROM c GROUP BY j)
    QUALIFY row_number() OVER (PARTITION BY side ORDER BY w, index) <= 20""")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("label", F.col("vec_id").alias("sample_id"), F.col("embedding").alias("vec"))
    sims = M.cosine_pairs(e.where("label = 0"), e.where("label = 1"), rescale=True)
    names = e.select(F.col("sample_id").alias("node_id"), F.when(F.col("sample_id") % 3 != 0, F.concat(F.lit("v"), F.col("sample_id").cast("string"))).alias("name"))
    return _rounded(P.topk_mismatches(sims.toDF("i", "j", "w"), names, names), "best_coupling", digits=5)


_Z = "WITH z AS (SELECT label, vec_id % 8 AS part, vec_id, embedding::DOUBLE[] AS v FROM embeddings) "


@register("nt_xent", _Z + """SELECT batch_id, round(avg(l), 5) AS loss FROM (SELECT a.label AS batch_id, a.vec_id, ln(sum(exp(list_cosine_similarity(a.v, list_reverse(b.v)) * 5)))
    - max(CASE WHEN a.vec_id = b.vec_id THEN list_cosine_similarity(a.v, list_reverse(b.v)) * 5 END) AS l FROM z a JOIN z b USING (label) GROUP BY ALL) GROUP BY batch_id""")
def _(spark, d):
    vec = F.col("vec").cast("array<double>")
    z = views.embeddings(spark, d).select(F.col("sample_id").alias("batch_id"), F.col("vec_id").alias("i"), vec.alias("z1"), F.reverse(vec).alias("z2"))
    return _rounded(L.nt_xent(z), "loss", digits=5)


@register("supcon", _Z + """, s AS (SELECT a.part, a.vec_id AS i, b.vec_id AS j, a.label = b.label AS same, list_cosine_similarity(a.v, b.v) * 5 AS s FROM z a JOIN z b USING (part)),
    t AS (SELECT part, i, ln(sum(CASE WHEN i <> j THEN exp(s - 5) ELSE 0 END) + 1e-9) AS e, sum(CASE WHEN i <> j AND same THEN s ELSE 0 END) AS sp, sum(CASE WHEN i <> j AND same THEN 1 ELSE 0 END)::DOUBLE AS np FROM s GROUP BY ALL)
    SELECT part AS batch_id, round(-avg((sp - np * e) / (np + 1e-9)), 5) AS loss FROM t GROUP BY part""")
def _(spark, d):
    z = views.embeddings(spark, d).select((F.col("vec_id") % 8).alias("batch_id"), F.col("vec_id").alias("i"), F.col("vec").cast("array<double>").alias("z"), F.col("sample_id").alias("label"))
    return _rounded(L.supcon(z), "loss", digits=5)


@register("node_align_loss", """WITH e AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT round(avg(1 - list_cosine_similarity(a.v, b.v)), 6) AS loss FROM e a JOIN e b ON b.label = a.label + 1 AND b.i = a.i""")
def _(spark, d):
    e = views.embeddings(spark, d).withColumn("vec", F.col("vec").cast("array<double>"))
    pairs = e.select(F.col("sample_id").alias("sample_a"), F.col("node_id").alias("i"), (F.col("sample_id") + 1).alias("sample_b"), F.col("node_id").alias("j"))
    return _rounded(L.node_align_loss(e, e, pairs), "loss")


_SCORED = "(SELECT event_id % 9 / 2e0 - 2e0 AS logit, event_id * 37 % 101 / 1e2 AS label FROM events)"


def _scored(spark, d, label=None):
    e = F.col("event_id")
    return spark.read.parquet(f"{d}/events.parquet").select((e % 9 / 2.0 - 2.0).alias("logit"), (e * 37 % 101 / 100.0 if label is None else label).alias("label"))


@register("pair_loss", f"""WITH s AS (SELECT *, 1 / (1 + exp(-logit)) AS s FROM {_SCORED})
    SELECT 'bce' AS kind, round(avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))), 6) AS loss FROM s UNION ALL SELECT 'mse', round(avg((s - label) * (s - label)), 6) FROM s
    UNION ALL SELECT 'margin', round(avg(CASE WHEN label > 5e-1 THEN greatest(2e-1 - s, 0) ELSE greatest(s - 8e-1, 0) END), 6) FROM s""")
def _(spark, d):
    s = _scored(spark, d)
    return _rounded(L.pair_loss(s).unionByName(L.pair_loss(s, "mse")).unionByName(L.pair_loss(s, "margin")), "loss")


_NEWTON = 30
_G = f"g AS MATERIALIZED (SELECT logit AS x, count(*)::DOUBLE AS n, sum(CASE WHEN label > 5e-1 THEN 1e0 ELSE 0e0 END) AS k FROM {_SCORED} GROUP BY logit)"
_TREND = "(event_id * 37 % 101 + event_id % 9 * 12 - (event_id % 9 + 1) % 3 * 20) / 1e2"  # rises with the logit, but not at every step: flat labels would leave the blocks to the last bit


# Newton steps of the penalized log likelihood over the counts of each logit
@register("fit_platt", f"""WITH RECURSIVE {_G}, step(it, a, b) AS (SELECT 0, 0e0, 0e0 UNION ALL
    SELECT it + 1, a - (h22 * ga - h12 * gb) / (h11 * h22 - h12 * h12), b - (h11 * gb - h12 * ga) / (h11 * h22 - h12 * h12) FROM (
      SELECT it, a, b, sum((n * p - k) * x) + a AS ga, sum(n * p - k) AS gb, sum(n * p * (1 - p) * x * x) + 1 AS h11, sum(n * p * (1 - p) * x) AS h12, sum(n * p * (1 - p)) AS h22
      FROM (SELECT it, a, b, x, n, k, 1 / (1 + exp(-(a * x + b))) AS p FROM step, g WHERE it < {_NEWTON}) GROUP BY it, a, b))
    SELECT round(a, 5) AS coef, round(b, 5) AS intercept FROM step WHERE it = {_NEWTON}""")
def _(spark, d):
    return _rounded(P.fit_platt(_scored(spark, d)), "coef", "intercept", digits=5)


# the fit at x is the greatest, over all starts up to x, of the least mean up to an end from x on
@register("fit_isotonic", f"""WITH g AS (SELECT event_id % 9 / 2e0 - 2e0 AS x, count(*)::DOUBLE AS n, avg({_TREND}) AS m FROM events GROUP BY ALL), means AS (SELECT j.x AS a, k.x AS z, sum(g.n * g.m) / sum(g.n) AS m FROM g j JOIN g k ON j.x <= k.x JOIN g ON g.x BETWEEN j.x AND k.x GROUP BY ALL),
    least AS (SELECT x, a, min(means.m) AS m FROM g JOIN means ON a <= x AND z >= x GROUP BY ALL), fit AS (SELECT x, round(max(m), 12) AS y FROM least GROUP BY x)
    SELECT DISTINCT unnest([min(x), max(x)]) AS x, round(y, 6) AS y FROM fit GROUP BY fit.y""")
def _(spark, d):
    return _rounded(P.fit_isotonic(_scored(spark, d, F.expr(_TREND))), "y")
