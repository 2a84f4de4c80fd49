"""Registered queries, each next to the SQL that gives the same rows.

A query names the operator it runs; doubles are rounded alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom, scalars
from ..operators import candidates as C
from ..operators import coverage as K
from ..operators import crosscheck as X
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import labelled as L
from ..operators import metrics as M
from ..operators import raster as R
from ..operators import spatial as S
from ..operators import split as P
from ..operators import stats as T
from ..ship import ship
from ..store import stored
from ..sources import ways as W
from . import views as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *views: str, recursive: bool = False):
    """Register a query under its function's name, with its SQL over the named views."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = V.with_views(sql, *views, recursive=recursive) if views else sql
        return f

    return put


def rd(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, places))
    return df


def truth(spark, sf):
    return V.grid_nodes(spark, sf), V.grid_edges(spark, sf)


def proposal(spark, sf):
    return V.grid_nodes(spark, sf), V.grid_edges(spark, sf, drop=15)


# --- graphs -------------------------------------------------------------------------------------------


@query("SELECT graph_id, round(sum(length), 6) AS length, count(*) AS n_edges FROM bowed GROUP BY graph_id", "bowed")
def edge_length_total(spark, sf):
    return rd(G.total_length(V.grid_edges(spark, sf, bowed=True)), "length")


@query("SELECT degree, count(*) AS n FROM (SELECT n.graph_id, n.node, count(e.graph_id) AS degree FROM grid_nodes n LEFT JOIN (SELECT graph_id, u AS node FROM thin_edges UNION ALL SELECT graph_id, v FROM thin_edges) e ON n.graph_id = e.graph_id AND n.node = e.node GROUP BY ALL) GROUP BY degree", "thin_edges", "grid_nodes")
def node_degree_hist(spark, sf):
    return G.degrees(*proposal(spark, sf)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


_DEG = "--with d AS (SELECT n.graph_id, n.node, n.x, n.y, count(e.graph_id) AS degree FROM grid_nodes n LEFT JOIN (SELECT graph_id, u AS node FROM thin_edges UNION ALL SELECT graph_id, v FROM thin_edges) e ON n.graph_id = e.graph_id AND n.node = e.node GROUP BY ALL) "


@query(_DEG + "SELECT graph_id, count(*) AS n FROM d WHERE degree >= 3 GROUP BY graph_id", "thin_edges", "grid_nodes")
def junctions_deg3(spark, sf):
    return G.junctions(*proposal(spark, sf)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


@query(_DEG + "SELECT graph_id, node, x, y FROM d WHERE degree = 1 AND x >= 50 AND x <= 349 AND y >= 0 AND y <= 349", "thin_edges", "grid_nodes")
def endpoints_interior(spark, sf):
    e = G.endpoints(*proposal(spark, sf))
    return e.where(scalars.interior(F.col("x"), F.col("y"), F.lit(400), F.lit(400), 50) | ((F.col("y") < 50) & (F.col("x") >= 50) & (F.col("x") <= 349))).select("graph_id", "node", "x", "y")


@query("SELECT graph_id, edge, k, round(k * length / 3, 6) AS s FROM bowed, range(1, 3) t(k) WHERE edge % 3 = 0", "bowed")
def densify_control_points(spark, sf):
    return rd(G.control_points(V.grid_edges(spark, sf, bowed=True), 50.0).select("graph_id", "edge", (F.col("k") + 1).cast("long").alias("k"), "s"), "s")


@query("--with b AS (SELECT graph_id, length, CASE WHEN edge % 3 = 0 THEN sqrt(100.0 * 100.0 + 40.0 * 40.0) ELSE 100.0 END AS diagonal FROM bowed), k AS (SELECT graph_id, length, CASE WHEN abs(diagonal - length) / length < 0.012 OR length < 37.5 THEN 1 WHEN length <= 50 THEN 2 ELSE CAST(ceil(length / 50) AS BIGINT) END AS pieces FROM b) SELECT graph_id, CAST(sum(pieces) AS BIGINT) AS n_edges, CAST(16 + sum(pieces - 1) AS BIGINT) AS n_nodes, round(sum(length), 6) AS length FROM k GROUP BY graph_id", "bowed")
def densify_graph(spark, sf):
    n, e = G.densify(V.grid_nodes(spark, sf), V.grid_edges(spark, sf, bowed=True), 50.0)
    a = rd(G.total_length(e), "length")
    return a.join(n.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes")), "graph_id")


@query("""--with ends AS (SELECT graph_id, edge, side, CAST(round_even(x / 1.0, 0) AS BIGINT) AS kx, CAST(round_even(y / 1.0, 0) AS BIGINT) AS ky
 FROM (SELECT graph_id, edge, 0 AS side, u % 4 * 100.0::DOUBLE + edge % 2 * 0.3 AS x, (u // 4) * 100.0::DOUBLE AS y FROM thin_edges UNION ALL SELECT graph_id, edge, 1, v % 4 * 100.0::DOUBLE + edge % 2 * 0.3, (v // 4) * 100.0::DOUBLE FROM thin_edges)),
 firsts AS (SELECT graph_id, kx, ky, min(edge * 2 + side) AS f FROM ends GROUP BY ALL),
 ids AS (SELECT graph_id, kx, ky, row_number() OVER (PARTITION BY graph_id ORDER BY f) - 1 AS node FROM firsts)
 SELECT e.graph_id, e.edge, max(CASE WHEN side = 0 THEN node END) AS u, max(CASE WHEN side = 1 THEN node END) AS v FROM ends e JOIN ids USING (graph_id, kx, ky) GROUP BY ALL""", "thin_edges")
def build_fuse_endpoints(spark, sf):
    e = V.grid_edges(spark, sf, drop=15)
    lines = e.select("graph_id", F.col("edge").alias("line"), F.transform("pts", lambda p: geom.point(p["x"] + F.col("edge") % 2 * 0.3, p["y"])).alias("pts"))
    return G.build(lines, tolerance=1.0)[1].select("graph_id", "edge", "u", "v")


@query("SELECT a.graph_id, a.node AS a, b.node AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM points a JOIN points b ON a.graph_id = b.graph_id AND a.node < b.node WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 75 * 75", "points")
def radius_pairs(spark, sf):
    return rd(S.radius_pairs(V.points(spark, sf), 75.0), "distance")


_NEAR = """--with seg AS (SELECT graph_id, edge, u, v, u % 4 * 100.0::DOUBLE AS ax, (u // 4) * 100.0::DOUBLE AS ay, v % 4 * 100.0::DOUBLE AS bx, (v // 4) * 100.0::DOUBLE AS b_y FROM thin_edges),
 t AS (SELECT p.graph_id, p.node, p.x, p.y, s.edge, s.u, s.v, greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (b_y - ay)) / 10000.0)) AS t, ax, ay, bx, b_y FROM points p JOIN seg s USING (graph_id)),
 d AS (SELECT graph_id, node, edge, u, v, t * 100 AS arc, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (b_y - ay)) * (y - ay - t * (b_y - ay))) AS distance FROM t) """


@query(_NEAR + "SELECT graph_id, node, edge, round(arc, 6) AS arc, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node ORDER BY distance, edge) AS r FROM d WHERE distance <= 60) WHERE r = 1", "points", "thin_edges")
def nearest_edge(spark, sf):
    return rd(S.nearest_edge(V.points(spark, sf), V.grid_edges(spark, sf, drop=15), 60.0).select("graph_id", "node", "edge", "arc", "distance"), "arc", "distance")


@query(_NEAR + "SELECT graph_id, node, edge, round(arc, 6) AS arc, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node ORDER BY distance, edge) AS r FROM d WHERE distance <= 110 AND u <> node AND v <> node) WHERE r = 1", "points", "thin_edges")
def nearest_other_edge(spark, sf):
    return rd(S.nearest_edge(V.points(spark, sf), V.grid_edges(spark, sf, drop=15), 110.0, incident=False).select("graph_id", "node", "edge", "arc", "distance"), "arc", "distance")


@query(_DEG + "SELECT a.graph_id, a.node AS a, b.node AS b FROM d a JOIN d b ON a.graph_id = b.graph_id AND a.node < b.node AND a.degree = 1 AND b.degree = 1 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 150 * 150 AND NOT EXISTS (SELECT 1 FROM thin_edges e WHERE e.graph_id = a.graph_id AND e.u = a.node AND e.v = b.node)", "thin_edges", "grid_nodes")
def endpoint_pairs_anti(spark, sf):
    return G.endpoint_pairs(*proposal(spark, sf), 150.0).select("graph_id", "a", "b")


@query("""--with s AS (SELECT graph_id, u % 4 * 100.0 AS ax, (u // 4) * 100.0 AS ay, v % 4 * 100.0 AS bx, (v // 4) * 100.0 AS b_y FROM grid_edges), l AS (SELECT 50 + 100.0 * k AS x, -20.0 AS y0, 320.0 AS y1 FROM range(3) t(k))
 SELECT graph_id, count(*) AS n FROM s JOIN l ON ay = b_y AND least(ax, bx) < x AND x < greatest(ax, bx) AND y0 < ay AND ay < y1 GROUP BY graph_id""", "grid_edges")
def nonplanar_crossings(spark, sf):
    # three long lines x = 50, 150, 250 cross every horizontal edge without sharing a node
    e = V.grid_edges(spark, sf)
    ids = e.select("graph_id").distinct()
    extra = ids.select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select(
        "graph_id", (100 + F.col("k")).cast("long").alias("edge"), (200 + 2 * F.col("k")).cast("long").alias("u"), (201 + 2 * F.col("k")).cast("long").alias("v"),
        F.array(geom.point(50 + 100 * F.col("k"), -20.0), geom.point(50 + 100 * F.col("k"), 320.0)).alias("pts"),
    ).withColumn("length", F.lit(340.0))
    return S.crossing_pairs(e.unionByName(extra)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))


_PRUNE = """--with deg AS (SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, u AS node FROM stub_edges UNION ALL SELECT graph_id, v FROM stub_edges) GROUP BY ALL),
 kept AS (SELECT e.* FROM stub_edges e JOIN deg a ON a.graph_id = e.graph_id AND a.node = e.u JOIN deg b ON b.graph_id = e.graph_id AND b.node = e.v WHERE NOT (e.length < 20 AND (a.degree = 1 OR b.degree = 1))) """


@query(_PRUNE + "SELECT graph_id, edge, u, v, length FROM kept", "stub_edges")
def prune_spurs_once(spark, sf):
    return G.prune_once(*V.stubs(spark, sf), 20.0)[1].select("graph_id", "edge", "u", "v", "length")


@query("SELECT graph_id, count(*) AS n_edges, sum(length) AS length FROM (SELECT graph_id, length FROM thin_edges_l UNION ALL SELECT graph_id, length FROM stub_edges WHERE edge >= 24 AND length >= 20) GROUP BY graph_id".replace("thin_edges_l", "(SELECT graph_id, 100.0::DOUBLE AS length FROM thin_edges)"), "stub_edges")
def prune_spurs(spark, sf):
    n, e = V.stubs(spark, sf)
    return G.total_length(G.prune(n, e, 20.0)[1]).select("graph_id", "n_edges", "length")


@query("""--with recursive_edges AS (SELECT a.graph_id, a.node AS a, b.node AS b FROM points a JOIN points b ON a.graph_id = b.graph_id AND a.node <> b.node WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 70 * 70),
 reach(graph_id, node, seen) AS (SELECT graph_id, node, node FROM points UNION SELECT r.graph_id, r.node, e.b FROM reach r JOIN recursive_edges e ON r.graph_id = e.graph_id AND r.seen = e.a)
 SELECT graph_id, count(DISTINCT c) AS n_clusters FROM (SELECT graph_id, node, min(seen) AS c FROM reach GROUP BY ALL) GROUP BY graph_id""", "points", recursive=True)
def snap_clusters(spark, sf):
    n, e = G.snap(V.points(spark, sf), V.grid_edges(spark, sf), 70.0)
    return n.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_clusters"))


@query("""--with e AS (SELECT graph_id, u AS a, v AS b FROM thin_edges UNION ALL SELECT graph_id, v, u FROM thin_edges),
 reach(graph_id, node, seen) AS (SELECT graph_id, node, node FROM grid_nodes UNION SELECT r.graph_id, r.node, e.b FROM reach r JOIN e ON r.graph_id = e.graph_id AND r.seen = e.a)
 SELECT graph_id, node, min(seen) AS component FROM reach GROUP BY ALL""", "thin_edges", "grid_nodes", recursive=True)
def graph_components(spark, sf):
    return G.components(*proposal(spark, sf))


_PATHS = """--with et AS (SELECT 't' AS g, graph_id, u AS a, v AS b FROM grid_edges UNION ALL SELECT 't', graph_id, v, u FROM grid_edges UNION ALL SELECT 'p', graph_id, u, v FROM thin_edges UNION ALL SELECT 'p', graph_id, v, u FROM thin_edges),
 walk(g, graph_id, a, b, h) AS (SELECT DISTINCT g, graph_id, a, a, 0 FROM et UNION SELECT w.g, w.graph_id, w.a, e.b, w.h + 1 FROM walk w JOIN et e ON e.g = w.g AND e.graph_id = w.graph_id AND e.a = w.b WHERE w.h < 15),
 len AS (SELECT g, graph_id, a, b, min(h) * 100.0::DOUBLE AS l FROM walk GROUP BY ALL) """
_APLS = _PATHS + """, landed AS (SELECT DISTINCT g, graph_id, a AS node FROM et),
 pairs AS (SELECT s.graph_id, CASE s.g WHEN 't' THEN 'forward' ELSE 'backward' END AS direction, s.l AS la, o.l AS lb, x.node IS NOT NULL AND y.node IS NOT NULL AS landed FROM len s
  LEFT JOIN landed x ON x.graph_id = s.graph_id AND x.g <> s.g AND x.node = s.a LEFT JOIN landed y ON y.graph_id = s.graph_id AND y.g <> s.g AND y.node = s.b
  LEFT JOIN len o ON o.graph_id = s.graph_id AND o.g <> s.g AND o.a = s.a AND o.b = s.b WHERE s.a < s.b AND s.l >= 10),
 side AS (SELECT graph_id, direction, avg(CASE WHEN landed AND lb IS NOT NULL THEN 1 - least(1, abs(la - lb) / la) ELSE 0 END) AS score, count(*) AS n_pairs, count(*) FILTER (NOT landed) AS n_unlanded, count(*) FILTER (landed AND lb IS NULL) AS n_no_path FROM pairs GROUP BY ALL) """


@query(_PATHS + "SELECT graph_id, a, b, l AS length FROM len WHERE g = 'p' AND a < b", "grid_edges", "thin_edges", recursive=True)
def path_lengths(spark, sf):
    return G.path_lengths(*proposal(spark, sf))


@query(_APLS + "SELECT graph_id, direction, count(*) AS n, round(sum(la), 6) AS la FROM pairs GROUP BY ALL", "grid_edges", "thin_edges", recursive=True)
def apls_pairs(spark, sf):
    p = M.route_pairs(truth(spark, sf), proposal(spark, sf)).where("i is not null")
    return p.groupBy("graph_id", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("la"), 6).alias("la"))


@query(_APLS + "SELECT graph_id, round(f.score, 9) AS forward_score, round(b.score, 9) AS backward_score, round(CASE WHEN f.score + b.score = 0 THEN 0 ELSE 2 * f.score * b.score / (f.score + b.score) END, 9) AS apls FROM (SELECT * FROM side WHERE direction = 'forward') f JOIN (SELECT * FROM side WHERE direction = 'backward') b USING (graph_id)", "grid_edges", "thin_edges", recursive=True)
def apls_score(spark, sf):
    return rd(M.apls(truth(spark, sf), proposal(spark, sf)).select("graph_id", "forward_score", "backward_score", "apls"), "forward_score", "backward_score", "apls", places=9)


@query(_APLS + "SELECT graph_id, direction, n_pairs, n_unlanded, n_no_path FROM side", "grid_edges", "thin_edges", recursive=True)
def apls_decomposition(spark, sf):
    return M.score_pairs(M.route_pairs(truth(spark, sf), proposal(spark, sf))).select("graph_id", "direction", "n_pairs", "n_unlanded", "n_no_path")


@query(_APLS + "SELECT direction, round(sum(n_unlanded) / sum(n_pairs), 9) AS unlanded, round(sum(n_no_path) / sum(n_pairs), 9) AS no_path, round((sum(n_pairs) - sum(n_unlanded) - sum(n_no_path) - sum(score * n_pairs)) / sum(n_pairs), 9) AS length_error FROM side GROUP BY direction", "grid_edges", "thin_edges", recursive=True)
def snap_loss_shares(spark, sf):
    d = M.score_pairs(M.route_pairs(truth(spark, sf), proposal(spark, sf))).groupBy("direction").agg(*[F.sum(c).alias(c) for c in ("score_sum", "n_unlanded", "n_no_path", "n_pairs")])
    x = d.select("direction", scalars.loss_shares(F.col("score_sum"), F.col("n_unlanded"), F.col("n_no_path"), F.col("n_pairs")).alias("s"))
    return rd(x.select("direction", "s.*"), "unlanded", "no_path", "length_error", places=9)


_SHIFT = """WITH n AS (SELECT n AS node, n % 4 * 100.0::DOUBLE AS x, (n // 4) * 100.0::DOUBLE AS y FROM range(16) t(n)),
 p AS (SELECT 'forward' AS direction, node, x, y, greatest(x, 12) AS put, abs(greatest(x, 12) - x) AS off, 12.0 AS c0 FROM n UNION ALL SELECT 'backward', node, x + 12, y, least(x + 12, 300), abs(least(x + 12, 300) - x - 12), 0.0 FROM n),
 r AS (SELECT a.direction, abs(a.x - b.x) + abs(a.y - b.y) AS la, abs(a.y - b.y) + CASE WHEN a.y = b.y THEN abs(a.put - b.put) ELSE (SELECT min(abs(a.put - a.c0 - 100 * k) + abs(b.put - a.c0 - 100 * k)) FROM range(4) c(k)) END AS lb, greatest(a.off, b.off) AS off FROM p a JOIN p b ON a.direction = b.direction AND a.node < b.node),
 s AS (SELECT snap, direction, avg(CASE WHEN off <= snap THEN 1 - least(1, abs(la - lb) / la) ELSE 0 END) AS score FROM r, (VALUES (5.0::DOUBLE), (12.0), (25.0)) t(snap) GROUP BY ALL),
 h AS (SELECT snap, 2 * f.score * b.score / (f.score + b.score) AS apls FROM (SELECT * FROM s WHERE direction = 'forward') f JOIN (SELECT * FROM s WHERE direction = 'backward') b USING (snap)) """


@query(_SHIFT + "SELECT snap, round(apls, 6) AS apls, (SELECT count(*) FROM supplier) AS n FROM h")
def max_snap_sweep(spark, sf):
    t = truth(spark, sf)
    moved = V.grid_nodes(spark, sf).withColumn("x", F.col("x") + 12), V.grid_edges(spark, sf).withColumn("pts", geom.shifted(F.col("pts"), 12.0, 0.0))
    # shifted along x: nodes land on level edges, and those of the outer columns only if a point may move by 12
    out = None
    for snap in (5.0, 12.0, 25.0):
        s = M.apls(t, moved, max_snap=snap).groupBy().agg(F.round(F.avg("apls"), 6).alias("apls"), F.count(F.lit(1)).alias("n")).withColumn("snap", F.lit(snap))
        out = s if out is None else out.unionByName(s)
    return out.select("snap", "apls", "n")


_JUNCTION = """--with dt AS (SELECT n.graph_id, n.node, count(*) AS degree FROM grid_nodes n JOIN (SELECT graph_id, u AS node FROM grid_edges UNION ALL SELECT graph_id, v FROM grid_edges) e USING (graph_id, node) GROUP BY ALL),
 dp AS (SELECT n.graph_id, n.node, count(*) AS degree FROM grid_nodes n JOIN (SELECT graph_id, u AS node FROM thin_edges UNION ALL SELECT graph_id, v FROM thin_edges) e USING (graph_id, node) GROUP BY ALL),
 j AS (SELECT coalesce(t.graph_id, p.graph_id) AS graph_id, count(t.node) AS n_truth, count(p.node) AS n_proposal, count(*) FILTER (t.node IS NOT NULL AND p.node IS NOT NULL) AS matched, avg(CASE WHEN t.node IS NOT NULL AND p.node IS NOT NULL THEN CAST(t.degree = p.degree AS DOUBLE) END) AS agreement FROM (SELECT * FROM dt WHERE degree >= 3) t FULL JOIN (SELECT * FROM dp WHERE degree >= 3) p ON t.graph_id = p.graph_id AND t.node = p.node GROUP BY 1) """


@query(_JUNCTION + "SELECT graph_id, n_truth, n_proposal, matched, round(matched / n_proposal, 9) AS precision, round(matched / n_truth, 9) AS recall, round(2.0::DOUBLE * matched / (n_truth + n_proposal), 9) AS f1, round(agreement, 9) AS degree_agreement FROM j", "grid_nodes", "grid_edges", "thin_edges")
def junction_prf(spark, sf):
    j = M.junction_prf(truth(spark, sf), proposal(spark, sf), 10.0)
    return rd(j.select("graph_id", "n_truth", "n_proposal", "matched", "precision", "recall", "f1", "degree_agreement"), "precision", "recall", "f1", "degree_agreement", places=9)


_BUFFER = """--with m AS (SELECT e.graph_id, count(*) AS n, count(*) FILTER (t.edge IS NULL) AS gone, 10.0::DOUBLE AS b FROM grid_edges e LEFT JOIN thin_edges t ON e.graph_id = t.graph_id AND e.edge = t.edge GROUP BY e.graph_id),
 ends AS (SELECT e.graph_id, sum(CASE WHEN a.node IS NULL THEN 0 ELSE 10 END + CASE WHEN c.node IS NULL THEN 0 ELSE 10 END) AS tips FROM grid_edges e LEFT JOIN thin_edges t ON e.graph_id = t.graph_id AND e.edge = t.edge
  LEFT JOIN (SELECT DISTINCT graph_id, node FROM (SELECT graph_id, u AS node FROM thin_edges UNION ALL SELECT graph_id, v FROM thin_edges)) a ON a.graph_id = e.graph_id AND a.node = e.u
  LEFT JOIN (SELECT DISTINCT graph_id, node FROM (SELECT graph_id, u AS node FROM thin_edges UNION ALL SELECT graph_id, v FROM thin_edges)) c ON c.graph_id = e.graph_id AND c.node = e.v WHERE t.edge IS NULL GROUP BY e.graph_id) """


@query(_BUFFER + "SELECT m.graph_id, 1.0::DOUBLE AS precision, round(((n - gone) * 100 + coalesce(tips, 0)) / (n * 100.0), 6) AS recall FROM m LEFT JOIN ends USING (graph_id)", "grid_edges", "thin_edges")
def buffer_prf(spark, sf):
    b = M.buffer_prf(V.grid_edges(spark, sf), V.grid_edges(spark, sf, drop=15), 10.0)
    return rd(b.select("graph_id", "precision", "recall"), "precision", "recall")


# --- candidates ---------------------------------------------------------------------------------------


_CENSUS = (
    _PATHS
    + _DEG.replace("--with", ",")
    + """, pr AS (SELECT a.graph_id, a.node AS a, b.node AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap FROM d a JOIN d b ON a.graph_id = b.graph_id AND a.node < b.node AND a.degree = 1 AND b.degree = 1 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 150 * 150 AND NOT EXISTS (SELECT 1 FROM thin_edges e WHERE e.graph_id = a.graph_id AND e.u = a.node AND e.v = b.node)),
 seg AS (SELECT graph_id, edge, u, v, u % 4 * 100.0::DOUBLE AS ax, (u // 4) * 100.0::DOUBLE AS ay, v % 4 * 100.0::DOUBLE AS bx, (v // 4) * 100.0::DOUBLE AS b_y FROM thin_edges),
 foot AS (SELECT a.graph_id, a.node, a.x, a.y, s.edge, s.u, s.v, ax, ay, bx, b_y, greatest(0, least(1, ((a.x - ax) * (bx - ax) + (a.y - ay) * (b_y - ay)) / 10000.0)) AS t FROM d a JOIN seg s ON s.graph_id = a.graph_id WHERE a.degree = 1 AND s.u <> a.node AND s.v <> a.node),
 side AS (SELECT graph_id, node, edge, u, v, t * 100 AS arc, ax + t * (bx - ax) AS fx, ay + t * (b_y - ay) AS fy, sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (b_y - ay)) ** 2) AS gap FROM foot),
 ca AS (SELECT graph_id, 'edge' AS kind, node AS node_a, gap, NULL::BIGINT AS node_b, edge, u, v, arc, CAST(round(fx / 100) + 4 * round(fy / 100) AS BIGINT) AS target FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, node ORDER BY gap, edge) AS r FROM side WHERE gap <= 150) WHERE r = 1
  UNION ALL SELECT graph_id, 'endpoint', a, gap, b, NULL, NULL, NULL, NULL, b FROM pr),
 nu AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY kind, node_a, coalesce(node_b, edge)) - 1 AS cand FROM ca),
 fu AS (SELECT nu.*, t.l AS truth_dist, CASE WHEN kind = 'endpoint' THEN coalesce(p.l, CAST('inf' AS DOUBLE)) ELSE least(coalesce(pu.l, CAST('inf' AS DOUBLE)) + arc, coalesce(pv.l, CAST('inf' AS DOUBLE)) + greatest(100 - arc, 0)) END AS proposal_dist FROM nu
  JOIN len t ON t.g = 't' AND t.graph_id = nu.graph_id AND t.a = node_a AND t.b = target
  LEFT JOIN len p ON p.g = 'p' AND p.graph_id = nu.graph_id AND p.a = node_a AND p.b = node_b
  LEFT JOIN len pu ON pu.g = 'p' AND pu.graph_id = nu.graph_id AND pu.a = node_a AND pu.b = nu.u
  LEFT JOIN len pv ON pv.g = 'p' AND pv.graph_id = nu.graph_id AND pv.a = node_a AND pv.b = nu.v),
 cen AS (SELECT fu.*, s.snap, CASE WHEN truth_dist <= 1.5 * gap AND proposal_dist > 1.2 * truth_dist THEN 'positive' ELSE 'negative' END AS label FROM fu, (VALUES (5.0::DOUBLE), (30.0)) s(snap)) """
)


@query(_CENSUS + "SELECT graph_id, cand, kind, node_a, round(gap, 6) AS gap, snap, round(proposal_dist, 6) AS proposal_dist, round(truth_dist, 6) AS truth_dist, label FROM cen", "grid_edges", "thin_edges", "grid_nodes", recursive=True)
def endpoint_census(spark, sf):
    x = _labelled(spark, sf).select("graph_id", "cand", "kind", "node_a", "gap", "snap", "proposal_dist", "truth_dist", "label")
    return rd(x, "gap", "proposal_dist", "truth_dist")


def _labelled(spark, sf, snaps=(5.0, 30.0)):
    t, p = truth(spark, sf), proposal(spark, sf)
    c = C.endpoint_candidates(*p, 150.0)
    c = stored(spark, c, "candidates")
    c = C.proposal_distance(c, p[1], G.lengths_from(*p, c.select("graph_id", F.col("node_a").alias("node"))))
    d = C.truth_distances(t, c, list(snaps))
    return C.label(c.join(d, ["graph_id", "cand"]))


@query(_DEG + ", pr AS (SELECT a.graph_id, a.node AS a, b.node AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap FROM d a JOIN d b ON a.graph_id = b.graph_id AND a.node < b.node AND a.degree = 1 AND b.degree = 1 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 150 * 150 AND NOT EXISTS (SELECT 1 FROM thin_edges e WHERE e.graph_id = a.graph_id AND e.u = a.node AND e.v = b.node)) SELECT graph_id, a AS node_a, b AS node_b, round(gap, 6) AS gap, (abs(a % 4 - b % 4) + abs(a // 4 - b // 4)) * 100.0::DOUBLE AS truth_dist FROM pr", "thin_edges", "grid_nodes")
def candidate_truth_distance(spark, sf):
    x = _labelled(spark, sf, (5.0,)).where("kind = 'endpoint'")
    return rd(x.select("graph_id", "node_a", "node_b", "gap", "truth_dist"), "gap")


_LABELS = (
    _PATHS
    + _DEG.replace("--with", ",")
    + """, pr AS (SELECT a.graph_id, a.node AS a, b.node AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap FROM d a JOIN d b ON a.graph_id = b.graph_id AND a.node < b.node AND a.degree = 1 AND b.degree = 1 WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 150 * 150 AND NOT EXISTS (SELECT 1 FROM thin_edges e WHERE e.graph_id = a.graph_id AND e.u = a.node AND e.v = b.node)),
 lab AS (SELECT pr.*, s.snap, CASE WHEN t.l <= 1.5 * gap AND coalesce(p.l, CAST('inf' AS DOUBLE)) > 1.2 * t.l THEN 'positive' ELSE 'negative' END AS label FROM pr JOIN len t ON t.g = 't' AND t.graph_id = pr.graph_id AND t.a = pr.a AND t.b = pr.b LEFT JOIN len p ON p.g = 'p' AND p.graph_id = pr.graph_id AND p.a = pr.a AND p.b = pr.b, (VALUES (5.0::DOUBLE), (30.0)) s(snap)) """
)
_LV = ("grid_edges", "thin_edges", "grid_nodes")


def _ends(spark, sf):
    return _labelled(spark, sf).where("kind = 'endpoint'")


@query(_LABELS + 'SELECT x.label AS "from", y.label AS "to", count(*) AS n FROM lab x JOIN lab y ON x.graph_id = y.graph_id AND x.a = y.a AND x.b = y.b WHERE x.snap = 5 AND y.snap = 30 GROUP BY ALL', *_LV, recursive=True)
def label_transitions(spark, sf):
    return C.transitions(_ends(spark, sf), 5.0, 30.0)


@query(_LABELS + "SELECT snap, CAST(sum(p) AS BIGINT) AS n_positive, CAST(sum(n) AS BIGINT) AS n_rated, round(sum(p) / sum(n), 6) AS pooled, round(avg(p / n), 6) AS graph_mean FROM (SELECT snap, graph_id, count(*) FILTER (label = 'positive') AS p, count(*) AS n FROM lab GROUP BY ALL) GROUP BY snap", *_LV, recursive=True)
def candidate_rates(spark, sf):
    return rd(C.candidate_rates(_ends(spark, sf), ["snap"]), "pooled", "graph_mean")


@query(_LABELS + "SELECT radius, snap, count(*) AS n, count(*) AS n_endpoint, 0 AS n_edge, count(*) FILTER (label = 'positive') AS n_positive, 0 AS n_undeterminable, count(DISTINCT (graph_id, a)) AS n_sources, count(DISTINCT CASE WHEN label = 'positive' THEN (graph_id, a) END) AS n_positive_sources FROM lab JOIN (VALUES (105.0::DOUBLE), (150.0)) r(radius) ON gap <= radius GROUP BY radius, snap", *_LV, recursive=True)
def radius_census(spark, sf):
    return C.radius_census(_ends(spark, sf), T.grid(spark, radius=[105.0, 150.0]))


_RATIO = ", r AS (SELECT snap, CASE WHEN truth_dist > 0 AND proposal_dist < CAST('inf' AS DOUBLE) THEN proposal_dist / truth_dist END AS r FROM cen) "


@query(_CENSUS + _RATIO + "SELECT snap, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.9), 6) AS p90, round(avg(CASE WHEN r IS NOT NULL THEN CAST(r < 1.5 AS DOUBLE) END), 6) AS under_1_5, count(*) FILTER (r IS NULL) AS undefined FROM r GROUP BY snap", "grid_edges", "thin_edges", "grid_nodes", recursive=True)
def shortcut_ratios(spark, sf):
    return rd(C.shortcut_ratios(_labelled(spark, sf), ["snap"]), "p50", "p90", "under_1_5")


@query(
    _CENSUS
    + ", n AS (SELECT graph_id, count(*) AS n FROM d WHERE degree = 1 GROUP BY 1), k AS (SELECT radius, snap, graph_id, count(DISTINCT node_a) AS c, count(DISTINCT CASE WHEN label = 'positive' THEN node_a END) AS p FROM cen JOIN (VALUES (105.0::DOUBLE), (150.0)) r(radius) ON gap <= radius GROUP BY ALL),"
    " e AS (SELECT radius, snap, n.graph_id, n.n, coalesce(c, 0) AS c, coalesce(p, 0) AS p FROM n CROSS JOIN (VALUES (105.0::DOUBLE), (150.0)) r(radius) CROSS JOIN (VALUES (5.0::DOUBLE), (30.0)) s(snap) LEFT JOIN k USING (radius, snap, graph_id))"
    " SELECT radius, snap, count(*) AS n_chips, CAST(sum(n) AS BIGINT) AS interior, CAST(sum(c) AS BIGINT) AS with_candidate, CAST(sum(p) AS BIGINT) AS with_positive, round(avg(p), 6) AS positive_mean, median(p) AS positive_median, round(sum(c) / sum(n), 9) AS candidate_share, round(sum(p) / sum(n), 9) AS positive_share FROM e GROUP BY ALL",
    "grid_edges", "thin_edges", "grid_nodes", recursive=True,
)
def endpoint_reach(spark, sf):
    x = E.endpoint_coverage(_labelled(spark, sf), G.endpoints(*proposal(spark, sf)).select("graph_id", "node"), T.grid(spark, radius=[105.0, 150.0]))
    return rd(rd(x, "positive_mean"), "candidate_share", "positive_share", places=9)


@query(_CENSUS + "SELECT snap, count(*) AS n, count(truth_dist) AS determinable, count(*) FILTER (truth_dist = 0) AS zero_distance, count(*) FILTER (truth_dist > 0 AND truth_dist <= 1) AS coincident, 0::BIGINT AS chips_without_roads FROM cen WHERE gap <= 105 GROUP BY snap", "grid_edges", "thin_edges", "grid_nodes", recursive=True)
def label_diagnostics(spark, sf):
    t = truth(spark, sf)
    return E.label_diagnostics(_labelled(spark, sf), t, t[0], 105.0)


@query("--with j AS (SELECT s.*, p.value AS o FROM scores s JOIN scores p ON p.chip = s.chip AND p.arm = 'view') SELECT arm, tolerance, round(avg(CASE WHEN abs(value - o) <= tolerance THEN 1.0 ELSE 0.0 END), 9) AS share FROM j, (VALUES (2.0::DOUBLE), (5.0)) t(tolerance) GROUP BY ALL", "scores")
def agreement_shares(spark, sf):
    s = V.scores(spark, sf)
    o = s.where("arm = 'view'").select("chip", F.col("value").alias("_o"))
    d = s.join(o, "chip").select("arm", F.abs(F.col("value") - F.col("_o")).alias("distance"))
    return rd(X.agreement(d, ["arm"], [2.0, 5.0]), "share", places=9)


@query("SELECT l_linestatus AS source, count(*) FILTER (l_discount = 0) AS n_base, count(*) FILTER (l_discount = 0 AND l_tax > 0.04) AS n_converted, round(count(*) FILTER (l_discount = 0 AND l_tax > 0.04) / count(*) FILTER (l_discount = 0), 9) AS rate FROM lineitem GROUP BY 1")
def conversion_counts(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "source")
    return rd(X.conversion(li, ["source"], F.col("l_discount") == 0, F.col("l_tax") > 0.04), "rate", places=9)


@query()
def marginal_edges(spark, sf):
    t, p = truth(spark, sf), proposal(spark, sf)
    rows = C.endpoint_candidates(*p, 110.0).where("kind = 'endpoint'")
    return rd(C.marginal_edges(t, p, rows), "delta")


# --- rasters ------------------------------------------------------------------------------------------

_IOU = "SELECT coalesce(a.chip, b.chip) AS chip, count(*) FILTER (a.chip IS NOT NULL AND b.chip IS NOT NULL) AS both, count(*) AS either, round(count(*) FILTER (a.chip IS NOT NULL AND b.chip IS NOT NULL) / count(*), 9) AS iou FROM mask a FULL JOIN mask2 b ON a.chip = b.chip AND a.row = b.row AND a.col = b.col GROUP BY 1"


@query(_IOU, "mask", "mask2")
def mask_iou(spark, sf):
    return rd(M.iou(V.mask(spark, sf), V.mask(spark, sf, 7)), "iou", places=9)


@query("SELECT chip, count(*) AS n FROM (SELECT DISTINCT m.chip, m.row + a.i AS row, m.col + b.i AS col FROM mask m, range(-1, 2) a(i), range(-1, 2) b(i) WHERE m.row + a.i BETWEEN 0 AND 30 AND m.col + b.i BETWEEN 0 AND 30) GROUP BY chip", "mask")
def mask_dilate(spark, sf):
    m = V.mask(spark, sf)
    grids = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("chip"), F.lit(31).alias("height"), F.lit(31).alias("width"))
    return R.dilate(m, 1, grids).groupBy("chip").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n, count(*) AS pixels FROM (SELECT m.chip, m.row, m.col, count(o.chip) AS n FROM mask m LEFT JOIN mask o ON o.chip = m.chip AND abs(o.row - m.row) <= 1 AND abs(o.col - m.col) <= 1 AND NOT (o.row = m.row AND o.col = m.col) GROUP BY ALL) GROUP BY n", "mask")
def neighbour_counts(spark, sf):
    return R.neighbour_counts(V.mask(spark, sf)).groupBy("n").agg(F.count(F.lit(1)).alias("pixels"))


@query("SELECT chip, 30 - col AS row, 30 - row AS col FROM mask", "mask")
def dihedral_pixels(spark, sf):
    # a quarter turn and a flip
    return R.dihedral_pixels(V.mask(spark, sf), 31, 3).select("chip", (30 - F.col("row")).alias("_r"), "col").select("chip", (30 - F.col("_r")).alias("row"), "col")


@query("SELECT chip, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS purity, count(*) AS n FROM (SELECT p.graph_id AS chip, m.chip IS NOT NULL AS hit FROM grid_nodes p LEFT JOIN mask m ON m.chip = p.graph_id AND m.row = CAST(p.y / 10 AS INTEGER) AND m.col = CAST(p.x / 10 AS INTEGER)) GROUP BY chip", "mask", "grid_nodes")
def stub_purity(spark, sf):
    s = V.grid_nodes(spark, sf).select(F.col("graph_id").alias("chip"), (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"))
    return rd(R.purity(s, V.mask(spark, sf), ["chip"]), "purity", places=9)


@query("SELECT p.graph_id AS chip, p.node, round(sqrt(min((m.row - p.y / 10) ** 2 + (m.col - p.x / 10) ** 2)), 6) AS distance FROM grid_nodes p LEFT JOIN mask m ON m.chip = p.graph_id AND (m.row - p.y / 10) ** 2 + (m.col - p.x / 10) ** 2 <= 9 GROUP BY ALL", "mask", "grid_nodes")
def centreline_distance(spark, sf):
    s = V.grid_nodes(spark, sf).select(F.col("graph_id").alias("chip"), "node", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"))
    return rd(R.distance_within(s, V.mask(spark, sf), 3, ["chip", "node"]), "distance")


@query("SELECT m.chip, count(*) AS n FROM mask m WHERE NOT (m.row BETWEEN 5 AND 14 AND m.col BETWEEN 5 AND 14) GROUP BY m.chip", "mask")
def punch_gaps(spark, sf):
    m = V.mask(spark, sf)
    gaps = m.select("chip").distinct().select("chip", F.lit(5).alias("row0"), F.lit(5).alias("col0"), F.lit(10).alias("size"))
    return R.punch_gaps(m, gaps).groupBy("chip").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chip, count(*) AS n, sum(CASE WHEN ((col * 7 // 31) + (row * 5 // 31) * 7) % 2 = 0 THEN 1 ELSE 0 END) AS covered FROM mask GROUP BY chip", "mask")
def coverage_blocks(spark, sf):
    b = scalars.block_of(F.col("row"), F.col("col"), 31, 31, 5, 7)
    return V.mask(spark, sf).groupBy("chip").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(b % 2 == 0, 1).otherwise(0)).alias("covered"))


def _grids(spark, sf, n=31):
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("chip"), F.lit(n).alias("height"), F.lit(n).alias("width"))


_US = "CAST('0x' || substr(md5('7|{0}|' || chip), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
_PATTERN = f"--with g AS (SELECT DISTINCT chip FROM mask), a AS (SELECT chip, {_US.format('end')} AS u, {_US.format('inner')} AS v, {_US.format('angle')} * pi() AS angle, CAST(floor({_US.format('period')} * 33) AS INTEGER) + 16 AS period, {_US.format('phase')} AS ph FROM g), p AS (SELECT *, CASE WHEN u < 0.2 THEN 0.0 WHEN u < 0.4 THEN 1.0 ELSE 0.05 + v * 0.9 END AS share, ph * period AS phase FROM a) "


@query(_PATTERN + "SELECT m.chip, round(any_value(share), 9) AS share, count(*) AS n, count(*) FILTER (((col * cos(angle) + row * sin(angle) + phase) % period + period) % period < share * period) AS covered FROM mask m JOIN p USING (chip) GROUP BY m.chip", "mask")
def coverage_strips(spark, sf):
    x = K.covered(V.mask(spark, sf), K.patterns(_grids(spark, sf), {"mode": "strips"}, 7).withColumn("_s", F.col("share")))
    p = K.patterns(_grids(spark, sf), {"mode": "strips"}, 7).select("chip", F.round("share", 9).alias("share"))
    return x.groupBy("chip").agg(F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("covered")).join(p, "chip")


@query("--with r AS (SELECT chip, row, col, row_number() OVER (PARTITION BY chip ORDER BY CAST('0x' || substr(md5('3|gap|' || chip || '|' || row || '|' || col), 1, 13) AS BIGINT), row, col) AS r FROM mask), s AS (SELECT chip, row - 2 AS row0, col - 2 AS col0 FROM r WHERE r <= 4) SELECT m.chip, count(*) AS n FROM mask m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.chip = m.chip AND m.row BETWEEN row0 AND row0 + 4 AND m.col BETWEEN col0 AND col0 + 4) GROUP BY m.chip", "mask")
def drawn_gaps(spark, sf):
    m = V.mask(spark, sf)
    return R.punch_gaps(m, K.draw_gaps(m, 4, 3)).groupBy("chip").agg(F.count(F.lit(1)).alias("n"))


def _streets(spark, sf):
    """(truth, grids) of 4 x 4 street grids in chips of 110 pixels."""
    small = V.grid_nodes(spark, sf).withColumn("x", F.col("x") * 0.3 + 10).withColumn("y", F.col("y") * 0.3 + 10)
    e = V.grid_edges(spark, sf).withColumn("pts", F.transform("pts", lambda p: geom.point(p["x"] * 0.3 + 10, p["y"] * 0.3 + 10))).withColumn("length", F.col("length") * 0.3)
    return (small, e), _grids(spark, sf, 110)


def _scene(spark, sf):
    """(truth, its drawn mask, grids) of `_streets`."""
    t, grids = _streets(spark, sf)
    return t, stored(spark, R.draw_edges(t[1], grids, 2), "scene"), grids


_TIDY = (1.0, 8.0, 4.0)


@query()
def tile_evaluation(spark, sf):
    t, mask, grids = _scene(spark, sf)
    hurt = R.punch_gaps(mask, K.draw_gaps(mask, 6, 1, 3))
    x = E.evaluate_tiles(t, mask, stored(spark, hurt, "hurt"), grids, _TIDY)
    return rd(x, "mask_iou", "apls_raw", "apls_cleaned", "ceiling", "of_ceiling")


@query()
def gap_divergence(spark, sf):
    t, grids = _streets(spark, sf)
    x = E.divergence(t, R.draw_masks(t[1], grids, 2), grids, [0, 4, 12], [0, 1], 3, _TIDY)
    return rd(x.groupBy("gaps").agg(F.avg("iou").alias("iou"), F.avg("apls").alias("apls"), F.count(F.lit(1)).alias("n")), "iou", "apls")


@query()
def traced_graph(spark, sf):
    grids = V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("chip"), F.lit(320).alias("height"), F.lit(320).alias("width"))
    n, e = G.drawn_and_traced(V.grid_edges(spark, sf, drop=15), grids, 2)
    return rd(G.total_length(e), "length", places=3)


# --- ways ---------------------------------------------------------------------------------------------

_TAG = "coalesce(nullif(regexp_extract(coalesce(other_tags, ''), '(?:^|,)\"{0}\"=>\"([^\"]*)\"', 1), ''), '')"
_DRIVE = "NOT regexp_matches(highway, '{}') AND NOT regexp_matches({}, 'yes') AND NOT regexp_matches({}, 'private') AND NOT regexp_matches({}, 'no') AND NOT regexp_matches({}, 'no') AND NOT regexp_matches({}, '{}')".format(
    scalars.NETWORKS["drive"][0][1], *[_TAG.format(k) for k in ("area", "access", "motor_vehicle", "motorcar", "service")], scalars.NETWORKS["drive"][5][1]
)
_ALL = f"NOT regexp_matches(highway, '{scalars.NETWORKS['all'][0][1]}') AND NOT regexp_matches({_TAG.format('area')}, 'yes')"


@query(f"SELECT way, {_DRIVE} AS drive, {_ALL} AS every FROM ways", "ways")
def network_filter(spark, sf):
    w = V.ways(spark, sf)
    tags = {k: scalars.tag(F.col("other_tags"), k) for k in scalars.filter_tag_keys()}
    return w.select("way", scalars.network_mask(F.col("highway"), tags, "drive").alias("drive"), scalars.network_mask(F.col("highway"), tags, "all").alias("every"))


@query(f"SELECT way, {_TAG.format('access')} AS access, {_TAG.format('service')} AS service, {_TAG.format('lanes')} AS lanes FROM ways", "ways")
def tag_parse(spark, sf):
    return V.ways(spark, sf).select("way", *[scalars.tag(F.col("other_tags"), k).alias(k) for k in ("access", "service", "lanes")])


@query("SELECT CASE WHEN highway IN ('motorway') THEN 'motorway' WHEN highway = 'primary_link' THEN 'primary' WHEN highway IN ('residential', 'living_street') THEN 'residential' WHEN highway = 'unclassified' THEN 'unclassified' ELSE 'other' END AS klass, count(*) AS n, round(sum(length), 4) AS length FROM ways GROUP BY 1", "ways")
def class_shares(spark, sf):
    w = V.ways(spark, sf)
    return w.groupBy(scalars.road_class(F.col("highway")).alias("klass")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("length"), 4).alias("length"))


@query("--with a AS (SELECT highway, sum(length) AS s FROM ways WHERE size <= 30 AND highway <> 'track' GROUP BY 1), b AS (SELECT highway, sum(length) AS s FROM ways WHERE size > 20 AND highway <> 'trunk' GROUP BY 1), j AS (SELECT highway, coalesce(a.s, 0) AS t, coalesce(b.s, 0) AS o FROM a FULL JOIN b USING (highway)) SELECT highway, round(t, 4) AS truth, round(o, 4) AS other, round(o - t, 4) AS surplus, round(t / sum(t) OVER (), 9) AS truth_share, round(o / sum(o) OVER (), 9) AS other_share FROM j", "ways")
def tag_length_surplus(spark, sf):
    w = V.ways(spark, sf)
    x = T.tag_lengths(w.where("size <= 30 and highway <> 'track'"), w.where("size > 20 and highway <> 'trunk'"))
    return rd(rd(x, "truth", "other", "surplus", places=4), "truth_share", "other_share", places=9)


@query("SELECT count(*) AS n FROM ways WHERE size BETWEEN 10 AND 30 AND length + size >= 1200", "ways")
def bbox_prefilter(spark, sf):
    w = V.ways(spark, sf).select("way", F.col("size").cast("double").alias("minx"), F.col("size").cast("double").alias("maxx"), F.col("length").alias("miny"), (F.col("length") + F.col("size")).alias("maxy"))
    return W.in_box(w, (10.0, 1200.0, 30.0, 1e9)).agg(F.count(F.lit(1)).alias("n"))


_KLASS = "CASE WHEN highway = 'motorway' THEN 'motorway' WHEN highway = 'primary_link' THEN 'primary' WHEN highway IN ('residential', 'living_street') THEN 'residential' WHEN highway = 'unclassified' THEN 'unclassified' ELSE 'other' END"
_IN_TILE = ", t AS (SELECT graph_id, way, highway, least(x1, tx + 320) - greatest(x0, tx) AS dx, least(y1, ty + 320) - greatest(y0, ty) AS dy, greatest(x0, tx) AS ax, least(x1, tx + 320) AS bx, greatest(y0, ty) AS ay, least(y1, ty + 320) AS b_y, tx, ty FROM w JOIN world_tiles ON x1 >= tx AND x0 <= tx + 320 AND y1 >= ty AND y0 <= ty + 320)"
_WORLD = ("world_ways", "world_tiles")


@query(f"--with w AS (SELECT * FROM world_ways WHERE {_DRIVE}){_IN_TILE} SELECT graph_id, count(*) AS n, min(way) AS first_way FROM t GROUP BY 1", *_WORLD)
def tile_ways(spark, sf):
    x = W.tile_ways(V.world_ways(spark, sf), V.world_tiles(spark, sf), "drive")
    return x.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("osm_id").cast("long")).alias("first_way"))


@query(f"--with w AS (SELECT * FROM world_ways WHERE {_ALL}){_IN_TILE} SELECT graph_id, round(sum(dx + dy), 6) AS length, count(DISTINCT way) AS n_ways FROM t WHERE dx + dy > 1e-6 GROUP BY 1", *_WORLD)
def tile_graph_lengths(spark, sf):
    p = stored(spark, W.tile_pieces(V.world_ways(spark, sf), V.world_tiles(spark, sf), "all", pad=0.0), "pieces")
    n, e = G.build(p.select("graph_id", "line", "pts"), 1e-3)
    ways = p.groupBy("graph_id").agg(F.countDistinct("osm_id").alias("n_ways"))
    return rd(G.total_length(e).join(ways, "graph_id").select("graph_id", "length", "n_ways"), "length")


def _pieces(spark, sf):
    """Ways of one graph, whole."""
    return V.world_ways(spark, sf).select(F.lit("g").alias("graph_id"), F.col("osm_id").cast("long").alias("line"), "osm_id", "highway", "pts")


_SPOTS = f"--with p AS (SELECT way, {_KLASS} AS klass, x0, y0, x1, y1, 120.0::DOUBLE AS length, CAST(greatest(1, round_even(120 / 50.0, 0)) AS BIGINT) AS n FROM world_ways), s AS (SELECT way, klass, CAST(k AS INTEGER) AS k, x0 + (x1 - x0) * (k + 0.5) / n AS x, y0 + (y1 - y0) * (k + 0.5) / n AS y, length / n AS node_length FROM p, range(0, 2) t(k) WHERE k < n AND klass <> 'other') "


@query(_SPOTS + "SELECT way, klass, k, round(x, 6) AS x, round(y, 6) AS y, round(node_length, 6) AS node_length FROM s", "world_ways")
def labelled_nodes(spark, sf):
    x = L.chip_nodes(_pieces(spark, sf), 50.0)
    return rd(x.select(F.col("way").cast("long").alias("way"), "klass", "k", "x", "y", "node_length"), "x", "y", "node_length")


@query(_SPOTS + f", c AS (SELECT klass, count(*) AS n_nodes, count(DISTINCT way) AS n_ways, sum(node_length) AS length FROM s GROUP BY 1), e AS (SELECT unnest({list(scalars.CLASSES)!r}) AS klass) SELECT klass, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_ways, 0) AS n_ways, round(coalesce(length, 0), 6) AS length, round(coalesce(n_nodes, 0) / (SELECT count(*) FROM s), 9) AS share FROM e LEFT JOIN c USING (klass) UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT), 0, 0.0, round(sum(n) / (SELECT count(*) FROM s), 9) FROM p WHERE klass = 'other'", "world_ways")
def labelled_classes(spark, sf):
    p = _pieces(spark, sf)
    x = L.class_table(L.chip_nodes(p, 50.0), L.other_counts(p, 50.0)).select("klass", "n_nodes", "n_ways", "length", "share")
    return rd(rd(x, "length"), "share", places=9)


@query("SELECT way, CAST(greatest(1, round_even(length / 100.0, 0)) AS BIGINT) AS n FROM ways", "ways")
def chip_node_counts(spark, sf):
    return V.ways(spark, sf).select("way", L.span_count(F.col("length"), 100.0).alias("n"))


# --- splits -------------------------------------------------------------------------------------------

_BLOCK = "--with b AS (SELECT *, CAST(floor((x - min(x) OVER ()) / 1280) AS BIGINT) AS gx, CAST(floor((y - min(y) OVER ()) / 1280) AS BIGINT) AS gy FROM placement), k AS (SELECT *, dense_rank() OVER (ORDER BY gx, gy) - 1 AS block FROM b) "
_HOLD = _BLOCK + ", g AS (SELECT block, count(*) AS size FROM k GROUP BY block), o AS (SELECT *, (block * 7 + 3) % 11 AS ord FROM g), h AS (SELECT *, coalesce(sum(size) OVER (ORDER BY ord, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < greatest(CAST(round_even(sum(size) OVER () * 0.2, 0) AS BIGINT), 1) AS held FROM o), sp AS (SELECT k.*, CASE WHEN held THEN 'val' ELSE 'train' END AS side FROM k JOIN h USING (block)) "


def _blocks(spark, sf, buffer=None):
    p = V.placement(spark, sf)
    order = P.block_index(p, 1280.0).select(F.col("block").alias("group")).distinct().withColumn("ord", (F.col("group") * 7 + 3) % 11)
    return P.blocked(p, 0.2, 1280.0, order, buffer_m=buffer)


@query(_BLOCK + "SELECT sample_id, block FROM k", "placement")
def block_index(spark, sf):
    return P.block_index(V.placement(spark, sf), 1280.0).select("sample_id", "block")


@query(_HOLD + "SELECT sample_id, block, side FROM sp", "placement")
def hold_out_blocks(spark, sf):
    return _blocks(spark, sf).select("sample_id", "block", "side")


_BUF = _HOLD + ", bf AS (SELECT a.sample_id, a.pos, a.x, a.y, CASE WHEN a.side = 'train' AND EXISTS (SELECT 1 FROM sp b WHERE b.side = 'val' AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 < 500.0 * 500.0) THEN 'dropped' ELSE a.side END AS side FROM sp a) "


@query(_BUF + "SELECT side, count(*) AS n FROM bf GROUP BY side", "placement")
def buffered_drop(spark, sf):
    return _blocks(spark, sf, 500.0).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query(_BUF + "SELECT side, count(*) AS n, sha256(string_agg(sample_id, chr(10) ORDER BY pos)) AS digest FROM bf GROUP BY side", "placement")
def split_digest(spark, sf):
    return P.side_digest(_blocks(spark, sf, 500.0))


@query(_BUF + ", n AS (SELECT w.*, side FROM way_nodes w JOIN bf ON w.chip = bf.sample_id WHERE side <> 'dropped'), y AS (SELECT way, max(CASE WHEN side = 'train' THEN 1 ELSE 0 END) AS t, sum(CASE WHEN side = 'val' THEN node_length ELSE 0 END) AS l, count(*) FILTER (side = 'val') AS k FROM n GROUP BY way HAVING max(CASE WHEN side = 'val' THEN 1 ELSE 0 END) = 1) SELECT count(*) AS n_ways, count(*) FILTER (t = 1) AS n_shared, round(count(*) FILTER (t = 1) / count(*), 9) AS way_share, round(sum(CASE WHEN t = 1 THEN l ELSE 0 END) / sum(l), 9) AS length_share, round(sum(CASE WHEN t = 1 THEN k ELSE 0 END) / sum(k), 9) AS node_share FROM y", "placement", "way_nodes")
def split_leakage(spark, sf):
    a = _blocks(spark, sf, 500.0).select(F.col("sample_id").alias("chip"), "side")
    return rd(P.leakage(V.way_nodes(spark, sf), a), "way_share", "length_share", "node_share", places=9)


@query(_HOLD + ", d AS (SELECT a.sample_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM sp a, sp b WHERE a.side = 'val' AND b.side = 'train' GROUP BY 1) SELECT round(min(d), 6) AS nearest, round(median(d), 6) AS median, round(quantile_cont(d, 0.1), 6) AS p10, round(avg(CAST(d <= 330 AS INTEGER)), 9) AS touching FROM d", "placement")
def split_adjacency(spark, sf):
    return rd(rd(P.adjacency(_blocks(spark, sf), 330.0), "nearest", "median", "p10"), "touching", places=9)


@query(_HOLD + ", n AS (SELECT w.klass, side FROM way_nodes w JOIN sp ON w.chip = sp.sample_id), s AS (SELECT side, klass, count(*) AS k FROM n GROUP BY ALL), a AS (SELECT klass, count(*) / (SELECT count(*) FROM way_nodes) AS overall FROM way_nodes GROUP BY 1), t AS (SELECT side, sum(k) AS n FROM s GROUP BY 1) SELECT t.side, a.klass, round(coalesce(k, 0) / n, 9) AS share, round(overall, 9) AS overall, round(abs(coalesce(k, 0) / n - overall), 9) AS deviation FROM t CROSS JOIN a LEFT JOIN s ON s.side = t.side AND s.klass = a.klass", "placement", "way_nodes")
def split_composition(spark, sf):
    a = _blocks(spark, sf).select(F.col("sample_id").alias("chip"), "side")
    return rd(P.composition(V.way_nodes(spark, sf), a), "share", "overall", "deviation", places=9)


@query()
def random_split(spark, sf):
    return P.random_split(V.placement(spark, sf), 0.2, 0)


# --- statistics ---------------------------------------------------------------------------------------


@query("SELECT arm, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS low, round(max(value), 6) AS high FROM scores GROUP BY arm", "scores")
def arm_summary(spark, sf):
    return rd(T.summarize(V.scores(spark, sf), ["arm"]), "mean", "median", "low", "high")


_DELTA = "--with dl AS (SELECT a.chip, a.arm, a.value - r.value AS delta FROM scores a JOIN scores r ON a.chip = r.chip AND r.arm = 'click' WHERE a.arm <> 'click') "


@query(_DELTA + "SELECT arm, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_samp(delta) / sqrt(count(*)), 6) AS sem, count(*) FILTER (delta > 0) AS better, count(*) FILTER (delta < 0) AS worse, count(*) FILTER (delta = 0) AS tied, round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) AS t FROM dl GROUP BY arm", "scores")
def paired_stat(spark, sf):
    d = T.paired_deltas(V.scores(spark, sf), "click")
    return rd(T.paired_stat(d, ["arm"], confidence=False), "mean", "sem", "t")


@query()
def paired_interval(spark, sf):
    return rd(T.paired_stat(T.paired_deltas(V.scores(spark, sf), "click"), ["arm"]), "mean", "sem", "t", "low", "high")


@query(_DELTA + ", r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY greatest(delta, 0) DESC) AS k FROM dl), s AS (SELECT arm, count(*) FILTER (delta > 0) AS n_gain, count(*) FILTER (delta < 0) AS n_loss, count(*) FILTER (delta = 0) AS n_same, sum(greatest(delta, 0)) AS gain, sum(least(delta, 0)) AS loss, sum(delta) AS total, sum(CASE WHEN k <= 5 THEN greatest(delta, 0) END) AS top FROM r GROUP BY arm) SELECT arm, n_gain, n_loss, n_same, round(gain, 6) AS gain, round(loss, 6) AS loss, round(total, 6) AS total, round(top, 6) AS top, round(CASE WHEN total > 0 THEN top / total END, 6) AS top_of_total, round(CASE WHEN gain <> 0 THEN top / gain END, 6) AS top_of_gain FROM s", "scores")
def gain_distribution(spark, sf):
    g = T.gain_distribution(T.paired_deltas(V.scores(spark, sf), "click"), ["arm"])
    return rd(g, "gain", "loss", "total", "top", "top_of_total", "top_of_gain")


@query("SELECT arm, round(CASE WHEN sum(value) > 0 THEN 2 * sum(i * value) / (count(*) * sum(value)) - (count(*) + 1) / count(*) ELSE 0 END, 6) AS gini FROM (SELECT arm, value, row_number() OVER (PARTITION BY arm ORDER BY value) AS i FROM scores) GROUP BY arm", "scores")
def gini(spark, sf):
    return rd(T.gini(V.scores(spark, sf), ["arm"], "value"), "gini")


_PT = "SELECT c_nationkey AS g, c_custkey AS id, c_acctbal AS a, CAST(c_custkey * 37 % 1009 AS DOUBLE) AS b, CAST(c_custkey * 101 % 613 AS DOUBLE) AS c FROM customer"


def _configs(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), k.alias("id"), F.col("c_acctbal").alias("a"), (k * 37 % 1009).cast("double").alias("b"), (k * 101 % 613).cast("double").alias("c"))


@query(f"WITH p AS ({_PT}) SELECT g, id, a, b FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.g = x.g AND y.a >= x.a AND y.b >= x.b AND (y.a > x.a OR y.b > x.b))")
def pareto_front(spark, sf):
    return T.pareto_front(_configs(spark, sf), ["id"], ["a", "b"], ["g"]).select("g", "id", "a", "b")


@query(f"WITH p AS ({_PT}) SELECT g, id, a, b, c FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.g = x.g AND y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c))")
def pareto_front_3d(spark, sf):
    return T.pareto_front(_configs(spark, sf), ["id"], ["a", "b", "c"], ["g"])


@query("SELECT l_linenumber AS k, round(avg(l_quantity), 6) AS q FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1")
def axis_profile(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("f", (F.col("l_returnflag") == "R").cast("int")).withColumn("s", (F.col("l_linestatus") == "F").cast("int"))
    g = li.groupBy(F.col("l_linenumber").alias("k"), "f", "s").agg(F.round(F.avg("l_quantity"), 6).alias("q"))
    return T.axis_profile(g, "k", {"f": 1, "s": 1}, "q")


@query("--with l AS (SELECT chip, arm, value, lag(value) OVER w AS p, lag(arm) OVER w AS lo FROM scores WINDOW w AS (PARTITION BY chip ORDER BY arm)) SELECT chip, lo, arm AS hi, round(p, 6) AS before, round(value, 6) AS after FROM l WHERE p > value", "scores")
def monotone_violations(spark, sf):
    return rd(T.monotone_violations(V.scores(spark, sf), ["chip"], "arm", "value"), "before", "after")


@query("SELECT chip, arm, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY chip ORDER BY value DESC, arm) AS r FROM scores) WHERE r = 1", "scores")
def best_arm(spark, sf):
    return rd(T.best_of(V.scores(spark, sf), ["chip"], "arm", "value"), "value")


@query("WITH h AS (SELECT l_suppkey AS run, l_orderkey AS epoch, avg(l_discount) AS v FROM lineitem GROUP BY ALL), b AS (SELECT *, max(v) OVER (PARTITION BY run ORDER BY epoch) AS best, coalesce(v > max(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS isnew FROM h), s AS (SELECT *, epoch - max(CASE WHEN isnew THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS stale FROM b) SELECT run, epoch, round(best, 6) AS best, stale, max(CASE WHEN stale >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) = 1 AS stopped FROM s")
def best_epoch(spark, sf):
    li = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("epoch")).agg(F.avg("l_discount").alias("v"))
    return rd(T.early_stop(li, ["run"], "epoch", "v", 200).drop("v"), "best")


@query("SELECT chip, truth, pred, count(*) AS n FROM predictions GROUP BY ALL", "predictions")
def confusion(spark, sf):
    return T.confusion(V.predictions(spark, sf), ["chip"])


_F1 = "--with c AS (SELECT chip, truth, pred, count(*) AS n FROM predictions GROUP BY ALL), k AS (SELECT chip, klass, sum(s) AS s, sum(p) AS p, sum(t) AS t FROM (SELECT chip, truth AS klass, n AS s, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS t FROM c UNION ALL SELECT chip, pred, 0, n, 0 FROM c) GROUP BY ALL) "


@query(_F1 + "SELECT chip, round(avg(CASE WHEN s > 0 THEN 2.0::DOUBLE * t / (s + p) END), 9) AS macro_f1, round(sum(t) / sum(s), 9) AS accuracy FROM k GROUP BY chip", "predictions")
def macro_f1(spark, sf):
    return rd(T.macro_f1(T.confusion(V.predictions(spark, sf), ["chip"]), ["chip"]), "macro_f1", "accuracy", places=9)


@query("""--with w AS (SELECT b AS boot, c AS chip, (b * 7 + c * 3) % 4 AS w FROM range(30) x(b), range(20) y(c)), c AS (SELECT boot, truth, pred, sum(w) AS n FROM predictions JOIN w USING (chip) GROUP BY ALL HAVING sum(w) > 0),
 k AS (SELECT boot, klass, sum(s) AS s, sum(p) AS p, sum(t) AS t FROM (SELECT boot, truth AS klass, n AS s, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS t FROM c UNION ALL SELECT boot, pred, 0, n, 0 FROM c) GROUP BY ALL), m AS (SELECT boot, avg(CASE WHEN s > 0 THEN 2.0::DOUBLE * t / (s + p) END) AS f FROM k GROUP BY boot) SELECT round(avg(f), 9) AS mean, round(stddev_samp(f), 9) AS sem FROM m""", "predictions")
def bootstrap_sem(spark, sf):
    w = spark.range(600).select(F.floor(F.col("id") / 20).alias("boot"), (F.col("id") % 20).alias("chip")).withColumn("w", (F.col("boot") * 7 + F.col("chip") * 3) % 4).where("w > 0")
    return rd(T.bootstrap_sem(T.confusion(V.predictions(spark, sf), ["chip"]), w), "mean", "sem", places=9)


_U = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
_RESOLVE = f"""--with ways_of AS (SELECT DISTINCT way FROM way_nodes),
 dr AS (SELECT way, draw, {_U.format("'0|1|' || draw || '|' || way")} AS u1, {_U.format("'0|2|' || draw || '|' || way")} AS u2 FROM ways_of, range(3) t(draw)),
 sh AS (SELECT klass, count(*)::DOUBLE AS k FROM way_nodes GROUP BY 1),
 cu AS (SELECT a.klass AS truth, b.klass AS other, sum(b.k) OVER (PARTITION BY a.klass ORDER BY b.klass) AS hi, sum(b.k) OVER (PARTITION BY a.klass) AS total FROM sh a JOIN sh b ON a.klass <> b.klass),
 wk AS (SELECT way, klass, chip, count(*) AS n FROM way_nodes GROUP BY ALL),
 pk AS (SELECT d.way, d.draw, k.klass AS truth, CASE WHEN u1 < 0.7 THEN k.klass ELSE (SELECT min(other) FROM cu WHERE cu.truth = k.klass AND u2 * total < hi) END AS pred FROM dr d JOIN (SELECT DISTINCT way, klass FROM wk) k USING (way)),
 cf AS (SELECT draw, chip, truth, pred, sum(n) AS n FROM wk JOIN pk ON pk.way = wk.way AND pk.truth = wk.klass GROUP BY ALL),
 ch AS (SELECT chip, row_number() OVER (ORDER BY chip) - 1 AS i FROM (SELECT DISTINCT chip FROM way_nodes)),
 wt AS (SELECT boot, i, count(*) AS w FROM (SELECT boot, CAST(floor({_U.format("'0|boot|' || boot || '|' || slot")} * (SELECT count(*) FROM ch)) AS BIGINT) AS i FROM range(20) b(boot), (SELECT i AS slot FROM ch)) GROUP BY ALL),
 ag AS (SELECT draw, boot, truth, pred, sum(n * w) AS n FROM cf JOIN ch USING (chip) JOIN wt USING (i) GROUP BY ALL UNION ALL SELECT draw, -1, truth, pred, sum(n) FROM cf GROUP BY ALL),
 kl AS (SELECT draw, boot, klass, sum(s) AS s, sum(p) AS p, sum(t) AS t FROM (SELECT draw, boot, truth AS klass, n AS s, 0 AS p, CASE WHEN truth = pred THEN n ELSE 0 END AS t FROM ag UNION ALL SELECT draw, boot, pred, 0, n, 0 FROM ag) GROUP BY ALL),
 mf AS (SELECT draw, boot, avg(CASE WHEN s > 0 THEN 2.0::DOUBLE * t / (s + p) END) AS f FROM kl GROUP BY ALL),
 se AS (SELECT draw, stddev_samp(f) AS sem FROM mf WHERE boot >= 0 GROUP BY draw) """


@query(_RESOLVE + f"""SELECT (SELECT count(*) FROM way_nodes) AS n_nodes, (SELECT count(*) FROM ways_of) AS n_units, (SELECT min(n) FROM (SELECT count(*) AS n FROM way_nodes GROUP BY klass)) AS min_class_nodes, (SELECT min(n) FROM (SELECT count(DISTINCT way) AS n FROM way_nodes GROUP BY klass)) AS min_class_units,
 round((SELECT avg(f) FROM mf WHERE boot = -1), 6) AS macro_f1, round((SELECT stddev_samp(f) FROM mf WHERE boot = -1), 6) AS macro_f1_spread, round(avg(sem), 6) AS macro_f1_sem, round(stddev_samp(sem), 6) AS sem_spread, round(avg(sem) * {scalars.detectable_difference(1.0, 0.5)!r}, 6) AS detectable_0_5 FROM se""", "way_nodes")
def resolvability(spark, sf):
    classes = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    x = L.resolvability(V.way_nodes(spark, sf), "way", classes, 0.7, 0, draws=3, boots=20, rhos=(0.5,))
    return rd(x, "macro_f1", "macro_f1_spread", "macro_f1_sem", "sem_spread", "detectable_0_5")


@query("SELECT klass, count(*) AS nodes, count(DISTINCT way) AS ways, count(DISTINCT chip) AS chips FROM way_nodes GROUP BY klass", "way_nodes")
def class_sizes(spark, sf):
    return T.class_sizes(V.way_nodes(spark, sf))


@query("SELECT count(*) AS n, round(avg(k), 6) AS mean, median(k) AS median, round(quantile_cont(k, 0.9), 6) AS p90, max(k) AS largest FROM (SELECT chip, count(*) AS k FROM way_nodes GROUP BY chip)", "way_nodes")
def cluster_sizes(spark, sf):
    return rd(T.cluster_sizes(V.way_nodes(spark, sf), "chip"), "mean", "p90")


@query("SELECT klass, round(k / n, 9) AS share, round(2.0::DOUBLE * k / (k + n) / c, 9) AS macro_f1 FROM (SELECT klass, count(*) AS k, sum(count(*)) OVER () AS n, count(*) OVER () AS c FROM way_nodes GROUP BY klass) ORDER BY k DESC, klass LIMIT 1", "way_nodes")
def majority_baseline(spark, sf):
    return rd(T.majority_baseline(V.way_nodes(spark, sf)), "share", "macro_f1", places=9)


@query("--with c AS (SELECT klass, count(*) AS k FROM way_nodes GROUP BY 1), e AS (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW', 'none']) AS klass) SELECT e.klass, round(coalesce((SELECT count(*) FROM way_nodes) / (k * 4), 0), 9) AS weight FROM e LEFT JOIN c USING (klass)", "way_nodes")
def class_weights(spark, sf):
    return rd(T.class_weights(V.way_nodes(spark, sf), ["1-URGENT", "2-HIGH", "5-LOW", "none"]), "weight", places=9)


@query("WITH s AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) FILTER (vec_id % 5 <> 0) AS m, stddev_pop(CAST(embedding[i] AS DOUBLE)) FILTER (vec_id % 5 <> 0) AS d FROM embeddings, range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) t(i) GROUP BY i) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round((CAST(embedding[i] AS DOUBLE) - m) / CASE WHEN d > 1e-6 THEN d ELSE 1 END, 6) AS z FROM embeddings JOIN s ON true")
def feature_standardize(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("f"))
    z = T.standardize(e, "f", F.col("vec_id") % 5 != 0)
    return rd(z.select("vec_id", F.posexplode("f").alias("i", "z")), "z")


@query("SELECT l_returnflag AS arm, round(sum(l_tax) / sum(l_quantity), 9) AS pooled, round(avg(l_tax / l_quantity), 9) AS mean_ratio FROM lineitem GROUP BY 1")
def conversion_rate(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "arm")
    return rd(T.pooled_and_mean(li, ["arm"], "l_tax", "l_quantity").select("arm", "pooled", "mean_ratio"), "pooled", "mean_ratio", places=9)


@query("SELECT l_returnflag AS arm, coalesce(l_linestatus, 'all') AS kind, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag))")
def marginal_summary(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("kind"), "l_quantity")
    return T.with_total(li, ["arm"], "kind", F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("WITH g AS (SELECT l_linestatus AS s, l_linenumber AS k, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL) SELECT s, k, round(v, 4) AS v, round(v / first_value(v) OVER (PARTITION BY s ORDER BY k DESC), 9) AS of_reference FROM g")
def of_reference(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("k")).agg(F.avg("l_extendedprice").alias("v"))
    return rd(rd(T.of_reference(g, ["s"], "k", "v"), "v", places=4), "of_reference", places=9)


@query("--with q AS (SELECT chip, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS a FROM predictions GROUP BY chip) SELECT count(*) AS n, count(*) FILTER (a < 0.7) AS below, count(*) > 0 AND 2 * count(*) FILTER (a < 0.7) <= count(*) AS passes, coalesce(string_agg(CASE WHEN a < 0.7 THEN CAST(chip AS VARCHAR) END, ',' ORDER BY chip), '') AS failing FROM q", "predictions")
def agreement_gate(spark, sf):
    q = V.predictions(spark, sf).groupBy("chip").agg(F.avg((F.col("truth") == F.col("pred")).cast("double")).alias("a"))
    return T.gate(q, "a", 0.7, "chip").withColumn("failing", F.array_join(F.col("failing").cast("array<string>"), ","))


@query("--with t AS (SELECT CASE WHEN value <= 40 THEN 0 WHEN value <= 60 THEN 1 WHEN value <= 100 THEN 2 END AS band, chip, arm, row_number() OVER (PARTITION BY CASE WHEN value <= 40 THEN 0 WHEN value <= 60 THEN 1 WHEN value <= 100 THEN 2 END ORDER BY chip, arm) AS r FROM scores WHERE value > 0 AND value <= 100) SELECT CAST(band AS INTEGER) AS band, chip, arm FROM t WHERE r <= 4", "scores")
def banded_sample(spark, sf):
    s = V.scores(spark, sf).withColumn("o", F.concat_ws("|", F.rpad("chip", 12, " "), "arm"))
    return T.banded(s, "value", [(0.0, 40.0), (40.0, 60.0), (60.0, 100.0)], 4, "o").select("band", "chip", "arm")


@query("WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS k, count(*) OVER () AS n FROM part) SELECT p_partkey, k AS rank FROM r WHERE k IN (SELECT CAST(round_even(i * (n - 1) / 8.0, 0) AS BIGINT) FROM range(9) t(i))")
def gallery_picks(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", F.struct("p_retailprice", "p_partkey").alias("o"))
    return T.spread_picks(p, "o", 9).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT i.n_name AS nation, CASE WHEN s.k IS NULL THEN 'left' WHEN c.k IS NULL THEN 'right' ELSE 'both' END AS side FROM nation i LEFT JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) s ON s.k = i.n_nationkey LEFT JOIN (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900) c ON c.k = i.n_nationkey WHERE s.k IS NOT NULL OR c.k IS NOT NULL".replace("'left' WHEN c.k IS NULL THEN 'right'", "'customer' WHEN c.k IS NULL THEN 'supplier'"))
def id_set_operations(spark, sf):
    s = V.table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    c = V.table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    both, only_s, only_c = s.intersect(c).withColumn("side", F.lit("both")), s.exceptAll(c).select("k").subtract(c).withColumn("side", F.lit("supplier")), c.subtract(s).withColumn("side", F.lit("customer"))
    return both.union(only_s).union(only_c).join(V.table(spark, sf, "nation"), F.col("k") == F.col("n_nationkey")).select(F.col("n_name").alias("nation"), "side")


@query("SELECT threshold, round(avg(CASE WHEN z > t THEN 1.0 ELSE 0.0 END), 9) AS share FROM (SELECT l_discount * 40 - 2 AS z FROM lineitem), (VALUES (0.1::DOUBLE, ln(0.1 / 0.9)::DOUBLE), (0.5, 0.0), (0.9, ln(0.9 / 0.1))) v(threshold, t) GROUP BY threshold")
def threshold_summary(spark, sf):
    z = V.table(spark, sf, "lineitem").select((F.col("l_discount") * 40 - 2).alias("z"))
    out = None
    for t in (0.1, 0.5, 0.9):
        s = z.agg(F.round(F.avg(scalars.predict_mask(F.col("z"), t).cast("double")), 9).alias("share")).withColumn("threshold", F.lit(t))
        out = s if out is None else out.unionByName(s)
    return out
