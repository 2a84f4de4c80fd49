"""More registered queries, over the operators that the first ones do not reach, each next to its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom, scalars
from ..operators import candidates as C
from ..operators import crosscheck as X
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import raster as R
from ..operators import spatial as S
from ..operators import split as P
from ..operators import stats as T
from ..sources import chips, sinks
from . import views as V
from .queries import _CENSUS, _DEG, _PATHS, _PRUNE, _grids, _labelled, proposal, query, rd, truth

_LEN_VIEWS = ("grid_edges", "thin_edges")
_CEN_VIEWS = ("grid_edges", "thin_edges", "grid_nodes")


# --- tiles and lines ------------------------------------------------------------------------------------


@query("SELECT sample_id, (x + 10 - (x - 160)) / 2 AS px, ((y + 160) - (y - 20)) / 2 AS py, x - 160 AS minx, y - 160 AS miny, x + 160 AS maxx, y + 160 AS maxy, x AS cx, y AS cy, x + 10 AS wx, y - 20 AS wy, 160 AS width FROM placement", "placement")
def tile_pixels(spark, sf):
    t = V.placement(spark, sf).withColumn("tile", geom.tile_from_center(F.lit(32611), F.col("x"), F.col("y"), F.lit(320.0), F.lit(2.0)))
    t = t.withColumn("p", geom.world_to_px(F.col("x") + 10, F.col("y") - 20, F.col("tile")))
    back = geom.px_to_world(F.col("p.x"), F.col("p.y"), F.col("tile"))
    b, c = geom.bounds_world(F.col("tile")), geom.tile_center(F.col("tile"))
    return t.select("sample_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), b.alias("b"), c.alias("c"), back.alias("w"), F.col("tile.width").alias("width")).select(
        "sample_id", "px", "py", "b.*", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("w.x").alias("wx"), F.col("w.y").alias("wy"), "width"
    )


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 160 - 80 >= 0 THEN 32600 ELSE 32700 END + floor((s_suppkey * 7 % 360 - 180 + 180) / 6) + 1 AS INTEGER) AS epsg FROM supplier")
def utm_zones(spark, sf):
    k = F.col("s_suppkey")
    return V.table(spark, sf, "supplier").select("s_suppkey", geom.utm_epsg(k % 160 - 80, k * 7 % 360 - 180).cast("int").alias("epsg"))


@query("SELECT graph_id, edge, u % 4 * 100.0::DOUBLE AS x, (u // 4) * 100.0::DOUBLE AS y FROM grid_edges", "grid_edges")
def oriented_lines(spark, sf):
    # odd edges are stored backwards; a null geometry is the straight line
    e = V.grid_edges(spark, sf).withColumn("pts", F.when(F.col("edge") % 2 == 1, F.reverse("pts")).otherwise(F.col("pts")))
    n = V.grid_nodes(spark, sf)
    end = lambda k: n.select("graph_id", F.col("node").alias(k), geom.point(F.col("x"), F.col("y")).alias(f"at_{k}"))
    j = e.join(end("u"), ["graph_id", "u"]).join(end("v"), ["graph_id", "v"])
    line = geom.edge_polyline(F.when(F.col("edge") % 3 > 0, F.col("pts")), F.col("at_u"), F.col("at_v"))
    o = j.select("graph_id", "edge", geom.oriented(line, F.col("at_u.x"), F.col("at_u.y"), F.col("u"), F.col("v")).alias("p"))
    return o.select("graph_id", "edge", F.get("p", F.lit(0)).alias("s")).select("graph_id", "edge", "s.x", "s.y")


@query("SELECT graph_id, edge, CAST(k AS INTEGER) AS k, round(u % 4 * 100 + CASE WHEN h THEN k * 25 ELSE 0 END, 6)::DOUBLE AS x, round((u // 4) * 100 + CASE WHEN h THEN 0 ELSE k * 25 END, 6)::DOUBLE AS y FROM grid_edges, range(5) t(k)", "grid_edges")
def resampled_lines(spark, sf):
    s = V.grid_edges(spark, sf).select("graph_id", "edge", F.posexplode(geom.resample(F.col("pts"), 30.0)).alias("k", "p"))
    return rd(s.select("graph_id", "edge", "k", "p.x", "p.y"), "x", "y")


@query("SELECT graph_id, tolerance, CAST(sum(CASE WHEN edge % 3 = 0 AND tolerance < 40 THEN 3 ELSE 2 END) AS BIGINT) AS points FROM grid_edges, (VALUES (2.0::DOUBLE), (45.0)) t(tolerance) GROUP BY ALL", "grid_edges")
def simplified_lines(spark, sf):
    out = None
    for tolerance in (2.0, 45.0):
        e = G.simplify(V.grid_nodes(spark, sf), V.grid_edges(spark, sf, bowed=True), tolerance)[1]
        x = e.groupBy("graph_id").agg(F.sum(F.size("pts")).alias("points")).withColumn("tolerance", F.lit(tolerance))
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT graph_id, edge, round_even(u % 4 * 100 / 7.0 + edge / 3.0, 1)::DOUBLE AS x, round_even((u // 4) * 100 / 7.0, 1)::DOUBLE AS y FROM grid_edges", "grid_edges")
def rounded_lines(spark, sf):
    e = V.grid_edges(spark, sf)
    p = F.transform("pts", lambda p: geom.point(p["x"] / 7.0 + F.col("edge") / 3.0, p["y"] / 7.0))
    return sinks.export_lines(e.withColumn("pts", p), 1).select("graph_id", "edge", F.get("pts", F.lit(0)).alias("p")).select("graph_id", "edge", "p.x", "p.y")


# --- tags and labels ------------------------------------------------------------------------------------


@query("SELECT way, CASE size % 3 WHEN 0 THEN 'untagged' ELSE highway END AS highway, size % 3 = 2 AS multi_valued, highway = 'footway' AS pedestrian, round(length / CASE WHEN size % 2 = 0 THEN 5 ELSE 13.41 END, 6) AS seconds FROM ways", "ways")
def highway_values(spark, sf):
    w, h = V.ways(spark, sf), F.col("highway")
    values = F.when(F.col("size") % 3 == 0, F.array().cast("array<string>")).when(F.col("size") % 3 == 1, F.array(h)).otherwise(F.array(h, F.lit("x")))
    x = w.select("way", scalars.highway_value(values).alias("v"), scalars.pedestrian(h).alias("pedestrian"), scalars.travel_time(F.col("length"), F.when(F.col("size") % 2 == 0, 5.0)).alias("seconds"))
    return rd(x.select("way", "v.highway", "v.multi_valued", "pedestrian", "seconds"), "seconds")


_ARMED = ", q AS (SELECT *, CASE WHEN proposal_dist = CAST('inf' AS DOUBLE) THEN 'component_join' ELSE 'shortcut' END AS pk, (cand * 7 + node_a) % 11 / 10.0::DOUBLE AS purity FROM cen) "


def _with_purity(spark, sf):
    a, b = (F.col("cand") * 7 + F.col("node_a")) % 11 / 10.0, F.lit(1.0)
    return _labelled(spark, sf).withColumn("purity", scalars.purity(a, b))


@query(_CENSUS + _ARMED + "SELECT snap, pk AS kind, count(*) AS n FROM q WHERE label = 'positive' GROUP BY ALL", *_CEN_VIEWS, recursive=True)
def positive_kinds(spark, sf):
    x = _labelled(spark, sf).where("label = 'positive'")
    return x.groupBy("snap", scalars.positive_kind(F.col("proposal_dist")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _CENSUS + _ARMED + "SELECT arm, count(*) AS n FROM q JOIN (VALUES ('joins@R105_snap5', 105.0::DOUBLE, 5.0::DOUBLE, 'component_join', 'component_join', NULL::DOUBLE), ('both@R150_snap30', 150.0, 30.0, 'component_join', 'shortcut', NULL), ('pure@R150_snap5', 150.0, 5.0, 'component_join', 'shortcut', 0.5)) a(arm, radius, s, k1, k2, least)"
    " ON gap <= radius AND snap = s AND label = 'positive' AND pk IN (k1, k2) AND (least IS NULL OR purity >= least) GROUP BY arm",
    *_CEN_VIEWS, recursive=True,
)
def arm_selection(spark, sf):
    arms = spark.createDataFrame(
        [("joins", 105.0, 5.0, ["component_join"], None), ("both", 150.0, 30.0, ["component_join", "shortcut"], None), ("pure", 150.0, 5.0, ["component_join", "shortcut"], 0.5)],
        "name string, radius double, snap double, kinds array<string>, min_purity double",
    )
    arms = arms.withColumn("arm", F.when(F.col("name") == "joins", scalars.key_of("joins", R=F.col("radius"), snap=F.col("snap"))).when(F.col("name") == "both", scalars.key_of("both", R=F.col("radius"), snap=F.col("snap"))).otherwise(scalars.key_of("pure", R=F.col("radius"), snap=F.col("snap"))))
    return C.select_arm(_with_purity(spark, sf), arms).groupBy("arm").agg(F.count(F.lit(1)).alias("n"))


@query(
    _CENSUS + _ARMED + ", b AS (SELECT snap, purity, 'all' AS bucket FROM q UNION ALL SELECT snap, purity, 'positive' FROM q WHERE label = 'positive')"
    " SELECT snap, bucket, count(*) FILTER (purity >= 0.5) AS n_high, count(*) FILTER (purity < 0.5) AS n_low, round(avg(CASE WHEN purity = 0 THEN 1.0 ELSE 0.0 END), 9) AS at_0, round(avg(CASE WHEN purity = 1 THEN 1.0 ELSE 0.0 END), 9) AS at_1, round(median(purity), 6) AS middle, round(quantile_cont(purity, 0.25), 6) AS low FROM b GROUP BY ALL",
    *_CEN_VIEWS, recursive=True,
)
def purity_buckets(spark, sf):
    x = C.purity_summary(C.buckets(_with_purity(spark, sf)), ["snap", "bucket"])
    x = x.withColumn("middle", F.get("five", F.lit(2))).withColumn("low", F.get("five", F.lit(1))).drop("five")
    return rd(rd(x, "at_0", "at_1", places=9), "middle", "low")


# --- graphs ---------------------------------------------------------------------------------------------


@query(_PRUNE.split("kept AS")[0].rstrip().rstrip(",") + " SELECT s.graph_id, count(*) AS n_edges, sum(length) AS length FROM (SELECT graph_id, 100.0::DOUBLE AS length FROM thin_edges UNION ALL SELECT graph_id, length FROM stub_edges WHERE edge >= 24 AND length >= 20) s GROUP BY s.graph_id", "stub_edges")
def cleaned_graphs(spark, sf):
    return G.total_length(G.clean(*V.stubs(spark, sf))[1]).select("graph_id", "n_edges", "length")


@query(
    _DEG + ", a AS (SELECT graph_id, count(*) FILTER (degree = 1) AS bare, count(*) FILTER (node = 0 AND degree = 1) AS was_end, count(*) FILTER (node = 0 AND degree = 0) AS was_alone FROM d GROUP BY 1),"
    " t AS (SELECT bare + 1 - was_end + was_alone AS before, CASE WHEN CAST(graph_id AS BIGINT) % 4 * 5 + 8 >= 20 THEN bare + 1 - was_end + was_alone ELSE bare END AS after FROM a)"
    " SELECT round(avg(before), 6) AS mean_before, median(before) AS median_before, round(avg(after), 6) AS mean_after, median(after) AS median_after, round(sum(before - after) / sum(before), 9) AS destroyed FROM t",
    "thin_edges", "grid_nodes",
)
def endpoint_losses(spark, sf):
    n, e = V.stubs(spark, sf)
    count = lambda net, c: net[0].select("graph_id").distinct().join(G.endpoints(*net).groupBy("graph_id").agg(F.count(F.lit(1)).alias(c)), "graph_id", "left").fillna(0, [c])
    x = count((n, e), "before").join(count(G.prune(n, e, 20.0), "after"), "graph_id").withColumn("every", F.lit(1))
    x = X.endpoint_summary(x, ["every"]).drop("every")
    return rd(rd(x, "mean_before", "mean_after"), "destroyed", places=9)


@query(_PATHS + ", r AS (SELECT graph_id, a, max(l) AS far, count(*) AS n FROM len WHERE g = 'p' GROUP BY ALL), c AS (SELECT len.graph_id, len.a, max(r.far) AS far, any_value(r.n) AS n FROM len JOIN r ON r.graph_id = len.graph_id AND r.a = len.b WHERE g = 'p' GROUP BY ALL) SELECT graph_id, count(*) AS n_nodes FROM c WHERE far >= 250 GROUP BY graph_id", *_LEN_VIEWS, recursive=True)
def without_small_parts(spark, sf):
    n, e = proposal(spark, sf)
    return G.drop_small(n, e, 250.0)[0].groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(_PATHS + "SELECT graph_id, a, b, l AS length, CAST(l / 100 AS BIGINT) + 1 AS hops FROM len WHERE g = 'p' AND a % 5 = 0 AND b = 15 - a", *_LEN_VIEWS, recursive=True)
def shortest_routes(spark, sf):
    n, e = proposal(spark, sf)
    ends = n.where("node % 5 = 0").select("graph_id", F.col("node").alias("a"), (15 - F.col("node")).alias("b"))
    # a node without an edge has no route, not even to itself
    return M.routes(n, e, ends).where("a <> b").select("graph_id", "a", "b", "length", F.size("route").cast("long").alias("hops"))


@query("SELECT graph_id, node AS cand, snap, CASE WHEN off <= snap THEN least(abs(x - 100) + y + 50, abs(x - 200) + y + 50) END AS truth_dist FROM (SELECT graph_id, node, x, y, 4.0 AS off FROM grid_nodes), (VALUES (3.0::DOUBLE), (5.0)) s(snap)", "grid_nodes")
def injected_points(spark, sf):
    # from every node to the middle of a street, which lies 4 off the point that is asked for
    c = V.grid_nodes(spark, sf).select("graph_id", F.col("node").alias("cand"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(150.0).alias("bx"), F.lit(-4.0).alias("by"))
    return C.truth_distances(truth(spark, sf), c, [3.0, 5.0])


@query("""--with l AS (SELECT graph_id, edge, CASE WHEN edge % 2 = 0 THEN 'a' ELSE 'b' END AS klass, u, v FROM thin_edges), e AS (SELECT graph_id, klass, u AS a, v AS b FROM l UNION ALL SELECT graph_id, klass, v, u FROM l),
 reach(graph_id, klass, node, seen) AS (SELECT DISTINCT graph_id, klass, a, a FROM e UNION SELECT r.graph_id, r.klass, r.node, e.b FROM reach r JOIN e ON r.graph_id = e.graph_id AND r.klass = e.klass AND r.seen = e.a)
 SELECT graph_id, klass, count(DISTINCT c) AS n_components FROM (SELECT graph_id, klass, node, min(seen) AS c FROM reach GROUP BY ALL) GROUP BY ALL""", "thin_edges", recursive=True)
def class_parts(spark, sf):
    e = V.grid_edges(spark, sf, drop=15).select("graph_id", F.col("edge").alias("line"), F.when(F.col("edge") % 2 == 0, "a").otherwise("b").alias("klass"), "pts")
    return G.class_components(e).groupBy("graph_id", "klass").agg(F.countDistinct("component").alias("n_components"))


@query("SELECT a.graph_id, a.node FROM points a WHERE NOT EXISTS (SELECT 1 FROM points b WHERE b.graph_id = a.graph_id AND b.node % 2 = 1 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 60 * 60) AND a.node % 2 = 0", "points")
def without_survivors(spark, sf):
    p = V.points(spark, sf)
    return S.without_near(p.where("node % 2 = 0"), p.where("node % 2 = 1"), 60.0, ["graph_id"], "node").select("graph_id", "node")


# --- rasters --------------------------------------------------------------------------------------------

_SMALL = ", s AS (SELECT graph_id AS chip, u % 4 * 10 AS c0, (u // 4) * 10 AS r0, CASE WHEN h THEN 1 ELSE 0 END AS dc, CASE WHEN h THEN 0 ELSE 1 END AS dr FROM thin_edges), px AS (SELECT DISTINCT chip, r0 + dr * k AS row, c0 + dc * k AS col FROM s, range(11) t(k))"


def _small(spark, sf):
    e = V.grid_edges(spark, sf, drop=15)
    return e.withColumn("pts", F.transform("pts", lambda p: geom.point(p["x"] / 10, p["y"] / 10)))


@query("--with one AS (SELECT 1)" + _SMALL + ", d AS (SELECT DISTINCT chip, row + a.i AS row, col + b.i AS col FROM px, range(-2, 3) a(i), range(-2, 3) b(i) WHERE a.i * a.i + b.i * b.i <= 4 AND row + a.i BETWEEN 0 AND 30 AND col + b.i BETWEEN 0 AND 30) SELECT chip, (SELECT count(*) FROM px p WHERE p.chip = d.chip) AS thin, count(*) AS wide FROM d GROUP BY chip", "thin_edges")
def drawn_pixels(spark, sf):
    e, g = _small(spark, sf), _grids(spark, sf)
    count = lambda w, name: R.draw_edges(e, g, w).groupBy("chip").agg(F.count(F.lit(1)).alias(name))
    return count(0, "thin").join(count(2, "wide"), "chip")


@query("--with one AS (SELECT 1)" + _SMALL + ", e AS (SELECT chip, c0 AS x, r0 AS y FROM s UNION ALL SELECT chip, c0 + 10 * dc, r0 + 10 * dr FROM s), d AS (SELECT e.chip, (SELECT sqrt(min((m.row - y) ** 2 + (m.col - x) ** 2)) FROM mask m WHERE m.chip = e.chip AND (m.row - y) ** 2 + (m.col - x) ** 2 <= 4) AS d FROM e) SELECT chip, tolerance, round(avg(CASE WHEN d <= tolerance THEN 1.0 ELSE 0.0 END), 9) AS share FROM d, (VALUES (0.0::DOUBLE), (1.0), (2.0)) t(tolerance) GROUP BY ALL", "thin_edges", "mask")
def registration_shares(spark, sf):
    return rd(X.registration(_small(spark, sf), V.mask(spark, sf), _grids(spark, sf), 10.0, [0.0, 1.0, 2.0]), "share", places=9)


@query("SELECT chip, CAST(crop AS INTEGER) AS crop, count(*) AS n, CAST(sum(row - 3 * crop) AS BIGINT) AS rows, CAST(sum(col - 2 * crop) AS BIGINT) AS cols FROM mask, range(3) t(crop) WHERE row BETWEEN 3 * crop AND 3 * crop + 15 AND col BETWEEN 2 * crop AND 2 * crop + 15 GROUP BY ALL", "mask")
def cropped_masks(spark, sf):
    m = V.mask(spark, sf)
    w = m.select("chip").distinct().withColumn("crop", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    w = w.select("chip", "crop", (3 * F.col("crop")).alias("row0"), (2 * F.col("crop")).alias("col0"), F.lit(16).alias("size"))
    return R.crop(m, w).groupBy("chip", "crop").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


_UC = "CAST('0x' || substr(md5('5|{0}|' || chip || '|' || crop || '|' || attempt), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query(
    f"--with w AS (SELECT chip, crop, attempt, CAST(floor({_UC.format(1)} * 20) AS INTEGER) AS row0, CAST(floor({_UC.format(2)} * 20) AS INTEGER) AS col0 FROM (SELECT DISTINCT chip FROM mask), range(2) c(crop), range(4) a(attempt)),"
    " s AS (SELECT w.*, (SELECT count(*) FROM mask m WHERE m.chip = w.chip AND m.row >= row0 AND m.row < row0 + 12 AND m.col >= col0 AND m.col < col0 + 12) / 144.0::DOUBLE AS share FROM w),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY chip, crop ORDER BY CASE WHEN share >= 0.2 THEN 0 ELSE 1 END, CASE WHEN share >= 0.2 THEN attempt ELSE -share END, row0, col0) AS r FROM s)"
    " SELECT chip, CAST(crop AS INTEGER) AS crop, row0, col0, round(share, 9) AS share FROM r WHERE r = 1",
    "mask",
)
def crop_draws(spark, sf):
    x = chips.crop_windows(V.mask(spark, sf), _grids(spark, sf), 12, 2, 0.2, 5, attempts=4)
    return rd(x.select("chip", "crop", "row0", "col0", "share"), "share", places=9)


@query("SELECT l_returnflag AS band, round(avg(CASE WHEN l_discount > 0.02 AND l_tax < 0.05 THEN l_quantity / 50 ELSE 0 END), 9) AS data, round(avg(CASE WHEN l_discount > 0.02 AND l_tax < 0.05 THEN 1.0 ELSE 0.0 END), 9) AS indicator FROM lineitem GROUP BY 1")
def observed_bands(spark, sf):
    li = V.table(spark, sf, "lineitem")
    o = scalars.observed(F.col("l_quantity"), F.col("l_discount") > 0.02, F.col("l_tax") < 0.05, 50.0, 7.0)
    x = li.select(F.col("l_returnflag").alias("band"), o.alias("o")).select("band", scalars.mask_unobserved(F.col("o.data"), F.col("o.indicator")).alias("data"), F.col("o.indicator").alias("indicator"))
    return rd(x.groupBy("band").agg(F.avg("data").alias("data"), F.avg("indicator").alias("indicator")), "data", "indicator", places=9)


# --- samples and summaries --------------------------------------------------------------------------------


@query("SELECT 'img' || s_suppkey AS chip, s_suppkey AS number FROM supplier WHERE s_suppkey % 3 = 0")
def chip_pairs(spark, sf):
    k = F.col("s_suppkey").cast("string")
    s = V.table(spark, sf, "supplier")
    images = s.select(F.concat(F.lit("a/RGB_img"), k, F.lit(".tif")).alias("path"))
    labels = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("b/roads_img"), k, F.lit(".geojson")).alias("path"))
    return chips.find_chips(images, labels).select("chip", "number")


@query("SELECT sample_id, pos FROM placement WHERE pos BETWEEN 3 AND 8 AND pos % 4 <> 0", "placement")
def held_out_slice(spark, sf):
    p = V.placement(spark, sf)
    return chips.holdout(p.select("sample_id", "pos"), p.where("pos % 4 = 0"), 3, 6)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS sample_id FROM supplier WHERE s_suppkey % 7 = 3")
def unknown_samples(spark, sf):
    p = V.placement(spark, sf)
    return P.unknown_ids(p, p.where("pos % 7 <> 3"))


@query("SELECT chip, round(avg(value) FILTER (arm = 'click'), 6) AS click, round(avg(value) FILTER (arm = 'view'), 6) AS view, round(avg(value) FILTER (arm = 'view') - avg(value) FILTER (arm = 'click'), 6) AS headroom FROM scores GROUP BY chip", "scores")
def arm_headroom(spark, sf):
    return rd(T.headroom(V.scores(spark, sf), ["chip"], "arm", "click", "view", "value"), "click", "view", "headroom")


@query("--with b AS (SELECT CAST(chip AS BIGINT) % 5 AS fold, arm, value FROM scores) SELECT fold, round(avg(value) FILTER (arm = 'click'), 6) AS click, round(median(value) FILTER (arm = 'click'), 6) AS click_median, round(avg(value) FILTER (arm = 'error'), 6) AS error, round(median(value) FILTER (arm = 'error'), 6) AS error_median FROM b GROUP BY fold", "scores")
def flat_summary(spark, sf):
    s = V.scores(spark, sf).withColumn("fold", F.col("chip").cast("long") % 5).withColumn("metric", F.col("arm"))
    x = sinks.flatten(T.summarize(s, ["fold", "metric"]), ["fold"], ["click", "error"])
    return rd(x, "click", "click_median", "error", "error_median")


@query("SELECT 'f' || c_nationkey AS arm, round((1.959963984540054 + 0.8416212335729143) * stddev_samp(c_acctbal) / sqrt(count(*)) * sqrt(2 * (1 - 0.5)), 4) AS detectable FROM customer GROUP BY c_nationkey")
def detectable_differences(spark, sf):
    c = V.table(spark, sf, "customer").groupBy("c_nationkey").agg((F.stddev_samp("c_acctbal") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("sem"))
    one = scalars.detectable_difference(1.0, 0.5)
    return c.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("arm"), F.round(F.col("sem") * one, 4).alias("detectable"))
