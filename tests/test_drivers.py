"""Drivers and the operators below them: evaluation, coverage, labelled nodes, tiles, ranks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stradale.functions import fields, geom, kernels, scalars
from stradale.operators import coverage as K
from stradale.operators import crosscheck as X
from stradale.operators import evaluate as E
from stradale.operators import graph as G
from stradale.operators import labelled as L
from stradale.operators import metrics as M
from stradale.operators import raster as R
from stradale.operators import stats as T
from stradale.operators.ranks import ranked
from stradale.sources import chips, registry
from stradale.sources import ways as W

TIDY = (1.0, 8.0, 4.0)


@pytest.fixture(scope="module")
def scene(spark):
    """Two chips with a cross of roads, one chip without any: (truth, its mask, grids)."""
    lines = [(g, i, [{"x": float(x), "y": float(y)} for x, y in p]) for g in ("a", "b") for i, p in enumerate([[(5, 30), (30, 30)], [(30, 30), (55, 30)], [(30, 5), (30, 30)], [(30, 30), (30, 55)]])]
    df = spark.createDataFrame(lines, "graph_id string, line long, pts array<struct<x:double,y:double>>")
    n, e = G.build(df)
    n = n.unionByName(spark.createDataFrame([("c", 0, 1.0, 1.0)], "graph_id string, node long, x double, y double"))
    grids = spark.createDataFrame([(g, 61, 61) for g in "abc"], "chip string, height int, width int")
    return (n, e), R.draw_edges(e, grids, 2), grids


def test_evaluation_skips_chips_without_roads(scene):
    truth, mask, grids = scene
    hurt = mask.where("not (chip = 'b' and col between 38 and 46)")
    rows = {r["graph_id"]: r for r in E.evaluate_tiles(truth, mask, hurt, grids, TIDY).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["mask_iou"] == 1 and rows["a"]["of_ceiling"] == pytest.approx(1)
    assert rows["b"]["mask_iou"] < 1 and rows["b"]["apls_cleaned"] < rows["b"]["ceiling"]
    # the same as its parts one by one
    net = G.clean(*G.trace(hurt.where("chip = 'b'"), grids.where("chip = 'b'")), *TIDY)
    one = M.apls((truth[0].where("graph_id = 'b'"), truth[1].where("graph_id = 'b'")), net).first()["apls"]
    assert rows["b"]["apls_cleaned"] == pytest.approx(one)
    total = E.aggregate(E.evaluate_tiles(truth, mask, hurt, grids, TIDY), truth[0]).first()
    assert (total["n_scored"], total["n_skipped"]) == (2, 1) and total["apls_median"] == pytest.approx((rows["a"]["apls_cleaned"] + one) / 2)
    none = E.aggregate(E.evaluate_tiles((truth[0], truth[1].where("false")), mask, hurt, grids, TIDY), truth[0]).first()
    assert (none["n_scored"], none["n_skipped"], none["apls_cleaned"]) == (0, 3, 0.0)


def test_threshold_sweep(scene):
    truth, mask, grids = scene
    # an arm of chip b is unsure: it shows at low thresholds only
    logits = mask.withColumn("logit", F.when((F.col("chip") == "b") & (F.col("col") > 36), -1.0).otherwise(4.0))
    rows = {(r["graph_id"], r["threshold"]): r for r in E.threshold_sweep(truth, mask, logits, grids, [0.1, 0.5], TIDY).collect()}
    assert set(rows) == {(g, t) for g in "ab" for t in (0.1, 0.5)}
    assert rows["b", 0.1]["of_ceiling"] == pytest.approx(1) and rows["b", 0.5]["apls"] < rows["b", 0.1]["apls"] and rows["b", 0.5]["mask_iou"] < 1
    few, summary = E.tuned_gallery(E.threshold_sweep(truth, mask, logits, grids, [0.1, 0.5], TIDY), 0.5, 0.1, 2)
    assert few.count() == 2 and summary.first()["better"] == 1


def test_arms(spark, scene):
    truth, mask, grids = scene
    raw = G.trace(mask.where("col not between 38 and 44"), grids)
    rows = spark.createDataFrame(
        [(g, 0, "endpoint", 8.0, 5.0, "positive", math.inf, 1.0) for g in "ab"], "graph_id string, cand long, kind string, gap double, snap double, label string, proposal_dist double, purity double"
    )
    ends = G.endpoints(*G.snap(*G.simplify(*raw, 1.0), 4.0)).where("y between 28 and 32 and x between 30 and 50")
    pair = ends.groupBy("graph_id").agg(F.min(F.struct("x", "node", "y")).alias("l"), F.max(F.struct("x", "node", "y")).alias("r"))
    rows = rows.join(pair.select("graph_id", F.col("l.node").alias("node_a"), F.col("r.node").alias("node_b"), F.col("r.x").alias("bx"), F.col("r.y").alias("by")), "graph_id")
    arms = spark.createDataFrame([("shipped", 0.0, 5.0, [], None, False), ("oracle", 20.0, 5.0, ["component_join"], None, True)], "arm string, radius double, snap double, kinds array<string>, min_purity double, reorder boolean")
    got = E.score_arms(truth, mask, raw, rows, arms, grids, TIDY, buffers=(5.0,), radii=(5.0,)).collect()
    value = {(r["graph_id"], r["arm"], r["metric"]): r["value"] for r in got}
    assert {g for g, _, _ in value} == {"a", "b"}
    assert value["a", "oracle", "apls_reference"] >= value["a", "shipped", "apls_reference"] and value["a", "shipped", "n_added"] == 0
    assert value["a", "oracle", "n_selected"] == 1


def test_gaps_hurt_routes_more_than_pixels(scene):
    truth, mask, grids = scene
    x = {r["gaps"]: r for r in E.divergence(truth, mask, grids, [0, 6], [0, 1], 3, TIDY).where("graph_id = 'a'").collect()}
    assert x[0]["iou"] == 1 and x[6]["iou"] < 1 and x[0]["apls"] - x[6]["apls"] > x[0]["iou"] - x[6]["iou"]


def test_coverage_patterns(spark):
    grids = spark.createDataFrame([(f"c{k}", 64, 48) for k in range(60)], "chip string, height int, width int")
    pixels = grids.select("chip", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(47))))
    share = lambda c, s=None: K.covered(pixels, K.patterns(grids, c, 5, s)).groupBy("chip").agg(F.avg(F.col("covered").cast("double")).alias("v")).toPandas().v
    assert (share({"mode": "full"}) == 1).all() and (share({"mode": "none"}) == 0).all()
    for mode in ("strips", "blocks"):
        v = share({"mode": mode}, 0.5)
        assert 0.4 < v.mean() < 0.6 and v.min() > 0.2
        drawn = share({"mode": mode})
        assert (drawn == 0).any() and (drawn == 1).any() and ((drawn > 0) & (drawn < 1)).any()
    for bad in ({"mode": "dots"}, {"endpoint_mass": 2}, {"low": 0.9, "high": 0.1}):
        with pytest.raises(ValueError):
            K.checked(bad)
    mask = pixels.where("row = 10")
    gaps = K.draw_gaps(mask, 3, 1)
    assert gaps.groupBy("chip").count().where("count <> 3").count() == 0 and K.draw_gaps(mask, 1000, 1).count() == mask.count()


def test_labelled_nodes(spark):
    line = lambda i, tag, *p: ("g", i, str(i // 2), tag, [{"x": float(x), "y": float(y)} for x, y in p])
    rows = [line(0, "primary", (0, 0), (100, 0)), line(1, "primary", (100, 0), (100, 30)), line(2, "residential", (100, 0), (200, 0)), line(3, "service", (0, 0), (0, 95)), line(4, "primary", (500, 0), (504, 0))]
    pieces = spark.createDataFrame(rows, "graph_id string, line long, osm_id string, highway string, pts array<struct<x:double,y:double>>")
    n = L.chip_nodes(pieces, 20.0).orderBy("line", "k").toPandas()
    assert n.groupby("line").size().to_dict() == {0: 5, 1: 2, 2: 5, 4: 1}
    assert n[n.line == 0].x.tolist() == [10, 30, 50, 70, 90] and (n[n.line == 1].node_length == 15).all() and n[n.line == 4].x.tolist() == [502]
    assert n[n.line == 0].component.iloc[0] == n[n.line == 1].component.iloc[0] != n[n.line == 4].component.iloc[0]
    table = {r["klass"]: r for r in L.class_table(L.chip_nodes(pieces, 20.0), L.other_counts(pieces, 20.0)).collect()}
    assert (table["primary"]["n_nodes"], table["primary"]["n_ways"], table["primary"]["n_components"], table["primary"]["length"]) == (8, 2, 2, 134.0)
    assert table["other"]["n_nodes"] == 5 and table["motorway"]["n_nodes"] == 0
    sizes = {r["unit"]: r["largest"] for r in L.cluster_table(L.chip_nodes(pieces, 20.0), {"way": ["way"], "component": ["chip", "klass", "component"]}).collect()}
    assert sizes == {"way": 7, "component": 7}


def test_resolvability(spark):
    nodes = spark.createDataFrame([(f"c{k % 40}", k // 4, "xyz"[(k // 4) % 3]) for k in range(2400)], "chip string, way long, klass string")
    one = lambda a, unit="way": L.resolvability(nodes, unit, ["x", "y", "z"], a, 1, draws=3, boots=30).first()
    right, mixed = one(1.0), one(0.7)
    assert right["macro_f1"] == 1 and right["macro_f1_sem"] == 0 and right["n_nodes"] == 2400 and right["n_units"] == 600 and right["min_class_units"] == 200
    assert 0.6 < mixed["macro_f1"] < 0.8 and mixed["macro_f1_sem"] > 0 and mixed["detectable_0_9"] < mixed["detectable_0"]
    w = L.resample_weights(nodes, 10, 3).groupBy("boot").agg(F.sum("w").alias("w")).collect()
    assert len(w) == 10 and all(r["w"] == 40 for r in w)
    missing = L.resolvability(nodes, "way", ["x", "y", "z", "none"], 0.7, 1, draws=2, boots=5).first()
    assert missing["min_class_nodes"] == 0


def test_tile_graph_has_junctions_inside(spark):
    """A side street that ends on the middle of a main road, cut at the tile's edge."""
    way = lambda i, tag, *p: (str(i), tag, "", [{"x": float(x), "y": float(y)} for x, y in p])
    ways = W.with_boxes(spark.createDataFrame([way(1, "primary", (-50, 50), (150, 50)), way(2, "residential", (40, 50), (40, 300)), way(3, "footway", (0, 0), (100, 100)), way(4, "primary", (900, 900), (950, 950))], "osm_id string, highway string, other_tags string, pts array<struct<x:double,y:double>>"))
    tiles = spark.createDataFrame([("t", {"epsg": 32611, "x_min": 0.0, "y_max": 100.0, "height": 100, "width": 100, "resolution": 1.0})], "graph_id string, tile struct<epsg:int,x_min:double,y_max:double,height:int,width:int,resolution:double>")
    n, e = W.tile_graphs(ways, tiles, "drive", (-500.0, -500.0, 1000.0, 1000.0))
    assert sorted(r["length"] for r in e.collect()) == pytest.approx([40.0, 50.0, 60.0])
    assert {r["degree"] for r in G.degrees(n, e).where("x between 39 and 41 and y between 49 and 51").collect()} == {3}
    assert {r["osm_id"] for r in W.tile_pieces(ways, tiles).collect()} == {"1", "2"}
    with pytest.raises(ValueError):
        W.tile_graphs(ways, tiles, "drive", (0.0, 0.0, 100.0, 100.0))
    plan = W.tile_ways(ways, tiles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_tile_ways_meet_once(spark):
    rng = np.random.default_rng(4)
    at = rng.uniform(-2000, 2000, (150, 2))
    rows = [(str(i), "primary", "", [{"x": x, "y": y}, {"x": x + rng.uniform(-900, 900), "y": y + rng.uniform(-900, 900)}]) for i, (x, y) in enumerate(at.tolist())]
    ways = W.with_boxes(spark.createDataFrame(rows, "osm_id string, highway string, other_tags string, pts array<struct<x:double,y:double>>"))
    grid = [(f"{i},{j}", {"epsg": 32611, "x_min": 700.0 * i - 2000, "y_max": 700.0 * j - 1300, "height": 700, "width": 700, "resolution": 1.0}) for i in range(5) for j in range(5)]
    tiles = spark.createDataFrame(grid, "graph_id string, tile struct<epsg:int,x_min:double,y_max:double,height:int,width:int,resolution:double>")
    got = sorted((r["graph_id"], r["osm_id"]) for r in W.tile_ways(ways, tiles, pad=30.0).collect())
    want = []
    for g, t in grid:
        x0, y1 = t["x_min"] - 30, t["y_max"] + 30
        x1, y0 = x0 + 760, y1 - 760
        for i, _, _, (p, q) in rows:
            if max(p["x"], q["x"]) >= x0 and min(p["x"], q["x"]) <= x1 and max(p["y"], q["y"]) >= y0 and min(p["y"], q["y"]) <= y1:
                want.append((g, i))
    assert got == sorted(want)


def test_ranks_and_fronts(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v)) for k, v in enumerate(rng.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "k long, v double")
    got = [(r["v"], r["k"]) for r in ranked(df, "v", "k").orderBy("rank").collect()]
    assert got == sorted((v, k) for k, v in rows) and [r["rank"] for r in ranked(df, "v", "k").orderBy("rank").collect()] == list(range(500))
    assert ranked(df.where("false"), "v").count() == 0
    pts = [(int(k), *map(float, p)) for k, p in enumerate(rng.integers(0, 12, (300, 3)))]
    front = {r["k"] for r in T.pareto_front(spark.createDataFrame(pts, "k long, a double, b double, c double"), ["k"], ["a", "b", "c"]).collect()}
    beaten = lambda p: any(all(x >= y for x, y in zip(q[1:], p[1:])) and q[1:] != p[1:] for q in pts)
    assert front == {p[0] for p in pts if not beaten(p)}


def test_whole_tiles_are_mirrored_for_a_model(spark):
    tiles = spark.createDataFrame([("a", r, c, float(r * 10 + c)) for r in range(5) for c in range(7)], "chip string, row int, col int, value double")
    seen = X.infer(tiles, lambda x: (x[..., 0] * 0 + x.shape[0] * 100 + x.shape[1]) if x.shape[:2] == (8, 8) else x[..., 0], ["value"], 8).collect()
    assert len(seen) == 35 and {r["logit"] for r in seen} == {808.0}
    padded, size = fields.reflect_padded(np.arange(15.0).reshape(3, 5), 4)
    assert padded.shape == (4, 8) and size == (3, 5) and padded[3].tolist() == padded[1].tolist() and padded[0, 5:].tolist() == [3, 2, 1]


def test_losses_blend():
    z, y = np.array([[8.0, -8.0], [3.0, -1.0]]), np.array([[1.0, 0.0], [1.0, 0.0]])
    bce = np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z))))
    p = 1 / (1 + np.exp(-z))
    assert kernels.segmentation_loss(z, y, 0.0) == pytest.approx(bce) and kernels.segmentation_loss(z, y, 1.0) == pytest.approx(kernels.soft_dice_loss(p, y))
    mixed = kernels.segmentation_loss(z, y, 0.5, 0.25)
    assert mixed == pytest.approx(0.75 * kernels.segmentation_loss(z, y, 0.5) + 0.25 * kernels.soft_cldice_loss(p, y))


def test_synthetic_tiles_stand_alone(spark):
    both = chips.synthetic(spark, [(0.0, 0.0), (500.0, 0.0)], 48, 3)
    alone = chips.synthetic(spark, [(500.0, 0.0)], 48, 3)
    at = lambda df: df.where("chip = '500_0'").orderBy("row", "col").toPandas()
    a, b = at(both), at(alone)
    assert a.equals(b) and len(a) == 48 * 48 and a["mask"].any() and not a["mask"].all()
    assert a.red[a["mask"]].mean() > a.red[~a["mask"]].mean() and a[["red", "green", "blue", "intensity"]].stack().between(0, 1).all() and (a.ndsm >= 0).all()
    rng = np.random.default_rng(0)
    assert abs(fields.canopy((200, 200), rng, 0.3).mean() - 0.3) < 0.01 and not fields.canopy((9, 9), rng, 0.0).any()
    lift = fields.deck_lift((40, 40), [(np.arange(1600).reshape(40, 40) % 40 == 20, (20.0, 20.0))])
    assert lift[20, 20] == 6 and lift[20, 21] == 0 and 0 < lift[10, 20] < 6


def test_overpasses_rise(spark):
    line = lambda g, i, u, v, *p: (g, i, u, v, [{"x": float(x), "y": float(y)} for x, y in p])
    rows = [line("a", 0, 0, 1, (5, 20), (35, 20)), line("a", 1, 2, 3, (20, 5), (20, 35)), line("b", 0, 0, 1, (5, 20), (20, 20)), line("b", 1, 1, 2, (20, 20), (20, 35))]
    edges = spark.createDataFrame(rows, "graph_id string, edge long, u long, v long, pts array<struct<x:double,y:double>>")
    grids = spark.createDataFrame([("a", 40, 40), ("b", 40, 40)], "chip string, height int, width int")
    got = {(r["row"], r["col"]): r["lift"] for r in R.overpass_lift(edges, grids, 6.0, 5.0, 1).where("chip = 'a'").collect()}
    assert R.overpass_lift(edges, grids).where("chip = 'b'").count() == 0  # they share a node
    assert got[20, 20] == pytest.approx(6) and got[20, 25] == pytest.approx(6 * math.exp(-0.5)) and (25, 20) not in got and {r for r, _ in got} == {19, 20, 21}


def test_tile_sources(spark, tmp_path):
    src = registry.TableSource(spark.createDataFrame([("b", 0, 0, 1.0), ("a", 0, 0, 2.0), ("a", 0, 1, 3.0)], "chip string, row int, col int, value double"))
    ids = src.ids()
    assert [(r["sample_id"], r["pos"]) for r in ids.orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    assert src.load(ids.where("pos = 0")).count() == 2
    with pytest.raises(KeyError):
        src.load(spark.createDataFrame([("z",)], "sample_id string"))
    for area in ("x", "y"):
        (tmp_path / area / "labels").mkdir(parents=True)
    (tmp_path / "x" / "labels" / "l_img1.geojson").write_text("{}")
    (tmp_path / "y" / "labels" / "notes.txt").write_text("")
    assert chips.aoi_roots(spark, str(tmp_path)) == ["x"]


def test_degrees_of_a_box():
    for epsg, lon, lat in ((32611, -115.2, 36.1), (32733, 15.5, -33.9)):
        x, y = kernels.utm(np.array([lon]), np.array([lat]), epsg)[0]
        assert kernels.lonlat(np.array([x]), np.array([y]), epsg)[0] == pytest.approx([lon, lat], abs=1e-9)
        west, south, east, north = kernels.lonlat_bounds((x, y, x + 500, y + 500), epsg, 50.0)
        assert west < lon < east and south < lat < north and east - west < 0.01


def test_auxiliary_channels(spark):
    df = spark.createDataFrame([(4.0, 0.5, True, True), (4.0, 0.5, True, False)], "h double, i double, valid boolean, covered boolean")
    got = [r[0] for r in df.select(scalars.aux_stack({"h": (F.col("h"), 8.0, 0.0), "i": (F.col("i"), 1.0, -1.0)}, F.col("valid"), F.col("covered"))).collect()]
    assert got == [[0.5, 0.5, 1.0], [0.0, -1.0, 0.0]]


def test_drawing_and_tracing_in_one_kernel(scene):
    truth, mask, grids = scene
    one = {r["graph_id"]: (r["length"], r["n_edges"]) for r in G.total_length(G.drawn_and_traced(truth[1], grids, 2)[1]).collect()}
    two = {r["graph_id"]: (r["length"], r["n_edges"]) for r in G.total_length(G.trace(mask, grids)[1]).collect()}
    assert one == two and set(one) == {"a", "b"}
    assert geom.STRAIGHT == 0.012


def test_distances_by_matrix_and_by_heap(monkeypatch):
    rng = np.random.default_rng(2)
    g = kernels.Graph({i: tuple(rng.uniform(0, 100, 2)) for i in range(40)}, [])
    g.edges = [(int(a), int(b), np.array([g.nodes[a], g.nodes[b]])) for a, b in rng.integers(0, 40, (55, 2))]
    some = [3, 7, 7, 30, 0]
    dense = g.distances_among(some)
    ids, every = g.all_distances()
    monkeypatch.setattr(kernels, "DENSE", 0)
    assert np.allclose(dense, g.distances_among(some)) and np.allclose(every, g.distances_among(ids.tolist()))
