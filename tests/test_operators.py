"""Operators over DataFrames: invariants that the kernels' facts do not cover."""

import math

import pytest
from pyspark.sql import functions as F

from stradale.functions import geom, scalars
from stradale.operators import candidates as C
from stradale.operators import graph as G
from stradale.operators import metrics as M
from stradale.operators import spatial as S
from stradale.operators import split as P
from stradale.operators import stats as T
from stradale.plans import views as V
from stradale.sources import registry, sinks


@pytest.fixture(scope="module")
def truth(spark, sf):
    return V.grid_nodes(spark, sf), V.grid_edges(spark, sf, bowed=True)


def test_identity_scores_one(truth):
    r = M.apls(truth, truth).agg(F.min("apls"), F.max("apls")).first()
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(1)


def test_damage_lowers_the_score(spark, sf, truth):
    got = [M.apls(truth, (truth[0], V.grid_edges(spark, sf, True, d))).agg(F.avg("apls")).first()[0] for d in (0, 15, 50)]
    assert got[0] > got[1] > got[2]


def test_decomposition_adds_up(spark, sf, truth):
    d = M.score_pairs(M.route_pairs(truth, (truth[0], V.grid_edges(spark, sf, True, 30))))
    x = d.select("score", scalars.loss_shares(F.col("score_sum"), F.col("n_unlanded"), F.col("n_no_path"), F.col("n_pairs")).alias("s")).select("score", "s.*").toPandas()
    assert (x.unlanded + x.no_path + x.length_error + x.score).tolist() == pytest.approx([1] * len(x))


def test_barbell_bridge_matters(spark):
    from tests.test_kernels import grid  # noqa: PLC0415

    a, b = grid(), grid(dx=500.0)
    n = [("g", k, *p) for k, p in a.nodes.items()] + [("g", 16 + k, *p) for k, p in b.nodes.items()]
    e = [("g", i, u, v, G.rows_of(p)) for i, (u, v, p) in enumerate(a.edges)] + [("g", 24 + i, 16 + u, 16 + v, G.rows_of(p)) for i, (u, v, p) in enumerate(b.edges)]
    right = {p: k for k, p in a.nodes.items()}[(300.0, 0.0)]
    left = 16 + {p: k for k, p in b.nodes.items()}[(500.0, 0.0)]
    e.append(("g", 48, right, left, [{"x": 300.0, "y": 0.0}, {"x": 500.0, "y": 0.0}]))
    nodes = spark.createDataFrame(n, "graph_id string, node long, x double, y double")
    edges = spark.createDataFrame(e, "graph_id string, edge long, u long, v long, pts array<struct<x:double,y:double>>").withColumn("length", geom.polyline_length(F.col("pts")))
    cut = edges.where("edge <> 48")
    share = 200 / G.total_length(edges).first()["length"]
    loss = 1 - M.apls((nodes, edges), (nodes, cut)).first()["apls"]
    assert share < 0.1 and loss > 3 * share


def test_shift_and_snap(truth, spark, sf):
    moved = truth[0].withColumn("x", F.col("x") + 12), truth[1].withColumn("pts", geom.shifted(F.col("pts"), 12.0, 9.0))
    far = M.apls(truth, moved, max_snap=25).agg(F.avg("apls")).first()[0]
    near = M.apls(truth, moved, max_snap=5).agg(F.avg("apls")).first()[0]
    assert far > 0.9 and near < far


def test_buffer_grows(truth):
    moved = truth[1].withColumn("pts", geom.shifted(F.col("pts"), 8.0, 0.0))
    f = [M.buffer_prf(truth[1], moved, b).agg(F.avg("f1")).first()[0] for b in (5.0, 10.0)]
    assert f[0] < 0.75 and f[1] > 0.95


def test_empty_sides(spark, sf, truth):
    none = truth[0].where("false"), truth[1].where("false")
    assert M.apls(truth, none).agg(F.max("apls")).first()[0] == 0
    b = M.buffer_prf(truth[1], none[1], 10.0).first()
    assert b["precision"] == 1 and b["recall"] == 0
    j = M.junction_prf(truth, none).first()
    assert j["precision"] == 1 and j["recall"] == 0 and j["degree_agreement"] is None and j["mean_offset"] is None


def test_radius_join_plan_has_no_nested_loop(spark, sf):
    pts = spark.createDataFrame(V.points(spark, sf).toPandas())
    plan = S.radius_pairs(pts, 75.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_labels_are_nested_in_snap(spark, sf):
    t, p = (V.grid_nodes(spark, sf), V.grid_edges(spark, sf)), (V.grid_nodes(spark, sf), V.grid_edges(spark, sf, drop=15))
    c = C.proposal_distance(C.endpoint_candidates(*p, 150.0), p[1], G.path_lengths(*p))
    x = C.label(c.join(C.truth_distances(t, c, [5.0, 30.0]), ["graph_id", "cand"]))
    n = {r["snap"]: r["count"] for r in x.where("label = 'positive'").groupBy("snap").count().collect()}
    assert n.get(5.0, 0) <= n.get(30.0, 0)


def test_connectors_close_a_gap(spark):
    pts = lambda *q: [{"x": float(x), "y": float(y)} for x, y in q]
    nodes = spark.createDataFrame([("g", 0, 0.0, 0.0), ("g", 1, 100.0, 0.0), ("g", 2, 130.0, 0.0), ("g", 3, 230.0, 0.0)], "graph_id string, node long, x double, y double")
    edges = spark.createDataFrame([("g", 0, 0, 1, pts((0, 0), (100, 0))), ("g", 1, 2, 3, pts((130, 0), (230, 0)))], "graph_id string, edge long, u long, v long, pts array<struct<x:double,y:double>>").withColumn("length", geom.polyline_length(F.col("pts")))
    c = C.endpoint_candidates(nodes, edges, 60.0).where("kind = 'endpoint'")
    n, e, added = C.add_connectors(nodes, edges, c)
    assert added.first()["added"] == 1 and G.total_length(e).first()["length"] == pytest.approx(230)


def test_split_round_trip(spark, sf, tmp_path):
    a = P.blocked(V.placement(spark, sf), 0.2, 640.0, seed=3)
    f = P.freeze(a, "b", "blocked", {"fraction": 0.2, "block_m": 640.0, "seed": 3}, {"n": 10})
    path = str(tmp_path / "split")
    P.write_frozen(spark, path, f)
    back = P.read_frozen(spark, path)
    assert back.digest == f.digest
    P.rebuild(V.placement(spark, sf), back)
    bad = P.Frozen(f.name, f.splitter, f.params, f.source, {**f.sides, "train": f.sides["train"][::-1]})
    assert bad.digest != f.digest
    with pytest.raises(ValueError):
        P.rebuild(V.placement(spark, sf), bad)


def test_t_quantile_and_power():
    assert T.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert T.t_quantile(0.975, 1) == pytest.approx(12.7062, abs=1e-3)
    assert scalars.detectable_difference(0.01) == pytest.approx(0.0396, abs=1e-3)


def test_logit_and_networks():
    assert scalars.logit(0) == -math.inf and scalars.logit(1) == math.inf
    with pytest.raises(ValueError):
        scalars.logit(1.5)
    with pytest.raises(ValueError):
        scalars.network_mask(F.lit("x"), {}, "walk")
    with pytest.raises(KeyError):
        registry.load(registry.TILES, "nowhere")


def test_tile_functions(spark):
    t = spark.range(1).select(geom.tile_from_center(F.lit(32611), F.lit(1000.0), F.lit(2000.0), F.lit(512.0), F.lit(1.0)).alias("t"))
    r = t.select("t.*", geom.tile_center(F.col("t")).alias("c"), geom.px_to_world(F.lit(3.0), F.lit(4.0), F.col("t")).alias("w"), geom.utm_epsg(F.lit(36.2), F.lit(-115.1)).alias("e")).first()
    assert (r["x_min"], r["y_max"], r["height"]) == (744.0, 2256.0, 512) and (r["c"]["x"], r["c"]["y"]) == (1000.0, 2000.0)
    assert (r["w"]["x"], r["w"]["y"]) == (747.0, 2252.0) and r["e"] == 32611
    with pytest.raises(Exception, match="square"):
        x = [F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -2.0, 0.0)]
        spark.range(1).select(geom.tile_from_transform(F.lit(32611), *x, F.lit(5), F.lit(5)).alias("t")).collect()


def test_column_lines_match_kernels(spark):
    import numpy as np

    from stradale.functions import kernels as K

    p = np.array([(0, 0), (30, 40), (30, 100), (90, 100)], float)
    df = spark.createDataFrame([(G.rows_of(p),)], "pts array<struct<x:double,y:double>>")
    r = df.select(geom.polyline_length(F.col("pts")).alias("n"), geom.control_cuts(F.col("pts"), 50.0).alias("c"), geom.along(F.col("pts"), F.lit(77.0)).alias("a"), F.size(geom.resample(F.col("pts"), 20.0)).alias("k")).first()
    assert r["n"] == pytest.approx(170) and r["c"] == pytest.approx(K.control_cuts(p, 50)) and r["k"] == 10
    assert (r["a"]["x"], r["a"]["y"]) == pytest.approx(tuple(K.at(p, 77.0)))


def test_script_safe():
    assert "</" not in sinks.script_safe('{"a": "</script>"}')


def test_streaming_scores_once(spark, sf, tmp_path):
    from stradale.streaming import score_arrivals

    V.grid_edges(spark, sf).select("graph_id", "length").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("graph_id string, length double").parquet(str(tmp_path / "in"))
    q = score_arrivals(s, lambda b: b.groupBy("graph_id").agg(F.sum("length").alias("length")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_fetch_backs_off_and_takes_no_for_an_answer():
    from stradale.sources.fetch import NoWays, fetch

    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return [1]

    assert fetch(flaky, sleep=waits.append) == [1] and waits == [1.0, 2.0, 0.0]

    def none():
        raise NoWays

    assert fetch(none, sleep=waits.append) == []
    with pytest.raises(OSError):
        fetch(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_warp_is_bilinear():
    import numpy as np

    from stradale.sources.fetch import warp

    a = np.arange(12.0).reshape(3, 4)
    assert (warp(a, a.shape, lambda r, c: (r, c)) == a).all()
    assert warp(a, (1, 1), lambda r, c: (r + 0.5, c + 0.5))[0, 0] == pytest.approx(2.5)


def test_chips_pair_by_number(spark):
    from stradale.sources.chips import find_chips, holdout

    images = spark.createDataFrame([(f"/a/PS-RGB_img{i}.tif",) for i in (10, 9, 2)], "path string")
    labels = spark.createDataFrame([(f"/b/geojson_img{i}.geojson",) for i in (2, 10, 7)], "path string")
    assert [r["chip"] for r in find_chips(images, labels).collect()] == ["img2", "img10"]
    val = spark.createDataFrame([(f"s{i}", i) for i in range(6)], "sample_id string, pos int")
    assert [r["sample_id"] for r in holdout(val, val.where("pos = 3"), 2, 3).collect()] == ["s2", "s4"]


def test_way_sources(spark, tmp_path):
    from stradale.sources import ways as W

    xml = '<osm><node id="1" lon="-115.14" lat="36.17"/><node id="2" lon="-115.13" lat="36.17"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="residential"/><tag k="access" v="private"/></way><way id="8"><nd ref="1"/><tag k="highway" v="primary"/></way></osm>'
    (tmp_path / "a.osm").write_text(xml)
    w = registry.load(registry.WAYS, "xml", spark, str(tmp_path / "a.osm"))
    assert w.count() == 1 and W.network(w, "drive").count() == 0 and W.network(w, "all").count() == 1
    m = W.to_utm(w.select("osm_id", "highway", "pts"), 32611).select(geom.polyline_length(F.col("pts")).alias("n")).first()["n"]
    assert m == pytest.approx(899.3, abs=1.5)
    w.write.parquet(str(tmp_path / "ways"))
    t = registry.load(registry.WAYS, "table", spark, str(tmp_path / "ways"), (-116.0, 36.0, -115.0, 37.0))
    assert t.count() == 1 and "PushedFilters: [IsNotNull" in t._jdf.queryExecution().executedPlan().toString()


def test_geojson_labels(spark, tmp_path):
    from stradale.sources.chips import label_lines

    (tmp_path / "x_img3.geojson").write_text('{"features": [{"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"geometry": null}, {"geometry": {"type": "MultiLineString", "coordinates": [[[0, 1], [2, 3]], [[5, 5]]]}}]}')
    rows = label_lines(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and {r["graph_id"] for r in rows} == {"img3"}


def test_round_trip_scores_high(spark, sf, truth):
    ids = truth[0].select("graph_id").distinct().limit(2)
    near = lambda d: d.join(ids, "graph_id", "left_semi")
    grids = ids.select(F.col("graph_id").alias("chip"), F.lit(310).alias("height"), F.lit(310).alias("width"))
    e = near(truth[1]).withColumn("pts", geom.shifted(F.col("pts"), 2.0, 2.0))
    n = near(truth[0]).withColumn("x", F.col("x") + 2).withColumn("y", F.col("y") + 2)
    got = M.round_trip((n, e), grids).agg(F.min("apls")).first()[0]
    assert got > 0.9


def test_class_components(spark):
    pts = lambda *q: [{"x": float(x), "y": float(y)} for x, y in q]
    rows = [("g", 0, "a", pts((0, 0), (1, 0))), ("g", 1, "b", pts((1, 0), (2, 0))), ("g", 2, "a", pts((2, 0), (3, 0))), ("g", 3, "a", pts((3, 0), (4, 0)))]
    got = G.class_components(spark.createDataFrame(rows, "graph_id string, line long, klass string, pts array<struct<x:double,y:double>>")).collect()
    by = {r["line"]: (r["klass"], r["component"]) for r in got}
    assert by[2] == by[3] and len(set(by.values())) == 3
