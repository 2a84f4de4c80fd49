"""Damage by gaps: one kernel a chip, without rows a pixel on the way, as the plain operators give it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stradale.operators import coverage, evaluate, graph, metrics, raster
from stradale.store import stored

TIDY = (1.0, 8.0, 4.0)


@pytest.fixture(scope="module")
def scene(spark):
    """Crosses of roads in chips a to e; c has no pixels, d no grid, e no roads."""
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    spots = [(0, 5.0, 30.0), (1, 30.0, 30.0), (2, 55.0, 30.0), (3, 30.0, 5.0), (4, 30.0, 55.0)]
    nodes = spark.createDataFrame([(g, n, x, y) for g in "abcde" for n, x, y in spots], "graph_id string, node long, x double, y double")
    arms = [(0, 0, 1), (1, 1, 2), (2, 3, 1), (3, 1, 4)]
    rows = [(g, e, u, v, line(spots[u][1:], spots[v][1:]), 25.0) for g in "abcd" for e, u, v in arms]
    edges = spark.createDataFrame(rows, "graph_id string, edge long, u long, v long, pts array<struct<x:double,y:double>>, length double")
    grids = spark.createDataFrame([(g, 60, 60) for g in "abcde"], "chip string, height int, width int")
    mask = raster.draw_edges(edges, grids, 2).where("chip <> 'c'")
    return (stored(spark, nodes, "nodes"), stored(spark, edges, "edges")), stored(spark, mask, "mask"), stored(spark, grids.where("chip <> 'd'"), "grids")


def shuffled(spark):
    """Rows that were written to exchanges so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_row_a_pixel_is_exchanged(spark, scene):
    truth, mask, grids = scene
    whole = stored(spark, raster.masks(mask), "whole")
    pixels, before = mask.count(), shuffled(spark)
    assert len(evaluate.divergence(truth, whole, grids, [0, 2, 5], [0, 1, 2], 3, TIDY).collect()) == 12
    assert shuffled(spark) - before < pixels / 4
    before = shuffled(spark)
    assert len(evaluate.divergence(truth, mask, grids, [0, 2, 5], [0, 1, 2], 3, TIDY).collect()) == 12
    assert pixels <= shuffled(spark) - before < 2 * pixels


def test_query_exchanges_no_row_a_pixel(spark, sf):
    from stradale.plans import QUERIES

    before = shuffled(spark)
    n = QUERIES["gap_divergence"](spark, sf).first()["n"]
    assert shuffled(spark) - before < 200 * n  # a chip has 3,388 pixels


def test_as_the_plain_operators(spark, scene):
    truth, mask, grids = scene
    got = {(r.graph_id, r.gaps): r for r in evaluate.divergence(truth, mask, grids, [0, 2, 5], [4, 9], 3, TIDY).collect()}
    assert set(got) == {(g, n) for g in "abcd" for n in (0, 2, 5)}
    chips = grids.select("chip").union(mask.select("chip")).distinct()
    for n in (0, 2, 5):
        want = []
        for seed in (4, 9):
            hurt = stored(spark, raster.punch_gaps(mask, coverage.draw_gaps(mask, n, seed, 3)), "hurt")
            score = metrics.apls(truth, graph.clean(*graph.trace(hurt, grids), *TIDY)).select("graph_id", "apls")
            want += score.join(metrics.iou(hurt, mask, chips).withColumnRenamed("chip", "graph_id"), "graph_id").collect()
        for g in "abcd":
            mine = [r for r in want if r.graph_id == g]
            assert len(mine) == 2
            assert got[g, n].apls == pytest.approx(sum(r.apls for r in mine) / 2, abs=1e-12)
            assert got[g, n].iou == pytest.approx(sum(r.iou for r in mine) / 2, abs=1e-12)
    assert got["c", 5].iou == 1 and got["c", 5].apls == 0 and got["d", 0].apls == 0 and got["d", 5].iou < 1 and got["a", 0].apls > 0.9


def test_draws_are_those_of_draw_gaps(spark, scene):
    mask = scene[1].unionByName(spark.createDataFrame([("é|x", -3, 7), ("é|x", 1000, -2), ("é|x", 0, 0)], "chip string, row int, col int"))
    whole = {r.chip: r for r in raster.masks(mask.union(mask)).collect()}
    for n, seed in ((3, 5), (1000, -2)):
        drawn = {(r.chip, r.row0 + 2, r.col0 + 2) for r in coverage.draw_gaps(mask, n, seed).collect()}
        mine = set()
        for chip, m in whole.items():
            r, c = raster.unpacked(*m[1:])
            k = coverage.first_drawn(chip, r, c, n, seed)
            mine |= {(chip, a, b) for a, b in zip(r[k].tolist(), c[k].tolist())}
        assert mine == drawn


def test_masks_hold_the_pixels(spark, scene):
    truth, mask, grids = scene
    want = {(r.chip, r.row, r.col) for r in mask.where("chip not in ('d', 'e')").collect()}
    for whole in (raster.masks(mask), raster.draw_masks(truth[1].where("graph_id <> 'c'"), grids, 2)):
        got = {(m.chip, r, c) for m in whole.where(F.col("chip").isin("a", "b")).collect() for r, c in zip(*map(np.ndarray.tolist, raster.unpacked(*m[1:])))}
        assert got == want
