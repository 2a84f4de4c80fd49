"""Pixel relations, whose files are far smaller than their rows, never go to the driver."""

import pytest

from stradale.operators import coverage, evaluate, graph, raster
from stradale.store import stored


@pytest.fixture(scope="module")
def scene(spark):
    """Chips a and b with full masks of 40 x 40, c without pixels."""
    mask = spark.sql("select c as chip, cast(id div 40 as int) as row, cast(id % 40 as int) as col from range(1600) cross join (select explode(array('a', 'b')) as c)")
    grids = spark.sql("select explode(array('a', 'b', 'c')) as chip, 40 as height, 40 as width")
    return stored(spark, mask, "scene"), stored(spark, grids, "grids")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_are_not_broadcast_for_damage(scene):
    mask, _ = scene
    assert "Broadcast" not in plan(raster.punch_gaps(mask, coverage.draw_gaps(mask, 3, 1)))


def test_pixels_are_not_broadcast_for_tracing(scene):
    mask, grids = scene
    assert "Broadcast" not in plan(graph.trace(mask, grids)[1])


def test_pixels_are_not_broadcast_for_grid_points(spark, scene):
    points = spark.sql("select explode(array('a', 'b')) as graph_id").selectExpr("graph_id", "concat(graph_id, '1') as point")
    assert "Broadcast" not in plan(evaluate.fanned(scene[0], points, "chip"))


def test_gaps_one_by_one(spark, scene):
    gaps = spark.createDataFrame([("a", 0, 0, 5), ("a", 3, 3, 5), ("a", 38, 38, 5), ("d", 0, 0, 40)], "chip string, row0 int, col0 int, size int")
    got = {(r.chip, r.row, r.col) for r in raster.punch_gaps(scene[0], gaps).collect()}
    hit = {("a", r, c) for r0, c0 in ((0, 0), (3, 3), (38, 38)) for r in range(r0, r0 + 5) for c in range(c0, c0 + 5)}
    assert got == {(k, r, c) for k in "ab" for r in range(40) for c in range(40)} - hit
