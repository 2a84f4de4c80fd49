"""Spatial joins by grid cells: an equi-join on cells, then the exact test.

A theta join on distance would plan as a nested loop over all pairs. Here each point enters one
cell as wide as the radius, the other side enters the nine cells around it (or the cells that a
segment's box covers), and the exact predicate runs on cell mates only. Dense cells are split by
AQE's skew handling, since both sides are plain exchanges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def _around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Rows repeated for the nine cells around their own."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    return (
        df.withColumn("_dx", F.explode(step))
        .withColumn("_dy", F.explode(step))
        .withColumn("_cx", cell(F.col(x), size) + F.col("_dx"))
        .withColumn("_cy", cell(F.col(y), size) + F.col("_dy"))
        .drop("_dx", "_dy")
    )


def radius_join(left: DataFrame, right: DataFrame, radius: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of points at distance at most radius, equal in `on`.

    left has columns x, y and right has x, y; both keep their other columns with prefixes l_ and r_.
    """
    keys = on or []
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in left.columns if c not in keys])
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    a = a.withColumn("_cx", cell(F.col("l_x"), radius)).withColumn("_cy", cell(F.col("l_y"), radius))
    b = _around(b, "r_x", "r_y", radius)
    d = F.sqrt((F.col("l_x") - F.col("r_x")) * (F.col("l_x") - F.col("r_x")) + (F.col("l_y") - F.col("r_y")) * (F.col("l_y") - F.col("r_y")))
    return a.join(b, [*keys, "_cx", "_cy"]).drop("_cx", "_cy").withColumn("distance", d).where(F.col("distance") <= radius)


def radius_pairs(points: DataFrame, radius: float, key: str = "node", on: str = "graph_id") -> DataFrame:
    """Unordered pairs (a < b) of one graph's points within the radius, inclusive."""
    p = points.select(on, key, "x", "y")
    both = radius_join(p, p.select("*"), radius, [on])
    return both.where(F.col(f"l_{key}") < F.col(f"r_{key}")).select(on, F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"), "distance")


def segments(edges: DataFrame, keep: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """One row a segment: graph_id, edge, seg, ax, ay, bx, by, start (arc length), total."""
    from ..functions import geom

    pts = F.col("pts")
    e = edges.select("graph_id", "edge", *keep, "pts", geom.segment_lengths(pts).alias("_len"))
    e = e.withColumn("_all", F.arrays_zip(F.slice("pts", 1, F.greatest(F.size("pts") - 1, F.lit(1))).alias("p"), F.slice("pts", 2, F.greatest(F.size("pts") - 1, F.lit(1))).alias("q")))
    e = e.where(F.size("pts") > 1).select("graph_id", "edge", *keep, "_len", F.posexplode("_all").alias("seg", "s"))
    start = F.aggregate(F.slice("_len", F.lit(1), F.col("seg")), F.lit(0.0), lambda a, d: a + d)
    total = F.aggregate("_len", F.lit(0.0), lambda a, d: a + d)
    return e.select(
        "graph_id", "edge", *keep, "seg",
        F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"),
        start.alias("start"), total.alias("total"),
    )


def _covered(df: DataFrame, size: float, grow: float) -> DataFrame:
    """Segments repeated for the cells that their box, grown by `grow`, covers."""
    lo = lambda a, b: cell(F.least(a, b) - grow, size)
    hi = lambda a, b: cell(F.greatest(a, b) + grow, size)
    return df.withColumn("_cx", F.explode(F.sequence(lo(F.col("ax"), F.col("bx")), hi(F.col("ax"), F.col("bx"))))).withColumn(
        "_cy", F.explode(F.sequence(lo(F.col("ay"), F.col("by")), hi(F.col("ay"), F.col("by"))))
    )


def nearest_edge(points: DataFrame, edges: DataFrame, radius: float, incident: bool = True) -> DataFrame:
    """Each point's nearest edge within the radius: edge, distance, arc, foot point. Ties: lowest edge id.

    points: graph_id, node, x, y. With incident=False, edges that end in the point's node are left out.
    """
    size = max(float(radius), 1e-9)
    s = _covered(segments(edges), size, radius)
    p = points.select("graph_id", "node", "x", "y").withColumn("_cx", cell(F.col("x"), size)).withColumn("_cy", cell(F.col("y"), size))
    j = p.join(s, ["graph_id", "_cx", "_cy"])
    if not incident:
        j = j.where((F.col("u") != F.col("node")) & (F.col("v") != F.col("node")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n2 = dx * dx + dy * dy
    t = F.when(n2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.when(n2 > 0, n2)))).otherwise(0.0)
    j = j.withColumn("_t", t).withColumn("fx", F.col("ax") + F.col("_t") * dx).withColumn("fy", F.col("ay") + F.col("_t") * dy)
    d = F.sqrt((F.col("x") - F.col("fx")) * (F.col("x") - F.col("fx")) + (F.col("y") - F.col("fy")) * (F.col("y") - F.col("fy")))
    j = j.withColumn("distance", d).where(F.col("distance") <= radius)
    best = F.struct("distance", "edge", "seg", (F.col("start") + F.col("_t") * F.sqrt(n2)).alias("arc"), "total", "fx", "fy")
    return j.groupBy("graph_id", "node").agg(F.min(best).alias("b")).select(
        "graph_id", "node", "b.edge", "b.distance", "b.arc", "b.total", "b.fx", "b.fy"
    )


def crossing_pairs(edges: DataFrame, size: float = 200.0) -> DataFrame:
    """Unordered edge pairs of one graph that cross inside and share no node, with a crossing point."""
    s = _covered(segments(edges), size, 0.0)
    a = s.select("graph_id", "_cx", "_cy", *[F.col(c).alias(f"p_{c}") for c in ("edge", "u", "v", "ax", "ay", "bx", "by")])
    b = s.select("graph_id", "_cx", "_cy", *[F.col(c).alias(f"q_{c}") for c in ("edge", "u", "v", "ax", "ay", "bx", "by")])
    j = a.join(b, ["graph_id", "_cx", "_cy"]).where(F.col("p_edge") < F.col("q_edge"))
    j = j.where((F.col("p_u") != F.col("q_u")) & (F.col("p_u") != F.col("q_v")) & (F.col("p_v") != F.col("q_u")) & (F.col("p_v") != F.col("q_v")))
    c = F.col
    rx, ry, qx, qy = c("p_bx") - c("p_ax"), c("p_by") - c("p_ay"), c("q_bx") - c("q_ax"), c("q_by") - c("q_ay")
    det = rx * qy - ry * qx
    wx, wy = c("q_ax") - c("p_ax"), c("q_ay") - c("p_ay")
    ok = F.when(det != 0, det)
    j = j.withColumn("_s", (wx * qy - wy * qx) / ok).withColumn("_t", (wx * ry - wy * rx) / ok)
    j = j.where((c("_s") > 0) & (c("_s") < 1) & (c("_t") > 0) & (c("_t") < 1))
    at = F.struct((c("p_ax") + c("_s") * rx).alias("x"), (c("p_ay") + c("_s") * ry).alias("y"))
    return j.groupBy("graph_id", c("p_edge").alias("a"), c("q_edge").alias("b")).agg(F.min(at).alias("at"))


def nearest_within(left: DataFrame, right: DataFrame, radius: float, on: list[str], key: str) -> DataFrame:
    """Each left key's distance to its nearest right point within the radius."""
    return radius_join(left, right, radius, on).groupBy(*on, F.col(f"l_{key}").alias(key)).agg(F.min("distance").alias("distance"))


def without_near(left: DataFrame, right: DataFrame, radius: float, on: list[str], key: str) -> DataFrame:
    """Left rows with no right point within the radius."""
    return left.join(nearest_within(left, right, radius, on, key).select(*on, key), [*on, key], "left_anti")
