"""Polyline and tile functions as column expressions (JVM side).

A polyline is array<struct<x,y>>; with fewer than two points its length is 0. Rounding is half to
even (`rint`, `bround`) wherever a grid is hit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import guard

#: A line whose length differs from its box diagonal by less than this share counts as straight.
STRAIGHT = 0.012
#: Lines shorter than this share of the spacing get no control point.
SHORT = 0.75


def point(x: Column | float, y: Column | float) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def segment_lengths(pts: Column) -> Column:
    """Lengths of consecutive segments; empty below two points."""
    n = F.size(pts)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(
        F.zip_with(F.slice(pts, 1, F.greatest(n - 1, F.lit(1))), F.slice(pts, 2, F.greatest(n - 1, F.lit(1))), distance)
    )


def polyline_length(pts: Column) -> Column:
    return F.aggregate(segment_lengths(pts), F.lit(0.0), lambda a, d: a + d)


def box_diagonal(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.hypot(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def oriented(pts: Column, ux: Column, uy: Column, u: Column, v: Column) -> Column:
    """The line running from node u: reversed if its first point is farther from u than its last; loops stay."""
    here = point(ux, uy)
    return F.when((u != v) & (distance(F.get(pts, F.lit(0)), here) > distance(F.element_at(pts, -1), here)), F.reverse(pts)).otherwise(pts)


def edge_polyline(geometry: Column, a: Column, b: Column) -> Column:
    """An edge's geometry, or the straight line between its ends."""
    return F.coalesce(geometry, F.array(a, b))


def uniform_cuts(total: Column, spacing: Column | float) -> Column:
    """Arc lengths i * spacing below the total, i = 1, 2, ..."""
    s = spacing if isinstance(spacing, Column) else F.lit(float(spacing))
    n = (F.ceil(total / s) - 1).cast("int")
    return F.when(n < 1, F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i * s))


def control_cuts(pts: Column, spacing: float, sampling: str = "reference") -> Column:
    """Arc lengths where a line gets control points.

    uniform: every `spacing`. reference: none on straight or short lines, the middle up to one
    spacing, else ceil(total / spacing) equal parts.
    """
    total = polyline_length(pts)
    if sampling == "uniform":
        return uniform_cuts(total, spacing)
    if sampling != "reference":
        raise ValueError(f"unknown sampling {sampling!r}")
    none = F.array().cast("array<double>")
    k = F.ceil(total / F.lit(float(spacing))).cast("int")
    equal = F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: i * total / k)
    return (
        F.when(total <= 0, none)
        .when(F.abs(box_diagonal(pts) - total) / total < STRAIGHT, none)
        .when(total < SHORT * spacing, none)
        .when(total <= spacing, F.array(total / 2))
        .otherwise(equal)
    )


def along(pts: Column, s: Column) -> Column:
    """The point at arc length s, held to the line's ends."""
    seg = segment_lengths(pts)
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0).alias("i"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(acc: Column, d: Column) -> Column:
        a, b = F.get(pts, acc["i"]), F.get(pts, acc["i"] + 1)
        t = F.when(d > 0, F.greatest(F.lit(0.0), (s - acc["done"]) / F.when(d > 0, d))).otherwise(0.0)
        here = F.when(acc["at"].isNull() & (s <= acc["done"] + d), point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))
        return F.struct((acc["done"] + d).alias("done"), (acc["i"] + 1).alias("i"), F.coalesce(acc["at"], here).alias("at"))

    return F.coalesce(F.aggregate(seg, start, step)["at"], F.element_at(pts, -1))


def resample(pts: Column, spacing: float) -> Column:
    """max(ceil(L / spacing) + 1, 2) evenly spaced points, both ends included."""
    total = polyline_length(pts)
    n = F.greatest(F.ceil(total / F.lit(float(spacing))).cast("int") + 1, F.lit(2))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: along(pts, i * total / (n - 1)))


def midpoints(pts: Column, count: Column) -> Column:
    """The middles of `count` equal spans."""
    total = polyline_length(pts)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: along(pts, (i + 0.5) * total / count))


def shifted(pts: Column, dx: float, dy: float) -> Column:
    return F.transform(pts, lambda p: point(p["x"] + dx, p["y"] + dy))


def rounded(pts: Column, places: int = 1) -> Column:
    return F.transform(pts, lambda p: point(F.bround(p["x"], places), F.bround(p["y"], places)))


def bowed(a: Column, b: Column, amplitude: float, count: int) -> Column:
    """A line from a to b bowed sideways by a half sine of the given amplitude."""
    d = distance(a, b)
    nx, ny = -(b["y"] - a["y"]) / d, (b["x"] - a["x"]) / d

    def at(i: Column) -> Column:
        t = i / float(count - 1)
        w = amplitude * F.sin(F.lit(math.pi) * t)
        return point(a["x"] + t * (b["x"] - a["x"]) + w * nx, a["y"] + t * (b["y"] - a["y"]) + w * ny)

    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)


def world_to_px(x: Column, y: Column, tile: Column) -> Column:
    return point((x - tile["x_min"]) / tile["resolution"], (tile["y_max"] - y) / tile["resolution"])


def px_to_world(x: Column, y: Column, tile: Column) -> Column:
    return point(tile["x_min"] + x * tile["resolution"], tile["y_max"] - y * tile["resolution"])


def bounds_world(tile: Column) -> Column:
    return F.struct(
        tile["x_min"].alias("minx"),
        (tile["y_max"] - tile["height"] * tile["resolution"]).alias("miny"),
        (tile["x_min"] + tile["width"] * tile["resolution"]).alias("maxx"),
        tile["y_max"].alias("maxy"),
    )


def utm_epsg(lat: Column, lon: Column) -> Column:
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def tile(epsg: Column, x_min: Column, y_max: Column, height: Column, width: Column, resolution: Column) -> Column:
    return F.struct(
        epsg.cast("int").alias("epsg"), x_min.cast("double").alias("x_min"), y_max.cast("double").alias("y_max"),
        height.cast("int").alias("height"), width.cast("int").alias("width"), resolution.cast("double").alias("resolution"),
    )


def tile_from_center(epsg: Column, x: Column, y: Column, size_m: Column, resolution: Column) -> Column:
    n = F.rint(size_m / resolution).cast("int")
    return tile(epsg, x - n * resolution / 2, y + n * resolution / 2, n, n, resolution)


def tile_from_transform(epsg: Column, a: Column, b: Column, c: Column, d: Column, e: Column, f: Column, height: Column, width: Column) -> Column:
    """A tile of an affine transform; geographic, sheared or non-square grids raise."""
    close = lambda p, q: F.abs(p - q) <= 1e-8 + 1e-5 * F.abs(q)
    good = tile(epsg, c, f, height, width, a)
    return guard(good, (epsg != 4326, "the grid must be projected"), (close(b, F.lit(0.0)) & close(d, F.lit(0.0)), "the grid is sheared"), (close(a, -e), "pixels are not square"))


def tile_center(t: Column) -> Column:
    return point(t["x_min"] + t["width"] * t["resolution"] / 2, t["y_max"] - t["height"] * t["resolution"] / 2)


def dihedral(row: Column, col: Column, n: int, index: Column | int) -> Column:
    """Pixel (row, col) of an n x n grid under symmetry 2 * quarter turns + flip; out of range raises."""
    i = index if isinstance(index, Column) else F.lit(index)
    k, flip = F.floor(i / 2).cast("int"), i % 2
    r, c = row, col
    turned = (
        F.when(k == 0, F.struct(r.alias("row"), c.alias("col")))
        .when(k == 1, F.struct((n - 1 - c).alias("row"), r.alias("col")))
        .when(k == 2, F.struct((n - 1 - r).alias("row"), (n - 1 - c).alias("col")))
        .otherwise(F.struct(c.alias("row"), (n - 1 - r).alias("col")))
    )
    out = F.struct(turned["row"].alias("row"), F.when(flip == 1, n - 1 - turned["col"]).otherwise(turned["col"]).alias("col"))
    return guard(out, ((i >= 0) & (i < 8), "symmetries are numbered 0 to 7"))
