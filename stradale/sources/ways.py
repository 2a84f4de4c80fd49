"""Way extracts: tagged polylines with boxes, filtered by network and box where they are scanned.

A way table stored as Parquet carries minx, miny, maxx, maxy, so that the box test reaches the scan
as pushed filters; tags other than highway are one HSTORE-like text column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geom, kernels, scalars
from ..operators import graph
from ..store import stored
from .registry import WAYS, register

COLUMNS = ("osm_id", "highway", "other_tags", "pts", "minx", "miny", "maxx", "maxy")


def with_boxes(ways: DataFrame) -> DataFrame:
    """Ways with at least two points and a highway value, their boxes beside them."""
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    ok = ways.where(F.col("highway").isNotNull() & (F.size("pts") >= 2))
    return ok.select(*[c for c in ways.columns if c not in COLUMNS[4:]], F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def network(ways: DataFrame, name: str) -> DataFrame:
    """Ways of a named network."""
    tags = {k: scalars.tag(F.col("other_tags"), k) for k in scalars.filter_tag_keys()}
    return ways.where(scalars.network_mask(F.col("highway"), tags, name))


def in_box(ways: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Ways whose box touches the box; four comparisons that Parquet scans can push down."""
    x0, y0, x1, y1 = box
    return ways.where((F.col("maxx") >= x0) & (F.col("minx") <= x1) & (F.col("maxy") >= y0) & (F.col("miny") <= y1))


def covering_bounds(tiles: DataFrame, pad: float = 0.0) -> tuple[float, float, float, float]:
    """One box over all tiles (column `tile`), padded; no tiles raise."""
    b = tiles.select(geom.bounds_world(F.col("tile")).alias("b"))
    r = b.agg(F.min("b.minx"), F.min("b.miny"), F.max("b.maxx"), F.max("b.maxy")).first()
    if r[0] is None:
        raise ValueError("no tiles to cover")
    return r[0] - pad, r[1] - pad, r[2] + pad, r[3] + pad


def require_inside(box: tuple, extent: tuple) -> None:
    """A box outside an extract's extent raises, rather than giving no ways."""
    if box[0] < extent[0] or box[1] < extent[1] or box[2] > extent[2] or box[3] > extent[3]:
        raise ValueError(f"{box} is not inside the extract's extent {extent}")


def tile_ways(ways: DataFrame, tiles: DataFrame, name: str = "drive", pad: float = 0.0, cell: float = 1024.0) -> DataFrame:
    """Each tile's ways: graph_id, line, osm_id, highway, pts in tile pixels; one scan for all tiles.

    tiles: (graph_id, tile). A way meets the tiles whose box, padded, touches its own. Boxes are joined on the
    grid cells that they cover, so that neither side is broadcast or met by all of the other. Lines are
    numbered within their graph, by osm_id and first point.
    """
    box = geom.bounds_world(F.col("tile"))
    spans = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))
    t = tiles.select("graph_id", "tile", box.alias("b"))
    t = t.select("graph_id", "tile", *[(F.col(f"b.{c}") + d).alias(f"t_{c}") for c, d in (("minx", -pad), ("miny", -pad), ("maxx", pad), ("maxy", pad))])
    t = t.withColumn("_cx", F.explode(spans(F.col("t_minx"), F.col("t_maxx")))).withColumn("_cy", F.explode(spans(F.col("t_miny"), F.col("t_maxy"))))
    w = network(ways, name).select("osm_id", "highway", "pts", "minx", "miny", "maxx", "maxy")
    w = w.withColumn("_cx", F.explode(spans(F.col("minx"), F.col("maxx")))).withColumn("_cy", F.explode(spans(F.col("miny"), F.col("maxy"))))
    j = w.join(t, ["_cx", "_cy"]).where((F.col("maxx") >= F.col("t_minx")) & (F.col("minx") <= F.col("t_maxx")) & (F.col("maxy") >= F.col("t_miny")) & (F.col("miny") <= F.col("t_maxy")))
    # a pair meets in every cell that both cover: only the first one, by its lower left corner, counts
    first = lambda c, lo: F.col(c) == F.floor(F.greatest(F.col(lo), F.col(f"t_{lo}")) / cell).cast("long")
    j = j.where(first("_cx", "minx") & first("_cy", "miny"))
    px = F.transform("pts", lambda p: geom.world_to_px(p["x"], p["y"], F.col("tile")))
    out = j.select("graph_id", "osm_id", "highway", px.alias("pts"), F.col("tile.width").alias("width"), F.col("tile.height").alias("height"))
    line = F.row_number().over(Window.partitionBy("graph_id").orderBy("osm_id", "pts")) - 1
    return out.withColumn("line", line.cast("long"))


def tile_pieces(ways: DataFrame, tiles: DataFrame, name: str = "drive", extent: tuple | None = None, pad: float = 250.0) -> DataFrame:
    """Each tile's ways noded at their crossings and cut at the tile's edge: graph_id, line, osm_id, highway, pts.

    Ways are noded whole, as far as the pad reaches, and cut afterwards, so that a junction at the edge is
    not lost. extent: what the ways were read over; tiles that reach beyond it raise.
    """
    if extent is not None:
        require_inside(covering_bounds(tiles, pad), extent)
    schema = "graph_id string, line long, osm_id string, highway string, pts array<struct<x:double,y:double>>"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line")
        box = (0.0, 0.0, float(rows.width.iloc[0]), float(rows.height.iloc[0]))
        lines = [graph.points(p) for p in rows.pts]
        tag, osm = rows.highway.tolist(), rows.osm_id.tolist()
        out = [(osm[src], tag[src], graph.rows_of(q)) for piece, src in kernels.node_lines(lines) for q in kernels.clip_line(piece, box)]
        got = pd.DataFrame(out, columns=["osm_id", "highway", "pts"])
        return got.assign(graph_id=key[0], line=np.arange(len(got)))[["graph_id", "line", "osm_id", "highway", "pts"]]

    return graph.by_graph(tile_ways(ways, tiles, name, pad)).applyInPandas(run, schema)


def tile_graphs(ways: DataFrame, tiles: DataFrame, name: str = "drive", extent: tuple | None = None, pad: float = 250.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each tile's road network in pixels: filter, node, cut, build."""
    pieces = stored(ways.sparkSession, tile_pieces(ways, tiles, name, extent, pad).select("graph_id", "line", "pts"), "pieces")
    return graph.build(pieces, 1e-3)


def to_utm(ways: DataFrame, epsg: int) -> DataFrame:
    """Longitude, latitude polylines to metres of a UTM zone (Arrow batches)."""
    schema = ways.schema

    def run(batches):
        for rows in batches:
            rows["pts"] = [[{"x": float(x), "y": float(y)} for x, y in kernels.utm(np.array([q["x"] for q in p]), np.array([q["y"] for q in p]), epsg)] for p in rows.pts]
            yield rows

    return ways.mapInPandas(run, schema)


@register(WAYS, "table")
def way_table(spark: SparkSession, path: str, box: tuple | None = None) -> DataFrame:
    """A Parquet way table, only the columns that are needed."""
    w = spark.read.parquet(path).select(*COLUMNS)
    return in_box(w, box) if box else w


@register(WAYS, "xml")
def way_xml(spark: SparkSession, path: str) -> DataFrame:
    """Ways of OSM XML files: node places are looked up within each file (Arrow map over whole files)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "osm_id string, highway string, other_tags string, pts array<struct<x:double,y:double>>"

    def run(batches):
        import xml.etree.ElementTree as ET

        for rows in batches:
            out = []
            for raw in rows.content:
                root = ET.fromstring(raw)
                at = {n.get("id"): {"x": float(n.get("lon")), "y": float(n.get("lat"))} for n in root.iter("node")}
                for w in root.iter("way"):
                    tags = {t.get("k"): t.get("v") for t in w.iter("tag")}
                    pts = [at[r.get("ref")] for r in w.iter("nd") if r.get("ref") in at]
                    if "highway" in tags and len(pts) >= 2:
                        rest = ",".join(f'"{k}"=>"{v}"' for k, v in tags.items() if k != "highway")
                        out.append((w.get("id"), tags["highway"], rest, pts))
            yield pd.DataFrame(out, columns=["osm_id", "highway", "other_tags", "pts"])

    return with_boxes(files.mapInPandas(run, schema))
