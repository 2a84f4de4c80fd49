"""Raster operators on sparse pixel relations (chip, row, col): True pixels only.

Neighbourhoods are joins with offset tables of fixed size; a pixel is a row, so work is
proportional to what is set, and partitions fall on (chip, row, col).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields, kernels
from ..store import unsent
from . import spatial
from .graph import by_graph, points

KEYS = ["chip", "row", "col"]
#: A mask as one row a chip: the box around its pixels, and a bit for each of the box.
BITS = "chip string, row0 int, col0 int, height int, width int, bits binary"


def _offsets(n: int, inside) -> Column:
    cells = [(a, b) for a in range(-n, n + 1) for b in range(-n, n + 1) if inside(a, b)]
    return F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in cells])


def moved(mask: DataFrame, n: int, inside) -> DataFrame:
    """Every pixel moved by every offset."""
    x = mask.select("chip", "row", "col", F.explode(_offsets(n, inside)).alias("o"))
    return x.select("chip", (F.col("row") + F.col("o.dr")).alias("row"), (F.col("col") + F.col("o.dc")).alias("col"))


def held(mask: DataFrame, grids: DataFrame | None) -> DataFrame:
    """Pixels on their grid (chip, height, width)."""
    if grids is None:
        return mask
    g = grids.select("chip", "height", "width")
    return mask.join(g, "chip").where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") < F.col("width"))).select(*KEYS)


def dilate(mask: DataFrame, n: int = 1, grids: DataFrame | None = None) -> DataFrame:
    """n dilations with a 3 x 3 square."""
    return held(moved(mask, n, lambda a, b: True).distinct(), grids)


def dilate_disk(mask: DataFrame, radius: int = 2, grids: DataFrame | None = None) -> DataFrame:
    return held(moved(mask, radius, lambda a, b: a * a + b * b <= radius * radius).distinct(), grids)


def erode(mask: DataFrame, n: int = 1) -> DataFrame:
    """n erosions with a 3 x 3 square; pixels at the border of what is set go."""
    full = (2 * n + 1) ** 2
    return moved(mask.distinct(), n, lambda a, b: True).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == full).select(*KEYS)


def neighbour_counts(mask: DataFrame) -> DataFrame:
    """Eight-neighbour counts of set pixels."""
    near = moved(mask, 1, lambda a, b: (a, b) != (0, 0)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    return mask.select(*KEYS).join(near, KEYS, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def draw_edges(edges: DataFrame, grids: DataFrame, half_width: int = 2) -> DataFrame:
    """Edges (graph_id, pts) drawn on grids (chip, height, width): chip, row, col."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = kernels.draw([points(p) for p in rows.pts if p is not None], int(rows.height.iloc[0]), int(rows.width.iloc[0]), half_width)
        r, c = np.nonzero(m)
        return pd.DataFrame({"chip": key[0], "row": r.astype(np.int32), "col": c.astype(np.int32)})

    both = grids.join(edges.select(F.col("graph_id").alias("chip"), "pts"), "chip", "left")
    return by_graph(both, "chip").applyInPandas(run, "chip string, row int, col int")


def packed(chip: str, r: np.ndarray, c: np.ndarray) -> pd.DataFrame:
    """Pixels of a chip as a row of BITS; no row without pixels."""
    if not len(r):
        return pd.DataFrame(columns=["chip", "row0", "col0", "height", "width", "bits"])
    r0, c0 = int(r.min()), int(c.min())
    box = np.zeros((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), bool)
    box[r - r0, c - c0] = True
    return pd.DataFrame([(chip, r0, c0, *box.shape, np.packbits(box).tobytes())], columns=["chip", "row0", "col0", "height", "width", "bits"])


def unpacked(row0: int, col0: int, height: int, width: int, bits: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of a mask's pixels, in order."""
    shape = int(height), int(width)
    r, c = np.nonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=math.prod(shape)).reshape(shape))
    return r + int(row0), c + int(col0)


def masks(pixels: DataFrame) -> DataFrame:
    """Pixels (chip, row, col) as one row a chip (BITS)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return packed(key[0], rows.row.to_numpy(np.int64), rows.col.to_numpy(np.int64))

    use = pixels.select(F.col("chip").cast("string").alias("chip"), "row", "col").dropna()
    return by_graph(use, "chip").applyInPandas(run, BITS)


def draw_masks(edges: DataFrame, grids: DataFrame, half_width: int = 2) -> DataFrame:
    """`masks` of `draw_edges`, without a row a pixel between the two."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = kernels.draw([points(p) for p in rows.pts if p is not None], int(rows.height.iloc[0]), int(rows.width.iloc[0]), half_width)
        return packed(key[0], *np.nonzero(m))

    both = grids.join(edges.select(F.col("graph_id").alias("chip"), "pts"), "chip", "left")
    return by_graph(both, "chip").applyInPandas(run, BITS)


def overpass_lift(edges: DataFrame, grids: DataFrame, height: float = 6.0, radius: float = 14.0, half_width: int = 2) -> DataFrame:
    """chip, row, col, lift: the deck of the first of two edges that cross without a shared node rises round the crossing.

    Chips without such a crossing have no rows.
    """
    pairs = spatial.crossing_pairs(edges).select(F.col("graph_id").alias("chip"), F.col("a").alias("edge"), F.col("at.x").alias("x"), F.col("at.y").alias("y"))
    decks = pairs.join(edges.select(F.col("graph_id").alias("chip"), "edge", "pts"), ["chip", "edge"]).join(grids.select("chip", "height", "width"), "chip")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shape = int(rows.height.iloc[0]), int(rows.width.iloc[0])
        z = fields.deck_lift(shape, [(kernels.draw([points(p)], *shape, half_width), (x, y)) for p, x, y in zip(rows.pts, rows.x, rows.y)], height, radius)
        r, c = np.nonzero(z)
        return pd.DataFrame({"chip": key[0], "row": r.astype(np.int32), "col": c.astype(np.int32), "lift": z[r, c]})

    return by_graph(decks, "chip").applyInPandas(run, "chip string, row int, col int, lift double")


def dihedral_pixels(mask: DataFrame, n: int, index: int) -> DataFrame:
    from ..functions.geom import dihedral

    return mask.select("chip", dihedral(F.col("row"), F.col("col"), n, index).alias("p")).select("chip", "p.row", "p.col")


def crop(mask: DataFrame, windows: DataFrame) -> DataFrame:
    """Pixels inside windows (chip, crop, row0, col0, size), in window coordinates."""
    j = mask.join(windows, "chip").where(
        (F.col("row") >= F.col("row0")) & (F.col("row") < F.col("row0") + F.col("size")) & (F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col0") + F.col("size"))
    )
    return j.select("chip", "crop", (F.col("row") - F.col("row0")).alias("row"), (F.col("col") - F.col("col0")).alias("col"))


def punch_gaps(mask: DataFrame, gaps: DataFrame) -> DataFrame:
    """Pixels outside all gap squares (chip, row0, col0, size); a chip's squares meet its pixels as one list."""
    inside = lambda v, a, g: (v >= a) & (v < a + g["size"])
    hit = F.exists("_gaps", lambda g: inside(F.col("row"), g["row0"], g) & inside(F.col("col"), g["col0"], g))
    lists = gaps.groupBy("chip").agg(F.collect_list(F.struct("row0", "col0", "size")).alias("_gaps"))
    return mask.join(unsent(lists), "chip", "left").where(~F.coalesce(hit, F.lit(False))).select(*mask.columns)


def purity(samples: DataFrame, mask: DataFrame, by: list[str]) -> DataFrame:
    """Share of sample points (chip, x, y, by...) that fall on the mask, after rounding half to even."""
    s = samples.withColumn("row", F.rint("y").cast("int")).withColumn("col", F.rint("x").cast("int"))
    j = s.join(mask.select(*KEYS).distinct().withColumn("_on", F.lit(1.0)), KEYS, "left")
    return j.groupBy(*by).agg(F.avg(F.coalesce("_on", F.lit(0.0))).alias("purity"), F.count(F.lit(1)).alias("n"))


def clipped(samples: DataFrame, grids: DataFrame) -> DataFrame:
    """Sample points held to their grid."""
    g = grids.select("chip", "height", "width")
    j = samples.join(g, "chip")
    return j.withColumn("x", F.greatest(F.lit(0.0), F.least(F.col("x"), F.col("width") - 1.0))).withColumn("y", F.greatest(F.lit(0.0), F.least(F.col("y"), F.col("height") - 1.0))).drop("height", "width")


def distance_within(samples: DataFrame, mask: DataFrame, reach: int, by: list[str]) -> DataFrame:
    """Distance of each rounded sample to the nearest mask pixel up to `reach` (null beyond)."""
    s = samples.withColumn("row", F.rint("y").cast("int")).withColumn("col", F.rint("x").cast("int"))
    cells = _offsets(reach, lambda a, b: a * a + b * b <= reach * reach)
    near = s.withColumn("o", F.explode(cells)).withColumn("row", F.col("row") + F.col("o.dr")).withColumn("col", F.col("col") + F.col("o.dc"))
    near = near.withColumn("_d", F.sqrt((F.col("o.dr") * F.col("o.dr") + F.col("o.dc") * F.col("o.dc")).cast("double")))
    hit = near.join(mask.select(*KEYS).distinct(), KEYS, "left_semi").groupBy(*by).agg(F.min("_d").alias("distance"))
    return samples.select(*by).distinct().join(hit, by, "left")


def soft_losses(pairs: DataFrame, rounds: int = 10, dice: float = 0.5, cldice: float = 0.0) -> DataFrame:
    """Dice, skeleton Dice and the combined loss of dense maps (chip, row, col, p, y), one chip a group."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows.row.max()) + 1, int(rows.col.max()) + 1
        p, y = np.zeros((h, w)), np.zeros((h, w))
        p[rows.row, rows.col], y[rows.row, rows.col] = rows.p, rows.y
        q = np.clip(p, 1e-12, 1 - 1e-12)
        total = kernels.segmentation_loss(np.log(q / (1 - q)), y, dice, cldice, rounds)
        return pd.DataFrame([(key[0], kernels.soft_dice_loss(p, y), kernels.soft_cldice_loss(p, y, rounds), total)], columns=["chip", "dice", "cldice", "loss"])

    return by_graph(pairs, "chip").applyInPandas(run, "chip string, dice double, cldice double, loss double")
