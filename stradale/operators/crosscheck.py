"""Comparison of two label sources: registration shares, conversions, gates, lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.scalars import ratio
from . import raster
from .graph import by_graph


def agreement(distances: DataFrame, by: list[str], tolerances: list[float]) -> DataFrame:
    """Share of distances within each tolerance per group; a null distance (none found) is beyond all."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in tolerances])).alias("tolerance")
    d = distances.select(*by, "distance", t)
    return d.groupBy(*by, "tolerance").agg(F.avg(F.coalesce(F.col("distance") <= F.col("tolerance"), F.lit(False)).cast("double")).alias("share"))


def samples(edges: DataFrame, spacing: float) -> DataFrame:
    """Evenly spaced points of edges: chip, edge, k, x, y."""
    s = edges.select(F.col("graph_id").alias("chip"), "edge", F.posexplode(geom.resample(F.col("pts"), spacing)).alias("k", "p"))
    return s.select("chip", "edge", "k", "p.x", "p.y")


def registration(edges: DataFrame, mask: DataFrame, grids: DataFrame, spacing: float, tolerances: list[float], shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Share of an edge set's samples near a mask, per chip and tolerance; a shift gives the null control.

    Samples that a shift moves off their grid are left out.
    """
    s = samples(edges, spacing).withColumn("x", F.col("x") + shift[0]).withColumn("y", F.col("y") + shift[1])
    g = grids.select("chip", "height", "width")
    s = s.join(g, "chip").where((F.rint("x") >= 0) & (F.rint("y") >= 0) & (F.rint("x") < F.col("width")) & (F.rint("y") < F.col("height"))).drop("height", "width")
    d = raster.distance_within(s, mask, int(max(tolerances)), ["chip", "edge", "k"])
    return agreement(d, ["chip"], tolerances)


def conversion(df: DataFrame, by: list[str], given: Column, then: Column) -> DataFrame:
    """Of the rows where `given` holds, how many have `then`."""
    return df.groupBy(*by).agg(F.count_if(given).alias("n_base"), F.count_if(given & then).alias("n_converted")).withColumn("rate", ratio(F.col("n_converted"), F.col("n_base")))


def endpoint_summary(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts (chip, before, after): mean, median and pooled share of dead ends that clean-up destroys."""
    gone = F.col("before") - F.col("after")
    return counts.groupBy(*by).agg(
        F.avg("before").alias("mean_before"), F.median("before").alias("median_before"), F.avg("after").alias("mean_after"), F.median("after").alias("median_after"),
        ratio(F.sum(gone), F.sum("before")).alias("destroyed"),
    )


def infer(tiles: DataFrame, predict, bands: list[str], factor: int = 1, schema: str = "chip string, row int, col int, logit double") -> DataFrame:
    """The model seam: a whole tile at a time, mirrored up to multiples of `factor`, and the result cropped back.

    tiles: chip, row, col and the bands, a row for every pixel of a tile. predict((height, width, bands) array)
    gives (height, width) logits. Models come from outside: a checkpoint is whatever `predict` closes over.
    """
    from ..functions.fields import reflect_padded

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows.row.max()) + 1, int(rows.col.max()) + 1
        x = np.zeros((h, w, len(bands)))
        x[rows.row, rows.col] = rows[bands].to_numpy(float)
        padded, _ = reflect_padded(x, factor)
        z = np.asarray(predict(padded), float)[:h, :w]
        i, j = np.indices((h, w))
        return pd.DataFrame({"chip": key[0], "row": i.ravel(), "col": j.ravel(), "logit": z.ravel()})

    return by_graph(tiles.select("chip", "row", "col", *bands), "chip").applyInPandas(run, schema)
