"""Seeded draws on chips: coverage patterns, gaps. Every draw is a hash of the seed and the chip.

A configuration is a dict: mode (full, none, strips, blocks), endpoint_mass, low, high, period, side.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from .raster import KEYS

MODES = ("full", "none", "strips", "blocks")
DEFAULTS = {"mode": "full", "endpoint_mass": 0.4, "low": 0.05, "high": 0.95, "period": (16, 48), "side": (8, 32)}


def checked(config: dict) -> dict:
    """The configuration with defaults; unknown modes, a mass that is no probability and bounds out of order raise."""
    c = {**DEFAULTS, **config}
    if c["mode"] not in MODES:
        raise ValueError(f"unknown coverage mode {c['mode']!r}; known: {sorted(MODES)}")
    if not 0 <= c["endpoint_mass"] <= 1:
        raise ValueError("endpoint_mass is a probability")
    if not 0 <= c["low"] <= c["high"] <= 1:
        raise ValueError("0 <= low <= high <= 1 is needed")
    return c


def fraction(config: dict, u: Column, v: Column) -> Column:
    """The share of a chip that is covered: both ends have half of endpoint_mass each, the rest is uniform."""
    c = checked(config)
    if c["mode"] in ("full", "none"):
        return F.lit(float(c["mode"] == "full"))
    half = c["endpoint_mass"] / 2
    inner = F.lit(c["low"]) + v * (c["high"] - c["low"])
    return F.when(u < half, 0.0).when(u < 2 * half, 1.0).otherwise(inner)


def between(u: Column, bounds: tuple[int, int]) -> Column:
    """A whole number of an inclusive range."""
    return F.floor(u * (bounds[1] - bounds[0] + 1)).cast("int") + bounds[0]


def patterns(grids: DataFrame, config: dict, seed: int, share: float | None = None) -> DataFrame:
    """One pattern a chip (chip, height, width): share, angle, period, phase, n_rows, n_cols, chosen blocks.

    share: a fixed one instead of a draw.
    """
    c = checked(config)
    u = lambda name: scalars.uniform(F.lit(seed), F.lit(name), F.col("chip"))
    g = grids.select("chip", "height", "width").withColumn("share", fraction(c, u("end"), u("inner")) if share is None else F.lit(float(share)))
    g = g.withColumn("angle", u("angle") * math.pi).withColumn("period", between(u("period"), c["period"])).withColumn("phase", u("phase") * F.col("period"))
    side = between(u("side"), c["side"])
    g = g.withColumn("n_rows", F.greatest(F.rint(F.col("height") / side).cast("int"), F.lit(1))).withColumn("n_cols", F.greatest(F.rint(F.col("width") / side).cast("int"), F.lit(1)))
    n = F.col("n_rows") * F.col("n_cols")
    order = F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(scalars.uniform(F.lit(seed), F.lit("block"), F.col("chip"), b).alias("u"), b.alias("b"))))
    k = F.rint(F.col("share") * n).cast("int")
    return g.withColumn("chosen", F.filter(F.transform(order, lambda s, i: F.when(i < k, s["b"])), lambda b: b.isNotNull())).withColumn("mode", F.lit(c["mode"]))


def covered(pixels: DataFrame, pattern: DataFrame) -> DataFrame:
    """pixels (chip, row, col, ...) with `covered`: whether the chip's pattern has them."""
    names = [c for c in pattern.columns if c != "chip"]
    p = pattern.select("chip", F.struct(*names).alias("_p"))
    m, q = F.col("_p.mode"), lambda c: F.col(f"_p.{c}")
    bands = scalars.strips(F.col("row"), F.col("col"), q("angle"), q("phase"), q("period").cast("double"), q("share"))
    block = scalars.block_of(F.col("row"), F.col("col"), q("height"), q("width"), q("n_rows"), q("n_cols"))
    ok = F.when(m == "full", True).when(m == "none", False).when(m == "strips", bands).otherwise(F.array_contains(q("chosen"), block))
    return pixels.join(p, "chip").withColumn("covered", ok).drop("_p")


def draw_gaps(mask: DataFrame, n: int, seed: int, radius: int = 2) -> DataFrame:
    """Squares (chip, row0, col0, size) around n of a chip's pixels, all of them where it has fewer; drawn without replacement."""
    u = scalars.uniform(F.lit(seed), F.lit("gap"), *[F.col(k) for k in KEYS])
    w = Window.partitionBy("chip").orderBy("_u", "row", "col")
    picked = mask.select(*KEYS).distinct().withColumn("_u", u).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return picked.select("chip", (F.col("row") - radius).alias("row0"), (F.col("col") - radius).alias("col0"), F.lit(2 * radius + 1).alias("size"))


def first_drawn(chip: str, rows: np.ndarray, cols: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places in a chip's pixels of the n that `draw_gaps` draws, in its order: for kernels that have a chip's pixels at hand."""
    head, md5 = f"{seed}|gap|{chip}|".encode(), hashlib.md5
    made = b"".join([md5(head + b"%d|%d" % p).digest() for p in zip(rows.tolist(), cols.tolist())])
    u = np.frombuffer(made, ">u8")[::2] >> np.uint64(12)  # 13 hex digits
    return np.lexsort((cols, rows, u))[:n]
