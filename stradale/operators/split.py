"""Spatial train/validation splits: random, blocked, buffered; leakage; frozen records.

A placement is (sample_id, pos, x, y); `pos` is the input order, which is part of an assignment's
identity. Group orders come from a seeded permutation drawn on the driver (a permutation of group
numbers, bounded by the number of groups) or from a given `ord` column.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..store import stored
from . import spatial

SIDES = ("train", "val", "dropped")


def block_index(placement: DataFrame, block_m: float) -> DataFrame:
    """placement with `block`: dense numbers of grid blocks, by x then y, unplaced samples last. The grid starts at the smallest x, y."""
    if block_m <= 0:
        raise ValueError("a block has a positive size")
    lo = placement.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))  # one row
    p = placement.join(F.broadcast(lo)).withColumn("bx", F.floor((F.col("x") - F.col("_x0")) / block_m)).withColumn("by", F.floor((F.col("y") - F.col("_y0")) / block_m))
    by_place = Window.orderBy(F.asc_nulls_last("_bx"), F.asc_nulls_last("_by"))
    blocks = p.select(F.col("bx").alias("_bx"), F.col("by").alias("_by")).distinct().withColumn("block", (F.dense_rank().over(by_place) - 1).cast("long"))
    same = F.col("bx").eqNullSafe(F.col("_bx")) & F.col("by").eqNullSafe(F.col("_by"))
    return p.join(blocks, same).drop("_x0", "_y0", "bx", "by", "_bx", "_by")


def target_size(n: Column, fraction: float) -> Column:
    return F.greatest(F.bround(n * F.lit(float(fraction))).cast("long"), F.lit(1))


def hold_out_groups(groups: DataFrame, fraction: float, order: Column) -> DataFrame:
    """Groups (group, size) taken whole, in the given order, until the share is reached; overshoot stays."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = groups.agg(F.sum("size").alias("_n"))
    before = groups.withColumn("_before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return before.join(F.broadcast(total)).withColumn("held", F.col("_before") < target_size(F.col("_n"), fraction)).select("group", "size", "held")


def shuffled_groups(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(group, ord): a seeded permutation of 0..n-1."""
    labels = np.arange(n)
    np.random.default_rng(seed).shuffle(labels)
    return spark.createDataFrame([(int(g), i) for i, g in enumerate(labels)], "group long, ord long")


def random_split(placement: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each sample for itself; both sides keep the shuffled order.

    The order is one seeded shuffle of all positions, which only one process can draw if recorded splits
    are to come out again: it takes 8 bytes a sample in a single task, and none on the driver.
    """
    spark, n = placement.sparkSession, placement.count()

    def draw(batches):
        order = np.arange(n)
        for _ in batches:
            pass
        np.random.default_rng(seed).shuffle(order)
        for lo in range(0, n, 1 << 20):
            part = order[lo : lo + (1 << 20)]
            yield pd.DataFrame({"pos": part.astype(np.int32), "ord": np.arange(lo, lo + len(part), dtype=np.int32)})

    rank = spark.range(1, numPartitions=1).mapInPandas(draw, "pos int, ord int")
    held = max(round(n * fraction), 1)
    return placement.join(rank, "pos").select("sample_id", F.when(F.col("ord") < held, "val").otherwise("train").alias("side"), F.when(F.col("ord") < held, F.col("ord")).otherwise(F.col("ord") - held).alias("ord"))


def blocked(placement: DataFrame, fraction: float, block_m: float, order: DataFrame | None = None, seed: int = 0, buffer_m: float | None = None) -> DataFrame:
    """Whole blocks held out; with a buffer, training samples nearer than it to a held-out one are dropped.

    order: (group, ord) of blocks, equal places by their numbers; by default a seeded permutation. Columns: sample_id, pos, x, y, block, side.
    """
    p = block_index(placement, block_m)
    sizes = p.groupBy(F.col("block").alias("group")).agg(F.count(F.lit(1)).alias("size"))
    if order is None:
        order = shuffled_groups(placement.sparkSession, sizes.count(), seed)
    held = hold_out_groups(sizes.join(order, "group"), fraction, F.struct("ord", "group")).where("held").select(F.col("group").alias("block"), F.lit(True).alias("_held"))
    p = p.join(held, "block", "left").withColumn("side", F.when(F.col("_held"), "val").otherwise("train")).drop("_held")
    if buffer_m:
        near = too_near(p.where("side = 'train'"), p.where("side = 'val'"), buffer_m)
        p = p.join(near.withColumn("_near", F.lit(True)), "sample_id", "left").withColumn("side", F.when(F.col("_near"), "dropped").otherwise(F.col("side"))).drop("_near")
    return p


def too_near(train: DataFrame, val: DataFrame, buffer_m: float) -> DataFrame:
    """Training samples whose nearest held-out sample is strictly nearer than the buffer (grid join)."""
    pts = lambda d: d.select("sample_id", "x", "y")
    j = spatial.radius_join(pts(train), pts(val), buffer_m)
    return j.where(F.col("distance") < buffer_m).select(F.col("l_sample_id").alias("sample_id")).distinct()


def adjacency(assigned: DataFrame, touch_m: float) -> DataFrame:
    """How near held-out samples lie to training samples: min, median, p10, share touching.

    The exact nearest distance needs no radius: cells double in size until every held-out sample has
    met a training sample. Each pass is a grid join of the samples that are left, stored as it is made.
    Samples without a place have no distance.
    """
    spark = assigned.sparkSession
    sides = stored(spark, assigned.select("sample_id", "x", "y", "side").dropna(subset=["x", "y"]), "sides")
    train = sides.where("side = 'train'").drop("side")
    left = sides.where("side = 'val'").drop("side")
    reach, parts = float(touch_m), []
    # beyond the width of everything no further sample can be met
    box = sides.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    most = 2 * math.hypot(*(v or 0.0 for v in box)) + reach
    while reach <= 2 * most:
        near = stored(spark, spatial.nearest_within(left, train, reach, [], "sample_id"), "near")
        parts.append(near)
        left = stored(spark, left.join(near.select("sample_id"), "sample_id", "left_anti"), "left")
        if not left.limit(1).count():
            break
        reach *= 2
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    return d.agg(F.min("distance").alias("nearest"), F.median("distance").alias("median"), F.percentile("distance", 0.1).alias("p10"), F.avg((F.col("distance") <= touch_m).cast("double")).alias("touching"))


def leakage(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Ways that both sides see: shares by ways, length and held-out nodes.

    nodes: chip, way, node_length; assigned: chip, side.
    """
    n = nodes.join(assigned.select("chip", "side"), "chip").where(F.col("side").isin("train", "val"))
    ways = n.groupBy("way").agg(
        F.max((F.col("side") == "train").cast("int")).alias("t"), F.max((F.col("side") == "val").cast("int")).alias("v"),
        F.sum(F.when(F.col("side") == "val", F.col("node_length")).otherwise(0)).alias("len"), F.count_if(F.col("side") == "val").alias("nodes"),
    ).where("v = 1")
    shared = F.col("t") == 1
    return ways.agg(
        F.count(F.lit(1)).alias("n_ways"), F.count_if(shared).alias("n_shared"),
        scalars.ratio(F.count_if(shared), F.count(F.lit(1))).alias("way_share"),
        scalars.ratio(F.sum(F.when(shared, F.col("len")).otherwise(0)), F.sum("len")).alias("length_share"),
        scalars.ratio(F.sum(F.when(shared, F.col("nodes")).otherwise(0)), F.sum("nodes")).alias("node_share"),
    )


def composition(nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Class shares per side against all: side, klass, share, overall, deviation."""
    n = nodes.join(assigned.select("chip", "side"), "chip")
    by = n.groupBy("side", "klass").agg(F.count(F.lit(1)).alias("k"))
    total = n.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    every = nodes.groupBy("klass").agg(F.count(F.lit(1)).alias("all_k"))
    size = nodes.agg(F.count(F.lit(1)).alias("all_n"))
    grid = total.join(every).join(F.broadcast(size))  # sides x classes, a fixed few
    out = grid.join(by, ["side", "klass"], "left").withColumn("share", F.coalesce("k", F.lit(0)) / F.col("n")).withColumn("overall", F.col("all_k") / F.col("all_n"))
    return out.select("side", "klass", "share", "overall", F.abs(F.col("share") - F.col("overall")).alias("deviation"))


def worst_composition(comp: DataFrame) -> DataFrame:
    """Per side: the largest deviation and the rarest class (first by name on ties)."""
    return comp.groupBy("side").agg(F.max("deviation").alias("max_deviation"), F.min(F.struct("share", "klass"))["klass"].alias("rarest"))


def side_digest(assigned: DataFrame, order: str = "pos") -> DataFrame:
    """side, n, digest over the side's ids in order (null without ids); a side is a list whose size a split file bounds."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col("sample_id")))), lambda s: s["sample_id"])
    return assigned.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("sample_id") > 0, scalars.digest(ids)).alias("digest"))


def unknown_ids(assigned: DataFrame, source: DataFrame) -> DataFrame:
    """Assigned ids that the source does not list; a split is usable if there are none."""
    return assigned.select("sample_id").join(source.select("sample_id"), "sample_id", "left_anti")


def placement_of(tiles: DataFrame) -> DataFrame:
    """Placements from tiles (sample_id, pos, tile): centres in metres; mixed projections raise."""
    from ..functions.geom import tile_center

    if tiles.select("tile.epsg").distinct().limit(2).count() > 1:
        raise ValueError("tiles of several projections have no common placement")
    return tiles.select("sample_id", "pos", tile_center(F.col("tile")).alias("c")).select("sample_id", "pos", "c.x", "c.y")


@dataclass(frozen=True)
class Frozen:
    """A recorded split: what drew it, from what, and its ordered sides."""

    name: str
    splitter: str
    params: dict[str, float]
    source: dict
    sides: dict[str, list[str]] = field(default_factory=dict)

    @property
    def digest(self) -> str:
        s = self.sides
        ids = [*s.get("train", []), "--val--", *s.get("val", []), "--dropped--", *s.get("dropped", [])]
        return digest(ids)


def digest(ids: list[str]) -> str:
    return hashlib.sha256("\n".join(ids).encode()).hexdigest()


def freeze(assigned: DataFrame, name: str, splitter: str, params: dict, source: dict, order: str = "pos") -> Frozen:
    """Collect an assignment for its record; a split file lists every id, so it is driver-sized."""
    rows = assigned.orderBy(order).select("sample_id", "side").collect()
    return Frozen(name, splitter, params, source, {s: [r[0] for r in rows if r[1] == s] for s in SIDES})


def write_frozen(spark: SparkSession, path: str, frozen: Frozen) -> None:
    text = json.dumps({"name": frozen.name, "splitter": frozen.splitter, "params": frozen.params, "source": frozen.source, "digest": frozen.digest, **frozen.sides})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_frozen(spark: SparkSession, path: str) -> Frozen:
    """Read a record back; ids that no longer hash to its digest raise."""
    raw = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    out = Frozen(raw["name"], raw["splitter"], raw["params"], raw["source"], {s: raw.get(s, []) for s in SIDES})
    if out.digest != raw["digest"]:
        raise ValueError(f"{path}: its ids do not match its digest")
    return out


def rebuild(placement: DataFrame, frozen: Frozen) -> DataFrame:
    """Draw the split again from its recipe; a result other than the record raises."""
    p = frozen.params
    out = SPLITTERS[frozen.splitter](placement, **p)
    again = freeze(out, frozen.name, frozen.splitter, p, frozen.source, "ord" if "ord" in out.columns else "pos")
    if again.digest != frozen.digest:
        raise ValueError(f"{frozen.name}: the recipe no longer gives the recorded split")
    return out


SPLITTERS = {"random": random_split, "blocked": blocked, "buffered": blocked}
