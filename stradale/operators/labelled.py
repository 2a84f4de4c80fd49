"""Labelled nodes along ways, and what a classifier of them could resolve.

Nodes are rows: chip, line, way, klass, component, k, x, y, node_length. Draws are hashes of their
parameters and keys, so that results depend on neither partitions nor order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom, scalars
from ..store import stored
from . import stats
from .graph import class_components
from .ranks import ranked


def span_count(length: Column, spacing: float) -> Column:
    """Nodes of a piece: its length over the spacing, half to even, one at least, so that no short piece goes without."""
    return F.greatest(F.lit(1), F.rint(length / F.lit(float(spacing)))).cast("long")


def with_classes(pieces: DataFrame, spacing: float) -> DataFrame:
    """pieces (graph_id, line, highway, pts, and osm_id if known) with klass, length, n nodes and way.

    A piece without an osm_id is a way of its own.
    """
    own = F.concat_ws(":", "graph_id", F.col("line").cast("string"))
    p = pieces.withColumn("klass", scalars.road_class(F.col("highway"))).withColumn("length", geom.polyline_length(F.col("pts")))
    way = F.coalesce(F.when(F.col("osm_id") != "", F.col("osm_id")), own) if "osm_id" in pieces.columns else own
    return p.withColumn("n", span_count(F.col("length"), spacing)).withColumn("way", way)


def chip_nodes(pieces: DataFrame, spacing: float, tolerance: float = 1e-3) -> DataFrame:
    """Nodes at the middles of equal spans of every piece of a listed class; `component` is unique with chip and klass.

    Pieces of other classes get no nodes; `other_counts` counts those that they would have had.
    """
    p = with_classes(pieces, spacing).where(F.col("klass") != scalars.OTHER)
    comp = class_components(p.select("graph_id", "line", "klass", "pts"), tolerance).select("graph_id", "line", "component")
    spots = p.join(comp, ["graph_id", "line"]).withColumn("p", geom.midpoints(F.col("pts"), F.col("n").cast("int")))
    rows = spots.select(F.col("graph_id").alias("chip"), "line", "way", "klass", "component", (F.col("length") / F.col("n")).alias("node_length"), F.posexplode("p").alias("k", "p"))
    return rows.select("chip", "line", "way", "klass", "component", "k", "p.x", "p.y", "node_length")


def other_counts(pieces: DataFrame, spacing: float) -> DataFrame:
    """(chip, n_other): nodes that pieces of classes outside the list would have had."""
    p = with_classes(pieces, spacing)
    return p.groupBy(F.col("graph_id").alias("chip")).agg(F.coalesce(F.sum(F.when(F.col("klass") == scalars.OTHER, F.col("n"))), F.lit(0)).alias("n_other"))


def class_table(nodes: DataFrame, others: DataFrame, classes: tuple[str, ...] = scalars.CLASSES) -> DataFrame:
    """Per class, and for the rest: nodes, distinct ways and components, length, and nodes over all labelled nodes."""
    spark = nodes.sparkSession
    by = nodes.groupBy("klass").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("way").alias("n_ways"), F.countDistinct("chip", "component").alias("n_components"), F.sum("node_length").alias("length"),
    )
    every = spark.createDataFrame([(c,) for c in classes], "klass string").join(by, "klass", "left").fillna(0)
    rest = others.agg(F.coalesce(F.sum("n_other"), F.lit(0)).alias("n_nodes"))
    rest = rest.select(F.lit(scalars.OTHER).alias("klass"), "n_nodes", F.lit(0).cast("long").alias("n_ways"), F.lit(0).cast("long").alias("n_components"), F.lit(0.0).alias("length"))
    total = nodes.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("_n"))
    return every.unionByName(rest).join(F.broadcast(total)).withColumn("share", F.col("n_nodes") / F.col("_n")).drop("_n")


def resample_weights(chips: DataFrame, draws: int, seed: int) -> DataFrame:
    """(boot, chip, w): how often each chip is drawn in resamples with replacement, as many draws as chips.

    One row a draw is made and counted, so the table grows with chips times resamples and is never on the driver.
    """
    spark = chips.sparkSession
    numbered = ranked(chips.select("chip").distinct(), "chip", name="i")
    n = numbered.count()
    slots = spark.range(draws * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("boot"), (F.col("id") % F.lit(max(n, 1))).alias("slot"))
    picked = slots.select("boot", F.floor(scalars.uniform(F.lit(seed), F.lit("boot"), F.col("boot"), F.col("slot")) * n).cast("long").alias("i"))
    return picked.groupBy("boot", "i").agg(F.count(F.lit(1)).alias("w")).join(numbered, "i").select("boot", "chip", "w")


def resolvability(nodes: DataFrame, unit: str, classes: list[str], accuracy: float, seed: int, draws: int, boots: int, rhos: tuple[float, ...] = (0.0, 0.5, 0.9), alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """What a split could tell of models that are right for whole units with the given accuracy: one row.

    The mean and spread, over simulated models, of macro-F1 and of its bootstrap error over chips (the
    same resamples for all), the smallest difference that a paired comparison finds at each
    correlation, and how many nodes and units the rarest class has.
    """
    said = stats.simulate(nodes, unit, classes, accuracy, seed, draws)
    conf = stored(nodes.sparkSession, stats.confusion(said, ["draw", "chip"]), "confusions")  # chips x draws x class pairs
    point = stats.macro_f1(conf.groupBy("draw", "truth", "pred").agg(F.sum("n").alias("n")), ["draw"])
    weights = resample_weights(nodes, boots, seed)
    again = conf.join(weights, "chip").groupBy("draw", "boot", "truth", "pred").agg(F.sum(F.col("n") * F.col("w")).alias("n"))
    sems = stats.macro_f1(again, ["draw", "boot"]).groupBy("draw").agg(F.stddev_samp("macro_f1").alias("sem"))
    spread = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    out = point.join(sems, "draw").agg(
        F.avg("macro_f1").alias("macro_f1"), spread("macro_f1").alias("macro_f1_spread"), F.avg("sem").alias("macro_f1_sem"), spread("sem").alias("sem_spread"),
    )
    units = nodes.groupBy("klass").agg(F.count(F.lit(1)).alias("k"), F.countDistinct(unit).alias("u"))
    none = F.count(F.lit(1)) < len(classes)  # a class without nodes
    low = units.agg(F.when(none, F.lit(0)).otherwise(F.min("k")).alias("min_class_nodes"), F.when(none, F.lit(0)).otherwise(F.min("u")).alias("min_class_units"))
    size = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.countDistinct(unit).alias("n_units"))
    one = size.join(F.broadcast(low)).join(F.broadcast(out))  # one row each
    for rho in rhos:
        one = one.withColumn(f"detectable_{rho:g}".replace(".", "_"), F.col("macro_f1_sem") * F.lit(scalars.detectable_difference(1.0, rho, alpha, power)))
    return one


def cluster_table(nodes: DataFrame, units: dict[str, list[str]]) -> DataFrame:
    """Size of the clusters under several definitions of a unit (name -> its columns)."""
    out = None
    for name, cols in units.items():
        row = stats.cluster_sizes(nodes.withColumn("_unit", F.struct(*cols)), "_unit").withColumn("unit", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with dense numbers 0..n-1 of a column's distinct values, in their order."""
    return df.join(ranked(df.select(column).distinct(), column, name=name), column)


