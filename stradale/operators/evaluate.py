"""Scoring of masks and networks chip by chip: stages, thresholds, arms, damage.

A grid point (threshold, seed, arm) is made part of the graph's name, so that all points of all chips
are scored by one job of grouped kernels; names are taken apart afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.scalars import logit, ratio
from ..store import stored, unsent
from . import candidates, coverage, metrics, raster
from . import graph as G

Network = tuple[DataFrame, DataFrame]
#: Clean-up tolerances in pixels: simplify, spur, snap.
CLEANUP = (2.0, 20.0, 8.0)
MARK = "\x1f"


def with_roads(truth: Network) -> Network:
    """Graphs with at least one edge: others cannot be scored and are skipped."""
    some = truth[1].select("graph_id").distinct()
    return truth[0].join(some, "graph_id", "left_semi"), truth[1]


def point_name(*parts: Column) -> Column:
    return F.concat_ws(MARK, *[p.cast("string") for p in parts])


def fanned(df: DataFrame, points: DataFrame, key: str = "graph_id") -> DataFrame:
    """Rows repeated for each of their graph's points (graph_id, point), renamed to it."""
    p = points.select(F.col("graph_id").alias(key), "point")
    return unsent(df).join(p, key).withColumn(key, F.col("point")).drop("point")


def named(pixels: DataFrame, by: str) -> DataFrame:
    """Pixels (chip, by, row, col) with the point as their chip."""
    return pixels.select(point_name(F.col("chip"), F.col(by)).alias("chip"), "row", "col")


def ceilings(truth: Network, truth_mask: DataFrame, grids: DataFrame, cleanup: tuple = CLEANUP) -> DataFrame:
    """graph_id, ceiling: the score that a perfect mask reaches."""
    traced = G.clean(*G.trace(truth_mask, grids), *cleanup)
    return metrics.apls(truth, traced).select("graph_id", F.col("apls").alias("ceiling"))


def evaluate_tiles(truth: Network, truth_mask: DataFrame, predicted: DataFrame, grids: DataFrame, cleanup: tuple = CLEANUP) -> DataFrame:
    """One row a chip with roads: mask_iou, apls_raw, apls_cleaned, ceiling, of_ceiling (0 where the ceiling is 0)."""
    t = with_roads(truth)
    chips = t[0].select(F.col("graph_id").alias("chip")).distinct()
    use = grids.join(chips, "chip", "left_semi")
    raw = G.settled(G.trace(predicted.join(chips, "chip", "left_semi"), use))
    r = metrics.apls(t, raw).select("graph_id", F.col("apls").alias("apls_raw"))
    c = metrics.apls(t, G.clean(*raw, *cleanup)).select("graph_id", F.col("apls").alias("apls_cleaned"))
    i = metrics.iou(predicted, truth_mask, chips).select(F.col("chip").alias("graph_id"), F.col("iou").alias("mask_iou"))
    out = i.join(r, "graph_id").join(c, "graph_id").join(ceilings(t, truth_mask.join(chips, "chip", "left_semi"), use, cleanup), "graph_id")
    return out.withColumn("of_ceiling", F.coalesce(ratio(F.col("apls_cleaned"), F.col("ceiling")), F.lit(0.0)))


def aggregate(reports: DataFrame, chips: DataFrame) -> DataFrame:
    """One row over all chips: scored, skipped, means, and the median score; all 0 where none was scored."""
    n = chips.select("graph_id").distinct().agg(F.count(F.lit(1)).alias("_n"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = reports.agg(
        F.count(F.lit(1)).alias("n_scored"), mean("mask_iou").alias("mask_iou"), mean("apls_cleaned").alias("apls_cleaned"), F.coalesce(F.median("apls_cleaned"), F.lit(0.0)).alias("apls_median"),
        mean("ceiling").alias("ceiling"), mean("of_ceiling").alias("of_ceiling"),
    )
    return out.join(F.broadcast(n)).withColumn("n_skipped", F.col("_n") - F.col("n_scored")).drop("_n")


def threshold_sweep(truth: Network, truth_mask: DataFrame, logits: DataFrame, grids: DataFrame, thresholds: list[float], cleanup: tuple = CLEANUP) -> DataFrame:
    """One row a chip and threshold: mask_iou, scores, ceiling, of_ceiling. Chips without roads or with a ceiling of 0 are skipped.

    logits: chip, row, col, logit; a pixel counts where its logit is strictly above the threshold's.
    """
    t = with_roads(truth)
    ceiling = stored(grids.sparkSession, ceilings(t, truth_mask, grids, cleanup).where("ceiling > 0"), "ceilings")
    cuts = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.lit(logit(x)).alias("cut")) for x in thresholds]))
    points = ceiling.select("graph_id", cuts.alias("c")).select("graph_id", "c.threshold", "c.cut")
    points = points.withColumn("point", point_name(F.col("graph_id"), F.col("threshold")))
    on = logits.join(points.select(F.col("graph_id").alias("chip"), "threshold", "cut"), "chip").where(F.col("logit") > F.col("cut"))
    mask = stored(grids.sparkSession, named(on, "threshold"), "masks")
    net = G.clean(*G.trace(mask, fanned(grids, points, "chip")), *cleanup)
    score = metrics.apls((fanned(t[0], points), fanned(t[1], points)), net).select(F.col("graph_id").alias("point"), "apls", "forward_score", "backward_score")
    i = metrics.iou(mask, fanned(truth_mask, points, "chip"), points.select(F.col("point").alias("chip"))).select(F.col("chip").alias("point"), F.col("iou").alias("mask_iou"))
    out = points.select("graph_id", "threshold", "point").join(score, "point").join(i, "point").join(ceiling, "graph_id").drop("point")
    return out.withColumn("of_ceiling", F.col("apls") / F.col("ceiling"))


def decode(raw: Network, rows: DataFrame, reorder: bool, inject: float = 1.0, cleanup: tuple = CLEANUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of an arm: the cleaned graph, or simplify, snap, connect, prune with the arm's rows."""
    simplify, spur, snap = cleanup
    if not reorder:
        return *G.clean(*raw, *cleanup), raw[0].select("graph_id").distinct().withColumn("added", F.lit(0).cast("long"))
    return candidates.add_connectors(*raw, rows, inject, True, spur, simplify, snap)


def score_arms(truth: Network, truth_mask: DataFrame, raw: Network, rows: DataFrame, arms: DataFrame, grids: DataFrame, cleanup: tuple = CLEANUP, **kinds) -> DataFrame:
    """Long scores (graph_id, arm, metric, value) of every arm, with `n_selected` and `n_added` as metrics.

    arms: arm, radius, snap, kinds, min_purity, reorder; a few rows. rows: labelled candidates. Chips
    without roads or with a ceiling of 0 are skipped.
    """
    t = with_roads(truth)
    ok = stored(grids.sparkSession, ceilings(t, truth_mask, grids, cleanup).where("ceiling > 0").select("graph_id"), "ceilings")
    points = ok.crossJoin(F.broadcast(arms.select("arm", "reorder"))).withColumn("point", point_name(F.col("graph_id"), F.col("arm")))  # chips x a few arms
    picked = candidates.select_arm(rows, arms).withColumn("graph_id", point_name(F.col("graph_id"), F.col("arm")))
    parts, counts = [], None
    for reorder in (False, True):
        some = points.where(F.col("reorder") == reorder)
        fan = lambda net, some=some: (fanned(net[0], some), fanned(net[1], some))
        n, e, added = decode(fan(raw), picked, reorder, 1.0, cleanup)
        parts.append(metrics.metric_rows(fan(t), G.settled((n, e)), **kinds))
        counts = added if counts is None else counts.unionByName(added)
    chosen = picked.groupBy("graph_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    long = parts[0].unionByName(parts[1])
    long = long.unionByName(counts.select("graph_id", F.lit("n_added").alias("metric"), F.col("added").cast("double").alias("value")))
    long = long.unionByName(chosen.select("graph_id", F.lit("n_selected").alias("metric"), "value"))
    names = points.select("graph_id", "arm", "point")
    return long.withColumnRenamed("graph_id", "point").join(names, "point").select("graph_id", "arm", "metric", "value")


def divergence(truth: Network, truth_mask: DataFrame, grids: DataFrame, counts: list[int], seeds: list[int], radius: int = 2, cleanup: tuple = CLEANUP) -> DataFrame:
    """Means over seeds of pixel and route scores of a perfect mask with gaps punched in it: graph_id, gaps, iou, apls.

    truth_mask: pixels (chip, row, col) or masks (`raster.BITS`). The gaps are those of `coverage.draw_gaps`. All points
    of a chip are punched, traced and scored in one kernel, which takes the mask as one row: a row a pixel and point would
    be thousands of times the input on disk.
    """
    counts, seeds = list(dict.fromkeys(counts)), list(dict.fromkeys(seeds))

    def run(key: tuple, g_rows: pd.DataFrame, m_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        g = G.unpack(g_rows)
        if key[0] is not None and g.nodes and g.edges:
            box = m_rows.dropna(subset=["bits"])
            r, c = raster.unpacked(*box[["row0", "col0", "height", "width", "bits"]].iloc[0]) if len(box) else (np.zeros(0, np.int64),) * 2
            grid = m_rows.dropna(subset=["grid_h"])
            shape = (int(grid.grid_h.iloc[0]), int(grid.grid_w.iloc[0])) if len(grid) else None
            drawn = {s: coverage.first_drawn(key[0], r, c, max(counts), s) for s in seeds} if max(counts) > 0 else {}
            control, known = metrics.controls(g), {}
            for n in counts:
                iou, apls = [], []
                for s in seeds:
                    stay = np.ones(len(r), bool)
                    for k in drawn[s][:n] if n > 0 else ():
                        stay &= (abs(r - r[k]) > radius) | (abs(c - c[k]) > radius)
                    if (same := stay.tobytes()) not in known:
                        known[same] = metrics.graph_apls(g, control, traced(r[stay], c[stay], shape))
                    iou.append(stay.mean() if len(r) else 1.0)
                    apls.append(known[same])
                out.append((key[0], n, sum(iou) / len(seeds), sum(apls) / len(seeds)))
        return pd.DataFrame(out, columns=["graph_id", "gaps", "iou", "apls"])

    def traced(r: np.ndarray, c: np.ndarray, shape: tuple[int, int] | None) -> kernels.Graph:
        """As `G.trace` and `G.clean` give it; no graph without a grid."""
        if shape is None:
            return kernels.Graph()
        m = np.zeros(shape, bool)
        m[r, c] = True
        return G.by_id(G.by_id(kernels.trace(m)).cleaned(*cleanup))

    m = truth_mask if "bits" in truth_mask.columns else raster.masks(truth_mask)
    g = grids.select(F.col("chip").alias("graph_id"), F.col("height").alias("grid_h"), F.col("width").alias("grid_w"))
    sides = m.withColumnRenamed("chip", "graph_id").unionByName(g, allowMissingColumns=True)
    return G.by_graph(G.packed(*truth)).cogroup(G.by_graph(sides)).applyInPandas(run, "graph_id string, gaps int, iou double, apls double")


def tuned_gallery(sweep: DataFrame, baseline: float, tuned: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(chips, summary) of two thresholds of a sweep: k chips spread over the tuned score, and means, medians and gains of all."""
    from . import stats

    at = lambda x, name: sweep.where(F.col("threshold") == x).select("graph_id", F.col("apls").alias(name))
    both = at(baseline, "baseline").join(at(tuned, "tuned"), "graph_id").withColumn("gain", F.col("tuned") - F.col("baseline"))
    summary = both.agg(
        F.count(F.lit(1)).alias("n"), F.avg("baseline").alias("baseline"), F.avg("tuned").alias("tuned"), F.median("baseline").alias("baseline_median"), F.median("tuned").alias("tuned_median"),
        F.count_if(F.col("gain") > 0).alias("better"), F.count_if(F.col("gain") < 0).alias("worse"),
    )
    return stats.spread_picks(both.withColumn("_o", F.struct("tuned", "graph_id")), "_o", k).drop("_o"), summary


def endpoint_coverage(rows: DataFrame, interior: DataFrame, radii: DataFrame) -> DataFrame:
    """By radius and snap: interior dead ends, those with a candidate, those with a positive one, shares, and per-chip means.

    interior: graph_id, node. Every chip with an interior dead end or a candidate counts once.
    """
    per = interior.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    snaps = rows.select("snap").distinct()
    points = radii.select("radius").crossJoin(F.broadcast(snaps))  # a few radii x a few snaps
    near = rows.join(F.broadcast(radii.select("radius")), F.col("gap") <= F.col("radius"))
    node = F.col("node_a")
    reach = near.groupBy("radius", "snap", "graph_id").agg(F.countDistinct(node).alias("c"), F.countDistinct(F.when(F.col("label") == "positive", node)).alias("p"))
    chips = per.join(rows.select("graph_id").distinct(), "graph_id", "full_outer").crossJoin(F.broadcast(points))
    every = chips.join(reach, ["radius", "snap", "graph_id"], "left").fillna(0, ["n", "c", "p"])
    out = every.groupBy("radius", "snap").agg(
        F.count(F.lit(1)).alias("n_chips"), F.sum("n").alias("interior"), F.sum("c").alias("with_candidate"), F.sum("p").alias("with_positive"),
        F.avg("p").alias("positive_mean"), F.median("p").alias("positive_median"),
    )
    share = lambda c: F.coalesce(ratio(F.col(c), F.col("interior")), F.lit(0.0))
    return out.withColumn("candidate_share", share("with_candidate")).withColumn("positive_share", share("with_positive"))


def label_diagnostics(rows: DataFrame, truth: Network, chips: DataFrame, radius: float) -> DataFrame:
    """By snap: where labels are weak. Chips without roads, candidates within the radius, those with a truth distance, of 0, of at most 1."""
    bare = chips.select("graph_id").distinct().join(truth[1].select("graph_id"), "graph_id", "left_anti").agg(F.count(F.lit(1)).alias("chips_without_roads"))
    d = F.col("truth_dist")
    out = rows.where(F.col("gap") <= radius).groupBy("snap").agg(
        F.count(F.lit(1)).alias("n"), F.count(d).alias("determinable"), F.count_if(d == 0).alias("zero_distance"), F.count_if((d > 0) & (d <= 1)).alias("coincident"),
    )
    return out.join(F.broadcast(bare))
