"""Reconnection candidates: dead ends that may join another dead end or an edge, their labels, and arms.

Candidates are made once at the largest radius; radii, snaps and arms are filters on the stored
table. Route lengths come from one Dijkstra per source in a kernel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import ratio
from . import spatial
from .graph import by_graph, endpoint_pairs, endpoints, packed, unpack


def endpoint_candidates(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Candidates of both kinds with running numbers per graph.

    endpoint: pairs of dead ends without an edge between them. edge: a dead end and the foot point on
    its nearest edge that does not end in it.
    """
    pos = nodes.select("graph_id", "node", "x", "y")
    p = endpoint_pairs(nodes, edges, radius)
    a = pos.select("graph_id", F.col("node").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = pos.select("graph_id", F.col("node").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    null = F.lit(None).cast("long")
    both = p.join(a, ["graph_id", "a"]).join(b, ["graph_id", "b"]).select(
        "graph_id", F.lit("endpoint").alias("kind"), F.col("a").alias("node_a"), "ax", "ay", "bx", "by", F.col("distance").alias("gap"),
        F.col("b").alias("node_b"), null.alias("edge"), F.lit(None).cast("double").alias("arc"),
    )
    near = spatial.nearest_edge(endpoints(nodes, edges), edges, radius, incident=False)
    side = near.join(pos, ["graph_id", "node"]).select(
        "graph_id", F.lit("edge").alias("kind"), F.col("node").alias("node_a"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.col("fx").alias("bx"), F.col("fy").alias("by"), F.col("distance").alias("gap"), null.alias("node_b"), "edge", "arc",
    )
    w = Window.partitionBy("graph_id").orderBy("kind", "node_a", F.coalesce("node_b", "edge"))
    return both.unionByName(side).withColumn("cand", (F.row_number().over(w) - 1).cast("long"))


def proposal_distance(cands: DataFrame, edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Route length that the proposal already offers between a candidate's ends; infinite without one.

    lengths: (graph_id, a, b, length) from every candidate's node_a (`graph.lengths_from`). For a point
    on an edge, the shorter way round by its ends.
    """
    e = edges.select("graph_id", "edge", "u", "v", F.col("length").alias("_total"))
    c = cands.join(e, ["graph_id", "edge"], "left")

    def to(df: DataFrame, target: str, name: str) -> DataFrame:
        d = lengths.select("graph_id", F.col("a").alias("node_a"), F.col("b").alias(target), F.col("length").alias(name))
        got = df.join(d, ["graph_id", "node_a", target], "left")
        return got.withColumn(name, F.when(F.col(target) == F.col("node_a"), 0.0).otherwise(F.coalesce(name, F.lit(math.inf))))

    c = to(to(to(c, "node_b", "_db"), "u", "_du"), "v", "_dv")
    round_ = F.least(F.col("_du") + F.col("arc"), F.col("_dv") + F.greatest(F.col("_total") - F.col("arc"), F.lit(0.0)))
    return c.withColumn("proposal_dist", F.when(F.col("node_b").isNotNull(), F.col("_db")).otherwise(round_)).drop("u", "v", "_total", "_db", "_du", "_dv")


def truth_distances(truth: tuple[DataFrame, DataFrame], cands: DataFrame, snaps: list[float]) -> DataFrame:
    """Per candidate and snap: the truth's route length between both ends, injected together.

    Null where an end does not land (undeterminable), infinite where no route joins the ends.
    """

    def run(key: tuple, g_rows: pd.DataFrame, c_rows: pd.DataFrame) -> pd.DataFrame:
        g, out = unpack(g_rows), []
        ends = c_rows[["ax", "ay", "bx", "by"]].to_numpy(float).reshape(-1, 2)  # a and b of each candidate
        for snap in snaps:
            # all points at once: where a point lands does not depend on the others, nor does a route's length
            both, landed = g.inject(ends, snap)
            near = both.adjacency()
            from_a: dict[int, dict[int, float]] = {}
            for k, cand in enumerate(c_rows.cand):
                a, b = landed[2 * k], landed[2 * k + 1]
                d = None
                if a is not None and b is not None:
                    if a not in from_a:
                        from_a[a] = both.distances(a, near)[0]
                    d = from_a[a].get(b, math.inf)
                out.append((key[0], cand, snap, d))
        return pd.DataFrame(out, columns=["graph_id", "cand", "snap", "truth_dist"])

    c = cands.select("graph_id", "cand", "ax", "ay", "bx", "by")
    return by_graph(packed(*truth)).cogroup(by_graph(c)).applyInPandas(run, "graph_id string, cand long, snap double, truth_dist double")


def label(rows: DataFrame, tau: float = 1.5, eps: float = 0.2) -> DataFrame:
    """Label of (gap, proposal_dist, truth_dist): a severed road is short in truth and not closed by the proposal."""
    d = F.col("truth_dist")
    direct = d <= tau * F.col("gap")
    open_ = F.col("proposal_dist") > (1 + eps) * d
    return rows.withColumn("label", F.when(d.isNull(), "undeterminable").when(d == F.lit(math.inf), "negative").when(direct & open_, "positive").otherwise("negative"))


def select_arm(rows: DataFrame, arms: DataFrame) -> DataFrame:
    """Rows of each arm (arm, radius, snap, kinds, min_purity): near enough, positive, of its kinds, pure enough."""
    a = arms.select(F.col("arm"), F.col("radius"), F.col("snap").alias("_snap"), "kinds", "min_purity")
    j = rows.join(F.broadcast(a), (F.col("gap") <= F.col("radius")) & (F.col("snap") == F.col("_snap")))  # a few arms
    ok = (F.col("label") == "positive") & F.array_contains("kinds", scalars.positive_kind(F.col("proposal_dist")))
    return j.where(ok & (F.col("min_purity").isNull() | (F.col("purity") >= F.col("min_purity")))).drop("_snap", "kinds", "min_purity", "radius")


def add_connectors(nodes: DataFrame, edges: DataFrame, rows: DataFrame, tolerance: float = 1.0, reorder: bool = True, spur: float = 20.0, simplify_tol: float = 2.0, snap_tol: float = 8.0):
    """(nodes, edges, counts) of graphs with the rows' straight connectors.

    reorder: simplify, snap, connect, prune (so that connected stubs survive); otherwise the graphs
    are cleaned first and connectors come last.
    """
    from . import graph as G

    def run(key: tuple, g_rows: pd.DataFrame, c_rows: pd.DataFrame) -> pd.DataFrame:
        g = unpack(g_rows)
        g = g.simplified(simplify_tol).snapped(snap_tol) if reorder else g.cleaned(simplify_tol, spur, snap_tol)
        old = unpack(g_rows)
        # snapping renumbers nodes: a candidate's ends are looked up by place
        ids = list(g.nodes)
        pos = np.array([g.nodes[n] for n in ids], float).reshape(-1, 2)

        def at(n):
            if n is None or pd.isna(n) or int(n) not in old.nodes or not len(ids):
                return None
            d = np.hypot(*(pos - np.array(old.nodes[int(n)])).T)
            return ids[int(d.argmin())] if d.min() <= snap_tol else None

        recs = [{"node_a": at(r.node_a), "node_b": at(r.node_b), "bx": r.bx, "by": r.by} for r in c_rows.sort_values("cand").itertuples()]
        g, added = g.connected(recs, tolerance)
        if reorder:
            g = g.pruned(spur)
        return G.repack(key[0], g, [(key[0], "c", added, None, None, [], [])])

    c = rows.select("graph_id", "cand", "node_a", "node_b", "bx", "by")
    made = by_graph(packed(nodes, edges)).cogroup(by_graph(c)).applyInPandas(run, G.PACKED)
    n, e = G.split_packed(made)
    return n, e, made.where("part = 'c'").select("graph_id", F.col("id").alias("added"))


def marginal_edges(truth, proposal, rows: DataFrame, **apls) -> DataFrame:
    """Each candidate alone: the score with its connector minus the score without, per candidate."""
    from . import metrics

    base = metrics.apls(truth, proposal, **apls).select("graph_id", F.col("apls").alias("base"))
    # every candidate becomes a graph of its own, so that all are scored in one job
    one = F.concat_ws("#", "graph_id", F.col("cand").cast("string"))
    keys = rows.select("graph_id", "cand", one.alias("_id"))
    fan = lambda df: df.join(keys, "graph_id").drop("graph_id", "cand").withColumnRenamed("_id", "graph_id")
    n, e, _ = add_connectors(fan(proposal[0]), fan(proposal[1]), rows.withColumn("graph_id", one))
    got = metrics.apls((fan(truth[0]), fan(truth[1])), (n, e), **apls).select(F.col("graph_id").alias("_id"), "apls")
    return keys.join(got, "_id", "left").join(base, "graph_id", "left").select("graph_id", "cand", (F.col("apls") - F.col("base")).alias("delta"))


# --- censuses -------------------------------------------------------------------------------------------


def radius_census(rows: DataFrame, radii: DataFrame) -> DataFrame:
    """Counts by radius and snap: candidates by kind, labels, distinct sources with a candidate or a positive."""
    j = rows.join(F.broadcast(radii.select("radius")), F.col("gap") <= F.col("radius"))  # a few radii
    source = F.struct("graph_id", "node_a")
    return j.groupBy("radius", "snap").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "endpoint").alias("n_endpoint"), F.count_if(F.col("kind") == "edge").alias("n_edge"),
        F.count_if(F.col("label") == "positive").alias("n_positive"), F.count_if(F.col("label") == "undeterminable").alias("n_undeterminable"),
        F.countDistinct(source).alias("n_sources"), F.countDistinct(F.when(F.col("label") == "positive", source)).alias("n_positive_sources"),
    )


def candidate_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Positive rate pooled (undeterminable left out) and as the mean over graphs with a rate."""
    rated = F.col("label") != "undeterminable"
    g = rows.groupBy(*by, "graph_id").agg(F.count_if(F.col("label") == "positive").alias("p"), F.count_if(rated).alias("n"))
    return g.groupBy(*by).agg(F.sum("p").alias("n_positive"), F.sum("n").alias("n_rated"), ratio(F.sum("p"), F.sum("n")).alias("pooled"), F.avg(ratio(F.col("p"), F.col("n"))).alias("graph_mean"))


def transitions(rows: DataFrame, a: float, b: float) -> DataFrame:
    """Label at snap a against label at snap b."""
    at = lambda s, n: rows.where(F.col("snap") == s).select("graph_id", "cand", F.col("label").alias(n))
    return at(a, "from").join(at(b, "to"), ["graph_id", "cand"]).groupBy("from", "to").agg(F.count(F.lit(1)).alias("n"))


def shortcut_ratios(rows: DataFrame, by: list[str]) -> DataFrame:
    """Quantiles of proposal over truth distance where both are finite; the rest counted apart."""
    ok = F.col("truth_dist").isNotNull() & (F.col("truth_dist") < F.lit(math.inf)) & (F.col("proposal_dist") < F.lit(math.inf)) & (F.col("truth_dist") > 0)
    r = F.when(ok, F.col("proposal_dist") / F.when(ok, F.col("truth_dist")))
    return rows.groupBy(*by).agg(F.percentile(r, 0.5).alias("p50"), F.percentile(r, 0.9).alias("p90"), F.avg((r < 1.5).cast("double")).alias("under_1_5"), F.count_if(r.isNull()).alias("undefined"))


def buckets(rows: DataFrame) -> DataFrame:
    """Rows repeated for the buckets they fall in: all, positive, coincident (0 < d <= 1), both."""
    pos = F.col("label") == "positive"
    near = (F.col("truth_dist") > 0) & (F.col("truth_dist") <= 1)
    tags = F.array(F.lit("all"), F.when(pos, F.lit("positive")), F.when(near, F.lit("coincident")), F.when(pos & near, F.lit("both")))
    return rows.withColumn("bucket", F.explode(F.filter(tags, lambda t: t.isNotNull())))


def purity_summary(rows: DataFrame, by: list[str], high: float = 0.5) -> DataFrame:
    """Five-number summary of purities, shares at 0 and 1, and counts on both sides of a limit."""
    q = F.percentile("purity", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return rows.groupBy(*by).agg(
        q.alias("five"), F.avg((F.col("purity") == 0).cast("double")).alias("at_0"), F.avg((F.col("purity") == 1).cast("double")).alias("at_1"),
        F.count_if(F.col("purity") >= high).alias("n_high"), F.count_if(F.col("purity") < high).alias("n_low"),
    )
