"""Comparison of two road networks: route lengths, buffers, junctions, masks.

The route metric emits one row per control pair from a kernel (one graph a group), and everything
after it (which pairs count, their scores, means, decomposition) is plain aggregation, so that
other radii and cut-offs reuse the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, scalars
from .graph import by_graph, junctions, packed, points, unpack

SIDES = (("forward", "t", "p"), ("backward", "p", "t"))


def roles(truth: tuple[DataFrame, DataFrame], proposal: tuple[DataFrame, DataFrame]) -> DataFrame:
    return packed(*truth).withColumn("role", F.lit("t")).unionByName(packed(*proposal).withColumn("role", F.lit("p")))


def controls(a: kernels.Graph, spacing: float = 50.0, sampling: str = "reference", max_control: int | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(positions of a's control points, lengths of the routes between them)."""
    dense = a.densify(spacing, sampling)
    control = list(dense.nodes)
    if max_control is not None and len(control) > max_control:
        rng = np.random.default_rng(seed)
        control = [control[i] for i in rng.choice(len(control), max_control, False)]
    at = np.array([dense.nodes[n] for n in control], float).reshape(-1, 2)
    return at, dense.distances_among(control) if control else np.zeros((0, 0))


def directed(control: tuple[np.ndarray, np.ndarray], b: kernels.Graph, max_snap: float = 25.0) -> tuple[dict, int, int]:
    """(pairs, control points, those that land) of a graph's control points in b; no pairs without control points."""
    spots_a, la = control
    if not len(spots_a):
        return {}, 0, 0
    other, landed = b.inject(spots_a, max_snap)
    i, j = np.nonzero(np.triu(np.isfinite(la), 1))
    on = np.array([x is not None for x in landed])
    spots = sorted({x for x in landed if x is not None})
    place = {x: k for k, x in enumerate(spots)}
    at = np.array([place.get(x, -1) for x in landed])
    both = on[i] & on[j]
    lb = np.full(len(i), np.nan)
    if both.any():
        lb[both] = other.distances_among(spots)[at[i[both]], at[j[both]]]
    return {"i": i, "j": j, "la": la[i, j], "lb": lb, "landed": both}, len(spots_a), int(on.sum())


def graph_apls(truth: kernels.Graph, control: tuple[np.ndarray, np.ndarray], proposal: kernels.Graph, min_length: float = 10.0) -> float:
    """What `apls` gives for one graph, without a row a pair. control: the truth's `controls`."""
    side = []
    for c, b in ((control, proposal), (controls(proposal), truth)):
        pairs, _, _ = directed(c, b)
        score = np.zeros(0)
        if pairs:
            counted = pairs["la"] >= min_length
            la, lb = pairs["la"][counted], pairs["lb"][counted]
            score = np.where(lb < math.inf, 1 - np.minimum(1.0, np.abs(la - lb) / la), 0.0)
        side.append(float(score.mean()) if len(score) else 0.0)
    return 2 * side[0] * side[1] / sum(side) if sum(side) else 0.0


def route_pairs(
    truth: tuple[DataFrame, DataFrame], proposal: tuple[DataFrame, DataFrame], spacing: float = 50.0, max_snap: float = 25.0,
    sampling: str = "reference", max_control: int | None = None, seed: int = 0,
) -> DataFrame:
    """Control pairs of both directions.

    graph_id, direction, i, j, la (route length in the source), lb (in the other graph, infinite
    without a route), landed (both ends), n_control, n_landed. A row with i null carries the counts
    of a direction without pairs.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = {r: unpack(rows[rows.role == r]) for r in ("t", "p")}
        parts = []
        for name, a, b in SIDES:
            pairs, n, landed = directed(controls(g[a], spacing, sampling, max_control, seed), g[b], max_snap)
            if not len(pairs.get("i", ())):
                pairs = {"i": [None], "j": [None], "la": [None], "lb": [None], "landed": [None]}
            got = pd.DataFrame(pairs).astype({"i": "Int64", "j": "Int64", "la": "Float64", "lb": "Float64", "landed": "boolean"})
            got["lb"] = got.lb.mask(~got.landed.fillna(False))  # null, not NaN, where an end does not land
            parts.append(got.assign(graph_id=key[0], direction=name, n_control=n, n_landed=landed))
        return pd.concat(parts)[["graph_id", "direction", "i", "j", "la", "lb", "landed", "n_control", "n_landed"]]

    schema = "graph_id string, direction string, i long, j long, la double, lb double, landed boolean, n_control long, n_landed long"
    return by_graph(roles(truth, proposal)).applyInPandas(run, schema)


def score_pairs(pairs: DataFrame, min_length: float = 10.0) -> DataFrame:
    """Per graph and direction: score and the counts that decompose it."""
    counted = F.col("i").isNotNull() & (F.col("la") >= min_length) & (F.col("la") < F.lit(math.inf))
    route = F.col("landed") & (F.col("lb") < F.lit(math.inf))
    score = F.when(route, scalars.pair_score(F.col("la"), F.col("lb"))).otherwise(0.0)
    return pairs.groupBy("graph_id", "direction").agg(
        F.coalesce(F.avg(F.when(counted, score)), F.lit(0.0)).alias("score"),
        F.coalesce(F.sum(F.when(counted, score)), F.lit(0.0)).alias("score_sum"),
        F.max("n_control").alias("n_control"),
        F.max("n_landed").alias("n_landed"),
        F.count_if(counted).alias("n_pairs"),
        F.count_if(counted & ~F.col("landed")).alias("n_unlanded"),
        F.count_if(counted & F.col("landed") & (F.col("lb") == F.lit(math.inf))).alias("n_no_path"),
    )


def combine(directions: DataFrame) -> DataFrame:
    """Per graph: the harmonic mean of both directions, with their scores and counts."""
    side = lambda c, d: F.max(F.when(F.col("direction") == d, F.col(c)))
    cols = ("score", "n_control", "n_landed", "n_pairs", "n_unlanded", "n_no_path")
    wide = directions.groupBy("graph_id").agg(*[side(c, d).alias(f"{d}_{c}") for d, _, _ in SIDES for c in cols])
    return wide.withColumn("apls", scalars.harmonic(F.col("forward_score"), F.col("backward_score")))


def apls(truth, proposal, spacing=50.0, max_snap=25.0, min_length=10.0, sampling="reference", max_control=None, seed=0) -> DataFrame:
    """Path length similarity of two networks per graph, 0 to 1, with its decomposition."""
    return combine(score_pairs(route_pairs(truth, proposal, spacing, max_snap, sampling, max_control, seed), min_length))


def routes(nodes: DataFrame, edges: DataFrame, ends: DataFrame) -> DataFrame:
    """The node lists of shortest routes for pairs (graph_id, a, b): graph_id, a, b, length, route."""

    def run(key: tuple, g_rows: pd.DataFrame, e_rows: pd.DataFrame) -> pd.DataFrame:
        g, out = unpack(g_rows), []
        near = g.adjacency()
        for a, some in e_rows.groupby("a"):
            d, prev = g.distances(int(a), near) if int(a) in near else ({}, {})
            for b in some.b:
                if int(b) in d:
                    path = [int(b)]
                    while path[-1] != a:
                        path.append(prev[path[-1]])
                    out.append((key[0], int(a), int(b), d[int(b)], path[::-1]))
        return pd.DataFrame(out, columns=["graph_id", "a", "b", "length", "route"])

    return by_graph(packed(nodes, edges)).cogroup(by_graph(ends)).applyInPandas(run, "graph_id string, a long, b long, length double, route array<long>")


def buffer_prf(truth: DataFrame, proposal: DataFrame, buffer: float = 10.0) -> DataFrame:
    """Length precision, recall, F1 within a buffer, per graph; an empty side counts as 1.

    truth, proposal: edges (graph_id, pts).
    """
    one = truth.select("graph_id", F.lit("t").alias("role"), "pts").unionByName(proposal.select("graph_id", F.lit("p").alias("role"), "pts"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, p = ([points(x) for x in rows[rows.role == r].pts] for r in ("t", "p"))
        lt, lp = sum(map(kernels.length, t)), sum(map(kernels.length, p))
        return pd.DataFrame([(key[0], lt, lp, kernels.covered_length(t, p, buffer), kernels.covered_length(p, t, buffer))], columns=["graph_id", "truth", "proposal", "truth_hit", "proposal_hit"])

    got = by_graph(one).applyInPandas(run, "graph_id string, truth double, proposal double, truth_hit double, proposal_hit double")
    return _prf(got, F.col("proposal_hit"), F.col("proposal"), F.col("truth_hit"), F.col("truth"))


def _prf(df: DataFrame, hit_p, all_p, hit_t, all_t) -> DataFrame:
    p = F.when(all_p > 0, F.try_divide(hit_p.cast("double"), all_p)).otherwise(1.0)
    r = F.when(all_t > 0, F.try_divide(hit_t.cast("double"), all_t)).otherwise(1.0)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", scalars.f1(F.col("precision"), F.col("recall")))


def match_junctions(truth: DataFrame, proposal: DataFrame, radius: float = 10.0) -> DataFrame:
    """Optimal one-to-one pairs of points (graph_id, node, x, y, degree): most pairs, then least distance."""
    one = truth.withColumn("role", F.lit("t")).unionByName(proposal.withColumn("role", F.lit("p")))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, p = (rows[rows.role == r].sort_values("node") for r in ("t", "p"))
        got = kernels.match_points(t[["x", "y"]].to_numpy(float), p[["x", "y"]].to_numpy(float), radius)
        out = [(key[0], int(t.node.iloc[i]), int(p.node.iloc[j]), d, int(t.degree.iloc[i]), int(p.degree.iloc[j])) for i, j, d in got]
        return pd.DataFrame(out, columns=["graph_id", "truth_node", "node", "distance", "truth_degree", "degree"])

    return by_graph(one).applyInPandas(run, "graph_id string, truth_node long, node long, distance double, truth_degree long, degree long")


def junction_prf(truth: tuple[DataFrame, DataFrame], proposal: tuple[DataFrame, DataFrame], radius: float = 10.0, min_degree: int = 3) -> DataFrame:
    """Junction precision, recall, F1, agreement of degrees and mean offset (null without a match)."""
    t, p = junctions(*truth, min_degree), junctions(*proposal, min_degree)
    m = match_junctions(t, p, radius).groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("matched"),
        F.avg((F.col("truth_degree") == F.col("degree")).cast("double")).alias("degree_agreement"),
        F.avg("distance").alias("mean_offset"),
    )
    ids = truth[0].select("graph_id").union(proposal[0].select("graph_id")).distinct()
    count = lambda d, c: d.groupBy("graph_id").agg(F.count(F.lit(1)).alias(c))
    all_of = ids.join(count(t, "n_truth"), "graph_id", "left").join(count(p, "n_proposal"), "graph_id", "left").join(m, "graph_id", "left")
    all_of = all_of.fillna(0, ["n_truth", "n_proposal", "matched"])
    return _prf(all_of, F.col("matched"), F.col("n_proposal"), F.col("matched"), F.col("n_truth"))


def metric_rows(truth, proposal, buffers=(5.0, 10.0, 20.0), radii=(5.0, 10.0, 20.0), snaps=(25.0,)) -> DataFrame:
    """All metrics in long form: graph_id, metric, value (null where undefined)."""
    parts = []
    for sampling in ("reference", "uniform"):
        a = apls(truth, proposal, sampling=sampling, max_snap=snaps[0])
        names = ["apls", "forward_score", "backward_score"]
        parts.append(a.select("graph_id", F.expr("stack(3, " + ", ".join(f"'{n}_{sampling}', {n}" for n in names) + ") as (metric, value)")))
    for b in buffers:
        x = buffer_prf(truth[1], proposal[1], b)
        parts.append(x.select("graph_id", F.expr(f"stack(3, 'buffer_precision@{b:g}', precision, 'buffer_recall@{b:g}', recall, 'buffer_f1@{b:g}', f1) as (metric, value)")))
    for r in radii:
        x = junction_prf(truth, proposal, r)
        cols = ["precision", "recall", "f1", "degree_agreement", "mean_offset"]
        parts.append(x.select("graph_id", F.expr(f"stack({len(cols)}, " + ", ".join(f"'junction_{c}@{r:g}', {c}" for c in cols) + ") as (metric, value)")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def iou(a: DataFrame, b: DataFrame, chips: DataFrame | None = None) -> DataFrame:
    """Intersection over union of pixel relations (chip, row, col); 1 where both are empty."""
    keys = ["chip", "row", "col"]
    marked = a.select(*keys).distinct().withColumn("_a", F.lit(1)).join(b.select(*keys).distinct().withColumn("_b", F.lit(1)), keys, "full_outer")
    got = marked.groupBy("chip").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count(F.lit(1)).alias("either"))
    if chips is not None:
        got = chips.select("chip").join(got, "chip", "left").fillna(0, ["both", "either"])
    return got.withColumn("iou", F.when(F.col("either") == 0, 1.0).otherwise(F.try_divide(F.col("both").cast("double"), F.col("either"))))


def round_trip(truth: tuple[DataFrame, DataFrame], grids: DataFrame, half_width: int = 2) -> DataFrame:
    """Draw the truth, trace it back, clean it and score it: the ceiling of tracing."""
    from .graph import clean, drawn_and_traced

    return apls(truth, clean(*drawn_and_traced(truth[1], grids, half_width)))
