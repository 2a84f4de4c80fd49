"""The route metric against a second implementation, written from its definition with plain loops.

Graphs are jittered street grids of some dozens of nodes with bends, missing edges, an offset and a split edge.
"""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from stradale.functions import geom
from stradale.operators import graph as G
from stradale.operators import metrics as M


def dist(p, q):
    return math.hypot(p[0] - q[0], p[1] - q[1])


def line_length(p):
    return sum(dist(a, b) for a, b in zip(p, p[1:]))


def point_at(p, s):
    for a, b in zip(p, p[1:]):
        d = dist(a, b)
        if s <= d:
            return (a[0] + (b[0] - a[0]) * s / d, a[1] + (b[1] - a[1]) * s / d)
        s -= d
    return p[-1]


def cuts_of(p, spacing):
    total = line_length(p)
    wide = max(x for x, _ in p) - min(x for x, _ in p)
    tall = max(y for _, y in p) - min(y for _, y in p)
    if abs(math.hypot(wide, tall) - total) / total < 0.012 or total < 0.75 * spacing:
        return []
    n = 2 if total <= spacing else math.ceil(total / spacing)
    return [k * total / n for k in range(1, n)]


def nearest(p, q):
    """(distance, arc length) of the point of line p nearest to q."""
    best, done = (math.inf, 0.0), 0.0
    for a, b in zip(p, p[1:]):
        d = dist(a, b)
        t = max(0.0, min(1.0, ((q[0] - a[0]) * (b[0] - a[0]) + (q[1] - a[1]) * (b[1] - a[1])) / d**2))
        best = min(best, (dist(q, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))), done + t * d))
        done += d
    return best


class Roads:
    """Nodes and edges; places on edges are (edge, arc length). Routes run between places."""

    def __init__(self, nodes, edges):
        self.nodes, self.edges = nodes, edges

    def routes(self, places):
        """Route lengths between all places, by a heap over nodes and places."""
        on = {}
        for k, (e, s) in enumerate(places):
            on.setdefault(e, []).append((s, k))
        near = {}

        def tie(a, b, w):
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))

        for e, (u, v, p) in enumerate(self.edges):
            stops = [(0.0, ("n", u)), *sorted((s, ("p", k)) for s, k in on.get(e, [])), (line_length(p), ("n", v))]
            for (s, a), (t, b) in zip(stops, stops[1:]):
                tie(a, b, t - s)
        out = []
        for k in range(len(places)):
            best, heap = {}, [(0.0, ("p", k))]
            while heap:
                d, a = heapq.heappop(heap)
                if a in best:
                    continue
                best[a] = d
                for b, w in near.get(a, ()):
                    if b not in best:
                        heapq.heappush(heap, (d + w, b))
            out.append([best.get(("p", j), math.inf) for j in range(len(places))])
        return out

    def controls(self, spacing):
        """Places of all nodes that an edge has, and of the cuts of every edge."""
        first = {}
        for e, (u, v, p) in enumerate(self.edges):
            first.setdefault(u, (e, 0.0))
            first.setdefault(v, (e, line_length(p)))
        return [*first.values(), *((e, s) for e, (_, _, p) in enumerate(self.edges) for s in cuts_of(p, spacing))]


def one_way(a, b, spacing, snap, least):
    """(score, pairs, unlanded, without a route) of the routes of a looked up in b."""
    control = a.controls(spacing)
    own = a.routes(control)
    spots = []
    for e, s in control:
        q = point_at(a.edges[e][2], s)
        d, k, arc = min((*nearest(p, q)[:1], k, nearest(p, q)[1]) for k, (_, _, p) in enumerate(b.edges))
        spots.append((k, arc) if d <= snap else None)
    there = [x for x in spots if x]
    other = b.routes(there)
    place = {i: there.index(x) for i, x in enumerate(spots) if x}
    total = n = lost = none = 0
    for i in range(len(control)):
        for j in range(i):
            d = own[i][j]
            if not least <= d < math.inf:
                continue
            n += 1
            if spots[i] is None or spots[j] is None:
                lost += 1
            elif (r := other[place[i]][place[j]]) == math.inf:
                none += 1
            else:
                total += 1 - min(1.0, abs(d - r) / d)
    return total / n if n else 0.0, n, lost, none


def scene(seed, n=6, step=90.0):
    rng = random.Random(seed)
    at = {i * n + j: (j * step + rng.uniform(-15, 15), i * step + rng.uniform(-15, 15)) for i in range(n) for j in range(n)}
    edges = []
    for i in range(n):
        for j in range(n):
            for k in ((i, j + 1), (i + 1, j)):
                if max(k) < n:
                    u, v = i * n + j, k[0] * n + k[1]
                    a, b = at[u], at[v]
                    mid = ((a[0] + b[0]) / 2 + rng.choice([0, 0, 25, -30]), (a[1] + b[1]) / 2 + rng.choice([0, 0, 20, -25]))
                    edges.append((u, v, [a, mid, b] if rng.random() < 0.6 else [a, b]))
    return Roads(at, edges)


def damaged(r, seed, share, shift):
    rng = random.Random(seed)
    stay = [e for e in r.edges if rng.random() >= share]
    move = lambda p: (p[0] + shift, p[1] - shift / 2)
    return Roads({k: move(p) for k, p in r.nodes.items()}, [(u, v, [move(p) for p in pts]) for u, v, pts in stay])


def tables(spark, scenes):
    n = [(g, k, *p) for g, r in scenes.items() for k, p in r.nodes.items() if any(k in e[:2] for e in r.edges)]
    e = [(g, i, u, v, [{"x": x, "y": y} for x, y in p]) for g, r in scenes.items() for i, (u, v, p) in enumerate(r.edges)]
    edges = spark.createDataFrame(e, "graph_id string, edge long, u long, v long, pts array<struct<x:double,y:double>>")
    return spark.createDataFrame(n, "graph_id string, node long, x double, y double"), edges.withColumn("length", geom.polyline_length(F.col("pts")))


def test_route_metric_on_curved_and_damaged_graphs(spark):
    truth = {f"g{k}": scene(k) for k in range(4)}
    hurt = {f"g{k}": damaged(truth[f"g{k}"], 50 + k, s, x) for k, (s, x) in enumerate([(0.0, 0.0), (0.15, 0.0), (0.3, 6.0), (0.5, 30.0)])}
    t, p = tables(spark, truth), tables(spark, hurt)
    got = {r["graph_id"]: r for r in M.apls(t, p, spacing=50.0, max_snap=25.0, min_length=10.0).collect()}
    for g in truth:
        f = one_way(truth[g], hurt[g], 50.0, 25.0, 10.0)
        b = one_way(hurt[g], truth[g], 50.0, 25.0, 10.0)
        r = got[g]
        assert (r["forward_n_pairs"], r["forward_n_unlanded"], r["forward_n_no_path"]) == f[1:]
        assert (r["backward_n_pairs"], r["backward_n_unlanded"], r["backward_n_no_path"]) == b[1:]
        assert r["forward_score"] == pytest.approx(f[0], abs=1e-9) and r["backward_score"] == pytest.approx(b[0], abs=1e-9)
        assert r["apls"] == pytest.approx(2 * f[0] * b[0] / (f[0] + b[0]) if f[0] + b[0] else 0.0, abs=1e-9)
    assert got["g0"]["apls"] == pytest.approx(1) and got["g0"]["apls"] > got["g1"]["apls"] > got["g3"]["apls"]


def test_graphs_are_dealt_out_by_number(spark, tmp_path):
    """Grouped kernels do not end up in one task, however small their input is."""
    t = tables(spark, {f"g{k}": scene(k, 3) for k in range(24)})
    G.path_lengths(*t).write.parquet(str(tmp_path / "out"))
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("part-")]) >= spark.sparkContext.defaultParallelism
    n, e = G.prune(*G.snap(*G.simplify(*t)))
    plan = G.total_length(e)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 3  # each kernel once, though nodes and edges go on as two tables
