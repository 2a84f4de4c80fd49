"""Graph operators on node and edge tables.

Degrees, lengths, noding of ends, densifying and one prune round are plain DataFrame operations.
Rewrites that iterate (prune to the fixpoint, snapping, shortest paths, tracing) run as numpy
kernels in grouped Arrow maps, one graph a group; graphs are chip-sized.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom, kernels
from ..store import stored, unsent
from . import spatial


def build(lines: DataFrame, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines (graph_id, line, pts): ends fuse on their rounded grid key.

    The first position seen (by line, start before end) wins; ids follow first appearance.
    Lines with fewer than two points are left out.
    """
    use = lines.where(F.size("pts") >= 2)
    end = lambda i, p: F.struct(
        F.lit(i).alias("side"), p["x"].alias("x"), p["y"].alias("y"),
        F.rint(p["x"] / tolerance).cast("long").alias("kx"), F.rint(p["y"] / tolerance).cast("long").alias("ky"),
    )
    ends = use.select("graph_id", "line", F.explode(F.array(end(0, F.get("pts", F.lit(0))), end(1, F.element_at("pts", -1)))).alias("e")).select("graph_id", "line", "e.*")
    first = ends.groupBy("graph_id", "kx", "ky").agg(F.min(F.struct("line", "side", "x", "y")).alias("f"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("f.line", "f.side")) - 1
    keyed = first.select("graph_id", "kx", "ky", rank.cast("long").alias("node"), F.col("f.x").alias("x"), F.col("f.y").alias("y"))
    named = ends.join(keyed.select("graph_id", "kx", "ky", "node"), ["graph_id", "kx", "ky"])
    uv = named.groupBy("graph_id", "line").agg(F.max(F.when(F.col("side") == 0, F.col("node"))).alias("u"), F.max(F.when(F.col("side") == 1, F.col("node"))).alias("v"))
    edges = use.join(uv, ["graph_id", "line"]).select("graph_id", F.col("line").alias("edge"), "u", "v", "pts", geom.polyline_length(F.col("pts")).alias("length"))
    return keyed.select("graph_id", "node", "x", "y"), edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node; parallel edges count, a self-loop counts twice."""
    ends = edges.select("graph_id", F.explode(F.array("u", "v")).alias("node"))
    return nodes.join(ends.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("degree")), ["graph_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).where(F.col("degree") == 1)


def junctions(nodes: DataFrame, edges: DataFrame, min_degree: int = 3) -> DataFrame:
    return degrees(nodes, edges).where(F.col("degree") >= min_degree)


def total_length(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_edges"))


def control_points(edges: DataFrame, spacing: float, sampling: str = "reference") -> DataFrame:
    """The points that densifying puts on edges: graph_id, edge, k, s, x, y."""
    cuts = edges.select("graph_id", "edge", "pts", F.posexplode(geom.control_cuts(F.col("pts"), spacing, sampling)).alias("k", "s"))
    return cuts.select("graph_id", "edge", "k", "s", geom.along(F.col("pts"), F.col("s")).alias("p")).select("graph_id", "edge", "k", "s", "p.x", "p.y")


def prune_once(nodes: DataFrame, edges: DataFrame, shortest: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """One round: edges shorter than `shortest` with a dead end go, then nodes without edges."""
    dead = endpoints(nodes, edges).select("graph_id", "node")
    short = edges.where(F.col("length") < shortest).select("graph_id", "edge", F.explode(F.array("u", "v")).alias("node"))
    doomed = short.join(dead, ["graph_id", "node"], "left_semi").select("graph_id", "edge").distinct()
    kept = edges.join(doomed, ["graph_id", "edge"], "left_anti")
    used = kept.select("graph_id", F.explode(F.array("u", "v")).alias("node"))
    return nodes.join(used, ["graph_id", "node"], "left_semi"), kept


def endpoint_pairs(nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Pairs of dead ends within the radius that no edge joins already."""
    pairs = spatial.radius_pairs(endpoints(nodes, edges), radius)
    have = edges.select("graph_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    return pairs.join(have, ["graph_id", "a", "b"], "left_anti")


# --- kernels ------------------------------------------------------------------------------------------


def points(pts) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in pts], float).reshape(-1, 2)


def rows_of(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


#: Attribute of the two tables of a kernel: the table that they were taken from.
MADE = "_made_by"
PACKED = "graph_id string, part string, id long, u long, v long, px array<double>, py array<double>"


def packed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One table for both relations, so that a rewrite reads and writes a single grouped map.

    Lines travel as two number arrays, which Arrow hands to numpy without a Python object a point. Nodes
    and edges that one kernel made, as they are, are taken from its own table: as a union of both they
    would run the kernel, and all before it, twice.
    """
    made = getattr(nodes, MADE, None)
    if made is not None and made is getattr(edges, MADE, None):
        made = made.where("part in ('n', 'e')")
        return made.select(*[F.col(c).alias(c) for c in made.columns])
    null = F.lit(None).cast("long")
    e = edges.select("graph_id", F.lit("e").alias("part"), F.col("edge").alias("id"), "u", "v", F.transform("pts", lambda p: p["x"]).alias("px"), F.transform("pts", lambda p: p["y"]).alias("py"))
    n = nodes.select("graph_id", F.lit("n").alias("part"), F.col("node").alias("id"), null.alias("u"), null.alias("v"), F.array("x").alias("px"), F.array("y").alias("py"))
    both = n.unionByName(e)
    # new names for the columns: a table may be cogrouped with one that comes from it
    return both.select(*[F.col(c).alias(c) for c in both.columns])


def unpack(rows: pd.DataFrame) -> kernels.Graph:
    n, e = rows[rows.part == "n"].sort_values("id"), rows[rows.part == "e"].sort_values("id")
    return kernels.Graph(
        {int(k): (float(x[0]), float(y[0])) for k, x, y in zip(n.id, n.px, n.py)},
        [(int(u), int(v), np.column_stack([x, y]).astype(float)) for u, v, x, y in zip(e.u, e.v, e.px, e.py)],
    )


def repack(graph_id: str, g: kernels.Graph, more: list[tuple] | None = None) -> pd.DataFrame:
    out = [(graph_id, "n", k, None, None, [x], [y]) for k, (x, y) in g.nodes.items()]
    out += [(graph_id, "e", i, u, v, p[:, 0], p[:, 1]) for i, (u, v, p) in enumerate(g.edges)]
    got = pd.DataFrame(out + (more or []), columns=["graph_id", "part", "id", "u", "v", "px", "py"])
    return got.astype({"u": "Int64", "v": "Int64"})


def by_id(g: kernels.Graph) -> kernels.Graph:
    """g with its nodes in the order that `repack` and `unpack` would leave them in."""
    return kernels.Graph(dict(sorted(g.nodes.items())), g.edges)


def split_packed(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a packed table."""
    n = made.where("part = 'n'").select("graph_id", F.col("id").alias("node"), F.get("px", F.lit(0)).alias("x"), F.get("py", F.lit(0)).alias("y"))
    e = made.where("part = 'e'").select("graph_id", F.col("id").alias("edge"), "u", "v", F.zip_with("px", "py", geom.point).alias("pts"))
    e = e.withColumn("length", geom.polyline_length(F.col("pts")))
    for df in (n, e):
        setattr(df, MADE, made)
    return n, e


def by_graph(df: DataFrame, key: str = "graph_id"):
    """df grouped for a kernel, dealt out by the session's number of partitions.

    Kernels take time by the graph, not by the byte: left to itself, adaptive execution merges small
    exchanges by bytes into one task, which then holds all graphs. A partition count that is asked for stays.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, key).groupBy(key)


def rewrite(nodes: DataFrame, edges: DataFrame, how) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after `how(Graph) -> Graph` on every graph."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return repack(key[0], how(unpack(rows)))

    return split_packed(by_graph(packed(nodes, edges)).applyInPandas(run, PACKED))


def settled(net: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A network as a stored table, for those that several jobs read."""
    return split_packed(stored(net[0].sparkSession, packed(*net), "network"))


def simplify(nodes: DataFrame, edges: DataFrame, tolerance: float = 2.0):
    return rewrite(nodes, edges, lambda g: g.simplified(tolerance))


def prune(nodes: DataFrame, edges: DataFrame, shortest: float = 20.0):
    return rewrite(nodes, edges, lambda g: g.pruned(shortest))


def snap(nodes: DataFrame, edges: DataFrame, tolerance: float = 8.0):
    return rewrite(nodes, edges, lambda g: g.snapped(tolerance))


def clean(nodes: DataFrame, edges: DataFrame, simplify_tol: float = 2.0, spur: float = 20.0, snap_tol: float = 8.0):
    """simplify, prune, snap, prune; the order matters."""
    return rewrite(nodes, edges, lambda g: g.cleaned(simplify_tol, spur, snap_tol))


def densify(nodes: DataFrame, edges: DataFrame, spacing: float, sampling: str = "reference"):
    return rewrite(nodes, edges, lambda g: g.densify(spacing, sampling))


def drop_small(nodes: DataFrame, edges: DataFrame, least: float = 80.0, known: int = 100):
    """Without components of up to `known` nodes whose longest shortest route is below `least`."""
    return rewrite(nodes, edges, lambda g: g.without_small(least, known))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node, component (its smallest node)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c = unpack(rows).components()
        return pd.DataFrame({"graph_id": key[0], "node": list(c), "component": list(c.values())})

    return by_graph(packed(nodes, edges)).applyInPandas(run, "graph_id string, node long, component long")


def class_components(lines: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Lines (graph_id, line, klass, pts) that hang together within their class: graph_id, line, klass, component.

    Every class of a graph is built as a graph of its own.
    """
    own = F.concat_ws("|", "graph_id", "klass")
    nodes, edges = build(lines.select(own.alias("graph_id"), "line", "pts"), tolerance)
    comp = components(nodes, edges).withColumnRenamed("node", "u")
    by_line = edges.select("graph_id", F.col("edge").alias("line"), "u").join(comp, ["graph_id", "u"])
    return lines.select("graph_id", "line", "klass", own.alias("_own")).join(by_line.select(F.col("graph_id").alias("_own"), "line", "component"), ["_own", "line"]).drop("_own")


def path_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Shortest path lengths between all node pairs a < b that a route joins."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, d = unpack(rows).all_distances()
        i, j = np.nonzero(np.triu(np.isfinite(d), 1))
        return pd.DataFrame({"graph_id": key[0], "a": ids[i], "b": ids[j], "length": d[i, j]})

    return by_graph(packed(nodes, edges)).applyInPandas(run, "graph_id string, a long, b long, length double")


def lengths_from(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Shortest path lengths from given nodes (graph_id, node) to all nodes that a route joins: graph_id, a, b, length."""

    def run(key: tuple, g_rows: pd.DataFrame, s_rows: pd.DataFrame) -> pd.DataFrame:
        g, out = unpack(g_rows), []
        near = g.adjacency()
        for a in sorted({int(n) for n in s_rows.node} & set(near)):
            out += [(key[0], a, b, d) for b, d in g.distances(a, near)[0].items()]
        return pd.DataFrame(out, columns=["graph_id", "a", "b", "length"])

    return by_graph(packed(nodes, edges)).cogroup(by_graph(sources.select("graph_id", "node"))).applyInPandas(run, "graph_id string, a long, b long, length double")


def node_lines(lines: DataFrame, least: float = 1e-6) -> DataFrame:
    """Lines split at all intersections, equal pieces once: graph_id, line, source, pts."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("line")
        got = kernels.node_lines([points(p) for p in rows.pts], least)
        src = rows.line.tolist()
        return pd.DataFrame([(key[0], i, src[s], rows_of(p)) for i, (p, s) in enumerate(got)], columns=["graph_id", "line", "source", "pts"])

    return by_graph(lines.select("graph_id", "line", "pts")).applyInPandas(run, "graph_id string, line long, source long, pts array<struct<x:double,y:double>>")


def clip(lines: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Parts of lines inside a box: graph_id, line, part, pts."""

    def run(batches):
        for rows in batches:
            out = [(g, i, k, rows_of(q)) for g, i, p in zip(rows.graph_id, rows.line, rows.pts) for k, q in enumerate(kernels.clip_line(points(p), box))]
            yield pd.DataFrame(out, columns=["graph_id", "line", "part", "pts"])

    return lines.select("graph_id", "line", "pts").mapInPandas(run, "graph_id string, line long, part int, pts array<struct<x:double,y:double>>")


def drawn_and_traced(edges: DataFrame, grids: DataFrame, half_width: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of drawing edges (graph_id, pts) on grids (chip, height, width) and tracing them, in one kernel.

    The same as `trace` after `raster.draw_edges`, without a row a pixel between the two.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lines = [points(p) for p in rows.pts if p is not None]
        return repack(key[0], kernels.trace(kernels.draw(lines, int(rows.height.iloc[0]), int(rows.width.iloc[0]), half_width)))

    both = grids.select(F.col("chip").alias("graph_id"), "height", "width").join(edges.select("graph_id", "pts"), "graph_id", "left")
    return split_packed(by_graph(both).applyInPandas(run, PACKED))


def trace(masks: DataFrame, grids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) traced from pixel masks (chip, row, col) on grids (chip, height, width)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(rows.height.iloc[0]), int(rows.width.iloc[0])), bool)
        on = rows.dropna(subset=["row"])
        m[on.row.astype(int), on.col.astype(int)] = True
        return repack(key[0], kernels.trace(m))

    both = grids.join(unsent(masks), "chip", "left").select(F.col("chip").alias("graph_id"), "height", "width", "row", "col")
    return split_packed(by_graph(both).applyInPandas(run, PACKED))
