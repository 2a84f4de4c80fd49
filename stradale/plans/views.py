"""Deterministic views of the sample tables in the shapes that the operators expect.

Each view exists twice: as a DataFrame here and as SQL text in `SQL` (for independent checks).
Only integer arithmetic makes keys; nothing is random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom
from ..store import unsent

HIGHWAYS = ("motorway", "primary_link", "residential", "service", "footway", "living_street", "track", "unclassified", "trunk")
TAGS = ('"access"=>"private"', '"service"=>"alley","lanes"=>"2"', '"area"=>"yes"', '"bicycle:access"=>"private","lanes"=>"4"', '"motor_vehicle"=>"no"', '"lanes"=>"1"')


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def placement(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.cast("string").alias("sample_id"), k.cast("int").alias("pos"),
        ((k % 10) * 320 + 160).cast("double").alias("x"), (F.expr("s_suppkey div 10") * 320 - 160).cast("double").alias("y"),
    )


def way_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of ways: the lines of an order."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    j = li.join(unsent(o), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_suppkey").cast("string").alias("chip"), F.col("l_orderkey").alias("way"), F.col("o_orderpriority").alias("klass"), F.col("l_quantity").cast("double").alias("node_length"))


def ways(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    return table(spark, sf, "part").select(
        k.alias("way"), pick(HIGHWAYS, k % len(HIGHWAYS)).alias("highway"),
        F.when(F.col("p_size") % 7 < 6, pick(TAGS, F.col("p_size") % 7)).alias("other_tags"), F.col("p_retailprice").alias("length"), F.col("p_size").alias("size"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").cast("string").alias("chip"), F.col("event_type").alias("arm")).agg(F.avg("value").alias("value")).withColumn("metric", F.lit("apls"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    pred = F.when(v % 10 < 7, F.col("label")).otherwise((F.col("label") + v) % 10)
    return table(spark, sf, "embeddings").select((v % 20).alias("chip"), F.col("label").cast("long").alias("truth"), pred.cast("long").alias("pred"))


def grid_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.range(16).select(F.col("id").alias("node"), ((F.col("id") % 4) * 100).cast("double").alias("x"), (F.floor(F.col("id") / 4) * 100).cast("double").alias("y"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("graph_id")).crossJoin(F.broadcast(n))  # 16 rows


def grid_edges(spark: SparkSession, sf: str, bowed: bool = False, drop: int = 0) -> DataFrame:
    """A 4 x 4 street grid per supplier, step 100; every third edge bowed; `drop` percent missing by key."""
    k = F.col("id")
    h = k < 12
    u = F.when(h, F.floor(k / 3) * 4 + k % 3).otherwise(k - 12).cast("long")
    v = F.when(h, u + 1).otherwise(u + 4).cast("long")
    e = spark.range(24).select(k.alias("edge"), u.alias("u"), v.alias("v"), h.alias("h"))
    x = lambda n: ((n % 4) * 100).cast("double")
    y = lambda n: (F.floor(n / 4) * 100).cast("double")
    a, b = geom.point(x(F.col("u")), y(F.col("u"))), geom.point(x(F.col("v")), y(F.col("v")))
    mid = geom.point((a["x"] + b["x"]) / 2 + F.when(F.col("h"), 0.0).otherwise(40.0), (a["y"] + b["y"]) / 2 + F.when(F.col("h"), 40.0).otherwise(0.0))
    pts = F.when((F.col("edge") % 3 == 0) & F.lit(bowed), F.array(a, mid, b)).otherwise(F.array(a, b))
    e = e.select("edge", "u", "v", pts.alias("pts"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("graph_id"))
    j = s.crossJoin(F.broadcast(e)).where((F.col("edge") * 7 + F.col("s_suppkey") * 13) % 100 >= drop)  # 24 rows
    return j.select("graph_id", "edge", "u", "v", "pts", geom.polyline_length(F.col("pts")).alias("length"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Grid nodes moved by integer jitter: graph_id, node, x, y."""
    n, k = F.col("node"), F.col("graph_id").cast("long")
    return grid_nodes(spark, sf).select("graph_id", "node", (F.col("x") + (k * n * 31) % 61 - 30).alias("x"), (F.col("y") + (k * 7 + n * n * 17) % 53 - 26).alias("y"))


def stubs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The thinned grid with a chain of two short stubs at node 0: (nodes, edges)."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("graph_id"), (F.col("s_suppkey") % 4 * 5 + 8).cast("double").alias("d"))
    n = s.select("graph_id", F.explode(F.array(*[F.struct(F.lit(16 + i).cast("long").alias("node"), (-(i + 1) * F.col("d")).alias("x"), F.lit(0.0).alias("y")) for i in range(2)])).alias("n")).select("graph_id", "n.*")
    one = lambda i, u, v: F.struct(
        F.lit(24 + i).cast("long").alias("edge"), F.lit(u).cast("long").alias("u"), F.lit(v).cast("long").alias("v"),
        F.array(geom.point(-i * F.col("d"), 0.0), geom.point(-(i + 1) * F.col("d"), 0.0)).alias("pts"),
    )
    e = s.select("graph_id", F.explode(F.array(one(0, 0, 16), one(1, 16, 17))).alias("e")).select("graph_id", "e.*").withColumn("length", geom.polyline_length(F.col("pts")))
    return grid_nodes(spark, sf).unionByName(n), grid_edges(spark, sf, drop=15).unionByName(e)


def mask(spark: SparkSession, sf: str, gap: int = 11) -> DataFrame:
    """A 31 x 31 grid of lines every 10 pixels with gaps by key: chip, row, col."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey"), F.col("s_suppkey").cast("string").alias("chip"))
    p = spark.range(31 * 31).select(F.floor(F.col("id") / 31).cast("int").alias("row"), (F.col("id") % 31).cast("int").alias("col")).where("row % 10 = 0 or col % 10 = 0")
    j = s.crossJoin(F.broadcast(p)).where((F.col("row") * 7 + F.col("col") * 13 + F.col("s_suppkey")) % gap != 0)  # 340 rows
    return j.select("chip", "row", "col")


def world_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Straight ways in metres, level for even part keys and upright for odd ones, with their boxes."""
    from ..sources.ways import with_boxes

    k = F.col("p_partkey")
    level = k % 2 == 0
    x = F.when(level, k * 53 % 2700).otherwise(k * 97 % 3200 + 0.7).cast("double")
    y = (k * 1.6 + 0.3).cast("double")
    pts = F.array(geom.point(x, y), geom.point(F.when(level, x + 120).otherwise(x), F.when(level, y).otherwise(y + 120)))
    w = ways(spark, sf).select("way", "highway", "other_tags")
    p = table(spark, sf, "part").select(k.alias("way"), pts.alias("pts"))
    return with_boxes(w.join(p, "way").select(F.col("way").cast("string").alias("osm_id"), "highway", "other_tags", "pts"))


def world_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """320 m tiles, ten in a row: graph_id, tile."""
    k = F.col("s_suppkey")
    one = geom.tile(F.lit(32611), (k % 10) * 320, (F.floor(k / 10) + 1) * 320, F.lit(320), F.lit(320), F.lit(1.0))
    return table(spark, sf, "supplier").select(k.cast("string").alias("graph_id"), one.alias("tile"))


_UV = "CASE WHEN k < 12 THEN (k // 3) * 4 + k % 3 ELSE k - 12 END"

SQL = {
    "placement": "SELECT CAST(s_suppkey AS VARCHAR) AS sample_id, CAST(s_suppkey AS INTEGER) AS pos, CAST((s_suppkey % 10) * 320 + 160 AS DOUBLE) AS x, CAST((s_suppkey // 10) * 320 - 160 AS DOUBLE) AS y FROM supplier",
    "way_nodes": "SELECT CAST(l_suppkey AS VARCHAR) AS chip, l_orderkey AS way, o_orderpriority AS klass, CAST(l_quantity AS DOUBLE) AS node_length FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "ways": f"SELECT p_partkey AS way, list_extract({list(HIGHWAYS)!r}, CAST(p_partkey % {len(HIGHWAYS)} AS INTEGER) + 1) AS highway, CASE WHEN p_size % 7 < 6 THEN list_extract({list(TAGS)!r}, CAST(p_size % 7 AS INTEGER) + 1) END AS other_tags, p_retailprice AS length, p_size AS size FROM part",
    "world_ways": "SELECT way, highway, other_tags, CASE WHEN way % 2 = 0 THEN way * 53 % 2700 ELSE way * 97 % 3200 + 0.7::DOUBLE END::DOUBLE AS x0, way * 1.6::DOUBLE + 0.3::DOUBLE AS y0, x0 + CASE WHEN way % 2 = 0 THEN 120 ELSE 0 END AS x1, y0 + CASE WHEN way % 2 = 0 THEN 0 ELSE 120 END AS y1 FROM ways",
    "world_tiles": "SELECT CAST(s_suppkey AS VARCHAR) AS graph_id, s_suppkey % 10 * 320.0::DOUBLE AS tx, s_suppkey // 10 * 320.0::DOUBLE AS ty FROM supplier",
    "scores": "SELECT CAST(user_id AS VARCHAR) AS chip, event_type AS arm, avg(value) AS value, 'apls' AS metric FROM events GROUP BY user_id, event_type",
    "predictions": "SELECT vec_id % 20 AS chip, CAST(label AS BIGINT) AS truth, CAST(CASE WHEN vec_id % 10 < 7 THEN label ELSE (label + vec_id) % 10 END AS BIGINT) AS pred FROM embeddings",
    "grid_nodes": "SELECT CAST(s_suppkey AS VARCHAR) AS graph_id, n AS node, CAST(n % 4 * 100 AS DOUBLE) AS x, CAST(n // 4 * 100 AS DOUBLE) AS y FROM supplier, range(16) t(n)",
    "grid_edges": f"SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS graph_id, k AS edge, {_UV} AS u, {_UV} + CASE WHEN k < 12 THEN 1 ELSE 4 END AS v, k < 12 AS h FROM supplier, range(24) t(k)",
    "thin_edges": "SELECT * FROM grid_edges WHERE (edge * 7 + s_suppkey * 13) % 100 >= 15",
    "bowed": "SELECT *, CASE WHEN edge % 3 = 0 THEN 2 * sqrt(50.0 * 50.0 + 40.0 * 40.0) ELSE 100.0 END::DOUBLE AS length FROM grid_edges",
    "points": "SELECT graph_id, node, x + (CAST(graph_id AS BIGINT) * node * 31) % 61 - 30 AS x, y + (CAST(graph_id AS BIGINT) * 7 + node * node * 17) % 53 - 26 AS y FROM grid_nodes",
    "stub_nodes": "SELECT * FROM grid_nodes UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 16 + i, CAST(-(i + 1) * (s_suppkey % 4 * 5 + 8) AS DOUBLE), 0.0::DOUBLE FROM supplier, range(2) t(i)",
    "stub_edges": "SELECT graph_id, edge, u, v, 100.0::DOUBLE AS length FROM thin_edges UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 24 + i, CASE i WHEN 0 THEN 0 ELSE 16 END, 16 + i, CAST(s_suppkey % 4 * 5 + 8 AS DOUBLE) FROM supplier, range(2) t(i)",
    "mask": "SELECT CAST(s_suppkey AS VARCHAR) AS chip, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM supplier, range(31) a(r), range(31) b(c) WHERE (r % 10 = 0 OR c % 10 = 0) AND (r * 7 + c * 13 + s_suppkey) % 11 <> 0",
    "mask2": "SELECT CAST(s_suppkey AS VARCHAR) AS chip, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col FROM supplier, range(31) a(r), range(31) b(c) WHERE (r % 10 = 0 OR c % 10 = 0) AND (r * 7 + c * 13 + s_suppkey) % 7 <> 0",
}
NEEDS = {
    "world_ways": ["ways"], "thin_edges": ["grid_edges"], "bowed": ["grid_edges"], "points": ["grid_nodes"], "stub_nodes": ["grid_nodes"], "stub_edges": ["thin_edges"],
}


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """SQL with the named views, and those they need, as leading common table expressions."""
    order: list[str] = []

    def put(n: str) -> None:
        for m in NEEDS.get(n, []):
            put(m)
        if n not in order:
            order.append(n)

    for n in names:
        put(n)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if sql.lstrip().startswith('--with') else ' '}{sql.replace('--with', '', 1)}"
