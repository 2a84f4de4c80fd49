"""Record shapes of graphs, rasters and samples."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
PTS = f"array<{POINT}>"
NODES = "graph_id string, node long, x double, y double"
EDGES = f"graph_id string, edge long, u long, v long, pts {PTS}, length double"
LINES = f"graph_id string, line long, pts {PTS}"
TILE = "struct<epsg:int,x_min:double,y_max:double,height:int,width:int,resolution:double>"
PIXELS = "chip string, row int, col int"
PLACEMENT = "sample_id string, pos int, x double, y double"
ASSIGNMENT = "sample_id string, side string, ord int"
METRICS = "chip string, arm string, metric string, value double"
CANDIDATES = "graph_id string, cand long, kind string, node_a long, ax double, ay double, bx double, by double, gap double, node_b long, edge long, arc double"
