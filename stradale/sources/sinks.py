"""Sinks: artifacts with their parameters, flat summaries, exported lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom


def write_artifact(path: str, params: dict, **tables: DataFrame) -> None:
    """Parameters as one JSON row, and each table, below a folder."""
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").json(f"{path}/params")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def flatten(summary: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """A long summary (metric, mean, median) as one row: metric, metric_median."""
    p = summary.groupBy(*by).pivot("metric", metrics).agg(F.first("mean").alias("mean"), F.first("median").alias("median"))
    return p.select(*by, *[c for m in metrics for c in (F.col(f"{m}_mean").alias(m), F.col(f"{m}_median"))])


def export_lines(edges: DataFrame, places: int = 1) -> DataFrame:
    """Edges with rounded points, for display."""
    return edges.select("graph_id", "edge", geom.rounded(F.col("pts"), places).alias("pts"))


def script_safe(text: str) -> str:
    """JSON for an inline script: `</` cannot end the element."""
    return text.replace("</", "<\\/")
