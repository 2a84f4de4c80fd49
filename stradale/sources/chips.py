"""Imagery chips: pairing images with labels, GeoJSON labels as lines, pixel scaling, samples."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from ..schema import PTS
from .registry import TILES, register

ID = r"(img\d+)\.[A-Za-z]+$"


def keyed(files: DataFrame, name: str) -> DataFrame:
    """(chip, path) of files whose name ends in an image number."""
    return files.select(F.regexp_extract("path", ID, 1).alias("chip"), F.col("path").alias(name)).where("chip <> ''")


def find_chips(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (path) with labels (path) by their trailing image number, ordered by that number.

    Images without labels are left out.
    """
    both = keyed(images, "image").join(keyed(labels, "label"), "chip")
    return both.withColumn("number", F.regexp_extract("chip", r"(\d+)$", 1).cast("long")).orderBy("number")


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths under a folder by Spark's own file listing; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of GeoJSON files: graph_id (image number), line, pts; Multi* exploded, null and short ones left out."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), ID, 1).alias("graph_id"), "value")
    shape = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    f = text.select("graph_id", F.explode(F.from_json("value", shape)["features"]).alias("f")).select("graph_id", "f.geometry.type", "f.geometry.coordinates")
    one = F.from_json("coordinates", "array<array<double>>")
    many = F.from_json("coordinates", "array<array<array<double>>>")
    lines = F.when(F.col("type") == "LineString", F.array(one)).when(F.col("type") == "MultiLineString", many)
    out = f.where("coordinates is not null").select("graph_id", F.explode(lines).alias("c")).where(F.size("c") >= 2)
    pts = F.transform("c", lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).cast(PTS)
    from pyspark.sql import Window

    w = Window.partitionBy("graph_id").orderBy(F.to_json("c"))
    return out.select("graph_id", (F.row_number().over(w) - 1).cast("long").alias("line"), pts.alias("pts"))


def scale_pixels(pixels: DataFrame, q: float = 0.995) -> DataFrame:
    """Pixel values (chip, row, col, value) by their chip's quantile, held to [0, 1]; a zero quantile counts as 1."""
    top = pixels.groupBy("chip").agg(F.percentile("value", q).alias("_q"))
    s = F.when(F.col("_q") == 0, 1.0).otherwise(F.col("_q"))
    return pixels.join(top, "chip").withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / s))).drop("_q")


def holdout(val: DataFrame, exclude: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """Ordered ids [skip : skip + limit] without the excluded ones. val: (sample_id, pos)."""
    x = val.where(F.col("pos") >= skip)
    if limit is not None:
        x = x.where(F.col("pos") < skip + limit)
    return x.join(exclude.select("sample_id"), "sample_id", "left_anti").orderBy("pos")


def aoi_roots(spark: SparkSession, path: str, labels: str = "*.geojson") -> list[str]:
    """Folders right below `path` that hold label files at any depth, in order; only the listing is read."""
    found = list_files(spark, path, labels).select(F.regexp_extract("path", re.escape(path.rstrip("/").split(":")[-1]) + r"/([^/]+)/", 1).alias("root"))
    return sorted(r[0] for r in found.where("root <> ''").distinct().collect())  # a handful of areas


@register(TILES, "synthetic")
def synthetic(spark: SparkSession, centers: list[tuple[float, float]], size: int = 64, seed: int = 0, streets: int = 3, cover: float = 0.12) -> DataFrame:
    """Fabricated tiles (chip, row, col, mask, red, green, blue, ndsm, intensity) of a street grid.

    Streams are seeded by (seed, x, y), so each tile stands alone, whatever the others; one canopy hides roads
    in the image and stands up in the heights.
    """
    t = spark.createDataFrame([(f"{x:g}_{y:g}", float(x), float(y)) for x, y in centers], "chip string, x double, y double")

    def run(batches):
        import numpy as np
        import pandas as pd

        from stradale.functions import fields, kernels

        for rows in batches:
            for r in rows.itertuples():
                trees, light, ground = np.random.default_rng((seed, int(r.x) & 0xFFFFFFFF, int(r.y) & 0xFFFFFFFF)).spawn(3)
                at = [size * (k + 0.5) / streets for k in range(streets)]
                lines = [np.array(p, float) for a in at for p in (((a, 0), (a, size - 1)), ((0, a), (size - 1, a)))]
                mask = kernels.draw(lines, size, size, 2)
                green = fields.canopy(mask.shape, trees, cover)
                rgb = fields.image(mask, light, occlusion=green)
                z, back = fields.heights(mask, ground, green)
                i, j = np.indices(mask.shape)
                yield pd.DataFrame({
                    "chip": r.chip, "row": i.ravel(), "col": j.ravel(), "mask": mask.ravel(), "red": rgb[..., 0].ravel(), "green": rgb[..., 1].ravel(), "blue": rgb[..., 2].ravel(),
                    "ndsm": z.ravel(), "intensity": back.ravel(),
                })

    return t.mapInPandas(run, "chip string, row int, col int, mask boolean, red double, green double, blue double, ndsm double, intensity double")


def crop_windows(mask: DataFrame, grids: DataFrame, size: int, n: int, least: float, seed: int, attempts: int = 20) -> DataFrame:
    """n windows a chip whose road share is at least `least`, else the best of the attempts.

    Draws are hashes of (seed, chip, crop, attempt); shares are counted by a join on windows.
    """
    u = lambda salt: uniform(F.lit(seed), F.lit(salt), F.col("chip"), F.col("crop"), F.col("attempt"))
    w = grids.select("chip", "height", "width").withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    w = w.withColumn("row0", F.floor(u(1) * (F.col("height") - size + 1)).cast("int")).withColumn("col0", F.floor(u(2) * (F.col("width") - size + 1)).cast("int"))
    hit = mask.join(w, "chip").where((F.col("row") >= F.col("row0")) & (F.col("row") < F.col("row0") + size) & (F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col0") + size))
    share = hit.groupBy("chip", "crop", "attempt").agg((F.count(F.lit(1)) / float(size * size)).alias("share"))
    s = w.join(share, ["chip", "crop", "attempt"], "left").fillna(0.0, ["share"])
    ok = F.col("share") >= least
    # the first attempt that passes; if none does, the one with the largest share
    pick = F.min(F.struct(F.when(ok, 0).otherwise(1).alias("o"), F.when(ok, F.col("attempt").cast("double")).otherwise(-F.col("share")).alias("r"), "row0", "col0", "share"))
    return s.groupBy("chip", "crop").agg(pick.alias("p")).select("chip", "crop", "p.row0", "p.col0", F.lit(size).alias("size"), "p.share")
