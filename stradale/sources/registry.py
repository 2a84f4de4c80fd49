"""Named builders of tables. An unknown name raises KeyError with the known ones."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked

TILES: dict[str, Callable[..., DataFrame]] = {}
WAYS: dict[str, Callable[..., DataFrame]] = {}


class TileSource(Protocol):
    """What holds tiles: their ids in a fixed order, and the pixels of some of them."""

    def ids(self) -> DataFrame:
        """(sample_id, pos)."""

    def load(self, ids: DataFrame) -> DataFrame:
        """Pixels (chip, row, col and bands) of the given ids; ids that the source does not have raise."""


class TableSource:
    """A tile source over a pixel table (chip, row, col, ...)."""

    def __init__(self, pixels: DataFrame):
        self.pixels = pixels

    def ids(self) -> DataFrame:
        return ranked(self.pixels.select(F.col("chip").alias("sample_id")).distinct(), "sample_id", name="pos")

    def load(self, ids: DataFrame) -> DataFrame:
        want = ids.select(F.col("sample_id").alias("chip")).distinct()
        gone = want.join(self.pixels.select("chip"), "chip", "left_anti").limit(3).collect()
        if gone:
            raise KeyError(f"no such tiles: {[r[0] for r in gone]}")
        return self.pixels.join(want, "chip", "left_semi")


def register(registry: dict, key: str):
    """Decorator that files a builder under a name."""

    def put(f):
        registry[key] = f
        return f

    return put


def load(registry: dict, key: str, *args, **kwargs) -> DataFrame:
    if key not in registry:
        raise KeyError(f"unknown source {key!r}; known: {sorted(registry)}")
    return registry[key](*args, **kwargs)
