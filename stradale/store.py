"""Tables on the way: written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where a session on one machine has none (tests) is a checkpoint folder of our own set; on a
    cluster a folder that is not shared would lose rows, so there the setting must be made.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "stradale-shared"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Lists of the folders that are written within `scratch` blocks, the innermost one last.
_SCRATCH: list[list[str]] = []


def stored(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """df for a join on its keys that sends neither side to the driver.

    Spark's size checks go by a file's bytes, of which rows in memory can take a hundred times as many.
    """
    return df.hint("merge")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that `stored` writes within this block at its end; what leaves it must be stored after it."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for p in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """make() as a stored table, the folders written on the way deleted."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
