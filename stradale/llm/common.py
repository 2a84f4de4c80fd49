"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship as send
from ..store import kept, scratch, shared_dir, stored  # noqa: F401

#: Words of the contracts: everything but space, tab, newline, VT, FF and CR.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Bytes of an Arrow batch, where a session has Spark's default.
BATCH_BYTES, DEFAULT_BATCH = 16 << 20, "67108864b"
#: Rows of a Parquet batch in the JVM, and the setting that holds it.
SCAN_ROWS, SCAN_SETTING = 64, "spark.sql.parquet.columnarReaderBatchSize"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; Spark alone opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors; batches of texts are bounded by bytes, not rows alone."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == DEFAULT_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")
    send(spark)


@contextmanager
def short_scans(spark: SparkSession) -> Iterator[None]:
    """Jobs of this block read Parquet in batches of few rows, since the JVM holds a batch's whole texts at once."""
    before = spark.conf.get(SCAN_SETTING)
    spark.conf.set(SCAN_SETTING, str(min(int(before), SCAN_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(SCAN_SETTING, before)


def slices(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column holds about `limit` bytes, one row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(batch.column(column).nbytes, 1)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def map_texts(
    df: DataFrame, keys: list[str], text: str, make: Callable[[], Callable[[list], list[tuple]]], schema: str
) -> DataFrame:
    """Arrow map over (keys, text): `make()` runs once a task and gives texts -> rows of the added columns.

    Rows keep their keys; the output has the keys and then the columns of `schema`. Null texts
    arrive as None.
    """
    spark = df.sparkSession
    ship(spark)
    src = df.select(*keys, text)
    added = spark.createDataFrame([], schema).schema
    full = spark.createDataFrame([], src.select(*keys).schema).schema
    out = type(full)(list(full.fields) + list(added.fields))
    arrow = None

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        nonlocal arrow
        arrow = arrow or to_arrow_schema(out)
        work, k = make(), len(keys)
        for whole in batches:
            for b in slices(whole, k):
                rows = work(b.column(k).to_pylist())
                cols = [b.column(i) for i in range(k)]
                made = list(zip(*rows)) if rows else [()] * len(added.fields)
                cols += [pa.array(list(v), type=arrow.field(k + i).type) for i, v in enumerate(made)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(arrow.field(i).type) for i, c in enumerate(cols)], names=arrow.names
                )
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return src.mapInArrow(run, out)


def rewrite_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """Arrow pass over whole rows: `make()` gives texts -> new texts, or booleans (rows to keep).

    All columns pass through as they are, so nothing is shuffled or joined back.
    """
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        work = make()
        for whole in batches:
            for b in slices(whole, at):
                got = work(b.column(at).to_pylist())
                if got and isinstance(got[0], bool):
                    yield b.filter(pa.array(got, pa.bool_()))
                else:
                    yield b.set_column(at, b.schema.field(at), pa.array(got, b.schema.field(at).type))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)
