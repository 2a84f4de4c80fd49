"""Shared plumbing: the shared folder, bounded batches, whole rows."""

import pyarrow as pa

from stradale.llm import common


class Bare:
    """A session without spark.checkpoint.dir, or with a given one."""

    def __init__(self, spark, folder=None):
        self.sparkContext, self.folder = self, folder
        self.conf, self.own, self.spark = self, None, spark

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.folder

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.own

    def setCheckpointDir(self, path):
        self.own = path


def test_the_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(Bare(spark, "file:///far/away/")) == "file:///far/away"
    own = Bare(spark)
    own.master = "local[2]"
    first = common.shared_dir(own)
    assert first.startswith("file://") and common.shared_dir(own) == first


def test_a_cluster_needs_a_shared_folder(spark):
    import pytest

    far = Bare(spark)
    far.master = "spark://far:7077"
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(far)


def test_tables_on_the_way_are_deleted(spark):
    seen = []

    def make():
        seen.append(common.stored(spark, spark.range(5), "way"))
        return common.kept(spark, lambda: seen[0].where("id > 1"), "inner")

    got = common.kept(spark, make, "end")
    assert got.count() == 3
    left = spark._jvm.org.apache.hadoop.fs.Path(seen[0].inputFiles()[0])
    assert not left.getFileSystem(spark._jsc.hadoopConfiguration()).exists(left)


def test_stored_tables_go_there(spark):
    got = common.stored(spark, spark.range(5), "numbers")
    assert got.count() == 5 and common.shared_dir(spark).removeprefix("file:").lstrip("/") in got.inputFiles()[0]
    assert common.stored(spark, spark.range(0), "none").count() == 0


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"k": list(range(50)), "t": ["x" * (i * 100) for i in range(50)]})
    parts = list(common.slices(b, 1, limit=3000))
    assert len(parts) > 5 and [k for p in parts for k in p.column(0).to_pylist()] == list(range(50))
    assert list(common.slices(b.slice(0, 0), 1)) == []


def test_rewriting_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a", None, [1.5]), (2, None, "z", None)], "doc_id long, text string, _keep string, v array<double>")
    out = common.rewrite_texts(df, "text", lambda: lambda ts: [t and t * 2 for t in ts])
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "aa", None, [1.5]), (2, None, "z", None)]
    kept = common.rewrite_texts(df, "text", lambda: lambda ts: [t is not None for t in ts])
    assert [r["doc_id"] for r in kept.collect()] == [1]
