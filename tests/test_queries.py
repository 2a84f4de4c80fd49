"""Every query of the engine's own operators against its SQL twin."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from stradale.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns), key=lambda s: s.astype(str)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE:
        assert len(got.columns)
        return
    want = duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-8, atol=1e-8, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


def test_random_split_is_the_seeded_shuffle(spark, sf):
    got = QUERIES["random_split"](spark, sf).toPandas()
    n = len(got)
    order = np.arange(n)
    np.random.default_rng(0).shuffle(order)
    held = max(round(0.2 * n), 1)
    side = lambda s: got[got.side == s].sort_values("ord").sample_id.astype(int).tolist()
    assert side("val") == order[:held].tolist() and side("train") == order[held:].tolist()


def test_paired_interval_against_numpy(spark, sf):
    e = pd.read_parquet(f"{sf}/events.parquet").groupby(["user_id", "event_type"]).value.mean().unstack()
    got = QUERIES["paired_interval"](spark, sf).toPandas().set_index("arm")
    table = {10: 2.262157, 20: 2.093024, 30: 2.045230, 60: 2.000995, 100: 1.984217, 150: 1.976013}  # two-sided 5 % points, by n
    for arm in got.index:
        d = (e[arm] - e["click"]).dropna()
        sem = d.std(ddof=1) / np.sqrt(len(d))
        half = got.high[arm] - got["mean"][arm]
        assert got["mean"][arm] == pytest.approx(d.mean(), abs=1e-5) and got.n[arm] == len(d)
        assert got["mean"][arm] - got.low[arm] == pytest.approx(half, abs=1e-5)
        lower, upper = max([v for k, v in table.items() if k >= len(d)], default=1.96), min([v for k, v in table.items() if k <= len(d)], default=13)
        assert lower - 1e-4 <= half / sem <= upper + 1e-4 or half / sem == pytest.approx(table.get(len(d), 0), abs=1e-4)


def test_traced_graph_against_the_kernels(spark, sf):
    from stradale.functions import kernels
    from stradale.operators.graph import points
    from stradale.plans import views

    got = QUERIES["traced_graph"](spark, sf).toPandas().set_index("graph_id")
    edges = views.grid_edges(spark, sf, drop=15).toPandas()
    for g, rows in edges.groupby("graph_id"):
        t = kernels.trace(kernels.draw([points(p) for p in rows.pts], 320, 320, 2))
        assert got.length[g] == pytest.approx(sum(kernels.length(p) for _, _, p in t.edges), abs=1e-3) and got.n_edges[g] == len(t.edges)


def test_marginal_edges_one_by_one(spark, sf):
    from pyspark.sql import functions as F

    from stradale.operators import candidates, metrics
    from stradale.plans.queries import proposal, truth

    got = QUERIES["marginal_edges"](spark, sf).toPandas()
    t, p = truth(spark, sf), proposal(spark, sf)
    rows = candidates.endpoint_candidates(*p, 110.0).where("kind = 'endpoint'")
    one = got.iloc[0]
    mine = lambda net: tuple(df.where(F.col("graph_id") == one.graph_id) for df in net)
    n, e, _ = candidates.add_connectors(*mine(p), rows.where((F.col("graph_id") == one.graph_id) & (F.col("cand") == int(one.cand))))
    score = lambda net: metrics.apls(mine(t), net).first()["apls"]
    assert one.delta == pytest.approx(score((n, e)) - score(mine(p)), abs=1e-6)


def test_damage_by_gaps(spark, sf):
    x = QUERIES["gap_divergence"](spark, sf).toPandas().set_index("gaps")
    assert x.iou[0] == 1 and x.iou[0] > x.iou[4] > x.iou[12] and x.apls[0] > x.apls[4] > x.apls[12]
    e = QUERIES["tile_evaluation"](spark, sf).toPandas()
    assert len(e) and (e.of_ceiling - e.apls_cleaned / e.ceiling).abs().max() < 1e-5 and e.mask_iou.between(0.5, 1).all()


def test_queries_take_whole_tables(spark, sf):
    """Nodes of ways are all lines of all orders; standardized features are all of a vector's."""
    lines = pd.read_parquet(f"{sf}/lineitem.parquet")
    assert QUERIES["class_sizes"](spark, sf).toPandas().nodes.sum() == len(lines)
    assert QUERIES["resolvability"](spark, sf).first()["n_nodes"] == len(lines)
    vectors = pd.read_parquet(f"{sf}/embeddings.parquet").embedding
    assert QUERIES["feature_standardize"](spark, sf).count() == sum(map(len, vectors))
    assert QUERIES["best_epoch"](spark, sf).count() == len(lines[["l_suppkey", "l_orderkey"]].drop_duplicates())
