"""Grouped statistics over long metric tables (chip, arm, metric, value) and confusions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import ratio
from .ranks import ranked


def summarize(scores: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, median, min, max per group; nulls are skipped, all-null groups give null."""
    v = F.col(value)
    return scores.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


def wide(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row a group with mean and `_median` of every metric."""
    return scores.groupBy(*by).pivot("metric", metrics).agg(F.avg("value").alias("mean"), F.median("value").alias("median"))


def paired_deltas(scores: DataFrame, reference: str) -> DataFrame:
    """chip, metric, arm, delta against the reference arm; pairs with a null side are left out."""
    ok = scores.where(F.col("value").isNotNull())
    ref = ok.where(F.col("arm") == reference).select("chip", "metric", F.col("value").alias("_ref"))
    return ok.where(F.col("arm") != reference).join(ref, ["chip", "metric"]).select("chip", "metric", "arm", (F.col("value") - F.col("_ref")).alias("delta"))


def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on its distribution (continued-fraction beta)."""

    def beta(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-30)
        f = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-30)
                c = (1 + num / c) or 1e-30
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * f / a

    cdf = lambda t: 1 - beta(df / 2, 0.5, df / (df + t * t)) / 2
    lo, hi = 0.0, 1e3 if df > 1 else 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def paired_stat(deltas: DataFrame, by: list[str], confidence: bool = True) -> DataFrame:
    """n, mean, sem, t, confidence interval, better/worse/tied; t and interval null if n <= 1 or sem = 0."""
    d = F.col("delta")
    out = deltas.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), (F.stddev_samp(d) / F.sqrt(F.count(d).cast("double"))).alias("sem"),
        F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("tied"),
    )
    ok = (F.col("n") > 1) & (F.col("sem") > 0)
    out = out.withColumn("t", F.when(ok, F.col("mean") / F.col("sem")))
    if not confidence:
        return out
    q = _t_factor(F.col("n"))
    return out.withColumn("low", F.when(ok, F.col("mean") - q * F.col("sem"))).withColumn("high", F.when(ok, F.col("mean") + q * F.col("sem")))


def _t_factor(n: Column) -> Column:
    """The 97.5 % quantile of Student's t for groups of n; one value a distinct n and Arrow batch."""

    @F.pandas_udf("double")
    def factor(sizes: pd.Series) -> pd.Series:
        return sizes.map({k: t_quantile(0.975, int(k) - 1) if k > 1 else None for k in sizes.unique()}).astype(float)

    return factor(n)


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient of values per group; 0 if empty or the sum is not positive."""
    w = Window.partitionBy(*by).orderBy(value)
    n, s = F.count(F.lit(1)), F.sum(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w))
    g = F.when(s > 0, 2 * F.sum(F.col("_i") * F.col(value)) / F.when(s > 0, n * s) - (n + 1) / n).otherwise(0.0)
    return ranked.groupBy(*by).agg(g.alias("gini"))


def gain_distribution(deltas: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """Counts and sums of gains and losses, and the k largest gains' share of the total and of all gains."""
    d = F.col("delta")
    gain = F.greatest(d, F.lit(0.0))
    w = Window.partitionBy(*by).orderBy(gain.desc())
    r = deltas.withColumn("_gain", gain).withColumn("_rank", F.row_number().over(w))
    out = r.groupBy(*by).agg(
        F.count_if(d > 0).alias("n_gain"), F.count_if(d < 0).alias("n_loss"), F.count_if(d == 0).alias("n_same"),
        F.sum("_gain").alias("gain"), F.sum(F.least(d, F.lit(0.0))).alias("loss"), F.sum(d).alias("total"), F.sum(F.when(F.col("_rank") <= k, F.col("_gain"))).alias("top"),
    )
    return out.withColumn("top_of_total", F.when(F.col("total") > 0, ratio(F.col("top"), F.when(F.col("total") > 0, F.col("total"))))).withColumn("top_of_gain", ratio(F.col("top"), F.col("gain")))


def with_total(df: DataFrame, by: list[str], split: str, *aggs: Column) -> DataFrame:
    """Aggregates by (by, split) and by (by) with split = 'all', in one pass of grouping sets."""
    out = df.groupingSets([[*by, split], by], *by, split).agg(*aggs, F.grouping(split).alias("_g"))
    return out.withColumn(split, F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col(split))).drop("_g")


def pareto_front(df: DataFrame, key: list[str], objectives: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows that no other row beats: at least as good in all objectives (larger is better) and not equal.

    With two objectives the test is a running maximum (one sort per group); with more, rows that are
    beaten within their Arrow batch leave first, and the rest is compared by an anti-join in the group.
    """
    by = by or []
    if len(objectives) == 2:
        a, b = objectives
        # of rows before this one (larger a), the best b; of rows with equal a, the best b
        order = Window.partitionBy(*by).orderBy(F.col(a).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = Window.partitionBy(*by, a)
        ahead = F.max(b).over(order)
        seen = df.withColumn("_ahead", ahead).withColumn("_same", F.max(b).over(same))
        first = Window.partitionBy(*by, b)
        seen = seen.withColumn("_a_of_b", F.max(a).over(first))
        return seen.where((F.col(b) >= F.col("_ahead")) & (F.col(b) == F.col("_same")) & (F.col(a) == F.col("_a_of_b"))).drop("_ahead", "_same", "_a_of_b")
    front = local_front(df, objectives, by)  # no row that its own task already beats takes part below
    o = front.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(objectives)]).distinct()
    cond = F.lit(True)
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    beats, differs = F.lit(True), F.lit(False)
    for i, c in enumerate(objectives):
        beats = beats & (F.col(f"_o{i}") >= F.col(c))
        differs = differs | (F.col(f"_o{i}") > F.col(c))
    return front.join(o, cond & beats & differs, "left_anti")


def local_front(df: DataFrame, objectives: list[str], by: list[str]) -> DataFrame:
    """Rows that no other row of their batch and group beats; a front keeps all of its rows. Null objectives are never beaten."""

    def run(batches):
        import numpy as np

        for rows in batches:
            keep = np.ones(len(rows), bool)
            groups = rows.groupby(by, dropna=False).indices.values() if by else [np.arange(len(rows))]
            for at in groups:
                x = rows[objectives].iloc[at].to_numpy(float)
                known = ~np.isnan(x).any(1)
                at, x = at[known], x[known]
                order = np.argsort(-x.sum(1), kind="stable")  # a row is beaten only by rows of a larger sum
                best = np.zeros((0, x.shape[1]))
                for i in order:
                    if ((best >= x[i]).all(1) & (best > x[i]).any(1)).any():
                        keep[at[i]] = False
                    else:
                        best = np.vstack([best, x[i]])
            yield rows[keep]

    return df.mapInPandas(run, df.schema)


def axis_profile(df: DataFrame, axis: str, pinned: dict[str, float], value: str) -> DataFrame:
    """A one-dimensional slice of a grid, in axis order."""
    for c, v in pinned.items():
        df = df.where(F.col(c) == v)
    return df.select(axis, value).orderBy(axis)


def monotone_violations(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Adjacent steps where the value falls although the order rises."""
    w = Window.partitionBy(*by).orderBy(order)
    x = df.withColumn("_prev", F.lag(value).over(w)).withColumn("_from", F.lag(order).over(w))
    return x.where(F.col("_prev") > F.col(value)).select(*by, F.col("_from").alias("lo"), F.col(order).alias("hi"), F.col("_prev").alias("before"), F.col(value).alias("after"))


def best_of(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Per group the key with the largest value; ties go to the smallest key."""
    top = F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))
    return df.groupBy(*by).agg(top.alias("_t")).select(*by, F.col("_t.k").alias(key), (-F.col("_t.v")).alias(value))


def early_stop(history: DataFrame, by: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """Running best, epochs since it, and whether training would have stopped by then."""
    w = Window.partitionBy(*by).orderBy(epoch)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = history.withColumn("best", F.max(value).over(run))
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_new", F.coalesce(F.col(value) > before, F.lit(True)))
    x = x.withColumn("_at", F.max(F.when(F.col("_new"), F.col(epoch))).over(run)).withColumn("stale", F.col(epoch) - F.col("_at"))
    return x.withColumn("stopped", F.max((F.col("stale") >= patience).cast("int")).over(run) == 1).drop("_new", "_at")


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(conf: DataFrame, by: list[str]) -> DataFrame:
    """Per class: support, predicted, hits, F1 = 2 tp / (support + predicted), null without support."""
    parts = conf.select(*by, F.col("truth").alias("klass"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")).unionByName(
        conf.select(*by, F.col("pred").alias("klass"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("tp"))
    )
    g = parts.groupBy(*by, "klass").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("hits"))
    return g.withColumn("f1", F.when(F.col("support") > 0, ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))))


def macro_f1(conf: DataFrame, by: list[str]) -> DataFrame:
    """Mean F1 over classes with support, and accuracy."""
    c = class_scores(conf, by)
    return c.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), ratio(F.sum("hits"), F.sum("support")).alias("accuracy"))


def bootstrap_sem(conf: DataFrame, weights: DataFrame, unit: str = "chip") -> DataFrame:
    """Bootstrap error of macro-F1. conf: (unit, truth, pred, n); weights: (boot, unit, w), common to all arms."""
    w = conf.join(weights, unit).groupBy("boot", "truth", "pred").agg(F.sum(F.col("n") * F.col("w")).alias("n")).where("n > 0")
    return macro_f1(w, ["boot"]).agg(F.avg("macro_f1").alias("mean"), F.stddev_samp("macro_f1").alias("sem"))


def simulate(nodes: DataFrame, unit: str, classes: list[str], accuracy: float, seed: int, draws: int = 1) -> DataFrame:
    """Predictions that are right for whole units with the given probability, else another class by its share.

    Random numbers are hashes of (seed, salt, draw, unit), so results do not depend on partitioning.
    """
    u = lambda salt: scalars.uniform(F.lit(seed), F.lit(salt), F.col("draw"), F.col(unit))
    n = nodes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_ok", u(1) < accuracy)
    share = nodes.groupBy(F.col("klass").alias("other")).agg(F.count(F.lit(1)).alias("k"))
    order = F.array(*[F.lit(c) for c in classes])
    # another class in proportion to its share: cumulative shares without the true class
    table = share.agg(F.map_from_entries(F.collect_list(F.struct("other", F.col("k").cast("double")))).alias("shares"))
    n = n.join(F.broadcast(table))
    rest = F.filter(order, lambda c: c != F.col("klass"))
    of = lambda c: F.coalesce(F.element_at("shares", c), F.lit(0.0))
    total = F.aggregate(rest, F.lit(0.0), lambda a, c: a + of(c))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("pick"))
    pick = F.aggregate(
        rest, start,
        lambda acc, c: F.struct((acc["sum"] + of(c)).alias("sum"), F.when(acc["pick"].isNull() & (u(2) * total < acc["sum"] + of(c)), c).otherwise(acc["pick"]).alias("pick")),
        lambda acc: acc["pick"],
    )
    return n.withColumn("pred", F.when(F.col("_ok"), F.col("klass")).otherwise(F.coalesce(pick, F.col("klass")))).withColumn("truth", F.col("klass")).drop("_ok", "shares")


def class_sizes(nodes: DataFrame) -> DataFrame:
    """Nodes, ways, components per class."""
    return nodes.groupBy("klass").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("way").alias("ways"), F.countDistinct("chip").alias("chips"))


def cluster_sizes(nodes: DataFrame, unit: str) -> DataFrame:
    """Mean, median, p90 and largest size of units."""
    s = nodes.groupBy(unit).agg(F.count(F.lit(1)).alias("k"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean"), F.median("k").alias("median"), F.percentile("k", 0.9).alias("p90"), F.max("k").alias("largest"))


def majority_baseline(nodes: DataFrame) -> DataFrame:
    """The most frequent class (first by name on ties), its share, and the macro-F1 of always saying it."""
    c = nodes.groupBy("klass").agg(F.count(F.lit(1)).alias("k"))
    top = c.agg(F.min(F.struct((-F.col("k")).alias("k"), "klass")).alias("t"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("classes"))
    hits = -F.col("t.k")
    return top.select(F.col("t.klass").alias("klass"), ratio(hits, F.col("n")).alias("share"), (ratio(2 * hits, hits + F.col("n")) / F.col("classes")).alias("macro_f1"))


def class_weights(nodes: DataFrame, classes: list[str]) -> DataFrame:
    """Inverse-frequency weights n / (count * classes), 0 for empty classes."""
    spark = nodes.sparkSession
    every = spark.createDataFrame([(c,) for c in classes], "klass string")
    c = nodes.groupBy("klass").agg(F.count(F.lit(1)).alias("k"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return every.join(c, "klass", "left").join(F.broadcast(n)).select("klass", F.coalesce(ratio(F.col("n"), F.col("k") * len(classes)), F.lit(0.0)).alias("weight"))


def standardize(df: DataFrame, features: str, train: Column, size: int | None = None) -> DataFrame:
    """Feature arrays standardized by the training rows only; deviations up to 1e-6 count as 1.

    size: features a row has, by default the most that any row has.
    """
    if size is None:
        size = df.agg(F.max(F.size(features))).first()[0] or 0
    at = lambda i: F.get(features, F.lit(i)).cast("double")
    m = df.agg(
        F.array(*[F.avg(F.when(train, at(i))) for i in range(size)]).alias("_mean"),
        F.array(*[F.stddev_pop(F.when(train, at(i))) for i in range(size)]).alias("_dev"),
    )
    z = F.zip_with(F.zip_with(F.col(features), "_mean", lambda x, mu: x.cast("double") - mu), "_dev", lambda x, d: x / F.when(d > 1e-6, d).otherwise(1.0))
    return df.join(F.broadcast(m)).withColumn(features, z).drop("_mean", "_dev")


def pooled_and_mean(df: DataFrame, by: list[str], hits: str, total: str) -> DataFrame:
    """A ratio of sums and the mean of the ratios, side by side."""
    return df.groupBy(*by).agg(ratio(F.sum(hits), F.sum(total)).alias("pooled"), F.avg(ratio(F.col(hits), F.col(total))).alias("mean_ratio"), F.sum(hits).alias("hits"), F.sum(total).alias("total"))


def of_reference(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each value as a fraction of its group's last row in order."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return df.withColumn("of_reference", ratio(F.col(value), F.first(value).over(w)))


def headroom(df: DataFrame, by: list[str], arena: str, model: str, ceiling: str, value: str) -> DataFrame:
    """Ceiling minus model per group."""
    p = df.groupBy(*by).pivot(arena, [model, ceiling]).agg(F.avg(value))
    return p.withColumn("headroom", F.col(ceiling) - F.col(model))


def tag_lengths(truth: DataFrame, other: DataFrame, tag: str = "highway", length: str = "length") -> DataFrame:
    """Length by tag in two networks: both sums, surplus, shares; longest surplus first."""
    a = truth.groupBy(tag).agg(F.sum(length).alias("truth"))
    b = other.groupBy(tag).agg(F.sum(length).alias("other"))
    j = a.join(b, tag, "full_outer").fillna(0.0, ["truth", "other"])
    total = j.agg(F.sum("truth").alias("_t"), F.sum("other").alias("_o"))
    return j.join(F.broadcast(total)).select(tag, "truth", "other", (F.col("other") - F.col("truth")).alias("surplus"), ratio(F.col("truth"), F.col("_t")).alias("truth_share"), ratio(F.col("other"), F.col("_o")).alias("other_share"))


def spread_picks(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at ranks round(i (n - 1) / (k - 1)): a gallery spread evenly over the order."""
    n = df.count()
    picks = sorted({round(i * (n - 1) / max(k - 1, 1)) for i in range(k)}) if n else []
    return ranked(df, order).where(F.col("rank").isin(picks))


def banded(df: DataFrame, value: str, bands: list[tuple[float, float]], k: int, order: str) -> DataFrame:
    """At most k rows of each score band (lo, hi], in order."""
    band = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(bands))):
        band = F.when((F.col(value) > lo) & (F.col(value) <= hi), i).otherwise(band)
    w = Window.partitionBy("band").orderBy(order)
    return df.withColumn("band", band).where("band is not null").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def gate(df: DataFrame, value: str, least: float, key: str) -> DataFrame:
    """Rows below a limit: how many, which, and whether the gate holds (2 * below <= n, n > 0)."""
    below = F.col(value) < least
    return df.agg(F.count(value).alias("n"), F.count_if(below).alias("below"), F.sort_array(F.collect_list(F.when(below, F.col(key)))).alias("failing")).withColumn("passes", (F.col("n") > 0) & (2 * F.col("below") <= F.col("n")))


def grid(spark, **axes: list) -> DataFrame:
    """The factorial grid of parameter axes."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return out


