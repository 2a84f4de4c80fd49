"""Quality rules with host verdicts, in DataFrame functions only.

A document fails a rule by its own counts. Failures of a softer limit are aggregated by host (the
`source` column), and each host's failure rate of each rule is shrunk towards the mean rate of the
other hosts by a beta prior fitted to all hosts by moments. Every host counts once in the mean, so no
host's share of rows decides a verdict. A host's verdict is how strictly each rule is applied to its
documents: at the plain limit where its shrunk rate is no higher than that of the others, at the
softer one where it is HOST_FACTOR times as high or more, and at a limit between them in proportion
for rates between. Host verdicts go back to the documents by a join.

Rules: too few words, repeated 3-word windows, symbols, duplicate lines. Each has a plain and a
softer limit (RULES; MIN_WORDS and SOFT_MIN_WORDS for the words, of which a document fails below).

Defined cases: a null or empty text has no words and fails; a null host is a host of its own;
repeated rows are counted as often as they come. The counts of repeated windows go by 64-bit
hashes that are confirmed against the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import short_scans, stored

SPACE = "[\\x20\\x09-\\x0D]"
#: rule -> (value, plain limit, softer limit); a document fails above the limit.
RULES = {
    "repeats": ("r_repeat", 0.50, 0.35),
    "symbols": ("r_symbol", 0.50, 0.25),
    "dup_lines": ("r_dup", 0.60, 0.40),
}
MIN_WORDS, SOFT_MIN_WORDS = 50, 60
#: Multiple of the other hosts' rate at which a host's documents meet the softer limits.
HOST_FACTOR = 2.0


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which is found twice or more, the first included.

    Windows are packed as (hash bits | position) in one long and sorted; equal neighbours are
    confirmed by their words. Positions take as many low bits as the text needs.
    """
    size = F.size(words)
    bits = F.ceil(F.log2(size + F.lit(1))).cast("int")

    def covered(w: Column, keys: Column, low: Column) -> Column:
        at = lambda k: k.bitwiseAND(low).cast("int")
        same = lambda a, b: (
            (F.coalesce(a.bitwiseXOR(b), F.lit(-1)).bitwiseAND(F.bitwise_not(low)) == 0)
            & (F.get(w, at(a)) == F.get(w, at(b)))
            & (F.get(w, at(a) + 1) == F.get(w, at(b) + 1))
            & (F.get(w, at(a) + 2) == F.get(w, at(b) + 2))
        )
        found = F.filter(
            keys,
            lambda k, i: ((i > 0) & same(k, F.get(keys, i - 1)))
            | ((i < F.size(keys) - 1) & same(k, F.get(keys, i + 1))),
        )
        hits = F.sort_array(F.transform(found, at))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")
        )
        return F.aggregate(hits, start, step, lambda acc: acc["n"])

    low = F.pow(F.lit(2.0), bits).cast("long") - 1
    keys = lambda b: F.sort_array(
        F.transform(
            F.sequence(F.lit(0), size - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            .bitwiseAND(F.bitwise_not(b))
            .bitwiseOR(i.cast("long")),
        )
    )
    # one-element arrays bind a value to a lambda's name, so that it is made once
    bound = F.transform(
        F.array(low), lambda b: F.get(F.transform(F.array(keys(b)), lambda k: covered(words, k, b)), F.lit(0))
    )
    return F.when(size >= 3, F.get(bound, F.lit(0))).otherwise(F.lit(0).cast("long"))


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per row: key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = df.select(
        F.col(key),
        F.col(host).alias("host"),
        # in runs: translate() makes two objects of every character
        F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
        F.filter(F.split(body, SPACE + "+"), lambda x: x != "").alias("_words"),
    )
    return split.select(
        key,
        "host",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


def host_rates(counts: DataFrame) -> DataFrame:
    """Per host: documents, the shrunk rate of each rule, and how strictly the rule is applied (0 to 1).

    The prior is fitted by moments over hosts: mean m and variance v of the rates give a strength
    s = m(1-m)/v - 1, held between 1 and 10,000; with o the mean rate of the other hosts, the shrunk
    rate is (failures + s o) / (n + s). A host without others is judged by the plain limits.
    """
    rules = [*RULES, "words"]
    fails = counts.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"soft_{r}").cast("long")).alias(f"f_{r}") for r in rules]
    )
    total = fails.agg(
        F.count(F.lit(1)).alias("n_hosts"),
        *[F.avg(F.col(f"f_{r}") / F.col("n")).alias(f"m_{r}") for r in rules],
        *[F.coalesce(F.var_pop(F.col(f"f_{r}") / F.col("n")), F.lit(0.0)).alias(f"v_{r}") for r in rules],
    )
    out = fails.join(F.broadcast(total))  # one row
    for r in rules:
        m = F.col(f"m_{r}")
        s = F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.coalesce(F.try_divide(m * (1 - m), F.col(f"v_{r}")) - 1, F.lit(1e4))))
        own = F.col(f"f_{r}") / F.col("n")
        other = F.when(F.col("n_hosts") > 1, F.greatest(F.lit(0.0), F.try_divide(m * F.col("n_hosts") - own, F.col("n_hosts") - 1))).otherwise(own)
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + s * other) / (F.col("n") + s))
        over = F.try_divide(F.col(f"rate_{r}") - other, other * (HOST_FACTOR - 1))  # null where no other host fails
        over = F.coalesce(over, F.when(F.col(f"rate_{r}") > other, 1.0).otherwise(0.0))
        out = out.withColumn(f"strict_{r}", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), over)), 9))
    return out.select("host", "n", *[f"rate_{r}" for r in rules], *[f"strict_{r}" for r in rules])


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: its counts, base_failed, host_failed (by its host's limits alone) and kept.

    The counts are made once and stored (numbers only, no texts); hosts are aggregated with
    partial sums, so a hot host costs one row a task; the join back to documents carries
    numbers only and its host side is small, so that a skewed host is split or broadcast at run time.
    """
    counts = word_counts(df, key, text, host)
    n = F.col("n_words")
    counts = (
        counts.withColumn("r_repeat", F.coalesce(F.try_divide(F.col("n_repeat_words"), n), F.lit(0.0)))
        .withColumn("r_symbol", F.coalesce(F.try_divide(F.col("n_symbols"), n), F.lit(0.0)))
        .withColumn("r_dup", F.coalesce(F.try_divide(F.col("n_dup_lines"), F.col("n_lines")), F.lit(0.0)))
    )
    for r, (v, _, soft) in RULES.items():
        counts = counts.withColumn(f"soft_{r}", F.col(v) > soft)
    counts = counts.withColumn("soft_words", n < SOFT_MIN_WORDS)
    with short_scans(df.sparkSession):
        counts = stored(df.sparkSession, counts, "rules")
    hosts = host_rates(counts)
    both = counts.join(hosts.withColumnRenamed("host", "_host").drop("n"), F.col("host").eqNullSafe(F.col("_host")), "left")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    plain = F.lit(False)
    by_host = (n >= MIN_WORDS) & (n < F.round(MIN_WORDS + (SOFT_MIN_WORDS - MIN_WORDS) * F.col("strict_words"), 6))
    for r, (v, hard, soft) in RULES.items():
        plain = plain | (F.col(v) > hard)
        by_host = by_host | ((F.col(v) <= hard) & (F.col(v) > F.round(hard - (hard - soft) * F.col(f"strict_{r}"), 9)))
    return both.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"),
        by_host.alias("host_failed"),
        (~base & ~plain & ~by_host).alias("kept"),
    )
