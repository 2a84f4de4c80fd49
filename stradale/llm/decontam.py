"""Benchmark decontamination: candidates by words and rare n-gram seeds, then Smith-Waterman alignment.

Words are compared lower-cased and without punctuation. Every test item gives its n-grams of SEED
words that occur in at most RARE items (all of them where none is rare; the whole item where it is
shorter). A passage of a document that shares a seed with an item is aligned with the item: match
+2, mismatch -1, gap -1. The score is the best local alignment over that of the whole item; a
document is contaminated if it reaches THRESHOLD for any item, which edited and paraphrased copies
do while chance overlaps and short quotes do not.

No copy that reaches the threshold needs a seed: a passage is also aligned if words of the item at +2
and others at -1, in any order, reach the threshold, which no alignment exceeds. Only items of whose
rarest words the text has one are looked at; the threshold leaves room for all others to be missed.

The items go to all tasks in blocks of bounded size (BLOCK_CHARS characters); a larger benchmark is
taken block by block. Rarity is counted over the whole benchmark, so blocks give what one block
would. Documents are read where they lie and carry their verdict from block to block; no document is
shuffled.

Defined cases: null or empty texts and items match nothing; an empty benchmark contaminates nothing;
a document that repeats an item is aligned once over the joined windows; ties between items go to
the smallest item id, a null one last; repeated rows of documents get equal results, repeated items
count as often as they come; ids are of any type that Spark can order.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rewrite_texts, ship, slices, stored

SEED, RARE, THRESHOLD = 5, 3, 0.5
BLOCK_CHARS = 32 << 20
NOT_WORD = re.compile(r"[\W_]+")
CACHE = 150_000


class Numbers(dict):
    """Tokens as they stand in texts -> word numbers of a vocabulary: -1 for other words, -2 for punctuation. Looked up as it grows."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, token: str) -> int:
        w = NOT_WORD.sub("", token)
        v = self[token] = self.vocab.get(w, -1) if w else -2
        return v


class Index:
    """Seeds of a block of items, and the alignment with them."""

    def __init__(self, items: list[tuple[object, str | None]], seed: int = SEED, rare: int = RARE, threshold: float = THRESHOLD, common: set[str] | None = None):
        """common: n-grams in more than `rare` items of the whole benchmark, where `items` are a part of it."""
        self.threshold = threshold
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[object, np.ndarray]] = []
        for k, t in sorted(items, key=lambda x: (x[0] is None, 0 if x[0] is None else x[0], x[1] or "")):
            if words := words_of(t):
                self.items.append((k, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], np.int64)))
        self.raw = Numbers(self.vocab)
        held: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        for i, (_, w) in enumerate(self.items):
            n = min(seed, len(w))
            by = held.setdefault(n, {})
            for p in range(len(w) - n + 1):
                by.setdefault(w[p : p + n].tobytes(), []).append((i, p))
        self.tables = []
        names = list(self.vocab)
        said = lambda g: " ".join(names[j] for j in np.frombuffer(g, np.int64))
        for n, by in held.items():
            often = {g for g, at in by.items() if (len({i for i, _ in at}) > rare if common is None else said(g) in common)}
            has_rare = {i for g, at in by.items() if g not in often for i, _ in at}
            keys, spots = [], []
            for g, at in by.items():
                use = at if g not in often else [x for x in at if x[0] not in has_rare]
                if use:
                    keys.append(self.hash(np.frombuffer(g, np.int64)[:, None])[0])
                    spots.append(use)
            order = np.argsort(np.array(keys, np.uint64), kind="stable")
            self.tables.append((n, np.array(keys, np.uint64)[order], [spots[i] for i in order]))
        # each item's words, and for each word the items that have it among their rarest
        self.first = np.cumsum([0, *(len(w) for _, w in self.items)])
        self.flat = np.concatenate([w for _, w in self.items]) if self.items else np.zeros(0, np.int64)
        many = np.zeros(len(self.vocab), np.int64)
        for _, w in self.items:
            many[np.unique(w)] += 1
        self.least = np.array([max(1, math.ceil(threshold * len(w) - 1e-9)) for _, w in self.items], np.int64)
        rarest = [np.unique(w[np.argsort(many[w], kind="stable")[: max(0, len(w) - m + 1)]]) for (_, w), m in zip(self.items, self.least)]
        words = np.concatenate([*rarest, np.zeros(0, np.int64)])
        order = np.argsort(words, kind="stable")
        self.with_word = np.repeat(np.arange(len(rarest)), [len(r) for r in rarest])[order]
        self.word_first = np.searchsorted(words[order], np.arange(len(self.vocab) + 1))

    @staticmethod
    def hash(columns: np.ndarray) -> np.ndarray:
        """64-bit hashes of word number windows, one window a column."""
        x = np.full(columns.shape[1], len(columns), np.uint64)
        for c in columns:
            x = (x ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return x

    def numbers(self, text: str) -> np.ndarray:
        """Word numbers of a text, -1 for words of no item; tokens of punctuation only are left out."""
        if len(self.raw) > CACHE:
            self.raw.clear()
        words = text.lower().split()
        got = np.fromiter(map(self.raw.__getitem__, words), np.int64, len(words))
        return got[got != -2]

    def passages(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, start, end) wherever the item's words in any order reach the threshold."""
        held = np.zeros(len(self.vocab) + 1, bool)  # the last one for words of no item
        held[w] = True
        held[-1] = False
        some = np.unique(self.with_word[spread(self.word_first, np.flatnonzero(held))])
        if not len(some):
            return []
        size = self.first[some + 1] - self.first[some]
        n_held = np.add.reduceat(held[self.flat[spread(self.first, some)]], np.cumsum(size) - size, dtype=np.int64)
        out = []
        mine = np.zeros(len(held), bool)
        known = np.flatnonzero(w >= 0)
        words, triple = w[known], 3 * np.arange(len(known))
        for i in some[n_held >= self.least[some]]:
            item = self.items[i][1]
            mine[item] = True
            at = known[mine[words]]
            mine[item] = False
            less = at - triple[: len(at)]  # from the p-th of the item's words to the q-th the sum is less[p] - less[q] + 2
            if ((np.maximum.accumulate(less) - less).max() + 2) / (2 * len(item)) < self.threshold:
                continue
            step = np.full(len(w), -1)
            step[at] = 2
            total = np.concatenate([[0], np.cumsum(step)])
            above = total - np.minimum.accumulate(total)  # best sum of a passage that ends here
            cut = np.flatnonzero(above == 0)  # no alignment is positive across these
            for a, b in zip(cut, [*cut[1:], len(w)]):
                if above[a : b + 1].max() / (2 * len(item)) >= self.threshold:
                    out.append((int(i), int(a), int(b)))
        return out

    def matches(self, text: str | None) -> list[tuple[object, float]]:
        """(item id, score) of every item that shares a seed with the text or may reach the threshold."""
        if not text or not self.items:
            return []
        w = self.numbers(text)
        starts: dict[int, list[int]] = {}
        for n, keys, spots in self.tables:
            if len(w) < n:
                continue
            known = np.concatenate([[0], np.cumsum(w >= 0)])
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = self.hash(np.stack([w[at + j] for j in range(n)]))
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for hit in np.flatnonzero(keys[k] == h):
                for i, p in spots[k[hit]]:
                    starts.setdefault(i, []).append(int(at[hit]) - p)
        found: dict[int, float] = {}
        for i, a, b in self.passages(w):
            found[i] = max(found.get(i, 0.0), align(self.items[i][1], w[a:b]))
        for i in found.keys() - starts.keys():
            if found[i] < self.threshold:
                del found[i]  # a chance overlap
        for i, begin in starts.items():
            _, item = self.items[i]
            slack = len(item) // 2 + 2
            best, lo, hi = found.get(i, 0.0), None, None
            for s in [*sorted(set(begin)), None]:
                if s is not None and lo is not None and s - slack <= hi:
                    hi = max(hi, s + len(item) + slack)
                    continue
                if lo is not None:
                    best = max(best, align(item, w[max(0, lo) : hi]))
                if s is not None:
                    lo, hi = s - slack, s + len(item) + slack
            found[i] = best
        return [(self.items[i][0], s) for i, s in found.items()]

    def verdict(self, text: str | None) -> tuple[int, object, float]:
        """(items that reach the threshold, best such item, best score of any item)."""
        found = self.matches(text)
        hits = [(-s, k is None, k) for k, s in found if s >= self.threshold]
        return len(hits), best_of(hits), max((s for _, s in found), default=0.0)


def best_of(hits: list[tuple[float, bool, object]]) -> object:
    """The item of the highest score; of equal ones the smallest, a null one last."""
    return min(hits, key=lambda h: h if h[2] is not None else h[:2] + (0,))[2] if hits else None


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation."""
    return [w for w in (NOT_WORD.sub("", x) for x in (text or "").lower().split()) if w]


def merge(a: tuple[int, object, float], b: tuple[int, object, float]) -> tuple[int, object, float]:
    """The verdict on two blocks of items together."""
    hits = [(-v[2], v[1] is None, v[1]) for v in (a, b) if v[0]]
    return a[0] + b[0], best_of(hits), max(a[2], b[2])


def spread(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions first[r] to first[r + 1] of all rows, one after the other."""
    size = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def align(item: np.ndarray, words: np.ndarray, match: int = 2, miss: int = 1, gap: int = 1) -> float:
    """Best local alignment over the score of the whole item. Rows run over the item's words."""
    steps = gap * np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    best = 0
    for x in item:
        new = np.maximum(row - gap, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(words == x, match, -miss))
        row = np.maximum.accumulate(new + steps) - steps  # gaps within the row
        best = max(best, int(row.max()))
    return best / (match * len(item))


def grams(benchmark: DataFrame, text: str, seed: int = SEED) -> DataFrame:
    """(gram): each item's distinct n-grams."""

    def run(batches):
        import pyarrow as pa

        from stradale.llm.decontam import words_of

        for b in batches:
            for t in b.column(0).to_pylist():
                w = words_of(t)
                n = min(seed, len(w))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(sorted({" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}), pa.string())], names=["gram"])

    return benchmark.select(text).mapInArrow(run, "gram string")


def blocks(benchmark: DataFrame, item: str, text: str) -> list[tuple[list[tuple[object, str]], set[str] | None]]:
    """The items in blocks of about BLOCK_CHARS characters, with the n-grams of each that are common in the whole benchmark.

    Two blocks are on the driver at a time at most. Items of the same id and text may be many; they are dealt
    out by both, so that only repeated rows share a block.
    """
    n = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    k = -(-n // BLOCK_CHARS) or 1
    if k == 1:
        yield [(r[0], r[1]) for r in benchmark.select(item, text).collect()], None
        return
    spark = benchmark.sparkSession
    common = grams(benchmark, text).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RARE).select("gram")
    common = stored(spark, common, "common-grams")
    for i in range(k):
        part = benchmark.where(F.pmod(F.xxhash64(item, text), F.lit(k)) == i).select(item, text)
        here = grams(part, text).distinct().join(common, "gram", "left_semi")
        yield [(r[0], r[1]) for r in part.collect()], {r[0] for r in here.collect()}


def decontaminate(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of documents: key, n_items, best_item, best_score, contaminated."""
    spark = df.sparkSession
    ship(spark)
    kind = benchmark.schema[item].dataType.simpleString()
    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast(kind).alias("best_item"), F.lit(0.0).alias("best_score"))
    parts = blocks(benchmark, item, item_text)
    part = next(parts)
    while part is not None:
        sent, part = spark.sparkContext.broadcast(part), next(parts, None)

        def run(batches, sent=sent, last=part is None):
            import pyarrow as pa

            from stradale.llm.decontam import Index, merge

            items, common = sent.value
            index = Index(items, threshold=threshold, common=common)
            for whole in batches:
                for b in slices(whole, 1):
                    before = zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))
                    rows = [merge(v, index.verdict(t)) for v, t in zip(before, b.column(1).to_pylist())]
                    cols = [pa.array([r[i] for r in rows], b.schema.field(2 + i).type) for i in range(3)]
                    texts = pa.nulls(b.num_rows, b.schema.field(1).type) if last else b.column(1)  # no further block needs them
                    yield pa.RecordBatch.from_arrays([b.column(0), texts, *cols], schema=b.schema)
            pa.default_memory_pool().release_unused()

        src = src.mapInArrow(run, src.schema)
    return src.select(F.col("_key").alias(key), "n_items", "best_item", "best_score", (F.col("n_items") > 0).alias("contaminated"))


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that no item contaminates, as they are; one Arrow pass for each block of items."""
    spark = df.sparkSession
    ship(spark)
    for part in blocks(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(part)

        def make(sent=sent):
            from stradale.llm.decontam import Index

            items, common = sent.value
            index = Index(items, threshold=threshold, common=common)
            return lambda texts: [index.verdict(t)[0] == 0 for t in texts]

        df = rewrite_texts(df, text, make)
    return df
