"""Near-duplicate classes by a multi-index Hamming join over minhash signatures.

A document's set is its distinct shingles of `words` words (lower-cased A-Z). Sets with equal
content collapse first, so exact copies cost one row. The signature has 60 symbols of 16 bits, one
minhash each, in 10 chunks of 6. By the pigeonhole principle two signatures that differ in at most
19 symbols agree, in some chunk, in all symbols but one; each chunk therefore enters the index six
times, each time with another symbol left out. All pairs within 19 of 60 share a bucket for
certain, and a pair with similarity 0.8 misses every bucket with probability 3e-5.

Buckets are never expanded into all pairs. Links are found in three steps, each of which merges
classes and compares only documents of different classes:

1. every document meets the smallest and the largest document of its buckets (one each);
2. buckets of up to SMALL members that hold several classes: the pairs across classes;
3. larger buckets, exactly, in blocks. Documents without enough shared shingles leave first:
   with c(A) shingles of A that any other remaining document has, |A and B| <= c(A), so that in
   groups that share a passage but differ otherwise hardly any document stays. Larger
   buckets that hold several classes are joined into families; the documents outside a family's largest class
   meet all its documents, one row being a pair of blocks of about BLOCK_SHINGLES shingles.
   A block pair intersects full sets and gives as few links as span the classes it connects.

Pairs already decided are not compared again. A pair is confirmed on the full sets (64-bit shingle
hashes); only pairs whose sizes rule out the similarity are not compared.

Defined cases: null or empty texts, or texts without words, have empty sets, link with nothing and
are kept; with fewer words than `words` the whole sequence is the one shingle; rows that repeat a
doc_id stand for one document, whose links are those of all its texts; a row without a doc_id has no
class of its own: it takes that of rows with an equal set, or none, and is then kept. Keys are of any
type that Spark can order; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, map_texts, ship, stored

CHUNKS, CHUNK = 10, 6
SYMBOLS = CHUNKS * CHUNK
SMALL = 24
#: Shingles of a block, on average (8 bytes each).
BLOCK_SHINGLES = 1 << 17
#: Odd multipliers and offsets of the 60 hash functions, from a fixed seed.
_RNG = np.random.default_rng(20240607)
MULT = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
UPPER = {c: c + 32 for c in range(65, 91)}
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_HASHES: dict[bytes, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split cuts at the same six bytes
    got = _HASHES
    if len(got) > 150_000:
        got.clear()
    out = []
    for w in words:
        h = got.get(w)
        if h is None:
            h = got[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(x)])
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def signature(s: np.ndarray) -> bytes:
    """60 minhash symbols of 16 bits."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        low = np.minimum(low, (s[i : i + 1024, None] * MULT + ADD).min(0))
    return (mix(low) >> np.uint64(48)).astype("<u2").tobytes()


def features(texts: list[str | None], words: int) -> list[tuple]:
    """n_shingles, digest of the set, signature; both empty for an empty set."""
    out = []
    for t in texts:
        s = shingles(t, words)
        out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s)) if len(s) else (0, None, None))
    return out


def bucket_keys(sig: Column) -> Column:
    """The index entries of a signature: each chunk six times, one symbol left out."""
    keys = []
    for c in range(CHUNKS):
        for gap in range(CHUNK):
            start = 2 * CHUNK * c
            a = F.substring(sig, start + 1, 2 * gap)
            b = F.substring(sig, start + 2 * gap + 3, 2 * (CHUNK - 1 - gap))
            keys.append(F.xxhash64(F.lit(c * CHUNK + gap), a, b))
    return F.array(*keys)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |A and B| >= percent * |A or B| on full sets."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb")), "b"
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ok = []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if 100 * len(small) < percent * len(large):
                    ok.append(False)
                    continue
                at = np.searchsorted(large, small)
                n = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                ok.append(100 * n >= percent * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = sets.schema["rep"].dataType.simpleString()
    return both.select("a", "b", "ha", "hb").mapInArrow(run, f"a {kind}, b {kind}")


def shared_counts(reps: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, n, c): shingles of each of these documents, and those that another of them has too."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                x = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(x)), pa.array(x)], names=["rep", "hash"])

    own = sets.join(reps, "rep", "left_semi")
    rows = own.select("rep", "hashes").mapInArrow(run, f"rep {sets.schema['rep'].dataType.simpleString()}, hash long")
    once = rows.groupBy("hash").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("k")).where("k = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("u"))
    n = (F.length("hashes") / 8).cast("long")
    return own.groupBy("rep").agg(F.max(n).alias("n")).join(once, "rep", "left").select("rep", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))


def block_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across classes among documents that share a bucket.

    rest: (first, rep, own), the smallest documents of a document's buckets, the document, its class.
    """
    spark = rest.sparkSession
    mixed = lambda df: df.groupBy("first").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("first")
    rest = stored(spark, rest, "rest")
    rest = stored(spark, rest.join(stored(spark, mixed(rest), "mixed"), "first", "left_semi"), "open")
    able = stored(spark, shared_counts(rest.select("rep").distinct(), sets).where(100 * F.col("c") >= percent * F.col("n")), "able")
    rest = stored(spark, rest.join(able.select("rep", "n"), "rep"), "able-in")
    near_by = stored(spark, rest.join(stored(spark, mixed(rest), "mixed"), "first", "left_semi"), "near-by")
    family = components(near_by.select(F.col("first").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct())
    docs = stored(spark, near_by.select("rep", "own", "n").distinct().join(family.select(F.col("node").alias("rep"), F.col("label").alias("family")), "rep"), "family")
    by_class = docs.groupBy("family", "own").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m"))
    home = by_class.groupBy("family").agg(F.max(F.struct("k", "own"))["own"].alias("home"), F.sum("m").alias("m"))
    docs = docs.join(stored(spark, home, "home"), "family").withColumn("part", F.when(F.col("own") == F.col("home"), 0).otherwise(1))
    docs = docs.withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("m") / BLOCK_SHINGLES).cast("long")))
    whole = docs.join(sets, "rep")
    cols = ("rep", "own", "hashes")
    blocks = stored(spark, whole.groupBy("family", "part", "block").agg(*[F.collect_list(F.col(c)).alias(c) for c in cols]), "blocks")
    x = blocks.where("part = 1").select("family", F.col("block").alias("xb"), *[F.col(c).alias(f"x_{c}") for c in cols])
    y = blocks.select("family", F.col("part").alias("yp"), F.col("block").alias("yb"), *[F.col(c).alias(f"y_{c}") for c in cols])
    both = x.join(y, "family").where((F.col("yp") == 0) | (F.col("yb") >= F.col("xb")))

    def run(batches):
        import pyarrow as pa

        def row(b, i, at):
            rep, own = (b.column(at + k)[i].values.to_numpy(zero_copy_only=False) for k in range(2))
            return rep, own, [np.frombuffer(v.as_buffer(), np.uint64) for v in b.column(at + 2)[i].values]

        for b in batches:
            for i in range(b.num_rows):
                (xr, xo, xs), (yr, yo, ys) = row(b, i, 0), row(b, i, 3)
                # postings of the block: each hash with the documents that have it
                size = np.array([len(s) for s in ys])
                every = np.concatenate(ys)
                order = np.argsort(every, kind="stable")
                owner = np.repeat(np.arange(len(ys)), size)[order]
                every = every[order]
                out = []
                up: dict = {}  # classes that this pair of blocks has joined

                def find(k):
                    while k in up:
                        k = up[k]
                    return k

                for r, o, s in zip(xr, xo, xs):
                    lo, hi = np.searchsorted(every, s), np.searchsorted(every, s, "right")
                    k = hi - lo
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
                    both_n = np.bincount(owner[at], minlength=len(ys))
                    ok = (yo != o) & (yr != r) & (100 * both_n >= percent * (len(s) + size - both_n))
                    for j in np.flatnonzero(ok):
                        p, q = find(o), find(yo[j])
                        if p != q:
                            up[max(p, q)] = min(p, q)
                            out.append((r, yr[j]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, b.schema.field(0).type.value_type) for v in zip(*out)], names=["a", "b"])

    kind = sets.schema["rep"].dataType.simpleString()
    return both.select(*[f"{p}_{c}" for p in "xy" for c in cols]).mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of the links (a, b).

    Min-label propagation with pointer jumping; each round is written to the shared folder.
    """
    spark = links.sparkSession
    ends = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    ends = stored(spark, ends.union(ends.select(F.col("dst"), F.col("src"))), "links")
    label = ends.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label"))
    label = stored(spark, label, "labels")
    while True:
        seen = (
            ends.join(label.withColumnRenamed("node", "dst"), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("label").alias("m"))
        )
        new = label.join(seen, "node", "left").select("node", "label", F.least("label", "m").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("label").alias("high"))
        new = new.join(up, "low", "left").select("node", F.least("low", "high").alias("label"), (F.least("low", "high") < F.col("label")).alias("moved"))
        new = stored(spark, new, "labels")
        if not new.where("moved").limit(1).count():
            return new.select("node", "label")
        label = new.select("node", "label")


def classes(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable), kept.

    The result is a stored table of numbers; all tables on the way to it are deleted.
    """
    return kept(df.sparkSession, lambda: _classes(df, words, percent, key, text), "classes")


def _classes(df: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)

    def make():
        from stradale.llm.dedup import features

        return lambda texts: features(texts, words)

    feats = stored(spark, map_texts(df, [key], text, make, "n_shingles long, digest binary, sig binary"), "feats")
    feats = feats.withColumnRenamed(key, "_key")
    # equal sets: one representative, the smallest key. Tables that a skewed join reads are stored
    # first, so that both of its sides are plain exchanges and hot keys can be split at run time.
    same = feats.where("digest is not null").groupBy("digest").agg(F.min("_key").alias("rep"), F.max("_key").alias("top"))
    same = stored(spark, same.where("rep < top").select("digest", "rep"), "same")
    docs = feats.join(same, "digest", "left").withColumn("rep", F.when(F.col("digest").isNotNull(), F.coalesce("rep", "_key")))
    docs = stored(spark, docs.select("_key", "n_shingles", "rep", F.when(F.col("rep") == F.col("_key"), F.col("sig")).alias("sig")), "docs")
    sigs = stored(spark, docs.where("sig is not null").select("rep", "sig").dropDuplicates(["rep", "sig"]), "sigs")

    entries = sigs.select("rep", F.explode(bucket_keys(F.col("sig"))).alias("bucket"))
    first = entries.groupBy("bucket").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"))
    first = stored(spark, first.where("first < last"), "first")
    member = stored(spark, entries.join(first, "bucket"), "buckets")

    # full sets of those that share a bucket with another document only
    shared = member.select("rep").distinct()
    wanted = df.select(F.col(key).alias("rep"), text).join(stored(spark, shared, "shared"), "rep", "left_semi")

    def sets_of():
        from stradale.llm.dedup import shingles

        return lambda texts: [(shingles(t, words).tobytes(),) for t in texts]

    sets = stored(spark, map_texts(wanted, ["rep"], text, sets_of, "hashes binary").dropDuplicates(["rep", "hashes"]), "sets")

    links, label, tried = None, None, None

    def across(pairs: DataFrame) -> DataFrame:
        """Ordered pairs that lie in different classes and were not compared before."""
        p = pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            p = p.join(tried, ["a", "b"], "left_anti")
        return p

    def classed(df: DataFrame) -> DataFrame:
        """df with `own`, the class of its rep."""
        return df.join(label.select(F.col("node").alias("rep"), F.col("label").alias("own")), "rep", "left").withColumn("own", F.coalesce("own", "rep"))

    def merge(found: DataFrame) -> None:
        """Add links and renew the classes."""
        nonlocal links, label
        found = stored(spark, found, "found")
        if label is None or found.limit(1).count():
            links = found if links is None else links.union(found)
            label = components(links)

    def decide(pairs: DataFrame) -> None:
        """Compare pairs that were not compared before."""
        nonlocal tried
        asked = stored(spark, across(pairs), "pairs")
        tried = asked if tried is None else tried.union(asked)
        merge(confirm(asked, sets, percent))

    ends = member.where("rep <> first").groupBy("rep").agg(F.min("first").alias("a"))
    ends = ends.unionByName(member.where("rep <> last").groupBy("rep").agg(F.max("last").alias("a")))
    decide(ends.select("a", F.col("rep").alias("b")))

    small = classed(member.where(F.col("n") <= SMALL).select("bucket", "rep"))
    mixed = small.groupBy("bucket").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high")
    small = stored(spark, small.join(stored(spark, mixed.select("bucket"), "mixed"), "bucket"), "small")
    left = small.select("bucket", F.col("rep").alias("a"), F.col("own").alias("la"))
    right = small.select("bucket", F.col("rep").alias("b"), F.col("own").alias("lb"))
    decide(left.join(right, "bucket").where("la <> lb and a < b").select("a", "b"))

    # large buckets go by their smallest document: a document has few such, its buckets have many
    large = stored(spark, member.where(F.col("n") > SMALL).groupBy("first", "rep").agg(F.count(F.lit(1)).alias("n")).select("first", "rep"), "large")
    if large.limit(1).count():
        merge(block_links(classed(large), sets, percent))

    own = label.withColumnRenamed("node", "rep")
    out = docs.join(own, "rep", "left")
    comp = F.coalesce("label", "rep", "_key")
    return out.select(F.col("_key").alias(key), "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("_key"), comp.isNull()).alias("kept"))
