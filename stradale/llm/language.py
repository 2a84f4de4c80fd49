"""Language identification by prediction by partial matching over bytes.

Per language a context tree of order 0 to 3 is counted on a bounded sample of labelled texts. A
byte is coded in the longest context that was seen, escaping to shorter ones with the probability
u / (n + u) (n: count, u: distinct followers), at last uniformly over 256 bytes. The statistics are
frozen, so the code length of a byte is a function of its three predecessors; the lengths of all
followers of all contexts are tabulated, and a text's exact code length is a sum of look-ups.

Bytes that no sample has share one class with text starts: they are coded alike in every context,
and what follows them is coded as at a text's start. The language of the shortest code wins, ties go to the language first in
order; the score is its posterior under equal priors.

Defined cases: a null text, or one without a letter (str.isalpha), is `und` with score 0; an empty
table gives an empty result; repeated rows get equal results; without any labelled text every row is
`und`. A model's tables are sent to every task, so their size is checked: languages whose contexts
need more than TABLE_BYTES raise ValueError.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, ship

#: What may be a letter; numbers such as fractions pass here and are told apart by str.isalpha.
LETTER = re.compile(r"[^\W\d_]+")
#: Bytes of a model's tables at most: some 200 languages of one alphabet.
TABLE_BYTES = 1 << 30
#: Bound of the sample: labelled texts a language, and bytes counted of each text's whole length.
SAMPLE_DOCS = 1500
#: Distinct labels at most; more are no languages.
MAX_LANGS = 2000
#: Bytes scored at once.
STEP = 1 << 20


class Model:
    """Code lengths in bits: row[context class triple] -> lengths[row, class, language]."""

    def __init__(self, langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        """grams: language -> (4-byte windows as big-endian uint32, counts)."""
        self.langs = langs
        seen = np.zeros(256, bool)
        for g, _ in grams.values():
            for s in (0, 8, 16, 24):
                seen[(g >> s) & 255] = True
        seen[0] = False
        self.cls = np.zeros(256, np.int32)  # class 0: text starts, NUL and bytes never seen
        self.cls[seen] = np.arange(1, seen.sum() + 1)
        self.k = k = int(seen.sum()) + 1
        counts = []
        for lang in langs:
            g, n = grams[lang]
            c = [self.cls[(g >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)]
            counts.append((c, n.astype(np.float64)))
        # contexts of any language, coded as base-k numbers with their order
        self.row = np.zeros(k**3, np.int32)
        triples = np.unique(np.concatenate([(c[0] * k + c[1]) * k + c[2] for c, _ in counts])) if counts else np.zeros(0, np.int64)
        pairs = np.unique(triples % (k * k))
        ones = np.unique(pairs % k)
        # rows: 0 for the empty context, then orders 1, 2, 3; a class triple gets its longest known one
        base1, base2, base3 = 1, 1 + len(ones), 1 + len(ones) + len(pairs)
        rows = base3 + len(triples)
        if 4 * (rows * k * len(langs) + k**3) > TABLE_BYTES:
            raise ValueError(f"{len(langs)} languages with {rows} contexts need tables of more than {TABLE_BYTES} bytes")
        r1 = np.zeros(k, np.int32)
        r1[ones] = base1 + np.arange(len(ones))
        r2 = np.tile(r1, k)
        r2[pairs] = base2 + np.arange(len(pairs))
        self.row = np.tile(r2, k)
        self.row[triples] = base3 + np.arange(len(triples))
        parent = np.zeros(rows, np.int64)
        parent[base2:base3] = r1[pairs % k]
        parent[base3:] = r2[triples % (k * k)]
        self.bits = np.empty((rows * k, len(langs)), np.float32)
        for li, (c, n) in enumerate(counts):
            p = np.empty((rows, k), np.float64)
            lower = np.full(k, 1 / 256)
            zero = np.bincount(c[3], n, k)
            p[0] = self._blend(zero[None], lower[None])[0]
            for lo, hi, keys, table in (
                (base1, base2, c[2], ones),
                (base2, base3, c[1] * k + c[2], pairs),
                (base3, rows, (c[0] * k + c[1]) * k + c[2], triples),
            ):
                at = np.searchsorted(table, keys)
                f = np.bincount(at * k + c[3], n, len(table) * k).reshape(len(table), k)
                p[lo:hi] = self._blend(f, p[parent[lo:hi]])
            self.bits[:, li] = -np.log2(p).reshape(-1)

    @staticmethod
    def _blend(f: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Escape with u / (n + u) to the shorter context; contexts never seen pass through."""
        n = f.sum(1, keepdims=True)
        u = (f > 0).sum(1, keepdims=True)
        t = np.maximum(n + u, 1)
        return np.where(n > 0, f / t + u / t * lower, lower)

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language. Texts start from three bytes of class 0."""
        k = self.k
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size + 3)
        data = np.frombuffer(b"".join([b"\0\0\0" + t for t in texts]), np.uint8)
        sums = np.zeros((len(texts), len(self.langs)))
        for lo in range(3, len(data), STEP):  # bounded work arrays, whatever the texts' lengths
            hi = min(lo + STEP, len(data))
            c = self.cls[data[lo - 3 : hi]]
            idx = self.row[(c[:-3] * k + c[1:-2]) * k + c[2:-1]] * np.int32(k) + c[3:]
            at = np.arange(lo, hi)
            owner = np.searchsorted(ends, at, "right")
            own = at >= ends[owner] - size[owner]  # not the three bytes before a text
            for li in range(len(self.langs)):
                sums[:, li] += np.bincount(owner, self.bits[idx, li] * own, len(texts))
        return sums

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, bits a byte) of each text."""
        out: list[tuple[str, float, float]] = [("und", 0.0, 0.0)] * len(texts)
        use = [i for i, t in enumerate(texts) if t and has_letter(t)]
        if not use or not self.langs:
            return out
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in use]
        s = self.lengths(raw)
        best = s.argmin(1)
        low = s.min(1)
        score = 1 / np.exp2(np.clip(low[:, None] - s, -1000, 0)).sum(1)
        for j, i in enumerate(use):
            out[i] = (self.langs[best[j]], float(score[j]), float(low[j] / len(raw[j])))
        return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in LETTER.finditer(text) for c in m[0])


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 4-byte windows of texts, each behind three zero bytes, with counts."""
    data = np.frombuffer(b"".join([b"\0\0\0" + t.encode("utf-8", "surrogatepass") for t in texts]), np.uint8).astype(np.uint32)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    g = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    # windows that end in one of the three zero bytes between texts belong to no text
    g = g[(g & 255) != 0]
    return np.unique(g, return_counts=True)


def held_out(key: str = "doc_id"):
    """crc32 of the key's decimal text, modulo 5, is 0; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Count 4-byte windows on about `sample_docs` labelled, not held-out texts a language.

    The sample is chosen by a hash of the key against a share per language, so it is the same at
    any partitioning. Windows are counted in Arrow batches and summed by key before they come to the
    driver: their number is bounded by the sample and by the bytes of its alphabets.
    """
    spark = df.sparkSession
    ship(spark)
    use = df.where(F.col(lang).isNotNull() & ~held_out(key))  # counted without reading a text
    n = {r["_k"]: r["n"] for r in use.groupBy(F.col(lang).cast("string").alias("_k")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    langs = sorted(n)
    if not langs:
        return Model([], {})
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, sample_docs / v))]), F.col(lang).cast("string"))
    u = F.pmod(F.xxhash64(F.lit(17), F.col(key).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = use.where(F.col(text).isNotNull() & (u < share)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches):
        import pyarrow as pa

        from stradale.llm.language import windows

        for b in batches:
            by: dict[str, list[str]] = {}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(k, []).append(t)
            for k, ts in by.items():
                g, c = windows(ts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"]
                )

    rows = (
        sample.mapInArrow(run, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    grams = {}
    for k in langs:
        x = rows[rows.lang == k].sort_values("gram")
        grams[k] = (x.gram.to_numpy(np.uint32), x.n.to_numpy(np.int64))
    return Model([k for k in langs if len(grams[k][0])], grams)


SCHEMA = "lang_pred string, score double, bits_per_byte double"


def identify(df: DataFrame, model: Model, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """One row per document: keys, lang_pred, score, bits_per_byte. One Arrow pass, no shuffle."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def make():
        return sent.value.predict

    return map_texts(df, keys or ["doc_id"], text, make, SCHEMA)
