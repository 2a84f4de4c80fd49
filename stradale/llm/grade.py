"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(theta_k - w.x) with one shared weight vector over hashed text features and
ordered thresholds. Features are the distinct words of a text (lower-cased, outer punctuation
stripped) and binned shape measures, hashed to WIDTH numbers; features in fewer than MIN_DOCS sample
documents, or without a clear association with the rating, carry no weight. The model is fitted here on a bounded sample of rated documents by
Adam on the whole sample.

Ratings come from labels: 0 for low quality, 1 for toxic but otherwise good, 2 for good; a label
without quality, or of good quality without a word on toxicity, is no rating.

Defined cases: a null text counts as empty and gets its shape features only; without rated
documents every document gets the three grades with equal probability and is kept; repeated ratings
of a document count as often as they come; grades below 0 or above 2 count as 0 and 2, null grades
and ratings without a document do not count.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, ship

WIDTH = 1 << 18
SAMPLE_DOCS = 12_000
#: Ratings weigh as the power -BALANCE of their grade's share.
BALANCE = 0.5
MIN_DOCS = 8
#: Features enter if their documents' mean rating is so many standard errors from the mean of all.
SCREEN = 5.0
GRADES = 3
KEEP_TAIL = 0.5
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|#*$%&-"
SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~@]")
UPPER = re.compile(r"[A-ZÄÖÜÉÈÊÇÑÁÍÓÚ]")
DIGITS = re.compile("[0-9]")


def place(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % WIDTH


def shape(text: str, words: list[str], distinct: int) -> list[str]:
    """Binned measures of a text as feature names."""
    n, k = max(len(text), 1), max(len(words), 1)
    rows = text.split("\n")
    step = lambda x, w: min(int(x / w), 12)
    return [
        f"\x00symbols{step(len(SYMBOLS.findall(text)) / n, 0.02)}",
        f"\x00upper{step(len(UPPER.findall(text)) / n, 0.05)}",
        f"\x00digits{step(len(DIGITS.findall(text)) / n, 0.04)}",
        f"\x00marks{step(text.count('!') / k, 0.1)}",
        f"\x00pipes{step(text.count('|') / k, 0.1)}",
        f"\x00distinct{step(distinct / k, 0.1)}",
        f"\x00rows{step(1 - len(set(rows)) / len(rows), 0.1)}",
        f"\x00words{min(len(words).bit_length(), 16)}",
        f"\x00long{step(n / k, 2)}",
    ]


def feature_places(text: str | None) -> list[int]:
    """Distinct hashed features of a text."""
    words = (text or "").lower().split()
    distinct = set(words)
    stripped = {w.strip(EDGE) for w in distinct} - {""}
    return sorted({place(w) for w in stripped} | {place(s) for s in shape(text or "", words, len(distinct))})


class Model:
    """Weights and thresholds; scoring keeps a bounded cache of raw word -> weight."""

    def __init__(self, weights: np.ndarray, theta: np.ndarray):
        self.weights, self.theta = weights, theta
        self.least = KEEP_TAIL if weights.any() else 0.0  # without any weight nothing speaks against a document
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        used = np.flatnonzero(self.weights)
        return used, self.weights[used].astype(np.float32), self.theta, self.least

    def __setstate__(self, s):
        self.weights = np.zeros(WIDTH)
        self.weights[s[0]] = s[1]
        self.theta, self.least, self.cache = s[2], s[3], {}

    def margin(self, text: str | None) -> float:
        words = (text or "").lower().split()
        distinct = set(words)
        cache = self.cache
        if len(cache) > 150_000:
            cache.clear()
        total, w, seen = 0.0, self.weights, set()
        for x in distinct:
            v = cache.get(x)
            if v is None:
                s = x.strip(EDGE)
                p = place(s) if s else -1
                v = cache[x] = (p, float(w[p]) if s else 0.0)
            if v[1] and v[0] not in seen:
                seen.add(v[0])
                total += v[1]
        for s in shape(text or "", words, len(distinct)):
            p = place(s)
            if p not in seen:
                seen.add(p)
                total += float(w[p])
        return total

    def grades(self, texts: list[str | None]) -> list[tuple]:
        """(expected grade, P(grade = top), P(grade >= 1), kept) of each text."""
        m = np.array([self.margin(t) for t in texts])
        above = 1 / (1 + np.exp(np.clip(self.theta[None] - m[:, None], -60, 60)))  # P(grade > k)
        return [(float(a.sum()), float(a[-1]), float(a[0]), bool(a[-1] >= self.least)) for a in above]


def train(rows: list, grades: list[int], steps: int = 600, rate: float = 0.05, ridge: float = 1e-5) -> Model:
    """Fit by Adam on the log-likelihood of the ratings, the sample being one batch."""
    y = np.clip(np.array(grades, int), 0, GRADES - 1)
    theta = np.array([-1.0, 0.0])
    if not len(y):
        return Model(np.zeros(WIDTH), np.array([-np.log(2), np.log(2)]))
    idx = np.concatenate([np.asarray(r, np.int32) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    df = np.bincount(idx, minlength=WIDTH)
    mean = np.bincount(idx, y[doc], WIDTH) / np.maximum(df, 1)
    z = (mean - y.mean()) * np.sqrt(df) / max(y.std(), 1e-9)
    ok = ((df >= MIN_DOCS) & (np.abs(z) >= SCREEN))[idx]
    idx, doc = idx[ok], doc[ok]
    used, inv = np.unique(idx, return_inverse=True)
    w = np.zeros(len(used))
    share = np.bincount(y, minlength=GRADES) / len(y)
    cost = ((1 / np.maximum(share, 1e-9)) ** BALANCE)[y]
    cost /= cost.mean()
    a, b = theta[0], np.log(theta[1] - theta[0])  # thresholds a and a + exp(b) stay in order
    m = v = np.zeros(len(used) + 2)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, steps + 1):
        s = np.bincount(doc, w[inv], len(y))
        lo, hi = sig(a - s), sig(a + np.exp(b) - s)  # P(y <= 0), P(y <= 1)
        p = np.where(y == 0, lo, np.where(y == 1, hi - lo, 1 - hi)).clip(1e-9)
        dlo, dhi = lo * (1 - lo), hi * (1 - hi)
        # d log p / d a, d log p / d (a + exp b)
        ga = np.where(y == 0, dlo / p, np.where(y == 1, -dlo / p, 0))
        gh = np.where(y == 1, dhi / p, np.where(y == 2, -dhi / p, 0))
        ga, gh = ga * cost, gh * cost  # rare grades weigh more
        gs = -(ga + gh)
        g = np.concatenate([np.bincount(inv, gs[doc], len(used)) / len(y) - ridge * w, [(ga + gh).mean(), gh.mean() * np.exp(b)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, a, b = w + step[:-2], a + step[-2], b + step[-1]
    full = np.zeros(WIDTH)
    full[used] = w
    return Model(full, np.array([a, a + np.exp(b)]))


def fit(df: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on about `sample_docs` rated documents, chosen by a hash of the key."""
    ship(df.sparkSession)
    r = ratings.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).select(key, F.col(grade).cast("int").alias("_grade"))
    n = r.count()
    u = F.pmod(F.xxhash64(F.lit(53), F.col(key).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    rated = df.select(key, text).join(r.where(u < min(1.0, sample_docs / max(n, 1))), key)

    def make():
        from stradale.llm.grade import feature_places

        return lambda texts: [(np.array(feature_places(t), np.int32).tobytes(),) for t in texts]

    got = map_texts(rated, [key, "_grade"], text, make, "places binary").toPandas()
    got = got.sort_values([key, "_grade", "places"], kind="stable")  # a bounded sample, in an order of its own
    return train([np.frombuffer(p, np.int32) for p in got.places], got._grade.tolist())


def graded(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) as ratings: 0 low quality, 1 toxic, 2 good; null where the labels say neither."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


SCHEMA = "expected_grade double, p_top double, p_above_low double, kept boolean"


def rate(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: expected grade, tail probabilities, kept. One Arrow pass, no shuffle."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return sent.value.grades

    return map_texts(df, [key], text, make, SCHEMA)
