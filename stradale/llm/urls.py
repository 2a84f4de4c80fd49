"""URL filter: prefix rules, and gradient-boosted trees on lexical features for the rest.

A rule (host, path, verdict) fits its host and all subdomains where the path starts with the rule's
path; the longest rule wins. URLs that no rule fits are judged by boosted regression trees
(second-order boosting of the logistic loss on feature histograms) over lexical features: lengths,
path depth, digit and letter ratios, entropies, parameter counts, and smoothed block rates of the
host's suffixes.

Labelled URLs come from a table with a label column (a bounded sample of distinct URLs). Where a
table has no labels of its own, the rules label its URLs, so that the trees carry the policy over to
URLs that no rule names: a URL that a rule fits has the rule's verdict, and one on a host that rules
block by path only is allowed outside those paths. Features describe shape, not names: the host
enters by counts, ratios and the smoothed block rates of its last one and last two labels, the path
by the rate of its first segment below the host's last label.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and is
judged by the trees on its empty features; without labelled URLs, or with one class only, the trees
are a constant; a URL that is labelled both ways counts as blocked; repeated rows get equal results.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored

# --- fixed values: the production rules, (host, path start, verdict) -------------------------------
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# ---------------------------------------------------------------------------------------------------

#: Bound of the sample that the trees are fitted on: distinct labelled URLs, chosen by a hash.
SAMPLE_URLS = 20_000
FOLDS = 5
#: A URL that no rule fits is blocked from this probability on: where labels say little, it is allowed.
BLOCK_AT = 0.8
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
FEATURES = (
    "length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio", "hyphens",
    "host_hyphens", "entropy", "host_entropy", "parameters", "longest_label", "longest_segment", "vowel_ratio",
    "punctuation", "https", "fragment", "extension", "rate_tld", "rate_domain", "rate_segment",
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without `://`."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return m[1].translate(_LOWER), m[2]


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """(rule as host + path, verdict) of the longest rule that fits."""
    best = None
    if host:
        for h, p, v in rules:
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
                best = (h + p, v)
    return best


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def ratio(s: str, chars: str) -> float:
    return sum(c in chars for c in s) / len(s) if s else 0.0


def suffixes(host: str, path: str) -> tuple[str, str, str]:
    """The host's last label, its last two labels, and the path's first segment below the last label."""
    x = host.split(".")
    return x[-1], ".".join(x[-2:]), x[-1] + "/" + path[1:].split("/", 1)[0]


def label_of(host: str, path: str, rules=RULES) -> bool | None:
    """Whether the rules have a URL blocked (true) or allowed; null where they say nothing."""
    r = rule_of(host, path, rules)
    if r:
        return r[1] == "block"
    by_path = any(v == "block" and p != "/" and (host == h or host.endswith("." + h)) for h, p, v in rules)
    return False if by_path else None


class Model:
    """Suffix rates, bin edges and trees; a tree is arrays (feature, bin, left, right, value)."""

    def __init__(self, prior, rates, cuts, trees, start):
        self.prior, self.rates, self.cuts, self.trees, self.start = prior, rates, cuts, trees, start

    def features(self, url: str | None) -> list[float]:
        url = url or ""
        host, path = split_url(url)
        query = url.split("?", 1)[1].split("#")[0] if "?" in url.split("#")[0] else ""
        labels, segs = host.split("."), [s for s in path.split("/") if s]
        letters = [c for c in url.lower() if c.isalpha()]
        return [
            len(url), len(host), len(path), len(labels), len(segs), ratio(url, "0123456789"), ratio(host, "0123456789"),
            url.count("-"), host.count("-"), entropy(url), entropy(host), len([q for q in query.split("&") if q]),
            max(map(len, labels)), max(map(len, segs), default=0), ratio(letters, "aeiou"), sum(not c.isalnum() for c in url),
            url[:6].lower() == "https:", "#" in url, "." in (segs[-1] if segs else ""),
            *(self.rates[i].get(s, self.prior) for i, s in enumerate(suffixes(host, path))),
        ]

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """Probability that a URL is to be blocked."""
        x = np.array([self.features(u) for u in urls], float).reshape(-1, len(FEATURES))
        b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1) if len(x) else x.astype(int)
        return 1 / (1 + np.exp(-self.start - self.sums(b)))

    def sums(self, b: np.ndarray) -> np.ndarray:
        """What the trees add up to for rows of bin numbers."""
        z = np.zeros(len(b))
        for f, t, left, right, v in self.trees:
            at = np.zeros(len(b), int)
            while (inner := f[at] >= 0).any():
                go = b[np.arange(len(b)), np.maximum(f[at], 0)] <= t[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            z += v[at]
        return z


def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, depth: int, ridge: float, least: int, rate: float):
    """One regression tree on binned features for gradients g and hessians h."""
    tree = []

    def node(rows: np.ndarray, d: int) -> int:
        at = len(tree)
        tree.append([-1, 0, 0, 0, -rate * g[rows].sum() / (h[rows].sum() + ridge)])
        if d == depth or len(rows) < 2 * least:
            return at
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0)
        for j in range(b.shape[1]):
            gl = np.cumsum(np.bincount(b[rows, j], g[rows], bins))[:-1]
            hl = np.cumsum(np.bincount(b[rows, j], h[rows], bins))[:-1]
            n = np.cumsum(np.bincount(b[rows, j], minlength=bins))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(n < least) | (n > len(rows) - least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
        if best[1] >= 0:
            go = b[rows, best[1]] <= best[2]
            tree[at][:2] = [best[1], best[2]]
            tree[at][2] = node(rows[go], d + 1)
            tree[at][3] = node(rows[~go], d + 1)
        return at

    node(np.arange(len(g)), 0)
    return tuple(np.array(c) for c in zip(*tree))


def train(urls: list[str], blocked: list[bool], trees: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.2, smooth: float = 20.0) -> Model:
    """Boosted trees for labelled URLs. Rates of suffixes come from other folds while fitting."""
    y = np.array(blocked, float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    start = math.log(prior / (1 - prior))
    empty = Model(prior, [{}, {}, {}], [np.zeros(0)] * len(FEATURES), [], start)
    if len(y) == 0 or y.min() == y.max():
        return empty
    parts = [suffixes(*split_url(u)) for u in urls]
    rates, own, fold = [], [], np.arange(len(y)) % FOLDS
    for i in range(3):
        names = np.array([p[i] for p in parts])
        table = lambda use: {
            k: (y[use & (names == k)].sum() + smooth * prior) / ((use & (names == k)).sum() + smooth) for k in np.unique(names[use])
        }
        rates.append(table(fold >= 0))
        # a row's own rate comes from the other folds, so that trees cannot read its label from it
        parts_of = [table(fold != f) for f in range(FOLDS)]
        own.append([parts_of[f].get(k, prior) for f, k in zip(fold, names)])
    x = np.array([empty.features(u) for u in urls], float)
    # one fold is learned without rates, so that trees know what to make of names that no label has
    x[:, -3:] = np.where((fold == 0)[:, None], prior, np.array(own).T)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    b = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    z, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        t = grow(b, p - y, p * (1 - p), bins, depth, 1.0, 20, rate)
        out.append(t)
        z += Model(prior, rates, cuts, [t], 0.0).sums(b)
    return Model(prior, rates, cuts, out, start)


def ruled(df: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """(url, bad) of the distinct URLs that the rules label."""

    def make():
        from stradale.llm.urls import label_of, split_url

        return lambda urls: [(label_of(*split_url(u), rules),) for u in urls]

    known = df.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("_text", F.col("url"))
    return map_texts(known, ["url"], "_text", make, "bad boolean").where("bad is not null")


def fit(df: DataFrame, label: str, url: str = "url", sample_urls: int = SAMPLE_URLS) -> Model:
    """Train on about `sample_urls` distinct URLs of a table with a boolean label (true: block)."""
    known = df.select(F.col(url).alias("url"), F.col(label).cast("boolean").alias("bad"))
    known = known.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad"))
    known = stored(df.sparkSession, known, "labelled-urls")
    n = known.count()
    u = F.pmod(F.xxhash64(F.lit(41), "url"), F.lit(1 << 20)) / float(1 << 20)
    rows = known.where(u < min(1.0, sample_urls / max(n, 1))).toPandas().sort_values("url")
    return train(rows.url.tolist(), rows.bad.tolist())


SCHEMA = "host string, path string, rule string, verdict string, p_block double"


def judge(df: DataFrame, model: Model, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per URL: host, path, rule, verdict, p_block. One Arrow pass, no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        from stradale.llm.urls import BLOCK_AT, rule_of, split_url

        m = sent.value

        def work(urls):
            out = []
            for u, p in zip(urls, m.scores(urls)):
                host, path = split_url(u)
                r = rule_of(host, path, rules)
                out.append((host, path, r[0] if r else None, r[1] if r else ("block" if p >= BLOCK_AT else "allow"), float(p)))
            return out

        return work

    return map_texts(df, [key], url, make, SCHEMA)
