"""Personal data: fixed patterns, and a skip-chain conditional random field over candidate tokens.

Base layer: four fixed patterns (email, ip, card, phone), each leftmost and not overlapping.

Method: the nodes of a text are its tokens with a digit or an `@` (others cannot be personal data
here). Labels are O and the four kinds. Unary potentials are linear in hashed features of a token's
shape, its check digits and its neighbours; chain edges join tokens that follow each other within a
few words; skip edges join each token with the previous one of equal digits or equal letters,
however far apart. Loopy sum-product passes give marginals. All potentials are learned together, by
gradient steps on the likelihood of the base layer's labels whose expected counts come from the same
passes, on a bounded sample of documents. Where base spans are known their tokens are held to them;
all other tokens are labelled by the field, whether or not a text has base spans. Tokens whose
marginal for a kind reaches THRESHOLD become spans of it, neighbours of one kind one span, unless
they overlap a base span or lack the digits of their kind: numbers that a base pattern lost in a
longer match, and values that are repeated in another form.

Defined cases: a null text counts as empty; rows repeated in the table get equal results; without
any labelled token in the sample only base spans are returned.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, ship

# --- fixed values: the base patterns --------------------------------------------------------------
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
# ---------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\s|]+")
DIGIT = re.compile("[0-9]")
NOT_DIGIT = re.compile("[^0-9]")
OUTER_LEFT, OUTER_RIGHT = "\"'[{<*#$%&", "\"'\\]}>.,;:!?*#$%&"
LABELS = ("O", *KINDS)
#: Bounds of the sample that is fitted on: documents with a token of the field, and tokens of one of them.
SAMPLE_DOCS, SAMPLE_TOKENS = 4000, 500
WIDTH = 1 << 12
ROUNDS = 16
THRESHOLD = 0.9
NEAR_WORDS = 2
#: Log potential of equal labels on a skip edge where the sample has nothing to learn it from.
AGREE = 13.0
#: Digits that a kind has at least and at most.
DIGITS = {"email": (0, 99), "ip": (4, 12), "card": (12, 19), "phone": (9, 15)}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four fixed patterns."""
    out = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            # the local part is the whole run of its characters before the @, back to the last match
            s = at = m.start()
            while s > free and text[s - 1] in LOCAL:
                s -= 1
            if s < at:
                out.append(("email", s, m.end()))
                free = m.end()
    for m in IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


class Graph:
    """The nodes of a text: spans, word numbers, base labels, features, and its edges.

    unsure: tokens whose missing label says nothing, as a base pattern took them into a longer match and dropped it.
    """

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        self.word: list[int] = []
        self.label: list[int] = []
        self.features: list[list[int]] = []
        self.unsure: list[bool] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        if not (DIGIT.search(text) or "@" in text):
            return
        spans = sorted(base, key=lambda x: (x[1], KINDS.index(x[0])))
        shapes, lefts, wholes = [], [], []
        left, at = "", 0
        for n, m in enumerate(TOKEN.finditer(text)):
            tok = m[0]
            if "@" in tok or DIGIT.search(tok):
                s = m.start() + len(tok) - len(tok.lstrip(OUTER_LEFT))
                e = m.end() - (len(tok) - len(tok.rstrip(OUTER_RIGHT)))
                if s < e:
                    while at < len(spans) and spans[at][2] <= s:
                        at += 1
                    inside = at < len(spans) and spans[at][1] < e
                    self.label.append(LABELS.index(spans[at][0]) if inside else 0)
                    wholes.append(text[spans[at][1] : spans[at][2]] if inside else text[s:e])
                    self.start.append(s)
                    self.end.append(e)
                    self.word.append(n)
                    shapes.append(shape(text[s:e]))
                    lefts.append(left)
            left = tok
        # what a base pattern matched but gave up for digits beyond its kind's: no label to learn from
        long = [(m.start(), m.start() + 24) for m in PHONE.finditer(text) if sum(c.isdigit() for c in m[0]) > 15] if "+" in text else []
        long.reverse()
        seen: dict[str, int] = {}
        for i, (s, e) in enumerate(zip(self.start, self.end)):
            tok = text[s:e]
            while long and long[-1][1] <= s:
                long.pop()
            joined = i > 0 and self.word[i] - self.word[i - 1] <= NEAR_WORDS
            if joined:
                self.chain.append((i - 1, i))
            digits = NOT_DIGIT.sub("", tok)
            number = NOT_DIGIT.sub("", wholes[i])  # of the base span that the token is in
            keys = ["d" + number] if len(number) >= 7 else []
            if "@" in tok:
                keys.append("t" + tok.lower())
            for k in keys:
                j = seen.get(k)
                if j is not None and not (joined and j == i - 1) and (not self.skip or self.skip[-1] != (j, i)):
                    self.skip.append((j, i))
                seen[k] = i
            near = lambda j, i=i: shapes[j] if 0 <= j < len(shapes) and abs(self.word[j] - self.word[i]) == 1 else "-"
            lost = 12 <= len(digits) <= 19 and luhn(digits) or bool(long) and long[-1][0] < e and s < long[-1][1]
            self.unsure.append(not self.label[i] and lost)
            self.features.append(places(tok, digits, shapes[i], near(i - 1), near(i + 1), lefts[i]))


def shape(tok: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", tok[:64]))[:24]


def places(tok: str, digits: str, own: str, before: str, after: str, left: str) -> list[int]:
    """Hashed feature numbers of a token."""
    n = len(digits)
    parts = tok.split(".")
    names = (
        "bias",
        "shape=" + own,
        f"digits={min(n, 24)}",
        f"check={luhn(digits) if 12 <= n <= 19 else '-'}",
        f"octets={all(p.isascii() and p.isdigit() and int(p[-4:]) <= 255 and len(p) < 4 for p in parts) if len(parts) == 4 else '-'}",
        f"at={'@' in tok and '.' in tok.rsplit('@', 1)[-1]}",
        f"plus={tok[:1] == '+'}",
        f"before={own}|{before}",
        f"after={own}|{after}",
        "left=" + re.sub("[0-9]+", "9", left.lower())[-8:],
    )
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % WIDTH for x in names]


class Field:
    """Several graphs side by side as arrays, and message passing on them."""

    def __init__(self, graphs: list[Graph]):
        first = np.cumsum([0, *(len(g.start) for g in graphs)])
        self.first = first
        self.features = np.array([f for g in graphs for f in g.features], np.int64).reshape(first[-1], -1)
        self.label = np.array([v for g in graphs for v in g.label], np.int64)
        self.unsure = np.array([v for g in graphs for v in g.unsure], bool)
        pick = lambda kind: np.array([(i + a, j + a) for g, a in zip(graphs, first) for i, j in getattr(g, kind)], np.int64).reshape(-1, 2)
        chain, skip = pick("chain"), pick("skip")
        self.n_chain = len(chain)
        self.edges = np.concatenate([chain, skip])
        self.src, self.dst = np.concatenate([self.edges[:, 0], self.edges[:, 1]]), np.concatenate([self.edges[:, 1], self.edges[:, 0]])
        self.msg = np.zeros((len(self.src), len(LABELS)))

    def gather(self, msg: np.ndarray) -> np.ndarray:
        out = np.zeros((self.first[-1], msg.shape[1]))
        for k in range(msg.shape[1]):
            out[:, k] = np.bincount(self.dst, msg[:, k], self.first[-1])
        return out

    def passes(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """(node marginals, log potentials of the edges in both directions) after some rounds; messages stay for a next call."""
        m, k = len(self.edges), self.n_chain
        pot = np.concatenate([np.broadcast_to(chain, (k, *chain.shape)), np.broadcast_to(skip, (m - k, *skip.shape))])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])  # [edge, source label, target label]
        back = np.concatenate([np.arange(m) + m, np.arange(m)])
        for r in range(rounds if m else 0):
            x = ((unary + self.gather(self.msg))[self.src] - self.msg[back])[:, :, None] + pot
            top = x.max(1, keepdims=True)
            new = np.log(np.exp(x - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            # the first rounds as they are, which is exact on short trees; then damped, against swinging loops
            self.msg = new if r < rounds // 2 else 0.5 * (self.msg + new)
        belief = unary + self.gather(self.msg) if m else unary
        return softmax(belief), pot

    def pairs(self, unary: np.ndarray, pot: np.ndarray) -> np.ndarray:
        """Marginals of the label pairs of the edges."""
        m = len(self.edges)
        cavity = unary + self.gather(self.msg)
        x = (cavity[self.edges[:, 0]] - self.msg[m:])[:, :, None] + pot[:m] + (cavity[self.edges[:, 1]] - self.msg[:m])[:, None, :]
        x = np.exp(x - x.max((1, 2), keepdims=True))
        return x / x.sum((1, 2), keepdims=True)


def softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Model:
    """Unary weights (WIDTH x labels) and log potentials of chain and skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    def marginals(self, field: Field, clamp: bool = True) -> np.ndarray:
        """Label marginals of all nodes; tokens of base spans are held to their labels."""
        u = self.unary[field.features].sum(1)
        if clamp:
            held = field.label > 0
            u[held] = np.where(np.arange(len(LABELS)) == field.label[held, None], 0.0, -30.0)
        field.msg[:] = 0
        return field.passes(u, self.chain, self.skip, ROUNDS)[0]

    def extra(self, texts: list[str], bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """Spans that the field adds to the base spans of each text."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        graphs = [Graph(t, b) for t, b in zip(texts, bases)]
        use = [i for i, g in enumerate(graphs) if 0 in g.label]
        if not use:
            return out
        field = Field([graphs[i] for i in use])
        p = self.marginals(field)
        best = np.where((field.label == 0) & (p.max(1) >= THRESHOLD), p.argmax(1), 0)
        for i, a, b in zip(use, field.first, field.first[1:]):
            if best[a:b].any():
                out[i] = runs(texts[i], graphs[i], best[a:b], bases[i])
        return out


def runs(text: str, g: Graph, best: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Neighbouring tokens of one kind as one span, if it has its kind's digits and overlaps no base span."""
    found: list[tuple[str, int, int]] = []
    last = -2
    for i in np.flatnonzero(best):
        kind = LABELS[best[i]]
        joined = kind in ("phone", "card") and last == i - 1 and g.word[i] == g.word[i - 1] + 1 and found[-1][0] == kind
        if joined and sum(c.isdigit() for c in text[found[-1][1] : g.end[i]]) <= DIGITS[kind][1] and text[g.start[i]] != "+":
            found[-1] = (kind, found[-1][1], g.end[i])
        else:
            found.append((kind, g.start[i], g.end[i]))
        last = i
    spans = sorted((a, b) for _, a, b in base)
    out, at = [], 0
    for kind, a, b in found:
        while at < len(spans) and spans[at][1] <= a:
            at += 1
        n = sum(c.isdigit() for c in text[a:b])
        if DIGITS[kind][0] <= n <= DIGITS[kind][1] and not (at < len(spans) and spans[at][0] < b):
            out.append((kind, a, b))
    return out


def train(graphs: list[Graph], steps: int = 150, rate: float = 0.1, ridge: float = 1e-4, hidden: float = 0.5) -> Model:
    """Fit all potentials together: gradient steps on the likelihood of the base labels, expectations by message passing.

    Every graph takes part twice, the second time with a share of its features hidden: where a token's
    own features say all, edges have nothing left to explain and would be learned as nothing.
    """
    n = len(LABELS)
    w, pots = np.zeros((WIDTH, n)), [np.zeros((n, n)), np.zeros((n, n))]
    graphs = [g for g in graphs if g.start]
    field = Field(graphs + graphs)
    y = field.label
    if not (y > 0).any():
        w[:, 0] = 1.0  # nothing to learn from: all tokens are O
        return Model(w, *pots)
    used, inv = np.unique(field.features, return_inverse=True)
    inv = inv.reshape(field.features.shape)
    show = np.ones(inv.shape)
    rng = np.random.default_rng(31)
    hide = rng.random((len(y) // 2, 1)) < hidden  # all features but the bias
    show[len(y) // 2 :, 1:] -= hide & (rng.random((len(y) // 2, inv.shape[1] - 1)) < 0.9)
    want = np.eye(n)[y]
    ends = field.edges
    seen = want[ends[:, 0]][:, :, None] * want[ends[:, 1]][:, None, :]
    open_end = field.unsure[ends].any(1)[:, None, None]
    theta = np.zeros(len(used) * n + 2 * n * n)
    prior = np.concatenate([theta[: -n * n], AGREE * np.eye(n).reshape(-1)])  # the weights' mean before any label
    theta = prior.copy()
    m = v = np.zeros_like(theta)
    k, cut = field.n_chain, len(used) * n
    for t in range(1, steps + 1):
        own = theta[:cut].reshape(-1, n)
        u = (own[inv] * show[:, :, None]).sum(1)
        chain, skip = theta[cut:].reshape(2, n, n)
        p, pot = field.passes(u, chain, skip, 3)  # goes on from the last step's messages
        miss = np.where(field.unsure[:, None], 0.0, want - p)
        g = np.zeros((len(used), n))
        for j in range(n):
            g[:, j] = np.bincount(inv.reshape(-1), (miss[:, j, None] * show).reshape(-1), len(used))
        both = np.where(open_end, 0.0, seen - field.pairs(u, pot)) if len(ends) else np.zeros((0, n, n))
        grad = np.concatenate([g.reshape(-1), both[:k].sum(0).reshape(-1), (both[k:].sum(0) + both[k:].sum(0).T).reshape(-1) / 2])
        grad = grad / len(y) - ridge * (theta - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    w[used] = theta[:cut].reshape(-1, n)
    chain, skip = theta[cut:].reshape(2, n, n)
    return Model(w, chain, skip)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Train on about `sample_docs` documents with a token of the field, chosen by a hash of the key."""
    ship(df.sparkSession)
    some = df.where(F.col(text).rlike("[0-9@]"))
    n = some.count()
    u = F.pmod(F.xxhash64(F.lit(29), F.col(key).cast("string")), F.lit(1 << 20)) / float(1 << 20)

    def make():
        import pickle

        from stradale.llm.pii import SAMPLE_TOKENS, Graph, base_spans

        def work(texts):
            graphs = (Graph(t, base_spans(t)) for t in texts)
            return [(pickle.dumps(g) if 0 < len(g.start) <= SAMPLE_TOKENS else None,) for g in graphs]

        return work

    import pickle

    sample = map_texts(some.where(u < min(1.0, sample_docs / max(n, 1))), [key], text, make, "graph binary")
    rows = sample.where("graph is not null").toPandas().sort_values(key, kind="stable")
    return train([pickle.loads(g) for g in sorted(rows.graph)] if rows[key].isna().any() else [pickle.loads(g) for g in rows.graph])


def scan_all(texts: list[str | None], model: Model | None) -> list[tuple]:
    """n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans of each text."""
    order = lambda x: (x[1], KINDS.index(x[0]))
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    whole = [t or "" for t in texts]
    bases = [sorted(base_spans(t), key=order) for t in whole]
    more = model.extra(whole, bases) if model else [[] for _ in whole]
    out = []
    for base, extra in zip(bases, more):
        count = Counter(k for k, _, _ in base)
        said = show(base)
        spans = show(sorted(base + extra, key=order)) if extra else said
        out.append((*(count[k] for k in KINDS), hashlib.sha256(said.encode()).hexdigest(), spans, len(extra), len(base) + len(extra)))
    return out


def scan(text: str | None, model: Model | None) -> tuple:
    """The row of one text."""
    return scan_all([text], model)[0]


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def find_personal_data(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its spans. One Arrow pass, no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        from stradale.llm.pii import scan_all

        m = sent.value
        return lambda texts: scan_all(texts, m)

    return map_texts(df, [key], text, make, SCHEMA)
