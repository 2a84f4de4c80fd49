"""Secret scan by assignment-aware lexing.

Two layers. The base layer is three fixed patterns. The method's layer lexes a text as source or
configuration (`name = "literal"`, `name: literal`, `"name": "literal"`, `name => literal`,
`export NAME=literal`, `name = other_name`, `name = "a" + "b"`), keeps a symbol table, propagates
constants through copies and concatenations, and scores each literal by how sensitive the names
are that it reaches. Literals that reach the threshold become `named` spans, whether or not the base
layer has found them too: a base `assign` span holds the name, a `named` one the literal alone.

The lexer goes from operator to operator and reads the name before and the value behind each, so
that its time is linear in the text. Literals are quoted by one or three marks, or bare. A literal
counts by its length, entropy and classes of characters; one without digits counts only if it is
quoted and its name as good as says that it is a secret.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows get equal
results; a name bound twice holds its latest literal.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import map_texts

# --- fixed values -------------------------------------------------------------------------------
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same matches as runs filtered by length
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "named")
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "passcode": 3, "pass": 2.5, "pwd": 3, "pw": 2.5, "secret": 3, "token": 2.5, "apikey": 3,
    "privatekey": 3, "accesskey": 3, "secretkey": 3, "authkey": 3, "signingkey": 3, "encryptionkey": 3,
    "credential": 2.5, "credentials": 2.5, "bearer": 2.5, "auth": 1.5, "authorization": 2, "connectionstring": 2,
    "salt": 1, "key": 1,
}
PLACEHOLDERS = {"changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "yourpassword", "xxxxxxxx"}
# ------------------------------------------------------------------------------------------------

#: What binds a value to a name; `==`, `::` and comparisons do not.
OPERATOR = re.compile(r"(?<![=:!<>+*/%^|&~-])(?::=|=>|=(?![=~])|:(?![:=]))(?=[\x20\t]*[\"'`A-Za-z0-9+/_.=$~@!%^&*-])")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
BLANK = frozenset("\x20\t")
MARKS = frozenset("\"'`")
SPACE = re.compile(r"[\x20\t]*+")
LITERAL = re.compile(r'''"{3}(?P<a>.*?)"{3}|\'{3}(?P<b>.*?)\'{3}|"(?P<c>(?:[^"\\\n]|\\.)*+)"|\'(?P<d>(?:[^\'\\\n]|\\.)*+)\'|`(?P<e>[^`\n]*+)`''', re.S)
BARE = re.compile(r"[A-Za-z0-9+/_.=$~@!%^&*-]+")
PLUS = re.compile(r"[\x20\t]*+(?:\+|\.\.)[\x20\t]*+")
#: Weight of a name from which a quoted literal without digits may be a secret.
PLAIN = 2.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three fixed patterns, each kind leftmost and not overlapping."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def sensitivity(name: str) -> float:
    """Weight of a target name: its words and adjacent pairs of words, looked up in SENSITIVE."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    best = 0.0
    for i, w in enumerate(words):
        best = max(best, SENSITIVE.get(w, 0), SENSITIVE.get(w + words[i + 1], 0) if i + 1 < len(words) else 0)
    return best


def strength(literal: str, plain: bool = False) -> float:
    """How much a literal looks like a secret, 0 to 1: length, entropy and mixture of classes.

    plain: one without digits or of one class of letters counts as well.
    """
    if len(literal) < 8 or literal.lower().strip("<>{}$%") in PLACEHOLDERS:
        return 0.0
    if re.match(r"(?:\$\{|\{\{|<|%\(|https?://|\./|/)", literal) or len(set(literal)) < 5 or " " in literal:
        return 0.0
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if not plain and (classes < 2 or not re.search("[0-9]", literal)):
        return 0.0
    return min(1.0, entropy(literal) / 3.5)


def name_before(text: str, at: int, since: int) -> str:
    """The name that ends before `at`, blanks and a closing mark left out; not before `since`."""
    while at > since and text[at - 1] in BLANK:
        at -= 1
    if at > since and text[at - 1] in MARKS:
        at -= 1
    end = at
    while at > since and text[at - 1] in NAME_CHARS:
        at -= 1
    name = text[at:end].strip(".-")
    return name if name and not name[0].isdigit() else ""


def pairs(text: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The lexed bindings: a name and its value, which is one literal or several that are joined (text, start, end)."""
    out = []
    since = at = 0  # nothing before belongs to a further name; where the search goes on
    while m := OPERATOR.search(text, at):
        name = name_before(text, m.start(), since)
        if not name:
            since = at = m.end()
            continue
        at, parts, bare = SPACE.match(text, m.end()).end(), [], None
        while True:
            if lit := LITERAL.match(text, at):
                a, b = lit.span(lit.lastgroup)
                parts.append((text[a:b], a, b))
                at = lit.end()
            elif bare := BARE.match(text, at):
                word = bare[0].rstrip(".,;!")
                if not word:
                    break
                parts.append((word, at, at + len(word)))
                at += len(word)
            else:
                break
            if not (plus := PLUS.match(text, at)):
                break
            at = plus.end()
        if parts:
            out.append((name, parts))
        # a bare value may be the next name, as in `a: b = "c"`
        since = parts[0][1] if len(parts) == 1 and bare else max(at, m.end())
        at = max(at, m.end())
    return out


def named_spans(text: str, threshold: float = 1.5) -> list[tuple[str, int, int]]:
    """Literals whose best target name, through propagated copies, makes them a secret.

    A binding knows the bindings it copies from; weights go back along these from the last binding to
    the first, each taken once, so that long chains of copies cost no more than their number.
    """
    if "=" not in text and ":" not in text:
        return []
    quoted = lambda s: s > 0 and text[s - 1] in MARKS
    last: dict[str, int] = {}  # the latest binding of a name
    weights: list[float] = []
    sources: list[list[int]] = []
    held: list[list[tuple[str, int, int]]] = []
    for name, parts in pairs(text):
        weights.append(sensitivity(name))
        sources.append([last[w] for w, s, _ in parts if not quoted(s) and w in last])
        # the joined value of a concatenation counts, the span is that of each part; names that are bound are no literals
        value = "".join(p[0] for p in parts)
        held.append([(value, s, e) for w, s, e in parts if quoted(s) or not sources[-1]])
        last[name] = len(weights) - 1
    best: dict[tuple[int, int], float] = {}
    for i in range(len(weights) - 1, -1, -1):
        w = weights[i]
        for j in sources[i]:
            weights[j] = max(weights[j], w)
        if w and held[i]:
            strong = [strength(held[i][0][0], plain) for plain in (False, w >= PLAIN)]  # all parts have the joined value
            for _, a, b in held[i]:
                best[a, b] = max(best.get((a, b), 0.0), w * strong[quoted(a)])
    return [("named", a, b) for (a, b), x in sorted(best.items()) if x >= threshold and b > a]


def scan(text: str | None, threshold: float = 1.5) -> tuple:
    """n_assign, n_access, n_hex, base_sha256, spans, n_named of one text."""
    text = text or ""
    base = sorted(base_spans(text), key=lambda x: (x[1], KINDS.index(x[0])))
    count = Counter(k for k, _, _ in base)
    extra = named_spans(text, threshold)
    show = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    said = show(base)
    every = sorted(base + extra, key=lambda x: (x[1], KINDS.index(x[0]))) if extra else base
    return count["assign"], count["access"], count["hex"], hashlib.sha256(said.encode()).hexdigest(), show(every), len(extra)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 1.5) -> DataFrame:
    """One row per document with its secret spans. One Arrow pass, no shuffle."""

    def make():
        from stradale.llm.secrets import scan

        return lambda texts: [scan(t, threshold) for t in texts]

    return map_texts(df, [key], text, make, SCHEMA)


def redact(text: str | None, spans: str, mark: str = "[SECRET]") -> str | None:
    """The text with every span of a `spans` string replaced; overlapping spans merge."""
    if not text or not spans:
        return text
    merged: list[list[int]] = []
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
