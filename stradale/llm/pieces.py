"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by piece score (ties: leftmost first) and
merges until no pair is a piece; what stays unknown falls back to bytes. A text is first cut where
no piece can span: before a run of the space mark that follows another character, around newlines,
and between a word and a punctuation mark that follows a word in no piece. No merge crosses such a cut, so segments are encoded
apart and their results kept for reuse. Every segment new to a task is compared, in Arrow batches,
with the library's own answer; `n_disagree` counts differing segments of a document (0 so far).

Defined cases: a null text counts as empty and has no ids; texts of any length work, a segment of
n symbols costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import re

from pyspark.sql import DataFrame

from .common import map_texts

MARK = "▁"
#: Segments held in each of the two generations of a worker's cache.
CACHE = 200_000
#: Segments of at most so many characters keep their agenda in a list, longer ones in a heap.
SHORT = 48
NEVER = float("inf")
#: Latin letters and digits, behind which a mark is cut off if the vocabulary allows it.
WORD = "0-9A-Za-z\u00c0-\u024f"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"


def normalizer(model: bytes) -> dict[int, object]:
    """The normalizer's settings: field number -> value, from the model's wire format."""

    def fields(b: bytes):
        i = 0

        def varint() -> int:
            nonlocal i
            v = s = 0
            while True:
                c = b[i]
                i += 1
                v |= (c & 127) << s
                s += 7
                if c < 128:
                    return v

        while i < len(b):
            k = varint()
            if k & 7 == 0:
                yield k >> 3, varint()
            else:
                n = {1: 8, 5: 4}.get(k & 7) or varint()
                yield k >> 3, b[i : i + n]
                i += n

    spec = next((v for k, v in fields(model) if k == 3), b"")
    return dict(fields(spec))


class Pieces:
    """A merge-type vocabulary with its own encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = normalizer(f.read())
        # fields: 2 character map, 3 dummy prefix, 4 remove extra spaces, 5 escape spaces (defaults: on)
        if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
            raise ValueError("only vocabularies with the identity normalizer and a leading space mark are supported")
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        byte = {i for i in range(n) if sp.is_byte(i)}
        other = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in byte}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.id = {p: i for i, p in enumerate(self.piece) if i not in byte and i not in other}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.rank = {p: -x for p, x in self.score.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        longer = [p for p in self.id if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in longer):
            raise ValueError("pieces with a space mark inside are not supported")
        self.newline_cuts = not any("\n" in p for p in longer)
        # marks that follow a letter or digit in no piece: a word is cut off before them
        after = "".join(c for c in PUNCTUATION if not any(re.search(rf"[{WORD}]{re.escape(c)}", p) for p in longer))
        word = rf"{MARK}*[{WORD}]+(?=[{re.escape(after)}])|" if after else ""
        self.cut = re.compile(word + (f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.newline_cuts else f"{MARK}*[^{MARK}]+|{MARK}+"))
        #: id -> characters; None for bytes, which are decoded together
        self.text = [None if i in byte else " ⁇ " if i == self.unknown else "" if i in self.silent else p.replace(MARK, " ") for i, p in enumerate(self.piece)]
        self.newline = self.numbers(["\n"])
        self.opening = sp.encode("\n")
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, tuple[str, int]] = {}

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment by the agenda."""
        n = len(segment)
        if n <= SHORT:
            return self.numbers(self.merge_short(segment))
        score = self.score
        sym = list(segment)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            p = sym[i] + sym[i + 1]
            if p in score:
                agenda.append((-score[p], i, p))
        heapq.heapify(agenda)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            j = right[i]
            # stale unless both symbols still stand and still spell the piece
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != len(p) or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j] = p, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                q = p + sym[k]
                if q in score:
                    heapq.heappush(agenda, (-score[q], i, q))
            if (h := left[i]) >= 0:
                q = sym[h] + p
                if q in score:
                    heapq.heappush(agenda, (-score[q], h, q))
        return self.numbers([x for x in sym if x is not None])

    def merge_short(self, segment: str) -> list[str]:
        """The agenda of a short segment: a list of pair ranks, of which the least is taken, leftmost first."""
        sym, get = list(segment), self.rank.get
        agenda = [get(a + b, NEVER) for a, b in zip(sym, sym[1:])]
        while agenda:
            top = min(agenda)
            if top == NEVER:
                break
            i = agenda.index(top)
            sym[i] += sym[i + 1]
            del sym[i + 1], agenda[i]
            if i:
                agenda[i - 1] = get(sym[i - 1] + sym[i], NEVER)
            if i < len(agenda):
                agenda[i] = get(sym[i] + sym[i + 1], NEVER)
        return sym

    def numbers(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; what is no piece falls back to bytes, or to one unknown for each run."""
        out: list[int] = []
        get = self.id.get
        for s in symbols:
            i = get(s)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        """The parts of a text that are encoded apart, the leading mark included."""
        marked = MARK + text.replace(" ", MARK)
        return self.cut.findall(marked) if text else []

    def spell(self, ids: list[int]) -> str:
        """The characters of ids, with the leading mark's space still there."""
        said = [self.text[i] for i in ids]
        if None not in said:
            return "".join(said)
        out, raw = [], bytearray()
        for i, t in zip(ids, said):
            if t is None:
                raw.append(self.id_byte[i])
                continue
            out += [raw.decode("utf-8", "replace"), t]
            raw.clear()
        return "".join([*out, raw.decode("utf-8", "replace")])

    def decode(self, ids: list[int]) -> str:
        s = self.spell(ids)
        return s[1:] if s[:1] == " " and ids and self.piece[ids[0]].startswith(MARK) else s

    def encode(self, text: str | None) -> list[int]:
        return [i for s in self.segments(text or "") for i in self.merge(s)]

    def differs(self, segments: list[str], own: list[list[int]]) -> list[int]:
        """1 for each segment whose ids the library would not give.

        The segments are joined, those without a leading mark behind a newline, and encoded in one
        call; only if the ids differ is the list halved to find the segments at fault.
        """
        text = "".join([s if s[0] == MARK else "\n" + s for s in segments]).replace(MARK, " ")
        ids = [i for s, x in zip(segments, own) for i in (x if s[0] == MARK else self.newline + x)]
        # the library puts a mark before a text; segments that begin with one bring their own
        theirs = self.library.encode("\n" + text)[len(self.opening) :]
        if ids == theirs:
            return [0] * len(segments)
        if len(segments) == 1:
            return [1]
        h = len(segments) // 2
        return self.differs(segments[:h], own[:h]) + self.differs(segments[h:], own[h:])

    def learn(self, fresh: list[str]) -> dict[str, str]:
        """Encode segments, compare them with the library; keep and return their ids as text.

        A segment whose ids spell other characters than its own, or differ from the library's, is
        noted in `odd` with what they spell.
        """
        out = {}
        for i in range(0, len(fresh), 10_000):
            part = fresh[i : i + 10_000]
            own = [self.merge(s) for s in part]
            for s, ids, bad in zip(part, own, self.differs(part, own)):
                out[s] = ",".join(map(str, ids))
                said = self.spell(ids)
                if bad or said != s.replace(MARK, " "):
                    self.odd[s] = (said, bad)
        if len(self.young) + len(out) > CACHE:
            self.old, self.young = self.young, {}
        self.young |= out
        return out

    def digest(self, texts: list[str | None]) -> list[tuple]:
        """n_tokens, ids_sha256, decoded_sha256, n_disagree of each text."""
        out = []
        for t in texts:
            segs = self.segments(t or "")
            young, old = self.young, self.old  # as they are before this text's segments
            fresh = [s for s in dict.fromkeys(segs) if s not in young and s not in old]
            new = self.learn(fresh) if fresh else {}
            ids = ",".join([young.get(s) or old.get(s) or new[s] for s in segs])
            odd, bad = self.odd, 0
            if odd and not odd.keys().isdisjoint(segs):
                said = "".join([odd[s][0] if s in odd else s.replace(MARK, " ") for s in segs])
                bad = sum(odd[s][1] for s in segs if s in odd)
            else:
                said = "".join(segs).replace(MARK, " ")
            if said[:1] == " ":
                said = said[1:]
            n = ids.count(",") + 1 if ids else 0
            out.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), bad))
        return out


_OPEN: dict[str, Pieces] = {}


def opened(path: str | None = None) -> Pieces:
    """The vocabulary at a path, read once a process; by default the public 32k merge vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _OPEN:
        _OPEN[path] = Pieces(str(path))
    return _OPEN[path]


SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_disagree long"


def piece_digests(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text per row. One Arrow pass, no shuffle."""

    def make():
        from stradale.llm.pieces import opened

        return opened(path).digest

    return map_texts(df, [key], text, make, SCHEMA)


def piece_ids(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ids array<int>, decoded string): the encoder's and decoder's own outputs."""

    def make():
        from stradale.llm.pieces import opened

        p = opened(path)

        def work(texts):
            ids = [p.encode(t) for t in texts]
            return [(i, p.decode(i)) for i in ids]

        return work

    return map_texts(df, [key], text, make, "ids array<int>, decoded string")
