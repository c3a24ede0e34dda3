"""Token counts by a compiled finite-state transducer (piece model with byte fallback).

``TokenTransducer`` compiles the vocabulary and merge order of a BPE piece model
into a deterministic transducer over characters.  Its states remember, for the
last few characters that may still become part of a longer piece, the last token
of the encoding of every prefix that ends there; a transition is annotated with
the change of the token count.  The step rule is the pair test: the encoding of a
prefix ends in the one piece ``t`` for which the encoding of (last token before
``t``) + ``t`` is exactly these two pieces.  States and transitions are made on
first use and kept, so a text costs one table look-up per character, and one per
word for words seen before (a word's state map from the reset state is constant).

A blank that follows another character always starts a new piece (checked when the
model is compiled), and characters outside the vocabulary become byte tokens, so
both reset the transducer.  A chunk of text therefore has the state map
``(head, count, tail)``: the text before its first reset, the tokens of its inside,
and the text after its last reset.  ``combine`` is associative; long texts are cut
into chunks whose maps are composed pairwise as in a prefix scan.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows are kept
one to one (repeated rows and ids as well); an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from fewlabel.llm.common import map_texts, pick, text_list

BLANK = "▁"
CHUNK_CHARS = 1 << 16
#: Words longer than this are run through the transducer without being kept.
LONG_WORD = 64
#: Entries of the per-worker tables (words, transitions); a full table starts afresh.
TABLE_ENTRIES = 600_000
MAX_TOKENS = 4096
INF = float("inf")


def read_pieces(model_path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and types (1 normal, 3 control, 6 byte) of a piece model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model_path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if m.trainer_spec.model_type != 2 or n.name != "identity" or not n.add_dummy_prefix or n.remove_extra_whitespaces:
        raise ValueError("only BPE models with identity normalisation and a dummy prefix are compiled")
    return [p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces]


class TokenTransducer:
    START = ("", (None,), (0,), (False,))

    def __init__(self, model_path: str):
        pieces, scores, types = read_pieces(model_path)
        if any(t not in (1, 2, 3, 6) for t in types) or not any(t == 6 for t in types):
            raise ValueError("only normal pieces and byte fallback are compiled")
        self.score = {p: s for p, s, t in zip(pieces, scores, types) if t == 1}
        if any(BLANK in p.lstrip(BLANK) or (p[0] == BLANK and p[:2] == BLANK * 2 and p.strip(BLANK)) for p in self.score):
            raise ValueError("a piece goes on over a blank")
        self.known = {p for p in self.score if len(p) == 1}
        self.prefixes = {p[:i] for p in self.score for i in range(1, len(p) + 1)}
        self._pair: dict[tuple[str, str], bool] = {}
        self._edges_of: dict[int, dict] = {0: {}, -1: {}}
        self._ids = {self.START: 0}
        self._states = [self.START]
        self._next: list[dict] = [{}]
        self._edges = 0
        self._compile_runs()
        this = self

        class Words(dict):
            def __missing__(self, word):
                n = this.word(word)
                if len(word) <= LONG_WORD:
                    if len(self) >= TABLE_ENTRIES:
                        self.clear()
                    self[word] = n
                return n

        self.words = Words()
        self.word_count = self.words.__getitem__

    # -- merge order -------------------------------------------------------

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """The pieces of a short text: the best pair joins first, the left one of equals."""
        parts, score = list(text), self.score
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compile_runs(self) -> None:
        """Runs of blanks: all their pieces have one score, so they join from the left; the count has a period."""
        self.period = max(len(p) for p in self.score if not p.strip(BLANK))
        self.runs = [len(self.merged(BLANK * k)) for k in range(4 * self.period + 1)]
        self.runs[0] = 0
        if any(self.run(k) != n for k, n in enumerate(self.runs)):
            raise ValueError("the blanks of this model are not periodic")

    def run(self, k: int) -> int:
        return k // self.period + self.runs[k % self.period]

    # -- transducer --------------------------------------------------------

    def _rank(self, t: str) -> float:
        """When a piece is made: characters are there from the start."""
        return -INF if len(t) == 1 else -self.score[t]

    def _edge(self, t: str, side: int) -> list[tuple[str, float, float]] | None:
        """The parts of piece ``t`` that lie at its left (0) or right (-1) edge while it is made, each with
        the times from and to which it is there; None if merging never makes ``t``."""
        got = self._edges_of[side].get(t, ())
        if got != ():
            return got
        out, x, end = [], t, INF
        while x is not None:
            out.append((x, self._rank(x), end))
            end = self._rank(x)
            if len(x) == 1:
                break
            halves = self._halves(x)
            x = halves[side] if halves else None
        self._edges_of[side][t] = got = out if x is not None else None
        return got

    def _halves(self, t: str) -> list[str] | None:
        """The two pieces that the last merge joins to ``t``."""
        parts = self.merged(t, stop=2)
        return parts if len(parts) == 2 and self.merged(t) == [t] else None

    def _fits(self, left: str | None, t: str) -> bool:
        """Whether ``left`` + ``t`` is encoded as just these: no two parts that meet at the seam make a piece
        before one of them is merged away on its own side."""
        mine = self._edge(t, 0)
        if mine is None or left is None:
            return mine is not None
        ok = self._pair.get((left, t))
        if ok is None:
            ok = True
            for x, x0, x1 in self._edge(left, -1):
                for y, y0, y1 in mine:
                    if x0 < y1 and y0 < x1 and x + y in self.score:
                        at = -self.score[x + y]
                        if at < x1 and at <= y1:
                            ok = False
            if len(self._pair) >= TABLE_ENTRIES:
                self._pair.clear()
            self._pair[left, t] = ok
        return ok

    def _step(self, state: int, c: str) -> tuple[int, int]:
        u, last, rel, bare = self._states[state]
        v = u + c
        for j in range(len(v)):  # the longest piece first; just one fits
            t = v[j:]
            if t in self.score and self._fits(last[j], t):
                break
        else:
            raise ValueError(f"no encoding of {v!r}")
        delta = rel[j] + 1
        first = t == BLANK if last[j] is None else bare[j]
        last, bare = (*last, t), (*bare, first)
        rel = (*(r - delta for r in rel), 0)
        k = 0
        while k < len(v) and v[k:] not in self.prefixes:
            k += 1
        key = (v[k:], last[k:], rel[k:], bare[k:])
        to = self._ids.get(key)
        if to is None:
            to = self._ids[key] = len(self._states)
            self._states.append(key)
            self._next.append({})
        return to, delta

    def _reset_tables(self) -> None:
        self._ids, self._states, self._next, self._edges = {self.START: 0}, [self.START], [{}], 0

    def segment(self, text: str) -> tuple[int, bool]:
        """Tokens of a text of known characters without inner blanks; whether its first token is a bare blank."""
        if self._edges > TABLE_ENTRIES:
            self._reset_tables()
        at, n, nexts = 0, 0, self._next
        for c in text:
            got = nexts[at].get(c)
            if got is None:
                got = nexts[at][c] = self._step(at, c)
                self._edges += 1
            at, d = got
            n += d
        return n, self._states[at][3][-1]

    def _unit(self, word: str) -> tuple[int, bool]:
        """One blank and ``word`` (no blanks inside): tokens, and whether the blank stays alone."""
        text, n, first, begin = BLANK + word, 0, None, 0
        known = self.known
        for i, c in enumerate(text):
            if c not in known:
                if i > begin:
                    k, bare = self.segment(text[begin:i])
                    n += k
                    first = bare if first is None else first
                n += len(c.encode("utf-8"))
                begin = i + 1
        if begin < len(text):
            k, bare = self.segment(text[begin:])
            n += k
            first = bare if first is None else first
        return n, bool(first)

    def word(self, word: str) -> int:
        return self._unit(word)[0]

    def _units(self, text: str) -> int:
        """Tokens of a text that starts with a blank."""
        parts = text.split(" ")[1:]
        if "" not in parts:
            return sum(map(self.word_count, parts))
        n = k = 0
        for w in parts:
            k += 1
            if w:
                if k == 1:
                    n += self.word_count(w)
                else:
                    m, bare = self._unit(w)
                    n += m - 1 + self.run(k) if bare else m + self.run(k - 1)
                k = 0
        return n + self.run(k)

    # -- chunk state maps --------------------------------------------------

    def chunk_map(self, text: str) -> tuple[str, int, str] | str:
        """The state map of a chunk: (head, tokens inside, tail), or the chunk itself if nothing in it resets."""
        first = _reset(text, 0)
        if first < 0:
            return text
        last = _last_reset(text)
        return text[:first], self._units(text[first:last]) if last > first else 0, text[last:]

    def combine(self, a, b):
        """State map of two neighbouring chunks (associative)."""
        if isinstance(a, str) and isinstance(b, str):
            return self.chunk_map(a + b)
        if isinstance(a, str):
            m = self.chunk_map(a + b[0])
            if isinstance(m, str):
                return m, b[1], b[2]
            head, n, tail = m
            return head, n + self._units(tail) + b[1], b[2]
        if isinstance(b, str):
            m = self.chunk_map(a[2] + b)
            if isinstance(m, str):
                return a[0], a[1], m
            head, n, tail = m
            return a[0], a[1] + self._units(head) + n, tail
        m = self.chunk_map(a[2] + b[0])
        if isinstance(m, str):
            return a[0], a[1] + self._units(m) + b[1], b[2]
        head, n, tail = m
        return a[0], a[1] + self._units(head) + n + self._units(tail) + b[1], b[2]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        if len(text) <= chunk:
            return self._units(" " + text)
        text = " " + text
        maps = [self.chunk_map(text[i:i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:
            maps = [self.combine(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        if isinstance(m, str):
            return self._units(m)
        return (self._units(m[0]) if m[0] else 0) + m[1] + self._units(m[2])


def _reset(text: str, begin: int) -> int:
    """The first blank from ``begin`` on that follows another character, or -1."""
    i = text.find(" ", max(begin, 1))
    while i > 0 and text[i - 1] == " ":
        i = text.find(" ", i + 1)
    return i


def _last_reset(text: str) -> int:
    i = text.rfind(" ", 1)
    while i > 0 and text[i - 1] == " ":
        i = text.rfind(" ", 1, i)
    return i


_compiled: dict[str, TokenTransducer] = {}


def transducer(model_path: str) -> TokenTransducer:
    """One transducer per worker process and model."""
    if model_path not in _compiled:
        _compiled[model_path] = TokenTransducer(model_path)
    return _compiled[model_path]


def token_counts(docs: DataFrame, model_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row's whole text.

    No shuffle: a narrow map over the rows.  ``model_path`` is a path that every
    executor can open (an installed package's file).
    """

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        t = transducer(model_path)
        texts = text_list(b.column("text"))
        tokens = [t.count(x) for x in texts]
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x.encode("utf-8")) for x in texts], pa.int64()),
             pa.array(tokens, pa.int64()), pa.array([n > max_tokens for n in tokens], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_texts(pick(docs, doc_id="bigint", text="string"), count,
                     "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
