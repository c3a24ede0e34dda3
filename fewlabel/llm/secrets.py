"""Secret scan: fixed patterns plus sliding-window Shannon entropy over candidate strings.

Base spans (kept as they are): ``assign`` (a keyword, ``:`` or ``=``, a value of 12
or more characters), ``access`` (``AKIA...`` of 18 or more) and ``hex`` (16 or more);
leftmost, non-overlapping per kind.

Entropy spans: a candidate string is a run of 20 or more key characters.  Inside it,
every run of 20 or more characters of one class (hex digits; base32; lower- or upper-case
letters and digits; base64, plain or URL-safe) is scanned by a window that moves one
character at a time; a run shorter than the class's window is one window, and the least
entropy falls with the logarithm of the window's length.  The counts change by one
character in and one out, and with them
``S = sum c * log2 c``, so that the window's entropy ``log2 w - S / w`` costs O(1) per
step.  Windows at or above the class threshold are merged into one span, whatever the
class.  The thresholds lie about two and a half deviations under the mean of random
strings of the class's alphabet.  Candidates that match the allow-list (by default plain
words, numbers, UUIDs, paths of words and numbers) are passed over, and so are runs of
letters alone in the classes of one case.

Defined results: null and empty texts have no spans; rows are kept one to one
(repeated rows too); an empty table gives an empty table; extra columns are ignored.
Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fewlabel.llm.common import importable, map_texts, pick, text_list, tidy

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")

#: Least length of a candidate and of a run in it.
SHORTEST = 20
#: class name, its characters, window length, least entropy in bits of a window.
CLASSES = (("hex", r"[0-9a-fA-F]+", 20, 3.0), ("base32", r"[A-Z2-7]+", 24, 3.35), ("base36", r"[a-z0-9]+|[A-Z0-9]+", 24, 3.45),
           ("base64", r"[A-Za-z0-9+/_-]+", 24, 3.8))
#: Classes in which letters alone are words.
ONE_CASE = ("base32", "base36")
#: Candidates that are no secrets whatever their entropy.
ALLOW = (
    r"[A-Za-z]+", r"[0-9]+", r"([A-Za-z]+|[0-9]+)([_/=+-]+([A-Za-z]+|[0-9]+))*[_/=+-]*",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[-_=+/]+",
)


def entropy_windows(text: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``window`` characters with at least ``least`` bits."""
    if len(text) < window:
        return []
    xlog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    top = window * (math.log2(window) - least) + 1e-9
    counts: dict[str, int] = {}
    for ch in text[:window]:
        counts[ch] = counts.get(ch, 0) + 1
    s = sum(xlog[c] for c in counts.values())
    spans: list[tuple[int, int]] = []
    for i in range(len(text) - window + 1):
        if i:
            out, come = text[i - 1], text[i + window - 1]
            if out != come:
                c = counts[out]
                s += xlog[c - 1] - xlog[c]
                counts[out] = c - 1
                c = counts.get(come, 0)
                s += xlog[c + 1] - xlog[c]
                counts[come] = c + 1
        if s <= top:
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + window)
            else:
                spans.append((i, i + window))
    return spans


class Scanner:
    def __init__(self, classes=CLASSES, allow=ALLOW):
        self.classes = [(re.compile(p), w, e, name in ONE_CASE) for name, p, w, e in classes]
        self.allow = re.compile("|".join(f"(?:{p})" for p in allow)) if allow else None

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans by start, then kind, then end."""
        found: list[tuple[int, int, int]] = []
        low = text.lower()
        if "passw" in low or "secret" in low or "token" in low or "api" in low:
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        for m in _CANDIDATE.finditer(text):
            if self.allow and self.allow.fullmatch(m[0]):
                continue
            got: list[tuple[int, int]] = []
            for chars, window, least, one_case in self.classes:
                for r in chars.finditer(m[0]):
                    if len(r[0]) >= SHORTEST and not (one_case and r[0].isalpha()):
                        w = min(window, len(r[0]))
                        at = m.start() + r.start()
                        got += [(at + a, at + b) for a, b in entropy_windows(r[0], w, least * math.log2(w) / math.log2(window))]
            end = -1
            for a, b in sorted(got):
                if a > end:
                    found.append((a, 3, b))
                elif b > end:
                    found[-1] = (found[-1][0], 3, b)
                end = max(end, b)
        return [(KINDS[k], a, b) for a, k, b in sorted(found)]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(docs: DataFrame, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> of every row's whole text; a narrow map."""

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        s = Scanner(classes, allow)
        spans = [[{"kind": k, "start": a, "end": e} for k, a, e in s.spans(t)] for t in text_list(b.column("text"))]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(SPAN))], names=["doc_id", "spans"])

    return map_texts(pick(docs, doc_id="bigint", text="string"), scan,
                     "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """``text`` with each union of overlapping spans replaced by ``mask``."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a > end:
            if end >= 0:
                out.append(mask)
                at = end
            out.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    if end >= 0:
        out.append(mask)
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked and ``n_chars`` (where present) brought up to date.

    All columns and rows stay; a null text stays null.
    """
    cols = docs.columns
    at = cols.index(text)

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        s = Scanner()
        texts = [t if t is None else redact(t, s.spans(t), mask) for t in b.column(at).to_pylist()]
        arrays = list(b.columns)
        arrays[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=[str(i) for i in range(len(arrays))])

    importable(docs.sparkSession)
    plain = docs.toDF(*[str(i) for i in range(len(cols))])
    out = plain.mapInArrow(tidy(lambda bs: (scan(b) for b in bs if b.num_rows)), plain.schema).toDF(*cols)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out
