"""Secret scans: fixed patterns plus windows of high entropy.

Fixed patterns find assignments, access keys and long hex runs.  Beside them, candidate strings
are read once per character class with a sliding window whose Shannon entropy is kept up to date
from the counts of its characters; windows above the class's threshold join into spans, and spans
that an allow-list pattern covers are suppressed.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{32}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")


@dataclass(frozen=True)
class CharClass:
    """Characters, window length and the least bits per character of a suspicious window.

    A run shorter than the window is one window, its threshold scaled to the log of its length.
    """

    name: str
    run: re.Pattern
    window: int
    bits: float
    needs: tuple[re.Pattern, ...]
    scattered: bool = False  # case that changes often stands for a digit

    def limits(self, length: int) -> tuple[int, float]:
        """Window and bits for a run of a length."""
        if length >= self.window:
            return self.window, self.bits
        return length, self.bits * math.log2(length) / math.log2(self.window)

    def keylike(self, piece: str) -> bool:
        if not all(n.search(piece) for n in self.needs):
            return False
        if not self.scattered or _DIGIT.search(piece):
            return True
        return sum(a.isupper() != b.isupper() for a, b in pairwise(piece)) >= _CHANGES * (len(piece) - 1)


#: Least share of neighbours of different case in a key without digits; names change at words only.
_CHANGES = 0.4
_DIGIT, _LOWER, _UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
#: Letters-only windows are words, not keys: each class names what a window's span must hold.
CLASSES = (
    CharClass("hex", re.compile(r"[0-9a-f]{20,}|[0-9A-F]{20,}"), 20, 3.0, (_DIGIT, re.compile("[A-Fa-f]"))),
    CharClass("base32", re.compile(r"[A-Z2-7]{20,}"), 20, 3.4, (_DIGIT, _UPPER)),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 24, 4.0, (_LOWER, _UPPER), True),
)

#: Strings that look random and are none: identifiers, digests named as such, candidates with a placeholder.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(r"(?:sha(?:1|256|384|512)|md5|commit|digest|checksum)[:=\-\x20]\x20?[A-Za-z0-9+/=]+", re.IGNORECASE),
)
PLACEHOLDER = re.compile("EXAMPLE|example|placeholder|PLACEHOLDER|abcdefghijklm|0123456789")


def _hot_windows(s: str, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Merged (start, end) of the windows of ``s`` with at least ``bits`` per character.

    H = log2(w) - sum(c log2 c) / w; one step changes two counts only.
    """
    term = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    limit = (math.log2(window) - bits) * window + 1e-9
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, ch in enumerate(s):
        if i >= window:
            old = s[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - term[c]
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += term[c + 1] - term[c]
        if i >= window - 1 and total <= limit:
            first = i - window + 1
            if first > end:
                if end > 0:
                    yield start, end
                start = first
            end = i + 1
    if end > 0:
        yield start, end


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    at = LONG_HEX.search(text)
    while at:  # a run is as long as it can be, so its first 32 characters find it
        run = HEX.match(text, at.start())
        out.append((run.start(), 2, run.end()))
        at = LONG_HEX.search(text, run.end())
    return sorted(out)


class Cover:
    """Whether any of some spans covers another one."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def __contains__(self, span: tuple[int, int]) -> bool:
        at = bisect_right(self.starts, span[0])
        return at > 0 and self.ends[at - 1] >= span[1]


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Spans of high entropy in candidate strings, merged over the classes, without allowed ones."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not (_DIGIT.search(s) or (_LOWER.search(s) and _UPPER.search(s))) or PLACEHOLDER.search(s):
            continue
        for k in CLASSES:
            for run in k.run.finditer(s):
                for a, b in _hot_windows(run[0], *k.limits(len(run[0]))):
                    if k.keylike(run[0][a:b]):
                        found.append((m.start() + run.start() + a, m.start() + run.start() + b))
    if not found:
        return []
    found.sort()
    merged = [found[0]]
    for a, b in found[1:]:
        if a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    allowed = Cover(m.span() for p in ALLOW for m in p.finditer(text))
    return [span for span in merged if span not in allowed]


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text: fixed patterns, and entropy spans that no fixed one covers."""
    if not text:
        return []
    base = base_spans(text)
    fixed = Cover((a, b) for a, _, b in base)
    return sorted(base + [(a, 3, b) for a, b in entropy_spans(text) if (a, b) not in fixed])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCAN_FIELDS = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("n_entropy", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            spans = spans_of(text.as_py())
            base = joined([s for s in spans if s[1] < 3])
            kinds = [k for _, k, _ in spans]
            rows.append((*[kinds.count(k) for k in range(4)], hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
        cols = [[r[i] for r in rows] for i in range(6)]
        arrays = [batch.column(0)] + [pa.array(c, f.type) for c, f in zip(cols, list(SCAN_FIELDS)[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, schema=SCAN_FIELDS)


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of secrets of every whole text.

    Null and empty texts have none; every input row gives one row, repeated ones too; other
    columns are not read.  Spans are code points, end exclusive, by start, then by kind in the
    order assign, access, hex, entropy.  A narrow job: no shuffle, a row at a time, in time linear in the
    text: a megabyte of base64 takes about a second.
    """
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"
    )


def mask(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind; overlapping ones become one mark."""
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]} removed]"]
        at = b
    return text if not out else "".join(out) + text[at:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the secrets of its texts masked, all rows (repeated ones too) and columns kept.

    Null and empty texts stay as they are; an empty table gives one.
    """

    @F.pandas_udf("string")
    def masked(texts):
        return texts.map(lambda t: mask(t, spans_of(t)) if t else t)

    return df.withColumn(text, masked(F.col(text)))
