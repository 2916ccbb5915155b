"""Near-duplicate lines by a segment-partition edit join.

If a line is cut into e + 1 segments, e edits leave one of them whole.  So every line is entered in
an index under (its length, segment number, segment), and looks up, for each length that e edits
can bridge, the substrings of its own that may stand at the segment's place.  Lines that meet are
verified with a bit-parallel automaton that keeps a band of diagonals.  Equal lines are one node.
The edits grow with the shorter line's length, else short lines would link each other to one class;
lines that may not differ at all stand in no index.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .linking import components, distinct_groups, tiles, verified_edges

#: (least length, edits), from long lines to short ones: of two lines, the shorter one's length decides.
EDITS = ((21, 2), (6, 1), (0, 0))
BROADCAST_ROWS = 500_000
#: Sketches that a Python worker holds at a time.
_SKETCHES = 4096
_HAS_WORD = re.compile(r"[^\x20\x09-\x0D]")


Scale = tuple[tuple[int, int], ...]


def edits_of(length: int, scale: Scale) -> int:
    """Edits that a line of ``length`` code points may differ by from one that is not shorter."""
    return next((edits for least, edits in scale if length >= least), 0)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 segments of a line, the shorter ones first."""
    short, more = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        size = short + (i > edits - more)
        out.append((at, size))
        at += size
    return out


def windows(length: int, other: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(segment number, size, first start, last start) of the substrings of a line of ``length``
    that can match segments of an indexed line of length ``other``, which is not longer.

    A match of segment i leaves i edits on its left and edits - i on its right at most, which
    bounds the shift from both sides.
    """
    delta, out = length - other, []
    for i, (start, size) in enumerate(segments(other, edits)):
        low = max(0, start - i, start + delta - (edits - i))
        high = min(length - size, start + i, start + delta + (edits - i))
        if low <= high:
            out.append((i, size, low, high))
    return out


def probed(length: int, scale: Scale) -> list[tuple[int, int]]:
    """(length, edits) of the lines, not longer ones, that a line of ``length`` can link with."""
    reach = max(edits for _, edits in scale)
    return [
        (n, e) for n in range(max(0, length - reach), length + 1) if (e := edits_of(n, scale)) and length - n <= e
    ]


def index_keys(line: str, scale: Scale) -> list[tuple[int, int, str]]:
    n = len(line)
    edits = edits_of(n, scale)
    return [(n, i, line[a : a + size]) for i, (a, size) in enumerate(segments(n, edits))] if edits else []


def probe_keys(line: str, scale: Scale) -> set[tuple[int, int, str]]:
    return {
        (other, i, line[a : a + size])
        for other, edits in probed(len(line), scale)
        for i, size, low, high in windows(len(line), other, edits)
        for a in range(low, high + 1)
    }


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of two lines is at most ``edits``.

    State: for each number of errors, a bit per diagonal of the band that is reachable.  A row
    takes one character of ``a`` and all diagonals at once.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    # Equal ends cost nothing; halving finds them with whole comparisons.
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[-mid:] == b[-mid:]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if max(len(a), len(b)) <= edits:
        return True
    places: dict[str, int] = defaultdict(int)
    for j, c in enumerate(b):
        places[c] |= 1 << (j + edits)
    band = (1 << (2 * edits + 1)) - 1
    # Bit d of a row i stands for the first i characters of a and i + d - edits of b.
    state = [0] * (edits + 1)
    state[0] = 1 << edits
    for e in range(1, edits + 1):
        state[e] = state[e - 1] | (state[e - 1] << 1)
    state = [s & band for s in state]
    n = len(b)
    for i, c in enumerate(a):
        match = (places.get(c, 0) >> i) & band
        # Diagonals whose place in b exists after this row.
        valid = band
        if i + 1 - edits < 0:
            valid &= -1 << (edits - i - 1)
        if i + 1 + edits > n:
            valid &= (1 << max(0, n - i + edits)) - 1
        before, new = 0, []
        for e in range(edits + 1):
            now = state[e] & match
            if e:
                now |= before | (before >> 1) | (new[e - 1] << 1)
            before = state[e]
            new.append(now & valid)
        state = new
        if not any(state):
            return False
    return any((s >> (n - len(a) + edits)) & 1 for s in state)


class Plan(dict):
    """Where a line of a length is cut for its index and probe keys: (seed, start, end) of each.

    The seed stands for the indexed line's length and the segment's number.
    """

    def __init__(self, scale: Scale):
        super().__init__()
        self.scale = scale

    def __missing__(self, n: int) -> tuple[list, list]:
        edits = edits_of(n, self.scale)
        index = [(n * 16 + i, a, a + size) for i, (a, size) in enumerate(segments(n, edits))] if edits else []
        probes = [
            (other * 16 + i, a, a + size)
            for other, allowed in probed(n, self.scale)
            for i, size, low, high in windows(n, other, allowed)
            for a in range(low, high + 1)
        ]
        self[n] = out = (index, probes)
        return out


def _key(piece: str, seed: int) -> int:
    h = xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass"), seed)
    return h - (h >> 63 << 64)


def _digest(line: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batch(cols, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


_LONG = pa.int64()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, line_no, d1, d2) of every line with a word."""
    for batch in batches:
        found = [
            (row, key, number, *_digest(line))
            for row, key, text in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True
            )
            for number, line in enumerate((text.as_py() or "").split("\n"))
            if _HAS_WORD.search(line)
        ]
        yield _batch(list(zip(*found, strict=True)) or [[]] * 5, ["row", "doc_id", "line_no", "d1", "d2"], [_LONG] * 5)


def _distinct_lines(batch: pa.RecordBatch) -> Iterator[str]:
    seen: set[str] = set()
    for text in batch.column(0):
        for line in (text.as_py() or "").split("\n"):
            if line not in seen and _HAS_WORD.search(line):
                seen.add(line)
                yield line


def _sketches(batches: Iterator[pa.RecordBatch], scale: Scale) -> Iterator[pa.RecordBatch]:
    """Digest, length, index keys and probe keys of the lines, once for equal lines of a batch."""
    plan, names = Plan(scale), ["d1", "d2", "units", "index", "probes"]
    kinds = [_LONG] * 3 + [pa.list_(_LONG)] * 2
    for batch in batches:
        found: list[tuple] = []
        for line in _distinct_lines(batch):
            if len(found) == _SKETCHES:
                yield _batch(list(zip(*found, strict=True)), names, kinds)
                found = []
            index, probes = plan[len(line)]
            if not probes:
                continue
            found.append(
                (
                    *_digest(line), len(line),
                    [_key(line[a:b], seed) for seed, a, b in index],
                    [_key(line[a:b], seed) for seed, a, b in probes],
                )
            )
        yield _batch(list(zip(*found, strict=True)) or [[]] * 5, names, kinds)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(*_digest(line), line) for line in _distinct_lines(batch)]
        yield _batch(list(zip(*found, strict=True)) or [[]] * 3, ["d1", "d2", "line"], [_LONG, _LONG, pa.string()])


def _links(lines: list[str], scale: Scale) -> np.ndarray:
    """Links among a tile's lines: probes of the tile's own index, verified by the automaton."""
    index: dict[tuple[int, int, str], list[int]] = defaultdict(list)
    for i, line in enumerate(lines):
        for k in index_keys(line, scale):
            index[k].append(i)
    out = np.zeros((len(lines), len(lines)), dtype=bool)
    for i, line in enumerate(lines):
        near = {j for k in probe_keys(line, scale) for j in index.get(k, ())}
        for j in near:
            # Pairs of one length meet from both sides.
            if (j < i or len(lines[j]) < len(line)) and within(line, lines[j], edits_of(len(lines[j]), scale)):
                out[i, j] = out[j, i] = True
    return out


def line_classes(
    df: DataFrame, scale: Scale = EDITS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per line with a word: doc_id, line_no, class_doc_id, class_line_no, class_size, kept.

    Lines are split at line feeds and compared as they are.  Two lines link if they are equal, or
    if their edit distance is at most what ``scale`` allows for the shorter one: by default none up to 5
    code points, 1 up to 20 and 2 beyond; classes are connected by links.  A class is named by its first line, in order of key (null last), row
    and line number; that line is kept.  ``class_size`` counts lines, copies included.  Blank lines,
    null and empty texts give no rows; repeated rows are further copies; other columns are not
    read; an empty table gives none.

    Equal lines are one node, so that their number costs nothing in the join.  Texts are read
    three times and never shuffled; lines are, those that meet another one only.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = stored(
        numbered.mapInArrow(_occurrences, "row long, doc_id long, line_no long, d1 long, d2 long"), "lines"
    )
    texts = docs.select("text")
    kind = "d1 long, d2 long, units long, index array<long>, probes array<long>"
    sketches = texts.mapInArrow(lambda b: _sketches(b, scale), kind)
    sketches = sketches.groupBy("d1", "d2").agg(*[F.first(c).alias(c) for c in ("units", "index", "probes")])
    sketches = stored(sketches.withColumn("node", F.monotonically_increasing_id()), "line-sketches")
    leaders = sketches.select("node", F.explode("index").alias("key")).groupBy("key").agg(F.min("node").alias("leader"))
    # A line's own segments are among its probes, so indexed lines meet their leader here, too.
    met = sketches.select("node", F.explode("probes").alias("key")).join(leaders, "key")
    met = stored(met.select("node", F.col("leader").alias("group")).distinct(), "line-leaders")
    groups = stored(distinct_groups(met), "line-groups")

    left = groups.select("node").distinct().join(sketches.select("node", "d1", "d2", "units"), "node")
    left = stored(left, "line-candidates")
    small, keys = left.count() <= BROADCAST_ROWS, left.select("d1", "d2", "node")
    lines = texts.mapInArrow(_lines, "d1 long, d2 long, line string")
    lines = lines.join(F.broadcast(keys) if small else keys, ["d1", "d2"])
    lines = stored(lines.groupBy("node").agg(F.first("line").alias("line")), "candidate-lines")
    tiled = tiles(groups, left.select("node", "units"), "lines")
    edges = verified_edges(tiled, lines, lambda c: _links(c["line"], scale))
    edges = stored(edges, "line-links")
    discard(met, groups, left, lines, tiled)
    named = components(edges, "lines")

    # Lines without a near one are named by their digest, the others by their component.
    nodes = named.join(sketches.select("node", "d1", "d2"), "node")
    first = named.groupBy("component").agg(F.min("node").alias("node")).join(sketches.select("node", "d1", "d2"), "node")
    first = first.select("component", F.col("d1").alias("c1"), F.col("d2").alias("c2"))
    nodes = stored(nodes.join(first, "component").select("d1", "d2", "c1", "c2"), "line-classes")
    placed = found.join(nodes, ["d1", "d2"], "left").select(
        "row", "doc_id", "line_no", F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2")
    )
    placed = stored(placed, "placed-lines")
    discard(found, sketches, edges, named, nodes)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")
    classes = placed.groupBy("c1", "c2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    out = placed.join(classes, ["c1", "c2"])
    kept = (F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))
    return out.select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"),
        "class_size", kept.alias("kept"),
    )
