"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are cut into windows of ten words.  The automaton's letters are words: its trie holds all
windows, a state's failure link leads to the longest suffix that also begins a window, and a text is
read once, word by word.  A match marks its words; only then are the words' places in the original
text looked up.  An automaton holds a bounded number of item words.  A larger benchmark is dealt to
several, each of which reads the texts once and marks the documents that it hits.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

WINDOW = 10
#: Item words of one automaton; each is in ten windows at most, which makes ten states.
AUTOMATON_WORDS = 50_000
#: Words of a piece of a long item.
PIECE_WORDS = 5_000

#: Every byte keeps its place: letters in lower case, bytes of no word are blanks, others stay.
_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
#: Bytes that continue a code point in UTF-8.
_CONTINUES = bytes(range(0x80, 0xC0))


def normalised(text: str | None) -> bytes:
    """The text's UTF-8 bytes with A-Z in lower case and blanks outside words, byte for byte."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES)


class Automaton:
    """Finds all windows of the given items in a sequence of words."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}  # of a word
        children: list[dict[int, int]] = [{}]
        self.depth = [0]
        self.items: dict[int, set] = defaultdict(set)  # of the windows that end in a state
        for item, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            for a in range(max(1, len(ids) - window + 1)):
                state = 0
                for w in ids[a : a + window]:
                    nxt = children[state].get(w)
                    if nxt is None:
                        nxt = children[state][w] = len(children)
                        children.append({})
                        self.depth.append(self.depth[state] + 1)
                    state = nxt
                if state:
                    self.items[state].add(item)
        self.words = len(self.number)
        self.goto = {s * self.words + w: t for s, below in enumerate(children) for w, t in below.items()}
        self._link(children)

    def _link(self, children: list[dict[int, int]]) -> None:
        """Failure links, and for each state the nearest one that ends a window, itself or by links."""
        goto, words = self.goto, self.words
        self.fail = fail = [0] * len(children)
        self.found = [s if s in self.items else 0 for s in range(len(children))]
        queue = deque([0])
        while queue:
            state = queue.popleft()
            self.found[state] = self.found[state] or self.found[fail[state]]
            for w, nxt in children[state].items():
                if state:
                    back = fail[state]
                    while back and back * words + w not in goto:
                        back = fail[back]
                    fail[nxt] = goto.get(back * words + w, 0)
                queue.append(nxt)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged (first, end) ranges of the words inside windows, and the items of these windows."""
        goto, fail, found, size = self.goto, self.fail, self.found, self.words
        state = 0
        ranges: list[tuple[int, int]] = []
        states: set[int] = set()
        for at, w in enumerate(map(self.number.get, words), 1):
            if w is None:
                state = 0
                continue
            nxt = goto.get(state * size + w)
            while nxt is None and state:
                state = fail[state]
                nxt = goto.get(state * size + w)
            state = nxt or 0
            if match := found[state]:
                low = at - self.depth[match]  # the longest window that ends here
                while ranges and ranges[-1][1] >= low:
                    low = min(low, ranges.pop()[0])
                ranges.append((low, at))
                while match and match not in states:
                    states.add(match)
                    match = found[fail[match]]
        return ranges, set().union(*(self.items[s] for s in states)) - {None}


def _pieces(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    """(item, words, n) of runs of words that together have each window of an item once."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = normalised(text.as_py()).split()
            for a in range(0, max(min(1, len(words)), len(words) - window + 1), size):
                part = words[a : a + size + window - 1]
                rows.append((item, b" ".join(part), len(part)))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        kinds = (pa.string(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["item", "words", "n"])


_RANGE = pa.struct([(n, pa.int64()) for n in ("first", "end", "start", "stop")])
_MARKS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("ranges", pa.list_(_RANGE)), ("items", pa.list_(pa.string()))]
)
_MARKS_DDL = (
    "row long, doc_id long, n_words long, "
    "ranges array<struct<first:long,end:long,start:long,stop:long>>, items array<string>"
)


def _placed(text: str, flat: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of words with their code points in the original text."""
    raw, spans = text.encode("utf-8", "surrogatepass"), [m.span() for m in _WORD.finditer(flat)]
    out, at, points = [], 0, 0

    def point(byte: int) -> int:
        nonlocal at, points
        points += len(raw[at:byte].translate(None, _CONTINUES))
        at = byte
        return points

    for first, end in ranges:
        out.append((first, end, point(spans[first][0]), point(spans[end - 1][1])))
    return out


def _marked(batches: Iterator[pa.RecordBatch], items, window: int, hits_only: bool) -> Iterator[pa.RecordBatch]:
    """Ranges and items of each document, or of those with a hit only."""
    automaton = Automaton(((item, words.split(b" ")) for item, words in items.value), window)
    for batch in batches:
        rows = []
        for row, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py() or ""
            flat = normalised(text)
            words = flat.split()
            ranges, found = automaton.scan(words)
            if ranges or not hits_only:
                placed = [dict(zip(("first", "end", "start", "stop"), r, strict=True)) for r in _placed(text, flat, ranges)]
                rows.append((row, key, len(words), placed, sorted(found)))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MARKS, strict=True)], schema=_MARKS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that meet or touch as one, items once, in order."""
    for batch in batches:
        ranges, items = [], []
        for found, names in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            out: list[dict] = []
            for r in sorted(found or [], key=lambda r: (r["first"], r["end"])):
                if out and out[-1]["end"] >= r["first"]:
                    if r["end"] > out[-1]["end"]:
                        out[-1] |= {"end": r["end"], "stop": r["stop"]}
                else:
                    out.append(dict(r))
            ranges.append(out)
            items.append(sorted(set(names or [])))
        cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(ranges, _MARKS.field("ranges").type), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, schema=_MARKS)


def contamination(
    df: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    automaton_words: int = AUTOMATON_WORDS,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_hit, items and spans.

    Words are runs of ASCII letters, digits and all other code points from U+0080, A-Z in lower case.
    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one
    window.  ``n_hit`` counts the document's words inside any occurrence of a window, ``items`` are the
    ids (as strings, sorted) of items with such windows, ``spans`` the (start, stop) of the hit runs in
    code points of the original text.  Null texts and items have no words; the windows of an item with a
    null id count, but name nothing; items that repeat an id are one; repeated rows of ``df`` each give
    one; empty tables give no rows, or rows without hits; other columns are not read.

    The items are cut to pieces in Spark and dealt by hash to automata of about ``automaton_words``
    words, so that no broadcast grows with the benchmark.  One automaton makes a narrow job; several read
    the numbered texts, stored once, one after the other, and meet in rows of hit documents only.
    """
    spark = df.sparkSession
    size = min(PIECE_WORDS, automaton_words)
    parts = benchmark.select(F.col(item).cast("string"), F.col(item_text)).mapInArrow(
        lambda b: _pieces(b, window, size), "item string, words binary, n long"
    )
    parts = stored(parts, "benchmark-pieces")
    total = parts.agg(F.sum("n")).first()[0] or 0
    count = max(1, math.ceil(total / automaton_words))
    dealt = parts.withColumn("automaton", F.pmod(F.xxhash64("words"), F.lit(count)))

    def items_of(automaton: int):
        rows = dealt.where(F.col("automaton") == automaton).select("item", "words").distinct().toLocalIterator()
        return spark.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in rows])

    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if count == 1:
        items = items_of(0)
        marks = docs.mapInArrow(lambda b: _marked(b, items, window, False), _MARKS_DDL)
    else:
        docs = stored(docs, "numbered-texts")
        hits = None
        for i in range(count):
            items = items_of(i)
            found = stored(docs.mapInArrow(lambda b, items=items: _marked(b, items, window, True), _MARKS_DDL), f"marks-{i}")
            hits = found if hits is None else hits.unionByName(found)
            items.unpersist()
        hits = hits.groupBy("row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "items")])
        nothing = spark.sparkContext.broadcast([])
        counted = docs.mapInArrow(lambda b: _marked(b, nothing, window, False), _MARKS_DDL).select("row", "doc_id", "n_words")
        marks = counted.join(hits, "row", "left").mapInArrow(_merged, _MARKS_DDL)
    lengths = F.transform("ranges", lambda r: r["end"] - r["first"])
    return marks.select(
        "doc_id", "n_words", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_hit"), "items",
        F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))).alias("spans"),
    )
