"""Byte-level BPE: ranked merges of the bytes of distinct words, all words of a block at once.

A task reads its documents in blocks of some megabytes, splits them by the tokenizer's pattern
and keeps each block's distinct words.  The merges then run in rounds over flat arrays: a round joins
the pair of the lowest rank, leftmost first, of every word that still has one, and looks up the two ranks
that changed.  Decoding concatenates the pieces' bytes per word.  At last the words' results are put
together in document order.  Everything is narrow: there is no shuffle, and a lost task is simply
run again.

A round copies the words that are left.  That is little for words, but not for the rare runs of
thousands of letters: those are merged beforehand, with a heap of the ranks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text characters of a block of documents; the distinct words of one are in memory at once.
BLOCK_CHARS = 16_000_000
#: Bytes of a word beyond which it is merged with a heap.
LONG_WORD = 400

_ODD = re.compile(r" (?=\s)")
_CUT = re.compile(r"(?= \S)")
#: Chunks of a block whose word numbers are remembered.
_REMEMBERED = 200_000
#: A pair (a, b) has the key a * 2^_BITS + b.  Pieces count from 1: 0 ends a word and pairs with nothing.
_BITS = 17
#: The rank of pairs that do not join, and the bits of a place beside a rank.
_NONE, _BITS_OF_PLACE = np.int64(1 << _BITS), 40
_PLACE = (1 << _BITS_OF_PLACE) - 1
#: Factors of the two places that a pair may have in the rank map; the next ones are tried if two do not do.
_FACTORS = ((40503, 9973), (7919, 104729), (15485863, 32452843), (49979687, 67867967))


def chunks(text: str) -> list[str]:
    """``text`` cut before every blank that a non-space follows, without those blanks.

    No match of the tokenizers' pattern reaches over such a cut, so that each chunk, the blank put
    before it again, can be encoded alone; the first chunk has none.
    """
    if _ODD.search(text) or text.endswith(" "):
        first, *rest = _CUT.split(text) if text[:1] != " " or text[1:2].isspace() or len(text) == 1 else ["", *_CUT.split(text)[1:]]
        return [first, *[c[1:] for c in rest]]
    return text.split(" ")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Rank (which is the id) of every adjacent pair of pieces that joins into a piece."""
    return {
        (ranks[t[:i]], ranks[t[i:]]): r
        for t, r in ranks.items()
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    }


def placed(pairs: dict[tuple[int, int], int]) -> tuple[list[int], list[tuple[int, int]]]:
    """A table in which each pair stands in one of two places, as key * 2^_BITS + rank, and the places' factors.

    A pair that finds its places taken moves another one to that one's second place, and so on.
    """
    size = 1 << (3 * len(pairs)).bit_length()
    for shift in range(len(_FACTORS)):
        factors = [_FACTORS[shift], _FACTORS[(shift + 1) % len(_FACTORS)]]
        table: list[tuple | None] = [None] * size
        for pair in pairs:
            held, at = pair, None
            for _ in range(500):
                spots = [(held[0] * f + held[1] * g) % size for f, g in factors]
                free = next((s for s in spots if table[s] is None), None)
                if free is not None:
                    table[free], held = held, None
                    break
                at = spots[1] if at == spots[0] else spots[0]
                table[at], held = held, table[at]
            if held is not None:
                break
        else:
            return [-1 if p is None else ((p[0] << _BITS) + p[1] << _BITS) + pairs[p] for p in table], factors
    raise ValueError("the ranks find no place in the table")


class RankMap:
    """The ranks of pairs of pieces, and the bytes of each piece.

    Pieces are counted from 1, so a rank is an id plus 1.  The map is a flat array, in which a lookup reads
    one or two places.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], table: np.ndarray, factors, byte_ids: list[int], pieces: list[bytes]):
        self.pairs, self.table, self.factors, self.byte_ids, self.pieces = pairs, table, factors, byte_ids, pieces

    @staticmethod
    def parts(ranks: dict[bytes, int]) -> tuple:
        """What a map is made of: plain values, which a task can read without this package."""
        pairs = pair_ranks(ranks)
        table, factors = placed({(a + 1, b + 1): r + 1 for (a, b), r in pairs.items()})
        pieces = [b""] * (max(ranks.values()) + 2)
        for t, r in ranks.items():
            pieces[r + 1] = t
        return pairs, np.array(table, dtype=np.int64), factors, [ranks[bytes([i])] for i in range(256)], pieces

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair (a, b), or _NONE."""
        key, out = (a << _BITS) + b, np.full(len(a), _NONE)
        for f, g in self.factors:
            found = self.table[(a * f + b * g) & (len(self.table) - 1)]
            hit = found >> _BITS == key
            out[hit] = found[hit] & ((1 << _BITS) - 1)
        return out

    def merged(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of pieces of each word; they replace, from its start on, those of its bytes in ``ids``.

        A zero ends each word.  Every round joins one pair in each word that has one.
        """
        sizes = np.diff(starts, append=len(ids)) - 1
        words, first, left = np.arange(len(starts)), starts, ids
        ranks = self.rank(left, np.append(left[1:], 0))
        while len(words):
            low = np.minimum.reduceat((ranks << _BITS_OF_PLACE) + np.arange(len(left)), first)
            goes_on = low >> _BITS_OF_PLACE != _NONE
            if not goes_on.all():
                # The words that have no such pair any more go back to their places.
                length = np.diff(first, append=len(left))
                kept = np.repeat(goes_on, length)
                over, n = words[~goes_on], length[~goes_on]
                sizes[over] = n - 1
                ids[_runs(starts[over], n)] = left[~kept]
                at = np.cumsum(kept) - 1
                words, first, low = words[goes_on], at[first[goes_on]], low[goes_on]
                left, ranks = left[kept], ranks[kept]
                place = at[low & _PLACE]
            else:
                place = low & _PLACE
            left[place] = low >> _BITS_OF_PLACE
            kept = np.ones(len(left), dtype=bool)
            kept[place + 1] = False
            # Each word before has lost one place.
            lost = np.arange(len(words))
            left, ranks, first, place = left[kept], ranks[kept], first - lost, place - lost
            for near in (place, place - 1):  # a zero stands before each word, that of the last before the first
                ranks[near] = self.rank(left[near], left[near + 1])
        return sizes


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def merged_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The pieces of a word from those of its bytes, lowest rank first, then leftmost, by a heap of the pairs."""
    n = len(ids)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    ids = list(ids)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue  # one of the two has been joined since
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y >= 0 and (r := pairs.get((ids[x], ids[y]))) is not None:
                heapq.heappush(heap, (r, x, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())]
)
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def _encoded(
    batches: Iterator[pa.RecordBatch], ranks, pattern: str, size: int, digest: bool
) -> Iterator[pa.RecordBatch]:
    """One row per document; documents are encoded in blocks that share their distinct words."""
    words_of = regex.compile(pattern).findall
    number: dict[str, int] = {}  # of a word in the block
    keys: list = []
    numbers: list[bytes] = []
    held = 0

    def numbered(chunk: str) -> bytes:
        return np.array([number.setdefault(w, len(number)) for w in words_of(chunk)], dtype=np.int32).tobytes()

    class Chunks(dict):
        """The word numbers of a chunk."""

        def __missing__(self, chunk: str) -> bytes:
            self[chunk] = out = numbered(" " + chunk)
            return out

    known, rank_map = Chunks(), RankMap(*ranks.value)
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            first, *rest = chunks(text.as_py() or "")
            keys.append(key)
            numbers.append(numbered(first) + b"".join(map(known.__getitem__, rest)))
            held += len(numbers[-1]) // 4
            if len(known) > _REMEMBERED:
                known.clear()
            if held * 5 >= size:  # a word has about five characters
                yield from _assembled(keys, numbers, *_merged(number, rank_map), digest)
                number.clear()
                known.clear()
                keys, numbers, held = [], [], 0
    if keys:
        yield from _assembled(keys, numbers, *_merged(number, rank_map), digest)


def _merged(words: Iterable[str], ranks: RankMap) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of words: all their ids in one array, where those of each begin, their number, and the bytes that they decode to."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    ids = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    ids[_runs(starts, sizes)] = np.array(ranks.byte_ids, dtype=np.int64)[np.frombuffer(b"".join(raw), dtype=np.uint8)] + 1
    is_long = sizes > LONG_WORD
    short = np.flatnonzero(~is_long)
    if len(short):
        # Those that are merged together lie side by side.
        places = _runs(starts[short], sizes[short] + 1)
        side = ids[places]
        at = np.cumsum(sizes[short] + 1) - (sizes[short] + 1)
        sizes[short] = ranks.merged(side, at)
        ids[places] = side
    for i in np.flatnonzero(is_long).tolist():
        pieces = merged_long([ranks.byte_ids[x] for x in raw[i]], ranks.pairs)
        ids[starts[i] : starts[i] + len(pieces)] = np.array(pieces, dtype=np.int64) + 1
        sizes[i] = len(pieces)
    # Decoded from the ids alone.
    pieces = list(map(ranks.pieces.__getitem__, ids[_runs(starts, sizes)].tolist()))
    ends = np.cumsum(sizes)
    back = [b"".join(pieces[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    return ids - 1, starts, sizes, back


def _assembled(
    keys: list, numbers: list[bytes], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, decoded: list[bytes], digest: bool
) -> Iterator[pa.RecordBatch]:
    """One row per document, from the encoded words of its block."""
    schema = DIGESTS if digest else ENCODED
    rows: list[tuple] = []
    for key, raw in zip(keys, numbers, strict=True):
        nums = np.frombuffer(raw, dtype=np.int32)
        own = ids[_runs(starts[nums], sizes[nums])].astype("<u4")
        back = b"".join(map(decoded.__getitem__, nums.tolist()))
        if digest:
            rows.append((key, len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
        else:
            rows.append((key, own.tobytes(), back))
        if len(rows) == 2000:
            yield _rows(rows, schema)
            rows = []
    if rows:
        yield _rows(rows, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    digest: bool = False,
    key: str = "doc_id",
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Token ids and decoded bytes of every whole text, or with ``digest`` their count and hashes.

    ``ids`` are little-endian unsigned 32-bit integers.  Null and empty texts give no ids; every
    input row gives one row, repeated ones too; other columns are not read; an empty table gives
    none.  ``ranks_path`` is read on the driver only.  A block ends with the document that fills
    it, so its size is bounded by ``block_chars`` plus one text.  The work for a word of up to LONG_WORD bytes
    grows with the square of its length, as each merge copies its pieces; longer ones take n log n: one of
    100,000 letters about a second.
    """
    ranks = df.sparkSession.sparkContext.broadcast(RankMap.parts(read_ranks(ranks_path)))  # as large as the vocabulary
    kind = (
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
        if digest
        else "doc_id long, ids binary, decoded binary"
    )
    return df.select(F.col(key).cast("long"), F.col(text)).mapInArrow(
        lambda batches: _encoded(batches, ranks, pattern, block_chars, digest), kind
    )
