"""Packing of documents into sequences: first-fit decreasing over a tournament tree.

Documents become token ids plus an end id and are cut into pieces of the sequence length and one
rest.  Full pieces fill a sequence each.  Rests are packed group by group: every row belongs to a
group by the hash of its place in the input, so that a group has about ``group_docs`` documents
whatever their keys or texts are.  In a group, pieces go from the longest to the shortest into the
first sequence with enough room, found in a tournament tree whose nodes hold the largest room below.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks

#: Documents of a group, on average.
GROUP_DOCS = 2048
#: Chunks whose ids a Python worker remembers; beyond that it starts anew.
_REMEMBERED = 500_000


def read_added(path: str) -> dict[str, int]:
    """Added tokens of the file with their ids; only plain ones are understood."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or ()
    odd = [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip"))]
    if odd:
        raise ValueError(f"added tokens that look at their surroundings: {odd}")
    return {t["content"]: t["id"] for t in added}


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Pieces as bytes with their ids, of a byte-level BPE file.

    The file writes a byte as a printable character: the printable ones of Latin-1 stand for
    themselves, the others follow from code point 256 on, in order.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    chars = {chr(b): b for b in plain}
    chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in model.get("added_tokens", ())}
    vocabulary = model["model"]["vocab"]
    return {bytes(chars[c] for c in t): i for t, i in vocabulary.items() if t not in special}


class Encoder(dict):
    """Ids of chunks as little-endian 32-bit bytes, computed when first asked for.

    The merges are run by tiktoken, whose ranks are the file's ids; the ids are those that the
    tokenizers library gives for the file: a text is cut at the strings of added tokens first,
    the leftmost and of these the longest one, and the parts between are encoded by themselves.
    """

    def __init__(self, vocabulary: dict[bytes, int], pattern: str, added: dict[str, int] | None = None):
        super().__init__()
        self._added = {t: i.to_bytes(4, "little") for t, i in (added or {}).items()}
        longest = sorted(map(re.escape, self._added), key=len, reverse=True)
        self._cut = re.compile(f"({'|'.join(longest)})") if longest else None
        self._encode = tiktoken.Encoding(
            "file", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}
        ).encode_ordinary

    def ids(self, text: str) -> bytes:
        return np.array(self._encode(text), dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        out = self.ids(" " + chunk)
        if len(chunk) < 64:
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        if len(self) > _REMEMBERED:
            self.clear()
        if self._cut is None:
            return self._part(text)
        parts = self._cut.split(text)
        if len(parts) == 1:
            return self._part(text)
        return b"".join(self._added[p] if i % 2 else self._part(p) for i, p in enumerate(parts) if p)

    def _part(self, text: str) -> bytes:
        first, *rest = chunks(text)
        return self.ids(first) + b"".join(map(self.__getitem__, rest))


def _packed(vocabulary: dict[bytes, int]) -> bytes:
    """The vocabulary as one string, which a task's function carries."""
    return zlib.compress(b"".join(i.to_bytes(4, "little") + bytes([len(t)]) + t for t, i in vocabulary.items()))


def _unpacked(packed: bytes) -> tuple[list[bytes], list[int]]:
    raw, at, pieces, ids = zlib.decompress(packed), 0, [], []
    while at < len(raw):
        n = raw[at + 4]
        ids.append(int.from_bytes(raw[at : at + 4], "little"))
        pieces.append(raw[at + 5 : at + 5 + n])
        at += 5 + n
    return pieces, ids


def _pieces(
    batches: Iterator[pa.RecordBatch],
    vocabulary: bytes,
    added: dict[str, int],
    pattern: str,
    end: int,
    length: int,
    with_ids: bool,
) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(dict(zip(*_unpacked(vocabulary), strict=True)), pattern, added)
    tail, step = end.to_bytes(4, "little"), 4 * length
    for batch in batches:
        cols: tuple[list, ...] = ([], [], [], [], [], [], [])
        for row, key, text in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True
        ):
            ids = encoder.encode(text.as_py() or "") + tail
            for at in range(0, len(ids), step):
                piece = ids[at : at + step]
                for col, value in zip(
                    cols,
                    (row, key, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None),
                    strict=True,
                ):
                    col.append(value)
        arrays = [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])


def first_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, in the given order, each in the first bin with enough room.

    ``tree`` is a tournament over bins: a node holds the largest room of the bins below it, so the
    first fitting bin is found from the root, the left child being asked first.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= size else 2 * node + 1
        bins[i], offsets[i] = node - leaves, room - tree[node]
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def _pack_group(group: tuple, pieces: pd.DataFrame, length: int) -> pd.DataFrame:
    pieces = pieces.sort_values(["length", "row", "start"], ascending=[False, True, True], ignore_index=True)
    full = int((pieces["length"] == length).sum())
    bins, offsets = first_fit(pieces["length"].to_numpy()[full:], length)
    pieces["sequence_id"] = (int(group[0]) << 32) + np.concatenate([np.arange(full), bins + full])
    pieces["offset"] = np.concatenate([np.zeros(full, np.int64), offsets])
    return pieces.drop(columns=["group", "row"])


def pack_documents(
    df: DataFrame,
    vocabulary_path: str,
    pattern: str,
    end: int = 1,
    length: int = 2048,
    group_docs: int = GROUP_DOCS,
    with_ids: bool = False,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Columns: doc_id, start, length, ids_crc32 (of the ids as little-endian 32-bit integers),
    doc_tokens (the end id included), sequence_id, offset, and with ``with_ids`` the ids
    themselves as such bytes.  Strings of the file's added tokens become their ids.  Null and empty texts are one end id; repeated rows, null keys and
    equal texts are packed as any others; other columns are not read; an empty table gives none.

    One shuffle, of rows without texts unless ids are asked for.  A group holds about
    ``group_docs`` rows as their number is counted first; a text's pieces stay together.
    """
    vocabulary, added = _packed(read_vocabulary(vocabulary_path)), read_added(vocabulary_path)
    groups = max(1, round(df.count() / group_docs))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long"), F.col(text))
    kind = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    pieces = rows.mapInArrow(lambda b: _pieces(b, vocabulary, added, pattern, end, length, with_ids), kind)
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    if not with_ids:
        pieces = pieces.drop("ids")
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    fields += ("ids binary, " if with_ids else "") + "sequence_id long, offset long"

    def pack(group, frame):
        return _pack_group(group, frame, length)

    return pieces.groupBy("group").applyInPandas(pack, fields)
