"""N-gram Jaccard join with prefix filters under several global token orders.

A document is the set of its hashed word shingles.  If two sets of Jaccard similarity t or more
are sorted by the same global order, they share a token among the first n - ceil(t n) + 1 of each.
This holds for every order, so candidates must share such a prefix token under each of them.
Each order sorts tokens by hashed counters of its own over the whole corpus, then by hash, so that
shared passages come late in all of them and their noise is independent.  The first order groups the
documents in Spark, cut by set size; the others are asked for inside a group's tiles, on prefixes alone, and
whole sets go to the tiles only of documents that still meet another one there.
Documents of equal sets are one node throughout.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import identity, kept_rows
from .linking import components, distinct_groups, meeting, overlaps, tiles, verified_edges

#: Counters of an order per document, and the least and most bits of their index.
_COUNTERS_PER_DOC, _LEAST_BITS, _MOST_BITS = 2, 16, 22
ORDERS = 3
#: A set of candidates up to this size is broadcast to filter the documents, beyond it is joined.
BROADCAST_ROWS = 500_000
#: Likewise of shared tokens, four bytes each, to filter the postings.
BROADCAST_TOKENS = 2_000_000
#: Tokens that wait to be counted together.
_COUNT_AT = 1_000_000

_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_STEP = _U(_GOLDEN)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random number for each byte, and an odd factor with its inverse modulo 2^64, for hashes of words.
_BYTE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_FACTOR = 0x5851F42D4C957F2D
_INVERSE = pow(_FACTOR, -1, 2**64)
_IN_WORD = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    The bytes' numbers times the powers of a factor are summed up once over the text; a word's hash is the
    difference of two sums, divided by the power at its start.
    """

    def __init__(self, words: int):
        self.words, self.size = words, 0

    def _powers(self, size: int) -> None:
        if size > self.size:
            self.size = max(2 * self.size, size, 1 << 16)
            ones = np.ones(self.size, dtype=np.uint64)
            ones[1:] = _FACTOR
            self.up = np.cumprod(ones)
            ones[1:] = _INVERSE
            self.down = np.cumprod(ones)

    def _words(self, raw: np.ndarray) -> np.ndarray:
        """Hashes of the words, between white space."""
        edge = np.zeros(len(raw) + 2, dtype=bool)
        edge[1:-1] = _IN_WORD[raw]
        edges = np.flatnonzero(edge[1:] != edge[:-1])
        starts, ends = edges[::2], edges[1::2]
        self._powers(len(raw))
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * self.up[: len(raw)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        # Bytes are lower-cased and split as the contract says: A-Z, and ASCII white space.
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if not raw:
            return np.zeros(0, dtype=np.uint64)
        h = self._words(np.frombuffer(raw, dtype=np.uint8))
        if not len(h):
            return h
        n = min(self.words, len(h))
        gram = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            gram = gram * _STEP + h[i : len(h) - n + 1 + i]
        return np.unique(_mixed(gram))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _counted(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    """One row per document (its set's size and digest), then this task's counters in slices."""
    shingles, counters = Shingler(words), np.zeros(ORDERS << bits, dtype=np.uint32)
    names = ["doc_id", "text_md5", "n", "d1", "d2", "slice", "counters"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def rows(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def count(held: list[np.ndarray]) -> None:
        tokens = np.concatenate(held)
        for k in range(ORDERS):
            found = np.bincount(_slots(_ordered(tokens, k), bits), minlength=1 << bits)
            counters[k << bits : (k + 1) << bits] += found.astype(np.uint32)

    for batch in batches:
        sizes, d1, d2, held, waiting = [], [], [], [], 0
        for text in batch.column(1):
            tokens = shingles(text.as_py())
            a, b = _digest(tokens)
            sizes.append(len(tokens))
            d1.append(a)
            d2.append(b)
            held.append(tokens)
            waiting += len(tokens)
            if waiting > _COUNT_AT:
                count(held)
                held, waiting = [], 0
        if waiting:
            count(held)
        none = [None] * len(sizes)
        yield rows([batch.column(0).to_pylist(), batch.column(2).to_pylist(), sizes, d1, d2, none, none])
    size = 1 << 14
    for i in range(0, len(counters), size):
        part = counters[i : i + size]
        if part.any():
            yield rows([[None]] * 5 + [[i // size], [zlib.compress(part.tobytes(), 1)]])


def _ordered(tokens: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the tokens that an order seeds: the upper bits choose a counter, the lower break ties."""
    return _mixed(tokens + _U((order + 1) * _GOLDEN % 2**64))


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64)


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), dtype=np.uint32).astype(np.uint64) for x in frame["counters"])
    return pd.DataFrame({"slice": frame["slice"].iloc[:1], "counters": [total.tobytes()]})


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which two sets with a similarity of ``percent`` share one, the larger one too."""
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, counters: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set in an order: by the order's counters, then by its hash."""
    p = prefix_length(len(tokens), percent)
    if p >= len(tokens):
        return tokens
    hashes = _ordered(tokens, order)
    bits = counters.shape[1].bit_length() - 1
    rank = (counters[order][_slots(hashes, bits)] << _U(40)) | (hashes & _U((1 << 40) - 1))
    return tokens[np.argpartition(rank, p - 1)[:p]]


def _prefixes(batches: Iterator[pa.RecordBatch], words: int, percent: int, counters) -> Iterator[pa.RecordBatch]:
    """Digest, a text's hash and key and the prefix of the grouping order, once for equal sets of a batch.

    Prefix tokens are cut to 32 bits: equal ones only make more candidates.
    """
    shingles = Shingler(words)
    for batch in batches:
        seen, cols = set(), ([], [], [], [], [], [])
        for text, md5, key in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
            tokens = shingles(text.as_py())
            d = _digest(tokens)
            if not len(tokens) or d in seen:
                continue
            seen.add(d)
            first = prefix(tokens, counters.value, 0, percent).astype(np.uint32).view(np.int32)
            for col, v in zip(cols, (*d, len(tokens), md5, key, first), strict=True):
                col.append(v)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["d1", "d2", "n", "md5", "id", "p0"]
        )


def _sets(batches: Iterator[pa.RecordBatch], words: int, percent: int, counters) -> Iterator[pa.RecordBatch]:
    """Node, whole set and the prefixes of the other orders as bytes."""
    shingles, names = Shingler(words), ["node", "tokens", *[f"p{k}" for k in range(1, ORDERS)]]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part, cols = batch.slice(at, 500), [[] for _ in names]
            for node, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                tokens = shingles(text.as_py())
                others = [prefix(tokens, counters.value, k, percent).astype(np.uint32).tobytes() for k in range(1, ORDERS)]
                for col, v in zip(cols, (node, tokens.tobytes(), *others), strict=True):
                    col.append(v)
            kinds = [pa.int64()] + [pa.binary()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _meets(columns: dict[str, list]) -> np.ndarray:
    """Pairs that share a prefix token under every other order."""
    out = None
    for name in sorted(columns):
        shared = overlaps([np.frombuffer(x, dtype=np.uint32) for x in columns[name]]) > 0
        out = shared if out is None else out & shared
    return out


def _links(columns: dict[str, list], percent: int) -> np.ndarray:
    """Pairs that reach the similarity."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in columns["tokens"]]
    both = overlaps(sets).astype(np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def _groups(sketches: DataFrame, percent: int) -> DataFrame:
    """(node, group) of nodes that share a token of their first prefixes and are of like size, stored.

    Linked sets lie in the same or in adjacent classes of size, each of which spans the ratio that the
    similarity allows.  A part holds the sets of a class and of the next larger one; it is needed only if it has some of
    the class itself.  Tokens of one node are left out first, which most are.
    """
    step = max(-math.log(percent / 100), 0) + 1e-9  # a little wide, so that rounding loses nothing
    postings = sketches.select("node", F.floor(F.log("n") / step).alias("own"), F.explode("p0").alias("key"))
    ends = postings.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    shared = stored(ends.where("a <> b").select("key"), "shared-tokens")
    small = shared.count() <= BROADCAST_TOKENS
    met = stored(postings.join(F.broadcast(shared) if small else shared, "key"), "shared-postings")
    parts = met.select("key", "node", "own", F.explode(F.array("own", F.col("own") - 1)).alias("part"))
    leaders = parts.groupBy("key", "part").agg(
        F.min("node").alias("leader"), F.max("node").alias("last"), F.max(F.col("own") == F.col("part")).alias("needed")
    )
    leaders = stored(leaders.where("needed and leader <> last").select("key", "part", "leader"), "leaders")
    # Equal hashes of different leaders join two groups: more to verify, nothing lost.
    groups = parts.join(leaders, ["key", "part"]).select("node", F.xxhash64("leader", "part").alias("group")).distinct()
    led = stored(groups, "led-groups")
    out = stored(distinct_groups(led), "groups")
    discard(shared, met, leaders, led)
    return out


def _members(df: DataFrame, percent: int, words: int, key: str, text: str) -> DataFrame:
    """One row per input row: doc_id, text_md5, n and component, null for empty sets."""
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = df.count()
    bits = min(_MOST_BITS, max(_LEAST_BITS, (_COUNTERS_PER_DOC * rows).bit_length()))
    counted = stored(
        docs.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")))).mapInArrow(
            lambda b: _counted(b, words, bits),
            "doc_id long, text_md5 string, n long, d1 long, d2 long, slice int, counters binary",
        ),
        "shingle-counts",
    )
    # ORDERS times 2^bits counters in all, whatever the corpus holds.
    slices = counted.where("slice is not null").groupBy("slice").applyInPandas(_summed, "slice int, counters binary")
    total = np.zeros(ORDERS << bits, dtype=np.uint64)
    slices = stored(slices, "shingle-counters")
    for r in slices.toLocalIterator():
        part = np.frombuffer(r["counters"], dtype=np.uint64)
        total[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    discard(slices)
    total = np.minimum(total, (1 << 24) - 1).reshape(ORDERS, -1)
    counters = spark.sparkContext.broadcast(total)

    texts = docs.select("text", F.md5(F.coalesce("text", F.lit(""))).alias("md5"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    kind = "d1 long, d2 long, n long, md5 string, id long, p0 array<int>"
    sketches = texts.mapInArrow(lambda b: _prefixes(b, words, percent, counters), kind)
    sketches = sketches.groupBy("d1", "d2").agg(
        F.first("n").alias("n"), F.min(F.struct("md5", "id")).alias("of"), F.first("p0").alias("p0")
    )
    sketches = stored(sketches.withColumn("node", F.monotonically_increasing_id()), "sketches")
    groups = _groups(sketches, percent)

    # Only candidates' texts are cut again, and of copies one: it is found by its hash and key.
    left = groups.select("node").distinct().join(sketches.select("node", "of", F.col("n").alias("units")), "node")
    left = stored(left.select("node", "units", "of.md5", "of.id"), "candidates")
    keys, candidates = left.select("md5", "id", "node"), left.count()
    chosen = texts.join(F.broadcast(keys) if candidates <= BROADCAST_ROWS else keys, ["md5", "id"]).select("node", "text")
    kind = "node long, tokens binary, " + ", ".join(f"p{k} binary" for k in range(1, ORDERS))
    sets = stored(chosen.mapInArrow(lambda b: _sets(b, words, percent, counters), kind), "candidate-sets")
    if sets.count() > 2 * candidates:  # rows that repeat key and text, which a tile would get many times
        sets = stored(sets.dropDuplicates(["node"]), "candidate-sets-once")
    tiled = tiles(groups, left.select("node", "units"), "jaccard")
    met = meeting(tiled, sets.drop("tokens"), _meets, "jaccard")
    edges = verified_edges(met, sets.select("node", "tokens"), lambda c: _links(c, percent))
    edges = stored(edges, "jaccard-links")
    discard(groups, left, tiled, met, sets)
    named = components(edges, "jaccard")

    nodes = sketches.select("d1", "d2", "node").join(named, "node", "left")
    nodes = nodes.select("d1", "d2", F.coalesce("component", "node").alias("component"))
    members = counted.where("slice is null").select("doc_id", "text_md5", "n", "d1", "d2")
    linked = members.where("n > 0").join(nodes, ["d1", "d2"]).select("doc_id", "text_md5", "n", "component")
    empty = members.where("n = 0").select("doc_id", "text_md5", "n", F.lit(None).cast("long").alias("component"))
    out = stored(linked.unionByName(empty), "members")
    discard(counted, sketches, edges, named)
    return out


def jaccard_classes(
    df: DataFrame, percent: int, words: int, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles and component_id.

    Sets are the distinct ``words``-word shingles of the text with A-Z in lower case, split at
    ASCII white space; with fewer words the whole sequence is the one shingle; null, empty and
    blank texts have an empty set and are linked with nothing, not even with each other.  Sets
    link when 100 * intersection >= percent * union.  ``component_id`` is the smallest key that
    links lead to; null keys neither name a component nor lose theirs.  Repeated rows are in one
    component; other columns are not read; an empty table gives no rows.

    Links are exact up to collisions of 64-bit shingle hashes in a pair; nodes are numbered from
    128-bit digests of the sets.  Texts are read three times and never shuffled; whole sets are, of
    documents that still meet others under all orders.
    """
    members = _members(df, percent, words, key, text)
    least = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = members.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = members.where("component is null")
    return linked.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(df: DataFrame, percent: int, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df``, one of each component: that of the smallest key, null last.

    Texts with an empty set all stay, but of rows that repeat a key and a text only one.
    """
    members = _members(df, percent, words, key, text).select("component", *identity("doc_id", F.col("text_md5")))
    names = ["no_id", "id", "digest"]
    first = members.where("component is not null").groupBy("component").agg(F.min(F.struct(*names)).alias("first"))
    kept = first.select("first.*").unionByName(members.where("component is null").select(*names))
    return kept_rows(df, key, F.md5(F.coalesce(F.col(text), F.lit(""))), kept)
