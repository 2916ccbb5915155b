"""Spelling variant grouping with a bit-sliced position index.

The vocabulary's words are numbered, and for each (position, letter) a bitset marks the words with that
letter there.  A query word runs through the sets once: with every letter, word-parallel recurrences
update the words without an error so far and those with one, whose positions are shifted by an
insertion or a deletion, or are not by a replacement.  Of two words at most one edit apart, one half of
the shorter is free of errors; halves decide in Spark which part of the vocabulary a query is held
against, so that the work grows with the vocabulary and not with its square.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Code points and occurrences of a word at least, and how many times a form is as frequent.
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: One in so many runs of a document loses a code point (the contract's noise).
NOISE = 199
#: Words of a part of the index that are aimed at; more are cut into blocks of twice as many.
PART_WORDS = 2048
#: Distinct words that a task holds before it hands on their counts.
_HELD = 400_000

_RUNS = "[A-Za-zÀ-ÿ]"


def damaged(prefix: str, run: str) -> str:
    """The lower-cased run, without one code point if its hash with the document's id says so."""
    h = zlib.crc32((prefix + run).encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of the documents of a task, counted in part."""
    runs = re.compile(f"{_RUNS}{{{least},}}").findall  # a shorter run can't become a word
    total: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"]
        )
        total.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            prefix = f"{'' if key is None else key}:"
            found: Counter[str] = Counter(runs((text.as_py() or b"").lower().decode("utf-8", "replace")))  # bytes lower A-Z only
            for run, n in found.items():
                word = damaged(prefix, run)
                if len(word) >= least:
                    total[word] += n
            if len(total) > _HELD:
                yield handed()
    if total:
        yield handed()


class PositionIndex:
    """Bitsets over a list of different words: per (position, letter) and per length."""

    def __init__(self, words: list[str]):
        self.words = words
        slices: dict[tuple[int, str], bytearray] = defaultdict(lambda: bytearray(len(words) // 8 + 1))
        lengths: dict[int, bytearray] = defaultdict(lambda: bytearray(len(words) // 8 + 1))
        for k, word in enumerate(words):
            byte, bit = k >> 3, 1 << (k & 7)
            lengths[len(word)][byte] |= bit
            for i, letter in enumerate(word):
                slices[i, letter][byte] |= bit
        self.slices = {k: int.from_bytes(v, "little") for k, v in slices.items()}
        self.lengths = {k: int.from_bytes(v, "little") for k, v in lengths.items()}
        self.all = (1 << len(words)) - 1

    def near(self, query: str) -> list[int]:
        """Numbers of the words with exactly one inserted, deleted or replaced code point."""
        at, of = self.slices.get, self.lengths.get
        exact, replaced, inserted, deleted = self.all, 0, 0, 0
        for i, letter in enumerate(query):
            here = at((i, letter), 0)
            # The words one letter ahead, in step and one letter behind; errors made now come from ``exact``.
            inserted = (inserted | exact) & at((i + 1, letter), 0)
            deleted = (deleted & at((i - 1, letter), 0)) | exact
            replaced = (replaced & here) | (exact ^ (exact & here))
            exact &= here
            if not (exact or replaced or inserted or deleted):
                return []
        n = len(query)
        found = (replaced & of(n, 0)) | ((inserted | exact) & of(n + 1, 0)) | (deleted & of(n - 1, 0))
        out = []
        while found:
            low = found & -found
            out.append(low.bit_length() - 1)
            found ^= low
        return out


def _near_pairs(frame: pd.DataFrame) -> pd.DataFrame:
    """Both directions of the near pairs between a tile's queries and its part of the vocabulary."""
    indexed = frame[frame["indexed"]].drop_duplicates("word")
    words, counts = indexed["word"].tolist(), indexed["n"].tolist()
    index = PositionIndex(words)
    asked = frame[frame["asks"]].drop_duplicates("word")
    out = [
        pair
        for word, n in zip(asked["word"].tolist(), asked["n"].tolist(), strict=True)
        for k in index.near(word)
        for pair in ((word, words[k], counts[k]), (words[k], word, n))
    ]
    return pd.DataFrame(out, columns=["word", "near", "near_n"])


def _halves(word: Column, length: Column, shorter: bool) -> list[Column]:
    """Keys of the halves of a word, or of those that a word one letter shorter can share with it."""
    own = length - 1 if shorter else length
    half = (own / 2).cast("int")
    ends = [F.substring(word, F.lit(1), half), F.substring(word, length - (own - half) + 1, own - half)]
    return [
        F.struct(F.xxhash64(own, F.lit(side), piece).alias("key"), F.lit(not shorter).alias("indexed"))
        for side, piece in enumerate(ends)
    ]


def near_pairs(words: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(word, near, near_n) of all pairs one edit apart, in both directions, from (word, n) of different words.

    Every word stands under the keys of its two halves, and asks there for words of its length, and
    under the two halves of a word one letter shorter for such.  Keys are dealt to parts by hash.  A
    part of too many words is cut into blocks, and each block of queries meets each block of the
    index in a tile of its own.
    """
    spark = words.sparkSession
    keyed = words.withColumn("length", F.length("word"))
    word, length = F.col("word"), F.col("length")
    keyed = keyed.select("word", "n", F.explode(F.array(*_halves(word, length, False), *_halves(word, length, True))).alias("k"))
    rows = 2 * words.count()
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // part_words))
    keyed = stored(keyed.select("word", "n", F.pmod("k.key", F.lit(parts)).alias("part"), "k.indexed"), "word-halves")
    # Both halves, or a half and another's, may lead to one part.
    keyed = keyed.groupBy("part", "word", "n").agg(F.max("indexed").alias("indexed"))
    large = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > 4 * part_words)
    # At most one row per 4 * part_words rows of keys.
    large = stored(large.select("part", F.ceil(F.col("held") / (2 * part_words)).cast("int").alias("blocks")), "large-parts")
    small = large.count() <= 500_000
    cut = keyed.join(F.broadcast(large) if small else large, "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(1), "word"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    indexed = cut.where("indexed").select("part", "word", "n", own.alias("index"), F.explode(others).alias("query"), F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
    asks = cut.select("part", "word", "n", F.explode(others).alias("index"), own.alias("query"), F.lit(False).alias("indexed"), F.lit(True).alias("asks"))
    tiles = indexed.unionByName(asks).groupBy("part", "index", "query")
    return tiles.applyInPandas(_near_pairs, "word string, near string, near_n long").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms are followed to the last, twice as far in each round.

    A form is several times as frequent as its word, so that chains are as long as a logarithm of the
    counts at most, and rounds the logarithm of that.
    """
    found, step = stored(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        step += 1
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = found.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        further = stored(further, f"roots-{step}")
        if not further.where("moved").limit(1).count():
            return further.select("word", "root")
        found = further.select("word", "root")


def spelling_forms(df: DataFrame, key: str = "doc_id", text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of ASCII and Latin-1 letters with A-Z in lower case, damaged by the contract's
    noise (a null key counts as no characters there), of LEAST_LENGTH code points and LEAST_COUNT occurrences
    over all rows, repeated rows included.  A word's form is its most frequent near word (ties: the
    smallest in code-point order) if that is FORM_RATIO times as frequent, else null; ``root`` is where forms end.
    Null and empty texts have no words; an empty table gives no rows; other columns are not read.

    Texts are read once; counts are combined in the tasks before they are shuffled.
    """
    docs = df.select(F.col(key).cast("string"), F.col(text).cast("binary"))
    counted = docs.mapInArrow(lambda b: _counts(b, LEAST_LENGTH), "word string, n long")
    words = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    words = stored(words, "words")
    near = near_pairs(words, part_words)
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.less") >= FORM_RATIO * F.col("n"), F.col("best")).alias("best"),
    )
    known = known.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    known = stored(known, "word-forms")
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
