"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size.  Distinct blocks are sorted, by their fingerprints, and
numbered, so that equal blocks, and no others, share an integer name.  Then adjacent names are paired and the
distinct pairs are sorted and numbered in the same way, which halves a document's names, until
each document has one.  Two documents have the same name of the same level if and only if their
texts are equal: no hash decides.

Blocks travel once.  They are grouped by a fingerprint of 128 bits, combined before the shuffle,
with the set of distinct blocks beside it; the naming holds only if every set has one member.
If not, it starts again with another seed, so that results never rest on the fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import identity, kept_rows, let

#: Bytes of a block.
BLOCK_BYTES = 1024
#: A single blank needs no replacement; all other runs do.
_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def normalised(text: str = "text") -> Column:
    """The text with every run of white space as one blank; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _RUNS, " ")


def _blocks(content: Column, size: int) -> Column:
    """The content's blocks, the last one shorter; an empty content is one empty block."""

    def cut(c: Column) -> Column:
        last = F.floor(F.greatest(F.octet_length(c) - 1, F.lit(0)) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * size + 1, F.lit(size)))

    return let(content, cut)


def _prints(block: Column, seed: int, bits: int) -> list[Column]:
    """Two fingerprints; fewer bits than 64 only serve tests."""
    both = [F.xxhash64(F.lit(2 * seed + i), block) for i in range(2)]
    return [F.shiftrightunsigned(h, 64 - bits) for h in both] if bits < 64 else both


#: Bits of a row's place in its partition, as ``monotonically_increasing_id`` puts it.
_PLACE_BITS = 33


def _numbered(keys: DataFrame, label: str, by: list[str], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of distinct ``keys`` and ``name``: the place in the order of ``by`` over the whole table.

    Keys are sorted by ranges; a name is a key's place in its range and the number of keys in those before, so
    that it depends on the keys alone, however they are dealt.
    """
    runs = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = stored(runs.select(*keep, F.monotonically_increasing_id().alias("place")), label)
    part = F.shiftright("place", _PLACE_BITS)
    # One row for each range.
    ranges = runs.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = runs.withColumn("part", part).join(F.broadcast(ranges), "part")
    name = F.col("before") + F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.select(*keep, name.alias("name"))


def _block_names(docs: DataFrame, seed: int, bits: int) -> DataFrame | None:
    """Names of the fingerprints of all blocks; None if one stands for two different blocks."""
    rows = docs.select(F.explode("blocks").alias("block"))
    p, q = _prints(F.col("block"), seed, bits)
    sets = rows.groupBy(p.alias("p"), q.alias("q")).agg(F.collect_set("block").alias("found"))
    # Fingerprints of one block each order the blocks as well as their bytes do, and are even and short.
    sets = sets.select("p", "q", F.size("found").alias("n"))
    names = _numbered(sets, "block-names", ["p", "q"], ["p", "q", "n"])
    return None if names.where("n > 1").limit(1).count() else names.drop("n")


def exact_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, print_bits: int = 64
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal after each run of white space became one blank; null counts as empty.  Of
    equal ones the row with the smallest key stays, null keys last; of rows that repeat a key
    exactly one stays.  ``text_sha256`` is of the normalised text.  Other columns are not read,
    and an empty table gives no rows.

    Hot blocks and pairs are combined before each shuffle; the joins that give the names back
    have no aggregate on their stage, so that Spark splits a skewed side.  Tables read again are
    in the shared folder.  Levels are as many as the longest text needs, log2 of its blocks.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.encode(normalised(text), "UTF-8").alias("content"))
    docs = docs.withColumn("blocks", _blocks(F.col("content"), block_bytes))
    seed, names = 0, None
    while names is None:
        names = _block_names(docs, seed, print_bits)
        seed += names is None

    def prints(block: Column) -> Column:
        p, q = _prints(block, seed, print_bits)
        return F.struct(p.alias("p"), q.alias("q"))

    # One row per document, numbered once: the number is fixed by being written.
    rows = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("content", 256).alias("text_sha256"),
            F.transform("blocks", prints).alias("prints"),
        ),
        "documents",
    )
    spread = rows.select("row", F.posexplode("prints").alias("pos", "print"))
    named = spread.select("row", "pos", "print.*").join(names, ["p", "q"]).select("row", "pos", "name")
    longest = rows.agg(F.max(F.size("prints"))).first()[0] or 1
    named, level = stored(named, "names"), 0
    while longest > 1:
        # A document's names meet in pairs; the last of an odd number stands with none.
        pairs = named.groupBy("row", F.expr("pos div 2").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        pairs = pairs.withColumn("right", F.coalesce("right", F.lit(-1)))
        pairs = stored(pairs, f"pairs-{level}")
        names = _numbered(pairs.select("left", "right").distinct(), f"pair-names-{level}", ["left", "right"], ["left", "right"])
        old, named = named, stored(pairs.join(names, ["left", "right"]).select("row", "pos", "name"), f"names-{level}")
        discard(old, pairs)
        longest, level = (longest + 1) // 2, level + 1
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    identified = stored(rows.select("row", "doc_id", "text_sha256").join(named.select("row", "name"), "row"), "identities")
    groups = identified.groupBy("name").agg(first, F.count(F.lit(1)).alias("group_size"))
    return identified.join(groups, "name").select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        "row",
    )


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``df`` without further copies: of equal texts the row that ``exact_groups`` keeps.

    Of rows that repeat a key and a text the least in order of all columns stays.
    """
    kept = exact_groups(df, key, text).where("kept")
    digest = F.sha2(F.encode(normalised(text), "UTF-8"), 256)
    return kept_rows(df, key, digest, kept.select(*identity("doc_id", F.col("text_sha256"))))
