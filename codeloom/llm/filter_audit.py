"""Interaction of document filters: path counts over the lattice of applied filters.

Every subset of the filters is a state; an order of the filters is a path from the empty state to the
full one, and applying a filter is an edge.  What an edge removes depends on its lower state alone, so
all orders share 2^k states and k 2^(k-1) edges.  Per part, Spark counts the documents of each failure
mask, and from these the documents that survive each state.  The number of orders that reach a state
(forward) times the number that leave the next one (backward) weighs an edge's removals in the sum over
all orders, k! times the Shapley value; the steps of an order are read from the same edges.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

FILTERS = "ABCDE"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_MARKS = re.compile(rb"[#$%&*|]")
#: Bytes that continue a code point in UTF-8.
_CONTINUES = bytes(range(0x80, 0xC0))


def failures(text: str) -> int:
    """Bits 0 to 3 for the conditions A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at the contract's white space
    few = len(words) < 200
    repeats = 100 * len(set(words)) < 50 * len(words)
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    points = len(raw.translate(None, _CONTINUES))
    return few | repeats << 1 | (100 * capitals > 2 * points) << 2 | bool(_MARKS.search(raw)) << 3


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column(2):
            text = text.as_py() or ""
            masks.append(failures(text))
            digests.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
            names=["doc_id", "part", "mask", "digest"],
        )


def paths(n: int) -> tuple[list[int], list[int]]:
    """Orders of ``n`` filters that lead from the empty state to each state, and from it to the full one."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def interactions(masks: DataFrame, filters: str, counts: tuple[str, ...] = ("n",)) -> DataFrame:
    """One row per part, order of ``filters`` and step, from (part, mask, counts...).

    Bit i of ``mask`` is a failure of filter i; the first count is that of documents, for the others
    the removed ones are given as ``<count>_lost``.  Rows of a part and mask may repeat.  A part has one row per
    state between the two groupings, so that nothing is gathered but 2^k sums; k is 8 at most.
    """
    k = len(filters)
    if not 1 <= k <= 8:
        raise ValueError("1 to 8 filters can be audited in all their orders")
    full = (1 << k) - 1
    reach, leave = paths(k)
    summed = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in counts])
    states = summed.select("part", "mask", *counts, F.explode(F.sequence(F.lit(0), F.lit(full))).alias("state"))
    passed = F.col("mask").bitwiseAND(F.col("state")) == 0
    survivors = states.groupBy("part", "state").agg(*[F.sum(F.when(passed, F.col(c)).otherwise(0)).alias(c) for c in counts])
    # 2^k rows per part.
    lattice = survivors.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("state", *counts))).alias("alive"))

    def alive(state: Column | int, count: str = counts[0]) -> Column:
        return F.get(F.col("alive"), F.lit(state) if isinstance(state, int) else state)[count]

    def removed(state: int, f: int) -> Column:
        return alive(state) - alive(state | 1 << f)

    shapley = [
        sum(
            (reach[s] * leave[s | 1 << f] * removed(s, f) for s in range(full + 1) if not s >> f & 1),
            F.lit(0).cast("long"),
        )
        for f in range(k)
    ]
    lattice = lattice.select("part", "alive", F.array(*shapley).alias("shapley"))
    steps = []
    for order in permutations(range(k)):
        state = 0
        for step, f in enumerate(order, 1):
            steps.append(["".join(filters[i] for i in order), step, f, state, state | 1 << f])
            state |= 1 << f
    kind = "array<struct<o:string,step:int,f:int,below:int,above:int>>"
    named = [dict(zip(("o", "step", "f", "below", "above"), s, strict=True)) for s in steps]
    rows = lattice.select("*", F.explode(F.from_json(F.lit(json.dumps(named)), kind)).alias("at"))
    f, below, above = F.col("at.f"), F.col("at.below"), F.col("at.above")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(k)]), f + 1)
    gone = alive(below) - alive(above)
    return rows.select(
        "part", F.col("at.o").alias("filter_order"), F.col("at.step").alias("step"),
        alive(above).alias("kept"), gone.alias("removed"),
        (alive(0) - alive(bit) - gone).alias("redundant"),
        (alive(F.lit(full) - bit) - alive(full)).alias("unique_fails"),
        *[(alive(below, c) - alive(above, c)).alias(f"{c}_lost") for c in counts[1:]],
        F.get(F.col("shapley"), f).alias("shapley"),
    )


def audit(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """Rows of ``interactions`` for the five text filters A to E, with good and toxic documents lost.

    A null text is empty, a null part the empty string.  E compares whole texts (128-bit digests) over
    the table: a row fails if another key that is smaller has its text; rows that repeat a key do not
    fail by each other, null keys neither fail E nor make another one fail.  A document is good (toxic)
    if any label of its key says so; labels of null keys count for nothing.  Other columns are not
    read; an empty table gives no rows.

    Texts are read once and never shuffled.  Rows join on (digest, key) and on the key, so that a group
    of copies is spread, and null keys are spread by their texts.
    """
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text))
    judged = stored(docs.mapInArrow(_judged, "doc_id long, part string, mask int, digest binary"), "filter-masks")
    first = judged.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    judged = judged.join(first.withColumn("is_first", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    judged = judged.select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"),
        F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0).alias("spread"),
    )
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic")
    )
    said = said.where("good = 1 or toxic = 1").withColumn("spread", F.lit(0).cast("long"))
    labelled = judged.join(said, ["doc_id", "spread"], "left")
    sums = labelled.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]
    )
    return interactions(sums, FILTERS, ("n", "good", "toxic"))
