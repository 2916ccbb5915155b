"""Hilbert-curve sharding: rows ordered along a curve through several metadata dimensions.

Every dimension is quantised to ``bits`` bits, the cell's position on the Hilbert curve is
computed, rows are sorted by it and the sorted sequence is cut into runs of equal row counts.
A run covers a compact region of all dimensions at once, so that the manifest's smallest and
largest values let a reader skip shards for a filter on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import stored

#: Lower bits of monotonically_increasing_id: the row's place in its partition.
_PLACE_BITS = 33


@dataclass(frozen=True)
class Dimension:
    """A metadata column and how its values become cells.

    ``category``: equal values share a cell (by hash); ``log``: sizes, by powers of two;
    ``linear``: even steps between the table's smallest and largest value.  Null is cell 0.
    """

    column: str
    kind: str = "category"


#: Dimensions of a documents table.
DOCUMENTS = (
    Dimension("source"),
    Dimension("lang"),
    Dimension("n_chars", "log"),
    Dimension("doc_id", "linear"),
)


def _cells(df: DataFrame, dims: Sequence[Dimension], bits: int) -> list[Column]:
    """One integer in [0, 2^bits) per dimension; one cheap pass for linear bounds."""
    top = (1 << bits) - 1
    linear = [d.column for d in dims if d.kind == "linear"]
    bounds = {}
    if linear:
        row = df.agg(
            *[F.min(F.col(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(linear)],
            *[F.max(F.col(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(linear)],
        ).first()
        bounds = {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(linear)}
    out = []
    for d in dims:
        c = F.col(d.column)
        if d.kind == "category":
            cell = F.pmod(F.xxhash64(c), F.lit(top + 1))
        elif d.kind == "log":
            cell = F.floor(F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1) * ((top + 1) / 32))
        elif d.kind == "linear":
            lo, hi = bounds[d.column]
            if lo is None or hi == lo:
                cell = F.lit(0)
            else:
                cell = F.floor((c.cast("double") - lo) * (top / (hi - lo)))
        else:
            raise ValueError(f"unknown kind of dimension: {d.kind}")
        cell = F.when(c.isNull(), F.lit(0)).otherwise(cell)
        out.append(F.greatest(F.least(cell.cast("long"), F.lit(top)), F.lit(0)).cast("long"))
    return out


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve positions of the columns of ``cells`` (dimensions x rows), by transposed Gray code.

    Whole columns are worked on at once; dimensions times bits must stay below 63.
    """
    x = [c.astype(np.int64) for c in cells]
    n = len(x)
    one = np.int64(1)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations of the nested cubes, the largest first
        p = np.int64(q - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):  # Gray code over the dimensions
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ np.int64(q - 1), flip)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):  # interleave, highest bits first
        for i in range(n):
            index = (index << one) | (((x[i] ^ flip) >> np.int64(b)) & one)
    return index


def hilbert_column(df: DataFrame, dims: Sequence[Dimension] = DOCUMENTS, bits: int = 12) -> Column:
    """The curve index of a row as a column of ``df``."""
    if len(dims) * bits > 62:
        raise ValueError("dimensions times bits must stay below 63")

    @F.pandas_udf(T.LongType())
    def place(cells: pd.DataFrame) -> pd.Series:
        if cells.empty:
            return pd.Series([], dtype="int64")
        return pd.Series(hilbert_index(cells.to_numpy(dtype=np.int64).T, bits))

    names = [f"c{i}" for i in range(len(dims))]
    return place(F.struct(*[c.alias(k) for c, k in zip(_cells(df, dims, bits), names, strict=True)]))


def hilbert_shards(
    df: DataFrame,
    shards: int,
    dims: Sequence[Dimension] = DOCUMENTS,
    bits: int = 12,
    ties: Sequence[str] = ("doc_id",),
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of ``df`` with ``hilbert``, ``shard`` and ``slot``.

    Rows are sorted by curve index, then by ``ties``, nulls first, and cut into ``shards`` runs
    whose row counts differ by one at most; ``slot`` counts from 0 in each run.  Columns ``keep``
    are carried (all by default); of the same names as the three results, the results win.  Rows
    equal in index and ties are put in one of their possible orders.  Empty tables give no rows,
    and shards beyond the number of rows stay empty.

    The sort is by ranges of (index, ties), so that a hot cell is split; places come from the
    number of rows in the ranges before.  The sorted rows are written to the shared folder, so
    nothing of it is done again if an executor is lost.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    names = [c for c in (keep if keep is not None else df.columns) if c not in ("hilbert", "shard", "slot")]
    ordered = df.select(
        F.struct(*names).alias("row"), hilbert_column(df, dims, bits).alias("h"), F.struct(*ties).alias("t")
    )
    runs = stored(
        ordered.repartitionByRange("h", "t").sortWithinPartitions("h", "t")
        .withColumn("m", F.monotonically_increasing_id()),
        "hilbert",
    )
    part = F.shiftright("m", _PLACE_BITS)
    # One row for each range: as many as there are partitions.
    ranges = runs.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
        F.sum("n").over(every).alias("total"),
    )
    ranked = runs.withColumn("part", part).join(F.broadcast(ranges), "part")
    ranked = ranked.withColumn("rank", F.col("first") + F.col("m").bitwiseAND((1 << _PLACE_BITS) - 1))
    # The first `more` shards hold one row more than the others.
    least, more = F.expr(f"total div {shards}"), F.col("total") % shards
    ranked = ranked.withColumn("least", least).withColumn("more", more)
    wide = F.col("more") * (F.col("least") + 1)
    ranked = ranked.withColumn(
        "shard",
        F.when(F.col("rank") < wide, F.expr("rank div (least + 1)"))
        .otherwise(F.col("more") + F.expr("(rank - more * (least + 1)) div greatest(least, 1)"))
        .cast("int"),
    )
    start = F.col("shard") * F.col("least") + F.least(F.col("shard").cast("long"), F.col("more"))
    return ranked.select("row.*", F.col("h").alias("hilbert"), "shard", (F.col("rank") - start).alias("slot"))


def manifest(sharded: DataFrame, dims: Sequence[Dimension] = DOCUMENTS) -> DataFrame:
    """Per shard: rows and the smallest and largest value of every dimension."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(d.column).alias(f"{k}_{d.column}") for d in dims for k, f in (("min", F.min), ("max", F.max))],
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; ``path`` must be shared."""
    parts = sharded.repartition("shard").sortWithinPartitions("shard", "slot")
    parts.write.partitionBy("shard").parquet(path)
