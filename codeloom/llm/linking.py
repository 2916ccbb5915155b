"""From shared keys to classes of linked nodes, without listing the pairs of a group.

Two nodes that may be linked share a key.  Instead of the pairs below a key, each node of a shared key
gets the key's leader, its smallest node; nodes below one leader form a group.  A group is cut
into blocks, every pair of blocks is verified in one task of bounded size (a tile), and a task gives a
spanning forest of the links that it found, one row per node at most.  A cheaper test may go
first, which says what nodes of a tile meet any other.  Components follow from the forests by rounds
of contraction.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

#: Nodes and payload units (elements, characters) of a block.
BLOCK_NODES = 1024
BLOCK_UNITS = 1_500_000


def distinct_groups(groups: DataFrame) -> DataFrame:
    """Groups of two nodes or more, once if several have the same nodes.

    Sets of nodes are compared by their number, ends and two 64-bit sums.
    """
    marks = groups.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"),
        *[F.bit_xor(F.xxhash64(F.lit(i), F.col("node"))).alias(f"x{i}") for i in range(2)],
    )
    first = marks.where("a <> b").groupBy("n", "a", "b", "x0", "x1").agg(F.min("group").alias("group"))
    return groups.join(first.select("group"), "group")


def _blocks(groups: DataFrame) -> DataFrame:
    """(node, group, one, two) for every pair of blocks that a node takes part in."""
    sized = groups.groupBy("group").agg(F.count(F.lit(1)).alias("nodes"), F.sum("units").alias("units"))
    count = F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("units") / BLOCK_UNITS)).cast("int")
    sized = sized.select("group", count.alias("blocks"))
    placed = groups.join(sized, "group").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("node", "group", "own", "blocks", other)
    # A block meets itself in the pair with its neighbour, and alone if it is the only one.
    placed = placed.where("other <> own or blocks = 1")
    return placed.select("node", "group", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"))


def forest(nodes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that links lead to, for nodes where these differ.

    ``linked`` is a symmetric matrix over ``nodes``.
    """
    order = np.argsort(nodes)
    nodes, linked = nodes[order], linked[np.ix_(order, order)]
    np.fill_diagonal(linked, True)
    label = np.arange(len(nodes))
    while True:
        least = np.where(linked, label[None, :], len(nodes)).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


#: Rows of tiles (four numbers each) up to which they are sent to the payloads, which then move once only.
BROADCAST_TILES = 2_000_000


def _delivered(tiled: DataFrame, payloads: DataFrame) -> DataFrame:
    """A row of payload for every row of ``tiled``."""
    return payloads.join(F.broadcast(tiled) if tiled.count() <= BROADCAST_TILES else tiled, "node")


def tiles(groups: DataFrame, units: DataFrame, label: str) -> DataFrame:
    """(node, group, one, two) of all pairs of blocks, stored; ``units`` has (node, units), the size of a node's payload."""
    return stored(_blocks(groups.join(units, "node")), f"{label}-tiles")


_TILE = ["group", "one", "two"]


def _rows_of(table: pa.Table) -> tuple[np.ndarray, dict[str, list]]:
    """Nodes of a tile, each once, and the payload columns of their first rows."""
    nodes, first = np.unique(table.column("node").to_numpy(), return_index=True)
    rows = table.take(pa.array(first))
    return nodes, {c: rows.column(c).to_pylist() for c in table.column_names if c not in (*_TILE, "node")}


def meeting(
    tiled: DataFrame, payloads: DataFrame, meets: Callable[[dict[str, list]], np.ndarray], label: str
) -> DataFrame:
    """The rows of ``tiled`` whose node meets another one of its tile, stored.

    ``meets`` gets the payload columns of a tile's nodes and returns the symmetric matrix of pairs that may
    be linked; ``payloads`` is a stored table with one row per node, or a few equal ones.
    """

    def kept(key: tuple, table: pa.Table) -> pa.Table:
        nodes, columns = _rows_of(table)
        found = meets(columns)
        np.fill_diagonal(found, False)
        nodes = nodes[found.any(axis=1)]
        keys = {c: pa.array([k.as_py()] * len(nodes), t) for c, k, t in zip(_TILE, key, (pa.int64(), pa.int32(), pa.int32()), strict=True)}
        return pa.table({"node": pa.array(nodes, pa.int64()), **keys})

    rows = _delivered(tiled, payloads).groupBy(*_TILE)
    return stored(rows.applyInArrow(kept, "node long, group long, one int, two int"), f"{label}-meeting")


def verified_edges(
    tiled: DataFrame, payloads: DataFrame, links: Callable[[dict[str, list]], np.ndarray]
) -> DataFrame:
    """(a, b) connecting the nodes that are linked, by verification of all tiles.

    ``payloads`` is a stored table with one row per node, or a few equal ones: node and the columns that ``links``
    reads.  ``links`` returns the symmetric matrix of true links.  Tiles are dealt to as many tasks as shuffles have, as their work is in no
    proportion to their bytes, by which adaptive execution would join them.
    """

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        nodes, columns = _rows_of(table)
        a, b = forest(nodes, links(columns))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    parts = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _delivered(tiled, payloads).repartition(parts, *_TILE)
    return rows.groupBy(*_TILE).applyInArrow(verify, "a long, b long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); a component is named by one of its nodes.

    Rounds: every node joins the neighbour, or itself, of the smallest hash in this round; edges
    are renamed and those within a component go.  Hashes change each round, so that long chains
    shrink by a constant factor on average.  Each round is written to the shared folder.
    """
    edges = stored(edges.where("a <> b").distinct(), f"{label}-edges-0")
    both = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct()
    named = stored(both.select(F.col("a").alias("node"), F.col("a").alias("component")), f"{label}-named-0")
    step = 0
    while edges.limit(1).count():
        step += 1
        either = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def weighed(c: str, step: int = step) -> Column:
            return F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("w"), F.col(c).alias("n"))

        best = either.groupBy("a").agg(F.min(weighed("b")).alias("best"))
        parents = stored(
            best.select("a", F.least(F.col("best"), weighed("a"))["n"].alias("parent")), f"{label}-parents-{step}"
        )
        old = [edges, named, parents]
        moved = edges.join(parents, "a").select(F.col("parent").alias("x"), "b")
        moved = moved.join(parents.withColumnRenamed("a", "b"), "b").select("x", F.col("parent").alias("y"))
        edges = stored(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"{label}-edges-{step}",
        )
        named = named.join(parents.withColumnRenamed("a", "component"), "component", "left")
        named = stored(named.select("node", F.coalesce("parent", "component").alias("component")), f"{label}-named-{step}")
        discard(*old)
    discard(edges)
    return named


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets, by products of 0/1 matrices ``width`` elements wide."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    sizes = np.array([len(s) for s in sets])
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = times > 1  # an element of one set meets nothing
    place = np.cumsum(common) - 1
    kept = common[inverse]
    owner, column = owner[kept], place[inverse[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(common.sum())
    for at in range(0, total, width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, min(width, total - at)), dtype=np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out


