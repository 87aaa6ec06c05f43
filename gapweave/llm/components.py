"""Connected components of a link table by contraction within tasks and pointer jumping between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _arrow

CHUNK = 500_000  # links that a task holds at once


def stars(u: list[int], v: list[int]) -> dict[int, int]:
    """The least node of each node's component among these links, for all nodes but the least ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in zip(u, v):
        a, b = find(a), find(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: r for x in list(parent) if (r := find(x)) != x}


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the same nodes: each node of a chunk once, linked to the least one it reaches there."""
    u, v = [], []

    def out() -> pa.RecordBatch:
        found = stars(u, v)
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["u", "v"])

    for batch in batches:
        u += batch.column("u").to_pylist()
        v += batch.column("v").to_pylist()
        if len(u) > CHUNK:
            yield out()
            u, v = [], []
    yield out()


def components(links: DataFrame, table: _arrow.Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node, root being the least node of its component.

    A round contracts the links of each task, which leaves a node one link at most however many it had, deals
    them out by node and contracts them again; where a node's new neighbour has a lesser one, the node is linked
    to that instead. It ends when no neighbour has one and no node has two. Rounds grow with the logarithm of
    a chain's length. Every round is written to `table`. Loops, repeats and nulls are ignored; no links give no rows.
    """
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    while True:
        e = table(e.mapInArrow(_contract, "u long, v long").repartition(n, "u").mapInArrow(_contract, "u long, v long"))
        up = table(e.groupBy("u").agg(F.min("v").alias("w"), F.count_distinct("v").alias("c")))
        on = e.join(up.select(F.col("u").alias("v"), "w"), "v", "left")
        left = table(on.filter("w is not null").select("u", "w"))
        if left.isEmpty() and up.filter("c > 1").isEmpty():
            return up.select(F.col("u").alias("node"), F.col("w").alias("root")).union(up.select(F.col("w"), F.col("w")).distinct())
        e = on.select("u", F.coalesce("w", "v").alias("v")).filter("u <> v")
