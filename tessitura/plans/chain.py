"""Following next-pointers through a hot key.

A greedy cut rule is a function from one cut to the next, so the chosen cuts are the nodes reached
from the head. Small groups are walked in one task. A large group is walked in blocks: each block
maps the nodes that other blocks point at to the node where the walk leaves the block, the maps are
contracted the same way over groups of blocks, and the short remainder is walked per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tessitura.plans.scan import summary

FOLD_ROWS = 50_000


def fold_runs(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[pa.Table, list[int]], pa.Table], schema: StructType | str
) -> DataFrame:
    """Folds groups of ``rows`` in ``order``, many short groups to one call.

    ``fold`` gets whole groups as one table and the places where they begin, the table's end included. Only the last
    group of a batch waits for the next batch, so a task holds a batch and one group; the caller bounds the groups. Groups are
    told by the place of each row, which moves no row that lies together by some of the keys already.
    """
    ordered = rows.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    def begins(table: pa.Table) -> np.ndarray:
        """First rows of groups, but for the table's first row."""
        found = np.flatnonzero(table["_pos"].to_numpy() == 1)
        return found[found > 0]

    def folded(table: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        yield from fold(table.drop_columns("_pos").combine_chunks(), edges).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = new if held is None else pa.concat_tables([held, new])
            edges = begins(table).tolist()
            held = table.slice(edges[-1]) if edges else table
            if edges:
                yield from folded(table.slice(0, edges[-1]), [0, *edges])
        if held is not None:
            yield from folded(held, [0, held.num_rows])

    return ordered.mapInArrow(run, schema)


def _schema(edges: DataFrame, keys: Sequence[str], *extra: StructField) -> StructType:
    return StructType([*[edges.schema[k] for k in keys], *extra])


def _exits(edges: DataFrame, keys: list[str], block: str) -> DataFrame:
    """For every node, the first node outside its own block on the walk (null at the end)."""

    def leave(table: pa.Table, edges: list[int]) -> pa.Table:
        nodes, nexts = table["node"].to_pylist(), table["nxt"].to_pylist()
        exits: list[int | None] = [None] * len(nodes)
        for a, b in zip(edges, edges[1:]):
            out: dict[int, int | None] = {}
            for i in range(b - 1, a - 1, -1):
                exits[i] = out[nodes[i]] = out.get(nexts[i], nexts[i])
        return table.append_column("exit", pa.array(exits, pa.int64()))

    schema = _schema(
        edges,
        keys,
        StructField("node", LongType()),
        StructField("nxt", LongType()),
        StructField(block, LongType()),
        StructField("head", BooleanType()),
        StructField("exit", LongType()),
    )
    return fold_runs(edges.select(*keys, "node", "nxt", block, "head"), [*keys, block], ["node"], leave, schema)


def _walk(edges: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Nodes reached inside each group from the rows flagged ``entry``."""

    def reach(table: pa.Table, edges: list[int]) -> pa.Table:
        nodes, nexts, entries = (table[c].to_pylist() for c in ("node", "nxt", "entry"))
        kept: list[int] = []
        for a, b in zip(edges, edges[1:]):
            seen = {nodes[i] for i in range(a, b) if entries[i]}
            for i in range(a, b):
                if nodes[i] in seen:
                    kept.append(i)
                    seen.add(nexts[i])
        return table.take(pa.array(kept, pa.int64())).select([*keys, "node"])

    schema = _schema(edges, keys, StructField("node", LongType()))
    return fold_runs(edges.select(*group, "node", "nxt", "entry"), group, ["node"], reach, schema)


def reached(edges: DataFrame, keys: Sequence[str], block: str = "block", fan: int = 256) -> DataFrame:
    """(keys, node) on the walk from each key's ``head`` node.

    ``edges``: keys, ``node``, ``nxt`` (null at the end, otherwise a larger node), ``block``, ``head``.
    """
    keys = list(keys)
    low = summary(_exits(edges, keys, block))
    targets = (
        low.filter(F.col("exit").isNotNull()).select(*keys, F.col("exit").alias("node"))
        .unionByName(low.filter("head").select(*keys, "node"))
        .distinct()
    )
    contracted = low.join(targets, [*keys, "node"]).select(
        *keys, "node", F.col("exit").alias("nxt"), F.floor(F.col(block) / fan).cast("long").alias("super"), "head"
    )
    high = summary(_exits(contracted, keys, "super"))
    high_targets = (
        high.filter(F.col("exit").isNotNull()).select(*keys, F.col("exit").alias("node"))
        .unionByName(high.filter("head").select(*keys, "node"))
        .distinct()
    )
    top = high.join(high_targets, [*keys, "node"]).select(
        *keys, "node", F.col("exit").alias("nxt"), F.col("head").alias("entry")
    )
    visited = _walk(top, keys, keys)
    for level, group in ((high, "super"), (low, block)):
        flagged = level.join(visited.withColumn("entry", F.lit(True)), [*keys, "node"], "left").select(
            *keys, group, "node", "nxt", F.coalesce("entry", F.lit(False)).alias("entry")
        )
        visited = _walk(flagged, keys, [*keys, group])
    return visited
