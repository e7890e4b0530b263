"""Shards of nearly equal bytes that never split equal texts, by a minimax contiguous partition.

Groups of equal texts are ordered by the first 60 bits of their text's MD5. A capacity is feasible if filling shards
greedily in that order needs no more shards than there are; binary search finds the smallest feasible one, and the
cuts are where the greedy filling at that capacity places them.

The order is never gathered. Spark sums groups by hash prefix; the driver sees ``BLOCKS`` prefixes at first and keeps
two bounds for every cut: prefixes taken as indivisible, and as divisible anywhere. Only prefixes between the two
bounds of a cut are refined by ``REFINE`` more bits, until each holds one group and both bounds agree. So the driver
holds some thousands of sums at any input size, and a document's shard is a comparison of its hash with the cuts.

Slots are running numbers inside a shard in the order of the document id's MD5, counted by blocks first so that no
task orders a whole shard.

Defined results: null text has no bytes and belongs to the group of empty texts; rows that repeat an id and a text
get neighbouring slots in no defined order; fewer groups than shards leave shards empty; an empty table gives no
rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import keep

SHARDS = 40
OVERHEAD = 16
BITS = 60
BLOCKS = 4096
REFINE = 6


class Prefix(NamedTuple):
    """Groups whose hash starts at ``low`` and whose first ``bits`` bits agree."""

    low: int
    bits: int
    total: int
    largest: int
    groups: int


def _greedy(parts: list[Prefix], capacity: int, shards: int, divisible: bool) -> list[int] | None:
    """Sum before each cut, or None where ``shards`` do not suffice; prefixes of several groups may be divisible."""
    cuts, start, at = [], 0, 0
    for part in parts:
        if part.largest > capacity:
            return None
        if divisible and part.groups > 1:
            while at + part.total - start > capacity:
                start = start + capacity
                cuts.append(start)
        elif at + part.total - start > capacity:
            if part.total > capacity:
                return None
            start = at
            cuts.append(start)
        at += part.total
        if len(cuts) >= shards:
            return None
    return cuts


def _smallest(parts: list[Prefix], shards: int, divisible: bool) -> int:
    """Smallest feasible capacity."""
    low, high = max(p.largest for p in parts), max(sum(p.total for p in parts), 1)
    while low < high:
        middle = (low + high) // 2
        if _greedy(parts, middle, shards, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _undecided(parts: list[Prefix], shards: int) -> list[Prefix]:
    """Prefixes of several groups that may hold a cut of the exact solution."""
    low, high = _smallest(parts, shards, True), _smallest(parts, shards, False)
    total, ranges = sum(p.total for p in parts), []
    first = _earliest(parts, low, shards)
    last = _greedy(parts, high, shards, True) or []
    for j, begin in enumerate(first):
        ranges.append((begin, last[j] if j < len(last) else total))
    found, at = [], 0
    for p in parts:
        if p.groups > 1 and any(b < at + p.total and e > at for b, e in ranges):
            found.append(p)
        at += p.total
    return found


def _earliest(parts: list[Prefix], capacity: int, shards: int) -> list[int]:
    """Lower bounds of the cuts: each falls back to the start of the prefix it lands in, or by its largest group."""
    cuts, start, at = [], 0, 0
    for part in parts:
        while at + part.total - start > capacity and len(cuts) < shards - 1:
            start = max(at, start + capacity - part.largest)
            cuts.append(start)
        at += part.total
    return cuts


def _sums(groups: DataFrame, bits: int) -> list[Prefix]:
    shift = BITS - bits
    prefix = F.shiftright("hash", shift)
    rows = groups.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("total"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("groups"))
    return [Prefix(r["prefix"] << shift, bits, r["total"], r["largest"], r["groups"]) for r in rows.collect()]


def cut_hashes(groups: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, refine: int = REFINE) -> list[int]:
    """First hash of shards 1, 2, ... of ``groups(hash, size)``, whose sizes are whole groups."""
    bits = blocks.bit_length() - 1
    parts = sorted(_sums(groups, bits))
    if not parts:
        return []
    while open_parts := _undecided(parts, shards):
        finer: list[Prefix] = []
        for bits in sorted({p.bits for p in open_parts}):
            own = [(p.low >> (BITS - bits),) for p in open_parts if p.bits == bits]
            wanted = groups.sparkSession.createDataFrame(own, "own long")
            inside = groups.join(wanted, F.shiftright("hash", BITS - bits) == F.col("own"), "left_semi")
            finer += _sums(inside, min(BITS, bits + refine))
        gone = set(open_parts)
        parts = sorted([p for p in parts if p not in gone] + finer)
    starts, at = {}, 0
    for p in parts:
        starts.setdefault(at, p.low)
        at += p.total
    return [starts[c] for c in _greedy(parts, _smallest(parts, shards, False), shards, False)]


def shard(docs: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs(doc_id, text, ...)``."""
    text = F.coalesce("text", F.lit(""))
    rows = keep(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("hash"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("place"),
        ),
        "shard-rows",
    )
    groups = keep(rows.groupBy("hash").agg(F.sum("size").alias("size")), "shard-groups")
    cuts = cut_hashes(groups, shards, blocks)
    number = sum((F.when(F.col("hash") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = rows.withColumn("shard", number.cast("int")).withColumn("block", F.substring("place", 1, 3))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("place", "doc_id", "hash")
    return placed.join(bases, ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("base") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
