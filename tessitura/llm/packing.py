"""Packing by minimum bin slack: a bitset subset sum fills each sequence as closely as the remaining lengths allow.

1. Every document is encoded once; whole windows of the capacity are sequences already, the rest of a document
   is one piece of 1 to capacity - 1 ids. The pieces are written with their ordinal inside (part, length).
2. The driver gets one count per length, capacity rows at most whatever the input. Starting from the longest
   length left, a bitset dynamic program over the remaining counts finds the multiset whose sum is closest to
   the capacity; backtracking gives the counts, and the same filling is repeated as often as the counts allow.
   Where a gap stays, the longest piece left gives away as many ids as fit, so only the last sequence is short.
3. A piece's rank inside its length (part offset plus ordinal) names its sequence and place. No task holds all
   pieces of a length, and no row but the counts reaches the driver.

Defined results: null text counts as empty and is its end id alone; rows that repeat an id are packed each;
an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import keep, slices
from tessitura.llm.tokens import worker_encoder

CAPACITY = 2048
#: Bytes of text that the encoder gets at once.
SLICE = 4 << 20
PIECES = "part long, size long, ordinal long, doc_id long, start long, doc_tokens long, crc long, ids binary"
PLACED = "part long, size long, ordinal long, doc_id long, start long, skip long, length long, crc long, doc_tokens long, sequence_id long, offset long"


class Share(NamedTuple):
    """Pieces of ``size`` with ranks ``low`` to ``high``: from id ``skip`` on, ``length`` ids each, ``each`` to a sequence."""

    size: int
    low: int
    high: int
    skip: int
    length: int
    first: int
    each: int
    sequence: int
    offset: int


def closest_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``, by a bitset over sums."""
    sums, steps, limit = 1, [], (1 << room + 1) - 1
    for size in sorted((s for s, n in counts.items() if n > 0 and s <= room), reverse=True):
        left, copies = min(counts[size], room // size), 1
        while left > 0 and not sums >> room & 1:
            copies = min(copies, left)
            steps.append((size, copies, sums))
            sums |= sums << size * copies & limit
            left, copies = left - copies, copies * 2
        if sums >> room & 1:
            break
    target, found = sums.bit_length() - 1, {}
    for size, copies, before in reversed(steps):
        if not before >> target & 1:
            found[size] = found.get(size, 0) + copies
            target -= size * copies
    return found


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[Share]:
    """Where the pieces of every length go; sequences are numbered from 0 without gaps."""
    left = {s: n for s, n in counts.items() if n > 0}
    queues = {s: deque([(s, 0, n, 0)]) for s, n in left.items()}
    shares: list[Share] = []
    sequence = 0

    def take(size: int, number: int) -> Iterator[tuple[int, int, int, int]]:
        left[size] -= number
        while number:
            origin, low, high, skip = queues[size].popleft()
            cut = min(number, high - low)
            if low + cut < high:
                queues[size].appendleft((origin, low + cut, high, skip))
            yield origin, low, low + cut, skip
            number -= cut
        if not left[size]:
            del left[size], queues[size]

    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = closest_filling(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        gap = capacity - sum(s * n for s, n in pattern.items())
        donor = max((s for s, n in left.items() if n > pattern.get(s, 0)), default=0) if gap else 0
        need = dict(pattern)
        if donor:
            need[donor] = need.get(donor, 0) + 1
        repeat = min(left[s] // n for s, n in need.items())
        offset = 0
        for size, each in sorted(pattern.items(), reverse=True):
            first = 0
            for origin, low, high, skip in list(take(size, each * repeat)):
                shares.append(Share(origin, low, high, skip, size, first, each, sequence, offset))
                first += high - low
            offset += size * each
        if donor:
            first = 0
            for origin, low, high, skip in list(take(donor, repeat)):
                shares.append(Share(origin, low, high, skip, gap, first, 1, sequence, offset))
                queues.setdefault(donor - gap, deque()).append((origin, low, high, skip + gap))
                left[donor - gap] = left.get(donor - gap, 0) + high - low
                first += high - low
        sequence += repeat
    return shares


def _by_rank(shares: list[Share]) -> dict[int, tuple[list[int], list[list[Share]]]]:
    """For each length, rank limits and the shares that hold from each limit on."""
    found: dict[int, tuple[list[int], list[list[Share]]]] = {}
    for size in {s.size for s in shares}:
        own = sorted((s for s in shares if s.size == size), key=lambda s: s.low)
        limits = sorted({x for s in own for x in (s.low, s.high)})
        lists: list[list[Share]] = [[] for _ in limits]
        for s in own:
            for i in range(bisect.bisect_left(limits, s.low), bisect.bisect_left(limits, s.high)):
                lists[i].append(s)
        found[size] = (limits, lists)
    return found


def pieces(docs: DataFrame, tokenizer: str, spaces_kept: bool, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Whole windows and rests of all documents; ids only for rests, which may still be cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = worker_encoder(tokenizer, spaces_kept), struct.pack("<H", end_id)
        part, ordinals = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        kinds = pa.schema([("part", pa.int64()), ("size", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("crc", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                out = []
                for doc_id, raw in zip(rows.column("doc_id").to_pylist(), encoder.encode([t or "" for t in rows.column("text").to_pylist()]), strict=True):
                    ids = np.frombuffer(raw + end, "<u2")
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        size = len(own)
                        out.append((part, size, int(ordinals[size]), doc_id, start, len(ids), zlib.crc32(own.astype("<u4").tobytes()), own.tobytes() if size < capacity else None))
                        ordinals[size] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", spaces_kept: bool = False, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece."""
    table = keep(pieces(docs, tokenizer, spaces_kept, end_id, capacity), "pieces")
    counts = keep(table.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    by_size = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = _by_rank(fillings(by_size, capacity))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.drop("ids").join(bases, ["size", "part"]).withColumn("rank", F.col("base") + F.col("ordinal")).drop("base")
    names = [f.split()[0] for f in PLACED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in ("part", "size", "ordinal", "doc_id", "start", "doc_tokens", "crc", "rank")]
            for part, size, ordinal, doc_id, start, tokens, crc, rank in zip(*columns, strict=True):
                limits, lists = plan[size]
                for s in lists[bisect.bisect_right(limits, rank) - 1]:
                    i = rank - s.low + s.first
                    whole = s.length == size
                    out.append((part, size, ordinal, doc_id, start + s.skip, s.skip, s.length, crc if whole else None, tokens, s.sequence + i // s.each, s.offset + i % s.each * s.length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("crc")
            crcs = [zlib.crc32(np.frombuffer(ids, "<u2")[skip : skip + n].astype("<u4").tobytes()) for ids, skip, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "skip", "length")), strict=True)]
            yield batch.set_column(at, "crc", pa.array(crcs, pa.int64())).select(names)

    placed = keep(ranked.mapInArrow(place, PLACED), "placed")
    split = placed.filter("crc IS NULL").join(table.select("part", "size", "ordinal", "ids"), ["part", "size", "ordinal"]).mapInArrow(checked, PLACED)
    return placed.filter("crc IS NOT NULL").unionByName(split).select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
