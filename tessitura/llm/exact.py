"""Exact deduplication by a Grace hash partition that compares complete content.

Texts are equal when they are identical after every run of ASCII white space becomes one space.

1. Every input task merges its own equal texts first, so a text that a third of all rows share leaves
   each task once, with the smallest id and the number of rows.
2. Spark deals the merged records by digest. A task streams its records into an open-addressing table
   that compares whole contents. Once the table holds ``TABLE_BYTES``, records whose content it does not
   know go to spill files by the next bits of the digest, and each file is treated the same way.
3. Rows get their group back by digest pair; groups of one row are left out of that join.

The spill files are the task's own, have no name in the file system and vanish with the task, so a lost
executor only means that Spark runs the task again.

Defined results: null text counts as empty; null ids never win over an id, and a group of null ids only
keeps its null rows; rows that repeat an id and a text are one document, kept or dropped together, and each
counts in the group's size; an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_BYTES = 64 << 20
FAN_OUT = 16
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
GROUPS = "sha string, check long, keep_id long, group_size long"
MERGED = "sha string, check long, content string, keep_id long, group_size long"
_HEAD = "<32sqqqqB"


class ContentTable:
    """Open addressing with linear probing; a slot points at a group, and a hit needs the same whole content."""

    def __init__(self) -> None:
        self.slots, self.contents, self.keys, self.least, self.sizes, self.held = [-1] * 1024, [], [], [], [], 0

    def _slot(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (group := self.slots[at]) >= 0 and self.contents[group] != content:
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, check: int, content: bytes, least: int | None, size: int, grow: bool = True) -> bool:
        """Counts a record in its group; without ``grow`` an unknown content is refused."""
        at = self._slot(digest, content)
        group = self.slots[at]
        if group >= 0:
            known = self.least[group]
            self.least[group] = least if known is None else known if least is None else min(known, least)
            self.sizes[group] += size
            return True
        if not grow:
            return False
        self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.keys.append((digest, check))
        self.least.append(least)
        self.sizes.append(size)
        self.held += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for i, (key, text) in enumerate(zip(self.keys, self.contents, strict=True)):
                self.slots[self._slot(key[0], text)] = i
        return True

    def groups(self, with_content: bool) -> Iterator[pa.RecordBatch]:
        """The groups in batches of bounded size."""
        step = 4096
        for i in range(0, len(self.keys), step):
            keys = self.keys[i : i + step]
            columns = {"sha": pa.array([d.hex() for d, _ in keys], pa.string()), "check": pa.array([c for _, c in keys], pa.int64())}
            if with_content:
                columns["content"] = pa.array([c.decode() for c in self.contents[i : i + step]], pa.string())
            columns["keep_id"] = pa.array(self.least[i : i + step], pa.int64())
            columns["group_size"] = pa.array(self.sizes[i : i + step], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    for sha, check, content, least, size in zip(*(batch.column(n).to_pylist() for n in ("sha", "check", "content", "keep_id", "group_size")), strict=True):
        yield bytes.fromhex(sha), check, content.encode(), least, size


def _spilled(file) -> Iterator[tuple]:
    file.seek(0)
    while head := file.read(struct.calcsize(_HEAD)):
        digest, check, least, size, length, has_id = struct.unpack(_HEAD, head)
        yield digest, check, file.read(length), least if has_id else None, size


def grace_groups(records: Iterator[tuple], table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[pa.RecordBatch]:
    """Groups of equal content among (digest, check, content, least id, size) records, in bounded memory.

    Each pass settles at least the contents that its table holds, so the recursion ends.
    """
    table, files = ContentTable(), {}
    for digest, check, content, least, size in records:
        if not table.add(digest, check, content, least, size, table.held < table_bytes or not table.keys):
            part = (digest[16 + level // 2 % 16] >> 4 * (level % 2)) % FAN_OUT
            if part not in files:
                files[part] = tempfile.TemporaryFile()
            files[part].write(struct.pack(_HEAD, digest, check, least or 0, size, len(content), least is not None) + content)
    yield from table.groups(with_content=False)
    del table
    for file in files.values():
        with file:
            yield from grace_groups(_spilled(file), table_bytes, level + 1)


def normal(text: Column) -> Column:
    """The text as it is compared."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def hashed(docs: DataFrame) -> DataFrame:
    """``doc_id``, normalised ``content``, its SHA-256 in hex and a second hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal(F.col("text")).alias("content")).select(
        "doc_id", "content", F.sha2("content", 256).alias("sha"), F.xxhash64("content").alias("check")
    )


def duplicate_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct content: ``sha, check, keep_id, group_size``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            for record in _records(batch):
                table.add(*record)
            if table.held >= table_bytes // 4:
                yield from table.groups(with_content=True)
                table = ContentTable()
        yield from table.groups(with_content=True)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grace_groups((r for batch in batches for r in _records(batch)), table_bytes)

    rows = hashed(docs).select("sha", "check", "content", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return rows.mapInArrow(merge, MERGED).repartition("sha").mapInArrow(settle, GROUPS)


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs(doc_id, text, ...)``."""
    shared = duplicate_groups(docs, table_bytes).filter("group_size > 1")
    rows = hashed(docs).select("doc_id", "sha", "check")
    joined = rows.join(shared, ["sha", "check"], "left")
    alone = F.col("group_size").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    dropped = exact_duplicates(docs, table_bytes).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(normal(docs["text"]), 256)
    return docs.join(dropped, docs["doc_id"].cast("long").eqNullSafe(dropped["_id"]) & (sha == dropped["_sha"]), "left_anti")
