"""Token ids as length-delimited binary records, in ascending order of documents.

Spark range-partitions the documents; each task writes one data file and one index file to the shared folder.

* Data file: for each document a u64 length, the masked checksum of those eight bytes, the payload, and the
  masked checksum of the payload. Payload: id (i64), whether there is one (u8), bytes per token (u8), token ids.
* Index file: the u64 offset of every record, so a reader can fetch records in any order.

All numbers are little-endian. A checksum is CRC-32 turned right by 15 bits plus a constant. A task writes under
a name of its own and renames at its end, so a repeated attempt replaces a file by an equal one.

Defined results: null text counts as empty and gives the end id alone; null ids come first; rows that repeat an
id follow each other, ordered by their text's hash, and may lie in several files; an empty table gives no files and no rows. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import keep, scratch, slices
from tessitura.llm.tokens import worker_encoder

HEAD = "<qBB"
#: Bytes of text that the encoder gets at once.
SLICE = 4 << 20
READ = "part long, position long, doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    """CRC-32 turned right by 15 bits plus a constant, so that a checksum of data with checksums stays useful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframed(read, size: int | None = None) -> bytes | None:
    """The next record's payload, or None at the end of the file; raises where a checksum fails."""
    length = read(8)
    if not length:
        return None
    if struct.unpack("<I", read(4))[0] != masked(length):
        raise ValueError("broken record length")
    payload = read(struct.unpack("<Q", length)[0])
    if struct.unpack("<I", read(4))[0] != masked(payload):
        raise ValueError("broken record")
    return payload


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def data_name(part: int) -> str:
    """Name of a part's data file."""
    return f"part-{part:07d}.records"


def index_name(part: int) -> str:
    """Name of a part's index file."""
    return f"part-{part:07d}.index"


def write_records(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", spaces_kept: bool = True, end_id: int = 0) -> DataFrame:
    """Writes all documents below ``folder``; ``part, docs, tokens`` of each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = worker_encoder(tokenizer, spaces_kept), struct.pack("<H", end_id)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        names = [f"{root}/{name(part)}" for name in (data_name, index_name)]
        at = docs_here = tokens = 0
        with files.open_output_stream(f"{names[0]}.{attempt}") as data, files.open_output_stream(f"{names[1]}.{attempt}") as index:
            for batch in batches:
                for rows in slices(batch, "text", SLICE):
                    texts = [t or "" for t in rows.column("text").to_pylist()]
                    for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                        record = framed(struct.pack(HEAD, doc_id or 0, doc_id is not None, 2) + ids + end)
                        data.write(record)
                        index.write(struct.pack("<Q", at))
                        at += len(record)
                        docs_here += 1
                        tokens += len(ids) // 2 + 1
        for name in names:
            files.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [docs_here], "tokens": [tokens]})

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    )
    return ordered.mapInArrow(write, "part long, docs long, tokens long")


def read_records(spark: SparkSession, folder: str, parts: int, written: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """Every record of files 0 to ``parts`` - 1; ``start`` counts the tokens before it in its file.

    With ``written``, the documents and tokens of each part, just those files are read, and a file that is missing or
    holds another number of either is an error; ``start`` then counts the tokens before it in all files. Without it
    missing files count as parts without rows.
    """
    known, before = sorted(written or {}), {}
    for part, previous in zip(known, [None, *known]):
        before[part] = 0 if previous is None else before[previous] + written[previous][1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for part in (p for batch in batches for p in batch.column(0).to_pylist()):
            name = f"{root}/{data_name(part)}"
            if written is not None and part not in written:
                continue
            if files.get_file_info(name).size is None:
                if written is not None:
                    raise ValueError(f"lost file {name}")
                continue
            rows, start, position, base = [], 0, 0, before.get(part, 0)
            with files.open_input_stream(name, buffer_size=1 << 20) as data:
                while (payload := unframed(data.read)) is not None:
                    doc_id, has_id, width = struct.unpack_from(HEAD, payload)
                    ids = np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD))
                    rows.append((part, position, doc_id if has_id else None, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start, position = start + len(ids), position + 1
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
            if written is not None and (position, start) != written[part]:
                raise ValueError(f"{name} holds {position} documents and {start} tokens, written were {written[part]}")
            if rows:
                yield _batch(rows)

    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(read, READ)


def read_record(folder: str, part: int, position: int) -> tuple[int | None, np.ndarray]:
    """One document's id and token ids by its place, through the index."""
    files, root = _files(folder)
    with files.open_input_file(f"{root}/{index_name(part)}") as index:
        index.seek(8 * position)
        (at,) = struct.unpack("<Q", index.read(8))
    with files.open_input_file(f"{root}/{data_name(part)}") as data:
        data.seek(at)
        payload = unframed(data.read)
    doc_id, has_id, width = struct.unpack_from(HEAD, payload)
    return (doc_id if has_id else None), np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("part", "position", "doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))


def token_records(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", spaces_kept: bool = True, end_id: int = 0) -> DataFrame:
    """Writes the records and returns ``doc_id, start, n_tokens, ids_crc32`` as read back from them."""
    spark = docs.sparkSession
    folder = scratch(spark, "records")
    parts = keep(write_records(docs, folder, tokenizer, spaces_kept, end_id), "record-parts")
    written = {r["part"]: (r["docs"], r["tokens"]) for r in parts.collect()}
    found = read_records(spark, folder, max(written, default=0) + 1, written)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", "part", "position")
