"""Substring deduplication by suffix automata of reference shards.

A window is 50 consecutive words of one document. It repeats where the same words start in a document with a smaller
id, and every word that a repeating window covers is removed.

1. Every window names one anchor, the run of ``ANCHOR`` words with the least hash in it (ties: the first), so equal
   windows name equal anchors. Neighbouring windows with one anchor make a passage. Anchors of a single document
   cannot repeat and go; what shares an anchor is the reference.
2. Passages of shared anchors are cut out of the texts and merged by content, first in each task, with the least and the
   greatest id. Anchors are dealt to shards of about ``SHARD_WORDS`` words. A task builds the shard's suffix automaton over the
   words themselves; every state knows the least id of the documents in which its strings occur.
3. The passages stream through their shard's automaton, holding the state of the longest match, cut to the window's
   length: its least id tells where the window starts first.
4. Passages with an earlier start go back to the documents that hold them; covered words merge to maximal spans.

An automaton is not sent to every task: passages go to the one shard that can match them, so the work stays
proportional to the shared text. An anchor with more than ``ANCHOR_WORDS`` words of distinct passages would make a
shard too large; its windows are compared one by one instead, grouped by a 128-bit digest. Keys that many rows share
are joined by broadcast; there are at most ``SHARES`` of them whatever the input (``meet``).

Defined results: null and empty texts have no words; documents without an id are no reference and lose nothing;
rows that repeat an id do not repeat each other, and equal rows have equal results; an empty table gives no rows; a
very long text is one row of one task. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import keep, same_row, slices, text_bytes
from tessitura.llm.hashing import mix, words

WINDOW, ANCHOR = 50, 16
SHARD_WORDS, ANCHOR_WORDS = 100_000, 100_000
SHARES = 1000
HELD_BYTES = 16 << 20
SPOTS = "doc_id long, text_key long, anchor long, start int, n int, n_words long, sha string"
PIECES = "doc_id long, text_key long, anchor long, content_key long, start int, n int, content binary, least long, most long, copies long"
FIRSTS = "anchor long, content_key long, copies long, firsts array<long>"
CHANGED = "doc_id long, text_key long, n_removed long, sha string, spans array<struct<start: long, end: long>>"


class ReferenceShard:
    """Suffix automaton of several word sequences; a state knows the least id of the documents its strings occur in."""

    def __init__(self) -> None:
        self.length, self.link, self.steps, self.least = [0], [-1], [{}], [None]

    def _copy(self, at: int, w: int) -> int:
        to, length, link, steps = self.steps[at][w], self.length, self.link, self.steps
        if length[to] == length[at] + 1:
            return to
        copy = len(length)
        length.append(length[at] + 1)
        link.append(link[to])
        steps.append(dict(steps[to]))
        self.least.append(None)
        link[to] = copy
        while at >= 0 and steps[at].get(w) == to:
            steps[at][w] = copy
            at = link[at]
        return copy

    def add(self, ids: Sequence[int], doc_id: int) -> None:
        """Adds one sequence of a document."""
        length, link, steps, least = self.length, self.link, self.steps, self.least
        last = 0
        for w in ids:
            if w in steps[last]:
                last = self._copy(last, w)
            else:
                new = len(length)
                length.append(length[last] + 1)
                link.append(0)
                steps.append({})
                least.append(None)
                at = last
                while at >= 0 and w not in steps[at]:
                    steps[at][w] = new
                    at = link[at]
                if at >= 0:
                    link[new] = self._copy(at, w)
                last = new
            known = least[last]
            least[last] = doc_id if known is None or doc_id < known else known

    def seal(self) -> None:
        """Hands the least ids down to shorter suffixes; to be called once, after the last sequence."""
        least, link = self.least, self.link
        for v in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            own, up = least[v], link[v]
            if least[up] is None or own < least[up]:
                least[up] = own

    def statistics(self, ids: Sequence[int], most: int) -> Iterator[tuple[int, int | None]]:
        """For every position the length of the longest match that ends there, ``most`` at the most, and its least id."""
        length, link, steps, least = self.length, self.link, self.steps, self.least
        at = matched = 0
        for w in ids:
            while at and w not in steps[at]:
                at = link[at]
                matched = length[at]
            if w in steps[at]:
                at, matched = steps[at][w], matched + 1
            if matched >= most:
                while length[link[at]] >= most:
                    at = link[at]
                matched = most
            yield matched, least[at] if at else None


def first_starts(passages: Sequence[tuple[bytes, int]], window: int = WINDOW) -> list[list[int]]:
    """For each (passage, id), the least id of every window, by one automaton over all of them."""
    names: dict[bytes, int] = {}
    sequences = [[names.setdefault(w, len(names)) for w in content.split()] for content, _ in passages]
    shard = ReferenceShard()
    for ids, (_, doc_id) in zip(sequences, passages, strict=True):
        shard.add(ids, doc_id)
    shard.seal()
    return [[least for matched, least in shard.statistics(ids, window) if matched == window] for ids in sequences]


def meet(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``weight`` how many rows of ``left`` hold it.

    Keys with more than one in ``SHARES`` of all ``total`` rows are broadcast, and there are fewer than ``SHARES`` of
    them; no other key makes a task large. Both frames are read twice, so they should be written tables.
    """
    limit = total // SHARES
    heavy = F.broadcast(right.filter(F.col(weight) > limit))
    rest = left.join(heavy.select(keys), keys, "left_anti").join(right.filter(F.col(weight) <= limit), keys)
    return left.join(heavy, keys).unionByName(rest)


def without(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Rows of ``left`` whose key ``right`` does not hold; keys of many rows are left out first, as in ``meet``."""
    limit = total // SHARES
    heavy = F.broadcast(right.filter(F.col(weight) > limit).select(keys))
    return left.join(heavy, keys, "left_anti").join(right.filter(F.col(weight) <= limit).select(keys), keys, "left_anti")


def anchors(own: np.ndarray, text: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of every passage, from word hashes and each word's text."""
    count = len(own) - window + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, width = own, 1
    while width * 2 <= anchor:
        grams = mix(grams[:-width] + np.uint64(0x9E3779B97F4A7C15) * grams[width:])
        width *= 2
    if width < anchor:
        grams = mix(grams[: len(own) - anchor + 1] + np.uint64(0x9E3779B97F4A7C15) * grams[anchor - width :])
    place, wide, span = np.arange(len(grams)), window - anchor + 1, 1
    while span * 2 <= wide:
        place = np.where(grams[place[:-span]] <= grams[place[span:]], place[:-span], place[span:])
        span *= 2
    left, right = place[:count], place[wide - span :][:count]
    place = np.where(grams[left] <= grams[right], left, right)
    whole = np.flatnonzero(text[:count] == text[window - 1 :])
    place = place[whole]
    if not len(whole):
        return np.zeros(0, np.uint64), whole, whole
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return grams[place[begin]], whole[begin], np.diff(np.append(begin, len(place)))


def spots(docs: DataFrame) -> DataFrame:
    """One row per document with its word count and digest, and one per passage with anchor, first word and windows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                data, offsets = text_bytes(rows.column("text"))
                found = words(data, offsets)
                count = np.bincount(found.text, minlength=rows.num_rows)
                shas = [hashlib.sha256(b" ".join(data[a:b].tobytes().split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                grams, first, n = anchors(found.prefix_hash(), found.text)
                owner = found.text[first] if len(first) else np.zeros(0, np.int64)
                at = pa.array(np.concatenate([np.arange(rows.num_rows), owner]))
                none = [pa.nulls(rows.num_rows, t) for t in (pa.int64(), pa.int32(), pa.int32())]
                some = [pa.array(grams.view(np.int64)), pa.array((first - (np.cumsum(count) - count)[owner]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(at),
                        rows.column("text_key").take(at),
                        *[pa.concat_arrays(pair) for pair in zip(none, some, strict=True)],
                        pa.concat_arrays([pa.array(count, pa.int64()), pa.nulls(len(first), pa.int64())]),
                        pa.concat_arrays([pa.array(shas, pa.string()), pa.nulls(len(first), pa.string())]),
                    ],
                    names=[f.split()[0] for f in SPOTS.split(", ")],
                )

    return docs.mapInArrow(find, SPOTS)


def pieces(texts: DataFrame) -> DataFrame:
    """Where passages stand, without content, and each task's distinct passages with content."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] + [pa.int64()] * 3

    def told(held: dict) -> pa.RecordBatch:
        rows = [(None, None, anchor, key, None, *rest) for (anchor, key), rest in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                texts, places = rows.column("text").to_pylist(), rows.column("spots").to_pylist()
                for doc_id, text_key, text, own in zip(rows.column("doc_id").to_pylist(), rows.column("text_key").to_pylist(), texts, places, strict=True):
                    content = text.encode().split()
                    for place in own:
                        start, n, anchor = place["start"], place["n"], place["anchor"]
                        passage = b" ".join(content[start : start + n + WINDOW - 1])
                        key = int.from_bytes(hashlib.blake2b(passage, digest_size=8).digest(), "little", signed=True)
                        out.append((doc_id, text_key, anchor, key, start, n))
                        known = held.get((anchor, key))
                        if known is None:
                            held[anchor, key] = [n, passage, doc_id, doc_id, 1]
                            size += len(passage) + 400
                        else:
                            known[2:] = [min(known[2], doc_id), max(known[3], doc_id), known[4] + 1]
                if out:
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds[:6], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(out), k) for k in kinds[6:]], names=names)
                if size > HELD_BYTES:
                    yield told(held)
                    held, size = {}, 0
        if held:
            yield told(held)

    return texts.mapInArrow(cut, PIECES)


def by_automaton(passages: DataFrame) -> DataFrame:
    """Least ids of the windows of every passage, one automaton a ``shard``; passages that nobody repeats are left out."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("shard", "anchor", "content_key", "content", "least", "most", "copies")
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[0]):
            own = list(group)
            out = [
                (anchor, key, copies, firsts)
                for (_, anchor, key, _, _, most, copies), firsts in zip(own, first_starts([(r[3], r[4]) for r in own]), strict=True)
                if min(firsts) < most
            ]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "content_key", "copies", "firsts"])

    return passages.repartition("shard").sortWithinPartitions("shard").mapInArrow(match, FIRSTS)


def by_window(passages: DataFrame) -> DataFrame:
    """The same for passages of anchors with too many of them: every window is a row of its own."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, out = batch.slice(at, 256), []
                for anchor, key, content, least in zip(*(rows.column(c).to_pylist() for c in ("anchor", "content_key", "content", "least")), strict=True):
                    own = content.split()
                    for j in range(len(own) - WINDOW + 1):
                        out.append((hashlib.blake2b(b" ".join(own[j : j + WINDOW]), digest_size=16).digest(), anchor, key, j, least))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["window", "anchor", "content_key", "j", "least"])

    windows = keep(passages.mapInArrow(explode, "window binary, anchor long, content_key long, j int, least long"), "windows")
    firsts = keep(windows.groupBy("window").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("holders")).filter("holders > 1"), "window-firsts")
    shared = windows.select("window", "anchor", "content_key", "j")
    known = meet(shared, firsts, ["window"], "holders", windows.count()).groupBy("anchor", "content_key").agg(F.map_from_entries(F.collect_list(F.struct("j", "first"))).alias("found"))
    own = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.coalesce(F.element_at("found", j), F.col("least")))
    return (
        passages.select("anchor", "content_key", "n", "least", "most", "copies").join(known, ["anchor", "content_key"], "left")
        .select("anchor", "content_key", "copies", "most", own.alias("firsts"))
        .filter(F.array_min("firsts") < F.col("most"))
        .drop("most")
    )


def cleaned(content: list[bytes], starts: Sequence[int], window: int = WINDOW) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Words outside the windows that begin at ``starts``, and the maximal spans inside."""
    spans: list[tuple[int, int]] = []
    for s in sorted(starts):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], s + window)
        else:
            spans.append((s, s + window))
    kept, at = [], 0
    for a, b in spans:
        kept += content[at:a]
        at = b
    return kept + content[at:], spans


def changed(texts: DataFrame) -> DataFrame:
    """What is left of texts with ``starts`` of repeating windows."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for doc_id, text_key, text, starts in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text_key", "text", "starts")), strict=True):
                    content = text.encode().split()
                    kept, spans = cleaned(content, starts)
                    out.append((doc_id, text_key, len(content) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "text_key", "n_removed", "sha", "spans"])

    return texts.mapInArrow(clean, CHANGED)


def repeated_passages(docs: DataFrame, anchor_words: int = ANCHOR_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, text_key, n_words, n_removed, kept_sha256, spans`` of every row of ``docs(doc_id, text, ...)``; ``spans`` are word numbers."""
    same = ["doc_id", "text_key"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    table = keep(spots(rows), "spots")
    digests = table.filter("sha IS NOT NULL").select("doc_id", "text_key", "n_words", "sha")
    places = table.filter("anchor IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text_key", "anchor", "start", "n")
    shared = keep(
        places.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("holders")).filter("least < most").select("anchor", "holders"), "shared-anchors"
    )
    held = meet(places, shared, ["anchor"], "holders", places.count()).groupBy(*same).agg(F.collect_set(F.struct("start", "n", "anchor")).alias("spots"))
    texts = keep(rows.join(held, same).dropDuplicates(same), "shared-texts")
    found = keep(pieces(texts), "passages")
    passages = keep(
        found.filter("content IS NOT NULL").groupBy("anchor", "content_key", "n", "content").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("copies").alias("copies")), "distinct-passages"
    )
    sizes = keep(passages.groupBy("anchor").agg(F.sum(F.col("n") + WINDOW - 1).alias("words"), F.count(F.lit(1)).alias("contexts")), "anchor-sizes")
    total = sizes.agg(F.sum("contexts").alias("contexts"), F.sum(F.when(F.col("words") <= anchor_words, F.col("words"))).alias("words")).collect()[0]
    crowded = keep(sizes.filter(F.col("words") > anchor_words).select("anchor", "contexts"), "crowded-anchors")
    contexts, shards = total["contexts"] or 0, max(1, -(-(total["words"] or 0) // shard_words))
    usual = without(passages, crowded, ["anchor"], "contexts", contexts).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    firsts = keep(by_automaton(usual).unionByName(by_window(meet(passages, crowded, ["anchor"], "contexts", contexts))), "first-starts")
    standing = found.filter("content IS NULL").select("doc_id", "text_key", "anchor", "content_key", "start")
    repeats = F.filter(F.transform("firsts", lambda f, j: F.when(f < F.col("doc_id"), F.col("start") + j)), lambda s: s.isNotNull())
    starts = meet(standing, firsts, ["anchor", "content_key"], "copies", standing.count()).select(*same, repeats.alias("starts")).filter(F.size("starts") > 0)
    left = changed(texts.select(*same, "text").join(starts.groupBy(*same).agg(F.flatten(F.collect_list("starts")).alias("starts")), same))
    joined = digests.alias("d").join(left.alias("c"), same_row(F.col("d.doc_id"), F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key")), "left")
    return joined.select(
        "d.doc_id",
        "d.text_key",
        "d.n_words",
        F.coalesce("c.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("c.sha", "d.sha").alias("kept_sha256"),
        F.coalesce("c.spans", F.array().cast("array<struct<start: long, end: long>>")).alias("spans"),
    )
