"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of five-word shingles; equal sets are one class. Every class walks down ``TREES`` independent
trees. A root is the class's minwise value under one hash; a node of more than ``LEAF`` classes passes each class
on to two children, each named by a coordinate that the node's own hash selects and the class's minwise token at it.
Small nodes compare all their members' sketches. A pair of similarity 0.85 stays together down to a leaf of one tree
with a probability of about 0.82, so eight trees miss one pair in a million.

Leaves propose links in two rounds, so that a group of copies never lists all its pairs: first every class proposes
its closest earlier neighbour; proposals are confirmed on full sets and linked classes merge. Then leaves propose
every remaining pair whose members are not yet merged, judged by a finer sketch of the classes that had any
neighbour; those are confirmed too, and components are final.

A large node is branched for as long as its children together hold at most half of its pairs; on one path no
coordinate is used twice. The members of a node that no longer splits are first dealt at random to blocks of ``LEAF``
that all hold the node's first class too, so that most of a group of copies merges there. Then its blocks are compared
pair by pair, all of them but pairs of blocks of one and the same component: in the first round by sketch, in the second
by finer sketch. So each pair of such a node is compared unless it is linked already, at a cost that grows with the
square of its unmerged members. Every comparison's memory is bounded by ``LEAF`` and ``BLOCK``.

Defined results: null, empty and white-space texts have no shingles and are alone; fewer than five words are one
shingle; rows that repeat a text are one class; rows of null id are linked like others, and a component of null ids
alone has a null component_id; an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm import hashing
from tessitura.llm.common import keep, slices, text_bytes
from tessitura.llm.graph import components

WIDTH = 5
PERCENT = 85
TREES = 8
COORDINATES = 128
#: Agreeing coordinates below which a pair's similarity is at least 3.9 standard deviations under the threshold.
AGREE = 93
#: The same for the finer sketch of the second round.
FINE = 1024
FINE_AGREE = 826
LEAF = 512
#: A block of a node that no longer splits holds about so many times ``LEAF`` classes.
BLOCK = 4
SETS = "doc_id long, text_key binary, n long, class binary, roots binary, sketch binary"
ROWS = "node long, class binary, n long, sketch binary, used binary, parent long, above long"
PLAIN = ["node", "class", "n", "sketch"]
_SEEDS = np.random.default_rng(85).integers(0, 1 << 63, TREES + COORDINATES + FINE, dtype=np.uint64)
_FACTORS = np.random.default_rng(86).integers(0, 1 << 63, TREES + COORDINATES + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _unique(text: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and the offset of each text."""
    ends = np.searchsorted(text, np.arange(texts + 1))
    value = value.copy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and offsets."""
    data, offsets = text_bytes(texts)
    text, value = hashing.shingles(hashing.words(data, offsets), len(texts), WIDTH)
    return _unique(text, value, len(texts))


def _class_keys(value: np.ndarray, at: np.ndarray, some: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(at) - 1, 2), np.uint64)
    if len(some):
        for k in range(2):
            keys[some, k] = np.add.reduceat(hashing.mix(value ^ np.uint64(0xA5A5A5A5 + k)), at[:-1][some])
    return keys


def _least(value: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Minwise token of every set under hash k."""
    return hashing.mix(np.minimum.reduceat((value ^ _SEEDS[k]) * _FACTORS[k], starts))


def _text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def set_rows(docs: DataFrame) -> DataFrame:
    """Text key, size, class, tree roots and sketch of every document."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                value, at = shingle_sets(rows.column("text"))
                count = np.diff(at)
                some = np.flatnonzero(count)
                keys = _class_keys(value, at, some)
                roots = np.zeros((len(count), TREES), "<u8")
                low = np.zeros((len(count), COORDINATES), np.uint8)
                for k in range(TREES if len(some) else 0):
                    roots[some, k] = _least(value, at[:-1][some], k)
                for k in range(COORDINATES if len(some) else 0):
                    low[some, k] = _least(value, at[:-1][some], TREES + k).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text_key"), pa.array(count, pa.int64()), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (keys.astype("<u8"), roots, low))],
                    names=["doc_id", "text_key", "n", "class", "roots", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key")).mapInArrow(sketch, SETS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset] if column.type == pa.binary() else np.frombuffer(offsets, np.int64)[column.offset]
    return np.frombuffer(data, np.uint8)[start : start + len(column) * width].reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint8)


def _node_rows(node: np.ndarray, batch: pa.RecordBatch, used: np.ndarray, parent: pa.Array, above: pa.Array) -> pa.RecordBatch:
    masks = pa.array([u.tobytes() for u in used], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(node.view(np.int64)), batch.column("class"), batch.column("n"), batch.column("sketch"), masks, parent, above], names=[*PLAIN, "used", "parent", "above"]
    )


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = _matrix(batch.column("roots"), 8 * TREES).copy().view("<u8")
        used, none = np.zeros((batch.num_rows, COORDINATES // 64), "<u8"), pa.nulls(batch.num_rows, pa.int64())
        for t in range(TREES):
            yield _node_rows(hashing.mix(roots[:, t] + np.uint64(t + 1)), batch, used, none, none)


def _bits(coordinate: np.ndarray) -> np.ndarray:
    """One row of ``COORDINATES`` bits for each coordinate, with that one set."""
    out = np.zeros((len(coordinate), COORDINATES // 64), "<u8")
    out[np.arange(len(coordinate)), coordinate // 64] = np.uint64(1) << (coordinate % 64).astype(np.uint64)
    return out


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = np.asarray(batch.column("node")).view(np.uint64)
        sketch = _matrix(batch.column("sketch"), COORDINATES)
        used = _matrix(batch.column("used"), COORDINATES // 8).copy().view("<u8")
        taken = used
        for branch in range(2):
            chosen = hashing.mix(node ^ np.uint64(0x1234567 + branch))
            coordinate = (chosen % np.uint64(COORDINATES)).astype(np.int64)
            for _ in range(COORDINATES):
                again = (taken & _bits(coordinate)).any(1)
                if not again.any():
                    break
                coordinate = np.where(again, (coordinate + 1) % COORDINATES, coordinate)
            token = sketch[np.arange(len(node)), coordinate].astype(np.uint64)
            child = hashing.mix(chosen + token * np.uint64(0x9E3779B97F4A7C15))
            yield _node_rows(child, batch, used | _bits(coordinate), batch.column("node"), batch.column("m"))
            taken = taken | _bits(coordinate)


def tree_rows(classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``node, class, n, sketch`` of every leaf of 2 to ``LEAF`` classes; the same and ``m`` of larger nodes that no longer split."""
    rows = classes.select("class", "n", "roots", "sketch").mapInArrow(_roots, ROWS)
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    leaves, stuck, level = [], [], 0
    while True:
        here = keep(rows.join(sizes.filter("m > 1"), "node"), f"nodes-{level}")
        leaves.append(here.filter(F.col("m") <= LEAF).select(PLAIN))
        large = here.filter(F.col("m") > LEAF)
        if large.isEmpty():
            break
        rows = keep(large.select(*PLAIN, "used", "m").mapInArrow(_children, ROWS), f"children-{level}")
        counts = keep(rows.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("m"), F.max("above").cast("double").alias("above")), f"sizes-{level}")
        halved = counts.groupBy("parent").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"), F.max("above").alias("above")).filter("2 * pairs <= above * above")
        halved = keep(halved.select("parent"), f"halved-{level}")
        stuck.append(large.join(halved, large["node"] == halved["parent"], "left_anti").select(*PLAIN, "m"))
        sizes = counts.join(halved, "parent", "left_semi").select("node", "m")
        level += 1
    return reduce(DataFrame.unionByName, leaves), keep(reduce(DataFrame.unionByName, stuck), "stuck") if stuck else None


def dealt(stuck: DataFrame) -> DataFrame:
    """Members of nodes that no longer split in random blocks of ``LEAF``, each with the node's first class."""
    blocks = F.ceil(F.col("m") / LEAF).cast("long")
    first = stuck.groupBy("node", "m").agg(F.min(F.struct("class", "n", "sketch")).alias("one"))
    members = stuck.select(F.xxhash64("node", F.pmod(F.xxhash64("class", "node"), blocks)).alias("node"), "class", "n", "sketch")
    pivots = first.select("node", "one", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")).select(
        F.xxhash64("node", "block").alias("node"), "one.*"
    )
    return members.unionByName(pivots).distinct()


def block_pairs(members: DataFrame) -> DataFrame:
    """All pairs of blocks of every node of ``members(node, class, root, ...)``, but those of one root alone.

    A pair of blocks is a node of its own; ``side`` is 0 where a block meets itself, else 1 and 2. A root of many
    classes fills blocks by itself, the others share blocks.
    """
    size = BLOCK * LEAF
    own = keep(members.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c")), "roots-of-nodes")
    mixed = own.groupBy("node").agg(F.count(F.lit(1)).alias("roots"), F.sum(F.when(F.col("c") < size, F.col("c")).otherwise(0)).alias("rest")).filter("roots > 1")
    whole = F.col("c") >= size
    parts = F.ceil(F.when(whole, F.col("c")).otherwise(F.col("rest")) / size).cast("long")
    homes = own.join(mixed, "node").select("node", "root", F.when(whole, F.col("root")).alias("pure"), parts.alias("parts"))
    homes = keep(homes, "homes")
    shared = F.pmod(F.xxhash64("root"), F.col("parts"))
    of_class = F.when(F.col("pure").isNull(), shared).otherwise(F.pmod(F.xxhash64("class", "node"), F.col("parts")))
    placed = members.join(homes, ["node", "root"]).withColumn("block", F.xxhash64("pure", of_class)).drop("pure", "parts")
    every = F.when(F.col("pure").isNull(), F.array(shared)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    blocks = homes.select("node", "pure", F.explode(every).alias("part")).select("node", "pure", F.xxhash64("pure", "part").alias("block")).distinct()
    one, two = (blocks.select("node", F.col("pure").alias(f"pure_{k}"), F.col("block").alias(f"block_{k}")) for k in "ab")
    pairs = one.join(two, "node").filter("block_a <= block_b AND NOT coalesce(pure_a = pure_b, false)")
    pair = F.xxhash64("node", "block_a", "block_b")
    same = F.col("block_a") == F.col("block_b")
    sides = F.when(same, F.array(F.struct(F.col("block_a").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(*(F.struct(F.col(f"block_{k}").alias("block"), F.lit(i).alias("side")) for i, k in ((1, "a"), (2, "b"))))
    )
    meet = pairs.select("node", pair.alias("pair"), F.explode(sides).alias("s")).select("node", "pair", "s.*")
    return placed.join(meet, ["node", "block"]).drop("node", "block").withColumnRenamed("pair", "node")


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one node after another, from rows sorted by node."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        node = np.asarray(batch.column("node"))
        cuts = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column("node")[0].as_py() != node[a]:
                yield pa.concat_tables(held)
                held = []
            if b > a:
                held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def proposals(leaves: DataFrame, labelled: bool) -> DataFrame:
    """Pairs of classes to confirm.

    Without labels every class of a leaf proposes its closest earlier neighbour, of another root where there is a
    ``root`` column, or itself where it is only a neighbour of later ones. With labels every pair of different roots is
    proposed, by the ``fine`` column. A ``side`` column is that of ``block_pairs``.
    """
    name, width, least = ("fine", FINE, FINE_AGREE) if labelled else ("sketch", COORDINATES, AGREE)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for table in _by_node(batches):
            if table.num_rows < 2:
                continue
            table = table.combine_chunks()
            keys, n = table.column("class").to_pylist(), np.asarray(table.column("n"))
            roots = table.column("root").to_pylist() if "root" in table.column_names else keys
            number = {r: i for i, r in enumerate(roots)}
            group = np.array([number[r] for r in roots])
            side = np.asarray(table.column("side")) if "side" in table.column_names else np.zeros(len(keys), int)
            upto = np.where(side == 0, np.arange(len(keys)), np.where(side == 2, (side == 1).sum(), 0))
            sketch = _matrix(table.column(name).chunk(0), width)
            near = np.zeros(len(keys), bool)
            for i in np.flatnonzero(upto).tolist():
                t = upto[i]
                agree = (sketch[:t] == sketch[i]).sum(1)
                fits = (agree >= least) & (100 * np.minimum(n[:t], n[i]) >= PERCENT * np.maximum(n[:t], n[i])) & (group[:t] != group[i])
                if not fits.any():
                    continue
                chosen = np.flatnonzero(fits) if labelled else np.array([np.argmax(np.where(fits, agree, -1))])
                near[:t] |= fits
                near[[*chosen, i]] &= labelled
                left.extend(min(keys[j], keys[i]) for j in chosen)
                right.extend(max(keys[j], keys[i]) for j in chosen)
            if not labelled:
                left.extend(keys[j] for j in np.flatnonzero(near))
                right.extend(keys[j] for j in np.flatnonzero(near))
            if len(left) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    order = ["node", *(["side"] if "side" in leaves.columns else []), "class"]
    return leaves.repartition("node").sortWithinPartitions(*order).mapInArrow(propose, "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= 85 * union; ``texts(class, text)``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text_a"):
                (x, at), (y, bt) = (shingle_sets(rows.column(c)) for c in ("text_a", "text_b"))
                good = []
                for i in range(rows.num_rows):
                    p, q = x[at[i] : at[i + 1]], y[bt[i] : bt[i + 1]]
                    both = np.concatenate([p, q])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    good.append(100 * shared >= PERCENT * (len(both) - shared))
                yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.filter("a <> b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary")


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, text`` and finer sketch of one document of every class in ``wanted(class, doc_id, text_key)``.

    Rows meet by id and text, so null ids are no common key, and equal rows count once.
    """

    def matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                value, at = shingle_sets(rows.column("text"))
                keys = _class_keys(value, at, np.flatnonzero(np.diff(at))).astype("<u8")
                good = [k.tobytes() == c for k, c in zip(keys, rows.column("class").to_pylist(), strict=True)]
                fine = np.zeros((len(good), FINE), np.uint8)
                some = np.flatnonzero(np.diff(at))
                for k in range(FINE if len(some) else 0):
                    fine[some, k] = _least(value, at[:-1][some], TREES + COORDINATES + k).astype(np.uint8)
                out = rows.select(["class", "text"]).append_column("fine", pa.array([f.tobytes() for f in fine], pa.binary()))
                yield out.filter(pa.array(good, pa.bool_()))

    ids = wanted.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "class")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key"))
    met = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))).dropDuplicates(["class"])
    return met.select("class", "text").mapInArrow(matching, "class binary, text string, fine binary")


def _confirmed_texts(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts of the classes that ``pairs`` names, and the pairs that are links."""
    named = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    texts = keep(class_texts(docs, classes.select("class", "doc_id", "text_key").join(named, "class")), "texts")
    return texts, keep(confirmed(pairs, texts), "links")


def _rooted(rows: DataFrame, merged: DataFrame) -> DataFrame:
    return rows.join(merged, "class", "left").withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs(doc_id, text, ...)``."""
    return labelled_rows(docs).drop("text_key")


def labelled_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` and the text's key of every row."""
    rows = keep(set_rows(docs), "sets")
    linkable = rows.filter("n > 0")
    classes = keep(
        linkable.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("text_key"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")),
        "classes",
    )
    leaves, stuck = tree_rows(classes)
    first = keep(proposals(leaves if stuck is None else leaves.unionByName(dealt(stuck)), labelled=False), "proposals")
    texts, links = _confirmed_texts(docs, classes, first)
    merged = keep(components(links), "merged").select(F.col("node").alias("class"), "root")
    if stuck is not None:
        across = block_pairs(_rooted(stuck.drop("m"), merged))
        first = keep(first.unionByName(proposals(across, labelled=False)).distinct(), "block-proposals")
        texts, links = _confirmed_texts(docs, classes, first)
        merged = keep(components(links), "merged-blocks").select(F.col("node").alias("class"), "root")
    known, fine = texts.select("class").distinct(), texts.select("class", "fine").dropDuplicates(["class"])
    rooted = _rooted(leaves.drop("sketch").join(known, "class"), merged)
    mixed = rooted.groupBy("node").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("node")
    open_leaves = rooted.join(mixed, "node").withColumn("side", F.lit(0))
    if stuck is not None:
        open_leaves = open_leaves.unionByName(block_pairs(_rooted(stuck.drop("m", "sketch").join(known, "class"), merged)))
    more = keep(proposals(open_leaves.join(fine, "class"), labelled=True).join(first, ["a", "b"], "left_anti"), "more-proposals")
    late = keep(confirmed(more, texts), "late-links")
    final = merged.select(F.col("class").alias("a"), F.col("root").alias("b")).unionByName(late)
    whole = keep(components(final), "components")
    labelled = classes.select("class", "doc_id", "copies").join(whole.withColumnRenamed("node", "class"), "class", "left")
    least = labelled.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    named_classes = labelled.filter("root IS NOT NULL OR copies > 1").join(least, "root", "left").select("class", F.coalesce("least", "doc_id").alias("component_id"), F.lit(True).alias("grouped"))
    joined = rows.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("class")).alias("class")).join(named_classes, "class", "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns."""
    dropped = labelled_rows(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_dropped"), F.col("text_key").alias("_key")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long").eqNullSafe(dropped["_dropped"]) & (_text_key(docs["text"]) == dropped["_key"]), "left_anti")
