"""Quality by attention over passages (multiple-instance learning).

A document is a bag of passages of 64 words. Every passage is encoded from its bytes: how kinds of characters follow
each other, how long and how varied its words are, and how much of it recurs in its document. A gated attention
network, fitted from document labels alone, weighs the passages; the weighted representation gives the score.

Fitting reads at most ``LABELLED`` documents, chosen by their id's hash, whole.

Defined results: null, empty and white-space texts are one passage of zeros; a training set of one class gives that
class's share to every document; null ids are scored like others; an empty table gives no rows. Only text makes a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm import hashing
from tessitura.llm.common import slices, text_bytes
from tessitura.llm.labelled import remainder, sampled_ids, texts_of

PASSAGE = 64
LABELLED = 4_000
HIDDEN = 24
GATE = 12
EPOCHS = 40
KINDS = 8
WIDTH = KINDS * KINDS + 5


def _kind(c: int) -> int:
    if c >= 128:
        return 7
    char = chr(c)
    if char in "\n\r":
        return 1
    if c <= 32:
        return 0
    if char.isalpha():
        return 3 if char.isupper() else 2
    return 4 if char.isdigit() else 5 if char in ".,;:'\"?!()-" else 6


_KIND = np.array([_kind(c) for c in range(256)], np.int64)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages of all texts in order, and the text of each; every text has at least one."""
    data, offsets = text_bytes(texts)
    found, n = hashing.words(data, offsets), len(texts)
    count = np.bincount(found.text, minlength=n)
    per = np.maximum(1, -(-count // PASSAGE))
    first = np.cumsum(per) - per
    own = first[found.text] + (np.arange(len(found.text)) - (np.cumsum(count) - count)[found.text]) // PASSAGE
    total = int(per.sum())
    out = np.zeros((total, WIDTH), np.float32)
    if len(own):
        opens = np.searchsorted(own, np.arange(total + 1))
        full = np.flatnonzero(opens[1:] > opens[:-1])
        begin, end = found.start[opens[full]], found.end[opens[full + 1] - 1]
        kind = _KIND[data]
        byte_passage = np.full(len(data), -1, np.int64)
        marks = np.zeros(len(data) + 1, np.int64)
        marks[begin] += 1
        np.add.at(marks, end, -1)
        inside = np.cumsum(marks[:-1]) > 0
        byte_passage[inside] = np.repeat(full, end - begin)
        pair = inside[:-1] & inside[1:] & (byte_passage[:-1] == byte_passage[1:])
        index = byte_passage[:-1][pair] * KINDS * KINDS + kind[:-1][pair] * KINDS + kind[1:][pair]
        moves = np.bincount(index, minlength=total * KINDS * KINDS).reshape(total, -1)
        out[:, : KINDS * KINDS] = np.sqrt(moves / np.maximum(moves.sum(1, keepdims=True), 1))
        words = np.bincount(own, minlength=total)
        value = found.prefix_hash()
        seen = np.unique(hashing.mix(value + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        out[:, -5] = np.bincount(own[seen], minlength=total) / np.maximum(words, 1)
        out[:, -4] = np.bincount(own, found.end - found.start, minlength=total) / np.maximum(words, 1) / 10
        out[:, -3] = words / PASSAGE
        next_two = value.copy()
        next_two[:-1] += hashing.mix(value[1:])
        next_two[:-2] += hashing.mix(hashing.mix(value[2:]))
        _, back, times = np.unique(hashing.mix(next_two + found.text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
        out[:, -2] = np.bincount(own, times[back] > 1, minlength=total) / np.maximum(words, 1)
        out[:, -1] = 1
    return out, np.repeat(np.arange(n), per)


class Model(NamedTuple):
    """Scaling of the features and the weights of the network; no weights where the labels had one class."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    constant: float


def _forward(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: tuple[np.ndarray, ...]) -> tuple:
    w, b, v, u, a, c, d = weights
    e = np.tanh(x @ w + b)
    t, s = np.tanh(e @ v), 1 / (1 + np.exp(-np.clip(e @ u, -30, 30)))
    raw = (t * s) @ a
    power = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), lengths))
    alpha = power / np.repeat(np.add.reduceat(power, starts), lengths)
    z = np.add.reduceat(alpha[:, None] * e, starts)
    return e, t, s, alpha, z, 1 / (1 + np.exp(-np.clip(z @ c + d, -30, 30)))


def _slopes(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, y: np.ndarray, weights: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    """Gradients of the mean logistic loss."""
    w, b, v, u, a, c, d = weights
    e, t, s, alpha, z, p = _forward(x, starts, lengths, weights)
    dp = (p - y) / len(y)
    dz = np.repeat(dp, lengths)[:, None] * c
    value = (dz * e).sum(1)
    draw = alpha * (value - np.repeat(np.add.reduceat(alpha * value, starts), lengths))
    dt, ds = draw[:, None] * a * s * (1 - t**2), draw[:, None] * a * t * s * (1 - s)
    de = (alpha[:, None] * dz + dt @ v.T + ds @ u.T) * (1 - e**2)
    return [x.T @ de, de.sum(0), e.T @ dt, e.T @ ds, (t * s).T @ draw, z.T @ dp, dp.sum()]


def fit_bags(bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """A network from bags of encoded passages and their labels, by Adam over batches of 128 bags."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), (), float(y.mean()) if len(y) else 0.5)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    random = np.random.default_rng(seed)
    shapes = [(WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), ()]
    weights = [random.normal(0, 1 / np.sqrt(max(s[0] if s else 1, 1)), s) if i not in (1, 6) else np.zeros(s) for i, s in enumerate(shapes)]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(bags))
        for i in range(0, len(order), 128):
            own = order[i : i + 128]
            lengths = np.array([len(bags[k]) for k in own])
            x = (np.concatenate([bags[k] for k in own]) - mean) / scale
            step += 1
            for k, g in enumerate(_slopes(x, np.cumsum(lengths) - lengths, lengths, y[own], tuple(weights))):
                g = g + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                weights[k] = weights[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, tuple(weights), 0.0)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """A model from ``labels(doc_id, quality)`` without held-out rows."""
    known = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("label"))
    ids = sampled_ids(known.filter(remainder(F.col("doc_id"), 5) != 0), labelled)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                x, own = passages(rows.column("text"))
                ends = np.searchsorted(own, np.arange(rows.num_rows + 1))
                bags = [x[a:b].astype("<f4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])

    rows = texts_of(docs, ids).select("doc_id", F.col("label").cast("long").alias("label"), "text").mapInArrow(encode, "doc_id long, label long, bag binary").toArrow()
    triples = sorted(zip(*(rows[c].to_pylist() for c in ("doc_id", "label", "bag")), strict=True))
    return fit_bags([np.frombuffer(b, "<f4").reshape(-1, WIDTH) for *_, b in triples], np.array([y for _, y, _ in triples], float))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of good quality of each text."""
    if not model.weights or not len(texts):
        return np.full(len(texts), model.constant)
    x, own = passages(texts)
    lengths = np.bincount(own, minlength=len(texts))
    return _forward((x - model.mean) / model.scale, np.cumsum(lengths) - lengths, lengths, model.weights)[-1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(rows.column("text"), model))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
