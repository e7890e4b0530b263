"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents stand against documents whose labels are not looked at. The class prior is the toxic share of
the labelled training rows. With it the risk of a classifier over toxic and clean text is estimated from both samples;
where the estimated risk over clean text turns negative, which only overfitting can do, the step goes back instead.
Several logistic classifiers, each fitted on its own resample, are averaged.

Features are hashed words and the first 3 to 9 bytes of longer words, valued by their occurrences per hundred words
(the text counts as a hundred words at least, and values end at ``MOST``), so one chance occurrence in a long text means
little; those whose share differs most between the two samples are kept. Fitting reads at most ``POSITIVE`` + ``UNLABELLED`` documents, chosen by their id's hash.

Defined results: null, empty and wordless texts score the bias alone; a training set without toxic rows gives the
prior to every document; null ids are scored like others; an empty table gives no rows. Only text makes a score.
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

POSITIVE = 2_000
UNLABELLED = 5_000
FEATURES = 2_048
CLASSIFIERS = 3
STEPS = 250
DECAY = 1e-3
BEGINNINGS = (3, 4, 5, 6, 7, 8, 9)
BUCKETS = 1 << 20
#: Occurrences per hundred words below which a feature is left out, at which it counts as present, and the largest value.
LEAST, PRESENT, MOST = 0.2, 0.5, 3.0
LEAST_SCORE = 0.3
#: Standard deviations by which a feature's shares must differ.
STRENGTH = 3.0
FEATURE = np.dtype([("bucket", "<i4"), ("value", "<f4")])


class Model(NamedTuple):
    """Kept buckets in ascending order, their weights for each classifier, and the biases."""

    buckets: np.ndarray
    weights: np.ndarray
    biases: np.ndarray


def buckets_of(texts: pa.Array, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of every feature; only ``kept`` buckets, as positions among them, where given."""
    data, offsets = text_bytes(texts)
    found = hashing.words(data, offsets, hashing.WORDLIKE)
    keys = []
    for k, length in enumerate((None, *BEGINNINGS)):
        own = found if length is None else found.longer(length)
        value = hashing.mix(own.prefix_hash(length) + np.uint64(k)) % np.uint64(BUCKETS)
        text = own.text
        if kept is not None:
            place = np.minimum(np.searchsorted(kept, value), max(len(kept) - 1, 0))
            hit = kept[place] == value if len(kept) else np.zeros(len(value), bool)
            value, text = place[hit], text[hit]
        keys.append(text * BUCKETS + value.astype(np.int64))
    both, times = np.unique(np.concatenate(keys), return_counts=True)
    text = both // BUCKETS
    rate = times / np.maximum(np.bincount(found.text, minlength=len(texts)) / 100, 1)[text]
    some = rate >= LEAST
    return text[some], both[some] % BUCKETS, np.minimum(rate[some], MOST).astype(np.float32)


def _sample(docs: DataFrame, ids: DataFrame) -> list[np.ndarray]:
    """Buckets and values of each document of the sample, in the order of ids."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                text, bucket, value = buckets_of(rows.column("text"))
                ends = np.searchsorted(text, np.arange(rows.num_rows + 1))
                both = np.empty(len(bucket), FEATURE)
                both["bucket"], both["value"] = bucket, value
                lists = [both[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(lists, pa.binary())], names=["doc_id", "features"])

    rows = texts_of(docs, ids.select("doc_id")).select("doc_id", "text").mapInArrow(features, "doc_id long, features binary").toArrow()
    return [np.frombuffer(b, FEATURE) for _, b in sorted(zip(rows["doc_id"].to_pylist(), rows["features"].to_pylist(), strict=True))]


def _matrix(lists: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), len(kept)), np.float32)
    if not len(kept):
        return out
    for row, own in zip(out, lists, strict=True):
        place = np.searchsorted(kept, own["bucket"])
        place[place == len(kept)] = 0
        hit = kept[place] == own["bucket"]
        row[place[hit]] = own["value"][hit]
    return out


def _shares(lists: list[np.ndarray]) -> np.ndarray:
    """Share of the documents in which each bucket is present."""
    every = np.concatenate(lists)
    return np.bincount(every["bucket"][every["value"] >= PRESENT], minlength=BUCKETS) / len(lists)


def kept_buckets(yes: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """The buckets whose shares differ most, in ascending order."""
    share_yes, share_other = _shares(yes), _shares(other)
    spread = np.sqrt(share_other * (1 - share_other) / len(yes) + 1 / len(yes) ** 2)
    strength = np.abs(share_yes - share_other) / spread
    kept = np.sort(np.argsort(-strength, kind="stable")[:FEATURES])
    return kept[strength[kept] > STRENGTH]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_one(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk under logistic loss, by Adam over all rows."""
    width = positive.shape[1]
    theta, first, second = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        w, b = theta[:-1].astype(np.float32), theta[-1]
        zp, zu = positive @ w + b, unlabelled @ w + b
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # gradients by score: toxic rows as toxic, and the clean part from unlabelled less toxic rows as clean
        toxic_p = -prior * _sigmoid(-zp) / len(zp)
        clean_p, clean_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
        if clean < 0:
            gp, gu = -clean_p, -clean_u
        else:
            gp, gu = toxic_p + clean_p, clean_u
        slope = np.append(gp.astype(np.float32) @ positive + gu.astype(np.float32) @ unlabelled, gp.sum() + gu.sum())
        slope[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        theta = theta - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVE, unlabelled: int = UNLABELLED) -> Model:
    """A model from ``labels(doc_id, toxic)``; neither side of it sees a held-out row."""
    known = labels.filter("toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(remainder(F.col("doc_id"), 4) != 2)
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = min(max((toxic or 0) / max(total, 1), 1e-4), 0.9)
    empty = Model(np.zeros(0, np.uint64), np.zeros((CLASSIFIERS, 0)), np.full(CLASSIFIERS, np.log(prior / (1 - prior))))
    if not toxic:
        return empty
    yes = _sample(docs, sampled_ids(known.filter("toxic = 1").select("doc_id"), positives))
    any_ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter(remainder(F.col("doc_id"), 4) != 2).distinct()
    other = _sample(docs, sampled_ids(any_ids, unlabelled))
    if not yes or not other:
        return empty
    kept = kept_buckets(yes, other)
    p, u, random = _matrix(yes, kept), _matrix(other, kept), np.random.default_rng(7)
    fitted = [fit_one(p[random.integers(0, len(p), len(p))], u[random.integers(0, len(u), len(u))], prior) for _ in range(CLASSIFIERS)]
    return Model(kept.astype(np.uint64), np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability of being toxic of each text: the mean over the classifiers."""
    text, place, value = buckets_of(texts, model.buckets)
    sums = np.stack([b + np.bincount(text, w[place] * value, minlength=len(texts)) for w, b in zip(model.weights, model.biases, strict=True)])
    return _sigmoid(sums).mean(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores(rows.column("text"), model))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """The rows that score below ``least``, with all their columns; nothing is shuffled."""

    @F.pandas_udf("double")
    def toxic(texts):
        done = [scores(rows.column("text"), model) for rows in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], names=["text"]), "text")]
        import pandas as pd

        return pd.Series(np.concatenate(done) if done else np.zeros(0))

    return docs.filter(toxic(F.col("text")) < least)
