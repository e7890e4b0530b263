"""Embedding whitening by shifted CholeskyQR over distributed Gram passes.

Entries c become the integers x = floor(64 c) + 1,000,000. With A the rows of x less their mean:

1. One pass gives the row count and the exact sums of every dimension, so the mean is known as a fraction.
2. A Gram pass multiplies the centred rows batch by batch in the tasks; Spark adds the cells. The Cholesky factor of
   the Gram matrix plus a small shift is a first R, and Q = A R^-1 by triangular solves of the rows is nearly
   orthogonal. Further passes take the Gram matrix of the current Q, until it is the identity to rounding; the
   factors are multiplied up to one R with A = Q R.
3. The SVD of R, a square of the dimension, gives components and variances. The rows are projected in one last pass.

The driver and the closures hold squares of the dimension, whatever the number of rows. A lost executor costs only
the repetition of its tasks, as each pass reads the table again.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out; so are vectors
shorter or longer than the most frequent length (ties: the longer). Null and repeated ids are rows like any other. An
entry beyond 2^40 in size counts as 2^40. A deviation beyond 64 bits is null. Components without variance (below
1e-11 of the largest) do not exist and are left out, so a single row or an empty table gives no rows. Ties between
eigenvalues keep the order of the decomposition. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, ORIGIN, LARGEST = 64.0, 1_000_000, float(1 << 40)
COMPONENTS = 32
PASSES = 8
RANK = 1e-11
ENTRIES = 1 << 20
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Whitening(NamedTuple):
    """``n`` rows with ``sums`` per dimension; ``components`` has one unit vector a column, ``variances`` and ``explained`` their shares."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part, and their common length as the column ``size``."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter((F.size("embedding") > 0) & finite)
    usual = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("size")).limit(1).collect()
    size = usual[0]["size"] if usual else 0
    return rows.filter(F.size("embedding") == size).withColumn("size", F.lit(size))


def blocks(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integers x of a batch, about ``ENTRIES`` of them at a time."""
    step = max(1, ENTRIES // max(1, size))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        entries = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(part.num_rows, size)
        yield np.arange(at, at + part.num_rows), np.clip(np.floor(SCALE * entries), -LARGEST, LARGEST).astype(np.int64) + ORIGIN


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x less the mean, rounded once: integer parts are subtracted before the fraction."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def solved(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangle, column by column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def totals(rows: DataFrame, size: int) -> tuple[int, tuple[int, ...]]:
    """Row count and exact sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            for _, x in blocks(batch, size):
                n += len(x)
                sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_pydict({"cell": pa.array(range(size + 1), pa.int32()), "value": [*map(str, sums), str(n)]})

    exact = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    found = {r["cell"]: int(r["value"]) for r in rows.select("embedding").mapInArrow(add, "cell int, value string").groupBy("cell").agg(exact).collect()}
    return found.get(size, 0), tuple(found.get(i, 0) for i in range(size))


def gram(rows: DataFrame, size: int, turn, width: int) -> np.ndarray:
    """Sum over all rows of the outer square of ``turn`` of their integers, ``width`` numbers each."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for _, x in blocks(batch, size):
                turned = turn(x)
                total += turned.T @ turned
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "value": pa.array(total[i, j], pa.float64())})

    cells = rows.select("embedding").mapInArrow(multiply, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((width, width))
    for r in cells.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["value"]
    return out


def shifted_factor(square: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of ``square`` plus the smallest workable shift of its diagonal, from ``shift`` on."""
    while True:
        try:
            return np.linalg.cholesky(square + shift * np.eye(len(square))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, np.finfo(float).eps * len(square) * max(1e-300, np.linalg.norm(square, 2)))


def orthogonalise(first: np.ndarray, passes, n: int) -> np.ndarray:
    """R with A = Q R, from the Gram matrix of A; ``passes(R)`` is the Gram matrix of A R^-1."""
    width = len(first)
    bound = min(1e-2, 11 * (n * width + width * (width + 1)) * np.finfo(float).eps / 2) * np.linalg.norm(first, 2)
    upper = shifted_factor(first, bound)
    for _ in range(PASSES):
        again = passes(upper)
        if np.abs(again - np.eye(width)).max() <= 1e-13 * width:
            break
        upper = shifted_factor(again, 0.0) @ upper
    return upper


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows``, as ``usable`` gives them; None where nothing varies."""
    n, sums = totals(rows, size)
    if n < 2:
        return None
    whole = gram(rows, size, lambda x: centred(x, n, sums), size)
    live = np.flatnonzero(np.diag(whole) > 0)
    if not len(live):
        return None

    def passes(upper: np.ndarray) -> np.ndarray:
        return gram(rows, size, lambda x: solved(centred(x, n, sums)[:, live], upper), len(live))

    upper = orthogonalise(whole[np.ix_(live, live)], passes, n)
    _, singular, right = np.linalg.svd(upper)
    variances = singular**2 / n
    some = min(components, int((variances > RANK * variances[0]).sum()))
    turned = np.zeros((size, some))
    turned[live] = right[:some].T
    turned *= np.where(turned[np.abs(turned).argmax(axis=0), np.arange(some)] < 0, -1.0, 1.0)
    scaled = turned / np.sqrt(variances[:some])
    covariance = gram(rows, size, lambda x: centred(x, n, sums) @ scaled, some) / n
    return Whitening(n, sums, turned, variances[:some], variances[:some] / (np.trace(whole) / n), float(np.abs(covariance - np.eye(some)).max()))


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of every row, exact; None beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    near, rest = x - whole, [s % n for s in sums]
    size = np.square(np.abs(near).astype(np.float64) * n + n).sum(axis=1).max(initial=0.0)
    if size < 2.0**62 and n < 1 << 53:
        return np.square(near * n - np.array(rest, np.int64)).sum(axis=1).tolist()
    exact = [sum((v * n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in near.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def apply(rows: DataFrame, size: int, fitted: Whitening) -> DataFrame:
    """Every row's whitened components, one output row each."""
    some = len(fitted.variances)
    scaled = fitted.components / np.sqrt(fitted.variances)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in blocks(batch, size):
                many = np.repeat(at, some)
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": ids.take(pa.array(many)),
                        "component": pa.array(np.tile(np.arange(1, some + 1, dtype=np.int32), len(at))),
                        "n": pa.array(np.full(len(many), fitted.n, np.int64)),
                        "deviation": pa.array(deviations(x, fitted.n, fitted.sums), pa.int64()).take(pa.array(many - at[0])),
                        "whitened": pa.array((centred(x, fitted.n, fitted.sums) @ scaled).ravel()),
                        "explained": pa.array(np.tile(fitted.explained, len(at))),
                        "identity_error": pa.array(np.full(len(many), fitted.identity_error)),
                    }
                )

    return rows.select("vec_id", "embedding").mapInArrow(project, WHITENED)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of ``vectors(vec_id, embedding, ...)``."""
    rows = usable(vectors)
    usual = rows.select("size").limit(1).collect()
    size = usual[0]["size"] if usual else 0
    fitted = fit(rows, size, components) if size else None
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    return apply(rows, size, fitted)
