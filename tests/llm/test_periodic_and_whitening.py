"""Periodic runs against all periods tried, whitening against a dense decomposition."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from tessitura.llm import periodic, whitening
from tessitura.llm.queries.periodic import op13_periodic_runs
from tessitura.llm.queries.whitening import op12_whitening

from tests.llm.conftest import edge_rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain_runs(w, least):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - start + q
            if size >= max(least, 2 * q) and not any(all(w[t] == w[t + d] for t in range(start, start + size - d)) for d in range(1, q)):
                out.append((start, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {t for s, n, q in runs for t in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plain_tail(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_rows(seed):
    rng = random.Random(seed)
    rows = [(5, "a " * 40), (3, "x y\tz " * 9), (3, "x y\tz " * 9), (None, "b c " * 12), (7, None), (8, ""), (9, " \n"), (70, "A a " * 8 + "a a a a a a a a a a a a"), (71, "é ü " * 7)]
    for i in range(150):
        w = [chr(97 + rng.randrange(rng.choice([2, 4, 26]))) for _ in range(rng.randrange(120))]
        if len(w) > 20:
            p, a = rng.randrange(1, len(w) // 3), rng.randrange(len(w) // 2)
            w = [x if t < a else w[a + (t - a) % p] for t, x in enumerate(w)]
        rows.append((100 + i, " ".join(w)))
    return rows


def test_all_runs_of_small_words():
    rng = random.Random(7)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(50))]
        assert periodic.all_runs(w) == plain_runs(w, 2)


def test_runs_and_collapsed_texts(frame):
    rows = periodic_rows(1)
    got = sorted((repr((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in periodic.periodic_runs(frame(rows)).collect()))
    want = []
    for i, t in rows:
        w = split(t)
        runs = plain_runs(w, 12)
        want.append(repr((i, len(w), runs, plain_collapsed(w, runs))))
    assert got == sorted(want)
    assert periodic.periodic_runs(frame([])).count() == 0
    long = [r for r in periodic.periodic_runs(frame(edge_rows())).collect() if r["doc_id"] == 10]
    assert [(x["start"], x["length"], x["period"]) for x in long[0]["runs"]] == [(0, 60_000, 977)]


def test_query_of_runs_with_tails(spark, frame, tmp_path):
    rows = periodic_rows(2) + [(1000 + i, " ".join(f"w{(i * k) % 50}" for k in range(60))) for i in range(60)]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect())))
    want, tails = [], 0
    for i, t in rows:
        w = plain_tail(i, split(t))
        tails += w != split(t)
        runs = plain_runs(w, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append(repr((i, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest())))
    assert got == sorted(want) and tails > 5


VECTORS = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("size", StringType()), StructField("n", LongType())])


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1) for i, v in rows], VECTORS)


def plain_whitening(rows, components=32):
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    centre = (x * n - sums).astype(float) / n
    values, turned = np.linalg.eigh(centre.T @ centre / n)
    order = np.argsort(-values)[:components]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return values[order], turned[:, order], centre, deviation, values.sum()


def check_whitened(got, rows, size):
    values, turned, centre, deviation, trace = plain_whitening(rows)
    some = min(32, size)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == len(rows) * some
    for c in range(some):
        want = centre @ turned[:, c] / np.sqrt(values[c])
        own = np.array([by[i, c + 1]["whitened"] for i, _ in rows])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-7
        assert all(by[i, c + 1]["deviation"] == (d if d < 1 << 63 else None) and by[i, c + 1]["n"] == len(rows) for (i, _), d in zip(rows, deviation))
        assert abs(by[rows[0][0], c + 1]["explained"] - values[c] / trace) < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_is_the_dense_one_over_usable_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    good = [(i, v) for i, v in enumerate((rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40))).tolist())]
    bad = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("inf")] + [0.0] * 39), (904, [1.0]), (905, [])]
    vectors(spark, good + bad).write.parquet(f"{tmp_path}/embeddings.parquet")
    check_whitened(op12_whitening(spark, str(tmp_path)).collect(), good, 40)


def test_whitening_of_wide_spread_and_dependent_dimensions(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(200, 3)) * [1e5, 1e2, 1.0]
    rows = [(i, v) for i, v in enumerate(np.floor(base * 64) / 64)]
    check_whitened(whitening.whiten(vectors(spark, rows)).collect(), rows, 3)
    twice = [(i, [*v, v[0] + v[1], 7.0]) for i, v in rows]
    got = whitening.whiten(vectors(spark, twice)).collect()
    assert max(r["component"] for r in got) == 3 and got[0]["identity_error"] < 1e-6


def test_whitening_of_ties_repeats_nulls_and_nothing(spark):
    tied = [(i, [1.0 if i % 4 == k else -1.0 if i % 4 == k + 2 else 0.0 for k in range(2)]) for i in range(8)] + [(None, [0.0, 0.0]), (3, [0.0, 0.0])]
    got = whitening.whiten(vectors(spark, tied)).collect()
    assert len(got) == 20 and {r["n"] for r in got} == {10} and {round(r["explained"], 12) for r in got} == {0.5}
    for rows in ([], [(1, [1.0, 2.0])], [(1, [2.0]), (2, [2.0])], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).count() == 0
    huge = whitening.whiten(vectors(spark, [(1, [1e300]), (2, [0.0]), (3, [-1e300])])).collect()
    assert len(huge) == 3 and huge[0]["whitened"] is not None


def test_exact_deviations_beyond_floats():
    x = np.array([[5_000_000_000, 1], [2, 3]])
    for n in (7, 1 << 40):
        sums = (n * 3 + 5, n * 9 + 1)
        want = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums)) for row in x]
        assert whitening.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want]
