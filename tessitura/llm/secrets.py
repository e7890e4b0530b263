"""Secrets in documents: strict patterns, and weaker candidates that only count together.

Strict spans stand alone. Weaker parts are identifiers (user and account assignments), keys (long mixed tokens) and
endpoints (addresses). An interval join on (document, cell of text) brings every weak part together with all parts
within ``REACH`` code points. A weak key is reported next to an identifier or endpoint, a weak identifier next to a
secret, an endpoint next to both. Parts of one kind never overlap, so a cell holds few of them and a document with
very many spreads over its cells.

Defined results: null text counts as empty; empty texts have no spans; every row gets its own result, repeated or not,
with or without an id; an empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import keep, slices
from tessitura.plans.intervals import overlap_join

REACH = 160
#: The strict patterns, by kind and in their listed order.
ASSIGN = r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Weak parts.
IDENTIFIER = r"(?ai:user(?:name)?|login|account|client_?id|key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"
KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"https?://[^\s\"'<>|]+"
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
ROLES = ("secret", "identifier", "secret", "identifier", "secret", "endpoint")
PARTS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, parts array<struct<kind:int,start:long,end:long>>"


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, leftmost and non-overlapping per kind; failing matches are dropped."""
    found, low = [], text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        found += [(0, m.start(), m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in re.finditer(HEX, text)]
    return found


def weak_spans(text: str, strict: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of weak parts that touch no strict span; none where no two roles can meet."""
    identifiers = [m.span() for m in re.finditer(IDENTIFIER, text)] if any(w in text.lower() for w in ("user", "login", "account", "client", "key")) else []
    endpoints = [m.span() for m in re.finditer(ENDPOINT, text)] if "://" in text else []
    if not identifiers and not endpoints and not any(k == 1 for k, *_ in strict):
        return []
    keys = [m.span() for m in re.finditer(KEY, text) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
    parts = [(3, *s) for s in identifiers] + [(4, *s) for s in keys] + [(5, *s) for s in endpoints]
    taken = bytearray(len(text) + 1)
    for _, a, b in strict:
        taken[a:b] = b"\1" * (b - a)
    return [p for p in parts if not any(taken[p[1] : p[2]])]


def _listed(parts: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(parts, key=lambda p: (p[1], p[0])))


def parts_of(docs: DataFrame) -> DataFrame:
    """Counts and digest of the strict spans of every row, and all its parts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                out = []
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    strict = strict_spans(text or "")
                    counts = [sum(k == i for k, *_ in strict) for i in range(3)]
                    digest = hashlib.sha256(_listed(strict).encode()).hexdigest()
                    parts = strict + weak_spans(text or "", strict)
                    out.append((doc_id, *counts, digest, [{"kind": k, "start": a, "end": b} for k, a, b in parts]))
                kinds = [pa.int64()] * 4 + [pa.string(), PARTS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "parts"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, FOUND)


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak parts of ``parts(row, kind, start, end)`` that have their complement within ``reach``."""
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("kind") + 1)
    weak = parts.filter("kind >= 3").select("row", "kind", role.alias("own"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    scopes = parts.select("row", role.alias("other"), (F.col("start") - reach).alias("s_start"), (F.col("end") + reach).alias("s_end"))
    near = overlap_join(weak, scopes, ["row"], scale=1.0, cell=4.0 * reach)
    met = near.groupBy("row", "kind", "own", "p_start", "p_end").agg(*(F.max(F.col("other") == r).alias(r) for r in ("secret", "identifier", "endpoint")))
    reported = (
        F.when(F.col("own") == "secret", F.col("identifier") | F.col("endpoint"))
        .when(F.col("own") == "identifier", F.col("secret"))
        .otherwise(F.col("secret") & F.col("identifier"))
    )
    return met.filter(reported).select("row", "kind", F.col("p_start").alias("start"), F.col("p_end").alias("end"))


def secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and the parts behind them, of every row."""
    found = keep(parts_of(docs).withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    open_rows = found.filter(F.exists("parts", lambda p: p["kind"] >= 3))
    weak = linked(open_rows.select("row", F.explode("parts").alias("p")).select("row", "p.*"), reach)
    by_row = weak.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak"))
    strict = F.filter("parts", lambda p: p["kind"] < 3)
    every = F.concat(strict, F.coalesce("weak", F.array().cast("array<struct<kind:int,start:long,end:long>>")))
    ordered = F.array_sort(F.transform(every, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))))
    named = F.transform(ordered, lambda p: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), p["kind"] + 1), p["start"], p["end"]))
    return found.join(by_row, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(named, ",").alias("spans"))
