"""Personal data in documents: strict patterns, and candidates chosen by gradient boosting.

Generators of high recall propose spans that may overlap: the strict patterns without their checks, and looser forms
(spelled-out addresses, long addresses of eight groups, card groups with other separators, numbers without a plus). Each
candidate is described by its format and its surroundings in small whole numbers. Whether it is likely to be personal
data is told by evidence that these numbers do not hold:

* email: the last part of the domain is two letters or more;
* ip: strict ones have parts of at most 255, of the eight groups one is longer than two characters;
* card: 14 to 19 digits that pass Luhn;
* phone: strict ones as they are; looser ones of 10 to 15 digits count if a cue stands before them or if their last nine
  digits are those of a strict phone number in any document.

Boosted trees learn the evidence from format and context. They are fitted on the counts of all feature combinations over
all documents, a table whose size the bins bound (``COMBINATIONS``), and become one SQL expression. For each kind the
threshold is calibrated on the looser candidates alone: the lowest score from which on at least ``PRECISION`` of them have
evidence, among ``LEAST`` or more. Looser candidates at or above it that overlap no strict span are added, with or without
evidence of their own. Strict spans always stay.

Only DataFrame functions touch the documents. Positions are code points: pieces between matches are measured.

Defined results: null text counts as empty; empty texts have no spans; every row gets its own result, repeated or not,
with or without an id; without candidates nothing is fitted and nothing added; an empty table gives no rows. Of added
spans that overlap the earliest stays, and of those the longest, then the first kind. Columns other than the id and the
text are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import keep

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns. Lookbehinds and possessive repeats only keep long runs from being tried again, and
#: card numbers of fewer than 13 digits, which no check passes, are not listed.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser generators.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++"
GROUPS8 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
GROUPED = r"(?<![0-9A-Za-z])[0-9]{4}[\x20._/-]{1,3}(?:[0-9]{4}[\x20._/-]{1,3}[0-9]{4}[\x20._/-]{1,3}[0-9]{2,7}|[0-9]{6}[\x20._/-]{1,3}[0-9]{4,5})(?![0-9A-Za-z])"
PLAIN = r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{2,4}\)?[\x20.-]){2,4}[0-9]{2,5}(?![0-9])"
CUES = (r"(?i)mail|contact|write|@", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|pay|credit", r"(?i)tel|phone|call|mobil|fax")
PART = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
FEATURES = ("kind", "digits", "length", "groups", "longest", "before", "after", "cue")
#: Bins of each feature, in the order of FEATURES.
BINS = (4, 6, 5, 4, 4, 5, 5, 2)
COMBINATIONS = int(np.prod(BINS))
PRECISION = 0.9
LEAST = 20
TREES = 24
SHRINK = 0.3
#: Characters before a span in which a cue counts.
AROUND = 24
#: Last digits by which a number without a plus is the same as one with it.
TAIL = 9
SPAN = "struct<kind:int,start:long,end:long,strict:boolean,check:boolean,tail:string,digits:int,length:int,groups:int,longest:int,before:int,after:int,cue:int>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: int, match: Column) -> Column:
    """Whether a match of a strict pattern passes the kind's check."""
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return F.regexp_like(match, F.lit(rf"^{PART}(\.{PART}){{3}}$"))
    size = F.length(_digits(match))
    if kind == 2:
        return size.between(14, 19) & F.call_function("luhn_check", _digits(match))
    return size.between(10, 15)


def _plausible(kind: int, match: Column) -> Column:
    """Whether a looser match holds what its kind asks for; phones need a cue or a strict twin besides."""
    if kind == 0:
        return F.regexp_like(match, F.lit(r"[A-Za-z]{2,}$"))
    if kind == 1:
        return F.regexp_like(match, F.lit("[0-9A-Fa-f]{3}")) & F.contains(match, F.lit(":"))
    size = F.length(_digits(match))
    if kind == 2:
        return size.between(14, 19) & F.call_function("luhn_check", _digits(match))
    return size.between(10, 15)


def _kind_of_char(char: Column) -> Column:
    return F.when(char == "", 0).when(F.regexp_like(char, F.lit(r"^\s")), 1).when(F.regexp_like(char, F.lit(r"^[A-Za-z]")), 2).when(F.regexp_like(char, F.lit("^[0-9]")), 3).otherwise(4)


def _bin(value: Column, *limits: int) -> Column:
    return sum((F.when(value >= x, 1).otherwise(0) for x in limits), F.lit(0))


def _matches(text: str, pattern: str, hint: Column, kind: int, strict: bool) -> Column:
    """Spans of a pattern with their features; ``hint`` is a cheap test without which nothing can match."""
    pieces, found = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"), F.slice(pieces, 2, F.size(found)).alias("q"), F.slice(found, 2, F.size(found)).alias("r"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        before = F.right(F.concat(acc["before"], x["p"]), F.lit(AROUND))
        after = F.left(F.concat(x["q"], F.coalesce(x["r"], F.lit(""))), F.lit(1))
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), before.alias("p"), after.alias("q"))
        return F.struct(end.alias("at"), F.right(F.concat(before, x["m"]), F.lit(AROUND)).alias("before"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("before"), F.array().cast("array<struct<start:int,end:int,m:string,p:string,q:string>>").alias("spans"))
    spans = F.aggregate(pairs, empty, step, lambda acc: acc["spans"])

    def described(s: Column) -> Column:
        m, numbers = s["m"], F.regexp_extract_all(s["m"], F.lit("[0-9]+"), F.lit(0))
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].cast("long").alias("start"),
            s["end"].cast("long").alias("end"),
            (_valid(kind, m) if strict else F.lit(False)).alias("strict"),
            _plausible(kind, m).alias("check"),
            (F.right(_digits(m), F.lit(TAIL)) if kind == 3 else F.lit(None).cast("string")).alias("tail"),
            _bin(F.length(_digits(m)), 1, 7, 10, 13, 16).alias("digits"),
            _bin(F.length(m), 8, 12, 16, 24).alias("length"),
            _bin(F.size(numbers), 2, 4, 5).alias("groups"),
            _bin(F.coalesce(F.array_max(F.transform(numbers, F.length)), F.lit(0)), 4, 5, 8).alias("longest"),
            _kind_of_char(F.right(s["p"], F.lit(1))).alias("before"),
            _kind_of_char(s["q"]).alias("after"),
            F.when(F.regexp_like(s["p"], F.lit(CUES[kind])), 1).otherwise(0).alias("cue"),
        )

    return F.when(hint, F.transform(spans, described)).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, row, strict, loose``: arrays of spans with features, for every row."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    has = lambda s: F.contains(F.col("text"), F.lit(s))
    digits = F.regexp_like("text", F.lit("[0-9]"))
    proposed = F.concat(
        _matches("text", EMAIL, has("@"), 0, True),
        _matches("text", IP, digits & has("."), 1, True),
        _matches("text", CARD, digits, 2, True),
        _matches("text", PHONE, has("+"), 3, True),
        _matches("text", SPELLED, has("(at)") | has("[at]"), 0, False),
        _matches("text", GROUPS8, has(":"), 1, False),
        _matches("text", GROUPED, digits, 2, False),
        _matches("text", PLAIN, digits, 3, False),
    )
    rows = text.select("doc_id", proposed.alias("spans"))
    meets = lambda s, t: (s["start"] < t["end"]) & (s["end"] > t["start"])
    strict = F.filter("spans", lambda s: s["strict"])
    loose = F.filter("spans", lambda s: ~s["strict"] & ~F.exists("strict", lambda t: meets(s, t)))
    return rows.withColumn("strict", strict).select("doc_id", "strict", loose.alias("loose")).withColumn("row", F.monotonically_increasing_id())


class Tree(NamedTuple):
    """Two levels: a split, and on each side a split with two values."""

    first: tuple[int, int]
    left: tuple[int, int, float, float]
    right: tuple[int, int, float, float]


def _best(x: np.ndarray, slope: np.ndarray, weight: np.ndarray) -> tuple[float, int, int, float, float]:
    """Gain, feature, limit and both values of the best split ``feature >= limit``."""
    def value(g: float, h: float) -> float:
        return SHRINK * g / (h + 1.0)

    total = (slope.sum(), weight.sum())
    best = (0.0, 0, 0, value(*total), value(*total))
    for k, bins in enumerate(BINS):
        g, h = np.bincount(x[:, k], slope, bins), np.bincount(x[:, k], weight, bins)
        for limit in range(1, bins):
            high, low = (g[limit:].sum(), h[limit:].sum()), (g[:limit].sum(), h[:limit].sum())
            gain = high[0] ** 2 / (high[1] + 1) + low[0] ** 2 / (low[1] + 1) - total[0] ** 2 / (total[1] + 1)
            if gain > best[0] + 1e-9:
                best = (gain, k, limit, value(*low), value(*high))
    return best


def boost(x: np.ndarray, yes: np.ndarray, n: np.ndarray, trees: int = TREES) -> tuple[float, list[Tree]]:
    """Base margin and trees from feature rows, their counts with evidence and all counts, under logistic loss."""
    base = float(np.log((yes.sum() + 1) / (n.sum() - yes.sum() + 1)))
    margin, out = np.full(len(x), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, weight = yes - n * p, n * p * (1 - p)
        _, k, limit, *_ = _best(x, slope, weight)
        high = x[:, k] >= limit
        sides = []
        for side in (~high, high):
            _, k2, limit2, low, up = _best(x[side], slope[side], weight[side])
            sides.append((k2, limit2, low, up))
            margin[side] += np.where(x[side, k2] >= limit2, up, low)
        out.append(Tree((k, limit), *sides))
    return base, out


def margins(x: np.ndarray, base: float, trees: list[Tree]) -> np.ndarray:
    """Sum of the trees for feature rows."""
    out = np.full(len(x), base)
    for t in trees:
        sides = [np.where(x[:, s[0]] >= s[1], s[3], s[2]) for s in (t.left, t.right)]
        out += np.where(x[:, t.first[0]] >= t.first[1], sides[1], sides[0])
    return out


def thresholds(x: np.ndarray, yes: np.ndarray, n: np.ndarray, margin: np.ndarray, precision: float = PRECISION, least: int = LEAST) -> list[float | None]:
    """For each kind the lowest margin from which on at least ``precision`` of ``least`` or more candidates have evidence, else None."""
    limits: list[float | None] = []
    for kind in range(len(KINDS)):
        own = x[:, 0] == kind
        limit = None
        for m in np.unique(np.round(margin[own & (n > 0)], 9)):
            above = own & (margin >= m - 1e-9)
            if n[above].sum() >= least and yes[above].sum() >= precision * n[above].sum():
                limit = float(m)
                break
        limits.append(limit)
    return limits


def _margin(span: Column, base: float, trees: list[Tree]) -> Column:
    def leaf(s: tuple[int, int, float, float]) -> Column:
        return F.when(span[FEATURES[s[0]]] >= s[1], F.lit(s[3])).otherwise(F.lit(s[2]))

    return sum((F.when(span[FEATURES[t.first[0]]] >= t.first[1], leaf(t.right)).otherwise(leaf(t.left)) for t in trees), F.lit(base))


def counts(found: DataFrame) -> DataFrame:
    """Per combination of features: strict spans, looser ones (``n``) and looser ones with evidence (``yes``).

    Spans are counted by features and last digits before they meet the strict numbers, so a frequent number is one row.
    """
    spans = found.select(F.explode(F.concat("strict", "loose")).alias("s")).select("s.*")
    alike = spans.groupBy(*FEATURES, "strict", "check", "tail").agg(F.count(F.lit(1)).alias("size"))
    known = spans.filter(F.col("strict") & (F.length("tail") == TAIL)).select("tail").distinct().withColumn("known", F.lit(True))
    proven = F.col("check") & ((F.col("kind") != KINDS.index("phone")) | (F.col("cue") == 1) | F.coalesce("known", F.lit(False)))
    sized = lambda test: F.sum(F.when(test, F.col("size")).otherwise(0))
    return alike.join(known, "tail", "left").groupBy(*FEATURES).agg(sized(F.col("strict")).alias("strict"), sized(~F.col("strict")).alias("n"), sized(~F.col("strict") & proven).alias("yes"))


def chooser(rows: list) -> tuple[float, list[Tree], list[float | None]]:
    """Base margin, trees and thresholds from the rows of ``counts``."""
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    strict, n, yes = (np.array([r[c] for r in rows], float) for c in ("strict", "n", "yes"))
    order = np.lexsort(x.T)
    x, strict, n, yes = x[order], strict[order], n[order], yes[order]
    base, trees = boost(x, strict + yes, strict + n)
    return base, trees, thresholds(x, yes, n, margins(x, base, trees))


def _chosen(found: DataFrame) -> Column:
    """The loose spans that are added, as a column over ``found``."""
    rows = counts(found).collect()
    if not rows:
        return F.array().cast(f"array<{SPAN}>")
    base, trees, limits = chooser(rows)

    def passes(s: Column) -> Column:
        ok = F.lit(False)
        for kind, limit in enumerate(limits):
            if limit is not None:
                ok = ok | ((s["kind"] == kind) & (_margin(s, base, trees) >= limit - 1e-9))
        return ok

    return F.filter("loose", passes)


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    found = keep(candidates(docs), "pii-spans")
    brief = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    place = "array<struct<start:long,kind:int,end:long>>"
    # of added spans that overlap, the earliest stays, and of those the longest
    ordered = F.array_sort(F.transform(_chosen(found), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["kind"].alias("kind"), s["end"].alias("end"))))
    apart = F.aggregate(
        ordered,
        F.struct(F.lit(-1).cast("long").alias("upto"), F.array().cast(place).alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["upto"], F.struct(s["end"].alias("upto"), F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    named = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("strict", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(named(brief(F.col("strict"))), 256).alias("base_sha256"),
        named(F.concat(brief(F.col("strict")), apart)).alias("spans"),
    )
