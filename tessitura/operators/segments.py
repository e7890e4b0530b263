"""Candidate spans from word streams: silence islands, cap splits, floors, density, ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.params import SENTENCE_MARKS, SPLIT_SEARCH_TAIL, SegmentParams
from tessitura.plans.chain import FOLD_ROWS, fold_runs, reached
from tessitura.plans.scan import block_prefix, summary, time_block, with_carry

# Long spans of a stream that travel to its words together.
KEY_SPLITS = 1024
ORDER = ["start_s", "end_s", "token_id"]
PIECE_COLUMNS = ["stream_id", "span_no", "piece_no", "start_s", "end_s", "n_words", "first_seq", "last_seq", "floor_s", "cap_s"]


def ends_sentence(text: Column, marks: tuple[str, ...] = SENTENCE_MARKS) -> Column:
    """Whether the trimmed text ends in one of the marks."""
    return F.substring(F.regexp_replace(text, r"(?U)\s+$", ""), -1, 1).isin(*marks)


def linked_words(
    words: DataFrame, gaps: Sequence[float], order: Sequence[str] = ORDER, block: Column | None = None
) -> DataFrame:
    """Adds ``seq``, the previous row's times and one island number per gap.

    A silence strictly over the gap opens an island. "Previous" is the previous row, not the word that
    ends last. Rows are windowed inside (stream, block); only block summaries are linked per stream.
    """
    return linked_with_totals(words, gaps, order, block)[0]


def linked_with_totals(
    words: DataFrame,
    gaps: Sequence[float],
    order: Sequence[str] = ORDER,
    block: Column | None = None,
    sums: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(linked words, totals per stream); totals come from the block summaries, so they cost no pass of their own."""
    sums, maxs = dict(sums or {}), dict(maxs or {})
    window = Window.partitionBy("stream_id", "_block").orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    numbers = range(len(gaps))
    lagged = words.withColumn("_block", time_block(F.col("start_s")) if block is None else block).select(
        "*",
        (F.row_number().over(window) - 1).cast("long").alias("_pos"),
        F.lag("start_s").over(window).alias("_ps"),
        F.lag("end_s").over(window).alias("_pe"),
    )
    local = lagged.select(
        "*", *[(F.col("start_s") - F.col("_pe") > F.lit(float(g))).cast("long").alias(f"_brk{i}") for i, g in enumerate(gaps)]
    ).select("*", *[F.sum(F.coalesce(f"_brk{i}", F.lit(0))).over(upto).alias(f"_run{i}") for i in numbers])
    blocks = summary(
        local.groupBy("stream_id", "_block").agg(
            F.min_by("start_s", "_pos").alias("_head"),
            F.max_by(F.struct("start_s", "end_s"), "_pos").alias("_tail"),
            F.count(F.lit(1)).alias("_rows"),
            *[F.coalesce(F.sum(f"_brk{i}"), F.lit(0)).alias(f"_breaks{i}") for i in numbers],
            *[F.sum(e).alias(n) for n, e in sums.items()],
            *[F.max(e).alias(n) for n, e in maxs.items()],
        )
    )
    totals = blocks.groupBy("stream_id").agg(F.sum("_rows").alias("n_words"), *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in maxs])
    linked = block_prefix(blocks.drop(*sums, *maxs), ["stream_id"], "_block", lasts=["_tail"], sums=["_rows"]).select(
        "*",
        *[
            F.coalesce((F.col("_head") - F.col("_tail.end_s") > F.lit(float(g))).cast("long"), F.lit(0)).alias(f"_open{i}")
            for i, g in enumerate(gaps)
        ],
    )
    if gaps:
        linked = block_prefix(
            summary(linked.select("*", *[(F.col(f"_open{i}") + F.col(f"_breaks{i}")).alias(f"_base{i}") for i in numbers])),
            ["stream_id"],
            "_block",
            sums=[f"_base{i}" for i in numbers],
        )
    based = linked.select(
        "stream_id",
        "_block",
        "_tail",
        F.col("_rows").alias("_seq0"),
        *[(F.col(f"_base{i}") + F.col(f"_open{i}")).alias(f"_base{i}") for i in numbers],
    )
    rows = with_carry(local, based, blocks, ["stream_id"]).select(
        *words.columns,
        (F.col("_seq0") + F.col("_pos")).alias("seq"),
        F.coalesce(F.col("_ps"), F.col("_tail.start_s")).alias("prev_start_s"),
        F.coalesce(F.col("_pe"), F.col("_tail.end_s")).alias("prev_end_s"),
        *[(F.col(f"_base{i}") + F.col(f"_run{i}")).alias(f"island_{i}") for i in numbers],
    )
    return rows, totals


def gap_islands(words: DataFrame, max_gap_s: float) -> DataFrame:
    """Adds ``seq`` (position in time order) and ``span_no`` for one silence threshold."""
    return linked_words(words, [max_gap_s]).drop("prev_start_s", "prev_end_s").withColumnRenamed("island_0", "span_no")


def span_rows(islands: DataFrame) -> DataFrame:
    """One row per raw span; its end is that of the last word in time order, not the largest end."""
    return islands.groupBy("stream_id", "span_no").agg(
        F.min("start_s").alias("start_s"),
        F.max_by("end_s", "seq").alias("end_s"),
        F.count(F.lit(1)).alias("n_words"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def _cut_after(starts: np.ndarray, ends: np.ndarray, closes: np.ndarray, at: int, stop: int, cap: float, origin: float) -> int:
    """Index of the last word of the piece that begins at ``at``; ``stop`` is the span's last word."""
    reach = int(np.searchsorted(starts, origin + cap + 1e-6, side="right"))
    reach = max(reach, at + 1)
    relative = ends[at:reach] - origin
    fits = relative <= cap
    tail = np.flatnonzero(fits & (relative >= cap * (1.0 - SPLIT_SEARCH_TAIL)) & closes[at:reach])
    if tail.size:
        return at + int(tail[-1])
    usable = np.flatnonzero(fits[: max(0, stop - at)])
    return at + int(usable[np.argmax(relative[usable])]) if usable.size else at


def next_cuts(starts: np.ndarray, ends: np.ndarray, closes: np.ndarray, ats: np.ndarray, stop: int, cap: float) -> np.ndarray:
    """``_cut_after`` of each of ``ats``, times read from its own start; all at once where ends do not go back."""
    if not (np.diff(ends) >= 0).all():
        return np.array([_cut_after(starts, ends, closes, at, stop, cap, float(starts[at])) for at in ats.tolist()], dtype=np.int64)
    n, origin, places = len(ends), starts[ats], np.arange(len(ends))
    relative = lambda i: ends[i] - origin
    # Words that fit end at ``last``; the sum's rounding may put the search one off.
    last = np.searchsorted(ends, origin + cap, side="right") - 1
    while (more := (last + 1 < n) & (relative(np.minimum(last + 1, n - 1)) <= cap)).any():
        last = last + more
    while (less := (last >= ats) & (relative(np.maximum(last, 0)) > cap)).any():
        last = last - less
    last = np.minimum(last, np.maximum(np.searchsorted(starts, origin + cap + 1e-6, side="right"), ats + 1) - 1)
    close = np.maximum.accumulate(np.where(closes, places, -1))[np.maximum(last, 0)]
    tail = (last >= ats) & (close >= ats) & (relative(np.maximum(close, 0)) >= cap * (1.0 - SPLIT_SEARCH_TAIL))
    usable = np.minimum(last, stop - 1)
    most = relative(np.maximum(usable, 0))
    while (same := (usable > ats) & (relative(np.maximum(usable - 1, 0)) == most)).any():
        usable = usable - same
    return np.where(tail, close, np.maximum(usable, ats))


def split_points(starts: np.ndarray, ends: np.ndarray, closes: np.ndarray, cap: float) -> list[int]:
    """First word of every piece of one over-long span, times read from each piece's own start."""
    heads, at, stop = [0], 0, len(starts) - 1
    while ends[stop] - starts[at] > cap:
        cut = _cut_after(starts, ends, closes, at, stop, cap, float(starts[at]))
        if cut >= stop:
            break
        at = cut + 1
        heads.append(at)
    return heads


def _small_pieces(over: DataFrame) -> DataFrame:
    """Splits over-long spans, many in one call; the caller bounds the words per span."""

    def fold(table: pa.Table, edges: list[int]) -> pa.Table:
        starts, ends, caps = (table[c].to_numpy() for c in ("start_s", "end_s", "cap_s"))
        closes = pc.fill_null(table["closes"], False).to_numpy()
        heads, tails, numbers = [], [], []
        for a, b in zip(edges, edges[1:]):
            found = split_points(starts[a:b], ends[a:b], closes[a:b], float(caps[a]))
            heads += [a + h for h in found]
            tails += [a + h - 1 for h in found[1:]] + [b - 1]
            numbers += range(len(found))
        at, to = table.take(pa.array(heads, pa.int64())), table.take(pa.array(tails, pa.int64()))
        pieces = {"piece_no": pa.array(numbers, pa.int64()), "start_s": at["start_s"], "end_s": to["end_s"]}
        pieces |= {"n_words": pa.array(np.subtract(tails, heads) + 1, pa.int64()), "first_seq": at["seq"], "last_seq": to["seq"]}
        return pa.table({c: pieces[c] if c in pieces else at[c] for c in PIECE_COLUMNS})

    key = over.schema["stream_id"].dataType.simpleString()
    schema = (
        f"stream_id {key}, span_no long, piece_no long, start_s double, end_s double, n_words long, "
        "first_seq long, last_seq long, floor_s double, cap_s double"
    )
    return fold_runs(over.select("stream_id", "span_no", "seq", "start_s", "end_s", "closes", "floor_s", "cap_s"), ["stream_id", "span_no"], ["seq"], fold, schema)


def _large_heads(over: DataFrame, max_gap_s: float) -> DataFrame:
    """Piece heads of spans too long for one task: per-block next pointers, then a blocked walk."""
    first = time_block(F.col("start_s") - F.col("cap_s") - F.lit(max_gap_s) - 1.0)
    haloed = over.withColumn("own", time_block(F.col("start_s"))).withColumn(
        "block", F.explode(F.sequence(F.greatest(first, time_block(F.col("span_start"))), F.col("own")))
    )

    def point(table: pa.Table, edges: list[int]) -> pa.Table:
        names = ("start_s", "end_s", "seq", "cap_s", "last_end", "first_seq", "last_seq")
        starts, ends, seqs, caps, last_ends, first_seqs, last_seqs = (table[c].to_numpy() for c in names)
        closes = pc.fill_null(table["closes"], False).to_numpy()
        mine = np.flatnonzero(pc.equal(table["own"], table["block"]).to_numpy())
        # No word of a span that fits from there on, and none that is its last, points anywhere.
        nxt = np.full(table.num_rows, -1, dtype=np.int64)
        for a, b in zip(edges, edges[1:]):
            ats = mine[np.searchsorted(mine, a) : np.searchsorted(mine, b)]
            ats = ats[last_ends[a] - starts[ats] > caps[a]] - a
            stop = int(last_seqs[a] - seqs[a]) if seqs[b - 1] == last_seqs[a] else b - a
            cut = a + next_cuts(starts[a:b], ends[a:b], closes[a:b], ats, stop, float(caps[a]))
            nxt[a + ats] = np.where(seqs[cut] < last_seqs[a], seqs[cut] + 1, -1)
        own, nxt = table.take(pa.array(mine)), nxt[mine]
        columns = {c: own[c] for c in ("stream_id", "span_no", "block")} | {"node": own["seq"], "nxt": pa.array(nxt, mask=nxt < 0)}
        return pa.table(columns | {"head": pa.array(seqs[mine] == first_seqs[mine])})

    key = over.schema["stream_id"].dataType.simpleString()
    edges = fold_runs(haloed, ["stream_id", "span_no", "block"], ["seq"], point, f"stream_id {key}, span_no long, block long, node long, nxt long, head boolean")
    return reached(edges, ["stream_id", "span_no"])


def speech_pieces(
    words: DataFrame, params: SegmentParams | None = None, bounds: DataFrame | None = None, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Spans after the cap split, before any floor.

    ``bounds`` optionally gives ``stream_id, floor_s, cap_s``; otherwise the parameters' own bounds hold.
    """
    params = params or SegmentParams()
    islands = linked_words(words, [params.max_gap_s]).withColumnRenamed("island_0", "span_no")
    spans = span_rows(islands)
    if bounds is None:
        spans = spans.withColumn("cap_s", F.lit(params.max_clip_s)).withColumn("floor_s", F.lit(params.min_clip_s))
    else:
        spans = spans.join(bounds.select("stream_id", "floor_s", "cap_s"), "stream_id")
    spans = summary(spans)
    fits = F.col("end_s") - F.col("start_s") <= F.col("cap_s")
    whole = spans.filter(fits).withColumn("piece_no", F.lit(0).cast("long")).select(*PIECE_COLUMNS)
    long_spans = spans.filter(~fits).select(
        "stream_id",
        "span_no",
        "n_words",
        "cap_s",
        "floor_s",
        "first_seq",
        "last_seq",
        F.col("start_s").alias("span_start"),
        F.col("end_s").alias("last_end"),
    )
    # A stream's long spans travel together, so its words stay where they lie.
    placed = islands.select("stream_id", F.col("span_no").alias("_block"), "seq", "prev_start_s", "start_s", "end_s", "text")
    facts = long_spans.withColumnRenamed("span_no", "_block")
    over = (
        with_carry(placed, facts, facts, ["stream_id"], most=KEY_SPLITS)
        .withColumnRenamed("_block", "span_no")
        .withColumn("closes", ends_sentence(F.col("text")))
        .drop("text")
    )
    if params.split_origin == "absolute":
        return whole.unionByName(_pieces_from_heads(_absolute_heads(over), long_spans, over))
    small = F.col("n_words") <= fold_rows
    result = whole
    if not spans.filter(~fits & small).isEmpty():
        # Kept, for the scores of a stream and its best spans read them again.
        result = result.unionByName(summary(_small_pieces(over.filter(small))))
    if not spans.filter(~fits & ~small).isEmpty():
        large = over.filter(~small)
        result = result.unionByName(
            _pieces_from_heads(_large_heads(large, params.max_gap_s), long_spans.filter(~small), large)
        )
    return result


def _pieces_from_heads(heads: DataFrame, long_spans: DataFrame, over: DataFrame) -> DataFrame:
    """A piece runs from its head to the word before the next head; times are joined back by position."""
    keys = ["stream_id", "span_no"]
    ordered = Window.partitionBy(*keys, "_b").orderBy("node")
    numbered = summary(
        heads.withColumn("_b", F.floor(F.col("node") / 65536).cast("long"))
        .withColumn("_rn", F.row_number().over(ordered).cast("long"))
        .withColumn("_nx", F.lead("node").over(ordered))
    )
    per_block = summary(numbered.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_first")))
    ranks = block_prefix(per_block.select(*keys, "_b", "_n"), keys, "_b", sums=["_n"])
    following = block_prefix(per_block.select(*keys, "_b", "_first"), keys, "_b", lasts=["_first"], reverse=True)
    pieces = (
        numbered.join(ranks, [*keys, "_b"])
        .join(following, [*keys, "_b"])
        .join(long_spans.drop("n_words"), keys)
        .select(
            *keys,
            (F.col("_n") + F.col("_rn") - 1).alias("piece_no"),
            F.col("node").alias("first_seq"),
            (F.coalesce("_nx", "_first", F.col("last_seq") + 1) - 1).alias("last_seq"),
            "cap_s",
            "floor_s",
        )
    )
    # Both ends of a piece meet the words in one pass.
    ends = F.explode(F.array(F.struct(F.col("first_seq").alias("seq"), F.lit(True).alias("_first")), F.struct(F.col("last_seq").alias("seq"), F.lit(False).alias("_first"))))
    timed = pieces.select("*", ends.alias("_e")).select(*pieces.columns, "_e.*").join(over.select(*keys, "seq", "start_s", "end_s"), [*keys, "seq"])
    return (
        timed.groupBy(*pieces.columns)
        .agg(F.max(F.when(F.col("_first"), F.col("start_s"))).alias("start_s"), F.max(F.when(~F.col("_first"), F.col("end_s"))).alias("end_s"))
        .withColumn("n_words", F.col("last_seq") - F.col("first_seq") + 1)
        .select(*PIECE_COLUMNS)
    )


def _absolute_heads(over: DataFrame) -> DataFrame:
    """Piece heads when the cap is read on the stream's own clock.

    Only words that start inside the first cap seconds of the stream are ever searched; everything
    after sheds one word at a time until the rest fits, which is a plain comparison per word.
    """
    near = over.filter((F.col("span_start") <= F.col("cap_s")) & (F.col("start_s") <= F.col("cap_s")))
    flat = over.select(
        "stream_id",
        F.col("span_no").alias("_block"),
        F.col("seq").alias("node"),
        "first_seq",
        (F.col("last_end") - F.col("start_s") <= F.col("cap_s")).alias("_fits"),
        (F.col("last_end") - F.col("prev_start_s") <= F.col("cap_s")).alias("_fitted"),
        (F.col("span_start") <= F.col("cap_s")).alias("_near"),
    )

    def fold(table: pa.Table, edges: list[int]) -> pa.Table:
        starts, ends, caps, last_ends, seqs, last_seqs = (table[c].to_numpy() for c in ("start_s", "end_s", "cap_s", "last_end", "seq", "last_seq"))
        closes = pc.fill_null(table["closes"], False).to_numpy()
        groups, nodes = [], []
        for a, b in zip(edges, edges[1:]):
            cap, last_end, n = float(caps[a]), float(last_ends[a]), b - a
            at, found, stop = 0, [0], int(last_seqs[a] - seqs[a])
            while at < n and last_end - starts[a + at] > cap and (ends[a + at : b] <= cap).any():
                at = _cut_after(starts[a:b], ends[a:b], closes[a:b], at, stop, cap, 0.0) + 1
                found.append(at)
            groups += [a] * len(found)
            nodes += [int(seqs[a]) + at for at in found]
        return table.take(pa.array(groups, pa.int64())).select(["stream_id", "span_no"]).append_column("node", pa.array(nodes, pa.int64()))

    key = over.schema["stream_id"].dataType.simpleString()
    words = near.select("stream_id", "span_no", "seq", "start_s", "end_s", "closes", "cap_s", "last_end", "last_seq")
    searched = summary(fold_runs(words, ["stream_id", "span_no"], ["seq"], fold, f"stream_id {key}, span_no long, node long"))
    resume = searched.groupBy("stream_id", F.col("span_no").alias("_block")).agg(F.max("node").alias("_from"))
    # Heads from there on: every word that does not fit yet, and the first that does. Starts never go back, so a word that fits
    # is the first where the one before does not.
    begun = with_carry(flat, resume, resume, ["stream_id"], "left", most=KEY_SPLITS).withColumn("_from", F.when(F.col("_near"), F.col("_from")).otherwise(F.col("first_seq")))
    shed = begun.filter((F.col("node") >= F.col("_from")) & (~F.col("_fits") | (F.col("node") == F.col("_from")) | ~F.col("_fitted")))
    return searched.unionByName(shed.select("stream_id", F.col("_block").alias("span_no"), "node")).distinct()


def passes_floor(params: SegmentParams) -> Column:
    """Both floors are hard: enough words and enough seconds."""
    return (F.col("n_words") >= params.min_words) & (F.col("end_s") - F.col("start_s") >= F.col("floor_s"))


def density() -> Column:
    """Words per second, 0 when the span has no length."""
    length = F.col("end_s") - F.col("start_s")
    return F.when(length > 0, F.col("n_words") / length).otherwise(F.lit(0.0))


def scored_pieces(pieces: DataFrame, params: SegmentParams | None = None) -> DataFrame:
    """Surviving pieces with a score relative to the densest survivor of the same stream."""
    params = params or SegmentParams()
    alive = pieces.filter(passes_floor(params)).withColumn("density", density())
    tops = alive.groupBy("stream_id").agg(F.max("density").alias("_top"))
    return alive.join(tops, "stream_id").withColumn(
        "score", F.when(F.col("_top") > 0, F.col("density") / F.col("_top")).otherwise(F.lit(0.0))
    ).drop("_top")


def top_moments(scored: DataFrame, params: SegmentParams | None = None) -> DataFrame:
    """The best spans of every stream: preferred length first, then score, then time.

    The rank filter lets Spark keep only the leaders of each input partition before the shuffle.
    """
    params = params or SegmentParams()
    short = F.when(F.col("end_s") - F.col("start_s") >= params.preferred_clip_s, 0).otherwise(1)
    window = Window.partitionBy("stream_id").orderBy(short, F.desc("score"), "start_s", "end_s", "first_seq")
    return (
        scored.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= params.max_moments)
        .withColumn("source", F.lit("speech_rate"))
    )


def selection_counts(pieces: DataFrame, params: SegmentParams | None = None) -> DataFrame:
    """Exact counts per stream, plus the two differences under their own names."""
    params = params or SegmentParams()
    per_span = pieces.withColumn("_ok", passes_floor(params).cast("long"))
    return per_span.groupBy("stream_id").agg(
        F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)).alias("n_raw"),
        F.count(F.lit(1)).alias("n_pieces"),
        F.sum(F.when(F.col("piece_no") == 1, 1).otherwise(0)).alias("n_split_spans"),
        F.sum(1 - F.col("_ok")).alias("n_floor_dropped"),
        F.sum("_ok").alias("n_qualifying"),
        F.least(F.sum("_ok"), F.lit(params.max_moments)).alias("n_kept"),
        F.greatest(F.sum("_ok") - params.max_moments, F.lit(0)).alias("cut_by_limit"),
        (F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0)) - F.sum("_ok")).alias("discarded_by_floor"),
        (F.count(F.lit(1)) - F.sum(F.when(F.col("piece_no") == 0, 1).otherwise(0))).alias("split"),
    )


def effective_bounds(platform_rules: DataFrame, params: SegmentParams | None = None) -> DataFrame:
    """Per contract: the largest platform minimum and the smallest platform maximum, with module defaults.

    ``bad_bounds`` marks a floor above the cap, which only a brief-driven run treats as an error.
    """
    params = params or SegmentParams()
    grouped = platform_rules.groupBy("contract_id").agg(F.max("min_s").alias("min_s"), F.min("max_s").alias("max_s"))
    cap = F.when(F.coalesce("max_s", F.lit(0.0)) > 0, F.least(F.col("max_s"), F.lit(params.max_clip_s)))
    return grouped.select(
        "contract_id",
        F.greatest(F.lit(params.min_clip_s), F.coalesce("min_s", F.lit(0.0))).alias("floor_s"),
        F.coalesce(cap, F.lit(params.max_clip_s)).alias("cap_s"),
        F.coalesce(F.col("min_s") > F.col("max_s"), F.lit(False)).alias("bad_bounds"),
    )


def selection_check(spans: DataFrame, bounds: DataFrame, streams: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """First reason a selected span may not be cut, or null. Declared ranges replace the proposed ones."""
    chosen = spans
    if declared is not None:
        replaced = declared.select("stream_id").distinct()
        chosen = spans.join(replaced, "stream_id", "left_anti").unionByName(declared, allowMissingColumns=True)
    length = F.col("end_s") - F.col("start_s")
    reason = (
        F.when(F.col("end_s") <= F.col("start_s"), "empty")
        .when((F.col("duration_s") > 0) & (F.col("end_s") > F.col("duration_s")), "past_end")
        .when(length < F.col("floor_s"), "too_short")
        .when(length > F.col("cap_s"), "too_long")
    )
    return (
        chosen.join(streams.select("stream_id", "duration_s"), "stream_id", "left")
        .join(bounds.select("stream_id", "floor_s", "cap_s"), "stream_id", "left")
        .withColumn("reason", reason)
    )
