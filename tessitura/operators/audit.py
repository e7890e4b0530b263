"""Transcript quality: gaps, durations, order, confidence, punctuation, stock phrases, cut sweeps."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessitura.operators.segments import linked_with_totals, linked_words
from tessitura.params import CLOSING_MARKS, SENTENCE_MARKS
from tessitura.plans.chain import reached
from tessitura.plans.scan import BLOCK_FAN, BLOCK_ROWS, exact_median, prefix_scan, row_block, summary, time_block

# Fixed values.
STOCK_PHRASES = (
    "gracias por ver",
    "gracias por ver el video",
    "subtitulos subtitulos realizados por",
    "suscribete",
    "traduccion",
    "sous titres",
    "merci",
    "thank you for watching",
    "subtitles by",
    "amigos de youtube",
)
GAP_BUCKETS = (
    ("<0.2", 0.0, 0.2),
    ("0.2-0.5", 0.2, 0.5),
    ("0.5-1.0", 0.5, 1.0),
    ("1.0-1.5", 1.0, 1.5),
    ("1.5-2.0", 1.5, 2.0),
    ("2.0-3.0", 2.0, 3.0),
    (">3.0", 3.0, None),
)
SWEEP_GAPS = (0.6, 1.0, 1.5, 2.0, 3.0)
SWEEP_WINDOWS = (10.0, 15.0, 20.0, 30.0, 45.0, None)
USABLE_S = 8.0
LOW_CONFIDENCE = 0.3
REPEATED_PHRASES = 5
FIRST_REGRESSIONS = 5
FIRST_LOW_CONFIDENCE = 8
NEVER, EVERY = float("inf"), float("-inf")


def last_mark(text: Column) -> Column:
    """Final character, untrimmed."""
    return F.substring(text, -1, 1)


def closes(text: Column) -> Column:
    """Ends a sentence as the audit reads it: three marks, no trimming."""
    return last_mark(text).isin(*CLOSING_MARKS)


def in_file_order(words: DataFrame, gaps: Sequence[float] = ()) -> DataFrame:
    """Words linked to their predecessor in file order."""
    return linked_words(words, gaps, ["token_id"], row_block(F.col("token_id")))


def with_extent(words: DataFrame, gaps: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
    """(``in_file_order``, each stream's own extent and number of closes), both from one summary of the words."""
    linked, totals = linked_with_totals(
        words, gaps, ["token_id"], row_block(F.col("token_id")), sums={"n_closes": closes(F.col("text")).cast("long")}, maxs={"to_s": F.col("end_s")}
    )
    return linked, totals.select("stream_id", F.lit(0.0).alias("from_s"), "to_s", F.coalesce("n_closes", F.lit(0)).alias("n_closes"))


def gap_histogram(linked: DataFrame) -> DataFrame:
    """Count and seconds per stream and fixed bucket, empty buckets included; negative gaps fall in none."""
    gap = F.col("start_s") - F.col("prev_end_s")
    bucket = F.lit(None).cast("int")
    for number, (_, low, high) in reversed(list(enumerate(GAP_BUCKETS))):
        inside = (gap >= low) if high is None else (gap >= low) & (gap < high)
        bucket = F.when(inside, number).otherwise(bucket)
    counted = (
        linked.select("stream_id", gap.alias("gap"), bucket.alias("bucket_no"))
        .groupBy("stream_id", "bucket_no")
        .agg(F.count("gap").alias("n"), F.sum("gap").alias("seconds"))
    )
    names = F.create_map(*[F.lit(v) for i, (label, _, _) in enumerate(GAP_BUCKETS) for v in (i, label)])
    filled = counted.groupBy("stream_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bucket_no").isNotNull(), F.struct("bucket_no", F.struct("n", "seconds"))))).alias("m")
    )
    return filled.select(
        "stream_id", "m", F.explode(F.sequence(F.lit(0), F.lit(len(GAP_BUCKETS) - 1))).alias("bucket_no")
    ).select(
        "stream_id",
        "bucket_no",
        names[F.col("bucket_no")].alias("bucket"),
        F.coalesce(F.col("m")[F.col("bucket_no")]["n"], F.lit(0)).alias("n"),
        F.coalesce(F.col("m")[F.col("bucket_no")]["seconds"], F.lit(0.0)).alias("seconds"),
    )


def gaps_over(linked: DataFrame, threshold: float) -> DataFrame:
    """Gaps strictly over a threshold per stream."""
    gap = F.col("start_s") - F.col("prev_end_s")
    return linked.groupBy("stream_id").agg(
        F.count_if(gap > threshold).alias("n"), F.coalesce(F.sum(F.when(gap > threshold, gap)), F.lit(0.0)).alias("seconds")
    )


def normal_token(text: Column) -> Column:
    """Lower case without edge spaces, full stops, marks or commas."""
    return F.btrim(F.lower(text), F.lit(" .!?,"))


def phrase_positions(words: DataFrame, phrases: Sequence[str] = STOCK_PHRASES) -> DataFrame:
    """Every contiguous occurrence of every phrase; overlapping and nested ones all count.

    The first tokens of each block are copied to the block before, so a phrase across a block edge
    needs no carry. ``token_id`` must be dense.
    """
    longest = max(len(p.split(" ")) for p in phrases)
    known = sorted({part for p in phrases for part in p.split(" ")})
    block = row_block(F.col("token_id"))
    # Only words of some phrase can be part of one, so the others are never copied, shuffled or sorted.
    lapped = (
        words.select("stream_id", "token_id", "start_s", "confidence", normal_token(F.col("text")).alias("token"))
        .filter(F.col("token").isin(*known))
        .select(
            "*",
            block.alias("own"),
            F.explode(F.array_distinct(F.array(row_block(F.greatest(F.col("token_id") - (longest - 1), F.lit(0))), block))).alias("block"),
        )
    )
    window = Window.partitionBy("stream_id", "block").orderBy("token_id")
    # Ids are dense, so k rows on is k words on only where the id is k higher; else a word between was left out.
    ahead = [F.when(F.lead("token_id", k).over(window) == F.col("token_id") + k, F.lead("token", k).over(window)) for k in range(1, longest)]
    tokens = [F.col("token"), *ahead]
    spread = lapped.select("*", *[t.alias(f"t{k}") for k, t in enumerate(tokens)]).filter(F.col("own") == F.col("block"))
    hits = []
    for number, phrase in enumerate(phrases):
        parts = phrase.split(" ")
        match = F.lit(True)
        for k, part in enumerate(parts):
            match = match & (F.col(f"t{k}") == part)
        hits.append(F.when(match, F.struct(F.lit(number).alias("phrase_no"), F.lit(phrase).alias("phrase"))))
    return spread.select(
        "stream_id", "token_id", "start_s", "confidence", F.explode(F.array_compact(F.array(*hits))).alias("hit")
    ).select("stream_id", "token_id", "start_s", "confidence", "hit.phrase_no", "hit.phrase")


def phrase_counts(positions: DataFrame) -> DataFrame:
    """Occurrences per stream and phrase."""
    return positions.groupBy("stream_id", "phrase").agg(F.count(F.lit(1)).alias("n"))


def phrase_first(positions: DataFrame) -> DataFrame:
    """The example to show: first by phrase list order, then by position."""
    return positions.groupBy("stream_id").agg(
        F.min_by(F.struct("phrase", "start_s", "confidence"), F.struct("phrase_no", "token_id")).alias("e")
    ).select("stream_id", "e.phrase", "e.start_s", "e.confidence")


def audit_rows(words: DataFrame, linked: DataFrame, positions: DataFrame) -> DataFrame:
    """One quality row per stream, with the integrity verdict."""
    length = F.col("end_s") - F.col("start_s")
    gap = F.col("start_s") - F.col("prev_end_s")
    mark = last_mark(F.col("text"))
    base = linked.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.max("end_s").alias("duration_s"),
        F.stddev_pop(length).alias("duration_sd"),
        F.count_if(length <= 0).alias("n_zero"),
        F.count_if(length >= 1.0).alias("n_long"),
        F.count_if(gap < 0).alias("n_negative_gaps"),
        F.count_if(F.col("start_s") < F.col("prev_start_s")).alias("n_regressions"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("n_low_confidence"),
        F.coalesce(F.sum(F.when(F.col("confidence") < LOW_CONFIDENCE, length)), F.lit(0.0)).alias("low_confidence_s"),
        F.count_if(mark.isin(*SENTENCE_MARKS)).alias("n_punctuated"),
        F.count_if(mark.isin(*CLOSING_MARKS)).alias("n_closes"),
    )
    median = exact_median(words.withColumn("_len", length), ["stream_id"], "_len", "duration_median", 0.05)
    based = base.join(median, "stream_id")
    outliers = (
        words.select("stream_id", length.alias("_len"))
        .join(based.select("stream_id", "duration_median", "duration_sd"), "stream_id")
        .groupBy("stream_id")
        .agg(
            F.count_if(F.col("_len") < F.col("duration_median") - 3 * F.col("duration_sd")).alias("n_short_outliers"),
            F.count_if(F.col("_len") > F.col("duration_median") + 3 * F.col("duration_sd")).alias("n_long_outliers"),
        )
    )
    phrases = positions.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n_phrase_hits"))
    return (
        based.join(outliers, "stream_id")
        .join(phrases, "stream_id", "left")
        .withColumn("n_phrase_hits", F.coalesce("n_phrase_hits", F.lit(0)))
        .withColumn("punctuated_share", F.try_divide(F.col("n_punctuated"), F.col("n_words")))
        .withColumn("closes_per_min", F.try_divide(F.col("n_closes"), F.col("duration_s") / 60))
        .withColumn("verdict", integrity(F.col("n_regressions"), F.col("n_phrase_hits")))
    )


def integrity(regressions: Column, phrase_hits: Column) -> Column:
    """Unusable if time runs backwards, partly reliable if stock phrases repeat, else reliable."""
    return (
        F.when(regressions > 0, "unusable").when(phrase_hits >= REPEATED_PHRASES, "partly_reliable").otherwise("reliable")
    )


def audit_examples(linked: DataFrame) -> DataFrame:
    """First five order faults and first eight low-confidence words of each stream, in file order."""
    kinds = F.array(
        F.when(F.col("start_s") < F.col("prev_start_s"), F.lit("regression")),
        F.when(F.col("confidence") < LOW_CONFIDENCE, F.lit("low_confidence")),
    )
    rows = linked.select(
        "stream_id", "token_id", "text", "start_s", "prev_start_s", "confidence", F.explode(F.array_compact(kinds)).alias("kind")
    )
    window = Window.partitionBy("stream_id", "kind").orderBy("token_id")
    # The looser rank bound lets Spark trim before the shuffle; the second filter is exact per kind.
    return (
        rows.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= max(FIRST_LOW_CONFIDENCE, FIRST_REGRESSIONS))
        .filter((F.col("kind") == "low_confidence") | (F.col("rank") <= FIRST_REGRESSIONS))
    )


def punctuation_counts(words: DataFrame) -> DataFrame:
    """Words per closing mark and stream."""
    return (
        words.select("stream_id", last_mark(F.col("text")).alias("mark"))
        .filter(F.col("mark").isin(*SENTENCE_MARKS))
        .groupBy("stream_id", "mark")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def close_spacing(words: DataFrame) -> DataFrame:
    """Seconds from each sentence close's end to the next close's start."""
    ended = words.filter(closes(F.col("text"))).select("stream_id", "token_id", "start_s", "end_s")
    spaced = (
        prefix_scan(ended, ["stream_id"], ["token_id"], row_block(F.col("token_id")), lasts={"prev_end_s": F.col("end_s")})
        .filter(F.col("prev_end_s").isNotNull())
        .select("stream_id", (F.col("start_s") - F.col("prev_end_s")).alias("spacing"))
    )
    stats = spaced.groupBy("stream_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("spacing").alias("mean_s"),
        F.min("spacing").alias("min_s"),
        F.max("spacing").alias("max_s"),
    )
    return stats.join(exact_median(spaced, ["stream_id"], "spacing", "median_s", 1.0), "stream_id")


def span_summary(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, min, median, max and sum of span lengths; a key without spans simply has no row."""
    lengths = spans.select(*keys, (F.col("end_s") - F.col("start_s")).alias("_len"))
    stats = lengths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_len").alias("min_s"), F.max("_len").alias("max_s"), F.sum("_len").alias("sum_s")
    )
    return stats.join(exact_median(lengths, list(keys), "_len", "median_s", 5.0), list(keys))


def silence_spans(linked: DataFrame, bounds: DataFrame, island: str = "island_0") -> DataFrame:
    """Spans between long silences: the first starts at the given start, the last ends at the given end.

    Islands are kept in the shared folder, since the last one of a stream and the statistics of spans read them again.
    """
    inner = summary(
        linked.groupBy("stream_id", F.col(island).alias("span_no")).agg(
            F.min_by("start_s", "seq").alias("start_s"), F.max_by("end_s", "seq").alias("end_s")
        )
    )
    edges = inner.groupBy("stream_id").agg(F.max("span_no").alias("_last")).join(bounds.select("stream_id", "from_s", "to_s"), "stream_id")
    return inner.join(edges, "stream_id").select(
        "stream_id",
        "span_no",
        F.when(F.col("span_no") == 0, F.col("from_s")).otherwise(F.col("start_s")).alias("start_s"),
        F.when(F.col("span_no") == F.col("_last"), F.col("to_s")).otherwise(F.col("end_s")).alias("end_s"),
    )


def _fold_cuts(groups: DataFrame) -> DataFrame:
    """Greedy cuts of each group's close ends in file order, folded inside the JVM.

    ``groups``: ``from_s``, ``to_s``, ``window_s`` and ``ends``, at most a block of them. Gives spans as an array, tail included.
    A window of ``EVERY`` cuts at each of them.
    """
    start = F.struct(F.col("from_s").alias("cut"), F.array().cast("array<struct<start_s:double,end_s:double>>").alias("spans"))

    def step(state: Column, end: Column) -> Column:
        span = F.array(F.struct(state["cut"].alias("start_s"), end.alias("end_s")))
        due = end - state["cut"] >= F.col("window_s")
        return F.when(due, F.struct(end.alias("cut"), F.concat(state["spans"], span).alias("spans"))).otherwise(state)

    before = lambda i: F.when(i == 0, F.col("from_s")).otherwise(F.get("ends", i - 1))
    each = F.struct(before(F.size("ends")).alias("cut"), F.transform("ends", lambda e, i: F.struct(before(i).alias("start_s"), e.alias("end_s"))).alias("spans"))
    folded = groups.withColumn("_f", F.when(F.col("window_s") == EVERY, each).otherwise(F.aggregate("ends", start, step)))
    tail = F.array(F.struct(F.col("_f.cut").alias("start_s"), F.col("to_s").alias("end_s")))
    return folded.withColumn(
        "spans", F.when(F.col("_f.cut") < F.col("to_s"), F.concat(F.col("_f.spans"), tail)).otherwise(F.col("_f.spans"))
    ).drop("_f", "ends")


def _first_due(nodes: DataFrame, targets: DataFrame, on: list[str], later: bool = True) -> DataFrame:
    """Adds ``hit`` to ``nodes(on, at, cut, window_s, ...)``; null where nothing is due.

    It is the first ``pos`` of ``targets(on, pos, value)``, past ``at`` where ``later``, with
    ``value - cut >= window_s``. Values need no order.
    """

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("at", ascending=False), right.sort_values("pos", ascending=False)
        pos, value = right["pos"].tolist(), right["value"].tolist()
        # Targets above every one between them and the node, the nearest last.
        above: list[int] = []
        hits: list[int | None] = []
        i = 0
        for at, cut, window in zip(left["at"].tolist(), left["cut"].tolist(), left["window_s"].tolist(), strict=True):
            while i < len(pos) and (not later or pos[i] > at):
                while above and value[above[-1]] <= value[i]:
                    above.pop()
                above.append(i)
                i += 1
            n_due = bisect_left(above, True, key=lambda k, cut=cut, window=window: value[k] - cut < window)
            hits.append(pos[above[n_due - 1]] if n_due else None)
        return left.assign(hit=pd.array(hits, dtype="Int64"))

    schema = StructType([*nodes.schema.fields, StructField("hit", LongType())])
    # Both sides come from the same rows, so the second gets column names of its own.
    other = [f"_{c}" for c in on]
    offered = targets.select(*[F.col(c).alias(o) for c, o in zip(on, other, strict=True)], "pos", "value")
    return nodes.groupBy(*on).cogroup(offered.groupBy(*other)).applyInPandas(find, schema)


def _walked_cuts(events: DataFrame, keys: list[str]) -> DataFrame:
    """The same greedy cuts for groups of more than a block.

    ``events``: keys, ``window_s``, ``seq`` and ``end_s`` of each close, plus one row per key with ``head`` set
    whose ``end_s`` is the group start. Each row is pointed at the first later close that is due: in its own
    block, else in the first later block whose largest end is due, found the same way over blocks and groups of
    blocks. The pointers are then walked. Nothing relies on times growing with ``seq``. Rows that look into one
    block come apart by their own group of blocks, so no task sees more than that.
    """
    block, group = row_block(F.col("seq")), F.floor(row_block(F.col("seq")) / BLOCK_FAN).cast("long")
    nodes = events.select(*keys, "window_s", "seq", "head", F.col("end_s").alias("cut"), block.alias("block"), group.alias("group"))
    closing = events.filter(~F.col("head")).select(*keys, F.col("seq").alias("pos"), F.col("end_s").alias("value"), block.alias("block"), group.alias("group"))
    per_block = closing.groupBy(*keys, "group", "block").agg(F.max("value").alias("value")).withColumn("pos", F.col("block"))
    per_group = per_block.groupBy(*keys, F.col("group").alias("pos")).agg(F.max("value").alias("value"))
    # Several later steps read each of these, so they are kept in the shared folder.
    here = summary(_first_due(nodes.withColumn("at", F.col("seq")), closing, [*keys, "block"]))
    near = summary(_first_due(here.filter("hit IS NULL").drop("hit").withColumn("at", F.col("block")), per_block, [*keys, "group"]))
    far = near.filter("hit IS NULL").drop("hit").withColumn("at", F.col("group"))
    far = summary(_first_due(far, per_group.join(far.select(*keys, "group").distinct(), keys), [*keys, "group"]))

    def inside(found: DataFrame, targets: DataFrame, name: str) -> DataFrame:
        """First due target of the ``name`` that ``hit`` gives."""
        aimed = found.filter("hit IS NOT NULL").withColumnRenamed("hit", "goal")
        wanted = aimed.select(*keys, "goal", "group").distinct()
        offered = targets.select(*keys, F.col(name).alias("goal"), "pos", "value").join(wanted, [*keys, "goal"])
        return _first_due(aimed, offered, [*keys, "goal", "group"], later=False).drop("goal")

    there = inside(near.unionByName(summary(inside(far, per_block, "group"))), closing, "block")
    pointed = [here.filter("hit IS NOT NULL"), there, far.filter("hit IS NULL")]
    edges = reduce(DataFrame.unionByName, [f.select(*keys, F.col("seq").alias("node"), F.col("hit").alias("nxt"), "block", "head") for f in pointed])
    return reached(edges, keys)


def _between(cuts: DataFrame, extents: DataFrame, keys: list[str]) -> DataFrame:
    """Spans from each of ``cuts(keys, seq, end_s)`` to the next one, and from the last to the group's end if that is later."""
    chained = prefix_scan(cuts, keys, ["seq"], row_block(F.col("seq")), lasts={"upto": F.col("end_s")}, reverse=True)
    return (
        chained.join(extents.select(*keys, "to_s"), keys)
        .filter(F.col("upto").isNotNull() | (F.col("end_s") < F.col("to_s")))
        .select(*keys, F.col("end_s").alias("start_s"), F.coalesce("upto", "to_s").alias("end_s"))
    )


def cut_spans(
    linked: DataFrame,
    bounds: DataFrame,
    islands: Sequence[tuple[float, str]],
    windows: Sequence[float | None],
    null_cuts_every_close: bool = False,
    fold_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Spans cut at silences and, after a window, at sentence closes, for every (gap, window) pair.

    ``bounds``: ``stream_id, from_s, to_s``; with ``n_closes`` as well, islands are sized only in streams that have more than
    ``fold_rows`` of them. A word that opens an island is not itself tested for a
    close. Without a window the closes cut nothing, or everything when ``null_cuts_every_close``: then each
    close ends a span, also one that lies before the last cut. Cuts follow ``seq``, whatever the times do.
    """
    keys = ["stream_id", "max_gap", "island"]
    # Only closes and words after a silence matter, so the rest never multiplies by the number of gaps.
    gap = F.col("start_s") - F.col("prev_end_s")
    is_close = closes(F.col("text"))
    per_gap = (
        linked.filter(is_close | F.col("prev_end_s").isNull() | (gap > min(g for g, _ in islands)))
        .select(
            "stream_id",
            "seq",
            "start_s",
            "end_s",
            "prev_end_s",
            gap.alias("gap"),
            is_close.alias("is_close"),
            F.explode(F.array(*[F.struct(F.lit(g).alias("max_gap"), F.col(c).alias("island")) for g, c in islands])).alias("g"),
        )
        .select("stream_id", "seq", "start_s", "end_s", "prev_end_s", "gap", "is_close", "g.max_gap", "g.island")
        .withColumn("opens", F.coalesce(F.col("gap") > F.col("max_gap"), F.lit(False)))
        .withColumn("is_close", F.col("is_close") & ~F.col("opens"))
    )
    # A word after a long silence starts its own island and ends the one before; only the last island is not ended so.
    nothing = F.lit(None).cast("double")
    mine = F.struct(
        "island",
        F.when(F.col("opens") | F.col("prev_end_s").isNull(), F.col("start_s")).alias("from_s"),
        nothing.alias("to_s"),
        F.lit(False).alias("ended"),
        F.col("is_close").cast("long").alias("n"),
        F.when(F.col("is_close") & F.col("end_s").isNotNull(), F.struct("seq", "end_s")).alias("close"),
    )
    before = F.struct(
        (F.col("island") - 1).alias("island"),
        nothing.alias("from_s"),
        F.col("prev_end_s").alias("to_s"),
        F.lit(True).alias("ended"),
        F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("struct<seq:long,end_s:double>").alias("close"),
    )
    edged = per_gap.select("stream_id", "max_gap", F.explode(F.array_compact(F.array(mine, F.when(F.col("opens"), before)))).alias("e")).select(
        "stream_id", "max_gap", "e.*"
    )

    def extents(events: DataFrame, *more: Column) -> DataFrame:
        """Bounds and number of closes of every island of ``events``; grouped where its stream lies."""
        inner = events.groupBy(*keys).agg(
            F.max("from_s").alias("from_s"), F.max("to_s").alias("to_s"), F.max("ended").alias("ended"), F.sum("n").alias("n_closes"), *more
        )
        return inner.join(bounds.select("stream_id", F.col("from_s").alias("_from"), F.col("to_s").alias("_to")), "stream_id").select(
            *keys,
            F.when(F.col("island") == 0, F.col("_from")).otherwise(F.col("from_s")).alias("from_s"),
            F.when(F.col("ended"), F.col("to_s")).otherwise(F.col("_to")).alias("to_s"),
            "n_closes",
            *[c for c in inner.columns if c == "ends"],
        )

    # Sizes first, so that no large island is ever gathered; what is kept of them is a row for each large one.
    crowded, no_large = edged, False
    if "n_closes" in bounds.columns:
        many = bounds.filter(F.col("n_closes") > fold_rows).select("stream_id")
        crowded, no_large = edged.join(many, "stream_id", "left_semi"), many.isEmpty()
    if not no_large:
        large_keys = summary(crowded.filter("n > 0").groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") > fold_rows).select(*keys))
        no_large = large_keys.isEmpty()
    whole = EVERY if null_cuts_every_close else NEVER
    options = F.explode(F.array(*[F.struct(F.lit(i).alias("window_no"), F.lit(whole if w is None else float(w)).alias("window_s")) for i, w in enumerate(windows)]))
    shown_window = F.when(~F.col("window_s").isin(EVERY, NEVER), F.col("window_s")).alias("window_s")
    small = edged if no_large else edged.join(large_keys, keys, "left_anti")
    ends = F.transform(F.sort_array(F.collect_list("close")), lambda c: c["end_s"]).alias("ends")
    groups = extents(small, ends).select("*", options.alias("w")).select("*", "w.window_no", "w.window_s")
    folded = _fold_cuts(groups).select(*keys, "window_no", "window_s", F.explode("spans").alias("s"))
    results = [folded.select(*keys, "window_no", shown_window, "s.start_s", "s.end_s")]
    if not no_large:
        wide = [*keys, "window_no"]
        sized = summary(extents(edged.join(large_keys, keys, "left_semi")))
        heads = sized.select(*keys, F.lit(-1).cast("long").alias("seq"), F.col("from_s").alias("end_s"))
        large = sized.select("*", options.alias("w")).select("*", "w.window_no", "w.window_s")
        closing = edged.filter("close IS NOT NULL").select(*keys, "close.*").join(large_keys, keys, "left_semi")
        if whole == EVERY and None in windows:
            results.append(_between(closing.unionByName(heads), sized, keys).join(large.filter(F.col("window_s") == EVERY).select(*wide), keys).select(
                *wide, F.lit(None).cast("double").alias("window_s"), "start_s", "end_s"
            ))
            large = large.filter(F.col("window_s") != EVERY)
        events = (
            closing.join(large.filter(F.col("window_s") < NEVER).select(*wide, "window_s"), keys)
            .withColumn("head", F.lit(False))
            .unionByName(heads.join(large.select(*wide, "window_s"), keys).withColumn("head", F.lit(True)))
        )
        visited = _walked_cuts(events, wide).withColumnRenamed("node", "seq").join(events, [*wide, "seq"])
        spans = _between(visited.select(*wide, "seq", "end_s"), large, wide).join(large.select(*wide, "window_s"), wide)
        results.append(spans.select(*wide, shown_window, "start_s", "end_s"))
    return reduce(DataFrame.unionByName, results)


def sweep_grid(linked: DataFrame, bounds: DataFrame, islands: Sequence[tuple[float, str]], fold_rows: int = BLOCK_ROWS) -> DataFrame:
    """Spans, usable spans and usable seconds for every gap and window pair."""
    spans = cut_spans(linked, bounds, islands, SWEEP_WINDOWS, fold_rows=fold_rows)
    length = F.col("end_s") - F.col("start_s")
    return spans.groupBy("stream_id", "max_gap", "window_no").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(length >= USABLE_S).alias("n_usable"),
        F.coalesce(F.sum(F.when(length >= USABLE_S, length)), F.lit(0.0)).alias("usable_s"),
    )
