"""Words against spans: text, relative segments, corrections, windows and fall-backs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.params import DEFAULT_LINE_DURATION_S
from tessitura.plans.intervals import KEY_SPANS, overlap_join
from tessitura.plans.scan import numbered, prefix_scan, row_block, summary, time_block

# Fixed values.
ANALYSIS_SCHEMA_VERSION = "1"
SEGMENTER_VERSION = "1"


def as_ms(seconds: Column) -> Column:
    """Seconds to whole milliseconds, half to even."""
    return F.rint(seconds * 1000).cast("long")


def trimmed(text: Column) -> Column:
    """Text without leading or trailing white space of any script."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ordered_text(order: Sequence[str], text: Column, separator: str = " ") -> Column:
    """Texts joined in order; null when there are none."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, text.alias("_x")))), lambda s: s["_x"]), separator)
    return F.when(F.count(text) > 0, joined)


def word_overlaps(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words against spans of the same stream, half open. Words that lie by stream stay there; ``spans`` is read several times."""
    points = words.withColumnsRenamed({"start_s": "p_start", "end_s": "p_end"})
    return overlap_join(points, spans.withColumnsRenamed({"start_s": "s_start", "end_s": "s_end"}), ["stream_id"], key_spans=KEY_SPANS)


def span_text(words: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text of every span; null where no word overlaps. ``keys`` identify a span within its stream."""
    held = summary(spans)
    return held.join(overlap_texts(words, held, keys), ["stream_id", *keys], "left")


def overlap_texts(words: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stream_id, keys, text`` of the spans that a word overlaps."""
    return (
        word_overlaps(words.select("stream_id", "token_id", "start_s", "end_s", "text"), spans)
        .groupBy("stream_id", *keys)
        .agg(ordered_text(["token_id"], F.col("text")).alias("text"))
    )


def relative_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Overlapping words shifted to the span's start and clipped to it; empty results drop out."""
    length = F.col("s_end") - F.col("s_start")
    return (
        word_overlaps(words, summary(spans))
        .withColumn("start_s", F.greatest(F.lit(0.0), F.col("p_start") - F.col("s_start")))
        .withColumn("end_s", F.least(length, F.col("p_end") - F.col("s_start")))
        .filter(F.col("end_s") > F.col("start_s"))
        .drop("p_start", "p_end", "s_start", "s_end")
    )


def relative_segments(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Checkable segments: relative words with their text trimmed and blanks dropped."""
    return relative_words(words, spans).withColumn("text", trimmed(F.col("text"))).filter(F.col("text") != "")


def plain_segments(words: DataFrame) -> DataFrame:
    """Segments of a whole stream when no span is given."""
    return words.filter(F.col("end_s") > F.col("start_s")).withColumn("text", trimmed(F.col("text"))).filter(F.col("text") != "")


def render_words(words: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Relative words with their text untouched and ids renumbered from zero per span; words of one id by time."""
    clipped = relative_words(words, spans).withColumnRenamed("token_id", "_old")
    return numbered(clipped, ["stream_id", *keys], ["_old", "start_s", "end_s"], row_block(F.col("_old")), "token_id").drop("_old")


def words_in_range_ms(words: DataFrame, variants: DataFrame) -> DataFrame:
    """Overlap on the millisecond clock: convert first, then clip. ``variants``: ``variant_id, stream_id, start_ms, end_ms``."""
    points = words.select(
        "stream_id", "token_id", "text", "confidence", as_ms(F.col("start_s")).alias("p_start"), as_ms(F.col("end_s")).alias("p_end")
    )
    spans = variants.withColumnsRenamed({"start_ms": "s_start", "end_ms": "s_end"})
    return (
        overlap_join(points, spans, ["stream_id"], scale=0.001, key_spans=KEY_SPANS)
        .withColumn("start_ms", F.greatest("p_start", "s_start") - F.col("s_start"))
        .withColumn("end_ms", F.least("p_end", "s_end") - F.col("s_start"))
        .filter(F.col("end_ms") > F.col("start_ms"))
        .drop("p_start", "p_end", "s_start", "s_end")
    )


def corrected_words(clipped: DataFrame, corrections: DataFrame, variants: DataFrame) -> DataFrame:
    """Words overlapping any correction give way to the corrections, clipped to the variant; ``place`` counts from its start.

    ``clipped``: ``variant_id, token_id, start_ms, end_ms, text, confidence`` relative to the variant.
    ``corrections``: ``variant_id, start_ms, end_ms, text`` on the source clock. Where all three frames also carry ``stream_id``,
    rows that lie together by stream stay there; corrections may then leave out ``variant_id`` and hold for every variant of
    their stream. A word is overlapped when the latest end of all corrections that start before its own end lies behind its
    start, so one running maximum over both replaces a join, however many corrections overlap each other. Words stand before
    corrections that start with them.
    """
    frames = (clipped, corrections, variants)
    keys = ["stream_id", "variant_id"] if all("stream_id" in f.columns for f in frames) else ["variant_id"]
    bounds = variants.select(*keys, F.col("start_ms").alias("v_start"), F.col("end_ms").alias("v_end"))
    # By stream alone where that is known, which moves no row that lies by stream.
    placed = corrections.join(bounds.withColumnRenamed("variant_id", "_variant"), "stream_id") if len(keys) > 1 else corrections.join(bounds, keys)
    if len(keys) > 1:
        placed = placed.filter(F.col("variant_id") == F.col("_variant")).drop("_variant") if "variant_id" in corrections.columns else placed.withColumnRenamed("_variant", "variant_id")
    fixes = placed.select(
        *keys,
        (F.col("start_ms") - F.col("v_start")).alias("at"),
        F.lit(1).alias("kind"),
        (F.col("end_ms") - F.col("v_start")).alias("reach"),
        F.lit(0).cast("long").alias("token_id"),
        (F.greatest("start_ms", "v_start") - F.col("v_start")).alias("start_ms"),
        (F.least("end_ms", "v_end") - F.col("v_start")).alias("end_ms"),
        "text",
        F.lit(1.0).alias("confidence"),
        ((F.col("end_ms") > F.col("v_start")) & (F.col("start_ms") < F.col("v_end"))).alias("inside"),
    )
    names = ["token_id", "start_ms", "end_ms", "text", "confidence"]
    spoken = clipped.select(*keys, F.col("end_ms").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("reach"), *names, F.lit(True).alias("inside"))
    reached = prefix_scan(spoken.unionByName(fixes), keys, ["at", "kind", "token_id"], time_block(F.col("at") / 1000), maxs={"reached": F.col("reach")})
    corrected = F.col("kind") == 1
    both = reached.filter(F.col("inside") & (corrected | F.coalesce(F.col("reached") <= F.col("start_ms"), F.lit(True)))).select(*keys, *names, corrected.alias("corrected"))
    return numbered(both, keys, ["start_ms", "corrected", "token_id", "end_ms", "text"], time_block(F.col("start_ms") / 1000), "place")


def with_implicit_end(lines: DataFrame, default_s: float = DEFAULT_LINE_DURATION_S) -> DataFrame:
    """A line without an end runs to the next line's start; the last one gets the default length."""
    following = prefix_scan(
        lines, ["track_id"], ["line_no"], row_block(F.col("line_no")), lasts={"_next": F.col("start_s")}, reverse=True
    )
    return following.withColumn("end_s", F.coalesce("end_s", "_next", F.col("start_s") + F.lit(default_s))).drop("_next")


def cut_line_windows(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Lines inside each window, shifted to its start and clipped. ``windows``: ``track_id, window_id, start_s, end_s``."""
    points = with_implicit_end(lines).withColumnsRenamed({"start_s": "p_start", "end_s": "p_end"})
    spans = windows.withColumnsRenamed({"start_s": "s_start", "end_s": "s_end"})
    return (
        overlap_join(points, spans, ["track_id"])
        .withColumn("start_s", F.greatest(F.lit(0.0), F.col("p_start") - F.col("s_start")))
        .withColumn("end_s", F.least(F.col("s_end") - F.col("s_start"), F.col("p_end") - F.col("s_start")))
        .filter(F.col("end_s") > F.col("start_s"))
        .drop("p_start", "p_end", "s_start", "s_end")
    )


def window_faults(windows: DataFrame, cut: DataFrame) -> DataFrame:
    """Windows that are reversed or hold no line."""
    held = cut.select("track_id", "window_id").distinct().withColumn("_held", F.lit(True))
    reason = F.when(F.col("start_s") >= F.col("end_s"), "reversed_window").when(F.col("_held").isNull(), "empty_window")
    return windows.join(held, ["track_id", "window_id"], "left").withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_held")


def line_segments(lines: DataFrame, default_s: float = DEFAULT_LINE_DURATION_S) -> DataFrame:
    """Lines as segments with a default length."""
    return lines.withColumn("end_s", F.coalesce("end_s", F.col("start_s") + F.lit(default_s)))


def line_text(lines: DataFrame) -> DataFrame:
    """Each track's non-blank lines joined by spaces."""
    return (
        lines.withColumn("text", trimmed(F.col("text")))
        .filter(F.col("text") != "")
        .groupBy("track_id")
        .agg(ordered_text(["start_s", "line_no"], F.col("text")).alias("text"))
    )


def candidates(words: DataFrame, moments: DataFrame, sources: DataFrame) -> DataFrame:
    """Moments with whole-millisecond bounds, an excerpt and a content id. ``sources``: ``stream_id, source_sha256``."""
    spoken = words.withColumn("text", trimmed(F.col("text"))).filter(F.col("text") != "")
    texts = span_text(spoken, moments.select("stream_id", "rank", "start_s", "end_s"), ["rank"]).select(
        "stream_id", "rank", F.coalesce("text", F.lit("")).alias("excerpt")
    )
    start, end = as_ms(F.col("start_s")), as_ms(F.col("end_s"))
    canonical = F.concat(
        F.lit('{"end_ms":'), end.cast("string"),
        F.lit(f',"schema_version":"{ANALYSIS_SCHEMA_VERSION}","source_sha256":"'), F.col("source_sha256"),
        F.lit('","start_ms":'), start.cast("string"), F.lit("}"),
    )
    return (
        moments.join(texts, ["stream_id", "rank"])
        .join(sources, "stream_id")
        .select("stream_id", F.sha2(canonical, 256).alias("candidate_id"), start.alias("start_ms"), end.alias("end_ms"), "score", "excerpt")
    )


def first_source(pieces: DataFrame, in_memory: DataFrame, saved: DataFrame, caption_file: DataFrame) -> DataFrame:
    """Text of a piece from the first source that may speak for it.

    Each source holds ``piece_id, text`` for the pieces it was cut for. An in-memory transcript is final
    even when its text is null; a saved one and the caption file are only tried after that.
    """
    mine = in_memory.select("piece_id", F.col("text").alias("_m"), F.lit(True).alias("_has"))
    kept = saved.select("piece_id", F.col("text").alias("_s"))
    file = caption_file.select("piece_id", F.col("text").alias("_f"))
    return (
        pieces.join(mine, "piece_id", "left")
        .join(kept, "piece_id", "left")
        .join(file, "piece_id", "left")
        .withColumn("text", F.when(F.col("_has"), F.col("_m")).otherwise(F.coalesce("_s", "_f")))
        .withColumn(
            "text_source",
            F.when(F.col("_has"), "memory").when(F.col("_s").isNotNull(), "saved").when(F.col("_f").isNotNull(), "caption_file").otherwise("none"),
        )
        .drop("_m", "_has", "_s", "_f")
    )


def first_segments(pieces: DataFrame, scoped: DataFrame, caption_file: DataFrame, whole: DataFrame) -> DataFrame:
    """Segments of a piece: its own span, else its caption file, else the whole transcript. Each frame has ``piece_id``."""
    a = scoped.withColumn("_source", F.lit("span"))
    b = caption_file.join(scoped.select("piece_id").distinct(), "piece_id", "left_anti").withColumn("_source", F.lit("caption_file"))
    used = scoped.select("piece_id").union(caption_file.select("piece_id")).distinct()
    c = whole.join(used, "piece_id", "left_anti").withColumn("_source", F.lit("whole"))
    return a.unionByName(b).unionByName(c).join(pieces.select("piece_id"), "piece_id", "left_semi")


def piece_windows(pieces: DataFrame, spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Absolute window of piece ``index``: the span at the same index plus its offset, else the only declared range."""
    aligned = spans.select(
        "batch_id",
        F.col("index"),
        (F.col("start_s") + F.col("offset_s")).alias("_a"),
        (F.col("end_s") + F.col("offset_s")).alias("_b"),
    )
    single = (
        ranges.groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("start_s").alias("_c"), F.min("end_s").alias("_d"))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )
    return (
        pieces.join(aligned, ["batch_id", "index"], "left")
        .join(single, "batch_id", "left")
        .select(*pieces.columns, F.coalesce("_a", "_c").alias("start_s"), F.coalesce("_b", "_d").alias("end_s"))
    )


def relative_ranges(ranges: DataFrame) -> DataFrame:
    """Declared ranges on the clock of a download that begins at the earliest of them."""
    offset = ranges.groupBy("contract_id").agg(F.min("start_s").alias("_off"))
    shift = F.when(F.abs("_off") > 1e-6, F.col("_off")).otherwise(F.lit(0.0))
    return (
        ranges.join(offset, "contract_id")
        .withColumn("start_s", F.when(shift == 0, F.col("start_s")).otherwise(F.greatest(F.lit(0.0), F.col("start_s") - shift)))
        .withColumn("end_s", F.when(shift == 0, F.col("end_s")).otherwise(F.greatest(F.lit(0.0), F.col("end_s") - shift)))
        .withColumnRenamed("_off", "offset_s")
    )


def lyric_choice(contracts: DataFrame, assets: DataFrame, provider: DataFrame) -> DataFrame:
    """Which synced text a contract uses, or why none.

    A declared local asset must be intact and is never replaced by the provider. ``contracts``:
    ``contract_id, lrc_asset_id, provider_enabled, track_name``; ``assets``: ``asset_id, intact, content``;
    ``provider``: ``track_name, content``.
    """
    local = assets.select(F.col("asset_id").alias("lrc_asset_id"), "intact", F.col("content").alias("_local"))
    remote = provider.select("track_name", F.col("content").alias("_remote"))
    declared = F.coalesce(F.col("lrc_asset_id") != "", F.lit(False))
    named = F.coalesce(F.col("track_name") != "", F.lit(False))
    reason = (
        F.when(declared & F.col("intact").isNull(), "asset_missing")
        .when(declared & ~F.col("intact"), "asset_modified")
        .when(~declared & F.col("provider_enabled") & ~named, "track_name_missing")
        .when(~declared & F.col("provider_enabled") & F.col("_remote").isNull(), "provider_has_none")
        .when(~declared & ~F.coalesce("provider_enabled", F.lit(False)), "no_source")
    )
    return (
        contracts.join(local, "lrc_asset_id", "left")
        .join(remote, "track_name", "left")
        .select(
            "contract_id",
            reason.alias("reason"),
            F.when(reason.isNull() & declared, F.lit("asset")).when(reason.isNull(), F.lit("provider")).alias("chosen"),
            F.when(reason.isNull(), F.when(declared, F.col("_local")).otherwise(F.col("_remote"))).alias("content"),
        )
    )
