"""Lyric ground truth: declared lines, the window cut out of them, and what a piece shows, compared place by place.

Three ordered sequences meet per piece: the expected lines, the piece's own segments and the events of its caption
file. They are rows of one frame with their place in the sequence, so one grouping by piece and place finds the
first differing place of both comparisons; no piece is compared with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.text import normal, ordered_tokens
from tessitura.operators.gate import loose_timing_fault
from tessitura.operators.spans import as_ms, cut_line_windows

# Fixed value.
TOLERANCE_S = 0.02
LINE = "struct<start_s:double,end_s:double,text:string,tokens:array<string>>"


def chosen_windows(pieces: DataFrame, contracts: DataFrame) -> DataFrame:
    """Each lyric piece with its track and window.

    ``contracts``: ``contract_id, track_id, n_ranges, n_segments, segment_start_s, segment_end_s``. A window that the piece
    leaves open is that of the contract's only segment; otherwise it stays open.
    """
    declared = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    alone = F.col("n_segments") == 1
    start = F.when(declared, F.col("start_s")).when(alone, F.col("segment_start_s"))
    end = F.when(declared, F.col("end_s")).when(alone, F.col("segment_end_s"))
    return (
        pieces.join(contracts, "contract_id")
        .withColumns({"_start": start, "_end": end})
        .withColumns({"start_s": F.col("_start"), "end_s": F.col("_end")})
        .withColumns({"windowed": F.col("start_s").isNotNull() & F.col("end_s").isNotNull(), "many": (F.col("n_ranges") > 1) | (F.col("n_segments") > 1)})
        .drop("_start", "_end", "n_ranges", "n_segments", "segment_start_s", "segment_end_s")
    )


def expected_lines(chosen: DataFrame, lines: DataFrame) -> DataFrame:
    """``piece_id, idx, start_s, end_s, text`` of what a piece must show: its window's lines, or the whole track without one."""
    windows = chosen.filter(F.col("windowed") & (F.col("start_s") < F.col("end_s"))).select("track_id", F.col("piece_id").alias("window_id"), "start_s", "end_s")
    cut = cut_line_windows(lines, windows).select(F.col("window_id").alias("piece_id"), "line_no", "start_s", "end_s", "text")
    whole = chosen.filter(~F.col("windowed") & ~F.col("many")).select("piece_id", "track_id").join(lines, "track_id").select("piece_id", "line_no", "start_s", "end_s", "text")
    order = Window.partitionBy("piece_id").orderBy("line_no")
    return cut.unionByName(whole).select("piece_id", (F.row_number().over(order) - 1).alias("idx"), "start_s", "end_s", "text")


def difference(shown: Column, expected: Column) -> Column:
    """How a shown line differs from the expected one: kind and both values; null where it does not.

    An expected line without an end, as of a track without a window, leaves the end open.
    """

    def told(kind: str, want: Column, got: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), want.cast("string").alias("expected"), got.cast("string").alias("got"))

    late = F.abs(shown["end_s"] - expected["end_s"]) > TOLERANCE_S
    found = F.when(~shown["tokens"].eqNullSafe(expected["tokens"]), told("text", expected["text"], shown["text"])).when(
        F.abs(shown["start_s"] - expected["start_s"]) > TOLERANCE_S, told("start", as_ms(expected["start_s"]), as_ms(shown["start_s"]))
    )
    return found.when(F.coalesce(late, F.lit(False)), told("end", as_ms(expected["end_s"]), as_ms(shown["end_s"])))


def first_other(left: Column, right: Column) -> Column:
    """First place at which two arrays differ; null where they are equal."""
    places = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)))
    return F.get(F.filter(places, lambda i: ~F.get(left, i).eqNullSafe(F.get(right, i))), F.lit(0))


def aligned(expected: DataFrame, segments: DataFrame, events: DataFrame) -> DataFrame:
    """Per piece: counts of the three sequences, the words of two, and the first difference of segments and of events.

    Each side: ``piece_id, idx, start_s, end_s, text``.
    """
    none = F.lit(None).cast(LINE)
    sides = ("e", "s", "v")
    rows = [
        frame.select(
            "piece_id",
            "idx",
            *[
                (F.struct("start_s", "end_s", "text", ordered_tokens(normal(F.coalesce("text", F.lit("")))).alias("tokens")).cast(LINE) if own == side else none).alias(own)
                for own in sides
            ],
        )
        for side, frame in zip(sides, (expected, segments, events), strict=True)
    ]
    places = (
        rows[0].unionByName(rows[1]).unionByName(rows[2])
        .repartition("piece_id")
        .groupBy("piece_id", "idx")
        .agg(*[F.first(c, ignorenulls=True).alias(c) for c in sides])
        .withColumns({f"{c}_off": F.when(F.col(c).isNotNull() & F.col("e").isNotNull(), difference(F.col(c), F.col("e"))) for c in ("s", "v")})
    )

    def words(side: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("idx", F.col(side)["tokens"].alias("tokens")))))
        return F.flatten(F.transform(ordered, lambda x: x["tokens"]))

    def first(side: str) -> Column:
        return F.min_by(F.struct("idx", F.col(f"{side}_off").alias("off")), F.when(F.col(f"{side}_off").isNotNull(), F.col("idx")))

    return places.groupBy("piece_id").agg(
        *[F.count(c).alias(f"n_{c}") for c in sides], words("e").alias("e_words"), words("s").alias("s_words"), first("s").alias("s_first"), first("v").alias("v_first")
    )


def ground_truth(pieces: DataFrame, contracts: DataFrame, lines: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """``piece_id, lyric``: why a lyric piece departs from its declared lines, as ``reason`` and ``evidence``; null where it does not.

    ``pieces``: ``piece_id, contract_id, subtitle_text, segments, start_s, end_s``; ``contracts`` as ``chosen_windows`` takes them, plus
    ``asset_fault``; ``lines``: ``track_id, line_no, start_s, end_s, text``; ``events``: ``piece_id, line_no, start_s, end_s, text`` of
    caption files; ``files``: ``piece_id, file_fault`` of those that exist. Faults count in the order in which they would
    be met: asset, window, words, segments, caption file, events.
    """
    chosen = chosen_windows(pieces, contracts)
    segments = chosen.select("piece_id", F.posexplode("segments").alias("idx", "x")).select("piece_id", "idx", "x.start_s", "x.end_s", "x.text")
    order = Window.partitionBy("piece_id").orderBy("line_no")
    shown = events.join(chosen.select("piece_id"), "piece_id", "left_semi").select("piece_id", (F.row_number().over(order) - 1).alias("idx"), "start_s", "end_s", "text")
    seen = files.select("piece_id", F.lit(True).alias("has_file"), "file_fault")
    rows = chosen.join(aligned(expected_lines(chosen, lines), segments, shown), "piece_id", "left").join(seen, "piece_id", "left")
    own = ordered_tokens(normal(F.coalesce("subtitle_text", F.lit(""))))
    rows = rows.select("*", own.alias("own_words"), loose_timing_fault(F.col("segments"), F.col("start_s"), F.col("end_s")).alias("loose")).withColumns(
        {"words_at": first_other(F.col("own_words"), F.col("e_words")), "segments_at": first_other(F.col("s_words"), F.col("e_words"))}
    )
    n = {c: F.coalesce(f"n_{c}", F.lit(0)) for c in ("e", "s", "v")}

    def fault(reason: str | Column, want: Column | None = None, got: Column | None = None) -> Column:
        shown_ = F.create_map(F.lit("expected"), F.coalesce(want.cast("string"), F.lit("")), F.lit("got"), F.coalesce(got.cast("string"), F.lit(""))) if want is not None else F.create_map().cast("map<string,string>")
        return F.struct((F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), shown_.alias("evidence"))

    def place(side: str, label: str) -> Column:
        first = F.col(f"{side}_first")
        return fault(F.concat(F.lit(f"{label}_"), first["off"]["kind"], F.lit("@"), first["idx"].cast("string")), first["off"]["expected"], first["off"]["got"])

    def other(label: str, at: Column, left: str) -> Column:
        return fault(F.concat(F.lit(f"{label}@"), at.cast("string")), F.get("e_words", at), F.get(left, at))

    windowed = F.col("windowed")
    lyric = (
        F.when(F.col("asset_fault").isNotNull(), fault(F.concat(F.lit("lyrics_"), F.col("asset_fault"))))
        .when(windowed & (F.col("start_s") >= F.col("end_s")), fault("window_reversed"))
        .when(windowed & (n["e"] == 0), fault("window_empty"))
        .when(~windowed & F.col("many"), fault("window_undeclared"))
        .when(F.coalesce(F.size("e_words"), F.lit(0)) <= 0, fault("lyrics_without_words"))
        .when(F.col("subtitle_text").isNull(), fault("no_subtitle_text"))
        .when(F.col("words_at").isNotNull(), other("words", F.col("words_at"), "own_words"))
        .when(F.coalesce(F.size("segments"), F.lit(0)) <= 0, fault("no_segments"))
        .when(windowed & (n["s"] != n["e"]), fault("segment_count", n["e"], n["s"]))
        .when(windowed & F.col("s_first").isNotNull(), place("s", "segment"))
        .when(~windowed & F.col("loose").isNotNull(), fault(F.concat(F.lit("segment_"), F.col("loose"))))
        .when(~windowed & F.col("segments_at").isNotNull(), other("segment_words", F.col("segments_at"), "s_words"))
        .when(F.col("has_file").isNull(), fault("caption_file_missing"))
        .when(F.col("file_fault").isNotNull(), fault(F.concat(F.lit("caption_file_"), F.col("file_fault"))))
        .when(n["v"] != n["e"], fault("event_count", n["e"], n["v"]))
        .when(F.col("v_first").isNotNull(), place("v", "event"))
    )
    return rows.select("piece_id", lyric.alias("lyric"))
