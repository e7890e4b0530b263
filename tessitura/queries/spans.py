"""Words against spans, timed lines and caption files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions.clock import centiseconds
from tessitura.operators import captions, segments
from tessitura.operators import spans as op
from tessitura.queries.common_sql import ISLANDS, PIECES, TOP, with_words
from tessitura.plans.scan import summary
from tessitura.queries.segments import ms
from tessitura.sources import timed_text
from tessitura.sources.tables import table, words


def moments(stream: DataFrame) -> DataFrame:
    return segments.top_moments(segments.scored_pieces(segments.speech_pieces(stream))).select(
        "stream_id", "rank", "start_s", "end_s", "score"
    )


def span_text(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder)
    return op.span_text(stream, moments(stream), ["rank"]).select("stream_id", "rank", "text")


def span_segments(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder).select("stream_id", "token_id", "start_s", "end_s", "text")
    clips = moments(stream.withColumn("language", F.lit("")))
    return op.relative_segments(stream, clips.drop("score")).select("stream_id", "rank", "token_id", ms("start_s"), ms("end_s"), "text")


def half_spans(stream: DataFrame) -> DataFrame:
    """Spans that cut through words: 20.3 s long, every 50 s of each stream."""
    ends = stream.groupBy("stream_id").agg(F.max("end_s").alias("to_s"))
    return ends.select("stream_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("to_s") / 50).cast("int"))).alias("n")).select(
        "stream_id", "n", (F.col("n") * 50 + 0.4).alias("start_s"), (F.col("n") * 50 + 20.7).alias("end_s")
    )


def clip_words(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder).select("stream_id", "token_id", "start_s", "end_s", "text", "confidence")
    return op.render_words(stream, half_spans(stream), ["n"]).select("stream_id", "n", "token_id", ms("start_s"), ms("end_s"), "text")


def variants(spark: SparkSession, folder: str) -> DataFrame:
    """Three overlapping windows of every stream: the whole of it, its opening, and a stretch that begins inside the opening."""
    d = F.col("doc_id")
    kinds = F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("v")
    bounds = lambda *at: F.when(F.col("v") == 0, at[0]).when(F.col("v") == 1, at[1]).otherwise(at[2])
    return table(spark, folder, "documents").select(d, kinds).select(
        (d * 3 + F.col("v")).alias("variant_id"),
        d.alias("stream_id"),
        bounds(F.lit(0), 1000 + d % 7 * 500, 15000 + d % 5 * 333).cast("long").alias("start_ms"),
        bounds(F.lit(100_000_000), 31013 + d % 11 * 700, 90000 + d % 13 * 1111).cast("long").alias("end_ms"),
    )


def variant_words(spark: SparkSession, folder: str) -> DataFrame:
    return op.words_in_range_ms(words(spark, folder), variants(spark, folder)).select(
        "variant_id", "token_id", "start_ms", "end_ms", "text"
    )


def corrected_words(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth word is corrected, the one after it too and wider, so corrections overlap each other."""
    stream, shown = words(spark, folder), variants(spark, folder)
    clipped = op.words_in_range_ms(stream, shown).select("stream_id", "variant_id", "token_id", "start_ms", "end_ms", "text", "confidence")
    wide = F.when(F.col("token_id") % 50 == 1, 250).otherwise(0)
    fixes = stream.filter(F.col("token_id") % 50 < 2).select(
        "stream_id", (op.as_ms(F.col("start_s")) - wide).alias("start_ms"), (op.as_ms(F.col("end_s")) + wide).alias("end_ms"), F.concat(F.lit("*"), F.col("text")).alias("text"),
    )
    return op.corrected_words(clipped, fixes, shown).select(
        "variant_id", "place", "token_id", "start_ms", "end_ms", "text", F.round("confidence", 2).alias("confidence")
    )


def moment_candidates(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder)
    sources = table(spark, folder, "documents").select(F.col("doc_id").alias("stream_id"), F.sha2("text", 256).alias("source_sha256"))
    return op.candidates(stream, moments(stream), sources).select(
        "stream_id", "candidate_id", "start_ms", "end_ms", F.round("score", 6).alias("score"), "excerpt"
    )


def timed_lines(stream: DataFrame) -> DataFrame:
    """Six words to a line; the line starts with its first word."""
    return (
        stream.groupBy(F.col("stream_id").alias("track_id"), F.floor(F.col("token_id") / 6).cast("long").alias("line_no"))
        .agg(F.min("start_s").alias("start_s"), op.ordered_text(["token_id"], F.col("text")).alias("text"))
        .withColumn("end_s", F.lit(None).cast("double"))
    )


def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder)
    windows = half_spans(stream).withColumnsRenamed({"stream_id": "track_id", "n": "window_id"})
    return op.cut_line_windows(timed_lines(stream), windows).select("track_id", "window_id", "line_no", ms("start_s"), ms("end_s"), "text")


def line_window_faults(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder)
    windows = (
        half_spans(stream)
        .withColumnsRenamed({"stream_id": "track_id", "n": "window_id"})
        .withColumn("start_s", F.when(F.col("window_id") % 5 == 4, F.col("end_s") + 1).otherwise(F.col("start_s")))
    )
    return op.window_faults(windows, op.cut_line_windows(timed_lines(stream), windows)).select("track_id", "window_id", "reason")


def line_text(spark: SparkSession, folder: str) -> DataFrame:
    lines = timed_lines(words(spark, folder))
    held = op.line_segments(lines).groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_s").alias("last_end_s"))
    return op.line_text(lines).join(held, "track_id").select("track_id", "n", ms("last_end_s"), "text")


def whole_stream_segments(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder)
    bent = stream.withColumn("text", F.when(F.col("token_id") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text")))).withColumn(
        "end_s", F.when(F.col("token_id") % 13 == 0, F.col("start_s")).otherwise(F.col("end_s"))
    )
    return op.plain_segments(bent).select("stream_id", "token_id", ms("start_s"), ms("end_s"), "text")


def relative_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ranges = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("contract_id"),
        F.col("l_linenumber").alias("n"),
        F.when(F.col("l_orderkey") % 5 == 0, (F.col("l_linenumber") - 1).cast("double")).otherwise(F.col("l_quantity")).alias("start_s"),
        (F.col("l_quantity") + 60).alias("end_s"),
    )
    return op.relative_ranges(ranges).select("contract_id", "n", "start_s", "end_s", "offset_s")


def turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("piece_id"), "conv_id", "turn", "text"
    )


def text_source(spark: SparkSession, folder: str) -> DataFrame:
    pieces = turns(spark, folder)
    memory = pieces.filter(F.col("conv_id") % 3 == 0).select("piece_id", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text"))
    saved = pieces.filter(F.col("conv_id") % 4 < 2).select("piece_id", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"))
    file = pieces.filter(F.col("conv_id") % 5 < 3).select("piece_id", F.lower("text").alias("text"))
    return op.first_source(pieces.select("piece_id"), memory, saved, file).select("piece_id", "text", "text_source")


def segment_source(spark: SparkSession, folder: str) -> DataFrame:
    pieces = turns(spark, folder)
    cols = [F.col("piece_id"), (F.col("turn") * 2.0).alias("start_s"), (F.col("turn") * 2.0 + 1.5).alias("end_s"), "text"]
    scoped = pieces.filter(F.col("conv_id") % 3 == 0).select(*cols)
    file = pieces.filter(F.col("conv_id") % 5 < 3).select(*cols)
    return op.first_segments(pieces, scoped, file, pieces.select(*cols)).select("piece_id", ms("start_s"), ms("end_s"), F.col("_source").alias("source"))


def piece_windows(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    pieces = lines.select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("index"))
    spans = lines.filter(F.col("l_linenumber") <= F.col("l_orderkey") % 5).select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("index"), F.col("l_quantity").alias("start_s"),
        (F.col("l_quantity") + 9).alias("end_s"), (F.col("l_orderkey") % 3 * 10.0).alias("offset_s"),
    )
    ranges = lines.filter(F.col("l_tax") == 0.02).select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_quantity").alias("start_s"), (F.col("l_quantity") + 30).alias("end_s")
    )
    return op.piece_windows(pieces, spans, ranges).groupBy("batch_id", "index", "start_s", "end_s").agg(F.count(F.lit(1)).alias("n"))


def lyric_choice(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    contracts = docs.select(
        F.col("doc_id").alias("contract_id"),
        F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).alias("lrc_asset_id"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 2 == 0).alias("provider_enabled"),
        F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("track-"), (F.col("doc_id") % 40).cast("string"))).alias("track_name"),
    )
    assets = docs.filter(F.col("doc_id") % 13 != 0).select(
        F.col("doc_id").cast("string").alias("asset_id"), (F.col("doc_id") % 11 != 0).alias("intact"), F.col("source").alias("content")
    )
    provider = docs.filter(F.col("doc_id") % 4 != 1).select(
        F.concat(F.lit("track-"), F.col("doc_id").cast("string")).alias("track_name"), F.col("lang").alias("content")
    )
    return op.lyric_choice(contracts, assets, provider)


def lyric_files(stream: DataFrame) -> DataFrame:
    """Synced-lyrics texts written from the line fixture; every seventh holds a malformed tag, every ninth shifts half-way."""
    cs = F.floor(F.rint(F.col("start_s") * 1000) / 10).cast("long")
    tag = F.format_string("[%02d:%02d.%02d]", F.floor(cs / 6000).cast("long"), F.floor(cs / 100 % 60).cast("long"), cs % 100)
    wrong = (F.col("track_id") % 7 == 0) & (F.col("line_no") == 1)
    rows = timed_lines(stream).select(
        "track_id",
        "line_no",
        F.concat(
            F.when((F.col("track_id") % 9 == 0) & (F.col("line_no") == 2), F.lit("[offset:-1500]\n")).otherwise(F.lit("")),
            F.when(wrong, F.lit("[00:75.10]")).otherwise(tag),
            F.when(F.col("line_no") % 4 == 3, F.lit("[59:59.5]")).otherwise(F.lit("")),
            F.col("text"),
        ).alias("row"),
    )
    return rows.groupBy(F.col("track_id").alias("file_id")).agg(
        F.concat(F.lit("[ar:nobody]\n\n"), op.ordered_text(["line_no"], F.col("row"), "\n")).alias("content")
    )


def lyric_scan(spark: SparkSession, folder: str) -> DataFrame:
    lines, _ = timed_text.parse_synced_lyrics(lyric_files(words(spark, folder)))
    return lines.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(op.as_ms(F.col("start_s"))).alias("sum_ms"), F.max("line_no").alias("last_no"),
        F.min_by("text", "line_no").alias("first_text"),
    )


def lyric_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return timed_text.parse_synced_lyrics(lyric_files(words(spark, folder)))[1]


def caption_scripts(stream: DataFrame) -> DataFrame:
    """Caption scripts of the line fixture; tracks divisible by 8 carry one reversed line."""
    lines = op.with_implicit_end(timed_lines(stream)).withColumn(
        "end_s", F.when((F.col("track_id") % 8 == 0) & (F.col("line_no") == 1), F.col("start_s") - 1).otherwise(F.col("end_s"))
    )
    rows = captions.lyric_rows(lines.withColumn("text", F.concat(F.lit("{\\b1}"), F.col("text")))).withColumn(
        "row", F.replace("row", F.lit("\\{\\\\b1\\}"), F.lit("{\\b1}"))
    )
    return captions.caption_files(rows, ["track_id"], ["line_no"], "Lines").withColumnRenamed("track_id", "file_id")


def caption_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = timed_text.caption_segments(caption_scripts(words(spark, folder)))
    return found.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(centiseconds(F.col("start_s"))).alias("start_cs"), F.sum(centiseconds(F.col("end_s"))).alias("end_cs"),
        F.sum(F.char_length("text")).alias("n_chars"),
    )


def caption_scan_strict(spark: SparkSession, folder: str) -> DataFrame:
    judged = timed_text.judged_scripts(caption_scripts(words(spark, folder)))
    n = F.when(F.col("events").isNull(), F.lit(0)).otherwise(F.size("events")).cast("long")
    # Exploded, so that the filter is not pushed below the reading and repeats it.
    found = judged.select("file_id", F.explode_outer(F.array(F.struct(n.alias("n"), F.coalesce("reason", F.lit("ok")).alias("reason")))).alias("f"))
    return found.select("file_id", "f.*").filter((F.col("n") > 0) | (F.col("reason") != "ok"))


def caption_text(spark: SparkSession, folder: str) -> DataFrame:
    return timed_text.caption_text(caption_scripts(words(spark, folder))).select("file_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


def clip_captions(spark: SparkSession, folder: str) -> DataFrame:
    """From words to script rows: best spans, their words, caption lines, karaoke timing, event rows."""
    stream = words(spark, folder)
    clips = summary(moments(stream).drop("score"))
    clipped = op.render_words(stream.select("stream_id", "token_id", "start_s", "end_s", "text"), clips, ["rank"])
    # A clip holds no more words than its stream.
    sizes = clips.select("stream_id", "rank").join(stream_sizes(spark, folder), "stream_id")
    ordered = clipped.select("stream_id", "rank", F.col("token_id").alias("seq"), "start_s", "end_s", "text")
    laid = captions.caption_lines(ordered, ["stream_id", "rank"], sizes=sizes)
    timed = captions.line_timing(laid, ["stream_id", "rank"])
    return timed.select(
        "stream_id", "rank", "line_seq", "n_words", "start_cs", "end_cs", captions.dialogue_row(F.col("start_cs"), F.col("end_cs"), F.col("karaoke")).alias("row")
    )


def stream_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """At least as many words as each stream has, counted in its text without laying them out."""
    pieces = F.size(F.split("text", r"\s+")).cast("long")
    return table(spark, folder, "documents").groupBy(F.col("doc_id").alias("stream_id")).agg(F.sum(pieces).alias("_n"))


def lined(spark: SparkSession, folder: str) -> DataFrame:
    islands = segments.gap_islands(words(spark, folder), 2.0).select("stream_id", "seq", "start_s", "end_s", "text")
    return captions.caption_lines(islands, ["stream_id"], sizes=stream_sizes(spark, folder))


def caption_lines(spark: SparkSession, folder: str) -> DataFrame:
    return (
        lined(spark, folder)
        .groupBy("stream_id", "line_seq")
        .agg(
            F.count(F.lit(1)).alias("n_words"), F.min(op.as_ms(F.col("start_s"))).alias("start_ms"), F.max(op.as_ms(F.col("end_s"))).alias("end_ms")
        )
    )


def caption_events(spark: SparkSession, folder: str) -> DataFrame:
    timed = captions.line_timing(lined(spark, folder), ["stream_id"], "uppercase")
    return timed.select(
        "stream_id", "line_seq", "n_words", "start_cs", "end_cs", captions.dialogue_row(F.col("start_cs"), F.col("end_cs"), F.col("karaoke")).alias("row")
    )


QUERIES = {
    "span_text": span_text,
    "span_segments": span_segments,
    "clip_words": clip_words,
    "variant_words": variant_words,
    "corrected_words": corrected_words,
    "moment_candidates": moment_candidates,
    "line_windows": line_windows,
    "line_window_faults": line_window_faults,
    "line_text": line_text,
    "whole_stream_segments": whole_stream_segments,
    "relative_ranges": relative_ranges,
    "text_source": text_source,
    "segment_source": segment_source,
    "piece_windows": piece_windows,
    "lyric_choice": lyric_choice,
    "lyric_scan": lyric_scan,
    "lyric_rejects": lyric_rejects,
    "caption_scan": caption_scan,
    "caption_scan_strict": caption_scan_strict,
    "caption_text": caption_text,
    "caption_lines": caption_lines,
    "caption_events": caption_events,
    "clip_captions": clip_captions,
}


def _ms(expression: str) -> str:
    return f"CAST(round_even(({expression}) * 1000, 0) AS BIGINT)"


_HALF = """
_e AS (SELECT stream_id, max(end_s) AS to_s FROM words GROUP BY stream_id),
half AS (SELECT stream_id, n::INT AS n, n * 50 + 0.4::DOUBLE AS start_s, n * 50 + 20.7::DOUBLE AS end_s
         FROM _e, unnest(range(0, floor(to_s / 50)::BIGINT + 1)) AS u(n))"""
_LINES = """
lines AS MATERIALIZED (SELECT stream_id AS track_id, token_id // 6 AS line_no, min(start_s) AS start_s,
         string_agg(text, ' ' ORDER BY token_id) AS text FROM words GROUP BY 1, 2)"""
_ENDED = """
ended AS (SELECT *, coalesce(lead(start_s) OVER (PARTITION BY track_id ORDER BY line_no), start_s + 4.0) AS end_s FROM lines)"""
_VAR = """
v AS (SELECT doc_id * 3 + x AS variant_id, doc_id AS stream_id, [0, 1000 + doc_id % 7 * 500, 15000 + doc_id % 5 * 333][x + 1] AS a,
      [100000000, 31013 + doc_id % 11 * 700, 90000 + doc_id % 13 * 1111][x + 1] AS b FROM documents, unnest(range(3)) AS u(x)),
_q AS (SELECT stream_id, token_id, text, confidence, CAST(round_even(start_s * 1000, 0) AS BIGINT) AS ws,
       CAST(round_even(end_s * 1000, 0) AS BIGINT) AS we FROM words),
clipped AS MATERIALIZED (SELECT variant_id, token_id, greatest(ws, a) - a AS start_ms, least(we, b) - a AS end_ms, text, confidence
       FROM _q JOIN v USING (stream_id) WHERE we > a AND ws < b AND least(we, b) > greatest(ws, a))"""
_TURNS = "t AS (SELECT conv_id || '-' || turn AS piece_id, * FROM conversations)"
_CUT_LINES = """
cut AS (SELECT l.track_id, h.n AS window_id, line_no, greatest(0, l.start_s - h.start_s) AS a, least(h.end_s - h.start_s, l.end_s - h.start_s) AS b, text
        FROM ended l JOIN w h ON h.stream_id = l.track_id AND l.end_s > h.start_s AND l.start_s < h.end_s)"""
_LRC = """
_lc AS (SELECT *, CAST(round_even(start_s * 1000, 0) AS BIGINT) // 10 AS cs FROM lines),
_lt AS (SELECT track_id, line_no, text, cs * 10 AS t, 0 AS tag FROM _lc UNION ALL SELECT track_id, line_no, text, 3599500, 1 FROM _lc WHERE line_no % 4 = 3),
lrc AS (SELECT *, greatest(0, t - CASE WHEN track_id % 9 = 0 AND line_no >= 2 THEN 1500 ELSE 0 END) AS st FROM _lt
        WHERE NOT (track_id % 7 = 0 AND track_id IN (SELECT track_id FROM lines WHERE line_no = 1)))"""
def _lay(source: str, *keys: str) -> str:
    """Caption lines of ``source(keys, seq, start_s, end_s, text)``."""
    k = ", ".join(keys)
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    of = lambda a: ", ".join(f"{a}.{c}" for c in keys)
    return f"""
_lw AS MATERIALIZED (SELECT {k}, seq, start_s, end_s, text,
        length(text) AS k, right(rtrim(text), 1) IN ('.', '?', '!', ',', ';', ':') AS closes FROM ({source})),
_la AS (SELECT {of("a")}, a.seq, b.seq AS bs, b.closes, b.end_s - a.start_s > 7.0 AS late,
        sum(b.k) OVER (PARTITION BY {of("a")}, a.seq ORDER BY b.seq) + (b.seq - a.seq) AS chars
        FROM _lw a JOIN _lw b ON {same("a", "b")} AND b.seq BETWEEN a.seq AND a.seq + 12),
_ln AS MATERIALIZED (SELECT {k}, seq, min(CASE WHEN bs > seq AND (chars > 18 OR late) THEN bs WHEN bs > seq AND closes THEN bs + 1 END) AS nxt
        FROM _la GROUP BY {k}, seq),
_lr AS MATERIALIZED (WITH RECURSIVE r AS (SELECT {k}, seq FROM _ln WHERE seq = 0
        UNION ALL SELECT {of("n")}, n.nxt FROM r JOIN _ln n USING ({k}, seq) WHERE n.nxt IS NOT NULL) SELECT * FROM r),
_lh AS (SELECT {k}, seq, coalesce(lead(seq) OVER (PARTITION BY {k} ORDER BY seq), 1000000000) AS upto FROM _lr),
lay AS (SELECT {of("h")}, h.seq AS line_seq, count(*)::INT AS n_words, min(w.start_s) AS a, max(w.end_s) AS b,
        list(w.start_s ORDER BY w.seq) AS starts, list(w.end_s ORDER BY w.seq) AS ends, list(w.text ORDER BY w.seq) AS texts
        FROM _lh h JOIN _lw w ON {same("w", "h")} AND w.seq >= h.seq AND w.seq < h.upto GROUP BY {of("h")}, h.seq)"""


_LAY = _lay("SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY start_s, end_s, token_id) - 1 AS seq, start_s, end_s, text FROM words", "stream_id")


def _karaoke(keys: str, text: str) -> str:
    """Shares, clock texts and event rows of the lines of ``lay``; ``text`` is written over the word ``x``."""
    clock = lambda c: f"printf('%d:%02d:%02d.%02d', {c} // 360000, {c} % 360000 // 6000, {c} % 6000 // 100, {c} % 100)"
    return f"""
_k1 AS (SELECT {keys}, line_seq, n_words, starts, texts, [(coalesce(starts[i + 1], ends[n_words]) - starts[i]) * 100 FOR i IN range(1, n_words + 1)] AS slots FROM lay),
_k2 AS (SELECT *, list_reduce([{{'s': x, 'c': 0.0::DOUBLE}} FOR x IN slots], lambda p, q: {{'s': p.s + q.s,
        'c': p.c + CASE WHEN abs(p.s) >= abs(q.s) THEN (p.s - (p.s + q.s)) + q.s ELSE (q.s - (p.s + q.s)) + p.s END}}) AS z FROM _k1),
_k3 AS (SELECT *, round_even(z.s + z.c, 0)::BIGINT AS total, least(1, floor(round_even(z.s + z.c, 0) / n_words))::BIGINT AS least_cs FROM _k2),
_k4 AS (SELECT *, [greatest(least_cs, trunc(x)::BIGINT) FOR x IN slots] AS base FROM _k3),
_k5 AS (SELECT *, total - list_sum(base)::BIGINT AS lack FROM _k4),
_k6 AS (SELECT *, [CASE WHEN lack > 0 THEN -round_even((x - trunc(x)) * 1e9, 0)::BIGINT ELSE -base[i] END FOR x, i IN slots] AS worth FROM _k5),
_k7 AS (SELECT *, [base[i] + sign(lack)::BIGINT * (abs(lack) // n_words + (len([j FOR j IN range(1, n_words + 1) IF worth[j] < worth[i] OR (worth[j] = worth[i] AND j < i)]) < abs(lack) % n_words)::INT)
        FOR i IN range(1, n_words + 1)] AS given FROM _k6),
_k8 AS (SELECT *, CASE WHEN least_cs >= 1 AND list_min(given) >= least_cs THEN given END AS share, round_even(starts[1] * 100, 0)::BIGINT AS c0 FROM _k7),
_k9 AS (SELECT *, c0 + list_sum(share)::BIGINT AS c1 FROM _k8)
SELECT {keys}, line_seq, n_words, c0 AS start_cs, c1 AS end_cs,
  CASE WHEN share IS NOT NULL THEN 'Dialogue: 0,' || {clock('c0')} || ',' || {clock('c1')} || ',Default,,0,0,0,,' ||
    array_to_string([chr(123) || '\\k' || share[i] || chr(125) || replace(replace(replace({text}, '\\', '\\\\'), chr(123), '\\' || chr(123)), chr(125), '\\' || chr(125)) FOR x, i IN texts], '') END AS row FROM _k9"""


ORACLES = {
    "span_text": with_words(ISLANDS, PIECES, TOP)
    + """SELECT t.stream_id, t.rank, string_agg(w.text, ' ' ORDER BY w.token_id) AS text FROM top t
        LEFT JOIN words w ON w.stream_id = t.stream_id AND w.end_s > t.start_s AND w.start_s < t.end_s GROUP BY 1, 2""",
    "span_segments": with_words(ISLANDS, PIECES, TOP)
    + f""", c AS (SELECT t.stream_id, t.rank, w.token_id, greatest(0, w.start_s - t.start_s) AS a, least(t.end_s - t.start_s, w.end_s - t.start_s) AS b, w.text
        FROM top t JOIN words w ON w.stream_id = t.stream_id AND w.end_s > t.start_s AND w.start_s < t.end_s)
        SELECT stream_id, rank, token_id, {_ms("a")} AS start_ms, {_ms("b")} AS end_ms, text FROM c WHERE b > a""",
    "clip_words": with_words(_HALF)
    + f""", c AS (SELECT t.stream_id, t.n, w.token_id, greatest(0, w.start_s - t.start_s) AS a, least(t.end_s - t.start_s, w.end_s - t.start_s) AS b, w.text
        FROM half t JOIN words w ON w.stream_id = t.stream_id AND w.end_s > t.start_s AND w.start_s < t.end_s)
        SELECT stream_id, n, row_number() OVER (PARTITION BY stream_id, n ORDER BY token_id) - 1 AS token_id, {_ms("a")} AS start_ms, {_ms("b")} AS end_ms, text
        FROM c WHERE b > a""",
    "variant_words": with_words(_VAR) + "SELECT variant_id, token_id, start_ms, end_ms, text FROM clipped",
    "corrected_words": with_words(_VAR)
    + """, f AS (SELECT stream_id, ws - CASE WHEN token_id % 50 = 1 THEN 250 ELSE 0 END AS ws, we + CASE WHEN token_id % 50 = 1 THEN 250 ELSE 0 END AS we, '*' || text AS text FROM _q WHERE token_id % 50 < 2),
        g AS (SELECT variant_id, f.*, a, b FROM f JOIN v USING (stream_id)),
        gone AS (SELECT DISTINCT c.variant_id, c.token_id FROM clipped c JOIN g ON c.variant_id = g.variant_id AND c.start_ms < g.we - g.a AND c.end_ms > g.ws - g.a),
        r AS (SELECT variant_id, token_id, start_ms, end_ms, text, round(confidence, 2) AS confidence, 0 AS fix FROM clipped c
              WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.variant_id = c.variant_id AND gone.token_id = c.token_id)
              UNION ALL SELECT variant_id, 0, greatest(ws, a) - a, least(we, b) - a, text, 1.0, 1 FROM g WHERE we > a AND ws < b)
        SELECT variant_id, row_number() OVER (PARTITION BY variant_id ORDER BY start_ms, fix, token_id, end_ms, text) - 1 AS place, token_id, start_ms, end_ms, text, confidence FROM r""",
    "moment_candidates": with_words(ISLANDS, PIECES, TOP)
    + f""", x AS (SELECT t.stream_id, t.rank, any_value(t.score) AS score, {_ms("any_value(t.start_s)")} AS a, {_ms("any_value(t.end_s)")} AS b,
        coalesce(string_agg(w.text, ' ' ORDER BY w.token_id), '') AS excerpt FROM top t
        LEFT JOIN words w ON w.stream_id = t.stream_id AND w.end_s > t.start_s AND w.start_s < t.end_s GROUP BY 1, 2)
        SELECT x.stream_id, sha256('{{"end_ms":' || b || ',"schema_version":"1","source_sha256":"' || sha256(d.text) || '","start_ms":' || a || '}}') AS candidate_id,
        a AS start_ms, b AS end_ms, round(score, 6) AS score, excerpt FROM x JOIN documents d ON d.doc_id = x.stream_id""",
    "line_windows": with_words(_HALF, _LINES, _ENDED, "w AS (SELECT * FROM half)", _CUT_LINES)
    + f"SELECT track_id, window_id, line_no, {_ms('a')} AS start_ms, {_ms('b')} AS end_ms, text FROM cut WHERE b > a",
    "line_window_faults": with_words(
        _HALF, _LINES, _ENDED, "w AS (SELECT stream_id, n, CASE WHEN n % 5 = 4 THEN end_s + 1 ELSE start_s END AS start_s, end_s FROM half)", _CUT_LINES
    )
    + """SELECT stream_id AS track_id, n AS window_id, CASE WHEN start_s >= end_s THEN 'reversed_window' ELSE 'empty_window' END AS reason
        FROM w WHERE start_s >= end_s OR NOT EXISTS (SELECT 1 FROM cut c WHERE c.track_id = w.stream_id AND c.window_id = w.n AND b > a)""",
    "line_text": with_words(_LINES)
    + f"SELECT track_id, count(*) AS n, {_ms('max(start_s + 4.0)')} AS last_end_ms, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY track_id",
    "whole_stream_segments": with_words()
    + f"SELECT stream_id, token_id, {_ms('start_s')} AS start_ms, {_ms('end_s')} AS end_ms, text FROM words WHERE token_id % 11 <> 0 AND token_id % 13 <> 0",
    "relative_ranges": """WITH r AS (SELECT l_orderkey AS contract_id, l_linenumber AS n, CASE WHEN l_orderkey % 5 = 0 THEN l_linenumber - 1.0::DOUBLE ELSE l_quantity END AS a,
        l_quantity + 60 AS b FROM lineitem), o AS (SELECT *, min(a) OVER (PARTITION BY contract_id) AS m FROM r)
        SELECT contract_id, n, CASE WHEN m > 1e-6 THEN greatest(0, a - m) ELSE a END AS start_s, CASE WHEN m > 1e-6 THEN greatest(0, b - m) ELSE b END AS end_s,
        m AS offset_s FROM o""",
    "text_source": f"""WITH {_TURNS} SELECT piece_id,
        CASE WHEN conv_id % 3 = 0 THEN CASE WHEN turn % 2 = 0 THEN text END WHEN conv_id % 4 < 2 AND turn % 3 <> 0 THEN text
             WHEN conv_id % 5 < 3 THEN lower(text) END AS text,
        CASE WHEN conv_id % 3 = 0 THEN 'memory' WHEN conv_id % 4 < 2 AND turn % 3 <> 0 THEN 'saved' WHEN conv_id % 5 < 3 THEN 'caption_file' ELSE 'none' END AS text_source
        FROM t""",
    "segment_source": f"""WITH {_TURNS} SELECT piece_id, turn * 2000 AS start_ms, turn * 2000 + 1500 AS end_ms,
        CASE WHEN conv_id % 3 = 0 THEN 'span' WHEN conv_id % 5 < 3 THEN 'caption_file' ELSE 'whole' END AS source FROM t""",
    "piece_windows": """WITH p AS (SELECT l_orderkey AS batch_id, l_linenumber AS index FROM lineitem),
        s AS (SELECT l_orderkey AS batch_id, l_linenumber AS index, l_quantity + l_orderkey % 3 * 10 AS a, l_quantity + 9 + l_orderkey % 3 * 10 AS b
              FROM lineitem WHERE l_linenumber <= l_orderkey % 5),
        r AS (SELECT l_orderkey AS batch_id, min(l_quantity) AS c, min(l_quantity + 30) AS d FROM lineitem WHERE l_tax = 0.02::DOUBLE GROUP BY 1 HAVING count(*) = 1)
        SELECT p.batch_id, p.index, coalesce(a, c) AS start_s, coalesce(b, d) AS end_s, count(*) AS n
        FROM p LEFT JOIN s USING (batch_id, index) LEFT JOIN r USING (batch_id) GROUP BY ALL""",
    "lyric_choice": """WITH c AS (SELECT doc_id, doc_id % 3 = 0 AS declared, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 2 = 0 END AS enabled,
        CASE WHEN doc_id % 5 <> 0 THEN doc_id % 40 END AS track FROM documents),
        j AS (SELECT c.*, a.doc_id AS aid, a.source, p.lang FROM c LEFT JOIN documents a ON c.declared AND a.doc_id = c.doc_id AND a.doc_id % 13 <> 0
              LEFT JOIN documents p ON p.doc_id = c.track AND p.doc_id % 4 <> 1),
        r AS (SELECT *, CASE WHEN declared AND aid IS NULL THEN 'asset_missing' WHEN declared AND doc_id % 11 = 0 THEN 'asset_modified'
              WHEN NOT declared AND enabled AND track IS NULL THEN 'track_name_missing' WHEN NOT declared AND enabled AND lang IS NULL THEN 'provider_has_none'
              WHEN NOT declared AND NOT coalesce(enabled, false) THEN 'no_source' END AS reason FROM j)
        SELECT doc_id AS contract_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN declared THEN 'asset' ELSE 'provider' END END AS chosen,
        CASE WHEN reason IS NULL THEN CASE WHEN declared THEN source ELSE lang END END AS content FROM r""",
    "lyric_scan": with_words(_LINES, _LRC)
    + """SELECT track_id AS file_id, count(*) AS n, sum(st)::BIGINT AS sum_ms, count(*) - 1 AS last_no, arg_min(text, (st, line_no, tag)) AS first_text
        FROM lrc GROUP BY track_id""",
    "lyric_rejects": with_words(_LINES)
    + "SELECT track_id AS file_id, 'bad_time_tag:00:75.10' AS reason FROM lines WHERE track_id % 7 = 0 AND line_no = 1",
    "caption_scan": with_words(_LINES, _ENDED)
    + """, c AS (SELECT *, CAST(round_even(start_s * 100, 0) AS BIGINT) AS a, CAST(round_even(end_s * 100, 0) AS BIGINT) AS b FROM ended
        WHERE NOT (track_id % 8 = 0 AND line_no = 1))
        SELECT track_id AS file_id, count(*) AS n, sum(a)::BIGINT AS start_cs, sum(b)::BIGINT AS end_cs,
        sum(length(trim(regexp_replace(replace(replace(replace(text, '\\', '\\\\'), '{', '\\{'), '}', '\\}'), '\\{[^}]*\\}', '', 'g'))))::BIGINT AS n_chars
        FROM c GROUP BY track_id""",
    "caption_text": with_words(_LINES)
    + """, c AS (SELECT track_id, line_no, trim(regexp_replace(replace(replace(replace(text, '\\', '\\\\'), '{', '\\{'), '}', '\\}'), '\\{[^}]*\\}', '', 'g')) AS x FROM lines)
        SELECT track_id AS file_id, sha256(coalesce(string_agg(x, ' ' ORDER BY line_no) FILTER (x <> ''), '')) AS digest FROM c GROUP BY track_id""",
    "caption_scan_strict": with_words(_LINES)
    + """SELECT track_id AS file_id, CASE WHEN bad THEN 0 ELSE n END AS n, CASE WHEN bad THEN 'bad_time' ELSE 'ok' END AS reason
        FROM (SELECT track_id, count(*) AS n, track_id % 8 = 0 AND count(*) FILTER (line_no = 1) > 0 AS bad FROM lines GROUP BY track_id)""",
    "caption_events": with_words(_LAY) + "," + _karaoke("stream_id", "upper(replace(x, 'ß', 'SS'))"),
    "clip_captions": with_words(
        ISLANDS, PIECES, TOP,
        """_cw AS (SELECT t.stream_id, t.rank, w.token_id, greatest(0, w.start_s - t.start_s) AS start_s, least(t.end_s - t.start_s, w.end_s - t.start_s) AS end_s, w.text
        FROM top t JOIN words w ON w.stream_id = t.stream_id AND w.end_s > t.start_s AND w.start_s < t.end_s)""",
        _lay("SELECT stream_id, rank, row_number() OVER (PARTITION BY stream_id, rank ORDER BY token_id) - 1 AS seq, start_s, end_s, text FROM _cw WHERE end_s > start_s", "stream_id", "rank"),
    ) + "," + _karaoke("stream_id, rank", "x"),
    "caption_lines": with_words(_LAY) + f"SELECT stream_id, line_seq, n_words, {_ms('a')} AS start_ms, {_ms('b')} AS end_ms FROM lay",
}
