"""Lyric pieces, their caption files and the ground truth they are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions.clock import caption_clock, centiseconds
from tessitura.operators import lyrics as op
from tessitura.operators.spans import ordered_text
from tessitura.plans.scan import summary
from tessitura.queries.common_sql import with_words
from tessitura.queries.spans import _ENDED, _LINES, timed_lines
from tessitura.sources import timed_text
from tessitura.sources.tables import table
from tessitura.sources.words import words_from_documents

# Contract literals: id, ranges, segments, start and end of the first segment.
LYRIC_CONTRACTS = ((3, 1, 1, 2.4, 14.7), (4, 3, 2, None, None), (5, 0, 0, None, None))
SEGMENTS = "array<struct<text:string,start_s:double,end_s:double>>"


def keyed(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of lyric conversations with the window each declares; the track is the document of the same number."""
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    contract = F.col("conv_id") % 6
    declared = ((contract == 3) & (k % 4 != 0)) | ((contract == 4) & (k % 7 != 0))
    start = F.when(declared, (F.col("turn") * 3000 + 400) / 1000.0)
    return table(spark, folder, "conversations").filter(contract >= 3).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("piece_id"),
        contract.alias("contract_id"),
        F.col("conv_id").alias("track_id"),
        (k % 13).alias("m"),
        start.alias("start_s"),
        F.when(declared, (F.col("turn") * 3000 + F.when(k % 17 == 5, -600).otherwise(9700)) / 1000.0).alias("end_s"),
    )


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per lyric contract; a track of the wrong kind is the piece's affair, see ``asset_faults``."""
    return spark.createDataFrame(LYRIC_CONTRACTS, "contract_id long, n_ranges int, n_segments int, segment_start_s double, segment_end_s double")


def asset_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks whose file is missing or altered."""
    i = F.col("doc_id")
    fault = F.when(i % 13 == 0, "missing").when(i % 23 == 0, "unsafe").when(i % 17 == 0, "tampered")
    return table(spark, folder, "documents").select(i.alias("track_id"), fault.alias("asset_fault"))


def track_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Timed lines of the tracks that lyric pieces name."""
    named = keyed(spark, folder).select(F.col("track_id").alias("doc_id"))
    return timed_lines(words_from_documents(table(spark, folder, "documents").join(named, "doc_id", "left_semi")))


def shown(spark: SparkSession, folder: str, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces, caption files): what lyric pieces show, each thirteenth bent in another way."""
    rows = keyed(spark, folder).join(asset_faults(spark, folder), "track_id")
    chosen = op.chosen_windows(rows, contracts(spark, folder))
    held = op.expected_lines(chosen, lines).join(chosen.select("piece_id", "m", "windowed"), "piece_id")
    m, at = F.col("m"), F.col("idx")
    last = F.count(F.lit(1)).over(Window.partitionBy("piece_id")) - 1
    end = F.coalesce("end_s", F.col("start_s") + 0.4)
    bent = held.withColumn("last", last).select(
        "piece_id",
        "idx",
        F.col("text").alias("own"),
        F.when((m == 3) & (at == 0), None).otherwise(
            F.struct(
                F.when((m == 4) & (at == 1), F.concat("text", F.lit(" extra"))).otherwise(F.upper("text")).alias("text"),
                F.when((m == 5) & (at == 0), F.col("start_s") + 0.5).otherwise(F.col("start_s")).alias("start_s"),
                F.when((m == 6) & (at == F.col("last")), end + 0.3).otherwise(end).alias("end_s"),
            )
        ).alias("segment"),
        F.when(
            ~((m == 7) & (at == F.col("last"))),
            F.concat(
                F.lit("Dialogue: 0,"), caption_clock(centiseconds(F.col("start_s"))), F.lit(","),
                caption_clock(centiseconds(F.when((m == 8) & (at == 0), end + 0.3).otherwise(end))), F.lit(",Default,,0,0,0,,"), F.col("text"),
            ),
        ).alias("row"),
    )
    rolled = bent.groupBy("piece_id").agg(
        ordered_text(["idx"], F.col("own")).alias("own"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("idx", "segment")))), lambda x: x["segment"]).alias("segments"),
        ordered_text(["idx"], F.col("row"), "\n").alias("body"),
    )
    # Both sides read these rows, so they are gathered once.
    held = summary(rows.join(rolled, "piece_id", "left"))
    pieces = held.select(
        "piece_id", "contract_id", "track_id", "asset_fault", "start_s", "end_s",
        F.when(m == 0, None).when(m == 1, F.concat_ws(" ", "own", F.lit("extra"))).otherwise(F.coalesce("own", F.lit("x"))).alias("subtitle_text"),
        F.when(m == 2, F.array()).otherwise(F.coalesce("segments", F.array())).cast(SEGMENTS).alias("segments"),
    )
    files = held.filter(m != 9).select(
        F.col("piece_id").alias("file_id"), F.concat(F.lit("[Events]\n"), F.coalesce("body", F.lit("")), F.when(m == 10, "\nDialogue: 0,broken").otherwise("")).alias("content")
    )
    return pieces, files


def truth(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(pieces, their ``lyric`` finding)."""
    lines = summary(track_lines(spark, folder))
    pieces, files = shown(spark, folder, lines)
    # A script's verdict and its events are read apart from each other, but it is parsed once.
    scripts = summary(timed_text.judged_scripts(files))
    events = timed_text.script_events(scripts).withColumnRenamed("file_id", "piece_id")
    judged = scripts.select(F.col("file_id").alias("piece_id"), F.col("reason").alias("file_fault"))
    found = op.ground_truth(pieces, contracts(spark, folder), lines, events, judged)
    return pieces, found


def shown_evidence(evidence: Column) -> Column:
    """A map as text, keys in order."""
    pairs = F.transform(F.array_sort(F.map_keys(evidence)), lambda key: F.concat(key, F.lit("="), F.coalesce(F.element_at(evidence, key), F.lit(""))))
    return F.array_join(pairs, ";")


def lyric_ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """One row per lyric piece."""
    _, found = truth(spark, folder)
    return found.select("piece_id", F.coalesce("lyric.reason", F.lit("ok")).alias("reason"), F.coalesce(shown_evidence(F.col("lyric.evidence")), F.lit("")).alias("evidence"))


QUERIES = {"lyric_ground_truth": lyric_ground_truth}


def tokens_sql(text: str) -> str:
    """Ordered words of a text's normal form."""
    n = f"trim(regexp_replace(replace(strip_accents(replace(replace(lower({text}), 'ß', 'ss'), 'ñ', chr(1))), chr(1), 'ñ'), '\\s+', ' ', 'g'))"
    return f"[x FOR x IN [regexp_replace(regexp_replace(y, '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+$', '') FOR y IN regexp_split_to_array({n}, '[\\s_]+')] IF x <> '']"


def _msr(x: str) -> str:
    return f"CAST(round_even(({x}) * 1000, 0) AS BIGINT)"


_EVIDENCE = "'expected=' || coalesce(({want})::VARCHAR, '') || ';got=' || coalesce(({got})::VARCHAR, '')"
LYRIC_SQL = (
    _LINES,
    _ENDED,
    """
lc(contract_id, n_ranges, n_segments, seg_a, seg_b) AS (VALUES (3, 1, 1, 2.4::DOUBLE, 14.7::DOUBLE), (4, 3, 2, NULL, NULL), (5, 0, 0, NULL, NULL))""",
    """
lk AS (SELECT conv_id || '-' || turn AS piece_id, conv_id % 6 AS contract_id, conv_id AS track_id, turn, conv_id * 7 + turn * 3 AS k, (conv_id * 7 + turn * 3) % 13 AS m
       FROM conversations WHERE conv_id % 6 >= 3),
lw AS (SELECT lk.*, CASE WHEN declared THEN (turn * 3000 + 400) / 1000.0::DOUBLE WHEN n_segments = 1 THEN seg_a END AS a,
       CASE WHEN declared THEN (turn * 3000 + CASE WHEN k % 17 = 5 THEN -600 ELSE 9700 END) / 1000.0::DOUBLE WHEN n_segments = 1 THEN seg_b END AS b
       FROM (SELECT *, (contract_id = 3 AND k % 4 <> 0) OR (contract_id = 4 AND k % 7 <> 0) AS declared FROM lk) lk JOIN lc USING (contract_id) JOIN documents d ON d.doc_id = track_id)""",
    f"""
lx AS (SELECT w.piece_id, w.m, row_number() OVER (PARTITION BY w.piece_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY w.piece_id) AS n,
       CASE WHEN w.a IS NULL THEN l.start_s ELSE greatest(0, l.start_s - w.a) END AS s, CASE WHEN w.a IS NOT NULL THEN least(w.b - w.a, l.end_s - w.a) END AS e, l.text,
       {tokens_sql('l.text')} AS toks
       FROM lw w JOIN ended l ON l.track_id = w.track_id AND (w.a IS NULL AND w.contract_id = 5 OR w.a < w.b AND l.end_s > w.a AND l.start_s < w.b
            AND least(w.b - w.a, l.end_s - w.a) > greatest(0, l.start_s - w.a)))""",
    f"""
ly AS (SELECT piece_id, count(*) AS n, flatten(list(toks ORDER BY i)) AS words,
       flatten(list(CASE WHEN m = 3 AND i = 0 THEN [] WHEN m = 4 AND i = 1 THEN list_append(toks, 'extra') ELSE toks END ORDER BY i)) AS seg_words,
       max(CASE WHEN i = 1 THEN text END) AS text1, {_msr('max(CASE WHEN i = 0 THEN s END)')} AS s0, {_msr('max(CASE WHEN i = 0 THEN e END)')} AS e0,
       {_msr('max(CASE WHEN i = n - 1 THEN e END)')} AS el, {_msr('max(CASE WHEN i = n - 1 THEN e END) + 0.3')} AS el3,
       (CAST(round_even((max(CASE WHEN i = 0 THEN e END) + 0.3) * 100, 0) AS BIGINT) * 10) AS ev3 FROM lx GROUP BY piece_id)""",
    f"""
lz AS (SELECT w.*, y.*, y.n AS ny, a IS NOT NULL AS win, [q FOR q IN range(0, greatest(len(words), len(seg_words)) + 1) IF words[q + 1] IS DISTINCT FROM seg_words[q + 1]][1] AS pos
       FROM lw w LEFT JOIN ly y USING (piece_id)),
lt AS (SELECT piece_id, CASE WHEN track_id % 13 = 0 THEN 'lyrics_missing' WHEN track_id % 23 = 0 THEN 'lyrics_unsafe' WHEN track_id % 17 = 0 THEN 'lyrics_tampered'
       WHEN win AND a >= b THEN 'window_reversed' WHEN win AND ny IS NULL THEN 'window_empty' WHEN NOT win AND contract_id = 4 THEN 'window_undeclared'
       WHEN coalesce(len(words), 0) = 0 THEN 'lyrics_without_words' WHEN m = 0 THEN 'no_subtitle_text'
       WHEN m = 1 THEN 'words@' || len(words) WHEN m = 2 OR (m = 3 AND ny = 1) THEN 'no_segments'
       WHEN m = 3 AND win THEN 'segment_count' WHEN m = 4 AND ny > 1 AND win THEN 'segment_text@1' WHEN m = 5 AND win THEN 'segment_start@0' WHEN m = 6 AND win THEN 'segment_end@' || (ny - 1)
       WHEN m = 5 THEN 'segment_reversed@0' WHEN m IN (3, 4) AND pos IS NOT NULL THEN 'segment_words@' || pos
       WHEN m = 7 THEN 'event_count' WHEN m = 8 AND win THEN 'event_end@0' WHEN m = 9 THEN 'caption_file_missing' WHEN m = 10 THEN 'caption_file_malformed_dialogue' ELSE 'ok' END AS reason, * EXCLUDE (piece_id)
       FROM lz),
lyr AS MATERIALIZED (SELECT piece_id, reason, CASE WHEN reason LIKE 'words@%' THEN {_EVIDENCE.format(want='NULL', got="'extra'")}
       WHEN reason = 'segment_count' THEN {_EVIDENCE.format(want='ny', got='ny - 1')} WHEN reason = 'event_count' THEN {_EVIDENCE.format(want='ny', got='ny - 1')}
       WHEN reason = 'segment_text@1' THEN {_EVIDENCE.format(want='text1', got="text1 || ' extra'")}
       WHEN reason = 'segment_start@0' THEN {_EVIDENCE.format(want='s0', got='s0 + 500')} WHEN reason LIKE 'segment_end@%' THEN {_EVIDENCE.format(want='el', got='el3')}
       WHEN reason = 'event_end@0' THEN {_EVIDENCE.format(want='e0', got='ev3')}
       WHEN reason LIKE 'segment_words@%' THEN {_EVIDENCE.format(want='words[pos + 1]', got='seg_words[pos + 1]')} ELSE '' END AS evidence,
       m IN (0, 2) OR ny IS NULL OR (m = 3 AND ny = 1) AS blank FROM lt)""",
)
ORACLES = {"lyric_ground_truth": with_words(*LYRIC_SQL) + "SELECT piece_id, reason, evidence FROM lyr"}
