"""Word-stream segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import segments as op
from tessitura.params import SegmentParams
from tessitura.queries.common_sql import ISLANDS, PIECES, TOP, with_words
from tessitura.sources.tables import table, words


def ms(column: str, alias: str | None = None):
    """Seconds as whole milliseconds, half to even."""
    return F.rint(F.col(column) * 1000).cast("long").alias(alias or column.replace("_s", "_ms"))


def word_stream(spark: SparkSession, folder: str) -> DataFrame:
    return words(spark, folder).select(
        "stream_id", "token_id", ms("start_s"), ms("end_s"), "text", F.rint(F.col("confidence") * 100).cast("long").alias("confidence_pct")
    )


def gap_spans(spark: SparkSession, folder: str) -> DataFrame:
    return op.span_rows(op.gap_islands(words(spark, folder), 2.0)).select(
        "stream_id", "span_no", ms("start_s"), ms("end_s"), "n_words"
    )


def speech_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return op.speech_pieces(words(spark, folder)).select(
        "stream_id", "span_no", "piece_no", ms("start_s"), ms("end_s"), "n_words"
    )


def pieces_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """The same split with every long span taken through the blocked walk."""
    return op.speech_pieces(words(spark, folder), fold_rows=0).select(
        "stream_id", "span_no", "piece_no", ms("start_s"), ms("end_s"), "n_words"
    )


def pieces_absolute(spark: SparkSession, folder: str) -> DataFrame:
    return op.speech_pieces(words(spark, folder), SegmentParams(split_origin="absolute")).select(
        "stream_id", "span_no", "piece_no", ms("start_s"), ms("end_s"), "n_words"
    )


def spans_top(spark: SparkSession, folder: str) -> DataFrame:
    return op.top_moments(op.scored_pieces(op.speech_pieces(words(spark, folder)))).select(
        "stream_id", "rank", ms("start_s"), ms("end_s"), "n_words", F.round("score", 6).alias("score"), "source"
    )


def selection_counts(spark: SparkSession, folder: str) -> DataFrame:
    return op.selection_counts(op.speech_pieces(words(spark, folder)))


def effective_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Each order is a contract, each of its lines a platform with its own bounds."""
    rules = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("contract_id"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("min_s"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity") + F.col("l_linenumber") * 5).alias("max_s"),
    )
    return op.effective_bounds(rules)


def selection_check(spark: SparkSession, folder: str) -> DataFrame:
    stream = words(spark, folder)
    spans = op.span_rows(op.gap_islands(stream, 2.0)).select("stream_id", "span_no", "start_s", "end_s")
    lengths = stream.groupBy("stream_id").agg((F.max("end_s") - 1.0).alias("duration_s"))
    bounds = table(spark, folder, "documents").select(
        F.col("doc_id").alias("stream_id"),
        (F.col("doc_id") % 10).cast("double").alias("floor_s"),
        (F.lit(20) + F.col("doc_id") % 40).cast("double").alias("cap_s"),
    )
    declared = (
        table(spark, folder, "documents")
        .filter(F.col("doc_id") % 9 == 0)
        .select(
            F.col("doc_id").alias("stream_id"),
            F.lit(-1).cast("long").alias("span_no"),
            F.lit(1.0).alias("start_s"),
            F.lit(25.0).alias("end_s"),
        )
    )
    return op.selection_check(spans, bounds, lengths, declared).select(
        "stream_id", "span_no", ms("start_s"), ms("end_s"), F.coalesce("reason", F.lit("ok")).alias("reason")
    )


QUERIES = {
    "word_stream": word_stream,
    "gap_spans": gap_spans,
    "speech_pieces": speech_pieces,
    "speech_pieces_blocked": pieces_blocked,
    "speech_pieces_absolute": pieces_absolute,
    "spans_top": spans_top,
    "selection_counts": selection_counts,
    "effective_bounds": effective_bounds,
    "selection_check": selection_check,
}

_MS = "CAST(round_even(start_s * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS end_ms"

_PIECES_SQL = with_words(ISLANDS, PIECES) + f"SELECT stream_id, span_no, piece_no, {_MS}, n_words FROM pieces"

_ABSOLUTE = """
_ov AS (SELECT i.stream_id, i.span_no, i.seq, i.start_s, i.end_s, right(rtrim(i.text), 1) IN ('.', '?', '!', ',', ';', ':') AS closes,
               s.last_seq, s.first_seq, s.end_s AS last_end
        FROM islands i JOIN spans s USING (stream_id, span_no) WHERE s.end_s - s.start_s > 60.0),
_cut AS (SELECT a.stream_id, a.span_no, a.seq,
               coalesce(max(CASE WHEN b.end_s >= 60.0 * (1.0 - 0.2) AND b.closes THEN b.seq END),
                        arg_max(CASE WHEN b.seq < b.last_seq THEN b.seq END, b.end_s), a.seq) + 1 AS nxt
        FROM _ov a LEFT JOIN _ov b ON a.stream_id = b.stream_id AND a.span_no = b.span_no AND b.seq >= a.seq AND b.end_s <= 60.0
        WHERE a.last_end - a.start_s > 60.0 AND a.seq < a.last_seq GROUP BY a.stream_id, a.span_no, a.seq),
_heads AS (WITH RECURSIVE r AS (SELECT DISTINCT stream_id, span_no, first_seq AS seq FROM _ov
               UNION ALL SELECT r.stream_id, r.span_no, c.nxt FROM r JOIN _cut c USING (stream_id, span_no, seq)) SELECT * FROM r),"""

ORACLES = {
    "word_stream": with_words()
    + f"SELECT stream_id, token_id, {_MS}, text, CAST(round_even(confidence * 100, 0) AS BIGINT) AS confidence_pct FROM words",
    "gap_spans": with_words(ISLANDS) + f"SELECT stream_id, span_no, {_MS}, n_words FROM spans",
    "speech_pieces": _PIECES_SQL,
    "speech_pieces_blocked": _PIECES_SQL,
    "speech_pieces_absolute": with_words(ISLANDS, _ABSOLUTE.strip() + PIECES[PIECES.index("_pb AS") :])
    + f"SELECT stream_id, span_no, piece_no, {_MS}, n_words FROM pieces",
    "spans_top": with_words(ISLANDS, PIECES, TOP)
    + f"SELECT stream_id, rank, {_MS}, n_words, round(score, 6) AS score, 'speech_rate' AS source FROM top",
    "selection_counts": with_words(ISLANDS, PIECES)
    + """, k AS (SELECT *, (n_words >= 4 AND end_s - start_s >= 2.0)::INT AS ok FROM pieces)
    SELECT stream_id, count(*) FILTER (piece_no = 0) AS n_raw, count(*) AS n_pieces, count(*) FILTER (piece_no = 1) AS n_split_spans,
           sum(1 - ok)::BIGINT AS n_floor_dropped, sum(ok)::BIGINT AS n_qualifying, least(sum(ok), 12)::BIGINT AS n_kept,
           greatest(sum(ok) - 12, 0)::BIGINT AS cut_by_limit, (count(*) FILTER (piece_no = 0) - sum(ok))::BIGINT AS discarded_by_floor,
           count(*) - count(*) FILTER (piece_no = 0) AS split FROM k GROUP BY stream_id""",
    "effective_bounds": """WITH r AS (SELECT l_orderkey AS contract_id, CASE WHEN l_quantity > 5 THEN l_quantity END AS min_s,
           CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity + l_linenumber * 5 END AS max_s FROM lineitem),
    g AS (SELECT contract_id, max(min_s) AS lo, min(max_s) AS hi FROM r GROUP BY contract_id)
    SELECT contract_id, greatest(2.0::DOUBLE, coalesce(lo, 0.0)) AS floor_s,
           CASE WHEN coalesce(hi, 0) > 0 THEN least(hi, 60.0) ELSE 60.0::DOUBLE END AS cap_s, coalesce(lo > hi, false) AS bad_bounds FROM g""",
    "selection_check": with_words(ISLANDS)
    + f""", c AS (SELECT stream_id, span_no, start_s, end_s FROM spans WHERE stream_id % 9 <> 0
           UNION ALL SELECT doc_id, -1, 1.0, 25.0 FROM documents WHERE doc_id % 9 = 0),
    l AS (SELECT stream_id, max(end_s) - 1.0 AS duration_s FROM words GROUP BY stream_id)
    SELECT c.stream_id, span_no, {_MS},
           CASE WHEN end_s <= start_s THEN 'empty' WHEN duration_s > 0 AND end_s > duration_s THEN 'past_end'
                WHEN end_s - start_s < c.stream_id % 10 THEN 'too_short' WHEN end_s - start_s > 20 + c.stream_id % 40 THEN 'too_long'
                ELSE 'ok' END AS reason
    FROM c LEFT JOIN l USING (stream_id)""",
}
