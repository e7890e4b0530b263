"""SQL building blocks shared by the oracles."""

from __future__ import annotations

WORDS = r"""
_t AS (SELECT doc_id AS stream_id, lang AS language,
              [x FOR x IN regexp_split_to_array(text, '\s+') IF x <> ''] AS ws FROM documents),
_w AS (SELECT stream_id, language, i - 1 AS token_id, ws[i] AS text FROM _t, unnest(range(1, len(ws) + 1)) AS u(i)),
_d AS (SELECT *, 60 + 40 * least(length(text), 12) AS dur_ms,
              CASE WHEN right(text, 1) IN ('.', '?', '!') THEN 700 WHEN right(text, 1) IN (',', ';', ':') THEN 250 ELSE 30 END
              + CASE WHEN (stream_id * 7 + token_id * 13) % 97 = 0 THEN 2600 ELSE 0 END AS pause_ms FROM _w),
_s AS (SELECT *, coalesce(sum(dur_ms + pause_ms) OVER (PARTITION BY stream_id ORDER BY token_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM _d),
words AS MATERIALIZED (SELECT stream_id, token_id, start_ms / 1000.0::DOUBLE AS start_s, (start_ms + dur_ms) / 1000.0::DOUBLE AS end_s, text,
              ((stream_id * 31 + token_id * 17) % 100) / 100.0::DOUBLE AS confidence, language FROM _s)"""

ISLANDS = """
_g AS (SELECT *, row_number() OVER w - 1 AS seq,
              CASE WHEN start_s - lag(end_s) OVER w > 2.0 THEN 1 ELSE 0 END AS brk
       FROM words WINDOW w AS (PARTITION BY stream_id ORDER BY start_s, end_s, token_id)),
islands AS MATERIALIZED (SELECT *, sum(brk) OVER (PARTITION BY stream_id ORDER BY seq)::BIGINT AS span_no FROM _g),
spans AS MATERIALIZED (SELECT stream_id, span_no, min(start_s) AS start_s, arg_max(end_s, seq) AS end_s, count(*) AS n_words,
              min(seq) AS first_seq, max(seq) AS last_seq FROM islands GROUP BY stream_id, span_no)"""

PIECES = """
_ov AS MATERIALIZED (SELECT i.stream_id, i.span_no, i.seq, i.start_s, i.end_s,
              right(rtrim(i.text), 1) IN ('.', '?', '!', ',', ';', ':') AS closes, s.last_seq, s.first_seq, s.end_s AS last_end
       FROM islands i JOIN spans s USING (stream_id, span_no) WHERE s.end_s - s.start_s > 60.0),
_cut AS (SELECT a.stream_id, a.span_no, a.seq,
              coalesce(max(CASE WHEN b.end_s - a.start_s >= 60.0 * (1.0 - 0.2) AND b.closes THEN b.seq END),
                       arg_max(CASE WHEN b.seq < b.last_seq THEN b.seq END, b.end_s), a.seq) + 1 AS nxt
       FROM _ov a JOIN _ov b ON a.stream_id = b.stream_id AND a.span_no = b.span_no AND b.seq >= a.seq AND b.end_s - a.start_s <= 60.0
       WHERE a.last_end - a.start_s > 60.0 GROUP BY a.stream_id, a.span_no, a.seq),
_heads AS (WITH RECURSIVE r AS (SELECT DISTINCT stream_id, span_no, first_seq AS seq FROM _ov
              UNION ALL SELECT r.stream_id, r.span_no, c.nxt FROM r JOIN _cut c USING (stream_id, span_no, seq)) SELECT * FROM r),
_pb AS (SELECT h.stream_id, h.span_no, row_number() OVER w - 1 AS piece_no, h.seq AS first_seq,
              coalesce(lead(h.seq) OVER w - 1, s.last_seq) AS last_seq
       FROM _heads h JOIN spans s USING (stream_id, span_no) WINDOW w AS (PARTITION BY h.stream_id, h.span_no ORDER BY h.seq)),
pieces AS MATERIALIZED (
       SELECT stream_id, span_no, 0 AS piece_no, start_s, end_s, n_words, first_seq, last_seq FROM spans WHERE end_s - start_s <= 60.0
       UNION ALL
       SELECT p.stream_id, p.span_no, p.piece_no, a.start_s, b.end_s, p.last_seq - p.first_seq + 1, p.first_seq, p.last_seq
       FROM _pb p JOIN islands a ON a.stream_id = p.stream_id AND a.seq = p.first_seq
                  JOIN islands b ON b.stream_id = p.stream_id AND b.seq = p.last_seq)"""

TOP = """
_alive AS (SELECT *, n_words / (end_s - start_s) AS density FROM pieces WHERE n_words >= 4 AND end_s - start_s >= 2.0),
_sc AS (SELECT *, CASE WHEN max(density) OVER (PARTITION BY stream_id) > 0
              THEN density / max(density) OVER (PARTITION BY stream_id) ELSE 0 END AS score FROM _alive),
_rk AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY CASE WHEN end_s - start_s >= 8.0 THEN 0 ELSE 1 END,
              score DESC, start_s, end_s, first_seq) AS rank FROM _sc),
top AS MATERIALIZED (SELECT * FROM _rk WHERE rank <= 12)"""


def with_words(*parts: str) -> str:
    """A WITH clause that starts from the word fixture."""
    return "WITH " + ",".join((WORDS, *parts)) + "\n"
