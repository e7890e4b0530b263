"""Energy, chat and scene signals and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import signals as op
from tessitura.params import SignalParams
from tessitura.queries.segments import ms
from tessitura.sources import logs
from tessitura.sources.tables import chat, event_clock

# The event fixture is spread over days, so its windows are minutes wide.
WIDE = SignalParams(window_s=300.0)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    return event_clock(spark, folder).filter(F.col("event_type") != "error").select(
        "stream_id", (F.col("timestamp_ms") / F.lit(1000.0)).alias("time_s"), "value"
    )


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    return event_clock(spark, folder).filter(F.col("event_type") == "error").select(
        "stream_id", (F.col("timestamp_ms") / F.lit(1000.0)).alias("time_s"), "value"
    )


def energy_bins(spark: SparkSession, folder: str) -> DataFrame:
    return op.energy_bins(frames(spark, folder), WIDE).select("stream_id", "bin", F.round("level", 6).alias("level"))


def chat_bins(spark: SparkSession, folder: str) -> DataFrame:
    return op.normalised(op.chat_bins(chat(spark, folder), WIDE), "level").select(
        "stream_id", "bin", F.round("level", 6).alias("level"), F.round("score", 6).alias("score")
    )


def signals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    levels = frames(spark, folder)
    durations = op.signal_durations(levels)
    energy = op.hot_runs(op.energy_bins(levels, WIDE), durations, WIDE.energy_min_score, "audio_energy", WIDE)
    talk = op.hot_runs(op.chat_bins(chat(spark, folder), WIDE), durations, WIDE.chat_min_score, "chat_density", WIDE)
    return op.scene_intervals(cuts(spark, folder), durations), energy, talk


def _moment(frame: DataFrame) -> DataFrame:
    return frame.select("stream_id", ms("start_s"), ms("end_s"), F.round("score", 6).alias("score"), "source")


def hot_runs(spark: SparkSession, folder: str) -> DataFrame:
    _, energy, talk = signals(spark, folder)
    return _moment(op.union_signals(energy, talk))


def scene_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return _moment(signals(spark, folder)[0])


def fused_moments(spark: SparkSession, folder: str) -> DataFrame:
    scenes, energy, talk = signals(spark, folder)
    known, _ = op.checked_sources(op.union_signals(scenes, energy, talk), WIDE)
    return _moment(op.by_interest(op.fused_moments(known, WIDE)))


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """A log per event stream: a time line, then a level line; some lines dangle, some levels are silence."""
    events = event_clock(spark, folder)
    n = F.col("event_id")
    rows = events.select(
        F.col("stream_id").alias("file_id"),
        n,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(n % 5 != 0, F.struct(F.lit(0).alias("k"), F.concat(F.lit("frame:1 pts_time:"), (F.col("timestamp_ms") / 1000.0).cast("decimal(18,3)").cast("string")).alias("line"))),
                    F.struct(F.lit(1).alias("k"), F.lit("noise").alias("line")),
                    F.when(n % 7 != 0, F.struct(F.lit(2).alias("k"), F.concat(F.lit("lavfi.astats.Overall.RMS_level="), F.when(n % 11 == 0, F.lit("-inf")).otherwise((-n % 60).cast("string"))).alias("line"))),
                )
            )
        ).alias("r"),
    )
    return rows.select("file_id", (n * 3 + F.col("r.k")).alias("line_no"), "r.line")


def log_levels(spark: SparkSession, folder: str) -> DataFrame:
    return logs.loudness(metric_log(spark, folder)).select("file_id", ms("time_s"), F.round("value", 6).alias("value"))


def chat_scan(spark: SparkSession, folder: str) -> DataFrame:
    messages = chat(spark, folder).select(
        "stream_id",
        F.when(F.col("event_id") % 17 == 0, F.lit(-1.0)).otherwise(F.col("timestamp_s")).alias("timestamp_s"),
        F.when(F.col("event_id") % 19 == 0, F.lit("")).otherwise(F.col("text")).alias("text"),
    )
    good, bad = logs.valid_chat(messages)
    return good.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("accepted")).unionByName(
        bad.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.lit(False).alias("accepted"))
    )


QUERIES = {
    "energy_bins": energy_bins,
    "chat_bins": chat_bins,
    "hot_runs": hot_runs,
    "scene_intervals": scene_intervals,
    "fused_moments": fused_moments,
    "log_levels": log_levels,
    "chat_scan": chat_scan,
}

_EV = """
_t0 AS (SELECT min(epoch_us(ts)) AS z FROM events),
ev AS MATERIALIZED (SELECT user_id % 4 AS stream_id, event_id, (epoch_us(ts) - z) // 1000 AS t_ms, event_type, value FROM events, _t0),
fr AS (SELECT stream_id, t_ms / 1000.0::DOUBLE AS time_s, value FROM ev WHERE event_type <> 'error'),
du AS (SELECT stream_id, max(time_s) AS d FROM fr GROUP BY 1)"""
_BINS = """
_eb AS (SELECT stream_id, floor(time_s / 300)::BIGINT AS bin, avg(value) AS level FROM fr GROUP BY 1, 2),
_cb AS (SELECT stream_id, floor(t_ms / 1000.0::DOUBLE / 300)::BIGINT AS bin, count(*) / 300.0::DOUBLE AS level FROM ev GROUP BY 1, 2),
eb AS (SELECT g.stream_id, g.bin, coalesce(level, 0) AS level FROM (SELECT stream_id, unnest(range(0, max(bin) + 1)) AS bin FROM _eb GROUP BY 1) g LEFT JOIN _eb USING (stream_id, bin)),
cb AS (SELECT g.stream_id, g.bin, coalesce(level, 0) AS level FROM (SELECT stream_id, unnest(range(0, max(bin) + 1)) AS bin FROM _cb GROUP BY 1) g LEFT JOIN _cb USING (stream_id, bin))"""
_RUNS = """
_al AS (SELECT *, 'audio_energy' AS source FROM eb UNION ALL SELECT *, 'chat_density' FROM cb),
_no AS (SELECT *, greatest(0, least(1, level / max(level) OVER (PARTITION BY source, stream_id))) AS score FROM _al),
_ho AS (SELECT *, bin - row_number() OVER (PARTITION BY source, stream_id ORDER BY bin) AS run FROM _no WHERE score > 0 AND score >= 0.5),
_rr AS (SELECT stream_id, source, run, min(bin) * 300.0::DOUBLE AS start_s, least((max(bin) + 1) * 300.0, max(d)) AS end_s, max(score) AS score
        FROM _ho LEFT JOIN du USING (stream_id) GROUP BY 1, 2, 3),
runs AS (SELECT stream_id, start_s, end_s, score, source FROM _rr WHERE end_s > start_s)"""
_SCENES = """
_sc AS (SELECT stream_id, t_ms / 1000.0::DOUBLE AS time_s, greatest(0, least(1, value / max(value) OVER (PARTITION BY stream_id))) AS score FROM ev WHERE event_type = 'error'),
_su AS (SELECT stream_id, time_s, max(score) AS score, max(d) AS d FROM _sc JOIN du USING (stream_id) WHERE time_s > 0 AND time_s < d GROUP BY 1, 2),
_sl AS (SELECT stream_id, time_s AS start_s, coalesce(lead(time_s) OVER (PARTITION BY stream_id ORDER BY time_s), d) AS end_s, score FROM _su),
scenes AS (SELECT stream_id, start_s, end_s, score, 'scene' AS source FROM _sl WHERE end_s > start_s AND score > 0)"""
_OUT = "CAST(round_even(start_s * 1000, 0) AS BIGINT) AS start_ms, CAST(round_even(end_s * 1000, 0) AS BIGINT) AS end_ms, round(score, 6) AS score, source"

ORACLES = {
    "energy_bins": f"WITH {_EV}, {_BINS} SELECT stream_id, bin, round(level, 6) AS level FROM eb",
    "chat_bins": f"WITH {_EV}, {_BINS} SELECT stream_id, bin, round(level, 6) AS level, round(level / max(level) OVER (PARTITION BY stream_id), 6) AS score FROM cb",
    "hot_runs": f"WITH {_EV}, {_BINS}, {_RUNS} SELECT stream_id, {_OUT} FROM runs",
    "scene_intervals": f"WITH {_EV}, {_SCENES} SELECT stream_id, {_OUT} FROM scenes",
    "fused_moments": f"""WITH {_EV}, {_BINS}, {_RUNS}, {_SCENES},
        m AS (SELECT * FROM scenes UNION ALL SELECT * FROM runs),
        r AS (SELECT *, max(end_s) OVER (PARTITION BY stream_id ORDER BY start_s, end_s, source, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m),
        g AS (SELECT *, sum(CASE WHEN start_s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY start_s, end_s, source, score) AS grp FROM r),
        b AS (SELECT stream_id, grp, source, max(score) AS s, min(start_s) AS a, max(end_s) AS e,
              CASE source WHEN 'scene' THEN 0.3 WHEN 'audio_energy' THEN 0.4 ELSE 0.3 END::DOUBLE AS w FROM g GROUP BY 1, 2, 3),
        f AS (SELECT stream_id, min(a) AS start_s, max(e) AS end_s, least(1, greatest(0, sum(w * s) / sum(w))) AS score, 'fused' AS source FROM b GROUP BY stream_id, grp)
        SELECT stream_id, {_OUT} FROM f""",
    "log_levels": f"""WITH {_EV},
        l AS (SELECT stream_id, event_id * 3 AS no, t_ms AS moment, NULL::BIGINT AS lev FROM ev WHERE event_id % 5 <> 0
              UNION ALL SELECT stream_id, event_id * 3 + 2, NULL, CASE WHEN event_id % 11 = 0 THEN -999 ELSE -event_id % 60 END FROM ev WHERE event_id % 7 <> 0),
        p AS (SELECT *, lag(moment) OVER (PARTITION BY stream_id ORDER BY no) AS prev FROM l)
        SELECT stream_id AS file_id, prev AS time_ms, round(CASE WHEN lev = -999 THEN 0 ELSE pow(10.0::DOUBLE, lev / 20.0::DOUBLE) END, 6) AS value
        FROM p WHERE lev IS NOT NULL AND prev IS NOT NULL""",
    "chat_scan": f"""WITH {_EV} SELECT stream_id, count(*) AS n, event_id % 17 <> 0 AND event_id % 19 <> 0 AS accepted FROM ev GROUP BY 1, 3""",
}
