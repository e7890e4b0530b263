"""Signal windows and fusion: binned energy and chat, hot runs, scene intervals, fused moments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.params import SignalParams
from tessitura.plans.scan import dense_bins, prefix_scan, row_block, summary, time_block


def linear_level(raw: Column) -> Column:
    """Decibel text to linear amplitude; minus infinity and non-finite values are silence."""
    value = F.when(F.lower(raw).isin("inf", "-inf", "nan", "infinity", "-infinity"), F.lit(None)).otherwise(raw.try_cast("double"))
    return F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(F.pow(F.lit(10.0), value / 20.0))


def energy_bins(frames: DataFrame, params: SignalParams) -> DataFrame:
    """Mean value per window, zero for empty windows up to the last frame. ``frames``: ``stream_id, time_s, value``."""
    counted = (
        frames.select("stream_id", F.floor(F.col("time_s") / params.window_s).cast("long").alias("bin"), "value")
        .groupBy("stream_id", "bin")
        .agg(F.avg("value").alias("level"))
    )
    return _filled(counted, "level")


def chat_bins(messages: DataFrame, params: SignalParams) -> DataFrame:
    """Messages per second per window, zero filled to the last message."""
    counted = (
        messages.select("stream_id", F.floor(F.col("timestamp_s") / params.window_s).cast("long").alias("bin"))
        .groupBy("stream_id", "bin")
        .agg((F.count(F.lit(1)) / params.window_s).alias("level"))
    )
    return _filled(counted, "level")


def _filled(counted: DataFrame, value: str) -> DataFrame:
    tops = counted.groupBy("stream_id").agg(F.max("bin").alias("_top"))
    return dense_bins(tops, ["stream_id"], "_top", "bin").join(counted, ["stream_id", "bin"], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0))
    )


def normalised(values: DataFrame, value: str, name: str = "score") -> DataFrame:
    """Share of the stream's maximum, in [0, 1]; all zero when the maximum is not positive."""
    tops = values.groupBy("stream_id").agg(F.max(value).alias("_max"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.col("_max")))
    return values.join(tops, "stream_id").withColumn(name, F.when(F.col("_max") > 0, share).otherwise(F.lit(0.0))).drop("_max")


def hot_runs(bins: DataFrame, durations: DataFrame, min_score: float, source: str, params: SignalParams) -> DataFrame:
    """Runs of consecutive windows that reach the score, as moments. Scores are positive, so empty windows need no rows."""
    scored = summary(normalised(bins, "level").filter((F.col("score") > 0) & (F.col("score") >= min_score)))
    order, block = ["bin"], row_block(F.col("bin"))
    linked = prefix_scan(scored, ["stream_id"], order, block, lasts={"_prev": F.col("bin")})
    opened = F.coalesce(F.col("bin") - F.col("_prev") > 1, F.lit(True)).cast("long")
    flagged = summary(linked.withColumn("_open", opened))
    islands = prefix_scan(flagged, ["stream_id"], order, block, sums={"_before": F.col("_open")})
    runs = islands.groupBy("stream_id", (F.col("_before") + F.col("_open")).alias("_run")).agg(
        F.min("bin").alias("_a"), F.max("bin").alias("_b"), F.max("score").alias("score")
    )
    end = (F.col("_b") + 1) * params.window_s
    return (
        runs.join(durations, "stream_id", "left")
        .select(
            "stream_id",
            (F.col("_a") * params.window_s).alias("start_s"),
            F.when(F.col("duration_s") > 0, F.least(end, F.col("duration_s"))).otherwise(end).alias("end_s"),
            "score",
            F.lit(source).alias("source"),
        )
        .filter(F.col("end_s") > F.col("start_s"))
    )


def scene_intervals(events: DataFrame, durations: DataFrame) -> DataFrame:
    """Intervals between cuts, scored by their left cut; the unscored opening interval drops out.

    Scores are normalised before cuts outside the recording are dropped. ``events``: ``stream_id, time_s, value``.
    """
    cuts = summary(
        normalised(events, "value")
        .join(durations.filter(F.col("duration_s") > 0), "stream_id")
        .filter((F.col("time_s") > 0) & (F.col("time_s") < F.col("duration_s")))
        .groupBy("stream_id", "time_s")
        .agg(F.max("score").alias("score"), F.max("duration_s").alias("duration_s"))
    )
    linked = prefix_scan(
        cuts, ["stream_id"], ["time_s"], time_block(F.col("time_s")), lasts={"_next": F.col("time_s")}, reverse=True
    )
    return linked.select(
        "stream_id", F.col("time_s").alias("start_s"), F.coalesce("_next", "duration_s").alias("end_s"), "score", F.lit("scene").alias("source")
    ).filter((F.col("end_s") > F.col("start_s")) & (F.col("score") > 0))


def signal_durations(frames: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Transcript duration where positive, else the last frame's time."""
    last = frames.groupBy("stream_id").agg(F.max("time_s").alias("_last"))
    if transcripts is None:
        return last.select("stream_id", F.col("_last").alias("duration_s"))
    known = transcripts.select("stream_id", F.when(F.col("duration_s") > 0, F.col("duration_s")).alias("_known"))
    return last.join(known, "stream_id", "full_outer").select("stream_id", F.coalesce("_known", "_last", F.lit(0.0)).alias("duration_s"))


def union_signals(*signals: DataFrame) -> DataFrame:
    """Bag union of moment frames."""
    return reduce(DataFrame.unionByName, signals)


def overlap_groups(moments: DataFrame) -> DataFrame:
    """Adds ``group_no``: a moment joins while it starts strictly before the furthest end so far."""
    order, block = ["start_s", "end_s", "source", "score"], time_block(F.col("start_s"))
    linked = prefix_scan(summary(moments), ["stream_id"], order, block, maxs={"_reach": F.col("end_s")})
    flagged = summary(linked.withColumn("_open", (~F.coalesce(F.col("start_s") < F.col("_reach"), F.lit(False))).cast("long")))
    counted = prefix_scan(flagged, ["stream_id"], order, block, sums={"_before": F.col("_open")})
    return counted.withColumn("group_no", F.col("_before") + F.col("_open") - 1).drop("_reach", "_open", "_before")


def checked_sources(moments: DataFrame, params: SignalParams) -> tuple[DataFrame, DataFrame]:
    """(known, unknown): a source without a weight would silently fuse to zero, so it is set aside."""
    known = F.col("source").isin(*params.weights, "fused")
    return moments.filter(known), moments.filter(~known)


def fused_moments(moments: DataFrame, params: SignalParams) -> DataFrame:
    """One moment per overlap group: best score per source, weighted; earlier fusions carry no score."""
    weight = F.create_map(*[F.lit(x) for pair in sorted(params.weights.items()) for x in pair])
    best = (
        overlap_groups(moments)
        .groupBy("stream_id", "group_no", "source")
        .agg(F.max("score").alias("score"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
        .withColumn("_w", F.when(F.col("source") != "fused", weight[F.col("source")]))
    )
    total = F.sum("_w")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum(F.col("_w") * F.col("score")) / total))
    return best.groupBy("stream_id", "group_no").agg(
        F.min("start_s").alias("start_s"),
        F.max("end_s").alias("end_s"),
        F.when(total > 0, score).otherwise(F.lit(0.0)).alias("score"),
    ).select("stream_id", "start_s", "end_s", "score", F.lit("fused").alias("source"))


def by_interest(moments: DataFrame) -> DataFrame:
    """Presentation order: score down, then time."""
    return moments.orderBy("stream_id", F.desc("score"), "start_s", "end_s")
