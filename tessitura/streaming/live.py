"""The two operators that are naturally live: chat density and gap segmentation."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessitura.params import MAX_GAP_S
from tessitura.plans.scan import shared_folder

SPAN_SCHEMA = "stream_id string, kind string, start_s double, end_s double, n_words long, token_id long"
SPAN_STATE = "opened string"
BUCKETS = 2048


def chat_density(messages: DataFrame, window_s: float, lateness: str) -> DataFrame:
    """Messages per second per window and stream, emitted once a window can no longer change.

    Counts are partial before the shuffle, so a busy stream does not flood one task. Zero windows and
    normalisation need the whole stream and stay in the batch form.
    """
    width = f"{window_s:g} seconds"
    return (
        messages.withWatermark("ts", lateness)
        .groupBy("stream_id", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("stream_id", F.col("w.start").alias("window_start"), (F.col("n") / F.lit(window_s)).alias("level"))
    )


def place_words(rows: pd.DataFrame, opened: dict, passed: int, max_gap_s: float) -> list[tuple]:
    """Closed spans and late words of one batch; ``opened`` (stream: start, last start, last end, words, clock's zero) is moved on."""
    rows = rows.sort_values(["start_s", "end_s", "token_id"], kind="stable")
    codes, streams = pd.factorize(rows["stream_id"], use_na_sentinel=False)
    order = np.argsort(codes, kind="stable")
    code, rows = codes[order], rows.iloc[order]
    start, end, at_ms, token = (rows[c].to_numpy() for c in ("start_s", "end_s", "at_ms", "token_id"))
    names = [None if pd.isna(s) else s for s in streams]
    nothing = (np.nan, np.nan, np.nan)
    last_start, last_end = (np.array([opened.get(s, nothing)[i] for s in names], dtype=float) for i in (1, 2))
    known = np.array([s in opened for s in names], dtype=bool)
    late = (at_ms < passed) | (start < last_start[code])
    out = [(names[c], "late", a, b, 1, int(t)) for c, a, b, t in zip(code[late].tolist(), start[late].tolist(), end[late].tolist(), token[late].tolist(), strict=True)]
    code, start, end, at_ms = (x[~late] for x in (code, start, end, at_ms))
    if not len(code):
        return out
    first = np.append(True, code[1:] != code[:-1])
    silence = start - np.where(first, last_end[code], np.append(np.nan, end[:-1]))
    opens = (silence > max_gap_s) | (first & ~known[code])
    heads = np.flatnonzero(opens | first)
    tails = np.append(heads[1:], len(code)) - 1
    zero = at_ms[heads].astype("int64") - np.rint(start[heads] * 1000).astype("int64")
    found = zip(code[heads].tolist(), opens[heads].tolist(), start[heads].tolist(), start[tails].tolist(), end[tails].tolist(), (tails - heads + 1).tolist(), zero.tolist(), strict=True)
    for c, fresh, begin, newest, upto, n, zero_ms in found:
        old = opened.get(names[c])
        if fresh and old is not None:
            out.append((names[c], "span", old[0], old[2], old[3], None))
        opened[names[c]] = [begin, newest, upto, n, zero_ms] if fresh else [old[0], newest, upto, old[3] + n, old[4]]
    return out


def live_spans(words: DataFrame, lateness_s: float = 5.0, max_gap_s: float = MAX_GAP_S, buckets: int = BUCKETS) -> DataFrame:
    """Silence islands of live word streams, plus the words that came too late to place.

    ``words``: ``stream_id, token_id, start_s, end_s, ts`` with ``ts`` the word's start as event time.
    Each stream has one open span. It closes when a word starts more than the gap after the last
    end, or when the watermark passes that end by the gap and the lateness. A word that starts before
    the last one already placed, or behind the watermark, is reported as ``late``: every word is counted in one span or
    told as late, none is lost.

    A call per stream and batch costs milliseconds however few its words, so streams are dealt over ``buckets`` and one state
    holds the open spans of a bucket's streams; its timer is the earliest of theirs. The number holds for a query's whole life.

    The engine drops rows behind the watermark before an operator sees them. So each word comes twice: a tick whose
    event time moves the watermark, and the word itself without one, which is never dropped. Ticks go no further than that.
    """

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        opened = {stream: span for stream, *span in json.loads(state.get[0])} if state.exists else {}
        out = [] if state.hasTimedOut else place_words(pd.concat([b[b["token_id"].notna()] for b in batches]), opened, passed, max_gap_s)
        due = {stream: int((span[2] + max_gap_s + lateness_s) * 1000) + span[4] for stream, span in opened.items()}
        for stream in [s for s, at in due.items() if at < passed]:
            start, _, end, n, _ = opened.pop(stream)
            out.append((stream, "span", start, end, n, None))
        if opened:
            state.update((json.dumps([[stream, *span] for stream, span in opened.items()]),))
            state.setTimeoutTimestamp(max(min(due[stream] for stream in opened), passed + 1))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["stream_id", "kind", "start_s", "end_s", "n_words", "token_id"])
        yield frame.astype({"n_words": "Int64", "token_id": "Int64"})

    own = [F.col(c).alias(c) for c in ("token_id", "start_s", "end_s")]
    word = F.struct(*own, F.unix_millis("ts").alias("at_ms"), F.lit(None).cast("timestamp").alias("clock"))
    tick = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("token_id", "long"), ("start_s", "double"), ("end_s", "double"), ("at_ms", "long"))], F.col("ts").alias("clock"))
    typed = words.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("token_id").cast("long").alias("token_id"), "start_s", "end_s", "ts")
    return (
        typed.select("stream_id", F.explode(F.array(word, tick)).alias("r"))
        .select("stream_id", "r.*", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).alias("bucket"))
        .withWatermark("clock", f"{lateness_s:g} seconds")
        .filter(F.col("clock").isNull())
        .groupBy("bucket")
        .applyInPandasWithState(step, SPAN_SCHEMA, SPAN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def run_to_table(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote, by way of the shared folder; removed when the driver ends."""
    place = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{place}/rows")
        .option("checkpointLocation", f"{place}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
