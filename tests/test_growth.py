"""Steps whose work must grow no faster than their rows."""

import random
import re
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from tessitura.operators import audit, segments, spans
from tessitura.sources import timed_text
from tessitura.sources.words import words_from_documents
from tessitura.streaming import live
from tests.test_folds import WORDS, make_words
from tests.test_streaming import EPOCH


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_span_costs_the_same_however_long_it_is(spark):
    words = spark.createDataFrame([(1, k, k * 50.0, k * 50.0 + 1, "w", 0.5) for k in range(40)], WORDS)
    # Two variants of the stream, then more than meet by key alone.
    for n in (2, 20):
        variants = spark.createDataFrame([(v, 1, 100_000 * v, 10**15) for v in range(n)], "variant_id long, stream_id long, start_ms long, end_ms long")
        got = spans.words_in_range_ms(words, variants).select("variant_id", "token_id", "start_ms").collect()
        assert sorted(tuple(r) for r in got) == [(v, k, k * 50_000 - 100_000 * v) for v in range(n) for k in range(2 * v, 40)]


def test_corrections_of_a_stream_hold_for_each_of_its_variants(spark):
    spoken = [(s, s * 10 + v, k, k * 100, k * 100 + 90, f"w{k}", 0.5) for s in (1, 2) for v in (0, 1) for k in range(30)]
    clipped = spark.createDataFrame(spoken, "stream_id long, variant_id long, token_id long, start_ms long, end_ms long, text string, confidence double")
    variants = spark.createDataFrame([(s, s * 10 + v, 500 * v, 500 * v + 3000) for s in (1, 2) for v in (0, 1)], "stream_id long, variant_id long, start_ms long, end_ms long")
    fixes = spark.createDataFrame([(1, 650, 720, "new"), (2, 100, 150, "old")], "stream_id long, start_ms long, end_ms long, text string")
    names = ["variant_id", "place", "start_ms", "end_ms", "text"]
    got = spans.corrected_words(clipped, fixes, variants).select(*names).collect()
    each = fixes.join(variants.select("stream_id", "variant_id"), "stream_id").drop("stream_id")
    want = spans.corrected_words(clipped.drop("stream_id"), each, variants.drop("stream_id")).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r.variant_id for r in got if r.text == "new"} == {10, 11} and {r.variant_id for r in got if r.text == "old"} == {20}


def test_phrases_look_only_at_words_of_phrases(spark):
    rng = random.Random(4)
    rows = [(s, k, float(k), k + 0.5, rng.choice(["a", "b", "c", "x", "Y.", "z"]), 0.5) for s in range(2) for k in range(9000)]
    phrases = ("a b c a b", "a a", "b", "c b")
    got = audit.phrase_positions(spark.createDataFrame(rows, WORDS), phrases)
    want = set()
    for s in range(2):
        texts = [r[4] for r in rows if r[0] == s]
        want |= {(s, k, p) for p in phrases for k in range(len(texts)) if texts[k : k + len(p.split())] == p.split()}
    assert {(r.stream_id, r.token_id, r.phrase) for r in got.collect()} == want
    assert " IN (a,b,c)" in plan_of(got).split("Window", 1)[1]


def test_streams_that_share_a_state_keep_their_own_spans(spark, tmp_path):
    rows = make_words(9, streams=30, n=60)
    schema = "stream_id string, token_id long, start_s double, end_s double, ts timestamp"
    timed = sorted([(str(r[0]), r[1], r[2], r[3], EPOCH + timedelta(seconds=r[2])) for r in rows], key=lambda r: r[4])
    far = [("end", 0, 9e5, 9e5 + 1, EPOCH + timedelta(seconds=9e5))]
    for n, part in enumerate((timed[:700], timed[700:1200], timed[1200:], far)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = live.run_to_table(live.live_spans(stream, buckets=3), spark).filter("stream_id <> 'end'").collect()
    want = segments.span_rows(segments.gap_islands(spark.createDataFrame(rows, WORDS), 2.0)).collect()
    assert {r.kind for r in got} == {"span"}
    assert {(r.stream_id, r.start_s, r.end_s, r.n_words) for r in got} == {(str(r.stream_id), r.start_s, r.end_s, r.n_words) for r in want}


def test_sweeps_leave_closes_with_their_stream(spark):
    documents = spark.createDataFrame([(d, "en", "One two. Three, four! Five six seven? " * 9) for d in range(6)], "doc_id long, lang string, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stream = words_from_documents(documents)
        bounds = stream.groupBy("stream_id").agg(F.lit(0.0).alias("from_s"), F.max("end_s").alias("to_s"))
        found = audit.cut_spans(audit.in_file_order(stream, [0.6, 1.0]), bounds, [(0.6, "island_0"), (1.0, "island_1")], (10.0, None))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "island" in line.split("ENSURE")[0]]


def test_silences_and_closes_pass_over_the_words_once_more(spark):
    """After the summary of their blocks, words are laid out once: extents and sizes come from that summary."""
    text = "One two. Three, four! Five six seven? " * 9
    stream = words_from_documents(spark.createDataFrame([(d, "en", text * (d + 1)) for d in range(3)] + [(7, "en", "no close"), (8, "en", "")], "doc_id long, lang string, text string"))
    bounds = stream.groupBy("stream_id").agg(F.lit(0.0).alias("from_s"), F.max("end_s").alias("to_s"))
    linked, extent = audit.with_extent(stream, [0.6])
    assert sorted(map(tuple, extent.select(*bounds.columns).collect())) == sorted(map(tuple, bounds.collect()))
    assert {r.stream_id: r.n_closes for r in extent.collect()} == {0: 27, 1: 54, 2: 81, 7: 0}
    spans = audit.silence_spans(linked, extent)
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, audit.silence_spans(linked, bounds).collect()))
    assert "Generate" not in plan_of(audit.span_summary(spans, ["stream_id"]))
    island = linked.withColumn("island_0", F.lit(0).cast("long"))
    rows = lambda f: sorted(((r.stream_id, r.window_no, r.window_s, r.start_s, r.end_s) for r in f.collect()), key=str)
    cut = lambda ends, limit: audit.cut_spans(island, ends, [(float("inf"), "island_0")], (10.0, None), null_cuts_every_close=True, fold_rows=limit)
    want = rows(cut(bounds, 4096))
    assert {r[2] for r in want} == {10.0, None} and len([r for r in want if r[1] == 1]) == 27 + 54 + 81 + 1
    assert plan_of(cut(extent, 4096)).count("Generate posexplode") == 1
    # All islands by their array, some by the walk, all with a close by the walk; then without sizes.
    for ends, limit in ((extent, 4096), (extent, 60), (extent, 0), (bounds, 60)):
        assert rows(cut(ends, limit)) == want, limit


def test_lyrics_and_captions_read_their_files_once(spark):
    rows = [("a", "[00:01.00]x\n[00:75.10]y"), ("b", "no tags"), ("c", None), ("d", "[00:02.00][00:01.00]z"), ("e", "")]
    files = spark.createDataFrame(rows, "file_id string, content string").withColumn("content", F.concat("content", F.lit("")))
    lines, rejects = timed_text.parse_synced_lyrics(files)
    assert [(r.file_id, r.line_no, r.start_s, r.text) for r in lines.orderBy("line_no").collect()] == [("d", 0, 1.0, "z"), ("d", 1, 2.0, "z")]
    assert {r.file_id: r.reason for r in rejects.collect()} == {"a": "bad_time_tag:00:75.10", **dict.fromkeys("bce", "no_timed_lines")}
    spoken = "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,"
    scripts = spark.createDataFrame([("a", f"{spoken}one\nx\n{spoken}{{\\b1}}\n{spoken}two"), ("b", "x"), ("c", None)], "file_id string, content string")
    scripts = scripts.withColumn("content", F.concat("content", F.lit("")))
    texts = timed_text.caption_text(scripts)
    assert {r.file_id: r.text for r in texts.collect()} == {"a": "one two", "b": None, "c": None}
    for frame in (lines, rejects, texts):
        assert len(re.findall("LogicalRDD|LocalRelation|Scan", plan_of(frame))) == 1


def test_scripts_of_lyric_pieces_are_parsed_once(spark):
    """Neither side of the ground truth parses scripts again or gathers what pieces show."""
    from tessitura.queries import lyrics

    pieces, found = lyrics.truth(spark, "/root/testdata/sf0.001")
    assert "Dialogue:" not in plan_of(found) and "collect_list" not in plan_of(pieces)
    assert found.count() == pieces.count() > 0


def exchanges(frame):
    """What the plan shuffles, with joins that nobody broadcasts."""
    spark = frame.sparkSession
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Another frame, for a plan is kept with its frame.
        plan = frame.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    return [line.split("ENSURE")[0] for line in plan.splitlines() if "Exchange" in line]


def text_streams(spark, n=4, times=40):
    schema = "doc_id long, lang string, text string"
    return words_from_documents(spark.createDataFrame([(d, "en", "One two. Three, four! Five six seven? " * (times + d)) for d in range(n)], schema))


def test_documents_are_shuffled_once_for_all_passes(spark):
    stream = text_streams(spark)
    assert not exchanges(stream) and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    first, second = (sorted(map(tuple, stream.collect())) for _ in range(2))
    assert first == second and len(first) == 7 * (40 + 41 + 42 + 43)
    for s in range(4):
        mine = [r for r in first if r[0] == s]
        assert [r[1] for r in mine] == list(range(len(mine))) and all(a[3] < b[2] for a, b in zip(mine, mine[1:]))


def test_words_of_spans_stay_with_their_stream(spark):
    stream = text_streams(spark)
    rows = stream.collect()
    # A few spans to a stream, then more than meet by key alone, with one that is empty and one behind the end.
    for n in (3, 40):
        bounds = [(s, k, 7.5 * k, 7.5 * k + 20.0) for s in range(4) for k in range(n)] + [(0, 98, 5.0, 5.0), (1, 99, 1e6, 2e6)]
        frame = spark.createDataFrame(bounds, "stream_id long, rank long, start_s double, end_s double")
        got = spans.span_text(stream, frame, ["rank"])
        want = {(s, k): " ".join(r.text for r in rows if r.stream_id == s and r.end_s > a and r.start_s < b) or None for s, k, a, b in bounds}
        assert {(r.stream_id, r.rank): r.text for r in got.collect()} == want
        cut = spans.render_words(stream.drop("language"), frame, ["rank"])
        held = sorted((r.stream_id, r.rank, r.token_id, r.text) for r in cut.collect())
        assert held == sorted((s, k, i, t) for (s, k), text in want.items() if text for i, t in enumerate(text.split()))
        for moved in exchanges(got) + exchanges(cut):
            assert "_cell" not in moved and "token_id" not in moved, moved


def test_numbers_cross_blocks_and_leave_null_keys_unnumbered(spark):
    rows = [(s, k) for s in (1, None) for k in range(0, 12_000, 500)] + [(2, 3)]
    frame = spark.createDataFrame(rows, "s long, k long")
    got = spans.numbered(frame, ["s"], ["k"], spans.row_block(F.col("k")), "n").collect()
    assert sorted((r.k, r.n) for r in got if r.s == 1) == [(500 * i, i) for i in range(24)]
    assert {r.n for r in got if r.s is None} == {None} and [r.n for r in got if r.s == 2] == [0]


def test_cuts_of_many_words_at_once_equal_one_by_one():
    for seed in range(60):
        rng = random.Random(seed)
        t, rows = rng.uniform(0, 700), []
        for _ in range(rng.randint(1, 60)):
            length = rng.choice([0.0, round(rng.uniform(0.08, 0.9), 3), 3.0 if seed % 4 == 0 else 0.5])
            rows.append((round(t, 3), round(t + length, 3), rng.random() < 0.2))
            t += rng.choice([0.1, length, length + rng.choice([0.02, 0.61, 5.0])])
        starts, ends, closing = (np.array(c) for c in zip(*rows))
        cap = rng.choice([0.05, 2.0, 20.0])
        for stop in (len(rows) - 1, len(rows)):
            want = [segments._cut_after(starts, ends, closing, at, stop, cap, float(starts[at])) for at in range(len(rows))]
            assert segments.next_cuts(starts, ends, closing, np.arange(len(rows)), stop, cap).tolist() == want


def test_walks_take_many_groups_to_a_call(spark):
    from tessitura.plans.chain import reached

    # Each key jumps three on, past its end; blocks of four.
    edges = spark.createDataFrame([(k, n, n + 3 if n + 3 < 30 else None, n // 4, n == k % 3) for k in range(7) for n in range(30)], "k long, node long, nxt long, block long, head boolean")
    found = reached(edges, ["k"], fan=2)
    assert sorted(map(tuple, found.collect())) == [(k, n) for k in range(7) for n in range(k % 3, 30, 3)]
    assert "FlatMapGroups" not in plan_of(found)


def test_ticks_move_the_watermark_and_go_no_further(spark, tmp_path):
    schema = "stream_id string, token_id long, start_s double, end_s double, ts timestamp"
    for n, rows in enumerate(([("a", 0, 0.0, 1.0), ("a", 1, 1.5, 2.0)], [("b", 0, 900.0, 901.0)])):
        timed = [(*r, EPOCH + timedelta(seconds=r[2])) for r in rows]
        spark.createDataFrame(timed, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = live.live_spans(stream, buckets=2)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Filter isnull(clock" in plan and plan.index("Filter isnull(clock") < plan.index("EventTimeWatermark")
    got = live.run_to_table(found, spark).collect()
    assert [(r.stream_id, r.kind, r.start_s, r.end_s, r.n_words) for r in got] == [("a", "span", 0.0, 2.0, 2)]


def test_words_of_one_id_are_numbered_by_time(spark):
    # Copies on both sides of a cell's edge, the later one first.
    rows = [(1, k, t, t + 0.5, f"{k}{c}", 0.9) for k in range(100) for c, t in (("b", 10.0 + k + 0.4), ("a", 10.0 + k))]
    clips = spark.createDataFrame([(1, 0, 0.0, 1000.0)], "stream_id long, rank long, start_s double, end_s double")
    got = spans.render_words(spark.createDataFrame(rows, WORDS).repartition(5), clips, ["rank"]).orderBy("token_id").collect()
    assert [r.text for r in got] == [f"{k}{c}" for k in range(100) for c in "ab"]
