"""Sequence operators against plain Python folds, with and without the blocked path."""

import random

from pyspark.sql import functions as F

from tessitura.operators import audit, captions, segments, spans, track
from tessitura.params import SegmentParams
from tessitura.plans import scan

WORDS = "stream_id long, token_id long, start_s double, end_s double, text string, confidence double"


def make_words(seed, streams=3, n=260, long_gap=0.02):
    rng, rows = random.Random(seed), []
    for s in range(streams):
        t = rng.uniform(0, 700)
        for k in range(n):
            length = round(rng.uniform(0.08, 0.9), 3)
            text = rng.choice(["uno", "palabra", "extraordinariamente", "si", "dos"]) + rng.choice(["", "", "", ".", ","])
            rows.append((s, k, round(t, 3), round(t + length, 3), text, 0.9))
            gap = rng.choice([0, 0.02, 0.15, 0.61, 1.4]) if rng.random() > long_gap else 9.0
            t += length + gap
    return rows


def islands_of(rows, gap):
    spans = []
    for row in sorted(rows, key=lambda r: (r[2], r[3], r[1])):
        if spans and not row[2] - spans[-1][-1][3] > gap:
            spans[-1].append(row)
        else:
            spans.append([row])
    return spans


def cut_span(span, cap, relative):
    pieces, rest = [], span
    while rest[-1][3] - rest[0][2] > cap:
        origin = rest[0][2] if relative else 0.0
        ends = [r[3] - origin for r in rest]
        tail = [i for i, e in enumerate(ends) if cap * 0.8 <= e <= cap and rest[i][4][-1] in ".?!,;:"]
        fits = [i for i, e in enumerate(ends[:-1]) if e <= cap]
        cut = tail[-1] if tail else (max(fits, key=lambda i: ends[i]) if fits else 0)
        if cut + 1 >= len(rest):
            break
        pieces.append(rest[: cut + 1])
        rest = rest[cut + 1 :]
    return [*pieces, rest]


def expected_pieces(rows, cap, relative):
    out = set()
    for s in {r[0] for r in rows}:
        for span in islands_of([r for r in rows if r[0] == s], 2.0):
            out |= {(s, p[0][2], p[-1][3], len(p)) for p in cut_span(span, cap, relative)}
    return out


def got_pieces(frame):
    return {(r.stream_id, r.start_s, r.end_s, r.n_words) for r in frame.collect()}


def test_pieces_match_fold_on_every_path(spark):
    rows = make_words(1)
    frame = spark.createDataFrame(rows, WORDS)
    want = expected_pieces(rows, 20.0, True)
    assert len(want) > 30
    assert got_pieces(segments.speech_pieces(frame, SegmentParams(max_clip_s=20.0))) == want
    assert got_pieces(segments.speech_pieces(frame, SegmentParams(max_clip_s=20.0), fold_rows=0)) == want
    absolute = segments.speech_pieces(frame, SegmentParams(max_clip_s=20.0, split_origin="absolute"))
    assert got_pieces(absolute) == expected_pieces(rows, 20.0, False)


def test_gap_at_the_limit_does_not_cut(spark):
    rows = [(1, 0, 0.0, 1.0, "a", 1.0), (1, 1, 3.0, 4.0, "b", 1.0), (1, 2, 6.5, 7.0, "c", 1.0), (1, 3, 1300.0, 1301.0, "d", 1.0)]
    got = segments.gap_islands(spark.createDataFrame(rows, WORDS), 2.0).orderBy("token_id").collect()
    assert [r.span_no for r in got] == [0, 0, 1, 2]
    assert [r.seq for r in got] == [0, 1, 2, 3]


def test_both_floors_are_hard(spark):
    rows = [(1, k, k * 2.4, k * 2.4 + 2.3, "w", 1.0) for k in range(3)] + [(1, 3 + k, 100 + k * 0.4, 100.3 + k * 0.4, "w", 1.0) for k in range(4)]
    assert segments.scored_pieces(segments.speech_pieces(spark.createDataFrame(rows, WORDS))).count() == 0


def combined(rows, end, gap, window):
    spans, cut = [], 0.0
    for i, r in enumerate(rows):
        if i and r[2] - rows[i - 1][3] > gap:
            if cut < rows[i - 1][3]:
                spans.append((cut, rows[i - 1][3]))
            cut = r[2]
        elif window is not None and r[4][-1] in ".?!" and r[3] - cut >= window:
            if cut < r[3]:
                spans.append((cut, r[3]))
            cut = r[3]
    return [*spans, (cut, end)] if cut < end else spans


def test_cut_sweep_matches_fold_on_both_paths(spark):
    rows = make_words(2, streams=2, n=400)
    frame = spark.createDataFrame(rows, WORDS)
    linked = audit.in_file_order(frame, [0.6, 3.0])
    bounds = frame.groupBy("stream_id").agg(F.lit(0.0).alias("from_s"), F.max("end_s").alias("to_s"))
    pairs = [(0.6, "island_0"), (3.0, "island_1")]
    want = set()
    for s in (0, 1):
        mine = [r for r in rows if r[0] == s]
        for gap, _ in pairs:
            for n, window in enumerate((10.0, None)):
                want |= {(s, gap, n, a, b) for a, b in combined(mine, max(r[3] for r in mine), gap, window)}
    for limit in (50_000, 0):
        spans = audit.cut_spans(linked, bounds, pairs, (10.0, None), fold_rows=limit)
        assert {(r.stream_id, r.max_gap, r.window_no, r.start_s, r.end_s) for r in spans.collect()} == want


def shuffled_times(rows, seed):
    """The same words with starts that jump back and words that last no time or less."""
    rng, out = random.Random(seed), []
    for s, k, a, b, text, c in rows:
        back = rng.choice([0, 0, 0, 0, 7.0, 33.0])
        out.append((s, k, a - back, (a - back) if rng.random() < 0.05 else (a - back - 1 if rng.random() < 0.05 else b - back), text, c))
    return out


def every_close(rows, end):
    spans, cut = [], 0.0
    for r in rows:
        if r[4][-1] in ".?!":
            spans.append((cut, r[3]))
            cut = r[3]
    return [*spans, (cut, end)] if cut < end else spans


def test_cuts_follow_the_file_when_times_do_not(spark, monkeypatch):
    rows = shuffled_times(make_words(5, streams=2, n=240), 6)
    frame = spark.createDataFrame(rows, WORDS)
    bounds = frame.groupBy("stream_id").agg(F.lit(0.0).alias("from_s"), F.max("end_s").alias("to_s"))
    # Blocks of 16 words and groups of 2 blocks, so that pointers cross both.
    monkeypatch.setattr(audit, "row_block", lambda c: F.floor(c / 16).cast("long"))
    monkeypatch.setattr(audit, "BLOCK_FAN", 2)
    for gap in (3.0,):
        linked = audit.in_file_order(frame, [gap])
        want = set()
        for s in (0, 1):
            mine = [r for r in rows if r[0] == s]
            for n, window in enumerate((5.0, 30.0, None)):
                want |= {(s, n, a, b) for a, b in combined(mine, max(r[3] for r in mine), gap, window)}
        for limit in (4096, 0):
            spans = audit.cut_spans(linked, bounds, [(gap, "island_0")], (5.0, 30.0, None), fold_rows=limit).collect()
            assert {(r.stream_id, r.window_no, r.start_s, r.end_s) for r in spans} == want, (gap, limit)
    whole = audit.in_file_order(frame).withColumn("island_0", F.lit(0).cast("long"))
    spans = audit.cut_spans(whole, bounds, [(float("inf"), "island_0")], (None,), null_cuts_every_close=True).collect()
    got = sorted((r.stream_id, r.start_s, r.end_s) for r in spans)
    assert got == sorted((s, a, b) for s in (0, 1) for a, b in every_close([r for r in rows if r[0] == s], max(r[3] for r in rows if r[0] == s)))


def test_lines_follow_the_file_when_times_do_not(spark):
    rows = shuffled_times(make_words(7, streams=2), 8)
    frame = spark.createDataFrame(rows, WORDS).withColumnRenamed("token_id", "seq")
    want = {(s, line[0][1], len(line)) for s in (0, 1) for line in lines_of([r for r in rows if r[0] == s])}
    for limit in (50_000, 0):
        got = captions.caption_lines(frame, ["stream_id"], fold_rows=limit).groupBy("stream_id", "line_seq").count().collect()
        assert {(r.stream_id, r.line_seq, r["count"]) for r in got} == want


def lines_of(rows):
    lines, cur, chars = [], [], 0
    for r in rows:
        grown = chars + len(r[4]) + (1 if cur else 0)
        if cur and (grown > 18 or r[3] - cur[0][2] > 7.0):
            lines.append(cur)
            cur, chars = [r], len(r[4])
            continue
        cur, chars = [*cur, r], grown
        if len(cur) >= 2 and r[4][-1] in ".?!,;:":
            lines.append(cur)
            cur, chars = [], 0
    return [*lines, cur] if cur else lines


def test_caption_lines_and_shares(spark):
    rows = make_words(3, streams=2)
    islands = segments.gap_islands(spark.createDataFrame(rows, WORDS), 2.0)
    want = {(s, line[0][1], len(line)) for s in (0, 1) for line in lines_of([r for r in rows if r[0] == s])}
    for limit in (50_000, 0):
        lined = captions.caption_lines(islands, ["stream_id"], fold_rows=limit)
        got = lined.groupBy("stream_id", "line_seq").count().collect()
        assert {(r.stream_id, r.line_seq, r["count"]) for r in got} == want
    timed = captions.line_timing(lined, ["stream_id"]).collect()
    for row in timed:
        assert row.share_cs is None or (sum(row.share_cs) == row.end_cs - row.start_cs and min(row.share_cs) >= 1)


def plain_shares(starts, ends):
    slots = [(b - a) * 100.0 for a, b in zip(starts, [*starts[1:], ends[-1]], strict=True)]
    total, n = round(sum(slots)), len(slots)
    least = min(1, total // n)
    if least < 1:
        return None
    out = [max(least, int(x)) for x in slots]
    left = total - sum(out)
    order = sorted(range(n), key=lambda i: (-round(slots[i] - int(slots[i]), 9) if left > 0 else -out[i], i))
    for k in range(abs(left)):
        out[order[k % n]] += 1 if left > 0 else -1
    return out if min(out) >= least else None


def test_shares_move_what_is_left_by_rank(spark):
    rng = random.Random(8)
    rows = [([0.0, 0.333, 0.666], [0.333, 0.666, 1.0]), ([0.0, 0.0, 0.0], [0.0, 0.0, 0.01]), ([1.0], [1.005]), ([5.0, 5.004, 5.008, 5.012], [5.004, 5.008, 5.012, 5.09])]
    for _ in range(400):
        t, starts, ends = rng.randrange(5000), [], []
        for _ in range(rng.randrange(1, 9)):
            starts.append(t / 1000)
            t += rng.choice([0, 1, 3, 7, 15, 40, 333])
            ends.append(t / 1000)
            t += rng.choice([0, 0, 5, 130])
        rows.append((starts, ends))
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, starts array<double>, ends array<double>")
    got = {r.i: r.share_cs for r in captions.with_shares(frame).collect()}
    assert [got[i] for i in range(len(rows))] == [plain_shares(a, b) for a, b in rows]
    assert got[0] == [33, 33, 34] and got[1] is None


def test_corrections_replace_what_they_overlap_and_keep_order(spark):
    rng = random.Random(5)
    clipped, fixes, windows = [], [], []
    for v in range(4):
        windows.append((v, 100 * v, 100 * v + 5000))
        at = 0
        for k in range(80):
            end = at + rng.choice([1, 20, 60, 90])
            clipped.append((v, k, at, end, f"w{k}", 0.5))
            at = end + rng.choice([0, 0, 10])
        for k in range(0 if v == 3 else 12):
            a = rng.randrange(-300, 5600)
            fixes.append((v, a, a + rng.choice([1, 50, 700]), f"fix{k}"))
    frames = (
        spark.createDataFrame(clipped, "variant_id long, token_id long, start_ms long, end_ms long, text string, confidence double"),
        spark.createDataFrame(fixes, "variant_id long, start_ms long, end_ms long, text string"),
        spark.createDataFrame(windows, "variant_id long, start_ms long, end_ms long"),
    )
    got = sorted((r.variant_id, r.place, r.start_ms, r.end_ms, r.text) for r in spans.corrected_words(*frames).collect())
    want = []
    for v, lo, hi in windows:
        own = [f for f in fixes if f[0] == v]
        rows = [(a, 0, k, b, t) for x, k, a, b, t, _ in clipped if x == v and not any(a < e - lo and b > s - lo for _, s, e, _ in own)]
        rows += [(max(s, lo) - lo, 1, 0, min(e, hi) - lo, t) for _, s, e, t in own if e > lo and s < hi]
        want += [(v, i, a, b, t) for i, (a, _, _, b, t) in enumerate(sorted(rows))]
    assert got == want


def test_track_blocks_agree_with_one_pass(spark):
    rng = random.Random(4)
    for p, (x0, x1), (y0, y1) in ((track.TrackParams(), (304.0, 1616.0), (540.0, 540.0)), (track.TrackParams(1080, 2400), (540.0, 540.0), (960.0, 1440.0))):
        edge = lambda k, lo, hi: lo if k % 2 else hi
        step = max(1.0, 0.02 * p.width)
        rows = [(0, k, edge(k, x0, x1), edge(k, y0, y1)) for k in range(900)]
        rows += [(1, k, rng.uniform(x0, x1), rng.uniform(y0, y1)) for k in range(900)] + [(2, 7, x0, y1), (2, 2000, x1, y0)]
        frame = spark.createDataFrame(rows, "video_id long, frame_no long, dx double, dy double")
        want = {}
        for v in (0, 1, 2):
            state = None
            for _, k, *goal in (r for r in rows if r[0] == v):
                if state is not None:
                    near = [min(s + step, max(s - step, 0.35 * g + 0.65 * s)) for g, s in zip(goal, state, strict=True)]
                    goal = [min(x1, max(x0, near[0])), min(y1, max(y0, near[1]))]
                state = want[v, k] = goal
        for block, fan in ((8192, 1024), (256, 1024), (7, 5)):
            got = {(r.video_id, r.frame_no): (r.cx, r.cy) for r in track.smoothed_track(frame, p, block, fan).collect()}
            assert got.keys() == want.keys()
            assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k], strict=True)) < 1e-6


def test_composed_maps_are_the_recurrence():
    rng = random.Random(9)
    for _ in range(200):
        axis = track.Axis(rng.choice([0.1, 0.35, 1.0]), rng.choice([1.0, 38.4, 700.0]), 304.0, 1616.0)
        wants = track.np.array([rng.choice([304.0, 1616.0, rng.uniform(304, 1616)]) for _ in range(rng.randrange(1, 40))])
        knots, values = axis.effect(wants)
        assert len(knots) < 2 * len(wants) + 3
        for state in (304.0, 700.0, 960.5, 1616.0):
            assert abs(track.np.interp(state, knots, values) - track.smooth(wants, state, axis.alpha, axis.step, axis.low, axis.high)[-1]) < 1e-6


def test_crop_sizes(spark):
    frame = spark.createDataFrame([(1920, 1080), (1280, 720), (1080, 1920), (16, 16)], "w int, h int")
    got = frame.select(track.crop_size(F.col("w"), F.col("h")).alias("c")).collect()
    assert [(r.c.width, r.c.height) for r in got[:3]] == [(608, 1080), (404, 720), (1080, 1920)]
    assert got[3].c.reason == "source_too_small"


def test_short_clips_share_calls_and_batches(spark):
    rows = make_words(3, streams=5)
    frame = spark.createDataFrame(rows, WORDS).withColumnRenamed("token_id", "seq")
    want = {(s, line[0][1], len(line)) for s in range(5) for line in lines_of([r for r in rows if r[0] == s])}
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lined = captions.caption_lines(frame, ["stream_id"])
        plan = lined._jdf.queryExecution().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
        got = lined.groupBy("stream_id", "line_seq").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert {(r.stream_id, r.line_seq, r["count"]) for r in got} == want


def test_carries_of_few_and_of_many_blocks_agree(spark, monkeypatch):
    rows = make_words(4, streams=3, n=300)
    frame = spark.createDataFrame(rows, WORDS)
    found = []
    for limit in (64, 0):
        monkeypatch.setattr(scan, "KEY_BLOCKS", limit)
        linked = segments.linked_words(frame, [2.0], ["token_id"], F.floor(F.col("token_id") / 16).cast("long"))
        found.append(sorted(linked.select("stream_id", "seq", "prev_start_s", "prev_end_s", "island_0").collect(), key=lambda r: (r[0], r[1])))
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_short_spans_share_calls(spark):
    rows = make_words(6, streams=4, n=400)
    frame = spark.createDataFrame(rows, WORDS)
    for origin in ("span", "absolute"):
        pieces = segments.speech_pieces(frame, SegmentParams(split_origin=origin, max_clip_s=20.0))
        assert "FlatMapGroupsInPandas" not in pieces._jdf.queryExecution().toString()
        want = {(s, p[0][2], p[-1][3]) for s in range(4) for i in islands_of([r for r in rows if r[0] == s], 2.0) for p in cut_span(i, 20.0, origin != "absolute")}
        assert {(r.stream_id, r.start_s, r.end_s) for r in pieces.collect()} == want
