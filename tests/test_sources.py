"""File sources and sinks on small fixtures."""

import json

from pyspark.sql import functions as F

from tessitura.operators import captions, lineage
from tessitura.sources import briefs, logs, timed_text, words


def test_transcripts_name_the_first_fault(spark, tmp_path):
    good = {"words": [{"start_s": 0, "end_s": "0.5", "text": "hola", "confidence": 0.9}], "language": "es", "duration_s": 1}
    (tmp_path / "good.json").write_text(json.dumps(good))
    (tmp_path / "none.json").write_text(json.dumps({"language": "es"}))
    bad = {"words": [{"start_s": 0, "end_s": 1, "text": "a", "confidence": 1}, {"start_s": True, "end_s": 1, "text": "b"}]}
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    rows, rejects = words.read_transcripts(spark, f"{tmp_path}/*.json")
    assert [(r.token_id, r.end_s, r.text) for r in rows.collect()] == [(0, 0.5, "hola")]
    assert sorted(r.reason for r in rejects.collect()) == ["transcript has no words", "word 1 has no confidence"]


def test_segment_words_number_after_drops(spark):
    schema = "stream_id string, seg_no long, words array<struct<start_s:double,end_s:double,text:string,confidence:double>>"
    frame = spark.createDataFrame([("a", 0, [(0.0, 1.0, " x ", 1.0), (1.0, 2.0, "  ", 1.0)]), ("a", 1, None), ("a", 2, [(2.0, 3.0, "y", 1.0)])], schema)
    got = words.words_from_segments(frame).orderBy("token_id").collect()
    assert [(r.token_id, r.text) for r in got] == [(0, "x"), (1, "y")]


def test_lyrics_offset_tags_and_rejects(spark):
    files = spark.createDataFrame(
        [("a", "[ar:x]\n[00:02.00]second\n[offset:+500]\n[00:00.10][00:05]first and third\n[00:09]"), ("b", "[00:61]bad"), ("c", "words only")],
        "file_id string, content string",
    )
    lines, rejects = timed_text.parse_synced_lyrics(files)
    assert [(r.start_s, r.text) for r in lines.orderBy("line_no").collect()] == [(0.6, "first and third"), (2.0, "second"), (5.5, "first and third")]
    assert {r.file_id: r.reason for r in rejects.collect()} == {"b": "bad_time_tag:00:61", "c": "no_timed_lines"}


def test_caption_scans(spark):
    body = "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,{\\k20}a, b\\Nc\nDialogue: 0,0:00:03.00,0:00:02.00,Default,,0,0,0,,late\n"
    files = spark.createDataFrame([("a", body), ("b", body.split("\n")[0])], "file_id string, content string")
    assert {(r.file_id, r.text) for r in timed_text.caption_segments(files).collect()} == {("a", "a, b c"), ("b", "a, b c")}
    events, rejects = timed_text.caption_events_strict(files)
    assert [r.file_id for r in events.collect()] == ["b"]
    assert [(r.file_id, r.line, r.reason) for r in rejects.collect()] == [("a", 2, "bad_time")]
    assert {r.file_id: r.text for r in timed_text.caption_text(files).collect()}["a"] == "a, b c late"


def test_metric_pairs_ignore_dangling_lines(spark):
    text = ["lavfi.scd.score=9", "pts_time:1.0", "pts_time:2.0", "noise", "lavfi.scd.score=5.5", "lavfi.scd.score=7", "pts_time:3"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file_id string, line_no long, line string")
    assert [(r.time_s, r.value) for r in logs.scene_scores(lines).collect()] == [(2.0, 5.5)]


def test_briefs_hash_normal_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\r")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    good, bad = briefs.read_briefs(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["one\ntwo\n"]
    assert [r.reason for r in bad.collect()] == ["not_utf8"]


def test_recorded_answers_are_checked(spark, tmp_path):
    (tmp_path / "x.draft.json").write_text(json.dumps({"brief_sha256": "b", "prompt_version": "1", "draft": {"a": 1}}))
    (tmp_path / "y.caption.json").write_text(
        json.dumps({"prompt_sha256": "p", "platform": "x", "piece_id": "1", "prompt_version": "0", "caption": {"caption": "c", "hashtags": ["#a"]}})
    )
    (tmp_path / "z.json").write_text("{}")
    drafts, caps, faults = briefs.read_recorded(spark, str(tmp_path), "1")
    assert drafts.first().brief_sha256 == "b"
    assert caps.first().hashtags == ["#a"]
    assert sorted(r.reason for r in faults.collect()) == ["other_prompt_version", "unexpected_name"]


def test_caption_and_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "Dialogue: two"), ("a", 0, "Dialogue: one"), ("b", 0, "Dialogue: b")], "clip string, line_seq long, row string")
    captions.write_caption_rows(rows, f"{tmp_path}/captions", "clip", ["line_seq"], "T")
    text = "".join(p.read_text() for p in sorted((tmp_path / "captions" / "clip=a").glob("*.txt")))
    assert text.startswith("[Script Info]\nTitle: T\n") and text.endswith("Dialogue: one\nDialogue: two\n")
    lineage.write_report(spark.createDataFrame([("r1", "ok")], "run_id string, status string"), f"{tmp_path}/reports")
    lineage.write_report(spark.createDataFrame([("r2", "no")], "run_id string, status string"), f"{tmp_path}/reports")
    assert {r.run_id for r in spark.read.json(f"{tmp_path}/reports").collect()} == {"r1", "r2"}


def test_transcript_numbers_reject_booleans(spark, tmp_path):
    row = {"start_s": True, "end_s": 1, "text": "b", "confidence": 1}
    (tmp_path / "t.json").write_text(json.dumps({"words": [row]}))
    kept, rejects = words.read_transcripts(spark, f"{tmp_path}/t.json")
    assert kept.count() == 0
    assert rejects.select(F.col("reason")).first().reason == "word 0: start_s is not numeric"


def test_transcripts_of_wrong_types_are_rejected(spark):
    good = '{"start_s": 0, "end_s": "1.5", "text": "a", "confidence": 1e-1}'
    cases = {
        "ok": '{"words": [%s], "language": "es", "duration_s": " 2.5 "}' % good,
        "empty": '{"words": []}',
        "not JSON": '{"words": [',
        "transcript is not an object": "[1]",
        "transcript has no words": '{"duration_s": "abc"}',
        "words is not a list": '{"words": {"start_s": 1}}',
        "word 0 is not an object": '{"words": ["x", "y"]}',
        "word 1 is not an object": '{"words": [%s, null]}' % good,
        "word 1 has no text": '{"words": [%s, {"start_s": true, "end_s": 1, "confidence": 1}]}' % good,
        "word 0: start_s is not numeric": '{"words": [{"start_s": false, "end_s": 1, "text": "x", "confidence": "y"}], "duration_s": []}',
        "word 0: confidence is not numeric": '{"words": [{"start_s": 0, "end_s": 1, "text": "x", "confidence": null}]}',
        "duration_s is not numeric": '{"words": [%s], "duration_s": "abc"}' % good,
        "duration_s is not numeric ": '{"words": [%s], "duration_s": true}' % good,
    }
    rows, rejects = words.parse_transcripts(spark.createDataFrame(list(cases.items()), "stream_id string, content string"))
    kept = rows.collect()
    assert [(r.stream_id, r.token_id, r.start_s, r.end_s, r.text, r.confidence, r.language, r.duration_s) for r in kept] == [("ok", 0, 0.0, 1.5, "a", 0.1, "es", 2.5)]
    assert {r.stream_id: r.reason for r in rejects.collect()} == {k: k.strip() for k in cases if k not in ("ok", "empty")}


def test_transcripts_are_judged_in_their_own_rows(spark):
    whole = '{"words":[{"start_s":"0","end_s":1.5,"text":{"a":1},"confidence":0.5}]}'
    files = [("a", whole), ("b", whole.replace("1.5", "[1.5]")), ("c", whole.replace('"0"', "null")), ("d", '{"words":[]}'), ("e", "3"), ("f", '{"words":"[1]"}')]
    kept, rejects = words.parse_transcripts(spark.createDataFrame(files, "stream_id string, content string"))
    for frame in (kept, rejects):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    assert [(r.stream_id, r.token_id, r.start_s, r.end_s, r.text) for r in kept.collect()] == [("a", 0, 0.0, 1.5, '{"a":1}')]
    assert sorted(map(tuple, rejects.collect())) == [
        ("b", "word 0: end_s is not numeric"), ("c", "word 0: start_s is not numeric"), ("e", "transcript is not an object"), ("f", "words is not a list"),
    ]


def test_scripts_are_judged_in_their_own_rows(spark):
    good = "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,a, b"
    files = [("a", f"x\n{good}\n  {good}\n"), ("b", f"{good}\nDialogue: 0,1\n{good.replace('02', '00')}"), ("c", good.replace("02", "00")), ("d", "x")]
    events, rejects = timed_text.caption_events_strict(spark.createDataFrame(files, "file_id string, content string"))
    for frame in (events, rejects):
        assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, events.collect())) == [("a", 1, 1.0, 2.0, "a, b"), ("a", 2, 1.0, 2.0, "a, b")]
    assert sorted(map(tuple, rejects.collect())) == [("b", 2, "malformed_dialogue"), ("c", 1, "bad_time")]
