"""Digests of nested columns and edit logs against plain versions."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessitura.functions.digest import canonical_text, number_text
from tessitura.operators import lineage


def test_numbers_are_written_as_json_writes_them(spark):
    rand = random.Random(1)
    values = [0.0, -0.0, 1.0, 0.1, 2e-3, 1e-4, 9.9e-5, 1e-5, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 5e-324, 1.7976931348623157e308, -2.5, 100.0, float("inf"), float("-inf"), float("nan")]
    values += [rand.uniform(-1, 1) * 10.0 ** rand.randrange(-30, 30) for _ in range(500)] + [rand.randrange(10**6) / 1000 for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for v, text in frame.select("v", number_text(F.col("v"))).collect():
        assert text == json.dumps(v)


def test_nested_columns_are_canonical(spark):
    kind = "b struct<z:int,a:string>, m map<string,array<double>>, l array<struct<t:string,k:boolean>>, `é q` long"
    rows = [
        ((1, 'q"\n\\ñ\x01'), {"b": [1.0, None], "a": [], "é": None}, [("x", True), None, ("y", None)], 7),
        (None, None, None, None), ((None, None), {}, [], -1), ((2, ""), {"": [0.5]}, [("x", False)], 0),
    ]
    frame = spark.createDataFrame(rows, kind).select(F.struct("b", "m", "l", "é q").alias("v"))
    unset, volatile = {"b.z": "2", "l": "[]"}, frozenset({"l.*.t"})
    got = [r[0] for r in frame.select(canonical_text(F.col("v"), frame.schema["v"].dataType, unset, volatile)).collect()]
    for text, (b, m, items, q) in zip(got, rows):
        value = {"b": b and {"z": b[0], "a": b[1]}, "m": m, "l": items if items is None else [i and {"k": i[1]} for i in items], "é q": q}
        if b and b[0] == 2:
            del value["b"]["z"]
        if items == []:
            del value["l"]
        assert text == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    with pytest.raises(TypeError):
        canonical_text(F.col("d"), spark.sql("SELECT current_date() AS d").schema["d"].dataType)


def test_digests_ignore_what_is_not_declared_or_not_listed(spark):
    old = spark.sql("SELECT named_struct('mode', 'x', 'assets', named_struct('required', array(named_struct('id', 1, 'resolved_at', 'a')))) AS contract")
    new = spark.sql("SELECT named_struct('hook_keyword', CAST(NULL AS STRING), 'outputs', array(named_struct('index', 0, 'aspect', '9:16')), 'mode', 'x', 'assets', named_struct('required', array(named_struct('resolved_at', 'b', 'id', 1)))) AS contract")
    want = hashlib.sha256(b'{"assets":{"required":[{"id":1}]},"mode":"x"}').hexdigest()
    assert [lineage.contract_digest(f).collect()[0]["digest"] for f in (old, new)] == [want, want]


def plain_log(at, log):
    bad = []
    for no, kind, pid, cut, fresh, absorb in sorted(log):
        i = next((k for k, p in enumerate(at) if p[1] == pid), None)
        if kind not in ("split", "delete"):
            bad.append((no, pid, "unknown_edit"))
        elif i is None:
            bad.append((no, pid, "not_found"))
        elif kind == "split":
            o, _, a, b = at[i]
            if cut is None or not a < cut < b:
                bad.append((no, pid, "not_inside"))
            else:
                at[i:i + 1] = [(o, pid, a, cut), (o, fresh, cut, b)]
        elif len(at) == 1:
            bad.append((no, pid, "only_position"))
        elif 0 < i < len(at) - 1 and absorb is None:
            bad.append((no, pid, "absorb_needed"))
        else:
            _, _, a, b = at[i]
            if i == 0 or (i < len(at) - 1 and absorb == "next"):
                at[i + 1] = (*at[i + 1][:2], a, at[i + 1][3])
            else:
                at[i - 1] = (*at[i - 1][:3], b)
            del at[i]
    return at, bad


def test_edit_logs_in_order(spark):
    rand = random.Random(3)
    positions, edits, want_at, want_bad = [], [], [], []
    for v in range(60):
        n = v % 7 if v % 2 else 40
        at = [(k, k if v % 5 else k % 6, k * 10, k * 10 + 10) for k in range(n)]
        log = [
            (no, rand.choice(["split", "split", "delete", "delete", "delete", "move"]), rand.choice([*range(max(1, min(n, 9))), *range(100, 100 + no), 999]), rand.choice([None, *range(0, 90, 3)]), 100 + no, rand.choice([None, "next", "previous"]))
            for no in range(rand.randrange(12))
        ]
        positions += [(v, *p) for p in at]
        edits += [(v, *e) for e in log]
        at, bad = plain_log(at, log)
        want_at += [(v, *p) for p in at]
        want_bad += [(v, *b) for b in bad]
    rand.shuffle(edits)
    kinds = "variant_id long, ordinal long, position_id long, start_ms long, end_ms long", "variant_id long, edit_no int, kind string, position_id long, at_ms long, new_id long, absorb string"
    kept, rejects = lineage.edited_positions(spark.createDataFrame(positions, kinds[0]), spark.createDataFrame(edits, kinds[1]))
    assert sorted(map(tuple, kept.collect())) == sorted(want_at)
    assert sorted(map(tuple, rejects.collect())) == sorted(want_bad)
    kept, rejects = lineage.edited_positions(spark.createDataFrame([], kinds[0]), spark.createDataFrame([], kinds[1]))
    assert kept.count() == rejects.count() == 0


def test_edit_log_folds_once_and_large_variants_agree(spark, monkeypatch):
    """Both sides come from one fold; of a large variant only what edits touch enters it, with the same result."""
    places = [(v, o, o if v else 7, o * 10, o * 10 + 10) for v in range(3) for o in range(40)]
    edits = [
        (v, *e)
        for v in (0, 1, 3)
        for e in ((1, "split", 20, 205, 100, None), (2, "delete", 100, None, None, "next"), (3, "delete", 0, None, None, None), (4, "delete", 7, None, None, None), (5, "move", 9, None, None, None))
    ]
    kinds = "variant_id long, ordinal long, position_id long, start_ms long, end_ms long", "variant_id long, edit_no int, kind string, position_id long, at_ms long, new_id long, absorb string"
    frames = [spark.createDataFrame(rows, kind) for rows, kind in zip((places, edits), kinds)]
    done = lineage.edit_outcomes(*frames)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    want = sorted(done.collect(), key=str)
    monkeypatch.setattr(lineage, "FOLD_ROWS", 10)
    large = lineage.edit_outcomes(*frames)
    assert sorted((tuple(r[c] for c in done.columns) for r in large.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert {(r.variant_id, r.edit_no, r.reason) for r in want if r.reason} == {
        (0, 1, "not_found"), (0, 2, "not_found"), (0, 3, "not_found"), (0, 5, "unknown_edit"), (1, 4, "absorb_needed"), (1, 5, "unknown_edit"),
        *((3, no, "not_found") for no in (1, 2, 3, 4)), (3, 5, "unknown_edit"),
    }
