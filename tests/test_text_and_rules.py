"""Text forms, clocks and null handling."""

import pytest
from pyspark.sql import functions as F

from tessitura.functions import clock, digest
from tessitura.functions import text as tx
from tessitura.operators import gate, resolve, rules
from tessitura.params import SignalParams


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_fold_keeps_enye_apart(spark):
    frame = spark.createDataFrame([("CAMPEÓN  del\tmundo",), ("año",), ("ano",), ("Straße",), ("plain  Text ",)], "t string")
    assert [r.n for r in frame.select(tx.normal(F.col("t")).alias("n")).collect()] == ["campeon del mundo", "año", "ano", "strasse", "plain text"]


@pytest.mark.parametrize(
    ("caption", "found"), [("mira @marca!", True), ("@marcado", False), ("correo@marca.com", False), ("@MARCA", True), ("ñ@marca", False)]
)
def test_mentions(spark, caption, found):
    assert one(spark, tx.has_mention(F.col("c"), F.lit("@marca")), c=caption) is found


@pytest.mark.parametrize(("text", "phrase", "found"), [("el campeon gana", "Campeón", True), ("un ano", "año", False), ("a_b_c", "a b", True), ("abc", "ab", False), ("x", " ", False)])
def test_phrases(spark, text, phrase, found):
    assert one(spark, tx.contains_phrase(F.col("t"), phrase), t=text) is found


def test_clocks(spark):
    assert one(spark, clock.lyric_clock(F.col("t")), t="01:02.5") == 62.5
    assert one(spark, clock.lyric_clock(F.col("t")), t="01:62.5") is None
    assert one(spark, clock.strict_caption_clock(F.col("t")), t="0:01:02.50") == 62.5
    assert one(spark, clock.strict_caption_clock(F.col("t")), t="0:61:02.50") is None
    assert one(spark, clock.lenient_caption_clock(F.col("t")), t="61:02") == 3662.0
    assert one(spark, clock.spoken_clock(F.col("t")), t=" 1:05 s") == 65.0
    assert one(spark, clock.spoken_clock(F.col("t")), t="1:5") is None
    assert one(spark, clock.caption_clock(clock.centiseconds(F.col("t"))), t=3661.005) in {"1:01:01.00", "1:01:01.01"}


def test_canonical_json_is_sorted_and_escaped(spark):
    made = digest.canonical_json({"b": digest.json_text(F.lit('q"\n')), "a": F.lit("1")})
    assert one(spark, made) == '{"a":1,"b":"q\\"\\n"}'


def test_duration_rule_orders_missing_measurements(spark):
    rows = [(None, 5.0, 9.0), (True, None, None), (True, 5.0, None), (True, 5.0, 5.0), (True, 5.0, 4.0)]
    frame = spark.createDataFrame(rows, "probed boolean, min_s double, duration_s double")
    got = [r.s for r in frame.select(rules.duration_min()["status"].alias("s")).collect()]
    assert got == ["unsupported", "pass", "unsupported", "pass", "fail"]


def test_verdict_severity(spark):
    checks = spark.createDataFrame(
        [("a", 1, "r", "hard", "pass", None), ("b", 1, "r", "manual_review", "pass", None), ("c", 1, "r", "recommended", "unsupported", None),
         ("c", 2, "q", "hard", "manual_review", "no_validator"), ("d", 1, "r", "recommended", "fail", None), ("d", 2, "q", "hard", "unsupported", None)],
        "piece_id string, ordinal int, rule_id string, strength string, status string, reason string",
    )
    pieces = spark.createDataFrame([(p,) for p in "abcde"], "piece_id string")
    got = {r.piece_id: (r.status, r.signable) for r in gate.verdicts(pieces, checks).collect()}
    assert got == {"a": ("passed", True), "b": ("pending_review", True), "c": ("unsupported", False), "d": ("rejected", False), "e": ("passed", True)}


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        SignalParams(window_s=0)
    with pytest.raises(ValueError):
        SignalParams(weights={"scene": -1.0})


def test_conflicts_walk_items_field_by_field(spark):
    fields = resolve.CONFLICT_FIELDS
    want = list(fields[0])
    for name in ("x", "tiktok"):
        want += [f.replace("*", name) for f in fields[1]]
    want += fields[2]
    for section in fields[3:]:
        want += [f.replace("#", str(i)) for i in (0, 2, 10) for f in section]
    rows = [(c, f, "conflict") for c in (1, 2) for f in sorted(want)] + [(1, "notes.free", "conflict"), (1, "assets.required[0].size", "conflict"), (3, "hook_keyword", "explicit")]
    frame = spark.createDataFrame(rows, "contract_id long, field_path string, confidence string")
    order = spark.createDataFrame([(c, p, i) for c in (1, 2) for i, p in enumerate(("x", "tiktok"))], "contract_id long, platform string, position int")
    got = resolve.conflicts(frame, order).orderBy("contract_id", "walk").collect()
    assert [(r.contract_id, r.field, r.walk) for r in got] == [(c, f, i) for c in (1, 2) for i, f in enumerate(want)]


def test_folding_looks_at_each_character_once(monkeypatch):
    """A character's bare form is made when it is first met; every character folds as it does alone."""
    import sys
    import unicodedata

    met = []
    bare = tx._bare
    monkeypatch.setattr(tx, "_bare", lambda c: met.append(c) or bare(c))
    monkeypatch.setattr(tx, "_BARE", type(tx._BARE)())
    for _ in range(3):
        assert tx.fold("Ñandú  ÉTÉ ﬁn ÑÑ été n\u0303") == "ñandu ete fin ññ ete ñ"
    assert len(met) == len(set(met))
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        assert tx.fold(f"a{c}b") == " ".join("".join(map(bare, unicodedata.normalize("NFC", f"a{c}b").casefold())).split())
