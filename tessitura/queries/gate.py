"""Text rules, the gate, delivery and what feeds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import text as tx
from tessitura.operators import gate as op
from tessitura.operators import rules as rl
from tessitura.operators.spans import cut_line_windows
from tessitura.queries.common_sql import WORDS, with_words
from tessitura.queries.lyrics import LYRIC_SQL, shown_evidence, truth
from tessitura.queries.spans import _CUT_LINES, _ENDED, _HALF, _LINES, half_spans, timed_lines
from tessitura.sources.tables import table, words

PLATFORMS = ("tiktok", "instagram_reels", "youtube_shorts", "x")
# Contract literals: id, format, outputs, split, policy, locks, prohibitions, hook, safety, logo.
CONTRACTS = (
    (0, "video", ["9:16", "16:9"], None, None, [], ["lenguaje tóxico"], "the", False, False),
    (1, "video", ["9:16"], (1080, 1920, "9:16"), "internal_official_sound", ["of the"], [], None, True, True),
    (2, "slideshow", ["1:1", "4:5"], None, "original_audio", [], ["en la"], "año", False, False),
    (3, "lyric_video", ["9:16"], None, None, [], [], None, False, False),
    (4, "lyric_video", ["9:16"], None, None, [], [], None, True, False),
    (5, "lyric_video", ["16:9"], None, None, [], [], None, False, False),
)
# Platform literals: contract, platform, audio rule, min, max, mentions, must mention, hashtags, forbidden, first line, attribution, link.
PLATFORM_RULES = (
    (0, "tiktok", "own_clip", 5.0, 60.0, ["@marca"], [], ["#clip"], ["de la", "of the"], None, "none", False),
    (0, "instagram_reels", "any", None, 45.0, [], ["@the"], ["#Day1"], [], "The", "tag", False),
    (0, "youtube_shorts", "no_trending", 10.0, None, [], [], [], ["tion"], None, "none", True),
    (0, "x", "official_required", None, None, [], [], ["##CLIP "], ["the_of"], None, "none", False),
    (1, "tiktok", "any", 3.0, 30.0, [], [], [], ["AND"], None, "none", False),
    (1, "instagram_reels", "own_clip", 3.0, 90.0, [], [], ["#day2"], [], " the ", "url", False),
    (1, "youtube_shorts", "own_clip", None, None, ["@a"], ["@b"], [], [], None, "none", False),
    (1, "x", "any", None, 20.0, [], [], [], ["für"], None, "none", False),
    (2, "tiktok", "no_trending", 8.0, None, [], [], [], [], None, "none", False),
    (2, "instagram_reels", "no_trending", None, None, [], [], [], ["en"], None, "none", False),
    (2, "youtube_shorts", "no_trending", None, 70.0, [], [], ["clip"], [], None, "none", False),
    *((c, p, "any", None, 20.0 * c, [], [], [], [], None, "none", False) for c in (3, 4, 5) for p in PLATFORMS),
)
RULES = (
    (0, "hard", ["artifact.integrity", "artifact.aspect", "artifact.video_stream", "duration.min", "duration.max", "audio.present", "caption.required_mention",
                 "caption.required_hashtag", "caption.forbidden", "caption.first_line", "subtitles.spelling_lock", "hook.keyword", "brand.safety", "layout.geometry"]),
    (0, "recommended", ["audio.own_clip", "attribution.present", "link.in_bio"]),
    (0, "manual_review", ["audio.rule", "audio.policy"]),
    (1, "hard", ["artifact.integrity", "layout.geometry", "artifact.aspect", "audio.silence", "audio.policy", "subtitles.spelling_lock", "watermark.full_video",
                 "brand.safety", "assets.required", "duration.max", "caption.forbidden"]),
    (1, "recommended", ["watermark.present", "caption.first_line", "audio.no_trending", "caption.required_mention", "caption.required_hashtag"]),
    (1, "manual_review", ["custom.review", "duration.min"]),
    (2, "hard", ["artifact.video_stream", "artifact.aspect", "link.in_bio", "custom.unknown", "custom.cited", "hook.keyword", "audio.official_track"]),
    (2, "recommended", ["caption.forbidden", "duration.max"]),
    (2, "manual_review", ["duration.min"]),
    *((c, "hard", ["artifact.integrity", "subtitles.spelling_lock", "duration.max", "brand.safety"]) for c in (3, 4, 5)),
)
UNMAPPED = ((2, "custom.cited", "cite one"), (1, "custom.review", "cite two"), (1, "hook.keyword", "cite three"))


def contracts(spark: SparkSession) -> DataFrame:
    schema = (
        "contract_id long, format string, outputs array<string>, split struct<width:int,height:int,aspect:string>, audio_policy string, "
        "spelling_locks array<string>, prohibitions array<string>, hook_keyword string, brand_safety_required boolean, watermark_required boolean"
    )
    return spark.createDataFrame(CONTRACTS, schema).withColumn("aspect_tolerance", F.lit(rl.ASPECT_TOLERANCE))


def platform_rules(spark: SparkSession) -> DataFrame:
    schema = (
        "contract_id long, platform string, audio_rule string, min_s double, max_s double, required_mentions array<string>, must_mention array<string>, "
        "required_hashtags array<string>, forbidden array<string>, first_line string, attribution_type string, link_in_bio boolean"
    )
    return spark.createDataFrame(PLATFORM_RULES, schema)


def rules(spark: SparkSession) -> DataFrame:
    flat = [(c, s, i, r) for c, s, ids in RULES for i, r in enumerate(ids)]
    return spark.createDataFrame(flat, "contract_id long, strength string, ordinal int, rule_id string")


def unmapped(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, r, q) for i, (c, r, q) in enumerate(UNMAPPED)], "contract_id long, position int, rule string, quote string")


def base_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as pieces: this turn is published, the next one is what was spoken."""
    talk = table(spark, folder, "conversations")
    later = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("subtitle_text"))
    names = F.array(*[F.lit(p) for p in PLATFORMS])
    return talk.join(later, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("piece_id"),
        F.col("conv_id").alias("batch_id"),
        (F.col("conv_id") % 6).alias("contract_id"),
        F.element_at(names, (F.floor(F.col("conv_id") / 6) % 4 + 1).cast("int")).alias("platform"),
        F.col("text").alias("caption"),
        "subtitle_text",
        (F.col("conv_id") * 7 + F.col("turn") * 3).alias("k"),
        "turn",
    )


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    tokens = F.filter(F.split(F.coalesce("subtitle_text", F.lit("")), " "), lambda t: t != "")
    sizes = {0: (1080, 1920), 1: (1920, 1080), 2: (608, 1080), 3: (1000, 1000), 5: (720, 900)}
    width = F.coalesce(*[F.when(k % 6 == m, w) for m, (w, _) in sizes.items()])
    height = F.coalesce(*[F.when(k % 6 == m, h) for m, (_, h) in sizes.items()])
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("batch_id"), F.struct((F.col("toxic") == 1).alias("risk")).alias("assessment")
    )
    segment = "array<struct<text:string,start_s:double,end_s:double>>"
    sung, found = truth(spark, folder)
    sung = sung.select("piece_id", F.col("subtitle_text").alias("sung"), F.col("segments").alias("sung_segments"))
    is_sung = F.col("contract_id") >= 3
    spoken = F.transform(tokens, lambda t, i: F.struct(t.alias("text"), (i * 0.8).alias("start_s"), (i * 0.8 + 0.8).alias("end_s"))).cast(segment)
    return (
        base_pieces(spark, folder)
        .join(labels, "batch_id", "left")
        .join(sung, "piece_id", "left")
        .join(found, "piece_id", "left")
        .withColumn("segments", F.when(is_sung, F.col("sung_segments")).otherwise(spoken))
        .withColumn("subtitle_text", F.when(is_sung, F.col("sung")).otherwise(F.col("subtitle_text")))
        .drop("sung", "sung_segments")
        .select(
            "*",
            F.array(F.lit("#Clip"), F.concat(F.lit("#day"), (F.col("turn") % 3).cast("string"))).alias("hashtags"),
            F.when(
                k % 2 == 0,
                F.array(F.struct(F.get(F.split("caption", " "), F.lit(0)).alias("text"), F.lit(0.5).alias("start_s"), F.lit(1.5).alias("end_s"))),
            ).otherwise(F.array()).cast(segment).alias("screen"),
            F.when(k % 19 != 0, F.sha2("caption", 256)).alias("artifact_sha256"),
            (k % 13 != 0).alias("probed"),
            F.when(k % 11 != 0, k % 90 + 0.5).alias("duration_s"),
            (k % 17 != 0).alias("has_video"),
            (k % 5 != 0).alias("has_audio"),
            width.alias("width"),
            height.alias("height"),
            F.when(k % 4 != 3, k % 4).alias("audio_tracks"),
            F.when(k % 3 == 0, -91.0).when(k % 3 == 1, -20.0).alias("max_volume_db"),
        )
    )


def registry(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").filter(F.col("doc_id") % 13 != 0)
    digest = F.sha2("text", 256)
    return docs.select(
        F.col("doc_id").alias("asset_id"),
        F.when(F.col("doc_id") % 11 == 0, F.sha2("lang", 256)).otherwise(digest).alias("reg_sha256"),
        F.char_length("text").cast("long").alias("reg_size"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("changed")).when(F.col("doc_id") % 11 == 0, F.sha2("lang", 256)).otherwise(digest).alias("file_sha256"),
        (F.col("doc_id") % 23 != 0).alias("safe"),
    )


def asset_audit(spark: SparkSession, folder: str) -> DataFrame:
    required = table(spark, folder, "documents").select(
        (F.col("doc_id") % 3).alias("contract_id"),
        F.col("doc_id").alias("asset_id"),
        F.when(F.col("doc_id") % 5 != 0, F.sha2("text", 256)).alias("sha256"),
        F.char_length("text").cast("long").alias("size_bytes"),
    )
    return op.asset_faults(required, registry(spark, folder))


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled frames of every piece, twelve each, from its own arithmetic."""
    n, k = F.col("n"), F.col("k")
    c = (k * 31 + n * 7) % 100
    weak = (k * 13 + n) % 100
    return base_pieces(spark, folder).select("piece_id", "k", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n")).select(
        "piece_id",
        F.when(k % 10 == 9, "edge").otherwise("ccoeff").alias("metric"),
        F.when(k % 3 == 0, 0.8 + c / 1000.0).when(k % 3 == 1, 0.3 + c / 200.0).otherwise(c / 100.0).alias("correlation"),
        F.when(k % 4 != 0, 0.3 + weak / 140.0).alias("edge_score"),
        F.when(k % 5 == 0, 0.9).otherwise(0.5).alias("opacity"),
        F.lit(1080).alias("frame_w"),
        F.lit(1920).alias("frame_h"),
        F.lit(162).alias("logo_w"),
        F.when(k % 7 == 0, 0.2).otherwise(0.1).alias("min_width_ratio"),
        (F.lit(20) + F.when((k % 9 == 0) & (n == 3), 40).otherwise(n % 5)).alias("x"),
        F.lit(25).alias("y"),
        F.lit(20.0).alias("expected_x"),
        F.lit(20.0).alias("expected_y"),
    )


def logo_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return op.logo_verdicts(samples(spark, folder))


def gate_rows(spark: SparkSession, folder: str) -> DataFrame:
    faults = op.faults_by_contract(
        op.asset_faults(
            table(spark, folder, "documents").select(
                (F.col("doc_id") % 6).alias("contract_id"), F.col("doc_id").alias("asset_id"), F.sha2("text", 256).alias("sha256"),
                F.char_length("text").cast("long").alias("size_bytes"),
            ),
            registry(spark, folder),
        )
    )
    rows = op.joined_rows(pieces(spark, folder), platform_rules(spark), contracts(spark))
    logos = logo_verdicts(spark, folder).drop("n_samples")
    return rows.join(faults, "contract_id", "left").join(logos, "piece_id", "left")


def gate_checks(spark: SparkSession, folder: str) -> DataFrame:
    dispatch = op.dispatch_table(rules(spark), platform_rules(spark), unmapped(spark))
    return op.evaluate(gate_rows(spark, folder), dispatch, unmapped(spark))


def check_rows(spark: SparkSession, folder: str) -> DataFrame:
    return gate_checks(spark, folder).select(
        "piece_id", "tier", "ordinal", "rule_id", "strength", "status", F.coalesce("reason", F.lit("")).alias("reason"), shown_evidence(F.col("evidence")).alias("evidence")
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    known = base_pieces(spark, folder).join(platform_rules(spark).select("contract_id", "platform"), ["contract_id", "platform"], "left_semi")
    return op.verdicts(known.select("piece_id", "batch_id", "contract_id", "platform"), gate_checks(spark, folder))


def gate_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).select("piece_id", "status", "n_checks", "open_rules", "signable")


def approvals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("batch_id")).distinct().select(
        "batch_id", (F.col("batch_id") % 2 == 0).alias("approved")
    )


def delivery_status(spark: SparkSession, folder: str) -> DataFrame:
    return op.batch_status(op.deliveries(judged(spark, folder), approvals(spark, folder)))


def rejections(spark: SparkSession, folder: str) -> DataFrame:
    return op.deliveries(judged(spark, folder), approvals(spark, folder)).filter(~F.col("exportable")).select("piece_id", "rejection")


def undeclared_platforms(spark: SparkSession, folder: str) -> DataFrame:
    return op.undeclared_platforms(base_pieces(spark, folder), platform_rules(spark)).select("piece_id", "platform")


def reminders(spark: SparkSession, folder: str) -> DataFrame:
    targets = spark.createDataFrame(
        [(0, "ES", 40, None, True), (1, None, None, 1000, False), (2, "MX", 10, 5000, None)],
        "contract_id long, geo_country string, geo_min_pct int, min_views int, proof_required boolean",
    )
    return op.reminders(base_pieces(spark, folder), targets, rules(spark), platform_rules(spark))


def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("batch_id"), (F.col("l_partkey") % 50).alias("piece_id"))
    return op.duplicates(lines, ["batch_id", "piece_id"])


def piece_grid(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    offered = lines.select(F.col("l_orderkey").alias("contract_id"), F.col("l_returnflag").alias("platform")).distinct()
    assets = lines.select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_partkey").alias("asset_id"), F.col("l_linenumber").alias("position"),
        F.when(F.col("l_linestatus") == "O", "video").otherwise("image").alias("kind"),
    )
    return op.piece_grid(offered, assets)


def lyric_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    stream = words(spark, folder)
    windows = half_spans(stream).withColumnsRenamed({"stream_id": "track_id", "n": "window_id"})
    cut = cut_line_windows(timed_lines(stream), windows).select(
        F.concat_ws("-", F.col("track_id").cast("string"), F.col("window_id").cast("string")).alias("piece_id"),
        "track_id", "window_id", "line_no", "start_s", "end_s", "text",
    )
    from pyspark.sql import Window

    placed = cut.withColumn("idx", F.row_number().over(Window.partitionBy("piece_id").orderBy("line_no")) - 1)
    expected = placed.select("piece_id", "idx", "start_s", "end_s", tx.ordered_tokens(tx.normal(F.col("text"))).alias("tokens"))
    odd = (F.col("track_id") + F.col("window_id")) % 5
    bent = placed.filter(~((odd == 1) & (F.col("idx") == 0) & (F.col("track_id") % 2 == 0))).select(
        "piece_id",
        "idx",
        F.when((odd == 2) & (F.col("idx") == 2), F.col("start_s") + 0.5).otherwise(F.col("start_s") + 0.01).alias("start_s"),
        F.when(odd == 3, F.col("end_s") + 0.3).otherwise(F.col("end_s")).alias("end_s"),
        tx.ordered_tokens(tx.normal(F.when((odd == 4) & (F.col("idx") == 1), F.concat("text", F.lit(" extra"))).otherwise(F.upper("text")))).alias("tokens"),
    )
    return bent, expected


def lyric_concordance(spark: SparkSession, folder: str) -> DataFrame:
    return op.concordance(*lyric_sides(spark, folder)).select("piece_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


def loose_timing(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's lines as one piece's segments."""
    from tessitura.operators.spans import trimmed  # noqa: F401

    pieces_ = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("piece_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("o"),
                    (F.col("l_linenumber") * 10 + F.when(F.col("l_tax") == 0.08, -25.0).otherwise(F.col("l_quantity") / 10)).alias("start_s"),
                    (F.col("l_linenumber") * 10 + F.col("l_quantity") / 4).alias("end_s"),
                )
            )
        ).alias("segments")
    )
    return pieces_.select(
        "piece_id", F.coalesce(op.loose_timing_fault(F.col("segments"), F.lit(12.0), F.lit(72.0)), F.lit("ok")).alias("reason")
    )


def normal_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", tx.normal(F.col("text")).alias("normal"))


def folded_mentions(spark: SparkSession, folder: str) -> DataFrame:
    folded = tx.normal_mentions(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id",
        tx.contains_any(folded, ["official sound", "sonido oficial", "audio oficial", "official audio"]).alias("official_sound"),
        tx.contains_any(folded, ["lyric video", ".lrc", "the of"]).alias("lyric"),
        tx.contains_any(tx.normal(F.col("text")), [tx.fold(p) for p in rl.SAFETY_PHRASES]).alias("safety"),
    )


def text_matches(spark: SparkSession, folder: str) -> DataFrame:
    talk = table(spark, folder, "conversations")
    n = tx.normal(F.col("text"))
    return talk.select(
        "conv_id",
        "turn",
        *[tx.contains_phrase(n, p).alias(f"p{i}") for i, p in enumerate(("of the", "año", "THE_OF", "für", "éou"))],
        tx.has_mention(F.col("text"), F.lit("@example")).alias("mention"),
        tx.has_hashtag(F.col("text"), F.lit("#1")).alias("tag"),
        tx.hashtag(F.concat(F.lit(" ##"), F.col("role"), F.lit(" "))).alias("tag_form"),
        F.size(tx.ordered_tokens(n)).alias("n_tokens"),
        F.size(tx.distinct_in_order(tx.ordered_tokens(n))).alias("n_distinct"),
        tx.first_line(F.col("text")).alias("first_line"),
        F.array_join(F.array_except(F.array(F.lit("user"), F.lit("system")), F.array("role")), ",").alias("absent_roles"),
    )


def aspect_labels(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 20).cast("int").alias("w"), (F.col("l_partkey") % 60 * 20 + 20).cast("int").alias("h")
    )
    return lines.groupBy("w", "h").agg(F.count(F.lit(1)).alias("n")).select(
        "w", "h", "n", rl.aspect_label(F.col("w"), F.col("h")).alias("label"), rl.aspect_matches(F.col("w"), F.col("h"), 9.0 / 16.0).alias("vertical")
    )


def sample_times(spark: SparkSession, folder: str) -> DataFrame:
    timed = base_pieces(spark, folder).select("piece_id", (F.col("k") % 90 + 0.5).alias("duration_s"))
    return timed.select("piece_id", F.posexplode(op.sample_times(F.col("duration_s"))).alias("n", "at")).select("piece_id", "n", F.round("at", 6).alias("at"))


def logo_corners(spark: SparkSession, folder: str) -> DataFrame:
    zones = F.array(*[F.lit(z) for z in ("top_left", "top_right", "bottom_left", "bottom_right", "center", "center_top", "center_bottom")])
    lines = table(spark, folder, "lineitem").select(
        F.lit(1080).alias("fw"), F.lit(1920).alias("fh"), (F.col("l_quantity") * 6).cast("int").alias("w"), (F.col("l_linenumber") * 31).alias("h"),
        F.element_at(zones, (F.col("l_orderkey") % 7 + 1).cast("int")).alias("zone"),
    ).distinct()
    corner = op.expected_corner(F.col("fw"), F.col("fh"), F.col("w"), F.col("h"), F.col("zone"))
    return lines.select("w", "h", "zone", corner["x"].alias("x"), corner["y"].alias("y"))


def colours(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    hexes = F.substring(F.sha2("text", 256), 1, 8)
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("#"), F.substring(hexes, 1, 6))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" #"), hexes)).when(
        F.col("doc_id") % 4 == 2, F.concat(F.lit("&h"), hexes)
    ).otherwise(hexes)
    return docs.select("doc_id", tx.caption_colour(raw).alias("colour"))


QUERIES = {
    "gate_checks": check_rows,
    "gate_verdicts": gate_verdicts,
    "delivery_status": delivery_status,
    "rejections": rejections,
    "undeclared_platforms": undeclared_platforms,
    "reminders": reminders,
    "duplicate_keys": duplicate_keys,
    "piece_grid": piece_grid,
    "asset_audit": asset_audit,
    "logo_verdicts": logo_verdicts,
    "lyric_concordance": lyric_concordance,
    "loose_timing": loose_timing,
    "normal_text": normal_text,
    "folded_mentions": folded_mentions,
    "text_matches": text_matches,
    "aspect_labels": aspect_labels,
    "sample_times": sample_times,
    "logo_corners": logo_corners,
    "colours": colours,
}


def _n(x: str) -> str:
    return (
        f"trim(regexp_replace(replace(strip_accents(replace(replace(lower({x}), 'ß', 'ss'), 'ñ', chr(1))), chr(1), 'ñ'), '\\s+', ' ', 'g'))"
    )


def _phrase(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}])' || {pattern} || '($|[^\\p{{L}}\\p{{N}}])')"


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "([" + ", ".join(_q(x) for x in v) + "]::VARCHAR[])"
    if isinstance(v, tuple):
        return "(" + ", ".join(_q(x) for x in v) + ")"
    return f"{v}::DOUBLE" if isinstance(v, float) else str(v)


def _pattern_of(term: str) -> str:
    return "[\\s_]+".join(p for p in tx.fold(term).replace("_", " ").split())


_FLAT_CONTRACTS = ", ".join(
    _q((c, f, o, (s or (None, None, None))[0], (s or (None, None, None))[1], pol, lk, [_pattern_of(x) for x in lk], pr, [_pattern_of(x) for x in pr], h,
        _pattern_of(h) if h else None, sf, wm))
    for c, f, o, s, pol, lk, pr, h, sf, wm in CONTRACTS
)
_FLAT_PLATFORMS = ", ".join(_q((*r[:9], [_pattern_of(x) for x in r[8]], *r[9:])) for r in PLATFORM_RULES)
_FLAT_RULES = ", ".join(_q((c, s, i, r)) for c, s, ids in RULES for i, r in enumerate(ids))
_PIECES_SQL = f"""
_b AS (SELECT c.conv_id || '-' || c.turn AS piece_id, c.conv_id AS batch_id, c.conv_id % 6 AS contract_id,
       {_q(list(PLATFORMS))}[c.conv_id // 6 % 4 + 1] AS platform, c.text AS caption, n.text AS spoken, c.conv_id * 7 + c.turn * 3 AS k, c.turn
       FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1)"""
_SAMPLES_SQL = """
_sm AS (SELECT piece_id, k, n, CASE WHEN k % 10 = 9 THEN 'edge' ELSE 'ccoeff' END AS metric, (k * 31 + n * 7) % 100 AS c, (k * 13 + n) % 100 AS weak,
        CASE WHEN k % 5 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS opacity FROM _b, unnest(range(0, 12)) AS u(n)),
_sv AS (SELECT *, CASE k % 3 WHEN 0 THEN 0.8::DOUBLE + c / 1000.0::DOUBLE WHEN 1 THEN 0.3::DOUBLE + c / 200.0::DOUBLE ELSE c / 100.0::DOUBLE END AS corr,
        CASE WHEN k % 4 <> 0 THEN 0.3::DOUBLE + weak / 140.0::DOUBLE END AS edge FROM _sm),
_sj AS (SELECT *, corr >= CASE WHEN metric = 'edge' THEN greatest(5.0, 12.0 * opacity) ELSE 0.75 END AND NOT (k % 7 = 0) AND NOT (k % 9 = 0 AND n = 3) AS hit,
        metric = 'ccoeff' AND corr >= 0.22 AND coalesce(edge >= 0.35, false) AS faint, coalesce(edge >= 0.9, false) AS strong,
        metric = 'ccoeff' AND opacity < 0.7 AS usable FROM _sv),
logos AS (SELECT piece_id, count(*) AS n_samples,
        CASE WHEN bool_and(hit) THEN 'pass' WHEN bool_and(usable) AND bool_and(faint) AND bool_and(strong) THEN 'pass' WHEN bool_and(usable) AND bool_and(faint) THEN 'manual_review' ELSE 'fail' END AS logo_all,
        CASE WHEN bool_or(hit) THEN 'pass' WHEN bool_and(usable) AND bool_or(faint AND strong) THEN 'pass' WHEN bool_and(usable) AND bool_or(faint) THEN 'manual_review' ELSE 'fail' END AS logo_any
        FROM _sj GROUP BY piece_id)"""
_REGISTRY_SQL = """
_rg AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN sha256(lang) ELSE sha256(text) END AS reg,
        CASE WHEN doc_id % 17 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN sha256(lang) ELSE sha256(text) END AS file, doc_id % 23 <> 0 AS safe, sha256(text) AS own
        FROM documents),
_af AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN NOT safe THEN 'unsafe' WHEN doc_id % 5 <> 0 AND reg <> own THEN 'mismatched' WHEN file <> reg THEN 'tampered' END AS fault FROM _rg),
_ag AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN NOT safe THEN 'unsafe' WHEN reg <> own THEN 'mismatched' WHEN file <> reg THEN 'tampered' END AS fault FROM _rg)"""
_MISSING_MENTION = """([m FOR m IN list_concat(mentions, must) IF NOT regexp_matches(caption, '(?i)(^|[^\\p{L}\\p{M}\\p{N}_@])' || m || '($|[^\\p{L}\\p{M}\\p{N}_])')])"""
_TAGS = "['clip', 'day' || (turn % 3)]"
_MISSING_TAG = f"""([t FOR t IN tags IF NOT list_contains({_TAGS}, lower(ltrim(trim(t), '#'))) AND NOT regexp_matches(caption, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_#])#' || lower(ltrim(trim(t), '#')) || '($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')])"""
_TERMS, _LIST = "list_concat(forbidden, prohibitions)", "list_concat(forbidden_p, prohibitions_p)"


def _fits(target: str) -> str:
    return f"abs(w / h - {target}) <= {target} * 0.05"


_RATIO = "CASE o WHEN '9:16' THEN 9.0/16.0 WHEN '16:9' THEN 16.0/9.0 WHEN '1:1' THEN 1.0 ELSE 0.8 END::DOUBLE"
_UNPROBED = "WHEN NOT probed THEN 'unsupported:not_probed'"
_RAW = f"""CASE canon
  WHEN 'artifact.integrity' THEN CASE WHEN k % 19 = 0 THEN 'fail:artifact_missing' ELSE 'pass:' END
  WHEN 'artifact.video_stream' THEN CASE WHEN format <> 'video' THEN 'unsupported:not_a_video_format' {_UNPROBED} WHEN has_video THEN 'pass:' ELSE 'fail:no_video' END
  WHEN 'artifact.aspect' THEN CASE {_UNPROBED} WHEN NOT has_video THEN 'fail:no_video' WHEN w IS NULL THEN 'unsupported:no_dimensions'
       WHEN len([o FOR o IN outputs IF {_fits(_RATIO)}]) > 0 THEN 'pass:' ELSE 'fail:undeclared_aspect' END
  WHEN 'layout.geometry' THEN CASE WHEN split_w IS NULL THEN 'fail:split_undeclared' {_UNPROBED} WHEN NOT has_video THEN 'fail:no_video' WHEN w IS NULL THEN 'unsupported:no_dimensions'
       WHEN w <> split_w OR h <> split_h THEN 'fail:other_dimensions' ELSE 'pass:' END
  WHEN 'duration.min' THEN CASE {_UNPROBED} WHEN min_s IS NULL THEN 'pass:no_bound' WHEN dur IS NULL THEN 'unsupported:no_duration' WHEN dur >= min_s THEN 'pass:' ELSE 'fail:out_of_bounds' END
  WHEN 'duration.max' THEN CASE {_UNPROBED} WHEN max_s IS NULL THEN 'pass:no_bound' WHEN dur IS NULL THEN 'unsupported:no_duration' WHEN dur <= max_s THEN 'pass:' ELSE 'fail:out_of_bounds' END
  WHEN 'audio.present' THEN CASE WHEN audio_rule IN ('official_required', 'no_trending') THEN 'manual_review:audio_not_verifiable' WHEN audio_rule = 'any' THEN 'unsupported:audio_not_required'
       {_UNPROBED} WHEN has_audio THEN 'pass:' ELSE 'fail:no_audio' END
  WHEN 'audio.own_clip' THEN 'manual_review:person_decides' WHEN 'audio.no_trending' THEN 'manual_review:person_decides' WHEN 'audio.official_track' THEN 'manual_review:person_decides'
  WHEN 'audio.policy' THEN CASE WHEN policy = 'internal_official_sound' THEN 'manual_review:approval_needed' ELSE 'pass:' END
  WHEN 'audio.silence' THEN CASE WHEN policy IS DISTINCT FROM 'internal_official_sound' THEN 'pass:' WHEN k % 4 = 3 THEN 'unsupported:tracks_not_counted' WHEN k % 4 <> 1 THEN 'fail:not_one_track'
       WHEN k % 3 = 2 THEN 'unsupported:volume_not_measured' WHEN k % 3 = 0 THEN 'pass:' ELSE 'fail:audible' END
  WHEN 'caption.required_mention' THEN CASE WHEN len({_MISSING_MENTION}) > 0 THEN 'fail:missing' ELSE 'pass:' END
  WHEN 'caption.required_hashtag' THEN CASE WHEN len({_MISSING_TAG}) > 0 THEN 'fail:missing' ELSE 'pass:' END
  WHEN 'caption.forbidden' THEN CASE WHEN len([p FOR p IN {_LIST} IF {_phrase('pub_n', 'p')}]) > 0 THEN 'fail:published' WHEN len([p FOR p IN {_LIST} IF {_phrase('spk_n', 'p')}]) > 0 THEN 'manual_review:spoken' ELSE 'pass:' END
  WHEN 'caption.first_line' THEN CASE WHEN first_line IS NULL THEN 'pass:not_required' WHEN contains(trim(regexp_split_to_array(caption, '\\r\\n|[\\n\\r]')[1]), trim(first_line)) THEN 'pass:' ELSE 'fail:first_line_absent' END
  WHEN 'subtitles.spelling_lock' THEN CASE WHEN format = 'lyric_video' THEN CASE WHEN coalesce(blank, true) THEN 'fail:no_synced_subtitles' WHEN lyric <> 'ok' THEN 'fail:' || lyric ELSE 'pass:' END
       WHEN len(locks) = 0 THEN 'pass:no_locks' WHEN spoken IS NULL THEN 'unsupported:no_subtitles'
       WHEN len([p FOR p IN locks_p IF NOT {_phrase('spk_n', 'p')}]) > 0 THEN 'fail:missing' ELSE 'pass:' END
  WHEN 'hook.keyword' THEN CASE WHEN hook IS NULL THEN 'pass:not_required' WHEN {_phrase('hook_n', 'hook_p')} OR {_phrase('scr_n', 'hook_p')} THEN 'pass:' ELSE 'fail:not_in_opening' END
  WHEN 'brand.safety' THEN CASE WHEN NOT (safety OR contract_id = 0) THEN 'pass:not_required' WHEN toxic IS NULL THEN 'manual_review:no_assessor' WHEN toxic = 1 THEN 'manual_review:risk' ELSE 'pass:no_risk' END
  WHEN 'assets.required' THEN CASE WHEN faults IS NOT NULL THEN 'fail:asset_faults' ELSE 'pass:' END
  WHEN 'watermark.full_video' THEN CASE WHEN NOT logo THEN 'pass:not_required' WHEN dur IS NULL THEN 'unsupported:no_duration' ELSE logo_all || ':samples' END
  WHEN 'watermark.present' THEN CASE WHEN NOT logo THEN 'pass:not_required' WHEN dur IS NULL THEN 'unsupported:no_duration' ELSE logo_any || ':samples' END
  END"""
_MEASURED = """'measured=' || CASE WHEN abs(w / h - 0.5625::DOUBLE) <= 0.5625::DOUBLE * 0.05 THEN '9:16' WHEN abs(w / h - 16.0::DOUBLE / 9) <= 16.0::DOUBLE / 9 * 0.05 THEN '16:9'
       WHEN abs(w / h - 1.0::DOUBLE) <= 0.05 THEN '1:1' WHEN abs(w / h - 0.8::DOUBLE) <= 0.8::DOUBLE * 0.05 THEN '4:5' END"""
_HEARD = "[x FOR x IN string_split(coalesce(spoken, ''), ' ') IF x <> '']"
_MATCHED = (
    "array_to_string([x FOR x IN ["
    + ", ".join(
        f"CASE WHEN {_phrase(_n(text), 'hook_p')} THEN '{told}' END"
        for text, told in ((f"{_HEARD}[1]", "subtitles@0.0"), ("CASE WHEN k % 2 = 0 THEN string_split(caption, ' ')[1] END", "screen@0.5"),
                           (f"{_HEARD}[2]", "subtitles@0.8"), (f"{_HEARD}[3]", "subtitles@1.6"), (f"{_HEARD}[4]", "subtitles@2.4"))
    )
    + "] IF x IS NOT NULL], '|')"
)


def _held(terms: str, patterns: str, text: str, negated: str = "") -> str:
    return f"array_to_string([({terms})[q] FOR q IN range(1, len({patterns}) + 1) IF {negated} {_phrase(text, f'({patterns})[q]')}], '|')"


_SHOWN = f"""CASE WHEN reason = 'no_validator' THEN CASE WHEN cited THEN 'citations=' || (SELECT string_agg(quote, '|' ORDER BY position) FROM um WHERE um.contract_id = ev.contract_id AND um.rule = ev.rule_id) END
  ELSE CASE canon
  WHEN 'artifact.integrity' THEN CASE WHEN ok THEN 'sha256=' || sha256(caption) END
  WHEN 'artifact.aspect' THEN CASE WHEN ok OR reason = 'undeclared_aspect' THEN {_MEASURED} END WHEN 'layout.geometry' THEN CASE WHEN ok THEN {_MEASURED} END
  WHEN 'duration.min' THEN CASE WHEN reason IN ('', 'out_of_bounds') THEN 'duration_s=' || dur END WHEN 'duration.max' THEN CASE WHEN reason IN ('', 'out_of_bounds') THEN 'duration_s=' || dur END
  WHEN 'audio.present' THEN CASE WHEN reason = 'audio_not_verifiable' THEN 'audio_rule=' || audio_rule END
  WHEN 'audio.own_clip' THEN 'audio_rule=own_clip;platform_audio_rule=' || audio_rule WHEN 'audio.no_trending' THEN 'audio_rule=no_trending;platform_audio_rule=' || audio_rule
  WHEN 'audio.official_track' THEN 'audio_rule=official_required;platform_audio_rule=' || audio_rule
  WHEN 'audio.policy' THEN CASE WHEN ok THEN 'audio_policy=' || coalesce(policy, '') END
  WHEN 'audio.silence' THEN CASE WHEN policy IS DISTINCT FROM 'internal_official_sound' THEN 'audio_policy=' || coalesce(policy, '') END
  WHEN 'caption.required_mention' THEN CASE WHEN NOT ok THEN 'missing=' || array_to_string({_MISSING_MENTION}, '|') END
  WHEN 'caption.required_hashtag' THEN CASE WHEN NOT ok THEN 'missing=' || array_to_string({_MISSING_TAG}, '|') END
  WHEN 'caption.forbidden' THEN CASE WHEN reason = 'published' THEN 'found=' || {_held(_TERMS, _LIST, 'pub_n')} WHEN reason = 'spoken' THEN 'found=' || {_held(_TERMS, _LIST, 'spk_n')} END
  WHEN 'subtitles.spelling_lock' THEN CASE WHEN format = 'lyric_video' THEN CASE WHEN reason = lyric THEN lyric_shown END WHEN reason = 'missing' THEN 'missing=' || {_held('locks', 'locks_p', 'spk_n', 'NOT')} END
  WHEN 'hook.keyword' THEN CASE WHEN ok AND reason = '' THEN 'matched=' || {_MATCHED} END
  WHEN 'assets.required' THEN CASE WHEN NOT ok THEN 'faults=' || faults END END END"""
_APPLIES = """CASE canon WHEN 'audio.present' THEN {a}audio_rule <> 'any' WHEN 'audio.own_clip' THEN {a}audio_rule = 'own_clip' WHEN 'audio.no_trending' THEN {a}audio_rule = 'no_trending'
  WHEN 'audio.official_track' THEN {a}audio_rule = 'official_required' WHEN 'attribution.required' THEN {a}attribution <> 'none' WHEN 'link.in_bio' THEN {a}link ELSE true END"""
_GATE = f"""
{WORDS},
{",".join(LYRIC_SQL)},
ct(contract_id, format, outputs, split_w, split_h, policy, locks, locks_p, prohibitions, prohibitions_p, hook, hook_p, safety, logo) AS (VALUES {_FLAT_CONTRACTS}),
pl(contract_id, platform, audio_rule, min_s, max_s, mentions, must, tags, forbidden, forbidden_p, first_line, attribution, link) AS (VALUES {_FLAT_PLATFORMS}),
rs(contract_id, strength, ordinal, rule_id) AS (VALUES {_FLAT_RULES}),
um(contract_id, position, rule, quote) AS (VALUES {', '.join(_q((c, i, r, q)) for i, (c, r, q) in enumerate(UNMAPPED))}),
rc AS (SELECT *, CASE rule_id WHEN 'audio.official_selection' THEN 'audio.official_track' WHEN 'audio.rule' THEN 'audio.official_track' WHEN 'attribution.present' THEN 'attribution.required'
       WHEN 'link_rules.link_in_bio' THEN 'link.in_bio' ELSE rule_id END AS canon FROM rs),
ra AS (SELECT rc.contract_id, strength, ordinal, rule_id, canon, bool_or({_APPLIES.format(a='pl.')}) AS anywhere,
       bool_or(rule_id IN (SELECT rule FROM um WHERE um.contract_id = rc.contract_id)) AS cited
       FROM rc JOIN pl USING (contract_id) GROUP BY rc.contract_id, strength, ordinal, rule_id, canon),
{_PIECES_SQL},
{_SAMPLES_SQL},
{_REGISTRY_SQL},
nf AS (SELECT contract_id, string_agg(fault || ':' || n, '|' ORDER BY fault) AS faults
       FROM (SELECT doc_id % 6 AS contract_id, fault, count(*) AS n FROM _ag GROUP BY 1, 2) WHERE fault IS NOT NULL GROUP BY 1),
rows_ AS MATERIALIZED (SELECT _b.*, k % 13 <> 0 AS probed, CASE WHEN k % 11 <> 0 THEN k % 90 + 0.5::DOUBLE END AS dur, k % 17 <> 0 AS has_video, k % 5 <> 0 AS has_audio,
       CASE k % 6 WHEN 0 THEN 1080 WHEN 1 THEN 1920 WHEN 2 THEN 608 WHEN 3 THEN 1000 WHEN 5 THEN 720 END::DOUBLE AS w,
       CASE k % 6 WHEN 0 THEN 1920 WHEN 1 THEN 1080 WHEN 2 THEN 1080 WHEN 3 THEN 1000 WHEN 5 THEN 900 END::DOUBLE AS h, toxic, logo_all, logo_any,
       {_n("concat_ws(chr(10), caption, '#Clip', '#day' || (turn % 3), CASE WHEN k % 2 = 0 THEN string_split(caption, ' ')[1] ELSE '' END)")} AS pub_n,
       {_n("coalesce(spoken, '')")} AS spk_n,
       {_n("array_to_string([x FOR x IN string_split(coalesce(spoken, ''), ' ') IF x <> ''][1:4], ' ')")} AS hook_n,
       {_n("CASE WHEN k % 2 = 0 THEN string_split(caption, ' ')[1] ELSE '' END")} AS scr_n
       FROM _b LEFT JOIN labels ON labels.doc_id = _b.batch_id LEFT JOIN logos USING (piece_id)),
full_ AS (SELECT rows_.*, pl.* EXCLUDE (contract_id, platform), ct.* EXCLUDE (contract_id), faults, lyr.reason AS lyric, lyr.evidence AS lyric_shown, blank
       FROM rows_ JOIN pl USING (contract_id, platform) JOIN ct USING (contract_id) LEFT JOIN nf USING (contract_id) LEFT JOIN lyr USING (piece_id)),
dd AS (SELECT f.*, ra.strength, ra.ordinal, ra.rule_id, ra.canon, ra.anywhere, ra.cited, {_APPLIES.format(a='f.')} AS here FROM full_ f JOIN ra USING (contract_id)),
rw AS (SELECT *, coalesce({_RAW}, CASE WHEN strength = 'manual_review' OR cited THEN 'manual_review:no_validator' ELSE 'unsupported:no_validator' END) AS raw FROM dd WHERE here OR NOT anywhere),
ev AS (SELECT *, string_split(raw, ':')[1] AS status0, substr(raw, strpos(raw, ':') + 1) AS reason, string_split(raw, ':')[1] = 'pass' AS ok,
       string_split(raw, ':')[1] = 'manual_review' AND strength <> 'manual_review' AND NOT cited AND NOT here AND NOT anywhere AS orphan FROM rw),
ck AS (SELECT piece_id, CASE strength WHEN 'hard' THEN 1 WHEN 'recommended' THEN 2 ELSE 3 END AS tier, ordinal, rule_id, strength,
       CASE WHEN orphan THEN 'unsupported' ELSE status0 END AS status, reason,
       concat_ws(';', nullif(coalesce({_SHOWN}, ''), ''), CASE WHEN orphan THEN 'unclaimed=no_platform' END) AS evidence FROM ev
       UNION ALL SELECT piece_id, 4, 0, 'rules.unmapped', CASE contract_id WHEN 1 THEN 'hard' ELSE 'manual_review' END, CASE contract_id WHEN 1 THEN 'fail' ELSE 'manual_review' END,
       CASE contract_id WHEN 1 THEN 'collides_with_validator' ELSE 'unmapped' END,
       concat_ws(';', 'citations=' || (SELECT string_agg(quote, '|' ORDER BY position) FROM um WHERE um.contract_id = full_.contract_id), CASE contract_id WHEN 1 THEN 'colliding=hook.keyword' END,
         'rules=' || (SELECT string_agg(rule, '|' ORDER BY position) FROM um WHERE um.contract_id = full_.contract_id)) FROM full_ WHERE contract_id IN (1, 2)),
vd AS (SELECT piece_id, batch_id, CASE max(CASE WHEN status = 'fail' THEN 3 WHEN status = 'unsupported' THEN 2 WHEN status = 'manual_review' OR strength = 'manual_review' THEN 1 ELSE 0 END)
       WHEN 3 THEN 'rejected' WHEN 2 THEN 'unsupported' WHEN 1 THEN 'pending_review' ELSE 'passed' END AS status, count(*) AS n_checks,
       coalesce(string_agg(rule_id, ', ' ORDER BY tier, ordinal, rule_id) FILTER (status <> 'pass'), '') AS open_rules,
       bool_and(status = 'pass' OR (status = 'manual_review' AND reason <> 'no_validator')) AS signable FROM ck JOIN _b USING (piece_id) GROUP BY piece_id, batch_id),
dl AS (SELECT *, status = 'passed' OR (batch_id % 2 = 0 AND status = 'pending_review' AND signable) AS exportable FROM vd)"""

ORACLES = {
    "gate_checks": f"WITH {_GATE} SELECT piece_id, tier, ordinal, rule_id, strength, status, reason, evidence FROM ck",
    "gate_verdicts": f"WITH {_GATE} SELECT piece_id, status, n_checks, open_rules, signable FROM vd",
    "delivery_status": f"""WITH {_GATE} SELECT batch_id, count(*) FILTER (exportable) AS n_exported, count(*) FILTER (NOT exportable) AS n_rejected,
        CASE WHEN bool_and(exportable) THEN 'exported' WHEN bool_or(exportable) THEN 'partial' ELSE 'blocked' END AS batch_status, bool_and(exportable) AS published FROM dl GROUP BY batch_id""",
    "rejections": f"WITH {_GATE} SELECT piece_id, 'not approved (' || status || '): ' || open_rules AS rejection FROM dl WHERE NOT exportable",
    "undeclared_platforms": f"WITH {_PIECES_SQL} SELECT piece_id, platform FROM _b WHERE contract_id = 2 AND platform = 'x'",
    "reminders": f"""WITH {_GATE}, bb AS (SELECT DISTINCT batch_id, contract_id, platform FROM _b),
        tg(contract_id, kind, detail) AS (VALUES (0, 'geo_target', '40 ES'), (0, 'analytics_proof_required', 'proof'), (1, 'min_views_for_payout', '1000'),
            (2, 'geo_target', '10 MX'), (2, 'min_views_for_payout', '5000'))
        SELECT DISTINCT batch_id, kind, detail FROM bb JOIN tg USING (contract_id)
        UNION ALL SELECT batch_id, 'manual_review', rule_id FROM bb JOIN pl USING (contract_id, platform) JOIN ra USING (contract_id)
        WHERE strength = 'manual_review' AND (NOT anywhere OR {_APPLIES.format(a='pl.')})""",
    "duplicate_keys": "SELECT l_orderkey AS batch_id, l_partkey % 50 AS piece_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "piece_grid": """SELECT c.l_orderkey AS contract_id, c.l_returnflag AS platform, a.l_partkey AS asset_id, a.l_linenumber AS position
        FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) c JOIN lineitem a ON a.l_orderkey = c.l_orderkey AND a.l_linestatus = 'O'""",
    "asset_audit": f"WITH {_REGISTRY_SQL} SELECT doc_id % 3 AS contract_id, doc_id AS asset_id, fault FROM _af WHERE fault IS NOT NULL",
    "logo_verdicts": f"WITH {_PIECES_SQL}, {_SAMPLES_SQL} SELECT * FROM logos",
    "lyric_concordance": with_words(_HALF, _LINES, _ENDED, "w AS (SELECT * FROM half)", _CUT_LINES)
    + """, x AS (SELECT *, row_number() OVER (PARTITION BY track_id, window_id ORDER BY line_no) - 1 AS idx, (track_id + window_id) % 5 AS odd FROM cut WHERE b > a),
        s AS (SELECT track_id || '-' || window_id AS piece_id, any_value(odd) AS odd, any_value(track_id) AS t, count(*) AS n FROM x GROUP BY 1)
        SELECT piece_id, CASE WHEN odd = 1 AND t % 2 = 0 THEN 'other_count' WHEN odd = 2 AND n > 2 THEN 'start_shifted@2' WHEN odd = 3 THEN 'end_shifted@0'
            WHEN odd = 4 AND n > 1 THEN 'other_text@1' ELSE 'ok' END AS reason FROM s""",
    "loose_timing": """WITH s AS (SELECT l_orderkey AS piece_id, l_linenumber * 10 + CASE WHEN l_tax = 0.08::DOUBLE THEN -25.0 ELSE l_quantity / 10 END AS a,
            l_linenumber * 10 + l_quantity / 4 AS b, row_number() OVER w - 1 AS i FROM lineitem
            WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
        p AS (SELECT *, lag(a) OVER (PARTITION BY piece_id ORDER BY i) AS pa FROM s),
        f AS (SELECT *, CASE WHEN a >= b THEN 'reversed@' WHEN a < pa THEN 'unordered@' WHEN a < 0 THEN 'negative@' WHEN b > 60.1 AND b > 72.1 THEN 'past_window@' END || i AS fault FROM p)
        SELECT piece_id, coalesce(arg_min(fault, i), 'ok') AS reason FROM f GROUP BY piece_id""",
    "normal_text": f"SELECT conv_id, turn, {_n('text')} AS normal FROM conversations",
    "folded_mentions": f"""WITH d AS (SELECT doc_id, strip_accents(replace(lower(text), 'ß', 'ss')) AS m, {_n('text')} AS n FROM documents)
        SELECT doc_id, contains(m, 'official sound') OR contains(m, 'sonido oficial') OR contains(m, 'audio oficial') OR contains(m, 'official audio') AS official_sound,
        contains(m, 'lyric video') OR contains(m, '.lrc') OR contains(m, 'the of') AS lyric, {' OR '.join(f"contains(n, {_q(tx.fold(p))})" for p in rl.SAFETY_PHRASES)} AS safety FROM d""",
    "text_matches": f"""WITH d AS (SELECT *, {_n('text')} AS n FROM conversations),
        t AS (SELECT *, [x FOR x IN [regexp_replace(regexp_replace(y, '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+$', '') FOR y IN regexp_split_to_array(n, '[\\s_]+')] IF x <> ''] AS toks FROM d)
        SELECT conv_id, turn, {', '.join(f"{_phrase('n', _q(_pattern_of(p)))} AS p{i}" for i, p in enumerate(("of the", "año", "THE_OF", "für", "éou")))},
        regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_@])@example($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') AS mention,
        regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_#])#1($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') AS tag, role AS tag_form, len(toks) AS n_tokens, len(list_distinct(toks)) AS n_distinct,
        trim(regexp_split_to_array(text, '\\r\\n|[\\n\\r]')[1]) AS first_line, array_to_string([r FOR r IN ['user', 'system'] IF r <> role], ',') AS absent_roles FROM t""",
    "aspect_labels": """WITH g AS (SELECT (l_quantity * 20)::INT AS w, (l_partkey % 60 * 20 + 20)::INT AS h, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT w, h, n, CASE WHEN abs(w / h - 0.5625::DOUBLE) <= 0.5625::DOUBLE * 0.05 THEN '9:16' WHEN abs(w / h - 16.0::DOUBLE / 9) <= 16.0::DOUBLE / 9 * 0.05 THEN '16:9'
            WHEN abs(w / h - 1.0::DOUBLE) <= 0.05 THEN '1:1' WHEN abs(w / h - 0.8::DOUBLE) <= 0.8::DOUBLE * 0.05 THEN '4:5' ELSE w || ':' || h END AS label,
            abs(w / h - 0.5625::DOUBLE) <= 0.5625::DOUBLE * 0.05 AS vertical FROM g""",
    "sample_times": f"""WITH {_PIECES_SQL}, d AS (SELECT piece_id, k % 90 + 0.5::DOUBLE AS s, least(120, greatest(12, ceil((k % 90 + 0.5::DOUBLE) * 4)))::INT AS c FROM _b)
        SELECT piece_id, n::INT AS n, round(s * (n + 0.5::DOUBLE) / c, 6) AS at FROM d, unnest(range(0, c)) AS u(n)""",
    "logo_corners": """WITH l AS (SELECT DISTINCT (l_quantity * 6)::INT AS w, l_linenumber * 31 AS h,
            ['top_left', 'top_right', 'bottom_left', 'bottom_right', 'center', 'center_top', 'center_bottom'][l_orderkey % 7 + 1] AS zone FROM lineitem)
        SELECT w, h, zone, CASE WHEN zone LIKE '%left' THEN 20.0 WHEN zone LIKE '%right' THEN 1080 - w - 20 ELSE (1080 - w) / 2 END::DOUBLE AS x,
            CASE WHEN zone LIKE 'top%' OR zone = 'center_top' THEN 20.0 WHEN zone LIKE 'bottom%' OR zone = 'center_bottom' THEN 1920 - h - 20 ELSE (1920 - h) / 2 END::DOUBLE AS y FROM l""",
    "colours": """WITH d AS (SELECT doc_id, upper(sha256(text)[1:8]) AS x FROM documents)
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '&H00' || x[5:6] || x[3:4] || x[1:2]
            WHEN 1 THEN '&H' || printf('%02X', 255 - ('0x' || x[7:8])::INT) || x[5:6] || x[3:4] || x[1:2] WHEN 2 THEN '&H' || x END AS colour FROM d""",
}
