"""The rule catalogue: each rule is one column expression over a joined piece row.

A row carries the piece, its platform's rules, its contract and what was measured or judged
elsewhere. Null always means "not measured" and never reads as a pass.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.functions.text import (
    contains_any,
    first_line,
    fold,
    has_hashtag,
    has_mention,
    hashtag,
    normal,
    normal_each,
    phrase_pattern_column,
)

Rule = Callable[[], Column]

# Fixed values.
PASS, FAIL, MANUAL, UNSUPPORTED = "pass", "fail", "manual_review", "unsupported"
ASPECTS = (("9:16", 9.0 / 16.0), ("16:9", 16.0 / 9.0), ("1:1", 1.0), ("4:5", 4.0 / 5.0))
ASPECT_TOLERANCE = 0.05
SILENCE_DB = -80.0
HOOK_WINDOW_S = 3.0
MUTED_POLICY = "internal_official_sound"
UNVALIDATED = "no_validator"
SAFETY_PHRASES = (
    "controvers",
    "polemic",
    "brand safety",
    "seguridad de marca",
    "toxic",
    "sin groserias",
    "contenido apto para marcas",
    "apto para todo publico",
    "family friendly",
    "nada de lenguaje ofensivo",
    "sin lenguaje ofensivo",
    "sin insultos",
    "no insultos",
    "no profanity",
    "sin malas palabras",
    "malas palabras",
    "prohibido contenido nsfw",
    "nsfw",
    "sin temas sensibles",
    "temas sensibles",
    "no politica ni religion",
    "no contenido para adultos",
    "contenido para adultos",
)


def outcome(status: str | Column, reason: str | Column | None = None, **evidence: Column) -> Column:
    """A check's status, reason and evidence map."""
    shown = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        (F.lit(status) if isinstance(status, str) else status).alias("status"),
        (F.lit(reason).cast("string") if not isinstance(reason, Column) else reason).alias("reason"),
        (F.create_map(*shown) if shown else F.create_map().cast("map<string,string>")).alias("evidence"),
    )


def first_of(*cases: tuple[Column, Column], otherwise: Column) -> Column:
    """The first case whose condition is true; null conditions are false."""
    chosen = otherwise
    for condition, value in reversed(cases):
        chosen = F.when(F.coalesce(condition, F.lit(False)), value).otherwise(chosen)
    return chosen


def joined(items: Column) -> Column:
    """Array as evidence text."""
    return F.array_join(items, "|")


def aspect_matches(width: Column, height: Column, target: Column | float, tolerance: Column | float = ASPECT_TOLERANCE) -> Column:
    """Relative comparison of a measured shape with a target ratio."""
    goal = target if isinstance(target, Column) else F.lit(target)
    return F.abs(width / height - goal) <= goal * tolerance


def aspect_ratio(label: Column) -> Column:
    """Ratio of a declared aspect label."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ASPECTS))[label]


def aspect_label(width: Column, height: Column, tolerance: Column | float = ASPECT_TOLERANCE) -> Column:
    """First known aspect that matches, else the plain pair."""
    chosen = F.concat_ws(":", width.cast("string"), height.cast("string"))
    for label, ratio in reversed(ASPECTS):
        chosen = F.when(aspect_matches(width, height, ratio, tolerance), F.lit(label)).otherwise(chosen)
    return chosen


def _sized() -> Column:
    return (F.col("width") > 0) & (F.col("height") > 0)


def _unprobed() -> tuple[Column, Column]:
    return ~F.coalesce("probed", F.lit(False)), outcome(UNSUPPORTED, "not_probed")


def artifact_integrity() -> Column:
    return first_of((F.col("artifact_sha256").isNull(), outcome(FAIL, "artifact_missing")), otherwise=outcome(PASS, sha256=F.col("artifact_sha256")))


def artifact_video_stream() -> Column:
    return first_of(
        (F.col("format") != "video", outcome(UNSUPPORTED, "not_a_video_format")),
        _unprobed(),
        (F.col("has_video"), outcome(PASS)),
        otherwise=outcome(FAIL, "no_video"),
    )


def artifact_aspect() -> Column:
    measured = aspect_label(F.col("width"), F.col("height"), F.col("aspect_tolerance"))
    fits = F.exists("outputs", lambda o: aspect_matches(F.col("width"), F.col("height"), aspect_ratio(o), F.col("aspect_tolerance")))
    return first_of(
        _unprobed(),
        (~F.col("has_video"), outcome(FAIL, "no_video")),
        (~F.coalesce(_sized(), F.lit(False)), outcome(UNSUPPORTED, "no_dimensions")),
        (fits, outcome(PASS, measured=measured)),
        otherwise=outcome(FAIL, "undeclared_aspect", measured=measured),
    )


def layout_geometry() -> Column:
    measured = aspect_label(F.col("width"), F.col("height"), F.col("aspect_tolerance"))
    same = (F.col("width") == F.col("split.width")) & (F.col("height") == F.col("split.height"))
    fits = aspect_matches(F.col("width"), F.col("height"), aspect_ratio(F.col("split.aspect")), F.col("aspect_tolerance"))
    return first_of(
        (F.col("split").isNull(), outcome(FAIL, "split_undeclared")),
        _unprobed(),
        (~F.col("has_video"), outcome(FAIL, "no_video")),
        (~F.coalesce(_sized(), F.lit(False)), outcome(UNSUPPORTED, "no_dimensions")),
        (~same, outcome(FAIL, "other_dimensions")),
        (~fits, outcome(FAIL, "other_aspect", measured=measured)),
        otherwise=outcome(PASS, measured=measured),
    )


def _duration(bound: str, within: Column) -> Column:
    return first_of(
        _unprobed(),
        (F.col(bound).isNull(), outcome(PASS, "no_bound")),
        (F.col("duration_s").isNull(), outcome(UNSUPPORTED, "no_duration")),
        (within, outcome(PASS, duration_s=F.col("duration_s"))),
        otherwise=outcome(FAIL, "out_of_bounds", duration_s=F.col("duration_s")),
    )


def duration_min() -> Column:
    return _duration("min_s", F.col("duration_s") >= F.col("min_s"))


def duration_max() -> Column:
    return _duration("max_s", F.col("duration_s") <= F.col("max_s"))


def audio_present() -> Column:
    return first_of(
        (F.col("audio_rule").isin("official_required", "no_trending"), outcome(MANUAL, "audio_not_verifiable", audio_rule=F.col("audio_rule"))),
        (F.col("audio_rule") == "any", outcome(UNSUPPORTED, "audio_not_required")),
        _unprobed(),
        (F.col("has_audio"), outcome(PASS)),
        otherwise=outcome(FAIL, "no_audio"),
    )


def _audio_review(expected: str) -> Rule:
    return lambda: outcome(MANUAL, "person_decides", audio_rule=F.lit(expected), platform_audio_rule=F.col("audio_rule"))


def audio_policy() -> Column:
    return first_of((F.col("audio_policy") == MUTED_POLICY, outcome(MANUAL, "approval_needed")), otherwise=outcome(PASS, audio_policy=F.col("audio_policy")))


def audio_silence() -> Column:
    return first_of(
        (~F.coalesce(F.col("audio_policy") == MUTED_POLICY, F.lit(False)), outcome(PASS, audio_policy=F.col("audio_policy"))),
        (F.col("audio_tracks").isNull(), outcome(UNSUPPORTED, "tracks_not_counted")),
        (F.col("audio_tracks") != 1, outcome(FAIL, "not_one_track")),
        (F.col("max_volume_db").isNull() | F.isnan("max_volume_db"), outcome(UNSUPPORTED, "volume_not_measured")),
        (F.col("max_volume_db") <= SILENCE_DB, outcome(PASS)),
        otherwise=outcome(FAIL, "audible"),
    )


def _listing(missing: Column) -> Column:
    return first_of((F.size(missing) > 0, outcome(FAIL, "missing", missing=joined(missing))), otherwise=outcome(PASS))


def required_mention() -> Column:
    needed = F.concat("required_mentions", "must_mention")
    return _listing(F.filter(needed, lambda m: ~has_mention(F.col("caption"), m)))


def required_hashtag() -> Column:
    held = F.transform("hashtags", hashtag)
    return _listing(F.filter("required_hashtags", lambda t: ~F.array_contains(held, hashtag(t)) & ~has_hashtag(F.col("caption"), t)))


def found_terms(text: Column, terms: Column, patterns: Column) -> Column:
    """Terms whose phrase pattern occurs in normal text, in declared order."""
    pairs = F.filter(F.arrays_zip(terms.alias("term"), patterns.alias("pattern")), lambda p: F.coalesce(F.regexp_like(text, p["pattern"]), F.lit(False)))
    return F.transform(pairs, lambda p: p["term"])


def caption_forbidden() -> Column:
    published = found_terms(F.col("published_n"), F.col("forbidden_all"), F.col("forbidden_p"))
    spoken = found_terms(F.col("spoken_n"), F.col("forbidden_all"), F.col("forbidden_p"))
    return first_of(
        (F.size(published) > 0, outcome(FAIL, "published", found=joined(published))),
        (F.size(spoken) > 0, outcome(MANUAL, "spoken", found=joined(spoken))),
        otherwise=outcome(PASS),
    )


def caption_first_line() -> Column:
    wanted = F.regexp_replace("first_line", r"(?U)^\s+|\s+$", "")
    return first_of(
        (F.col("first_line").isNull(), outcome(PASS, "not_required")),
        (F.contains(first_line(F.col("caption")), wanted), outcome(PASS)),
        otherwise=outcome(FAIL, "first_line_absent"),
    )


def spelling_lock() -> Column:
    lyric = F.col("format") == "lyric_video"
    blank = F.col("subtitle_text").isNull() | (F.col("spoken_n") == "") | (F.coalesce(F.size("segments"), F.lit(0)) <= 0)
    held = found_terms(F.col("spoken_n"), F.col("spelling_locks"), F.col("locks_p"))
    missing = F.array_except("spelling_locks", held)
    return first_of(
        (lyric & blank, outcome(FAIL, "no_synced_subtitles")),
        (~lyric & (F.size("spelling_locks") == 0), outcome(PASS, "no_locks")),
        (F.col("subtitle_text").isNull(), outcome(UNSUPPORTED, "no_subtitles")),
        (F.size(missing) > 0, outcome(FAIL, "missing", missing=joined(missing))),
        (lyric & F.col("lyric").isNotNull(), F.struct(F.lit(FAIL).alias("status"), F.col("lyric.reason").alias("reason"), F.col("lyric.evidence").alias("evidence"))),
        otherwise=outcome(PASS),
    )


def assets_required() -> Column:
    return first_of(
        (F.col("asset_faults").isNotNull() & (F.size("asset_faults") > 0), outcome(FAIL, "asset_faults", faults=joined(F.col("asset_faults")))),
        otherwise=outcome(PASS),
    )


def suffix_hit(texts: Column, pattern: Column) -> Column:
    """Index of the last suffix whose joined text holds the pattern, or null."""
    places = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(texts) - 1, F.lit(0))),
        lambda i: F.coalesce(F.regexp_like(F.array_join(F.filter(F.slice(texts, i + 1, F.size(texts)), lambda t: t != ""), " "), pattern), F.lit(False)),
    )
    return F.when(F.size(texts) > 0, F.get(places, F.size(places) - 1))


def hook_hits(starts: Column, texts: Column, pattern: Column, source: str) -> Column:
    """Times of the keyword within one source's opening segments, direct hits before suffix ones."""
    zipped = F.arrays_zip(starts.alias("at"), texts.alias("text"))
    direct = F.transform(F.filter(zipped, lambda z: F.coalesce(F.regexp_like(z["text"], pattern), F.lit(False))), lambda z: z["at"])
    late = suffix_hit(texts, pattern)
    found = F.when(F.size(direct) > 0, direct).when(late.isNotNull(), F.array(F.get(starts, late))).otherwise(F.array().cast("array<double>"))
    return F.transform(found, lambda at: F.struct(at.alias("at"), F.lit(source).alias("source")))


def hook_keyword() -> Column:
    pattern = F.col("hook_p")
    hits = F.array_sort(
        F.array_distinct(
            F.concat(
                hook_hits(F.col("hook_sub_at"), F.col("hook_sub_n"), pattern, "subtitles"),
                hook_hits(F.col("hook_screen_at"), F.col("hook_screen_n"), pattern, "screen"),
            )
        )
    )
    return first_of(
        (F.col("hook_keyword").isNull(), outcome(PASS, "not_required")),
        (pattern.isNull(), outcome(FAIL, "keyword_blank")),
        (F.size(hits) > 0, outcome(PASS, matched=joined(F.transform(hits, lambda h: F.concat(h["source"], F.lit("@"), F.round(h["at"], 3).cast("string")))))),
        otherwise=outcome(FAIL, "not_in_opening"),
    )


def brand_safety() -> Column:
    needed = F.coalesce("brand_safety_required", F.lit(False)) | contains_any(F.col("prohibitions_n"), [fold(p) for p in SAFETY_PHRASES])
    return first_of(
        (~needed, outcome(PASS, "not_required")),
        (F.col("assessment").isNull(), outcome(MANUAL, "no_assessor")),
        (F.col("assessment.risk").isNull(), outcome(MANUAL, "bad_assessment")),
        (F.col("assessment.risk"), outcome(MANUAL, "risk")),
        otherwise=outcome(PASS, "no_risk"),
    )


def _logo(column: str) -> Rule:
    def check() -> Column:
        return first_of(
            (~F.coalesce("watermark_required", F.lit(False)), outcome(PASS, "not_required")),
            (F.coalesce(F.col("duration_s") <= 0, F.lit(True)), outcome(UNSUPPORTED, "no_duration")),
            (F.col(column).isNull(), outcome(UNSUPPORTED, "no_samples")),
            otherwise=outcome(F.col(column), "samples"),
        )

    return check


CATALOGUE: dict[str, Rule] = {
    "artifact.aspect": artifact_aspect,
    "artifact.integrity": artifact_integrity,
    "artifact.video_stream": artifact_video_stream,
    "assets.required": assets_required,
    "audio.present": audio_present,
    "audio.policy": audio_policy,
    "audio.own_clip": _audio_review("own_clip"),
    "audio.no_trending": _audio_review("no_trending"),
    "audio.official_track": _audio_review("official_required"),
    "audio.silence": audio_silence,
    "brand.safety": brand_safety,
    "caption.first_line": caption_first_line,
    "caption.forbidden": caption_forbidden,
    "caption.required_hashtag": required_hashtag,
    "caption.required_mention": required_mention,
    "duration.max": duration_max,
    "duration.min": duration_min,
    "hook.keyword": hook_keyword,
    "layout.geometry": layout_geometry,
    "subtitles.spelling_lock": spelling_lock,
    "watermark.full_video": _logo("logo_all"),
    "watermark.present": _logo("logo_any"),
}


def with_term_patterns(terms: DataFrame) -> DataFrame:
    """Adds normal forms and patterns of the terms of platforms and contracts, in declared order."""
    patterns = lambda c: F.transform(normal_each(F.col(c)), phrase_pattern_column)
    staged = terms.select(
        "*",
        F.array_distinct(F.concat("forbidden", "prohibitions")).alias("forbidden_all"),
        normal(F.array_join("prohibitions", " ")).alias("prohibitions_n"),
        normal(F.col("hook_keyword")).alias("_hook_n"),
    )
    return staged.select(
        "*", patterns("forbidden_all").alias("forbidden_p"), patterns("spelling_locks").alias("locks_p"), phrase_pattern_column(F.col("_hook_n")).alias("hook_p")
    ).drop("_hook_n")


def with_normal_text(rows: DataFrame) -> DataFrame:
    """Adds every normal form of a piece's own texts that the catalogue reads, once per row and outside the rules."""
    opening = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)), lambda s: s["start_s"] <= HOOK_WINDOW_S)
    published = F.concat_ws(
        "\n", "caption", F.array_join("hashtags", "\n"), F.array_join(F.transform("screen", lambda s: s["text"]), "\n")
    )
    return rows.select(
        "*",
        normal(published).alias("published_n"),
        normal(F.coalesce("subtitle_text", F.lit(""))).alias("spoken_n"),
        F.transform(opening("segments"), lambda s: s["start_s"]).alias("hook_sub_at"),
        normal_each(F.transform(opening("segments"), lambda s: s["text"])).alias("hook_sub_n"),
        F.transform(opening("screen"), lambda s: s["start_s"]).alias("hook_screen_at"),
        normal_each(F.transform(opening("screen"), lambda s: s["text"])).alias("hook_screen_n"),
    )
