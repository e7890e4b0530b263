"""From extracted fields and brief text to rules, issues and a resolution status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions.clock import spoken_clock
from tessitura.functions.text import contains_any, fold, normal, normal_mentions
from tessitura.operators.gate import ALIASES
from tessitura.operators.rules import CATALOGUE, MUTED_POLICY, SAFETY_PHRASES

# Fixed values.
BLOCKING = ("missing_required", "conflict", "unresolved_asset", "invalid_contract")
SOUND_PHRASES = ("official sound", "official audio", "sonido oficial", "audio oficial")
LYRIC_PHRASES = ("lyric video", "video con letra", "letra official", "letra oficial", ".lrc")
TIME = r"(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}(?:\.[0-9]+)?"
SECONDS = r"[0-9]+(?:\.[0-9]+)?\s*s?"
RANGE = rf"(?iuU)({TIME}|{SECONDS})\s*(?:-|[–—]|\ba\b|\bal\b|\bto\b|\bhasta\b)\s*({TIME}|{SECONDS})"
CUT_WORDS = r"(?iuU)\b(?:timestamps?|cortes?|cortar\s+de(?:l)?|corte\s+de(?:l)?|minutos?|segmentos?|fragmentos?|marcas?|clip\s+from)\b"
OTHER_WORDS = r"(?iuU)\b(?:durar|duracion|duración|duration|horario|schedule|horas?)\b"
CLAUSE_END = r"[\r\n;\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]+|(?<=\S)\.\s+"
QUOTED_TIME = rf"(?U)\b((?:{TIME}|{SECONDS}))\b"
QUOTED_NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
# The fields that may be in conflict, in the order in which they are walked; * is a platform, # an index.
CONFLICT_FIELDS = (
    (
        "spelling_locks", "prohibitions", "audio_policy", "hook_keyword", "hook_window_seconds", "brand_safety", "brand_safety_required", "brand_safety_citation",
        "min_views_for_payout", "analytics_proof_required",
    ),
    (
        "platforms.*.audio_rule", "platforms.*.required_hashtags", "platforms.*.required_mentions", "platforms.*.duration.min_s", "platforms.*.duration.max_s",
        "platforms.*.caption_rules.must_mention", "platforms.*.caption_rules.first_line", "platforms.*.caption_rules.forbidden", "platforms.*.attribution.type",
        "platforms.*.attribution.value", "platforms.*.link_rules.link_in_bio",
    ),
    (
        "languages.subtitles", "languages.voice", "languages.language", "official_audio.tiktok_url", "official_audio.instagram_url", "watermark.required",
        "watermark.asset_id", "watermark.visible_full_video", "watermark.position", "watermark.scale_ratio", "watermark.opacity", "watermark.min_width_ratio",
        "rules.hard", "rules.recommended", "rules.manual_review", "geo_target.country", "geo_target.min_pct",
    ),
    ("assets.required[#].asset_id", "assets.required[#].kind", "assets.required[#].uri", "assets.required[#].origin", "assets.required[#].license"),
    ("assets.optional[#].asset_id", "assets.optional[#].kind", "assets.optional[#].uri", "assets.optional[#].origin", "assets.optional[#].license"),
    ("unmapped[#].rule", "unmapped[#].quote"),
)
PERSON_RULES = ("audio.own_clip", "audio.no_trending", "audio.policy", *[n for k, v in ALIASES.items() for n in (k, *v)])


def candidate_fault(value: Column, quote: Column, confidence: Column) -> Column:
    """First way an extracted field contradicts its own confidence, or null."""
    return (
        F.when(~F.coalesce(confidence.isin("explicit", "inferred", "missing", "conflict"), F.lit(False)), "bad_confidence")
        .when((confidence == "missing") & (value.isNotNull() | quote.isNotNull()), "missing_with_content")
        .when((confidence == "conflict") & (value.isNotNull() | quote.isNull()), "conflict_needs_quote_only")
        .when(confidence.isin("explicit", "inferred") & (value.isNull() | quote.isNull()), "value_and_quote_needed")
    )


def provenance_fault(brief: Column, quote: Column, start: Column, end: Column) -> Column:
    """First way a quote is not where it says, or null; offsets are 0-based and half open."""
    upto = F.coalesce(end, start + F.char_length(quote))
    return (
        F.when(quote.isNull(), F.lit(None).cast("string"))
        .when(~F.contains(brief, quote), "fabricated")
        .when(start.isNotNull() & ((start < 0) | (upto < start) | (upto > F.char_length(brief))), "out_of_range")
        .when(start.isNotNull() & (F.substring(brief, start + 1, upto - start) != quote), "misaligned")
    )


def provenance(candidates: DataFrame, briefs: DataFrame) -> DataFrame:
    """Per contract, whether its whole draft stands and its first fault by field order."""
    fault = provenance_fault(F.col("brief"), F.col("quote"), F.col("start"), F.col("end"))
    judged = candidates.join(briefs, "contract_id").withColumn("fault", fault)
    return judged.groupBy("contract_id").agg(
        F.count("fault").alias("n_faults"),
        (F.count("fault") == 0).alias("accepted"),
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("field_no"))).alias("first_fault"),
    )


def conflicts(candidates: DataFrame, platforms: DataFrame | None = None) -> DataFrame:
    """One issue per conflicted field of the fixed list; ``walk`` counts them per contract in walk order.

    Sections follow each other; inside one, an item (a platform or a list entry) is walked through all its fields before
    the next. Platforms come in the order of ``platforms(contract_id, platform, position)``, by name without it.
    """
    listed = [(template, section, place) for section, fields in enumerate(CONFLICT_FIELDS) for place, template in enumerate(fields)]
    templates = candidates.sparkSession.createDataFrame(listed, "template string, section int, place int")
    path = F.col("field_path")
    shaped = F.regexp_replace(F.regexp_replace(path, r"^platforms\.[^.]+\.", "platforms.*."), r"\[\d+\]", "[#]")
    found = (
        candidates.filter(F.col("confidence") == "conflict")
        .select("contract_id", F.col("field_path").alias("field"), shaped.alias("template"), F.regexp_extract(path, r"^platforms\.([^.]+)\.", 1).alias("platform"),
                F.regexp_extract(path, r"\[(\d+)\]", 1).try_cast("long").alias("item"))
        .join(templates, "template")
    )
    if platforms is not None:
        found = found.join(platforms.select("contract_id", "platform", "position"), ["contract_id", "platform"], "left").withColumn("item", F.coalesce("item", F.col("position").cast("long")))
    order = Window.partitionBy("contract_id").orderBy("section", "item", "platform", "place", "field")
    return found.select("contract_id", F.lit("conflict").alias("code"), "field", (F.row_number().over(order) - 1).alias("walk"))


def quoted_times(quote: Column) -> Column:
    """Times in a quote, in order."""
    return F.filter(F.transform(F.regexp_extract_all(quote, F.lit(QUOTED_TIME), 1), spoken_clock), lambda t: t.isNotNull())


def _near(items: Column, value: Column, tolerance: float) -> Column:
    return F.coalesce(F.exists(items, lambda t: F.abs(t - value) <= F.greatest(F.lit(tolerance), 1e-9 * F.greatest(F.abs(t), F.abs(value)))), F.lit(False))


def in_order(times: Column, start: Column, end: Column) -> Column:
    """Whether a start is followed by an end within one quote."""
    hit = F.transform(times, lambda t, i: F.when(F.abs(t - start) <= 1e-3, i))
    first = F.array_min(F.array_compact(hit))
    return F.coalesce(F.exists(F.transform(times, lambda t, i: (i > first) & (F.abs(t - end) <= 1e-3)), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def number_in_quote(quote: Column, value: Column) -> Column:
    """Whether a number stands in its own quote."""
    return _near(F.transform(F.regexp_extract_all(quote, F.lit(QUOTED_NUMBER), 1), lambda n: n.try_cast("double")), value, 1e-6)


def confidence_issue(confidence: Column) -> Column:
    """Issue code of a bound's confidence, or null."""
    text = F.lower(confidence)
    return (
        F.when(confidence.isNull() | (F.trim(confidence) == ""), "missing_required")
        .when(F.contains(text, F.lit("conflict")), "conflict")
        .when(F.contains(text, F.lit("missing")), "missing_required")
        .when(~text.isin("explicit", "inferred"), "invalid_contract")
    )


def quote_issue(quote: Column, brief: Column) -> Column:
    """Issue code of a bound's quote, or null."""
    return F.when(quote.isNull() | (F.trim(quote) == ""), "missing_required").when(~F.contains(brief, quote), "invalid_contract")


def declared_ranges(items: DataFrame, briefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, issues) of declared time ranges.

    ``items``: ``contract_id, idx`` and for both bounds ``value, quote, confidence`` (prefix ``start_``/``end_``).
    A range without one of its bounds (value, quote and confidence all null) is one issue. Of bounds that are there every
    fault of confidence and quote is an issue; later checks report the first.
    """
    s, e = spoken_clock(F.col("start_value")), spoken_clock(F.col("end_value"))
    brief = F.col("brief")
    bound_issues = F.array_compact(
        F.array(
            confidence_issue(F.col("start_confidence")), quote_issue(F.col("start_quote"), brief),
            confidence_issue(F.col("end_confidence")), quote_issue(F.col("end_quote"), brief),
        )
    )
    shared = F.trim("start_quote") == F.trim("end_quote")
    late = (
        F.when(F.col("start_value").isNull() | F.col("end_value").isNull(), "invalid_contract")
        .when(~F.coalesce((s >= 0) & (s < e), F.lit(False)), "invalid_contract")
        .when(~(_near(quoted_times(F.col("start_quote")), s, 1e-3) & _near(quoted_times(F.col("end_quote")), e, 1e-3)), "invalid_contract")
        .when(shared & ~in_order(quoted_times(F.col("start_quote")), s, e), "invalid_contract")
    )
    gone = lambda side: F.coalesce(*[F.col(f"{side}_{c}").cast("string") for c in ("value", "quote", "confidence")]).isNull()
    absent = F.when(gone("start") | gone("end"), F.array(F.lit("missing_required")))
    issues = F.when(absent.isNotNull(), absent).when(F.size(bound_issues) > 0, bound_issues).otherwise(F.array_compact(F.array(late)))
    judged = items.join(briefs, "contract_id").withColumn("issues", issues).withColumn("start_s", s).withColumn("end_s", e)
    ranges = judged.filter(F.size("issues") == 0).select("contract_id", F.col("idx").cast("long").alias("idx"), "start_s", "end_s")
    return ranges, judged.select("contract_id", F.explode("issues").alias("code"), F.lit("timestamp_ranges").alias("field"))


def text_ranges(briefs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, issues) named in free text: only clauses about cuts, not about length or schedule."""
    clauses = briefs.select("contract_id", F.posexplode(F.split("brief", CLAUSE_END)).alias("clause_no", "clause")).filter(
        F.col("clause").rlike(CUT_WORDS) & ~F.col("clause").rlike(OTHER_WORDS)
    )
    pairs = F.arrays_zip(
        F.regexp_extract_all("clause", F.lit(RANGE), 1).alias("a"), F.regexp_extract_all("clause", F.lit(RANGE), 2).alias("b")
    )
    found = (
        clauses.select("contract_id", "clause_no", F.posexplode(pairs).alias("pair_no", "p"))
        .select("contract_id", "clause_no", "pair_no", spoken_clock(F.col("p.a")).alias("start_s"), spoken_clock(F.col("p.b")).alias("end_s"))
        .filter(F.col("start_s").isNotNull() & F.col("end_s").isNotNull())
    )
    ranges = (
        found.filter(F.col("start_s") < F.col("end_s"))
        .groupBy("contract_id", "start_s", "end_s")
        .agg(F.min(F.shiftleft(F.col("clause_no").cast("long"), 32) + F.col("pair_no")).alias("idx"))
        .select("contract_id", "idx", "start_s", "end_s")
    )
    issues = found.filter(F.col("start_s") >= F.col("end_s")).select(
        "contract_id", F.lit("invalid_contract").alias("code"), F.lit("timestamp_ranges").alias("field")
    )
    return ranges, issues


def resolved_ranges(items: DataFrame, briefs: DataFrame, earlier_issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared ranges, or those of the text for a contract with no range and no issue of any kind so far."""
    ranges, issues = declared_ranges(items, briefs)
    blocked = ranges.select("contract_id").union(issues.select("contract_id")).union(earlier_issues.select("contract_id")).distinct()
    free = briefs.join(blocked, "contract_id", "left_anti")
    spoken, spoken_issues = text_ranges(free)
    return ranges.unionByName(spoken), issues.unionByName(spoken_issues)


def resolved_segments(items: DataFrame, contracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, issues) of long-video contracts. ``items``: ``contract_id, idx, start_s, end_s, start_confidence, end_confidence``."""
    long_ones = contracts.filter(F.col("mode") == "long_video").select("contract_id")
    mine = items.join(long_ones, "contract_id", "left_semi")
    clash = F.array_compact(
        F.array(
            F.when(F.col("start_confidence") == "conflict", F.struct(F.lit("conflict").alias("code"), F.concat(F.lit("segments["), F.col("idx").cast("string"), F.lit("].start_s")).alias("field"))),
            F.when(F.col("end_confidence") == "conflict", F.struct(F.lit("conflict").alias("code"), F.concat(F.lit("segments["), F.col("idx").cast("string"), F.lit("].end_s")).alias("field"))),
        )
    )
    code = F.when(F.col("start_s").isNull() | F.col("end_s").isNull(), "missing_required").when(
        ~((F.col("start_s") >= 0) & (F.col("end_s") > F.col("start_s"))), "invalid_contract"
    )
    single = F.when(code.isNotNull(), F.array(F.struct(code.alias("code"), F.concat(F.lit("segments["), F.col("idx").cast("string"), F.lit("]")).alias("field"))))
    judged = mine.withColumn("issues", F.when(F.size(clash) > 0, clash).otherwise(F.coalesce(single, F.array().cast("array<struct<code:string,field:string>>"))))
    none = long_ones.join(items.select("contract_id").distinct(), "contract_id", "left_anti").select(
        "contract_id", F.lit("missing_required").alias("code"), F.lit("segments").alias("field")
    )
    issues = judged.select("contract_id", F.explode("issues").alias("i")).select("contract_id", "i.code", "i.field").unionByName(none)
    return judged.filter(F.size("issues") == 0).select("contract_id", "idx", "start_s", "end_s"), issues


def _ids(*cases: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(rule)) for condition, rule in cases]))


def filled(column: str) -> Column:
    """Whether an array holds anything."""
    return F.coalesce(F.size(column) > 0, F.lit(False))


def logo_rule() -> Column:
    """Which logo rule a contract needs, if any."""
    return F.when(F.col("watermark_required"), F.when(F.col("watermark_full"), "watermark.full_video").otherwise("watermark.present"))


def active_restrictions(platforms: DataFrame, contracts: DataFrame) -> DataFrame:
    """Rule ids every platform of a contract switches on, the contract-wide ones included."""
    rows = platforms.join(contracts, "contract_id")
    own = _ids(
        (F.col("min_s").isNotNull(), "duration.min"),
        (F.col("max_s").isNotNull(), "duration.max"),
        (F.col("first_line").isNotNull(), "caption.first_line"),
        (filled("forbidden") | filled("prohibitions"), "caption.forbidden"),
        (filled("must_mention") | filled("required_mentions"), "caption.required_mention"),
        (filled("required_hashtags"), "caption.required_hashtag"),
        (F.col("audio_rule") == "official_required", "audio.official_track"),
        (F.col("audio_rule") == "own_clip", "audio.own_clip"),
        (F.col("audio_rule") == "no_trending", "audio.no_trending"),
        (F.col("attribution_type") != "none", "attribution.required"),
        (F.col("link_in_bio"), "link.in_bio"),
    )
    wide = _ids(
        (F.col("has_required_assets"), "assets.required"),
        (logo_rule() == "watermark.full_video", "watermark.full_video"),
        (logo_rule() == "watermark.present", "watermark.present"),
        (filled("spelling_locks"), "subtitles.spelling_lock"),
        (F.coalesce(F.col("hook_keyword") != "", F.lit(False)), "hook.keyword"),
        (F.col("audio_policy") == MUTED_POLICY, "audio.policy"),
        (F.col("audio_policy") == MUTED_POLICY, "audio.silence"),
        (F.col("brand_safety_required"), "brand.safety"),
    )
    return rows.select("contract_id", "platform", F.explode(F.concat(own, wide)).alias("rule_id"))


def base_rules(contracts: DataFrame, platforms: DataFrame) -> DataFrame:
    """Rules that are always hard for a contract of its kind."""
    heard = platforms.groupBy("contract_id").agg(F.max(F.col("audio_rule") != "any").alias("_audio"))
    ids = _ids(
        (F.lit(True), "artifact.integrity"),
        (F.lit(True), "artifact.aspect"),
        (F.col("format").isin("video", "lyric_video"), "artifact.video_stream"),
        (F.col("format") == "lyric_video", "subtitles.spelling_lock"),
        (F.col("_audio"), "audio.present"),
        (F.col("has_required_assets"), "assets.required"),
        (logo_rule() == "watermark.full_video", "watermark.full_video"),
        (logo_rule() == "watermark.present", "watermark.present"),
        (F.col("has_split"), "layout.geometry"),
    )
    return contracts.join(heard, "contract_id", "left").select("contract_id", F.explode(ids).alias("rule_id"))


def mentions_safety(brief: Column, prohibitions: Column) -> Column:
    """Whether brief or prohibitions speak of brand safety. ``prohibitions`` is one joined text."""
    return contains_any(normal(F.concat_ws(" ", prohibitions, brief)), [fold(p) for p in SAFETY_PHRASES])


def mentions_sound(brief: Column) -> Column:
    """Whether a brief speaks of the official sound."""
    return contains_any(normal_mentions(brief), SOUND_PHRASES)


def mentions_lyrics(brief: Column) -> Column:
    """Whether a brief speaks of a lyric video."""
    return contains_any(normal_mentions(brief), LYRIC_PHRASES)


def classified_rules(
    declared: DataFrame, contracts: DataFrame, platforms: DataFrame, unmapped: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(rules, issues): base rules forced hard, everything active but unclassified given a strength.

    ``declared``: ``contract_id, strength, rule_id``. ``contracts`` carries ``brief`` beside its settings.
    The first step that classifies a rule keeps it.
    """
    base = base_rules(contracts, platforms).withColumn("_base", F.lit(True))
    marked = declared.join(base, ["contract_id", "rule_id"], "left")
    moved = marked.filter(F.col("_base") & F.col("strength").isin("recommended", "manual_review")).select(
        "contract_id", "rule_id", F.lit("base_forced_hard").alias("detail")
    )
    kept = marked.filter(F.col("_base").isNull() | (F.col("strength") == "hard")).select("contract_id", "strength", "rule_id")
    official = platforms.groupBy("contract_id").agg(F.max(F.col("audio_rule") == "official_required").alias("_official"))
    facts = contracts.join(official, "contract_id", "left").select(
        "contract_id",
        (F.col("audio_policy").isNull() & (F.coalesce("_official", F.lit(False)) | mentions_sound(F.col("brief")))).alias("_policy"),
        (F.coalesce("brand_safety_required", F.lit(False)) | mentions_safety(F.col("brief"), F.array_join("prohibitions", " "))).alias("_safety"),
    )
    person = F.col("rule_id").isin(*PERSON_RULES)
    steps = (
        facts.filter("_policy").select("contract_id", F.lit("audio.policy").alias("rule_id"), F.lit(1).alias("step"), F.lit("manual_review").alias("strength"))
        .unionByName(
            active_restrictions(platforms, contracts).select(
                "contract_id", "rule_id", F.lit(2).alias("step"), F.when(person, "manual_review").otherwise("hard").alias("strength")
            )
        )
        .unionByName(facts.filter("_safety").select("contract_id", F.lit("brand.safety").alias("rule_id"), F.lit(3).alias("step"), F.lit("hard").alias("strength")))
        .unionByName(unmapped.select("contract_id", F.col("rule").alias("rule_id"), F.lit(4).alias("step"), F.lit("manual_review").alias("strength")))
    )
    added = (
        steps.join(declared.select("contract_id", "rule_id").distinct(), ["contract_id", "rule_id"], "left_anti")
        .groupBy("contract_id", "rule_id")
        .agg(F.min_by("strength", "step").alias("strength"), F.min("step").alias("step"))
    )
    rules = (
        kept.unionByName(base.select("contract_id", F.lit("hard").alias("strength"), "rule_id"))
        .unionByName(added.select("contract_id", "strength", "rule_id"))
        .distinct()
    )
    names = F.element_at(F.array(*[F.lit(x) for x in ("policy_review", "restriction_defaulted", "safety_defaulted", "unmapped_review")]), F.col("step"))
    return rules, moved.unionByName(added.select("contract_id", "rule_id", names.alias("detail")))


def resolution_status(contracts: DataFrame, issues: DataFrame) -> DataFrame:
    """Resolved, manual review or a new archetype. ``contracts``: ``contract_id, mode, format, brief``."""
    seen = issues.groupBy("contract_id").agg(
        F.max(F.col("code") == "conflict").alias("_conflict"), F.max(F.col("code").isin(*BLOCKING)).alias("_blocked"), F.count(F.lit(1)).alias("n_issues")
    )
    shape = F.coalesce("format", F.when(mentions_lyrics(F.col("brief")), "lyric_video"))
    unknown = F.col("mode").isNull() | F.col("_format").isNull()
    return (
        contracts.withColumn("_format", shape)
        .join(seen, "contract_id", "left")
        .select(
            "contract_id",
            F.col("_format").alias("format"),
            F.coalesce("n_issues", F.lit(0)).alias("n_issues"),
            F.when(unknown & F.coalesce("_conflict", F.lit(False)), "manual_review")
            .when(unknown, "new_archetype")
            .when(F.coalesce("_blocked", F.lit(False)), "manual_review")
            .otherwise("resolved")
            .alias("status"),
        )
    )


def campaign_route(archetype: Column, variations: Column) -> Column:
    """State of a classified campaign; variations belong to the middle archetype and to it alone."""
    varied = F.coalesce(F.size(variations) > 0, F.lit(False))
    return (
        F.when((archetype == "known_with_variation") != varied, "invalid")
        .when(archetype == "new_archetype", "manual_review")
        .when(archetype == "known_with_variation", "pending")
        .otherwise("classified")
    )


def split_quote_faults(drafts: DataFrame) -> DataFrame:
    """Split-screen fields not backed by their own quote. ``drafts``: ``contract_id, field, value, quote`` of declared fields."""
    value = F.col("value").try_cast("double")
    backed = (
        F.when(F.col("field").isin("top_source", "bottom_source"), F.contains("quote", F.col("value")))
        .when(F.col("field") == "panel_ratio", number_in_quote(F.col("quote"), value) | number_in_quote(F.col("quote"), value * 100))
        .otherwise(number_in_quote(F.col("quote"), value))
    )
    return drafts.filter(~F.coalesce(backed, F.lit(False))).select("contract_id", "field")


def resolved_assets(drafts: DataFrame, registry: DataFrame) -> DataFrame:
    """Issue code of every asset draft, or null. ``drafts``: ``slot`` is required or optional; conflicts are flagged per field."""
    names = ("asset_id", "kind", "uri", "origin")
    empty = {n: F.coalesce(F.col(n) == "", F.lit(True)) for n in names}
    lacking = F.filter(F.array(*[F.when(empty[n] & ~F.array_contains("conflicted", n), n) for n in names]), lambda x: x.isNotNull())
    unusable = empty["asset_id"] | empty["kind"] | empty["uri"] | empty["origin"]
    known = registry.select("asset_id", F.col("uri").alias("_uri"))
    dropped = F.when(F.col("slot") == "optional", "optional_asset_dropped")
    code = F.when(unusable & (F.size(lacking) > 0), F.coalesce(dropped, F.lit("missing_required"))).when(
        ~unusable & F.col("_uri").isNotNull() & (F.col("_uri") != F.col("uri")), F.coalesce(dropped, F.lit("unresolved_asset"))
    )
    return drafts.join(known, "asset_id", "left").select("contract_id", "slot", "idx", code.alias("code"), (~unusable & code.isNull()).alias("kept"))


def safety_chain(rows: DataFrame) -> DataFrame:
    """Whether brand safety is required, its citation, and the prohibitions with a safety phrase in them."""
    required = (
        F.coalesce("required_value", F.lit(False)) | F.coalesce("safety_value", F.lit(False)) | mentions_safety(F.col("brief"), F.array_join("prohibitions", " "))
    )
    citation = F.coalesce("citation", F.when(F.col("needed"), F.coalesce("required_quote", "safety_quote", "prohibitions_quote", F.get("prohibitions", F.lit(0)))))
    phrased = contains_any(normal(F.array_join("prohibitions", " ")), [fold(p) for p in SAFETY_PHRASES])
    return rows.withColumn("needed", required).select(
        "contract_id",
        "needed",
        citation.alias("citation"),
        F.when(F.col("needed") & ~phrased, F.concat("prohibitions", F.array(F.lit("brand safety")))).otherwise(F.col("prohibitions")).alias("prohibitions"),
    )


def contract_violations(contracts: DataFrame, platforms: DataFrame, rules: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Every invariant a contract breaks, in fixed order."""
    known = [r.lower() for r in CATALOGUE]
    official = platforms.groupBy("contract_id").agg(F.max(F.col("audio_rule") == "official_required").alias("_official"))
    clash = unmapped.groupBy("contract_id").agg(F.max(F.lower(F.trim("rule")).isin(*known)).alias("_clash"))
    accepted = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in (k, *v)]))])
    named = rules.groupBy("contract_id").agg(F.collect_set("rule_id").alias("_named"))
    loose = (
        active_restrictions(platforms, contracts)
        .join(named, "contract_id", "left")
        .withColumn("_ok", F.arrays_overlap(F.coalesce(accepted[F.col("rule_id")], F.array("rule_id")), F.coalesce("_named", F.array().cast("array<string>"))))
        .groupBy("contract_id")
        .agg(F.max(~F.col("_ok")).alias("_loose"))
    )
    checks = (
        ((F.col("mode") == "slideshow") != (F.col("format") == "slideshow"), "mode_format"),
        (F.size("outputs") != F.size(F.array_distinct("outputs")), "repeated_outputs"),
        ((F.col("schema_version") == "1.1") & (F.array_join("outputs", ",") != "9:16"), "outputs_need_1_2"),
        (F.col("split_aspect").isNotNull() & (F.size("outputs") > 1), "split_with_many_outputs"),
        (F.col("split_aspect").isNotNull() & (F.size("outputs") == 1) & (F.col("split_aspect") != F.get("outputs", F.lit(0))), "split_aspect"),
        (F.col("hook_keyword").isNotNull() & (F.trim("hook_keyword") == ""), "blank_hook"),
        (F.col("_clash"), "unmapped_collides"),
        ((F.col("mode") == "audio_locked") & (F.col("audio_policy") == MUTED_POLICY), "policy_mode"),
        (F.col("_official") & ~F.col("has_official_audio"), "official_audio_missing"),
        (F.col("_loose"), "restriction_unclassified"),
        (F.col("brand_safety_required") & (F.trim(F.coalesce("brand_safety_citation", F.lit(""))) == ""), "safety_uncited"),
        ((F.col("mode") == "long_video") != (F.col("n_segments") > 0), "segments_mode"),
    )
    return (
        contracts.join(official, "contract_id", "left").join(clash, "contract_id", "left").join(loose, "contract_id", "left")
        .select("contract_id", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks])).alias("violations"))
    )


def default_contracts(campaigns: DataFrame, platform: str = "tiktok", language: str = "es") -> DataFrame:
    """The contract of a campaign without a brief: integrity, shape, video and a three-second floor."""
    return campaigns.filter(F.col("campaign_id") != "").select(
        F.col("campaign_id").alias("contract_id"), F.lit("video").alias("format"), F.lit("repost_ugc").alias("mode"), F.lit(platform).alias("platform"),
        F.lit(3.0).alias("min_s"), F.lit(None).cast("double").alias("max_s"), F.lit("any").alias("audio_rule"), F.lit("original_audio").alias("audio_policy"),
        F.lit(language).alias("language"), F.lit(False).alias("watermark_required"), F.lit(False).alias("brand_safety_required"),
        F.array(*[F.lit(r) for r in ("artifact.aspect", "artifact.integrity", "artifact.video_stream", "duration.min")]).alias("hard"),
    )


def expected_names(paths: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """Files that are not one of the expected recorded kinds."""
    fits = F.lit(False)
    for suffix in suffixes:
        fits = fits | F.col("file_id").endswith(suffix)
    return paths.filter(F.col("file_id").endswith(".json") & ~fits)
