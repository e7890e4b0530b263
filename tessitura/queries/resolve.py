"""Contract resolution from extracted fields and brief text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.operators import resolve as op
from tessitura.sources.briefs import ingest_texts
from tessitura.sources.tables import table


def clock(seconds) -> F.Column:
    """``M:SS`` of whole seconds."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("long"), (seconds % 60).cast("long"))


def briefs(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts, some with a line about cuts, lengths, sound or lyrics."""
    i = F.col("item_id")
    a, b = i * 7 % 200, i * 7 % 200 + i % 5 * 10
    cuts = F.concat(F.lit("\nCortes: "), clock(a), F.lit(" - "), clock(b), F.lit("; segmento "), (i % 30).cast("string"), F.lit("s a "), (i % 30 + 4.5).cast("string"), F.lit("s"))
    return table(spark, folder, "benchmark").select(
        i.alias("contract_id"),
        F.concat(
            "text", F.when(i % 3 == 0, cuts).otherwise(F.lit("")), F.when(i % 4 == 0, F.lit("\nDuración de los cortes: 10 - 20")).otherwise(F.lit("")),
            F.when(i % 6 == 1, F.lit("\nUsar SONIDO OFICIAL")).otherwise(F.lit("")), F.when(i % 8 == 2, F.lit("\nLYRIC vídeo")).otherwise(F.lit("")),
            F.when(i % 9 == 5, F.lit("\nSin temas polémicos")).otherwise(F.lit("")),
        ).alias("brief"),
    )


def fields(spark: SparkSession, folder: str) -> DataFrame:
    """Five fields per brief quoting it at known offsets; some corrupted, some conflicting."""
    names = F.array(*[F.lit(n) for n in ("hook_keyword", "platforms.tiktok.audio_rule", "watermark.position", "unmapped[0].rule", "notes.free")])
    k = F.col("contract_id") * 5 + F.col("field_no")
    base = briefs(spark, folder).select("contract_id", "brief", F.posexplode(names).alias("field_no", "field_path"))
    start = F.when(k % 7 == 3, 100000).otherwise(k % 20)
    text = F.substring("brief", (k % 20 + 1).cast("int"), F.lit(12))
    return base.select(
        "contract_id", F.col("field_no").cast("long").alias("field_no"), "field_path",
        F.when(k % 6 == 1, F.lit(None)).otherwise(F.lit("v")).alias("value"),
        F.when(k % 11 == 5, F.concat(text, F.lit("#~"))).when(k % 17 != 6, text).alias("quote"),
        F.when(k % 5 != 2, start).cast("int").alias("start"), F.when(k % 5 != 2, start + 12 + F.when(k % 13 == 0, 1).otherwise(0)).cast("int").alias("end"),
        F.element_at(F.array(*[F.lit(c) for c in ("explicit", "conflict", "inferred", "missing")]), (k % 4 + 1).cast("int")).alias("confidence"),
    )


def candidate_faults(spark: SparkSession, folder: str) -> DataFrame:
    fault = op.candidate_fault(F.col("value"), F.col("quote"), F.col("confidence"))
    return fields(spark, folder).select("contract_id", "field_no", F.coalesce(fault, F.lit("ok")).alias("fault"))


def provenance(spark: SparkSession, folder: str) -> DataFrame:
    return op.provenance(fields(spark, folder), briefs(spark, folder))


def conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return op.conflicts(fields(spark, folder))


def range_items(spark: SparkSession, folder: str) -> DataFrame:
    """One declared range per contract divisible by six, quoting the brief's cut line; every ninth of them has no end."""
    i = F.col("contract_id")
    ends = i % 54 != 0
    a, b = i * 7 % 200, i * 7 % 200 + i % 5 * 10
    shared = F.concat(clock(a), F.lit(" - "), clock(b))
    return briefs(spark, folder).filter(i % 6 == 0).select(
        "contract_id", F.lit(0).alias("idx"), clock(a).alias("start_value"), F.when(ends, clock(b + F.when(i % 18 == 6, 1).otherwise(0))).alias("end_value"),
        shared.alias("start_quote"), F.when(ends, F.when(i % 24 == 12, "nowhere 9:99").otherwise(shared)).alias("end_quote"),
        F.when(i % 36 == 18, "CONFLICT").otherwise("explicit").alias("start_confidence"), F.when(ends, F.lit("inferred")).alias("end_confidence"),
    )


def time_ranges(spark: SparkSession, folder: str) -> DataFrame:
    none = conflicts(spark, folder).filter(F.col("contract_id") % 15 == 0)
    ranges, issues = op.resolved_ranges(range_items(spark, folder), briefs(spark, folder), none)
    return ranges.select("contract_id", F.lit("range").alias("kind"), "start_s", "end_s").unionByName(
        issues.select("contract_id", F.col("code").alias("kind"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s"))
    )


def segment_resolution(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    contracts = table(spark, folder, "orders").select(o.alias("contract_id"), F.when(o % 2 == 0, "long_video").otherwise("given_clips").alias("mode"))
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    items = table(spark, folder, "lineitem").filter(F.col("l_orderkey") % 8 != 0).select(
        F.col("l_orderkey").alias("contract_id"), n.alias("idx"), F.when(q != 7, q).alias("start_s"), (q + F.when(n == 3, -1.0).otherwise(4.0)).alias("end_s"),
        F.when(q == 9, "conflict").otherwise("explicit").alias("start_confidence"), F.when((q == 9) | (q == 11), "conflict").otherwise("explicit").alias("end_confidence"),
    )
    kept, issues = op.resolved_segments(items, contracts)
    return kept.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"), F.sum("end_s").alias("total")).select("contract_id", F.lit("kept").alias("code"), "n", "total").unionByName(
        issues.groupBy("contract_id", "code").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("total"))
    )


def settings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Contracts over briefs with platforms, declared rules and unmapped rules, all by arithmetic."""
    i = F.col("contract_id")
    empty = F.array().cast("array<string>")
    contracts = briefs(spark, folder).select(
        i, "brief", F.element_at(F.array(*[F.lit(x) for x in ("video", "slideshow", "lyric_video")]), (i % 3 + 1).cast("int")).alias("format"),
        (i % 4 == 0).alias("has_required_assets"), (i % 5 == 0).alias("watermark_required"), (i % 10 == 0).alias("watermark_full"), (i % 7 == 0).alias("has_split"),
        F.when(i % 6 == 0, F.array(F.lit("lock"))).otherwise(empty).alias("spelling_locks"), F.when(i % 8 == 0, F.array(F.lit("spoilers"))).otherwise(empty).alias("prohibitions"),
        F.when(i % 3 == 0, op.MUTED_POLICY).when(i % 3 == 1, "any_audio").alias("audio_policy"), F.when(i % 2 == 0, "ya").alias("hook_keyword"), (i % 11 == 0).alias("brand_safety_required"),
    )
    platforms = contracts.select("contract_id", F.explode(F.array(F.lit("tiktok"), F.lit("x"))).alias("platform")).select(
        "contract_id", "platform", F.when(i % 2 == 0, 5.0).alias("min_s"), F.when(F.col("platform") == "x", 60.0).alias("max_s"), F.when(i % 9 == 0, "hi").alias("first_line"),
        F.when(i % 12 == 0, F.array(F.lit("no"))).otherwise(empty).alias("forbidden"), empty.alias("must_mention"), F.when(F.col("platform") == "x", F.array(F.lit("@a"))).otherwise(empty).alias("required_mentions"),
        empty.alias("required_hashtags"), F.when((i % 4 == 1) & (F.col("platform") == "x"), "official_required").when(i % 4 == 2, "own_clip").otherwise("any").alias("audio_rule"),
        F.when(i % 5 == 1, "tag").otherwise("none").alias("attribution_type"), (i % 6 == 5).alias("link_in_bio"),
    )
    declared = contracts.select(
        "contract_id",
        F.explode(
            F.array(
                F.struct(F.lit("recommended").alias("strength"), F.lit("artifact.aspect").alias("rule_id")), F.struct(F.lit("hard").alias("strength"), F.lit("duration.max").alias("rule_id")),
                F.struct(F.lit("manual_review").alias("strength"), F.when(i % 2 == 0, "hook.keyword").otherwise("audio.present").alias("rule_id")),
            )
        ).alias("d"),
    ).select("contract_id", "d.strength", "d.rule_id")
    unmapped = contracts.filter(i % 5 == 2).select("contract_id", F.when(i % 10 == 2, "custom.one").otherwise("hook.keyword").alias("rule"))
    return contracts, platforms, declared, unmapped


def active_restrictions(spark: SparkSession, folder: str) -> DataFrame:
    contracts, platforms, _, _ = settings(spark, folder)
    return op.active_restrictions(platforms, contracts)


def classified_rules(spark: SparkSession, folder: str) -> DataFrame:
    contracts, platforms, declared, unmapped = settings(spark, folder)
    rules, _ = op.classified_rules(declared, contracts, platforms, unmapped)
    return rules


def rule_issues(spark: SparkSession, folder: str) -> DataFrame:
    contracts, platforms, declared, unmapped = settings(spark, folder)
    return op.classified_rules(declared, contracts, platforms, unmapped)[1]


def contract_violations(spark: SparkSession, folder: str) -> DataFrame:
    contracts, platforms, declared, unmapped = settings(spark, folder)
    i = F.col("contract_id")
    full = contracts.select(
        "*", F.when(i % 4 == 1, "slideshow").when(i % 4 == 2, "long_video").when(i % 4 == 3, "audio_locked").otherwise("given_clips").alias("mode"),
        F.when(i % 5 == 0, F.array(F.lit("9:16"), F.lit("9:16"))).when(i % 5 == 1, F.array(F.lit("16:9"))).otherwise(F.array(F.lit("9:16"))).alias("outputs"),
        F.when(i % 2 == 0, "1.1").otherwise("1.2").alias("schema_version"), F.when(i % 7 == 0, "9:16").alias("split_aspect"), (i % 3 != 0).alias("has_official_audio"),
        F.when(i % 2 == 0, "quote").alias("brand_safety_citation"), F.when(i % 4 == 2, i % 3).otherwise(i % 2).alias("n_segments"),
    )
    rules, _ = op.classified_rules(declared, contracts, platforms, unmapped)
    kept = rules.filter(~((i % 6 == 1) & (F.col("rule_id") == "duration.max")))
    return op.contract_violations(full, platforms, kept, unmapped).select("contract_id", F.array_join("violations", ",").alias("violations"))


def resolution_status(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("contract_id")
    drafts = briefs(spark, folder).select("contract_id", "brief", F.when(i % 7 != 0, "given_clips").alias("mode"), F.when(i % 4 != 2, "video").alias("format"))
    issues = op.conflicts(fields(spark, folder)).select("contract_id", "code").filter(i % 3 == 1).unionByName(
        drafts.filter(i % 5 == 0).select("contract_id", F.lit("rule_defaulted").alias("code"))
    )
    return op.resolution_status(drafts, issues)


def campaign_routes(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("o_orderkey")
    kinds = F.array(F.lit("known"), F.lit("known_with_variation"), F.lit("new_archetype"))
    rows = table(spark, folder, "orders").select(
        i, F.element_at(kinds, (i % 3 + 1).cast("int")).alias("a"), F.when((i % 3 == 1) != (i % 10 == 0), F.array(F.lit("v"))).otherwise(F.array().cast("array<string>")).alias("v")
    )
    return rows.select("o_orderkey", op.campaign_route(F.col("a"), F.col("v")).alias("state"))


def split_quotes(spark: SparkSession, folder: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    names = F.array(*[F.lit(x) for x in ("top_source", "gap", "panel_ratio", "width", "height", "bottom_source", "gap")])
    drafts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("contract_id"), F.element_at(names, n).alias("field"), F.col("l_partkey").alias("p"),
        F.when(n == 3, q / 100).otherwise(q).cast("string").alias("value"),
        F.when(n.isin(1, 6), F.concat(F.lit("src "), q.cast("string"))).otherwise(F.concat(F.lit("about "), (q + F.col("l_partkey") % 2).cast("int").cast("string"), F.lit(" px"))).alias("quote"),
    )
    return op.split_quote_faults(drafts).groupBy("contract_id", "field").agg(F.count(F.lit(1)).alias("n"))


def asset_resolution(spark: SparkSession, folder: str) -> DataFrame:
    i, n = F.col("l_partkey"), F.col("l_linenumber")
    drafts = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("contract_id"), F.when(n % 2 == 0, "optional").otherwise("required").alias("slot"), n.alias("idx"),
        F.when(i % 9 != 0, i.cast("string")).otherwise(F.lit("")).alias("asset_id"), F.when(i % 5 != 0, "video").alias("kind"), F.concat(F.lit("file:"), (i % 4).cast("string")).alias("uri"),
        F.lit("brief").alias("origin"), F.when(i % 10 == 5, F.array(F.lit("kind"))).otherwise(F.array().cast("array<string>")).alias("conflicted"),
    )
    registry = table(spark, folder, "part").filter(F.col("p_partkey") % 2 == 0).select(
        F.col("p_partkey").cast("string").alias("asset_id"), F.concat(F.lit("file:"), (F.col("p_partkey") % 3).cast("string")).alias("uri")
    )
    return op.resolved_assets(drafts, registry).groupBy("contract_id", "slot", "code", "kept").agg(F.count(F.lit(1)).alias("n"))


def safety_chain(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("contract_id")
    rows = briefs(spark, folder).select(
        "contract_id", "brief", (i % 5 == 0).alias("required_value"), (i % 7 == 0).alias("safety_value"), F.when(i % 11 == 0, "cited").alias("citation"),
        F.when(i % 2 == 0, "rq").alias("required_quote"), F.when(i % 3 == 0, "sq").alias("safety_quote"), F.lit(None).cast("string").alias("prohibitions_quote"),
        F.when(i % 4 == 1, F.array(F.lit("Contenido TÓXICO"))).when(i % 4 == 2, F.array(F.lit("spoilers"))).otherwise(F.array().cast("array<string>")).alias("prohibitions"),
    )
    return op.safety_chain(rows).select("contract_id", "needed", "citation", F.array_join("prohibitions", "|").alias("prohibitions"))


def default_contracts(spark: SparkSession, folder: str) -> DataFrame:
    made = op.default_contracts(table(spark, folder, "supplier").select(F.col("s_name").alias("campaign_id")))
    return made.select("contract_id", "format", "mode", "platform", "min_s", "max_s", "audio_rule", "audio_policy", F.array_join("hard", ",").alias("hard"))


def ingested_briefs(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("source"), F.replace("html", F.lit(">"), F.lit(">\r\n")).alias("text"))
    return ingest_texts(pages).select("source", "sha256", F.char_length("text").alias("n_chars"))


QUERIES = {
    "candidate_faults": candidate_faults, "provenance": provenance, "conflicts": conflicts, "time_ranges": time_ranges, "segment_resolution": segment_resolution,
    "active_restrictions": active_restrictions, "classified_rules": classified_rules, "rule_issues": rule_issues, "contract_violations": contract_violations,
    "resolution_status": resolution_status, "campaign_routes": campaign_routes, "split_quotes": split_quotes, "asset_resolution": asset_resolution,
    "safety_chain": safety_chain, "default_contracts": default_contracts, "ingested_briefs": ingested_briefs,
}

_CLK = "(({0}) // 60) || ':' || printf('%02d', ({0}) % 60)"
_BR = f"""
_bi AS (SELECT item_id AS i, text, item_id * 7 % 200 AS a, item_id * 7 % 200 + item_id % 5 * 10 AS b FROM benchmark),
br AS (SELECT i, a, b, text || CASE WHEN i % 3 = 0 THEN chr(10) || 'Cortes: ' || {_CLK.format('a')} || ' - ' || {_CLK.format('b')} || '; segmento ' || (i % 30) || 's a ' || (i % 30) + 4 || '.5s' ELSE '' END
       || CASE WHEN i % 4 = 0 THEN chr(10) || 'Duración de los cortes: 10 - 20' ELSE '' END || CASE WHEN i % 6 = 1 THEN chr(10) || 'Usar SONIDO OFICIAL' ELSE '' END
       || CASE WHEN i % 8 = 2 THEN chr(10) || 'LYRIC vídeo' ELSE '' END || CASE WHEN i % 9 = 5 THEN chr(10) || 'Sin temas polémicos' ELSE '' END AS brief FROM _bi),
_f0 AS (SELECT i, brief, n, ['hook_keyword', 'platforms.tiktok.audio_rule', 'watermark.position', 'unmapped[0].rule', 'notes.free'][n + 1] AS path, i * 5 + n AS k FROM br, unnest(range(0, 5)) AS u(n)),
_f1 AS (SELECT *, substring(brief, (k % 20 + 1)::INT, 12) AS t, CASE WHEN k % 7 = 3 THEN 100000 ELSE k % 20 END AS st FROM _f0),
fl AS (SELECT *, CASE WHEN k % 6 <> 1 THEN 'v' END AS val, CASE WHEN k % 11 = 5 THEN t || '#~' WHEN k % 17 <> 6 THEN t END AS quote, CASE WHEN k % 5 <> 2 THEN st END AS s,
       CASE WHEN k % 5 <> 2 THEN st + 12 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END AS e, ['explicit', 'conflict', 'inferred', 'missing'][k % 4 + 1] AS conf FROM _f1),
cf AS (SELECT i, path, CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 END AS walk FROM fl WHERE conf = 'conflict' AND n < 4)"""
_SET = f"""{_BR},
ct AS (SELECT i, brief, ['video', 'slideshow', 'lyric_video'][i % 3 + 1] AS format, CASE i % 3 WHEN 0 THEN 'internal_official_sound' WHEN 1 THEN 'any_audio' END AS policy,
       strip_accents(lower(brief)) AS m FROM br),
pf AS (SELECT i, p, CASE WHEN i % 4 = 1 AND p = 'x' THEN 'official_required' WHEN i % 4 = 2 THEN 'own_clip' ELSE 'any' END AS au FROM br, (VALUES ('tiktok'), ('x')) AS v(p)),
ac AS (SELECT i, p, rule FROM pf JOIN ct USING (i), (VALUES ('duration.min'), ('duration.max'), ('caption.first_line'), ('caption.forbidden'), ('caption.required_mention'), ('audio.official_track'),
       ('audio.own_clip'), ('attribution.required'), ('link.in_bio'), ('assets.required'), ('watermark.full_video'), ('watermark.present'), ('subtitles.spelling_lock'), ('hook.keyword'),
       ('audio.policy'), ('audio.silence'), ('brand.safety')) AS r(rule)
       WHERE CASE rule WHEN 'duration.min' THEN i % 2 = 0 WHEN 'duration.max' THEN p = 'x' WHEN 'caption.first_line' THEN i % 9 = 0 WHEN 'caption.forbidden' THEN i % 12 = 0 OR i % 8 = 0
       WHEN 'caption.required_mention' THEN p = 'x' WHEN 'audio.official_track' THEN au = 'official_required' WHEN 'audio.own_clip' THEN au = 'own_clip' WHEN 'attribution.required' THEN i % 5 = 1
       WHEN 'link.in_bio' THEN i % 6 = 5 WHEN 'assets.required' THEN i % 4 = 0 WHEN 'watermark.full_video' THEN i % 10 = 0 WHEN 'watermark.present' THEN i % 10 = 5
       WHEN 'subtitles.spelling_lock' THEN i % 6 = 0 WHEN 'hook.keyword' THEN i % 2 = 0 WHEN 'audio.policy' THEN i % 3 = 0 WHEN 'audio.silence' THEN i % 3 = 0 ELSE i % 11 = 0 END),
de AS (SELECT i, 'recommended' AS strength, 'artifact.aspect' AS rule FROM br UNION ALL SELECT i, 'hard', 'duration.max' FROM br
       UNION ALL SELECT i, 'manual_review', CASE WHEN i % 2 = 0 THEN 'hook.keyword' ELSE 'audio.present' END FROM br),
ba AS (SELECT i, rule FROM ct, (VALUES ('artifact.integrity'), ('artifact.aspect'), ('artifact.video_stream'), ('subtitles.spelling_lock'), ('audio.present'), ('assets.required'), ('watermark.full_video'),
       ('watermark.present'), ('layout.geometry')) AS r(rule)
       WHERE CASE rule WHEN 'artifact.video_stream' THEN i % 3 <> 1 WHEN 'subtitles.spelling_lock' THEN i % 3 = 2 WHEN 'audio.present' THEN i % 4 IN (1, 2) WHEN 'assets.required' THEN i % 4 = 0
       WHEN 'watermark.full_video' THEN i % 10 = 0 WHEN 'watermark.present' THEN i % 10 = 5 WHEN 'layout.geometry' THEN i % 7 = 0 ELSE true END),
st AS (SELECT i, 'audio.policy' AS rule, 1 AS step, 'manual_review' AS strength FROM ct WHERE policy IS NULL AND (i % 4 = 1 OR i % 6 = 1)
       UNION ALL SELECT i, rule, 2, CASE WHEN rule IN ('audio.own_clip', 'audio.policy', 'audio.official_track', 'attribution.required', 'link.in_bio') THEN 'manual_review' ELSE 'hard' END FROM ac
       UNION ALL SELECT i, 'brand.safety', 3, 'hard' FROM ct WHERE i % 11 = 0 OR i % 9 = 5
       UNION ALL SELECT i, CASE WHEN i % 10 = 2 THEN 'custom.one' ELSE 'hook.keyword' END, 4, 'manual_review' FROM ct WHERE i % 5 = 2),
ad AS (SELECT i, rule, min(step) AS step, arg_min(strength, step) AS strength FROM st WHERE (i, rule) NOT IN (SELECT (i, rule) FROM de) GROUP BY i, rule),
ru AS (SELECT i, strength, rule FROM de WHERE strength = 'hard' OR (i, rule) NOT IN (SELECT (i, rule) FROM ba)
       UNION SELECT i, 'hard', rule FROM ba UNION SELECT i, strength, rule FROM ad),
iss AS (SELECT i, rule, 'base_forced_hard' AS detail FROM de WHERE strength <> 'hard' AND (i, rule) IN (SELECT (i, rule) FROM ba)
       UNION ALL SELECT i, rule, ['policy_review', 'restriction_defaulted', 'safety_defaulted', 'unmapped_review'][step] FROM ad)"""

ORACLES = {
    "candidate_faults": f"""WITH {_BR} SELECT i AS contract_id, n AS field_no, CASE WHEN conf = 'missing' AND (val IS NOT NULL OR quote IS NOT NULL) THEN 'missing_with_content'
        WHEN conf = 'conflict' AND (val IS NOT NULL OR quote IS NULL) THEN 'conflict_needs_quote_only' WHEN conf IN ('explicit', 'inferred') AND (val IS NULL OR quote IS NULL) THEN 'value_and_quote_needed' ELSE 'ok' END AS fault FROM fl""",
    "provenance": f"""WITH {_BR}, j AS (SELECT *, CASE WHEN quote IS NULL THEN NULL WHEN NOT contains(brief, quote) THEN 'fabricated'
            WHEN s IS NOT NULL AND (s < 0 OR e < s OR e > length(brief)) THEN 'out_of_range' WHEN s IS NOT NULL AND substring(brief, s::INT + 1, (e - s)::INT) <> quote THEN 'misaligned' END AS fault FROM fl)
        SELECT i AS contract_id, count(fault) AS n_faults, count(fault) = 0 AS accepted, arg_min(fault, n) FILTER (fault IS NOT NULL) AS first_fault FROM j GROUP BY i""",
    "conflicts": f"WITH {_BR} SELECT i AS contract_id, 'conflict' AS code, path AS field, row_number() OVER (PARTITION BY i ORDER BY walk) - 1 AS walk FROM cf",
    "time_ranges": f"""WITH {_BR}, d AS (SELECT i, a, b, b + CASE WHEN i % 18 = 6 THEN 1 ELSE 0 END AS e2,
            CASE WHEN i % 54 = 0 THEN 'missing_required' WHEN i % 36 = 18 THEN 'conflict' END AS c1, CASE WHEN i % 54 <> 0 AND i % 24 = 12 THEN 'invalid_contract' END AS c2 FROM br WHERE i % 6 = 0),
        dj AS (SELECT *, CASE WHEN c1 IS NULL AND c2 IS NULL AND (NOT a < e2 OR e2 <> b) THEN 'invalid_contract' END AS c3 FROM d),
        fr AS (SELECT * FROM br WHERE i % 3 = 0 AND i % 6 <> 0 AND NOT (i % 15 = 0 AND i IN (SELECT i FROM cf)))
        SELECT i AS contract_id, 'range' AS kind, a::DOUBLE AS start_s, e2::DOUBLE AS end_s FROM dj WHERE c1 IS NULL AND c2 IS NULL AND c3 IS NULL
        UNION ALL SELECT i, c1, NULL, NULL FROM dj WHERE c1 IS NOT NULL UNION ALL SELECT i, c2, NULL, NULL FROM dj WHERE c2 IS NOT NULL UNION ALL SELECT i, c3, NULL, NULL FROM dj WHERE c3 IS NOT NULL
        UNION ALL SELECT i, 'range', a, b FROM fr WHERE a < b UNION ALL SELECT i, 'invalid_contract', NULL, NULL FROM fr WHERE a >= b UNION ALL SELECT i, 'range', i % 30, i % 30 + 4.5 FROM fr""",
    "segment_resolution": """WITH s AS (SELECT l_orderkey AS c, l_linenumber AS n, l_quantity AS q, l_quantity + CASE WHEN l_linenumber = 3 THEN -1 ELSE 4 END AS e FROM lineitem WHERE l_orderkey % 8 <> 0 AND l_orderkey % 2 = 0),
        k AS (SELECT *, CASE WHEN q = 9 THEN 2 WHEN q = 11 THEN 1 ELSE 0 END AS cl FROM s)
        SELECT c AS contract_id, 'kept' AS code, count(*) AS n, sum(e) AS total FROM k WHERE cl = 0 AND q <> 7 AND n <> 3 GROUP BY c
        UNION ALL SELECT c, 'conflict', sum(cl)::BIGINT, 0 FROM k WHERE cl > 0 GROUP BY c
        UNION ALL SELECT coalesce(x.c, y.c), 'missing_required', coalesce(x.n, 0) + coalesce(y.n, 0), 0 FROM (SELECT c, count(*) AS n FROM k WHERE q = 7 GROUP BY c) x
            FULL JOIN (SELECT o_orderkey AS c, 1 AS n FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 8 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))) y ON x.c = y.c
        UNION ALL SELECT c, 'invalid_contract', count(*), 0 FROM k WHERE cl = 0 AND q <> 7 AND n = 3 GROUP BY c""",
    "active_restrictions": f"WITH {_SET} SELECT i AS contract_id, p AS platform, rule AS rule_id FROM ac",
    "classified_rules": f"WITH {_SET} SELECT i AS contract_id, strength, rule AS rule_id FROM ru",
    "rule_issues": f"WITH {_SET} SELECT i AS contract_id, rule AS rule_id, detail FROM iss",
    "contract_violations": f"""WITH {_SET}, q AS (SELECT i, CASE i % 4 WHEN 1 THEN 'slideshow' WHEN 2 THEN 'long_video' WHEN 3 THEN 'audio_locked' ELSE 'given_clips' END AS mode, format, policy FROM ct),
        lo AS (SELECT DISTINCT i FROM ac WHERE NOT EXISTS (SELECT 1 FROM ru WHERE ru.i = ac.i AND ru.rule = ac.rule AND NOT (ru.i % 6 = 1 AND ru.rule = 'duration.max')))
        SELECT i AS contract_id, concat_ws(',', CASE WHEN (mode = 'slideshow') <> (format = 'slideshow') THEN 'mode_format' END, CASE WHEN i % 5 = 0 THEN 'repeated_outputs' END,
            CASE WHEN i % 2 = 0 AND i % 5 IN (0, 1) THEN 'outputs_need_1_2' END, CASE WHEN i % 7 = 0 AND i % 5 = 0 THEN 'split_with_many_outputs' END, CASE WHEN i % 7 = 0 AND i % 5 = 1 THEN 'split_aspect' END,
            CASE WHEN i % 5 = 2 AND i % 10 <> 2 THEN 'unmapped_collides' END, CASE WHEN mode = 'audio_locked' AND i % 3 = 0 THEN 'policy_mode' END, CASE WHEN i % 4 = 1 AND i % 3 = 0 THEN 'official_audio_missing' END,
            CASE WHEN i IN (SELECT i FROM lo) THEN 'restriction_unclassified' END, CASE WHEN i % 11 = 0 AND i % 2 <> 0 THEN 'safety_uncited' END,
            CASE WHEN (mode = 'long_video') <> (CASE WHEN i % 4 = 2 THEN i % 3 ELSE i % 2 END > 0) THEN 'segments_mode' END) AS violations FROM q""",
    "resolution_status": f"""WITH {_BR}, x AS (SELECT i, 'conflict' AS code FROM cf WHERE i % 3 = 1 UNION ALL SELECT i, 'rule_defaulted' FROM br WHERE i % 5 = 0),
        n AS (SELECT i, count(*) AS k, bool_or(code = 'conflict') AS c FROM x GROUP BY i),
        s AS (SELECT br.i, CASE WHEN br.i % 4 <> 2 THEN 'video' WHEN contains(strip_accents(lower(brief)), 'lyric video') OR contains(brief, '.lrc') THEN 'lyric_video' END AS format, coalesce(k, 0) AS k, coalesce(c, false) AS c FROM br LEFT JOIN n ON n.i = br.i)
        SELECT i AS contract_id, format, k AS n_issues, CASE WHEN (i % 7 = 0 OR format IS NULL) AND c THEN 'manual_review' WHEN i % 7 = 0 OR format IS NULL THEN 'new_archetype' WHEN c THEN 'manual_review' ELSE 'resolved' END AS status FROM s""",
    "campaign_routes": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'invalid' WHEN o_orderkey % 3 = 2 THEN 'manual_review' WHEN o_orderkey % 3 = 1 THEN 'pending' ELSE 'classified' END AS state FROM orders""",
    "split_quotes": """SELECT l_orderkey AS contract_id, ['top_source', 'gap', 'panel_ratio', 'width', 'height', 'bottom_source', 'gap'][l_linenumber] AS field, count(*) AS n FROM lineitem
        WHERE l_linenumber NOT IN (1, 6) AND l_partkey % 2 = 1 AND NOT (l_linenumber = 3 AND false) GROUP BY 1, 2""",
    "asset_resolution": """WITH d AS (SELECT l_orderkey AS c, CASE WHEN l_linenumber % 2 = 0 THEN 'optional' ELSE 'required' END AS slot, l_partkey AS i FROM lineitem),
        r AS (SELECT *, i % 9 = 0 OR i % 5 = 0 AS unusable, i % 9 = 0 OR (i % 5 = 0 AND i % 10 <> 5) AS lacking, i % 2 = 0 AND i % 4 <> i % 3 AND i IN (SELECT p_partkey FROM part) AS other FROM d),
        k AS (SELECT c, slot, CASE WHEN unusable AND lacking THEN CASE slot WHEN 'optional' THEN 'optional_asset_dropped' ELSE 'missing_required' END
            WHEN NOT unusable AND other THEN CASE slot WHEN 'optional' THEN 'optional_asset_dropped' ELSE 'unresolved_asset' END END AS code, unusable FROM r)
        SELECT c AS contract_id, slot, code, NOT unusable AND code IS NULL AS kept, count(*) AS n FROM k GROUP BY ALL""",
    "safety_chain": f"""WITH {_BR}, s AS (SELECT i, i % 5 = 0 OR i % 7 = 0 OR i % 4 = 1 OR i % 9 = 5 AS needed, CASE i % 4 WHEN 1 THEN 'Contenido TÓXICO' WHEN 2 THEN 'spoilers' ELSE '' END AS p FROM br)
        SELECT i AS contract_id, needed, CASE WHEN i % 11 = 0 THEN 'cited' WHEN NOT needed THEN NULL WHEN i % 2 = 0 THEN 'rq' WHEN i % 3 = 0 THEN 'sq' WHEN p <> '' THEN p END AS citation,
        CASE WHEN needed AND i % 4 <> 1 THEN CASE WHEN p = '' THEN 'brand safety' ELSE p || '|brand safety' END ELSE p END AS prohibitions FROM s""",
    "default_contracts": """SELECT s_name AS contract_id, 'video' AS format, 'repost_ugc' AS mode, 'tiktok' AS platform, 3.0::DOUBLE AS min_s, NULL::DOUBLE AS max_s, 'any' AS audio_rule, 'original_audio' AS audio_policy,
        'artifact.aspect,artifact.integrity,artifact.video_stream,duration.min' AS hard FROM supplier""",
    "ingested_briefs": "WITH p AS (SELECT page_id, replace(html, '>', '>' || chr(10)) AS t FROM pages) SELECT page_id AS source, sha256(t) AS sha256, length(t) AS n_chars FROM p",
}
