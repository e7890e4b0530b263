"""From checks to verdicts to delivery."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.operators.rules import CATALOGUE, FAIL, MANUAL, PASS, UNSUPPORTED, UNVALIDATED, Rule, joined, outcome, with_normal_text, with_term_patterns

# Spellings accepted for a canonical rule.
ALIASES = {
    "audio.official_track": ("audio.official_selection", "audio.rule"),
    "attribution.required": ("attribution.present",),
    "link.in_bio": ("link_rules.link_in_bio",),
}
STRENGTHS = ("hard", "recommended", "manual_review")


def canonical(rule_id: Column) -> Column:
    """Canonical id of a rule or one of its aliases."""
    folded = F.create_map(*chain.from_iterable((F.lit(a), F.lit(c)) for c, names in ALIASES.items() for a in names))
    return F.coalesce(folded[rule_id], rule_id)


def applies(canonical_id: Column) -> Column:
    """Whether a rule asks anything of a platform; rules without a predicate always apply."""
    predicates = {
        "audio.present": F.col("audio_rule") != "any",
        "audio.own_clip": F.col("audio_rule") == "own_clip",
        "audio.no_trending": F.col("audio_rule") == "no_trending",
        "audio.official_track": F.col("audio_rule") == "official_required",
        "attribution.required": F.col("attribution_type") != "none",
        "link.in_bio": F.col("link_in_bio"),
    }
    return reduce(lambda acc, kv: acc.when(canonical_id == kv[0], kv[1]), predicates.items(), F.when(F.lit(False), F.lit(False))).otherwise(F.lit(True))


def undeclared_platforms(pieces: DataFrame, platform_rules: DataFrame) -> DataFrame:
    """Pieces whose contract does not name their platform; they cannot be gated."""
    return pieces.join(platform_rules, ["contract_id", "platform"], "left_anti")


def declared(items: Column) -> Column:
    """Collected ``(position, value)`` pairs as values in declared order."""
    return F.transform(F.array_sort(items), lambda x: x["value"])


def dispatch_table(rules: DataFrame, platform_rules: DataFrame, unmapped: DataFrame) -> DataFrame:
    """Per contract, the ordered rules with what the dispatcher must know about each.

    ``unmapped``: ``contract_id, position, rule, quote``, in the order in which the contract cites them.
    """
    cited = unmapped.groupBy("contract_id", F.col("rule").alias("rule_id")).agg(
        declared(F.collect_list(F.struct("position", F.col("quote").alias("value")))).alias("citations")
    )
    anywhere = (
        rules.select("contract_id", "rule_id", canonical(F.col("rule_id")).alias("canonical_id"))
        .distinct()
        .join(platform_rules.select("contract_id", "audio_rule", "attribution_type", "link_in_bio"), "contract_id")
        .groupBy("contract_id", "rule_id", "canonical_id")
        .agg(F.max(applies(F.col("canonical_id"))).alias("anywhere"))
    )
    order = F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), F.col("strength")).cast("int")
    return (
        rules.join(anywhere, ["contract_id", "rule_id"])
        .join(cited, ["contract_id", "rule_id"], "left")
        .groupBy("contract_id")
        .agg(F.array_sort(F.collect_list(F.struct(order.alias("tier"), "ordinal", "strength", "rule_id", "canonical_id", "anywhere", "citations"))).alias("todo"))
    )


def joined_rows(pieces: DataFrame, platform_rules: DataFrame, contracts: DataFrame) -> DataFrame:
    """Piece, platform and contract in one row. The small sides broadcast only under the session's size limit.

    Normal forms and patterns of terms are made once per contract and platform, before any piece meets them.
    """
    return pieces.join(with_term_patterns(platform_rules.join(contracts, "contract_id")), ["contract_id", "platform"])


def evaluate(
    rows: DataFrame, dispatch: DataFrame, unmapped: DataFrame, catalogue: Mapping[str, Rule] | None = None
) -> DataFrame:
    """One row per piece and dispatched rule, plus one for requirements nobody can check.

    ``tier`` and ``ordinal`` give the order of a piece's checks. A rule is only computed for the rows that ask for it.
    """
    rules = dict(CATALOGUE if catalogue is None else catalogue)
    todo = with_normal_text(rows).join(dispatch, "contract_id").withColumn("r", F.explode("todo")).drop("todo")
    asked, cited = F.col("r.canonical_id"), F.col("r.citations")
    here = applies(asked)
    shown = F.when(cited.isNotNull(), F.create_map(F.lit("citations"), joined(cited))).otherwise(F.create_map().cast("map<string,string>"))
    unknown = F.struct(
        F.when((F.col("r.strength") == MANUAL) | cited.isNotNull(), MANUAL).otherwise(UNSUPPORTED).alias("status"), F.lit(UNVALIDATED).alias("reason"), shown.alias("evidence")
    )
    direct = reduce(lambda acc, kv: acc.when(asked == kv[0], kv[1]()), rules.items(), F.when(F.lit(False), outcome(PASS))).otherwise(unknown)
    base = ["piece_id", "contract_id", "platform"]
    found = todo.withColumn("here", here).filter(F.col("here") | ~F.col("r.anywhere")).select(*base, "r", "here", direct.alias("o"))
    orphan = (F.col("o.status") == MANUAL) & (F.col("r.strength") != MANUAL) & cited.isNull() & ~F.col("here") & ~F.col("r.anywhere")
    checks = found.select(
        *base,
        "r.tier",
        "r.ordinal",
        "r.rule_id",
        "r.strength",
        F.when(orphan, F.lit(UNSUPPORTED)).otherwise(F.col("o.status")).alias("status"),
        "o.reason",
        F.when(orphan, F.map_concat("o.evidence", F.create_map(F.lit("unclaimed"), F.lit("no_platform")))).otherwise(F.col("o.evidence")).alias("evidence"),
    )
    return checks.unionByName(_unmapped_rows(rows, unmapped, list(rules)))


def _unmapped_rows(rows: DataFrame, unmapped: DataFrame, validators: list[str]) -> DataFrame:
    per_contract = unmapped.groupBy("contract_id").agg(
        declared(F.collect_list(F.struct("position", F.struct("rule", "quote").alias("value")))).alias("cited")
    )
    names = F.transform("cited", lambda c: c["rule"])
    clash = F.filter(names, lambda n: n.isin(*validators))
    failed = F.size("clash") > 0
    told = F.create_map(F.lit("rules"), joined(names), F.lit("citations"), joined(F.transform("cited", lambda c: c["quote"])))
    return (
        rows.select("piece_id", "contract_id", "platform")
        .join(per_contract.select("contract_id", clash.alias("clash"), told.alias("told")), "contract_id")
        .select(
            "piece_id",
            "contract_id",
            "platform",
            F.lit(len(STRENGTHS) + 1).alias("tier"),
            F.lit(0).alias("ordinal"),
            F.lit("rules.unmapped").alias("rule_id"),
            F.when(failed, "hard").otherwise(MANUAL).alias("strength"),
            F.when(failed, FAIL).otherwise(MANUAL).alias("status"),
            F.when(failed, "collides_with_validator").otherwise("unmapped").alias("reason"),
            F.when(failed, F.map_concat("told", F.create_map(F.lit("colliding"), joined(F.col("clash"))))).otherwise(F.col("told")).alias("evidence"),
        )
    )


def severity() -> Column:
    """Worst first: fail, unsupported, then anything left to a person."""
    return (
        F.when(F.col("status") == FAIL, 3)
        .when(F.col("status") == UNSUPPORTED, 2)
        .when((F.col("status") == MANUAL) | (F.col("strength") == MANUAL), 1)
        .otherwise(0)
    )


def verdicts(pieces: DataFrame, checks: DataFrame) -> DataFrame:
    """One verdict per piece. A piece without checks passes; a signature may only cover real validators.

    Checks without a ``tier`` stand in the order of their ``ordinal``.
    """
    signable = (F.col("status") == PASS) | ((F.col("status") == MANUAL) & ~F.coalesce(F.col("reason") == UNVALIDATED, F.lit(False)))
    order = [c for c in ("tier", "ordinal") if c in checks.columns]
    open_checks = F.collect_list(F.when(F.col("status") != PASS, F.struct(*order, "rule_id")))
    rolled = checks.groupBy("piece_id").agg(
        F.max(severity()).alias("_worst"),
        F.min(signable).alias("_signable"),
        F.count(F.lit(1)).alias("n_checks"),
        F.array_join(F.transform(F.array_sort(open_checks), lambda c: c["rule_id"]), ", ").alias("open_rules"),
    )
    label = F.element_at(F.array(*[F.lit(s) for s in ("passed", "pending_review", "unsupported", "rejected")]), F.coalesce("_worst", F.lit(0)) + 1)
    return pieces.join(rolled, "piece_id", "left").select(
        *pieces.columns,
        label.alias("status"),
        F.coalesce("n_checks", F.lit(0)).alias("n_checks"),
        F.coalesce("open_rules", F.lit("")).alias("open_rules"),
        F.coalesce("_signable", F.lit(True)).alias("signable"),
    )


def deliveries(judged: DataFrame, approvals: DataFrame) -> DataFrame:
    """Adds ``exportable`` and the rejection text. ``approvals``: ``batch_id, approved``."""
    allowed = (F.col("status") == "passed") | (
        F.coalesce("approved", F.lit(False)) & (F.col("status") == "pending_review") & F.col("signable")
    )
    reason = F.concat(F.lit("not approved ("), F.col("status"), F.lit("): "), F.col("open_rules"))
    return (
        judged.join(approvals, "batch_id", "left")
        .withColumn("exportable", allowed)
        .withColumn("rejection", F.when(~F.col("exportable"), reason))
        .drop("approved")
    )


def batch_status(delivered: DataFrame) -> DataFrame:
    """Exported when nothing was rejected, partial when something was, blocked when everything was."""
    rejected, exported = F.count_if(~F.col("exportable")), F.count_if(F.col("exportable"))
    return delivered.groupBy("batch_id").agg(
        exported.alias("n_exported"),
        rejected.alias("n_rejected"),
        F.when(rejected == 0, "exported").when(exported > 0, "partial").otherwise("blocked").alias("batch_status"),
        (rejected == 0).alias("published"),
    )


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def reminders(batches: DataFrame, contracts: DataFrame, rules: DataFrame, platform_rules: DataFrame) -> DataFrame:
    """What a person must still do. ``batches``: ``batch_id, contract_id, platform``; contracts carry the targets.

    A manual rule is recalled if it applies to a delivered platform, or to no platform of the contract.
    """
    heads = batches.select("batch_id", "contract_id").distinct().join(contracts, "contract_id")
    facts = heads.select(
        "batch_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("geo_country").isNotNull(),
                        F.struct(F.lit(0).alias("at"), F.lit("geo_target").alias("kind"), F.concat_ws(" ", F.col("geo_min_pct").cast("string"), "geo_country").alias("detail")),
                    ),
                    F.when(F.col("min_views").isNotNull(), F.struct(F.lit(1).alias("at"), F.lit("min_views_for_payout").alias("kind"), F.col("min_views").cast("string").alias("detail"))),
                    F.when(F.col("proof_required"), F.struct(F.lit(2).alias("at"), F.lit("analytics_proof_required").alias("kind"), F.lit("proof").alias("detail"))),
                )
            )
        ).alias("r"),
    ).select("batch_id", "r.kind", "r.detail")
    manual = rules.filter(F.col("strength") == MANUAL).select("contract_id", "rule_id", canonical(F.col("rule_id")).alias("canonical_id"))
    reach = manual.join(platform_rules, "contract_id").withColumn("_here", applies(F.col("canonical_id")))
    anywhere = reach.groupBy("contract_id", "rule_id").agg(F.max("_here").alias("_any"))
    delivered = (
        batches.select("batch_id", "contract_id", "platform").distinct()
        .join(reach.select("contract_id", "platform", "rule_id", "_here"), ["contract_id", "platform"])
        .groupBy("batch_id", "contract_id", "rule_id")
        .agg(F.max("_here").alias("_mine"))
    )
    recalled = delivered.join(anywhere, ["contract_id", "rule_id"]).filter(F.col("_mine") | ~F.col("_any")).select(
        "batch_id", F.lit("manual_review").alias("kind"), F.col("rule_id").alias("detail")
    )
    return facts.unionByName(recalled)


def asset_faults(required: DataFrame, registry: DataFrame) -> DataFrame:
    """One class per required asset that is not as declared.

    ``required``: ``contract_id, asset_id, sha256, size_bytes`` (null hash = only needs to be intact);
    ``registry``: ``asset_id, reg_sha256, reg_size, file_sha256, safe``.
    """
    known = registry.withColumn("_known", F.lit(True))
    fault = (
        F.when(F.col("_known").isNull(), "missing")
        .when(~F.coalesce("safe", F.lit(True)), "unsafe")
        .when(F.col("sha256").isNotNull() & ((F.col("reg_sha256") != F.col("sha256")) | ~F.col("reg_size").eqNullSafe(F.col("size_bytes"))), "mismatched")
        .when(~F.col("file_sha256").eqNullSafe(F.col("reg_sha256")), "tampered")
    )
    return required.join(known, "asset_id", "left").select("contract_id", "asset_id", fault.alias("fault")).filter(F.col("fault").isNotNull())


def faults_by_contract(faults: DataFrame) -> DataFrame:
    """How many assets of a contract have each class of fault, for the rule row; which ones is ``asset_faults``."""
    counted = faults.groupBy("contract_id", "fault").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "fault", F.col("n").cast("string")))).alias("asset_faults"))


def piece_grid(contracts_platforms: DataFrame, assets: DataFrame) -> DataFrame:
    """Every platform of a contract with every required video asset of it, platforms by name."""
    videos = assets.filter(F.col("kind") == "video").select("contract_id", "asset_id", "position")
    return contracts_platforms.select("contract_id", "platform").join(videos, "contract_id").select(
        "contract_id", "platform", "asset_id", "position"
    )


def concordance(actual: DataFrame, expected: DataFrame, tolerance_s: float = 0.02) -> DataFrame:
    """First reason two ordered line lists disagree, per piece; null when they agree.

    Both sides: ``piece_id, idx, start_s, end_s, tokens``. Counts are compared before any pair.
    """
    a = actual.withColumnsRenamed({"start_s": "a_start", "end_s": "a_end", "tokens": "a_tokens"}).withColumn("_a", F.lit(1))
    e = expected.withColumnsRenamed({"start_s": "e_start", "end_s": "e_end", "tokens": "e_tokens"}).withColumn("_e", F.lit(1))
    fault = (
        F.when(~F.col("a_tokens").eqNullSafe(F.col("e_tokens")), "other_text")
        .when(F.abs(F.col("a_start") - F.col("e_start")) > tolerance_s, "start_shifted")
        .when(F.col("e_end").isNotNull() & (F.abs(F.col("a_end") - F.col("e_end")) > tolerance_s), "end_shifted")
    )
    paired = a.join(e, ["piece_id", "idx"], "full_outer").withColumn("fault", fault)
    return (
        paired.groupBy("piece_id")
        .agg(
            F.sum("_a").alias("n_actual"),
            F.sum("_e").alias("n_expected"),
            F.min_by(F.struct("idx", "fault"), F.when(F.col("fault").isNotNull(), F.col("idx"))).alias("first"),
        )
        .select(
            "piece_id",
            F.when(~F.col("n_actual").eqNullSafe(F.col("n_expected")), F.lit("other_count"))
            .when(F.col("first").isNotNull(), F.concat_ws("@", F.col("first.fault"), F.col("first.idx").cast("string")))
            .alias("reason"),
        )
    )


def loose_timing_fault(segments: Column, start_s: Column, end_s: Column) -> Column:
    """First timing fault of a piece's segments when no exact window is known; null when sound.

    A segment exceeds the window only if it passes both the window's length and its absolute end.
    """
    faults = F.transform(
        segments,
        lambda s, i: F.when(s["start_s"] >= s["end_s"], F.concat(F.lit("reversed@"), i.cast("string")))
        .when((i > 0) & (s["start_s"] < F.get(segments, i - 1)["start_s"]), F.concat(F.lit("unordered@"), i.cast("string")))
        .when(s["start_s"] < 0, F.concat(F.lit("negative@"), i.cast("string")))
        .when((s["end_s"] > end_s - start_s + 0.1) & (s["end_s"] > end_s + 0.1), F.concat(F.lit("past_window@"), i.cast("string"))),
    )
    return F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0))


# Fixed values of the logo check.
MATCH_THRESHOLD, EDGE_FLOOR, EDGE_GAIN = 0.75, 5.0, 12.0
FAINT_OPACITY, FAINT_CORRELATION, FAINT_EDGE, STRONG_EDGE = 0.7, 0.22, 0.35, 0.90
MARGIN_PX = 20


def expected_corner(frame_w: Column, frame_h: Column, logo_w: Column, logo_h: Column, position: Column) -> Column:
    """Top-left corner a logo must have for a named zone."""
    right, bottom = frame_w - logo_w - MARGIN_PX, frame_h - logo_h - MARGIN_PX
    mid_x, mid_y, edge = (frame_w - logo_w) / 2, (frame_h - logo_h) / 2, F.lit(float(MARGIN_PX))
    x = F.when(position.endswith("_left"), edge).when(position.endswith("_right"), right.cast("double")).otherwise(mid_x)
    y = (
        F.when(position.startswith("top_") | (position == "center_top"), edge)
        .when(position.startswith("bottom_") | (position == "center_bottom"), bottom.cast("double"))
        .otherwise(mid_y)
    )
    return F.struct(x.alias("x"), y.alias("y"))


def sample_fault() -> Column:
    """First reason one sampled frame does not show the logo: likeness, then size, then zone."""
    floor = F.greatest(F.lit(EDGE_FLOOR), F.col("opacity") * EDGE_GAIN)
    unlike = F.when(F.col("metric") == "edge", F.col("correlation") < floor).otherwise(F.col("correlation") < MATCH_THRESHOLD)
    inside = (F.abs(F.col("x") - F.col("expected_x")) <= F.greatest(F.lit(8.0), 0.02 * F.col("frame_w"))) & (
        F.abs(F.col("y") - F.col("expected_y")) <= F.greatest(F.lit(8.0), 0.02 * F.col("frame_h"))
    )
    return (
        F.when(F.coalesce(unlike, F.lit(True)), "unlike")
        .when(F.col("logo_w") / F.col("frame_w") < F.col("min_width_ratio"), "too_small")
        .when(~F.coalesce(inside, F.lit(False)), "wrong_zone")
    )


def logo_verdicts(samples: DataFrame) -> DataFrame:
    """Per piece, the verdict when every sample must show the logo and when one is enough."""
    judged = samples.withColumn("_hit", sample_fault().isNull())
    faint = (F.col("metric") == "ccoeff") & (F.col("correlation") >= FAINT_CORRELATION) & F.coalesce(F.col("edge_score") >= FAINT_EDGE, F.lit(False))
    strong = F.coalesce(F.col("edge_score") >= STRONG_EDGE, F.lit(False))
    rolled = judged.groupBy("piece_id").agg(
        F.min("_hit").alias("all_hit"),
        F.max("_hit").alias("any_hit"),
        F.min((F.col("metric") == "ccoeff") & (F.col("opacity") < FAINT_OPACITY)).alias("faint_ok"),
        F.min(faint).alias("all_faint"),
        F.max(faint).alias("any_faint"),
        F.min(strong).alias("all_strong"),
        F.max(faint & strong).alias("any_strong"),
        F.count(F.lit(1)).alias("n_samples"),
    )

    def verdict(hit: str, signal: str, sure: str) -> Column:
        usable = F.col("faint_ok") & F.col(signal)
        return F.when(F.col(hit), PASS).when(usable & F.col(sure), PASS).when(usable, MANUAL).otherwise(FAIL)

    return rolled.select(
        "piece_id",
        "n_samples",
        verdict("all_hit", "all_faint", "all_strong").alias("logo_all"),
        verdict("any_hit", "any_faint", "any_strong").alias("logo_any"),
    )


def sample_times(duration: Column) -> Column:
    """Cell centres for full-length sampling: four per second, at least 12 and at most 120."""
    n = F.least(F.lit(120), F.greatest(F.lit(12), F.ceil(duration * 4).cast("int")))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: duration * (i + 0.5) / n)
