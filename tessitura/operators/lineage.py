"""Fingerprints, stale stages, reuse, jobs, timelines and names."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from tessitura.functions.digest import canonical_text, digest, json_text
from tessitura.functions.text import RESERVED_NAMES
from tessitura.plans.chain import FOLD_ROWS, fold_runs
from tessitura.plans.scan import prefix_scan, row_block, summary

# Fixed values.
SOURCE_STAGES = ("transcribe", "moments", "select", "reframe", "subtitles", "completed")
AUDIO_STAGES = ("subtitles", "completed")
MAX_NAME = 64
INPUT_FIELDS = {
    "audio": ("locked", "track_path", "track_url", "mix_ratio"),
    "render": ("ffmpeg", "timeout_s", "nvenc_available", "target_aspect", "aspect_tolerance"),
    "ranges": ("start_sec", "end_sec"),
}
CAPTION_STYLE = {
    "capitalization": "original", "subtitle_language": "original",
    "primary_color": "&H00FFFFFF", "highlight_color": "&H000000FF", "outline_color": "&H00000000", "back_color": "&H00000000",
    "fontname": "Arial", "fontsize": 48, "outline": 2, "shadow": 0, "margin_v": 40, "alignment": 2,
}
#: Contract fields that count only where declared, with the JSON they have otherwise.
UNSET = {
    "languages.language": "null",
    "audio_policy": "null",
    "outputs": '[{"aspect":"9:16","index":0}]',
    "hook_keyword": "null",
    "unmapped": "[]",
    "brand_safety_required": "false",
    "brand_safety_citation": "null",
    "timestamp_ranges": "[]",
    "lyric_video": "null",
    "split_screen": "null",
    "caption_style": json.dumps(CAPTION_STYLE, sort_keys=True, separators=(",", ":")),
    "layout_spec": "null",
    "watermark.position": '"top_right"',
    "watermark.scale_ratio": "0.2",
    "watermark.opacity": "1.0",
    "watermark.min_width_ratio": "0.05",
}
VOLATILE = frozenset({"assets.required.*.resolved_at", "assets.optional.*.resolved_at"})
INTERRUPTED = "no_final_result"
PRESETS = {"clean": (54, "&H00000000", 1), "bold": (62, "&H80000000", 1), "boxed": (54, "&H99000000", 3)}
SIZES = {"small": 46, "large": 70}
ROWS = {"top": (7, 60), "middle": (4, 0), "bottom": (1, 80)}
COLUMNS = {"left": 0, "center": 1, "right": 2}
OUTLINES = {"none": 0, "thin": 2, "thick": 4}
SHADOWS = {"none": 0, "soft": 1, "strong": 3}


def safe_name(name: Column) -> Column:
    """Whether a name is a portable path segment."""
    stem = F.lower(F.substring_index(name, ".", 1))
    return (
        (F.char_length(name) <= MAX_NAME) & name.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?\z") & ~stem.isin(*RESERVED_NAMES)
    )


def piece_name(campaign: Column, platform: Column, index: Column, shape: Column) -> Column:
    """Piece id from its parts (nulls are left out) and a reason where it would be too long; never cut."""
    name = F.concat_ws("-", campaign, platform, F.format_string("%02d", index), shape)
    name = F.when(index.isNull(), F.concat_ws("-", campaign, platform, shape)).otherwise(name)
    return F.struct(F.when(F.char_length(name) <= MAX_NAME, name).alias("piece_id"), F.when(F.char_length(name) > MAX_NAME, "too_long").alias("reason"))


def expired_temporaries(folders: DataFrame, cutoff: Column) -> DataFrame:
    """Temporary folders old enough to go; lists only. ``folders``: ``path, modified`` relative to the root.

    Two levels deep: below a temporary folder nothing more is listed, nor below protected ones.
    """
    temporary = lambda n: (
        n.startswith("tmp") | n.startswith(".tmp") | n.startswith(".part-") | F.contains(n, F.lit("-tmp-")) | n.endswith(".tmp") | n.isin("temp", ".temp")
    )
    parts = F.split("path", "/")
    parent, leaf = F.get(parts, F.lit(0)), F.lower(F.element_at(parts, -1))
    nested = (F.size(parts) == 2) & ~temporary(F.lower(parent)) & ~parent.isin("fixtures", "pending")
    return folders.filter(((F.size(parts) == 1) | nested) & temporary(leaf) & (F.col("modified") <= cutoff))


def input_fingerprint(runs: DataFrame) -> DataFrame:
    """``runs`` with the digest of everything that decides a run's result, and nothing else.

    ``runs``: ``url, contract, face_model_path, audio, render, ranges, repost_mode, watermark, lyric_video, split_screen``;
    ``contract`` is a digest, ``audio`` and ``render`` are structs of which only the listed fields count, ``ranges`` an
    array of structs. Columns and fields beyond the list do not move the digest. The last two are left out where null.
    """
    picked = lambda name: F.struct(*[F.col(name)[f].alias(f) for f in INPUT_FIELDS[name]]).alias(name)
    ranges = F.coalesce("ranges", F.array().cast(runs.schema["ranges"].dataType))
    payload = F.struct(
        F.lit("long_video").alias("pipeline"), "url", "contract", "face_model_path", picked("audio"), picked("render"),
        F.struct(
            F.transform(ranges, lambda r: F.struct(*[r[f].alias(f) for f in INPUT_FIELDS["ranges"]])).alias("timestamp_ranges"),
            (F.size(ranges) > 0).alias("download_section_mode"),
        ).alias("download"),
        "repost_mode", "watermark", "lyric_video", "split_screen",
    )
    held = runs.withColumn("_payload", payload)
    text = canonical_text(F.col("_payload"), held.schema["_payload"].dataType, {"lyric_video": "null", "split_screen": "null"})
    return held.withColumn("fingerprint", F.sha2(text, 256)).drop("_payload")


def stale_stages(changes: DataFrame) -> DataFrame:
    """Stages to redo per run. ``changes``: ``run_id, source_changed, audio_changed``. A source change also drops coordinates."""
    stages = F.array_distinct(
        F.concat(
            F.when(F.col("source_changed"), F.array(*[F.lit(s) for s in SOURCE_STAGES])).otherwise(F.array().cast("array<string>")),
            F.when(F.col("audio_changed"), F.array(*[F.lit(s) for s in AUDIO_STAGES])).otherwise(F.array().cast("array<string>")),
        )
    )
    return changes.select("run_id", F.col("source_changed").alias("drop_coords"), F.explode(stages).alias("stage"))


def reusable_segments(current: DataFrame, stored: DataFrame) -> DataFrame:
    """A segment is reused only if the stored one at the same index has exactly its bounds."""
    old = stored.select("run_id", "index", F.col("start_s").alias("_a"), F.col("end_s").alias("_b"))
    same = (F.col("_a") == F.col("start_s")) & (F.col("_b") == F.col("end_s"))
    return current.join(old, ["run_id", "index"], "left").withColumn("reuse", F.coalesce(same, F.lit(False))).drop("_a", "_b")


def review_after_rebind(variants: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every variant of a project needs review when any of its three digests changed."""
    new = evidence.select("project_id", *[F.col(c).alias(f"_{c}") for c in ("analysis", "transcript", "source")])
    same = F.lit(True)
    for c in ("analysis", "transcript", "source"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        variants.join(new.withColumn("_known", F.lit(True)), "project_id", "left")
        .withColumn("status", F.when(F.col("_known") & ~same, "requires_review").otherwise(F.col("status")))
        .select(*variants.columns)
    )


def variant_revision(rows: DataFrame) -> DataFrame:
    """Digest of a variant together with the evidence it stands on."""
    fields = {c: json_text(F.col(c)) for c in ("project_id", "analysis_sha256", "transcript_sha256", "source_sha256")}
    fields["source_duration_ms"] = F.col("source_duration_ms").cast("string")
    fields["variant"] = F.col("variant_json")
    return rows.withColumn("revision", digest(fields))


def contract_digest(contracts: DataFrame, column: str = "contract") -> DataFrame:
    """``contracts`` with the digest of a nested contract column.

    What was not declared is left out, so contracts written before a field existed keep their digest; times of resolution
    never count.
    """
    text = canonical_text(F.col(column), contracts.schema[column].dataType, UNSET, VOLATILE)
    return contracts.withColumn("digest", F.sha2(text, 256))


def cache_hits(streams: DataFrame, cached: DataFrame, version: str) -> DataFrame:
    """Streams whose stored candidates stand: same source, same segmenter."""
    return streams.join(
        cached.filter(F.col("segmenter_version") == version).select("stream_id", "source_sha256"), ["stream_id", "source_sha256"], "left_semi"
    )


def job_faults(jobs: DataFrame) -> DataFrame:
    """First reason a job row is not allowed, or null."""
    path, parts = F.col("output_path"), F.filter(F.split("output_path", "/"), lambda p: (p != "") & (p != "."))
    reason = (
        F.when(F.contains(path, F.lit("\\")), "backslash")
        .when(path.startswith("/"), "absolute")
        .when(F.array_contains(parts, ".."), "escapes")
        .when((F.size(parts) < 2) | (F.get(parts, F.lit(0)) != "delivery"), "outside_delivery")
        .when(~F.lower(F.element_at(parts, -1)).rlike(r"[^.]\.mp4$"), "not_mp4")
        .when((F.col("state") == "completed") & F.col("error").isNotNull(), "completed_with_error")
        .when(F.col("state").isin("pending", "running") & F.col("error").isNotNull(), "open_with_error")
        .when(F.col("state").isin("failed", "interrupted") & (F.coalesce("error", F.lit("")) == ""), "failed_without_error")
    )
    return jobs.withColumn("reason", reason)


def recovered_jobs(jobs: DataFrame, active_queues: DataFrame) -> DataFrame:
    """Running jobs of a queue without a live worker are interrupted, with the reason as their error."""
    live = active_queues.select("queue_id").distinct().withColumn("_live", F.lit(True))
    lost = (F.col("state") == "running") & F.col("_live").isNull()
    return (
        jobs.join(live, "queue_id", "left")
        .withColumn("error", F.when(lost, F.lit(INTERRUPTED)).otherwise(F.col("error")))
        .withColumn("state", F.when(lost, F.lit("interrupted")).otherwise(F.col("state")))
        .select(*jobs.columns)
    )


def queue_summary(jobs: DataFrame, stops: DataFrame) -> DataFrame:
    """Completed, failed and next pending job per queue, and whether it was stopped."""
    rolled = jobs.groupBy("queue_id").agg(
        F.count_if(F.col("state") == "completed").alias("completed"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state").isin("failed", "interrupted")).alias("retryable"),
        F.min_by("job_id", F.when(F.col("state") == "pending", F.col("position"))).alias("next_job"),
    )
    flags = stops.select("queue_id").distinct().withColumn("stopped", F.lit(True))
    return rolled.join(flags, "queue_id", "left").withColumn("stopped", F.coalesce("stopped", F.lit(False)))


def job_readiness(jobs: DataFrame, variants: DataFrame, candidates: DataFrame) -> DataFrame:
    """First reason a job may not run, in fixed order. ``variants`` carry own and current digests and revision."""
    known = candidates.select("project_id", F.col("candidate_id").alias("origin_candidate")).distinct().withColumn("_cand", F.lit(True))
    origin = (
        (F.col("own_analysis") == F.col("analysis")) & (F.col("own_transcript") == F.col("transcript")) & (F.col("own_source") == F.col("source"))
    )
    reason = (
        F.when(F.col("status").isNull(), "variant_not_found")
        .when(F.col("status") != "active", "variant_not_active")
        .when(~F.coalesce(origin, F.lit(False)) | F.col("_cand").isNull(), "origin_mismatch")
        .when(~F.col("current_revision").eqNullSafe(F.col("revision")), "revision_mismatch")
    )
    return jobs.join(variants, "variant_id", "left").join(known, ["project_id", "origin_candidate"], "left").select("job_id", reason.alias("reason"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Time per run and stage within the newest process that ran it; a cached stage has no row.

    ``events``: ``run_id, stage, process, elapsed_ms``.
    """
    return (
        events.groupBy("run_id", "stage", "process")
        .agg(F.sum("elapsed_ms").alias("elapsed_ms"))
        .groupBy("run_id", "stage")
        .agg(F.max_by("elapsed_ms", "process").alias("elapsed_ms"), F.max("process").alias("process"))
    )


def tiling_faults(positions: DataFrame, variants: DataFrame) -> DataFrame:
    """First reason a variant's positions do not tile it, or null. ``positions``: ``variant_id, ordinal, position_id, start_ms, end_ms``."""
    linked = prefix_scan(positions, ["variant_id"], ["ordinal"], row_block(F.col("ordinal")), lasts={"_prev": F.col("end_ms")})
    rolled = linked.groupBy("variant_id").agg(
        F.min_by("start_ms", "ordinal").alias("_first"),
        F.max_by("end_ms", "ordinal").alias("_last"),
        F.max(F.coalesce(F.col("_prev") != F.col("start_ms"), F.lit(False))).alias("_gap"),
    )
    repeated = positions.groupBy("variant_id", "position_id").count().filter("count > 1").select("variant_id").distinct().withColumn("_dup", F.lit(True))
    reason = (
        F.when(F.col("_first").isNull(), "empty")
        .when(F.col("end_ms") <= F.col("start_ms"), "reversed")
        .when(F.col("_dup"), "duplicate_id")
        .when((F.col("_first") != F.col("start_ms")) | (F.col("_last") != F.col("end_ms")), "not_covered")
        .when(F.col("_gap"), "not_continuous")
    )
    return variants.join(rolled, "variant_id", "left").join(repeated, "variant_id", "left").select("variant_id", reason.alias("reason"))


def _neighbours(positions: DataFrame) -> DataFrame:
    order, block = ["ordinal"], row_block(F.col("ordinal"))
    here = F.struct("position_id", "start_ms", "end_ms")
    before = prefix_scan(positions, ["variant_id"], order, block, lasts={"_prev": here})
    return prefix_scan(before, ["variant_id"], order, block, lasts={"_next": here}, reverse=True)


def split_positions(positions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, rejects). ``edits``: ``variant_id, position_id, at_ms, new_id``, at most one per position; strictly inside."""
    asked = edits.select("variant_id", "position_id", "at_ms", "new_id")
    joined = positions.join(asked, ["variant_id", "position_id"], "left")
    inside = F.coalesce((F.col("at_ms") > F.col("start_ms")) & (F.col("at_ms") < F.col("end_ms")), F.lit(False))
    halves = F.when(
        inside,
        F.array(
            F.struct("position_id", "start_ms", F.col("at_ms").alias("end_ms")),
            F.struct(F.col("new_id").alias("position_id"), F.col("at_ms").alias("start_ms"), "end_ms"),
        ),
    ).otherwise(F.array(F.struct("position_id", "start_ms", "end_ms")))
    result = joined.select("variant_id", "ordinal", F.explode(halves).alias("p")).select("variant_id", "ordinal", "p.*")
    missing = asked.join(positions, ["variant_id", "position_id"], "left_anti").select("variant_id", "position_id", F.lit("not_found").alias("reason"))
    bad = joined.filter(F.col("at_ms").isNotNull() & ~inside).select("variant_id", "position_id", F.lit("not_inside").alias("reason"))
    return result, missing.unionByName(bad)


def delete_positions(positions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, rejects). ``edits``: ``variant_id, position_id, absorb``, one per variant.

    The first position is absorbed by its successor and the last by its predecessor; an interior one
    must say which. The only position stays.
    """
    around = _neighbours(positions)
    victim = around.join(edits, ["variant_id", "position_id"])
    reason = F.when(F.col("_prev").isNull() & F.col("_next").isNull(), "only_position").when(
        F.col("_prev").isNotNull() & F.col("_next").isNotNull() & ~F.coalesce(F.col("absorb").isin("previous", "next"), F.lit(False)), "absorb_needed"
    )
    judged = victim.withColumn("reason", reason)
    to_next = F.col("_prev").isNull() | (F.col("_next").isNotNull() & (F.col("absorb") == "next"))
    plan = judged.filter(F.col("reason").isNull()).select(
        "variant_id",
        F.col("position_id").alias("gone"),
        F.when(to_next, F.col("_next.position_id")).otherwise(F.col("_prev.position_id")).alias("heir"),
        F.when(to_next, F.col("start_ms")).alias("new_start"),
        F.when(~to_next, F.col("end_ms")).alias("new_end"),
    )
    kept = (
        positions.join(plan, "variant_id", "left")
        .filter(F.col("gone").isNull() | (F.col("gone") != F.col("position_id")))
        .withColumn("start_ms", F.when(F.col("heir") == F.col("position_id"), F.coalesce("new_start", "start_ms")).otherwise(F.col("start_ms")))
        .withColumn("end_ms", F.when(F.col("heir") == F.col("position_id"), F.coalesce("new_end", "end_ms")).otherwise(F.col("end_ms")))
        .select(*positions.columns)
    )
    rejects = judged.filter(F.col("reason").isNotNull()).select("variant_id", "position_id", "reason").unionByName(
        edits.join(positions, ["variant_id", "position_id"], "left_anti").select("variant_id", "position_id", F.lit("not_found").alias("reason"))
    )
    return kept, rejects


def _edited(at: list[list], log: list[tuple], bad: list[tuple]) -> None:
    """Applies a variant's edits to its positions ``[ordinal, id, start, end]``, in place; refused ones go to ``bad``."""
    for no, kind, asked, cut_at, new_id, absorb in log:
        for i, place in enumerate(at):
            if asked is not None and place[1] == asked:
                break
        else:
            i = -1
        last = len(at) - 1
        if kind not in ("split", "delete"):
            bad.append((no, asked, "unknown_edit"))
        elif i < 0:
            bad.append((no, asked, "not_found"))
        elif kind == "split":
            ordinal, own, start, end = at[i]
            if None in (cut_at, start, end) or not start < cut_at < end:
                bad.append((no, asked, "not_inside"))
            else:
                at[i : i + 1] = [[ordinal, own, start, cut_at], [ordinal, new_id, cut_at, end]]
        elif last == 0:
            bad.append((no, asked, "only_position"))
        elif 0 < i < last and absorb not in ("previous", "next"):
            bad.append((no, asked, "absorb_needed"))
        else:
            if i == 0 or (i < last and absorb == "next"):
                at[i + 1][2] = at[i][2]
            else:
                at[i - 1][3] = at[i][3]
            del at[i]


def edit_outcomes(positions: DataFrame, edits: DataFrame) -> DataFrame:
    """Positions and rejects after all edits, in one frame: rejects are the rows with a ``reason``.

    Both sides are those of ``edited_positions``; a reject has ``edit_no``, ``asked_id`` and ``reason``, a position the rest.
    Many variants are folded in one Arrow call. Of a variant with more than ``FOLD_ROWS`` positions, only those that an edit
    names, and their neighbours, enter the fold; all others pass by.
    """
    columns = ["ordinal", "position_id", "start_ms", "end_ms"]
    asked = ["edit_no", "kind", "asked_id", "at_ms", "new_id", "absorb"]
    large = summary(positions.groupBy("variant_id").count().filter(F.col("count") > FOLD_ROWS).select("variant_id"))
    touched, passed = positions, None
    if not large.isEmpty():
        named = edits.select("variant_id", "position_id").distinct().withColumn("_named", F.lit(True))
        marked = positions.join(large, "variant_id", "left_semi").join(named, ["variant_id", "position_id"], "left").withColumn("_named", F.coalesce("_named", F.lit(False)))
        order, block = ["ordinal"], row_block(F.col("ordinal"))
        marked = prefix_scan(marked, ["variant_id"], order, block, lasts={"_before": F.col("_named")})
        marked = prefix_scan(marked, ["variant_id"], order, block, lasts={"_after": F.col("_named")}, reverse=True)
        near = F.col("_named") | F.coalesce("_before", F.lit(False)) | F.coalesce("_after", F.lit(False))
        touched = positions.join(large, "variant_id", "left_anti").unionByName(marked.filter(near).select("variant_id", *columns))
        passed = marked.filter(~near).select("variant_id", *columns)
    log = edits.withColumnRenamed("position_id", "asked_id").select("variant_id", *asked)
    rows = touched.select("variant_id", *columns, F.lit(False).alias("is_edit")).unionByName(log.withColumn("is_edit", F.lit(True)), allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = StructType([StructField(c, StringType() if c == "reason" else kinds[c]) for c in ["variant_id", *columns, "edit_no", "asked_id", "reason"]])

    def fold(table: pa.Table, edges: list[int]) -> pa.Table:
        is_edit, variants = table["is_edit"].to_numpy(), table["variant_id"].take(edges[:-1])
        n_log = np.add.reduceat(is_edit.astype(np.int64), edges[:-1])
        wanted, places = (list(zip(*[table[c].filter(m).to_pylist() for c in names], strict=True)) for names, m in ((asked, is_edit), (columns, ~is_edit)))
        kept, bad, n_kept, n_bad, p, e = [], [], [], [], 0, 0
        for n_at, n_edits in zip((np.diff(edges) - n_log).tolist(), n_log.tolist(), strict=True):
            at, known = list(map(list, places[p : p + n_at])), len(bad)
            _edited(at, wanted[e : e + n_edits], bad)
            p, e = p + n_at, e + n_edits
            kept += at
            n_kept.append(len(at))
            n_bad.append(len(bad) - known)

        def side(rows: list, counts: list[int], names: list[str]) -> pa.Table:
            values = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {}
            keys = variants.take(np.repeat(np.arange(len(counts)), counts))
            return pa.table([keys if f.name == "variant_id" else pa.array(values[f.name], f.type) if f.name in values else pa.nulls(len(rows), f.type) for f in arrow], schema=arrow)

        return pa.concat_tables([side(kept, n_kept, columns), side(bad, n_bad, ["edit_no", "asked_id", "reason"])])

    arrow = to_arrow_schema(schema)
    done = fold_runs(rows, ["variant_id"], ["is_edit", *columns, *asked], fold, schema)
    return done if passed is None else done.unionByName(passed, allowMissingColumns=True)


def edited_positions(positions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, rejects) after all edits of every variant in the order of their numbers.

    ``positions``: ``variant_id, ordinal, position_id, start_ms, end_ms``; ``edits``: ``variant_id, edit_no, kind, position_id,
    at_ms, new_id, absorb`` with kind ``split`` or ``delete``. Each edit sees what the earlier ones left, so a position made by
    a split can be edited again. A refused edit changes nothing and is a reject ``variant_id, edit_no, position_id, reason``:
    ``unknown_edit``, ``not_found``, ``not_inside`` (splits are strictly inside), ``only_position`` or ``absorb_needed`` (the
    first position is absorbed by its successor, the last by its predecessor, an interior one must say which). The second
    half of a split keeps the ordinal of the first, whose geometry it shares. Of equal position ids the first is meant.

    A variant's edits are one value, as each depends on the one before: they are decisions made by hand. Who needs both
    sides takes ``edit_outcomes``, which folds once.
    """
    done = edit_outcomes(positions, edits)
    kept = done.filter("reason IS NULL").select("variant_id", "ordinal", "position_id", "start_ms", "end_ms")
    return kept, done.filter("reason IS NOT NULL").select("variant_id", "edit_no", F.col("asked_id").alias("position_id"), "reason")


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def caption_style(rows: DataFrame) -> DataFrame:
    """Font size, colours and placement of a named caption style."""
    size = F.coalesce(_lookup(SIZES, F.col("size")), _lookup({k: v[0] for k, v in PRESETS.items()}, F.col("preset")))
    return rows.select(
        "*",
        size.alias("font_size"),
        _lookup({k: v[1] for k, v in PRESETS.items()}, F.col("preset")).alias("back_colour"),
        _lookup({k: v[2] for k, v in PRESETS.items()}, F.col("preset")).alias("border_style"),
        (_lookup({k: v[0] for k, v in ROWS.items()}, F.col("vertical")) + _lookup(COLUMNS, F.col("horizontal"))).alias("alignment"),
        _lookup({k: v[1] for k, v in ROWS.items()}, F.col("vertical")).alias("margin_v"),
        _lookup(OUTLINES, F.col("outline")).alias("outline_px"),
        _lookup(SHADOWS, F.col("shadow")).alias("shadow_px"),
    )


def write_report(rows: DataFrame, path: str, run_column: str = "run_id") -> None:
    """One JSON partition per run; a run's earlier report is replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_column).json(path)


