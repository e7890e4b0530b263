"""Geometry, tracks, timelines, jobs and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import digest as dg
from tessitura.operators import lineage as op
from tessitura.operators import track as tr
from tessitura.sources.tables import table

SHOW, TALL = tr.TrackParams(), tr.TrackParams(1080, 2400)


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Two face boxes a frame from the first embedding values, folded into the frame; label = video, one frame per vector.

    The second box is the first one mirrored, so both are equally large; every third frame holds it once more, smaller.
    In every fifth video the face jumps from edge to edge, so its track never settles.
    """
    unit = lambda i: F.abs(F.element_at("embedding", i).cast("double")) % 1.0
    jumps = F.col("label") % 5 == 3
    n = F.col("vec_id")
    first = table(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("video_id"), n.alias("frame_no"),
        F.when(jumps, F.when(n % 2 == 0, 0.0).otherwise(0.95)).otherwise(unit(1)).alias("x"), unit(2).alias("y"), (unit(3) * 0.5 + 0.01).alias("w"), (unit(4) * 0.5 + 0.01).alias("h"),
        F.when(jumps, 0.9).otherwise(n % 10 / 10.0).alias("confidence"),
    )
    box = lambda pos, x, shrink: F.struct(F.lit(pos).alias("pos"), x.alias("x"), F.col("y"), (F.col("w") * shrink).alias("w"), F.col("h"), F.col("confidence"))
    many = F.array_compact(F.array(F.when(F.col("frame_no") % 3 == 0, box(0, F.col("x") + 0.1, 0.5)), box(1, F.col("x"), 1.0), box(2, 1.0 - F.col("x"), 1.0)))
    return first.select("video_id", "frame_no", F.explode(many).alias("b")).select("video_id", "frame_no", "b.*")


def centres(spark: SparkSession, folder: str, shape: tr.TrackParams = SHOW) -> DataFrame:
    faces = boxes(spark, folder)
    return tr.desired_centres(tr.primary_faces(faces.select("video_id", "frame_no").distinct(), faces, shape.min_confidence), shape)


def desired_centres(spark: SparkSession, folder: str) -> DataFrame:
    return centres(spark, folder).select("video_id", "frame_no", F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"))


def crop_track(spark: SparkSession, folder: str) -> DataFrame:
    """Wide recordings, whose crop moves sideways; several blocks a video."""
    return tr.crop_targets(tr.smoothed_track(centres(spark, folder), SHOW, block_frames=128, fan=4), SHOW)


def crop_track_tall(spark: SparkSession, folder: str) -> DataFrame:
    """Tall recordings, whose crop moves up and down."""
    return tr.crop_targets(tr.smoothed_track(centres(spark, folder, TALL), TALL, block_frames=64), TALL)


def track_position(spark: SparkSession, folder: str) -> DataFrame:
    faces = boxes(spark, folder).filter(F.col("pos") == 1)
    keys = faces.filter(F.col("frame_no") % 3 == 0).select("video_id", F.col("frame_no").cast("double").alias("t"), F.rint(F.col("x") * 1000).alias("v"))
    asked = faces.select("video_id", (F.col("frame_no") + 0.5).alias("t"))
    return tr.track_position(keys, asked).select("video_id", "t", F.round("v", 6).alias("v"))


def geometry(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select((F.col("l_quantity") * 37).cast("int").alias("w"), (F.col("l_partkey") % 80 * 13).cast("int").alias("h")).distinct()
    crop, canvas = tr.crop_size(F.col("w"), F.col("h")), tr.canvas_size(F.col("w"), F.lit(0.8))
    rect = F.struct(F.lit(0.1).alias("x"), F.lit(0.25).alias("y"), F.lit(0.33).alias("width"), F.lit(0.5).alias("height"))
    box = tr.crop_box(rect, F.col("w"), F.col("h"))
    return lines.select(
        "w", "h", crop["width"].alias("crop_w"), crop["height"].alias("crop_h"), crop["reason"].alias("reason"), canvas["width"].alias("canvas_w"),
        canvas["height"].alias("canvas_h"), box["width"].alias("box_w"), box["height"].alias("box_h"), box["x"].alias("box_x"), box["y"].alias("box_y"),
        tr.even_round(F.col("w") / 3.0).alias("rounded"), tr.even_floor(F.col("w")).alias("floored"),
    )


def band_heights(spark: SparkSession, folder: str) -> DataFrame:
    layouts = F.array(*[F.lit(x) for x in ("single", "dividido", "trio", "spotlight")])
    lines = table(spark, folder, "lineitem").select(
        F.element_at(layouts, (F.col("l_orderkey") % 4 + 1).cast("int")).alias("layout"), (F.col("l_quantity") * 40 + 2).cast("int").alias("height")
    ).distinct()
    return lines.select("layout", "height", F.posexplode(tr.band_heights(F.col("layout"), F.col("height"))).alias("band", "px"))


def caption_styles(spark: SparkSession, folder: str) -> DataFrame:
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    d = F.col("doc_id")
    rows = table(spark, folder, "documents").select(
        "doc_id", pick(("clean", "bold", "boxed"), d).alias("preset"), pick(("small", "medium", "large"), F.floor(d / 3)).alias("size"),
        pick(("top", "middle", "bottom"), F.floor(d / 9)).alias("vertical"), pick(("left", "center", "right"), F.floor(d / 27)).alias("horizontal"),
        pick(("none", "thin", "thick"), d).alias("outline"), pick(("none", "soft", "strong"), F.floor(d / 3)).alias("shadow"),
    )
    return op.caption_style(rows).select("doc_id", "font_size", "back_colour", "border_style", "alignment", "margin_v", "outline_px", "shadow_px")


def positions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as consecutive positions whose lengths are quantities; orders divisible by ten break."""
    from tessitura.plans.scan import prefix_scan, row_block

    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("variant_id"), F.col("l_linenumber").alias("ordinal")).agg(
        F.max("l_quantity").cast("long").alias("len")
    )
    laid = prefix_scan(lines, ["variant_id"], ["ordinal"], row_block(F.col("ordinal")), sums={"start_ms": F.col("len")})
    broken = F.when((F.col("variant_id") % 10 == 0) & (F.col("ordinal") > 2), 1).otherwise(0)
    places = laid.select(
        "variant_id", F.col("ordinal").cast("long").alias("ordinal"),
        F.when((F.col("variant_id") % 25 == 3), F.lit(7)).otherwise(F.col("ordinal")).cast("long").alias("position_id"),
        (F.col("start_ms") + broken).alias("start_ms"), (F.col("start_ms") + F.col("len")).alias("end_ms"),
    )
    ends = places.groupBy("variant_id").agg(F.max("end_ms").alias("end_ms"))
    variants = table(spark, folder, "orders").select(F.col("o_orderkey").alias("variant_id")).join(ends, "variant_id", "left").select(
        "variant_id", F.lit(0).cast("long").alias("start_ms"), (F.coalesce("end_ms", F.lit(1)) + F.when(F.col("variant_id") % 40 == 7, 5).otherwise(0)).alias("end_ms")
    )
    return places, variants


def timeline_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return op.tiling_faults(*positions(spark, folder)).select("variant_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


def timeline_edits(spark: SparkSession, folder: str) -> DataFrame:
    places = positions(spark, folder)[0].filter((F.col("variant_id") % 25 != 3) & (F.col("variant_id") % 10 != 0))
    cuts = places.filter((F.col("ordinal") == 2) & (F.col("variant_id") % 2 == 0)).select(
        "variant_id", "position_id", (F.col("start_ms") + F.col("variant_id") % 20).alias("at_ms"), F.lit(100).cast("long").alias("new_id")
    )
    halves, split_rejects = op.split_positions(places, cuts)
    drops = places.filter((F.col("variant_id") % 3 == 0) & (F.col("ordinal") == F.col("variant_id") % 4 + 1)).select(
        "variant_id", "position_id", F.when(F.col("variant_id") % 5 == 1, "previous").when(F.col("variant_id") % 5 == 2, "next").alias("absorb")
    )
    kept, drop_rejects = op.delete_positions(places, drops)
    total = lambda f, k: f.groupBy("variant_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms")).select(F.lit(k).alias("edit"), "*")
    faults = lambda f, k: f.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(k), F.col("reason")).alias("edit"), F.lit(-1).cast("long").alias("variant_id"), "n", F.lit(0).cast("long").alias("ms"))
    return total(halves, "split").unionByName(total(kept, "delete")).unionByName(faults(split_rejects, "split:")).unionByName(faults(drop_rejects, "delete:"))


def timeline_edit_log(spark: SparkSession, folder: str) -> DataFrame:
    """Six edits of every order in turn, some of positions that earlier ones made or took, also where ids repeat or times break."""
    v = F.col("variant_id")
    places = positions(spark, folder)[0]
    second = places.groupBy("variant_id").agg(F.max(F.when(F.col("ordinal") == 2, F.col("start_ms"))).alias("a"))
    absorb = F.when(v % 5 == 1, "previous").when(v % 5 == 2, "next")
    edit = lambda no, kind, pid, at=None, new=None, side=None: F.struct(
        F.lit(no).alias("edit_no"), F.lit(kind).alias("kind"), pid.cast("long").alias("position_id"),
        (F.lit(None) if at is None else at).cast("long").alias("at_ms"), F.lit(new).cast("long").alias("new_id"), (F.lit(None) if side is None else side).cast("string").alias("absorb"),
    )
    log = F.array(
        edit(1, "split", F.lit(2), F.col("a") + v % 20, 100), edit(2, "delete", v % 4 + 1, side=absorb), edit(3, "split", F.lit(100), F.col("a") + v % 20 + v % 7, 101),
        edit(4, "delete", F.lit(100), side=F.lit("next")), edit(5, "delete", F.lit(2), side=F.lit("previous")), edit(6, "delete", F.lit(1)),
    )
    edits = second.select("variant_id", F.explode(log).alias("e")).select("variant_id", "e.*")
    return op.edit_outcomes(places, edits).select(
        "variant_id", F.coalesce("reason", F.lit("kept")).alias("kind"), F.when(F.col("reason").isNull(), F.col("position_id")).otherwise(F.col("asked_id")).alias("position_id"),
        F.when(F.col("reason").isNull(), F.col("start_ms")).otherwise(F.col("edit_no").cast("long")).alias("a"), F.col("end_ms").alias("b"),
    )


def clerk(key: Column) -> Column:
    return F.concat(F.lit("clerk "), key)


def contract_digests(spark: SparkSession, folder: str) -> DataFrame:
    """A nested contract per order; what is not declared and the time of resolution do not count."""
    o = F.col("o_orderkey")
    asset = lambda key: F.struct(key.alias("asset_id"), F.col("o_orderdate").cast("string").alias("resolved_at"))
    output = lambda aspect, no: F.struct(F.lit(aspect).alias("aspect"), F.lit(no).alias("index"))
    limits = lambda low: F.struct(low.cast("double").alias("min_s"), F.when(o % 2 == 0, o * 2.5).cast("double").alias("max_s"))
    contract = F.struct(
        F.struct(F.when(o % 3 == 0, F.lit("es\n\"ñ")).alias("language"), F.array("o_orderstatus").alias("subtitles")).alias("languages"),
        F.when(o % 4 == 0, "internal").alias("audio_policy"),
        F.when(o % 5 == 0, F.array(output("1:1", 0), output("9:16", 1))).otherwise(F.array(output("9:16", 0))).alias("outputs"),
        F.struct(F.array(asset(clerk(F.col("o_custkey")))).alias("required"), F.array().cast("array<struct<asset_id:string,resolved_at:string>>").alias("optional")).alias("assets"),
        F.struct((o % 2 == 0).alias("required"), (o % 10 / 20).alias("scale_ratio"), F.when(o % 7 == 0, "center_bottom").otherwise("top_right").alias("position")).alias("watermark"),
        F.create_map(F.lit("tiktok"), limits(o % 9), F.lit("reels"), limits(o % 8 / 1000000)).alias("platforms"),
        (o % 6 == 0).alias("brand_safety_required"),
    )
    return op.contract_digest(table(spark, folder, "orders").select(o.alias("contract_id"), contract.alias("contract"))).select("contract_id", "digest")


def input_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """One run per order; its note and thread count are not on the list."""
    o = F.col("o_orderkey")
    runs = table(spark, folder, "orders").select(
        o.alias("run_id"), F.concat(F.lit("v/"), o % 50).alias("url"), F.sha2(clerk(F.col("o_custkey")), 256).alias("contract"), F.lit(None).cast("string").alias("face_model_path"),
        F.struct((o % 2 == 0).alias("locked"), F.when(o % 3 == 0, clerk(F.col("o_custkey"))).alias("track_path"), F.lit(None).cast("string").alias("track_url"), (o % 5 / 4).alias("mix_ratio"), F.col("o_orderstatus").alias("note")).alias("audio"),
        F.struct(F.lit("ffmpeg").alias("ffmpeg"), F.lit(600.0).alias("timeout_s"), F.lit(False).alias("nvenc_available"), F.lit(0.5625).alias("target_aspect"), F.lit(0.01).alias("aspect_tolerance"), o.alias("threads")).alias("render"),
        F.when(o % 4 == 1, F.array(F.struct((o % 30).cast("double").alias("start_sec"), (o % 30 + 4.5).cast("double").alias("end_sec"), F.lit("q").alias("quote")))).alias("ranges"),
        (o % 2 == 1).alias("repost_mode"), F.lit(None).cast("string").alias("watermark"),
        F.when(o % 6 == 0, F.struct(F.lit("line").alias("text"))).alias("lyric_video"), F.when(o % 8 == 0, F.lit("wide")).alias("split_screen"),
    )
    return op.input_fingerprint(runs).select("run_id", "fingerprint")


def stage_durations(spark: SparkSession, folder: str) -> DataFrame:
    stages = F.array(*[F.lit(s) for s in ("download", *op.SOURCE_STAGES)])
    events = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("run_id"), F.element_at(stages, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("stage"),
        (F.col("o_orderkey") % 3).alias("process"), F.floor("o_totalprice").cast("long").alias("elapsed_ms"),
    )
    return op.stage_durations(events)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise(F.when(o % 2 == 0, "running").otherwise("failed"))
    folder_ = F.when(o % 31 == 0, "/delivery/").when(o % 37 == 0, "delivery/../").when(o % 41 == 0, "out/").otherwise("delivery/")
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % 100).alias("queue_id"), o.alias("job_id"), o.alias("position"), state.alias("state"),
        F.concat(folder_, o.cast("string"), F.when(o % 43 == 0, ".mov").otherwise(".MP4")).alias("output_path"),
        F.when((state == "failed") & (o % 5 != 1), "broke").when((state == "completed") & (o % 47 == 0), "odd").alias("error"),
    )


def job_faults(spark: SparkSession, folder: str) -> DataFrame:
    return op.job_faults(jobs(spark, folder)).select("job_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


def queue_summary(spark: SparkSession, folder: str) -> DataFrame:
    every = jobs(spark, folder)
    active = every.filter(F.col("queue_id") % 4 == 0)
    return op.queue_summary(op.recovered_jobs(every, active), every.filter(F.col("queue_id") % 9 == 0))


def job_readiness(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    every = table(spark, folder, "orders").select(o.alias("job_id"), o.alias("variant_id"), F.concat(F.lit("r"), (o % 4).cast("string")).alias("revision"))
    variants = table(spark, folder, "orders").filter(o % 13 != 0).select(
        o.alias("variant_id"), (F.col("o_custkey") % 10).alias("project_id"), F.when(o % 7 == 0, "requires_review").otherwise("active").alias("status"),
        F.lit("a").alias("own_analysis"), F.lit("t").alias("own_transcript"), F.when(o % 11 == 0, "s0").otherwise("s").alias("own_source"),
        F.lit("a").alias("analysis"), F.lit("t").alias("transcript"), F.lit("s").alias("source"), (o % 6).alias("origin_candidate"),
        F.concat(F.lit("r"), F.when(o % 5 == 0, "9").otherwise((o % 4).cast("string"))).alias("current_revision"),
    )
    found = table(spark, folder, "orders").select((F.col("o_custkey") % 10).alias("project_id"), (o % 5).alias("candidate_id"))
    return op.job_readiness(every, variants, found).select("job_id", F.coalesce("reason", F.lit("ready")).alias("reason"))


def stale_stages(spark: SparkSession, folder: str) -> DataFrame:
    changes = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.col("o_orderstatus") == "F").alias("source_changed"), (F.col("o_custkey") % 2 == 0).alias("audio_changed")
    )
    return op.stale_stages(changes)


def segment_reuse(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("index")).agg(
        F.max("l_quantity").alias("start_s"), (F.max("l_quantity") + 10).alias("end_s")
    )
    stored = lines.filter(F.col("index") < 5).withColumn("end_s", F.when(F.col("run_id") % 3 == 0, F.col("end_s") + 1e-9).otherwise(F.col("end_s")))
    return op.reusable_segments(lines, stored).groupBy("run_id").agg(F.count_if("reuse").alias("n_reused"), F.count(F.lit(1)).alias("n"))


def evidence_review(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    variants = table(spark, folder, "orders").select(
        o.alias("variant_id"), F.col("o_custkey").alias("project_id"), F.lit("active").alias("status"), F.lit("a").alias("analysis"), F.lit("t").alias("transcript"), F.lit("s").alias("source")
    )
    fresh = table(spark, folder, "customer").filter(F.col("c_custkey") % 5 != 4).select(
        F.col("c_custkey").alias("project_id"), F.lit("a").alias("analysis"), F.when(F.col("c_custkey") % 3 == 0, "t2").otherwise("t").alias("transcript"), F.lit("s").alias("source")
    )
    return op.review_after_rebind(variants, fresh).groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"))


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(
        "doc_id", F.concat(F.lit('p"'), F.col("source")).alias("project_id"), F.sha2("text", 256).alias("analysis_sha256"), F.sha2("lang", 256).alias("transcript_sha256"),
        F.sha2("source", 256).alias("source_sha256"), F.col("n_chars").alias("source_duration_ms"),
        dg.canonical_json({"name": dg.json_text(F.concat("lang", F.lit("\n\\ñ"))), "id": F.col("doc_id").cast("string"), "style": F.when(F.col("doc_id") % 2 == 0, F.lit("1"))}, frozenset({"style"})).alias("variant_json"),
    )
    return op.variant_revision(rows).select("doc_id", "revision")


def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("stream_id"), F.sha2("text", 256).alias("source_sha256"))
    cached = docs.filter(F.col("stream_id") % 3 != 0).select(
        "stream_id", F.when(F.col("stream_id") % 7 == 0, F.lit("old")).otherwise(F.col("source_sha256")).alias("source_sha256"),
        F.when(F.col("stream_id") % 5 == 0, "0").otherwise("1").alias("segmenter_version"),
    )
    return op.cache_hits(docs, cached, "1").select("stream_id")


def brief_digests(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    mixed = F.replace("html", F.lit("<"), F.when(F.col("page_id") % 2 == 0, F.lit("\r\n<")).otherwise(F.lit("\r<")))
    return pages.select("page_id", dg.brief_key(mixed).alias("digest"), dg.brief_key(F.replace("html", F.lit("<"), F.lit("\n<"))).alias("plain"))


def names(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    raw = F.when(F.col("page_id") % 3 == 0, F.element_at(F.split("url", "/"), -1)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("COM"), (F.col("page_id") % 12).cast("string"), F.lit(".txt"))).otherwise(F.regexp_replace("url", "[^A-Za-z0-9]+", "-"))
    named = op.piece_name(raw, F.when(F.col("page_id") % 2 == 0, "tiktok"), F.when(F.col("page_id") % 5 != 0, F.col("page_id") % 120).cast("int"), F.when(F.col("page_id") % 7 == 0, "16x9"))
    return pages.select("page_id", op.safe_name(raw).alias("safe"), named["piece_id"].alias("piece_id"), named["reason"].alias("reason"))


def expired_folders(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    top = F.when(o % 5 == 0, "fixtures").when(o % 5 == 1, "tmp1").when(o % 5 == 2, "Run-tmp-9").otherwise("runs")
    leaf = F.when(o % 4 == 0, F.concat(F.lit(".part-"), o.cast("string"))).when(o % 4 == 1, F.concat(F.lit("x"), o.cast("string"), F.lit(".TMP"))).when(o % 4 == 2, "keep").otherwise("temp")
    folders = table(spark, folder, "orders").select(o.alias("id"), F.when(o % 3 == 0, leaf).otherwise(F.concat_ws("/", top, leaf)).alias("path"), F.col("o_orderdate").alias("modified"))
    return op.expired_temporaries(folders, F.lit("1998-01-01").cast("timestamp_ntz")).select("id", "path")


QUERIES = {
    "desired_centres": desired_centres, "crop_track": crop_track, "crop_track_tall": crop_track_tall, "track_position": track_position, "geometry": geometry, "band_heights": band_heights,
    "caption_styles": caption_styles, "timeline_tiling": timeline_tiling, "timeline_edits": timeline_edits, "timeline_edit_log": timeline_edit_log, "contract_digests": contract_digests,
    "input_fingerprints": input_fingerprints, "stage_durations": stage_durations,
    "job_faults": job_faults, "queue_summary": queue_summary, "job_readiness": job_readiness, "stale_stages": stale_stages, "segment_reuse": segment_reuse,
    "evidence_review": evidence_review, "revisions": revisions, "cache_hits": cache_hits, "brief_digests": brief_digests, "names": names,
    "expired_folders": expired_folders,
}

_BOX = """
bx AS (SELECT label::BIGINT AS video_id, vec_id AS frame_no, CASE WHEN label % 5 = 3 THEN CASE WHEN vec_id % 2 = 0 THEN 0.0 ELSE 0.95 END ELSE abs(embedding[1]::DOUBLE) % 1.0 END::DOUBLE AS x,
       abs(embedding[2]::DOUBLE) % 1.0 AS y, abs(embedding[3]::DOUBLE) % 1.0 * 0.5::DOUBLE + 0.01::DOUBLE AS w, abs(embedding[4]::DOUBLE) % 1.0 * 0.5::DOUBLE + 0.01::DOUBLE AS h,
       label % 5 = 3 OR vec_id % 10 >= 3 AS seen FROM embeddings)"""


def _smoothed(width: int, height: int, x: tuple[float, float], y: tuple[float, float], step: float, crop: tuple[int, int]) -> str:
    """The recurrence frame by frame, and the even offsets of its crop."""
    double = lambda v: f"{v}::DOUBLE"
    centre = lambda c, size, full, lo, hi: f"least({double(hi)}, greatest({double(lo)}, CASE WHEN seen THEN ({c} + {size} / 2) * {full} ELSE {full} / 2 END))"
    near = lambda c, want, lo, hi: f"least({double(hi)}, greatest({double(lo)}, least(r.{c} + {double(step)}, greatest(r.{c} - {double(step)}, 0.35::DOUBLE * d.{want} + 0.65::DOUBLE * r.{c}))))"
    offset = lambda c, side, full: f"greatest(0, least(floor(greatest(round_even({c} - {side / 2}::DOUBLE, 0), 0) / 2)::BIGINT * 2, {(full - side) // 2 * 2}))"
    return f"""WITH {_BOX}, d AS (SELECT video_id, frame_no, row_number() OVER (PARTITION BY video_id ORDER BY frame_no) AS rn, {centre("x", "w", width, *x)} AS dx, {centre("y", "h", height, *y)} AS dy FROM bx),
        t AS (WITH RECURSIVE r AS (SELECT video_id, rn, frame_no, dx AS cx, dy AS cy FROM d WHERE rn = 1
            UNION ALL SELECT d.video_id, d.rn, d.frame_no, {near("cx", "dx", *x)}, {near("cy", "dy", *y)} FROM r JOIN d ON d.video_id = r.video_id AND d.rn = r.rn + 1) SELECT * FROM r)
        SELECT video_id, frame_no, {offset("cx", crop[0], width)} AS x, {offset("cy", crop[1], height)} AS y, {crop[0]} AS width, {crop[1]} AS height FROM t"""


_POS = """
_ln AS (SELECT l_orderkey AS variant_id, l_linenumber AS ordinal, max(l_quantity)::BIGINT AS len FROM lineitem GROUP BY 1, 2),
_ld AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY variant_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM _ln),
pos AS MATERIALIZED (SELECT variant_id, ordinal, CASE WHEN variant_id % 25 = 3 THEN 7 ELSE ordinal END AS position_id,
        s + CASE WHEN variant_id % 10 = 0 AND ordinal > 2 THEN 1 ELSE 0 END AS a, s + len AS b FROM _ld)"""
_JOBS = """
jb AS (SELECT o_custkey % 100 AS queue_id, o_orderkey AS o, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'failed' END END AS state FROM orders)"""
_EVEN = "(floor(greatest({0}, 0) / 2) * 2)"
_CROPPED = """
g AS (SELECT DISTINCT (l_quantity * 37)::INT AS w, (l_partkey % 80 * 13)::INT AS h FROM lineitem),
e AS (SELECT *, h // 2 * 2 AS eh, w // 2 * 2 AS ew, h * 9 <= w * 16 AS wide FROM g),
r AS (SELECT *, CASE WHEN wide THEN round_even(eh * 0.5625::DOUBLE, 0)::BIGINT // 2 * 2 ELSE ew END AS rw, CASE WHEN wide THEN eh ELSE round_even(ew / 0.5625::DOUBLE, 0)::BIGINT // 2 * 2 END AS rh FROM e),
c AS (SELECT *, greatest(2, least(rw, ew)) AS cw, greatest(2, least(rh, eh)) AS ch FROM r),
b AS (SELECT *, greatest(2, least(round_even(0.33::DOUBLE * w / 2, 0)::BIGINT * 2, w)) AS bw, greatest(2, least(round_even(0.5::DOUBLE * h / 2, 0)::BIGINT * 2, h)) AS bh FROM c)"""

ORACLES = {
    "desired_centres": f"""WITH {_BOX} SELECT video_id, frame_no, round(least(1616.0, greatest(304.0, CASE WHEN seen THEN (x + w / 2) * 1920 ELSE 960 END)), 4) AS dx,
        round(least(540.0, greatest(540.0, CASE WHEN seen THEN (y + h / 2) * 1080 ELSE 540 END)), 4) AS dy FROM bx""",
    "crop_track": _smoothed(1920, 1080, (304.0, 1616.0), (540.0, 540.0), 38.4, (608, 1080)),
    "crop_track_tall": _smoothed(1080, 2400, (540.0, 540.0), (960.0, 1440.0), 21.6, (1080, 1920)),
    "track_position": f"""WITH {_BOX}, k AS (SELECT video_id, frame_no::DOUBLE AS t, round_even(x * 1000, 0) AS v FROM bx WHERE frame_no % 3 = 0),
        q AS (SELECT video_id, frame_no + 0.5::DOUBLE AS t FROM bx),
        a AS (SELECT q.video_id, q.t, k.t AS t0, k.v AS v0 FROM q ASOF LEFT JOIN k ON q.video_id = k.video_id AND q.t >= k.t),
        z AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.video_id = k.video_id AND a.t <= k.t)
        SELECT video_id, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM z""",
    "geometry": f"""WITH {_CROPPED} SELECT w, h, CASE WHEN w > 0 AND h > 0 AND least(cw, ch) >= 24 THEN cw END AS crop_w, CASE WHEN w > 0 AND h > 0 AND least(cw, ch) >= 24 THEN ch END AS crop_h,
        CASE WHEN w <= 0 OR h <= 0 THEN 'bad_source' WHEN least(cw, ch) < 24 THEN 'source_too_small' END AS reason,
        greatest(2, floor(round_even(w * 0.8::DOUBLE, 0) / 2) * 2)::BIGINT AS canvas_w, w::BIGINT AS canvas_h, bw AS box_w, bh AS box_h,
        greatest(0, least(round_even(0.1::DOUBLE * w / 2, 0)::BIGINT * 2, w - bw)) AS box_x, greatest(0, least(round_even(0.25::DOUBLE * h / 2, 0)::BIGINT * 2, h - bh)) AS box_y,
        round_even(w / 3.0::DOUBLE / 2, 0)::BIGINT * 2 AS rounded, ew AS floored FROM b""",
    "band_heights": """WITH l AS (SELECT DISTINCT ['single', 'dividido', 'trio', 'spotlight'][l_orderkey % 4 + 1] AS layout, (l_quantity * 40 + 2)::INT AS height FROM lineitem),
        s AS (SELECT *, height // 2 // 2 * 2 AS hf, height // 3 // 2 * 2 AS th, round_even(height * 0.5625::DOUBLE / 2, 0)::BIGINT * 2 AS tp FROM l),
        b AS (SELECT layout, height, CASE layout WHEN 'dividido' THEN [hf, height - hf] WHEN 'trio' THEN [th, th, height - 2 * th] WHEN 'spotlight' THEN [tp, height - tp] ELSE [height] END AS px FROM s)
        SELECT layout, height, i - 1 AS band, px[i] AS px FROM b, unnest(range(1, len(px) + 1)) AS u(i)""",
    "caption_styles": """SELECT doc_id, CASE doc_id // 3 % 3 WHEN 0 THEN 46 WHEN 2 THEN 70 ELSE CASE doc_id % 3 WHEN 1 THEN 62 ELSE 54 END END AS font_size,
        CASE doc_id % 3 WHEN 0 THEN '&H00000000' WHEN 1 THEN '&H80000000' ELSE '&H99000000' END AS back_colour, CASE doc_id % 3 WHEN 2 THEN 3 ELSE 1 END AS border_style,
        CASE doc_id // 9 % 3 WHEN 0 THEN 7 WHEN 1 THEN 4 ELSE 1 END + doc_id // 27 % 3 AS alignment, CASE doc_id // 9 % 3 WHEN 0 THEN 60 WHEN 1 THEN 0 ELSE 80 END AS margin_v,
        doc_id % 3 * 2 AS outline_px, CASE doc_id // 3 % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS shadow_px FROM documents""",
    "timeline_tiling": f"""WITH {_POS}, v AS (SELECT o_orderkey AS variant_id, coalesce(max(b), 1) + CASE WHEN o_orderkey % 40 = 7 THEN 5 ELSE 0 END AS e FROM orders LEFT JOIN pos ON variant_id = o_orderkey GROUP BY o_orderkey),
        p AS (SELECT *, lag(b) OVER (PARTITION BY variant_id ORDER BY ordinal) AS pb FROM pos),
        g AS (SELECT variant_id, arg_min(a, ordinal) AS f, arg_max(b, ordinal) AS l, bool_or(pb <> a) AS gap, count(*) <> count(DISTINCT position_id) AS dup FROM p GROUP BY 1)
        SELECT variant_id, CASE WHEN f IS NULL THEN 'empty' WHEN e <= 0 THEN 'reversed' WHEN dup THEN 'duplicate_id' WHEN f <> 0 OR l <> e THEN 'not_covered' WHEN gap THEN 'not_continuous' ELSE 'ok' END AS reason
        FROM v LEFT JOIN g USING (variant_id)""",
    "timeline_edits": f"""WITH {_POS}, p AS (SELECT *, a = min(a) OVER w AND b = max(b) OVER w AS solo, lag(b) OVER o IS NULL AS is_first, lead(a) OVER o IS NULL AS is_last FROM pos
            WHERE variant_id % 25 <> 3 AND variant_id % 10 <> 0 WINDOW w AS (PARTITION BY variant_id), o AS (PARTITION BY variant_id ORDER BY ordinal)),
        s AS (SELECT *, ordinal = 2 AND variant_id % 2 = 0 AS asked, variant_id % 20 > 0 AND a + variant_id % 20 < b AS ok FROM p),
        d AS (SELECT *, variant_id % 3 = 0 AND ordinal = variant_id % 4 + 1 AS asked FROM p),
        dv AS (SELECT variant_id, CASE WHEN is_first AND is_last THEN 'only_position' WHEN NOT is_first AND NOT is_last AND variant_id % 5 NOT IN (1, 2) THEN 'absorb_needed' END AS reason FROM d WHERE asked)
        SELECT 'split' AS edit, variant_id, count(*) + count(*) FILTER (asked AND ok) AS n, sum(b - a)::BIGINT AS ms FROM s GROUP BY variant_id
        UNION ALL SELECT 'delete', variant_id, count(*) - (any_value(variant_id) IN (SELECT variant_id FROM dv WHERE reason IS NULL))::INT, sum(b - a)::BIGINT FROM d GROUP BY variant_id
        UNION ALL SELECT 'split:not_inside', -1, count(*), 0 FROM s WHERE asked AND NOT ok HAVING count(*) > 0
        UNION ALL SELECT 'delete:' || reason, -1, count(*), 0 FROM dv WHERE reason IS NOT NULL GROUP BY reason""",
    "timeline_edit_log": f"""WITH RECURSIVE {_POS}, q AS (SELECT variant_id, list(struct_pack(pid := position_id::BIGINT, a := a::BIGINT, b := b::BIGINT) ORDER BY ordinal) AS ps, max(a) FILTER (ordinal = 2) AS s
            FROM pos GROUP BY 1),
        ed AS (SELECT variant_id, 1 AS no, true AS cut, 2 AS pid, s + variant_id % 20 AS x, 100 AS fresh, NULL AS side FROM q
            UNION ALL SELECT variant_id, 2, false, variant_id % 4 + 1, NULL, NULL, CASE variant_id % 5 WHEN 1 THEN 'previous' WHEN 2 THEN 'next' END FROM q
            UNION ALL SELECT variant_id, 3, true, 100, s + variant_id % 20 + variant_id % 7, 101, NULL FROM q
            UNION ALL SELECT variant_id, 4, false, 100, NULL, NULL, 'next' FROM q UNION ALL SELECT variant_id, 5, false, 2, NULL, NULL, 'previous' FROM q
            UNION ALL SELECT variant_id, 6, false, 1, NULL, NULL, NULL FROM q),
        st AS (SELECT variant_id, 0 AS no, ps, NULL::VARCHAR AS reason, NULL::BIGINT AS bad FROM q
            UNION ALL SELECT variant_id, no, CASE WHEN reason IS NOT NULL THEN ps
                    WHEN cut THEN list_concat(list_concat(ps[:i - 1], [struct_pack(pid := p.pid, a := p.a, b := x::BIGINT), struct_pack(pid := fresh::BIGINT, a := x::BIGINT, b := p.b)]), ps[i + 1:])
                    WHEN i = 1 OR (i < n AND side = 'next') THEN list_concat(list_concat(ps[:i - 1], [struct_pack(pid := ps[i + 1].pid, a := p.a, b := ps[i + 1].b)]), ps[i + 2:])
                    ELSE list_concat(list_concat(ps[:i - 2], [struct_pack(pid := ps[i - 1].pid, a := ps[i - 1].a, b := p.b)]), ps[i + 1:]) END, reason, pid
                FROM (SELECT *, CASE WHEN i = 0 THEN 'not_found' WHEN cut AND NOT coalesce(x > p.a AND x < p.b, false) THEN 'not_inside' WHEN NOT cut AND n = 1 THEN 'only_position'
                    WHEN NOT cut AND i > 1 AND i < n AND side IS NULL THEN 'absorb_needed' END AS reason
                    FROM (SELECT *, ps[i] AS p FROM (SELECT st.variant_id, ed.no, st.ps, ed.cut, ed.pid::BIGINT AS pid, ed.x, ed.fresh, ed.side, len(st.ps) AS n,
                        coalesce(list_position(list_transform(st.ps, lambda z: z.pid), ed.pid::BIGINT), 0) AS i FROM st JOIN ed ON ed.variant_id = st.variant_id AND ed.no = st.no + 1))))
        SELECT variant_id, 'kept' AS kind, r.pid AS position_id, r.a AS a, r.b AS b FROM (SELECT variant_id, unnest(ps) AS r FROM st WHERE no = 6)
        UNION ALL SELECT variant_id, reason, bad, no, NULL FROM st WHERE reason IS NOT NULL""",
    "contract_digests": """WITH c AS (SELECT *, 'clerk ' || o_custkey AS o_clerk, o_orderkey AS o, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey * 2.5)::DOUBLE::VARCHAR ELSE 'null' END AS hi FROM orders)
        SELECT o AS contract_id, sha256('{"assets":{"optional":[],"required":[{"asset_id":"' || o_clerk || '"}]}' || CASE WHEN o % 4 = 0 THEN ',"audio_policy":"internal"' ELSE '' END
            || CASE WHEN o % 6 = 0 THEN ',"brand_safety_required":true' ELSE '' END || ',"languages":{' || CASE WHEN o % 3 = 0 THEN '"language":"es\\n\\"ñ",' ELSE '' END || '"subtitles":["' || o_orderstatus || '"]}'
            || CASE WHEN o % 5 = 0 THEN ',"outputs":[{"aspect":"1:1","index":0},{"aspect":"9:16","index":1}]' ELSE '' END
            || ',"platforms":{"reels":{"max_s":' || hi || ',"min_s":' || (o % 8 / 1000000)::DOUBLE::VARCHAR || '},"tiktok":{"max_s":' || hi || ',"min_s":' || (o % 9)::DOUBLE::VARCHAR || '}}'
            || ',"watermark":{' || CASE WHEN o % 7 = 0 THEN '"position":"center_bottom",' ELSE '' END || '"required":' || (o % 2 = 0)::VARCHAR || CASE WHEN o % 10 <> 4 THEN ',"scale_ratio":' || (o % 10 / 20)::DOUBLE::VARCHAR ELSE '' END || '}}') AS digest FROM c""",
    "input_fingerprints": """WITH c AS (SELECT *, 'clerk ' || o_custkey AS o_clerk, o_orderkey AS o FROM orders)
        SELECT o AS run_id, sha256('{"audio":{"locked":' || (o % 2 = 0)::VARCHAR || ',"mix_ratio":' || (o % 5 / 4)::DOUBLE::VARCHAR || ',"track_path":' || CASE WHEN o % 3 = 0 THEN '"' || o_clerk || '"' ELSE 'null' END || ',"track_url":null}'
            || ',"contract":"' || sha256(o_clerk) || '","download":{"download_section_mode":' || (o % 4 = 1)::VARCHAR || ',"timestamp_ranges":['
            || CASE WHEN o % 4 = 1 THEN '{"end_sec":' || (o % 30 + 4.5)::DOUBLE::VARCHAR || ',"start_sec":' || (o % 30)::DOUBLE::VARCHAR || '}' ELSE '' END || ']},"face_model_path":null'
            || CASE WHEN o % 6 = 0 THEN ',"lyric_video":{"text":"line"}' ELSE '' END || ',"pipeline":"long_video","render":{"aspect_tolerance":0.01,"ffmpeg":"ffmpeg","nvenc_available":false,"target_aspect":0.5625,"timeout_s":600.0}'
            || ',"repost_mode":' || (o % 2 = 1)::VARCHAR || CASE WHEN o % 8 = 0 THEN ',"split_screen":"wide"' ELSE '' END || ',"url":"v/' || o % 50 || '","watermark":null}') AS fingerprint FROM c""",
    "stage_durations": """WITH e AS (SELECT o_custkey AS run_id, ['download', 'transcribe', 'moments', 'select', 'reframe', 'subtitles', 'completed'][o_orderkey % 7 + 1] AS stage, o_orderkey % 3 AS process,
            floor(o_totalprice)::BIGINT AS ms FROM orders), m AS (SELECT *, max(process) OVER (PARTITION BY run_id, stage) AS top FROM e)
        SELECT run_id, stage, sum(ms)::BIGINT AS elapsed_ms, any_value(process) AS process FROM m WHERE process = top GROUP BY 1, 2""",
    "job_faults": f"""WITH {_JOBS} SELECT o AS job_id, CASE WHEN o % 31 = 0 THEN 'absolute' WHEN o % 37 = 0 THEN 'escapes' WHEN o % 41 = 0 THEN 'outside_delivery' WHEN o % 43 = 0 THEN 'not_mp4'
        WHEN state = 'completed' AND o % 47 = 0 THEN 'completed_with_error' WHEN state = 'failed' AND o % 5 = 1 THEN 'failed_without_error' ELSE 'ok' END AS reason FROM jb""",
    "queue_summary": f"""WITH {_JOBS}, r AS (SELECT queue_id, o, CASE WHEN state = 'running' AND queue_id % 4 <> 0 THEN 'interrupted' ELSE state END AS state FROM jb)
        SELECT queue_id, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state IN ('failed', 'interrupted')) AS retryable,
        min(o) FILTER (state = 'pending') AS next_job, queue_id % 9 = 0 AS stopped FROM r GROUP BY queue_id""",
    "job_readiness": """WITH f AS (SELECT DISTINCT o_custkey % 10 AS p, o_orderkey % 5 AS c FROM orders)
        SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 13 = 0 THEN 'variant_not_found' WHEN o_orderkey % 7 = 0 THEN 'variant_not_active'
            WHEN o_orderkey % 11 = 0 OR f.p IS NULL THEN 'origin_mismatch' WHEN o_orderkey % 5 = 0 THEN 'revision_mismatch' ELSE 'ready' END AS reason
        FROM orders LEFT JOIN f ON f.p = o_custkey % 10 AND f.c = o_orderkey % 6""",
    "stale_stages": """WITH o AS (SELECT o_orderkey AS run_id, o_orderstatus = 'F' AS s, o_custkey % 2 = 0 AS a FROM orders),
        st(stage, audio) AS (VALUES ('transcribe', false), ('moments', false), ('select', false), ('reframe', false), ('subtitles', true), ('completed', true))
        SELECT run_id, s AS drop_coords, stage FROM o, st WHERE s OR (a AND audio)""",
    "segment_reuse": """WITH l AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS i FROM lineitem)
        SELECT run_id, count(*) FILTER (i < 5 AND run_id % 3 <> 0) AS n_reused, count(*) AS n FROM l GROUP BY run_id""",
    "evidence_review": """SELECT o_custkey AS project_id, CASE WHEN o_custkey % 5 <> 4 AND o_custkey % 3 = 0 THEN 'requires_review' ELSE 'active' END AS status, count(*) AS n FROM orders GROUP BY 1, 2""",
    "revisions": """SELECT doc_id, sha256('{"analysis_sha256":"' || sha256(text) || '","project_id":"p\\"' || source || '","source_duration_ms":' || n_chars || ',"source_sha256":"' || sha256(source)
        || '","transcript_sha256":"' || sha256(lang) || '","variant":{"id":' || doc_id || ',"name":"' || lang || '\\n\\\\ñ"' || CASE WHEN doc_id % 2 = 0 THEN ',"style":1' ELSE '' END || '}}') AS revision FROM documents""",
    "cache_hits": "SELECT doc_id AS stream_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0",
    "brief_digests": """SELECT page_id, sha256(replace(replace(replace(html, '<', chr(10) || '<'), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest,
        sha256(replace(replace(replace(html, '<', chr(10) || '<'), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS plain FROM pages""",
    "names": """WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN string_split(url, '/')[-1] WHEN 1 THEN 'COM' || (page_id % 12) || '.txt' ELSE regexp_replace(url, '[^A-Za-z0-9]+', '-', 'g') END AS n FROM pages),
        p AS (SELECT *, concat_ws('-', n, CASE WHEN page_id % 2 = 0 THEN 'tiktok' END, CASE WHEN page_id % 5 <> 0 THEN printf('%02d', page_id % 120) END, CASE WHEN page_id % 7 = 0 THEN '16x9' END) AS id FROM r)
        SELECT page_id, length(n) <= 64 AND regexp_full_match(n, '[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?') AND NOT (page_id % 3 = 1 AND page_id % 12 BETWEEN 1 AND 9) AS safe,
        CASE WHEN length(id) <= 64 THEN id END AS piece_id, CASE WHEN length(id) > 64 THEN 'too_long' END AS reason FROM p""",
    "expired_folders": """WITH f AS (SELECT o_orderkey AS o, CASE o_orderkey % 5 WHEN 0 THEN 'fixtures' WHEN 1 THEN 'tmp1' WHEN 2 THEN 'Run-tmp-9' ELSE 'runs' END AS t,
            CASE o_orderkey % 4 WHEN 0 THEN '.part-' || o_orderkey WHEN 1 THEN 'x' || o_orderkey || '.TMP' WHEN 2 THEN 'keep' ELSE 'temp' END AS l, o_orderdate FROM orders)
        SELECT o AS id, CASE WHEN o % 3 = 0 THEN l ELSE t || '/' || l END AS path FROM f WHERE l <> 'keep' AND o_orderdate <= TIMESTAMP '1998-01-01' AND (o % 3 = 0 OR t = 'runs')""",
}
