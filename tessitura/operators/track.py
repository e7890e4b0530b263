"""Crop tracks from face boxes, and the integer geometry around them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.plans.scan import BLOCK_FAN, prefix_scan, summary, time_block

# Fixed values.
MIN_CROP_SIDE = 24
TARGET = 9.0 / 16.0
BLOCK_FRAMES = 8192
SETTLED_PX = 1e-9


@dataclass(frozen=True)
class TrackParams:
    """Smoothing of a crop centre."""

    width: int = 1920
    height: int = 1080
    smoothing: float = 0.35
    max_step_ratio: float = 0.02
    min_confidence: float = 0.3

    def __post_init__(self) -> None:
        if not 0.0 < self.smoothing <= 1.0 or not 0.0 <= self.max_step_ratio <= 1.0 or not 0.0 <= self.min_confidence <= 1.0:
            raise ValueError("smoothing, step and confidence must lie in their ranges")


def even_floor(value: Column) -> Column:
    """Largest even number not above the value, never negative."""
    return (F.floor(F.greatest(value, F.lit(0)) / 2) * 2).cast("long")


def even_round(value: Column) -> Column:
    """Nearest even number, ties to the multiple of four."""
    return (F.rint(value / 2) * 2).cast("long")


def crop_size(width: Column, height: Column) -> Column:
    """9:16 crop of a source, with a reason where the source is too small."""
    wide = height * 9 <= width * 16
    raw_h = F.when(wide, even_floor(height)).otherwise(even_floor(F.rint(even_floor(width) / F.lit(TARGET))))
    raw_w = F.when(wide, even_floor(F.rint(even_floor(height) * F.lit(TARGET)))).otherwise(even_floor(width))
    w = F.greatest(F.lit(2).cast("long"), F.least(raw_w, even_floor(width)))
    h = F.greatest(F.lit(2).cast("long"), F.least(raw_h, even_floor(height)))
    reason = F.when((width <= 0) | (height <= 0), "bad_source").when(F.least(w, h) < MIN_CROP_SIDE, "source_too_small")
    return F.struct(F.when(reason.isNull(), w).alias("width"), F.when(reason.isNull(), h).alias("height"), reason.alias("reason"))


def canvas_size(long_side: Column, aspect: Column) -> Column:
    """Canvas from its long side and shape; the short side is even and at least two."""
    short = lambda v: F.greatest(F.lit(2).cast("long"), (F.floor(F.rint(v) / 2) * 2).cast("long"))
    return F.struct(
        F.when(aspect >= 1, long_side.cast("long")).otherwise(short(long_side * aspect)).alias("width"),
        F.when(aspect >= 1, short(long_side / aspect)).otherwise(long_side.cast("long")).alias("height"),
    )


def band_heights(layout: Column, height: Column) -> Column:
    """Even band heights that add up to the canvas; the last band takes the remainder."""
    half, third, top = (F.floor(height / 4) * 2), (F.floor(F.floor(height / 3) / 2) * 2), F.rint(height * 0.5625 / 2) * 2
    sizes = (
        F.when(layout == "dividido", F.array(half.cast("long"), (height - half).cast("long")))
        .when(layout == "trio", F.array(third.cast("long"), third.cast("long"), (height - 2 * third).cast("long")))
        .when(layout == "spotlight", F.array(top.cast("long"), (height - top).cast("long")))
    )
    return F.coalesce(sizes, F.array(height.cast("long")))


def crop_box(rect: Column, source_w: Column, source_h: Column) -> Column:
    """Pixel crop of a band's source rectangle, even and inside the source."""
    w = F.greatest(F.lit(2).cast("long"), F.least(even_round(rect["width"] * source_w), source_w.cast("long")))
    h = F.greatest(F.lit(2).cast("long"), F.least(even_round(rect["height"] * source_h), source_h.cast("long")))
    x = F.greatest(F.lit(0).cast("long"), F.least(even_round(rect["x"] * source_w), source_w - w))
    y = F.greatest(F.lit(0).cast("long"), F.least(even_round(rect["y"] * source_h), source_h - h))
    return F.struct(w.alias("width"), h.alias("height"), x.alias("x"), y.alias("y"))


def primary_faces(frames: DataFrame, faces: DataFrame, min_confidence: float) -> DataFrame:
    """Largest confident face of each frame; the first listed wins a tie, frames without one stay.

    ``frames``: ``video_id, frame_no``; ``faces``: those plus ``pos, x, y, w, h, confidence``.
    """
    best = (
        faces.filter(F.col("confidence") >= min_confidence)
        .groupBy("video_id", "frame_no")
        .agg(F.max_by(F.struct("x", "y", "w", "h"), F.struct(F.col("w") * F.col("h"), -F.col("pos"))).alias("face"))
    )
    return frames.join(best, ["video_id", "frame_no"], "left")


def _limits(p: TrackParams) -> tuple[float, float, float, float, int, int]:
    even = lambda v: max(0, v) // 2 * 2
    if p.height * 9 <= p.width * 16:
        ch = even(p.height)
        cw = even(round(ch * TARGET))
    else:
        cw = even(p.width)
        ch = even(round(cw / TARGET))
    cw, ch = max(2, min(cw, even(p.width))), max(2, min(ch, even(p.height)))
    return cw / 2.0, p.width - cw / 2.0, ch / 2.0, p.height - ch / 2.0, cw, ch


def desired_centres(primary: DataFrame, p: TrackParams) -> DataFrame:
    """Where the crop wants to be: the face, or the middle of the frame without one."""
    x0, x1, y0, y1, _, _ = _limits(p)
    clamp = lambda v, lo, hi: F.least(F.lit(hi), F.greatest(F.lit(lo), v))
    x = F.when(F.col("face").isNull(), F.lit(p.width / 2.0)).otherwise((F.col("face.x") + F.col("face.w") / 2) * p.width)
    y = F.when(F.col("face").isNull(), F.lit(p.height / 2.0)).otherwise((F.col("face.y") + F.col("face.h") / 2) * p.height)
    return primary.select("video_id", "frame_no", clamp(x, x0, x1).alias("dx"), clamp(y, y0, y1).alias("dy"))


def smooth(desired: np.ndarray, state: float | None, alpha: float, step: float, low: float, high: float) -> np.ndarray:
    """Exponential smoothing with a step clamp and a frame clamp; without a state the first value is taken as is."""
    out = np.empty(len(desired))
    for i, want in enumerate(desired.tolist()):
        if state is None:
            state = want
        else:
            nxt = alpha * want + (1.0 - alpha) * state
            state = min(high, max(low, min(state + step, max(state - step, nxt))))
        out[i] = state
    return out


@dataclass(frozen=True)
class Axis:
    """One axis of the recurrence: ``state`` becomes ``alpha * want + (1 - alpha) * state``, at most ``step`` away, inside the frame."""

    alpha: float
    step: float
    low: float
    high: float

    def map_of(self, want: float) -> tuple[np.ndarray, np.ndarray]:
        """One frame's effect on any state: a monotone line with at most two bends, as knots and values."""
        reach = self.step / self.alpha
        knots = np.array([self.low, *(k for k in (want - reach, want + reach) if self.low < k < self.high), self.high])
        value = np.clip(self.alpha * want + (1.0 - self.alpha) * knots, knots - self.step, knots + self.step)
        return knots, np.clip(value, self.low, self.high)

    def effect(self, wants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The effect of several frames. Where both frame edges end at one place it is constant; else the maps are composed."""
        ends = [smooth(wants, edge, self.alpha, self.step, self.low, self.high)[-1] for edge in (self.low, self.high)]
        if ends[1] - ends[0] <= SETTLED_PX:
            return np.array([self.low, self.high]), np.array([ends[0], ends[0]])
        found = self.map_of(float(wants[0]))
        for want in wants[1:].tolist():
            found = composed(found, self.map_of(want))
        return found


def composed(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``then`` after ``first``, both monotone and piecewise linear; every second knot that does not bend the line is left out."""
    knots, values = first
    inside = then[0][(then[0] > values[0]) & (then[0] < values[-1])]
    knots = np.unique(np.concatenate([knots, np.interp(inside, values, knots)]))
    out = np.interp(np.interp(knots, *first), *then)
    if len(knots) > 2:
        straight = out[:-2] + (out[2:] - out[:-2]) * (knots[1:-1] - knots[:-2]) / (knots[2:] - knots[:-2])
        bends = np.concatenate([[True], np.abs(straight - out[1:-1]) > 1e-12, [True]])
        bends[::2] = True  # a knot goes only between two that stay
        knots, out = knots[bends], out[bends]
    return knots, out


def _axes(p: TrackParams) -> dict[str, Axis]:
    x0, x1, y0, y1, _, _ = _limits(p)
    step = max(1.0, p.max_step_ratio * p.width)
    return {"x": Axis(p.smoothing, step, x0, x1), "y": Axis(p.smoothing, step, y0, y1)}


EFFECT = "ox double, oy double, kx array<double>, vx array<double>, ky array<double>, vy array<double>"


def _rolled(pdf: pd.DataFrame) -> dict[str, object]:
    """Effects in order as one effect, and where they end when the video starts with them."""
    out: dict[str, object] = {}
    for axis in ("x", "y"):
        maps = [(np.array(k), np.array(v)) for k, v in zip(pdf[f"k{axis}"], pdf[f"v{axis}"], strict=True)]
        found, end = maps[0], float(pdf[f"o{axis}"].iloc[0])
        for later in maps[1:]:
            found, end = composed(found, later), float(np.interp(end, *later))
        out[f"o{axis}"], out[f"k{axis}"], out[f"v{axis}"] = end, found[0].tolist(), found[1].tolist()
    return out


def _entered(pdf: pd.DataFrame, start: dict[str, float | None]) -> pd.DataFrame:
    """The state before each of several effects in order; a start of None means that the video begins here."""
    out = {}
    for axis in ("x", "y"):
        state, states = start[axis], []
        for end, k, v in zip(pdf[f"o{axis}"], pdf[f"k{axis}"], pdf[f"v{axis}"], strict=True):
            states.append(state)
            state = float(end) if state is None else float(np.interp(state, k, v))
        out[f"s{axis}"] = pd.Series(states, dtype="float64")
    return pd.DataFrame(out)


def smoothed_track(centres: DataFrame, p: TrackParams, block_frames: int = BLOCK_FRAMES, fan: int = BLOCK_FAN) -> DataFrame:
    """Smoothed crop centres per video.

    A frame's effect on the state is a monotone piecewise-linear map, and so is that of a whole block: its maps composed.
    Blocks give one small row each; groups of ``fan`` blocks and then the groups of a video are composed the same way,
    which gives the state before every group and before every block. Then each block is smoothed on its own. No task
    sees more than one block of frames, ``fan`` blocks' effects, or one effect per group of a video.
    """
    axes = _axes(p)
    key = centres.schema["video_id"].dataType.simpleString()
    blocked = centres.select("video_id", "frame_no", "dx", "dy", F.floor(F.col("frame_no") / block_frames).cast("long").alias("block"))

    def effects(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        row: dict[str, object] = {"video_id": pdf["video_id"].iloc[0], "block": pdf["block"].iloc[0]}
        for axis, a in axes.items():
            wants = pdf[f"d{axis}"].to_numpy()
            knots, values = a.effect(wants)
            row |= {f"o{axis}": smooth(wants, None, a.alpha, a.step, a.low, a.high)[-1], f"k{axis}": knots.tolist(), f"v{axis}": values.tolist()}
        return pd.DataFrame([row])

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"video_id": pdf["video_id"].iloc[0], "grp": pdf["grp"].iloc[0], **_rolled(pdf.sort_values("block"))}])

    def group_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp").reset_index(drop=True)
        return pd.concat([pdf[["video_id", "grp"]], _entered(pdf, {"x": None, "y": None})], axis=1)

    def block_states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        start = {axis: None if pd.isna(pdf[f"g{axis}"].iloc[0]) else float(pdf[f"g{axis}"].iloc[0]) for axis in axes}
        return pd.concat([pdf[["video_id", "block"]], _entered(pdf, start)], axis=1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        out = {"video_id": pdf["video_id"], "frame_no": pdf["frame_no"]}
        for axis, a in axes.items():
            state = pdf[f"s{axis}"].iloc[0]
            out[f"c{axis}"] = smooth(pdf[f"d{axis}"].to_numpy(), None if pd.isna(state) else float(state), a.alpha, a.step, a.low, a.high)
        return pd.DataFrame(out)

    maps = summary(blocked.groupBy("video_id", "block").applyInPandas(effects, f"video_id {key}, block long, {EFFECT}")).withColumn("grp", F.floor(F.col("block") / fan).cast("long"))
    rolled = maps.groupBy("video_id", "grp").applyInPandas(groups, f"video_id {key}, grp long, {EFFECT}")
    entered = rolled.groupBy("video_id").applyInPandas(group_states, f"video_id {key}, grp long, sx double, sy double").withColumnsRenamed({"sx": "gx", "sy": "gy"})
    states = maps.join(entered, ["video_id", "grp"]).groupBy("video_id", "grp").applyInPandas(block_states, f"video_id {key}, block long, sx double, sy double")
    return blocked.join(states, ["video_id", "block"]).groupBy("video_id", "block").applyInPandas(run, f"video_id {key}, frame_no long, cx double, cy double")


def crop_targets(track: DataFrame, p: TrackParams) -> DataFrame:
    """Even pixel offsets of the crop along a track."""
    _, _, _, _, cw, ch = _limits(p)
    top_x, top_y = max(0, p.width - cw) // 2 * 2, max(0, p.height - ch) // 2 * 2
    offset = lambda c, half, top: F.greatest(F.lit(0).cast("long"), F.least(even_floor(F.rint(F.col(c) - half)), F.lit(top).cast("long")))
    return track.select(
        "video_id", "frame_no", offset("cx", cw / 2.0, top_x).alias("x"), offset("cy", ch / 2.0, top_y).alias("y"),
        F.lit(cw).alias("width"), F.lit(ch).alias("height"),
    )


def track_position(keyframes: DataFrame, queries: DataFrame) -> DataFrame:
    """Value at each query time: straight lines between keyframes, constant outside. Frames: ``video_id, t, v`` and ``video_id, t``."""
    events = keyframes.select("video_id", "t", F.lit(0).alias("kind"), F.col("v").cast("double").alias("v")).unionByName(
        queries.select("video_id", "t", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("v"))
    )
    knot = F.when(F.col("kind") == 0, F.struct("t", "v"))
    order, block = ["t", "kind"], time_block(F.col("t"))
    before = prefix_scan(events, ["video_id"], order, block, lasts={"a": knot})
    both = prefix_scan(summary(before), ["video_id"], order, block, lasts={"b": knot}, reverse=True)
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return both.filter(F.col("kind") == 1).select(
        "video_id",
        "t",
        F.when(F.col("a").isNull(), F.col("b.v")).when(F.col("b").isNull() | (F.col("b.t") <= F.col("a.t")), F.col("a.v")).otherwise(line).alias("v"),
    )
