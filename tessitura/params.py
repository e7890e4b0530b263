"""Validated parameter objects; every threshold enters a plan as a literal taken from here."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

# Fixed values.
MAX_GAP_S = 2.0
MAX_MOMENTS = 12
MIN_WORDS = 4
MIN_CLIP_S = 2.0
PREFERRED_CLIP_S = 8.0
MAX_CLIP_S = 60.0
SPLIT_SEARCH_TAIL = 0.2
DEFAULT_LINE_DURATION_S = 4.0
SENTENCE_MARKS = (".", "?", "!", ",", ";", ":")
CLOSING_MARKS = (".", "?", "!")
SIGNAL_WEIGHTS: Mapping[str, float] = MappingProxyType({"scene": 0.3, "audio_energy": 0.4, "chat_density": 0.3})


@dataclass(frozen=True)
class SegmentParams:
    """Thresholds of word-stream segmentation."""

    max_gap_s: float = MAX_GAP_S
    min_words: int = MIN_WORDS
    min_clip_s: float = MIN_CLIP_S
    max_clip_s: float = MAX_CLIP_S
    preferred_clip_s: float = PREFERRED_CLIP_S
    max_moments: int = MAX_MOMENTS
    split_origin: str = "span"

    def __post_init__(self) -> None:
        if self.split_origin not in {"span", "absolute"}:
            raise ValueError(f"split_origin must be span or absolute: {self.split_origin}")
        if self.max_gap_s < 0 or self.max_clip_s <= 0 or self.max_moments < 1:
            raise ValueError("gap, cap and moment limit must be positive")


@dataclass(frozen=True)
class SignalParams:
    """Thresholds and weights of moment detection."""

    window_s: float = 2.0
    scene_threshold: float = 10.0
    scene_change: float = 0.3
    energy_min_score: float = 0.5
    chat_min_score: float = 0.5
    weights: Mapping[str, float] = field(default_factory=lambda: dict(SIGNAL_WEIGHTS))

    def __post_init__(self) -> None:
        if self.window_s <= 0:
            raise ValueError(f"window must be positive: {self.window_s}")
        if self.scene_threshold < 0:
            raise ValueError(f"scene threshold must not be negative: {self.scene_threshold}")
        for name in ("scene_change", "energy_min_score", "chat_min_score"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]: {getattr(self, name)}")
        if any(w < 0 for w in self.weights.values()):
            raise ValueError(f"negative weights are not allowed: {dict(self.weights)}")
