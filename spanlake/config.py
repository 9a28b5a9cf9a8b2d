"""Named thresholds, weights and limits. Every value here is a default a caller may replace."""
from __future__ import annotations

from dataclasses import dataclass, field, replace

# Channel names and the weight of each channel in a fused score.
CHANNELS = ("visual", "face", "asr", "speaker", "ocr")
FUSION_WEIGHTS = {"face": 0.55, "visual": 0.30, "ocr": 0.20, "asr": 0.15}

# Hit decisions from strongest to weakest; anything else is "hit".
DECISION_ORDER = (
    "strong", "fuzzy", "fallback", "absolute_hit", "semantic_lexical_hit",
    "semantic_hit", "lexical_hit", "weak",
)

# Vector width of each channel and the stored text limits.
VECTOR_DIMS = {"visual": 1152, "asr": 384, "ocr": 384, "face": 512, "speaker": 192}
TEXT_MAX_CHARS = 2000
TEXT_MAX_BYTES = 5000


@dataclass(frozen=True)
class SearchProfile:
    """One search configuration; ``checked`` rejects values outside their range."""

    name: str = "balanced"
    weights: dict = field(default_factory=lambda: dict(FUSION_WEIGHTS))
    ann_k: int = 500
    text_k: int = 100
    segment_top_n: int = 3
    merge_gap: float = 2.0
    max_result_seconds: float = 15.0
    face_threshold: float = 0.35
    speaker_threshold: float = 0.50
    asr_dense_weight: float = 0.65
    ocr_dense_weight: float = 0.30
    dynamic_floor: float = 0.10
    dynamic_ratio: float = 0.30
    result_limit: int = 24

    def checked(self) -> "SearchProfile":
        unit = ("face_threshold", "speaker_threshold", "asr_dense_weight", "ocr_dense_weight",
                "dynamic_floor", "dynamic_ratio")
        for name in unit:
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie in [0, 1]")
        for name in ("ann_k", "text_k", "segment_top_n", "result_limit"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.merge_gap < 0 or self.max_result_seconds <= 0:
            raise ValueError("merge_gap must be >= 0 and max_result_seconds > 0")
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("weights must not be negative")
        return self


PROFILES = {
    "balanced": SearchProfile(),
    "recall": replace(SearchProfile(), name="recall", result_limit=500),
    "precise": replace(SearchProfile(), name="precise", merge_gap=1.0, segment_top_n=1),
}


def profile(name: str, **changes) -> SearchProfile:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {sorted(PROFILES)}")
    return replace(PROFILES[name], **changes).checked()
