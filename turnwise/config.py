"""Options and named profiles. Explicit values override those of the profile."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """Limits of the operators, with their defaults."""

    utterance_max_gap_seconds: float = 0.85
    sentence_max_gap_seconds: float = 2.5
    segmentation_mode: str = "structural"
    segmentation_max_gap_seconds: float = 2.0
    segmentation_soft_max_gap_seconds: float = 7.0
    segmentation_max_duration_seconds: float = 90.0
    segmentation_max_text_length: int = 800
    invalid_timing_policy: str = "clamp"
    max_answer_units: int = 3
    max_answer_duration_seconds: float = 45.0
    max_question_length_chars: int = 220
    qa_min_confidence: float = 0.40
    strict_gate: bool = False
    speaker_check: bool = False
    semantic_search: bool = True
    semantic_rerank: bool = True
    semantic_top_k: int = 4

    def __post_init__(self) -> None:
        if self.segmentation_mode not in ("structural", "windowed", "adaptive", "both"):
            raise ValueError(f"unknown segmentation mode {self.segmentation_mode!r}")
        if self.invalid_timing_policy not in ("clamp", "drop"):
            raise ValueError(f"unknown timing policy {self.invalid_timing_policy!r}")
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and not isinstance(v, bool) and v < 0:
                object.__setattr__(self, f.name, type(v)(0))
        if self.segmentation_soft_max_gap_seconds < self.segmentation_max_gap_seconds:
            object.__setattr__(self, "segmentation_soft_max_gap_seconds", self.segmentation_max_gap_seconds)
        object.__setattr__(self, "qa_min_confidence", min(1.0, self.qa_min_confidence))


PROFILES: dict[str, dict[str, object]] = {
    "current": {},
    "light": {"semantic_search": False, "semantic_rerank": False},
    "quality": {"segmentation_mode": "adaptive"},
    "quality_local": {"strict_gate": True, "speaker_check": True, "semantic_rerank": False},
    "full": {"segmentation_mode": "both", "speaker_check": True},
    "diagnostic": {"segmentation_mode": "both", "qa_min_confidence": 0.0},
}


def options(profile: str = "current", **overrides: object) -> Options:
    """The options of a profile with explicit overrides; unknown profiles and options are errors."""
    if profile not in PROFILES:
        raise KeyError(f"unknown profile {profile!r}")
    unknown = set(overrides) - {f.name for f in fields(Options)}
    if unknown:
        raise KeyError(f"unknown options {sorted(unknown)}")
    return replace(Options(), **{**PROFILES[profile], **overrides})


def snapshot(o: Options) -> dict[str, object]:
    """Options as plain values, for cache keys and reports."""
    return asdict(o)
