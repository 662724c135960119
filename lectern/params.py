"""Tunable numbers of the analytics, frozen on the driver and put into plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values of the domain's formulas."""

    base_effort_hours: float = 2.0
    no_notes_penalty: float = 1.25
    recency_half_life_years: float | None = 5.0
    due_cap: float = 2.0
    due_weight: float = 0.3
    frequent_year_share: float = 0.4
    answer_length_anchors: tuple[tuple[int, int], ...] = ((2, 50), (5, 150), (10, 300))
    writing_words_per_minute: float = 12.0
    topic_threshold: float = 0.45
    repeat_threshold: float = 0.70
    low_confidence: float = 0.60
    usable_text_chars: int = 20


DEFAULT = Params()
