"""Every tunable in one frozen object; operators take it, and an explicit as_of, instead of reading a clock."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    gate_threshold: float = 0.2
    default_credibility: float = 0.5
    # duplicates
    jaccard: float = 0.85
    semantic: float = 0.88
    dedup_days: int = 7
    shingle: int = 5
    permutations: int = 128
    # clusters
    cluster_days: int = 30
    min_cluster: int = 4
    temporal_weight: float = 0.065
    match_centroid: float = 0.9
    dormant_days: int = 7
    # trends
    window_hours: int = 6
    span: int = 6
    history_days: int = 28
    provisional_days: int = 14
    trend_weights: tuple[float, float, float] = (0.3, 0.4, 0.3)
    breakout: float = 2.5
    # weak signals
    small_cluster: int = 5
    weak_days: int = 14
    weak_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
    weak_threshold: float = 0.20
    burst_scale: float = 2.0
    burst_gamma: float = 1.0
    # triage
    sensitivity: float = 0.05
    priority_total: float = 7.5
    priority_urgency: float = 9.0
    fasttrack_impact: float = 8.0
    fasttrack_reliability: float = 7.0
    investigate_total: float = 5.5
    # beats, forces, delivery
    beat_floor: float = 4.0
    beat_shortlist: int = 150
    beat_cap: int = 25
    rivals: int = 5
    preference: float = 2.0
    cooldown_hours: int = 6
    retry_seconds: tuple[int, ...] = (30, 120, 600, 3600)


DEFAULTS = Params()
#: The published random consistency index by matrix order.
RANDOM_INDEX = {3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41}
#: The scored triage dimensions; sensitivity only lifts.
SCORED = ("relevance", "urgency", "impact", "novelty", "actionability", "reliability")
DIMENSIONS = (*SCORED, "sensitivity")
