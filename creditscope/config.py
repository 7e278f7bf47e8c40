"""Named parameters of the analyses, with the defaults of the analysed pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PortfolioConfig:
    # Fixed values that must equal the analysed pipeline's for equal results.
    thin_file_months: int = 24
    cli_growth_share: float = 0.19
    kmeans_k: int = 4
    kmeans_restarts: int = 10
    seed: int = 42
    sample_size: int = 8000
    decile_count: int = 10
    delinquent_dpd: int = 30
    # Risk points: FICO < 660 -> 2, < 720 -> 1; utilization >= .90 -> 2, >= .60 -> 1;
    # thin file -> 1.  Tier: >= 4 high, 3 elevated, 1-2 moderate, 0 low.
    fico_cuts: tuple[int, int] = (660, 720)
    util_cuts: tuple[float, float] = (0.60, 0.90)
    tier_labels: tuple[str, ...] = field(default=(
        "Tier 1 - Low Risk", "Tier 2 - Moderate", "Tier 3 - Elevated", "Tier 4 - High Risk"))
    high_risk_tiers: tuple[str, ...] = ("Tier 3 - Elevated", "Tier 4 - High Risk")
    segment_names: tuple[str, ...] = (
        "Segment A - Lowest risk", "Segment B - Moderate",
        "Segment C - Elevated", "Segment D - Highest risk")
