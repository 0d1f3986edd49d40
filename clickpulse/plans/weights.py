"""The weights of the health score."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FeatureWeight:
    group: str
    group_weight: float
    feature: str
    direction: int


def _group(name: str, weight: float, direction: int, features: tuple[str, ...]) -> tuple[FeatureWeight, ...]:
    return tuple(FeatureWeight(name, weight, f, direction) for f in features)


#: Groups, their weights, features and directions (-1: smaller is better).
WEIGHTS = (
    *_group("quality", 0.40, -1, ("dead_search_rate", "bounce_rate", "km_median_time_to_cart_s")),
    *_group(
        "engagement",
        0.35,
        1,
        ("rate_clicks", "rate_views", "rate_favs", "multi_category_rate", "click_per_view", "cart_per_click", "cart_rate", "session_conversion_rate", "mean_duration_s", "search_refinement_rate"),
    ),
    *_group("discovery", 0.25, 1, ("rate_unique_queries", "rate_searches", "view_per_search")),
)
GROUPS = tuple(dict.fromkeys(w.group for w in WEIGHTS))
FEATURES = tuple(w.feature for w in WEIGHTS)


def directions() -> list[tuple[str, int]]:
    return [(w.feature, w.direction) for w in WEIGHTS]
