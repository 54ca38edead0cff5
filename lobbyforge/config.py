"""Tunables of the engine; defaults are the production values."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    min_board_units: int = 6
    star_max_cost: int = 3
    carry_fully_itemized: int = 3
    carry_full_rate: float = 0.5
    carry_top_slots: int = 2
    carry_damage_min_items: int = 2
    hero_min_damage_items: int = 2
    tier_min_sample: int = 15
    trend_min_sample: int = 3
    trend_retention_days: int = 90
    prior_weight: float = 40.0
    prior_placement: float = 4.5
    prior_top4: float = 0.5
    z: float = 1.96
    low_sample: int = 30
    tier_percentiles: tuple[float, ...] = (0.1, 0.27, 0.5, 0.75)
    tier_bands: tuple[float, ...] = (0.55, 0.5, 0.45, 0.4)
    min_tier_scores: int = 8
    niche_limit: int = 100
    example_unit_freq: float = 0.5
    example_cap: int = 10
    example_item_freq: float = 0.5
    detail_core_freq: float = 0.75
    detail_flex_freq: float = 0.25
    unit_min_boards: int = 10
    variant_cap: int = 8
    build_min_boards: int = 5
    build_items: int = 3
    build_cap: int = 3
    flex_cap: int = 8
    strip_units: int = 10
    top_boards: int = 3
    hit_share: float = 0.35
    representative_boards: int = 5
    representative_fraction: float = 0.05
    reroll_max_cost: int = 3
    emblem_split_swing: float = 0.15
    emblem_split_k: float = 1.5
    emblem_split_floor: int = 50
    emblem_split_fraction: float = 0.05
    merge_score: float = 0.78
    merge_containment: float = 0.75
    merge_jaccard: float = 0.60
    merge_carry_overlap: float = 0.34
    merge_weights: tuple[float, float, float] = (0.45, 0.35, 0.20)
    merge_optional: float = 0.35
    merge_dominant: float = 0.40
    merge_assign_margin: float = 0.02
    merge_refine_margin: float = 0.10
    merge_trait_strong: float = 0.65
    merge_trait_slack: tuple[float, float] = (0.12, 0.15)
    merge_trait_min: float = 0.20
    merge_grade3_min_n: int = 10
    merge_carry_strong: float = 0.75
    merge_carry_slack: float = 0.06
    merge_hero_low: float = 0.2
    merge_level_gap: float = 1.75
    merge_weight_core: float = 0.7
    merge_weight_flex: float = 0.25
    merge_flex_min_cost: int = 4
    merge_flex_item_rate: float = 0.25
    merge_damage_rate: float = 0.25
    merge_fallback_rate: float = 0.5
    seed_min_total: int = 2
    ranked_queue: int = 1100
    full_lobby: int = 8
    require_emblem: bool = False
    hero_rate: float = 0.5
    hero_champions: tuple[str, ...] = ()
    gated_units: tuple[str, ...] = ()


PRODUCTION = Config()
#: For the small derived boards of the test tables, on which the floors of production select nothing.
FIXTURE = replace(PRODUCTION, min_board_units=3, tier_min_sample=3, trend_min_sample=2, emblem_split_floor=3, hero_champions=("U0", "U1"), gated_units=("U2", "U5"))

#: Items that are parts, not finished (fixed values of the domain); the views of the test tables have one.
COMPONENT_ITEMS = (
    "TFT_Item_BFSword", "TFT_Item_RecurveBow", "TFT_Item_NeedlesslyLargeRod", "TFT_Item_TearOfTheGoddess", "TFT_Item_ChainVest",
    "TFT_Item_NegatronCloak", "TFT_Item_GiantsBelt", "TFT_Item_SparringGloves", "TFT_Item_Spatula", "TFT_Item_FryingPan", "TFT_Item_EmptyBag",
)
DAMAGE_ITEMS = ("TFT_Item_I0", "TFT_Item_I1", "TFT_Item_I2", "TFT_Item_I3", "TFT_Item_I4")
EMBLEM_PATTERN = "(?i)emblem"
TIERS = ("S", "A", "B", "C", "D")
