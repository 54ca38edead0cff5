"""Scores of pooled results: rates, intervals, shrinkage, tiers.  Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TIERS, Config

STATS = ("n", "placement_sum", "placement_sumsq", "top4_count", "win_count")


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def rate(part: Column, n: Column, empty: float) -> Column:
    return F.when(n > 0, part / n).otherwise(F.lit(empty))


def avg_placement(config: Config) -> Column:
    return rate(F.col("placement_sum"), F.col("n"), config.prior_placement)


def sem() -> Column:
    """Standard error of the mean placement; 0 for fewer than two boards."""
    n, mean = F.col("n"), F.col("placement_sum") / F.col("n")
    variance = F.greatest(F.lit(0.0), (F.col("placement_sumsq") - n * mean * mean) / (n - 1))
    return F.when(n >= 2, F.sqrt(variance / n)).otherwise(0.0)


def wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Wilson interval of k in n, within 0 and 1; (0, 0) without trials."""
    p, zz = k / n, z * z
    denominator = 1 + zz / n
    centre = (p + zz / (2 * n)) / denominator
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / denominator
    some = lambda x: F.when(n > 0, clamp01(x)).otherwise(0.0)
    return some(centre - half), some(centre + half)


def shrunk_score(config: Config) -> Column:
    """Half placement, half top-4 rate, each drawn to its prior by the prior's weight in boards."""
    w = F.col("n") / (F.col("n") + config.prior_weight)
    placement = w * avg_placement(config) + (1 - w) * config.prior_placement
    top4 = w * rate(F.col("top4_count"), F.col("n"), config.prior_top4) + (1 - w) * config.prior_top4
    return 0.5 * clamp01((8 - placement) / 7) + 0.5 * top4


def metrics(stats: DataFrame, config: Config) -> DataFrame:
    """Adds every derived measure to rows of sufficient statistics."""
    low, high = wilson(F.col("top4_count"), F.col("n"), config.z)
    return stats.withColumns({
        "avg_placement": avg_placement(config), "top4_rate": rate(F.col("top4_count"), F.col("n"), config.prior_top4), "win_rate": rate(F.col("win_count"), F.col("n"), 0.0),
        "placement_sem": sem(), "top4_low": low, "top4_high": high, "score": shrunk_score(config), "low_sample": F.col("n") < config.low_sample,
    })


def static_tier(score: Column, config: Config) -> Column:
    out = F.lit(TIERS[-1])
    for tier, band in reversed(list(zip(TIERS, config.tier_bands))):
        out = F.when(score >= band, tier).otherwise(out)
    return out


#: Slices of the scores 0 to 1 within which rows are ranked.
SLICES = 4096


def ranked(scores: DataFrame, by: list[str], *ties: str) -> DataFrame:
    """Adds ``_rank`` (1: highest score) within ``by`` and ``_all``, the rows there.

    A few groups may hold all rows, so none is sorted as a whole: rows are counted by slice
    of the score, which gives each slice its first rank, and sorted within their slice.
    """
    rows = scores.withColumn("_slice", F.floor((1 - clamp01(F.col("score"))) * SLICES).cast("int"))
    counts = rows.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*by)
    before = own.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_all"))
    inside = Window.partitionBy(*by, "_slice").orderBy(F.desc("score"), *ties)
    placed = rows.withColumn("_in", F.row_number().over(inside)).join(starts, [*by, "_slice"])
    return placed.withColumn("_rank", F.col("_before") + F.col("_in")).drop("_slice", "_in", "_before")


def cutoffs(scores: DataFrame, by: list[str], config: Config) -> DataFrame:
    """(by..., s, a, b, c): score at floor(p * count) in descending order; no row under the least count.

    Only the four ranks wanted leave each group, so no list of scores is built.
    """
    finite = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return cuts_of(ranked(finite, by), by, config)


def cuts_of(ranked: DataFrame, by: list[str], config: Config) -> DataFrame:
    """``cutoffs`` from rows that have their rank."""
    ranked = ranked.filter(F.col("_all") >= config.min_tier_scores)
    at = [F.least(F.col("_all") - 1, F.floor(p * F.col("_all"))) + 1 for p in config.tier_percentiles]
    names = ("cut_s", "cut_a", "cut_b", "cut_c")
    return ranked.groupBy(*by).agg(*(F.max(F.when(F.col("_rank") == x, F.col("score"))).alias(n) for x, n in zip(at, names)))


def dynamic_tier(score: Column, config: Config) -> Column:
    """Tier by the group's cutoffs, or by static bands where it has none."""
    out = F.lit(TIERS[-1])
    for tier, cut in reversed(list(zip(TIERS, ("cut_s", "cut_a", "cut_b", "cut_c")))):
        out = F.when(score >= F.col(cut), tier).otherwise(out)
    return F.when(F.col("cut_s").isNull(), static_tier(score, config)).otherwise(out)
