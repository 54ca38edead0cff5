"""Sufficient statistics: sums that add up at every grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scoring import STATS

BUCKET = ("patch_id", "region", "rank_bucket")


def ranked(matches: DataFrame, config: Config) -> DataFrame:
    """Matches whose boards count: ranked queue, known set, full of people."""
    return matches.filter((F.col("queue_id") == config.ranked_queue) & F.col("set_number").isNotNull() & (F.col("player_count") == config.full_lobby))


def board_stats(placement: Column) -> list[Column]:
    p = placement.cast("long")
    return [F.count(F.lit(1)).alias("n"), F.sum(p).alias("placement_sum"), F.sum(p * p).alias("placement_sumsq"), F.count_if(p <= 4).alias("top4_count"), F.count_if(p == 1).alias("win_count")]


def comp_stats(boards: DataFrame) -> DataFrame:
    """Statistics by comp and bucket; one shuffle, summed before it."""
    known = boards.filter(F.col("comp_id").isNotNull() & F.col("patch_id").isNotNull())
    return known.groupBy("comp_id", *BUCKET).agg(*board_stats(F.col("placement")))


def bucket_totals(boards: DataFrame) -> DataFrame:
    known = boards.filter(F.col("comp_id").isNotNull() & F.col("patch_id").isNotNull())
    return known.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("total_boards"))


def pool(stats: DataFrame, *by: str | Column) -> DataFrame:
    """Sums statistics up to a coarser grain."""
    return stats.groupBy(*by).agg(*(F.sum(c).cast("long").alias(c) for c in STATS))


def gkey(meta_comp: Column, comp_id: Column) -> Column:
    """Grouping key: the archetype's label if there is one, else the comp."""
    return F.coalesce(F.concat(F.lit("m:"), F.nullif(meta_comp, F.lit(""))), F.concat(F.lit("c:"), comp_id.cast("string")))
