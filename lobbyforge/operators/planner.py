"""The trait engine of a planned board."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .itemization import dealt


def active_traits(units: DataFrame, unit_traits: DataFrame, doubled: DataFrame, emblems: DataFrame, breakpoints: DataFrame, parts: int | None = None) -> DataFrame:
    """(board_id, trait_id, count, style, next_at, is_unique, place) of every trait on a board.

    A unit counts once for a trait, however many copies there are: by what it gives itself (``doubled``: (character_id,
    trait_id, contribution), else 1) or by an emblem (``emblems``: (board_id, character_id, trait_id)), whichever is
    more.  Style is that of the last breakpoint met; the order is style, count, id.  Units and emblems meet in one shuffle,
    of ``parts`` partitions.
    """
    innate = unit_traits.select("character_id", "trait_id").distinct().join(doubled, ["character_id", "trait_id"], "left").withColumn("c", F.coalesce("contribution", F.lit(1)))
    innate = F.broadcast(innate.groupBy("character_id").agg(F.collect_list(F.struct("trait_id", "c")).alias("own")))
    rows = dealt(units.select("board_id", "character_id", F.lit(None).cast("string").alias("trait_id")).unionAll(emblems.select("board_id", "character_id", "trait_id")), parts)
    given = F.array(F.struct("trait_id", F.lit(1).alias("c")))
    held = rows.distinct().join(innate, "character_id", "left").select("board_id", "character_id", F.inline(F.when(F.col("trait_id").isNotNull(), given).otherwise(F.col("own"))))
    each = held.groupBy("board_id", "trait_id", "character_id").agg(F.max("c").alias("c"))
    count = each.groupBy("board_id", "trait_id").agg(F.sum("c").alias("count"))
    steps = breakpoints.groupBy("trait_id").agg(F.array_sort(F.collect_list(F.struct("min_units", "style"))).alias("steps"))
    met = F.filter("steps", lambda s: s["min_units"] <= F.col("count"))
    ahead = F.filter("steps", lambda s: s["min_units"] > F.col("count"))
    rows = count.join(F.broadcast(steps), "trait_id", "left").select(
        "board_id", "trait_id", "count", F.coalesce(F.try_element_at(met, F.lit(-1))["style"], F.lit(0)).cast("int").alias("style"), F.get(ahead, F.lit(0))["min_units"].cast("int").alias("next_at"), F.coalesce(F.size("steps") == 1, F.lit(False)).alias("is_unique"))
    order = Window.partitionBy("board_id").orderBy(F.desc("style"), F.desc("count"), "trait_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))
