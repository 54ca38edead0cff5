"""Itemization: which units carry, how they are built, what variant a board plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import COMPONENT_ITEMS, DAMAGE_ITEMS, Config


def completed(item: Column) -> Column:
    return ~item.isin(*COMPONENT_ITEMS)


def copies(units: DataFrame, items: DataFrame) -> DataFrame:
    """One row a unit copy: its completed items (sorted, repeats kept), all items' number and damage items."""
    done = F.when(completed(F.col("item_id")), F.col("item_id"))
    held = items.groupBy("board_id", "unit_row", "character_id").agg(
        F.array_sort(F.collect_list(done)).alias("done"), F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("item_id").isin(*DAMAGE_ITEMS)).alias("n_damage"))
    rows = units.select("board_id", "unit_row", "character_id", "star_tier").join(held, ["board_id", "unit_row", "character_id"], "left")
    return rows.withColumns({"done": F.coalesce("done", F.array().cast("array<string>")), "n_items": F.coalesce("n_items", F.lit(0)), "n_damage": F.coalesce("n_damage", F.lit(0))}).withColumn("n_done", F.size("done"))


def held_copies(held: DataFrame) -> DataFrame:
    """``copies`` of units that come with their items (board_id, unit_row, character_id, star_tier, items): nothing is shuffled."""
    done = F.array_sort(F.filter("items", completed))
    rows = held.select("board_id", "unit_row", "character_id", "star_tier", done.alias("done"), F.size("items").alias("n_items"), F.size(F.filter("items", lambda i: i.isin(*DAMAGE_ITEMS))).alias("n_damage"))
    return rows.withColumns({"n_items": F.col("n_items").cast("long"), "n_damage": F.col("n_damage").cast("long"), "n_done": F.size("done")})


def counted_copies(boards: DataFrame, units: DataFrame, items: DataFrame) -> DataFrame:
    """One row a unit copy on the boards (board_id, comp_id): its completed and its damage items by number alone.

    Units and their items meet in one shuffle by board, which all that is reckoned by board after that needs.
    """
    zero = F.lit(0).cast("long")
    one = lambda c: c.cast("long")
    held = units.select("board_id", "unit_row", "character_id", zero.alias("n_done"), zero.alias("n_damage"), F.lit(True).alias("unit"))
    worn = items.select("board_id", "unit_row", "character_id", one(completed(F.col("item_id"))), one(F.col("item_id").isin(*DAMAGE_ITEMS)), F.lit(False))
    rows = held.unionAll(worn).join(boards.select("board_id", "comp_id"), "board_id")
    copy = rows.groupBy("board_id", "comp_id", "unit_row", "character_id").agg(F.sum("n_done").alias("n_done"), F.sum("n_damage").alias("n_damage"), F.max("unit").alias("unit"))
    return copy.filter("unit").drop("unit")


def best_copy(held: DataFrame, by: str = "n_done") -> DataFrame:
    """Of a unit's copies on a board the one with most items, the first among equals.

    By completed items for carries and builds, by all items (``n_items``) for example teams.
    """
    order = Window.partitionBy("board_id", "character_id").orderBy(F.desc(by), "unit_row")
    return held.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def top_slots(best: DataFrame, config: Config) -> DataFrame:
    """Marks the units of a board that hold most completed items, ``carry_top_slots`` of them."""
    order = Window.partitionBy("board_id").orderBy(F.desc("n_done"), "character_id")
    return best.withColumn("is_top", (F.row_number().over(order) <= config.carry_top_slots) & (F.col("n_done") > 0))


def rates(boards: DataFrame, copies: DataFrame, config: Config) -> DataFrame:
    """By comp and unit: shares of the comp's boards (board_id, comp_id) where it is full, top and damage itemized, by copies dealt by board."""
    held = copies.select("board_id", "unit_row", "character_id", "n_done", "n_damage").join(boards.select("board_id", "comp_id"), "board_id")
    best = top_slots(best_copy(held), config)
    total = boards.groupBy("comp_id").agg(F.count(F.lit(1)).alias("total"))
    full = F.col("n_done") >= config.carry_fully_itemized
    damage = F.col("n_damage") >= config.carry_damage_min_items
    counts = best.groupBy("comp_id", "character_id").agg(F.count_if(full).alias("full"), F.count_if("is_top").alias("top"), F.count_if(damage).alias("damage"))
    share = lambda c: F.col(c) / F.col("total")
    return counts.join(total, "comp_id").select("comp_id", "character_id", "total", share("full").alias("full_rate"), share("top").alias("top_rate"), share("damage").alias("damage_rate"))


def carries(rated: DataFrame, config: Config) -> DataFrame:
    """Carries of each comp: full ones, else up to two that are often on top."""
    own = Window.partitionBy("comp_id")
    full = F.col("full_rate") >= config.carry_full_rate
    marked = rated.withColumns({"_full": full, "_any": F.max(full.cast("int")).over(own)})
    order = own.orderBy(F.desc("top_rate"), F.desc("full_rate"), "character_id")
    marked = marked.withColumn("_r", F.row_number().over(order))
    fallback = (F.col("_any") == 0) & (F.col("top_rate") >= config.merge_fallback_rate) & (F.col("_r") <= 2)
    return marked.filter(F.col("_full") | fallback).drop("_full", "_any", "_r")


def dealt(rows: DataFrame, parts: int | None) -> DataFrame:
    """Rows by board in one shuffle, in so many partitions: all that is reckoned by board after that stays where it is."""
    return rows.repartition(parts, "board_id") if parts else rows.repartition("board_id")


def trait_frame(units: DataFrame, unit_traits: DataFrame, emblems: DataFrame, breakpoints: DataFrame, parts: int | None = None) -> DataFrame:
    """(board_id, trait_id, num_units, level): distinct units by trait and one for each emblem;
    level counts the breakpoints met.  Traits below their first are left out, and so are
    markers whose only breakpoint is 1.  Units and emblems meet in one shuffle, of ``parts`` partitions."""
    none = F.lit(None).cast("string")
    rows = dealt(units.select("board_id", "character_id", none.alias("trait_id")).unionAll(emblems.select("board_id", none, "trait_id")), parts)
    each = rows.groupBy("board_id", "character_id", "trait_id").agg(F.count(F.lit(1)).alias("k"))
    innate = F.broadcast(unit_traits.groupBy("character_id").agg(F.collect_list("trait_id").alias("own")))
    trait = F.explode(F.when(F.col("trait_id").isNotNull(), F.array("trait_id")).otherwise(F.col("own"))).alias("trait_id")
    n = F.when(F.col("character_id").isNull(), F.col("k")).otherwise(1)
    count = each.join(innate, "character_id", "left").select("board_id", trait, n.alias("n")).groupBy("board_id", "trait_id").agg(F.sum("n").alias("num_units"))
    steps = breakpoints.groupBy("trait_id").agg(F.array_sort(F.collect_list("min_units")).alias("mins")).filter(~((F.size("mins") == 1) & (F.col("mins")[0] == 1)))
    leveled = count.join(F.broadcast(steps), "trait_id").withColumn("level", F.size(F.filter("mins", lambda m: m <= F.col("num_units"))))
    return leveled.filter("level > 0").select("board_id", "trait_id", "num_units", "level")


def emblem_trait(item: Column) -> Column:
    """Trait that an emblem grants, by the naming of both."""
    return F.concat(F.substring_index(item, "_", 1), F.lit("_"), F.regexp_extract(item, "_Item_(.*)EmblemItem$", 1))


def over_counts(reported: DataFrame, implied: DataFrame, least: int = 2) -> DataFrame:
    """Board's variant: the trait reported most above what its units imply, ties by id."""
    delta = F.col("num_units") - F.coalesce("implied", F.lit(0))
    rows = reported.join(implied, ["board_id", "trait_id"], "left").withColumn("delta", delta).filter(F.col("delta") >= least)
    order = Window.partitionBy("board_id").orderBy(F.desc("delta"), "trait_id")
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
