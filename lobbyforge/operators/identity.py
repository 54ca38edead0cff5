"""Exact-board identity: which composition a board plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EMBLEM_PATTERN, Config


def is_emblem(item: Column) -> Column:
    return item.rlike(EMBLEM_PATTERN)


def unit_token(character: Column, star: Column, cost: Column, config: Config) -> Column:
    """A unit's part of the identity; only a cheap unit's third star counts."""
    hit = (F.coalesce(star, F.lit(0)) >= 3) & (cost <= config.star_max_cost)
    return F.concat(character, F.when(hit, ":3").otherwise(":lo"))


def emblems_worn(items: DataFrame) -> DataFrame:
    """(board_id, emblems): the distinct emblems on all units of a board, sorted."""
    return items.filter(is_emblem(F.col("item_id"))).groupBy("board_id").agg(F.array_sort(F.collect_set("item_id")).alias("emblems"))


def signatures(units: DataFrame, costs: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """(board_id, signature, core_units, three_stars, emblems) of boards with enough real units.

    Copies of a unit all count; units without a known cost of 1 to 5 do not.
    """
    real = units.join(F.broadcast(costs.select("character_id", "cost")), "character_id").filter(F.col("cost").between(1, 5))
    token = unit_token(F.col("character_id"), F.col("star_tier"), F.col("cost"), config)
    three = F.when(token.endswith(":3"), F.col("character_id"))
    boards = real.groupBy("board_id").agg(F.array_sort(F.collect_list(token)).alias("tokens"), F.array_sort(F.collect_list("character_id")).alias("core_units"), F.array_sort(F.collect_list(three)).alias("three_stars"))
    boards = boards.filter(F.size("tokens") >= config.min_board_units).join(emblems_worn(items), "board_id", "left")
    emblems = F.coalesce("emblems", F.array().cast("array<string>"))
    parts = F.concat("tokens", F.transform(emblems, lambda e: F.concat(F.lit("emb:"), e)))
    return boards.select("board_id", F.array_join(parts, "|").alias("signature"), "core_units", "three_stars", emblems.alias("emblems"))


def comp_id(signature: Column) -> Column:
    """An id that follows from the signature alone: no numbering over all comps is needed."""
    return F.conv(F.substring(F.md5(signature.cast("binary")), 1, 15), 16, 10).cast("long")


def signature_emblems(signature: Column) -> Column:
    """Emblems of a signature, sorted: the inverse of what ``signatures`` writes."""
    tokens = F.filter(F.split(signature, "[|]"), lambda t: t.startswith("emb:"))
    return F.array_sort(F.transform(tokens, lambda t: F.substring(t, 5, 1000)))


def assign(boards: DataFrame, signed: DataFrame) -> DataFrame:
    """Boards with their comp_id; those without identity have none (a stale one is cleared)."""
    return boards.join(signed.select("board_id", comp_id(F.col("signature")).alias("comp_id")), "board_id", "left")


def comps(signed: DataFrame) -> DataFrame:
    """One row a comp: comp_id, signature, core units and threes."""
    return signed.groupBy("signature").agg(F.first("core_units").alias("core_units"), F.first("three_stars").alias("three_stars"), F.first("emblems").alias("emblems")).withColumn("comp_id", comp_id(F.col("signature")))
