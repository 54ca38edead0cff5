"""Variants of a unit that documents report under one id: told from the traits that its board counts too many."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    """Units told apart by what they choose: the id reported, the ids there are, the trait that only marks
    the choice, and how far the chosen trait's count lies above what the units explain."""

    base: str
    pattern: str
    marker: str
    least: int = 2


def over_counts(units: DataFrame, unit_traits: DataFrame, reported: DataFrame) -> DataFrame:
    """(board_id, trait_id, delta): reported counts less what different units imply."""
    held = units.select("board_id", "character_id").distinct().join(F.broadcast(unit_traits.select("character_id", "trait_id").distinct()), "character_id")
    implied = held.groupBy("board_id", "trait_id").agg(F.count(F.lit(1)).alias("implied"))
    rows = reported.join(implied, ["board_id", "trait_id"], "left")
    return rows.select("board_id", "trait_id", (F.col("num_units") - F.coalesce("implied", F.lit(0))).cast("long").alias("delta"))


def chosen_traits(over: DataFrame, family: Family) -> DataFrame:
    """The trait over-counted most on each board, ties by id; the marker is none."""
    order = Window.partitionBy("board_id").orderBy(F.desc("delta"), "trait_id")
    able = over.filter((F.col("delta") >= family.least) & (F.col("trait_id") != family.marker))
    return able.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def infer(units: DataFrame, unit_traits: DataFrame, reported: DataFrame, families: tuple[Family, ...]) -> DataFrame:
    """(board_id, base, variant_id, trait_id, delta): variants whose traits hold the one their board over-counts."""
    out = None
    for family in families:  # a set has a few
        bases = units.filter(F.col("character_id") == family.base).select("board_id").distinct()
        over = over_counts(units.join(bases, "board_id", "left_semi"), unit_traits, reported.join(bases, "board_id", "left_semi"))
        able = F.broadcast(unit_traits.filter(F.col("character_id").rlike(family.pattern)).select(F.col("character_id").alias("variant_id"), "trait_id").distinct())
        rows = chosen_traits(over, family).join(able, "trait_id").select("board_id", F.lit(family.base).alias("base"), "variant_id", "trait_id", "delta")
        out = rows if out is None else out.unionByName(rows)
    return out


def tally(boards: DataFrame, inferred: DataFrame) -> DataFrame:
    """(comp_id, base, variant_id, boards)."""
    return inferred.join(boards.select("board_id", "comp_id"), "board_id").groupBy("comp_id", "base", "variant_id").agg(F.count(F.lit(1)).alias("boards"))


def pick(tallies: DataFrame, by: list[str]) -> DataFrame:
    """The variant of most boards over all comps of a row, ties by id."""
    sums = tallies.groupBy(*by, "base", "variant_id").agg(F.sum("boards").alias("boards"))
    order = Window.partitionBy(*by, "base").orderBy(F.desc("boards"), "variant_id")
    return sums.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
