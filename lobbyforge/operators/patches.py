"""Patches: which one is current, and which one a match was played on.

A table of patches has a row a release: (patch_id, set_number, patch, is_current), (set_number, patch)
being unique.  It is a dimension; matches are facts, of which only the distinct keys are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs

NUMBERED = "^[0-9]+[.][0-9]+$"


def placeholder(set_number: Column) -> Column:
    """The name of a set's patch as long as no version is known."""
    return F.concat(set_number.cast("string"), F.lit(".0"))


def live_set(units: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: the newest set that has both a catalogue and matches, null if there is none."""
    played = matches.select("set_number").distinct()
    return units.select("set_number").distinct().join(played, "set_number", "left_semi").agg(F.max("set_number").alias("set_number"))


def current_set(patches: DataFrame, units: DataFrame) -> DataFrame:
    """One row: the newest flagged set that has a catalogue, else the newest of the catalogue."""
    flagged = patches.filter("is_current").select("set_number", F.lit(True).alias("_flagged")).distinct()
    sets = units.select("set_number").distinct().join(flagged, "set_number", "left")
    return sets.agg(F.coalesce(F.max(F.when(F.col("_flagged"), F.col("set_number"))), F.max("set_number")).alias("set_number"))


def winner(patches: DataFrame, units: DataFrame, matches: DataFrame) -> DataFrame:
    """At most one row (patch_id, patch): the live set's newest numbered patch that has matches.

    Numbers are compared as numbers, and a set's placeholder comes behind all others.
    """
    part = F.split("patch", "[.]")
    order = [F.desc(F.col("patch") != placeholder(F.col("set_number"))), F.desc(part[0].try_cast("long")), F.desc(part[1].try_cast("long")), F.asc("patch_id")]
    of_set = patches.filter(F.col("patch").rlike(NUMBERED)).join(live_set(units, matches), "set_number", "left_semi")
    return of_set.join(matches.select("patch_id").distinct(), "patch_id", "left_semi").orderBy(*order).limit(1).select("patch_id", "patch")


def advance(patches: DataFrame, units: DataFrame, matches: DataFrame) -> DataFrame:
    """Patches with ``is_current`` as it becomes; ``changed`` marks the rows to write.

    Without a winner nothing changes.
    """
    won = winner(patches, units, matches).select("patch_id", F.lit(True).alias("_won"))
    found = patches.join(F.broadcast(won), "patch_id", "left")
    becomes = F.when(F.max("_won").over(Window.partitionBy(F.lit(0))), F.coalesce("_won", F.lit(False))).otherwise(F.col("is_current"))
    return found.withColumn("_becomes", becomes).withColumns({"changed": ~F.col("is_current").eqNullSafe(F.col("_becomes")), "is_current": F.col("_becomes")}).drop("_won", "_becomes")


def resolve(matches: DataFrame, patches: DataFrame) -> DataFrame:
    """Adds patch and patch_id by set and client version; an unknown patch has no id."""
    named = matches.withColumn("patch", codecs.patch_of_version(F.col("game_version"), F.col("set_number")))
    return named.join(F.broadcast(patches.select("set_number", "patch", "patch_id")), ["set_number", "patch"], "left")


def crawl_boundary(current: DataFrame, matches: DataFrame, hours: int = 12) -> DataFrame:
    """One row: the first match of the current patch, so many hours earlier; null if it has none."""
    mine = matches.join(F.broadcast(current.select("patch_id")), "patch_id", "left_semi")
    return mine.agg((F.min("game_datetime") - F.make_interval(hours=F.lit(hours))).alias("since"))


def cleared(patches: DataFrame, units: DataFrame) -> DataFrame:
    """Patches without the flag of those whose set has no catalogue; ``changed`` marks the rows to write."""
    there = units.select("set_number", F.lit(True).alias("_there")).distinct()
    found = patches.join(F.broadcast(there), "set_number", "left").withColumn("_becomes", F.col("is_current") & F.coalesce("_there", F.lit(False)))
    return found.withColumns({"changed": ~F.col("is_current").eqNullSafe(F.col("_becomes")), "is_current": F.col("_becomes")}).drop("_there", "_becomes")
