"""The crawl's frontier: which accounts a pass examines, and which players matches lead to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import store
from . import order


@dataclass(frozen=True)
class Budgets:
    """What a pass may spend; defaults are the production values."""

    tiers: tuple[str, ...] = ("CHALLENGER", "GRANDMASTER", "MASTER")
    accounts: int = 60
    overselect: int = 6
    explore: int = 20
    match_fetches: int = 1200
    matches_each: int = 20
    recrawl_hours: int = 12
    tier_hours: int = 24
    out_of_scope_hours: int = 168


def hours(n) -> Column:
    return F.make_dt_interval(F.lit(0), n)


def in_scope(tier: Column, budgets: Budgets) -> Column:
    return F.coalesce(F.upper(tier).isin(*budgets.tiers), F.lit(False))


def tier_fresh(budgets: Budgets) -> Column:
    """Whether a tier need not be looked up at ``now``: those in scope last shorter than the others."""
    lasts = F.when(in_scope(F.col("tier"), budgets), budgets.tier_hours).otherwise(budgets.out_of_scope_hours)
    return F.coalesce(F.col("tier_checked_at") > F.col("now") - hours(lasts), F.lit(False))


def released(budgets: Budgets, minutes: int = 15) -> Column:
    """When an account whose fetch failed counts as crawled last, so that it is due again in a few minutes."""
    return F.col("now") - hours(F.lit(budgets.recrawl_hours)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))


def drain(accounts: DataFrame, now: DataFrame, budgets: Budgets) -> DataFrame:
    """What a pass does with each account it comes to: (id, place, action, lookup, matches, enqueued, spent).

    ``accounts``: (id, tier, tier_checked_at, last_crawled_at, found_tier, available): the tier that a
    lookup would find and the matches there are.  ``now`` has one row.  Known good tiers come first, then
    unknown ones, then the longest not crawled.  A tier that is not fresh costs a lookup, by how long its class lasts; of unknown
    ones only so many are looked up and the others wait.  Accounts out of scope spend no
    matches.  The pass ends with the account that spends the last enqueue or the last match.
    """
    good = lambda tier: in_scope(tier, budgets)
    rows = accounts.crossJoin(F.broadcast(now))  # one row
    due = F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < F.col("now") - hours(F.lit(budgets.recrawl_hours)))
    rows = rows.filter(due).withColumns({"good": good(F.col("tier")), "unknown": F.col("tier").isNull(), "fresh": tier_fresh(budgets)})
    by = [F.desc("good"), F.desc("unknown"), F.asc_nulls_first("last_crawled_at"), F.asc("id")]
    table = order.dealt(rows, by, "frontier")
    blind = F.col("unknown") & ~F.col("fresh")
    seen = order.running(table, by, place=F.lit(1), blind_k=blind.cast("int")).filter(F.col("place") <= budgets.accounts * budgets.overselect)
    waits = blind & (F.col("blind_k") > budgets.explore)
    tier = F.when(F.col("fresh"), F.col("tier")).otherwise(F.col("found_tier"))
    fetch = ~waits & good(tier)
    wanted = F.when(fetch, F.least("available", F.lit(budgets.matches_each))).otherwise(0)
    spent = order.running(seen.withColumns({"waits": waits, "fetch": fetch, "wanted": wanted}), by, enqueued=(F.col("wanted") > 0).cast("int"), asked=F.col("wanted"))
    before = {"enqueued": F.col("enqueued") - (F.col("wanted") > 0).cast("int"), "spent": F.col("asked") - F.col("wanted")}
    reached = (before["enqueued"] < budgets.accounts) & (before["spent"] < budgets.match_fetches)
    action = F.when(F.col("waits"), "waits").when(~F.col("fetch"), "out_of_scope").when(F.col("available") == 0, "nothing_new").otherwise("fetch")
    matches = F.least("wanted", budgets.match_fetches - before["spent"]).cast("long")
    return spent.filter(reached).select("id", "place", action.alias("action"), (~F.col("fresh") & ~F.col("waits")).alias("lookup"), matches.alias("matches"), "enqueued", (before["spent"] + matches).alias("spent"))


def reach(boards: DataFrame, seeds: DataFrame) -> DataFrame:
    """(puuid, level): in how many rounds of reading players' matches each player is found.

    ``boards``: (match_id, puuid).  A round reads the matches of the players found last and keeps
    the players that no earlier round has, each round a table of its own; it ends when there are none.
    """
    spark, path = boards.sparkSession, store.new_path(boards.sparkSession, "frontier")
    seeds.select("puuid").distinct().write.parquet(f"{path}/level=0")
    level, schema = 0, "puuid string, level int"
    while True:
        known = spark.read.schema(schema).parquet(path)
        last = known.filter(F.col("level") == level).select("puuid")
        matches = boards.join(last, "puuid", "left_semi").select("match_id").distinct()
        found = boards.join(matches, "match_id", "left_semi").select("puuid").distinct().join(known.select("puuid"), "puuid", "left_anti")
        level += 1
        found.write.mode("overwrite").parquet(f"{path}/level={level}")
        if spark.read.schema("puuid string").parquet(f"{path}/level={level}").isEmpty():
            return spark.read.schema(schema).parquet(path)
