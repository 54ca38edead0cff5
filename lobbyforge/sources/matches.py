"""Match documents: nested JSON in, flat fact tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH = """metadata struct<match_id:string>, info struct<game_datetime:bigint, game_length:double, game_version:string, queue_id:int, tft_set_number:int,
participants:array<struct<puuid:string, placement:int, level:int, units:array<struct<character_id:string, tier:int, rarity:int, itemNames:array<string>>>,
traits:array<struct<name:string, num_units:int, style:int>>, augments:array<string>>>>"""


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of JSON lines under a fixed schema; nothing is inferred."""
    return spark.read.schema(MATCH).json(path)


def flat_matches(docs: DataFrame) -> DataFrame:
    """One row a match: region from its id, people without bots."""
    people = F.filter("info.participants", lambda p: p["puuid"] != "BOT")
    return docs.select(
        F.col("metadata.match_id").alias("match_id"), F.split_part("metadata.match_id", F.lit("_"), F.lit(1)).alias("region"), F.col("info.queue_id").alias("queue_id"),
        F.col("info.tft_set_number").alias("set_number"), F.timestamp_millis("info.game_datetime").alias("game_datetime"), F.size(people).alias("player_count"),
    )


def flat_participants(docs: DataFrame, ranked_queue: int = 1100) -> DataFrame:
    """One row a board of ranked matches; unknown queues and bots fan out to nothing."""
    rows = docs.filter(F.col("info.queue_id") == ranked_queue).select(F.col("metadata.match_id").alias("match_id"), F.explode("info.participants").alias("p"))
    return rows.filter("p.puuid <> 'BOT'").select("match_id", "p.puuid", "p.placement", "p.level", "p.units", "p.traits", "p.augments")


def flat_units(participants: DataFrame) -> DataFrame:
    """One row a unit copy, with its running index among the copies of the board."""
    rows = participants.select("match_id", "puuid", "units", F.posexplode("units").alias("pos", "u"))
    earlier = F.size(F.filter(F.slice("units", F.lit(1), F.col("pos")), lambda x: x["character_id"] == F.col("u.character_id")))
    return rows.select("match_id", "puuid", "pos", F.col("u.character_id").alias("character_id"), F.col("u.tier").alias("star_tier"), F.col("u.itemNames").alias("item_ids"), earlier.alias("copy_index"))


def persist(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome of each document: skipped if its match is known, stored if ranked, else meta-only."""
    new = docs.dropDuplicates(["metadata"]).select(F.col("metadata.match_id").alias("match_id"), F.col("info.queue_id").alias("queue_id"))
    marked = new.join(known.select("match_id", F.lit(True).alias("_known")), "match_id", "left")
    outcome = F.when(F.col("_known"), "skipped").when(F.col("queue_id") == 1100, "stored").otherwise("meta-only")
    return marked.select("match_id", outcome.alias("outcome"))


def pick_set(catalog: DataFrame, least: int = 20) -> DataFrame:
    """The newest set with a real roster: enough units of cost 1 to 5 that have a trait."""
    real = catalog.filter(F.col("cost").between(1, 5) & (F.size("traits") > 0))
    sizes = real.groupBy("set_number").agg(F.count_distinct("character_id").alias("roster")).filter(F.col("roster") >= least)
    return sizes.agg(F.max("set_number").alias("set_number"), F.max_by("roster", "set_number").alias("roster"))
