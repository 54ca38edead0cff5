"""Match documents as five tables that a repeated micro-batch leaves as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import comp_id
from . import matches as source
from . import store
from .matches import MATCH

TABLES = ("matches", "participants", "units", "traits", "augments", "outcomes")


def board_id(match_id: Column, puuid: Column) -> Column:
    """A board's id from what identifies it, so its children know it before anything is written."""
    return comp_id(F.concat(match_id, F.lit("#"), puuid))


def first_boards(docs: DataFrame) -> DataFrame:
    """Documents with the first board of each player: that of the least place, found in the document itself, so no board is shuffled."""
    order = F.array_sort(F.transform("info.participants", lambda p, i: F.struct(p["placement"].alias("placement"), i.alias("i"), p["puuid"].alias("puuid"))))
    rows = docs.withColumn("_order", order)
    first = F.filter("info.participants", lambda p, i: F.get(F.filter("_order", lambda x: x["puuid"] == p["puuid"]), F.lit(0))["i"] == i)
    return rows.withColumn("info", F.col("info").withField("participants", first)).drop("_order")


def shaped(docs: DataFrame, ranked_queue: int = 1100) -> dict[str, DataFrame]:
    """Rows of each table, of documents of different matches.  Boards of ranked matches only, without bots; of a player's boards in a match the first."""
    boards = source.flat_participants(first_boards(docs), ranked_queue).withColumn("id", board_id(F.col("match_id"), F.col("puuid")))
    most = F.array_sort(F.transform("units", lambda u, i: F.struct((-F.size(u["itemNames"])).alias("a"), (-u["rarity"]).alias("b"), i.alias("c"), u["character_id"].alias("d"))))
    units = boards.withColumn("carry", F.get(most, F.lit(0))["d"]).select("id", "carry", "units", F.posexplode("units").alias("pos", "u"))
    copy = F.size(F.filter(F.slice("units", F.lit(1), F.col("pos")), lambda x: x["character_id"] == F.col("u.character_id")))
    carries = (F.col("u.character_id") == F.col("carry")) & (F.size("u.itemNames") > 0)
    once = F.filter("traits", lambda t, i: ~F.exists(F.slice("traits", F.lit(1), i), lambda x: x["name"].eqNullSafe(t["name"])))
    return {
        "matches": source.flat_matches(docs),
        "participants": boards.select("id", "match_id", "puuid", "placement", "level"),
        "units": units.select("id", F.col("u.character_id").alias("character_id"), copy.alias("copy_index"), F.col("u.tier").alias("star_tier"), F.col("u.itemNames").alias("item_ids"), carries.alias("is_carry")),
        "traits": boards.select("id", F.inline(once)),
        "augments": boards.select("id", F.posexplode("augments").alias("slot", "augment_id")).select("id", "augment_id", (F.col("slot") + 1).alias("slot")),
    }


def persist(batch: DataFrame, number: int, path: str, ranked_queue: int = 1100) -> None:
    """Writes the batch's new matches and all that belongs to them, as parts of the batch's own number.

    Matches of earlier batches are skipped.  A batch that is run again replaces its own parts by the
    same rows, so a failure between two tables leaves nothing half done.  Documents are shuffled once, by
    match and as text, which is a fraction of their rows; what is new is stored, and all tables come from it.
    """
    spark, own = batch.sparkSession, f"{path}/documents/batch={number}"
    rows = batch.select(F.col("metadata.match_id").alias("match_id"), F.col("info.queue_id").alias("queue_id"), F.to_json(F.struct("metadata", "info")).alias("doc")).dropDuplicates(["match_id"])
    known = spark.createDataFrame([], "match_id string, known boolean")
    if number:
        known = spark.read.schema("match_id string, batch int").parquet(f"{path}/matches").filter(F.col("batch") < number).select("match_id", F.lit(True).alias("known"))
    new = F.from_json(F.when(F.col("known").isNull(), F.col("doc")), MATCH)
    rows.join(known, "match_id", "left").select("match_id", "queue_id", "known", new.alias("doc")).write.mode("overwrite").parquet(own)
    docs = spark.read.schema(f"match_id string, queue_id int, known boolean, doc struct<{MATCH}>").parquet(own)
    outcome = F.when(F.col("known"), "skipped").when(F.col("queue_id") == ranked_queue, "stored").otherwise("meta-only")
    for name, table in (shaped(docs.filter("known IS NULL").select("doc.*"), ranked_queue) | {"outcomes": docs.select("match_id", outcome.alias("outcome"))}).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def persist_stream(stream: DataFrame, times: int = 1, path: str | None = None) -> str:
    """Runs a stream of match documents into the tables; gives their folder.  ``times``: how often each batch is run.

    With the ``path`` of tables that are there it goes on after their last batch: what has come since is one batch, in however many files.
    """
    path = path or store.new_path(stream.sparkSession, "persisted")

    def keep(batch: DataFrame, number: int) -> None:
        for _ in range(times):
            persist(batch, number, path)

    stream.writeStream.option("checkpointLocation", f"{path}-stream").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return path


def prune_cascade(parents: DataFrame, children: DataFrame, dependents: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """Parents that no child has any more go, and with them their rows in every dependent table."""
    orphans = parents.select(key).distinct().join(children.select(key), key, "left_anti")
    orphans = store.saved(orphans, "orphans")
    return {name: rows.join(orphans, key, "left_anti") for name, rows in ({"": parents} | dependents).items()}


def drop_partitions(spark: SparkSession, path: str, column: str, before: str) -> list[str]:
    """Removes the folders of a table partitioned by date that lie before a date; no other file is touched."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for status in fs.listStatus(hadoop):  # one entry a date
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and name.split("=", 1)[1] < before:
            fs.delete(status.getPath(), True)
            gone.append(name.split("=", 1)[1])
    return sorted(gone)
