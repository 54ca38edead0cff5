"""Structured Streaming over the event log; results are tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources import store


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a stream; event time as a timestamp, which watermarks need."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream reads folders: the log's own folder, files of that name
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def arrivals(spark: SparkSession, rows: DataFrame, turn: Column, turns: int) -> DataFrame:
    """A stream of the rows that brings them in so many turns, one a micro-batch."""
    path = store.new_path(spark, "arrivals")
    for k in range(turns):
        rows.filter(turn == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def numbered(schema: StructType) -> StructType:
    """The schema of a table in parts by micro-batch."""
    return StructType([*schema.fields, StructField("batch", IntegerType())])


def usage_counts(events: DataFrame) -> DataFrame:
    """Calls by minute, method and region; late ones are added for ten minutes."""
    return events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute"), F.col("event_type").alias("method"), (F.col("user_id") % 4).alias("region")).agg(F.count(F.lit(1)).alias("requests"))


def latest_by_key(stream: DataFrame, key: list[str]) -> DataFrame:
    """Runs a stream of changing rows over what is there; gives the last state of each key.

    Every micro-batch writes the rows that it changed as a part of its own number, so one that
    is run again replaces itself.
    """
    spark = stream.sparkSession
    path = store.new_path(spark, "states")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    options = {"checkpointLocation": store.new_path(spark, "stream")}
    stream.writeStream.outputMode("update").options(**options).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(numbered(stream.schema)).parquet(path)
    others = [c for c in stream.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("_last"))
    return last.select(*key, "_last.*")


def first_seen(stream: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key (least ``order`` within a micro-batch, earlier batches first).

    What was seen is a table, not state in memory: a batch adds the keys that no earlier one had.
    """
    spark = stream.sparkSession
    path = store.new_path(spark, "seen")
    schema = stream.select(*key, order).schema

    def keep(batch: DataFrame, number: int) -> None:
        first = batch.groupBy(*key).agg(F.min(order).alias(order))
        if number:
            earlier = spark.read.schema(numbered(schema)).parquet(path).filter(F.col("batch") < number)
            first = first.join(earlier.select(*key), key, "left_anti")
        first.write.mode("overwrite").parquet(f"{path}/batch={number}")

    options = {"checkpointLocation": store.new_path(spark, "stream")}
    stream.writeStream.options(**options).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(path).select(*key, order)
