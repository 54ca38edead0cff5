"""Jobs as rows: chains of stages, retried calls, cached results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chained(rows: DataFrame, stages: tuple[str, ...], failures: Callable[[int], Column], attempts: int = 3, wait: int = 5) -> DataFrame:
    """Rows with each stage that ran: tried up to ``attempts`` times, with waits that double, and
    only if all before it succeeded.  ``failures(place)``: how often the stage fails first."""
    parts = []
    fine = F.lit(True)
    for place, stage in enumerate(stages, 1):
        fails = failures(place)
        done = fails < attempts
        tried = F.struct(
            F.lit(stage).alias("stage"), F.lit(place).alias("place"), F.least(fails + 1, F.lit(attempts)).cast("long").alias("attempts"), done.alias("done"),
            (wait * (F.pow(F.lit(2), F.least(fails, F.lit(attempts - 1))) - 1)).cast("long").alias("waited"))
        parts.append(F.when(fine, tried))
        fine = fine & done
    ran = F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("_ran")
    return rows.select("*", ran).select("*", "_ran.*").drop("_ran")


def retried_calls(calls: DataFrame, retries: int = 3) -> DataFrame:
    """event_id, calls, outcome and seconds waited of calls (event_id, k, kind, failures).

    ``limited``: every wait is what the limit names (k % 7 seconds here); ``down``: waits
    double from one second; ``missing`` is not tried again.
    """
    fails = F.least("failures", F.lit(retries))
    missing = F.col("kind") == "missing"
    outcome = F.when(missing, "none").when((F.col("kind") == "fine") | (F.col("failures") <= retries), "ok").otherwise("failed")
    waited = F.when(missing, 0).when(F.col("kind") == "limited", fails * (F.col("k") % 7)).otherwise(F.pow(F.lit(2), fails) - 1)
    return calls.select("event_id", F.when(missing, 1).otherwise(fails + 1).cast("long").alias("calls"), outcome.alias("outcome"), waited.cast("long").alias("waited"))


def cache_hits(requests: DataFrame, key: str, seconds: int) -> DataFrame:
    """event_id and hit of requests (event_id, key, ts): a result lives so long from when it was made.

    Each request depends on the one before it, so rows pass in order of key and time; a task
    holds one time of one key, however many requests the key has.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    rows = requests.select("event_id", F.col(key).alias("key"), micros).repartition("key").sortWithinPartitions("key", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = object(), 0
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (k, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                hit[i] = k == now and at < made + seconds * 1_000_000
                if not hit[i]:
                    now, made = k, at
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit)], names=["event_id", "hit"])

    return rows.mapInArrow(run, "event_id long, hit boolean")
