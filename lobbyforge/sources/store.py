"""Tables in the folder that the driver and the executors share, and how they change.

Parquet tables have no MERGE, UPDATE or DELETE: a change is a new state of the rows,
computed as a DataFrame and written beside the old one (or over one date's partition).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only in a local session that names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lobbyforge.store", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lobbyforge-")
        spark.conf.set("spark.lobbyforge.store", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Writes a table and reads it again."""
    path = new_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tables of this application that stand for what they were made from: key -> path.
MADE: dict[tuple, str] = {}


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, latest change) of a file or of all files of a folder, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, size, changed = fs.listFiles(root, True), 0, 0
    while files.hasNext():
        status = files.next()
        size, changed = size + status.getLen(), max(changed, status.getModificationTime())
    return size, changed


def there(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end and is still there."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def once(spark: SparkSession, name: str, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written the first time it is asked for under this key and read from then on; anew if it is gone."""
    key = (spark.sparkContext.applicationId, name, *key)
    if key not in MADE or not there(spark, MADE[key]):
        path = new_path(spark, name)
        build().write.parquet(path)
        MADE[key] = path
    return spark.read.parquet(MADE[key])


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it has not."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``old``, and those of ``new`` whose key it has not."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def stamp(rows: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Sets a column from values by key; rows without a value lose a stale one."""
    return rows.drop(column).join(values.select(key, column), key, "left")


def prune(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents that still have a child."""
    return parents.join(children.select(key), key, "left_semi")


def rewrite_partition(df: DataFrame, path: str, column: str) -> None:
    """Replaces the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def keep_manual(automatic: DataFrame, manual: DataFrame, key: list[str]) -> DataFrame:
    """Regenerated rows and the pinned ones; a pinned row wins over a regenerated one."""
    return automatic.join(manual.select(*key), key, "left_anti").unionByName(manual)
