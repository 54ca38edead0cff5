"""Helpers shared by the document operators: reading, shared storage, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word is a run of characters that are none of these (fixed values of the contract).
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the driver and all executors share: ``spark.checkpoint.dir``.

    A folder of this machine's own is set only in a local session that names none, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.lobbyforge.checkpoint.dir", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="lobbyforge-")
            spark.conf.set("spark.lobbyforge.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fold(ascii_text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(ascii_text, UPPER, LOWER)


def crc_mod5(doc_id: Column) -> Column:
    """crc32 of the id as decimal text, modulo 5 (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list], schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch for each input batch; fn gets small slices.

    Slices hold at most SLICE_ROWS rows and about SLICE_BYTES of data, so a task's
    memory does not follow the length of the texts in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield fn(piece)

    return df.mapInArrow(run, schema)


SLICE_ROWS, SLICE_BYTES = 2000, 2 << 20


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into slices of bounded rows and bytes (a single longer row stays whole)."""
    rows = batch.num_rows
    step = max(1, min(SLICE_ROWS, int(rows * most_bytes / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def texts_of(column: pa.Array) -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]
