"""Document fingerprints by winnowing.

Every run of K code points gets a rolling polynomial hash; of every WINDOW
consecutive hashes the least is kept, the rightmost among equals; a hash kept by
several windows counts once, with its position.  Any passage of K + WINDOW - 1 code
points that two texts share gives them a fingerprint in common (the match guarantee).

A text of 1 to K - 1 code points has one hash, of all of it; an empty or null text has
none.  Two texts without hashes are alike (1.0); one without and one with are not (0.0).
Likeness is the Jaccard similarity of the sets of hashes.  Repeated rows stay; rows of equal
doc_id stand in the order of their texts and share a range.  Null doc_ids come first.  An
empty table gives none.  Only doc_id and text are read.  A very long text is one row: its
hashes are arrays of some 50 bytes a code point, in its own slice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

K, WINDOW = 16, 32
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MATCH_LENGTH = K + WINDOW - 1


def power(exponent: int) -> np.uint64:
    return np.uint64(pow(BASE, exponent, 1 << 64))


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all runs of k values, by joining runs of doubled length."""
    if not len(points):
        return np.zeros(0, np.uint64)
    k = min(k, len(points))
    single = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    single ^= single >> np.uint64(29)
    done, total, run, size = 0, None, single, 1
    while True:
        if k & size:  # runs of `done` values are followed by one of `size`
            total = run if total is None else total[: len(total) - size] * power(size) + run[done : done + len(total) - size]
            done += size
        if done == k:
            break
        run = run[:-size] * power(size) + run[size:]
        size *= 2
    total = total * np.uint64(MIX)
    return (total ^ (total >> np.uint64(31))) >> np.uint64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint of a text, in order of position."""
    hashes = gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), k)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    width = min(window, n)
    # least hash first, then the rightmost position
    least = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: n - width + 1], least[width - size :])
    kept = np.concatenate([[True], least[1:] != least[:-1]])
    least = least[kept]
    return (least >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared / (len(a) + len(b) - shared)


def written_out(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def edited(text: str, after: str) -> str:
    """The last half of the text gives way to the first as many code points of ``after``."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


BUCKETS = 4096


def cut_index(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or under value (null: none), by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts)
    steps = F.lit([1 << p for p in range(len(cuts).bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(cuts)) & (F.get(table, low + step - 1) <= value), low + step).otherwise(low))
    return F.coalesce(found, F.lit(0))


def in_order(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (bucket, halo, doc_id, text) in ranges of doc_id, sorted in each range.

    Ranges come from quantiles of all doc_ids, at most BUCKETS of them.  The last row of
    a range also stands, marked ``halo``, in front of the next one (of the last range: in
    front of the first), so every row finds its predecessor in its own range.  What the
    driver holds and broadcasts is one row for each range.
    """
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(BUCKETS, 4 * count)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []))
    rows = rows.withColumn("bucket", cut_index(F.col("doc_id"), cuts).cast("int"))
    lasts = sorted(rows.groupBy("bucket").agg(F.max("doc_id").alias("last")).collect())
    table = [(a.bucket, a["last"], b.bucket) for a, b in zip(lasts, lasts[1:] + lasts[:1])]
    follow = F.broadcast(spark.createDataFrame(table, "bucket int, last long, next int"))
    own = F.struct("bucket", F.lit(False).alias("halo"))
    ahead = F.struct(F.col("next").alias("bucket"), F.lit(True).alias("halo"))
    at = F.when(F.col("doc_id").eqNullSafe(F.col("last")), F.array(own, ahead)).otherwise(F.array(own))
    dealt = rows.join(follow, "bucket").select(F.explode(at).alias("at"), "doc_id", "text").select("at.bucket", "at.halo", "doc_id", "text")
    return dealt.repartitionByRange(count, "bucket").sortWithinPartitions("bucket", F.desc("halo"), "doc_id", "text")


def digest(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The next document of a row is its predecessor in ascending (doc_id, text), and the
    last row for the first.  ``n_hashes`` counts the fingerprint; ``positions`` has the
    code-point position of each of its hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            for piece in slices(batch):
                out: list[tuple] = []
                for bucket, halo, doc_id, text in zip(*(c.to_pylist() for c in piece.columns)):
                    hashes, positions = winnow(text, k, window)
                    own = np.unique(hashes)
                    if not halo:
                        if before is None or before[0] != bucket:
                            raise ValueError("a range of documents lacks the row in front of it")
                        other = edited(text, before[1])
                        changed = winnow(other, k, window)[0]
                        out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), written_out(hashes), written_out(changed), likeness(own, np.unique(changed)), likeness(own, before[2]), len(own), positions))
                    before = (bucket, text, own)
                columns = list(zip(*out)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32())))], names=NAMES)

    return in_order(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, positions array<int>")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes", "positions"]


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """One row (doc_id, hash, position) for each hash of a document's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, positions = winnow(text or "", k, window)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_id] * len(hashes), pa.int64()), "hash": pa.array(hashes.astype(np.int64)), "position": pa.array(positions)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, hash long, position long")
