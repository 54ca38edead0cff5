"""Operator 11: documents drawn by importance towards a target, with features counted in word tries.

A feature is a run of 1 to ``longest`` consecutive words.  A task keeps a trie of words: each node
has the count of its run and the CRC state of the run's bytes, from which the states of its
children go on.  A full trie is poured into bucket totals and begun anew, so memory is bounded
and counts stay exact.  Totals of the tasks are summed; for scoring, a node that is met first gets
its bucket's gain, and a document's gains are those of the nodes on its paths.

Ranks need no sort in one task: documents are counted by slices of the score, slices that can hold
drawn documents are sorted by range, and a rank is a row's place in its range behind the ranges before it.

Null and empty texts have no words, no features, a weight of 0, and are drawn only if
``least_words`` is 0.  A null doc_id hashes as empty text and comes last among equal scores.
Repeated rows are documents each; those equal in all that orders them have different ranks in any order.
Empty tables give empty results; an empty target has zero counts.  Other columns, whatever their
names, travel with their documents in a struct.  Very long texts are worked through in windows
of ``window`` characters that end between words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import fold, slices, texts_of, written

#: Letters and digits of ASCII and all other characters (fixed values of the contract), of lower-cased texts.
WORDS = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
SEPARATOR = re.compile("[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]")
#: Buckets that leave a task in one row.
LANE = 100
#: Width of the slices of scores that are counted before any row is ranked.
SLICE = 100


@dataclass(frozen=True)
class Settings:
    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024
    #: Characters worked through at once, and nodes of a trie before it is poured out: no result depends on them.
    window: int = 1 << 20
    most_nodes: int = 300_000


class Node:
    """A run of words: its CRC state, how often it was met since the trie began, its gain."""

    __slots__ = ("children", "count", "crc", "gain")

    def __init__(self, crc: int, gain: int):
        self.crc, self.gain, self.count, self.children = crc, gain, 0, None


class Trie:
    """Runs of words of one task; ``gains`` by bucket, if there are any yet."""

    def __init__(self, settings: Settings, gains: np.ndarray | None = None):
        self.settings, self.gains = settings, None if gains is None else gains.tolist()
        self.totals = np.zeros(settings.buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = Node(0, 0), 0
        self.root.children = {}

    def grow(self, parent: Node, word: str) -> Node:
        data = word.encode("utf-8", "surrogatepass")
        crc = zlib.crc32(data if parent is self.root else b" " + data, parent.crc)
        node = Node(crc, self.gains[crc % self.settings.buckets] if self.gains else 0)
        if parent.children is None:
            parent.children = {}
        parent.children[word] = node
        self.nodes += 1
        return node

    def walk(self, words: list[str], starts: int) -> tuple[int, int]:
        """Counts the runs that begin at the first ``starts`` words; their number and their gains."""
        features = gain = 0
        longest, heads = self.settings.longest, self.root.children
        for at in range(starts):
            node = heads.get(words[at]) or self.grow(self.root, words[at])
            node.count += 1
            gain += node.gain
            for word in words[at + 1 : at + longest]:
                node = (node.children and node.children.get(word)) or self.grow(node, word)
                node.count += 1
                gain += node.gain
                features += 1
        return features + starts, gain

    def text(self, text: str) -> tuple[int, int, int]:
        """(features, words, gains) of a lower-cased text."""
        features = n_words = gain = 0
        for words, starts in windows(text, self.settings):
            if self.nodes > self.settings.most_nodes:
                self.pour()
            f, g = self.walk(words, starts)
            features, n_words, gain = features + f, n_words + starts, gain + g
        return features, n_words, gain

    def pour(self) -> None:
        """Adds all counts to their buckets' totals and begins a new trie."""
        crcs, counts, open_nodes = [], [], [self.root]
        while open_nodes:
            for node in (open_nodes.pop().children or {}).values():
                crcs.append(node.crc)
                counts.append(node.count)
                if node.children:
                    open_nodes.append(node)
        np.add.at(self.totals, np.array(crcs, np.int64) % self.settings.buckets, np.array(counts, np.int64))
        self.clear()


def windows(text: str, settings: Settings) -> Iterator[tuple[list[str], int]]:
    """Words of a text by windows, each with the words that runs begun in it need, and how many begin in it."""
    longest, window = settings.longest, settings.window
    if len(text) <= window:
        words = WORDS.findall(text)
        yield words, len(words)
        return
    at, held = 0, []
    while at < len(text):
        cut = SEPARATOR.search(text, at + window)
        end = cut.start() if cut else len(text)
        held += WORDS.findall(text, at, end)
        at = end
        starts = max(0, len(held) - longest + 1) if at < len(text) else len(held)
        yield held, starts
        held = held[starts:]


def bucket_totals(texts: DataFrame, settings: Settings) -> np.ndarray:
    """Occurrences of features by bucket over the first column: one small row a lane leaves a task."""
    lane = min(LANE, settings.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(settings)
        for batch in batches:
            for piece in slices(batch):
                for text in texts_of(piece.column(0)):
                    trie.text(text)
        trie.pour()
        sums = np.zeros(-(-settings.buckets // lane) * lane, np.int64)
        sums[: settings.buckets] = trie.totals
        sums = sums.reshape(-1, lane)
        used = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(pa.array, np.ascontiguousarray(sums[used].T))], names=["lane", *cells])

    cells = [f"c{i}" for i in range(lane)]
    summed = texts.mapInArrow(run, "lane int, " + ", ".join(f"{c} long" for c in cells)).groupBy("lane").agg(*(F.sum(c).alias(c) for c in cells))
    out = np.zeros(-(-settings.buckets // lane) * lane, np.int64)
    for at, *sums in summed.collect():  # at most buckets / LANE rows, whatever the input
        out[at * lane : (at + 1) * lane] = sums
    return out[: settings.buckets]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the log ratio of target to source, smoothed by one and rounded down."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.astype(float).tolist(), target.astype(float).tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in pairs], np.int64)


def luck(doc_id: Column, seed: int) -> Column:
    """A thousand times a Gumbel number that a document's id and the seed decide, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """Rows (_doc, _features, _words, _weight, _score); ``_doc`` holds the columns ``keep``, or all."""
    low = fold(F.coalesce(F.col("text"), F.lit("")))
    attached = gains(bucket_totals(docs.select(low), settings), bucket_totals(target.select(low), settings))
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in (keep or docs.columns))).alias("_doc"), low.alias("_low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(settings, attached)
        for batch in batches:
            for piece in slices(batch):
                found = np.array([trie.text(t) for t in texts_of(piece.column(1))], np.int64).reshape(-1, 3)
                weight = found[:, 2] // np.maximum(found[:, 0], 1)
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, (found[:, 0], found[:, 1], weight))], names=["_doc", "_features", "_words", "_weight"])

    schema = StructType([kept.schema["_doc"], *(StructField(c, LongType()) for c in ("_features", "_words", "_weight"))])
    return kept.mapInArrow(run, schema).withColumn("_score", F.col("_weight") + luck(F.col("_doc.doc_id"), settings.seed))


def ranked(docs: DataFrame, target: DataFrame, settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """``scored`` with ``_rank``: 1 and up for the drawn documents by falling score, null for the others."""
    rows = written(scored(docs, target, settings, keep), "scores")
    able = F.col("_words") >= settings.least_words
    place = F.floor(F.col("_score") / SLICE)
    # bounded: a score is under 10^5 in size, so there are at most a few thousand slices
    counts = sorted(((r["s"], r["n"]) for r in rows.filter(able).groupBy(place.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw = sum(n for _, n in counts) * settings.percent // 100
    least, have = None, 0
    for at, n in counts:
        if have >= draw:
            break
        least, have = at, have + n
    if least is None or draw == 0:
        return rows.withColumn("_rank", F.lit(None).cast("long"))
    maybe = able & (place >= least)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("_score"), F.asc_nulls_last("_id"), F.asc("_tie")]
    found = rows.filter(maybe).withColumns({"_id": F.col("_doc.doc_id"), "_tie": F.monotonically_increasing_id()})
    dealt = found.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = written(dealt.select(*rows.columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "ranks")
    before, total = {}, 0
    for part, n in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # as many rows as partitions
        before[part], total = total, total + n
    offsets = docs.sparkSession.createDataFrame(list(before.items()), "_part int, _before long")
    place_of = F.col("_before") + F.col("_at") + 1
    top = dealt.join(F.broadcast(offsets), "_part").select(*rows.columns, F.when(place_of <= draw, place_of).alias("_rank"))
    return top.unionByName(rows.filter(~maybe).withColumn("_rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The drawn documents, all their columns and no others."""
    return ranked(docs, target, settings).filter("_rank IS NOT NULL").select("_doc.*")
