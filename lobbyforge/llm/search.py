"""Operator 13: ranked lexical search over shards of documents with integer impacts.

The index is a table of shards.  A shard holds documents of at most about ``SHARD_BYTES`` of text
(a longer document is one by itself) as postings in compressed rows: its terms, for each term the
range of its postings, and for each posting the document's number in the shard and its impact, an
integer reckoned once from the length of the document and the totals of all documents.

Queries come in blocks of bounded size.  For a block, the documents that hold each of its terms are
counted from the shards' ranges alone; then each shard adds a query's terms one after another into a
dense array over its documents and keeps its best ``top``, a task those of all its shards, and these
are merged in two steps.  Ties go to the smaller doc_id (null last) at every step, so no shard drops
a document that belongs to the result.

Null and empty texts, and texts without a term, have no terms, do not count as documents and are
found by no query.  Repeated rows are documents each and may all be found, with different ranks;
which of equal rows is first does not matter.  A query without known terms has no rows.  Repeated
queries are answered each.  Empty tables give empty results.  Very long texts are cut into terms by
windows.  Only doc_id and text are read, item_id and text of queries, whatever other columns there are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, slices, texts_of, written

#: Letters and digits of ASCII and all other characters (fixed values of the contract).
TERMS = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
SEPARATOR = re.compile("[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]")
WINDOW = 1 << 20
SHARD_BYTES, SHARD_DOCS = 2 << 20, 1 << 14
#: Queries answered by one pass over the index: at most so many, and of so many bytes (a longer one alone).
BLOCK_QUERIES, BLOCK_BYTES = 500, 4 << 20
#: Groups in which the best of the tasks are merged before the last step.
LANES = 64
#: Share of length in a document's norm, and scales of weights and impacts (fixed values of the contract).
LENGTH_PART, WEIGHT_SCALE, IMPACT_SCALE = 25, 1000, 1_000_000_000

SHARD = "doc_ids array<long>, terms string, ranges binary, docs binary, impacts binary"


@dataclass(frozen=True)
class Totals:
    """Documents with a term, and terms of all documents."""

    documents: int
    terms: int


@dataclass(frozen=True)
class Index:
    shards: DataFrame
    totals: Totals


def windows(text: str) -> Iterator[list[str]]:
    """Terms of a text by windows that end between terms."""
    at = 0
    while at < len(text):
        cut = SEPARATOR.search(text, at + WINDOW) if len(text) > at + WINDOW else None
        end = cut.start() if cut else len(text)
        yield TERMS.findall(text, at, end)
        at = end


def counted(text: str) -> Counter:
    """Occurrences of a lower-cased text's terms."""
    out: Counter = Counter()
    for terms in windows(text):
        out.update(terms)
    return out


def n_terms(text: str) -> int:
    return sum(map(len, windows(text)))


def impacts(tf: np.ndarray, length: np.ndarray, totals: Totals) -> np.ndarray:
    """What an occurrence count is worth in a document of so many terms."""
    norm = 100 - LENGTH_PART + LENGTH_PART * length * totals.documents // totals.terms
    return IMPACT_SCALE * tf // (1000 * tf + 12 * norm)


class Shard:
    """Documents gathered for one shard."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.counts: list[Counter] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found = counted(text)
        if found:
            self.ids.append(doc_id)
            self.counts.append(found)
            self.bytes += len(text)

    def full(self, most_bytes: int) -> bool:
        return self.bytes >= most_bytes or len(self.ids) >= SHARD_DOCS

    def batch(self, totals: Totals) -> pa.RecordBatch:
        place: dict[str, int] = {}
        term = np.fromiter((place.setdefault(t, len(place)) for c in self.counts for t in c), np.int64)
        tf = np.fromiter((n for c in self.counts for n in c.values()), np.int64, len(term))
        doc = np.repeat(np.arange(len(self.ids)), [len(c) for c in self.counts])
        length = np.array([c.total() for c in self.counts], np.int64)[doc]
        order = np.argsort(term, kind="stable")
        ranges = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(place)))])
        data = [a.astype("<i4").tobytes() for a in (ranges, doc[order], impacts(tf, length, totals)[order])]
        kinds = (pa.list_(pa.int64()), pa.string(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((self.ids, " ".join(place), *data), kinds)], names=["doc_ids", "terms", "ranges", "docs", "impacts"])


def totals_of(docs: DataFrame) -> Totals:
    """Counted in one pass, before any impact can be reckoned; a task gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        for batch in batches:
            for piece in slices(batch):
                found = [n_terms(t) for t in texts_of(piece.column(0))]
                documents, terms = documents + len(found) - found.count(0), terms + sum(found)
        yield pa.RecordBatch.from_pydict({"documents": [documents], "terms": [terms]})

    # letters of either case make the same terms, so no text need be folded to count them
    row = docs.select("text").mapInArrow(run, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return Totals(*row)


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, written to the shared folder; no row leaves the task that read it."""
    totals = totals_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for piece in slices(batch):
                for doc_id, text in zip(piece.column(0).to_pylist(), texts_of(piece.column(1))):
                    shard.add(doc_id, text)
                    if shard.full(shard_bytes):
                        yield shard.batch(totals)
                        shard = Shard()
        if shard.ids:
            yield shard.batch(totals)

    rows = docs.select(F.col("doc_id").cast("long"), fold(F.coalesce("text", F.lit(""))))
    return Index(written(rows.mapInArrow(run, SHARD), "shards"), totals)


def blocks(queries: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """(item_id, lower-cased text) of the queries, fetched partition by partition, in blocks."""
    held, size = [], 0
    for item_id, text in queries.select("item_id", fold(F.coalesce("text", F.lit("")))).toLocalIterator():
        if held and (len(held) >= BLOCK_QUERIES or size + len(text) > BLOCK_BYTES):
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += len(text)
    if held:
        yield held


def holders(index: Index, wanted: set[str]) -> dict[str, int]:
    """How many documents hold each of the wanted terms: lengths of ranges, summed over the shards."""
    shared = index.shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for terms, ranges in zip(batch.column(0), batch.column(1)):
                sizes = np.diff(np.frombuffer(ranges.as_py(), "<i4"))
                for at, term in enumerate(terms.as_py().split(" ")):
                    if term in shared.value:
                        found[term] += int(sizes[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    sums = index.shards.select("terms", "ranges").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in sums.collect()}  # terms of one block of queries


def weight(documents: int, holding: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * holding + 1)))


def best(score: np.ndarray, doc_id: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores above 0, by falling score and rising doc_id, ties at the edge by doc_id."""
    found = np.flatnonzero(score > 0)
    if len(found) > top:
        edge = np.partition(score[found], len(found) - top)[len(found) - top]
        found = found[score[found] >= edge]
    return found[np.lexsort((doc_id[found], -score[found]))][:top]


LAST = np.iinfo(np.int64).max


def search(index: Index, queries: DataFrame, top: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each query."""
    spark = index.shards.sparkSession
    out = None
    for at, block in enumerate(blocks(queries)):
        terms = [counted(text) for _, text in block]
        known = holders(index, {t for c in terms for t in c})
        weighed = [{t: n * weight(index.totals.documents, known[t]) for t, n in c.items() if t in known} for c in terms]
        shared = spark.sparkContext.broadcast(weighed)
        found = merged(index.shards.mapInArrow(lambda batches, shared=shared: answers(batches, shared.value, top), "query int, doc_id long, score long"), top)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "query int, item_id long")
        rows = written(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), f"found-{at}")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def answers(batches: Iterator[pa.RecordBatch], queries: list[dict[str, int]], top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of a task's shards for each query of a block."""
    ids = [np.zeros(0, np.int64)] * len(queries)
    scores = [np.zeros(0, np.int64)] * len(queries)
    wanted = set().union(*queries)
    for batch in batches:
        for row in range(batch.num_rows):
            own, terms, ranges, docs, worth = (column[row].as_py() for column in batch.columns)
            doc_id = np.array([LAST if i is None else i for i in own], np.int64)
            ranges, docs, worth = (np.frombuffer(a, "<i4") for a in (ranges, docs, worth))
            place = {t: i for i, t in enumerate(terms.split(" ")) if t in wanted}
            for i, query in enumerate(queries):
                score = np.zeros(len(doc_id), np.int64)
                for term, w in query.items():
                    if (k := place.get(term)) is not None:
                        a, b = ranges[k], ranges[k + 1]
                        score[docs[a:b]] += w * worth[a:b].astype(np.int64)  # a document once a term
                first = best(score, doc_id, top)
                both = np.concatenate([scores[i], score[first]]), np.concatenate([ids[i], doc_id[first]])
                first = best(*both, top)
                scores[i], ids[i] = both[0][first], both[1][first]
    query = np.repeat(np.arange(len(queries), dtype=np.int32), [len(a) for a in ids])
    doc = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(doc, mask=doc == LAST), pa.array(np.concatenate(scores) if ids else doc)], names=["query", "doc_id", "score"])


def merged(found: DataFrame, top: int) -> DataFrame:
    """The best of the tasks' best, first in lanes."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(LANES))
    some = found.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("query", "lane").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= top).drop("lane")
