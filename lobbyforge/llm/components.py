"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task joins in memory.
PART_EDGES = 500_000


def forests(edges: DataFrame, parts: int) -> DataFrame:
    """(a, b): in each of so many parts of the edges, every node with the least it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            top = x
            while (up := above.get(top, top)) != top:
                top = up
            while (up := above.get(x, x)) != top:
                above[x], x = top, up
            return top

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for z in (x, y):
                    above.setdefault(z, z)
                x, y = root(x), root(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], names=["a", "b"])

    return written(edges.select("a", "b").repartition(parts).mapInArrow(run, "a binary, b binary"), "forest")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge (a, b) of binary ids; root is the least reachable.

    Parts of at most about PART_EDGES edges are joined in memory, each to stars.  If there is
    more than one part, what follows joins the stars.  Large-star and small-star steps in turn.  Each step takes minima by aggregation and
    joins them back, so a node with very many edges is summed before the shuffle and its
    join may be split.  Every round is written to the shared folder.  The number of rounds
    grows with the logarithm of the longest path; nothing but two numbers a round reaches
    the driver.
    """
    edges = written(edges, "edges")
    parts = max(1, -(-edges.count() // PART_EDGES))
    edges = forests(edges, parts)
    if parts == 1:
        return edges.toDF("node", "root")
    high, low = F.greatest("a", "b"), F.least("a", "b")
    links = edges.filter(F.col("a") != F.col("b")).select(high.alias("u"), low.alias("v")).distinct()
    links = written(links, "links")
    seen = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = written(small.filter(F.col("u") != F.col("v")).distinct(), "links")
        state = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"no fixed point after {rounds} rounds")
