"""Minimum-cost-flow resharding.

Documents lie in old shards and must fill new ones of given capacity.  Rows are
grouped into hash blocks of their old shard (BLOCKS of each at most); the driver gets
the size of every block, never rows.  A minimum-cost flow over old and new shards, in
which a byte that stays costs nothing and a byte that moves costs one, says how many
bytes go from each old shard to each new one; no plan moves fewer.  Blocks are dealt to
those flows, large ones first, and rows follow their block.

Affected shards, those that gain or lose a row, are then written anew: as many parts of about
PART_BYTES as a shard needs, each by a task of its own, with rows in the order of their slots.
Shards that keep all they have and get none are left as they are.

Null texts have 8 bytes and checksum 0.  Null sources or shards form an old shard like any other
(NO_SHARD, from which all rows move).  Rows of equal doc_id and text are interchangeable and share a
block.  An empty table gives no rows and no files.  Columns of the documents may have any names: they
are kept in a struct.  A very long text is one row of one block: its size is counted, and it is
moved whole.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS, ROW_BYTES, NO_SHARD = 2048, 8, -1
#: Bytes of texts in a part of a rewritten shard.
PART_BYTES = 64 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Cheapest shipment of all supply into the capacities (whose sum must be as large).

    Successive shortest paths with potentials on the graph of both sides; its size is the
    number of shards.  cost(i, j) is what one unit from i to j costs, 0 at least.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities cannot hold the supply")
    left, room = list(supply), list(capacity)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    flow: dict[tuple[int, int], int] = defaultdict(int)
    height = [0] * (n + m)
    while any(left):
        far = [float("inf")] * (n + m)
        came = [-1] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        for _, i in heap:
            far[i] = 0
        heapq.heapify(heap)
        done = [False] * (n + m)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < n:
                steps = [(n + j, price[u][j]) for j in range(m)]
            else:
                steps = [(i, -price[i][u - n]) for i in range(n) if flow.get((i, u - n), 0)]
            for v, c in steps:
                new = d + c + height[u] - height[v]
                if new < far[v]:
                    far[v], came[v] = new, u
                    heapq.heappush(heap, (new, v))
        ends = [n + j for j in range(m) if room[j] and far[n + j] < float("inf")]
        end = min(ends, key=lambda v: (far[v] + height[v], v))
        limit = max(x for x in far if x < float("inf"))
        height = [h + min(d, limit) for h, d in zip(height, far)]
        path, v = [], end
        while came[v] >= 0:
            path.append((came[v], v))
            v = came[v]
        amount = min([left[v], room[end - n], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return {k: x for k, x in flow.items() if x}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def deal(blocks: list[tuple[int, int, int]], flow: dict[tuple[int, int], int]) -> list[int]:
    """New shard of each block (old shard, bytes, rows): the largest first, each to the
    new shard to which most of its old shard's flow is still due."""
    due: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (i, j), amount in flow.items():
        due[i].append((-amount, j))
    for queue in due.values():
        heapq.heapify(queue)
    out = [0] * len(blocks)
    for k in sorted(range(len(blocks)), key=lambda k: (-blocks[k][1], k)):
        old, size, _ = blocks[k]
        wanted, j = heapq.heappop(due[old])
        out[k] = j
        heapq.heappush(due[old], (wanted + size, j))
    return out


def sized(docs: DataFrame, old: Column, *keep: Column) -> DataFrame:
    """doc_id, size, text_crc32, old shard and block of each row, and the columns to keep."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(*keep, "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.coalesce(old.cast("int"), F.lit(NO_SHARD)).alias("old_shard"))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BLOCKS)).cast("int"))


def planned(docs: DataFrame, old: Column, shards: int, capacities: list[int] | None = None) -> list[tuple[int, int, int, int, int, bool]]:
    """(old shard, block, shard, first slot, part, whether its shard changes) of every block.

    A part is a run of blocks of one shard; parts are numbered over all shards.
    """
    rows = sized(docs, old)
    sums = rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    found = sorted((r.old_shard, r.block, r.bytes, r["rows"]) for r in sums.collect())
    olds = sorted({o for o, *_ in found})
    supply = [sum(b for o, _, b, _ in found if o == i) for i in olds]
    room = capacities or even_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, room, lambda i, j: 0 if olds[i] == j else 1)
    shard = deal([(o, b, n) for o, _, b, n in found], {(olds[i], j): amount for (i, j), amount in flow.items()})
    changed = {x for (o, *_), j in zip(found, shard) if o != j for x in (o, j)}
    plan, part = [], -1
    first: dict[int, int] = defaultdict(int)
    held: dict[int, tuple[int, int]] = {}
    for (o, block, size, n), j in sorted(zip(found, shard), key=lambda x: x[1]):
        number, used = held.get(j, (-1, PART_BYTES))
        if used >= PART_BYTES:
            part += 1
            number, used = part, 0
        held[j] = number, used + size
        plan.append((o, block, j, first[j], number, j in changed))
        first[j] += n
    return plan


PLAN = "old_shard int, block int, shard int, first long, part int, changed boolean"


def slotted(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("part", "old_shard", "block").orderBy("doc_id", "size", "text_crc32")
    return rows.withColumn("slot", F.col("first") + F.row_number().over(order) - 1)


def reshard(docs: DataFrame, old: Column, shards: int, capacities: list[int] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard and moved of each row.

    ``old`` gives a row's present shard; shard j stays the same place when it is kept.
    Law ``bytes``: the shards' sizes follow the capacities (even ones by default).
    """
    table = F.broadcast(docs.sparkSession.createDataFrame(planned(docs, old, shards, capacities), PLAN))
    return told(slotted(sized(docs, old).join(table, ["old_shard", "block"])))


def told(rows: DataFrame) -> DataFrame:
    moved = (F.col("old_shard") != F.col("shard")).alias("moved")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", moved)


def rewrite(docs: DataFrame, old: Column, shards: int, folder: str, capacities: list[int] | None = None) -> DataFrame:
    """Writes the affected shards to ``folder/shard=j``; returns all rows (doc, shard, slot, old_shard).

    Rows of the shards written are those of the files, read again; ``doc`` is a document with
    its own columns.
    """
    spark = docs.sparkSession
    plan = planned(docs, old, shards, capacities)
    parts = 1 + max((part for *_, part, _ in plan), default=0)
    table = F.broadcast(spark.createDataFrame(plan, PLAN))
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = sized(docs, old, doc).join(table, ["old_shard", "block"])
    out = ["doc", "slot", "old_shard", "shard"]
    changed = slotted(rows.filter("changed").repartitionById(parts, F.col("part"))).sortWithinPartitions("shard", "slot").select(*out)
    changed.write.mode("overwrite").partitionBy("shard").parquet(folder)
    back = spark.read.schema(changed.schema).parquet(folder).select(*out)
    return back.unionByName(slotted(rows.filter("NOT changed")).select(*out))


def digest(rows: DataFrame) -> DataFrame:
    """What ``reshard`` returns, from the documents as ``rewrite`` gives them."""
    own = sized(rows.select("doc.doc_id", "doc.text", "shard", "slot", "old_shard"), F.col("old_shard"), F.col("shard"), F.col("slot"))
    return told(own)
