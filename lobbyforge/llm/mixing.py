"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A tree of domains, languages and sources gets a token budget at its root.  Each node
shares its budget among its children by weight; a child that cannot use its share
passes the rest to its siblings, and only what all of them cannot use goes to the
node's own siblings.  (Shares are filled from the top with whole subtrees' supplies as
limits, which comes to the same.)  A leaf's supply is its tokens times ``max_epochs``.

A leaf is read in epochs, each in its own seeded order.  Whole epochs are taken as long
as the budget lasts; of the last one, the longest prefix that does not exceed the rest.
The prefix is found by buckets of the order: tokens are summed by bucket, then within the bucket
in which the budget ends, and so on, each step 256 times finer.  Every row before the last of these is
taken where it is, and only its few rows are moved and summed one by one.  So texts stay in
place and a source with a third of all rows is no task of its own.  What is decided for each leaf is broadcast if there are at most
BROADCAST_LEAVES of them; for more, rows and decisions are joined by leaf and salt.

All amounts are whole tokens; shares are rounded down.  Null keys are nodes of their own
(``none``), null texts have one token.  Repeated rows are documents of their own; equal or null
doc_ids stand together in an epoch.  An empty table gives none.  Input columns may have any
names (they travel as one struct).  A very long text counts as many tokens and is moved whole,
if at all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

LEVELS = ("_domain", "_lang", "_source")


@dataclass(frozen=True)
class Mix:
    """Target weights of domains and languages (others: 1); sources weigh alike."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    percent: int = 60
    max_epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    """A domain for each source, by its last character."""
    return F.coalesce(F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 4).cast("string")), F.lit("none"))


def token_estimate() -> Column:
    """A token for every four bytes of ``text`` begun, one at least."""
    return F.expr("greatest(1, (octet_length(coalesce(text, '')) + 3) div 4)")


def weight_of(key: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(key == name, weight).otherwise(out)
    return out.cast("long")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to nodes (parent keys, key, weight, supply, given): given is the parent's.

    Children fill up in order of supply by weight.  One is full if, were all that are not
    full yet to fill at its level, the parent's budget would still do.
    """
    own = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = own.orderBy((F.col("supply") / F.col("weight")), *[c for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stepped = nodes.withColumns({"_used": F.coalesce(F.sum("supply").over(before), F.lit(0)), "_rest": F.sum("weight").over(onward)})
    full = F.col("supply") * F.col("_rest") <= (F.col("given") - F.col("_used")) * F.col("weight")
    marked = stepped.withColumn("_full", full)
    spent = F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(own), F.lit(0))
    open_weight = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(own), F.lit(1))
    part = F.expr("(given - _spent) * weight div _open")
    return marked.withColumns({"_spent": spent, "_open": open_weight}).withColumn("budget", F.when(F.col("_full"), F.col("supply")).otherwise(part)).drop("_used", "_rest", "_full", "_spent", "_open")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Budget of each leaf (LEVELS, tokens), filled from the root down."""
    leaves = leaves.withColumn("supply", F.col("tokens") * mix.max_epochs)
    above = None
    weights = (lambda: weight_of(F.col("_domain"), mix.domains), lambda: weight_of(F.col("_lang"), mix.languages), lambda: F.lit(1).cast("long"))
    for depth, weight in enumerate(weights):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens")).withColumn("weight", weight())
        if depth:
            nodes = nodes.join(above, keys[:-1])
        else:  # one row a domain: the root's budget is a share of all tokens
            total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("_total", total).withColumn("given", F.expr(f"_total * {mix.percent} div 100")).drop("_total")
        above = share(nodes, keys[:-1]).select(*keys, F.col("budget").alias("given"), "tokens", "supply")
        if depth < 2:
            above = above.drop("tokens", "supply")
    return above.withColumnRenamed("given", "budget")


def mix_documents(docs: DataFrame, mix: Mix = Mix(), domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Each taken document as ``_doc``, then _domain, _lang, _source, _tokens, _epoch, _order.

    _order is the hash by which the document stands in its epoch.
    """
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"),
        F.col("doc_id").alias("_id"),
        (domain if domain is not None else domain_of(F.col("source"))).alias("_domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("none")).alias("_source"),
        (tokens if tokens is not None else token_estimate()).alias("_tokens"),
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"))
    budgets = written(leaf_budgets(leaves, mix).select(*LEVELS, F.expr("budget div tokens").alias("_whole"), F.expr("budget % tokens").alias("_part")), "budgets")
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_epoch").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("none"))).cast("binary"))
    decided = budgets.withColumns({"_cut": F.lit(""), "_start": F.lit(0).cast("long")})
    for digits in CUTS:
        # sums of the buckets into which the bucket found so far is cut: no more a leaf than a step has
        inside = by_leaf(rows, decided.filter("_part > 0")).withColumn("_epoch", F.col("_whole")).withColumn("_order", order).filter(F.col("_order").startswith(F.col("_cut")))
        sums = inside.groupBy(*LEVELS, "_part", "_start", F.substring("_order", 1, digits).alias("_bucket")).agg(F.sum("_tokens").alias("_sum"))
        before = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        begin = F.col("_start") + F.coalesce(F.sum("_sum").over(before), F.lit(0))
        ends = sums.withColumn("_begin", begin).filter("_begin <= _part AND _begin + _sum > _part").select(*LEVELS, F.col("_bucket").alias("_cut"), F.col("_begin").alias("_start"))
        spent, decided = decided, written(budgets.join(ends, list(LEVELS), "left"), "decided")
        if hasattr(spent, "written_to"):
            discard(spent)
    discard(budgets)
    bucket = F.substring("_order", 1, CUTS[-1])

    epochs = F.explode(F.sequence(F.lit(0), F.lit(mix.max_epochs - 1))).alias("_epoch")
    offered = by_leaf(rows, decided).select("*", epochs).filter("_epoch < _whole OR (_epoch = _whole AND _part > 0)").withColumn("_order", order)
    out = ["_doc", *LEVELS, "_tokens", "_epoch", "_order"]
    last = (F.col("_epoch") == F.col("_whole")) & (bucket == F.col("_cut"))
    taken = offered.filter((F.col("_epoch") < F.col("_whole")) | (bucket < F.col("_cut"))).select(*out)
    inside = Window.partitionBy(*LEVELS, "_epoch").orderBy("_order", "_id", "_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = offered.filter(last).withColumn("_end", F.col("_start") + F.sum("_tokens").over(inside)).filter("_end <= _part")
    return taken.unionByName(rest.select(*out))


#: Hex digits of the hash by which the place where a budget ends is narrowed, step by step: 256 buckets each.
CUTS = (2, 4, 6)
#: Leaves whose decisions are broadcast (some 100 bytes each); ways that a leaf's rows are dealt beyond.
BROADCAST_LEAVES, SALTS = 100_000, 64


def by_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows joined with what was decided for their leaf."""
    if leaves.count() <= BROADCAST_LEAVES:
        return rows.join(F.broadcast(leaves), list(LEVELS))
    salted = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_tokens"), F.lit(SALTS)).cast("int")).join(salted, [*LEVELS, "_salt"]).drop("_salt")


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents taken, with their own columns; one row for each time a document is taken."""
    return mix_documents(docs, mix).select("_doc.*")
