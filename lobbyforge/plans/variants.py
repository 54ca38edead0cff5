"""Queries of variants and of keys that a merge has renamed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import rollup, variants
from ..operators.variants import Family
from . import stages
from .items import comp_boards
from .merging import parsed
from .stages import sql

ALL = sql()
#: Families of the test tables' units; those of a set belong to its catalogue.
FAMILIES = (Family("U6", "^U[0-4]$", "TFT17_T3", 1), Family("U2", "^U[57]$", "TFT17_T0", 2))

OVER = """, imp AS (SELECT board_id, trait_id, count(DISTINCT character_id) AS n FROM b_units JOIN d_unit_traits USING (character_id) GROUP BY ALL),
ov AS (SELECT r.board_id, r.trait_id, (r.num_units - coalesce(i.n, 0))::BIGINT AS delta FROM b_traits r LEFT JOIN imp i USING (board_id, trait_id)),
fams(base, pattern, marker, least_delta) AS (VALUES ('U6', '^U[0-4]$', 'TFT17_T3', 1), ('U2', '^U[57]$', 'TFT17_T0', 2)),
ch AS (SELECT * FROM (SELECT f.base, f.pattern, o.*, row_number() OVER (PARTITION BY f.base, o.board_id ORDER BY delta DESC, trait_id) AS r FROM fams f JOIN ov o ON o.delta >= f.least_delta AND o.trait_id <> f.marker
    WHERE EXISTS (SELECT 1 FROM b_units u WHERE u.board_id = o.board_id AND u.character_id = f.base)) WHERE r = 1),
inf AS (SELECT ch.board_id, ch.base, v.character_id AS variant_id, ch.trait_id, ch.delta FROM ch JOIN d_unit_traits v ON v.trait_id = ch.trait_id AND regexp_matches(v.character_id, ch.pattern))"""
TALLY = OVER + """, ty AS (SELECT c.comp_id, inf.base, inf.variant_id, count(*)::BIGINT AS boards FROM inf JOIN clustered c USING (board_id) WHERE c.comp_id IS NOT NULL GROUP BY ALL)"""


def inferred(b):
    return variants.infer(b.units, b.d_unit_traits, b.traits, FAMILIES)


@query("join_left_implied", OVER + "SELECT board_id, trait_id, delta FROM ov")
def join_left_implied(b):
    """Reported counts less what the board's units explain."""
    return variants.over_counts(b.units, b.d_unit_traits, b.traits)


@query("win_argmax_trait", OVER + "SELECT board_id, trait_id, delta FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY delta DESC, trait_id) AS r FROM ov WHERE delta >= 1 AND trait_id <> 'TFT17_T3') WHERE r = 1")
def win_argmax_trait(b):
    return variants.chosen_traits(variants.over_counts(b.units, b.d_unit_traits, b.traits), FAMILIES[0])


@query("var_infer", OVER + "SELECT board_id, base, variant_id, trait_id, delta FROM inf")
def var_infer(b):
    """The variants that each board's over-counted trait tells."""
    return inferred(b)


@query("agg_variant_tally", TALLY + "SELECT comp_id, base, variant_id, boards FROM ty", ctes=ALL)
def agg_variant_tally(b):
    return variants.tally(comp_boards(b), inferred(b))


@query("agg_pick_variant", TALLY + """SELECT gkey, base, variant_id, boards FROM (SELECT *, row_number() OVER (PARTITION BY gkey, base ORDER BY boards DESC, variant_id) AS r
    FROM (SELECT k.gkey, ty.base, ty.variant_id, sum(ty.boards)::BIGINT AS boards FROM ty JOIN (SELECT DISTINCT comp_id, gkey FROM keyed) k USING (comp_id) GROUP BY ALL)) WHERE r = 1""", ctes=ALL)
def agg_pick_variant(b):
    return variants.pick(stages.grouped(b, variants.tally(comp_boards(b), inferred(b))), ["gkey"])


B = "patch_id, region, rank_bucket"
#: Labels as they are now: a base, a gate, and an anchor for some; and keys as they were, each asked for in every bucket.
STALE = f""", now AS (SELECT s.comp_id, {B}, n, CASE WHEN comp_id % 3 = 0 THEN 'm:fam' || (comp_id % 20) || '##gate:U' || (comp_id % 4) ELSE 'c:' || comp_id END AS gkey FROM stats s),
live AS (SELECT gkey, {B}, sum(n)::BIGINT AS n FROM now GROUP BY ALL), of_comp AS (SELECT DISTINCT comp_id, gkey FROM now), buckets AS (SELECT DISTINCT {B} FROM now),
old AS (SELECT DISTINCT unnest(['c:' || comp_id, CASE comp_id % 4 WHEN 0 THEN 'm:gone' || (comp_id % 7) || '##k:' || comp_id WHEN 1 THEN 'm:fam' || (comp_id % 20) || '##dup:U1##k:' || (comp_id + 1) WHEN 2 THEN 'm:fam' || (comp_id % 20) || '##gate:U9' ELSE 'm:lost' || (comp_id % 5) END]) AS key FROM of_comp),
base AS (SELECT {B}, split_part(substr(gkey, 3), '##', 1) AS label, arg_max(gkey, (n, gkey)) AS heaviest FROM live WHERE gkey LIKE 'm:%' GROUP BY ALL),
h0 AS (SELECT key, {B}, key AS k FROM old CROSS JOIN buckets)"""


def _hop(n: int) -> str:
    return f""", h{n + 1} AS (SELECT h.key, h.patch_id, h.region, h.rank_bucket, CASE WHEN l.gkey IS NOT NULL THEN h.k ELSE coalesce(o.gkey, b.heaviest) END AS k FROM h{n} h LEFT JOIN live l ON l.gkey = h.k AND l.patch_id = h.patch_id AND l.region = h.region AND l.rank_bucket = h.rank_bucket
LEFT JOIN of_comp o ON o.comp_id = CASE WHEN h.k LIKE 'c:%' THEN substr(h.k, 3)::BIGINT ELSE try_cast(regexp_extract(h.k, '##k:([0-9]+)', 1) AS BIGINT) END
LEFT JOIN base b ON h.k LIKE 'm:%' AND b.label = split_part(substr(h.k, 3), '##', 1) AND b.patch_id = h.patch_id AND b.region = h.region AND b.rank_bucket = h.rank_bucket)"""


def resolve(keys, live, of_comp, hops: int = 3):
    """(key, bucket..., gkey): the live group that an old key of a bucket leads to, null if none.

    A key that is live stays.  One of a comp, or with the anchor of one, goes to that comp's group now; another to the
    heaviest live group of its base.  What that gives is followed in the same way.
    """
    bucket = list(rollup.BUCKET)
    head = F.split_part(F.substring("gkey", 3, 10_000), F.lit("##"), F.lit(1))
    bases = live.filter(F.col("gkey").startswith("m:")).groupBy(*bucket, head.alias("_base")).agg(F.max_by("gkey", F.struct("n", "gkey")).alias("_heaviest"))
    there = live.select(*bucket, F.col("gkey").alias("_k"), F.lit(True).alias("_live"))
    comps = of_comp.select(F.col("comp_id").alias("_comp"), F.col("gkey").alias("_now"))
    rows = keys.withColumn("_k", F.col("key"))
    for _ in range(hops):
        label = F.substring("_k", 3, 10_000)
        comp = F.when(F.col("_k").startswith("c:"), label).otherwise(F.nullif(parsed(label)["anchor"], F.lit(""))).try_cast("long")
        base = F.when(F.col("_k").startswith("m:"), F.split_part(label, F.lit("##"), F.lit(1)))
        rows = rows.join(there, [*bucket, "_k"], "left").withColumns({"_comp": comp, "_base": base}).join(comps, "_comp", "left").join(bases, [*bucket, "_base"], "left")
        rows = rows.withColumn("_next", F.when(F.col("_live"), F.col("_k")).otherwise(F.coalesce("_now", "_heaviest"))).select("key", *bucket, F.col("_next").alias("_k"))
    return rows.join(there, [*bucket, "_k"], "left").select("key", *bucket, F.when(F.col("_live"), F.col("_k")).alias("gkey"))


@query("rm_stale_key", STALE + _hop(0) + _hop(1) + _hop(2) + f" SELECT h3.key, {B}, l.gkey FROM h3 LEFT JOIN live l ON l.gkey = h3.k AND l.patch_id = h3.patch_id AND l.region = h3.region AND l.rank_bucket = h3.rank_bucket".replace(B, "h3.patch_id, h3.region, h3.rank_bucket"), ctes=ALL, stored=True)
def rm_stale_key(b):
    """Where each key of before leads in each bucket."""
    k = F.col("comp_id")
    named = F.concat(F.lit("m:fam"), k % 20, F.lit("##gate:U"), k % 4)
    now = stages.stats(b).select("comp_id", *rollup.BUCKET, "n", F.when(k % 3 == 0, named).otherwise(F.concat(F.lit("c:"), k)).alias("gkey"))
    live = now.groupBy("gkey", *rollup.BUCKET).agg(F.sum("n").alias("n"))
    of_comp = now.select("comp_id", "gkey").distinct()
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    old = F.when(k % 4 == 0, text("m:gone", k % 7, "##k:", k)).when(k % 4 == 1, text("m:fam", k % 20, "##dup:U1##k:", k + 1)).when(k % 4 == 2, text("m:fam", k % 20, "##gate:U9")).otherwise(text("m:lost", k % 5))
    keys = of_comp.select(F.explode(F.array(text("c:", k), old)).alias("key")).distinct()
    buckets = F.broadcast(now.select(*rollup.BUCKET).distinct())  # patches times regions times ranks
    return resolve(keys.crossJoin(buckets), live, of_comp)
