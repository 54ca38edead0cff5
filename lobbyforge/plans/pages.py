"""The tier list and the page of a group: families, representatives, identity, every panel's counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring
from ..operators import family, itemization, rollup
from ..operators.family import KEY
from . import stages
from .core import CUTS, DYNAMIC, STATIC, joined, r6
from .items import COPIES, FRAME, emblems_of
from .stages import SCORE, SEM, sql

ALL = sql()
K = "gkey, patch_id, region, rank_bucket"
SUMS = "sum(n)::BIGINT AS n, sum(placement_sum)::BIGINT AS placement_sum, sum(placement_sumsq)::BIGINT AS placement_sumsq, sum(top4_count)::BIGINT AS top4_count, sum(win_count)::BIGINT AS win_count"

#: Carries that a label names: by the rule of the test tables' groups two units for each family.
NAMED = "CASE WHEN k.gkey LIKE 'm:fam%' THEN ['U' || (substr(k.gkey, 6)::INT % 8), 'U' || ((substr(k.gkey, 6)::INT + 3) % 8)] ELSE []::VARCHAR[] END"

#: Members with what a group's label names, variants of emblem sets, members of the shown variant, who stands for a group.
FAMILIES = f""", cm AS (SELECT DISTINCT ('0x' || substr(md5(signature), 1, 15))::BIGINT AS comp_id, three_stars, worn FROM signed),
cheap AS (SELECT list(character_id) AS ids FROM d_units WHERE cost BETWEEN 1 AND 3),
mem0 AS (SELECT k.*, cm.three_stars, cm.worn AS emblem, {NAMED} AS named FROM keyed k JOIN cm USING (comp_id)),
mem AS (SELECT m.*, len(list_filter(list_distinct(string_split(three_stars, '|')), lambda x: list_contains(named, x) AND list_contains(ids, x))) AS stars FROM mem0 m, cheap),
vs0 AS (SELECT {K}, emblem, {SUMS} FROM mem GROUP BY ALL),
vw AS (SELECT *, {SEM} AS sem, sum(n) OVER (PARTITION BY {K}) AS family_n, row_number() OVER (PARTITION BY {K} ORDER BY (emblem = '') DESC, n DESC, emblem) AS base_k FROM vs0),
vb AS (SELECT {K}, emblem AS base, placement_sum / n AS base_avg, sem AS base_sem FROM vw WHERE base_k = 1),
vk AS (SELECT *, CASE WHEN emblem <> '' AND emblem <> base AND base_avg - placement_sum / n >= 0.15 AND sem * sem + base_sem * base_sem > 0 AND base_avg - placement_sum / n >= 1.5 * sqrt(sem * sem + base_sem * base_sem)
    AND n >= greatest(3, ceil(0.05 * family_n)) THEN emblem ELSE base END AS variant FROM vw JOIN vb USING ({K})),
vf AS (SELECT {K}, variant, base, family_n, {SUMS}, max(n) FILTER (WHERE emblem = variant) AS own_n FROM vk GROUP BY {K}, variant, base, family_n),
fam AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score DESC, variant <> base, variant) = 1 AS shown, count(*) OVER (PARTITION BY {K}) AS variants FROM (SELECT *, {SCORE} AS score FROM vf)),
sel AS (SELECT m.*, f.variant, f.variant <> '' OR m.emblem = '' AS builds, m.emblem = f.variant AS own FROM mem m JOIN vk USING ({K}, emblem) JOIN fam f ON f.gkey = m.gkey AND f.patch_id = m.patch_id AND f.region = m.region AND f.rank_bucket = m.rank_bucket AND f.variant = vk.variant WHERE f.shown),
manual AS (SELECT comp_id, patch_id, region, rank_bucket, substr('SABCD', (comp_id % 5)::INT + 1, 1) AS tier FROM stats WHERE comp_id % 97 = 0)"""


def representatives_sql(source: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY n < greatest(5, ceil(0.05 * all_n)), CASE WHEN hit_share >= 0.35 THEN stars ELSE 0 END DESC, n DESC, comp_id) AS rep_k,
    CASE WHEN len(named) > 0 THEN named ELSE list_filter(list_distinct(string_split(three_stars, '|')), lambda x: x <> '') END AS carries
    FROM (SELECT *, sum(n) OVER (PARTITION BY {K}) AS all_n, sum(CASE WHEN stars > 0 THEN n ELSE 0 END) OVER (PARTITION BY {K}) / sum(n) OVER (PARTITION BY {K}) AS hit_share FROM {source})) WHERE rep_k = 1"""


def pins_sql(source: str) -> str:
    return f"SELECT {K}, arg_max(tier, (m.n, -m.comp_id)) AS pinned FROM {source} m JOIN manual USING (comp_id, patch_id, region, rank_bucket) GROUP BY ALL"


def named(b):
    """The carries that a group's label names."""
    if b.merged:
        from .merging import parsed

        return F.filter(F.split(parsed(F.substring("gkey", 3, 10_000))["carries"], r"\|"), lambda u: F.col("gkey").startswith("m:") & (u != ""))
    number = F.substring("gkey", 6, 10).try_cast("int")  # by rule two units for each of twenty families
    return F.when(F.col("gkey").startswith("m:fam"), F.array(*(F.concat(F.lit("U"), (number + k) % 8) for k in (0, 3)))).otherwise(F.array().cast("array<string>"))


def kept(b, name, rows):
    """A table of the read models, stored once for the rule's groups and once for the merge's."""
    return b.once(name + "_merged" * b.merged, lambda: rows) if b.stored else rows


def members(b):
    """Comps of each bucket with statistics, group, emblem set, three-star units, and the label's carries."""
    worn = joined(F.transform("emblems", lambda e: F.concat(F.lit("emb:"), e))).alias("emblem")
    comps = stages.comps(b).select("comp_id", joined("three_stars").alias("state"), F.array_distinct("three_stars").alias("threes"), worn)
    cheap = b.d_units.filter(F.col("cost").between(1, b.config.reroll_max_cost)).agg(F.collect_set("character_id").alias("_cheap"))
    rows = stages.keyed(b).join(comps, "comp_id").withColumn("named", named(b)).crossJoin(F.broadcast(cheap))  # one row of unit ids
    rows = rows.withColumn("named_cheap", F.array_intersect("named", "_cheap")).drop("_cheap")
    return kept(b, "members", rows)


def shown_members(b):
    """(members of the shown variant of each group, all variants)."""
    rows = members(b)
    found = kept(b, "variants", family.variants(rows, b.config))
    shown = found.filter("shown").select(*KEY, "emblem", "variant")
    return rows.join(shown, [*KEY, "emblem"]).withColumns({"builds": (F.col("variant") != "") | (F.col("emblem") == ""), "own": F.col("emblem") == F.col("variant")}), found


def manual(b):
    """Tiers set by hand."""
    tier = F.substring(F.lit("SABCD"), (F.col("comp_id") % 5 + 1).cast("int"), F.lit(1))
    return stages.stats(b).filter("comp_id % 97 = 0").select("comp_id", *rollup.BUCKET, tier.alias("tier"))


@query("rm_family", FAMILIES + f"SELECT {K}, variant, n, family_n::BIGINT AS family_n, round(score, 6) AS score, shown, variants FROM fam", ctes=ALL, stored=True, merged=True)
def rm_family(b):
    """Variants that each group shows after folding, and which of them stands for it."""
    found = shown_members(b)[1].filter("emblem = variant")
    return found.select(*KEY, "variant", "n", "family_n", r6("score").alias("score"), "shown", "variants")


@query("rm_archetype_row", FAMILIES + f""", rep AS ({representatives_sql('mem')}), pin AS ({pins_sql('mem')})
    SELECT {K}, a.n, rep.comp_id AS representative, round(rep.hit_share, 6) AS hit_share, round(score, 6) AS score, coalesce(pinned, {STATIC}) AS tier, pinned IS NOT NULL AS is_manual, round(a.n / total_boards, 6) AS play_rate
    FROM scored a JOIN rep USING ({K}) LEFT JOIN pin USING ({K}) JOIN totals USING (patch_id, region, rank_bucket)""", ctes=ALL, stored=True, merged=True)
def rm_archetype_row(b):
    """Every group of a bucket: pooled measures, the comp that stands for it, a tier set by hand before the computed one."""
    rows = members(b)
    pooled = rollup.pool(rows, *KEY).withColumn("score", scoring.shrunk_score(b.config))
    out = pooled.join(family.representatives(rows, KEY, b.config), list(KEY)).join(family.pins(rows, manual(b), KEY), list(KEY), "left").join(stages.totals(b), list(rollup.BUCKET))
    tier = F.coalesce("pinned", scoring.static_tier(F.col("score"), b.config)).alias("tier")
    return out.select(*KEY, "n", "representative", r6("hit_share").alias("hit_share"), r6("score").alias("score"), tier, F.col("pinned").isNotNull().alias("is_manual"), r6(F.col("n") / F.col("total_boards")).alias("play_rate"))


TIER_LIST = FAMILIES + CUTS + f""", rep AS ({representatives_sql('(SELECT * FROM sel WHERE own)')}), pin AS ({pins_sql('(SELECT * FROM sel WHERE own)')}),
placed AS (SELECT {K}, n AS pooled_n, CASE WHEN n >= 3 THEN 'main' ELSE 'niche' END AS part, row_number() OVER (PARTITION BY patch_id, region, rank_bucket, n >= 3 ORDER BY n DESC, gkey) AS size_k FROM arch),
listed AS (SELECT f.*, p.part, rep.comp_id AS representative, rep.carries, pinned, total_boards, coalesce(pinned, {DYNAMIC}) AS tier FROM fam f JOIN placed p USING ({K}) JOIN rep USING ({K}) LEFT JOIN pin USING ({K})
    LEFT JOIN cuts USING (patch_id, region, rank_bucket) JOIN totals USING (patch_id, region, rank_bucket) WHERE f.shown AND (p.part = 'main' OR p.size_k <= 100))"""


@query("rm_tier_list", TIER_LIST + f"""SELECT {K}, part, tier, n, round(score, 6) AS score, round(placement_sum / n, 6) AS avg_placement, round(top4_count / n, 6) AS top4_rate, round(family_n / total_boards, 6) AS play_rate,
    variant, variants, representative, pinned IS NOT NULL AS is_manual, row_number() OVER (PARTITION BY patch_id, region, rank_bucket, part, CASE WHEN part = 'main' THEN tier END ORDER BY score DESC, gkey) AS position FROM listed""", ctes=ALL, stored=True, merged=True)
def rm_tier_list(b):
    """Groups over the floor by tier, and the largest under it: each as its shown variant."""
    return tier_rows(b).select(
        *KEY, "part", "tier", "n", r6("score").alias("score"), r6(F.col("placement_sum") / F.col("n")).alias("avg_placement"), r6(F.col("top4_count") / F.col("n")).alias("top4_rate"),
        r6(F.col("family_n") / F.col("total_boards")).alias("play_rate"), "variant", "variants", "representative", F.col("pinned").isNotNull().alias("is_manual"), F.col("_rank").alias("position"))


def tier_rows(b):
    c, bucket = b.config, list(rollup.BUCKET)
    chosen, found = shown_members(b)
    groups = rollup.pool(members(b), *KEY).withColumn("score", scoring.shrunk_score(c))
    main = F.col("n") >= c.tier_min_sample
    cut = scoring.cutoffs(groups.filter(main), bucket, c)
    niche = groups.filter(~main).withColumn("_k", F.row_number().over(Window.partitionBy(*bucket).orderBy(F.desc("n"), "gkey"))).filter(F.col("_k") <= c.niche_limit)
    parts = groups.filter(main).select(*KEY, F.lit("main").alias("part")).unionByName(niche.select(*KEY, F.lit("niche").alias("part")))
    own = chosen.filter("own")
    rows = found.filter("shown AND emblem = variant").drop("emblem").join(parts, list(KEY)).join(family.representatives(own, KEY, c), list(KEY)).join(family.pins(own, manual(b), KEY), list(KEY), "left")
    rows = rows.join(cut, bucket, "left").join(stages.totals(b), bucket)
    rows = rows.withColumn("tier", F.coalesce("pinned", scoring.dynamic_tier(F.col("score"), c)))
    return scoring.ranked(rows.withColumn("_list", F.when(F.col("part") == "main", F.col("tier")).otherwise("")), [*bucket, "part", "_list"], "gkey")


TRAITS = FRAME + """, gb AS (SELECT c.board_id, k.gkey FROM clustered c JOIN (SELECT DISTINCT comp_id, gkey FROM keyed) k USING (comp_id)), gn AS (SELECT gkey, count(*) AS total FROM gb GROUP BY 1),
tc AS (SELECT gkey, trait_id, num_units, level, count(*) AS boards FROM frame JOIN gb USING (board_id) GROUP BY ALL),
steps AS (SELECT trait_id, count(*) = 1 AS is_unique FROM d_breakpoints GROUP BY 1),
tm AS (SELECT *, sum(boards) OVER (PARTITION BY gkey, trait_id) AS appears, row_number() OVER (PARTITION BY gkey, trait_id ORDER BY boards DESC, num_units) AS r FROM tc),
tk AS (SELECT gkey, trait_id, num_units, level AS style, appears / total AS freq, row_number() OVER (PARTITION BY gkey ORDER BY is_unique, level DESC, num_units DESC, appears / total DESC, trait_id) AS place FROM tm JOIN gn USING (gkey) JOIN steps USING (trait_id) WHERE r = 1 AND appears / total >= 0.5)"""


def group_traits(b):
    """(gkey, trait_id, num_units, style, freq, place): traits that half of a group's boards have at their usual count, in the order of the badge."""
    boards = stages.grouped(b, stages.clustered(b).filter("comp_id IS NOT NULL").select("board_id", "comp_id")).select("board_id", "gkey")
    total = boards.groupBy("gkey").agg(F.count(F.lit(1)).alias("total"))
    frame = itemization.trait_frame(b.units, b.d_unit_traits, emblems_of(b), b.d_breakpoints, b.parts())
    counts = frame.join(boards, "board_id").groupBy("gkey", "trait_id", "num_units", "level").agg(F.count(F.lit(1)).alias("boards"))
    usual = counts.groupBy("gkey", "trait_id").agg(F.sum("boards").alias("appears"), F.max_by(F.struct("num_units", "level"), F.struct("boards", (-F.col("num_units")).alias("k"))).alias("m"))
    single = F.broadcast(b.d_breakpoints.groupBy("trait_id").agg((F.count(F.lit(1)) == 1).alias("is_unique")))
    rows = usual.join(total, "gkey").join(single, "trait_id").select("gkey", "trait_id", F.col("m.num_units").alias("num_units"), F.col("m.level").alias("style"), "is_unique", (F.col("appears") / F.col("total")).alias("freq")).filter(F.col("freq") >= b.config.example_item_freq)
    order = Window.partitionBy("gkey").orderBy("is_unique", F.desc("style"), F.desc("num_units"), F.desc("freq"), "trait_id")
    return rows.withColumn("place", F.row_number().over(order))


@query("rm_key_traits", TRAITS + "SELECT gkey, trait_id, num_units, style::INT AS style, round(freq, 6) AS freq, place FROM tk WHERE place <= 2", ctes=ALL, stored=True, merged=True)
def rm_key_traits(b):
    """The two traits of a group's badge: shared ones before those of one unit, then by style, units, share."""
    return group_traits(b).filter("place <= 2").select("gkey", "trait_id", "num_units", "style", r6("freq").alias("freq"), F.col("place").cast("long").alias("place"))


@query("rm_identity", FAMILIES + TRAITS + f""", rep AS ({representatives_sql('(SELECT * FROM sel WHERE own)')}),
    cc AS (SELECT {K}, string_agg(c.u, ' ' ORDER BY CASE WHEN c.listed THEN -d.cost END, c.u) AS carries FROM (SELECT {K}, len(named) > 0 AS listed, unnest(carries) AS u FROM rep) c JOIN d_units d ON d.character_id = c.u GROUP BY ALL)
    SELECT {K}, rep.comp_id AS representative, coalesce(cc.carries, '') AS carries, coalesce(concat_ws(' ', tk.trait_id, nullif(cc.carries, '')), '') AS display_name FROM rep LEFT JOIN cc USING ({K}) LEFT JOIN (SELECT * FROM tk WHERE place = 1) tk USING (gkey)""", ctes=ALL, stored=True, merged=True)
def rm_identity(b):
    """Carries by falling cost where the label names them, else the representative's three-star units; name from trait and carries."""
    chosen, _ = shown_members(b)
    heads = family.representatives(chosen.filter("own").withColumn("listed", F.size("named") > 0), KEY, b.config)
    listed = chosen.select(*KEY, (F.size("named") > 0).alias("listed")).distinct()
    units = heads.join(listed, list(KEY)).select(*KEY, "listed", F.explode("carries").alias("u")).join(F.broadcast(b.d_units.select(F.col("character_id").alias("u"), "cost")), "u")
    order = F.struct(F.when(F.col("listed"), -F.col("cost")).alias("a"), "u")
    named_units = units.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["u"]), " ").alias("carries"))
    top = group_traits(b).filter("place = 1").select("gkey", "trait_id")
    return heads.drop("carries").join(named_units, list(KEY), "left").join(top, "gkey", "left").select(*KEY, "representative", F.coalesce("carries", F.lit("")).alias("carries"), F.concat_ws(" ", "trait_id", "carries").alias("display_name"))


def _page_sql() -> str:
    rates = "avg(placement) AS avg_placement, count(*) FILTER (WHERE placement <= 4) / count(*) AS top4_rate, count(*) FILTER (WHERE placement = 1) / count(*) AS win_rate"
    none = "NULL::VARCHAR AS detail, NULL::INT AS position"
    cols = f"{K}, part, item, boards, round(share, 6) AS share, round(avg_placement, 6) AS avg_placement, round(top4_rate, 6) AS top4_rate, round(win_rate, 6) AS win_rate, detail, position"
    counted = lambda part, item, source="mb", more="": f"SELECT {K}, '{part}' AS part, {item} AS item, count(*)::BIGINT AS boards, {rates}{more} FROM {source} GROUP BY ALL"
    filled = lambda part, items, item: f"""SELECT {K}, '{part}' AS part, i.item, coalesce(boards, 0) AS boards, coalesce(boards, 0) / total AS share, coalesce(avg_placement, 0) AS avg_placement, coalesce(top4_rate, 0) AS top4_rate, coalesce(win_rate, 0) AS win_rate, {none}
        FROM tot CROSS JOIN (SELECT unnest({items}) AS item) i LEFT JOIN ({counted(part, item)}) x USING ({K}, item)"""  # noqa: E731
    return FAMILIES + CUTS + COPIES + f""", rep AS ({representatives_sql('(SELECT * FROM sel WHERE own)')}), pin AS ({pins_sql('(SELECT * FROM sel WHERE own)')}),
mb AS (SELECT s.gkey, c.patch_id, c.region, c.rank_bucket, c.board_id, c.comp_id, c.placement, c.level, strftime(c.game_datetime, '%Y-%m-%d') AS day, s.three_stars, s.builds FROM clustered c JOIN sel s USING (comp_id, patch_id, region, rank_bucket)),
tot AS (SELECT {K}, count(*) AS total, avg(placement) AS mean FROM mb GROUP BY ALL),
days AS (SELECT patch_id, region, rank_bucket, strftime(game_datetime, '%Y-%m-%d') AS day, count(*) AS in_bucket FROM clustered GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, three_stars) AS r FROM (SELECT {K}, three_stars, count(*) AS n FROM mb GROUP BY ALL)),
bd AS (SELECT mb.*, b.character_id, b.done FROM mb JOIN best b USING (board_id) JOIN rep USING ({K}) WHERE mb.builds AND b.n_done >= 3 AND list_contains(rep.carries, b.character_id)),
bs AS (SELECT *, sum(boards) OVER (PARTITION BY {K}, item) AS itemized FROM ({counted('build', 'character_id', 'bd', ', done AS detail')})),
us AS (SELECT mb.*, u.character_id, least(coalesce(u.star, 1), 3) AS star FROM mb JOIN (SELECT board_id, character_id, max(star_tier) AS star FROM b_units GROUP BY ALL) u USING (board_id)),
un AS (SELECT x.*, boards / total AS freq, total, d.cost, list_contains(rep.carries, item) OR boards / total >= 0.75 AS core, (SELECT m.star FROM (SELECT star, count(*) AS k FROM us y WHERE y.gkey = x.gkey AND y.patch_id = x.patch_id AND y.region = x.region AND y.rank_bucket = x.rank_bucket AND y.character_id = x.item GROUP BY 1) m ORDER BY m.k DESC, m.star LIMIT 1) AS modal
    FROM ({counted('unit', 'character_id', 'us')}) x JOIN tot USING ({K}) JOIN rep USING ({K}) JOIN d_units d ON d.character_id = x.item WHERE boards >= least(10, greatest(1, ceil(total / 2))) AND d.cost <= 5),
up AS (SELECT *, count(*) FILTER (WHERE core) OVER (PARTITION BY {K}) AS cores, row_number() OVER (PARTITION BY {K}, core ORDER BY cost DESC, freq DESC, item) AS by_cost, row_number() OVER (PARTITION BY {K}, core ORDER BY freq DESC, item) AS by_freq FROM un)
SELECT {cols} FROM (
SELECT {K}, 'head' AS part, variant AS item, f.n AS boards, own_n / total_boards AS share, placement_sum / f.n AS avg_placement, top4_count / f.n AS top4_rate, win_count / f.n AS win_rate, coalesce(pinned, {DYNAMIC}) AS detail, variants::INT AS position
    FROM fam f LEFT JOIN pin USING ({K}) LEFT JOIN cuts USING (patch_id, region, rank_bucket) JOIN totals USING (patch_id, region, rank_bucket) WHERE shown
UNION ALL SELECT {K}, 'variant', variant, n, n / family_n, placement_sum / n, top4_count / n, win_count / n, CASE WHEN shown THEN 'shown' ELSE 'other' END, NULL FROM fam
UNION ALL {filled('level', "['7-', '8', '9+']", "CASE WHEN level >= 9 THEN '9+' WHEN level = 8 THEN '8' ELSE '7-' END")}
UNION ALL {filled('place', "['1', '2', '3', '4', '5', '6', '7', '8']", "placement::VARCHAR")}
UNION ALL SELECT {K}, part, item, boards, boards / in_bucket, avg_placement, top4_rate, win_rate, {none} FROM ({counted('day', 'day')}) JOIN (SELECT patch_id, region, rank_bucket, day AS item, in_bucket FROM days) USING (patch_id, region, rank_bucket, item)
UNION ALL SELECT {K}, part, item, boards, boards / total, avg_placement, top4_rate, win_rate, NULL, r::INT FROM (SELECT m.gkey, m.patch_id, m.region, m.rank_bucket, 'state' AS part, CASE WHEN r <= 8 THEN m.three_stars ELSE '__other__' END AS item, least(r, 9) AS r, count(*)::BIGINT AS boards, {rates} FROM mb m JOIN st USING ({K}, three_stars) GROUP BY ALL) JOIN tot USING ({K})
UNION ALL SELECT {K}, 'hits_first', '', count(*) FILTER (WHERE three_stars <> '')::BIGINT, count(*) FILTER (WHERE three_stars <> '') / count(*), NULL, NULL, NULL, (count(*) FILTER (WHERE three_stars <> '') / count(*) >= 0.35)::VARCHAR, NULL FROM mb GROUP BY ALL
UNION ALL SELECT {K}, part, item, boards, boards / total, avg_placement, top4_rate, win_rate, NULL, r::INT FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY boards DESC, item::BIGINT) AS r FROM ({counted('board', 'comp_id::VARCHAR')})) JOIN tot USING ({K}) WHERE r <= 3
UNION ALL SELECT {K}, part, item, boards, boards / itemized, avg_placement, top4_rate, win_rate, detail, r::INT FROM (SELECT *, row_number() OVER (PARTITION BY {K}, item ORDER BY boards DESC, detail) AS r FROM bs WHERE boards >= 5) WHERE r <= 3
UNION ALL SELECT {K}, part, item, boards, freq, avg_placement, top4_rate, win_rate, modal::VARCHAR, NULL FROM un
UNION ALL SELECT {K}, part, item, boards, boards / total, avg_placement, top4_rate, win_rate, {none} FROM ({counted('star', "character_id || '*' || star", 'us')}) JOIN tot USING ({K}) WHERE boards >= least(10, greatest(1, ceil(total / 2)))
UNION ALL SELECT {K}, 'core', item, boards, freq, avg_placement, top4_rate, win_rate, NULL, by_cost::INT FROM up WHERE core
UNION ALL SELECT {K}, 'flex', item, boards, freq, avg_placement, top4_rate, win_rate, NULL, by_freq::INT FROM up WHERE NOT core AND freq >= 0.25 AND by_freq <= greatest(0, least(8, 10 - cores)))"""


def page_counts(b):
    """All counts of all groups' pages, in one pass over boards, units and items."""
    chosen, _ = shown_members(b)
    heads = family.representatives(chosen.filter("own"), KEY, b.config)
    rows = chosen.join(heads, list(KEY)).select("comp_id", *KEY, "state", "builds", "carries")
    boards = stages.clustered(b).select("board_id", "comp_id", *rollup.BUCKET, "placement", "level", "game_datetime")
    return family.detail_counts(boards, itemization.held_copies(b.held), rows, b.config)


@query("rm_detail", _page_sql(), ctes=ALL, stored=True, merged=True)
def rm_detail(b):
    """The page of every group in every bucket, a row a line.

    ``head`` and ``variant``: measures, tier and emblem variants; ``core``, ``flex``, ``unit``, ``star``: units; ``level``,
    ``place``, ``day``: distributions; ``state``, ``hits_first``: three-star states; ``build``: item sets of carries; ``board``: comps most played.
    """
    c, bucket = b.config, list(rollup.BUCKET)
    chosen, found = shown_members(b)
    own = chosen.filter("own")
    heads = family.representatives(own, KEY, c)
    counts = b.once("page_counts" + "_merged" * b.merged, lambda: page_counts(b))  # lazily: only if it is not there
    lines = family.page(counts, heads.select(*KEY, "carries"), b.d_units, c)
    groups = rollup.pool(members(b), *KEY).withColumn("score", scoring.shrunk_score(c)).filter(F.col("n") >= c.tier_min_sample)
    variants = found.filter("emblem = variant")
    head = variants.filter("shown").join(family.pins(own, manual(b), KEY), list(KEY), "left").join(scoring.cutoffs(groups, bucket, c), bucket, "left").join(stages.totals(b), bucket)
    rate = lambda x: F.col(x) / F.col("n")
    measures = [rate("placement_sum").alias("avg_placement"), rate("top4_count").alias("top4_rate"), rate("win_count").alias("win_rate")]
    head = head.select(*KEY, F.lit("head").alias("part"), F.col("variant").alias("item"), F.col("n").alias("boards"), (F.col("own_n") / F.col("total_boards")).alias("share"), *measures, F.coalesce("pinned", scoring.dynamic_tier(F.col("score"), c)).alias("detail"), F.col("variants").cast("int").alias("position"))
    each = variants.select(*KEY, F.lit("variant").alias("part"), F.col("variant").alias("item"), F.col("n").alias("boards"), (F.col("n") / F.col("family_n")).alias("share"), *measures, F.when(F.col("shown"), "shown").otherwise("other").alias("detail"), F.lit(None).cast("int").alias("position"))
    return lines.unionByName(head).unionByName(each).select(*KEY, "part", "item", "boards", *(r6(x).alias(x) for x in ("share", "avg_placement", "top4_rate", "win_rate")), "detail", "position")
