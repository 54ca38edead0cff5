"""Queries of itemization, modes and windows over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import codecs
from ..operators import itemization, rollup
from . import stages
from .core import joined, r6
from .stages import sql

COPIES = """,
cp AS (SELECT u.board_id, u.unit_row, u.character_id, u.star_tier, coalesce(string_agg(i.item_id, '|' ORDER BY i.item_id) FILTER (WHERE i.item_id <> 'TFT_Item_BFSword'), '') AS done,
    count(i.item_id) FILTER (WHERE i.item_id <> 'TFT_Item_BFSword') AS n_done, count(i.item_id) AS n_items, count(*) FILTER (WHERE i.item_id IN ('TFT_Item_I0', 'TFT_Item_I1', 'TFT_Item_I2', 'TFT_Item_I3', 'TFT_Item_I4')) AS n_damage
    FROM b_units u LEFT JOIN b_items i USING (board_id, unit_row, character_id) GROUP BY ALL),
best AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY board_id, character_id ORDER BY n_done DESC, unit_row) AS r FROM cp) WHERE r = 1),
tops AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY n_done DESC, character_id) <= 2 AND n_done > 0 AS is_top FROM best)"""
RATES = COPIES + """,
tot AS (SELECT comp_id, count(*) AS total FROM clustered WHERE comp_id IS NOT NULL GROUP BY 1),
rates AS (SELECT c.comp_id, t.character_id, tot.total, count(*) FILTER (WHERE n_done >= 3) / tot.total AS full_rate, count(*) FILTER (WHERE is_top) / tot.total AS top_rate, count(*) FILTER (WHERE n_damage >= 2) / tot.total AS damage_rate
    FROM tops t JOIN clustered c USING (board_id) JOIN tot ON tot.comp_id = c.comp_id GROUP BY c.comp_id, t.character_id, tot.total)"""
ALL = sql()


def held(b):
    return itemization.held_copies(b.held)


def comp_boards(b):
    return stages.clustered(b).filter("comp_id IS NOT NULL")


def comp_rates(b):
    return itemization.rates(comp_boards(b), held(b), b.config)


@query("item_best_copy", COPIES + "SELECT board_id, character_id, unit_row, n_done, done FROM best")
def item_best_copy(b):
    return itemization.best_copy(held(b)).select("board_id", "character_id", "unit_row", "n_done", joined("done").alias("done"))


@query("item_best_copy_raw", COPIES + "SELECT board_id, character_id, unit_row FROM (SELECT *, row_number() OVER (PARTITION BY board_id, character_id ORDER BY n_items DESC, unit_row) AS r FROM cp) WHERE r = 1")
def item_best_copy_raw(b):
    return itemization.best_copy(held(b), "n_items").select("board_id", "character_id", "unit_row")


@query("win_best_copy", COPIES + "SELECT board_id, character_id, unit_row, n_items FROM (SELECT *, row_number() OVER (PARTITION BY board_id, character_id ORDER BY n_items DESC, unit_row) AS r FROM cp) WHERE r = 1")
def win_best_copy(b):
    return itemization.best_copy(held(b), "n_items").select("board_id", "character_id", "unit_row", "n_items")


@query("item_top_slots", COPIES + "SELECT board_id, character_id, is_top FROM tops")
def item_top_slots(b):
    return itemization.top_slots(itemization.best_copy(held(b)), b.config).select("board_id", "character_id", "is_top")


@query("item_damage_count", COPIES + "SELECT board_id, unit_row, n_damage >= 2 AS damage FROM cp")
def item_damage_count(b):
    return held(b).select("board_id", "unit_row", (F.col("n_damage") >= b.config.carry_damage_min_items).alias("damage"))


@query("flt_completed_items", COPIES + "SELECT board_id, unit_row, done FROM cp")
def flt_completed_items(b):
    return held(b).select("board_id", "unit_row", joined("done").alias("done"))


@query("agg_itemization", RATES + "SELECT comp_id, character_id, round(full_rate, 6) AS full_rate, round(top_rate, 6) AS top_rate, round(damage_rate, 6) AS damage_rate FROM rates", ctes=ALL)
def agg_itemization(b):
    return comp_rates(b).select("comp_id", "character_id", *(r6(c).alias(c) for c in ("full_rate", "top_rate", "damage_rate")))


@query("agg_hero_aug", RATES + """SELECT t.comp_id, h.character_id, round(coalesce(r.damage_rate, 0), 6) AS damage_rate FROM tot t CROSS JOIN (VALUES ('U0'), ('U1')) AS h(character_id)
    LEFT JOIN rates r ON r.comp_id = t.comp_id AND r.character_id = h.character_id""", ctes=ALL)
def agg_hero_aug(b):
    champions = F.explode(F.array(*map(F.lit, b.config.hero_champions))).alias("character_id")
    eligible = comp_boards(b).select("comp_id").distinct().select("comp_id", champions)
    return eligible.join(comp_rates(b), ["comp_id", "character_id"], "left").select("comp_id", "character_id", r6(F.coalesce("damage_rate", F.lit(0.0))).alias("damage_rate"))


CARRIES = RATES + """,
carry AS (SELECT * FROM (SELECT *, max(CASE WHEN full_rate >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY comp_id) AS any_full, row_number() OVER (PARTITION BY comp_id ORDER BY top_rate DESC, full_rate DESC, character_id) AS r FROM rates)
    WHERE full_rate >= 0.5 OR (any_full = 0 AND top_rate >= 0.5 AND r <= 2))"""


@query("prof_build", CARRIES + """SELECT comp_id, string_agg(character_id, '|' ORDER BY character_id) AS carries, coalesce(string_agg(character_id, '|' ORDER BY character_id) FILTER (WHERE damage_rate >= 0.25), '') AS damage_carries FROM carry GROUP BY comp_id""", ctes=ALL)
def prof_build(b):
    c = itemization.carries(comp_rates(b), b.config)
    damage = F.when(F.col("damage_rate") >= b.config.merge_damage_rate, F.col("character_id"))
    return c.groupBy("comp_id").agg(joined(F.array_sort(F.collect_list("character_id"))).alias("carries"), joined(F.array_sort(F.collect_list(damage))).alias("damage_carries"))


@query("prof_copy_sig", """, m AS (SELECT s.signature, t.character_id, count(*) AS copies FROM (SELECT signature, min(board_id) AS board_id FROM signed GROUP BY 1) s JOIN tok t USING (board_id) WHERE t.cost BETWEEN 1 AND 3 GROUP BY ALL HAVING count(*) >= 2)
    SELECT s.signature, coalesce(string_agg(m.character_id, '|' ORDER BY m.character_id), '') AS copy_sig FROM (SELECT DISTINCT signature FROM signed) s LEFT JOIN m USING (signature) GROUP BY 1""", ctes=ALL)
def prof_copy_sig(b):
    cheap = F.broadcast(b.d_units.filter(F.col("cost").between(1, 3)).select(F.col("character_id").alias("u")))
    comps = stages.signed(b).groupBy("signature").agg(F.first("core_units").alias("core_units"))
    many = comps.select("signature", F.explode("core_units").alias("u")).join(cheap, "u").groupBy("signature", "u").agg(F.count(F.lit(1)).alias("c")).filter("c >= 2")
    named = many.groupBy("signature").agg(joined(F.array_sort(F.collect_list("u"))).alias("copy_sig"))
    return comps.select("signature").join(named, "signature", "left").na.fill("", ["copy_sig"])


@query("prof_gated_sig", "SELECT DISTINCT signature, CASE WHEN core_units LIKE '%U2%' THEN 'U2' ELSE '' END || CASE WHEN core_units LIKE '%U2%' AND core_units LIKE '%U5%' THEN '|' ELSE '' END || CASE WHEN core_units LIKE '%U5%' THEN 'U5' ELSE '' END AS gated_sig FROM signed", ctes=ALL)
def prof_gated_sig(b):
    gated = F.array(*map(F.lit, b.config.gated_units))
    return stages.signed(b).select("signature", joined(F.array_sort(F.array_intersect("core_units", gated))).alias("gated_sig")).distinct()


FRAME = """,
inn AS (SELECT board_id, trait_id, count(DISTINCT character_id) AS n FROM b_units JOIN d_unit_traits USING (character_id) GROUP BY ALL),
giv AS (SELECT board_id, replace(replace(item_id, 'Item_', ''), 'EmblemItem', '') AS trait_id, count(*) AS n FROM b_items WHERE lower(item_id) LIKE '%emblem%' GROUP BY ALL),
num AS (SELECT board_id, trait_id, sum(n)::BIGINT AS num_units FROM (SELECT * FROM inn UNION ALL SELECT * FROM giv) GROUP BY ALL),
frame AS (SELECT n.board_id, n.trait_id, n.num_units, count(*) AS level FROM num n JOIN d_breakpoints d ON d.trait_id = n.trait_id AND d.min_units <= n.num_units GROUP BY ALL)"""


def emblems_of(b):
    worn = b.items.filter(F.col("item_id").rlike("(?i)emblem"))
    return worn.select("board_id", itemization.emblem_trait(F.col("item_id")).alias("trait_id"))


@query("prof_trait_frame", FRAME + "SELECT board_id, trait_id, num_units, level::INT AS level FROM frame")
def prof_trait_frame(b):
    return itemization.trait_frame(b.units, b.d_unit_traits, emblems_of(b), b.d_breakpoints, b.parts())


@query("join_emblem_convention", "SELECT DISTINCT item_id, replace(replace(item_id, 'Item_', ''), 'EmblemItem', '') AS trait_id FROM b_items WHERE lower(item_id) LIKE '%emblem%'")
def join_emblem_convention(b):
    worn = b.items.select("item_id").distinct().filter(F.col("item_id").rlike("(?i)emblem"))
    return worn.withColumn("trait_id", itemization.emblem_trait(F.col("item_id")))


TALLY = FRAME + """, tally AS (SELECT c.comp_id, f.trait_id, count(*) AS boards FROM clustered c JOIN frame f USING (board_id) WHERE c.comp_id IS NOT NULL AND f.level >= 2 GROUP BY ALL)"""


def tallies(b):
    frame = itemization.trait_frame(b.units, b.d_unit_traits, emblems_of(b), b.d_breakpoints, b.parts()).filter("level >= 2")
    return comp_boards(b).select("board_id", "comp_id").join(frame, "board_id").groupBy("comp_id", "trait_id").agg(F.count(F.lit(1)).alias("boards"))


SHAPES = """,
shape AS (SELECT c.comp_id, u.board_id, u.character_id, count(*) AS copies, string_agg(coalesce(star_tier, 0)::VARCHAR, ',' ORDER BY coalesce(star_tier, 0) DESC) AS stars FROM b_units u JOIN clustered c USING (board_id) WHERE c.comp_id IS NOT NULL GROUP BY ALL),
sc AS (SELECT comp_id, character_id, copies, stars, count(*)::BIGINT AS boards FROM shape GROUP BY ALL)"""


def shapes(b):
    stars = F.sort_array(F.collect_list(F.coalesce("star_tier", F.lit(0))), asc=False)
    rows = b.units.join(comp_boards(b).select("board_id", "comp_id"), "board_id").groupBy("comp_id", "board_id", "character_id")
    return rows.agg(F.count(F.lit(1)).alias("copies"), F.array_join(stars.cast("array<string>"), ",").alias("stars"))


def shape_counts(b):
    return shapes(b).groupBy("comp_id", "character_id", "copies", "stars").agg(F.count(F.lit(1)).alias("boards"))


@query("agg_collect_ordered", SHAPES + "SELECT board_id, character_id, copies::BIGINT AS copies, stars FROM shape", ctes=ALL)
def agg_collect_ordered(b):
    return shapes(b).drop("comp_id")


@query("agg_shape_count", SHAPES + "SELECT comp_id, character_id, copies::BIGINT AS copies, stars, boards FROM sc", ctes=ALL)
def agg_shape_count(b):
    return shape_counts(b)


MODE = """, mc AS (SELECT comp_id, character_id, copies FROM (SELECT comp_id, character_id, copies, row_number() OVER (PARTITION BY comp_id, character_id ORDER BY sum(boards) DESC, copies) AS r FROM sc GROUP BY comp_id, character_id, copies) WHERE r = 1)"""


@query("agg_mode_shape", SHAPES + MODE + """SELECT comp_id, character_id, copies::BIGINT AS copies, stars FROM (SELECT sc.comp_id, sc.character_id, sc.copies, sc.stars, row_number() OVER (PARTITION BY sc.comp_id, sc.character_id ORDER BY sc.boards DESC, sc.stars) AS r FROM sc JOIN mc USING (comp_id, character_id, copies)) WHERE r = 1""", ctes=ALL)
def agg_mode_shape(b):
    sc = shape_counts(b)
    unit = Window.partitionBy("comp_id", "character_id")
    sums = sc.withColumn("of_copies", F.sum("boards").over(Window.partitionBy("comp_id", "character_id", "copies")))
    order = unit.orderBy(F.desc("of_copies"), "copies", F.desc("boards"), "stars")
    return sums.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("comp_id", "character_id", "copies", "stars")


SETS = COPIES + """, st AS (SELECT c.comp_id, x.character_id, x.done, count(*)::BIGINT AS boards, sum(c.placement)::BIGINT AS placement_sum FROM best x JOIN clustered c USING (board_id) WHERE c.comp_id IS NOT NULL AND x.n_done > 0 GROUP BY ALL)"""


def set_counts(b):
    boards = comp_boards(b).select("board_id", "comp_id", "placement")
    best = itemization.best_copy(held(b)).filter("n_done > 0").join(boards, "board_id")
    return best.groupBy("comp_id", "character_id", joined("done").alias("done")).agg(F.count(F.lit(1)).alias("boards"), F.sum("placement").alias("placement_sum"))


@query("agg_set_count", SETS + "SELECT comp_id, character_id, done, boards FROM st", ctes=ALL)
def agg_set_count(b):
    return set_counts(b).drop("placement_sum")


@query("agg_mode_itemset", SETS + """SELECT comp_id, character_id, done FROM (SELECT *, row_number() OVER (PARTITION BY comp_id, character_id ORDER BY regexp_matches(done, '(?i)_Item_Artifact_|_Item_Ornn|Radiant|AnimaSquadItem'), boards DESC, done) AS r FROM st) WHERE r = 1""", ctes=ALL)
def agg_mode_itemset(b):
    """The usual set of each unit; sets with items that chance gives come last."""
    chance = F.exists(F.split("done", r"\|"), codecs.rng_item)
    order = Window.partitionBy("comp_id", "character_id").orderBy(chance, F.desc("boards"), "done")
    return set_counts(b).withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("comp_id", "character_id", "done")


@query("agg_mode_build", SETS + """, g AS (SELECT k.gkey, st.character_id, st.done, sum(st.boards)::BIGINT AS boards, sum(placement_sum) AS ps FROM st JOIN (SELECT DISTINCT comp_id, gkey FROM keyed) k USING (comp_id) GROUP BY ALL HAVING sum(st.boards) >= 5)
    SELECT gkey, character_id, done, boards, round(ps / boards, 6) AS avg_placement, r AS position FROM (SELECT *, row_number() OVER (PARTITION BY gkey, character_id ORDER BY boards DESC, done) AS r FROM g) WHERE r <= 3""", ctes=ALL)
def agg_mode_build(b):
    keyed = stages.grouped(b, set_counts(b))
    sums = keyed.groupBy("gkey", "character_id", "done").agg(F.sum("boards").alias("boards"), F.sum("placement_sum").alias("ps")).filter(F.col("boards") >= b.config.build_min_boards)
    order = Window.partitionBy("gkey", "character_id").orderBy(F.desc("boards"), "done")
    return sums.withColumn("position", F.row_number().over(order).cast("long")).filter("position <= 3").select("gkey", "character_id", "done", "boards", r6(F.col("ps") / F.col("boards")).alias("avg_placement"), "position")


@query("agg_mode_trait", FRAME + """, tc AS (SELECT c.comp_id, f.trait_id, f.num_units, count(*) AS boards FROM frame f JOIN clustered c USING (board_id) WHERE c.comp_id IS NOT NULL GROUP BY ALL), n AS (SELECT comp_id, count(*) AS total FROM clustered WHERE comp_id IS NOT NULL GROUP BY 1)
    SELECT comp_id, trait_id, num_units, round(appears / total, 6) AS freq FROM (SELECT *, sum(boards) OVER (PARTITION BY comp_id, trait_id) AS appears, row_number() OVER (PARTITION BY comp_id, trait_id ORDER BY boards DESC, num_units) AS r FROM tc) JOIN n USING (comp_id) WHERE r = 1 AND appears / total >= 0.5""", ctes=ALL)
def agg_mode_trait(b):
    boards = comp_boards(b).select("board_id", "comp_id")
    total = boards.groupBy("comp_id").agg(F.count(F.lit(1)).alias("total"))
    frame = itemization.trait_frame(b.units, b.d_unit_traits, emblems_of(b), b.d_breakpoints, b.parts())
    counts = frame.join(boards, "board_id").groupBy("comp_id", "trait_id", "num_units").agg(F.count(F.lit(1)).alias("boards"))
    own = Window.partitionBy("comp_id", "trait_id")
    ranked = counts.withColumns({"appears": F.sum("boards").over(own), "_r": F.row_number().over(own.orderBy(F.desc("boards"), "num_units"))}).filter("_r = 1")
    freq = F.col("appears") / F.col("total")
    return ranked.join(total, "comp_id").filter(freq >= 0.5).select("comp_id", "trait_id", "num_units", r6(freq).alias("freq"))


@query("carry_heuristic", """, c AS (SELECT u.board_id, u.unit_row, u.character_id, d.cost, count(i.item_id) AS n FROM b_units u JOIN d_units d USING (character_id) LEFT JOIN b_items i USING (board_id, unit_row) GROUP BY ALL)
    SELECT board_id, character_id AS carry FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY n DESC, cost DESC, unit_row) AS r FROM c) WHERE r = 1 AND n > 0""")
def carry_heuristic(b):
    rows = held(b).join(F.broadcast(b.d_units.select("character_id", "cost")), "character_id")
    order = Window.partitionBy("board_id").orderBy(F.desc("n_items"), F.desc("cost"), "unit_row")
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1 AND n_items > 0").select("board_id", F.col("character_id").alias("carry"))


@query("copy_index", "SELECT board_id, unit_row, character_id, (row_number() OVER (PARTITION BY board_id, character_id ORDER BY unit_row) - 1)::INT AS copy_index FROM b_units")
def copy_index(b):
    order = Window.partitionBy("board_id", "character_id").orderBy("unit_row")
    return b.units.select("board_id", "unit_row", "character_id", (F.row_number().over(order) - 1).alias("copy_index"))


@query("board_build", """, c AS (SELECT u.board_id, u.unit_row, u.character_id, u.star_tier, d.cost, count(i.item_id) AS n FROM b_units u JOIN d_units d USING (character_id) LEFT JOIN b_items i USING (board_id, unit_row) GROUP BY ALL)
    SELECT board_id, string_agg(character_id || '*' || star_tier, ' ' ORDER BY n DESC, cost DESC, star_tier DESC, character_id, unit_row) AS line FROM c GROUP BY 1""")
def board_build(b):
    rows = held(b).join(F.broadcast(b.d_units.select("character_id", "cost")), "character_id")
    key = F.struct((-F.col("n_items")).alias("a"), (-F.col("cost")).alias("b"), (-F.col("star_tier")).alias("c"), F.col("character_id").alias("d"), F.col("unit_row").alias("e"))
    sorted_units = F.array_sort(F.collect_list(F.struct(key.alias("k"), F.concat("character_id", F.lit("*"), "star_tier").alias("t"))))
    return rows.groupBy("board_id").agg(F.array_join(F.transform(sorted_units, lambda x: x["t"]), " ").alias("line"))


@query("agg_hit_states", """, h AS (SELECT k.gkey, s.three_stars, sum(k.n)::BIGINT AS n FROM keyed k JOIN (SELECT DISTINCT ('0x' || substr(md5(signature), 1, 15))::BIGINT AS comp_id, three_stars FROM signed) s USING (comp_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY n DESC, three_stars) AS rk FROM h) SELECT gkey, CASE WHEN rk <= 8 THEN three_stars ELSE '__other__' END AS state, sum(n)::BIGINT AS n FROM r GROUP BY ALL""", ctes=ALL)
def agg_hit_states(b):
    from ..operators import identity

    three = stages.comps(b).select("comp_id", joined("three_stars").alias("state"))
    sums = stages.keyed(b).join(three, "comp_id").groupBy("gkey", "state").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("gkey").orderBy(F.desc("n"), "state")
    ranked = sums.withColumn("_r", F.row_number().over(order))
    return ranked.groupBy("gkey", F.when(F.col("_r") <= b.config.variant_cap, F.col("state")).otherwise("__other__").alias("state")).agg(F.sum("n").alias("n"))


@query("agg_unit_rollup", """, per AS (SELECT c.comp_id, u.board_id, u.character_id, max(u.star_tier) AS star, max(c.placement) AS placement FROM b_units u JOIN clustered c USING (board_id) WHERE c.comp_id IS NOT NULL GROUP BY ALL),
    st AS (SELECT k.gkey, p.character_id, p.star, count(*) AS n, sum(p.placement) AS ps FROM per p JOIN (SELECT DISTINCT comp_id, gkey FROM keyed) k USING (comp_id) GROUP BY ALL),
    tot AS (SELECT gkey, sum(n) AS n, sum(placement_sum) AS ps FROM keyed GROUP BY 1)
    SELECT gkey, character_id, boards, modal_star, round(avg_placement, 6) AS avg_placement, round(avg_placement - a, 6) AS delta FROM (SELECT st.gkey, st.character_id, sum(st.n)::BIGINT AS boards, arg_max(st.star, st.n * 10 - st.star)::INT AS modal_star, sum(st.ps) / sum(st.n) AS avg_placement, max(t.ps / t.n) AS a, max(t.n) AS total
    FROM st JOIN tot t USING (gkey) GROUP BY st.gkey, st.character_id) WHERE boards >= least(10, greatest(1, ceil(total / 2)))""", ctes=ALL)
def agg_unit_rollup(b):
    boards = comp_boards(b).select("board_id", "comp_id", "placement")
    per = b.units.join(boards, "board_id").groupBy("comp_id", "board_id", "placement", "character_id").agg(F.max("star_tier").alias("star"))
    star = stages.grouped(b, per).groupBy("gkey", "character_id", "star").agg(F.count(F.lit(1)).alias("n"), F.sum("placement").alias("ps"))
    total = rollup.pool(stages.keyed(b), "gkey").select("gkey", F.col("n").alias("total"), (F.col("placement_sum") / F.col("n")).alias("a"))
    rows = star.groupBy("gkey", "character_id").agg(F.sum("n").alias("boards"), F.max_by("star", F.col("n") * 10 - F.col("star")).alias("modal_star"), (F.sum("ps") / F.sum("n")).alias("avg_placement"))
    floor = F.least(F.lit(b.config.unit_min_boards), F.greatest(F.lit(1), F.ceil(F.col("total") / 2)))
    return rows.join(total, "gkey").filter(F.col("boards") >= floor).select("gkey", "character_id", "boards", "modal_star", r6("avg_placement").alias("avg_placement"), r6(F.col("avg_placement") - F.col("a")).alias("delta"))
