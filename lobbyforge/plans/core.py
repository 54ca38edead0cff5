"""Queries of clustering, rollup, scoring and ranking over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scoring
from ..operators import identity, rollup
from . import stages
from .stages import SCORE, SEM, sql

ALL = sql()
ROUND = 6


def r6(c):
    return F.round(c, ROUND)


def joined(c):
    return F.array_join(c, "|")


@query("clu_pass", """SELECT 'clustered' AS name, count(*)::BIGINT AS rows FROM clustered UNION ALL SELECT 'comps', count(DISTINCT signature)::BIGINT FROM signed UNION ALL SELECT 'stats', count(*)::BIGINT FROM stats UNION ALL SELECT 'totals', count(*)::BIGINT FROM totals""", ctes=ALL, stored=True)
def clu_pass(b):
    """One pass: writes the tables that read models read, if they are not there yet, and counts their rows."""
    made = {"clustered": stages.clustered(b), "comps": stages.comps(b), "stats": stages.stats(b), "totals": stages.totals(b)}
    counts = [rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, rows in made.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("sig_build", "SELECT board_id, signature FROM signed", ctes=ALL)
def sig_build(b):
    return stages.signed(b).select("board_id", "signature")


@query("sig_core_units", "SELECT board_id, core_units, three_stars FROM signed", ctes=ALL)
def sig_core_units(b):
    return stages.signed(b).select("board_id", joined("core_units").alias("core_units"), joined("three_stars").alias("three_stars"))


@query("sig_emblem", "SELECT DISTINCT item_id, lower(item_id) LIKE '%emblem%' AS is_emblem FROM b_items")
def sig_emblem(b):
    return b.items.select("item_id").distinct().withColumn("is_emblem", identity.is_emblem(F.col("item_id")))


@query("sig_parse_emblems", "SELECT DISTINCT signature, replace(worn, 'emb:', '') AS emblems FROM signed", ctes=ALL)
def sig_parse_emblems(b):
    return stages.signed(b).select("signature").distinct().withColumn("emblems", joined(identity.signature_emblems(F.col("signature"))))


@query("clu_assign", "SELECT board_id, coalesce(comp_id, -1) AS comp_id FROM clustered", ctes=ALL)
def clu_assign(b):
    return stages.clustered(b).select("board_id", F.coalesce("comp_id", F.lit(-1)).alias("comp_id"))


@query("clu_comps", "SELECT ('0x' || substr(md5(signature), 1, 15))::BIGINT AS comp_id, signature, min(core_units) AS core_units, count(*)::BIGINT AS boards FROM signed GROUP BY signature", ctes=ALL)
def clu_comps(b):
    return stages.signed(b).groupBy("signature").agg(F.min(joined("core_units")).alias("core_units"), F.count(F.lit(1)).alias("boards")).withColumn("comp_id", identity.comp_id(F.col("signature")))


@query("clu_units_lookup", "SELECT p.board_id, count(*)::BIGINT AS copies FROM b_players p JOIN b_units u USING (board_id) GROUP BY p.board_id")
def clu_units_lookup(b):
    return b.players.select("board_id").join(b.units, "board_id").groupBy("board_id").agg(F.count(F.lit(1)).alias("copies"))


@query("clu_emblems_worn", "SELECT board_id, string_agg(DISTINCT item_id, '|' ORDER BY item_id) AS emblems FROM b_items WHERE lower(item_id) LIKE '%emblem%' GROUP BY board_id")
def clu_emblems_worn(b):
    return identity.emblems_worn(b.items).select("board_id", joined("emblems").alias("emblems"))


@query("flt_ranked_scope", "SELECT match_id, region, patch_id FROM b_matches WHERE queue_id = 1100 AND set_number IS NOT NULL AND player_count = 8")
def flt_ranked_scope(b):
    return rollup.ranked(b.matches, b.config).select("match_id", "region", "patch_id")


@query("flt_rollup_scope", "SELECT board_id, comp_id, patch_id FROM clustered WHERE comp_id IS NOT NULL AND patch_id IS NOT NULL", ctes=ALL)
def flt_rollup_scope(b):
    return stages.clustered(b).filter("comp_id IS NOT NULL AND patch_id IS NOT NULL").select("board_id", "comp_id", "patch_id")


@query("flt_real_units", "SELECT u.board_id, u.unit_row, u.character_id FROM b_units u JOIN d_units d USING (character_id) WHERE d.cost BETWEEN 1 AND 5")
def flt_real_units(b):
    return b.units.join(F.broadcast(b.d_units), "character_id").filter(F.col("cost").between(1, 5)).select("board_id", "unit_row", "character_id")


@query("flt_not_bot", "SELECT board_id, puuid FROM b_players WHERE puuid <> 'BOT'")
def flt_not_bot(b):
    return b.players.filter(F.col("puuid") != "BOT").select("board_id", "puuid")


@query("flt_bucket", "SELECT * FROM stats WHERE patch_id = 1 AND region = 'AFRICA' AND rank_bucket = 'challenger'", ctes=ALL)
def flt_bucket(b):
    return stages.stats(b).filter("patch_id = 1 AND region = 'AFRICA' AND rank_bucket = 'challenger'")


@query("flt_min_sample", "SELECT * FROM stats WHERE n >= 3", ctes=ALL)
def flt_min_sample(b):
    return stages.stats(b).filter(F.col("n") >= b.config.tier_min_sample)


@query("flt_in_list", "SELECT board_id, comp_id FROM clustered WHERE comp_id IN (SELECT comp_id FROM stats WHERE n >= 3)", ctes=ALL)
def flt_in_list(b):
    wanted = stages.stats(b).filter(F.col("n") >= b.config.tier_min_sample).select("comp_id").distinct()
    return stages.clustered(b).join(wanted, "comp_id", "left_semi").select("board_id", "comp_id")


@query("prj_gkey", "SELECT DISTINCT comp_id, gkey FROM keyed", ctes=ALL)
def prj_gkey(b):
    return stages.keyed(b).select("comp_id", "gkey").distinct()


@query("join_board_match", "SELECT p.board_id, m.region, m.queue_id FROM b_players p JOIN b_matches m USING (match_id)")
def join_board_match(b):
    return b.players.join(b.matches, "match_id").select("board_id", "region", "queue_id")


@query("join_board_units", "SELECT p.board_id, m.patch_id, u.unit_row, u.character_id, u.star_tier FROM b_players p JOIN b_matches m USING (match_id) JOIN b_units u USING (board_id) WHERE m.queue_id = 1100")
def join_board_units(b):
    ranked = b.matches.filter("queue_id = 1100").select("match_id", "patch_id")
    return b.players.select("board_id", "match_id").join(ranked, "match_id").join(b.units, "board_id").select("board_id", "patch_id", "unit_row", "character_id", "star_tier")


@query("join_board_traits", "SELECT u.board_id, t.trait_id, count(DISTINCT u.character_id)::BIGINT AS num_units FROM b_units u JOIN d_unit_traits t USING (character_id) GROUP BY ALL")
def join_board_traits(b):
    distinct = b.units.select("board_id", "character_id").distinct()
    return distinct.join(F.broadcast(b.d_unit_traits), "character_id").groupBy("board_id", "trait_id").agg(F.count(F.lit(1)).alias("num_units"))


@query("join_stats_comps", "SELECT s.comp_id, s.patch_id, s.region, s.rank_bucket, s.n, c.signature FROM stats s JOIN (SELECT DISTINCT signature, ('0x' || substr(md5(signature), 1, 15))::BIGINT AS comp_id FROM signed) c USING (comp_id)", ctes=ALL)
def join_stats_comps(b):
    return stages.stats(b).join(stages.comps(b).select("comp_id", "signature"), "comp_id").select("comp_id", "patch_id", "region", "rank_bucket", "n", "signature")


@query("join_wanted_keys", "SELECT comp_id, patch_id, region, rank_bucket, gkey, n FROM keyed WHERE gkey IN ('m:fam0', 'm:fam3', 'm:fam7')", ctes=ALL)
def join_wanted_keys(b):
    wanted = F.broadcast(b.spark.createDataFrame([("m:fam0",), ("m:fam3",), ("m:fam7",)], "gkey string"))
    return stages.keyed(b).join(wanted, "gkey").select("comp_id", "patch_id", "region", "rank_bucket", "gkey", "n")


@query("join_left_manual", "SELECT comp_id, patch_id, region, rank_bucket, CASE WHEN comp_id % 11 = 0 THEN 'S' END AS manual_tier FROM stats", ctes=ALL)
def join_left_manual(b):
    s = stages.stats(b)
    keys = ["comp_id", *rollup.BUCKET]
    pins = s.filter("comp_id % 11 = 0").select(*keys, F.lit("S").alias("manual_tier"))
    return s.select(*keys).join(pins, keys, "left")


@query("join_left_totals", "SELECT s.comp_id, s.patch_id, s.region, s.rank_bucket, s.n, t.total_boards FROM stats s LEFT JOIN totals t USING (patch_id, region, rank_bucket)", ctes=ALL)
def join_left_totals(b):
    c = stages.clustered(b)
    return rollup.comp_stats(c).join(F.broadcast(rollup.bucket_totals(c)), list(rollup.BUCKET), "left").select("comp_id", *rollup.BUCKET, "n", "total_boards")


@query("join_left_stats", "SELECT c.comp_id, coalesce(sum(s.n), 0)::BIGINT AS total FROM (SELECT DISTINCT comp_id FROM clustered WHERE comp_id IS NOT NULL) c LEFT JOIN (SELECT * FROM stats WHERE n >= 2) s USING (comp_id) GROUP BY c.comp_id", ctes=ALL)
def join_left_stats(b):
    comps = stages.comps(b).select("comp_id")
    return comps.join(stages.stats(b).filter("n >= 2").select("comp_id", "n"), "comp_id", "left").groupBy("comp_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


@query("agg_rollup_stats", "SELECT * FROM stats", ctes=ALL)
def agg_rollup_stats(b):
    return stages.stats(b)


@query("agg_bucket_totals", "SELECT * FROM totals", ctes=ALL)
def agg_bucket_totals(b):
    return rollup.bucket_totals(stages.clustered(b))


@query("agg_conditional_count", "SELECT rank_bucket, count(*) FILTER (WHERE placement <= 4)::BIGINT AS top4, count(*) FILTER (WHERE placement = 1)::BIGINT AS wins, count(*) FILTER (WHERE puuid <> 'BOT')::BIGINT AS people FROM b_players GROUP BY rank_bucket")
def agg_conditional_count(b):
    return b.players.groupBy("rank_bucket").agg(F.count_if(F.col("placement") <= 4).alias("top4"), F.count_if(F.col("placement") == 1).alias("wins"), F.count_if(F.col("puuid") != "BOT").alias("people"))


@query("agg_pool_archetype", "SELECT * FROM arch", ctes=ALL)
def agg_pool_archetype(b):
    return stages.archetypes(b)


@query("agg_pool_members", "SELECT gkey, sum(n)::BIGINT AS n, sum(placement_sum)::BIGINT AS placement_sum, sum(placement_sumsq)::BIGINT AS placement_sumsq, sum(top4_count)::BIGINT AS top4_count, sum(win_count)::BIGINT AS win_count FROM keyed GROUP BY gkey", ctes=ALL)
def agg_pool_members(b):
    return rollup.pool(stages.keyed(b), "gkey")


@query("agg_trend_snapshot", """SELECT k.gkey, k.patch_id, k.region, k.rank_bucket, min(k.comp_id) AS anchor, sum(k.n)::BIGINT AS n, max(t.total_boards) AS bucket_total, sum(k.placement_sum)::BIGINT AS placement_sum,
    sum(k.top4_count)::BIGINT AS top4_count, sum(k.win_count)::BIGINT AS win_count FROM keyed k LEFT JOIN totals t USING (patch_id, region, rank_bucket) GROUP BY ALL HAVING sum(k.n) >= 2""", ctes=ALL)
def agg_trend_snapshot(b):
    c = stages.clustered(b)
    totals = F.broadcast(rollup.bucket_totals(c))
    rows = stages.grouped(b, rollup.comp_stats(c)).join(totals, list(rollup.BUCKET), "left")
    out = rows.groupBy("gkey", *rollup.BUCKET).agg(F.min("comp_id").alias("anchor"), F.sum("n").alias("n"), F.max("total_boards").alias("bucket_total"), *(F.sum(c).alias(c) for c in ("placement_sum", "top4_count", "win_count")))
    return out.filter(F.col("n") >= b.config.trend_min_sample)


@query("agg_having_max", "SELECT comp_id, sum(n)::BIGINT AS total FROM stats GROUP BY comp_id HAVING max(n) >= 3", ctes=ALL)
def agg_having_max(b):
    return stages.stats(b).groupBy("comp_id").agg(F.sum("n").alias("total"), F.max("n").alias("_m")).filter(F.col("_m") >= b.config.tier_min_sample).drop("_m")


@query("prof_load_tail", "SELECT comp_id, sum(n)::BIGINT AS total FROM stats GROUP BY comp_id HAVING max(n) < 3 AND sum(n) >= 2", ctes=ALL)
def prof_load_tail(b):
    out = stages.stats(b).groupBy("comp_id").agg(F.sum("n").alias("total"), F.max("n").alias("_m"))
    return out.filter((F.col("_m") < b.config.tier_min_sample) & (F.col("total") >= b.config.seed_min_total)).drop("_m")


@query("agg_combos", "SELECT patch_id, region, rank_bucket, sum(n)::BIGINT AS n FROM stats GROUP BY ALL", ctes=ALL)
def agg_combos(b):
    return stages.stats(b).groupBy(*rollup.BUCKET).agg(F.sum("n").alias("n"))


@query("agg_avg_level", "SELECT comp_id, round(avg(level), 6) AS avg_level FROM clustered WHERE comp_id IS NOT NULL GROUP BY comp_id", ctes=ALL)
def agg_avg_level(b):
    return stages.clustered(b).filter("comp_id IS NOT NULL").groupBy("comp_id").agg(r6(F.avg("level")).alias("avg_level"))


@query("agg_player_count", "SELECT match_id, count(*) FILTER (WHERE puuid <> 'BOT')::BIGINT AS player_count FROM b_players GROUP BY match_id")
def agg_player_count(b):
    return b.players.groupBy("match_id").agg(F.count_if(F.col("puuid") != "BOT").alias("player_count"))


@query("agg_unit_star", """, per AS (SELECT u.board_id, u.character_id, least(3, greatest(1, max(coalesce(u.star_tier, 1)))) AS star FROM b_units u JOIN ranked r USING (board_id) GROUP BY ALL)
    SELECT p.character_id, p.star::INT AS star, count(*)::BIGINT AS n, sum(r.placement)::BIGINT AS placement_sum, count(*) FILTER (WHERE r.placement <= 4)::BIGINT AS top4_count FROM per p JOIN ranked r USING (board_id) GROUP BY ALL""", ctes=ALL)
def agg_unit_star(b):
    boards = stages.ranked_boards(b).select("board_id", "placement")
    star = F.least(F.lit(3), F.greatest(F.lit(1), F.max(F.coalesce("star_tier", F.lit(1)))))
    per = b.units.join(boards, "board_id").groupBy("board_id", "placement", "character_id").agg(star.alias("star"))
    return per.groupBy("character_id", "star").agg(F.count(F.lit(1)).alias("n"), F.sum("placement").alias("placement_sum"), F.count_if(F.col("placement") <= 4).alias("top4_count"))


BAND = "CASE WHEN coalesce(level, 0) >= 9 THEN '9+' WHEN level = 8 THEN '8' ELSE '7-' END"


@query("prj_level_band", f"SELECT board_id, {BAND} AS band FROM b_players")
def prj_level_band(b):
    return b.players.select("board_id", F.expr(BAND).alias("band"))


@query("agg_level_bands", f""", g AS (SELECT {BAND} AS band, count(*) AS n, avg(placement) AS a FROM ranked WHERE rank_bucket = 'challenger' GROUP BY 1)
    SELECT v.band, coalesce(g.n, 0)::BIGINT AS boards, round(coalesce(g.n, 0) / (SELECT sum(n) FROM g), 6) AS share, round(g.a, 6) AS avg_placement FROM (VALUES ('7-'), ('8'), ('9+')) AS v(band) LEFT JOIN g USING (band)""", ctes=ALL)
def agg_level_bands(b):
    found = stages.ranked_boards(b).filter("rank_bucket = 'challenger'").groupBy(F.expr(BAND).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("placement").alias("a"))
    bands = b.spark.createDataFrame([("7-",), ("8",), ("9+",)], "band string")
    total = F.sum("boards").over(Window.partitionBy(F.lit(0)))
    out = bands.join(found, "band", "left").withColumn("boards", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("band", "boards", r6(F.try_divide("boards", total)).alias("share"), r6("a").alias("avg_placement"))


@query("agg_placement_hist", """, g AS (SELECT placement, count(*) AS n FROM ranked GROUP BY 1) SELECT s.placement::INT AS placement, coalesce(g.n, 0)::BIGINT AS boards, round(coalesce(g.n, 0) / (SELECT sum(n) FROM g), 6) AS share
    FROM (SELECT unnest(generate_series(1, 8)) AS placement) s LEFT JOIN g ON g.placement = s.placement""", ctes=ALL)
def agg_placement_hist(b):
    found = stages.ranked_boards(b).groupBy("placement").agg(F.count(F.lit(1)).alias("n"))
    places = b.spark.range(1, 9).select(F.col("id").cast("int").alias("placement"))
    out = places.join(found, "placement", "left").withColumn("boards", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("placement", "boards", r6(F.try_divide("boards", F.sum("boards").over(Window.partitionBy(F.lit(0))))).alias("share"))


@query("agg_play_trend", "SELECT k.gkey, CAST(game_datetime AS DATE) AS day, count(*)::BIGINT AS games, round(avg(placement), 6) AS avg_placement, count(*) FILTER (WHERE placement <= 4)::BIGINT AS top4 FROM clustered c JOIN (SELECT DISTINCT comp_id, gkey FROM keyed) k USING (comp_id) GROUP BY 1, 2", ctes=ALL)
def agg_play_trend(b):
    return stages.grouped(b, stages.clustered(b).filter("comp_id IS NOT NULL")).groupBy("gkey", F.to_date("game_datetime").alias("day")).agg(F.count(F.lit(1)).alias("games"), r6(F.avg("placement")).alias("avg_placement"), F.count_if(F.col("placement") <= 4).alias("top4"))


@query("agg_bucket_day", "SELECT CAST(m.game_datetime AS DATE) AS day, count(*)::BIGINT AS boards FROM b_players p JOIN b_matches m USING (match_id) WHERE m.queue_id = 1100 AND m.patch_id = 1 GROUP BY 1")
def agg_bucket_day(b):
    matches = b.matches.filter("queue_id = 1100 AND patch_id = 1").select("match_id", "game_datetime")
    return b.players.select("match_id").join(matches, "match_id").groupBy(F.to_date("game_datetime").alias("day")).agg(F.count(F.lit(1)).alias("boards"))


@query("join_two_grain", """, d AS (SELECT comp_id % 20 AS slice, CAST(game_datetime AS DATE) AS day, count(*) AS games FROM clustered WHERE comp_id IS NOT NULL GROUP BY 1, 2), a AS (SELECT CAST(game_datetime AS DATE) AS day, count(*) AS boards FROM ranked GROUP BY 1)
    SELECT d.slice, d.day, d.games::BIGINT AS games, round(d.games / a.boards, 6) AS play_rate FROM d LEFT JOIN a USING (day)""", ctes=ALL)
def join_two_grain(b):
    boards = stages.clustered(b).select(F.to_date("game_datetime").alias("day"), (F.col("comp_id") % 20).alias("slice"))
    per_day = boards.groupBy("day").agg(F.count(F.lit(1)).alias("boards"))
    per_slice = boards.filter("slice IS NOT NULL").groupBy("slice", "day").agg(F.count(F.lit(1)).alias("games"))
    return per_slice.join(F.broadcast(per_day), "day").select("slice", "day", "games", r6(F.col("games") / F.col("boards")).alias("play_rate"))


@query("agg_distinct_count", "SELECT character_id, count(DISTINCT board_id)::BIGINT AS boards FROM b_units GROUP BY 1")
def agg_distinct_count(b):
    return b.units.groupBy("character_id").agg(F.count_distinct("board_id").alias("boards"))


@query("agg_distinct", "SELECT DISTINCT region, patch_id FROM b_matches")
def agg_distinct(b):
    return b.matches.select("region", "patch_id").distinct()


@query("agg_min_max", "SELECT patch_id, min(game_datetime) AS first_game, max(game_datetime) AS last_game, max(set_number) AS last_set FROM b_matches GROUP BY 1")
def agg_min_max(b):
    return b.matches.groupBy("patch_id").agg(F.min("game_datetime").alias("first_game"), F.max("game_datetime").alias("last_game"), F.max("set_number").alias("last_set"))


@query("score_metrics", f"""SELECT gkey, patch_id, region, rank_bucket, n, round(placement_sum / n, 6) AS avg_placement, round(top4_count / n, 6) AS top4_rate, round(win_count / n, 6) AS win_rate, round({SEM}, 6) AS placement_sem, round({SCORE}, 6) AS score, n < 30 AS low_sample FROM arch""", ctes=ALL)
def score_metrics(b):
    m = scoring.metrics(stages.archetypes(b), b.config)
    return m.select("gkey", *rollup.BUCKET, "n", *(r6(c).alias(c) for c in ("avg_placement", "top4_rate", "win_rate", "placement_sem", "score")), "low_sample")


WILSON = """round(least(greatest(({k} / n + 3.8416 / (2 * n) - 1.96 * sqrt(({k} / n) * (1 - {k} / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 1), 6) AS low,
    round(least(greatest(({k} / n + 3.8416 / (2 * n) + 1.96 * sqrt(({k} / n) * (1 - {k} / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 0), 1), 6) AS high""".format(k="top4_count")


@query("score_wilson", f"SELECT gkey, patch_id, region, rank_bucket, {WILSON} FROM (SELECT gkey, patch_id, region, rank_bucket, n::DOUBLE AS n, top4_count::DOUBLE AS top4_count FROM arch)", ctes=ALL)
def score_wilson(b):
    low, high = scoring.wilson(F.col("top4_count"), F.col("n"), b.config.z)
    return stages.archetypes(b).select("gkey", *rollup.BUCKET, r6(low).alias("low"), r6(high).alias("high"))


@query("score_sem", f"SELECT gkey, patch_id, region, rank_bucket, round({SEM}, 6) AS placement_sem FROM arch", ctes=ALL)
def score_sem(b):
    return stages.archetypes(b).select("gkey", *rollup.BUCKET, r6(scoring.sem()).alias("placement_sem"))


CUTS = """, f AS (SELECT *, row_number() OVER (PARTITION BY patch_id, region, rank_bucket ORDER BY score DESC) AS rk, count(*) OVER (PARTITION BY patch_id, region, rank_bucket) AS c FROM scored WHERE n >= 3),
cuts AS (SELECT patch_id, region, rank_bucket, max(score) FILTER (WHERE rk = least(c - 1, floor(0.1 * c)) + 1) AS cut_s, max(score) FILTER (WHERE rk = least(c - 1, floor(0.27 * c)) + 1) AS cut_a,
    max(score) FILTER (WHERE rk = least(c - 1, floor(0.5 * c)) + 1) AS cut_b, max(score) FILTER (WHERE rk = least(c - 1, floor(0.75 * c)) + 1) AS cut_c FROM f WHERE c >= 8 GROUP BY ALL)"""


@query("win_tier_cutoffs", CUTS + "SELECT patch_id, region, rank_bucket, round(cut_s, 6) AS cut_s, round(cut_a, 6) AS cut_a, round(cut_b, 6) AS cut_b, round(cut_c, 6) AS cut_c FROM cuts", ctes=ALL, stored=True)
def win_tier_cutoffs(b):
    s = stages.archetypes(b).withColumn("score", scoring.shrunk_score(b.config)).filter(F.col("n") >= b.config.tier_min_sample)
    c = scoring.cutoffs(s, list(rollup.BUCKET), b.config)
    return c.select(*rollup.BUCKET, *(r6(x).alias(x) for x in ("cut_s", "cut_a", "cut_b", "cut_c")))


STATIC = "CASE WHEN score >= 0.55 THEN 'S' WHEN score >= 0.5 THEN 'A' WHEN score >= 0.45 THEN 'B' WHEN score >= 0.4 THEN 'C' ELSE 'D' END"
DYNAMIC = f"CASE WHEN cut_s IS NULL THEN {STATIC} WHEN score >= cut_s THEN 'S' WHEN score >= cut_a THEN 'A' WHEN score >= cut_b THEN 'B' WHEN score >= cut_c THEN 'C' ELSE 'D' END"


def tiered(b):
    """Groups over the floor with score, rank in their bucket and tier."""
    s = stages.archetypes(b).withColumn("score", scoring.shrunk_score(b.config)).filter(F.col("n") >= b.config.tier_min_sample)
    rows = scoring.ranked(s, list(rollup.BUCKET), "gkey")
    cut = scoring.cuts_of(rows, list(rollup.BUCKET), b.config)
    return rows.join(F.broadcast(cut), list(rollup.BUCKET), "left").withColumn("tier", scoring.dynamic_tier(F.col("score"), b.config))


@query("win_tier_assign", CUTS + f"SELECT gkey, patch_id, region, rank_bucket, {DYNAMIC} AS tier FROM scored LEFT JOIN cuts USING (patch_id, region, rank_bucket) WHERE n >= 3", ctes=ALL, stored=True)
def win_tier_assign(b):
    return tiered(b).select("gkey", *rollup.BUCKET, "tier")


@query("win_rank_bucket", f"""SELECT comp_id, patch_id, region, rank_bucket, {STATIC} AS tier, row_number() OVER (PARTITION BY patch_id, region, rank_bucket ORDER BY score DESC, comp_id) AS rank_order
    FROM (SELECT *, {SCORE} AS score FROM stats WHERE n >= 2)""", ctes=ALL, stored=True)
def win_rank_bucket(b):
    s = stages.stats(b).filter(F.col("n") >= b.config.seed_min_total).withColumn("score", scoring.shrunk_score(b.config))
    rows = scoring.ranked(s, list(rollup.BUCKET), "comp_id")
    return rows.select("comp_id", *rollup.BUCKET, scoring.static_tier(F.col("score"), b.config).alias("tier"), F.col("_rank").alias("rank_order"))
