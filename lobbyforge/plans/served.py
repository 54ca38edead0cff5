"""Queries of patches, selectors, profiles, matches and ladder pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import codecs
from ..operators import patches, served
from ..sources.boards import BOARDS_SQL
from . import stages
from .core import agg_trend_snapshot, r6
from .stages import sql

#: Patches of the test tables: versions as numbers, placeholders of two sets, one that is no number, one without matches.
VERSIONS = ("16.9", "16.10", "17.0", "18.0", "beta", "17.6")
D_PATCHES = """,
d_patches AS (SELECT CAST(k + 1 AS INT) AS patch_id, CASE k WHEN 3 THEN 18 ELSE 17 END AS set_number, ['16.9', '16.10', '17.0', '18.0', 'beta', '17.6'][k + 1] AS patch, k = 3 AS is_current
    FROM (SELECT DISTINCT p_partkey % 6 AS k FROM part)),
won AS (SELECT p.patch_id FROM d_patches p WHERE regexp_full_match(p.patch, '[0-9]+[.][0-9]+') AND EXISTS (SELECT 1 FROM b_matches m WHERE m.patch_id = p.patch_id)
    AND p.set_number = (SELECT max(set_number) FROM d_units u WHERE EXISTS (SELECT 1 FROM b_matches m WHERE m.set_number = u.set_number))
    ORDER BY p.patch <> p.set_number || '.0' DESC, split_part(p.patch, '.', 1)::INT DESC, split_part(p.patch, '.', 2)::INT DESC LIMIT 1),
adv AS (SELECT d.* EXCLUDE (is_current), coalesce(d.patch_id = (SELECT patch_id FROM won), d.is_current) AS is_current, d.is_current AS was FROM d_patches d)"""
VIEWS = BOARDS_SQL + D_PATCHES


def d_patches(b):
    k = F.col("id").cast("int")
    return b.keys(6).select((k + 1).alias("patch_id"), F.when(k == 3, 18).otherwise(17).alias("set_number"), F.get(F.array(*map(F.lit, VERSIONS)), k).alias("patch"), (k == 3).alias("is_current"))


def advanced(b):
    return patches.advance(d_patches(b), b.d_units, b.matches)


@query("rm_current_set", """SELECT coalesce((SELECT max(set_number) FROM d_patches p WHERE is_current AND EXISTS (SELECT 1 FROM d_units u WHERE u.set_number = p.set_number)), (SELECT max(set_number) FROM d_units)) AS set_number""", ctes=VIEWS)
def rm_current_set(b):
    return patches.current_set(d_patches(b), b.d_units)


@query("rm_advance_patch", "SELECT patch_id, patch, is_current, is_current <> was AS changed FROM adv", ctes=VIEWS)
def rm_advance_patch(b):
    return advanced(b).select("patch_id", "patch", "is_current", "changed")


@query("rm_resolve_patch", """SELECT m.match_id, v.patch, p.patch_id FROM (SELECT match_id, set_number, CASE lobby % 4 WHEN 0 THEN '16.9' WHEN 1 THEN '16.10' WHEN 2 THEN '17.0' ELSE '15.3' END AS patch FROM b_matches) v
    JOIN b_matches m USING (match_id) LEFT JOIN d_patches p ON p.set_number = v.set_number AND p.patch = v.patch""", ctes=VIEWS)
def rm_resolve_patch(b):
    texts = ("Version 16.9.633.5272 (x)", "Linux Version 16.10.1 [PUBLIC]", "Unreal Version ?.?.?.?", "Version 15.3.2")
    seen = b.matches.select("match_id", "set_number", F.get(F.array(*map(F.lit, texts)), (F.col("lobby") % 4).cast("int")).alias("game_version"))
    return patches.resolve(seen, d_patches(b)).select("match_id", "patch", "patch_id")


@query("rm_crawl_boundary", "SELECT min(game_datetime) - INTERVAL 12 HOUR AS since FROM b_matches WHERE patch_id IN (SELECT patch_id FROM adv WHERE is_current)", ctes=VIEWS)
def rm_crawl_boundary(b):
    return patches.crawl_boundary(advanced(b).filter("is_current"), b.matches)


@query("rm_selection", """,
o1 AS (SELECT t.*, coalesce(a.patch, t.patch_id::VARCHAR) AS option, row_number() OVER (ORDER BY coalesce(a.is_current, false) DESC, t.boards DESC, t.patch_id) AS place FROM (SELECT patch_id, sum(total_boards)::BIGINT AS boards FROM totals GROUP BY 1) t LEFT JOIN adv a USING (patch_id)),
c1 AS (SELECT * FROM totals WHERE patch_id = (SELECT patch_id FROM o1 WHERE place = 1)),
o2 AS (SELECT *, row_number() OVER (ORDER BY boards DESC, option) AS place FROM (SELECT region AS option, sum(total_boards)::BIGINT AS boards FROM c1 GROUP BY 1)),
o3 AS (SELECT *, row_number() OVER (ORDER BY coalesce(list_position(['challenger', 'master_plus', 'apex_mixed', 'diamond', 'plat_emerald', 'iron_gold', 'all', 'unknown'], option), 9), option) AS place
    FROM (SELECT rank_bucket AS option, sum(total_boards)::BIGINT AS boards FROM c1 WHERE region = (SELECT option FROM o2 WHERE place = 1) GROUP BY 1))
SELECT part, option, boards, place::INT AS place, place = 1 AS chosen FROM (SELECT 'patch' AS part, option, boards, place FROM o1 UNION ALL SELECT 'region', option, boards, place FROM o2 UNION ALL SELECT 'rank', option, boards, place FROM o3)""", ctes=sql() + D_PATCHES, stored=True)
def rm_selection(b):
    totals = stages.totals(b).withColumnRenamed("total_boards", "boards")
    return served.selection(totals, advanced(b))


LINES = """,
it AS (SELECT board_id, unit_row, '+' || string_agg(item_id, '+' ORDER BY slot) AS worn FROM b_items GROUP BY ALL),
ul AS (SELECT u.board_id, string_agg(u.character_id || '*' || u.star_tier || coalesce(it.worn, ''), ' ' ORDER BY u.unit_row) AS units FROM b_units u LEFT JOIN it USING (board_id, unit_row) GROUP BY 1),
tl AS (SELECT board_id, string_agg(trait_id || ':' || num_units, ' ' ORDER BY trait_id) AS traits FROM b_traits GROUP BY 1),
acc AS (SELECT 'P' || c_custkey AS puuid, c_name AS name, CASE WHEN c_acctbal > 5000 THEN 'CHALLENGER' WHEN c_acctbal > 0 THEN 'MASTER' END AS tier, c_acctbal AS lp FROM customer WHERE c_custkey % 5 <> 0),
rec AS (SELECT * FROM (SELECT p.*, m.queue_id, m.game_datetime, row_number() OVER (PARTITION BY p.puuid ORDER BY m.game_datetime DESC, p.match_id, p.board_id) AS place FROM b_players p JOIN b_matches m USING (match_id) WHERE p.puuid <> 'BOT') WHERE place <= 20)"""
PLACED = "CASE WHEN placement = 1 THEN 'first' WHEN placement <= 4 THEN 'top4' ELSE 'bottom' END"
SUMMARY = "count(*)::BIGINT AS games, round(avg(placement), 6) AS avg_placement, round(avg((placement <= 4)::INT), 6) AS top4_rate, round(avg((placement = 1)::INT), 6) AS first_rate"


def accounts(b):
    """Accounts seen before: four players in five."""
    lp = F.col("c_acctbal")
    tier = F.when(lp > 5000, "CHALLENGER").when(lp > 0, "MASTER")
    return b.table("customer").filter("c_custkey % 5 <> 0").select(F.concat(F.lit("P"), "c_custkey").alias("puuid"), F.col("c_name").alias("name"), tier.alias("tier"), lp.alias("lp"))


def with_lines(b, boards, some: bool = False):
    """Boards with their two lines of text; ``some``: parts of other boards are left out first."""
    lines = served.board_lines(b.units, b.items, b.traits, boards.select("board_id") if some else None)
    return boards.join(lines, "board_id", "left")


def recent(b, start=0, count=20):
    games = b.matches.select("match_id", "queue_id", "game_datetime")
    return served.recent(b.players.filter("puuid <> 'BOT'").join(games, "match_id"), start, count)


def rounded(rows):
    return rows.withColumns({n: r6(F.col(n)) for n in ("avg_placement", "top4_rate", "first_rate")})


@query("rm_match", f"{LINES} SELECT p.match_id, p.placement, p.puuid, coalesce(acc.name, substr(p.puuid, 1, 6) || '…') AS name, {PLACED} AS bucket, p.level, m.queue_id, coalesce(units, '') AS units, coalesce(traits, '') AS traits FROM b_players p JOIN b_matches m USING (match_id) LEFT JOIN acc USING (puuid) LEFT JOIN ul USING (board_id) LEFT JOIN tl USING (board_id)")
def rm_match(b):
    """All boards of each match: name, placement and its class, the board itself."""
    boards = b.players.join(b.matches.select("match_id", "queue_id"), "match_id").join(accounts(b), "puuid", "left")
    shown = served.display_name(F.col("name"), F.col("puuid"))
    lines = [F.coalesce(n, F.lit("")).alias(n) for n in ("units", "traits")]
    return with_lines(b, boards).select("match_id", "placement", "puuid", shown.alias("name"), served.placement_bucket(F.col("placement")).alias("bucket"), "level", "queue_id", *lines)


@query("rm_profile", f"{LINES} SELECT rec.puuid, coalesce(acc.name, substr(rec.puuid, 1, 6) || '…') AS name, tier, lp, place::INT AS place, match_id, queue_id, placement, {PLACED} AS bucket, level, coalesce(units, '') AS units, coalesce(traits, '') AS traits FROM rec LEFT JOIN acc USING (puuid) LEFT JOIN ul USING (board_id) LEFT JOIN tl USING (board_id)")
def rm_profile(b):
    """Each player's account, rank and twenty newest matches with their boards."""
    rows = with_lines(b, recent(b), some=True).join(accounts(b), "puuid", "left")
    lines = [F.coalesce(n, F.lit("")).alias(n) for n in ("units", "traits")]
    return rows.select("puuid", served.display_name(F.col("name"), F.col("puuid")).alias("name"), "tier", "lp", "place", "match_id", "queue_id", "placement", served.placement_bucket(F.col("placement")).alias("bucket"), "level", *lines)


@query("rm_profile_vm", f"{LINES} SELECT puuid, upper(left(coalesce(acc.name, puuid), 1)) AS initial, {SUMMARY} FROM rec LEFT JOIN acc USING (puuid) GROUP BY puuid, acc.name")
def rm_profile_vm(b):
    found = served.summary(recent(b), "puuid").join(accounts(b).select("puuid", "name"), "puuid", "left")
    return rounded(found).withColumn("initial", F.upper(F.left(F.coalesce("name", "puuid"), F.lit(1)))).drop("name")


@query("flt_queue_mode", f"{LINES}, md AS (SELECT *, unnest(['all', CASE queue_id WHEN 1100 THEN 'ranked' WHEN 1160 THEN 'double_up' ELSE 'unranked' END]) AS mode FROM rec) SELECT puuid, mode, {SUMMARY} FROM md GROUP BY ALL")
def flt_queue_mode(b):
    """Each player's summary over all recent matches and again by mode."""
    mode = F.explode(F.array(F.lit("all"), served.queue_mode(F.col("queue_id")))).alias("mode")
    return rounded(served.summary(recent(b).select("puuid", "placement", mode), "puuid", "mode"))


@query("src_match_ids", "SELECT puuid, match_id, game_datetime, r::INT AS place FROM (SELECT p.puuid, m.match_id, m.game_datetime, row_number() OVER (PARTITION BY p.puuid ORDER BY m.game_datetime DESC, m.match_id, p.board_id) AS r FROM b_matches m JOIN b_players p USING (match_id) WHERE p.puuid <> 'BOT' AND m.game_datetime >= DATE '1994-01-01') WHERE r BETWEEN 3 AND 7")
def src_match_ids(b, start: int = 2, count: int = 5, since: str = "1994-01-01"):
    """A page of every player's match ids from a start time on."""
    games = b.matches.filter(F.col("game_datetime") >= F.lit(since).cast("date")).select("match_id", "game_datetime")
    return served.recent(b.players.filter("puuid <> 'BOT'").join(games, "match_id"), start, count).select("puuid", "match_id", "game_datetime", "place")


@query("page_slice", """, ld AS (SELECT c_custkey, c_acctbal AS lp, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank, least(2, ceil(count(*) OVER () / 25)) AS page FROM customer),
g AS (SELECT puuid, count(*) AS games, count(*) FILTER (WHERE placement = 1) AS wins FROM b_players GROUP BY 1)
SELECT c_custkey, lp, rank::BIGINT AS rank, page::INT AS page, coalesce(wins, 0)::BIGINT AS wins, round(CASE WHEN games > 0 THEN wins / games ELSE -1 END, 6) AS win_rate FROM ld LEFT JOIN g ON g.puuid = 'P' || c_custkey WHERE rank BETWEEN (page - 1) * 25 + 1 AND page * 25""")
def page_slice(b, number: int = 2, size: int = 25):
    """A page of the ladder with ranks; games are counted for the players on it only."""
    ladder = b.table("customer").select("c_custkey", F.col("c_acctbal").alias("lp"))
    rows = served.page(ladder, [F.desc("lp"), F.asc("c_custkey")], number, size, "ladder").withColumn("puuid", F.concat(F.lit("P"), "c_custkey"))
    played = b.players.join(F.broadcast(rows.select("puuid")), "puuid", "left_semi").groupBy("puuid").agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("placement") == 1).alias("wins"))
    rate = F.when(F.col("games") > 0, F.col("wins") / F.col("games")).otherwise(-1.0)
    return rows.join(played, "puuid", "left").select("c_custkey", "lp", "rank", "page", F.coalesce("wins", F.lit(0)).cast("long").alias("wins"), r6(rate).alias("win_rate"))


RATES = "round(placement_sum / n, 6) AS avg_placement, round(top4_count / n, 6) AS top4_rate, round(win_count / n, 6) AS win_rate"


@query("agg_inspector", f""", mb AS (SELECT gkey, comp_id, sum(n)::BIGINT AS n, sum(placement_sum) AS placement_sum, sum(top4_count) AS top4_count, sum(win_count) AS win_count FROM keyed WHERE gkey LIKE 'm:%' GROUP BY ALL HAVING max(n) >= 3),
gr AS (SELECT gkey, count(*) AS members, sum(n)::BIGINT AS group_boards, sum(placement_sum) / sum(n) AS a, sum(top4_count) / sum(n) AS t, sum(win_count) / sum(n) AS w FROM mb GROUP BY 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY gkey ORDER BY n DESC, comp_id) AS place FROM mb)
SELECT gkey, comp_id, n AS boards, {RATES}, place::BIGINT AS place, place = 1 AS representative, members, group_boards, round(a, 6) AS group_avg_placement, round(t, 6) AS group_top4_rate, round(w, 6) AS group_win_rate FROM pl JOIN gr USING (gkey)""", ctes=sql(), stored=True, merged=True)
def agg_inspector(b):
    """Groups with their members: rates of each, its place, and what all have together."""
    found = served.inspector(stages.keyed(b), b.config.tier_min_sample)
    return found.withColumns({c: r6(F.col(c)) for c in found.columns if c.endswith(("_rate", "_placement"))}).withColumn("place", F.col("place").cast("long"))


OPS = """hi AS (SELECT max(ts) AS now, date_trunc('minute', max(ts)) AS last FROM events),
cl AS (SELECT date_trunc('minute', ts) AS minute, event_type AS method, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, max(ts) AS seen FROM events, hi WHERE ts >= last - INTERVAL 59 MINUTE GROUP BY ALL),
se AS (SELECT c.minute, coalesce(sum(requests), 0) AS requests, coalesce(sum(errors), 0) AS errors FROM (SELECT unnest(generate_series(last - INTERVAL 59 MINUTE, last, INTERVAL 1 MINUTE)) AS minute FROM hi) c LEFT JOIN cl USING (minute) GROUP BY 1)"""


@query("rm_ops", """SELECT 'total' AS part, 'calls' AS key, sum(requests)::BIGINT AS requests, sum(errors)::BIGINT AS errors, NULL::TIMESTAMP AS seen, NULL::BOOLEAN AS stale FROM se
UNION ALL SELECT 'total', 'peak', max(requests)::BIGINT, NULL, NULL, NULL FROM se
UNION ALL SELECT 'total', 'methods', count(DISTINCT method)::BIGINT, NULL, NULL, NULL FROM cl
UNION ALL SELECT 'minute', strftime(minute, '%Y-%m-%d %H:%M'), requests::BIGINT, errors::BIGINT, NULL, NULL FROM se
UNION ALL SELECT 'method', method, sum(requests)::BIGINT, sum(errors)::BIGINT, max(seen), NULL FROM cl GROUP BY method
UNION ALL SELECT 'health', event_type, NULL, NULL, max(ts) FILTER (WHERE value > 50), coalesce(max(ts) FILTER (WHERE value > 50) < (SELECT now FROM hi) - INTERVAL 60 MINUTE, true) FROM events GROUP BY event_type
UNION ALL (SELECT 'job', event_id || ' ' || event_type, NULL, NULL, ts, coalesce(value <= 50, true) FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)""", ctes=OPS)
def rm_ops(b):
    """Usage, methods, health and newest jobs as one table; an event is a call, and a job that its value says is done."""
    calls = b.events.select("ts", F.col("event_type").alias("method"), (F.col("event_type") == "error").alias("rejected"))
    jobs = b.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("job"), "ts", F.coalesce(F.col("value") > 50, F.lit(False)).alias("done"))
    return served.operations(calls, jobs)


@query("fn_item_stats", """SELECT p_partkey, concat_ws('|', CASE WHEN p_size < 10 THEN 'Attack Damage +' || p_size * 10 || '%' ELSE 'Attack Damage +' || p_size || '%' END,
    CASE WHEN p_partkey % 3 = 0 THEN 'Ability Power +' || p_size END, 'Health +' || CASE WHEN p_partkey % 2 = 0 THEN 10 * p_size ELSE 7 END, CASE WHEN p_size % 4 <> 0 THEN 'Omnivamp +' || p_size % 4 || '%' END) AS stats FROM part""", ctes="one AS (SELECT 1)")
def fn_item_stats(b):
    """Stats of an item from its effects: shares, whole per cents, points, zeros, a label met twice, effects that are no stats."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("double")
    pairs = {"AD": F.when(n < 10, n / 10).otherwise(n), "AP": F.when(k % 3 == 0, n), "Health": F.when(k % 2 == 0, 10 * n), "HealthMax": F.lit(7.0), "StatOmnivamp": n % 4, "HealthThreshold": F.lit(0.5)}
    effects = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*(v.cast("double") for v in pairs.values())))
    lines = F.transform(codecs.item_stats(effects), lambda x: F.concat_ws(" ", x["label"], x["value"]))
    return b.dealt("part", "p_partkey", "p_size").select("p_partkey", F.array_join(lines, "|").alias("stats"))


@query("mig_clear_flag", "SELECT patch_id, is_current AND EXISTS (SELECT 1 FROM d_units u WHERE u.set_number = p.set_number) AS is_current, is_current AND NOT EXISTS (SELECT 1 FROM d_units u WHERE u.set_number = p.set_number) AS changed FROM d_patches p", ctes=VIEWS)
def mig_clear_flag(b):
    return patches.cleared(d_patches(b), b.d_units).select("patch_id", "is_current", "changed")


@query("mig_relabel", """, tb AS (SELECT 'boards' AS name, rank_bucket FROM b_players UNION ALL SELECT 'stats', rank_bucket FROM stats UNION ALL SELECT 'totals', rank_bucket FROM totals
    UNION ALL SELECT 'trends', rank_bucket FROM (SELECT gkey, patch_id, region, rank_bucket FROM keyed GROUP BY ALL HAVING sum(n) >= 2) UNION ALL SELECT 'tiers', rank_bucket FROM stats WHERE comp_id % 97 = 0)
SELECT name, CASE rank_bucket WHEN 'challenger' THEN 'apex_mixed' ELSE rank_bucket END AS rank_bucket, count(*)::BIGINT AS rows FROM tb GROUP BY ALL""", ctes=sql(), stored=True)
def mig_relabel(b):
    """One bucket of five tables renamed; rows by table and bucket after that."""
    stats = stages.stats(b)
    tables = {"boards": b.players, "stats": stats, "totals": stages.totals(b), "trends": agg_trend_snapshot(b), "tiers": stats.filter("comp_id % 97 = 0")}
    counts = [rows.groupBy("rank_bucket").agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(name)) for name, rows in served.relabelled(tables, "rank_bucket", "challenger", "apex_mixed").items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionAll(more)
    return out


@query("src_account", """SELECT upper(c_name) AS name, 'T' || c_nationkey AS tag, CASE route WHEN 'sea' THEN 'asia' ELSE route END AS host, CASE WHEN c_custkey % 5 <> 0 THEN 'P' || c_custkey END AS puuid FROM a""", ctes="""a AS (SELECT *, CASE c_nationkey % 4 WHEN 0 THEN 'americas' WHEN 1 THEN 'europe' WHEN 2 THEN 'asia' ELSE 'sea' END AS route FROM customer)""")
def src_account(b):
    """Names asked for in capitals, sought among the accounts seen before."""
    platform = F.get(F.array(*map(F.lit, ("na1", "euw1", "kr", "oc1"))), (F.col("c_nationkey") % 4).cast("int"))
    people = b.table("customer").withColumns({"tag": F.concat(F.lit("T"), F.col("c_nationkey")), "route": codecs.route(platform)})
    seen = people.filter("c_custkey % 5 <> 0").withColumn("route", F.when(F.col("route") == "sea", "asia").otherwise(F.col("route")))
    accounts = seen.select(F.concat(F.lit("P"), "c_custkey").alias("puuid"), F.col("c_name").alias("name"), F.lower("tag").alias("tag"), "route")
    return served.find_accounts(people.select(F.upper("c_name").alias("name"), "tag", "route"), accounts).select("name", "tag", "host", "puuid")


@query("src_league", f"{LINES} SELECT tier, puuid, lp, row_number() OVER (PARTITION BY tier ORDER BY lp DESC, puuid) AS place FROM acc WHERE tier IN ('CHALLENGER', 'MASTER')")
def src_league(b):
    """The ladders of the tiers above all divisions."""
    return served.ladders(accounts(b), ("CHALLENGER", "GRANDMASTER", "MASTER")).select("tier", "puuid", "lp", F.col("place").cast("long").alias("place"))
