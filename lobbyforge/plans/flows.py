"""Queries of limits, frontier, persistence and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import frontier
from ..sources import persist, store
from ..sources.matches import MATCH
from ..streaming import limits
from ..streaming.usage import arrivals
from . import stages
from .core import joined
from .ops import NONE
from .stages import sql
from .storage import documents

ALL = sql()
HOUR = 3_600_000_000
#: Two windows at once over a user's calls, some 66 in thirty days.
USER_WINDOWS = ((2, 24 * HOUR), (5, 72 * HOUR))


def calls(b):
    """Events as calls of users: purchases first, errors last."""
    priority = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "error", 0).otherwise(1)
    return b.events.select(F.col("user_id").cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"), priority.alias("priority"))


@query("st_sliding_window_limit")
def st_sliding_window_limit(b, windows=USER_WINDOWS):
    """When each call passes a sliding log with two windows: by priority, then by arrival; as a stream in three turns."""
    rows = calls(b)
    span = b.events.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    share = (F.unix_micros("ts") - F.unix_micros(F.lit(span["a"]).cast("timestamp"))) / F.greatest(F.lit(1), F.unix_micros(F.lit(span["z"]).cast("timestamp")) - F.unix_micros(F.lit(span["a"]).cast("timestamp")) + 1)
    return limits.admitted(arrivals(b.spark, rows, F.floor(share * 3), 3), windows)


WINDOW_SQL = """w AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS key_k, row_number() OVER (PARTITION BY floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS all_k,
    3600 - floor(epoch(ts))::BIGINT % 3600 AS left_s FROM events), v AS (SELECT *, CASE WHEN key_k > 1 THEN 'ip' WHEN all_k > 12 THEN 'global' END AS scope FROM w)"""


@query("st_fixed_window_limit", "SELECT event_id, scope IS NULL AS ok, scope, CASE WHEN scope IS NULL THEN 0 ELSE left_s END AS retry_after FROM v", ctes=WINDOW_SQL)
def st_fixed_window_limit(b, per_key: int = 1, everyone: int = 12, seconds: int = 3600):
    """Verdict of each call, which limit rejects it, and the seconds until the next window."""
    return limits.fixed_windows(calls(b), per_key, everyone, seconds)


#: A pass small enough to end within the test tables' accounts.
PASS = frontier.Budgets(tiers=("CHALLENGER", "MASTER"), accounts=80, overselect=6, explore=15, match_fetches=300, matches_each=5, recrawl_hours=12, tier_hours=24, out_of_scope_hours=168)


def accounts(b):
    """Customers as accounts: their last event is when they were crawled, the one before when their tier was looked up."""
    seen = b.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.min("ts").alias("first"))
    segment, key = F.col("c_mktsegment"), F.col("c_custkey")
    tier = F.when(segment == "BUILDING", "Challenger").when(segment == "MACHINERY", "MASTER").when(segment == "AUTOMOBILE", "GOLD").when(segment == "FURNITURE", "DIAMOND")
    found = F.when(key % 10 == 0, "GOLD").when(tier.isNull(), F.when(key % 3 == 0, "CHALLENGER")).otherwise(tier)
    return b.table("customer").join(seen, key == F.col("user_id"), "left").select(
        key.alias("id"), tier.alias("tier"), F.when(key % 2 == 0, F.col("last")).otherwise(F.col("first")).alias("tier_checked_at"), F.col("last").alias("last_crawled_at"), found.alias("found_tier"), (key % 8).cast("int").alias("available"))


DRAIN_SQL = """seen AS (SELECT user_id, max(ts) AS last, min(ts) AS first FROM events GROUP BY 1), now AS (SELECT max(ts) AS t FROM events),
acc AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'CHALLENGER' WHEN 'MACHINERY' THEN 'MASTER' WHEN 'AUTOMOBILE' THEN 'GOLD' WHEN 'FURNITURE' THEN 'DIAMOND' END AS tier,
    CASE WHEN c_custkey % 2 = 0 THEN last ELSE first END AS checked, last, c_custkey % 8 AS available FROM customer LEFT JOIN seen ON user_id = c_custkey),
fnd AS (SELECT *, CASE WHEN id % 10 = 0 THEN 'GOLD' WHEN tier IS NULL THEN CASE WHEN id % 3 = 0 THEN 'CHALLENGER' END ELSE tier END AS found FROM acc),
cand AS (SELECT *, coalesce(tier IN ('CHALLENGER', 'MASTER'), false) AS good, tier IS NULL AS unknown, coalesce(checked > t - CASE WHEN tier IN ('CHALLENGER', 'MASTER') THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END, false) AS fresh FROM fnd, now WHERE last IS NULL OR last < t - INTERVAL 12 HOUR),
placed AS (SELECT *, row_number() OVER o AS place, sum(CASE WHEN unknown AND NOT fresh THEN 1 ELSE 0 END) OVER o AS blind_k FROM cand WINDOW o AS (ORDER BY good DESC, unknown DESC, last NULLS FIRST, id)),
acts AS (SELECT *, unknown AND NOT fresh AND blind_k > 15 AS waits, NOT (unknown AND NOT fresh AND blind_k > 15) AND coalesce(CASE WHEN fresh THEN tier ELSE found END IN ('CHALLENGER', 'MASTER'), false) AS fetches FROM placed WHERE place <= 480),
want AS (SELECT *, CASE WHEN fetches THEN least(available, 5) ELSE 0 END AS wanted FROM acts),
spend AS (SELECT *, sum(CASE WHEN wanted > 0 THEN 1 ELSE 0 END) OVER (ORDER BY place)::BIGINT AS enqueued, sum(wanted) OVER (ORDER BY place)::BIGINT - wanted AS before FROM want)"""


@query("st_frontier_drain", """SELECT id, place, CASE WHEN waits THEN 'waits' WHEN NOT fetches THEN 'out_of_scope' WHEN available = 0 THEN 'nothing_new' ELSE 'fetch' END AS action, NOT fresh AND NOT waits AS lookup, least(wanted, 300 - before)::BIGINT AS matches, enqueued,
    (before + least(wanted, 300 - before))::BIGINT AS spent FROM spend WHERE enqueued - CASE WHEN wanted > 0 THEN 1 ELSE 0 END < 80 AND before < 300""", ctes=DRAIN_SQL)
def st_frontier_drain(b, budgets=PASS):
    """What a pass does with the accounts it comes to before its budgets are spent."""
    now = b.events.agg(F.max("ts").alias("now"))
    return frontier.drain(accounts(b), now, budgets)


@query("prj_tier_fresh", "SELECT id, coalesce(checked > t - CASE WHEN tier IN ('CHALLENGER', 'MASTER') THEN INTERVAL 24 HOUR ELSE INTERVAL 168 HOUR END, false) AS fresh FROM acc, now", ctes=DRAIN_SQL)
def prj_tier_fresh(b, budgets=PASS):
    """Whether each account's tier still holds, by how long its class lasts."""
    now = b.events.agg(F.max("ts").alias("now"))
    return accounts(b).crossJoin(F.broadcast(now)).select("id", frontier.tier_fresh(budgets).alias("fresh"))  # one row


@query("st_release", "SELECT id, t - INTERVAL 12 HOUR + INTERVAL 15 MINUTE AS last_crawled_at FROM acc, now WHERE id IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)", ctes=DRAIN_SQL)
def st_release(b, budgets=PASS):
    """Accounts that failed within the last hour are offered again soon."""
    now = b.events.agg(F.max("ts").alias("now"))
    failed = b.events.filter("event_type = 'error'").crossJoin(F.broadcast(now)).filter(F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 HOUR"))  # one row
    ids = failed.select(F.col("user_id").alias("id")).distinct()
    return accounts(b).join(ids, "id", "left_semi").crossJoin(F.broadcast(now)).select("id", frontier.released(budgets).alias("last_crawled_at"))


@query("st_frontier_expand", "SELECT puuid, min(level) AS level FROM r GROUP BY 1", ctes="RECURSIVE " + stages.BOARDS_SQL + """, e AS (SELECT DISTINCT match_id, puuid FROM b_players WHERE puuid <> 'BOT'),
nb AS (SELECT DISTINCT a.puuid AS a, z.puuid AS z FROM e a JOIN e z USING (match_id)), r(puuid, level) AS (SELECT DISTINCT puuid, 0 FROM e WHERE puuid LIKE 'P%1' AND length(puuid) <= 3 UNION SELECT nb.z, r.level + 1 FROM r JOIN nb ON nb.a = r.puuid WHERE r.level < 12)""")
def st_frontier_expand(b):
    """The round in which each player is found from a few, until a round finds none."""
    boards = b.players.filter("puuid <> 'BOT'").select("match_id", "puuid")
    return frontier.reach(boards, boards.filter(F.col("puuid").like("P%1") & (F.length("puuid") <= 3)))


PERSISTED = """SELECT 'matches' AS kind, match_id AS id, '' AS item, region || '|' || queue_id || '|' || set_number || '|' || player_count AS value FROM (SELECT *, split_part(match_id, '_', 1) AS region FROM (SELECT * EXCLUDE (region) FROM b_matches))
    UNION ALL SELECT 'participants', bid, match_id || '#' || puuid, placement || '|' || level FROM pp
    UNION ALL SELECT 'units', bid, u.character_id || '#' || (row_number() OVER (PARTITION BY board_id, u.character_id ORDER BY u.unit_row) - 1), u.star_tier || '|' || coalesce(u.names, '') || '|' || CASE WHEN u.character_id = cy.carry AND u.n > 0 THEN 'carry' ELSE '' END FROM pp JOIN uu u USING (board_id) JOIN cy USING (board_id)
    UNION ALL SELECT 'traits', bid, trait_id, num_units || '|' || least(4, num_units // 2) FROM pp JOIN b_traits USING (board_id)
    UNION ALL SELECT 'augments', bid, '1', 'A' || (board_id % 5) FROM pp UNION ALL SELECT 'augments', bid, '2', 'A' || (board_id % 7) FROM pp
    UNION ALL SELECT 'outcomes:' || t.n, match_id, '', CASE WHEN t.n > lobby % 3 THEN 'skipped' WHEN queue_id = 1100 THEN 'stored' ELSE 'meta-only' END FROM b_matches JOIN (VALUES (0), (1), (2)) AS t(n) ON t.n = lobby % 3 OR (t.n = 2 AND lobby % 3 = 0)"""
PERSIST_CTES = stages.BOARDS_SQL + """, uu AS (SELECT u.board_id, u.unit_row, u.character_id, u.star_tier, d.cost, string_agg(i.item_id, ' ' ORDER BY i.slot) AS names, count(i.item_id) AS n FROM b_units u LEFT JOIN b_items i USING (board_id, unit_row) LEFT JOIN d_units d ON d.character_id = u.character_id GROUP BY ALL),
cy AS (SELECT board_id, character_id AS carry FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY n DESC, cost DESC, unit_row) AS r FROM uu) WHERE r = 1),
pp AS (SELECT *, ('0x' || substr(md5(match_id || '#' || puuid), 1, 15))::BIGINT::VARCHAR AS bid FROM (SELECT p.*, row_number() OVER (PARTITION BY p.match_id, puuid ORDER BY placement) AS r FROM b_players p JOIN b_matches m USING (match_id) WHERE m.queue_id = 1100 AND puuid <> 'BOT') WHERE r = 1)"""


def persisted(b, times: int = 2):
    """The tables after documents came in three turns, the first once more in the last, and each batch was run twice."""
    spark, folder, out = b.spark, store.new_path(b.spark, "arrivals"), store.new_path(b.spark, "persisted")
    for k in range(3):
        documents(b, F.col("lobby") % 3 == k, f"{folder}/{k}")
        if k == 2:  # lines as they are
            spark.read.text(f"{folder}/0").write.mode("append").text(f"{folder}/{k}", compression="gzip")
        persist.persist_stream(spark.readStream.schema(MATCH).option("recursiveFileLookup", True).json(folder), times, out)
    return out


@query("sink_match_persist", PERSISTED, ctes=PERSIST_CTES)
def sink_match_persist(b):
    """Rows of every table that a stream of match documents fills."""
    path = persisted(b)
    read = lambda name: b.spark.read.parquet(f"{path}/{name}")
    row = lambda df, kind, key, item, value: df.select(kind.alias("kind"), F.col(key).cast("string").alias("id"), item.cast("string").alias("item"), value.alias("value"))
    bar = lambda *c: F.concat_ws("|", *c)
    out = row(read("matches"), F.lit("matches"), "match_id", F.lit(""), bar("region", "queue_id", "set_number", "player_count"))
    for more in (
        row(read("participants"), F.lit("participants"), "id", F.concat_ws("#", "match_id", "puuid"), bar("placement", "level")),
        row(read("units"), F.lit("units"), "id", F.concat_ws("#", "character_id", "copy_index"), bar("star_tier", F.array_join("item_ids", " "), F.when(F.col("is_carry"), "carry").otherwise(""))),
        row(read("traits"), F.lit("traits"), "id", F.col("name"), bar("num_units", "style")),
        row(read("augments"), F.lit("augments"), "id", F.col("slot"), F.col("augment_id")),
        row(read("outcomes"), F.concat(F.lit("outcomes:"), F.col("batch")), "match_id", F.lit(""), F.col("outcome")),
    ):
        out = out.unionByName(more)
    return out


@query("sink_insert_returning", "SELECT match_id, puuid, bid::BIGINT AS id, (SELECT count(*) FROM uu WHERE uu.board_id = pp.board_id) AS units FROM pp WHERE board_id // 8 % 4 <> 0", ctes=PERSIST_CTES)
def sink_insert_returning(b):
    """Boards that are new to a table, with the ids under which their children are inserted in the same pass."""
    docs = documents(b)
    known = b.matches.filter("lobby % 4 = 0").select(F.col("match_id").alias("_known"))
    tables = persist.shaped(docs.join(known, F.col("metadata.match_id") == F.col("_known"), "left_anti"))
    children = tables["units"].groupBy("id").agg(F.count(F.lit(1)).alias("units"))
    return tables["participants"].join(children, "id", "left").select("match_id", "puuid", "id", F.coalesce("units", F.lit(0)).cast("long").alias("units"))


PRUNE = """, kept AS (SELECT DISTINCT comp_id FROM clustered WHERE comp_id IS NOT NULL AND board_id % 5 <> 0)
SELECT 'comps' AS name, comp_id, count(*)::BIGINT AS rows FROM (SELECT DISTINCT comp_id FROM clustered WHERE comp_id IS NOT NULL) JOIN kept USING (comp_id) GROUP BY ALL
UNION ALL SELECT 'stats', comp_id, count(*)::BIGINT FROM stats JOIN kept USING (comp_id) GROUP BY ALL
UNION ALL SELECT 'trends', comp_id, count(*)::BIGINT FROM (SELECT DISTINCT comp_id, patch_id, region, rank_bucket, CAST(game_datetime AS DATE) AS day FROM clustered) JOIN kept USING (comp_id) GROUP BY ALL"""


@query("sink_prune_orphans", PRUNE, ctes=ALL)
def sink_prune_orphans(b):
    """Every fifth board is gone: comps without a board go, and their statistics and snapshots with them."""
    boards = stages.clustered(b).filter("comp_id IS NOT NULL")
    comps = boards.select("comp_id").distinct()
    trends = boards.select("comp_id", "patch_id", "region", "rank_bucket", F.to_date("game_datetime").alias("day")).distinct()
    left = persist.prune_cascade(comps, boards.filter("board_id % 5 <> 0"), {"stats": stages.stats(b), "trends": trends}, "comp_id")
    out = None
    for name, rows in left.items():
        counts = rows.groupBy("comp_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name or "comps").alias("name"), "comp_id", "rows")
        out = counts if out is None else out.unionByName(counts)
    return out


@query("sink_retention", "SELECT match_id, month FROM (SELECT match_id, strftime(game_datetime, '%Y-%m-01') AS month FROM b_matches) WHERE month >= (SELECT strftime(max(game_datetime) - INTERVAL 90 DAY, '%Y-%m-01') FROM b_matches)")
def sink_retention(b):
    """Snapshots by month: those before the month that lies ninety days back are dropped as folders; no other file changes."""
    rows = b.matches.select("match_id", F.date_format("game_datetime", "yyyy-MM-01").alias("month"))
    path = store.new_path(b.spark, "snapshots")
    rows.repartition("month").write.partitionBy("month").parquet(path)
    since = b.matches.agg(F.date_format(F.max("game_datetime") - F.expr("INTERVAL 90 DAYS"), "yyyy-MM-01").alias("d")).first()["d"]
    persist.drop_partitions(b.spark, path, "month", since)
    return b.spark.read.schema("match_id string, month string").parquet(path).select("match_id", "month")
