"""Queries of operations and time: usage, calendars, job health, change logs, version order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from .core import r6

NONE = "unused AS (SELECT 1 AS one)"


def usage(b):
    """Events as calls: the type is the method, errors are rejections, users deal to regions."""
    return b.events.select("event_id", "ts", F.col("event_type").alias("method"), (F.col("event_type") == "error").alias("rejected"), (F.col("user_id") % 4).alias("region"))


@query("agg_usage_minute", "SELECT date_trunc('minute', ts) AS minute, count(*)::BIGINT AS requests, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS rejected FROM events GROUP BY 1", ctes=NONE)
def agg_usage_minute(b):
    return usage(b).groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("requests"), F.count_if("rejected").alias("rejected"))


@query("agg_usage_method", "SELECT event_type AS method, count(*)::BIGINT AS requests, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS rejected, max(ts) AS last_seen FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE GROUP BY 1", ctes=NONE)
def agg_usage_method(b):
    last = b.events.agg((F.max("ts") - F.expr("INTERVAL 60 MINUTES")).alias("since"))
    recent = usage(b).join(F.broadcast(last), F.col("ts") >= F.col("since"))
    return recent.groupBy("method").agg(F.count(F.lit(1)).alias("requests"), F.count_if("rejected").alias("rejected"), F.max("ts").alias("last_seen"))


CALENDAR = """m AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1), w AS (SELECT max(minute) AS hi FROM m)
SELECT c.minute, coalesce(m.n, 0)::BIGINT AS requests FROM (SELECT unnest(generate_series(hi - INTERVAL 59 MINUTE, hi, INTERVAL 1 MINUTE)) AS minute FROM w) c LEFT JOIN m USING (minute)"""


@query("join_left_calendar", CALENDAR.split("\nSELECT", 1)[1].join(["SELECT", ""]), ctes=CALENDAR.split("\nSELECT", 1)[0])
def join_left_calendar(b):
    minutes = b.events.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    span = b.events.agg(F.date_trunc("minute", F.max("ts")).cast("timestamp_ntz").alias("hi"))
    series = span.select(F.explode(F.sequence(F.col("hi") - F.expr("INTERVAL 59 MINUTES"), F.col("hi"), F.expr("INTERVAL 1 MINUTE"))).alias("minute"))
    return series.join(minutes, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("requests"))


@query("agg_job_health", """SELECT event_type AS job, max(ts) FILTER (WHERE value > 50) AS last_success, max(ts) FILTER (WHERE value > 50) < (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE AS stale FROM events GROUP BY 1""", ctes=NONE)
def agg_job_health(b):
    now = F.broadcast(b.events.agg(F.max("ts").alias("now")))
    last = b.events.groupBy(F.col("event_type").alias("job")).agg(F.max(F.when(F.col("value") > 50, F.col("ts"))).alias("last_success"))
    return last.join(now, F.lit(True)).select("job", "last_success", (F.col("last_success") < F.col("now") - F.expr("INTERVAL 60 MINUTES")).alias("stale"))


@query("ops_reconcile_jobs", "SELECT event_id, CASE WHEN event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'done' END AS status FROM events", ctes=NONE)
def ops_reconcile_jobs(b):
    now = F.broadcast(b.events.agg(F.max("ts").alias("now")))
    stuck = F.col("ts") < F.col("now") - F.expr("INTERVAL 30 MINUTES")
    running = F.col("event_type") == "view"
    return b.events.join(now, F.lit(True)).select("event_id", F.when(running & stuck, "failed").when(running, "running").otherwise("done").alias("status"))


@query("ops_scope_reconcile", "SELECT c_custkey, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'dropped' WHEN c_acctbal < 0 THEN 'retried' ELSE 'kept' END AS outcome FROM customer", ctes=NONE)
def ops_scope_reconcile(b):
    scope = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    return b.table("customer").select("c_custkey", F.when(~scope, "dropped").when(F.col("c_acctbal") < 0, "retried").otherwise("kept").alias("outcome"))


@query("latest_row", "SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", ctes=NONE)
def latest_row(b):
    newest = b.events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return newest.select("user_id", "e.event_id", "e.ts", "e.event_type")


@query("sink_change_log", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type", ctes=NONE)
def sink_change_log(b):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return b.events.withColumn("_b", before).filter(~F.col("_b").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("sort_multi_key", "SELECT c_custkey, row_number() OVER (ORDER BY (c_mktsegment = 'BUILDING') DESC, (c_acctbal > 5000) DESC, nullif(c_nationkey, 3) NULLS FIRST, c_custkey) AS position FROM customer ORDER BY position LIMIT 25", ctes=NONE)
def sort_multi_key(b):
    c = b.table("customer")
    key = [(F.col("c_mktsegment") == "BUILDING").desc(), (F.col("c_acctbal") > 5000).desc(), F.nullif("c_nationkey", F.lit(3)).asc_nulls_first(), F.col("c_custkey").asc()]
    first = c.orderBy(*key).limit(25)  # a top-k of each task, then of those
    return first.select("c_custkey", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*key)).cast("long").alias("position"))


@query("sort_nulls", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7) NULLS FIRST, p_name, p_partkey) AS up, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 7) DESC NULLS LAST, p_name, p_partkey) AS down FROM part", ctes=NONE)
def sort_nulls(b):
    size = F.nullif("p_size", F.lit(7))
    own = Window.partitionBy("p_brand")
    up, down = own.orderBy(size.asc_nulls_first(), "p_name", "p_partkey"), own.orderBy(size.desc_nulls_last(), "p_name", "p_partkey")
    return b.table("part").select("p_partkey", F.row_number().over(up).cast("long").alias("up"), F.row_number().over(down).cast("long").alias("down"))


@query("sort_numeric_version", """v AS (SELECT DISTINCT year(o_orderdate) - 1980 AS a, month(o_orderdate) AS b FROM orders), p AS (SELECT a || '.' || b AS patch FROM v UNION ALL SELECT '17.0')
SELECT patch, row_number() OVER (ORDER BY (patch <> '17.0') DESC, split_part(patch, '.', 1)::INT DESC, split_part(patch, '.', 2)::INT DESC) AS position FROM p""".split("\nSELECT", 1)[1].join(["SELECT", ""]),
    ctes="v AS (SELECT DISTINCT year(o_orderdate) - 1980 AS a, month(o_orderdate) AS b FROM orders), p AS (SELECT a || '.' || b AS patch FROM v UNION ALL SELECT '17.0')")
def sort_numeric_version(b):
    patch = F.concat_ws(".", (F.year("o_orderdate") - 1980).cast("string"), F.month("o_orderdate").cast("string"))
    patches = b.table("orders").select(patch.alias("patch")).distinct().union(b.spark.createDataFrame([("17.0",)], "patch string"))
    part = lambda i: F.split_part("patch", F.lit("."), F.lit(i)).try_cast("int").desc()
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("patch") != "17.0").desc(), part(1), part(2))
    return patches.withColumn("position", F.row_number().over(order).cast("long"))


@query("top_k", "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3", ctes=NONE)
def top_k(b):
    order = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return b.table("part").withColumn("_r", F.row_number().over(order)).filter("_r <= 3").select("p_brand", "p_partkey", "p_retailprice")


@query("top_k_two_sort", "t AS (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10) SELECT *, row_number() OVER (ORDER BY p_size, p_partkey) AS position FROM t".split(") SELECT", 1)[1].join(["SELECT", ""]),
    ctes="t AS (SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10)")
def top_k_two_sort(b):
    best = b.table("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10).select("p_partkey", "p_size", "p_retailprice")
    return best.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p_size", "p_partkey")).cast("long"))


@query("top_1_group", "SELECT c_mktsegment, sum(c_acctbal) > 0 AS positive, count(*)::BIGINT AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 1", ctes=NONE)
def top_1_group(b):
    return b.table("customer").groupBy("c_mktsegment").agg((F.sum("c_acctbal") > 0).alias("positive"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(1)



@query("sort_custom_order", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END AS place FROM customer", ctes=NONE)
def sort_custom_order(b):
    order = ("MACHINERY", "BUILDING", "AUTOMOBILE")
    place = F.lit(len(order))
    for i, name in enumerate(order):
        place = F.when(F.col("c_mktsegment") == name, i).otherwise(place)
    return b.table("customer").select("c_custkey", place.alias("place"))


@query("dedupe_first", "SELECT p_brand, p_partkey, p_type FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY (p_type LIKE '%STEEL') DESC, p_partkey) AS r FROM part) WHERE r = 1", ctes=NONE)
def dedupe_first(b):
    order = Window.partitionBy("p_brand", "p_size").orderBy(F.col("p_type").endswith("STEEL").desc(), "p_partkey")
    return b.table("part").withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("p_brand", "p_partkey", "p_type")


@query("agg_profile_summary", "SELECT puuid, count(*)::BIGINT AS games, round(avg(placement), 6) AS avg_placement, round(avg(CASE WHEN placement <= 4 THEN 1 ELSE 0 END), 6) AS top4_rate, round(avg(CASE WHEN placement = 1 THEN 1 ELSE 0 END), 6) AS first_rate FROM b_players WHERE puuid <> 'BOT' GROUP BY 1")
def agg_profile_summary(b):
    mean = lambda c: r6(F.avg(c.cast("double")))
    p = F.col("placement")
    return b.players.filter("puuid <> 'BOT'").groupBy("puuid").agg(F.count(F.lit(1)).alias("games"), mean(p).alias("avg_placement"), mean(p <= 4).alias("top4_rate"), mean(p == 1).alias("first_rate"))


@query("flt_recrawl", "SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) WHERE last < (SELECT max(ts) FROM events) - INTERVAL 12 HOUR", ctes=NONE)
def flt_recrawl(b):
    now = F.broadcast(b.events.agg(F.max("ts").alias("now")))
    last = b.events.groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.join(now, F.col("last") < F.col("now") - F.expr("INTERVAL 12 HOURS")).select("user_id")


@query("st_usage_tumble", "SELECT date_trunc('minute', ts) AS minute, event_type AS method, (user_id % 4)::BIGINT AS region, count(*)::BIGINT AS requests FROM events GROUP BY ALL", ctes=NONE)
def st_usage_tumble(b):
    """As a stream: one-minute windows, additive, read until the source is drained."""
    from ..streaming.usage import event_stream, latest_by_key, usage_counts

    counts = latest_by_key(usage_counts(event_stream(b.spark, b.folder)), ["window", "method", "region"])
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "method", "region", "requests")


@query("st_dedupe", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type", ctes=NONE)
def st_dedupe(b):
    """First event of each user and type, as a stream."""
    from ..streaming.usage import event_stream, first_seen

    return first_seen(event_stream(b.spark, b.folder), ["user_id", "event_type"], "event_id")


@query("st_self_heal", "SELECT match_id, coalesce(CASE WHEN lobby % 5 <> 0 THEN player_count END, player_count)::BIGINT AS player_count FROM b_matches")
def st_self_heal(b):
    stored = b.matches.select("match_id", F.when(F.col("lobby") % 5 != 0, F.col("player_count")).alias("stored"))
    missing = stored.filter("stored IS NULL").select("match_id")
    counted = b.players.join(missing, "match_id", "left_semi").groupBy("match_id").agg(F.count_if(F.col("puuid") != "BOT").alias("counted"))
    return stored.join(counted, "match_id", "left").select("match_id", F.coalesce("stored", "counted").cast("long").alias("player_count"))
