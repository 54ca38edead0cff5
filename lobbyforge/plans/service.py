"""Queries of the service around the engine: jobs, queues, retries, caches, texts and tokens, over tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import codecs, service
from ..operators import jobs
from ..sources import store
from .ops import NONE


@query("sink_job_log", """SELECT event_id, event_type AS job, CASE WHEN event_type = 'view' THEN 'running' WHEN value < 5 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN event_type = 'view' OR value < 5 THEN 0 ELSE floor(value)::BIGINT END AS items, CASE WHEN event_type <> 'view' AND value < 5 THEN 1 ELSE 0 END AS errors FROM events""", ctes=NONE)
def sink_job_log(b):
    """Every run is logged as running when it begins and once more when it ends; a crash leaves it running."""
    runs = b.events.select("event_id", F.col("event_type").alias("job"), "value")
    begun = runs.select("event_id", "job", F.lit("running").alias("status"), F.lit(0).cast("long").alias("items"), F.lit(0).alias("errors"))
    failed = F.col("value") < 5
    ended = runs.filter("job <> 'view'").select("event_id", "job", F.when(failed, "failed").otherwise("success").alias("status"), F.when(failed, 0).otherwise(F.floor("value")).cast("long").alias("items"), failed.cast("int").alias("errors"))
    return store.saved(store.upsert(store.saved(begun, "job_log"), ended, ["event_id"]), "job_log")


QUEUE = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'active' ELSE 'done' END"


@query("ops_reset_queue", f"SELECT event_id, state FROM (SELECT *, {QUEUE} AS state, max(ts) OVER () AS now FROM events) WHERE state = 'done' OR (state = 'active' AND ts >= now - INTERVAL 1 DAY)", ctes=NONE)
def ops_reset_queue(b):
    """The queue before and after: waiting work goes, and so does active work that no one can still be at."""
    queue = store.saved(b.events.select("event_id", "ts", F.expr(QUEUE).alias("state")), "queue")
    now = F.broadcast(queue.agg(F.max("ts").alias("now")))
    fresh = F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 DAY")
    left = queue.join(now, F.lit(True)).filter((F.col("state") == "done") | ((F.col("state") == "active") & fresh))
    return store.saved(left.select("event_id", "state"), "queue")


@query("ddl_migrate", "SELECT c_custkey, m.name AS migration, m.n AS place FROM customer JOIN (VALUES ('0001_base', 1), ('0002_derived', 2), ('0003_labels', 3)) AS m(name, n) ON m.n > c_custkey % 4", ctes=NONE)
def ddl_migrate(b):
    """Migrations that each of many stores still lacks, in order; a ledger holds what it has."""
    known = F.array(*(F.struct(F.lit(m).alias("migration"), F.lit(n).alias("place")) for n, m in enumerate(service.MIGRATIONS, 1)))
    ledger = b.table("customer").select("c_custkey", F.slice(F.array(*map(F.lit, service.MIGRATIONS)), F.lit(1), (F.col("c_custkey") % 4).cast("int")).alias("applied"))
    return ledger.select("c_custkey", F.explode(service.pending(known, F.col("applied"))).alias("m")).select("c_custkey", "m.*")


@query("st_chain", """SELECT slot, stage, place, asked, least(failures + 1, 3)::BIGINT AS attempts, failures < 3 AS done, (5 * (2 ** least(failures, 2) - 1))::BIGINT AS waited FROM r WHERE stopped = 0""",
    ctes="""slot AS (SELECT floor(epoch(ts) / 1800)::BIGINT AS slot, count(*) AS asked, arg_min(value, event_id) AS value FROM events WHERE event_type = 'signup' GROUP BY 1),
    s AS (SELECT slot, asked, st.stage, st.place, floor(value * st.place)::BIGINT % 4 AS failures FROM slot CROSS JOIN (VALUES ('cluster', 1), ('rollup', 2), ('merge', 3), ('trend', 4)) AS st(stage, place)),
    r AS (SELECT *, count(*) FILTER (WHERE failures >= 3) OVER (PARTITION BY slot ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stopped FROM s)""")  # fmt: skip
def st_chain(b):
    """Requests for a pass by half hours: those of one are one job; a stage is tried thrice, with
    waits of 5 and 10 seconds, and the next runs only if it succeeded."""
    asked = b.events.filter("event_type = 'signup'").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 1800).alias("slot"))
    slots = asked.agg(F.count(F.lit(1)).alias("asked"), F.min_by("value", "event_id").alias("value"))
    return jobs.chained(slots, ("cluster", "rollup", "merge", "trend"), lambda place: F.floor(F.col("value") * place) % 4).select("slot", "stage", "place", "asked", "attempts", "done", "waited")


@query("st_retry", """SELECT event_id, CASE WHEN kind = 'missing' THEN 1 ELSE least(failures, 3) + 1 END::BIGINT AS calls, CASE WHEN kind = 'missing' THEN 'none' WHEN kind = 'fine' OR failures <= 3 THEN 'ok' ELSE 'failed' END AS outcome,
    CASE kind WHEN 'missing' THEN 0 WHEN 'limited' THEN least(failures, 3) * (k % 7) ELSE 2 ** least(failures, 3) - 1 END::BIGINT AS waited
    FROM (SELECT event_id, k, kind, CASE WHEN kind = 'fine' THEN 0 ELSE floor(value)::BIGINT % 6 END AS failures FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k,
    CASE regexp_extract(props, '([0-9]+)', 1)::BIGINT % 10 WHEN 7 THEN 'limited' WHEN 8 THEN 'down' WHEN 9 THEN 'missing' ELSE 'fine' END AS kind FROM events))""", ctes=NONE)
def st_retry(b):
    """Calls with what they met: three retries at most, after the time that a limit names or 1, 2, 4 seconds; what is missing is not tried again."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    kind = F.when(k % 10 == 7, "limited").when(k % 10 == 8, "down").when(k % 10 == 9, "missing").otherwise("fine")
    calls = b.events.select("event_id", k.alias("k"), kind.alias("kind"), F.when(kind == "fine", 0).otherwise(F.floor("value") % 6).alias("failures"))
    return jobs.retried_calls(calls, retries=3)


@query("st_ttl_cache", """SELECT e.event_id, m.since IS NULL OR e.event_id <> first_value(e.event_id) OVER (PARTITION BY e.user_id, e.ts ORDER BY e.event_id) AS hit FROM events e LEFT JOIN made m ON m.user_id = e.user_id AND m.since = e.ts""",
    ctes="""RECURSIVE made(user_id, since) AS (SELECT user_id, min(ts) FROM events GROUP BY 1 UNION ALL SELECT m.user_id, (SELECT min(ts) FROM events e WHERE e.user_id = m.user_id AND e.ts >= m.since + INTERVAL 1 DAY) FROM made m WHERE m.since IS NOT NULL)""")
def st_ttl_cache(b):
    """Whether each request is answered from a result by key that lives for a day from when it was made."""
    return jobs.cache_hits(b.events.select("event_id", "user_id", "ts"), "user_id", seconds=86_400)


@query("st_schedule", """SELECT due, CASE WHEN epoch(due)::BIGINT % 3600 = 0 THEN 'crawl|pipeline' ELSE 'crawl' END AS jobs, coalesce(n, 0)::BIGINT AS arriving FROM due LEFT JOIN n USING (due)""",
    ctes="""b AS (SELECT to_timestamp(floor(epoch(min(ts)) / 1800) * 1800)::TIMESTAMP AS lo, max(ts) AS hi FROM events), due AS (SELECT unnest(generate_series(lo, hi, INTERVAL 30 MINUTE)) AS due FROM b),
    n AS (SELECT to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP AS due, count(*) AS n FROM events GROUP BY 1)""")  # fmt: skip
def st_schedule(b):
    """Times at which the crawl (every 30 minutes) and the pass (every 60) are due over the log, with what comes in until the next."""
    slot = F.window(F.col("ts").cast("timestamp"), "30 minutes")["start"].cast("timestamp_ntz")
    counts = b.events.groupBy(slot.alias("due")).agg(F.count(F.lit(1)).alias("arriving"))
    span = counts.agg(F.min("due").alias("lo"), F.max("due").alias("hi"))
    due = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 30 MINUTES"))).alias("due"))
    jobs_due = F.when(F.unix_timestamp(F.col("due").cast("timestamp")) % 3600 == 0, "crawl|pipeline").otherwise("crawl")
    return due.join(counts, "due", "left").select("due", jobs_due.alias("jobs"), F.coalesce("arriving", F.lit(0)).alias("arriving"))


@query("prj_status", """SELECT c_custkey, CASE WHEN value IS NOT NULL AND value NOT IN ('', 'changeme') THEN 'ok' WHEN c_nationkey < 12 THEN 'fatal' ELSE 'warn' END AS status
    FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_custkey % 9 = 0 THEN 'changeme' WHEN c_custkey % 9 = 1 THEN '' ELSE c_mktsegment END AS value FROM customer)""", ctes=NONE)
def prj_status(b):
    """Settings that are missing or still a placeholder: fatal where they are needed, else a warning."""
    value = F.when(F.col("c_acctbal") < 0, None).when(F.col("c_custkey") % 9 == 0, "changeme").when(F.col("c_custkey") % 9 == 1, "").otherwise(F.col("c_mktsegment"))
    rows = b.table("customer").select("c_custkey", value.alias("value"), (F.col("c_nationkey") < 12).alias("needed"))
    return rows.select("c_custkey", service.setting_status(F.col("value"), F.col("needed")).alias("status"))


OUTER, INNER = (service.padded("secret", pad).hex() for pad in (0x5C, 0x36))


@query("fn_token", f"""SELECT c_custkey, token, CASE WHEN c_custkey % 5 <> 0 AND expires > 50 THEN c_name END AS subject FROM (SELECT *, body || '.' || sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode(body)))) AS token
    FROM (SELECT *, c_custkey % 100 AS expires, translate(to_base64(encode(c_name || ':' || (c_custkey % 100))), '+/', '-_') AS body FROM customer))""", ctes=NONE)
def fn_token(b):
    """Signed tokens, and whom they name where the signature is whole and they have not expired."""
    rows = b.table("customer").select("c_custkey", service.token(F.col("c_name"), F.col("c_custkey") % 100, "secret").alias("token"))
    shown = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.col("token"), F.lit("0"))).otherwise(F.col("token"))
    return rows.select("c_custkey", "token", service.token_subject(shown, 50, "secret").alias("subject"))


@query("st_late_data", "SELECT CAST(ts AS DATE) AS day, count(*)::BIGINT AS games FROM events GROUP BY 1", ctes=NONE)
def st_late_data(b):
    """A stream in which every tenth event arrives after all others: each counts for its own day."""
    from ..streaming.usage import arrivals, latest_by_key

    stream = arrivals(b.spark, b.events, F.when(F.col("event_id") % 10 == 0, 2).when(F.col("event_id") % 3 == 0, 1).otherwise(0), 3)
    days = lambda rows: rows.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("games"))
    return latest_by_key(days(stream), ["day"])
