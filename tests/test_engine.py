"""The engine's queries against DuckDB, and its operators on hand-made rows."""

from __future__ import annotations

import math
import numbers

import duckdb
import pytest
from pyspark.sql import functions as F

from lobbyforge import registry
from lobbyforge.config import FIXTURE, PRODUCTION
from lobbyforge.functions import codecs, scoring, service
from lobbyforge.operators import identity, itemization, jobs, merge
from lobbyforge.operators.merge import Archetype, Profile

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(frame):
    def cell(v):
        if v is None or type(v).__name__ == "NAType" or v != v:
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()[:26].removesuffix("T00:00:00")
        if isinstance(v, numbers.Real):
            return f"{float(v):.5f}"
        return str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark, data, duck):
    ours = plain(registry.QUERIES[name](spark, data).toPandas())
    theirs = plain(duck.execute(registry.ORACLES[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", ["sink_upsert_ignore", "sink_upsert_update"])
def test_upserts_of_more_than_a_million_parts(name, spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest([0, 3, 7, 21, 1000000, 1000007, 1000021, 2000014]) AS p_partkey, unnest([1, 2, 3, 4, 5, 6, 7, 8])::INT AS p_size) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert plain(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(con.execute(registry.ORACLES[name]).df())


def test_every_query_without_sql_runs(spark, data):
    for name in sorted(set(registry.QUERIES) - set(registry.ORACLES)):
        assert registry.QUERIES[name](spark, data).count() >= 0


def test_entry_points(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def signature(spark, units, items=(), config=PRODUCTION):
    u = spark.createDataFrame([(1, i + 1, c, s) for i, (c, s, _) in enumerate(units)], "board_id long, unit_row int, character_id string, star_tier int")
    costs = spark.createDataFrame(sorted({(c, k) for c, _, k in units}), "character_id string, cost int")
    held = spark.createDataFrame([(1, 1, "x", 1, i) for i in items], "board_id long, unit_row int, character_id string, slot int, item_id string")
    rows = identity.signatures(u, costs, held, config).collect()
    return rows[0].signature if rows else None


def test_identity(spark):
    six = [(f"U{i}", 1, 2) for i in range(6)]
    base = signature(spark, six)
    assert base == signature(spark, six[::-1]) == signature(spark, [(c, 2, k) for c, _, k in six])
    assert base != signature(spark, [*six, ("U0", 1, 2)])
    assert base != signature(spark, [("U0", 3, 2), *six[1:]])
    dear = [("U9", 1, 5), *six[1:]]
    assert signature(spark, dear) == signature(spark, [("U9", 3, 5), *six[1:]])
    assert signature(spark, six[:5]) is None
    assert signature(spark, [*six[:5], ("S", 1, 11)]) is None
    assert signature(spark, six, ["A_Item_BEmblemItem", "A_Item_BEmblemItem"]).endswith("|emb:A_Item_BEmblemItem")


def stats(spark, n, placement_sum, sumsq, top4, wins):
    return spark.createDataFrame([(n, placement_sum, sumsq, top4, wins)], "n long, placement_sum long, placement_sumsq long, top4_count long, win_count long")


def test_scores(spark):
    empty = scoring.metrics(stats(spark, 0, 0, 0, 0, 0), PRODUCTION).first()
    assert (empty.avg_placement, empty.top4_rate, empty.win_rate, empty.top4_low, empty.top4_high) == (4.5, 0.5, 0, 0, 0)
    many = scoring.metrics(stats(spark, 400, 1440, 6000, 248, 40), PRODUCTION).first()
    lucky = scoring.metrics(stats(spark, 1, 1, 1, 1, 1), PRODUCTION).first()
    assert many.score > lucky.score and lucky.placement_sem == 0
    tiers = spark.createDataFrame([(x,) for x in (0.9, 0.55, 0.5, 0.45, 0.4, 0.0, -5.0)], "score double")
    assert [r.t for r in tiers.select(scoring.static_tier(tiers.score, PRODUCTION).alias("t")).collect()] == list("SSABCDD")
    few = spark.createDataFrame([(1, float(i)) for i in range(7)], "g int, score double")
    assert scoring.cutoffs(few, ["g"], PRODUCTION).count() == 0
    nine = spark.createDataFrame([(1, float(i)) for i in range(10)], "g int, score double")
    cut = scoring.cutoffs(nine, ["g"], PRODUCTION).first()
    assert (cut.cut_s, cut.cut_a, cut.cut_b, cut.cut_c) == (8.0, 7.0, 4.0, 2.0)


def test_codecs(spark):
    cells = [(0, "U0", ["a", "b"]), (27, "U1", [])]
    df = spark.createDataFrame([(cells,), ([],)], f"cells {codecs.CELLS}")
    back = df.select(codecs.encode_board(df.cells).alias("code")).select("code", codecs.decode_board(F.col("code")).alias("cells")).collect()
    assert back[0].code[0] == "1" and "=" not in back[0].code
    assert [(c.i, c.u, c.it) for c in back[0].cells] == [(0, "U0", ["a", "b"]), (27, "U1", [])]
    assert back[1].code == ""
    assert codecs.buckets_in_scope(("challenger", "ALL")) is None


def test_overlap_bounds():
    assert merge.weighted_overlap({}, {}) == (0.0, 1.0)
    assert merge.weighted_overlap({"a": 1.0}, {}) == (0.0, 0.0)
    c, j = merge.weighted_overlap({"a": 1.0, "b": 0.5}, {"a": 0.5})
    assert math.isclose(c, 1.5) and math.isclose(j, 0.75 / 1.25)
    assert Archetype().add(Profile(1, frozenset("A"))).total == 1


def test_tokens_are_hmac(spark):
    import base64
    import hashlib
    import hmac

    rows = spark.createDataFrame([("a:b", 60), ("ö", 50), ("", 99)], "subject string, expires int")
    got = rows.withColumn("t", service.token(F.col("subject"), F.col("expires"), "key")).withColumn("who", service.token_subject(F.col("t"), 50, "key")).collect()
    for r in got:
        body = base64.urlsafe_b64encode(f"{r.subject}:{r.expires}".encode()).decode()
        assert r.t == f"{body}.{hmac.new(b'key', body.encode(), hashlib.sha256).hexdigest()}"
        assert r.who == (r.subject if r.expires > 50 else None)


def test_cache_is_sequential(spark):
    at = [0, 100, 299, 300, 301, 599, 600, 1000]
    rows = spark.createDataFrame([(i, k, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}") for k in (1, 2) for i, t in enumerate(at, 10 * k)], "event_id long, k int, ts string")
    got = {r.event_id: r.hit for r in jobs.cache_hits(rows.withColumn("ts", F.col("ts").cast("timestamp")), "k", 300).collect()}
    assert [got[10 + i] for i in range(len(at))] == [False, True, True, False, True, True, False, False] == [got[20 + i] for i in range(len(at))]


def test_chain_stops_at_a_failure(spark):
    rows = jobs.chained(spark.createDataFrame([(1,), (3,)], "v int"), ("a", "b"), lambda place: F.col("v") * place).collect()
    assert [(r.v, r.stage, r.attempts, r.done, r.waited) for r in rows] == [(1, "a", 2, True, 5), (1, "b", 3, True, 15), (3, "a", 3, False, 15)]


def test_late_rows_change_their_own_day(spark):
    from lobbyforge.streaming.usage import arrivals, first_seen, latest_by_key

    rows = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "a", 1), (4, "c", 1), (0, "b", 1)], "event_id long, day string, turn int")
    stream = arrivals(spark, rows, F.col("turn"), 2)
    assert {r.day: r.n for r in latest_by_key(stream.groupBy("day").agg(F.count(F.lit(1)).alias("n")), ["day"]).collect()} == {"a": 2, "b": 2, "c": 1}
    assert {r.day: r.event_id for r in first_seen(arrivals(spark, rows, F.col("turn"), 2), ["day"], "event_id").collect()} == {"a": 1, "b": 2, "c": 4}


def test_carries_fall_back(spark):
    rows = spark.createDataFrame([(1, "A", 0.6, 0.1), (1, "B", 0.2, 0.9), (2, "A", 0.1, 0.7), (2, "B", 0.2, 0.7), (2, "C", 0.0, 0.6)], "comp_id int, character_id string, full_rate double, top_rate double")
    got = sorted((r.comp_id, r.character_id) for r in itemization.carries(rows, FIXTURE).collect())
    assert got == [(1, "A"), (2, "A"), (2, "B")]


def shuffles(rows):
    """Shuffles by key that a plan has, before it is adapted."""
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_boards_traits_take_one_shuffle_of_units(spark, data):
    """All that is reckoned by board stays where units and emblems met; a table twice as large gives tasks twice as many."""
    from lobbyforge.plans.items import held
    from lobbyforge.sources.boards import Boards

    b = Boards(spark, data)
    assert shuffles(registry.QUERIES["fn_active_traits"](spark, data)) <= 4  # two of them of the catalogue
    assert shuffles(itemization.best_copy(held(b))) == 1
    assert b.parts() == 4 and Boards(spark, "/root/testdata/sf0.1").parts(megabytes=1) > 8


def test_signatures_are_made_once(spark, data):
    """The tables of a pass that rest on signatures read them as they were written."""
    from lobbyforge.plans import stages
    from lobbyforge.sources import store
    from lobbyforge.sources.boards import Boards

    b = Boards(spark, data, stored=True)
    assert stages.clustered(b).count() == b.players.join(stages.rollup.ranked(b.matches, b.config), "match_id").count()
    assert stages.comps(b).count() == stages.signed(b).select("signature").distinct().count()
    assert any(key[1] == "signed" for key in store.MADE) and "Exchange" not in stages.signed(b)._jdf.queryExecution().executedPlan().toString()
