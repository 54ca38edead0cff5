"""Limits, frontier, persistence and pruning on hand-made rows and against plain restatements."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lobbyforge import registry
from lobbyforge.operators import frontier, order, variants
from lobbyforge.operators.variants import Family
from lobbyforge.plans.flows import USER_WINDOWS
from lobbyforge.sources import persist
from lobbyforge.sources.boards import Boards
from lobbyforge.streaming import limits
from lobbyforge.streaming.usage import arrivals

START = datetime(2024, 1, 1)


def replay(calls, windows):
    """Admission of (at, event, priority) by stepping from one instant at which something happens to the next."""
    hits, waiting, out, todo, now = [], [], {}, sorted(calls), 0
    while todo or waiting:
        if not waiting:
            now = max(now, todo[0][0])
        while todo and todo[0][0] <= now:
            at, event, priority = todo.pop(0)
            waiting.append((-priority, at, event))
        wait = 0
        for most, span in windows:
            inside = [h for h in hits if h > now - span]
            if len(inside) >= most:
                wait = max(wait, inside[len(inside) - most] + span - now)
        if wait:
            now = min(now + wait, todo[0][0]) if todo else now + wait
            continue
        waiting.sort()
        out[waiting.pop(0)[2]] = now
        hits.append(now)
    return out


def call_rows(spark, calls):
    rows = [(k, e, START + timedelta(microseconds=at), p) for k, at, e, p in calls]
    return spark.createDataFrame(rows, "key string, event_id long, ts timestamp, priority int")


@pytest.mark.parametrize("turns", [1, 3])
def test_sliding_log_admits_as_a_replay(spark, turns):
    r = random.Random(6)
    windows = ((2, 1_000_000), (5, 7_000_000))
    calls = [(k, r.randrange(60) * 500_000, i * 10 + j, r.randrange(3)) for j, k in enumerate("ab") for i in range(60)]
    calls += [("c", 5, 999, 0), (None, 7, 998, 0)]
    stream = arrivals(spark, call_rows(spark, calls), F.least(F.lit(turns - 1), F.floor((F.unix_micros("ts") - F.lit(int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)) / 30_000_001 * turns).cast("int")), turns)
    got = {r.event_id: r.admitted for r in limits.admitted(stream, windows, "0 seconds").collect()}
    base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = {}
    for k in ("a", "b", "c", None):
        want |= {e: t + base for e, t in replay([(at, e, p) for key, at, e, p in calls if key == k], windows).items()}
    assert got == want


def test_sliding_log_over_events(spark, data):
    got = {r.event_id: r.admitted for r in registry.QUERIES["st_sliding_window_limit"](spark, data).collect()}
    by = defaultdict(list)
    for r in Boards(spark, data).events.collect():
        at = round((r.ts - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        by[r.user_id].append((at, r.event_id, {"purchase": 2, "error": 0}.get(r.event_type, 1)))
    want = {}
    for calls in by.values():
        want |= replay(calls, USER_WINDOWS)
    assert got == want and any(got[e] > at for calls in by.values() for at, e, _ in calls)


def test_fixed_windows_with_a_busy_key(spark):
    calls = [("a", i * 1000, i, 0) for i in range(50)] + [(str(i), 2_000_000 + i, 100 + i, 0) for i in range(5)] + [(None, 3_000_000, 200, 0)]
    got = {r.event_id: (r.ok, r.scope, r.retry_after) for r in limits.fixed_windows(call_rows(spark, calls), 3, 53, 10).collect()}
    assert [got[i][1] for i in range(50)] == [None] * 3 + ["ip"] * 47
    assert [got[100 + i][1] for i in range(5)] == [None] * 3 + ["global"] * 2
    assert got[103] == (False, "global", 8) and got[0] == (True, None, 0)
    assert limits.fixed_windows(call_rows(spark, calls).limit(0), 3, 53, 10).count() == 0


def test_running_sums_and_places(spark):
    r = random.Random(2)
    data = [(i, r.randrange(5), r.choice([None, 1, 2])) for i in range(500)]
    rows = spark.createDataFrame(data, "id long, v int, g int")
    by = [F.desc("v"), F.asc("id")]
    got = {x.id: (x.n, x.s) for x in order.running(order.dealt(rows, by, "t"), by, n=F.lit(1), s=F.col("v")).collect()}
    total = 0
    for n, (i, v, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        total += v
        assert got[i] == (n, total)
    placed = order.places(rows.filter("g IS NOT NULL"), ["g"], F.col("v"), [F.asc("id")], "k").collect()
    for g in (1, 2):
        assert [x.k for x in sorted((x for x in placed if x.g == g), key=lambda x: (x.v, x.id))] == list(range(1, sum(d[2] == g for d in data) + 1))


def drained(accounts, now, b):
    """The pass as a loop over accounts."""
    good = lambda t: t is not None and t.upper() in b.tiers
    hours = lambda n: timedelta(hours=n)
    due = [a for a in accounts if a[3] is None or a[3] < now - hours(b.recrawl_hours)]
    due.sort(key=lambda a: (not good(a[1]), a[1] is not None, a[3] is not None, a[3] or now, a[0]))
    out, enqueued, budget, blind = {}, 0, b.match_fetches, 0
    for i, tier, checked, _, found, available in due[: b.accounts * b.overselect]:
        if enqueued >= b.accounts or budget <= 0:
            break
        fresh = checked is not None and checked > now - hours(b.tier_hours if good(tier) else b.out_of_scope_hours)
        if not fresh and tier is None:
            if blind >= b.explore:
                out[i] = ("waits", 0)
                continue
            blind += 1
        if not good(tier if fresh else found):
            out[i] = ("out_of_scope", 0)
            continue
        n = min(available, b.matches_each, budget)
        out[i] = ("fetch" if available else "nothing_new", n)
        enqueued, budget = enqueued + (n > 0), budget - n
    return out


@pytest.mark.parametrize(("accounts", "fetches", "explore"), [(5, 1000, 3), (1000, 23, 0), (1000, 10_000, 1000), (3, 7, 2)])
def test_drain_is_the_loop(spark, accounts, fetches, explore):
    r = random.Random(accounts)
    ago = lambda h: None if h is None else START - timedelta(hours=h)
    tiers = [None, "master", "GOLD", "CHALLENGER"]
    data = [(i, r.choice(tiers), ago(r.choice([None, 1, 30, 100, 300])), ago(r.choice([None, 2, 20, 20, 40, 400])), r.choice(tiers), r.randrange(6)) for i in range(150)]
    rows = spark.createDataFrame(data, "id long, tier string, tier_checked_at timestamp, last_crawled_at timestamp, found_tier string, available int")
    now = spark.createDataFrame([(START,)], "now timestamp")
    b = frontier.Budgets(tiers=("CHALLENGER", "MASTER"), accounts=accounts, overselect=4, explore=explore, match_fetches=fetches, matches_each=4)
    got = {x.id: (x.action, x.matches) for x in frontier.drain(rows, now, b).collect()}
    assert got == drained(data, START, b)
    assert frontier.drain(rows.limit(0), now, b).count() == 0


def test_reach_ends(spark):
    edges = [("m1", "a"), ("m1", "b"), ("m2", "b"), ("m2", "c"), ("m3", "c"), ("m3", "d"), ("m4", "x"), ("m4", "y"), ("m3", "a")]
    boards = spark.createDataFrame(edges, "match_id string, puuid string")
    found = lambda *s: {(r.puuid, r.level) for r in frontier.reach(boards, spark.createDataFrame([(x,) for x in s], "puuid string")).collect()}
    assert found("a") == {("a", 0), ("b", 1), ("c", 1), ("d", 1)}
    assert found("x", "b") == {("x", 0), ("b", 0), ("y", 1), ("a", 1), ("c", 1), ("d", 2)}
    assert frontier.reach(boards, boards.limit(0).select("puuid")).count() == 0


def test_batches_run_twice_leave_what_one_run_leaves(spark, data):
    from lobbyforge.plans.flows import persisted

    def rows(path):
        return {name: Counter(map(str, spark.read.parquet(f"{path}/{name}").collect())) for name in persist.TABLES}

    once, twice = (rows(persisted(Boards(spark, data), times)) for times in (1, 2))
    assert once == twice and all(once.values())
    ids = [r.match_id for r in spark.read.parquet(f"{persisted(Boards(spark, data), 1)}/matches").collect()]
    assert len(ids) == len(set(ids))


def test_dropped_partitions_leave_the_others_files(spark, tmp_path):
    path = f"file://{tmp_path}/snapshots"
    days = spark.createDataFrame([(i, f"2024-0{1 + i % 4}-01") for i in range(40)], "n long, day string")
    days.repartition("day").write.partitionBy("day").parquet(path)
    files = lambda: {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(tmp_path) for f in fs if "day=2024-03" in d or "day=2024-04" in d}
    before = files()
    assert persist.drop_partitions(spark, path, "day", "2024-03-01") == ["2024-01-01", "2024-02-01"]
    assert files() == before and spark.read.schema("n long, day string").parquet(path).count() == 20


def test_pruning_cascades(spark):
    comps = spark.createDataFrame([(1,), (2,), (3,)], "comp_id long")
    boards = spark.createDataFrame([(10, 1), (11, 1), (12, None)], "board_id long, comp_id long")
    stats = spark.createDataFrame([(1, 5), (2, 6), (2, 7), (9, 1)], "comp_id long, n long")
    left = persist.prune_cascade(comps, boards, {"stats": stats}, "comp_id")
    assert [r.comp_id for r in left[""].collect()] == [1]
    assert sorted((r.comp_id, r.n) for r in left["stats"].collect()) == [(1, 5), (9, 1)]


def test_variants_by_over_count(spark):
    """A board of the family's unit whose mage count is two above its units plays the variant with that trait."""
    traits = spark.createDataFrame([("Base", "Marker"), ("V1", "Mage"), ("V2", "Tank"), ("A", "Mage"), ("B", "Mage")], "character_id string, trait_id string")
    units = spark.createDataFrame([(1, "Base"), (1, "A"), (1, "A"), (2, "Base"), (2, "A"), (2, "B"), (3, "A"), (4, "Base")], "board_id long, character_id string")
    reported = spark.createDataFrame([(1, "Mage", 3), (1, "Tank", 2), (1, "Marker", 9), (2, "Mage", 3), (2, "Tank", 4), (3, "Tank", 5), (4, "Mage", 1)], "board_id long, trait_id string, num_units int")
    got = {(r.board_id, r.variant_id, r.delta) for r in variants.infer(units, traits, reported, (Family("Base", "^V[0-9]$", "Marker"),)).collect()}
    assert got == {(1, "V1", 2), (2, "V2", 4)}
    boards = spark.createDataFrame([(1, 7), (2, 7), (3, 8)], "board_id long, comp_id long")
    picked = variants.pick(variants.tally(boards, variants.infer(units, traits, reported, (Family("Base", "^V[0-9]$", "Marker"),))), ["comp_id"]).collect()
    assert [(r.comp_id, r.variant_id, r.boards) for r in picked] == [(7, "V1", 1)]


def test_a_turn_comes_in_many_files(spark, data, monkeypatch):
    """Documents of a turn are never put into one file, which one task would write and read; a turn is a batch all the same."""
    from lobbyforge.plans.flows import persisted
    from lobbyforge.sources import store

    made, new_path = {}, store.new_path
    monkeypatch.setattr(store, "new_path", lambda s, name: made.setdefault(name, new_path(s, name)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        path = persisted(Boards(spark, data), 1)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    root = made["arrivals"].removeprefix("file://").removeprefix("file:")
    assert min(sum(f.startswith("part-") for f in os.listdir(f"{root}/{k}")) for k in range(3)) > 1
    assert spark.read.schema("batch int").parquet(f"{path}/outcomes").distinct().count() == 3


def test_first_boards_are_found_in_the_document(spark, data):
    """Of a player's boards the one of least place; no board is shuffled for it, and documents take one shuffle of their lines."""
    from lobbyforge.plans.storage import documents
    from lobbyforge.sources.matches import MATCH

    board = lambda who, place, level: (who, place, level, [], [], [])
    people = [board("a", 3, 1), board("b", 2, 2), board("a", 1, 3), board("BOT", 4, 4), board("BOT", 5, 5), board("b", 6, 6), board(None, 7, 7), board("c", None, 8), board("c", 8, 9)]
    docs = spark.createDataFrame([(("X_1",), (0, 1.0, "v", 1100, 17, people)), (("X_2",), (0, 1.0, "v", 1100, 17, []))], MATCH)
    tables = persist.shaped(docs)
    assert sorted((r.puuid, r.placement, r.level) for r in tables["participants"].collect()) == sorted([("a", 1, 3), ("b", 2, 2), ("c", None, 8)], key=str)
    assert "Exchange" not in tables["units"]._jdf.queryExecution().executedPlan().toString()
    assert {r.match_id: r.player_count for r in tables["matches"].collect()} == {"X_1": 6, "X_2": 0}
    assert documents(Boards(spark, data)).count() == Boards(spark, data).matches.count()


def test_documents_are_shuffled_once_as_text(spark, data, monkeypatch, tmp_path):
    """A batch's documents are written once, compressed, and cross one shuffle as text; known ones are not kept again, and no table shuffles."""
    from lobbyforge.plans.flows import persisted
    from lobbyforge.sources import store

    made, new_path = {}, store.new_path
    monkeypatch.setattr(store, "new_path", lambda s, name: made.setdefault(name, new_path(s, name)))
    path = persisted(Boards(spark, data), 1)
    assert "matches" not in made
    root = made["arrivals"].removeprefix("file://").removeprefix("file:")
    assert all(f.endswith(".gz") for k in range(3) for f in os.listdir(f"{root}/{k}") if f.startswith("part-"))
    kept = [r.match_id for r in spark.read.parquet(f"{path}/documents").filter("known IS NULL").collect()]
    assert len(kept) == len(set(kept)) == Boards(spark, data).matches.count()
    assert spark.read.parquet(f"{path}/documents").filter("known AND doc IS NOT NULL").count() == 0
    person = "struct('P1' AS puuid, 1 AS placement, 7 AS level, array(named_struct('character_id', 'U1', 'tier', 1, 'rarity', 2, 'itemNames', array('I1'))) AS units, array(named_struct('name', 'T1', 'num_units', 2, 'style', 1), named_struct('name', CAST(NULL AS STRING), 'num_units', 1, 'style', 0), named_struct('name', 'T1', 'num_units', 9, 'style', 4)) AS traits, array('A') AS augments)"
    docs = spark.sql(f"SELECT struct('ZZ1_1' AS match_id) AS metadata, struct(1L AS game_datetime, 1.5D AS game_length, CAST(NULL AS STRING) AS game_version, 1100 AS queue_id, 17 AS tft_set_number, array({person}) AS participants) AS info")
    tables = persist.shaped(docs)
    assert not any("Exchange" in t._jdf.queryExecution().executedPlan().toString() for t in tables.values())
    assert sorted((r.name or "", r.num_units) for r in tables["traits"].collect()) == [("", 1), ("T1", 2)]
    persist.persist(docs.unionAll(docs), 0, f"file://{tmp_path}/p")
    assert spark.read.parquet(f"file://{tmp_path}/p/documents").select("doc.*").collect() == docs.collect()
