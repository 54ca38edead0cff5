"""Patches, selectors, boards as text, recent matches and pages, on hand-made rows."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lobbyforge.functions import codecs
from lobbyforge.operators import patches, served

PATCH = "patch_id int, set_number int, patch string, is_current boolean"
UNITS, MATCH = "set_number int, character_id string", "match_id string, set_number int, patch_id int"


def known(spark, *rows):
    return spark.createDataFrame(list(rows), PATCH)


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([(17, "U1"), (17, "U2"), (18, "U9"), (18, "U9")], UNITS)


def flags(rows):
    return {r.patch_id: (r.is_current, r.changed) for r in rows.collect()}


def test_versions_are_numbers_and_need_matches(spark, catalogue):
    table = known(spark, (1, 17, "16.9", True), (2, 17, "16.10", False), (3, 17, "17.6", False), (4, 17, "17.0", False), (5, 17, "beta", False), (6, 18, "18.0", False))
    seen = spark.createDataFrame([("a", 17, 1), ("b", 17, 2), ("c", 17, 4), ("d", 17, 5)], MATCH)
    assert flags(patches.advance(table, catalogue, seen)) == {1: (False, True), 2: (True, True), 3: (False, False), 4: (False, False), 5: (False, False), 6: (False, False)}


def test_placeholder_is_current_only_alone(spark, catalogue):
    table = known(spark, (1, 17, "16.9", True), (6, 18, "18.0", False), (7, 18, "16.16", False))
    first = spark.createDataFrame([("a", 17, 1), ("b", 18, 6)], MATCH)
    assert flags(patches.advance(table, catalogue, first))[6] == (True, True)
    later = first.unionAll(spark.createDataFrame([("c", 18, 7)], MATCH))
    assert flags(patches.advance(table, catalogue, later)) == {1: (False, True), 6: (False, False), 7: (True, True)}


def test_without_matches_nothing_changes(spark, catalogue):
    table = known(spark, (1, 17, "16.9", True), (2, 17, "16.10", False))
    none = spark.createDataFrame([], MATCH)
    assert flags(patches.advance(table, catalogue, none)) == {1: (True, False), 2: (False, False)}
    assert patches.live_set(catalogue, none).collect()[0].set_number is None
    assert patches.crawl_boundary(table.filter("is_current"), none.withColumn("game_datetime", F.current_timestamp())).collect()[0].since is None


def test_flagged_set_without_catalogue_is_not_current(spark, catalogue):
    assert patches.current_set(known(spark, (1, 19, "19.0", True)), catalogue).collect()[0].set_number == 18
    assert patches.current_set(known(spark, (1, 17, "16.9", True)), catalogue).collect()[0].set_number == 17
    assert patches.current_set(known(spark, (1, 17, "16.9", True)), catalogue.limit(0)).collect()[0].set_number is None


def test_unknown_versions_have_the_placeholder(spark):
    table = known(spark, (1, 17, "16.9", True), (4, 17, "17.0", False))
    seen = spark.createDataFrame([("a", 17, "Version 16.9.1.2"), ("b", 17, "?"), ("c", 17, None), ("d", 17, "1.2.3")], "match_id string, set_number int, game_version string")
    assert {r.match_id: (r.patch, r.patch_id) for r in patches.resolve(seen, table).collect()} == {"a": ("16.9", 1), "b": ("17.0", 4), "c": ("17.0", 4), "d": ("1.2", None)}


TOTALS = [(1, "EUROPE", "master_plus", 5), (1, "EUROPE", "zzz", 1), (1, "EUROPE", "challenger", 2), (1, "ASIA", "challenger", 8), (2, "ASIA", "diamond", 90), (9, "ASIA", "diamond", 95)]


@pytest.mark.parametrize(
    ("wanted", "chosen"),
    [({}, ("16.9", "ASIA", "challenger")), ({"region": "EUROPE"}, ("16.9", "EUROPE", "challenger")), ({"region": "EUROPE", "bucket": "zzz"}, ("16.9", "EUROPE", "zzz")), ({"patch_id": 9, "region": "EUROPE"}, ("9", "ASIA", "diamond")), ({"patch_id": 4}, ("16.9", "ASIA", "challenger"))],
)
def test_selection(spark, wanted, chosen):
    totals = spark.createDataFrame(TOTALS, "patch_id int, region string, rank_bucket string, boards long")
    rows = served.selection(totals, known(spark, (1, 17, "16.9", True), (2, 17, "16.10", False)), **wanted).collect()
    assert tuple(next(r.option for r in rows if r.part == part and r.chosen) for part in ("patch", "region", "rank")) == chosen
    assert [r.option for r in sorted((r for r in rows if r.part == "patch"), key=lambda r: r.place)] == ["16.9", "9", "16.10"]


def test_ranks_have_their_own_order(spark):
    totals = spark.createDataFrame(TOTALS, "patch_id int, region string, rank_bucket string, boards long")
    rows = served.selection(totals, known(spark, (1, 17, "16.9", True)), region="EUROPE").filter("part = 'rank'").orderBy("place").collect()
    assert [r.option for r in rows] == ["challenger", "master_plus", "zzz"]
    assert served.selection(totals.limit(0), known(spark, (1, 17, "16.9", True))).count() == 0


def test_board_lines(spark):
    units = spark.createDataFrame([(1, 2, "B", 3), (1, 1, "A", None), (2, 1, "A", 1)], "board_id long, unit_row int, character_id string, star_tier int")
    items = spark.createDataFrame([(1, 2, 2, "y"), (1, 2, 1, "x")], "board_id long, unit_row int, slot int, item_id string")
    traits = spark.createDataFrame([(1, "T2", 4), (1, "T1", 2), (3, "T1", 1)], "board_id long, trait_id string, num_units int")
    assert {r.board_id: (r.units, r.traits) for r in served.board_lines(units, items, traits).collect()} == {1: ("A*0 B*3+x+y", "T1:2 T2:4"), 2: ("A*1", ""), 3: ("", "T1:1")}
    some = units.select("board_id").distinct().filter("board_id = 2")
    assert [(r.board_id, r.units) for r in served.board_lines(units, items, traits, some).collect()] == [(2, "A*1")]


def test_recent_pages_of_one_player_with_most_rows(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 3990, "P1").otherwise(F.concat(F.lit("P"), "id")).alias("puuid"), F.concat(F.lit("m"), "id").alias("match_id"), F.col("id").alias("board_id"), F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("id") % 50).cast("int")).alias("game_datetime"))
    got = served.recent(rows, 3, 4).filter("puuid = 'P1'").orderBy("place").collect()
    want = sorted((49 - i % 50, f"m{i}") for i in range(3990))[3:7]
    assert [(r.place, r.match_id) for r in got] == [(4 + k, m) for k, (_, m) in enumerate(want)]
    assert served.recent(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("number", "page", "ranks"), [(1, 1, range(1, 11)), (3, 3, range(21, 24)), (99, 3, range(21, 24)), (0, 1, range(1, 11))])
def test_page_numbers_are_clamped(spark, number, page, ranks):
    rows = spark.range(23).select("id", (F.col("id") % 3).alias("lp"))
    got = served.page(rows, [F.desc("lp"), F.asc("id")], number, 10, "test_ladder").orderBy("rank").collect()
    order = sorted(range(23), key=lambda i: (-(i % 3), i))
    assert [(r["rank"], r.id, r.page) for r in got] == [(k, order[k - 1], page) for k in ranks]
    assert served.page(rows.limit(0), [F.desc("lp"), F.asc("id")], number, 10, "test_ladder").count() == 0


def test_names_fall_back_to_the_id(spark):
    rows = spark.createDataFrame([("abcdefgh", None), ("abcdefgh", ""), ("p", "Ann")], "puuid string, name string")
    assert [r[0] for r in rows.select(served.display_name(F.col("name"), F.col("puuid"))).collect()] == ["abcdef…", "abcdef…", "Ann"]


def test_inspector_places_ties_and_floors(spark):
    rows = [("m:a", i, 3, 9, 2, 1) for i in range(600)] + [("m:a", 10**17 + i, 40 + i % 2, 100, 20, 5) for i in range(50)]
    rows += [("m:a", 7, 2, 4, 2, 1), ("m:b", 1, 2, 9, 0, 0), ("m:b", 1, 2, 9, 0, 0), ("c:9", 9, 50, 200, 9, 9), ("m:d", 5, 3, 3, 3, 3)]
    stats = spark.createDataFrame(rows, "gkey string, comp_id long, n long, placement_sum long, top4_count long, win_count long")
    got = {(r.gkey, r.comp_id): r for r in served.inspector(stats, 3).collect()}
    n = {}
    for gkey, comp, boards, *_ in rows:
        n[gkey, comp] = n.get((gkey, comp), 0) + boards
    want = sorted((k for k in n if k[0] == "m:a"), key=lambda k: (-n[k], k[1]))
    assert {k for k in got if k[0] != "m:a"} == {("m:d", 5)}  # no comp of b reaches the floor in one bucket
    assert [got[k].place for k in want] == list(range(1, len(want) + 1)) and [k for k in got if got[k].representative] and got[want[0]].representative
    assert got[want[0]].members == 650 and got[want[0]].group_boards == sum(n[k] for k in want)
    assert got["m:d", 5].avg_placement == 1.0 and got["m:d", 5].group_win_rate == 1.0
    assert served.inspector(stats.limit(0), 3).count() == 0


def test_operations_have_no_gaps(spark):
    at = datetime.datetime(2024, 1, 1, 12, 0, 30)
    calls = spark.createDataFrame([(at, "a", False), (at - datetime.timedelta(minutes=2), "a", True), (at - datetime.timedelta(minutes=61), "b", False)], "ts timestamp_ntz, method string, rejected boolean")
    jobs = spark.createDataFrame([(1, "x", at, False), (2, "x", at - datetime.timedelta(hours=2), True), (3, "y", at, True), (4, "z", at, False)], "id long, job string, ts timestamp_ntz, done boolean")
    rows = served.operations(calls, jobs, minutes=5, newest=2).collect()
    of = lambda part: {r.key: r for r in rows if r.part == part}
    assert {k: (r.requests, r.errors) for k, r in of("minute").items()} == {"2024-01-01 11:56": (0, 0), "2024-01-01 11:57": (0, 0), "2024-01-01 11:58": (1, 1), "2024-01-01 11:59": (0, 0), "2024-01-01 12:00": (1, 0)}
    assert {k: r.requests for k, r in of("total").items()} == {"calls": 2, "peak": 1, "methods": 1}
    assert {k: (r.requests, r.errors, r.seen) for k, r in of("method").items()} == {"a": (2, 1, at)}
    assert {k: r.stale for k, r in of("health").items()} == {"x": True, "y": False, "z": True}
    assert set(of("job")) == {"4 z", "3 y"}


def test_item_stats(spark):
    rows = [({"AD": 0.15, "AS": 10.0, "Health": 0.0, "HealthMax": 150.0, "ShieldDuration": 3.0},), ({"AttackSpeed": 0.255, "AS": 10.0, "AP": 24.5},), ({},), (None,), ({"Mana": None},)]
    found = spark.createDataFrame(rows, "effects map<string,double>").select(codecs.item_stats(F.col("effects")).alias("s")).collect()
    assert [[tuple(x) for x in r.s] for r in found] == [[("Attack Damage", "+15%"), ("Health", "+150"), ("Attack Speed", "+10%")], [("Ability Power", "+25"), ("Attack Speed", "+26%")], [], [], []]


def test_flags_without_catalogue_are_cleared(spark, catalogue):
    table = known(spark, (1, 17, "16.9", True), (2, 19, "19.0", True), (3, 19, "19.1", False))
    assert flags(patches.cleared(table, catalogue)) == {1: (True, False), 2: (False, True), 3: (False, False)}


def test_accounts_by_name(spark):
    asked = spark.createDataFrame([("ANN", "Eu1", "europe"), ("Ann", "eu1", "asia"), ("Bo", "OC", "sea"), (None, "x", "asia")], "name string, tag string, route string")
    accounts = spark.createDataFrame([("p1", "Ann", "EU1", "europe"), ("p2", "bo", "oc", "asia")], "puuid string, name string, tag string, route string")
    assert sorted((str(r.name), r.host, r.puuid) for r in served.find_accounts(asked, accounts).collect()) == [("ANN", "europe", "p1"), ("Ann", "asia", None), ("Bo", "asia", "p2"), ("None", "asia", None)]


def test_ladders_break_ties_by_player(spark):
    rows = [("CHALLENGER", f"p{i:03}", i % 7 * 90) for i in range(300)] + [("MASTER", "q", 5), ("GOLD", "r", 99), (None, "s", 9)]
    got = served.ladders(spark.createDataFrame(rows, "tier string, puuid string, lp int"), ("CHALLENGER", "MASTER")).collect()
    top = [r.puuid for r in sorted((r for r in got if r.tier == "CHALLENGER"), key=lambda r: r.place)]
    assert top == [p for _, p, _ in sorted((r for r in rows if r[0] == "CHALLENGER"), key=lambda r: (-r[2], r[1]))]
    assert {r.tier for r in got} == {"CHALLENGER", "MASTER"}


def test_relabelling_leaves_other_values(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    found = served.relabelled({"one": rows, "two": rows.filter("k = 'b'")}, "k", "a", "z")
    assert {n: sorted(str(r.k) for r in t.collect()) for n, t in found.items()} == {"one": ["None", "b", "z"], "two": ["b"]}
