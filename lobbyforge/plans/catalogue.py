"""Queries of scalar functions, codecs and catalogue dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import codecs
from .core import joined
from .stages import sql
from .ops import NONE

TIER = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Challenger' WHEN 'MACHINERY' THEN 'GRANDMASTER' WHEN 'AUTOMOBILE' THEN 'Gold' WHEN 'HOUSEHOLD' THEN 'emerald' END"


def players(b):
    return b.table("customer").select("c_custkey", F.expr(TIER).alias("tier"))


@query("prj_rank_bucket", f"SELECT c_custkey, CASE upper(coalesce({TIER}, '')) WHEN 'CHALLENGER' THEN 'challenger' WHEN 'GRANDMASTER' THEN 'master_plus' WHEN 'GOLD' THEN 'iron_gold' WHEN 'EMERALD' THEN 'plat_emerald' ELSE 'unknown' END AS rank_bucket FROM customer", ctes=NONE)
def prj_rank_bucket(b):
    return players(b).select("c_custkey", codecs.rank_bucket(F.col("tier")).alias("rank_bucket"))


@query("prj_bucket_label", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Challenger' WHEN 1 THEN 'Master+' ELSE 'Bronze' END AS label FROM customer", ctes=NONE)
def prj_bucket_label(b):
    bucket = F.element_at(F.array(*map(F.lit, ("challenger", "master_plus", "bronze"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return b.table("customer").select("c_custkey", codecs.bucket_label(bucket).alias("label"))


@query("flt_tier_scope", f"SELECT c_custkey FROM customer WHERE upper({TIER}) IN ('CHALLENGER', 'EMERALD') OR {TIER} IS NULL", ctes=NONE)
def flt_tier_scope(b):
    return players(b).filter(codecs.tier_in_scope(F.col("tier"), ("challenger", "Emerald", "unranked"))).select("c_custkey")


@query("prj_buckets_in_scope", f"SELECT c_custkey FROM customer WHERE upper(coalesce({TIER}, '')) NOT IN ('GRANDMASTER', 'GOLD', 'EMERALD')", ctes=NONE)
def prj_buckets_in_scope(b):
    """Players in the buckets that a scope of tiers reaches."""
    wanted = sorted(codecs.buckets_in_scope(("CHALLENGER", "unranked")))
    return players(b).filter(codecs.rank_bucket(F.col("tier")).isin(*wanted)).select("c_custkey")


@query("prj_route", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'americas' WHEN 1 THEN 'europe' WHEN 2 THEN 'asia' ELSE 'sea' END AS route FROM nation", ctes=NONE)
def prj_route(b):
    platform = F.element_at(F.array(*map(F.lit, ("na1", "euw1", "kr", "oc1"))), F.col("n_nationkey") % 4 + 1)
    return b.table("nation").select("n_nationkey", codecs.route(platform).alias("route"))


@query("prj_region_of_match", "SELECT DISTINCT match_id, split_part(match_id, '_', 1) AS region FROM b_players")
def prj_region_of_match(b):
    return b.players.select("match_id").distinct().withColumn("region", F.split_part("match_id", F.lit("_"), F.lit(1)))


@query("prj_placement_bucket", "SELECT board_id, CASE WHEN placement = 1 THEN 'first' WHEN placement <= 4 THEN 'top4' ELSE 'bottom' END AS bucket FROM b_players")
def prj_placement_bucket(b):
    p = F.col("placement")
    return b.players.select("board_id", F.when(p == 1, "first").when(p <= 4, "top4").otherwise("bottom").alias("bucket"))


@query("prj_classify_item", "SELECT DISTINCT item_id, CASE WHEN item_id = 'TFT_Item_BFSword' THEN 'component' WHEN lower(item_id) LIKE '%emblem%' THEN 'emblem' ELSE 'craftable' END AS kind FROM b_items")
def prj_classify_item(b):
    from ..config import COMPONENT_ITEMS

    ids = b.items.select("item_id").distinct()
    return ids.withColumn("kind", codecs.item_kind(F.col("item_id"), F.col("item_id").isin(*COMPONENT_ITEMS)))


@query("prj_rng_item", "SELECT p_partkey, p_partkey % 4 <> 3 AS rng FROM part", ctes=NONE)
def prj_rng_item(b):
    kinds = F.array(*map(F.lit, ("TFT_Item_Artifact_", "TFT5_Item_SwordRadiant", "TFT17_AnimaSquadItem_RadiantField", "TFT_Item_I")))
    item = F.concat(F.element_at(kinds, (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return b.table("part").select("p_partkey", codecs.rng_item(item).alias("rng"))


@query("flt_item_junk", "SELECT p_partkey, p_name FROM part WHERE p_type NOT LIKE '%BRUSHED%' AND p_partkey % 5 <> 0", ctes=NONE)
def flt_item_junk(b):
    """Part types stand for ids: brushed ones play those with a junk word."""
    ids = F.when(F.col("p_type").contains("BRUSHED"), "TFT_Item_Debug").otherwise("TFT_Item_Sword")
    names = F.when(F.col("p_partkey") % 5 == 0, "Tome of Traits").otherwise("Sword")
    return b.table("part").filter(~ids.rlike(codecs.ITEM_JUNK) & ~names.rlike(codecs.ITEM_NAME_JUNK)).select("p_partkey", "p_name")


@query("flt_text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND p_brand = 'Brand#1'", ctes=NONE)
def flt_text_search(b):
    return b.table("part").filter(F.lower("p_name").contains("a") & (F.col("p_brand") == "Brand#1")).select("p_partkey")


@query("flt_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^[A-Z]')", ctes=NONE)
def flt_regex(b):
    return b.table("part").filter(F.col("p_type").rlike("^[A-Z]")).select("p_partkey")


@query("flt_null_safe", "SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS DISTINCT FROM nullif(p_size, 8)", ctes=NONE)
def flt_null_safe(b):
    a, c = F.nullif("p_size", F.lit(7)), F.nullif("p_size", F.lit(8))
    return b.table("part").filter(~a.eqNullSafe(c)).select("p_partkey")



@query("flt_roster", "SELECT d.character_id FROM d_units d WHERE cost BETWEEN 1 AND 5 AND EXISTS (SELECT 1 FROM d_unit_traits t WHERE t.character_id = d.character_id)")
def flt_roster(b):
    return b.d_units.filter(F.col("cost").between(1, 5)).join(b.d_unit_traits, "character_id", "left_semi").select("character_id")


@query("flt_facets", "SELECT DISTINCT cost FROM d_units WHERE cost > 0")
def flt_facets(b):
    return b.d_units.filter("cost > 0").select("cost").distinct()


@query("flt_sanitize_board", """SELECT u.board_id, u.unit_row, u.character_id, coalesce((SELECT string_agg(item_id, '|' ORDER BY slot) FROM b_items i WHERE i.board_id = u.board_id AND i.unit_row = u.unit_row AND i.item_id <> 'TFT_Item_I8'), '') AS kept FROM b_units u JOIN d_units d USING (character_id)""")
def flt_sanitize_board(b):
    known = b.items.filter("item_id <> 'TFT_Item_I8'").groupBy("board_id", "unit_row").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("slot", "item_id"))), lambda x: x["item_id"]), 1, 3).alias("items"))
    units = b.units.join(F.broadcast(b.d_units.select("character_id")), "character_id", "left_semi")
    return units.join(known, ["board_id", "unit_row"], "left").select("board_id", "unit_row", "character_id", F.coalesce(joined("items"), F.lit("")).alias("kept"))


@query("bp_normalise", "SELECT trait_id, min_units, least(row_number() OVER (PARTITION BY trait_id ORDER BY min_units), 4)::INT AS style FROM d_breakpoints")
def bp_normalise(b):
    """Styles by position, four at most; a lone breakpoint gets 4."""
    own = Window.partitionBy("trait_id")
    rank, n = F.row_number().over(own.orderBy("min_units")), F.count(F.lit(1)).over(own)
    return b.d_breakpoints.withColumns({"r": rank, "n": n}).select("trait_id", "min_units", F.when(F.col("n") == 1, 4).otherwise(F.least("r", F.lit(4))).alias("style"))


@query("trait_style", """SELECT n AS units, t.trait_id, coalesce(max(CASE WHEN b.min_units <= n THEN CASE b.min_units WHEN 2 THEN 1 ELSE 2 END END), 0)::INT AS style FROM (SELECT unnest(generate_series(1, 6)) AS n) s CROSS JOIN (SELECT DISTINCT trait_id FROM d_breakpoints) t JOIN d_breakpoints b USING (trait_id) GROUP BY ALL""")
def trait_style(b):
    steps = bp_normalise(b).groupBy("trait_id").agg(F.array_sort(F.collect_list(F.struct("min_units", "style"))).alias("steps"))
    counts = steps.select("trait_id", "steps", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("units"))
    met = F.filter("steps", lambda s: s["min_units"] <= F.col("units"))
    return counts.select(F.col("units").cast("long").alias("units"), "trait_id", F.coalesce(F.try_element_at(met, F.lit(-1))["style"], F.lit(0)).alias("style"))


@query("trait_normalise", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 6 < 4 THEN 'TFT17_T' || (p_partkey % 6) ELSE 'TFT17_T' || (p_partkey % 6) || CASE WHEN p_partkey % 3 = 1 THEN '_x' ELSE '' END END AS trait_id FROM part", ctes=NONE)
def trait_normalise(b):
    """A variant's trait is its parent's where taking its last part off gives a known one."""
    k = F.col("p_partkey")
    raw = b.table("part").select("p_partkey", F.concat(F.lit("TFT17_T"), (k % 6).cast("string"), F.when(k % 3 == 1, "_x").otherwise("")).alias("raw"))
    known = F.broadcast(b.d_breakpoints.select(F.col("trait_id").alias("parent")).distinct())
    return raw.withColumn("stem", F.regexp_replace("raw", "_[^_]*$", "")).join(known, F.col("stem") == F.col("parent"), "left").select("p_partkey", F.coalesce("parent", "raw").alias("trait_id"))


@query("join_trait_name", "SELECT DISTINCT i.item_id, t.trait_id FROM b_items i JOIN (SELECT DISTINCT trait_id FROM d_breakpoints) t ON lower(replace(replace(i.item_id, 'TFT17_Item_', ''), 'EmblemItem', '')) = lower(replace(t.trait_id, 'TFT17_', '')) WHERE lower(item_id) LIKE '%emblem%'")
def join_trait_name(b):
    names = F.broadcast(b.d_breakpoints.select("trait_id", F.lower(F.replace(F.col("trait_id"), F.lit("TFT17_"), F.lit(""))).alias("name")).distinct())
    worn = b.items.select("item_id").distinct().withColumn("name", F.lower(F.regexp_extract("item_id", "_Item_(.*)EmblemItem$", 1)))
    return worn.join(names, "name").select("item_id", "trait_id")


@query("join_recipe", "SELECT a.p_partkey AS item, b.p_partkey AS part_a, c.p_partkey AS part_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey * 2 JOIN part c ON c.p_partkey = a.p_partkey * 2 + 1", ctes=NONE)
def join_recipe(b):
    """Both parts of an item or no row."""
    part = b.table("part").select("p_partkey")
    wanted = part.select(F.col("p_partkey").alias("item"), F.posexplode(F.array(F.col("p_partkey") * 2, F.col("p_partkey") * 2 + 1)).alias("pos", "p_partkey"))
    got = wanted.join(part, "p_partkey").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("pos", "p_partkey"))).alias("parts")).filter(F.size("parts") == 2)
    return got.select("item", F.col("parts")[0]["p_partkey"].alias("part_a"), F.col("parts")[1]["p_partkey"].alias("part_b"))


@query("join_resolve_names", "SELECT p.puuid, coalesce(c.c_mktsegment, substr(p.puuid, 1, 6) || '…') AS name FROM (SELECT DISTINCT puuid FROM b_players) p LEFT JOIN customer c ON 'P' || c.c_custkey = p.puuid AND c.c_custkey % 2 = 0")
def join_resolve_names(b):
    known = b.table("customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("P"), F.col("c_custkey")).alias("puuid"), F.col("c_mktsegment").alias("name"))
    short = F.concat(F.substring("puuid", 1, 6), F.lit("…"))
    return b.players.select("puuid").distinct().join(known, "puuid", "left").select("puuid", F.coalesce("name", short).alias("name"))


@query("join_hash_lookup", "SELECT u.board_id, u.unit_row, coalesce(d.cost, 0) AS cost FROM b_units u LEFT JOIN d_units d USING (character_id)")
def join_hash_lookup(b):
    return b.units.join(F.broadcast(b.d_units.select("character_id", "cost")), "character_id", "left").select("board_id", "unit_row", F.coalesce("cost", F.lit(0)).alias("cost"))


@query("join_array_contains", "SELECT u.character_id, t.trait_id FROM d_units u JOIN d_unit_traits t USING (character_id) WHERE regexp_matches(t.trait_id, '^TFT17_T[01]$')")
def join_array_contains(b):
    """Membership in an array, as an equality join on its elements."""
    arrays = b.d_unit_traits.groupBy("character_id").agg(F.collect_list("trait_id").alias("traits"))
    variants = b.d_breakpoints.select("trait_id").distinct().filter(F.col("trait_id").rlike("^TFT17_T[01]$"))
    return arrays.select("character_id", F.explode("traits").alias("trait_id")).join(F.broadcast(variants), "trait_id", "left_semi").select("character_id", "trait_id")


@query("join_lateral_unnest", "SELECT o_orderkey, k FROM orders, LATERAL (SELECT unnest(string_split(o_orderpriority, '-')) AS k)", ctes=NONE)
def join_lateral_unnest(b):
    return b.table("orders").select("o_orderkey", F.explode(F.split("o_orderpriority", "-")).alias("k"))


@query("join_semi_exists", "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000)", ctes=NONE)
def join_semi_exists(b):
    rich = b.table("supplier").filter("s_acctbal > 5000")
    return b.table("nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("n_name")


@query("join_anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", ctes=NONE)
def join_anti_not_exists(b):
    return b.table("customer").join(b.table("orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("join_anti_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", ctes=NONE)
def join_anti_not_in(b):
    used = b.table("lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return b.table("part").join(used, "p_partkey", "left_anti").select("p_partkey")


@query("join_update_values", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part", ctes=NONE)
def join_update_values(b):
    part = b.table("part")
    changes = part.filter("p_partkey % 10 = 0").select("p_partkey", (F.col("p_size") + 100).alias("new"))
    return part.join(changes, "p_partkey", "left").select("p_partkey", F.coalesce("new", "p_size").alias("p_size"))


@query("join_multi_membership", "SELECT g.k AS group_key, sum(s.n)::BIGINT AS n FROM stats s JOIN (VALUES (0), (1), (2)) AS g(k) ON s.comp_id % 2 = g.k % 2 OR s.comp_id % 3 = g.k GROUP BY 1", ctes=sql())
def join_multi_membership(b):
    from . import stages

    c = F.col("comp_id")
    groups = F.array_distinct(F.concat(F.when(c % 2 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(1))), F.array((c % 3).cast("int"))))
    return stages.stats(b).select("n", F.explode(groups).alias("group_key")).groupBy("group_key").agg(F.sum("n").alias("n"))


@query("fn_bin_hash", "SELECT p_partkey, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(lower(p_name || p_partkey), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) AS hash FROM part", ctes=NONE)
def fn_bin_hash(b):
    return b.table("part").select("p_partkey", codecs.fnv1a32(F.concat(F.col("p_name"), F.col("p_partkey").cast("string"))).alias("hash"))


@query("fn_bin_lookup", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 END::DOUBLE AS value FROM part", ctes=NONE)
def fn_bin_lookup(b):
    """A field by its name, or by the hash of its name where only that is kept."""
    fields = F.create_map(F.lit("speed"), F.lit(2.0), F.lit("{1b76cfed}"), F.lit(5.0))
    name = F.element_at(F.array(*map(F.lit, ("capstonead", "Speed", "none"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    hashed = F.concat(F.lit("{"), codecs.fnv1a32(name), F.lit("}"))
    return b.table("part").select("p_partkey", F.coalesce(F.try_element_at(fields, F.lower(name)), F.try_element_at(fields, hashed)).alias("value"))


def board_cells(b):
    placed = b.units.filter("unit_row <= 28")
    items = b.items.groupBy("board_id", "unit_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "item_id"))), lambda x: x["item_id"]).alias("it"))
    rows = placed.join(items, ["board_id", "unit_row"], "left")
    cell = F.struct((F.col("unit_row") - 1).alias("i"), F.col("character_id").alias("u"), F.coalesce("it", F.array().cast("array<string>")).alias("it"))
    return rows.groupBy("board_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


@query("fn_encode_board", """SELECT board_id, '1' || replace(replace(replace(base64(encode('[' || string_agg('{"i":' || (unit_row - 1) || ',"u":"' || character_id || '"' || CASE WHEN it IS NULL THEN '' ELSE ',"it":[' || it || ']' END || '}', ',' ORDER BY unit_row) || ']')), '=', ''), '+', '-'), '/', '_') AS code
    FROM b_units u LEFT JOIN (SELECT board_id, unit_row, string_agg('"' || item_id || '"', ',' ORDER BY slot) AS it FROM b_items GROUP BY ALL) i USING (board_id, unit_row) WHERE unit_row <= 28 GROUP BY 1""")
def fn_encode_board(b):
    return board_cells(b).select("board_id", codecs.encode_board(F.col("cells")).alias("code"))


@query("fn_decode_board", """SELECT board_id, string_agg(character_id, ' ' ORDER BY unit_row) AS units FROM b_units WHERE unit_row <= 28 GROUP BY 1""")
def fn_decode_board(b):
    cells = codecs.decode_board(codecs.encode_board(F.col("cells")))
    return board_cells(b).select("board_id", F.array_join(F.transform(cells, lambda c: c["u"]), " ").alias("units"))


CODES = "SELECT u.board_id, list(DISTINCT 1 + ascii(right(character_id, 1)) - 48 ORDER BY 1 + ascii(right(character_id, 1)) - 48) AS c FROM b_units u GROUP BY 1"


def unit_codes(b):
    code = (1 + F.ascii(F.right("character_id", F.lit(1))) - 48).alias("c")
    return b.units.groupBy("board_id").agg(F.array_sort(F.collect_set(code)).alias("codes"))


@query("fn_encode_riot", f"SELECT board_id, '02' || rpad(array_to_string(list_transform(c, lambda x: lpad(upper(to_hex(x)), 3, '0')), ''), 30, '0') || 'TFTSet17' AS code FROM ({CODES})")
def fn_encode_riot(b):
    return unit_codes(b).select("board_id", codecs.encode_planner(F.col("codes"), F.lit(17)).alias("code"))


@query("fn_decode_riot", f"SELECT board_id, array_to_string(c, ' ') AS codes FROM ({CODES})")
def fn_decode_riot(b):
    code = codecs.encode_planner(F.col("codes"), F.lit(17))
    return unit_codes(b).select("board_id", F.array_join(codecs.decode_planner(code).cast("array<string>"), " ").alias("codes"))


@query("fn_method_label", "SELECT event_id, CASE event_type WHEN 'view' THEN 'match.byId' WHEN 'click' THEN 'league.apex' ELSE 'other' END AS method FROM events", ctes=NONE)
def fn_method_label(b):
    path = F.when(F.col("event_type") == "view", "/tft/match/v1/matches/EUW1_1?x=1").when(F.col("event_type") == "click", "/tft/league/v1/challenger").otherwise("/other")
    return b.events.select("event_id", codecs.method_label(path).alias("method"))


@query("fn_retryable", "SELECT event_id, status, status IN (0, 401, 403, 429) OR status >= 500 AS retry FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 503 WHEN 5 THEN 401 ELSE 403 END AS status FROM events)", ctes=NONE)
def fn_retryable(b):
    status = F.element_at(F.array(*map(F.lit, (0, 200, 404, 429, 503, 401, 403))), (F.col("event_id") % 7 + 1).cast("int"))
    return b.events.select("event_id", status.alias("status")).withColumn("retry", codecs.retryable(F.col("status")))



@query("fn_ordinal", "SELECT n, n || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END AS name FROM (SELECT DISTINCT p_partkey % 120 + 1 AS n FROM part)", ctes=NONE)
def fn_ordinal(b):
    return b.keys(120).select((F.col("id") + 1).alias("n")).withColumn("name", codecs.ordinal(F.col("n")))


@query("fn_prettify", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part", ctes=NONE)
def fn_prettify(b):
    prefix = F.when(F.col("p_partkey") % 2 == 0, "TFT_Item_").otherwise("TFT17_")
    return b.table("part").select("p_partkey", codecs.prettify(F.concat(prefix, F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))).alias("name"))


@query("fn_rich_plain", "SELECT p_partkey, 'a ' || p_name || ' ' || p_type AS plain FROM part", ctes=NONE)
def fn_rich_plain(b):
    rich = F.concat(F.lit("a <i>"), F.col("p_name"), F.lit("</i> [[icon]] "), F.col("p_type"))
    return b.table("part").select("p_partkey", codecs.plain_text(rich).alias("plain"))


@query("fn_rarity", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Prismatic' WHEN 1 THEN 'Gold' WHEN 2 THEN 'Silver' END AS tier FROM part", ctes=NONE)
def fn_rarity(b):
    end = F.element_at(F.array(*map(F.lit, ("_III.tex", "-2.png", "_I", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return b.table("part").select("p_partkey", codecs.rarity(F.concat(F.lit("aug_of_"), F.split_part("p_name", F.lit(" "), F.lit(1)), end)).alias("tier"))



@query("fn_ability_map", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || '/' || 2 * p_size || '/' || 3 * p_size ELSE p_size::VARCHAR END AS text FROM part", ctes=NONE)
def fn_ability_map(b):
    """Values of an ability at one to three stars; one value where they are the same."""
    k, even = F.col("p_size"), F.col("p_partkey") % 2 == 0
    values = F.when(even, F.array(F.lit(0), k, 2 * k, 3 * k, F.lit(9))).otherwise(F.array(k, k, k, k))
    return b.table("part").select("p_partkey", F.array_join(F.array_distinct(F.slice(values, 2, 3)).cast("array<string>"), "/").alias("text"))


@query("rm_library", "SELECT character_id, cost, (SELECT string_agg(trait_id, '|' ORDER BY trait_id) FROM d_unit_traits t WHERE t.character_id = d.character_id) AS traits FROM d_units d WHERE cost BETWEEN 1 AND 5")
def rm_library(b):
    traits = b.d_unit_traits.groupBy("character_id").agg(joined(F.array_sort(F.collect_list("trait_id"))).alias("traits"))
    return b.d_units.filter(F.col("cost").between(1, 5)).join(traits, "character_id", "left").select("character_id", "cost", "traits")


@query("rm_planner", "SELECT t.trait_id, count(DISTINCT u.character_id)::BIGINT AS units, (SELECT string_agg(min_units::VARCHAR, '/' ORDER BY min_units) FROM d_breakpoints b WHERE b.trait_id = t.trait_id) AS steps FROM d_unit_traits t JOIN d_units u USING (character_id) GROUP BY t.trait_id")
def rm_planner(b):
    units = b.d_unit_traits.join(b.d_units, "character_id").groupBy("trait_id").agg(F.count_distinct("character_id").alias("units"))
    steps = b.d_breakpoints.groupBy("trait_id").agg(F.array_join(F.array_sort(F.collect_list("min_units")).cast("array<string>"), "/").alias("steps"))
    return units.join(steps, "trait_id")
