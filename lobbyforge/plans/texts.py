"""Queries of texts made from templates and of the trait engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import richtext
from ..operators import planner
from ..operators.itemization import emblem_trait
from .ops import NONE

#: Texts of the parts: a conditional block, spans in spans, a value by name, one by its hash, a series, an icon, a keyword, odd blanks.
TEMPLATE = (
    "<tftbold>%s</tftbold>:  gain <scaleAD>@AD*100@%% %%i:scaleAD%%</scaleAD><ShowIf.Augment>@AD@ <ShowIf.Inner>more</ShowIf.Inner>hidden</ShowIf.Augment>"
    "<br><magicDamage>@Levels*10@ ( <status>@CapstoneAD@</status> )</magicDamage> .<trueDamage>@Unknown@</trueDamage> {{TFT_Keyword_%s}}[[x]]&nbsp;%% %%i:nothing%%()"
)
WORDS = ("Burn", "chill", "Other")


def text_rows(b):
    part = b.dealt("part", "p_partkey", "p_type", "p_size")
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    pieces = TEMPLATE.replace("%%", "%").split("%s")
    template = F.concat(F.lit(pieces[0]), F.col("p_type"), F.lit(pieces[1]), word, F.lit(pieces[2]))
    numbers = F.create_map(F.lit("ad"), (F.col("p_size") / 100.0), F.lit("{1b76cfed}"), F.col("p_size") + 0.5)
    series = F.create_map(F.lit("LEVELS"), F.concat_ws("/", F.col("p_size"), F.col("p_size") * 2, F.lit("0.123456"), F.lit("n")))
    return part.select("p_partkey", template.alias("template"), numbers.alias("numbers"), series.alias("series"))


@query("fn_resolve_desc", """SELECT p_partkey, '«bold:' || p_type || '»: gain «ad:' || p_size || '% «icon:ad»»hidden' || chr(10) || '«magic:' || (p_size * 10) || '/' || (p_size * 20) || '/1.23/n («kw:' || p_size || '.5»)».'
    || CASE p_partkey % 3 WHEN 0 THEN ' «rules:«bold:Burn»: Deals a percent of the target''s max Health as true damage every second»' WHEN 1 THEN ' «rules:«bold:Chill»: Reduce Attack Speed»' ELSE '' END AS text FROM part""", ctes=NONE)
def fn_resolve_desc(b):
    return richtext.descriptions(text_rows(b), "template", "numbers", "series", "text").select("p_partkey", "text")


@query("fn_trait_content", """SELECT p_partkey, 0 AS place, p_name || ' for ' || 2 || ' allies.' AS line FROM part UNION ALL SELECT p_partkey, 1, CASE WHEN p_partkey % 2 = 0 THEN p_size || ' «icon:ad» of «kw:' || 1.5 || '» «icon:mr»' ELSE 'First ' || p_size || ' «icon:ad» «icon:mr»' END FROM part
    UNION ALL SELECT p_partkey, 2, CASE WHEN p_partkey % 2 = 0 THEN (p_size + 7) || ' «icon:ad» of «kw:' || 2.5 || '» «icon:mr»' ELSE 'Then ' || (p_size + 7) || ' «icon:ad» «icon:mr»' END FROM part
    UNION ALL SELECT p_partkey, 3, NULL FROM part WHERE p_partkey % 2 = 1""", ctes=NONE)
def fn_trait_content(b):
    """Even parts have one row that stands for both steps, odd ones a row a step and a step without a row."""
    step = lambda n, add, x: F.struct(F.lit(n).alias("min_units"), F.create_map(F.lit("Gain"), (F.col("p_size") + add).cast("double"), F.lit("X"), F.lit(x)).alias("vars"))
    steps, even = F.array(step(2, 0, 1.5), step(4, 7, 2.5)), F.col("p_partkey") % 2 == 0
    desc = F.concat(F.col("p_name"), F.lit(" for @MinUnits@ allies."), F.when(even, "<expandRow>(@MinUnits@) @Gain@  of <status>@X@</status></expandRow>").otherwise("<row>First @gain@</row><row>Then @gain@</row>"))
    rows = b.dealt("part", "p_partkey", "p_name", "p_size").select("p_partkey", desc.alias("desc"), F.when(even, steps).otherwise(F.concat(steps, F.array(step(6, 9, 3.5)))).alias("steps"), F.array(F.array(F.lit("ad")), F.array(F.lit("mr"))).alias("icons"))
    return richtext.trait_lines(rows, "p_partkey")


@query("fn_keyword", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Precision' WHEN 1 THEN 'Wound' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'Ability damage can critically strike. Additional Precision grants 10% Critical Strike Damage.' WHEN 1 THEN 'Reduces healing received' END AS text FROM part", ctes=NONE)
def fn_keyword(b):
    """What a reference to a keyword stands for, in any case; other references and unknown keywords stand for nothing."""
    ref = F.element_at(F.array(*map(F.lit, ("TFT_KEYWORD_precision", "tft_keyword_Wound", "TFT_Keyword_Luck", "TFT13_OnlyItem"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    name, text = richtext.keyword(ref)
    return b.table("part").select("p_partkey", name.alias("name"), text.alias("text"))


ICON_NAMES = (" Attack Damage", "scaleMR", "HP", "Crit Chance", "life steal", "durability", "Luck", "")


@query("fn_stat_icon", "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'ad' WHEN 1 THEN 'mr' WHEN 2 THEN 'health' WHEN 3 THEN 'crit' WHEN 4 THEN 'omnivamp' WHEN 5 THEN 'damagereduction' END AS icon FROM part", ctes=NONE)
def fn_stat_icon(b):
    """Statistics by the names of texts, grids and item lists."""
    name = F.element_at(F.array(*map(F.lit, ICON_NAMES)), (F.col("p_size") % 8 + 1).cast("int"))
    return b.table("part").select("p_partkey", richtext.stat_icon(name).alias("icon"))


@query("fn_active_traits", """, dbl(character_id, trait_id, c) AS (VALUES ('U3', 'TFT17_T3', 2), ('U4', 'TFT17_T0', 2)),
one AS (SELECT u.board_id, u.character_id, t.trait_id, coalesce(d.c, 1) AS c FROM (SELECT DISTINCT board_id, character_id FROM b_units) u JOIN d_unit_traits t USING (character_id) LEFT JOIN dbl d USING (character_id, trait_id)
    UNION ALL SELECT board_id, character_id, replace(replace(item_id, 'Item_', ''), 'EmblemItem', ''), 1 FROM b_items WHERE lower(item_id) LIKE '%emblem%'),
cnt AS (SELECT board_id, trait_id, sum(c)::BIGINT AS count FROM (SELECT board_id, trait_id, character_id, max(c) AS c FROM one GROUP BY ALL) GROUP BY ALL),
act AS (SELECT c.*, (SELECT count(*) FROM d_breakpoints d WHERE d.trait_id = c.trait_id AND d.min_units <= c.count)::INT AS style, (SELECT min(min_units) FROM d_breakpoints d WHERE d.trait_id = c.trait_id AND d.min_units > c.count)::INT AS next_at, (SELECT count(*) FROM d_breakpoints d WHERE d.trait_id = c.trait_id) = 1 AS is_unique FROM cnt c)
    SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY style DESC, count DESC, trait_id) AS place FROM act""")
def fn_active_traits(b):
    """Traits of every board: units that count twice, emblems that a unit with the trait wastes, style, next step and order."""
    doubled = b.spark.sql("SELECT * FROM VALUES ('U3', 'TFT17_T3', 2), ('U4', 'TFT17_T0', 2) AS t(character_id, trait_id, contribution)")
    styles = b.d_breakpoints.groupBy("trait_id").agg(F.array_sort(F.collect_list("min_units")).alias("m")).select("trait_id", F.posexplode("m").alias("i", "min_units")).select("trait_id", "min_units", (F.col("i") + 1).alias("style"))
    worn = b.items.filter(F.col("item_id").rlike("(?i)emblem")).select("board_id", "character_id", "item_id")
    emblems = worn.select("board_id", "character_id", emblem_trait(F.col("item_id")).alias("trait_id"))
    return planner.active_traits(b.units, b.d_unit_traits, doubled, emblems, styles, b.parts())
