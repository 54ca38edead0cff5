"""Queries of merge steps, weighted elections and the service around the engine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import service
from ..operators import itemization, merge
from ..sources import store
from . import stages
from .core import joined, r6
from .items import CARRIES, FRAME, comp_boards, comp_rates, emblems_of
from .merging import SETS, WHOLE, kinds_alike, stored_archetypes, stored_profiles, unit_classes, unit_sets
from .ops import NONE
from .stages import sql

ALL = sql()


def traced(b):
    """The passes, step by step: run once, as the queries below all read what they did."""
    return b.once("trace", lambda: merge.trace_profiles(stored_profiles(b), b.config))


@query("mrg_pass1", stored=True)
def mrg_pass1(b):
    return traced(b).select("comp_id", "pass1")


@query("mrg_pass2_fold", stored=True)
def mrg_pass2_fold(b):
    return traced(b).select("comp_id", "pass1", "pass2")


@query("mrg_pass3_refine", stored=True)
def mrg_pass3_refine(b):
    return traced(b).select("comp_id", "pass2", "pass3")


@query("mrg_pass4_label", stored=True)
def mrg_pass4_label(b):
    return traced(b).select("comp_id", "label")


@query("mrg_debug", stored=True)
def mrg_debug(b):
    """Comps that their own archetype would not take today, with the reason."""
    return traced(b).filter("reason <> ''").select("comp_id", "label", "reason")


@query("mrg_tail", stored=True)
def mrg_tail(b):
    """Comps of few boards and the archetype they were assigned to."""
    return merge.tail_labels(stored_profiles(b), stored_archetypes(b), b.config)


@query("mrg_eval", stored=True)
def mrg_eval(b):
    """Pairs of comps with a wanted outcome against what the merge did with them, counted for each comp by verdict.

    Wanted: pairs whose unit sets agree nine tenths are to merge, pairs whose classes (copies,
    gated units, heroes) differ are not.  Known failures: the units agree, but the carries have
    nothing in common.
    """
    units, links = unit_classes(b, 4)
    made = stored_profiles(b).select("comp_id", F.struct("copy_sig", "gated_sig", "hero_sig").alias("sig"), F.coalesce("carries", F.array().cast("array<string>")).alias("carries"))
    comps = units.select("comp_id", "units", F.col("class_id").alias("set_id")).join(made, "comp_id").join(stages.labels(b), "comp_id", "left")
    classes = store.saved(merge.set_classes(comps, "set_id", "sig", "carries", "meta_comp"), "eval")
    close = F.col("shared") >= 0.9 * F.greatest("sa", "sb")
    near = links.select(F.col("a").alias("set_id"), F.col("b").alias("other"), close.alias("close")).unionAll(links.select("b", "a", close))
    own = units.filter("comp_id = class_id").select("class_id", "class_id", F.lit(True))
    return merge.evaluated_classes(classes, near.unionAll(own))


PAIRS = SETS + """, pr AS (SELECT p.a, p.b, p.shared, za.size AS sa, zb.size AS sb FROM (SELECT x.comp_id AS a, y.comp_id AS b, count(*) AS shared FROM s x JOIN s y ON x.unit = y.unit AND x.comp_id < y.comp_id GROUP BY ALL) p
    JOIN z za ON za.comp_id = p.a JOIN z zb ON zb.comp_id = p.b WHERE shared >= 0.54 / 1.54 * (za.size + zb.size) - 1e-9)"""


#: Profiles and their comparison, as they are written down: sets are tables of (comp, unit).
COMPARE = PAIRS + CARRIES + """, tt AS (SELECT comp_id, sum(n) AS boards, max(n) >= 3 AS known FROM stats GROUP BY 1), lv AS (SELECT comp_id, avg(level) AS level FROM clustered WHERE comp_id IS NOT NULL GROUP BY 1),
cs AS (SELECT DISTINCT ('0x' || substr(md5(signature), 1, 15))::BIGINT AS comp_id, core_units, three_stars, worn FROM signed),
raw AS (SELECT comp_id, unnest(string_split(core_units, '|')) AS u FROM cs), cu AS (SELECT DISTINCT comp_id, u FROM raw), th AS (SELECT DISTINCT comp_id, unnest(string_split(three_stars, '|')) AS u FROM cs WHERE three_stars <> ''),
ca AS (SELECT c.comp_id, c.character_id AS u, c.damage_rate >= 0.25 AS hurts FROM carry c JOIN tt ON tt.comp_id = c.comp_id WHERE tt.known),
rt AS (SELECT cu.comp_id, cu.u, tt.known, d.cost, coalesce(r.full_rate, 0) AS f, coalesce(r.top_rate, 0) AS t, coalesce(r.damage_rate, 0) AS h, th.u IS NOT NULL AS third, ca.u IS NOT NULL AS carries FROM cu JOIN tt ON tt.comp_id = cu.comp_id JOIN d_units d ON d.character_id = cu.u
    LEFT JOIN rates r ON r.comp_id = cu.comp_id AND r.character_id = cu.u LEFT JOIN th ON th.comp_id = cu.comp_id AND th.u = cu.u LEFT JOIN ca ON ca.comp_id = cu.comp_id AND ca.u = cu.u),
wt AS (SELECT comp_id, u, CASE WHEN NOT known OR third OR carries OR t >= 0.5 THEN 1.0 WHEN cost >= 4 AND f < 0.25 AND t < 0.25 THEN 0.25 ELSE 0.7 END::DOUBLE AS w, third AND (NOT known OR carries OR t >= 0.5) AS hit, CASE WHEN known AND third AND u IN ('U0', 'U1') THEN h END AS hero FROM rt),
hs AS (SELECT comp_id, arg_min(u, (-hero, u)) AS hero_sig FROM wt WHERE hero >= 0.5 GROUP BY 1),
cp2 AS (SELECT comp_id, string_agg(u, '|' ORDER BY u) AS copy_sig FROM (SELECT comp_id, u FROM raw JOIN d_units d ON d.character_id = u WHERE cost <= 3 GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1),
gs AS (SELECT comp_id, string_agg(u, '|' ORDER BY u) AS gated_sig FROM cu WHERE u IN ('U2', 'U5') GROUP BY 1),
tn AS (SELECT comp_id, trait_id, count(*) AS k FROM (SELECT cu.comp_id, t.trait_id FROM cu JOIN d_unit_traits t ON t.character_id = cu.u UNION ALL SELECT comp_id, replace(replace(replace(unnest(string_split(worn, '|')), 'emb:', ''), 'Item_', ''), 'EmblemItem', '') FROM cs WHERE worn <> '') GROUP BY ALL),
fr AS (SELECT tn.comp_id, tn.trait_id, count(*)::DOUBLE AS x FROM tn JOIN d_breakpoints d ON d.trait_id = tn.trait_id AND d.min_units <= tn.k GROUP BY ALL), fq AS (SELECT comp_id, sum(x * x) AS q FROM fr GROUP BY 1),
one AS (SELECT tt.comp_id, boards, level, coalesce(hero_sig, '') AS hero_sig, coalesce(copy_sig, '') AS copy_sig, coalesce(gated_sig, '') AS gated_sig, (SELECT count(*) FROM ca WHERE ca.comp_id = tt.comp_id) AS nc, (SELECT count(*) FROM ca WHERE ca.comp_id = tt.comp_id AND hurts) AS nd,
    (SELECT count(*) FROM wt WHERE wt.comp_id = tt.comp_id AND hit) AS nh, (SELECT sum(w) FROM wt WHERE wt.comp_id = tt.comp_id) AS sw, (SELECT count(*) FROM ca JOIN cu ON cu.comp_id = ca.comp_id AND cu.u = ca.u WHERE ca.comp_id = tt.comp_id) AS nf, fq.q
    FROM tt JOIN lv ON lv.comp_id = tt.comp_id LEFT JOIN hs ON hs.comp_id = tt.comp_id LEFT JOIN cp2 ON cp2.comp_id = tt.comp_id LEFT JOIN gs ON gs.comp_id = tt.comp_id LEFT JOIN fq ON fq.comp_id = tt.comp_id),
cc AS (SELECT pr.a, pr.b, count(*) AS both_c, count(*) FILTER (WHERE x.hurts AND y.hurts) AS both_d FROM pr JOIN ca x ON x.comp_id = pr.a JOIN ca y ON y.comp_id = pr.b AND y.u = x.u GROUP BY ALL),
ab AS (SELECT pr.a, pr.b, count(*) AS a_in_b FROM pr JOIN ca x ON x.comp_id = pr.a JOIN cu y ON y.comp_id = pr.b AND y.u = x.u GROUP BY ALL), ba AS (SELECT pr.a, pr.b, count(*) AS b_in_a FROM pr JOIN ca x ON x.comp_id = pr.b JOIN cu y ON y.comp_id = pr.a AND y.u = x.u JOIN cu z ON z.comp_id = pr.b AND z.u = x.u GROUP BY ALL),
ww AS (SELECT pr.a, pr.b, sum((x.w + y.w) / 2) AS both_w, count(*) FILTER (WHERE x.hit AND y.hit) AS both_h FROM pr JOIN wt x ON x.comp_id = pr.a JOIN wt y ON y.comp_id = pr.b AND y.u = x.u GROUP BY ALL),
ff AS (SELECT pr.a, pr.b, sum(least(x.x, y.x) * greatest(x.x, y.x)) AS num, sum(least(x.x, y.x) * least(x.x, y.x)) AS low FROM pr JOIN fr x ON x.comp_id = pr.a JOIN fr y ON y.comp_id = pr.b AND y.trait_id = x.trait_id GROUP BY ALL),
ol AS (SELECT pr.a, pr.b, x.boards, x.level AS la, y.level AS lb, x.copy_sig <> y.copy_sig AS copies, x.gated_sig <> y.gated_sig AS gates, x.hero_sig AS ha, y.hero_sig AS hb, x.nc, y.nc AS nc_b, x.nh > 0 AND y.nh > 0 AND both_h = 0 AS hits, both_w / least(x.sw, y.sw) AS c, both_w / (x.sw + y.sw - both_w) AS j,
    CASE WHEN x.q IS NULL OR y.q IS NULL THEN -1 ELSE coalesce(num, 0) / (x.q + y.q - coalesce(low, 0)) END AS s,
    CASE WHEN x.nd > 0 AND y.nd > 0 AND coalesce(both_d, 0) > 0 THEN 2 * both_d / (x.nd + y.nd) WHEN x.nd > 0 AND y.nd > 0 THEN 2 * coalesce(both_c, 0) / (x.nc + y.nc) WHEN x.nc = 0 AND y.nc = 0 THEN 1 WHEN x.nc = 0 THEN CASE WHEN y.nf = 0 THEN 1 ELSE coalesce(b_in_a, 0) / y.nf END
        WHEN y.nc = 0 THEN coalesce(a_in_b, 0) / x.nc ELSE 2 * coalesce(both_c, 0) / (x.nc + y.nc) END::DOUBLE AS o
    FROM pr JOIN one x ON x.comp_id = pr.a JOIN one y ON y.comp_id = pr.b JOIN ww USING (a, b) LEFT JOIN cc USING (a, b) LEFT JOIN ab USING (a, b) LEFT JOIN ba USING (a, b) LEFT JOIN ff USING (a, b)),
lim AS (SELECT *, 0.45 * c + 0.35 * j + 0.2 * o AS score, CASE WHEN o >= 0.75 - 1e-9 THEN 0.06 ELSE 0 END + CASE WHEN nc > 0 AND s >= 0.65 - 1e-9 THEN 0.12 ELSE 0 END AS sj, CASE WHEN o >= 0.75 - 1e-9 THEN 0.06 ELSE 0 END + CASE WHEN nc > 0 AND s >= 0.65 - 1e-9 THEN 0.15 ELSE 0 END AS ss,
    CASE WHEN nc = 0 AND nc_b > 0 THEN 0.02 ELSE 0 END AS margin, ha <> hb AND ((ha <> '' AND hb <> '') OR coalesce(CASE WHEN ha <> '' THEN CASE WHEN nc_b > 0 THEN (SELECT hero FROM wt WHERE wt.comp_id = ol.b AND wt.u = ol.ha) END ELSE (SELECT hero FROM wt WHERE wt.comp_id = ol.a AND wt.u = ol.hb) END, 0) <= 0.2 + 1e-9) AS heroes FROM ol)
SELECT a, b, round(score, 6) AS score, CASE WHEN hits AND boards >= 10 THEN 'grade3_conflict' WHEN copies THEN 'copy_class' WHEN heroes THEN 'hero_augment' WHEN abs(la - lb) >= 1.75 - 1e-9 THEN 'level_gap' WHEN gates THEN 'gated_class' WHEN o < 0.34 - 1e-9 THEN 'carry_overlap' WHEN s >= 0 AND s < 0.2 - 1e-9 THEN 'trait_frame'
    WHEN c < 0.75 - 1e-9 THEN 'containment' WHEN j < 0.6 - sj - 1e-9 THEN 'jaccard' WHEN score < 0.78 + margin - ss - 1e-9 THEN 'score' ELSE '' END AS reason FROM lim"""


@query("mrg_compare", COMPARE, ctes=ALL, stored=True)
def mrg_compare(b):
    """Similar comps one against the other: score, and the first reason why they are not one archetype."""
    return merge.compare_classes(*unit_classes(b, 4), stored_profiles(b), b.config).select("a", "b", r6("score").alias("score"), "reason")


def weighed_classes(b):
    """Comps by their units and what each weighs."""
    units = F.array_sort("units")
    weight = lambda u: F.coalesce(F.try_element_at("weights", u), F.lit(1.0))
    return merge.set_classes(stored_profiles(b).select("comp_id", units.alias("units"), F.transform(units, weight).alias("weights")), "weights")


#: What each unit of a comp weighs, with the tables it rests on.
WEIGHED = CARRIES + COMPARE[COMPARE.index(", tt AS") : COMPARE.index("hs AS")].rstrip().rstrip(",")


@query("mrg_overlap", WEIGHED + """, sw AS (SELECT comp_id, round(sum(w), 6) AS w FROM wt GROUP BY 1),
    ov AS (SELECT x.comp_id AS a, y.comp_id AS b, count(*) AS shared, round(sum((x.w + y.w) / 2), 6) AS common FROM wt x JOIN wt y ON x.u = y.u AND x.comp_id < y.comp_id GROUP BY ALL)
    SELECT a, b, round(common / least(za.w, zb.w), 6) AS containment, round(common / (za.w + zb.w - common), 6) AS jaccard FROM ov JOIN sw za ON za.comp_id = a JOIN sw zb ON zb.comp_id = b WHERE shared >= 0.54 / 1.54 * (za.w + zb.w) - 1e-9""", ctes=ALL, stored=True)
def mrg_overlap(b):
    """Weighted containment and Jaccard of all pairs of comps that share units enough for their weights; a unit of both weighs the mean of its two."""
    c, bound = b.config, 0.54 / 1.54
    least = bound * min(c.merge_weight_core, c.merge_weight_flex, 1.0)  # what units weigh at least: no pair of other unit sets meets the bound
    kinds, met = kinds_alike(b, "weighed", lambda: weighed_classes(b), least / (1 - least), "weights")
    total = lambda side: r6(F.aggregate(f"{side}.weights", F.lit(0.0), lambda s, w: s + w)).alias(f"w{side}")
    mean = lambda e: (e["weights"] + F.get("q.weights", F.array_position("q.units", e["units"]).cast("int") - 1)) / 2
    both = r6(F.aggregate(F.arrays_zip("p.units", "p.weights"), F.lit(0.0), lambda s, e: s + F.coalesce(mean(e), F.lit(0.0))))
    found = met.select("a", "b", "na", "nb", "shared", both.alias("both"), total("p"), total("q")).filter(F.col("shared") >= bound * (F.col("wp") + F.col("wq")) - 1e-9)
    values = r6(F.col("both") / F.least("wp", "wq")).alias("containment"), r6(F.col("both") / (F.col("wp") + F.col("wq") - F.col("both"))).alias("jaccard")
    links = b.once("weighed_pairs", lambda: found.select("a", "b", "na", "nb", *values))
    return merge.expanded(kinds, links).drop("p", "q")


def framed_classes(b):
    """Comps by their units and trait frames.

    Boards of a comp with the same units and emblems have one frame, so each such shape is reckoned once.
    """
    ids = comp_boards(b).select("board_id", "comp_id")
    fielded = b.units.join(ids, "board_id").groupBy("board_id", "comp_id").agg(F.array_sort(F.collect_set("character_id")).alias("fielded"))
    worn = emblems_of(b).groupBy("board_id").agg(F.array_sort(F.collect_list("trait_id")).alias("worn"))
    shapes = fielded.join(worn, "board_id", "left").select("comp_id", "fielded", F.coalesce("worn", F.array().cast("array<string>")).alias("worn")).distinct()
    shapes = store.saved(shapes.withColumn("board_id", F.monotonically_increasing_id()), "shapes")
    frame = itemization.trait_frame(shapes.select("board_id", F.explode("fielded").alias("character_id")), b.d_unit_traits, shapes.select("board_id", F.explode("worn").alias("trait_id")), b.d_breakpoints)
    levels = shapes.select("board_id", "comp_id").join(frame, "board_id").groupBy("comp_id", "trait_id").agg(F.max("level").cast("double").alias("x"))
    frames = levels.groupBy("comp_id").agg(F.array_sort(F.collect_list(F.struct("trait_id", "x"))).alias("frame"))
    sets = unit_sets(b).groupBy("comp_id").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    return merge.set_classes(sets.join(frames, "comp_id", "left"), "frame")


@query("mrg_trait_sim", WHOLE + FRAME.replace("inn AS", "inn AS", 1) + """, cf AS (SELECT c.comp_id, f.trait_id, max(f.level)::DOUBLE AS x FROM frame f JOIN clustered c USING (board_id) WHERE c.comp_id IS NOT NULL GROUP BY ALL), sq AS (SELECT comp_id, sum(x * x) AS q FROM cf GROUP BY 1),
    sh AS (SELECT pr.a, pr.b, sum(least(fa.x, fb.x) * greatest(fa.x, fb.x)) AS num, sum(least(fa.x, fb.x) * least(fa.x, fb.x)) AS low FROM pr JOIN cf fa ON fa.comp_id = pr.a JOIN cf fb ON fb.comp_id = pr.b AND fb.trait_id = fa.trait_id GROUP BY ALL)
    SELECT pr.a, pr.b, round(CASE WHEN qa.q IS NULL OR qb.q IS NULL THEN -1 ELSE coalesce(num, 0) / (qa.q + qb.q - coalesce(low, 0)) END, 6) AS similarity FROM pr LEFT JOIN sh USING (a, b) LEFT JOIN sq qa ON qa.comp_id = pr.a LEFT JOIN sq qb ON qb.comp_id = pr.b""", ctes=ALL, stored=True)
def mrg_trait_sim(b):
    """Shared activation of the trait frames of all pairs of comps that are alike, over squared peaks; -1 where one is unknown."""
    kinds, met = kinds_alike(b, "framed", lambda: framed_classes(b), 0.54, "frame")
    met = met.withColumns({"fa": F.col("p.frame"), "fb": F.col("q.frame")})
    level = lambda frame, trait: F.coalesce(F.get(F.filter(frame, lambda e: e["trait_id"] == trait), F.lit(0))["x"], F.lit(0.0))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    square = lambda frame: total(F.transform(frame, lambda e: e["x"] * e["x"]))
    both = F.transform("fa", lambda e: F.struct(F.least(e["x"], level(F.col("fb"), e["trait_id"])).alias("low"), F.greatest(e["x"], level(F.col("fb"), e["trait_id"])).alias("high")))
    num, low = total(F.transform(both, lambda e: e["low"] * e["high"])), total(F.transform(both, lambda e: e["low"] * e["low"]))
    value = F.when(F.col("fa").isNull() | F.col("fb").isNull(), -1.0).otherwise(num / (square(F.col("fa")) + square(F.col("fb")) - low))
    links = b.once("framed_pairs", lambda: met.select("a", "b", "na", "nb", r6(value).alias("similarity")))
    return merge.expanded(kinds, links).drop("p", "q")


@query("prof_tail", "SELECT DISTINCT ('0x' || substr(md5(signature), 1, 15))::BIGINT AS comp_id, core_units, three_stars AS grade3 FROM signed", ctes=ALL)
def prof_tail(b):
    """Profiles by presence alone: units and all three-star units."""
    return stages.comps(b).select("comp_id", joined("core_units").alias("core_units"), joined("three_stars").alias("grade3"))


ELECT = CARRIES + """, ev AS (SELECT k.gkey, c.character_id, sum(k.n) AS w FROM carry c JOIN (SELECT comp_id, gkey, sum(n) AS n FROM keyed GROUP BY ALL) k USING (comp_id) GROUP BY ALL),
tw AS (SELECT k.gkey, sum(k.n) AS t FROM (SELECT comp_id, gkey, sum(n) AS n FROM keyed GROUP BY ALL) k WHERE k.comp_id IN (SELECT comp_id FROM carry) GROUP BY 1)"""


@query("agg_weighted_election", ELECT + "SELECT gkey, character_id, round(w / t, 6) AS share FROM (SELECT ev.*, tw.t, max(w / t) OVER (PARTITION BY gkey) AS top, row_number() OVER (PARTITION BY gkey ORDER BY w DESC, character_id) AS r FROM ev JOIN tw USING (gkey)) WHERE w / t >= 0.4 OR (top < 0.4 AND r = 1)", ctes=ALL)
def agg_weighted_election(b):
    """Carries with a share of a group's weight, or the one with most."""
    carry = itemization.carries(comp_rates(b), b.config).select("comp_id", "character_id")
    weight = stages.keyed(b).groupBy("gkey", "comp_id").agg(F.sum("n").alias("n"))
    voted = weight.join(carry, "comp_id").groupBy("gkey", "character_id").agg(F.sum("n").alias("w"))
    total = weight.join(carry, "comp_id", "left_semi").groupBy("gkey").agg(F.sum("n").alias("t"))
    share = F.col("w") / F.col("t")
    own = Window.partitionBy("gkey")
    rows = voted.join(total, "gkey").withColumn("share", share)
    rows = rows.withColumns({"top": F.max("share").over(own), "r": F.row_number().over(own.orderBy(F.desc("w"), "character_id"))})
    limit = b.config.merge_dominant
    return rows.filter((F.col("share") >= limit) | ((F.col("top") < limit) & (F.col("r") == 1))).select("gkey", "character_id", r6("share").alias("share"))


@query("agg_accumulate", """, w AS (SELECT comp_id, gkey, sum(n) AS n FROM keyed GROUP BY ALL), u AS (SELECT DISTINCT ('0x' || substr(md5(signature), 1, 15))::BIGINT AS comp_id, unnest(list_distinct(string_split(core_units, '|'))) AS unit FROM signed)
    SELECT w.gkey, u.unit, sum(w.n)::BIGINT AS weight FROM w JOIN u USING (comp_id) GROUP BY ALL""", ctes=ALL)
def agg_accumulate(b):
    """Board-weighted units of each group: sums, so members may come in any order."""
    units = stages.comps(b).select("comp_id", F.explode(F.array_distinct("core_units")).alias("unit"))
    return stages.keyed(b).select("gkey", "comp_id", "n").join(units, "comp_id").groupBy("gkey", "unit").agg(F.sum("n").alias("weight"))


MEAN = FRAME + """, cf AS (SELECT c.comp_id, f.trait_id, max(f.level) AS x FROM frame f JOIN clustered c USING (board_id) WHERE c.comp_id IS NOT NULL GROUP BY ALL), w AS (SELECT comp_id, gkey, sum(n) AS n FROM keyed GROUP BY ALL),
tw AS (SELECT gkey, sum(n) AS t FROM w WHERE comp_id IN (SELECT comp_id FROM cf) GROUP BY 1), mf AS (SELECT w.gkey, cf.trait_id, sum(cf.x * w.n) / max(tw.t) AS mean FROM cf JOIN w USING (comp_id) JOIN tw USING (gkey) GROUP BY w.gkey, cf.trait_id)"""


def mean_frames(b):
    frame = itemization.trait_frame(b.units, b.d_unit_traits, emblems_of(b), b.d_breakpoints, b.parts())
    cf = comp_boards(b).select("board_id", "comp_id").join(frame, "board_id").groupBy("comp_id", "trait_id").agg(F.max("level").alias("x"))
    weight = stages.keyed(b).groupBy("gkey", "comp_id").agg(F.sum("n").alias("n"))
    total = weight.join(cf, "comp_id", "left_semi").groupBy("gkey").agg(F.sum("n").alias("t"))
    return cf.join(weight, "comp_id").groupBy("gkey", "trait_id").agg(F.sum(F.col("x") * F.col("n")).alias("s")).join(total, "gkey").select("gkey", "trait_id", (F.col("s") / F.col("t")).alias("mean"))


@query("agg_weighted_mean_frame", MEAN + "SELECT gkey, trait_id, round(mean, 6) AS mean FROM mf", ctes=ALL)
def agg_weighted_mean_frame(b):
    return mean_frames(b).select("gkey", "trait_id", r6("mean").alias("mean"))



@query("trait_style_vm", "SELECT board_id, trait_id, greatest(level, 0)::INT AS style FROM frame", ctes=sql("ranked") + FRAME)
def trait_style_vm(b):
    """Style by the breakpoints met, or what the payload says where a trait has none."""
    frame = itemization.trait_frame(b.units, b.d_unit_traits, emblems_of(b), b.d_breakpoints, b.parts())
    return frame.select("board_id", "trait_id", F.greatest("level", F.lit(0)).alias("style"))


@query("flt_show_breakpoints", "SELECT trait_id, count(*) > 1 AS shown FROM d_breakpoints GROUP BY 1")
def flt_show_breakpoints(b):
    """A lone breakpoint without text of its own is not shown."""
    return b.d_breakpoints.groupBy("trait_id").agg((F.count(F.lit(1)) > 1).alias("shown"))


@query("api_http", "SELECT c_custkey, CASE WHEN c_nationkey >= 16 THEN 400 WHEN c_acctbal > 9000 THEN 429 WHEN c_acctbal < -900 THEN 502 WHEN c_custkey % 7 = 0 THEN 404 ELSE 200 END AS status FROM customer", ctes=NONE)
def api_http(b):
    status = service.http_status(F.col("c_nationkey") < 16, F.col("c_name"), F.col("c_custkey") % 7 != 0, F.col("c_acctbal") > 9000, F.col("c_acctbal") >= -900)
    return b.table("customer").select("c_custkey", status.alias("status"))


@query("fn_trait_contribution", "SELECT character_id, trait_id, CASE WHEN character_id = 'U3' AND trait_id = 'TFT17_T3' THEN 2 ELSE 1 END AS contribution FROM d_unit_traits")
def fn_trait_contribution(b):
    double = F.col("character_id").rlike("^U3$") & F.col("trait_id").rlike("T3$")
    return b.d_unit_traits.select("character_id", "trait_id", F.when(double, 2).otherwise(1).alias("contribution"))


@query("fn_emblem_desc", "SELECT DISTINCT item_id, 'The holder gains the ' || replace(replace(item_id, 'TFT17_Item_', ''), 'EmblemItem', '') || ' trait.' AS text FROM b_items WHERE lower(item_id) LIKE '%emblem%'")
def fn_emblem_desc(b):
    worn = b.items.select("item_id").distinct().filter(F.col("item_id").rlike("(?i)emblem"))
    return worn.withColumn("text", F.concat(F.lit("The holder gains the "), F.regexp_extract("item_id", "_Item_(.*)EmblemItem$", 1), F.lit(" trait.")))
