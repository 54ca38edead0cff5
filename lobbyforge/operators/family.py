"""Groups as read models show them: emblem variants, who stands for them, pins, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import scoring
from .rollup import BUCKET, pool

KEY = ("gkey", *BUCKET)


def variants(members: DataFrame, config: Config) -> DataFrame:
    """(KEY, emblem, variant, ...): to which variant the comps of each emblem set belong.

    The base are the comps without emblem, else the most played set.  Another set stays a
    variant if its mean placement is better by a margin that its errors allow and it has
    boards enough; all others fold into the base.  ``shown`` marks the variant of the best
    score over all its boards, the base first among equals; ``variants`` counts them.
    """
    sets = pool(members, *KEY, "emblem")
    own = Window.partitionBy(*KEY)
    order = own.orderBy(F.col("emblem") != "", F.desc("n"), "emblem")
    avg = F.col("placement_sum") / F.col("n")
    rows = sets.withColumns({"sem": scoring.sem(), "avg": avg, "family_n": F.sum("n").over(own)})
    rows = rows.withColumns({"base": F.first("emblem").over(order), "base_avg": F.first("avg").over(order), "base_sem": F.first("sem").over(order)})
    square = F.col("sem") ** 2 + F.col("base_sem") ** 2
    swing = F.col("base_avg") - F.col("avg")
    least = F.greatest(F.lit(config.emblem_split_floor), F.ceil(config.emblem_split_fraction * F.col("family_n")))
    keep = (F.col("emblem") != "") & (F.col("emblem") != F.col("base")) & (swing >= config.emblem_split_swing) & (square > 0) & (swing >= config.emblem_split_k * F.sqrt(square)) & (F.col("n") >= least)
    rows = rows.withColumn("variant", F.when(keep, F.col("emblem")).otherwise(F.col("base")))
    own_n = F.max(F.when(F.col("emblem") == F.col("variant"), F.col("n"))).alias("own_n")
    folded = rows.groupBy(*KEY, "variant", "base", "family_n").agg(*(F.sum(c).cast("long").alias(c) for c in scoring.STATS), own_n)
    folded = folded.withColumn("score", scoring.shrunk_score(config))
    best = own.orderBy(F.desc("score"), F.col("variant") != F.col("base"), "variant")
    folded = folded.withColumns({"shown": F.row_number().over(best) == 1, "variants": F.count(F.lit(1)).over(own)})
    return rows.select(*KEY, "emblem", "variant").join(folded, [*KEY, "variant"])


def representatives(members: DataFrame, by: tuple[str, ...], config: Config) -> DataFrame:
    """(by..., representative, hit_share, carries...) of members with ``threes`` and ``named``.

    Where enough boards belong to comps that hold a named carry of a low cost at three stars,
    the comp with most of them stands for the group; else, and among equals, the one with most boards.
    Comps with a small part of the boards come last.  Without names, the carries are those three stars.
    """
    own = Window.partitionBy(*by)
    stars = F.size(F.array_intersect("threes", "named_cheap"))
    rows = members.withColumn("_stars", stars).withColumns({"_all": F.sum("n").over(own), "_hit": F.sum(F.when(F.col("_stars") > 0, F.col("n")).otherwise(0)).over(own)})
    usual = F.when(F.col("_hit") / F.col("_all") >= config.hit_share, F.col("_stars")).otherwise(0)
    small = F.col("n") < F.greatest(F.lit(config.representative_boards), F.ceil(config.representative_fraction * F.col("_all")))
    order = F.struct(small.alias("a"), (-usual).alias("b"), (-F.col("n")).alias("c"), F.col("comp_id").alias("d"))
    value = F.struct("comp_id", F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("threes")).alias("carries"))
    found = rows.groupBy(*by).agg(F.min_by(value, order).alias("_r"), (F.first("_hit") / F.first("_all")).alias("hit_share"))
    return found.select(*by, F.col("_r.comp_id").alias("representative"), F.col("_r.carries").alias("carries"), "hit_share")


def pins(members: DataFrame, manual: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by..., pinned): the tier set by hand for the member of most boards that has one."""
    rows = members.join(manual, ["comp_id", *BUCKET])
    return rows.groupBy(*by).agg(F.max_by("tier", F.struct("n", (-F.col("comp_id")).alias("i"))).alias("pinned"))


def band(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(0)) >= 9, "9+").when(level == 8, "8").otherwise("7-")


def detail_counts(boards: DataFrame, held: DataFrame, members: DataFrame, config: Config) -> DataFrame:
    """(KEY, part, item, sub, n, placement_sum, top4_count, win_count): every count of a group's page.

    Each board is met once.  It gives rows for all the grains it counts in, which are summed
    before they are shuffled: the group, level band, placement, day, three-star state, comp, each unit at
    its best star, and the completed items of each carry.  Rows of the group '' count a bucket's days.
    """
    star = F.least(F.coalesce(F.max("star_tier"), F.lit(1)), F.lit(3)).cast("string").alias("star")
    best = F.min_by(F.struct("done", "n_done"), F.struct((-F.col("n_done")).alias("a"), "unit_row"))
    units = held.groupBy("board_id", "character_id").agg(star, best.alias("best"))
    listed = F.collect_list(F.struct("character_id", "star", F.array_join("best.done", "|").alias("set"), F.col("best.n_done").alias("n_done")))
    rows = boards.join(units.groupBy("board_id").agg(listed.alias("units")), "board_id", "left").join(members, ["comp_id", *BUCKET], "left")
    day = F.date_format("game_datetime", "yyyy-MM-dd")
    cell = lambda part, item, sub=None: F.struct(F.col("gkey").alias("gkey"), F.lit(part).alias("part"), item.cast("string").alias("item"), (F.lit("") if sub is None else sub).alias("sub"))
    own = F.array(cell("boards", F.lit("")), cell("level", band(F.col("level"))), cell("place", F.col("placement")), cell("day", day), cell("state", F.col("state")), cell("comp", F.col("comp_id")))
    found = F.coalesce("units", F.array().cast("array<struct<character_id:string,star:string,set:string,n_done:int>>"))
    per_unit = F.transform(found, lambda u: cell("star", u["character_id"], u["star"]))
    built = F.filter(found, lambda u: F.col("builds") & F.array_contains("carries", u["character_id"]) & (u["n_done"] >= config.build_items))
    per_build = F.transform(built, lambda u: cell("build", u["character_id"], u["set"]))
    whole = F.array(F.struct(F.lit("").alias("gkey"), F.lit("bucket_day").alias("part"), day.alias("item"), F.lit("").alias("sub")))
    cells = F.when(F.col("gkey").isNull(), whole).otherwise(F.concat(whole, own, per_unit, per_build))
    flat = rows.select(*BUCKET, "placement", F.explode(cells).alias("x")).select(*BUCKET, "placement", "x.*")
    p = F.col("placement").cast("long")
    return flat.groupBy(*KEY, "part", "item", "sub").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("placement_sum"), F.count_if(p <= 4).alias("top4_count"), F.count_if(p == 1).alias("win_count"))


def page(counts: DataFrame, heads: DataFrame, costs: DataFrame, config: Config) -> DataFrame:
    """The parts of each group's page from its counts; one row a line.

    ``heads``: one row a group (KEY, carries); ``costs``: (character_id, cost).
    """
    n, none = F.col("n"), F.lit(None)
    rate = lambda c: F.col(c) / n
    measures = [(F.col("placement_sum") / n).alias("avg_placement"), rate("top4_count").alias("top4_rate"), rate("win_count").alias("win_rate")]
    whole = counts.filter("part = 'boards'").select(*KEY, n.alias("total"), (F.col("placement_sum") / n).alias("mean"))
    rows = counts.filter("gkey <> ''").join(whole, list(KEY))
    own = list(KEY)
    line = lambda df, part, item, share, detail=none, place=none, extra=(): df.select(*own, F.lit(part).alias("part"), item.cast("string").alias("item"), n.cast("long").alias("boards"), share.cast("double").alias("share"), *(extra or measures), detail.cast("string").alias("detail"), place.cast("int").alias("position"))

    share = n / F.col("total")
    filled = lambda part, items: whole.select(*own, "total", F.explode(F.array(*map(F.lit, items))).alias("item")).join(counts.filter(F.col("part") == part).drop("part", "sub"), [*own, "item"], "left").na.fill(0, ["n"])
    given = [F.when(n > 0, m).otherwise(0.0).alias(name) for m, name in zip(((F.col("placement_sum") / n), rate("top4_count"), rate("win_count")), ("avg_placement", "top4_rate", "win_rate"))]
    out = [line(filled("level", ("7-", "8", "9+")), "level", F.col("item"), share, extra=given), line(filled("place", [str(i) for i in range(1, 9)]), "place", F.col("item"), share, extra=given)]

    days = counts.filter("part = 'bucket_day'").select(*own[1:], "item", n.alias("in_bucket"))
    out.append(line(rows.filter("part = 'day'").join(days, [*own[1:], "item"]), "day", F.col("item"), n / F.col("in_bucket")))

    states = rows.filter("part = 'state'").withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("n"), "item")))
    kept = F.when(F.col("r") <= config.variant_cap, F.col("item")).otherwise("__other__")
    states = states.groupBy(*own, kept.alias("item"), F.least("r", F.lit(config.variant_cap + 1)).alias("r"), "total").agg(*(F.sum(c).alias(c) for c in ("n", "placement_sum", "top4_count", "win_count")))
    out.append(line(states, "state", F.col("item"), share, place=F.col("r")))
    hits = rows.filter("part = 'state'").groupBy(*own, "total").agg(F.sum(F.when(F.col("item") != "", n).otherwise(0)).alias("n"))
    nothing = [none.cast("double").alias(c) for c in ("avg_placement", "top4_rate", "win_rate")]
    out.append(line(hits, "hits_first", F.lit(""), share, detail=share >= config.hit_share, extra=nothing))

    top = rows.filter("part = 'comp'").withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("n"), F.col("item").cast("long")))).filter(F.col("r") <= config.top_boards)
    out.append(line(top, "board", F.col("item"), share, place=F.col("r")))

    sets = rows.filter("part = 'build'").withColumn("itemized", F.sum("n").over(Window.partitionBy(*own, "item"))).filter(n >= config.build_min_boards)
    sets = sets.withColumn("r", F.row_number().over(Window.partitionBy(*own, "item").orderBy(F.desc("n"), "sub"))).filter(F.col("r") <= config.build_cap)
    out.append(line(sets, "build", F.col("item"), n / F.col("itemized"), detail=F.col("sub"), place=F.col("r")))

    least = F.least(F.lit(config.unit_min_boards), F.greatest(F.lit(1), F.ceil(F.col("total") / 2)))
    stars = rows.filter("part = 'star'")
    units = stars.groupBy(*own, "item", "total", "mean").agg(*(F.sum(c).alias(c) for c in ("n", "placement_sum", "top4_count", "win_count")), F.max_by("sub", F.struct("n", (-F.col("sub").cast("int")).alias("s"))).alias("modal"))
    units = units.filter(n >= least).join(F.broadcast(costs.select(F.col("character_id").alias("item"), "cost")), "item").filter("cost <= 5").join(heads, own)
    units = units.withColumns({"freq": share, "named": F.array_contains("carries", F.col("item"))})
    units = units.withColumn("core", (F.col("freq") >= config.detail_core_freq) | F.col("named"))
    place = lambda *order: F.row_number().over(Window.partitionBy(*own, "core").orderBy(*order))
    units = units.withColumns({"cores": F.count_if("core").over(Window.partitionBy(*own)), "by_cost": place(F.desc("cost"), F.desc("freq"), "item"), "by_freq": place(F.desc("freq"), "item")})
    out.append(line(units, "unit", F.col("item"), F.col("freq"), detail=F.col("modal")))
    out.append(line(stars.filter(n >= least), "star", F.concat_ws("*", "item", "sub"), share))
    out.append(line(units.filter("core"), "core", F.col("item"), F.col("freq"), place=F.col("by_cost")))
    flex = ~F.col("core") & (F.col("freq") >= config.detail_flex_freq) & (F.col("by_freq") <= F.greatest(F.lit(0), F.least(F.lit(config.flex_cap), config.strip_units - F.col("cores"))))
    out.append(line(units.filter(flex), "flex", F.col("item"), F.col("freq"), place=F.col("by_freq")))
    done = out[0]
    for more in out[1:]:
        done = done.unionByName(more)
    return done
