"""What pages are served from: selectors, boards as text, recent matches, summaries, pages of a ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order

#: Ranks as selectors list them; others follow by name (fixed values of the domain).
BUCKETS = ("challenger", "master_plus", "apex_mixed", "diamond", "plat_emerald", "iron_gold", "all", "unknown")


def options(rows: DataFrame, key: str, by: list[Column], wanted=None) -> DataFrame:
    """Adds place and chosen: the wanted option where it is there, else the first."""
    every = Window.partitionBy(F.lit(0))  # a row an option
    mine = F.lit(False) if wanted is None else F.col(key).eqNullSafe(F.lit(wanted))
    placed = rows.withColumn("place", F.row_number().over(every.orderBy(*by)))
    return placed.withColumn("chosen", F.when(F.max(mine).over(every), mine).otherwise(F.col("place") == 1))


def selection(totals: DataFrame, patches: DataFrame, patch_id: int | None = None, region: str | None = None, bucket: str | None = None) -> DataFrame:
    """(part, place, option, boards, chosen) of the selectors of patch, region and rank.

    ``totals`` has boards by patch_id, region and rank_bucket.  Patches: current first, then by boards; regions of the
    chosen patch by boards; ranks of both in their own order.  Without totals there are no options.
    """

    def summed(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.sum("boards").alias("boards"))

    known = summed(totals, "patch_id").join(F.broadcast(patches.select("patch_id", "patch", "is_current")), "patch_id", "left")
    first = options(known, "patch_id", [F.desc(F.coalesce("is_current", F.lit(False))), F.desc("boards"), F.asc("patch_id")], patch_id)
    of_patch = totals.join(F.broadcast(first.filter("chosen").select("patch_id")), "patch_id", "left_semi")
    second = options(summed(of_patch, "region"), "region", [F.desc("boards"), F.asc("region")], region)
    of_both = of_patch.join(F.broadcast(second.filter("chosen").select("region")), "region", "left_semi")
    rank = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("rank_bucket"))
    third = options(summed(of_both, "rank_bucket"), "rank_bucket", [F.when(rank == 0, len(BUCKETS) + 1).otherwise(rank).asc(), F.asc("rank_bucket")], bucket)
    parts = (("patch", first, F.coalesce("patch", F.col("patch_id").cast("string"))), ("region", second, F.col("region")), ("rank", third, F.col("rank_bucket")))
    rows = [found.select(F.lit(part).alias("part"), "place", name.alias("option"), "boards", "chosen") for part, found, name in parts]
    return rows[0].unionAll(rows[1]).unionAll(rows[2])


def board_lines(units: DataFrame, items: DataFrame, traits: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(board_id, units, traits): a board as two lines of text, from one shuffle of its parts.

    ``ids``: only these boards (a row each), met once for all parts by the same shuffle; a semi join would be
    planned once a part.  Units in their order with stars and items (``U3*2+item+item``), traits by name (``T1:4``).
    """
    unit = F.concat("character_id", F.lit("*"), F.coalesce("star_tier", F.lit(0)))
    u = units.select("board_id", F.lit(False).alias("trait"), F.col("unit_row").alias("row"), F.lit(0).alias("slot"), unit.alias("text"))
    i = items.select("board_id", F.lit(False).alias("trait"), F.col("unit_row").alias("row"), "slot", F.concat(F.lit("+"), "item_id").alias("text"))
    t = traits.select("board_id", F.lit(True).alias("trait"), F.lit(0).alias("row"), F.lit(0).alias("slot"), F.concat("trait_id", F.lit(":"), "num_units").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("trait", "row", "slot", "text")))

    def line(is_trait: bool) -> Column:
        mine = F.filter("parts", lambda p: p["trait"] == is_trait)
        return F.ltrim(F.array_join(F.transform(mine, lambda p: F.when(p["slot"] == 0, F.concat(F.lit(" "), p["text"])).otherwise(p["text"])), ""))

    rows = u.unionAll(i).unionAll(t)
    rows = rows if ids is None else rows.join(ids, "board_id")
    return rows.groupBy("board_id").agg(parts.alias("parts")).select("board_id", line(False).alias("units"), line(True).alias("traits"))


def placement_bucket(placement: Column) -> Column:
    return F.when(placement == 1, "first").when(placement <= 4, "top4").otherwise("bottom")


def queue_mode(queue: Column) -> Column:
    return F.when(queue == 1100, "ranked").when(queue == 1160, "double_up").otherwise("unranked")


def display_name(name: Column, puuid: Column) -> Column:
    """The account's name, or the beginning of the id where the account is not known."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.substring(puuid, 1, 6), F.lit("…")))


def recent(rows: DataFrame, start: int = 0, count: int = 20) -> DataFrame:
    """Each player's matches from ``start`` on, newest first, with their place.

    The bound on places is applied before the shuffle too, so a player with most of the rows is no large task.
    """
    newest = Window.partitionBy("puuid").orderBy(F.desc("game_datetime"), F.asc("match_id"), F.asc("board_id"))
    upto = rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= start + count)
    return upto.filter(F.col("place") > start)


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Games, mean placement and the rates of top four and first."""
    p = F.col("placement")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), F.avg(p).alias("avg_placement"), F.avg((p <= 4).cast("int")).alias("top4_rate"), F.avg((p == 1).cast("int")).alias("first_rate"))


def page(rows: DataFrame, by: list[Column], number: int, size: int, name: str) -> DataFrame:
    """Rows of one page of a whole order, with their rank; numbers beyond the pages mean the nearest page.

    Ranks come from counts of ranges, so neither an early nor a late page sorts all rows in one task.
    """
    dealt = order.dealt(rows, by, name)
    total = dealt.count()
    number = min(max(1, number), max(1, -(-total // size)))
    ranked = order.running(dealt, by, rank=F.lit(1))
    return ranked.filter(F.col("rank").between((number - 1) * size + 1, number * size)).drop("_part").withColumn("page", F.lit(number))


def inspector(stats: DataFrame, floor: int) -> DataFrame:
    """Members of every labelled group with their rates, place and the group's own, over all buckets.

    ``stats`` are sums by gkey, comp_id and bucket.  A comp counts once it reaches the floor in one bucket.  Members are
    placed by boards, then comp_id; the first stands for the group.  Places come from counts by slice of the order: of
    few boards slices of equal boards are cut by comp_id, so a group with most comps is no one task.
    """
    sums = ("n", "placement_sum", "top4_count", "win_count")
    rates = {"avg_placement": F.col("placement_sum") / F.col("n"), "top4_rate": F.col("top4_count") / F.col("n"), "win_rate": F.col("win_count") / F.col("n")}
    members = stats.filter(F.col("gkey").startswith("m:")).groupBy("gkey", "comp_id").agg(*(F.sum(c).alias(c) for c in sums), F.max("n").alias("most"))
    members = members.filter(F.col("most") >= floor).drop("most")
    few = F.when(F.col("n") <= 8, F.shiftright("comp_id", 52)).otherwise(F.lit(0).cast("long"))
    placed = order.places(members, ["gkey"], F.struct((-F.floor(F.log2("n") * 8)).alias("size"), few.alias("few")), [F.desc("n"), F.asc("comp_id")], "place")
    groups = members.groupBy("gkey").agg(*(F.sum(c).alias(c) for c in sums), F.count(F.lit(1)).alias("members"))
    groups = groups.withColumns(rates).select("gkey", "members", F.col("n").alias("group_boards"), *(F.col(r).alias(f"group_{r}") for r in rates))
    return placed.withColumns(rates).join(groups, "gkey").select("gkey", "comp_id", F.col("n").alias("boards"), *rates, "place", (F.col("place") == 1).alias("representative"), "members", "group_boards", *(f"group_{r}" for r in rates))


def operations(calls: DataFrame, jobs: DataFrame, minutes: int = 60, newest: int = 20) -> DataFrame:
    """(part, key, requests, errors, seen, stale) of the last minutes before the last call.

    ``calls`` are (ts, method, rejected), ``jobs`` (id, job, ts, done).  Parts: total (with the peak minute and the number of
    methods), minute (without gaps), method, health of each job (its last success), and the newest jobs.  Calls are counted
    once, by minute and method; all parts on calls read these few sums.
    """
    now = calls.agg(F.max("ts").alias("now"), F.date_trunc("minute", F.max("ts")).cast("timestamp_ntz").alias("last"))
    since = F.col("last") - F.make_dt_interval(mins=F.lit(minutes - 1))
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")
    recent = calls.join(F.broadcast(now), F.col("ts") >= since)
    cells = recent.groupBy(minute, "method").agg(F.count(F.lit(1)).alias("requests"), F.count_if("rejected").alias("errors"), F.max("ts").alias("seen"))
    span = now.select(F.explode(F.sequence(since, F.col("last"), F.make_dt_interval(mins=F.lit(1)))).alias("minute"))
    series = span.join(cells.groupBy("minute").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors")), "minute", "left").na.fill(0, ["requests", "errors"])
    methods = cells.groupBy("method").agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.max("seen").alias("seen"))
    none, stamp = F.lit(None).cast("boolean"), F.lit(None).cast("timestamp_ntz")

    def part(rows: DataFrame, name: str, key: Column, requests: Column, errors: Column, seen: Column = stamp, stale: Column = none) -> DataFrame:
        return rows.select(F.lit(name).alias("part"), key.alias("key"), requests.cast("long").alias("requests"), errors.cast("long").alias("errors"), seen.cast("timestamp_ntz").alias("seen"), stale.alias("stale"))

    r, e = F.col("requests"), F.col("errors")
    health = jobs.groupBy("job").agg(F.max(F.when(F.col("done"), F.col("ts"))).alias("seen")).join(F.broadcast(now), F.lit(True))
    late = F.coalesce(F.col("seen") < F.col("now") - F.make_dt_interval(mins=F.lit(minutes)), F.lit(True))
    last = jobs.orderBy(F.desc("ts"), F.desc("id")).limit(newest)
    parts = [
        part(series.agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors")), "total", F.lit("calls"), r, e),
        part(series.agg(F.max("requests").alias("requests")), "total", F.lit("peak"), r, F.lit(None)),
        part(methods.agg(F.count(F.lit(1)).alias("requests")), "total", F.lit("methods"), r, F.lit(None)),
        part(series, "minute", F.date_format("minute", "yyyy-MM-dd HH:mm"), r, e),
        part(methods, "method", F.col("method"), r, e, F.col("seen")),
        part(health, "health", F.col("job"), F.lit(None), F.lit(None), F.col("seen"), late),
        part(last, "job", F.concat(F.col("id").cast("string"), F.lit(" "), "job"), F.lit(None), F.lit(None), F.col("ts"), ~F.col("done")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def find_accounts(asked: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds puuid to asked (name, tag, route), whatever the case; null where no account is known.

    Accounts are kept on the three main routes, so those asked for by way of ``sea`` are sought in ``asia``.
    """
    key = {"_name": F.lower("name"), "_tag": F.lower("tag")}
    host = F.when(F.col("route") == "sea", "asia").otherwise(F.col("route"))
    known = accounts.select(F.col("puuid"), F.col("route").alias("host"), *(c.alias(n) for n, c in key.items()))
    return asked.withColumns(key | {"host": host}).join(known, ["_name", "_tag", "host"], "left").drop("_name", "_tag")


def ladders(entries: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """The ladder of each tier: entries by points with their place, whole and in slices of a hundred points."""
    mine = entries.filter(F.col("tier").isin(*tiers))
    return order.places(mine, ["tier"], -F.floor(F.col("lp") / 100), [F.desc("lp"), F.asc("puuid")], "place")


def relabelled(tables: dict[str, DataFrame], column: str, old: str, new: str) -> dict[str, DataFrame]:
    """The same tables with one value of a column under its new name."""
    value = F.when(F.col(column) == old, new).otherwise(F.col(column))
    return {name: rows.withColumn(column, value) for name, rows in tables.items()}
