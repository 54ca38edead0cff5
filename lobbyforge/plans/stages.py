"""The derived tables of a pass over the test tables' boards, in Spark and as SQL.

A pass goes boards -> signatures -> comps -> statistics -> groups.  The greedy merge is not
for SQL: where a query is held against SQL its groups come from a rule on comp ids, and the
same query runs over the merge's groups as ``name_merged``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import identity, rollup
from ..sources.boards import BOARDS_SQL, Boards


def ranked_boards(b: Boards) -> DataFrame:
    matches = rollup.ranked(b.matches, b.config).select("match_id", "region", "patch_id", "set_number", "game_datetime")
    return b.players.join(matches, "match_id")


def signed(b: Boards) -> DataFrame:
    """Signatures of the ranked boards; the boards' ids reach both fact tables as a semi join."""
    return b.once("signed", lambda: signatures(b)) if b.stored else signatures(b)


def signatures(b: Boards) -> DataFrame:
    ids = ranked_boards(b).select("board_id")
    units = b.units.select("board_id", "character_id", "star_tier").repartition(b.parts(), "board_id")
    return identity.signatures(units.join(ids, "board_id", "left_semi"), b.d_units, b.items.join(ids, "board_id", "left_semi"), b.config)


def clustered(b: Boards) -> DataFrame:
    if b.stored:
        return b.once("clustered", lambda: identity.assign(ranked_boards(b), signed(b)))
    return identity.assign(ranked_boards(b), signed(b))


def comps(b: Boards) -> DataFrame:
    if b.stored:
        return b.once("comps", lambda: identity.comps(signed(b)))
    return identity.comps(signed(b))


def stats(b: Boards) -> DataFrame:
    if b.stored:
        return b.once("stats", lambda: rollup.comp_stats(clustered(b)))
    return rollup.comp_stats(clustered(b))


def totals(b: Boards) -> DataFrame:
    return b.once("totals", lambda: rollup.bucket_totals(clustered(b))) if b.stored else rollup.bucket_totals(clustered(b))


def labels(b: Boards) -> DataFrame:
    """(comp_id, meta_comp) of the archetype merge."""
    from .merging import merged_labels

    return b.once("labels", lambda: merged_labels(b))


def grouped(b: Boards, rows: DataFrame) -> DataFrame:
    """Adds the grouping key to rows with a comp_id."""
    if b.merged:
        found = rows.join(labels(b), "comp_id", "left")
        return found.withColumn("gkey", rollup.gkey(F.coalesce("meta_comp", F.lit("")), F.col("comp_id"))).drop("meta_comp")
    comp = F.col("comp_id")  # by rule one comp in three has an archetype, of twenty
    family = F.when(comp % 3 == 0, F.concat(F.lit("fam"), comp % 20)).otherwise("")
    return rows.withColumn("gkey", rollup.gkey(family, comp))


def keyed(b: Boards) -> DataFrame:
    return grouped(b, stats(b))


def archetypes(b: Boards) -> DataFrame:
    return rollup.pool(keyed(b), "gkey", *rollup.BUCKET)


def sql(*names: str) -> str:
    """Common table expressions up to the named ones, after the views'."""
    return BOARDS_SQL + "".join(f",\n{name} AS ({STAGES[name]})" for name in STAGES if not names or name in names)


STAGES = {
    "ranked": """SELECT p.*, m.region, m.patch_id, m.set_number, m.game_datetime FROM b_players p JOIN b_matches m USING (match_id)
    WHERE m.queue_id = 1100 AND m.set_number IS NOT NULL AND m.player_count = 8""",
    "tok": """SELECT u.board_id, u.character_id, CASE WHEN u.star_tier >= 3 AND d.cost <= 3 THEN 1 ELSE 0 END AS hit, d.cost
    FROM b_units u JOIN d_units d USING (character_id) WHERE d.cost BETWEEN 1 AND 5 AND u.board_id IN (SELECT board_id FROM ranked)""",
    "emb": """SELECT board_id, string_agg(DISTINCT 'emb:' || item_id, '|' ORDER BY 'emb:' || item_id) AS worn FROM b_items
    WHERE lower(item_id) LIKE '%emblem%' AND board_id IN (SELECT board_id FROM ranked) GROUP BY board_id""",
    "core": """SELECT board_id, string_agg(character_id || CASE WHEN hit = 1 THEN ':3' ELSE ':lo' END, '|' ORDER BY character_id || CASE WHEN hit = 1 THEN ':3' ELSE ':lo' END) AS tokens,
    string_agg(character_id, '|' ORDER BY character_id) AS core_units, coalesce(string_agg(character_id, '|' ORDER BY character_id) FILTER (WHERE hit = 1), '') AS three_stars,
    count(*) AS units FROM tok GROUP BY board_id HAVING count(*) >= 3""",
    "signed": """SELECT c.board_id, c.tokens || coalesce('|' || e.worn, '') AS signature, c.core_units, c.three_stars, coalesce(e.worn, '') AS worn FROM core c LEFT JOIN emb e USING (board_id)""",
    "clustered": """SELECT r.*, ('0x' || substr(md5(s.signature), 1, 15))::BIGINT AS comp_id FROM ranked r LEFT JOIN signed s USING (board_id)""",
    "stats": """SELECT comp_id, patch_id, region, rank_bucket, count(*)::BIGINT AS n, sum(placement)::BIGINT AS placement_sum, sum(placement * placement)::BIGINT AS placement_sumsq,
    count(*) FILTER (WHERE placement <= 4)::BIGINT AS top4_count, count(*) FILTER (WHERE placement = 1)::BIGINT AS win_count
    FROM clustered WHERE comp_id IS NOT NULL AND patch_id IS NOT NULL GROUP BY comp_id, patch_id, region, rank_bucket""",
    "totals": """SELECT patch_id, region, rank_bucket, count(*)::BIGINT AS total_boards FROM clustered WHERE comp_id IS NOT NULL GROUP BY ALL""",
    "keyed": """SELECT *, CASE WHEN comp_id % 3 = 0 THEN 'm:fam' || (comp_id % 20) ELSE 'c:' || comp_id END AS gkey FROM stats""",
    "arch": """SELECT gkey, patch_id, region, rank_bucket, sum(n)::BIGINT AS n, sum(placement_sum)::BIGINT AS placement_sum, sum(placement_sumsq)::BIGINT AS placement_sumsq,
    sum(top4_count)::BIGINT AS top4_count, sum(win_count)::BIGINT AS win_count FROM keyed GROUP BY ALL""",
    "scored": """SELECT *, 0.5 * least(greatest((8 - (n / (n + 40.0) * (placement_sum / n) + (1 - n / (n + 40.0)) * 4.5)) / 7, 0.0), 1.0)
    + 0.5 * (n / (n + 40.0) * (top4_count / n) + (1 - n / (n + 40.0)) * 0.5) AS score FROM arch""",
}
#: Functions of a row of sufficient statistics, as SQL.
SCORE = """0.5 * least(greatest((8 - (n / (n + 40.0) * (placement_sum / n) + (1 - n / (n + 40.0)) * 4.5)) / 7, 0.0), 1.0) + 0.5 * (n / (n + 40.0) * (top4_count / n) + (1 - n / (n + 40.0)) * 0.5)"""
SEM = """CASE WHEN n >= 2 THEN sqrt(greatest(0.0, (placement_sumsq - n * (placement_sum / n) * (placement_sum / n)) / (n - 1)) / n) ELSE 0 END"""
