"""Codes, labels and text of the domain, as column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tiers by rank bucket, labels of buckets, regional route of platforms (fixed values of the domain).
BUCKET_OF_TIER = {
    "CHALLENGER": "challenger", "GRANDMASTER": "master_plus", "MASTER": "master_plus", "DIAMOND": "diamond", "EMERALD": "plat_emerald", "PLATINUM": "plat_emerald",
    "GOLD": "iron_gold", "SILVER": "iron_gold", "BRONZE": "iron_gold", "IRON": "iron_gold",
}
BUCKET_LABEL = {"challenger": "Challenger", "master_plus": "Master+", "apex_mixed": "Apex (mixed)", "diamond": "Diamond", "plat_emerald": "Platinum / Emerald", "iron_gold": "Iron – Gold", "unknown": "Unranked sample", "all": "All ranks"}
ROUTE_OF_PLATFORM = {
    "na1": "americas", "br1": "americas", "la1": "americas", "la2": "americas", "euw1": "europe", "eun1": "europe", "tr1": "europe", "ru": "europe", "kr": "asia", "jp1": "asia",
    "oc1": "sea", "ph2": "sea", "sg2": "sea", "th2": "sea", "tw2": "sea", "vn2": "sea",
}
#: Prefixes of request paths and what their calls are named (fixed values).
METHOD_OF_PATH = (
    ("/riot/account/v1/accounts/by-riot-id", "account.byRiotId"), ("/riot/account/v1/accounts/by-puuid", "account.byPuuid"), ("/tft/summoner/v1/summoners/by-puuid", "summoner.byPuuid"),
    ("/tft/summoner/v1/summoners/", "summoner.byId"), ("/tft/league/v1/by-puuid", "league.byPuuid"), ("/tft/league/v1/entries/by-summoner", "league.bySummoner"),
    ("/tft/league/v1/challenger", "league.apex"), ("/tft/league/v1/grandmaster", "league.apex"), ("/tft/league/v1/master", "league.apex"),
    ("/tft/match/v1/matches/by-puuid", "match.idsByPuuid"), ("/tft/match/v1/matches/", "match.byId"),
)
#: Patterns of ids and names that are no real items, and of classes of items (fixed values of the domain).
ITEM_JUNK = "(?i)Grant|Tutorial|Trainer|Encounter|Tooltip|Debug|Test|Placeholder|Consumable|Reforger|Remover|Duplicator|Magnetic|TacticianCrown|Choncc|Unstable|Component$"
ITEM_NAME_JUNK = r"(?i)\bAnvil\b|Tome of Traits|^TFT\b|\bMode\b|^Jammed!$|^Unusable Slot$|^game_item_displayname_|^tft_item_name_"
ARTIFACT, RADIANT, MECHANIC = "(?i)_Item_Artifact_|_Item_Ornn", "(?i)Radiant", "(?i)AnimaSquadItem"
BOARD_CELLS, CODE_SLOTS = 28, 10


def from_map(key: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def rank_bucket(tier: Column) -> Column:
    return from_map(F.upper(F.coalesce(tier, F.lit(""))), BUCKET_OF_TIER, F.lit("unknown"))


def bucket_label(bucket: Column) -> Column:
    return from_map(bucket, BUCKET_LABEL, F.concat(F.upper(F.substring(bucket, 1, 1)), F.substring(bucket, 2, 1000)))


def route(platform: Column) -> Column:
    return from_map(platform, ROUTE_OF_PLATFORM, F.lit(None).cast("string"))


def tier_in_scope(tier: Column, scope: tuple[str, ...]) -> Column:
    lowered = {s.lower() for s in scope}
    if "all" in lowered:
        return F.lit(True)
    missing = F.coalesce(tier, F.lit("")) == ""
    return F.when(missing, F.lit("unranked" in lowered)).otherwise(F.upper(tier).isin(*(s.upper() for s in scope)))


def buckets_in_scope(scope: tuple[str, ...]) -> set[str] | None:
    """Buckets that a scope reaches; None for all."""
    if any(s.lower() == "all" for s in scope):
        return None
    return {"unknown" if s.lower() == "unranked" else BUCKET_OF_TIER.get(s.upper(), "unknown") for s in scope}


def method_label(path: Column) -> Column:
    bare, out = F.split_part(path, F.lit("?"), F.lit(1)), F.lit("other")
    for prefix, name in reversed(METHOD_OF_PATH):
        # a tier is a whole word of the path
        here = bare.rlike(f"^{re.escape(prefix)}\\b") if name == "league.apex" else bare.startswith(prefix)
        out = F.when(here, name).otherwise(out)
    return out


def retryable(status: Column) -> Column:
    return status.isin(0, 401, 403, 429) | (status >= 500)


def patch_of_version(version: Column, set_number: Column) -> Column:
    """First N.N of a client version, or the set's placeholder."""
    return F.coalesce(F.nullif(F.regexp_extract(version, r"(\d+\.\d+)", 1), F.lit("")), F.concat(set_number.cast("string"), F.lit(".0")))


def rng_item(item: Column) -> Column:
    mechanic = item.rlike(MECHANIC)
    return item.rlike(ARTIFACT) | (item.rlike(RADIANT) & ~mechanic) | mechanic


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def item_kind(item: Column, components: Column) -> Column:
    """First rule that fits: component, emblem, craftable, artifact, other."""
    return F.when(components, "component").when(item.rlike("(?i)emblem"), "emblem").when(item.rlike("^TFT_Item_I"), "craftable").when(item.rlike(ARTIFACT), "artifact").otherwise("other")


def ordinal(n: Column) -> Column:
    last, teens = n % 10, (n % 100).between(11, 13)
    return F.concat(n.cast("string"), F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def prettify(identifier: Column) -> Column:
    """Readable name of an id: the set's prefix goes, words are set apart."""
    bare = F.regexp_replace(identifier, "^TFT[0-9]*_(Item_)?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"), "_", " "))


def fnv1a32(text: Column) -> Column:
    """FNV-1a of the lower-cased ASCII text as eight hex digits, by a fold in 64-bit arithmetic."""
    codes = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    fold = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 0x01000193).bitwiseAND(mask))
    return F.lower(F.lpad(F.hex(fold), 8, "0"))


def encode_board(cells: Column) -> Column:
    """'1' and the base64url of the JSON of cells (array of {i, u, it}); '' for none.

    Spark breaks base64 lines; the breaks and the padding are taken out.
    """
    packed = F.concat(F.lit("["), F.array_join(F.transform(cells, lambda c: F.to_json(F.struct(c["i"].alias("i"), c["u"].alias("u"), F.when(F.size(c["it"]) > 0, c["it"]).alias("it")))), ","), F.lit("]"))
    code = F.regexp_replace(F.base64(packed.cast("binary")), "[\\r\\n=]", "")
    return F.when(F.size(cells) > 0, F.concat(F.lit("1"), F.translate(code, "+/", "-_"))).otherwise("")


CELLS = "array<struct<i:int,u:string,it:array<string>>>"


def decode_board(code: Column) -> Column:
    """Cells of a code that lie on the board, with three items at most; null for no code."""
    body = F.translate(F.regexp_replace(F.trim(code), "^1", ""), "-_", "+/")
    padded = F.concat(body, F.repeat(F.lit("="), (F.lit(4) - F.length(body) % 4) % 4))
    cells = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), CELLS)
    kept = F.filter(cells, lambda c: c["i"].between(0, BOARD_CELLS - 1) & c["u"].isNotNull())
    return F.transform(kept, lambda c: F.struct(c["i"].alias("i"), c["u"].alias("u"), F.slice(F.coalesce(c["it"], F.array().cast("array<string>")), 1, 3).alias("it")))


def encode_planner(codes: Column, set_number: Column) -> Column:
    """Planner string of unit codes: the first ten different ones, three hex digits each; null without any."""
    some = F.slice(F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != 0))), 1, CODE_SLOTS)
    slots = F.concat(some.cast("array<bigint>"), F.array_repeat(F.lit(0).cast("long"), CODE_SLOTS - F.size(some)))
    digits = F.array_join(F.transform(slots, lambda c: F.lpad(F.hex(c), 3, "0")), "")
    return F.when(F.size(some) > 0, F.concat(F.lit("02"), digits, F.lit("TFTSet"), set_number.cast("string")))


def decode_planner(code: Column) -> Column:
    """Unit codes of a planner string in order; null if it is none."""
    digits = F.regexp_extract(F.trim(code), "^02([0-9A-Fa-f]+)TFTSet[0-9]+$", 1)
    good = (F.length(digits) > 0) & (F.length(digits) % 3 == 0)
    n = F.greatest(F.floor(F.length(digits) / 3), F.lit(1)).cast("int")
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(digits, i * 3 + 1, F.lit(3)), 16, 10).cast("int"))
    return F.when(good, F.filter(values, lambda v: v != 0))


def plain_text(rich: Column) -> Column:
    """Rich text without its tokens and tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(rich, r"<[^>]*>|\[\[[^\]]*\]\]|%i:[^%]*%", " "), r"\s+", " "))


def rarity(icon: Column) -> Column:
    """Augment tier by the end of its icon's name."""
    name = F.regexp_extract(icon, r"[_-](III|II|I|[123])(\.[A-Za-z.]*)?$", 1)
    return F.when(name.isin("I", "1"), "Silver").when(name.isin("II", "2"), "Gold").when(name.isin("III", "3"), "Prismatic")


#: Effects of items that are stats, in the order shown: key, label, whether in per cent (fixed values of the domain).
ITEM_STATS = (
    ("AD", "Attack Damage", True), ("AP", "Ability Power", False), ("Health", "Health", False), ("HealthMax", "Health", False), ("Armor", "Armor", False), ("MagicResist", "Magic Resist", False),
    ("AttackSpeed", "Attack Speed", True), ("AS", "Attack Speed", True), ("CritChance", "Crit Chance", True), ("CritDamage", "Crit Damage", True), ("LifeSteal", "Life Steal", True),
    ("Omnivamp", "Omnivamp", True), ("StatOmnivamp", "Omnivamp", True), ("Mana", "Mana", False), ("DamageAmp", "Damage Amp", True), ("DurabilityToGive", "Durability", True),
)


def item_stats(effects: Column) -> Column:
    """Array of (label, value) of a map of effects; none or zero is left out, of one label the first stays.

    Per cents under one are shares.  Halves are rounded up.
    """

    def stat(label: str, share: bool):
        def shown(raw: Column) -> Column:
            value = F.floor((F.when(raw < 1, raw * 100).otherwise(raw) if share else raw) + 0.5).cast("string")
            return F.when(raw != 0, F.struct(F.lit(label).alias("label"), F.concat(F.lit("+"), value, F.lit("%" if share else "")).alias("value")))

        return shown

    shown = [bound(F.try_element_at(effects, F.lit(key)), stat(label, share)) for key, label, share in ITEM_STATS]
    first = lambda found, labels: F.filter(found, lambda x, i: F.array_position(labels, x["label"]) == i + 1)
    found = F.filter(F.array(*shown), lambda x: x.isNotNull())
    stats = bound(found, lambda f: bound(F.transform(f, lambda x: x["label"]), lambda labels: first(f, labels)))
    return F.coalesce(stats, F.array().cast("array<struct<label:string,value:string>>"))
