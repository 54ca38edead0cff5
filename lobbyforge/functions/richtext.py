"""Descriptions from templates: values, conditional blocks, marked spans, icons and keywords, as column functions.

A template is compiled once, into its literal pieces and what stands between them, and applied to rows
as arrays; no row is seen by Python.  Rewriting that goes on until nothing changes (nested
blocks and spans, spans that emptied) runs as often as its openings occur, which bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import bound, fnv1a32

#: Tags of spans and the classes they become (fixed values of the domain).
TAG_CLASS = {
    "physicaldamage": "phys", "magicdamage": "magic", "truedamage": "true", "scalehealth": "hp", "scalelevel": "lvl", "scaleap": "ap", "scalead": "ad",
    "scalearmor": "armor", "scalemr": "armor", "scalemana": "mana", "tftbonus": "bonus", "tfthighlight": "bonus", "tftkeyword": "kw", "status": "kw",
    "spellpassive": "label", "spellactive": "label", "tftpassive": "label", "tftactive": "label", "tftbold": "bold", "rules": "rules", "tftrules": "rules",
    "tftitemrules": "rules", "tftradiantitembonus": "radiant", "tftshadowitembonus": "shadow", "tftshadowitempenalty": "shadow",
}
#: Names of statistics, in texts, grids and item lists, and the icons they share (fixed values of the domain).
ICON_OF_NAME = {
    "scalead": "ad", "tftbasead": "ad", "scaleap": "ap", "scaleas": "as", "scalehealth": "health", "scalearmor": "armor", "scalemr": "mr", "scalerange": "range",
    "scaleda": "damageamp", "scalesv": "omnivamp", "scaledr": "damagereduction", "scalehpregen": "healthregen", "tftmanaregen": "manaregen",
    "scalecrit": "crit", "scalecritmult": "crit", "scalemana": "mana", "scalemanaregen": "manaregen",
    "ad": "ad", "ap": "ap", "as": "as", "hp": "health", "armor": "armor", "mr": "mr", "range": "range", "mana": "mana", "crit chance": "crit",
    "attack damage": "ad", "ability power": "ap", "attack speed": "as", "health": "health", "magic resist": "mr", "crit damage": "crit",
    "life steal": "omnivamp", "omnivamp": "omnivamp", "damage amp": "damageamp", "damage reduction": "damagereduction", "durability": "damagereduction",
    "hp regen": "healthregen", "mana regen": "manaregen", "critical strike": "crit", "health regen": "healthregen",
}
#: Words in place of icons that no sheet has (fixed values of the domain).
WORD_OF_ICON = {"set14ampicon": "Meeps"}
#: What references to keywords stand for (fixed values of the domain).
KEYWORDS = {
    "precision": ("Precision", "Ability damage can critically strike. Additional Precision grants 10% Critical Strike Damage."),
    "burn": ("Burn", "Deals a percent of the target's max Health as true damage every second"),
    "wound": ("Wound", "Reduces healing received"),
    "chill": ("Chill", "Reduce Attack Speed"),
}

VARIABLE, ICON, REFERENCE = "@([^@]+)@", "%i:([^%]+)%", r"\{\{([^}]+)\}\}"
ROW, ROW_BEGIN = r"(?is)<(?:expandRow|row)>(.*?)</(?:expandRow|row)>", "(?i)<(?:expandRow|row)>"
TEXTS = "array<string>"


def table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def stat_icon(name: Column) -> Column:
    """Icon of a statistic by any of its names, null for others."""
    return F.try_element_at(table(ICON_OF_NAME), F.lower(F.trim(name)))


def keyword(reference: Column) -> tuple[Column, Column]:
    """Name and definition of the keyword that a reference means, null for others."""
    key = F.lower(F.trim(F.regexp_extract(reference, "(?i)^TFT_Keyword_(.+)$", 1)))
    return tuple(F.try_element_at(table({k: v[i] for k, v in KEYWORDS.items()}), key) for i in (0, 1))


def woven(text: Column, pattern: str, fill) -> Column:
    """Text with ``fill(group 1)`` in place of each match."""
    parts = bound(text, lambda t: F.struct(F.regexp_extract_all(t, F.lit(pattern), 1).alias("found"), F.split(t, pattern, -1).alias("pieces")))
    put = lambda x, p, i: F.concat(p, F.when(i < F.size(x["found"]), F.coalesce(fill(F.get(x["found"], i)), F.lit(""))).otherwise(""))
    return bound(parts, lambda x: F.array_join(F.transform(x["pieces"], lambda p, i: put(x, p, i)), ""))


def rewritten(rows: DataFrame, name: str, steps: list[tuple[str, str, str]]) -> DataFrame:
    """Applies (opening, pattern, replacement) one after another, each as often as the text then has its opening.

    Each pass takes an opening away, so a step ends where nothing changes any more.  Patterns are literals, which Spark
    compiles once a task; a text without the opening is not searched.
    """

    def step(opening: str, pattern: str, to: str):
        once = lambda x: F.regexp_replace(x, pattern, to)
        return lambda t: bound(F.regexp_count(t, F.lit(opening)), lambda n: F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), t, lambda x, _: once(x))).otherwise(t))

    for opening, pattern, to in steps:
        text = F.col(name)
        rows = rows.withColumn(name, F.regexp_replace(text, pattern, to) if opening == ONCE else bound(text, step(opening, pattern, to)))
    return rows


def compiled(template: Column) -> Column:
    """(pieces, keys, hashes, factors) of a template: what stands between and at its variables."""
    raw = F.regexp_extract_all(template, F.lit(VARIABLE), 1)
    scaled = r"^([^*]+)\*([0-9]+(?:\.[0-9]+)?)$"
    name = lambda r: F.lower(F.when(r.rlike(scaled), F.regexp_extract(r, scaled, 1)).otherwise(r))
    hidden = lambda r: r.startswith("TFTUnitProperty") | r.startswith("ShowIf")
    keys = F.transform(raw, lambda r: F.when(~hidden(r), name(r)))
    factors = F.transform(raw, lambda r: F.coalesce(F.when(r.rlike(scaled), F.regexp_extract(r, scaled, 2).try_cast("double")), F.lit(1.0)))
    hashes = F.transform(keys, lambda k: F.concat(F.lit("{"), fnv1a32(k), F.lit("}")))
    return F.struct(F.split(template, VARIABLE, -1).alias("pieces"), keys.alias("keys"), hashes.alias("hashes"), factors.alias("factors"))


def significant(x: Column, digits: int) -> Column:
    scale = lambda v: F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(v))))
    return bound(x, lambda v: F.when(v == 0, 0.0).otherwise(F.rint(v * scale(v)) / scale(v)))


def whole(x: Column) -> Column:
    return F.floor(x).cast("string")


def one_decimal(x: Column) -> Column:
    """The nearest tenth of the number that a double is, the larger of two: ten times it as a sum of two doubles."""

    def text(a: Column) -> Column:
        ten = 8 * a + 2 * a
        lost = 2 * a - (ten - 8 * a)
        tenths = F.floor(ten) + F.when((ten - F.floor(ten) - 0.5) + lost >= 0, 1).otherwise(0)
        return bound(tenths, lambda k: F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string")))

    return F.concat(F.when(x < 0, "-").otherwise(""), bound(F.abs(x), text))


def number_text(x: Column) -> Column:
    """Six digits recover a decimal that was kept short; then whole, or with one decimal."""
    return bound(significant(x, 6), lambda y: F.when(y == F.floor(y), whole(y)).when(y.isNotNull(), one_decimal(y)))


def series_text(series: Column, factor: Column) -> Column:
    """Values for several levels, each with three digits; what is no number stays."""

    def one(part: Column) -> Column:
        short = lambda y: F.regexp_replace(F.regexp_replace(F.format_string("%.12f", y), "0+$", ""), r"\.$", "")
        few = lambda x: bound(significant(x, 3), lambda y: F.when(y == F.floor(y), whole(y)).otherwise(short(y)))
        return bound(part.try_cast("double") * factor, lambda x: F.when(x.isNull(), part).when(x == F.floor(x), whole(x)).otherwise(few(x)))

    return F.array_join(F.transform(F.split(series, "/"), one), "/")


def looked_up(fields: Column, key: Column, hashed: Column) -> Column:
    """A field by its name in any case, or by the hash that stands for its name."""
    entries = F.map_entries(fields)
    named = F.get(F.filter(entries, lambda e: F.lower(e["key"]) == key), F.lit(0))["value"]
    return F.coalesce(named, F.get(F.filter(entries, lambda e: e["key"] == hashed), F.lit(0))["value"])


def filled(parts: Column, numbers: Column, series: Column) -> Column:
    """The compiled template with values: ``numbers`` map<string,double>, ``series`` map<string,string>; unknown ones are left out."""

    def value(i: Column) -> Column:
        key, hashed, factor = (F.get(parts[c], i) for c in ("keys", "hashes", "factors"))
        return F.coalesce(number_text(looked_up(numbers, key, hashed) * factor), series_text(looked_up(series, key, hashed), factor), F.lit(""))

    return F.array_join(F.transform(parts["pieces"], lambda p, i: F.concat(p, F.when(i < F.size(parts["keys"]), value(i)).otherwise(""))), "")


ONCE = "$^"  # an opening that no text has: the step is applied once
BLOCKS = [(ONCE, r"(?i)<br\s*/?>", "\n"), (r"(?i)<ShowIf\.", r"(?is)<ShowIf\.[^>]*>.*?</ShowIf\.[^>]*>", "")]
SPANS = [(f"(?i)<{tag}", f"(?is)<{tag}[^>]*>(.*?)</{tag}>", f"«{name}:$1»") for tag, name in TAG_CLASS.items()]
LEFTOVER = [(ONCE, p, r) for p, r in ((r"\[\[[^\]]+\]\]", ""), ("(?i)&nbsp;", " "), ("(?<![0-9])%", ""), (r"\(\s*\)", ""))] + [("«", r"«[a-z]+:\s*»", "")]
BLANKS = [(ONCE, p, r) for p, r in ((r"\\r\\n|\\n|\\r", "\n"), (r"\r\n?", "\n"), (r"\s+\)", ")"), (r"\(\s+", "("), (r"[ \t]{2,}", " "), (" +([.,])", "$1"), (r"\n{3,}", "\n\n"), (r"(?m)^[ \t]+|[ \t]+$", ""), (r"^\s+|\s+$", ""))]


def icon_text(name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("«icon:"), stat_icon(name), F.lit("»")), F.concat(F.lit("«scale:"), F.try_element_at(table(WORD_OF_ICON), F.lower(name)), F.lit("»")))


def rule_text(reference: Column) -> Column:
    name, meaning = keyword(F.trim(reference))
    return F.concat(F.lit("«rules:«bold:"), name, F.lit("»: "), meaning, F.lit("»"))


def descriptions(rows: DataFrame, template: str, numbers: str, series: str, to: str) -> DataFrame:
    """Adds the description of each row, null for an empty one; every different template is compiled once, and rows of one
    template and equal values are described once.

    Filled with values, then: blocks under a condition go, known spans become «class:text», other tags go, icons and
    keywords are named, what has emptied goes, blanks are put right.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = lambda c: F.to_json(F.map_entries(c))
    values = lambda c, kind: F.map_from_entries(F.from_json(c, f"array<struct<key:string,value:{kind}>>"))
    keyed = rows.withColumns({"_t": F.col(template), "_numbers_key": entries(numbers), "_series_key": entries(series)})
    key = ["_t", "_numbers_key", "_series_key"]
    different = keyed.filter("_t IS NOT NULL").select(*key).distinct().repartition(parts, *key)
    templates = different.select(F.col("_t").alias("_of")).distinct().withColumn("_parts", compiled(F.col("_of")))
    out = different.join(templates, F.col("_t") == F.col("_of"), "left").withColumn(to, filled(F.col("_parts"), values("_numbers_key", "double"), values("_series_key", "string")))
    text = F.col(to)
    out = rewritten(out.select(*key, to), to, [*BLOCKS, *SPANS, (ONCE, "<[^>]+>", "")]).withColumn(to, woven(text, ICON, icon_text)).withColumn(to, woven(text, REFERENCE, rule_text))
    out = rewritten(out, to, [*LEFTOVER, *BLANKS]).withColumn(to, F.nullif(text, F.lit("")))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key]
    return keyed.alias("x").join(out.alias("y"), same, "left").select(*(F.col(f"x.{c}") for c in rows.columns if c != to), F.col(f"y.{to}"))


def with_icons(row: Column, groups: Column) -> Column:
    """Icons of values, in order, where a row has wide gaps for them; the rest behind it."""
    pieces = F.split(row, " {2,}", -1)
    shown = F.transform(groups, lambda g: F.array_join(F.transform(g, lambda k: F.concat(F.lit("«icon:"), k, F.lit("»"))), ""))
    gap = lambda i: F.when(i <= F.size(shown), F.concat(F.lit(" "), F.get(shown, i - 1), F.lit(" "))).otherwise(" ")
    body = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(gap(i), p))), "")
    rest = F.filter(shown, lambda g, i: i >= F.size(pieces) - 1)
    return F.when(F.size(groups) > 0, F.concat(body, F.array_join(F.transform(rest, lambda g: F.concat(F.lit(" "), g)), ""))).otherwise(row)


def trait_lines(traits: DataFrame, key: str) -> DataFrame:
    """(key, place, line): the introduction (place 0) and the line of each step of a trait.

    ``traits``: key, desc, steps array<struct<min_units:int,vars:map<string,double>>>, icons array<array<string>>.
    One row of the text for several steps is a template for all of them; else rows and steps go together.
    """
    merged = F.aggregate(
        F.transform("steps", lambda s: F.map_concat(F.when(s["min_units"].isNotNull(), F.create_map(F.lit("MinUnits"), s["min_units"].cast("double"))).otherwise(F.create_map().cast("map<string,double>")), s["vars"])),
        F.create_map().cast("map<string,double>"), lambda a, m: F.map_concat(a, F.map_filter(m, lambda k, v: ~F.map_contains_key(a, k))))
    rows = F.regexp_extract_all("desc", F.lit(ROW), 1)
    base = traits.filter(F.col("desc").isNotNull() & (F.col("desc") != "")).withColumns({"_merged": merged, "_rows": rows, "_n": F.size("steps")})
    intro = base.select(key, F.lit(0).alias("place"), F.get(F.split("desc", ROW_BEGIN, -1), F.lit(0)).alias("_text"), F.col("_merged").alias("_numbers"))
    own = F.when((F.size("_rows") == 1) & (F.col("_n") > 1), F.get("_rows", F.lit(0))).otherwise(F.get("_rows", F.col("_i")))
    numbers = F.map_concat(F.when(F.col("_s.min_units").isNotNull(), F.create_map(F.lit("MinUnits"), F.col("_s.min_units").cast("double"))).otherwise(F.create_map().cast("map<string,double>")), "_s.vars")
    steps = base.select(key, "_rows", "_n", "icons", F.posexplode("steps").alias("_i", "_s")).select(key, (F.col("_i") + 1).alias("place"), with_icons(own, F.col("icons")).alias("_text"), numbers.alias("_numbers"))
    both = intro.unionByName(steps).withColumn("_series", F.create_map().cast("map<string,string>"))
    out = descriptions(both, "_text", "_numbers", "_series", "line")
    line = F.when(F.col("place") > 0, F.nullif(F.regexp_replace("line", r"^\([0-9]+\)\s*", ""), F.lit(""))).otherwise(F.col("line"))
    return out.select(key, "place", line.alias("line"))
