"""Descriptions and planned boards against plain restatements."""

from __future__ import annotations

import random
import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from lobbyforge.functions import richtext
from lobbyforge.operators import planner


def fnv(text):
    h = 0x811C9DC5
    for c in text.lower().encode():
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return f"{{{h:08x}}}"


def short(x, digits):
    return float(f"{x:.{digits}g}")


def value(raw, numbers, series):
    if raw.startswith(("TFTUnitProperty", "ShowIf")):
        return ""
    m = re.fullmatch(r"([^*]+)\*([0-9]+(?:\.[0-9]+)?)", raw)
    name, factor = (m[1], float(m[2])) if m else (raw, 1.0)
    for fields in (numbers, series):
        known = next((v for k, v in fields.items() if k.lower() == name.lower()), fields.get(fnv(name)))
        if known is not None:
            break
    if known is None:
        return ""
    if isinstance(known, str):
        out = []
        for part in known.split("/"):
            try:
                x = float(part) * factor
            except ValueError:
                out.append(part)
                continue
            y = x if x == int(x) else short(x, 3)
            out.append(str(int(y)) if y == int(y) else f"{y:.12f}".rstrip("0"))
        return "/".join(out)
    y = short(known * factor, 6)
    return str(int(y)) if y == int(y) else str(Decimal(y).quantize(Decimal("0.1"), ROUND_HALF_UP))


def until_same(text, change):
    while (new := change(text)) != text:
        text = new
    return text


def plain(template, numbers, series):
    """The rules of descriptions, one replacement after another."""
    if template is None:
        return None
    t = re.sub(richtext.VARIABLE, lambda m: value(m[1], numbers, series), template)
    t = re.sub(r"(?i)<br\s*/?>", "\n", t)
    t = until_same(t, lambda x: re.sub(r"(?is)<ShowIf\.[^>]*>.*?</ShowIf\.[^>]*>", "", x))
    for tag, name in richtext.TAG_CLASS.items():
        t = until_same(t, lambda x, tag=tag, name=name: re.sub(f"(?is)<{tag}[^>]*>(.*?)</{tag}>", lambda m: f"«{name}:{m[1]}»", x))
    t = re.sub("<[^>]+>", "", t)

    def icon(m):
        key = richtext.ICON_OF_NAME.get(m[1].strip().lower())
        word = richtext.WORD_OF_ICON.get(m[1].lower())
        return f"«icon:{key}»" if key else f"«scale:{word}»" if word else ""

    def rule(m):
        ref = re.match("(?i)TFT_Keyword_(.+)$", m[1].strip())
        found = richtext.KEYWORDS.get(ref[1].strip().lower()) if ref else None
        return f"«rules:«bold:{found[0]}»: {found[1]}»" if found else ""

    t = re.sub(richtext.REFERENCE, rule, re.sub(richtext.ICON, icon, t))
    for pattern, put in ((r"\[\[[^\]]+\]\]", ""), ("(?i)&nbsp;", " "), ("(?<![0-9])%", ""), (r"\(\s*\)", "")):
        t = re.sub(pattern, put, t)
    t = until_same(t, lambda x: re.sub(r"«[a-z]+:\s*»", "", x))
    for pattern, put in ((r"\\r\\n|\\n|\\r", "\n"), (r"\r\n?", "\n"), (r"\s+\)", ")"), (r"\(\s+", "("), (r"[ \t]{2,}", " "), (" +([.,])", r"\1"), (r"\n{3,}", "\n\n")):
        t = re.sub(pattern, put, t)
    return "\n".join(x.strip(" \t") for x in t.split("\n")).strip() or None


PIECES = [
    "@AD*100@", "@ad@", "@Levels*10@", "@Levels@", "@capstonead@", "@none@", "@TFTUnitProperty.x@", "@ShowIf.y@", "@", "@@", "<status>", "</status>", "<scaleAD>", "</scaleAD>", "<TFTBold x='1'>", "</TFTBold>",
    "<ShowIf.A>", "</ShowIf.A>", "<ShowIfNot.A>", "</ShowIfNot.A>", "<ShowIf.B>", "</ShowIf.B>", "<br>", "<BR/>", "<li>", "%i:scaleMR%", "%i:set14AmpIcon%", "%i:odd%", "{{TFT_Keyword_burn}}", "{{ tft_keyword_CHILL }}", "{{TFT_Keyword_none}}",
    "{{x}}", "[[y]]", "&nbsp;", "%", "5%", "(", ")", "( )", " ", "  ", "\t", "\n", "\\n", "\r\n", ".", ",", "text", "«kw: »", "Ünï",
]


def test_descriptions_as_restated(spark):
    r = random.Random(12)
    rows = [(i, "".join(r.choice(PIECES) for _ in range(r.randrange(0, 25)))) for i in range(400)] + [(400, None), (401, ""), (402, "a\n\n\n\nb" + "<status>" * 5 + "x" + "</status>" * 5)]
    numbers, series = {"AD": 0.3499999940395355, "{1b76cfed}": 33.3333, "big": 12345678.0}, {"LEVELS": "41/6.25/-0.00994/0/n/0.75"}
    lit = lambda m, k: F.create_map(*(F.lit(x) for p in m.items() for x in p)).cast(k)
    table = spark.createDataFrame(rows, "i long, template string").withColumns({"n": lit(numbers, "map<string,double>"), "s": lit(series, "map<string,string>")})
    got = {x.i: x.text for x in richtext.descriptions(table, "template", "n", "s", "text").collect()}
    assert len(got) == len(rows)
    for i, template in rows:
        assert got[i] == plain(template, numbers, series), template


def test_trait_lines(spark):
    step = lambda n, **v: (n, {k: float(x) for k, x in v.items()})
    icons = [["ad", "ap"], ["mr"]]
    data = [
        (1, "Has @MinUnits@ and @X@.<expandRow>(@MinUnits@) @X@  OR  y</expandRow>", [step(2, X=1), step(4, X=2.5)], icons),
        (2, "<row>one @X@</row><row>two</row>", [step(None, X=1), step(3, X=2), step(5, X=3)], []),
        (3, None, [step(1, X=1)], []),
        (4, "no rows", [], []),
    ]
    table = spark.createDataFrame(data, "k int, desc string, steps array<struct<min_units:int,vars:map<string,double>>>, icons array<array<string>>")
    got = sorted((r.k, r.place, r.line) for r in richtext.trait_lines(table, "k").collect())
    assert got == [
        (1, 0, "Has 2 and 1."), (1, 1, "1 «icon:ad»«icon:ap» OR «icon:mr» y"), (1, 2, "2.5 «icon:ad»«icon:ap» OR «icon:mr» y"),
        (2, 0, None), (2, 1, "one 1"), (2, 2, "two"), (2, 3, None), (4, 0, "no rows"),
    ]


def test_active_traits(spark):
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    units = frame([(1, "A"), (1, "A"), (1, "B"), (1, "C"), (2, "C")], "board_id long, character_id string")
    traits = frame([("A", "x"), ("B", "x"), ("B", "y"), ("C", "z")], "character_id string, trait_id string")
    doubled = frame([("B", "x", 2)], "character_id string, trait_id string, contribution int")
    emblems = frame([(1, "A", "x"), (1, "C", "x"), (1, "C", "new"), (2, "C", "y")], "board_id long, character_id string, trait_id string")
    steps = frame([("x", 2, 1), ("x", 4, 3), ("x", 6, 4), ("y", 1, 5), ("z", 2, 1), ("z", 3, 2)], "trait_id string, min_units int, style int")
    got = sorted((r.board_id, r.place, r.trait_id, r["count"], r.style, r.next_at, r.is_unique) for r in planner.active_traits(units, traits, doubled, emblems, steps).collect())
    assert got == [(1, 1, "y", 1, 5, None, True), (1, 2, "x", 4, 3, 6, False), (1, 3, "new", 1, 0, None, False), (1, 4, "z", 1, 0, 2, False), (2, 1, "y", 1, 5, None, True), (2, 2, "z", 1, 0, 2, False)]


def test_parts_are_described_in_many_tasks_and_each_kind_once(spark, data):
    """One small file is one task, unless its rows are dealt out; rows of one template and equal values are one description."""
    from lobbyforge import registry

    for name in ("fn_resolve_desc", "fn_trait_content", "fn_item_stats"):
        plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [p_partkey" in plan, name
        assert name == "fn_item_stats" or "Aggregate [_t" in plan, name
