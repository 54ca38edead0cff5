"""The archetype merge: scenarios, and every pass against a plain restatement of the rules."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from lobbyforge import registry
from lobbyforge.config import FIXTURE, PRODUCTION
from lobbyforge.operators import merge
from lobbyforge.operators.merge import Profile
from lobbyforge.plans import merging, pages, stages
from lobbyforge.plans.items import comp_rates
from lobbyforge.sources.boards import Boards

SHELL = tuple("ABCDEFGH")
U8 = tuple(f"u{i}" for i in range(1, 9))


def P(i, units=SHELL, carries="", boards=10, **more):
    """A profile: letters of ``carries`` (or a tuple) are its carries."""
    sets = {k: frozenset(more.pop(k, ())) for k in ("damage", "grade3")}
    return Profile(i, frozenset(units), carries=frozenset(carries), boards=boards, **sets, **more)


def groups(*profiles):
    named = merge.labelled(merge.merge(list(profiles), PRODUCTION), PRODUCTION)
    out = defaultdict(set)
    for i, text in named.items():
        out[text].add(i)
    return sorted(map(sorted, out.values())), named


CORE6 = tuple("ABCDEF")
SAVED = {"A": 1, "B": 1, "C": 0.7, "D": 0.7, "E": 0.7, "F": 0.7}
DARK = tuple(f"S{i}" for i in range(1, 8))
FRAME = {"DarkStar": 3.0, "Sorcerer": 1.0}
LULU = ("L", "M", "Mi", "P", "J", "S1", "S2", "S3", "S4")
REROLL = ("S1", "S2", "S3", "S4", "S5", "S6", "J", "F")
FOLD = tuple(f"u{i}" for i in range(1, 7))
#: name -> (profiles, groups of their numbers that must come out)
SCENARIOS = {
    "hits that were missed": ([P(1, carries="AB", grade3="AB", boards=100), P(2, carries="AB", grade3="A", boards=50), P(3, carries="A", boards=20)], [[1, 2, 3]]),
    "one hit more": ([P(1, carries="A", boards=500), P(2, (*SHELL, "I"), "AI", 40, grade3="I")], [[1, 2]]),
    "overlapping hits": ([P(1, LULU, "LMP", 170, grade3="LMP"), P(2, LULU, "JLM", 61, grade3="JLM")], [[1, 2]]),
    "damage carries agree": ([P(1, carries=("A", "B", "T1"), damage="AB", boards=100), P(2, carries=("A", "C", "T2"), damage="AC", boards=60)], [[1, 2]]),
    "damage carries disjoint": ([P(1, carries="AB", damage="AB", boards=100), P(2, carries="CD", damage="CD", boards=60)], [[1], [2]]),
    "damage disjoint, carries overlap": ([P(1, carries="AJK", damage="AJ", boards=195), P(2, carries="KMA", damage="KM", boards=53)], [[1, 2]]),
    "frames agree over flex units": ([P(1, (*DARK, "X1", "X2"), ("S1", "X1"), 100, damage=("S1", "X1"), frame=FRAME), P(2, (*DARK, "Y1", "Y2"), ("S1", "Y1"), 60, damage=("S1", "Y1"), frame=FRAME)], [[1, 2]]),
    "the same without frames": ([P(1, (*DARK, "X1", "X2"), ("S1", "X1"), 100, damage=("S1", "X1")), P(2, (*DARK, "Y1", "Y2"), ("S1", "Y1"), 60, damage=("S1", "Y1"))], [[1], [2]]),
    "frames apart": ([P(1, carries="A", damage="A", boards=100, frame={"V": 2.0, "Sl": 2.0}), P(2, carries="A", damage="A", boards=60, frame={"So": 2.0, "St": 2.0})], [[1], [2]]),
    "a gated unit": ([P(1, carries="A", damage="A", boards=120), P(2, (*SHELL, "Z"), "A", 30, damage="A", gated_sig="Z")], [[1], [2]]),
    "two with the gated unit": ([P(1, (*SHELL, "Z"), "A", 30, damage="A", gated_sig="Z"), P(2, (*SHELL, "Z"), "A", 20, damage="A", gated_sig="Z")], [[1, 2]]),
    "rolling for other units": ([P(1, REROLL, ("J", "S1"), 100, grade3="J"), P(2, REROLL, ("F", "S1"), 90, grade3="F")], [[1], [2]]),
    "an emblem does not split": ([P(1, carries="A", boards=100), P(2, carries="A", emblem_sig="Dark", boards=40)], [[1, 2]]),
    "doubled copies": ([P(1, carries="A", boards=100), P(2, carries="A", copy_sig="A", boards=30)], [[1], [2]]),
    "the best that takes it": ([P(1, U8, ("u1",), 300), P(2, (*U8[:7], "v8"), ("u1",), 100, hero_sig="u2"), P(3, U8, ("u1",), 50, hero_sig="u2")], [[1], [2, 3]]),
    "a hero among middling rates": ([P(1, U8, ("u1",), 300, hero_rates={"u2": 0.35}), P(2, U8, ("u1",), 200, hero_rates={"u2": 0.4}), P(3, U8, ("u1",), 20, hero_sig="u2", hero_rates={"u2": 1.0})], [[1, 2, 3]]),
    "a hero among low rates": ([P(1, U8, ("u1",), 300, hero_rates={"u2": 0.05}), P(2, U8, ("u1",), 200), P(3, U8, ("u1",), 100, hero_sig="u2", hero_rates={"u2": 0.9})], [[1, 2], [3]]),
    "levels apart": ([P(1, U8, ("u1",), 300, level=9.0), P(2, U8, ("u1",), 100, level=7.0), P(3, U8, ("u1",), 50, level=8.6)], [[1, 3], [2]]),
    "nothing in common": ([P(1, [f"a{i}" for i in range(8)], boards=100), P(2, [f"b{i}" for i in range(8)], boards=90)], [[1], [2]]),
    "weighted caps": ([P(1, (*CORE6, "X1", "X2"), "AB", 100, weights={**SAVED, "X1": 0.25, "X2": 0.25}), P(2, (*CORE6, "Y1", "Y2"), "AB", 40, weights={**SAVED, "Y1": 0.25, "Y2": 0.25})], [[1, 2]]),
    "caps without weights": ([P(1, (*CORE6, "X1", "X2"), "AB", 100), P(2, (*CORE6, "Y1", "Y2"), "AB", 40)], [[1, 2]]),
    "carries cannot make up for units": ([P(1, carries="AB", boards=100), P(2, tuple("ABCDWXYZ"), "AB", 40)], [[1], [2]]),
    "a fragment is folded": ([P(1, (*FOLD, "u7", "u8"), ("u1",), 300), P(2, (*FOLD, "f1", "f2"), ("u1",), 250), P(3, (*FOLD, "u7", "u8", "f1", "f2"), ("u1",), 200)], [[1, 2, 3]]),
    "hits without evidence": ([P(1, U8, grade3=("u1", "u2"), boards=14), P(2, U8, grade3=("u1", "u3"), boards=10), P(3, U8, boards=6)], [[1, 2, 3]]),
    "presence joins a line": ([P(1, carries="AB", grade3="A", boards=100), P(2, tuple("ABCDEFGX"), boards=8)], [[1, 2]]),
    "presence without the carries": ([P(1, carries="AB", boards=100), P(2, tuple("CDEFGHXY"), boards=8)], [[1], [2]]),
    "rolls without evidence": ([P(1, U8, grade3=("u1",), boards=20), P(2, U8, grade3=("u2",), boards=15)], [[1], [2]]),
    "none": ([], []),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(name):
    profiles, want = SCENARIOS[name]
    assert groups(*profiles)[0] == want


def test_labels():
    assert groups(*SCENARIOS["two with the gated unit"][0])[1][1] == "A##gate:Z"
    plain = groups(*SCENARIOS["nothing in common"][0])[1]
    assert plain == {1: "no_carry", 2: "no_carry##k:2"}
    assert groups(*SCENARIOS["hits without evidence"][0])[1][1].startswith("u1")
    assert "emb" not in groups(*SCENARIOS["an emblem does not split"][0])[1][2]
    assert merge.parse_label("A|B##dup:C##aug:X##gate:Z##k:7") == {"carries": ["A", "B"], "dup": "C", "aug": "X", "emb": "", "gate": "Z", "anchor": "7"}
    assert merge.parse_label("no_carry")["carries"] == []


def test_explanations():
    one, three = P(1, carries="A", boards=40), P(2, carries="ABC", boards=40)
    assert 0.34 < merge.explain(one, three, PRODUCTION)["carry_overlap"] < 0.75
    assert round(merge.explain(three, P(3, carries="ABD", boards=40), PRODUCTION)["carry_overlap"], 3) == 0.667
    same = merge.explain(P(1, carries="AB"), P(2, carries="AB"), PRODUCTION)
    assert same["carry_overlap"] == 1 and same["merges"]
    apart = merge.explain(P(1, REROLL, "J", grade3="J"), P(2, REROLL, "F", grade3="F"), PRODUCTION)
    assert not apart["merges"] and {"grade3_conflict", "carry_overlap"} <= set(apart["reasons"])


def tail(archetypes, *comps):
    return merge.assign_tail(list(comps), [a.profile(PRODUCTION) for a in archetypes], PRODUCTION)


def test_tail_scenarios():
    line = merge.merge([P(1, carries="AB", grade3="AB", boards=100)], PRODUCTION)
    assert tail(line, P(9, tuple("ABCDEFG"), boards=3), P(8, tuple("CDEFGHXY"), boards=3)) == [0, None]
    one = merge.merge([P(1, carries="A", grade3="A", boards=100)], PRODUCTION)
    assert tail(one, P(9, grade3="H", boards=20), P(8, grade3="H", boards=2), P(7, boards=2)) == [None, 0, 0]
    assert tail(merge.merge([P(1, carries=("MECH",), boards=100)], PRODUCTION), P(9, tuple("ABCDEFG"), boards=3)) == [0]
    assert tail(merge.merge([P(1, carries="A", hero_sig="B", boards=100)], PRODUCTION), P(9, boards=2)) == [None]
    two = merge.merge([P(1, carries="AB", grade3="AB", boards=100), P(2, tuple("PQRSTUVW"), "P", 90)], PRODUCTION)
    assert tail(two, P(9, tuple("ABCDEFG")), P(8, tuple("PQRSTUV")), P(7, tuple("ABCDEFG"), grade3="Z", boards=1), P(6, tuple("zyxwvut"))) == [0, 1, 0, None]
    assert tail([], P(9)) == [None] and tail(two) == []


# ---------------------------------------------------------------- restated without index, sums or caches


def heaviest(pairs):
    sums = defaultdict(float)
    for k, w in pairs:
        sums[k] += w
    return min(sums, key=lambda k: (-sums[k], k)) if sums else ""


def view(members, c):
    """What an archetype is, from its members alone."""
    w = lambda p: float(p.boards or 1)
    total = sum(map(w, members))
    having = lambda name: [p for p in members if getattr(p, name)]
    share = lambda u, name, of: sum(w(p) for p in members if u in getattr(p, name) and (name == "grade3" or p.carries)) / of if of else 0
    evidence, hits = sum(map(w, having("carries"))), sum(map(w, having("grade3")))
    units = {}
    for u in set().union(*(p.units for p in members)):
        mine = [p for p in members if u in p.units]
        if sum(map(w, mine)) / total >= c.merge_optional:
            units[u] = sum(w(p) * p.weights.get(u, 1.0) for p in mine) / sum(map(w, mine))
    every = lambda name: set().union(*(getattr(p, name) for p in members))
    carries = {u for u in every("carries") if share(u, "carries", evidence) >= c.merge_dominant}
    if not carries and evidence:
        carries = {heaviest((u, w(p)) for p in members for u in p.carries)}
    levelled = [p for p in members if p.level > 0]
    framed = having("frame")
    rates = {u: sum(w(p) * p.hero_rates.get(u, 0) for p in members if p.carries) / evidence for p in members for u in p.hero_rates} if evidence else {}
    return Profile(
        min(p.comp_id for p in members), frozenset(units), units, frozenset(carries), frozenset(u for u in every("damage") if share(u, "damage", evidence) >= c.merge_dominant),
        frozenset(u for u in every("grade3") if share(u, "grade3", hits) >= c.merge_dominant), *(heaviest((getattr(p, n), w(p)) for p in members) for n in ("copy_sig", "hero_sig")),
        rates, *(heaviest((getattr(p, n), w(p)) for p in members) for n in ("emblem_sig", "gated_sig")), int(total),
        sum(w(p) * p.level for p in levelled) / sum(map(w, levelled)) if levelled else 0.0,
        {t: sum(w(p) * p.frame.get(t, 0) for p in framed) / sum(map(w, framed)) for p in framed for t in p.frame},
    )


def fit(p, a, c, tail=False):
    """(score, whether the comp may join) of a comp and an archetype's view."""
    checkable = [u for u in a.carries if u in a.units]
    presence = sum(u in p.units for u in checkable) / len(checkable) if checkable else 1.0
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y))
    if tail:
        agree = presence
    elif p.damage and a.damage:
        agree = dice(p.damage, a.damage) if p.damage & a.damage else dice(p.carries, a.carries)
    elif not p.carries:
        agree = presence if a.carries else 1.0
    else:
        agree = dice(p.carries, a.carries) if a.carries else sum(u in a.units for u in p.carries) / len(p.carries)
    mine = {u: p.weights.get(u, 1.0) for u in p.units}
    sa, sb = sum(mine.values()), sum(a.weights[u] for u in a.units)
    both = sum((mine[u] + a.weights[u]) / 2 for u in mine if u in a.units)
    contained, jaccard = (both / min(sa, sb), both / (sa + sb - both)) if sa and sb else (0.0, 0.0)
    peak = [(min(p.frame.get(t, 0), a.frame.get(t, 0)), max(p.frame.get(t, 0), a.frame.get(t, 0))) for t in {*p.frame, *a.frame}] if p.frame and a.frame else []
    similar = sum(x * y for x, y in peak) / sum(y * y for _, y in peak) if peak else -1.0
    if p.hero_sig and a.hero_sig or p.hero_sig == a.hero_sig:
        hero = p.hero_sig != a.hero_sig
    else:
        hero = (a.hero_rates.get(p.hero_sig, 0) if p.hero_sig else p.hero_rates.get(a.hero_sig, 0)) <= c.merge_hero_low
    strong = agree >= c.merge_carry_strong - 1e-9
    trait = not tail and bool(p.carries) and similar >= c.merge_trait_strong - 1e-9
    sj = c.merge_carry_slack * strong + c.merge_trait_slack[0] * trait
    ss = c.merge_carry_slack * strong + c.merge_trait_slack[1] * trait
    margin = c.merge_assign_margin if tail or (not p.carries and a.carries) else 0.0
    score = sum(x * y for x, y in zip(c.merge_weights, (contained, jaccard, agree)))
    bad = (
        p.grade3 and a.grade3 and not p.grade3 & a.grade3 and p.boards >= c.merge_grade3_min_n, p.copy_sig != a.copy_sig, hero,
        p.level > 0 and a.level > 0 and abs(p.level - a.level) >= c.merge_level_gap, p.gated_sig != a.gated_sig, agree < c.merge_carry_overlap - 1e-9,
        0 <= similar < c.merge_trait_min - 1e-9, contained < c.merge_containment - 1e-9, jaccard < c.merge_jaccard - sj - 1e-9, score < c.merge_score + margin - ss - 1e-9,
    )
    return score, not any(bad)


def restated(profiles, c):
    """Groups of comp ids after each pass."""
    founded: list[list[Profile]] = []
    for p in sorted(profiles, key=lambda p: (2 if not p.carries else int(bool(p.hero_sig)), -p.boards, p.comp_id)):
        best = None
        for k, members in enumerate(founded):
            score, ok = fit(p, view(members, c), c)
            rank = (any(m.carries for m in members), score)
            if ok and (best is None or rank > best[0]):
                best = (rank, k)
        founded[best[1]].append(p) if best else founded.append([p])
    ids = lambda gs: sorted(sorted(p.comp_id for p in g) for g in gs if g)
    first = ids(founded)
    weight = lambda g: sum(p.boards or 1 for p in g)
    for k in sorted(range(len(founded)), key=lambda k: (weight(founded[k]), k)):
        own, best = view(founded[k], c), None
        for j, members in enumerate(founded):
            if j != k and members and weight(members) >= weight(founded[k]):
                score, ok = fit(own, view(members, c), c)
                if ok and (best is None or score > best[0]):
                    best = (score, j)
        if best:
            founded[best[1]] += founded[k]
            founded[k] = []
    second = ids(founded)
    views = {k: view(g, c) for k, g in enumerate(founded) if g}
    rich = {k: any(m.carries for m in founded[k]) for k in views}
    moved = defaultdict(list)
    for k in views:
        for p in founded[k]:
            score, ok = fit(p, views[k], c)
            best = (rich[k], score + c.merge_refine_margin if ok else float("-inf")), k
            for j in views:
                score, ok = fit(p, views[j], c)
                if j != k and ok and (rich[j], score) > best[0]:
                    best = (rich[j], score), j
            moved[best[1]].append(p)
    return first, second, ids(moved.values()), [view(moved[k], c) for k in sorted(moved)]


def made_up(seed, n=120):
    r = random.Random(seed)
    lines = [r.sample(range(24), 8) for _ in range(9)]
    out = []
    for i in range(n):
        units = {f"u{u:02d}" for u in r.choice(lines)}
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            units.discard(r.choice(sorted(units)))
            units.add(f"u{r.randrange(24):02d}")
        units = sorted(units)
        carries = r.sample(units, r.choice([0, 1, 2, 2]))
        out.append(Profile(
            1000 - i, frozenset(units), {u: r.choice([1.0, 0.7, 0.25]) for u in units if r.random() < 0.7}, frozenset(carries), frozenset(c for c in carries if r.random() < 0.6),
            frozenset(r.sample(units, r.choice([0, 0, 1, 2]))), r.choice(["", "", "", "u01"]), carries[0] if carries and r.random() < 0.15 else "", {u: r.random() for u in carries},
            "", r.choice(["", "", "", "u02"]), r.choice([0, 3, 12, 40, 200]), r.choice([0.0, 7.5, 8.5]), {f"t{t}": float(r.randrange(1, 4)) for t in r.sample(range(6), r.choice([0, 3, 4]))},
        ))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_passes_match_the_rules(seed):
    profiles = made_up(seed)
    first, second, third, views = restated(profiles, PRODUCTION)
    by = lambda rows, at: sorted(sorted(r[0] for r in rows if r[at] == a) for a in {r[at] for r in rows})
    rows = merge.trace(profiles, PRODUCTION)
    assert (by(rows, 1), by(rows, 2), by(rows, 3)) == (first, second, third)
    assert by(rows, 4) == third  # labels tell all groups apart
    assert len(third) < len(profiles)
    archetypes = [a.profile(PRODUCTION) for a in merge.merge(profiles, PRODUCTION)]
    light = [Profile(p.comp_id, p.units, grade3=p.grade3, copy_sig=p.copy_sig, gated_sig=p.gated_sig, boards=p.boards, level=p.level, frame=p.frame) for p in made_up(seed, 400)]
    found = merge.assign_tail(light, archetypes, PRODUCTION, block=37)
    for p, got in zip(light, found):
        best = None
        for k, a in enumerate(archetypes):
            score, ok = fit(p, a, PRODUCTION, tail=True)
            if ok and (best is None or (bool(a.carries), score) > (best[0][0], best[0][1] + 1e-12)):
                best = ((bool(a.carries), score), k)
        assert got == (best[1] if best else None)
    assert sum(k is not None for k in found) > 10


def test_verdicts(spark):
    labels = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "comp_id long, meta_comp string")
    pairs = spark.createDataFrame([(1, 2, "merge", False), (1, 3, "merge", False), (1, 3, "split", False), (2, 3, "merge", True), (1, 2, "merge", True), (1, 9, "split", False), (8, 9, "merge", False)], "a long, b long, wanted string, known boolean")
    got = sorted((r.a, r.b, r.wanted, r.got, r.verdict) for r in merge.evaluated(pairs, labels).collect())
    assert got == sorted([(1, 2, "merge", "merge", "pass"), (1, 3, "merge", "split", "fail"), (1, 3, "split", "split", "pass"), (2, 3, "merge", "split", "known"), (1, 2, "merge", "merge", "fixed"), (1, 9, "split", "split", "pass"), (8, 9, "merge", "split", "fail")])


def test_prefix_join_finds_all_pairs(spark):
    r = random.Random(3)
    sets = {i: sorted(r.sample("ABCDEFGHIJKLMN", r.randrange(1, 9))) for i in range(120)}
    table = spark.createDataFrame([(i, u) for i, us in sets.items() for u in us], "comp_id long, unit string")
    for least in (0.54, 0.75, 1.0):
        got = {(x.a, x.b): x.shared for x in merge.set_similarity_pairs(table, least).collect()}
        want = {(i, j): len(set(sets[i]) & set(sets[j])) for i in sets for j in sets if i < j and len(set(sets[i]) & set(sets[j])) >= least * len(set(sets[i]) | set(sets[j])) - 1e-9}
        assert got == want


def test_classes_stand_for_all_pairs(spark):
    r = random.Random(5)
    kinds = [sorted(r.sample("ABCDEFGH", r.randrange(3, 8))) for _ in range(25)]
    sets = {i: kinds[r.randrange(25)] for i in range(300)}
    classes = merge.set_classes(spark.createDataFrame(sorted(sets.items()), "comp_id long, units array<string>"))
    rows = merge.linked(classes, merge.class_links(classes, 0.54), "shared", F.col("shared"), F.size("units").cast("long")).collect()
    own = {x.a: x.b for x in rows if x.kind == "comp"}
    assert own == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    shared = {(x.a, x.b): x.shared for x in rows if x.kind == "pair"}
    alike = lambda i, j: len(set(sets[i]) & set(sets[j])) >= 0.54 * len(set(sets[i]) | set(sets[j])) - 1e-9
    pairs = {(i, j) for i in sets for j in sets if i < j and alike(i, j)}
    assert pairs == {(i, j) for i in sets for j in sets if i < j and (own[i] == own[j] or tuple(sorted((own[i], own[j]))) in shared)}
    assert all(n == len(set(sets[a]) & set(sets[b])) for (a, b), n in shared.items())
    assert {x.a: x.links for x in rows if x.kind == "comp"} == {i: sum(i in p for p in pairs) for i in sets}
    assert sum(x.links for x in rows if x.kind == "comp") == 2 * len(pairs) and len(rows) <= 300 + 25 * 24 / 2


def test_every_pair_is_a_row_in_whatever_lanes(spark):
    r = random.Random(8)
    kinds = [sorted(r.sample("ABCDEFGH", r.randrange(3, 8))) for _ in range(25)]
    sets = {i: kinds[r.randrange(25)] for i in range(300)}
    classes = merge.set_classes(spark.createDataFrame(sorted(sets.items()), "comp_id long, units array<string>"))
    links = merge.class_links(classes, 0.54).unionByName(merge.own_links(classes))
    want = {(i, j): len(set(sets[i]) & set(sets[j])) for i in sets for j in sets if i < j and len(set(sets[i]) & set(sets[j])) >= 0.54 * len(set(sets[i]) | set(sets[j])) - 1e-9}
    for lane, task in ((3, 500), (1024, 1 << 22)):
        rows = merge.expanded(classes, links, "units", lane=lane, task=task).collect()
        assert len(rows) == len(want) and {(x.a, x.b): x.shared for x in rows} == want
        assert all({x.p.comp_id, x.q.comp_id} == {x.a, x.b} and x.p.units == sets[x.p.comp_id] and x.q.units == sets[x.q.comp_id] for x in rows)


@pytest.fixture(scope="module")
def all_pairs(spark, data):
    """Units of all comps, of however few boards, and every pair of them that is alike."""
    sets = {r.comp_id: set(r.core_units) for r in stages.comps(Boards(spark, data)).collect()}
    pairs = {(i, j): len(sets[i] & sets[j]) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.54 * len(sets[i] | sets[j]) - 1e-9}
    return sets, pairs


def test_join_gives_every_pair_of_comps(spark, data, all_pairs):
    got = {(x.a, x.b): x.shared for x in registry.QUERIES["join_inverted_index"](spark, data).collect()}
    assert got == all_pairs[1] and len(got) > 20_000


def test_dice_of_every_pair_of_comps(spark, data, all_pairs):
    sets, pairs = all_pairs
    dice = {p: 2 * n / (len(sets[p[0]]) + len(sets[p[1]])) for p, n in pairs.items()}
    got = {(x.a, x.b): x.dice for x in registry.QUERIES["mrg_dice"](spark, data).collect()}
    assert got == pytest.approx({p: x for p, x in dice.items() if x >= 0.75}, abs=1e-6) and len(got) > 20_000


def test_overlap_of_every_pair_of_comps(spark, data, all_pairs):
    rows = registry.QUERIES["mrg_overlap"](spark, data).select("a", "b").collect()
    assert len(rows) == len(set(rows)) and set(all_pairs[1]) <= set(map(tuple, rows))


def test_overlap_weighs_units(spark, data):
    """Units weigh what the profile says; a pair is met if its shared units can reach the floor by weight."""
    from lobbyforge.plans.more import mrg_overlap

    b = Boards(spark, data, replace(FIXTURE, tier_min_sample=2), stored=True)
    made = {r.comp_id: {u: (r.weights or {}).get(u, 1.0) for u in r.units} for r in merging.stored_profiles(b).select("comp_id", "units", "weights").collect()}
    got = {(x.a, x.b): (x.containment, x.jaccard) for x in mrg_overlap(b).collect()}
    want = {}
    for i, x in made.items():
        for j, y in made.items():
            wx, wy = sum(x.values()), sum(y.values())
            if i < j and x.keys() & y.keys() and len(x.keys() & y.keys()) >= 0.54 / 1.54 * (wx + wy) - 1e-9:
                both = sum((x[u] + y[u]) / 2 for u in x if u in y)
                want[i, j] = both / min(wx, wy), both / (wx + wy - both)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-6) for p in want)
    assert any(w < 1 for x in made.values() for w in x.values())


def test_trait_similarity_of_every_pair_of_comps(spark, data, all_pairs):
    rows = registry.QUERIES["mrg_trait_sim"](spark, data).select("a", "b").collect()
    assert len(rows) == len(all_pairs[1]) and set(map(tuple, rows)) == set(all_pairs[1])


def test_verdicts_of_classes_are_those_of_pairs(spark):
    r = random.Random(6)
    comps = [(i, sorted(r.sample("ABCDE", r.randrange(3, 6))), r.choice("pq"), sorted(r.sample("XYZ", r.randrange(0, 3))), r.choice(["l", "m", None])) for i in range(80)]
    table = spark.createDataFrame(comps, "comp_id long, units array<string>, sig string, carries array<string>, meta_comp string")
    classes = merge.set_classes(table.select("comp_id", "units"))
    links = merge.class_links(classes, 0.54)
    close = F.col("shared") >= 0.9 * F.greatest("sa", "sb")
    near = links.select(F.col("a").alias("set_id"), F.col("b").alias("other"), close.alias("close")).unionAll(links.select("b", "a", close)).unionAll(classes.filter("comp_id = class_id").select("class_id", "class_id", F.lit(True)))
    kinds = merge.set_classes(table.join(classes.select("comp_id", F.col("class_id").alias("set_id")), "comp_id"), "set_id", "sig", "carries", "meta_comp")
    got = {x.comp_id: {k: v for k, v in x.asDict().items() if "_" in k and k not in ("comp_id", "class_id")} for x in merge.evaluated_classes(kinds, near).collect()}
    pairs = []
    for a in comps:
        for b in comps:
            both, wider = len(set(a[1]) & set(b[1])), max(len(a[1]), len(b[1]))
            if a[0] < b[0] and both >= 0.54 * len(set(a[1]) | set(b[1])) - 1e-9 and (a[2] != b[2] or both >= 0.9 * wider):
                pairs.append((a[0], b[0], "split" if a[2] != b[2] else "merge", a[2] == b[2] and bool(a[3]) and bool(b[3]) and not set(a[3]) & set(b[3])))
    verdicts = merge.evaluated(spark.createDataFrame(pairs, "a long, b long, wanted string, known boolean"), table.select("comp_id", "meta_comp").filter("meta_comp IS NOT NULL")).collect()
    want = {i: Counter() for i in range(80)}
    for x in verdicts:
        want[x.a][f"{x.wanted}_{x.verdict}"] += 1
        want[x.b][f"{x.wanted}_{x.verdict}"] += 1
    assert {i: {k: v for k, v in g.items() if v} for i, g in got.items()} == {i: dict(w) for i, w in want.items()}
    assert {x.verdict for x in verdicts} == {"pass", "fail", "known", "fixed"}


def test_profiles_reckon_item_rates_once(spark, data):
    """What units hold is one table, not read again by every part of a profile; its copies are those with all items."""
    from lobbyforge.operators import itemization

    b = Boards(spark, data, stored=True)
    assert "l_linenumber" not in merging.profiles(b)._jdf.queryExecution().optimizedPlan().toString()
    boards = stages.clustered(b).filter("comp_id IS NOT NULL").select("board_id", "comp_id")
    columns = ["board_id", "unit_row", "character_id", "n_done", "n_damage"]
    full = itemization.copies(b.units, b.items).join(boards, "board_id", "left_semi").select(*columns)
    counted = itemization.counted_copies(boards, b.units, b.items).select(*columns)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, counted.collect()))


def test_order_of_rows_does_not_matter():
    profiles = made_up(77)
    assert merge.labelled(merge.merge(profiles, PRODUCTION), PRODUCTION) == merge.labelled(merge.merge(profiles[::-1], PRODUCTION), PRODUCTION)


# ---------------------------------------------------------------- over the test tables


def test_merge_of_boards(spark, data):
    """The stage over boards is the passes and the tail over its own profiles."""
    b = Boards(spark, data, stored=True)
    rows = merging.profiles(b).collect()
    assert any(r.gated_sig for r in rows) and any(r.tail for r in rows) and all(r.set_number == 17 for r in rows)
    assert all(not r.carries and not r.weights for r in rows if r.tail)
    profiles = [merge.to_profile(r) for r in rows if not r.tail]
    archetypes = merge.merge(profiles, FIXTURE)
    want = merge.labelled(archetypes, FIXTURE)
    names = merge.labels(archetypes, FIXTURE)
    light = [merge.to_profile(r) for r in rows if r.tail]
    want |= {p.comp_id: names[k] for p, k in zip(light, merge.assign_tail(light, [a.profile(FIXTURE) for a in archetypes], FIXTURE)) if k is not None}
    assert {r.comp_id: r.meta_comp for r in stages.labels(b).collect()} == want
    assert any("##gate:" in t for t in want.values())


def test_profiles_know_heroes(spark, data):
    """A champion at three stars with damage items on most boards names the class of its comp."""
    b = Boards(spark, data, replace(FIXTURE, tier_min_sample=1, hero_rate=0.3, hero_champions=tuple(f"U{i}" for i in range(7))))
    rows = {r.comp_id: r for r in merging.profiles(b).filter("weights IS NOT NULL").collect()}
    rates = {(r.comp_id, r.character_id): r.damage_rate for r in comp_rates(b).collect()}
    threes = {r.comp_id: r.three_stars for r in stages.comps(b).collect()}
    assert any(r.hero_sig for r in rows.values())
    for i, r in rows.items():
        want = {u: rates.get((i, u), 0.0) for u in threes[i]}
        assert (r.hero_rates or {}) == want
        assert r.hero_sig == min((u for u in want if want[u] >= 0.3), key=lambda u: (-want[u], u), default="")


@pytest.mark.parametrize("name", sorted(n.removesuffix("_merged") for n in registry.QUERIES if n.endswith("_merged")))
def test_read_models_over_the_merge(name, spark, data):
    """The read models' SQL, with the groups of the merge in place of the rule."""
    from test_engine import TABLES, plain

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    con.register("merged", stages.labels(Boards(spark, data, stored=True)).toPandas())
    rule = "CASE WHEN comp_id % 3 = 0 THEN 'm:fam' || (comp_id % 20) ELSE 'c:' || comp_id END AS gkey FROM stats"
    sql = registry.ORACLES[name]
    assert rule in sql
    sql = sql.replace(rule, "coalesce('m:' || meta_comp, 'c:' || comp_id) AS gkey FROM stats LEFT JOIN merged USING (comp_id)").replace("SELECT *, coalesce('m:'", "SELECT stats.*, coalesce('m:'")
    sql = sql.replace(pages.NAMED, "CASE WHEN k.gkey LIKE 'm:%' THEN list_filter(string_split(split_part(substr(k.gkey, 3), '##', 1), '|'), lambda u: u NOT IN ('', 'no_carry')) ELSE []::VARCHAR[] END")
    got = registry.QUERIES[f"{name}_merged"](spark, data)
    assert got.filter(F.col("gkey").startswith("m:")).count() > 0
    assert plain(got.toPandas()) == plain(con.execute(sql).df())


@pytest.mark.parametrize("seed", range(12))
def test_classes_merge_as_the_whole(seed):
    """Merged class by class, comps get the labels that merging all of a set at once gives them."""
    profiles, c = made_up(seed, 200), FIXTURE
    whole = merge.labelled(merge.merge(profiles, c), c)
    classes = defaultdict(list)
    for p in profiles:
        classes[p.copy_sig, p.gated_sig].append(p)
    apart = {}
    for mine in classes.values():
        apart |= merge.labelled(merge.merge(mine, c), c)
    assert apart == whole and len(classes) > 1


def test_a_table_that_is_gone_is_made_anew(spark, tmp_path):
    import shutil

    from lobbyforge.sources import store

    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    key = (str(tmp_path),)
    assert store.once(spark, "gone", key, build).count() == store.once(spark, "gone", key, build).count() == 3 and len(calls) == 1
    path = next(p for k, p in store.MADE.items() if k[1] == "gone" and k[2:] == key)
    shutil.rmtree(path.removeprefix("file://"))
    assert store.once(spark, "gone", key, build).count() == 3 and len(calls) == 2


def test_blocks_compare_as_one_by_one(spark):
    """Every pair of linked classes once, the lesser comp against the other, in whatever lanes they lie."""
    r = random.Random(9)
    some = lambda xs, n: frozenset(r.sample(xs, n))
    profiles = []
    for i in range(60):
        units = some("ABCD", 3) | some("EF", r.randrange(2))
        carries = some(sorted(units), r.randrange(3)) | some("GH", r.randrange(2))
        known = r.random() < 0.7
        weights = {u: r.choice((1.0, 0.7, 0.25)) for u in units} if known else {}
        rates = {u: r.choice((0.1, 0.2, 0.6)) for u in some("AB", r.randrange(3))}
        profiles.append(Profile(i * 7 % 61, units, weights, carries, some(sorted(carries), r.randrange(len(carries) + 1)), some(sorted(units), r.randrange(2)), r.choice(("", "", "", "A")), r.choice(("", "", "A", "B")), rates,
                                "", r.choice(("", "", "", "C")), r.randrange(1, 20), r.choice((0.0, 7.0, 8.0, 9.0)), {t: r.choice((1.0, 2.0)) for t in some("XYZ", r.randrange(4))}))
    columns = [c.split(" ")[0] for c in merge.PROFILE.split(", ")]
    row = lambda p: (p.comp_id, 17, sorted(p.units), p.weights, sorted(p.carries), sorted(p.damage), sorted(p.grade3), p.copy_sig, p.hero_sig, p.hero_rates, p.emblem_sig, p.gated_sig, p.boards, p.level, p.frame)
    table = spark.createDataFrame([row(p) for p in profiles], merge.PROFILE).select(*columns)
    classes = merge.set_classes(table.select("comp_id", F.array_sort("units").alias("units")))
    got = {(x.a, x.b): (round(x.score, 9), x.reason) for x in merge.compare_classes(classes, merge.class_links(classes, 0.54), table, FIXTURE, 3).collect()}
    near = lambda p, q: len(p.units & q.units) >= 0.54 * len(p.units | q.units) - 1e-9
    want = {}
    for p in profiles:
        for q in profiles:
            if p.comp_id < q.comp_id and near(p, q):
                score, reason = merge.compare(p, merge.Archetype().add(q), FIXTURE)
                want[p.comp_id, q.comp_id] = round(score, 9), reason
    assert got == want and len({reason for _, reason in want.values()}) > 6
    assert merge.compare_classes(classes, merge.class_links(classes, 0.54), table, FIXTURE, 3).count() == len(want)
