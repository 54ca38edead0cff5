"""Archetype merge: near-identical compositions become one group.

Comparison works on one record a comp (a profile) and an accumulator of an archetype's
members.  Passes 1 to 3 decide in order, each on what was decided before, so they run in
one task for each set, on the comps that were seen often enough to found or join an
archetype; how many there are is bounded by the sample floors.  A matrix of the
archetypes' unit weights tells, for one comp at a time, the few that its units allow.
Comps of the tail only join what came out: they are dealt to tasks, each of which
compares them with all archetypes at once.

Ties: of archetypes that take a comp equally well the one founded first gets it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config

UNKNOWN = -1.0
#: Sums in another order may differ by so much: what misses a limit by less still meets it.
SLIP = 1e-9


@dataclass
class Profile:
    """What the merge knows of a comp."""

    comp_id: int
    units: frozenset[str]
    weights: dict[str, float] = field(default_factory=dict)
    carries: frozenset[str] = frozenset()
    damage: frozenset[str] = frozenset()
    grade3: frozenset[str] = frozenset()
    copy_sig: str = ""
    hero_sig: str = ""
    hero_rates: dict[str, float] = field(default_factory=dict)
    emblem_sig: str = ""
    gated_sig: str = ""
    boards: int = 0
    level: float = 0.0
    frame: dict[str, float] = field(default_factory=dict)

    @property
    def weight(self) -> float:
        return float(self.boards or 1)

    def evidence(self) -> int:
        """Comps with carries come first, then heroes, then those known by units alone."""
        if not self.carries:
            return 2
        return 1 if self.hero_sig else 0


def dice(a: Iterable[str], b: Iterable[str]) -> float:
    a, b = set(a), set(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def frame_similarity(a: dict[str, float], b: dict[str, float]) -> float:
    """Shared activation over squared peaks; -1 if either side is unknown."""
    if not a or not b:
        return UNKNOWN
    keys = a.keys() | b.keys()
    peak = sum(max(a.get(k, 0), b.get(k, 0)) ** 2 for k in keys)
    return sum(min(a.get(k, 0), b.get(k, 0)) * max(a.get(k, 0), b.get(k, 0)) for k in keys) / peak if peak else UNKNOWN


def weighted_overlap(a: dict[str, float], b: dict[str, float]) -> tuple[float, float]:
    """(containment, Jaccard) of weighted sets; a shared unit counts the mean of its weights."""
    if not a and not b:
        return 0.0, 1.0
    if not a or not b:
        return 0.0, 0.0
    sa, sb = sum(a.values()), sum(b.values())
    both = sum((a[u] + b[u]) / 2 for u in a.keys() & b.keys())
    return both / min(sa, sb), both / (sa + sb - both)


def argmax(weights: Counter) -> str:
    return min(weights, key=lambda k: (-weights[k], k)) if weights else ""


class Archetype:
    """Sums over the members; every field adds up, so members may come in any order."""

    def __init__(self):
        self.members: list[Profile] = []
        self.anchor = 0
        self.total = self.evidence = self.hit_weight = self.level_sum = self.level_weight = 0.0
        self.unit_weight: Counter = Counter()
        self.unit_sum: Counter = Counter()
        self.carry: Counter = Counter()
        self.damage: Counter = Counter()
        self.grade3: Counter = Counter()
        self.copy: Counter = Counter()
        self.hero: Counter = Counter()
        self.hero_rate: Counter = Counter()
        self.emblem: Counter = Counter()
        self.gated: Counter = Counter()
        self.frame: Counter = Counter()
        self.frame_weight = 0.0
        self.cached: dict = {}

    def add(self, p: Profile) -> Archetype:
        w = p.weight
        self.anchor = min(self.anchor, p.comp_id) if self.members else p.comp_id
        self.members.append(p)
        self.total += w
        for u in p.units:
            self.unit_weight[u] += w
            self.unit_sum[u] += w * p.weights.get(u, 1.0)
        if p.carries:
            self.evidence += w
            for u in p.carries:
                self.carry[u] += w
            for u in p.damage:
                self.damage[u] += w
            for u, rate in p.hero_rates.items():
                self.hero_rate[u] += w * rate
        if p.grade3:
            self.hit_weight += w
            for u in p.grade3:
                self.grade3[u] += w
        self.copy[p.copy_sig] += w
        self.hero[p.hero_sig] += w
        self.emblem[p.emblem_sig] += w
        self.gated[p.gated_sig] += w
        if p.level > 0:
            self.level_sum += w * p.level
            self.level_weight += w
        if p.frame:
            self.frame_weight += w
            for t, x in p.frame.items():
                self.frame[t] += w * x
        self.cached = {}
        return self

    def absorb(self, other: Archetype) -> Archetype:
        for p in other.members:
            self.add(p)
        return self

    def derive(self, config: Config) -> dict:
        if not self.cached:
            dominant = lambda c, total: frozenset(u for u, w in c.items() if total and w / total >= config.merge_dominant)
            units = {u: self.unit_sum[u] / w for u, w in self.unit_weight.items() if w / self.total >= config.merge_optional}
            carries = dominant(self.carry, self.evidence) or frozenset(filter(None, [argmax(self.carry)]))
            self.cached = {
                "units": units, "carries": carries, "damage": dominant(self.damage, self.evidence), "grade3": dominant(self.grade3, self.hit_weight),
                "copy": argmax(self.copy), "hero": argmax(self.hero), "emblem": argmax(self.emblem), "gated": argmax(self.gated),
                "level": self.level_sum / self.level_weight if self.level_weight else 0.0,
                "frame": {t: x / self.frame_weight for t, x in self.frame.items()} if self.frame_weight else {},
            }
        return self.cached

    def profile(self, config: Config) -> Profile:
        """The archetype as a comp of its own, for folding and for the tail."""
        d = self.derive(config)
        rates = {u: x / self.evidence for u, x in self.hero_rate.items()} if self.evidence else {}
        return Profile(self.anchor, frozenset(d["units"]), dict(d["units"]), d["carries"], d["damage"], d["grade3"], d["copy"], d["hero"], rates, d["emblem"], d["gated"], int(self.total), d["level"], d["frame"])


def carry_overlap(p: Profile, d: dict) -> float:
    mine, theirs = p.carries, d["carries"]
    if p.damage and d["damage"] and p.damage & d["damage"]:
        return dice(p.damage, d["damage"])
    if p.damage and d["damage"]:
        return dice(mine, theirs)
    if not mine and not theirs:
        return 1.0
    if not mine:
        checkable = [u for u in theirs if u in d["units"]]
        return sum(u in p.units for u in checkable) / len(checkable) if checkable else 1.0
    if not theirs:
        return sum(u in d["units"] for u in mine) / len(mine)
    return dice(mine, theirs)


def hero_conflict(p: Profile, a: Archetype, d: dict, config: Config) -> bool:
    if p.hero_sig == d["hero"]:
        return False
    if p.hero_sig and d["hero"]:
        return True
    if p.hero_sig:
        rate = a.hero_rate[p.hero_sig] / a.evidence if a.evidence else 0.0
    else:
        rate = p.hero_rates.get(d["hero"], 0.0)
    return rate <= config.merge_hero_low + SLIP


def judged(p: Profile, a: Archetype, config: Config) -> tuple[float, float, list[str]]:
    """(score, agreement of carries, every reason why the comp does not belong to the archetype)."""
    d = a.derive(config)
    overlap = carry_overlap(p, d)
    weights = {u: p.weights.get(u, 1.0) for u in p.units}
    contained, jaccard = weighted_overlap(weights, d["units"])
    wc, wj, wo = config.merge_weights
    score = wc * contained + wj * jaccard + wo * overlap
    similar = frame_similarity(p.frame, d["frame"])
    slack_j = slack_s = config.merge_carry_slack if overlap >= config.merge_carry_strong - SLIP else 0.0
    if p.carries and similar >= config.merge_trait_strong - SLIP:
        slack_j, slack_s = slack_j + config.merge_trait_slack[0], slack_s + config.merge_trait_slack[1]
    margin = config.merge_assign_margin if not p.carries and d["carries"] else 0.0
    failed = (
        ("grade3_conflict", bool(p.grade3 and d["grade3"]) and not p.grade3 & d["grade3"] and p.boards >= config.merge_grade3_min_n),
        ("copy_class", p.copy_sig != d["copy"]),
        ("hero_augment", hero_conflict(p, a, d, config)),
        ("level_gap", p.level > 0 and d["level"] > 0 and abs(p.level - d["level"]) >= config.merge_level_gap - SLIP),
        ("emblem_class", config.require_emblem and p.emblem_sig != d["emblem"]),
        ("gated_class", p.gated_sig != d["gated"]),
        ("carry_overlap", overlap < config.merge_carry_overlap - SLIP),
        ("trait_frame", 0 <= similar < config.merge_trait_min - SLIP),
        ("containment", contained < config.merge_containment - SLIP),
        ("jaccard", jaccard < config.merge_jaccard - slack_j - SLIP),
        ("score", score < config.merge_score + margin - slack_s - SLIP),
    )
    return score, overlap, [name for name, bad in failed if bad]


def compare(p: Profile, a: Archetype, config: Config) -> tuple[float, str]:
    """(score, first reason): the reason is empty if the comp belongs to the archetype."""
    score, _, reasons = judged(p, a, config)
    return score, reasons[0] if reasons else ""


def explain(a: Profile, b: Profile, config: Config) -> dict:
    score, overlap, reasons = judged(a, Archetype().add(b), config)
    return {"score": score, "carry_overlap": overlap, "reasons": reasons, "merges": not reasons}


class Shelf:
    """Archetypes in order of founding, and the weights of their units as a matrix.

    One product of the matrix with a comp's units gives containment and Jaccard against
    all archetypes; those of another class, of another level, or that no slack could let
    pass are not compared.
    """

    def __init__(self, profiles: list[Profile], config: Config):
        self.config = config
        self.column = {u: i for i, u in enumerate(sorted(set().union(*(p.units for p in profiles))))}
        self.alive: dict[int, Archetype] = {}
        self.weights = np.zeros((64, max(1, len(self.column))))
        self.sums, self.levels, self.kinds = np.zeros(64), np.zeros(64), np.zeros(64, np.int64)
        self.codes: dict[tuple[str, str], int] = {}
        self.least_jaccard = config.merge_jaccard - config.merge_carry_slack - config.merge_trait_slack[0]
        self.least_score = config.merge_score - config.merge_carry_slack - config.merge_trait_slack[1] - config.merge_weights[2]

    def kind(self, copy_sig: str, gated_sig: str) -> int:
        return self.codes.setdefault((copy_sig, gated_sig), len(self.codes))

    def put(self, k: int, a: Archetype) -> None:
        """Founds archetype k, or takes note that it changed."""
        if k >= len(self.weights):
            self.weights, self.sums, self.levels, self.kinds = (np.concatenate([x, np.zeros_like(x)]) for x in (self.weights, self.sums, self.levels, self.kinds))
        d = a.derive(self.config)
        self.alive[k] = a
        self.weights[k] = 0
        for u, w in d["units"].items():
            self.weights[k, self.column[u]] = w
        self.sums[k], self.levels[k], self.kinds[k] = self.weights[k].sum(), d["level"], self.kind(d["copy"], d["gated"])

    def drop(self, k: int) -> None:
        del self.alive[k]
        self.weights[k] = self.sums[k] = 0

    def near(self, p: Profile) -> list[int]:
        """Archetypes that share enough of the comp's units, in order of founding."""
        ok = (self.sums > 0) & (self.kinds == self.kind(p.copy_sig, p.gated_sig))
        if p.level > 0:
            ok &= (self.levels == 0) | (np.abs(self.levels - p.level) < self.config.merge_level_gap - SLIP)
        at = np.flatnonzero(ok)
        units = [u for u in p.units if u in self.column]
        mine = np.array([p.weights.get(u, 1.0) for u in units])
        theirs, sums = self.weights[at[:, None], [self.column[u] for u in units]], self.sums[at]
        both = ((theirs > 0) @ mine + theirs.sum(1)) / 2
        own = sum(p.weights.get(u, 1.0) for u in p.units)
        with np.errstate(divide="ignore", invalid="ignore"):
            contained, jaccard = both / np.minimum(own, sums), both / (own + sums - both)
        score = self.config.merge_weights[0] * contained + self.config.merge_weights[1] * jaccard
        return at[(contained >= self.config.merge_containment - 2 * SLIP) & (jaccard >= self.least_jaccard - 2 * SLIP) & (score >= self.least_score - 2 * SLIP)].tolist()

    def takers(self, p: Profile, ids: Iterable[int]) -> Iterator[tuple[int, bool, float]]:
        """(archetype, whether it has evidence, score) of those that take the comp."""
        for k in ids:
            score, reason = compare(p, self.alive[k], self.config)
            if not reason:
                yield k, bool(self.alive[k].evidence), score


def group(profiles: list[Profile], config: Config) -> Shelf:
    """Pass 1: each comp joins the best archetype so far that takes it (those with carries
    before those without, then the higher score), or founds one."""
    shelf = Shelf(profiles, config)
    founded = 0
    for p in sorted(profiles, key=lambda p: (p.evidence(), -p.boards, p.comp_id)):
        found = max(shelf.takers(p, shelf.near(p)), key=lambda x: x[1:], default=None)
        if found is None:
            shelf.put(founded, Archetype().add(p))
            founded += 1
        else:
            shelf.put(found[0], shelf.alive[found[0]].add(p))
    return shelf


def fold(shelf: Shelf, config: Config) -> None:
    """Pass 2: from the smallest up, an archetype goes into the one at least as heavy that takes it best."""
    for k in sorted(shelf.alive, key=lambda k: (shelf.alive[k].total, k)):
        small = shelf.alive[k]
        own = small.profile(config)
        larger = [j for j in shelf.near(own) if j != k and shelf.alive[j].total >= small.total]
        found = max(shelf.takers(own, larger), key=lambda x: x[2], default=None)
        if found is not None:
            shelf.put(found[0], shelf.alive[found[0]].absorb(small))
            shelf.drop(k)


def refine(shelf: Shelf, config: Config) -> list[Archetype]:
    """Pass 3: every comp against the archetypes as they stand; it moves to one that is better
    by a margin, or that has carries where its own has none, and never the other way."""
    moves: dict[int, list[Profile]] = defaultdict(list)
    for k, own in shelf.alive.items():
        for p in own.members:
            score, reason = compare(p, own, config)
            bar = (bool(own.evidence), score + config.merge_refine_margin if not reason else -math.inf)
            found = max(shelf.takers(p, (j for j in shelf.near(p) if j != k)), key=lambda x: x[1:], default=None)
            moves[found[0] if found is not None and found[1:] > bar else k].append(p)
    out = []
    for k in sorted(moves):
        rebuilt = Archetype()
        for p in moves[k]:
            rebuilt.add(p)
        out.append(rebuilt)
    return out


def merge(profiles: list[Profile], config: Config) -> list[Archetype]:
    """Passes 1 to 3: greedy grouping, folding of the small, refinement."""
    shelf = group(profiles, config)
    fold(shelf, config)
    return refine(shelf, config)


def label(a: Archetype, config: Config) -> str:
    d = a.derive(config)
    text = "|".join(sorted(d["carries"])) or "|".join(sorted(d["grade3"])) or "no_carry"
    for name, sig in (("dup", d["copy"]), ("aug", d["hero"]), ("gate", d["gated"])):
        text += f"##{name}:{sig}" if sig else ""
    return text


def labels(archetypes: list[Archetype], config: Config) -> list[str]:
    """Pass 4: label of each archetype; the heaviest of equal ones keeps it, others add their least comp."""
    named: dict[str, list[int]] = defaultdict(list)
    for i, a in enumerate(archetypes):
        named[label(a, config)].append(i)
    out = [""] * len(archetypes)
    for text, group in named.items():
        for rank, i in enumerate(sorted(group, key=lambda i: (-archetypes[i].total, archetypes[i].anchor))):
            out[i] = text if rank == 0 else f"{text}##k:{archetypes[i].anchor}"
    return out


def labelled(archetypes: list[Archetype], config: Config) -> dict[int, str]:
    """comp -> label."""
    return {p.comp_id: text for a, text in zip(archetypes, labels(archetypes, config)) for p in a.members}


def parse_label(text: str) -> dict:
    """Carries, classes and anchor of a label."""
    head, *rest = text.split("##")
    parts = dict(x.split(":", 1) for x in rest if ":" in x)
    carries = [] if head == "no_carry" else head.split("|")
    return {"carries": carries, **{name: parts.get(key, "") for name, key in (("dup", "dup"), ("aug", "aug"), ("emb", "emb"), ("gate", "gate"), ("anchor", "k"))}}


def trace(profiles: list[Profile], config: Config) -> list[tuple]:
    """(comp, anchor after each pass, label, score in its archetype, reason) of every comp."""
    placed = lambda groups: {p.comp_id: a.anchor for a in groups for p in a.members}
    shelf = group(profiles, config)
    first = placed(shelf.alive.values())
    fold(shelf, config)
    second = placed(shelf.alive.values())
    final = refine(shelf, config)
    named = labels(final, config)
    return [(p.comp_id, first[p.comp_id], second[p.comp_id], a.anchor, text, *compare(p, a, config)) for a, text in zip(final, named) for p in a.members]


def assign_tail(tail: list[Profile], archetypes: list[Profile], config: Config, block: int = 256) -> list[int | None]:
    """For comps known by their units alone: the archetype (its place) that takes each best, if any.

    The archetypes are profiles as the passes left them.  All conditions but that on trait
    frames are matrices of comps and archetypes; frames are compared where the rest holds.
    """
    if not archetypes or not tail:
        return [None] * len(tail)
    column = {u: i for i, u in enumerate(sorted(set().union(*(a.units | a.carries | a.grade3 for a in archetypes))))}

    def marks(sets: list[Iterable[str]]) -> np.ndarray:
        out = np.zeros((len(sets), len(column)))
        for i, units in enumerate(sets):
            out[i, [column[u] for u in units if u in column]] = 1
        return out

    units, proxies, grade3 = marks([a.units for a in archetypes]), marks([a.carries & a.units for a in archetypes]), marks([a.grade3 for a in archetypes])
    weights = units.copy()
    for i, a in enumerate(archetypes):
        for u in a.units:
            weights[i, column[u]] = a.weights.get(u, 1.0)
    sums, checkable = weights.sum(1), proxies.sum(1)
    text = lambda rows, name: np.array([getattr(r, name) for r in rows], object)
    number = lambda rows, name: np.array([getattr(r, name) for r in rows], float)
    evidence = np.array([bool(a.carries) for a in archetypes])
    same = ("copy_sig", "gated_sig", "hero_sig") + (("emblem_sig",) if config.require_emblem else ())
    classes = {name: text(archetypes, name) for name in same}
    levels, hits = number(archetypes, "level"), grade3.any(1)
    wc, wj, wo = config.merge_weights
    out: list[int | None] = []
    for at in range(0, len(tail), block):
        part = tail[at : at + block]
        mine = marks([p.units for p in part])
        own = np.array([sum(p.weights.get(u, 1.0) for u in p.units) for p in part])
        if any(p.weights for p in part):
            raise ValueError("comps of the tail have no weights of their own")
        both = (mine @ units.T + mine @ weights.T) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            present = np.where(checkable > 0, (mine @ proxies.T) / checkable, 1.0)
            contained = both / np.minimum(own[:, None], sums)
            jaccard = both / (own[:, None] + sums - both)
        slack = np.where(present >= config.merge_carry_strong - SLIP, config.merge_carry_slack, 0.0)
        score = wc * contained + wj * jaccard + wo * present
        fits = (present >= config.merge_carry_overlap - SLIP) & (contained >= config.merge_containment - SLIP) & (jaccard >= config.merge_jaccard - slack - SLIP) & (score >= config.merge_score + config.merge_assign_margin - slack - SLIP)
        for name, theirs in classes.items():
            fits &= text(part, name)[:, None] == theirs
        level = number(part, "level")[:, None]
        fits &= ~((level > 0) & (levels > 0) & (np.abs(level - levels) >= config.merge_level_gap - SLIP))
        third = marks([p.grade3 for p in part])
        sampled = np.array([bool(p.grade3) and p.boards >= config.merge_grade3_min_n for p in part])
        fits &= ~(sampled[:, None] & hits & (third @ grade3.T == 0))
        for row, p in enumerate(part):
            found = [k for k in np.flatnonzero(fits[row]).tolist() if not 0 <= frame_similarity(p.frame, archetypes[k].frame) < config.merge_trait_min - SLIP]
            out.append(max(found, key=lambda k: (evidence[k], score[row, k], -k), default=None))
    return out


def to_profile(row) -> Profile:
    """A profile from a row of the profiles table (or of the table of archetypes)."""
    some = lambda x: frozenset(x) if x is not None else frozenset()
    pairs = lambda x: dict(x) if x is not None else {}
    return Profile(
        int(row.comp_id), some(row.units), pairs(row.weights), some(row.carries), some(row.damage), some(row.grade3), row.copy_sig or "", row.hero_sig or "",
        pairs(row.hero_rates), row.emblem_sig or "", row.gated_sig or "", int(row.boards), float(row.level or 0.0), pairs(row.frame),
    )


#: Columns of a profile in a table.
PROFILE = (
    "comp_id long, set_number int, units array<string>, weights map<string,double>, carries array<string>, damage array<string>, grade3 array<string>, copy_sig string, hero_sig string, "
    "hero_rates map<string,double>, emblem_sig string, gated_sig string, boards long, level double, frame map<string,double>"
)
MERGED = f"{PROFILE}, label string, place int, members array<long>"


#: A comp joins only archetypes of its own set, copies and gated units, and a label says both, so all
#: passes are apart for each such class.
CLASS = ("set_number", "copy_sig", "gated_sig")


def merge_classes(profiles: DataFrame, config: Config) -> DataFrame:
    """Archetypes of each class: profile, label, place in the order of founding within it, and members.

    Rows marked ``tail`` take no part.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        archetypes = merge([to_profile(r) for r in pdf.itertuples()], config)
        rows = []
        for place, (a, text) in enumerate(zip(archetypes, labels(archetypes, config))):
            p = a.profile(config)
            rows.append((
                p.comp_id, int(pdf.set_number.iloc[0]), sorted(p.units), p.weights, sorted(p.carries), sorted(p.damage), sorted(p.grade3), p.copy_sig, p.hero_sig,
                p.hero_rates, p.emblem_sig, p.gated_sig, p.boards, p.level, p.frame, text, place, [m.comp_id for m in a.members],
            ))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in MERGED.split(", ")])

    return profiles.filter("NOT tail").groupBy(*CLASS).applyInPandas(run, MERGED)


#: Comps of a class's tail that one task compares with its archetypes.
TAIL_COMPS = 4096


def tail_labels(profiles: DataFrame, archetypes: DataFrame, config: Config) -> DataFrame:
    """(comp_id, meta_comp) of the comps of the tail that an archetype takes.

    A large class's comps are dealt to lanes, and its archetypes, which the sample floors bound, go to each.
    Classes without an archetype have nothing to join.
    """
    tail = profiles.filter("tail").join(archetypes.select(*CLASS).distinct(), list(CLASS), "left_semi")
    lanes = tail.groupBy(*CLASS).agg(F.ceil(F.count(F.lit(1)) / TAIL_COMPS).cast("int").alias("lanes"))
    comps = tail.join(lanes, list(CLASS)).withColumn("lane", F.pmod(F.xxhash64("comp_id"), F.col("lanes")).cast("int")).drop("lanes")
    every = archetypes.drop("members").join(lanes, list(CLASS)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")

    def run(tail: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        rows = [to_profile(r) for r in tail.itertuples()]
        made = made.sort_values("place")
        found = assign_tail(rows, [to_profile(r) for r in made.itertuples()], config)
        names = made.label.tolist()
        return pd.DataFrame([(p.comp_id, names[k]) for p, k in zip(rows, found) if k is not None], columns=["comp_id", "meta_comp"])

    return comps.groupBy(*CLASS, "lane").cogroup(every.groupBy(*CLASS, "lane")).applyInPandas(run, "comp_id long, meta_comp string")


def all_labels(profiles: DataFrame, archetypes: DataFrame, config: Config) -> DataFrame:
    """(comp_id, meta_comp) of all comps that belong to an archetype."""
    own = archetypes.select(F.explode("members").alias("comp_id"), F.col("label").alias("meta_comp"))
    return own.unionByName(tail_labels(profiles, archetypes, config))


def trace_profiles(profiles: DataFrame, config: Config) -> DataFrame:
    """``trace`` of all profiles that are not in the tail."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = trace([to_profile(r) for r in pdf.itertuples()], config)
        return pd.DataFrame(rows, columns=["comp_id", "pass1", "pass2", "pass3", "label", "score", "reason"])

    return profiles.filter("NOT tail").groupBy(*CLASS).applyInPandas(run, "comp_id long, pass1 long, pass2 long, pass3 long, label string, score double, reason string")


def evaluated(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, wanted, got and verdict of pairs (a, b, wanted, known) under labels (comp_id, meta_comp).

    ``wanted`` is merge or split; a comp without label is in no archetype, so it is split from
    all others.  Verdict: pass, known (a failure that is expected) or fail; ``fixed`` where a
    known failure passes now.
    """
    of = lambda side: labels.select(F.col("comp_id").alias(side), F.col("meta_comp").alias(f"label_{side}"))
    rows = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    got = F.when(F.col("label_a") == F.col("label_b"), "merge").otherwise("split")
    right = got == F.col("wanted")
    verdict = F.when(right & F.col("known"), "fixed").when(right, "pass").when(F.col("known"), "known").otherwise("fail")
    return rows.select("a", "b", "wanted", got.alias("got"), verdict.alias("verdict"))


def evaluated_classes(classes: DataFrame, near: DataFrame) -> DataFrame:
    """Verdicts of all pairs of comps, counted for each comp without a row a pair.

    ``classes`` come from ``set_classes`` by set_id, sig, carries and meta_comp; ``near`` (set_id, other, close) has the sets that
    are compared, both ways and each with itself.  Wanted: split where ``sig`` differs, else merge where the sets are ``close``;
    a merge is a known failure where both have carries and none in common.  Gives comp_id, class_id, links and how many of
    them have which verdict, as in ``evaluated``.
    """
    kinds = classes.filter("comp_id = class_id").select("class_id", "set_id", "sig", "carries", "meta_comp", "members")
    count = lambda name, *by: kinds.groupBy(F.col("set_id").alias("other"), *by).agg(F.sum("members").alias(name))
    n = lambda name: F.coalesce(name, F.lit(0))
    met = kinds.join(near, "set_id").join(count("s"), "other").join(count("sg", "sig"), ["other", "sig"], "left")
    met = met.join(count("sl", "meta_comp"), ["other", "meta_comp"], "left").join(count("sgl", "sig", "meta_comp"), ["other", "sig", "meta_comp"], "left")
    failed = n("sl") - n("sgl")
    split = met.groupBy("class_id").agg(F.sum(F.col("s") - n("sg") - failed).alias("split_pass"), F.sum(failed).alias("split_fail"))
    mine = kinds.join(near.filter("close").select("set_id", "other"), "set_id").alias("x")
    both = mine.join(kinds.alias("y"), (F.col("x.other") == F.col("y.set_id")) & (F.col("x.sig") == F.col("y.sig")))
    others = F.col("y.members") - (F.col("x.class_id") == F.col("y.class_id")).cast("int")
    known = (F.size("x.carries") > 0) & (F.size("y.carries") > 0) & ~F.arrays_overlap("x.carries", "y.carries")
    got = F.coalesce(F.col("x.meta_comp") == F.col("y.meta_comp"), F.lit(False))
    verdicts = {"merge_pass": got & ~known, "merge_fail": ~got & ~known, "merge_fixed": got & known, "merge_known": ~got & known}
    merge = both.groupBy(F.col("x.class_id").alias("class_id")).agg(*(F.sum(F.when(c, others).otherwise(0)).alias(name) for name, c in verdicts.items()))
    names = ["split_pass", "split_fail", *verdicts]
    total = F.lit(0)
    for name in names:
        total += F.col(name)
    return classes.select("comp_id", "class_id").join(split, "class_id").join(merge, "class_id").select("comp_id", "class_id", total.alias("links"), *names)


#: Reasons in the order in which they are named; none is the first.
REASONS = ("", "grade3_conflict", "copy_class", "hero_augment", "level_gap", "emblem_class", "gated_class", "carry_overlap", "trait_frame", "containment", "jaccard", "score")
#: Comps of a class that one task compares with as many of another, and pairs that it reckons at a time.
BLOCK, STRIP = 1024, 1 << 18


def compare_blocks(mine: list[Profile], theirs: list[Profile], config: Config, same: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """``compare`` of every two comps of two lists, the one of the lesser id against an archetype of the other alone.

    Gives arrays of both ids, the score and the reason's place in ``REASONS``; every condition is a matrix of comps and comps.
    ``same``: both lists hold the same comps, so each pair is met twice and given once.
    """
    both = mine + theirs
    column = {u: i for i, u in enumerate(sorted(set().union(*(p.units | p.carries | p.grade3 for p in both))))}
    traits = {t: i for i, t in enumerate(sorted(set().union(*(p.frame for p in both))))}
    codes: dict = {}

    def arrays(rows: list[Profile]) -> dict[str, np.ndarray]:
        def marks(sets: Iterable[Iterable[str]]) -> np.ndarray:
            out = np.zeros((len(rows), len(column)))
            for i, units in enumerate(sets):
                out[i, [column[u] for u in units]] = 1
            return out

        code = lambda name: np.array([codes.setdefault((name, getattr(p, name)), len(codes)) for p in rows])
        out = {"units": marks(p.units for p in rows), "carries": marks(p.carries for p in rows), "damage": marks(p.damage if p.carries else () for p in rows), "grade3": marks(p.grade3 for p in rows)}
        out |= {name: code(name) for name in ("copy_sig", "hero_sig", "gated_sig", "emblem_sig")}
        weights, frame = np.zeros((len(rows), len(column))), np.zeros((len(rows), len(traits)))
        for i, p in enumerate(rows):
            weights[i, [column[u] for u in p.units]] = [p.weights.get(u, 1.0) for u in p.units]
            frame[i, [traits[t] for t in p.frame]] = list(p.frame.values())
        kept = out["carries"] * out["units"]
        own_damage = marks(p.damage for p in rows)
        return out | {
            "weights": weights, "frame": frame, "sums": weights.sum(1), "square": (frame**2).sum(1), "kept": kept, "n_kept": kept.sum(1), "n_carries": out["carries"].sum(1), "own_damage": own_damage,
            "ids": np.array([p.comp_id for p in rows], np.int64), "boards": np.array([p.boards for p in rows]), "level": np.array([p.level for p in rows], float), "hero": np.array([bool(p.hero_sig) for p in rows]),
            "known": np.array([bool(p.frame) for p in rows]), "names": [p.hero_sig for p in rows], "rates": [p.hero_rates for p in rows],
        }

    def low(rates: list[dict], evidence: np.ndarray, names: list[str]) -> np.ndarray:
        """Whether each comp's rate of each named hero is low; without evidence it is."""
        kinds = sorted(set(names))
        table = np.array([[not ok or r.get(k, 0.0) <= config.merge_hero_low + SLIP for k in kinds] for r, ok in zip(rates, evidence)], bool)
        return table[:, [kinds.index(n) for n in names]]

    a, b = arrays(mine), arrays(theirs)
    step = max(1, STRIP // max(1, len(theirs)))
    for at in range(0, len(mine), step):
        part = {k: v[at : at + step] for k, v in a.items()}
        yield from _compared(part, b, config, low, same)


def _compared(a: dict, b: dict, config: Config, low: Callable, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    shared = (a["weights"] @ b["units"].T + a["units"] @ b["weights"].T) / 2
    sa, sb = a["sums"][:, None], b["sums"]
    contained, jaccard = shared / np.minimum(sa, sb), shared / (sa + sb - shared)
    least = np.zeros_like(shared)
    for x, y in zip(a["frame"].T, b["frame"].T):
        least += np.minimum(x[:, None], y) ** 2
    peak = a["square"][:, None] + b["square"] - least
    with np.errstate(divide="ignore", invalid="ignore"):
        similar = np.where(a["known"][:, None] & b["known"] & (peak > 0), (a["frame"] @ b["frame"].T) / peak, UNKNOWN)
        dice_c = 2 * (a["carries"] @ b["carries"].T) / (a["n_carries"][:, None] + b["n_carries"])
    differ = {name: a[name][:, None] != b[name] for name in ("copy_sig", "gated_sig", "emblem_sig", "hero_sig")}
    hits = a["grade3"].any(1)[:, None] & b["grade3"].any(1) & (a["grade3"] @ b["grade3"].T == 0)
    gap = (a["level"][:, None] > 0) & (b["level"] > 0) & (np.abs(a["level"][:, None] - b["level"]) >= config.merge_level_gap - SLIP)
    heroes = a["hero"][:, None] & b["hero"]
    wc, wj, wo = config.merge_weights

    def directed(p: dict, d: dict, turn: Callable, wanted: np.ndarray) -> tuple[np.ndarray, ...]:
        """Comps p against archetypes d; ``turn`` makes what is reckoned by (p, d) a matrix by (a, b)."""
        carried, known = p["n_carries"][:, None] > 0, d["n_carries"] > 0
        common = p["own_damage"] @ d["damage"].T
        some = p["own_damage"].any(1)[:, None] & d["damage"].any(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            hurt = 2 * common / (p["own_damage"].sum(1)[:, None] + d["damage"].sum(1))
            present = np.where(d["n_kept"] > 0, (p["units"] @ d["kept"].T) / d["n_kept"], 1.0)
            held = (p["carries"] @ d["units"].T) / p["n_carries"][:, None]
        usual = np.where(carried & known, turn(dice_c), np.where(carried, held, np.where(known, present, 1.0)))
        overlap = np.where(some & (common > 0), hurt, np.where(some, np.nan_to_num(turn(dice_c)), usual))
        c, j, s = turn(contained), turn(jaccard), turn(similar)
        score = wc * c + wj * j + wo * overlap
        slack = np.where(overlap >= config.merge_carry_strong - SLIP, config.merge_carry_slack, 0.0)
        strong = carried & (s >= config.merge_trait_strong - SLIP)
        slack_j, slack_s = slack + np.where(strong, config.merge_trait_slack[0], 0.0), slack + np.where(strong, config.merge_trait_slack[1], 0.0)
        margin = np.where(~carried & known, config.merge_assign_margin, 0.0)
        theirs = low(d["rates"], known, p["names"]).T
        own = low(p["rates"], np.ones(len(p["rates"]), bool), d["names"])
        hero = turn(differ["hero_sig"]) & (turn(heroes) | np.where(p["hero"][:, None], theirs, own))
        failed = (
            turn(hits) & (p["boards"][:, None] >= config.merge_grade3_min_n), turn(differ["copy_sig"]), hero, turn(gap), turn(differ["emblem_sig"]) & config.require_emblem, turn(differ["gated_sig"]),
            overlap < config.merge_carry_overlap - SLIP, (s >= 0) & (s < config.merge_trait_min - SLIP), c < config.merge_containment - SLIP,
            j < config.merge_jaccard - slack_j - SLIP, score < config.merge_score + margin - slack_s - SLIP,
        )
        reason = np.zeros(score.shape, np.int8)
        for place, bad in reversed(list(enumerate(failed, 1))):
            reason[bad] = place
        x, y = np.nonzero(wanted)
        return p["ids"][x], d["ids"][y], score[x, y], reason[x, y]

    forward = a["ids"][:, None] < b["ids"]
    backward = a["ids"][:, None] > b["ids"]
    if forward.any():
        yield directed(a, b, lambda m: m, forward)
    if backward.any() and not same:
        yield directed(b, a, lambda m: m.T, backward.T)


def compare_classes(classes: DataFrame, links: DataFrame, profiles: DataFrame, config: Config, block: int = BLOCK) -> DataFrame:
    """a, b, score and reason of all pairs of comps (a < b) of linked classes and of one class: a against an archetype of b alone.

    A class's comps are dealt to lanes, and every two lanes that are linked meet in one task, so no pair is a row before its result.
    """
    columns = [c.split(" ")[0] for c in PROFILE.split(", ")]
    lane = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = classes.filter("comp_id = class_id").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.col("members").alias("na"), F.col("members").alias("nb"))
    met = links.select("a", "b", "na", "nb").unionByName(own)
    met = met.withColumn("la", F.explode(F.sequence(F.lit(0), lane("na") - 1))).withColumn("lb", F.explode(F.sequence(F.lit(0), lane("nb") - 1)))
    met = met.filter("a <> b OR la <= lb").select("a", "la", "b", "lb")
    comps = classes.select("comp_id", "class_id", F.pmod(F.xxhash64("comp_id"), lane("members")).cast("int").alias("lane")).join(profiles.select(*columns), "comp_id")
    key = ["a", "la", "b", "lb"]
    side = lambda c, at: comps.join(met, (F.col("class_id") == F.col(c)) & (F.col("lane") == F.col(at))).select(*(F.col(x).alias(x) for x in (*key, *columns)))

    def run(keys: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = ([to_profile(r) for r in pdf.itertuples()] for pdf in (left, right))
        found = list(compare_blocks(mine, theirs, config, keys[:2] == keys[2:])) if mine and theirs else []  # a lane may be empty
        if not found:
            return pd.DataFrame({"a": [], "b": [], "score": [], "reason": []})
        return pd.DataFrame(dict(zip(("a", "b", "score", "reason"), (np.concatenate(x) for x in zip(*found)))))

    pairs = side("a", "la").groupBy(*key).cogroup(side("b", "lb").groupBy(*key)).applyInPandas(run, "a long, b long, score double, reason int")
    return pairs.withColumn("reason", F.element_at(F.array(*map(F.lit, REASONS)), F.col("reason") + 1))


def set_similarity_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, sa, sb): pairs of comps whose unit sets (comp_id, unit) reach a Jaccard; their shared units and sizes.

    Two such sets share one of their rarest units: of a set of n only the first
    n - ceil(least * n) + 1, in an order by how many sets have a unit, are joined on, sizes
    must allow the pair, and it counts at the first unit that both prefixes have.
    """
    common = sets.groupBy("unit").agg(F.count(F.lit(1)).alias("of"))
    ordered = sets.join(common, "unit").groupBy("comp_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("of", "unit"))), lambda x: x["unit"]).alias("units"))
    size = F.size("units")
    prefix = ordered.withColumn("size", size).withColumn("prefix", F.slice("units", F.lit(1), size - F.ceil(F.lit(least) * size - 1e-9).cast("int") + 1))
    rows = prefix.select("comp_id", "units", "size", "prefix", F.explode("prefix").alias("unit"))
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.unit") == F.col("y.unit")) & (F.col("x.comp_id") < F.col("y.comp_id")) & (F.least("x.size", "y.size") >= least * F.greatest("x.size", "y.size") - 1e-9))
    first = F.try_element_at(F.array_intersect("x.prefix", "y.prefix"), F.lit(1)) == F.col("x.unit")
    shared = F.size(F.array_intersect("x.units", "y.units")).cast("long")
    pairs = met.filter(first).select(F.col("x.comp_id").alias("a"), F.col("y.comp_id").alias("b"), shared.alias("shared"), F.col("x.size").alias("sa"), F.col("y.size").alias("sb"))
    return pairs.filter(F.col("shared") >= least / (1 + least) * (F.col("sa") + F.col("sb")) - 1e-9)


def set_classes(sets: DataFrame, *by: str) -> DataFrame:
    """(comp_id, class_id, units, *by, members) of comps (comp_id, units, *by): those with equal units, and equal ``by``, are one
    class, named by its least comp; ``members`` is how many it has."""
    classes = sets.groupBy("units", *by).agg(F.min("comp_id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    same = F.lit(True)
    for c in ("units", *by):
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    found = sets.alias("x").join(classes.alias("y"), same)
    return found.select("x.comp_id", "y.class_id", *(F.col(f"x.{c}") for c in ("units", *by)), "y.members")


def class_links(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, shared, sa, sb, na, nb): pairs of classes whose units reach a Jaccard, with their shared units, sizes and members.

    Every pair of comps is a pair of their classes, or two of one class.
    """
    own = classes.filter("comp_id = class_id")
    of = lambda side: own.select(F.col("class_id").alias(side), F.col("members").alias(f"n{side}"))
    pairs = set_similarity_pairs(own.select("comp_id", F.explode("units").alias("unit")), least)
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "shared", "sa", "sb", "na", "nb")


def linked(classes: DataFrame, links: DataFrame, name: str, between: Column, within: Column) -> DataFrame:
    """kind, a, b, value, links: pairs of classes (``pair``) and the class of each comp (``comp``: a is the comp, b its class).

    ``links`` is the pairs of comps that a pair of classes stands for, or the comps that a comp is linked with.
    """
    ends = links.select(F.col("a").alias("class_id"), F.col("nb").alias("n")).unionAll(links.select("b", "na"))
    degree = ends.groupBy("class_id").agg(F.sum("n").alias("n"))
    pairs = links.select(F.lit("pair").alias("kind"), "a", "b", between.alias(name), (F.col("na") * F.col("nb")).alias("links"))
    count = F.col("members") - 1 + F.coalesce("n", F.lit(0))
    return pairs.unionAll(classes.join(degree, "class_id", "left").select(F.lit("comp"), "comp_id", "class_id", within, count))


#: Comps of a lane, and pairs of comps that one task gives.
LANE, TASK = 1024, 1 << 22


def own_links(classes: DataFrame) -> DataFrame:
    """(a, b, shared, sa, sb, na, nb) of each class with itself, for the pairs of comps of one class."""
    size = F.size("units")
    return classes.filter("comp_id = class_id").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), size.cast("long").alias("shared"), size.alias("sa"), size.alias("sb"), F.col("members").alias("na"), F.col("members").alias("nb"))


def expanded(classes: DataFrame, links: DataFrame, *carried: str, lane: int = LANE, task: int = TASK) -> DataFrame:
    """Every pair of comps (a < b) of linked classes, with the link's other columns; ``links`` has a row (c, c) for two comps of one class.

    A class's comps lie in lanes.  Two lanes that meet are one row, which is dealt to a task before its pairs are rows; ``p`` and ``q`` are
    the two comps with what they have in ``carried``, in either order.
    """
    of = lambda n: F.ceil(F.col(n) / lane).cast("int")
    comps = classes.select("class_id", F.pmod(F.xxhash64("comp_id"), of("members")).cast("int").alias("lane"), F.struct("comp_id", *carried).alias("c"))
    lanes = comps.groupBy("class_id", "lane").agg(F.collect_list("c").alias("comps"))
    values = [c for c in links.columns if c not in ("a", "b", "na", "nb")]
    met = links.withColumn("la", F.explode(F.sequence(F.lit(0), of("na") - 1))).withColumn("lb", F.explode(F.sequence(F.lit(0), of("nb") - 1))).filter("a <> b OR la <= lb")
    side = lambda c, at, name: lanes.select(F.col("class_id").alias(c), F.col("lane").alias(at), F.col("comps").alias(name))
    pairs = links.agg(F.sum(F.col("na") * F.col("nb")).alias("n")).first()["n"] or 0
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // task + 1)
    rows = met.join(side("a", "la", "ps"), ["a", "la"]).join(side("b", "lb", "qs"), ["b", "lb"]).repartition(parts, "a", "la", "b", "lb")
    same = (F.col("a") == F.col("b")) & (F.col("la") == F.col("lb"))
    rows = rows.select(same.alias("same"), *values, "qs", F.explode("ps").alias("p")).select("same", *values, "p", F.explode("qs").alias("q"))
    x, y = F.col("p.comp_id"), F.col("q.comp_id")
    return rows.filter(~F.col("same") | (x < y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), *values, "p", "q")


def kind_links(kinds: DataFrame, sets: DataFrame, links: DataFrame, *by: str) -> DataFrame:
    """(a, b, na, nb, shared, sa, sb, p, q): every pair of kinds of linked unit sets or of one, and each kind with itself.

    ``kinds`` come from ``set_classes`` by units and ``by``, which ``p`` and ``q`` have, in either order; ``sets`` are the classes of kinds
    with equal units, ``links`` those that are alike.
    """
    own = kinds.filter("comp_id = class_id").select("comp_id", "units", *by, F.col("members").alias("n"))
    met = expanded(sets.drop("units").join(own, "comp_id"), links.unionByName(own_links(sets)), "units", *by, "n")
    of = lambda side: F.when(F.col("p.comp_id") == F.col(side), F.col("p.n")).otherwise(F.col("q.n")).alias(f"n{side}")
    kind = F.struct("comp_id", "units", *by, "n")
    alone = own.select(F.col("comp_id").alias("a"), F.col("comp_id").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"), F.size("units").cast("long").alias("shared"), F.size("units").alias("sa"), F.size("units").alias("sb"), kind.alias("p"), kind.alias("q"))
    return met.select("a", "b", of("a"), of("b"), "shared", "sa", "sb", "p", "q").unionByName(alone)
