"""Toxicity by noisy-channel deobfuscation.

Tokens that look tampered with (signs or digits for letters, letters repeated, letters
set apart by blanks or marks) become lattices of the characters that they may stand
for; a Viterbi search finds the likeliest spelling under a character trigram model of
the corpus and the cost of each substitution.  The restored text is scored by the log
odds of the words that set toxic documents apart from others, and, within a bound, by the mean
leaning of all its words, toxic or clean, which are counted in buckets of a hash.  A text with a toxic word
starts from the share of toxic documents, one without from their share among labelled texts without.

The character model counts all documents.  The words are learnt from labelled rows, at
most ``max_labelled`` of them in hash order; near copies count once, so a copied
document does not teach its own words.  Null and empty texts have no words and lean nowhere.  Labelled
rows without a label are left out; of a document with several labels the greatest holds.
Repeated rows stay; an empty table gives an empty one, empty labels a model that marks nothing.
Column names play no part (``score`` and the like may be among the documents').  A very long
text is read whole, token by token: what is kept of it is its different words.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod5, texts_of

#: Letters that a sign may stand for (fixed values of the channel).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
MARKS = set(".-_*~'`^/\\,:;=#%&") | {"​", "‍", "­"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, FOREIGN, SIZE = 26, 27, 28
#: Costs in nats: a sign read as a letter, a sign or mark dropped, a sign kept, letters run together.
READ, DROP_SIGN, DROP_MARK, KEEP, SQUEEZE = 0.7, 9.0, 0.5, 4.0, 0.5

#: Longer tokens are cut at marks; what is longer still is decoded in windows of so many that overlap by half.
MAX_TOKEN = 40
BREAKS = re.compile(r"[-_.~^/\\,:;=#%&*|+]+")
#: A stem counts if two words or more begin with it, one of them in so many words of the text.
STEM, STEM_EVERY = 4, 150
SPELT = re.compile(r"(?<!\S)\S(?:[ \t]+\S){3,}(?!\S)")
RUN = re.compile(r"(.)\1{2,}")
PLAIN = re.compile(r"[^\W\d_]+")
TRIM = "".join(sorted(MARKS)) + "!?\"()[]{}<>$|+@«»…"


#: Characters in a piece of a word that blanks break; signs that close a clause.
PIECE, CLOSING = 4, "!?.,;:\"')"


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 20_000
    max_words: int = 500
    least_documents: int = 4
    least_spread: float = 0.5
    least_weight: float = 4.0
    least_stem_weight: float = 2.75
    #: Buckets of words that lean to either side, documents against which a bucket's leaning is drawn to none, and the most that all words move a score (in nats).
    buckets: int = 1 << 13
    leaning_prior: float = 8.0
    most_leaning: float = 1.0


@dataclass(frozen=True)
class Model:
    costs: np.ndarray  # -log p(third | first, second), SIZE x SIZE x SIZE
    weights: dict[str, float]  # skeleton -> log odds
    prior: float  # log odds of a text with a toxic word before its words are counted
    without: float  # log odds of a text without any
    leanings: list[float]  # bucket of a word -> log odds, drawn to 0
    most_leaning: float


def letter_ids() -> np.ndarray:
    table = np.full(0x110000, EDGE, np.uint8)
    for point in range(0x3000):
        if chr(point).isalpha():
            table[point] = FOREIGN
    for i, c in enumerate(LETTERS):
        table[ord(c)] = table[ord(c.upper())] = i
    return table


IDS = letter_ids()


def trigram_costs(docs: DataFrame) -> np.ndarray:
    """Costs of all letter trigrams, counted over all documents (SIZE**3 cells at most)."""

    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                ids = IDS[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
                ids = np.concatenate([[EDGE, EDGE], ids, [EDGE]])
                total += np.bincount(ids[:-2] * SIZE * SIZE + ids[1:-1] * SIZE + ids[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int32()), "count": pa.array(total[at])})

    rows = docs.select("text").mapInArrow(count, "cell int, count long").groupBy("cell").agg(F.sum("count").alias("count")).collect()
    counts = np.zeros(SIZE**3)
    for cell, n in rows:
        counts[cell] = n
    counts = counts.reshape(SIZE, SIZE, SIZE)
    counts[:, EDGE, EDGE] = 0  # blanks and signs in a row tell nothing of spelling
    pair = counts.sum(0)
    single = pair.sum(0)
    one = (single + 1) / (single.sum() + SIZE)
    two = (pair + 5 * one) / (pair.sum(1, keepdims=True) + 5)
    three = (counts + 5 * two[None]) / (counts.sum(2, keepdims=True) + 5)
    return -np.log(three)


def readings(run: str, size: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with the cost of each reading."""
    if run.isalpha():
        if size == 1:
            return [(run, 0.0)]
        return [(run, SQUEEZE if size > 2 else 1.5), (run * 2, 0.0 if size == 2 else 1.0)]
    if run in LEET:
        found = [(c * n, READ * n) for c in LEET[run] for n in ({1, size} if size <= 2 else {1})]
        return [*found, ("", DROP_SIGN), ("?", KEEP)]
    return [("", DROP_MARK), ("?", KEEP)] if run in MARKS else [("?", 0.0)]


def restore(token: str, costs: np.ndarray) -> str:
    """The likeliest spelling of a lower-cased token; ``?`` stands for what is no letter."""
    lattice = [readings(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]
    best: dict[tuple[int, int], tuple[float, str]] = {(EDGE, EDGE): (0.0, "")}
    for options in lattice:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, text) in best.items():
            for letters, own in options:
                x, y, total = a, b, cost + own
                for c in letters:
                    i = IDS[ord(c)]
                    total += costs[x, y, i]
                    x, y = y, i
                if (old := after.get((x, y))) is None or (total, text + letters) < old:
                    after[x, y] = (total, text + letters)
        best = after
    return min((cost + costs[a, b, EDGE], text) for (a, b), (cost, text) in best.items())[1]


def skeleton(word: str) -> str:
    """The word with letters in a row written once."""
    return re.sub(r"(.)\1+", r"\1", word, flags=re.S)


def parts_of(tokens: list[str]) -> list[str]:
    """The tokens; long ones with runs written thrice (they read the same) and cut at marks."""
    if not any(len(t) > MAX_TOKEN for t in tokens):
        return tokens
    out: list[str] = []
    for token in tokens:
        if len(token) > MAX_TOKEN:
            token = re.sub(r"(.)\1{3,}", r"\1\1\1", token, flags=re.S)
        out.extend(filter(None, BREAKS.split(token)) if len(token) > MAX_TOKEN else [token])
    return out


def tokens_of(text: str) -> list[str]:
    return parts_of(text.lower().split())


def tampered(token: str) -> bool:
    """Whether signs stand among letters, or a letter comes three times in a row."""
    letters = sum(map(str.isalpha, token))
    if letters < 2:
        return False
    inside = token.rstrip(TRIM)
    return bool(RUN.search(token)) or any(not c.isalpha() for c in inside.lstrip(".-_*~'`^/\\,:;=#%&?\"()[]{}<>"))


CACHED = 120_000
NONE: frozenset[str] = frozenset()


class Restorer:
    """Tokens of a text in their restored spelling, as skeletons."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.cache: dict[str, tuple[str, ...]] = {}

    def words(self, token: str) -> tuple[str, ...]:
        found = self.cache.get(token)
        if found is None:
            found = self.spell(token)
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[token] = found
        return found

    def spell(self, token: str) -> tuple[str, ...]:
        core = token.strip(TRIM)
        out = {skeleton(p) for p in PLAIN.findall(core)} if not core.isalpha() else {skeleton(core)}
        if len(token) <= MAX_TOKEN and tampered(token):
            out.update(skeleton(p) for p in restore(token.rstrip("!?.,;:*%&#\"'"), self.costs).split("?") if p)
        return tuple(token if p == token else p for p in out)  # most words are their own: one string, not two

    def text(self, tokens: list[str]) -> set[str]:
        """Words of a text's tokens, and stems (with ``~``) that begin several of its words densely."""
        words = self.words
        found: set[str] = set()
        for token in set(tokens):
            found.update(words(token))
        stems: dict[str, int] = {}
        for word in found:
            if len(word) > STEM:
                stems[word[:STEM]] = stems.get(word[:STEM], 0) + 1
        found.update(f"{stem}~" for stem, n in stems.items() if n > 1 and n * STEM_EVERY >= len(tokens))
        return found

    def spelt(self, text: str, tokens: list[str]) -> list[str]:
        """Skeletons of the letters set apart by blanks, and of long tokens in windows."""
        out = []
        for m in SPELT.finditer(text):
            letters = re.sub(r"[ \t]+", "", m[0].lower())
            for at in range(0, len(letters), 200):  # overlapping windows: any length in bounded time
                out.append(skeleton(restore(letters[at : at + 240], self.costs)))
        for token in tokens:
            if len(token) > MAX_TOKEN and tampered(token):
                for at in range(0, len(token) - MAX_TOKEN // 2, MAX_TOKEN // 2):
                    out.append(skeleton(restore(token[at : at + MAX_TOKEN], self.costs)))
        return out


class Joiner:
    """Learnt words whose letters stand in tokens next to one another (``s c u m``, ``mo ron``)."""

    def __init__(self, model: Model):
        self.costs = model.costs
        self.words = {w for w in model.weights if not w.endswith("~")}
        self.heads = {w[:n] for w in self.words for n in range(1, len(w) + 1)}
        self.steps: dict[tuple[frozenset[str], str], frozenset[str]] = {}
        self.first: dict[str, frozenset[str]] = {}

    def step(self, heads: frozenset[str], token: str) -> frozenset[str]:
        """Beginnings of learnt words after a further piece, in every reading of its characters."""
        found = self.steps.get((heads, token))
        if found is None:
            now = set(heads)
            for c in token:
                if c not in MARKS:
                    letters = LEET.get(c, c)
                    now = {h + x for h in now for x in letters if h + x in self.heads} | {h for h in now if h and h[-1] in letters}
            found = frozenset(now) or NONE
            if len(self.steps) >= CACHED:
                self.steps.clear()
            self.steps[heads, token] = found
        return found

    def begin(self, token: str) -> frozenset[str]:
        found = self.first.get(token)
        if found is None:
            if len(self.first) >= CACHED:
                self.first.clear()
            found = NONE if ends(token) else (self.step(frozenset([""]), token) - {""}) or NONE
            self.first[token] = found
        return found

    def cost(self, word: str) -> float:
        a, b, total = EDGE, EDGE, 0.0
        for c in word:
            i = int(IDS[ord(c)])
            total += self.costs[a, b, i]
            a, b = b, i
        return total + self.costs[a, b, EDGE]

    def find(self, tokens: list[str]) -> set[str]:
        """Words that a run of pieces makes, if they are likelier in one than apart."""
        begin, out = self.begin, set()
        for at, token in enumerate(tokens):
            if len(token) > PIECE or not (heads := begin(token)):
                continue
            for end in range(at + 1, len(tokens)):
                piece = tokens[end]
                last = piece.rstrip(CLOSING)
                if len(last) > PIECE or not last:
                    break
                heads = self.step(heads, last)
                if not heads:
                    break
                if hits := (heads & self.words) - out:
                    apart = sum(self.cost(p) for p in (*tokens[at:end], last))
                    out.update(w for w in hits if self.cost(w) + DROP_MARK * (end - at) < apart)
                if ends(piece):
                    break
        return out


def ends(token: str) -> bool:
    """Whether a piece closes a clause, so that no word goes on behind it."""
    return len(token) > 2 and token[-1] in CLOSING


def group_of(words: set[str]) -> int:
    """The least hash of the longer words: near copies mostly have the same, others do not."""
    return min((zlib.crc32(w.encode()) for w in words if len(w) > 8 and w.isalpha()), default=min((zlib.crc32(w.encode()) for w in words), default=0))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Character model of all documents; words of the labelled rows that may be learnt from."""
    costs = trigram_costs(docs)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(costs)
    usable = labels.filter((crc_mod5(F.col("doc_id")) != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def words(batches):
        restorer = Restorer(shared.value)
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                found = restorer.text(tokens_of(text))
                out.append((toxic, group_of(found), sorted(found)))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.string())))], names=["toxic", "copies", "words"])

    spelled = rows.mapInArrow(words, "toxic int, copies long, words array<string>").cache()
    sizes = {r[0]: r[1] for r in spelled.groupBy("toxic").agg(F.count_distinct("copies")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    each = spelled.select("toxic", "copies", F.explode("words").alias("word")).groupBy("word", "toxic", "copies").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("n"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_if(F.col("toxic") == 0).alias("clean"),
    )
    weight = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(clean + 1.0))
    kept = counts.filter((F.col("toxic") >= settings.least_documents) & (F.col("toxic") >= settings.least_spread * F.col("n")) & (F.length("word") >= 3))
    kept = kept.withColumn("weight", weight).filter(F.col("weight") >= F.when(F.col("word").endswith("~"), settings.least_stem_weight).otherwise(settings.least_weight))
    chosen = kept.orderBy(F.desc("toxic"), "word").limit(settings.max_words).select("word", "weight").collect()
    names = [w for w, _ in chosen]
    plain = spelled.filter(~F.arrays_overlap("words", F.array(*map(F.lit, names)).cast("array<string>"))) if names else spelled
    unmarked = {r[0]: r[1] for r in plain.groupBy("toxic").agg(F.count_distinct("copies")).collect()}
    bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(settings.buckets)).cast("int")
    met = each.select(bucket.alias("bucket"), "toxic", "copies").distinct().groupBy("bucket").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    leanings = [0.0] * settings.buckets
    for at, t, c in met.collect():  # a row a bucket at most
        leanings[at] = leaning(t, c, toxic, clean, settings)
    spelled.unpersist()
    return Model(costs, {w: float(x) for w, x in chosen}, math.log((toxic + 1) / (clean + 9)), math.log((unmarked.get(1, 0) + 0.5) / (unmarked.get(0, 0) + 9)), leanings, settings.most_leaning)


def leaning(toxic_with: int, clean_with: int, toxic: int, clean: int, settings: Settings) -> float:
    """Log odds of a bucket's words, drawn to 0 where few documents have them."""
    n = toxic_with + clean_with
    return (math.log((toxic_with + 0.5) / (toxic + 1)) - math.log((clean_with + 0.5) / (clean + 1))) * n / (n + settings.leaning_prior)


def score(text: str, restorer: Restorer, joiner: Joiner, model: Model) -> tuple[float, list[str]]:
    """(probability, toxic words found) of a text."""
    tokens = tokens_of(text)
    words = restorer.text(tokens)
    hits = {w for w in words if w in model.weights}
    for letters in restorer.spelt(text, tokens) if text else ():
        hits.update(w for w in model.weights if w in letters and len(w) > STEM)
    hits |= joiner.find(tokens)
    table, size = model.leanings, len(model.leanings)
    mean = math.fsum(table[zlib.crc32(w.encode()) % size] for w in words) / max(1, len(words))
    logit = (model.prior if hits else model.without) + sum(model.weights[w] for w in sorted(hits)) + model.most_leaning * math.tanh(mean)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit)))), sorted(hits)


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then score (0 to 1), predicted (0 or 1) and the words that told."""
    return scored(docs, labels, settings, keep).toDF(*keep, "score", "predicted", "toxic_words")


def scored(docs: DataFrame, labels: DataFrame, settings: Settings, keep: tuple[str, ...]) -> DataFrame:
    """``judge`` with columns c0, c1, ...: no name clashes with a document's."""
    model = learn(docs, labels, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        if not state:
            state.extend((Restorer(own.costs), Joiner(own)))
        found = [score(t, *state, own) for t in texts_of(batch.column(0))]
        points = [s for s, _ in found]
        arrays = [*batch.columns[1:], pa.array(points, pa.float64()), pa.array([int(s >= 0.5) for s in points], pa.int32()), pa.array([h for _, h in found], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    kinds = [*(docs.schema[c].dataType.simpleString() for c in keep), "double", "int", "array<string>"]
    rows = docs.select("text", *(F.col(f"`{c}`") for c in keep)).toDF(*(f"i{i}" for i in range(len(keep) + 1)))
    return arrow_map(rows, run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))


def clean_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    columns = tuple(docs.columns)
    judged = scored(docs, labels, settings, columns)
    return judged.filter(f"c{len(columns) + 1} = 0").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
