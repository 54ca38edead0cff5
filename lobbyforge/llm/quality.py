"""Quality rules: base counts and divergence from the language's usual distributions.

The references of a language come from all documents: for each character class the
upper quartile of its share in a document (which the shares of a minority of odd
documents do not move), and the counts of the commonest words with the rest in one bin.
A document is compared with the references of its language by the Jensen-Shannon
distance (base 2, 0 to 1).  Short texts say little: each comparison has a least length
and an allowance that shrinks with the length.  Digits are in no class: numbers,
addresses and keys are no sign of another language.

Limits on words are parts of ``none``, the distance at which a text without any common
word stands.  Besides the distance over all common words, which in short texts is
mostly chance, the share of common words as a whole is compared (two bins): too few of
them is the sign of another language, of gibberish and of lists.

Null texts and texts without words have no words and fail the base rule.  A document
without language is compared with the reference of all documents, its words with the
nearest reference of any language.  One whose language has under MIN_REFERENCE_WORDS words, or
under one in LANGUAGES of all words, is compared with that of all documents too, but its words
do not reject it, as nothing says what is usual there; so there are at most LANGUAGES references,
whatever the column holds.  Repeated rows stay; an empty table gives none.  Clashing column
names are no matter.  A very long text is worked on as arrays of some 60 bytes a byte of text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, texts_of, written

#: Character classes: lower case, upper case, other letters, blanks, line ends, common
#: punctuation, symbols of the contract, all other signs; digits are left out.
LOWER_CASE, UPPER_CASE, LETTER, BLANK, LINE_END, PUNCTUATION, SYMBOL, OTHER, DIGIT = range(9)
CLASSES = 8
SYMBOLS, PUNCTUATION_SIGNS = "#*$%&|<>", ".,;:'\"-()?/’¿¡=+@_"


@dataclass(frozen=True)
class Limits:
    """Limits of the rules; distances are of the whole document."""

    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    common_words: int = 40
    min_chars: int = 40
    class_distance: float = 0.09
    class_allowance: float = 1.2
    min_common_words: int = 40
    word_distance: float = 0.8  # of none
    word_allowance: float = 1.2
    min_few_words: int = 20
    few_distance: float = 0.4  # of none
    few_allowance: float = 1.45  # 3.4 standard deviations of a share; as a floor, not added


MIN_REFERENCE_WORDS, LANGUAGES = 1000, 1000


def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x3000):
        c = chr(point)
        if c.isalpha():
            table[point] = LOWER_CASE if c.islower() else UPPER_CASE if c.isupper() else LETTER
        elif c.isdigit():
            table[point] = DIGIT
    table[0x3000:0xE000] = LETTER
    table[[9, 32, 0xA0]] = BLANK
    table[[10, 11, 12, 13]] = LINE_END
    table[[ord(c) for c in PUNCTUATION_SIGNS]] = PUNCTUATION
    table[[ord(c) for c in SYMBOLS]] = SYMBOL
    return table


TABLE = class_table()
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 21


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n at least, kept from call to call unless they are very many."""
    found = POWERS.get(int(base))
    if found is None or len(found) <= n:
        found = np.full(max(n + 1, 1 << 16), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if len(found) <= KEPT_POWERS:
            POWERS[int(base)] = found
    return found


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word in the bytes of a text or of joined texts."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ~SPACES[raw], [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices of bytes, by prefix sums of a polynomial."""
    prefix = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[raw] * powers(STEP, len(raw))[: len(raw)], out=prefix[1:])
    found = (prefix[end] - prefix[start]) * powers(BACK, len(raw))[start]
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return found ^ (found >> np.uint64(29)) ^ (end - start).astype(np.uint64)


def repeated(hashes: np.ndarray, width: int) -> int:
    """Words inside windows of so many words that the text has twice or more."""
    n = len(hashes) - width + 1
    if n < 2:
        return 0
    window = np.zeros(n, np.uint64)
    for j in range(width):
        window = window * STEP + hashes[j : j + n]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    mark = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    mark[at] += 1
    np.add.at(mark, at + width, -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def base_counts(text: str, width: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    start, end = words_of(raw)
    if not len(start):
        return 0, 0, 0, 0, 0
    points = (raw & 0xC0) != 0x80
    chars = int(np.count_nonzero(points & ~SPACES[raw]))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    signs = sum(map(text.count, SYMBOLS))
    return len(start), chars, signs, len(lines) - len(set(lines)), repeated(word_hashes(raw, start, end), width)


def class_counts(text: str) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=CLASSES + 1)[:CLASSES]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


#: Words are counted in so many buckets of their hash, shares in steps of 1 / SHARES: what
#: is counted for a language has a fixed size.
BUCKETS, SHARES, QUANTILE = 1 << 14, 1000, 0.75
#: Languages that a task sums before it hands on what it has.
HELD = 64


def word_buckets(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (word_hashes(FOLD[raw], start, end) >> np.uint64(50)).astype(np.int64)


@dataclass(frozen=True)
class Reference:
    """Histograms of a language: character classes; the common buckets, then the rest."""

    classes: np.ndarray
    place: np.ndarray  # bucket -> bin of ``words``
    words: np.ndarray

    @property
    def none(self) -> float:
        """The word distance of a text without common words."""
        return distance(np.eye(len(self.words))[-1], self.words)


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str | None, Reference]:
    """References by language (None: of all documents), counted over all documents.

    Each task sums what it reads, of HELD languages at a time; Spark sums those rows of
    (language, cell, count) and leaves out languages of too few words.  The driver gets
    ``CLASSES + common_words + 1`` rows of each of at most LANGUAGES languages.
    """
    shares = CLASSES * (SHARES + 1)
    cells = shares + BUCKETS
    first = np.arange(CLASSES) * (SHARES + 1)

    def count(batches):
        found: dict[str | None, np.ndarray] = {}

        def rows():
            for lang, mine in found.items():
                at = np.flatnonzero(mine)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "cell": pa.array(at, pa.int32()), "count": pa.array(mine[at])})
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                if text:
                    if len(found) >= HELD and lang not in found:
                        yield from rows()
                    mine = found.setdefault(lang, np.zeros(cells, np.int64))
                    raw = np.frombuffer(text.encode(), np.uint8)
                    classes = class_counts(text)
                    mine[first + classes * SHARES // max(1, classes.sum())] += 1
                    mine[shares:] += np.bincount(word_buckets(raw, *words_of(raw)), minlength=BUCKETS)
        yield from rows()

    counted = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(count, "lang string, cell int, count long")
    counted = written(counted, "histograms")  # a few cells a task and language: read thrice below
    every = counted.filter(F.col("cell") >= shares).agg(F.sum("count")).first()[0] or 0
    own = counted.filter(F.col("lang").isNotNull())
    spoken = own.filter(F.col("cell") >= shares).groupBy("lang").agg(F.sum("count").alias("words")).filter(F.col("words") >= max(MIN_REFERENCE_WORDS, every / LANGUAGES))
    own = own.join(F.broadcast(spoken.select("lang")), "lang", "left_semi")  # LANGUAGES rows at most
    sums = own.groupBy("lang", "cell").agg(F.sum("count").alias("count")).unionByName(counted.groupBy("cell").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(None).cast("string")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "cell"))
    words = sums.filter(F.col("cell") >= shares).withColumn("rank", rank)
    words = words.groupBy("lang", F.when(F.col("rank") > limits.common_words, -1).otherwise(F.col("cell") - shares).alias("cell")).agg(F.sum("count").alias("count"))
    kind, step = F.expr(f"cell div {SHARES + 1}"), F.col("cell") % (SHARES + 1)
    ordered = Window.partitionBy("lang", "kind").orderBy("step")
    levels = sums.filter(F.col("cell") < shares).select("lang", kind.alias("kind"), step.alias("step"), "count")
    levels = levels.withColumn("upto", F.sum("count").over(ordered)).withColumn("all", F.sum("count").over(Window.partitionBy("lang", "kind")))
    levels = levels.filter(F.col("upto") >= QUANTILE * F.col("all")).groupBy("lang", "kind").agg(F.min("step").alias("step"))
    by_lang: dict[str | None, dict[int, int]] = {None: {}}
    for lang, cell, n in words.collect():
        by_lang.setdefault(lang, {})[cell] = n
    level: dict[str | None, np.ndarray] = {None: np.zeros(CLASSES)}
    for lang, kind, step in levels.collect():
        level.setdefault(lang, np.zeros(CLASSES))[kind] = step
    out = {}
    for lang, mine in by_lang.items():
        common = sorted(c for c in mine if c >= 0)
        place = np.full(BUCKETS, len(common), np.uint16)
        place[common] = np.arange(len(common))
        counts = np.array([*(mine[c] for c in common), mine.get(-1, 0)], float)
        out[lang] = Reference(level.get(lang, np.zeros(CLASSES)), place, counts)
    discard(counted)
    return out


@dataclass(frozen=True)
class Apart:
    """How far a text is from its reference; ``none`` is 0 where words cannot reject it."""

    by_class: float
    by_word: float
    few: float  # of two bins, common words and others; 0 if it has no fewer than usual
    none: float


def word_divergences(buckets: np.ndarray, reference: Reference) -> tuple[float, float]:
    """Distances of all common words one by one, and of their share if it is too small."""
    found = np.bincount(reference.place[buckets], minlength=len(reference.words))
    own, usual = (np.array([h[:-1].sum(), h[-1]], float) for h in (found, reference.words))
    less = own[0] * usual.sum() < usual[0] * own.sum()
    return distance(found, reference.words), distance(own, usual) if less else 0.0


def divergences(text: str, lang: str | None, known: dict[str | None, Reference], none: dict[str | None, float]) -> Apart:
    """Jensen-Shannon distances from the reference of the language (see above for others)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    buckets = word_buckets(raw, *words_of(raw))
    usual = known.get(lang, known[None])
    by_class = distance(class_counts(text).astype(float), usual.classes)
    if lang is not None:
        return Apart(by_class, *word_divergences(buckets, usual), none[lang] if lang in known else 0.0)
    return Apart(by_class, *min((*word_divergences(buckets, r), none[k]) for k, r in known.items() if k is not None or len(known) == 1))


def verdict(n_chars: int, n_words: int, apart: Apart, limits: Limits) -> bool:
    """True if the text is long enough to judge nowhere, or near enough everywhere."""
    odd_classes = n_chars >= limits.min_chars and apart.by_class > limits.class_distance + limits.class_allowance / n_chars**0.5
    if odd_classes or not apart.none:
        return not odd_classes
    odd_words = n_words >= limits.min_common_words and apart.by_word > limits.word_distance * apart.none + limits.word_allowance / n_words**0.5
    few_words = n_words >= limits.min_few_words and apart.few > max(limits.few_distance * apart.none, limits.few_allowance / n_words**0.5)
    return not (odd_words or few_words)


def judge(docs: DataFrame, limits: Limits = Limits(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, then the base counts, both distances and ``kept`` of each document."""
    return measured(docs, limits, keep).toDF(*keep, *MEASURES)


def measured(docs: DataFrame, limits: Limits, keep: tuple[str, ...]) -> DataFrame:
    """``judge`` with columns c0, c1, ...: no name clashes with a document's."""
    known = references(docs, limits)
    shared = docs.sparkSession.sparkContext.broadcast((known, {k: r.none for k, r in known.items()}))
    fields = [(c, docs.schema[c].dataType) for c in keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        refs, none = shared.value
        out = []
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            n, chars, signs, lines, again = base_counts(text, limits.window)
            failed = n < limits.min_words or 100 * again > limits.repeat_percent * n
            apart = divergences(text, lang, refs, none) if n else Apart(0.0, 0.0, 0.0, 0.0)
            out.append((n, chars, signs, lines, again, failed, apart.by_class, apart.by_word, not failed and verdict(len(text), n, apart, limits)))
        columns = list(zip(*out)) or [()] * 9
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        arrays = [*batch.columns[2:], *(pa.array(c, t) for c, t in zip(columns, types))]
        return pa.RecordBatch.from_arrays(arrays, names=[f"c{i}" for i in range(len(arrays))])

    names = [f"c{i}" for i in range(len(fields) + 9)]
    kinds = [t.simpleString() for _, t in fields] + ["long"] * 5 + ["boolean", "double", "double", "boolean"]
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text", *(F.col(f"`{c}`") for c in keep))
    return arrow_map(rows.toDF(*(f"i{i}" for i in range(len(keep) + 2))), run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_divergence", "word_divergence", "kept")


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with their own columns."""
    columns = tuple(docs.columns)
    judged = measured(docs, limits, columns)
    return judged.filter(judged.columns[-1]).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
