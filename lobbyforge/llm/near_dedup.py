"""Near-duplicate groups by a chosen-path set similarity join.

A document's set is its distinct shingles of words.  Documents with equal sets form a
class; what follows works on classes.  Minwise values of a set are its path choices: in
a tree, a node picks one of the positions, and with some chance a second, and every set
in it goes on to the child of its value there.  Similar sets part ways rarely, others
soon.  Independent trees are grown until a pair at the threshold is found with the
target recall.  Small nodes are compared exhaustively: sizes and two bits of each
minwise value (in parallel, as words) must allow a link.  What passes is a candidate.

A node that stays large holds a group of near copies or sets around a common passage.
Its sets meet a few pivots, which joins most copies to a few components.  Then all sets
from such nodes are joined exactly by prefixes: two sets that are similar enough share
one of their rarest shingles.  For each shingle the sets outside its main component meet
the others that have it, so a group of copies is not compared with itself.

Links are confirmed on whole sets, in rounds: each class tries its most similar
candidate that is not in its component yet; pairs inside a component need no
confirming, as they change no group.  What the rounds leave is confirmed pair by pair.

Words are runs without white space, A-Z lower-cased.  A text with fewer words than a
shingle has the whole sequence as its one shingle.  Texts without words and nulls have
no shingles and stay alone.  Repeated rows fall into one class.  A group's id is its
least doc_id; null doc_ids count last, and a group of nulls alone has none.  An empty table
gives an empty one; only doc_id and text are read, whatever other columns there are.  A very
long text is hashed as arrays of some 40 bytes a byte of its text, in its own task; sets of
candidates travel whole, 8 bytes a shingle.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, texts_of, written
from .components import components
from .quality import FOLD, word_hashes, words_of

#: Minwise values of a set; of the few sets in large nodes, and the words of 64 bits these fill.
POSITIONS, WIDE, WORDS = 64, 1024, 16
#: Buckets in which shingles of late sets are counted, and how many of them a row holds.
BUCKETS, LANE = 1 << 14, 64
U32 = np.uint64(32)
WIDE_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = WIDE_FACTORS[:POSITIONS]
MIXER = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """Similarity is at_least / of; branching: children a node has on average."""

    width: int = 2
    at_least: int = 80
    of: int = 100
    trees: int = 5
    branching: float = 1.65
    small_node: int = 64
    node_share: float = 0.03
    pivots: int = 2
    rounds: int = 2

    @property
    def threshold(self) -> float:
        return self.at_least / self.of

    def most_apart(self, positions: int = POSITIONS) -> int:
        """Positions whose two bits may differ: four deviations over what is expected at the threshold."""
        p = 0.75 * (1 - self.threshold)
        return math.ceil(positions * p + 4 * math.sqrt(positions * p * (1 - p)))

    @property
    def likely_apart(self) -> int:
        """Positions whose two bits are expected to differ at the threshold, and a deviation."""
        p = 0.75 * (1 - self.threshold)
        return math.ceil(POSITIONS * p + math.sqrt(POSITIONS * p * (1 - p)))

    def levels(self, classes: int) -> int:
        """Depth at which nodes of unlike sets are expected to be small."""
        return max(1, math.ceil(math.log(max(1, classes) / 16, 1 / self.node_share))) if classes > 16 else 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIXER
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    raw = FOLD[np.frombuffer(text.encode(), np.uint8)]
    start, end = words_of(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    hashes = word_hashes(raw, start, end)
    n = max(1, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(width, len(hashes))):
        out = mix(out * np.uint64(3) + hashes[j : j + n])
    return np.unique(out)


def signature(found: np.ndarray, factors: np.ndarray = FACTORS) -> np.ndarray:
    """Minwise values of a set at all positions."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = (1 << 18) // len(factors)
    for at in range(0, len(found), step):
        best = np.minimum(best, (found[at : at + step, None] * factors).min(0))
    return (mix(best) >> U32).astype(np.uint32)


def two_bits(sig: np.ndarray) -> np.ndarray:
    """The last bits of all values, then the bits before them, as words."""
    return np.packbits(np.stack([sig & 1, (sig >> 1) & 1]).astype(np.uint8), axis=1).view(np.int64).ravel()


def sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, class (null: no shingles), signature and its bits of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch.column(1)):
            found = shingles(text, width)
            if len(found):
                sig = signature(found)
                bits = two_bits(sig)
                rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), sig.tobytes(), int(bits[0]), int(bits[1])))
            else:
                rows.append((0, None, None, 0, 0))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "key", "n", "class", "sig", "bits0", "bits1"])

    return arrow_map(keyed(docs).select("doc_id", "text", "key"), run, "doc_id long, key long, n long, class binary, sig binary, bits0 long, bits1 long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the hash of the text by which rows of one doc_id are told apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))


#: A class is named by its least doc_id and its hash, so the least class of a group has its
#: least doc_id: a byte that puts nulls last, 8 bytes in the order of signed numbers, 16 of the hash.
SIGN = -(1 << 63)


def named(doc_id: Column, digest: Column) -> Column:
    number = F.unhex(F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).bitwiseXOR(F.lit(SIGN))), 16, "0"))
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), number, digest)


def least_id(name: Column) -> Column:
    """The doc_id in a class's name, null for a class of nulls."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(SIGN))
    return F.when(F.substring(name, 1, 1) == F.unhex(F.lit("00")), number)


def branch(classes: DataFrame, levels: int, settings: Settings, first: int = 0) -> DataFrame:
    """Nodes so many levels down: (node, class, n, bits0, bits1); from the roots, or from column ``node``."""
    chance = np.uint64(int((settings.branching - 1) * 2**32))
    rooted = "node" not in classes.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, POSITIONS).astype(np.uint64)
        if rooted:
            doc = np.repeat(np.arange(n), settings.trees)
            node = mix(np.tile(np.arange(1, settings.trees + 1, dtype=np.uint64), n))
        else:
            doc, node = np.arange(n), batch.column(5).to_numpy().view(np.uint64)
        for level in range(first, first + levels):
            pick = mix(node + np.uint64((level + 1) * int(MIXER) % 2**64))
            one = pick % np.uint64(POSITIONS)
            two = (one + np.uint64(1) + (pick >> np.uint64(8)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
            more = (pick >> U32) < chance
            doc, node = np.concatenate([doc, doc[more]]), np.concatenate([mix(node ^ mix((one << U32) + sig[doc, one])), mix(node[more] ^ mix((two[more] << U32) + sig[doc[more], two[more]]))])
        names = ["node", "class", "n", "bits0", "bits1"]
        taken = pa.array(doc)
        return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), *(batch.column(i).take(taken) for i in (0, 2, 3, 4))], names=names)

    return arrow_map(classes.select("class", "sig", "n", "bits0", "bits1", *([] if rooted else ["node"])), run, "node long, class binary, n long, bits0 long, bits1 long")


def near(a: str, b: str, settings: Settings, sketch: bool = True):
    """Column: whether sizes allow a link; with the sketch: how far it is apart, and whether both allow one."""
    sizes = F.expr(f"least({a}.n, {b}.n) * {settings.of} >= greatest({a}.n, {b}.n) * {settings.at_least}")
    if not sketch:
        return sizes
    apart = F.expr(f"bit_count(({a}.bits0 ^ {b}.bits0) | ({a}.bits1 ^ {b}.bits1))")
    return apart, sizes & (apart <= settings.most_apart())


def pair(apart):
    return F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"), apart.cast("int").alias("apart")


def candidates(classes: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(pairs a < b with their distance of sketches, classes of the nodes that stayed large)."""
    rows = branch(classes, settings.levels(classes.count()), settings)
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("in_node")).filter("in_node > 1")
    rows = written(rows.join(counts, "node"), "nodes")
    apart, close = near("x", "y", settings)
    small = rows.filter(F.col("in_node") <= settings.small_node)
    small = small.alias("x").join(small.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.class") < F.col("y.class")) & close)
    large = rows.filter(F.col("in_node") > settings.small_node)
    pivot = large.groupBy("node", F.pmod(F.xxhash64("class", "node"), F.lit(settings.pivots)).alias("_p")).agg(F.min(F.struct(F.xxhash64("node", "class"), "class", "n", "bits0", "bits1")).alias("s"))
    pivot = pivot.select("node", "s.class", "s.n", "s.bits0", "s.bits1")
    likely = (F.col("x.node") == F.col("y.node")) & (F.col("x.class") != F.col("y.class")) & close & (apart <= settings.likely_apart)
    met = large.alias("x").join(pivot.alias("y"), likely)
    pairs = small.select(*pair(apart)).union(met.select(*pair(apart)))
    pairs, late = written(pairs.distinct(), "pairs"), written(large.select("class").distinct(), "late")
    discard(rows)
    return pairs, late


def whole_sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, late: DataFrame, settings: Settings) -> DataFrame:
    """(class, members) of every class in a pair or in ``late``, from the text of one of its documents."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).union(late).distinct()
    one = classes.join(wanted, "class", "left_semi").select("class", "first", "key")
    rows = keyed(docs).alias("d").join(one.alias("o"), (F.col("d.key") == F.col("o.key")) & F.col("d.doc_id").eqNullSafe(F.col("o.first"))).select("class", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, members = [], []
        for cls, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            found = shingles(text, settings.width).tobytes()
            if hashlib.blake2b(found, digest_size=16).digest() == cls[-16:]:  # not a text of the same key
                keep.append(cls)
                members.append(found)
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.binary()), pa.array(members, pa.binary())], names=["class", "members"])

    return written(arrow_map(rows, run, "class binary, members binary").dropDuplicates(["class"]), "sets")


def confirmed(pairs: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose sets are as similar as the threshold asks."""
    a = members.select(F.col("class").alias("a"), F.col("members").alias("of_a"))
    b = members.select(F.col("class").alias("b"), F.col("members").alias("of_b"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared * settings.of >= settings.at_least * (len(x) + len(y) - shared))
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b")
    return written(arrow_map(joined, run, "a binary, b binary"), "links")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that do not lie in one component yet."""
    ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return joined.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def placed(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, key, n and root (null: no shingles) of each row: root is the least class of its group."""
    rows = written(sets(docs, settings.width), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("s")
    classes = rows.filter(F.col("class").isNotNull()).groupBy(F.col("class").alias("digest")).agg(first, F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits0").alias("bits0"), F.first("bits1").alias("bits1"))
    classes = written(classes.select(named(F.col("s.doc_id"), F.col("digest")).alias("class"), "digest", F.col("s.doc_id").alias("first"), F.col("s.key").alias("key"), "n", "sig", "bits0", "bits1"), "classes")
    pairs, late = candidates(classes, settings)
    roots = linked(docs, classes, pairs, late, settings)
    found = classes.select("digest", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select("digest", F.coalesce("root", "class").alias("root"))
    joined = rows.select("doc_id", "key", "n", F.col("class").alias("digest")).join(found, "digest", "left")
    return joined.select("doc_id", "key", "n", "root")


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows = placed(docs, settings)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(least_id(F.col("root"))).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, late: DataFrame, settings: Settings) -> DataFrame:
    """(node, root) of the classes with links."""
    members = whole_sets(docs, classes, pairs, late, settings)
    links, roots = None, None
    open_pairs, spent = pairs, [members]
    for step in range(settings.rounds + 1):
        best = open_pairs.select("a", "b")
        if step < settings.rounds:
            both = open_pairs.union(open_pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
            best = both.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("s")).select(F.least("a", "s.b").alias("a"), F.greatest("a", "s.b").alias("b")).distinct()
            best = written(best, "best")
        new = confirmed(best, members, settings)
        spent += [t for t in (best, new, open_pairs) if hasattr(t, "written_to")]
        links = new if links is None else links.union(new)
        roots = components(links)
        if step < settings.rounds:
            open_pairs = written(across(open_pairs, roots).join(best, ["a", "b"], "left_anti").select("a", "b", "apart"), "open")
            if open_pairs.isEmpty():
                break
    if not late.isEmpty():
        more, tables = prefix_pairs(late, members, roots, settings)
        new = confirmed(more, members, settings)
        spent += [new, *tables]
        links = links.union(new)
        roots = components(links)
    discard(late, *spent)
    return roots


def prefix_pairs(late: DataFrame, members: DataFrame, roots: DataFrame, settings: Settings) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of late classes in different components that share a shingle of their prefixes, and the tables they come from.

    The prefix of a set of n are its first n - ceil(threshold * n) + 1 shingles in an order
    that holds for all sets: sets at the threshold have one of these in common, and the
    first of them stands early enough in both.  The order puts rare shingles first; how
    rare one is, is counted over all late sets in BUCKETS of its hash.
    """
    mine = members.join(late, "class", "left_semi").join(roots.withColumnRenamed("node", "class"), "class", "left")
    mine = written(mine.select("class", F.coalesce("root", "class").alias("root"), "members"), "late_sets")

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(m, np.uint64) % np.uint64(BUCKETS), minlength=BUCKETS)
        lanes = total.reshape(-1, LANE)
        used = np.flatnonzero(lanes.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *map(pa.array, np.ascontiguousarray(lanes[used].T))], names=["lane", *cells])

    cells = [f"c{i}" for i in range(LANE)]
    sums = mine.select("members").mapInArrow(count, "lane int, " + ", ".join(f"{c} long" for c in cells)).groupBy("lane").agg(*(F.sum(c).alias(c) for c in cells))
    rarity = np.zeros(BUCKETS, np.int64)
    for lane, *n in sums.collect():
        rarity[lane * LANE : (lane + 1) * LANE] = n
    shared = late.sparkSession.sparkContext.broadcast(rarity)
    words = [f"w{i}" for i in range(2 * WORDS)]

    def prefix(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, shingle, size, place, bits = [], [], [], [], []
        for row, m in enumerate(batch.column(2).to_pylist()):
            found = np.frombuffer(m, np.uint64)
            n = len(found)
            length = n - -(-n * settings.at_least // settings.of) + 1
            first = np.lexsort((found, shared.value[found % np.uint64(BUCKETS)]))[:length]
            owner.append(np.full(length, row))
            shingle.append(found[first].view(np.int64))
            size.append(np.full(length, n))
            place.append(np.arange(1, length + 1))
            bits.append(np.repeat(two_bits(signature(found, WIDE_FACTORS))[:, None], length, 1))
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        planes = np.concatenate(bits, 1) if bits else np.zeros((2 * WORDS, 0), np.int64)
        whose = pa.array(flat(owner))
        return pa.RecordBatch.from_arrays([pa.array(flat(shingle)), batch.column(0).take(whose), batch.column(1).take(whose), pa.array(flat(size)), pa.array(flat(place)), *map(pa.array, planes)], names=["shingle", "class", "root", "n", "place", *words])

    kinds = "shingle long, class binary, root binary, n long, place long, " + ", ".join(f"{w} long" for w in words)
    rows = written(arrow_map(mine, prefix, kinds), "prefixes")
    sizes = rows.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("shingle", F.col("m.root").alias("main"))
    met = written(rows.join(main, "shingle"), "met")
    odd = met.filter(F.col("root") != F.col("main"))
    apart = F.expr(" + ".join(f"bit_count((x.w{i} ^ y.w{i}) | (x.w{i + WORDS} ^ y.w{i + WORDS}))" for i in range(WORDS)))
    # from the first shingle in common on, what is left must do for the overlap that is needed
    enough = F.expr(f"(least(x.n - x.place, y.n - y.place) + 1) * {settings.at_least + settings.of} >= {settings.at_least} * (x.n + y.n)")
    close = near("x", "y", settings, sketch=False) & enough & (apart <= settings.most_apart(WIDE))
    pairs = odd.alias("x").join(met.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & close)
    return pairs.select(*pair(F.lit(0))[:2]).distinct(), [mine, rows, met]


def kept_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each group, of its least doc_id, with the documents' own columns.

    Rows without shingles stay, but of rows that repeat doc_id and text (of null doc_ids: the
    text) only one; where their other columns differ, it may be any of them.
    """
    rows = placed(docs, settings)
    counted = rows.groupBy("doc_id", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key", "n")).alias("s")
    grouped = counted.filter("root IS NOT NULL").groupBy("root").agg(first).select("s.doc_id", "s.key", "s.n")
    kept = grouped.union(counted.filter("root IS NULL").select("doc_id", "key", "n")).toDF("_id", "_key", "_n")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    alone = docs.join(kept.filter("_n = 1"), here, "left_semi")
    again = kept.filter("_n > 1")
    if again.isEmpty():
        return alone
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rest = docs.join(again, here, "left_semi").select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), every)
    return alone.unionByName(rest.groupBy("_id", "_key").agg(F.first("_row").alias("_row")).select("_row.*"))
