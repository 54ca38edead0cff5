"""Language-model scores by prediction by partial matching.

The model is a trie of byte contexts of up to ORDER bytes.  A symbol (a byte, or the
end of the text) is sought in the longest context that was seen; where it is missing,
the model escapes to the context one byte shorter, and the symbols of the longer one
are excluded there.  With n occurrences and d different symbols in a context (after
exclusion), a symbol seen c times has probability (2c - 1) / 2n and the escape d / 2n
(method D).  Shorter contexts count a symbol once for each context they are the end of,
as when a trie is updated with exclusion.  Below the empty context all symbols not yet excluded are equally likely.

The model is pretrained: counts come from the training documents, by context, summed over
the whole corpus.  Documents are dealt to chunks of bounded size, each of which is a
partition of its own; a chunk states what strings and words it has, these are summed over
all chunks before any row meets its sum again, and a chunk gets the counts of the contexts
and words that occur in it.  No task or broadcast ever holds the whole model.

The base model is a unigram model of words with additive smoothing, over the same counts.

Null texts are empty: they hold the end of text alone.  Null doc_ids count as the empty
text in the choice of training rows.  Repeated rows all count; rows of equal doc_id and text
share a chunk, which is as large as they are.  A very long text is one row of one chunk and is
worked on whole (some 120 bytes for each of its own).  An empty table gives an empty one.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod5, written
from .quality import FOLD, word_hashes, words_of

ORDER, END, SYMBOLS, WIDTH = 4, 256, 257, 9
CHUNK_BYTES = 28 << 20
WORD = 0  # kind of a row of word counts; a row of kind k counts strings of k symbols


def mask(symbols: int) -> np.int64:
    return np.int64((1 << WIDTH * symbols) - 1)


def packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of the last ORDER + 1 symbols at each place, their number, end of each text).

    Texts follow one another, each with its END; a key never reaches into the text before.
    """
    raw = [t.encode() for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    symbol = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    is_end = np.zeros(len(symbol), bool)
    is_end[ends - 1] = True
    symbol[~is_end] = np.frombuffer(b"".join(raw), np.uint8)
    symbol[is_end] = END
    place = np.arange(len(symbol)) - np.repeat(ends - sizes, sizes)
    length = np.minimum(place + 1, ORDER + 1)
    key = symbol.copy()
    for back in range(1, ORDER + 1):
        earlier = np.zeros_like(symbol)
        earlier[back:] = symbol[:-back] if len(symbol) > back else 0
        key |= np.where(length > back, earlier, 0) << np.int64(WIDTH * back)
    return key, length, ends


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's weights (1 by default)."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))) if weights is None else np.add.reduceat(weights, at)


def string_counts(key: np.ndarray, length: np.ndarray, train: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(symbols, keys, count in training texts) of all strings of 1 to ORDER + 1 symbols."""
    coded = (key | (length << np.int64(WIDTH * (ORDER + 1)))).astype(np.int64)
    every, _ = counted(coded)
    known, n = counted(coded[train])
    total = np.zeros(len(every), np.int64)
    total[np.searchsorted(every, known)] = n
    longest, strings = every >> np.int64(WIDTH * (ORDER + 1)), every & mask(ORDER + 1)
    for symbols in range(1, ORDER + 2):
        enough = longest >= symbols
        keys, sums = counted(strings[enough] & mask(symbols), total[enough])
        yield symbols, keys, sums


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text, train) of each row, and the number of chunks of about CHUNK_BYTES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (crc_mod5(F.col("doc_id")) != 1).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")), chunks


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), A-Z lower-cased."""
    raw = np.frombuffer(" ".join(texts).encode(), np.uint8)
    start, end = words_of(raw)
    sizes = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, len(texts))
    upto = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(start):
        return np.zeros(0, np.int64), np.diff(upto)
    return word_hashes(FOLD[raw], start, end).view(np.int64), np.diff(upto)


SLICE_BYTES = 1 << 20


def portions(table: pa.Table) -> Iterator[tuple[list[str], np.ndarray]]:
    """(texts, train) of runs of rows of a MB or so, so that temporary arrays stay small."""
    rows = table.num_rows
    step = max(1, int(rows * SLICE_BYTES / max(1, table.column("text").nbytes)))
    for at in range(0, rows, step):
        part = table.slice(at, step)
        yield part.column("text").to_pylist(), part.column("train").to_numpy().astype(bool)


def gather(rows: DataFrame, chunks: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, kind, key) of what occurs in each chunk; (kind, key, count) in all training rows.

    The sums have one row a key and only keys with a count; a key of all chunks is summed
    in part where its rows are made.
    """

    def run(table: pa.Table) -> pa.Table:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for texts, train in portions(table):
            key, length, ends = packed(texts)
            for kind, keys, n in string_counts(key, length, np.repeat(train, np.diff(np.concatenate([[0], ends])))):
                parts[kind].append((keys, n))
            words, per_text = word_keys(texts)
            every, _ = counted(words)
            known, n = counted(words[np.repeat(train, per_text)])
            total = np.zeros(len(every), np.int64)
            total[np.searchsorted(every, known)] = n
            parts[WORD].append((every, total))
            if len(parts[WORD]) > 6:  # sums of the portions so far take less room
                for found in parts.values():
                    found[:] = [counted(*(np.concatenate(x) for x in zip(*found)))]
                pa.default_memory_pool().release_unused()
        out = []
        for kind, found in parts.items():
            keys, n = counted(*(np.concatenate(x) for x in zip(*found)))
            found.clear()
            out.append(pa.table({"chunk": pa.array(np.full(len(keys), table.column("chunk")[0].as_py(), np.int32)), "kind": pa.array(np.full(len(keys), kind, np.int8)), "key": pa.array(keys), "n": pa.array(n)}))
        return pa.concat_tables(out)

    dealt = rows.select("chunk", "text", "train").repartitionById(chunks, F.col("chunk"))
    found = written(dealt.groupBy("chunk").applyInArrow(run, "chunk int, kind byte, key long, n long"), "found")
    sums = found.filter("n > 0").groupBy("kind", "key").agg(F.sum("n").alias("count"))
    return found.select("chunk", "kind", "key"), written(sums, "counts")


def contexts(counts: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """(kind, key, weight, follow, kinds, shorter) of strings up to ORDER symbols; (follow, kinds) of the root.

    weight: how often a string counts.  As in updating with exclusion, a string that is not
    of full length counts once for each symbol that goes before it, and once if it begins a
    text.  follow: weights of all strings one symbol longer; kinds: how many there are;
    shorter: the weights that their symbols have after the context one symbol shorter.
    """
    string = counts.filter(f"kind > {WORD}")
    low = F.expr(f"key & (shiftleft(1L, (kind - 1) * {WIDTH}) - 1)")
    down = (F.col("kind") - 1).cast("byte").alias("kind")
    before = string.filter("kind > 1").groupBy(down, low.alias("key")).agg(F.count(F.lit(1)).alias("symbols"), F.sum("count").alias("times"))
    begins = F.when(F.col("count") > F.coalesce("times", F.lit(0)), 1).otherwise(0)
    inner = string.filter(f"kind <= {ORDER}").join(before, ["kind", "key"], "left").select("kind", "key", (F.coalesce("symbols", F.lit(0)) + begins).alias("weight"))
    full = string.filter(f"kind > {ORDER}").select("kind", "key", F.col("count").alias("weight"))
    weighted = written(inner.union(full), "weights")
    up = weighted.select((F.col("kind") + 1).cast("byte").alias("kind"), F.col("key").alias("low"), F.col("weight").alias("short"))
    longer = weighted.withColumn("low", low).join(up, ["kind", "low"], "left")
    after = longer.groupBy(down, F.shiftright("key", WIDTH).alias("key")).agg(F.sum("weight").alias("follow"), F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("short"), F.lit(0)).alias("shorter"))
    after = written(after, "contexts")
    root = after.filter("kind = 0").select("follow", "kinds").first() or (0, 0)
    own = weighted.filter(f"kind <= {ORDER}").join(after, ["kind", "key"], "left")
    none = F.lit(0).cast("long")
    return own.select("kind", "key", "weight", *(F.coalesce(c, none).alias(c) for c in ("follow", "kinds", "shorter"))), (int(root[0]), int(root[1]))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    rows, chunks = chunked(docs)
    found, counts = gather(rows, chunks)
    strings, root = contexts(counts)
    words, vocabulary, ends = counts.agg(F.sum(F.when(F.col("kind") == WORD, F.col("count"))), F.count_if(F.col("kind") == WORD), F.sum(F.when((F.col("kind") == 1) & (F.col("key") == END), F.col("count")))).first()
    ends = ends or 0
    constants = ((words or 0) + ends, vocabulary + (ends > 0), ends, root)
    inner = F.col("kind").between(1, ORDER)
    none = F.lit(0).cast("long")
    plain = counts.filter(~inner).select("kind", "key", F.col("count").alias("weight"), none.alias("follow"), none.alias("kinds"), none.alias("shorter"))
    model = strings.unionByName(plain).withColumnRenamed("weight", "count")
    wanted = found.join(model, ["kind", "key"]).select("chunk", "kind", "key", "count", "follow", "kinds", "shorter")

    def run(texts: pa.Table, model: pa.Table) -> pa.Table:
        return score_chunk(texts, model, *constants)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts, counted = (df.repartitionById(chunks, F.col("chunk")).groupBy("chunk") for df in (rows, wanted))
    return texts.cogroup(counted).applyInArrow(run, schema)


def score_chunk(table: pa.Table, counts: pa.Table, known: int, vocabulary: int, ends: int, root: tuple[int, int]) -> pa.Table:
    kind = counts.column("kind").to_numpy()
    columns = {c: counts.column(c).to_numpy() for c in ("key", "count", "follow", "kinds", "shorter")}
    trie = Trie({k: {c: v[kind == k] for c, v in columns.items()} for k in range(1, ORDER + 2)}, root)
    order = np.argsort(columns["key"][kind == WORD])
    words, seen = columns["key"][kind == WORD][order], columns["count"][kind == WORD][order]
    floor = known + 0.5 * (vocabulary + 1)
    out: dict[str, list] = defaultdict(list)
    for texts, _ in portions(table):
        keys, per_text = word_keys(texts)
        distinct, inverse = np.unique(keys, return_inverse=True)
        count = np.zeros(len(distinct), np.int64)
        if len(words):
            at = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
            count = np.where(words[at] == distinct, seen[at], 0)
        count = count[inverse]
        upto = np.concatenate([[0], np.cumsum(per_text)])
        logs = np.concatenate([[0], np.cumsum(np.log10((count + 0.5) / floor))])
        hits = np.concatenate([[0], np.cumsum(count > 0)])
        out["n_tokens"].append(per_text + 1)
        out["n_known"].append(hits[upto[1:]] - hits[upto[:-1]] + (ends > 0))
        out["base_score"].append(logs[upto[1:]] - logs[upto[:-1]] + math.log10((ends + 0.5) / floor))
        out["score"].append(trie.log10(texts))
    del trie, columns, kind
    pa.default_memory_pool().release_unused()
    flat = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
    return pa.table({
        "doc_id": table.column("doc_id"), "held_out": pa.array(~table.column("train").to_numpy().astype(bool)),
        "n_tokens": pa.array(flat["n_tokens"].astype(np.int64)), "n_known": pa.array(flat["n_known"].astype(np.int64)),
        "train_tokens": pa.array(np.full(table.num_rows, known, np.int64)), "base_score": pa.array(flat["base_score"]), "score": pa.array(flat["score"]),
    })


class Trie:
    """Contexts and counts as arrays by level, walked for all places of many texts at once.

    Level k numbers the strings of k symbols from 0, with one number more for all that
    are missing.  ``child`` of level k leads by (string, class of the next symbol) to level
    k + 1.  Costs are natural logarithms.
    """

    def __init__(self, levels: dict[int, dict[str, np.ndarray]], root: tuple[int, int]):
        used = np.unique(levels[1]["key"])
        self.classes = len(used) + 1
        self.symbol = np.full(SYMBOLS, self.classes - 1, np.int64)
        self.symbol[used] = np.arange(len(used))
        self.child: list[np.ndarray] = []
        self.count: list[np.ndarray] = [np.zeros(1)]
        n, d = float(root[0]), float(root[1])
        follow, kinds = [np.array([n, 0.0])], [np.array([d, 0.0])]
        shorter = [np.zeros(2)]
        above = np.zeros(1, np.int64)
        for k in range(1, ORDER + 2):
            level = levels[k]
            order = np.argsort(level["key"])
            keys = level["key"][order]
            parent = keys >> np.int64(WIDTH)
            at = np.searchsorted(above, parent)
            at = np.where((at < len(above)) & (above[np.minimum(at, len(above) - 1)] == parent), at, len(above)) if len(above) else np.zeros(len(keys), np.int64)
            table = np.full((len(above) + 1) * self.classes, len(keys), np.int32)
            inside = at < len(above)
            table[at[inside] * self.classes + self.symbol[keys[inside] & mask(1)]] = np.flatnonzero(inside)
            self.child.append(table)
            self.count.append(np.append(np.log(2.0 * level["count"][order] - 1), -np.inf))
            follow.append(np.append(level["follow"][order], 0).astype(float))
            kinds.append(np.append(level["kinds"][order], 0).astype(float))
            shorter.append(np.append(level["shorter"][order], 0).astype(float))
            above = keys
        with np.errstate(divide="ignore"):
            # as the first context, or after the escape from the string one longer
            self.first = [np.log(2 * n) for n in follow]
            self.escape = [np.log(d) - np.log(np.maximum(2 * n, 1)) for n, d in zip(follow, kinds)]
        self.follow, self.kinds, self.shorter = follow, kinds, shorter

    def log10(self, texts: list[str]) -> np.ndarray:
        """log10 of the probability of each text with its end."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        symbol = np.full(int(ends[-1]), END, np.int64)
        body = np.ones(len(symbol), bool)
        body[ends - 1] = False
        symbol[body] = np.frombuffer(b"".join(raw), np.uint8)
        cls = self.symbol[symbol]
        n = len(cls)
        missing = [1] + [len(c) - 1 for c in self.count[1:]]
        at = [np.zeros(n, np.int64)]  # at[k][i]: string of the k symbols up to place i
        begin = np.zeros(n, bool)
        begin[np.concatenate([[0], ends[:-1]])] = True
        before = [np.zeros(n, np.int64)]  # the same up to the place before
        for k in range(1, ORDER + 2):
            own = self.child[k - 1][before[k - 1] * self.classes + cls].astype(np.int64)
            at.append(own)
            if k <= ORDER:
                shifted = np.empty(n, np.int64)
                shifted[1:] = own[:-1]
                shifted[begin] = missing[k]
                before.append(shifted)
        total = np.zeros(n)
        # the longest context that was seen and has successors
        rest = np.arange(n)
        came = np.full(n, -1, np.int64)  # string one longer, from which the model escaped
        for k in range(ORDER, -1, -1):
            ctx = before[k][rest]
            seen = self.follow[k][ctx] > 0
            fresh = came[rest] < 0
            start = np.flatnonzero(seen & fresh)
            later = np.flatnonzero(seen & ~fresh)
            hit = at[k + 1][rest] != missing[k + 1]
            done = np.zeros(len(rest), bool)
            if len(start):
                own, c = hit[start], ctx[start]
                cost = np.where(own, self.count[k + 1][at[k + 1][rest[start]]] - self.first[k][c], self.escape[k][c])
                total[rest[start]] += cost
                done[start] = own
            if len(later):
                own, c, longer = hit[later], ctx[later], came[rest[later]]
                n_left = self.follow[k][c] - self.shorter[k + 1][longer]
                d_left = self.kinds[k][c] - self.kinds[k + 1][longer]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost = np.where(own, self.count[k + 1][at[k + 1][rest[later]]], np.log(d_left)) - np.log(2 * n_left)
                total[rest[later]] += np.where(n_left > 0, cost, 0.0)
                done[later] = own
            going = ~done
            if k:
                came[rest[seen]] = ctx[seen]
                rest = rest[going]
            else:  # all symbols that the empty context has not are equally likely
                total[rest[going]] -= math.log(max(1.0, SYMBOLS - self.kinds[0][0]))
        sums = np.concatenate([[0], np.cumsum(total)])
        return (sums[ends] - sums[ends - sizes]) / math.log(10)
