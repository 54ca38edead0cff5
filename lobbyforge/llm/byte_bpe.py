"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are split without a regex.  Every code point gets a class from a table; a
look at the neighbours turns it into one of nine input symbols; an automaton of
eight states over those symbols says where pieces begin.  The automaton runs as
an associative scan: blocks of the input are composed into transition functions
side by side, the functions are combined across blocks by doubling, and a second
pass replays every block from its true entry state.  Slices between boundaries
feed a cache of merged pieces; the ids of a piece come from pair merging by rank.

Nulls count as empty texts; an empty text has no ids and decodes to the empty
byte string.  Repeated rows stay; order of rows does not matter; an empty table gives an empty
one.  Columns that are kept may have any name but ``ids`` and ``offsets``, which are refused.
A very long text is one value of a slice of its own: its classes, symbols and states are
arrays of some 30 bytes a code point.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts_of

# ---------------------------------------------------------------- classes

LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE, APOS1, APOS2, RESET = range(9)
#: States: nothing open, letters, numbers, other signs, one space that joins what follows,
#: white space, a contraction with one or two letters to come.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, SPACE_OPEN, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
#: States that every symbol sends to the same state are of one kind; functions are kept for
#: one state of each kind.
KINDS = (CLOSED, IN_OTHER, ONE_LEFT, TWO_LEFT)
KIND_OF = np.array([0, 0, 0, 1, 1, 0, 2, 3], np.intp)
#: White_Space of Unicode besides U+0009-U+000D and U+0020 (fixed values).
WHITE_SPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    category = unicodedata.category
    for point in range(sys.maxunicode + 1):
        first = category(chr(point))[0]
        if first == "L":
            table[point] = LETTER
        elif first == "N":
            table[point] = NUMBER
    table[[*range(9, 14), 32, *WHITE_SPACE]] = WHITE
    return table


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, begins a piece), both indexed by symbol * 8 + state."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (APOS1, IN_OTHER), (APOS2, IN_OTHER)):
        step[symbol] = run
        begins[symbol, [run, SPACE_OPEN]] = False
    step[LETTER, ONE_LEFT], step[LETTER, TWO_LEFT] = CLOSED, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    free = [s for s in range(8) if s not in (IN_OTHER, SPACE_OPEN)]
    step[APOS1, free], step[APOS2, free] = ONE_LEFT, TWO_LEFT
    step[SPACE_LAST], step[WHITE_LAST], step[WHITE] = SPACE_OPEN, CLOSED, IN_WHITE
    begins[WHITE, IN_WHITE] = False
    step[RESET] = CLOSED
    return step.ravel(), begins.ravel()


def symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Input symbols of concatenated texts; ends: where each (non-empty) text ends."""
    kind = class_table()[points]
    out = kind.copy()
    white = kind == WHITE
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[ends - 1] = False  # white space at the end of a text is one piece
    out[last] = WHITE_LAST
    out[last & (points == 32)] = SPACE_LAST
    at = np.flatnonzero(points == 39)
    if len(at):
        stop = ends[np.searchsorted(ends, at, side="right")]
        room = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = room[at + 1], room[at + 2]
        single = (at + 1 < stop) & np.isin(one, [ord(c) for c in "stmd"])
        pair = (at + 2 < stop) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        out[at[single]] = APOS1
        out[at[pair]] = APOS2
    return out


def boundaries(points: np.ndarray, ends: np.ndarray, block: int = 64) -> np.ndarray:
    """True where a piece begins, by an associative scan of transition functions."""
    n = len(points)
    step, begins = automaton()
    syms = symbols(points, ends)
    blocks = -(-n // block)
    grid = np.full(blocks * block, RESET, np.uint8)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(blocks, block).T) * np.uint8(8)
    first = np.zeros(blocks * block, bool)  # the automaton starts anew with each text
    starts = np.concatenate([[0], ends[:-1]])
    first[starts] = True
    fresh = np.ascontiguousarray(first.reshape(blocks, block).T)
    funcs = np.repeat(np.array(KINDS, np.uint8)[:, None], blocks, 1)
    for t in range(block):
        if fresh[t].any():
            funcs[:, fresh[t]] = CLOSED
        funcs += grid[t]
        funcs = step.take(funcs, mode="clip")
    shift = 1
    while shift < blocks:  # prefix composition by doubling
        later = funcs[:, shift:].copy()
        funcs[:, shift:] = np.take_along_axis(later, KIND_OF[funcs[:, :-shift]], 0)
        shift *= 2
    state = np.concatenate([[CLOSED], funcs[0, :-1]]).astype(np.uint8)
    out = np.empty((block, blocks), bool)
    for t in range(block):
        state[fresh[t]] = CLOSED
        key = grid[t] + state
        out[t] = begins[key]
        state = step[key]
    return out.T.reshape(-1)[:n]


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts joined, start of each piece and the end, number of pieces up to each text)."""
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not joined:
        return joined, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begin = boundaries(points, np.cumsum(sizes[sizes > 0]))
    starts = np.flatnonzero(begin)
    upto = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return joined, np.append(starts, len(points)), upto


# ---------------------------------------------------------------- merging


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Merger:
    """Ids of a piece: merges the adjacent pair of least rank until none is known."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]

    def ids(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self.short(piece) if len(piece) < 60 else self.long(piece)

    def short(self, piece: bytes) -> list[int]:
        get, parts = self.ranks.get, [piece[i : i + 1] for i in range(len(piece))]
        none = 1 << 60
        rank = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while rank:
            least = min(rank)
            if least == none:
                break
            i = rank.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rank[i]
            if i:
                rank[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(rank):
                rank[i] = get(parts[i] + parts[i + 1], none)
        ranks = self.ranks
        return [ranks[p] for p in parts]

    def long(self, piece: bytes) -> list[int]:
        """The same with a heap over a linked list, for pieces of any length."""
        n, get = len(piece), self.ranks.get
        part = [piece[i : i + 1] for i in range(n)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return [self.ranks[part[i]] for i in range(n) if alive[i]]


CACHED_PIECES = 500_000


class PieceCache(dict):
    """Piece -> its ids as decimal bytes joined by a space; emptied when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        found = b" ".join(b"%d" % i for i in self.encode(piece))
        if len(piece) <= 64:
            self[piece] = found
        return found


@lru_cache(4)
def encoder(path: str) -> tuple[PieceCache, dict[bytes, bytes]]:
    """(cache of encoded pieces, bytes of each id in decimal) for a rank file; once a worker."""
    ranks = load_ranks(path)
    merger = Merger(ranks)
    return PieceCache(lambda piece: merger.ids(piece.encode())), {b"%d" % rank: token for token, rank in ranks.items()}


def joined_ids(texts: list[str], cache: PieceCache) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Ids of each text in decimal, with the piece starts and the piece count up to each text."""
    joined, starts, upto = split(texts)
    bounds = starts.tolist()
    lookup = cache.__getitem__
    out = []
    for first, last in zip(upto[:-1].tolist(), upto[1:].tolist()):
        out.append(b" ".join([lookup(joined[a:b]) for a, b in zip(bounds[first:last], bounds[first + 1 : last + 1])]))
    return out, starts, upto


def encode_texts(texts: list[str], rank_path: str) -> list[list[int]]:
    """Ids of each text; the plain interface of the operator."""
    cache, _ = encoder(rank_path)
    return [[int(i) for i in ids.split()] for ids in joined_ids(texts, cache)[0]]


def decode_ids(ids: list[int], rank_path: str) -> bytes:
    _, token = encoder(rank_path)
    return b"".join(token[b"%d" % i] for i in ids)


def encode_documents(docs: DataFrame, rank_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``ids array<int>`` and ``offsets array<int>`` (code point where each piece begins)."""
    if {"ids", "offsets"} & set(keep):
        raise ValueError("columns named ids or offsets cannot be kept beside the operator's own")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(len(keep)))
        cache, _ = encoder(rank_path)
        ids, starts, upto = joined_ids(texts, cache)
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        offsets = [(starts[a:b] - s).tolist() for a, b, s in zip(upto[:-1], upto[1:], base)]
        columns = [*(batch.column(i) for i in range(len(keep))), pa.array([[int(x) for x in i.split()] for i in ids], pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "offsets"])

    return arrow_map(docs.select(*keep, text), run, f"{fields}, ids array<int>, offsets array<int>")


def digest(docs: DataFrame, rank_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_pieces of each whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache, token = encoder(rank_path)
        ids, _, upto = joined_ids(texts_of(batch.column(1)), cache)
        sha, of = hashlib.sha256, token.__getitem__
        rows = [(x.count(b" ") + 1 if x else 0, sha(x).hexdigest(), sha(b"".join(map(of, x.split(b" "))) if x else b"").hexdigest()) for x in ids]
        count, coded, decoded = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string()), pa.array(np.diff(upto), pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long")
