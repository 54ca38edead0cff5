"""Token-id files in Simple-8b word-aligned coding.

A 64-bit word holds a selector in its top four bits and, in the other sixty, as many
values of equal width as the selector says.  Selector 0 is an escape: the next word is
one raw value of more than sixty bits (so its own top bits are never 0).  Values are
coded in blocks of BLOCK; a table of word offsets lets any block be read alone, and
both directions work on all blocks of a file at once.

A file holds the ids of whole documents in ascending doc_id order: header, document
ids, ids per document, block offsets, words.  Spark writes the files as rows of a
table (one binary value a file), so they land in whatever store the folder is in, and
a lost task leaves nothing behind.

Null texts count as empty, and a document always has its end id.  Null doc_ids sort
first.  Rows with the same doc_id stay, ordered by their text.  An empty table gives no files.
A very long text is one document of one file: its task holds the text, its ids and the coded
words at once (some 40 bytes for each id); a file is closed once it holds FILE_IDS ids.
Only doc_id and text are read; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .byte_bpe import WHITE_SPACE
from .common import slices, texts_of, written
from .quality import word_hashes

#: (values, bits of each) by selector; 0 is the escape (fixed values of the coding).
SELECTORS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS, BITS = (np.array(x, np.int64) for x in zip(*SELECTORS))
BLOCK = 256
MAGIC = b"S8B1"


#: The least width of the table that holds so many bits.
STEPS = np.array([min(b for b in BITS.tolist() if b >= bits) for bits in range(65)], np.uint8)


#: The same for every value of 16 bits.
SHORT = STEPS[np.frexp(np.arange(1 << 16, dtype=np.float64))[1]]


def widths(values: np.ndarray) -> np.ndarray:
    """Width of the table that each value needs; a value just under a power of two of over
    53 bits may count as one bit more, which costs room only."""
    if len(values) and values.max() < len(SHORT):
        return SHORT[values]
    return STEPS[np.minimum(np.frexp(values.astype(np.float64))[1], 64)]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end) of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n, blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    pad = 128
    grid = np.zeros((blocks, BLOCK + pad), np.uint8)
    flat = np.zeros(blocks * BLOCK + pad, np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = widths(flat[: blocks * BLOCK]).reshape(blocks, BLOCK)
    most, size = grid, 1  # the widest of the next ``size`` values
    choice = np.zeros((blocks, BLOCK), np.uint8)
    for selector in range(15, 0, -1):  # ever more values in a word; the last that fits stays
        count, bits = SELECTORS[selector]
        while 2 * size <= count:
            most = np.maximum(most, np.concatenate([most[:, size:], np.zeros((blocks, size), np.uint8)], 1))
            size *= 2
        fits = np.maximum(most[:, :BLOCK], most[:, count - size : count - size + BLOCK]) <= bits
        if not fits.any():  # then none fits more values of fewer bits
            break
        choice[fits] = selector
    flat_choice = choice.ravel()
    lanes = np.arange(blocks)
    at, slot = lanes * BLOCK, np.zeros(blocks, np.int64)
    end = np.minimum(at + BLOCK, n)
    seen: list[tuple[np.ndarray, ...]] = []
    while len(lanes):  # every block takes its next word
        chosen = flat_choice[at]
        seen.append((lanes, at, slot, chosen))
        at = at + COUNTS[chosen]
        slot = slot + 1 + (chosen == 0)
        going = at < end
        if not going.all():
            lanes, at, slot, end = lanes[going], at[going], slot[going], end[going]
    lane, start, slot, selector = (np.concatenate(x) for x in zip(*seen))
    per_block = np.bincount(lane, weights=1 + (selector == 0), minlength=blocks).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(per_block)])
    place = first[lane] + slot
    words = np.zeros(int(first[-1]), np.uint64)
    for s in np.unique(selector):
        count, bits = SELECTORS[s]
        mine = np.flatnonzero(selector == s)
        if s == 0:
            words[place[mine] + 1] = flat[start[mine]]
            continue
        inside = np.minimum((lane[mine] + 1) * BLOCK, n) - start[mine]
        word = np.full(len(mine), np.uint64(int(s) << 60))
        for j in range(count if bits else 0):
            word |= np.where(j < inside, flat[start[mine] + j], np.uint64(0)) << np.uint64(bits * j)
        words[place[mine]] = word
    return words, first.astype(np.uint32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of all blocks."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    raw[1:] = selector[:-1] == 0
    # an escape in front of a block's first word would be the end of another block
    count = np.where(raw, 0, COUNTS[selector])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    upto = np.cumsum(count) - count
    start = upto - upto[offsets[:-1].astype(np.int64)][block] + block * BLOCK
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(selector[~raw]):
        size, bits = SELECTORS[s]
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[start[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << bits) - 1)
        for j in range(size if bits else 0):
            inside = start[mine] + j < stop[mine]
            out[(start[mine] + j)[inside]] = (words[mine][inside] >> np.uint64(bits * j)) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """The values of one block, from its own words alone."""
    mine = words[offsets[block] : offsets[block + 1]]
    return decode(mine, np.array([0, len(mine)], np.uint32), min(BLOCK, n - block * BLOCK))


def pack_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file; ids holds the ids of all its documents in order."""
    words, offsets = encode(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    head = MAGIC + struct.pack("<IQQI", len(doc_ids), len(ids), len(words), len(offsets))
    return b"".join([head, known.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), offsets.astype("<u4").tobytes(), words.astype("<u8").tobytes()])


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b token file")
    docs, n, words, offsets = struct.unpack_from("<IQQI", data, 4)
    at = 4 + struct.calcsize("<IQQI")
    parts = []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", offsets), ("<u8", words)):
        parts.append(np.frombuffer(data, kind, size, at))
        at += parts[-1].nbytes
    doc_ids = [None if z else d for d, z in zip(parts[0].tolist(), parts[1].tolist())]
    return doc_ids, parts[2], decode(parts[4].astype(np.uint64), parts[3], n)


#: Words that a cache holds before it begins anew.
CACHED_WORDS = 600_000


class Words:
    """Ids of words, each with the byte before it: one array of all ids, and where each word's are."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def clear_if_full(self) -> None:
        if len(self.place) > CACHED_WORDS:
            self.place.clear()
            self.used = 0

    def learn(self, words: list[bytes], coded: list[bytes]) -> None:
        """Adds words that are not there yet, with their ids (little-endian)."""
        n, count = len(self.place), len(words)
        sizes = np.fromiter(map(len, coded), np.int64, count) // 4
        total = int(sizes.sum())
        while n + count > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(coded), "<u4")
        self.sizes[n : n + count] = sizes
        self.starts[n : n + count] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.place.update(zip(words, range(n, n + count)))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after another, where each word's end)."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.starts[which] - (ends - sizes), sizes)
        return self.ids[np.arange(len(shift)) + shift], ends


@dataclass
class Coder:
    """The library's tokenizer and what is kept from call to call."""

    library: Tokenizer
    words: Words
    cuttable: bool  # whether texts may be cut at blanks, see ``splits_at_blanks``
    added: tuple[str, ...]  # texts of tokens that the library seeks before all else


def splits_at_blanks(config: dict) -> bool:
    """Whether a tokenizer file says that pieces begin at each blank and that nothing joins them.

    That is byte-level BPE with its own pattern (a blank goes with the word behind it, a line
    end is a piece), no text changed before and no id added after.
    """
    before = config.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    model = config.get("model") or {}
    return bool(plain and config.get("normalizer") is None and config.get("post_processor") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))


@lru_cache(2)
def coder(path: str) -> Coder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    library = Tokenizer.from_file(path)
    config = json.loads(library.to_str())
    added = tuple(t["content"] for t in config.get("added_tokens") or [])
    return Coder(library, Words(), splits_at_blanks(config), added)


@lru_cache(2)
def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id's token (the vocabulary writes one character for each byte)."""
    vocabulary = coder(path).library.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)
    return out


TOGETHER = 1000


def encode_together(pieces: list[bytes], path: str) -> list[bytes]:
    """Ids (little-endian) of pieces by the library, many in a call.

    The pieces must be such as the library splits apart again when they follow one
    another; the bytes of the tokens tell whose they are.
    """
    library, size, out = coder(path).library, token_bytes(path), []
    groups = [pieces[i : i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
    for group, coded in zip(groups, library.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)):
        ids = np.array(coded.ids, "<u4")
        ends = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)))
        cuts = (4 * (np.searchsorted(np.cumsum(size[ids]), ends) + 1)).tolist()
        raw = ids.tobytes()
        out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
    return out


def encode_apart(texts: list[str], path: str) -> list[bytes]:
    return [np.array(x.ids, "<u4").tobytes() for x in coder(path).library.encode_batch_fast(texts, add_special_tokens=False)]


#: White space other than blanks and line ends, and white space next to white space.
UNUSUAL = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
WHITE = tuple(map(chr, WHITE_SPACE))


def plain(text: str) -> bool:
    """Whether words are set apart by single blanks and line ends alone."""
    if not text or text[0] in " \n" or text[-1] in " \n" or "\0" in text or any(map(text.__contains__, UNUSUAL)):
        return False
    return text.isascii() or not any(map(text.__contains__, WHITE))


#: Signs that, behind an ASCII letter or digit at the end of a word, are a piece of their own.
CLOSING = np.isin(np.arange(256), np.frombuffer(string.punctuation.encode(), np.uint8))
ALNUM = np.isin(np.arange(256), np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8))
#: Signs that are looked for at the end of a word; words that end in more are not cut.
CLOSING_SIGNS = 8
#: What stands before a word: a blank, a line end, or the beginning of the text.
BLANK, LINE_END, BEGIN = b" \n\0"


def closing_signs(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the signs at the end of words begin, of words whose signs follow a letter or digit."""
    found = []
    going = CLOSING[raw[end - 1]]
    at, cut = at[going], end[going] - 1
    for _ in range(CLOSING_SIGNS):
        before = raw[cut - 1]
        found.append(cut[ALNUM[before] & (cut > at + 1)])
        going = CLOSING[before]
        if not going.any():
            break
        at, cut = at[going], cut[going] - 1
    return np.concatenate(found)


def learn(words: list[bytes], path: str) -> None:
    """Encodes pieces that the cache does not have: words, each with the byte before it, and closing signs."""
    mine = coder(path)
    begins = [w for w in words if w[0] == BEGIN]
    inner = [w for w in words if w[0] in (BLANK, LINE_END)]
    signs = [w for w in words if CLOSING[w[0]]]
    apart = encode_apart([w[1:].decode() for w in begins] + [w.decode() for w in signs], path)
    mine.words.learn(begins + signs + inner, apart + encode_together(inner, path))


def plain_ids(texts: list[str], path: str) -> list[np.ndarray] | None:
    """Ids of plain texts (none if hashes clash): words and the signs behind them are cut and told apart
    as arrays, each different piece of a call is looked up once, and each of a cache encoded once."""
    words = coder(path).words
    data = ("\0" + "\0".join(texts)).encode()
    raw = np.frombuffer(data, np.uint8)
    starts = (raw == BLANK) | (raw == LINE_END) | (raw == BEGIN)
    at = np.flatnonzero(starts)
    starts[closing_signs(raw, at, np.append(at[1:], len(raw)))] = True
    at = np.flatnonzero(starts)
    end = np.append(at[1:], len(raw))
    _, first, which = np.unique(word_hashes(raw, at, end), return_index=True, return_inverse=True)
    sizes, shift = end - at, (at[first][which] - at).astype(np.int32)
    if not (sizes[first][which] == sizes).all() or not (raw[np.arange(len(raw), dtype=np.int32) + np.repeat(shift, sizes)] == raw).all():
        return None
    words.clear_if_full()
    keys = [data[a:b] for a, b in zip(at[first].tolist(), end[first].tolist())]
    found = list(map(words.place.get, keys))
    if None in found:
        learn([k for k, i in zip(keys, found) if i is None], path)
        found = [words.place[k] if i is None else i for k, i in zip(keys, found)]
    ids, ends = words.gather(np.array(found, np.int64)[which])
    last = np.append(np.flatnonzero(raw[at] == BEGIN)[1:], len(at)) - 1
    return np.split(ids, ends[last[:-1]])


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    In a plain text byte-level BPE always begins a piece at a blank and at a line end, so it
    can be cut there into words.  Other texts, texts with the text of an added token, and all
    texts of tokenizers of another kind go to the library whole.
    """
    mine = coder(path)
    easy = [mine.cuttable and plain(t) and not any(map(t.__contains__, mine.added)) for t in texts]
    cut = plain_ids([t for t, ok in zip(texts, easy) if ok], path) if any(easy) else []
    if cut is None:
        easy, cut = [False] * len(texts), []
    whole = (np.frombuffer(x, "<u4") for x in encode_apart([t for t, ok in zip(texts, easy) if not ok], path))
    found = iter(cut)
    return [next(found) if ok else next(whole) for ok in easy]


FILE_IDS, ENCODE_BYTES = 1 << 19, 1 << 20


def write_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Files of about FILE_IDS ids: rows (part, seq, before, n_docs, n_ids, data), in ascending doc_id order.

    Documents are dealt to ranges of doc_id; (part, seq) is the order of the files, and
    ``before`` the number of ids in the earlier files of the part.
    """
    spark = docs.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, before = TaskContext.get().partitionId(), 0, 0, 0
        doc_ids: list = []
        ids: list[np.ndarray] = []

        def file() -> pa.RecordBatch:
            data = pack_file(doc_ids, np.array([len(x) for x in ids]), np.concatenate(ids))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            for piece in slices(batch, ENCODE_BYTES):
                doc_ids += piece.column(0).to_pylist()
                new = [np.append(x, np.uint32(end_id)) for x in token_ids(texts_of(piece.column(1)), tokenizer_path)]
                ids += new
                held += sum(map(len, new))
                if held >= FILE_IDS:
                    yield file()
                    seq, before, held, doc_ids, ids = seq + 1, before + held, 0, [], []
        if doc_ids:
            yield file()

    return written(dealt.mapInArrow(run, "part int, seq int, before long, n_docs long, n_ids long, data binary"), "simple8b")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    ``start`` needs the ids of all earlier parts: one sum for each part, of which there
    are as many as ``write_files`` made ranges; these sums are broadcast.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start in zip(batch.column(0), batch.column(1)):
                doc_ids, lengths, ids = unpack_file(data.as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(ends - lengths + start.as_py(), pa.int64()), "n_tokens": pa.array(lengths.astype(np.int64), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return files.join(F.broadcast(parts), "part").select("data", (F.col("earlier") + F.col("before")).alias("start")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
