"""Token ids in a word-aligned binary format (Simple-8b).

Each 64-bit word holds a 4-bit selector and 60 payload bits: the selector tells
how many ids of how many bits follow (1 x 60 ... 60 x 1).  Selector 0 is the
escape: one id of any size up to 60 bits; ids are unsigned 32-bit, so an escape
always suffices.  Words are grouped in blocks of whole documents; a block holds
a header, the byte offset, first id and length of each document, and the words,
so any document is decoded without its neighbours.  A file is a Parquet table
of one row a block, which makes it readable from any store Spark reads, written
by Spark's committer and so safe against lost or repeated tasks.

Texts are dealt into ranges of doc_id and sorted, each range encodes its part
in order and notes how many ids stand before each block in the range; the
number of ids of each range (a few rows, one a partition) gives the rest of the
global start of a document.

Defined cases: a null or empty text has no ids besides the end id; rows of one
doc_id follow each other in text order, a null text first; a null doc_id comes
before all others (the smallest long counts as null).
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .word_cache import WordCache

#: Fixed values of the format: bits of an id for each selector.
BITS = (60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
COUNTS = tuple(60 // b for b in BITS)
ESCAPE = 0
MAGIC = b"S8B1"
BLOCK_IDS = 1 << 16
END_ID = 0
#: Characters of texts encoded together.
STEP = 500_000
#: Selectors worth trying, densest first; one id in a word is the escape.
_TRY = tuple((s, COUNTS[s], BITS[s]) for s in range(len(BITS) - 1, 1, -1))


#: Bits needed by each 16-bit value.
_WIDTH = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.int8)


def pack(ids: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words of a sequence of unsigned 32-bit ids, and the number of words that
    stand before each end in `ends`; no word crosses an end.

    The selector that fits most ids is found for all positions at once: the
    width needed by the next n ids is a sliding maximum.  The greedy walk then
    jumps from word to word, and words are filled selector by selector."""
    n = len(ids)
    ends = np.array([n], np.int64) if ends is None else ends
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    wide = _WIDTH[np.minimum(ids, (1 << 16) - 1)]
    if (large := ids >> 16).any():
        wide = np.where(large > 0, 16 + _WIDTH[large], wide)
    room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    best = np.full(n, ESCAPE, np.int8)
    most, span, widest = wide, 1, int(wide.max())
    # Sliding maxima for growing spans; a longer fit replaces a shorter one.
    for s, count, bits in reversed(_TRY):
        if count > n:
            break
        while span < count:
            step = min(span, count - span)
            most = np.maximum(most[: len(most) - step], most[step:])
            span += step
        fits = most <= bits if bits < widest else np.ones(len(most), bool)
        fits &= room[: len(most)] >= count
        if not fits.any():
            break
        best[: len(most)][fits] = s
    starts = _walk(np.asarray(COUNTS, np.int64)[best], n)
    sel = best[starts]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        own = np.flatnonzero(sel == s)
        at = starts[own]
        part = words[own]
        for k in range(COUNTS[s]):
            part |= ids[at + k].astype(np.uint64) << np.uint64(k * BITS[s])
        words[own] = part
    return words, np.searchsorted(starts, ends)


def _walk(jump: np.ndarray, n: int) -> np.ndarray:
    at, out = 0, []
    steps = jump.tolist()
    while at < n:
        out.append(at)
        at += steps[at]
    return np.array(out, np.int64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of a sequence of words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.asarray(COUNTS, np.int64)[sel]
    out = np.zeros(int(counts.sum()), np.uint32)
    start = np.cumsum(counts) - counts
    for s in np.unique(sel):
        at, w = start[sel == s], words[sel == s]
        mask = np.uint64((1 << BITS[s]) - 1)
        for k in range(COUNTS[s]):
            out[at + k] = (w >> np.uint64(k * BITS[s])) & mask
    return out


def write_block(docs: list[np.ndarray]) -> bytes:
    """Header, n + 1 word offsets, n id counts, words."""
    counts = np.array([len(d) for d in docs], "<u4")
    words, ends = pack(np.concatenate([np.zeros(0, np.uint32), *docs]).astype(np.uint32), np.cumsum(counts, dtype=np.int64))
    offsets = np.concatenate([[0], ends]).astype("<u8")
    return struct.pack("<4sIQ", MAGIC, len(docs), int(counts.sum())) + offsets.tobytes() + counts.tobytes() + words.astype("<u8").tobytes()


def open_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word offsets, id counts and words of a block."""
    magic, n, _ = struct.unpack_from("<4sIQ", data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    offsets = np.frombuffer(data, "<u8", n + 1, 16)
    counts = np.frombuffer(data, "<u4", n, 16 + 8 * (n + 1))
    return offsets, counts, np.frombuffer(data, "<u8", int(offsets[-1]), 16 + 8 * (n + 1) + 4 * n)


def read_block(data: bytes) -> Iterator[np.ndarray]:
    """The ids of each document: all words are decoded at once, then split."""
    _, counts, words = open_block(data)
    return iter(np.split(unpack(words), np.cumsum(counts)[:-1])) if len(counts) else iter(())


def read_document(data: bytes, k: int) -> np.ndarray:
    """The ids of one document, by its offset alone."""
    offsets, _, words = open_block(data)
    return unpack(words[int(offsets[k]) : int(offsets[k + 1])])


class CachedEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct
    piece once while it is cached.

    A text is cut where a pre-token of the byte-level pattern starts whatever
    stands before it, so that its pieces can be encoded apart: at a space or a
    line end between two words, after that line end, and where punctuation ends
    a word.  Texts with other runs of white space are cut less finely.  All texts
    of a call are cut and looked up together."""

    def __init__(self, path: str, keep: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spaced = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.spaced[i] = token[:1] == _ALPHABET[32]
        self.cache = WordCache(keep)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _stems(self, words: list[bytes], step: int = 2048) -> Iterator[bytes]:
        """Ids of words of letters, each with a space before it: one pre-token
        each, so many go to the library's model at once."""
        for k in range(0, len(words), step):
            some = words[k : k + step]
            text = b"\n".join(some).decode("latin-1").translate(_ALPHABET)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = (4 * np.append(np.flatnonzero(self.spaced[ids]), len(ids))).tolist()
            if len(at) != len(some) + 1:  # never for a byte-level vocabulary
                raise ValueError("a word holds a space")
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip(at, at[1:]))

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that are not cached."""
        stem = [STEM.fullmatch(p) is not None for p in pieces]
        stems = self._stems([p for p, s in zip(pieces, stem) if s])
        others = iter(self._library([p.decode("utf-8", "surrogatepass") for p, s in zip(pieces, stem) if not s]))
        return [next(stems) if s else next(others) for s in stem]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b"".join(data), np.uint8)
        bounds = np.cumsum([0, *map(len, data)])
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        first = cuts(raw, bounds)
        ids, n = self.cache.resolve(raw, first, self._new)
        before = np.concatenate([[0], np.cumsum(n)])
        return np.split(ids, before[np.searchsorted(first, bounds[1:-1])])


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others
    for the code points from 256 on, in order.  Line ends are left as they are."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    table.update((b, chr(256 + k)) for k, b in enumerate(b for b in range(256) if b not in table))
    del table[10]
    return table


_ALPHABET = _alphabet()
#: A space and letters of Latin-1.
STEM = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_OTHER, _SPACE, _LINE, _MARK, _ALNUM = range(5)
_CLASS = np.full(256, _OTHER, np.int8)
_CLASS[[32]], _CLASS[[10]] = _SPACE, _LINE
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _ALNUM
#: First bytes of characters that are white space, besides space and line end, or
#: that Unicode versions and libraries take for it.
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def cuts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts raw[bounds[k]:bounds[k + 1]] start.

    A space starts a piece if a character that is no white space follows; a
    line end is a piece if it stands between two such characters, and two line
    ends there are two pieces.  Beside odd white space nothing is cut, nor inside
    any longer run.  A text starts a piece."""
    kind = _CLASS[raw]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True  # a text starts here
    blank = (kind == _SPACE) | (kind == _LINE)
    plain = ~blank & ~_ODD[raw]
    plain_after = np.append(plain[1:], False) & ~edge[1:]
    odd_before = np.concatenate([[False], ~plain[:-1]]) | edge[:-1]
    start = edge[:-1].copy()
    space = (kind == _SPACE) & plain_after  # begins the next word, whatever stands before
    start |= space
    line = kind == _LINE
    last = line & plain_after  # a line end before a word
    alone = last & ~odd_before
    twin = np.append(last[1:], False) & line & ~odd_before & ~edge[1:]
    second = np.concatenate([[False], twin[:-1]])
    own = alone | second
    start |= own | twin
    start[1:] |= own[:-1]  # the word after a line end
    # Punctuation that ends a word, after a letter or a digit.
    end_after = np.append(blank[1:], True) | edge[1:]
    mark = kind == _MARK
    run_start = mark & ~np.concatenate([[False], mark[:-1]])
    at = np.flatnonzero(run_start)
    if len(at):
        stops = np.flatnonzero(mark & (np.append(~mark[1:], True) | edge[1:]))
        to = stops[np.searchsorted(stops, at)]
        letter = np.zeros(len(at), bool)
        inner = at > 0
        letter[inner] = kind[at[inner] - 1] == _ALNUM
        two = at > 1
        latin = raw[at[two] - 1]
        letter[two] |= (raw[at[two] - 2] == 0xC3) & (latin >= 0x80) & (latin <= 0xBF) & (latin != 0x97) & (latin != 0xB7)
        start[at[letter & end_after[to]]] = True
    return np.flatnonzero(start)


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


#: Stands for a null doc_id in a block.
NO_ID = -(1 << 63)
BLOCKS = "part int, start_in_part long, n_ids long, doc_ids array<long>, block binary"


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of several batches together, STEP characters or a little more."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for pdf in batches:
        ids += pdf["doc_id"].tolist()
        own = [t or "" for t in pdf["text"]]
        texts += own
        size += sum(map(len, own))
        if size >= STEP:
            yield ids, texts
            ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _blocks(encode: Callable[[list[str]], list[np.ndarray]], end_id: int, block_ids: int):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        ids: list = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "start_in_part": [before], "n_ids": [held], "doc_ids": [np.array(ids, np.int64)], "block": [write_block(docs)]})

        for doc_ids, texts in _gathered(batches):
            for doc, own in zip(doc_ids, encode(texts)):
                ids.append(doc)
                docs.append(np.append(own, np.uint32(end_id)))
                held += len(own) + 1
                if held >= block_ids:
                    yield flush()
                    before, held, ids, docs = before + held, 0, [], []
        if docs:
            yield flush()
        common.trim()

    return build


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> None:
    """Encode every text and write token blocks in ascending doc_id order."""
    spark = docs.sparkSession
    common.ship(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    if partitions is None:
        partitions = texts.rdd.getNumPartitions()  # as many ranges as the input has splits
    ordered = texts.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(some: list[str]) -> list[np.ndarray]:
        return encoder(tokenizer)(some)

    ordered.mapInPandas(_blocks(encode, end_id, block_ids), BLOCKS).write.option("compression", "none").parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # One row a partition of the writer, so small enough to sum and broadcast.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_ids, at, block in zip(pdf["doc_ids"], pdf["start"], pdf["block"]):
                _, counts, words = open_block(block)
                raw = memoryview(unpack(words).astype("<u4")).cast("B")
                n = counts.astype(np.int64)
                ends = (4 * np.cumsum(n)).tolist()
                yield pd.DataFrame({
                    "doc_id": doc_ids,
                    "start": at + np.cumsum(n) - n, "n_tokens": n,
                    "ids_crc32": np.array([zlib.crc32(raw[a:b]) for a, b in zip([0, *ends], ends)], np.int64),
                })

    at = blocks.join(F.broadcast(parts), F.col("part") == F.col("of")).select("doc_ids", (F.col("part_start") + F.col("start_in_part")).alias("start"), "block")
    out = at.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
