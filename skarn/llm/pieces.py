"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The vocabulary and merge order come from a SentencePiece BPE model file.  A text
is cut into units (a run of spaces and the word after it); no piece of the model
crosses a unit.  In a unit, the adjacent pair whose merged piece has the best
score is merged first, the leftmost of equal ones, until no pair is left.  With
dropout, a candidate merge is skipped when the keyed hash of (seed, doc_id,
offset of the unit in the text, start, middle, end) falls below the dropout
rate: every occurrence of a word is drawn anew, and repeatably.

Units are encoded many at a time: symbols stand in a matrix, a hashed table
gives the rank of every adjacent pair, and each round merges the best pair of
every row at once.  Long units use a heap agenda instead.

Decoding joins the bytes of pieces: byte pieces give bytes, the mark U+2581 a
space, and the space put before the text is taken off.  A literal U+2581 in a
text is written as byte pieces, so that every text comes back unchanged.

Defined cases: a null text is encoded as empty; an empty text has no pieces; a
null doc_id is drawn as an id of its own; rows with the same id and text are
encoded alike.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A document and a place in it have one of VARIANTS hashes.
DROPOUT, SEED, VARIANTS = 0.1, 20240229, 1 << 64
MARK = "▁"
UNIT = re.compile(r" *[^ ]+| +\Z")
#: Units of more symbols are encoded one by one.
LONG = 48
#: Texts encoded together, and units merged together.
STEP, ROWS = 500, 4096
NONE = np.int64(1) << np.int64(40)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Model:
    """Pieces, scores and the table of mergeable pairs of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        self.byte_ids = np.zeros(256, np.int64)
        special = np.zeros(n, bool)
        self.bytes: list[bytes] = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
                special[i] = True
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
                special[i] = True
            else:
                self.bytes.append(p.replace(MARK, " ").encode())
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces that cross words are not supported")
        # Symbols: single characters of the model; others are size + code point.
        self.chars = np.arange(0x110000, dtype=np.int64) + n
        for p, i in normal.items():
            if len(p) == 1 and p != MARK:
                self.chars[ord(p)] = i
        self.chars[ord(" ")] = normal[MARK]
        score = np.array([sp.get_score(i) for i in range(n)])
        order = np.unique(-score, return_inverse=True)[1]
        left, right, made = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        keys = np.array(left, np.int64) * n + np.array(right, np.int64)
        # rank (best first) and made piece in one number
        values = order[made].astype(np.int64) * n + np.array(made, np.int64)
        self.bits = max(16, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        self.pairs = dict(zip(keys.tolist(), values.tolist()))
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):  # open addressing, all keys at once
            at = (slot[todo] + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[at] == -1
            take = np.unique(at[free], return_index=True)[1]
            chosen = np.flatnonzero(free)[take]
            self.keys[at[chosen]], self.values[at[chosen]] = keys[todo[chosen]], values[todo[chosen]]
            todo = np.delete(todo, chosen)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _M1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank * size + piece of each pair, or NONE."""
        ok = (left < self.size) & (right < self.size) & (left >= 0) & (right >= 0)
        keys = np.where(ok, left.astype(np.int64) * self.size + right, -2)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1) & ok)
        for k in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + k) & ((1 << self.bits) - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (found != -1)]
        return out


def _places(docs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The variant of each place: a hash of its document's hash and offset."""
    x = (docs ^ (offsets.astype(np.uint64) * _M2)) * _M1
    x ^= x >> np.uint64(31)
    x *= _M2
    return x ^ (x >> np.uint64(29))


def _unit_key(unit: str, variant: int, seed: int) -> int:
    """The key of a unit's draws at a place; the place tells units apart."""
    return (variant ^ (seed * 1_000_003)) & (2**64 - 1)


def _span_hash(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Keyed hash of a candidate merge: the spans are characters of the unit."""
    span = (start.astype(np.uint64) << np.uint64(42)) | (middle.astype(np.uint64) << np.uint64(21)) | end.astype(np.uint64)
    x = (key ^ (span * _M1)) * _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    return x ^ (x >> np.uint64(32))


def _span_draw(key: int, start: int, middle: int, end: int) -> int:
    """_span_hash of one candidate, in plain integers."""
    full = (1 << 64) - 1
    x = (key ^ (((start << 42) | (middle << 21) | end) & full) * int(_M1) & full) * int(_M2) & full
    x = (x ^ (x >> 29)) * int(_M1) & full
    return x ^ (x >> 32)


class Encoder:
    """Encodes every occurrence of a unit by its own draws."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS):
        self.model, self.seed, self.variants = Model(path), seed, variants
        self.limit = np.uint64(min(2**64 - 1, int(dropout * 2.0**64)))

    def variant(self, doc_id: int | None) -> int:
        return xxhash.xxh3_64_intdigest(repr(doc_id).encode(), seed=self.seed) % self.variants

    def _finish(self, symbols: list[int]) -> bytes:
        n = self.model.size
        if any(s >= n for s in symbols):
            flat: list[int] = []
            for s in symbols:
                flat.extend(self.model.byte_ids[list(chr(s - n).encode("utf-8", "surrogatepass"))].tolist() if s >= n else [s])
            symbols = flat
        return np.array(symbols, "<i4").tobytes()

    def agenda(self, unit: str, key: int) -> bytes:
        """One unit by a heap of candidate merges."""
        m = self.model
        cps = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sym = m.chars[cps].tolist()
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        end = list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []
        limit, size, pairs = int(self.limit), m.size, m.pairs

        def offer(i: int) -> None:
            j = nxt[i]
            if j < 0 or sym[i] >= size or sym[j] >= size:
                return
            value = pairs.get(sym[i] * size + sym[j])
            if value is not None and _span_draw(key, i, j, end[j]) >= limit:
                rank, made = divmod(value, size)
                heapq.heappush(heap, (rank, i, j, end[j], made))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, e, made = heapq.heappop(heap)
            if nxt[i] != j or end[j] != e or sym[i] < 0 or sym[j] < 0 or end[i] != j:
                continue
            if m.pairs.get(sym[i] * m.size + sym[j], -1) % m.size != made:
                continue
            sym[i], end[i], nxt[i] = made, e, nxt[j]
            sym[j] = -1
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            if prev[i] >= 0:
                offer(prev[i])
            offer(i)
        return self._finish([s for s in sym if s >= 0])

    def _matrix(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """Units of similar length, merged round by round."""
        m = self.model
        n, lengths = len(units), np.array([len(u) for u in units])
        width = int(lengths.max())
        cps = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        fill = np.arange(width) < lengths[:, None]
        sym = np.full((n, width), -1, np.int32)
        sym[fill] = m.chars[cps]
        start = np.minimum(np.arange(width + 1, dtype=np.int16), lengths[:, None].astype(np.int16))  # also the end of the last
        key = keys
        out: list[bytes] = [b""] * n
        rows = np.arange(n)

        def ranks(left, right, k, a, b, c):
            value = m.lookup(left, right)
            live = np.flatnonzero(value < NONE)
            gone = _span_hash(k[live], a[live], b[live], c[live]) < self.limit
            value[live[gone]] = NONE
            return value

        if width == 1:
            value = np.full((n, 1), NONE)
        else:
            shape = (n, width - 1)
            value = ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel(), np.repeat(key, width - 1), start[:, : width - 1].ravel(), start[:, 1:width].ravel(), start[:, 2:].ravel()).reshape(shape)
        count = lengths.copy()
        while len(rows):
            at = value.argmin(1)
            best = value[np.arange(len(rows)), at]
            done = best >= NONE
            if done.any():
                own, n_own = np.flatnonzero(done), count[done]
                flat = sym[own][np.arange(sym.shape[1]) < n_own[:, None]]
                raw, ends = flat.astype("<i4").tobytes(), (4 * np.cumsum(n_own)).tolist()
                for k, a, b in zip(rows[own].tolist(), [0, *ends], ends):
                    out[k] = raw[a:b]
                if (flat >= m.size).any():
                    for k in own[(sym[own] >= m.size).any(1)].tolist():
                        out[rows[k]] = self._finish(sym[k, : count[k]].tolist())
                live = ~done
                rows, sym, start, value, key, count, at, best = rows[live], sym[live], start[live], value[live], key[live], count[live], at[live], best[live]
                if not len(rows):
                    break
            r = np.arange(len(rows))
            # Close the gap of the right symbol of each merged pair.
            w = sym.shape[1]
            gap = at + 1
            keep = np.ones(len(r) * (w + 1), bool)
            keep[r * (w + 1) + gap] = False
            start = start.ravel()[keep].reshape(-1, w)
            keep = np.ones(len(r) * w, bool)
            keep[r * w + gap] = False
            sym = sym.ravel()[keep].reshape(-1, w - 1)
            sym[r, at] = best % m.size
            count -= 1
            if w == 2:
                value = np.full((len(rows), 1), NONE)
                sym = np.concatenate([sym, np.full((len(rows), 1), -1, np.int32)], 1)
                start = np.concatenate([start, start[:, -1:]], 1)
                continue
            keep = np.ones(len(r) * (w - 1), bool)
            keep[r * (w - 1) + np.minimum(gap, w - 2)] = False
            value = value.ravel()[keep].reshape(-1, w - 2)
            for shift in (-1, 0):
                i = at + shift
                own = np.flatnonzero((i >= 0) & (i + 1 < count))
                i = i[own]
                value[own, i] = ranks(sym[own, i], sym[own, i + 1], key[own], start[own, i], start[own, i + 1], start[own, i + 2])
            edge = np.flatnonzero(at + 1 >= count)
            inside = edge[at[edge] < w - 2]
            value[inside, at[inside]] = NONE
        return out

    def units(self, units: list[str], variant: int | np.ndarray) -> list[bytes]:
        """Each unit by its own draws; variant is that of its place."""
        keys = np.broadcast_to(np.asarray(variant, np.uint64) ^ np.uint64(_unit_key("", 0, self.seed)), len(units))
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        n_short = int((lengths <= LONG).sum())
        out: list[bytes] = [b""] * len(units)
        for k in range(0, n_short, ROWS):
            some = order[k : min(k + ROWS, n_short)]
            own = some.tolist()
            for i, coded in zip(own, self._matrix([units[i] for i in own], keys[some])):
                out[i] = coded
        for i in order[n_short:].tolist():
            out[i] = self.agenda(units[i], int(keys[i]))
        return out

    def __call__(self, texts: list[str], doc_ids: list) -> list[np.ndarray]:
        """The ids of each text."""
        units: list[str] = []
        sizes = []
        for text in texts:
            before = len(units)
            if text:
                units += UNIT.findall(" " + text)
            sizes.append(len(units) - before)
        ends = np.cumsum(sizes, dtype=np.int64)
        begins = ends - np.array(sizes, np.int64)
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))])
        offsets = total[:-1] - np.repeat(total[begins], sizes)
        docs = np.repeat(np.array([self.variant(d) for d in doc_ids], np.uint64), sizes)
        coded = self.units(units, _places(docs, offsets))
        return [np.frombuffer(b"".join(coded[a:b]), "<i4") for a, b in zip(begins.tolist(), ends.tolist())]


_models: dict[str, Model] = {}
_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, dropout: float, seed: int, variants: int) -> Encoder:
    """One encoder for each worker process and setting."""
    key = (path, dropout, seed, variants)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def decode(ids: np.ndarray, pieces: list[bytes]) -> str:
    raw = b"".join(map(pieces.__getitem__, ids.tolist()))
    return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


def with_pieces(docs: DataFrame, model: str, out: str = "piece_ids", dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """docs with array<int> column `out`: the ids of each text's pieces."""
    common.ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        enc = encoder(model, dropout, seed, variants)
        for texts, ids in batches:
            some, own = [t or "" for t in texts], ids.astype("Int64").fillna(-(1 << 63)).tolist()
            got: list[np.ndarray] = []
            for k in range(0, len(some), STEP):
                got.extend(enc(some[k : k + STEP], own[k : k + STEP]))
            yield pd.Series(got, dtype=object)

    return docs.withColumn(out, encode(F.col("text"), F.col("doc_id").cast("long")))


def with_decoded(df: DataFrame, model: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """df with struct column `out`: text, crc32 of the ids (little-endian
    32-bit) and sha256 of the text."""
    common.ship(df.sparkSession)

    @F.pandas_udf("text string, ids_crc32 long, sha256 string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if model not in _models:
            _models[model] = Model(model)
        pieces = _models[model].bytes
        for some in batches:
            texts = [decode(np.asarray(x, np.int64), pieces) for x in some]
            yield pd.DataFrame({
                "text": texts, "ids_crc32": [zlib.crc32(np.asarray(x, "<i4").tobytes()) for x in some],
                "sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
            })

    return df.withColumn(out, back(F.col(ids)))


def with_checked_pieces(docs: DataFrame, model: str, out: str = "pieces", dropout: float = DROPOUT, seed: int = SEED, variants: int = VARIANTS) -> DataFrame:
    """docs with struct column `out`: the ids of each text, their crc32, and
    what the ids decode to (its sha256, and whether it is the text).  One Python
    worker a task does both ways."""
    common.ship(docs.sparkSession)

    @F.pandas_udf("ids array<int>, ids_crc32 long, decoded_sha256 string, lossless boolean")
    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        enc = encoder(model, dropout, seed, variants)
        names = enc.model.bytes
        for texts, ids in batches:
            some, own = [t or "" for t in texts], ids.astype("Int64").fillna(-(1 << 63)).tolist()
            got: list[np.ndarray] = []
            for k in range(0, len(some), STEP):
                got.extend(enc(some[k : k + STEP], own[k : k + STEP]))
            back = [decode(x, names) for x in got]
            yield pd.DataFrame({
                "ids": pd.Series(got, dtype=object), "ids_crc32": [zlib.crc32(x.astype("<i4").tobytes()) for x in got],
                "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
                "lossless": [a == b for a, b in zip(some, back)],
            })

    return docs.withColumn(out, both(F.col("text"), F.col("doc_id").cast("long")))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256, lossless of each row."""
    coded = with_checked_pieces(docs.select("doc_id", "text"), model)
    return coded.select("doc_id", F.size("pieces.ids").cast("long").alias("n_pieces"), "pieces.ids_crc32", "pieces.decoded_sha256", "pieces.lossless")
