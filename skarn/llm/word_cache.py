"""A bounded cache of byte strings' ids, looked up many at a time.

Strings are told apart by two independent 64-bit hashes (a false match among a
million strings has a chance below one in 10^26 a look-up).  Hashes stand sorted
in two tables: a small one that takes new strings, and a large one it is merged
into; when that is full, it is forgotten and filled anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | _U(1)
_ODD = _rng.integers(1, 1 << 63, 3, dtype=np.uint64) | _U(1)
_power = np.ones(1, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    global _power
    while len(_power) < n:
        _power = np.concatenate([_power, _power * (_power[-1:] * _ODD[0])])
    return _power


def hashes(raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each string; strings start at `first` and fill `raw`."""
    size = np.diff(first, append=len(raw))
    power = _powers(int(size.max()))[np.arange(len(raw)) - np.repeat(first, size)]
    one, two = (_mix(np.add.reduceat(_BYTE[k][raw] * power, first) ^ (size.astype(np.uint64) * _ODD[1 + k])) for k in (0, 1))
    return one, two


@dataclass
class _Table:
    one: np.ndarray  # sorted
    two: np.ndarray
    size: np.ndarray  # number of ids
    ids: np.ndarray  # all ids, in the order of the strings

    def __post_init__(self):
        self.start = np.cumsum(self.size) - self.size


def _empty() -> _Table:
    return _Table(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))


def ragged(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at `start`, one after the other."""
    stop = np.cumsum(size)
    return ids[np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)]


def _merged(a: _Table, b: _Table) -> _Table:
    one = np.concatenate([a.one, b.one])
    order = np.argsort(one, kind="stable")
    start = np.concatenate([a.start, b.start + len(a.ids)])[order]
    size = np.concatenate([a.size, b.size])[order]
    return _Table(one[order], np.concatenate([a.two, b.two])[order], size, ragged(np.concatenate([a.ids, b.ids]), start, size))


class WordCache:
    def __init__(self, keep: int, recent: int = 1 << 15):
        self.keep, self.most = keep, recent
        self.main, self.recent = _empty(), _empty()

    def resolve(self, raw: np.ndarray, first: np.ndarray, make: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, joined, and how many each has.  `make` gives
        the ids (little-endian 32-bit) of strings met for the first time."""
        one, two = hashes(raw, first)
        uniq, at, back = np.unique(one, return_index=True, return_inverse=True)
        second = two[at]
        if len(at) < len(one) and not (two == second[back]).all():  # one hash is not enough here
            return self._plain(raw, first, make)
        ids = np.concatenate([self.main.ids, self.recent.ids])
        start, size = np.zeros(len(uniq), np.int64), np.full(len(uniq), -1, np.int64)
        for table, offset in ((self.main, 0), (self.recent, len(self.main.ids))):
            if len(table.one):
                k = np.minimum(np.searchsorted(table.one, uniq), len(table.one) - 1)
                hit = (table.one[k] == uniq) & (table.two[k] == second)
                start[hit], size[hit] = table.start[k[hit]] + offset, table.size[k[hit]]
        new = np.flatnonzero(size < 0)
        if len(new):
            ends = np.append(first[1:], len(raw))
            data = raw.tobytes()
            got = make([data[a:b] for a, b in zip(first[at[new]].tolist(), ends[at[new]].tolist())])
            fresh = np.frombuffer(b"".join(got), "<u4")
            size[new] = np.fromiter(map(len, got), np.int64, len(got)) >> 2
            start[new] = len(ids) + np.cumsum(size[new]) - size[new]
            ids = np.concatenate([ids, fresh])
            self._add(_Table(uniq[new], second[new], size[new], fresh))
        n = size[back]
        return ragged(ids, start[back], n), n

    def _plain(self, raw, first, make):
        data, ends = raw.tobytes(), np.append(first[1:], len(raw))
        got = make([data[a:b] for a, b in zip(first.tolist(), ends.tolist())])
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) >> 2

    def _add(self, new: _Table) -> None:
        # Of two strings with one first hash the newer is found, or neither.
        self.recent = _merged(self.recent, new)
        if len(self.recent.one) > self.most:
            full = len(self.main.one) + len(self.recent.one) > self.keep
            self.main = self.recent if full else _merged(self.main, self.recent)
            self.recent = _empty()
