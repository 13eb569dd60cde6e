"""A bounded cache of prepared statements, least recently used out first."""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass


@dataclass
class CacheStats:
    hits: int = 0
    misses: int = 0
    evictions: int = 0

    @property
    def hit_rate(self) -> float:
        seen = self.hits + self.misses
        return self.hits / seen if seen else 0.0


class LruCache:
    def __init__(self, capacity: int = 100):
        self.capacity, self.stats = capacity, CacheStats()
        self._items: OrderedDict = OrderedDict()

    def get(self, key, make):
        """The cached value of key, made and kept if missing."""
        if key in self._items:
            self.stats.hits += 1
            self._items.move_to_end(key)
            return self._items[key]
        self.stats.misses += 1
        value = self._items[key] = make()
        if len(self._items) > self.capacity:
            self._items.popitem(last=False)
            self.stats.evictions += 1
        return value

    def clear(self) -> None:
        self._items.clear()

    def __len__(self) -> int:
        return len(self._items)
