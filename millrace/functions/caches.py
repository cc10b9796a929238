"""Caches of the driver with a literal clock: values that expire, a bounded number of values, and a gate that opens once in
a while. They hold metadata of a session, never rows."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class TtlCache:
    """Values kept for so many milliseconds; a failed load keeps nothing."""

    def __init__(self, ttl: int, now: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.ttl, self.now = ttl, now
        self._kept: dict[Hashable, tuple[int, Any]] = {}

    def get(self, key: Hashable, load: Callable[[], Any]) -> Any:
        now, have = self.now(), self._kept.get(key)
        if have is None or now - have[0] >= self.ttl:
            self._kept = {k: x for k, x in self._kept.items() if now - x[0] < self.ttl}
            self._kept[key] = have = (now, load())
        return have[1]

    def drop(self, key: Hashable) -> None:
        self._kept.pop(key, None)

    def __len__(self) -> int:
        return len(self._kept)


class LruCache:
    """At most so many values; the one used longest ago goes first."""

    def __init__(self, size: int):
        self.size = size
        self._kept: OrderedDict[Hashable, Any] = OrderedDict()

    def get(self, key: Hashable, default: Any = None) -> Any:
        if key in self._kept:
            self._kept.move_to_end(key)
        return self._kept.get(key, default)

    def put(self, key: Hashable, value: Any) -> None:
        self._kept[key] = value
        self._kept.move_to_end(key)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)

    def __len__(self) -> int:
        return len(self._kept)


class PeriodicGate:
    """Open the first time, and then once in every period."""

    def __init__(self, period: int, now: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.period, self.now, self._last = period, now, None

    def open(self) -> bool:
        now = self.now()
        if self._last is not None and now - self._last < self.period:
            return False
        self._last = now
        return True
