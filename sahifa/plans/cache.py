"""Finished results kept for a while on the driver, by an unguessable key."""

from __future__ import annotations

import secrets
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any


class ResultCache:
    """At most ``size`` results, each for ``ttl`` seconds; the oldest goes first, and reading renews nothing."""

    def __init__(self, size: int = 64, ttl: float = 600.0, clock: Callable[[], float] = time.time) -> None:
        self._size, self._ttl, self._clock = size, ttl, clock
        self._kept: OrderedDict[str, tuple[float, Any]] = OrderedDict()

    def put(self, result: Any) -> str:
        now = self._clock()
        self._kept = OrderedDict((k, v) for k, v in self._kept.items() if v[0] >= now)
        while len(self._kept) >= self._size:
            self._kept.popitem(last=False)
        key = secrets.token_urlsafe(24)
        self._kept[key] = (now + self._ttl, result)
        return key

    def get(self, key: str) -> Any:
        """The result, or ``KeyError`` once it has expired or gone."""
        until, result = self._kept[key]
        if until < self._clock():
            del self._kept[key]
            raise KeyError(key)
        return result
