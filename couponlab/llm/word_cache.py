"""A bounded memory of what was computed for a word."""

from __future__ import annotations


class TwoGenerations(dict):
    """Remembers ``make(key)``.  When the young half is full it becomes the old one, and the old one goes.

    The bound is on entries; keys longer than ``longest`` are never kept, so it bounds bytes too.
    """

    def __init__(self, make, size: int, longest: int = 64):
        super().__init__()
        self._make, self._half, self._longest, self._old = make, max(1, size // 2), longest, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= self._longest:
            if len(self) >= self._half:
                self._old = self.copy()
                self.clear()
            self[key] = value
        return value
