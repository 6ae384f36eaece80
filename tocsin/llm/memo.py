"""A bounded memory of results inside one Python worker."""

from __future__ import annotations

from collections.abc import Callable


class Memo:
    """Remembers results of a function of a hashable key.

    Two generations of at most ``limit`` entries each: what is asked for again
    moves to the young one, the rest goes when the generations change.
    """

    def __init__(self, function: Callable, limit: int):
        self.function, self.limit = function, limit
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.function(key)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found

    def all(self, keys: list) -> list:
        """Results of many keys; those known are fetched without a call each."""
        known = list(map(self.young.get, keys))
        if None in known:
            known = [self(k) if v is None else v for k, v in zip(keys, known)]
        return known
