"""A bounded memo of two generations for what Python workers compute per distinct word."""

from __future__ import annotations

from collections.abc import Callable

#: Longer keys aren't kept, so that a memo's bytes are bounded with its entries.
LONGEST = 64


class Memo(dict):
    """Maps a key to make(key). At most 2 * limit entries stay: those used since the last turn, and the turn before.

    Strings over `longest` characters are made anew each time; 0 keeps all keys, which then are of one size.
    """

    def __init__(self, make: Callable, limit: int = 250_000, longest: int = LONGEST):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
