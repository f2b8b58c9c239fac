"""A bounded dictionary that makes what it lacks."""

from __future__ import annotations


class Kept(dict):
    """What ``make`` gives for a string, kept for about the last ``size`` to ``2 * size`` strings of up to ``longest`` characters, in two generations."""

    def __init__(self, make, size: int = 250_000, longest: int = 48):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        self[key] = found = self.make(key) if found is None else found
        return found
