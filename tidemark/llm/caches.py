"""A dictionary that computes what it lacks and stops growing at a bound."""

from __future__ import annotations


class Bounded(dict):
    """Values of a pure function of the key; the first `limit` keys are kept, later ones are computed anew."""

    def __init__(self, compute, limit: int = 120_000):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.limit:
            self[key] = value
        return value
