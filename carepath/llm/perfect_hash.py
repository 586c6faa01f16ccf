"""A minimal perfect hash over 128-bit digests, as flat numpy arrays.

Keys are placed level by level (Limasset et al., 2017): each level has twice as many
places as keys are left; a key alone at its place stays, the others go on.
A key's slot is the number of taken places before its own, so n keys have the slots 0 to
n - 1. Slots are verified against the stored keys: a lookup of any other
key fails instead of giving the slot of another.
"""

from __future__ import annotations

import numpy as np

from carepath.llm.textnum import mix

_U = np.uint64
_MAX_LEVELS = 100


def _place(a: np.ndarray, b: np.ndarray, level: int, places: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = mix(np.array([level + 1], _U) * _U(0x9E3779B97F4A7C15))
        return (mix(a ^ seed) + mix(b + seed)) % _U(places)


class PerfectHash:
    """Slots of the distinct keys (a, b), two arrays of uint64."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, used = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == _MAX_LEVELS:
                raise ValueError("keys of a perfect hash must be distinct")
            places = 2 * len(left)
            at = _place(a[left], b[left], len(self.levels), places)
            taken = np.bincount(at.astype(np.int64), minlength=places) == 1
            self.levels.append((taken, used + np.cumsum(taken) - 1))
            left, used = left[~taken[at]], used + int(taken.sum())
        self.a, self.b = np.zeros(len(a), _U), np.zeros(len(b), _U)
        slot = self._find(a, b)
        self.a[slot], self.b[slot] = a, b
        self.slots(a, b)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = np.full(len(a), -1, np.int64)
        open_ = np.arange(len(a))
        for level, (taken, rank) in enumerate(self.levels):
            at = _place(a[open_], b[open_], level, len(taken))
            hit = taken[at]
            slot[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return slot

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key; fails if one is not in the table."""
        slot = self._find(a, b)
        if len(slot) and (slot.min() < 0 or np.any(self.a[slot] != a) or np.any(self.b[slot] != b)):
            raise KeyError("a digest is not in the node table, or shares another's slot")
        return slot
