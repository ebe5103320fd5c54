"""A bidirectional FM-index over word ids, for patterns of at most DEPTH words.

The text is an array of ids, 0 where a piece ends; it begins and ends with 0. Suffixes are sorted
by their first DEPTH ids only, which is all that shorter patterns need. The index is two
Burrows-Wheeler transforms, of the text and of its reverse. A set of patterns is three arrays:
where its intervals begin in either index, and their sizes. Extending all patterns of a set by
every id that stands before (or behind) them is one pass over their intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 4


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes, sorted by their first DEPTH ids; 0 stands beyond the end."""
    rank, step = text.astype(np.int64), 1
    while step < DEPTH:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        change = np.empty(len(key), bool)
        change[:1], change[1:] = False, key[order[1:]] != key[order[:-1]]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(change)
        step *= 2
    return order


def transform(text: np.ndarray) -> np.ndarray:
    """The id before each suffix, in suffix order."""
    return text[suffix_order(text) - 1]


@dataclass
class Patterns:
    """Intervals in the forward and in the backward index."""

    ahead: np.ndarray
    back: np.ndarray
    size: np.ndarray

    def __getitem__(self, chosen: np.ndarray) -> Patterns:
        return Patterns(self.ahead[chosen], self.back[chosen], self.size[chosen])


class Index:
    def __init__(self, forward: np.ndarray, backward: np.ndarray) -> None:
        self.bwt = (forward, backward)
        self.lead = tuple(self._lead(b) for b in self.bwt)
        counts = np.bincount(forward)
        begins = np.cumsum(counts) - counts
        self.ids = np.flatnonzero(counts[1:]) + 1
        self.single = Patterns(begins[self.ids], begins[self.ids], counts[self.ids])

    @classmethod
    def of(cls, text: np.ndarray) -> Index:
        return cls(transform(text), transform(text[::-1]))

    @staticmethod
    def _lead(bwt: np.ndarray) -> np.ndarray:
        """Where a place of the transform stands among the suffixes that begin with its id."""
        out = np.empty(len(bwt), np.int64)
        out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        return out

    def _extend(self, side: int, here: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        bwt, total = self.bwt[side], int(size.sum())
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(size)), size)
        places = np.arange(total) + np.repeat(here - (ends - size), size)
        key = owner * (int(bwt.max(initial=0)) + 1) + bwt[places]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.empty(0, np.int64)
        first = places[order[starts]]
        parent, word = owner[order[starts]], bwt[first]
        smaller = starts - (ends - size)[parent]
        made = word > 0
        sizes = np.diff(np.append(starts, total))
        return parent[made], word[made], self.lead[side][first[made]], (other[parent] + smaller)[made], sizes[made]

    def left(self, p: Patterns) -> tuple[np.ndarray, np.ndarray, Patterns]:
        """(which pattern, the word put before it, the longer patterns)."""
        parent, word, ahead, back, size = self._extend(0, p.ahead, p.back, p.size)
        return parent, word, Patterns(ahead, back, size)

    def right(self, p: Patterns) -> tuple[np.ndarray, np.ndarray, Patterns]:
        """(which pattern, the word put behind it, the longer patterns)."""
        parent, word, back, ahead, size = self._extend(1, p.back, p.ahead, p.size)
        return parent, word, Patterns(ahead, back, size)
