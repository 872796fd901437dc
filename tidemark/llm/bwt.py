"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of many strings.

All strings grow by one symbol to the left a round: round j inserts the suffix of length j of every string that has
one.  The transform and the common-prefix values of what has been inserted lie in two files, one byte a suffix each;
a round reads both from front to back and writes their successors.  The place of a new suffix cS follows from the
place of S by counting c before it (the LF step), and its common prefix with a neighbour is one more than the least
common prefix between S and the neighbouring suffix that c also precedes.

Strings are arrays of bytes other than ``END``; suffixes of equal content are told apart by their string's number.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Never a byte of valid UTF-8: marks in the transform that a string has no further symbol.
END = 0xFE


class Collection:
    """The transform of ``count`` strings, the i-th being data[starts[i]:ends[i]], built in ``folder``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folder: str) -> None:
        self.data, self.starts, self.ends, self.count = data, starts, ends, len(starts)
        self.files = [os.path.join(folder, name) for name in ("bwt", "lcp")]
        first = np.full(self.count, END, np.uint8)
        first[ends > starts] = data[ends[ends > starts] - 1]
        first.tofile(self.files[0])
        np.zeros(self.count, np.uint8).tofile(self.files[1])
        self.place = np.arange(self.count)
        self.active = np.flatnonzero(ends > starts)
        self.length = 0
        while len(self.active):
            self._round()

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        return np.fromfile(self.files[0], np.uint8), np.fromfile(self.files[1], np.uint8)

    def _round(self) -> None:
        bwt, lcp = self.read()
        self.length += 1
        # suffixes by the symbol before them, each symbol's in their own order; END sorts last and is not counted
        order = np.argsort(bwt, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        who = self.active[np.argsort(self.place[self.active], kind="stable")]
        place = self.place[who]
        symbol = bwt[place]
        skipped = np.where(symbol > END, bounds[END + 1] - bounds[END], 0)
        new = self.count + rank[place] - skipped
        has_prev, has_next = rank[place] > bounds[symbol], rank[place] + 1 < bounds[symbol.astype(np.int64) + 1]
        prev = order[np.maximum(rank[place] - 1, 0)]
        follow = order[np.minimum(rank[place] + 1, len(bwt) - 1)]
        least_before = np.where(has_prev, _range_least(lcp, np.where(has_prev, prev + 1, place), place) + 1, 0)
        least_after = np.where(has_next, _range_least(lcp, np.where(has_next, place + 1, place), np.where(has_next, follow, place)) + 1, 0)
        added = np.zeros(len(bwt) + len(who), bool)
        added[new] = True
        at = self.ends[who] - self.length - 1
        symbols = np.where(at >= self.starts[who], self.data[np.maximum(at, 0)], END).astype(np.uint8)
        by_place = np.argsort(new, kind="stable")
        next_bwt, next_lcp = np.empty(len(added), np.uint8), np.empty(len(added), np.uint8)
        next_bwt[added], next_bwt[~added] = symbols[by_place], bwt
        next_lcp[~added] = lcp
        next_lcp[added] = 0
        next_lcp[new] = np.minimum(least_before, 255)
        next_lcp[new[has_next] + 1] = np.minimum(least_after[has_next], 255)
        next_bwt.tofile(self.files[0])
        next_lcp.tofile(self.files[1])
        self.place[who] = new
        self.active = who[at >= self.starts[who]]

    def suffix_places(self, rounds: int) -> np.ndarray:
        """Final places of the suffixes, one row for each length from 1 (-1 where the string is shorter)."""
        bwt, _ = self.read()
        order = np.argsort(bwt, kind="stable")
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        bounds = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=256))])
        ended = bounds[END + 1] - bounds[END]
        out = np.full((rounds, self.count), -1, np.int64)
        who, at = np.arange(self.count), np.arange(self.count)
        for length in range(rounds):
            alive = bwt[at] != END
            who, at = who[alive], at[alive]
            at = self.count + rank[at] - np.where(bwt[at] > END, ended, 0)
            out[length, who] = at
        return out


def _range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of values[first..last], both included."""
    padded = np.append(values, np.uint8(255))
    bounds = np.empty(2 * len(first), np.int64)
    bounds[::2], bounds[1::2] = first, last + 1
    return np.minimum.reduceat(padded, bounds)[::2].astype(np.int64) if len(first) else np.zeros(0, np.int64)


def repeated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """A group number for each suffix of at least ``least`` symbols; equal numbers share their first ``least`` symbols.

    The result has a row for each start in the longest string and a column for each string; -1 where the suffix is too
    short.
    """
    longest = int((ends - starts).max(initial=0))
    with tempfile.TemporaryDirectory() as folder:
        built = Collection(data, starts, ends, folder)
        _, lcp = built.read()
        group = np.cumsum(lcp < least)
        places = built.suffix_places(longest)
    out = np.full((max(longest - least + 1, 0), len(starts)), -1, np.int64)
    lengths = ends - starts
    for start in range(len(out)):
        left = lengths - start
        fits = np.flatnonzero(left >= least)
        out[start, fits] = group[places[left[fits] - 1, fits]]
    return out
