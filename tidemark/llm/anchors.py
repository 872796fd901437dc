"""Content-defined anchors of byte strings, by winnowing with vectorised rolling hashes.

Every string of ``length`` bytes has one anchor: the ``gram``-byte string in it with the least hash (the rightmost of
equals).  The anchor and its place depend on those ``length`` bytes alone, so equal strings have equal anchors in
equal places wherever they occur.  Consecutive strings that share an anchor form a fragment.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    filled, step = 1, np.uint64(base)
    while filled < n:  # out[filled : 2 * filled] = out[:filled] * base ** filled
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * step
        filled *= 2
        step = step * step
    return out


class Rolling:
    """Hashes of any substring of a text, modulo 2 ** 64, through prefix sums."""

    def __init__(self, base: int, seed: int) -> None:
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(0, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            with np.errstate(over="ignore"):
                self.up, self.down = _powers(self.base, 2 * n + 1), _powers(self.inverse, 2 * n + 1)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=out[1:])
        return out

    def at(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefix[ends] - prefix[starts]) * self.down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


#: The hash of anchors.
GRAM = Rolling(0x9E3779B97F4A7C15, 11)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def anchors(data: np.ndarray, lengths: np.ndarray, length: int, gram: int, stretch: int = 1 << 24) -> dict[str, np.ndarray]:
    """Fragments of the texts that lie end to end in ``data``.

    For each, in order of place: ``text`` (its number), ``first`` and ``last`` start of its strings and ``anchor``
    (places in ``data``), and ``key``, the hash of the anchor.  ``stretch``: places compared at a time, at most 2 ** 24.
    """
    ends = np.cumsum(lengths)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return {"text": empty, "first": empty, "last": empty, "anchor": empty, "key": empty.astype(np.uint64)}
    prefix = GRAM.prefix(data)
    places = np.arange(len(data) - gram + 1)
    hashes = GRAM.at(prefix, places, places + gram)
    width = length - gram + 1
    chosen = np.empty(len(hashes) - width + 1, np.int64)
    # places count from the start of a stretch, which overlaps the next by one window
    for at in range(0, len(chosen), stretch - width + 1):
        own = hashes[at : at + stretch]
        # least hash first, then the rightmost; 2 ** 24 places and 40 bits of hash in one word
        packed = (own & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - np.arange(len(own), dtype=np.uint64))
        least = (np.uint64(0xFFFFFF) - (_sliding_least(packed, width) & np.uint64(0xFFFFFF))).astype(np.int64)
        chosen[at : at + len(least)] = least + at
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - length + 1, 0))
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.cumsum(np.maximum(lengths - length + 1, 0))
    place = np.arange(len(text)) - np.repeat(inside - np.maximum(lengths - length + 1, 0), np.maximum(lengths - length + 1, 0)) + starts[text]
    anchor = chosen[place]
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])) + 1
    heads, tails = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(text) - 1]])
    if not len(text):
        return {"text": empty, "first": empty, "last": empty, "anchor": empty, "key": empty.astype(np.uint64)}
    return {"text": text[heads], "first": place[heads], "last": place[tails], "anchor": anchor[heads], "key": hashes[anchor[heads]]}
