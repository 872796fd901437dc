"""Anchors of texts longer than the places that one word counts."""

from __future__ import annotations

import numpy as np

from tidemark.llm import anchors as an


def found(data, lengths, **options):
    with np.errstate(over="ignore"):
        return an.anchors(data, np.array(lengths), 100, 48, **options)


def test_stretches_change_nothing():
    data = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    data[3000:3600] = 97  # ties
    whole = found(data, [1200, 90, 3710])
    for stretch in (53, 54, 100, 777, 4953):
        parts = found(data, [1200, 90, 3710], stretch=stretch)
        assert all(np.array_equal(whole[c], parts[c]) for c in whole)


def test_places_beyond_24_bits():
    """A passage has the same anchors before and after place 2 ** 24, all within their strings."""
    deal = np.random.default_rng(2)
    data = deal.integers(97, 123, (1 << 24) + 50_000).astype(np.uint8)
    late = (1 << 24) + 20_000
    data[late : late + 1000] = data[5000:6000]
    got = found(data, [len(data)])
    assert (got["anchor"] >= got["last"]).all() and (got["anchor"] <= got["first"] + 52).all()

    def inside(start):
        # all strings that hold these anchors lie in the passage
        own = (got["anchor"] >= start + 100) & (got["anchor"] <= start + 850)
        return [tuple(x) for x in np.stack([got["anchor"][own] - start, got["key"][own].view(np.int64)], 1).tolist()]

    assert len(inside(5000)) > 10 and inside(5000) == inside(late)
