"""The pipeline's near-dedup against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import simhash


def words(text):
    found = (text or "").lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def kept(rows):
    """Smallest doc_id of each group of rows whose shingles are equal or similar by 0.8."""
    up = {d: d for d, _ in rows}

    def find(d):
        while up[d] != d:
            d = up[d]
        return d

    for i, (a, s) in enumerate(rows):
        for b, t in rows[:i]:
            x, y = words(s), words(t)
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {find(d) for d in up}


@pytest.mark.parametrize("most", [32, 3])
def test_without_near_copies(spark, most):
    """Texts of 120 words with up to six words changed: many similar pairs are far over 3 bits apart."""
    deal, rows = random.Random(5), []
    for base in range(8):
        text = [f"w{deal.randrange(900)}" for _ in range(120)]
        for _ in range(12):
            copy = list(text)
            for at in deal.sample(range(120), deal.randrange(7)):
                copy[at] = f"x{deal.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(901, None), (902, ""), (903, "one two"), (904, "One  two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    narrow = {r["component_id"] for r in simhash.near_duplicates(docs).select("component_id").collect()}
    assert len(want) < len(narrow)
    assert {r["doc_id"] for r in simhash.without_near_copies(docs, most=most).collect()} == want


def test_stage(spark):
    """The stage drops near copies that are over 3 bits apart in the fingerprint of op9."""
    import corpus_pipeline

    text = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:40] + ["x"] + text[41:80] + ["y"] + text[81:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).bit_count() > 3
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_rows_that_share_an_id(spark):
    """Another text under the doc_id of a dropped copy stays; equal rows are one."""
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = spark.createDataFrame([(1, one), (5, one), (5, other), (5, other), (7, None), (7, other + " tail"), (None, one)], "doc_id long, text string")
    for kept in (simhash.one_of_each_group(docs), simhash.without_near_copies(docs)):
        assert sorted(((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect()), key=repr)[:2] == [(1, one), (5, other)]
        assert kept.where("doc_id is null").count() == 1
    assert sorted(simhash.without_near_copies(docs).select("doc_id", "text").where("doc_id = 7").collect()) == [(7, None)]


def test_ring_keeps_all_within_the_budget():
    """Chains prune nothing that the full check would keep, and the fingerprint of similar sets is near."""
    deal = np.random.default_rng(3)
    one = deal.integers(0, 1 << 63, (400, 8), dtype=np.uint64)
    two = one.copy()
    for row in two:
        for bit in deal.choice(512, deal.integers(0, 260), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    differ = np.bitwise_count(one ^ two).sum(axis=1)
    assert (simhash.ring_ok(one, two) == (differ <= simhash.BUDGET)).all() and 0 < (differ <= simhash.BUDGET).sum() < 400
    for size in (20, 200, 2000):
        hashes = deal.integers(0, 1 << 63, size * 10 // 8, dtype=np.uint64)
        sides = [np.frombuffer(simhash.wide_fingerprint(h), "<u8").reshape(1, -1) for h in (hashes[:size], hashes)]  # similarity 0.8
        assert simhash.ring_ok(*sides).all()
