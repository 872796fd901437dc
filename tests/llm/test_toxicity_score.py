"""Scores against a plain restatement, and labels that contradict each other."""

from __future__ import annotations

import math
import random

import zstandard
from test_documents import SCHEMA, awkward, with_clashes

from tidemark.llm import toxicity


def corpus():
    pick = random.Random(3)
    plain, bad = [f"word{i}" for i in range(200)], ["grumbold", "snarkelwitz"]
    return [(i, " ".join(pick.choice(plain) for _ in range(40)) + (f" {pick.choice(bad)}" * 3 if i % 3 == 0 else ""), None, None, None) for i in range(300)]


def plain_score(model, text):
    """Each window compressed with either dictionary by itself; the sum of the table's ratios through the logistic curve."""

    def length(dictionary, raw):
        shape = zstandard.ZstdCompressionParameters.from_level(model.level, source_size=80, dict_size=len(dictionary), write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=shape).compress(raw))

    found = [length(model.ordinary, raw) - length(model.toxic, raw) for raw in (toxicity.coded(w + b" ") for w in toxicity.windows((text or "").encode()))]
    total = sum(model.table[min(max(d, toxicity.LOW), toxicity.HIGH) - toxicity.LOW] for d in found)
    n = len(found)
    value = sum(w * x for w, x in zip(model.weights, (total, total / math.sqrt(n + 1), math.log(n + 1), 1.0)))
    return 1 / (1 + math.exp(-min(max(value, -500), 500)))


def test_scores(spark):
    rows = corpus()
    docs = with_clashes(spark.createDataFrame(rows + awkward(), SCHEMA))
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i, *_ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs, model).where("doc_id is not null").collect())
    want = sorted((d, plain_score(model, t)) for d, t, *_ in rows + awkward() if d is not None)
    assert [d for d, _ in found] == [d for d, _ in want]
    assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(found, want))


def test_contradicting_labels(spark):
    """An id that bears both labels is not learnt from: flipping all others to it leaves nothing of one kind."""
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    twice = [(i, None, kind) for i, *_ in rows if i % 3 == 0 for kind in (0, 1)] + [(i, None, 0) for i, *_ in rows if i % 3]
    assert toxicity.fit(docs, spark.createDataFrame(twice, "doc_id long, quality int, toxic int")) is None
