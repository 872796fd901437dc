"""The pipeline, stage by stage and as a whole, against plain restatements; near copies by the similarity of five-word shingles."""

from __future__ import annotations

import zlib

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import test_near_copies
from test_documents import SCHEMA, benchmark_rows
from test_pipeline import corpus
from test_special_tokens import plain

from tidemark.llm import quality

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def cut(before):
    """The texts after the removal of repeated bytes; what is left of a cut character goes too."""
    seen, out = set(), {}
    for doc, text in sorted(before.items()):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            else:
                seen.add(raw[i : i + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        out[doc] = text if not any(gone) else kept
    return out


def test_stages(spark, tmp_path):
    rows = corpus()
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=NAMES)
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in benchmark_rows()], pa.int64()), "text": pa.array([t for _, t in benchmark_rows()], pa.string())}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    book = quality.ledger(spark.createDataFrame(rows, SCHEMA))
    good = {r["doc_id"] for r in book.where(~quality.fails_policy("v1")).collect()}
    want = {d: t for d, t, *_ in rows if d in good}
    steps = {
        "quality_rules": lambda now: now,
        "near_dedup": lambda now: {d: now[d] for d in test_near_copies.kept(sorted(now.items()))},
        "substring_dedup": cut,
        "decontamination": lambda now: {d: t for d, t in now.items() if not brute.hits([(d, t)], benchmark_rows())[d][4]},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, want = want, steps[name](want)
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == NAMES
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
        assert name == "quality_rules" or want != before
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = plain()
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in want.items()}
    assert {r["doc_id"] for r in packed} == set(want) and sum(r["length"] for r in packed) == sum(map(len, ids.values()))
    for r in packed:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
