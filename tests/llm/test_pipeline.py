"""The pipeline against the stages' plain restatements, one after the other."""

from __future__ import annotations

import brute
import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
from test_documents import SCHEMA, awkward, benchmark_rows, passage

from tidemark.llm import quality


def corpus():
    rows = [r for i, r in enumerate(awkward()) if r[0] is not None and r not in awkward()[:i]]
    for i in range(40):
        parts = [passage(300 + i, 60)] + [passage(50)] * (i % 3 == 0) + [passage(1, 12)] * (i % 7 == 0) + ["junk ### *** $$$ %%% &&&" * 30] * (i % 11 == 0)
        rows.append((100 + i, " ".join(parts), "en", None, 7))
    return rows + [(200 + i, rows[30 + i][1], "en", "copy", None) for i in range(8)]


def test_pipeline(spark, tmp_path):
    rows = corpus()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=names)
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in benchmark_rows()], pa.int64()), "text": pa.array([t for _, t in benchmark_rows()], pa.string())}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = {d: t for d, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = texts, stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == names
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            assert texts and not {d for d in texts if brute.quality(before[d])[5]}
            book = quality.ledger(spark.createDataFrame(rows, SCHEMA))
            assert set(texts) == {r["doc_id"] for r in book.where(~quality.fails_policy("v1")).collect()}
        elif name == "near_dedup":
            groups = brute.groups([(d, brute.simhash(t)) for d, t in sorted(before.items())])
            assert set(texts) == set(groups.values()) and len(texts) < len(before)
        elif name == "substring_dedup":
            assert {d: len((t or "").encode()) for d, t in texts.items()}.keys() == before.keys()
            want = brute.kept_bytes(list(before.items()))
            assert all(v[0] - v[1] - 12 <= len(texts[d].encode()) <= v[0] - v[1] for d, v in want.items())
            assert any(v[1] for v in want.values())
        elif name == "decontamination":
            hit = brute.hits(list(before.items()), benchmark_rows())
            assert set(texts) == {d for d in before if not hit[d][4]} and len(texts) < len(before)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == set(texts)


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
