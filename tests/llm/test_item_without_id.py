"""A benchmark item without an id still contaminates."""

from __future__ import annotations

from tidemark.llm import decontaminate


def test_item_without_id(spark):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(["a", *words[:15]])), (2, " ".join(words[15:])), (3, "none of them")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(words[:15])), (7, " ".join(words[15:]))], "item_id long, text string")
    for block_bytes in (8 << 20, 8):
        found = decontaminate.digest(decontaminate.find_hits(docs, bench, block_bytes=block_bytes))
        assert {(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in found.collect()} == {(1, 15, 0, True), (2, 15, 1, True), (3, 0, 0, False)}
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).collect()] == [3]
