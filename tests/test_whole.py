"""Queries over whole tables, beside those that are registered over a part."""

from __future__ import annotations

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"


def run(spark, name):
    return registry.queries()[name](spark, FOLDER)


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_highlight_whole_texts(spark):
    marked = {r["doc_id"]: r["marked"].replace("<b>", "").replace("</b>", "") for r in run(spark, "fts_highlight_whole").collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    assert marked == {d: t.replace("<b>", "").replace("</b>", "") for d, t in texts.items()} and max(map(len, marked.values())) > 400


def test_all_query_vectors(spark):
    from tidemark.operators import vectors

    rows = table(spark, "embeddings")
    queries = rows.where("vec_id % 50 = 0")
    found = run(spark, "vector_cosine_topk_each")
    assert found.count() == 10 * queries.count() and queries.count() > 1
    blocks = vectors.nearest_each(rows, "vec_id", "embedding", queries, 10, block=3).select("query", "vec_id", "rank")
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, found.collect()))
    first = vectors.nearest(rows, "vec_id", "embedding", rows.where("vec_id = 0").first()["embedding"], 10)
    assert [r["vec_id"] for r in first.collect()] == [r["vec_id"] for r in found.where("query = 0").orderBy("rank").collect()]
    assert {r["query"] for r in run(spark, "semantic_match_vectors_each").collect()} == {r["vec_id"] for r in queries.collect()}


def test_all_events_make_the_round_trip(spark):
    assert run(spark, "copy_jsonl_roundtrip_whole").count() == table(spark, "events").count() > 500


def test_whole_altered_table_and_numbering(spark):
    orders = table(spark, "orders")
    assert run(spark, "alter_table_whole").count() == orders.count() > 100
    new = sorted(tuple(r) for r in run(spark, "insert_auto_increment_whole").select("old", "o_orderkey").collect())
    start = orders.agg({"o_orderkey": "max"}).first()[0]
    assert len(new) == orders.where("o_orderstatus = 'F'").count() > 100
    assert [n for _, n in new] == list(range(start + 1, start + 1 + len(new)))


def test_full_join_and_all_over_whole_tables(spark):
    customers = {r["c_custkey"] for r in table(spark, "customer").collect()}
    assert {r["c_custkey"] for r in run(spark, "join_full_whole").collect()} - {None} == customers
    prices = {r["o_orderkey"]: r["o_totalprice"] for r in table(spark, "orders").collect()}
    assert {r["o_orderkey"] for r in run(spark, "quantified_all_whole").collect()} == {k for k, p in prices.items() if p == max(prices.values())}
