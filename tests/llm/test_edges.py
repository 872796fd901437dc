"""Every query, and every stage of the pipeline, over tables with clashing column names, empty tables and rows at the edge of what is allowed."""

from __future__ import annotations

import zlib

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.llm import queries

TABLES = ("documents", "pages", "benchmark", "labels")
#: Names that the operators give to columns of their own, or return.
CLASHING = """
    a at b band base_ base_failed before best block body bucket byte_start component component_id contaminated digest digest_ doc doc_ids dup end failed failed_rules fingerprint first first_ fp g group_ groups h hashes
    held_out hits host i id_ ids_crc32 intact items_sha256 j kept kept_sha256 key keys_ kind last lead length lines listed m main many marks n n_ n_all n_bytes n_failed n_hit n_items n_lines n_removed n_repeat_words
    n_spans n_symbols n_tokens n_words node number offset origin other out owner own p parent part path payload payload_bytes payload_digest piece place predicted r range_ record record_type refers_ refers_to rejected rep
    row_ rule s score sequence_id set sets shard side size slot spans spans_ start t_ text_ total u v value verdict wave whole wide wide2 word word_chars words
""".split()  # fmt: skip


def write(folder, tables):
    folder.mkdir()
    for name, table in tables.items():
        pq.write_table(table, folder / f"{name}.parquet")
    return str(folder)


def awkward():
    """The smallest tables, with a null id, null and empty texts, a repeated row and a long text."""
    found = {n: pq.read_table(f"/root/testdata/sf0.001/{n}.parquet") for n in TABLES}
    docs = found["documents"].slice(0, 60)
    row = lambda doc, text: pa.table([[doc], [text], ["en"], ["web"], [len(text or "")]], schema=docs.schema)
    long_text = " ".join(f"{i * 7919 % 9973} words{i % 13}" for i in range(30_000))
    found["documents"] = pa.concat_tables([docs, row(None, "a text without an id"), row(900_001, None), row(900_002, ""), row(900_003, long_text), docs.slice(3, 1)])
    found["labels"] = pa.concat_tables([found["labels"], pa.table([[None, 900_001], [1, None], [None, 1]], schema=found["labels"].schema)])
    pages = found["pages"]
    page = lambda number, url, html: pa.table([[number], [url], [html]], schema=pages.schema)
    found["pages"] = pa.concat_tables([pages, page(900_001, None, None), page(900_002, "no scheme", ""), page(900_003, "http://", "<p>" + "long " * 50_000), pages.slice(3, 1)])
    return found


def rows(frame):
    """All rows, whatever their order."""
    return sorted(map(repr, frame.collect()))


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("edges")
    plain = awkward()
    clashing = {n: t for n, t in plain.items()}
    for name, table in plain.items():
        for extra in CLASHING:
            clashing[name] = clashing[name].append_column(extra, pa.array([f"{extra} {i}" for i in range(len(table))]))
    return {
        "plain": write(root / "plain", plain),
        "clashing": write(root / "clashing", clashing),
        "empty": write(root / "empty", {n: t.slice(0, 0) for n, t in plain.items()}),
    }


#: What depends on how rows fall to tasks: the numbers of sequences and places in them.
FREE = {"op10_packing": ("sequence_id", "offset")}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_clashing_names_change_nothing(spark, folders, name):
    query = queries.queries()[name]
    plain, clashing = query(spark, folders["plain"]), query(spark, folders["clashing"])
    assert plain.dtypes == clashing.dtypes
    assert rows(plain.drop(*FREE.get(name, ()))) == rows(clashing.drop(*FREE.get(name, ())))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, folders, name):
    query = queries.queries()[name]
    frame = query(spark, folders["empty"])
    assert frame.collect() == [] and frame.dtypes == query(spark, folders["plain"]).dtypes


def test_each_row_is_answered(spark, folders):
    """One row out for each row in, where the contract says a row per document or page; a null id stays null."""
    for name in ("op2_substring_dedup", "op3_decontaminate", "op4_toxicity", "op5_quality_rules", "op9_simhash"):
        found = [r["doc_id"] for r in queries.queries()[name](spark, folders["plain"]).collect()]
        want = awkward()["documents"]["doc_id"].to_pylist()
        assert sorted(map(repr, found)) == sorted(map(repr, want)), name
    for name in ("op1_url_filter", "op7_html_text", "op8_warc"):
        found = [r["page_id"] for r in queries.queries()[name](spark, folders["plain"]).collect()]
        assert sorted(found) == sorted(awkward()["pages"]["page_id"].to_pylist()), name


def test_packing_of_a_long_text_and_no_id(spark, folders):
    found = queries.queries()["op10_packing"](spark, folders["plain"]).collect()
    long = sorted((r["start"], r["length"]) for r in found if r["doc_id"] == 900_003)
    assert len(long) > 50 and all(a + n == b for (a, n), (b, _) in zip(long, long[1:])) and all(n <= 1024 for _, n in long)
    assert [r["length"] for r in found if r["doc_id"] in (900_001, 900_002)] == [1, 1]
    assert any(r["doc_id"] is None for r in found)
    end = zlib.crc32((2).to_bytes(4, "little"))
    assert all(r["ids_crc32"] == end for r in found if r["doc_id"] in (900_001, 900_002))
    held = {}
    for r in found:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_with_clashing_names(spark, folders):
    """Stages keep all columns of their input, and decide as they do without the others."""
    names = spark.read.parquet(f"{folders['plain']}/documents.parquet").columns
    for stage, function in corpus_pipeline.STAGES[:-1]:
        kept = {}
        for kind in ("plain", "clashing"):
            docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
            out = function(spark, docs, folders[kind])
            assert out.columns == docs.columns, stage
            kept[kind] = rows(out.select(*names))
        assert kept["plain"] == kept["clashing"], stage


def test_pipeline_of_empty_tables(spark, folders):
    assert corpus_pipeline.run(spark, folders["empty"]).collect() == []
