"""Document operators against plain restatements, over awkward inputs."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bwt, decontaminate, materialise, packing, quality, simhash, substring, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(seed: int, words: int = 40) -> str:
    pick = random.Random(seed)
    return " ".join("".join(pick.choice("abcdeéñß漢") for _ in range(pick.randint(1, 8))) for _ in range(words))


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, self-repeats, ties and odd characters."""
    shared, other = passage(1), passage(2)
    near = passage(3, 120)
    texts = [
        None, "", " \n\t ", "one", "Two Words", shared, shared, f"{other} {shared} {passage(4)}", f"{passage(5)}\n{shared[:150]}", near, near.replace("a", "b", 1), near + " tail",
        "line one here\nline one here\n\nline one here\n" * 30, "a" * 500, "ab" * 400 + shared, passage(6, 30_000), "\u00a0\u2003nbsp\u0085 next", "x\x0by\x0cz\rw",
        "HELLO hello HeLLo " * 12, "#$%& ||| <> *" * 10 + passage(7), "<|endoftext|> literal", "0123456789" * 40, shared.upper(),
    ]
    rows = [(i, t, None if i % 3 else "en", f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows + [rows[5], (None, shared, None, None, 3), (None, None, None, None, None)]


def with_clashes(frame):
    """Extra columns under names that the operators use themselves."""
    extra = {c: F.lit(i) for i, c in enumerate(("id_", "Row_", "spans_", "hits", "Items", "n_words", "failed", "q_failed", "fp", "block", "marks", "component_id", "measured", "own"))}
    return frame.withColumns(extra)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def benchmark_rows():
    return [(0, passage(1, 40)), (1, None), (2, ""), (3, "Two words"), (4, "hello"), (5, passage(1, 12)), (6, passage(99))]


@pytest.mark.parametrize("block_bytes", [8 << 20, 64])
def test_decontaminate(spark, docs, block_bytes):
    bench = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    found = decontaminate.digest(decontaminate.find_hits(docs, bench, block_bytes=block_bytes))
    want = sorted(((d, *brute.hits([(d, t)], benchmark_rows())[d]) for d, t, *_ in awkward()), key=repr)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert any(r[5] for r in want)


def test_decontaminate_keeps_columns(spark, docs, none):
    bench = spark.createDataFrame(benchmark_rows(), "item_id long, text string")
    clashing = with_clashes(docs)
    kept = decontaminate.remove_contaminated(clashing, bench)
    assert kept.schema.names == clashing.schema.names
    assert 0 < kept.count() < clashing.count()
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.find_hits(none, bench).count() == 0


def test_quality(docs, none):
    book = quality.ledger(docs)
    want = sorted(((d, *brute.quality(t)) for d, t, *_ in awkward()), key=repr)
    assert rows_of(book.withColumn("base", quality.fails_policy("base")), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base") == want
    clashing = with_clashes(docs)
    kept = quality.accepted(clashing)
    assert kept.schema == clashing.schema and 0 < kept.count() < clashing.count()
    assert quality.accepted(none).count() == 0
    ablated = {r["rule"]: r for r in quality.ablations(book).collect()}
    assert ablated["too_few_words"]["n_failed"] == sum(brute.quality(t)[0] < 20 for _, t, *_ in awkward())


@pytest.mark.parametrize("most", [256, 2])
def test_simhash(spark, docs, most):
    pick = random.Random(5)
    base = [pick.getrandbits(64) for _ in range(4)]
    prints = [b ^ sum(1 << x for x in pick.sample(range(64), pick.randint(0, 4))) for b in base for _ in range(60)]
    distinct = spark.createDataFrame([(simhash._signed(p),) for p in set(prints)], "fp long")
    from tidemark.scratch import Scratch

    scratch = Scratch(spark, "test")
    links = simhash.links_between(distinct, scratch, most)
    named = {simhash._signed(p): i for i, p in enumerate(sorted(set(prints)))}
    pairs = spark.createDataFrame([(named[r["a"]], named[r["b"]]) for r in links.collect()], "u long, v long")
    found = {r["node"]: r["component"] for r in simhash.components(pairs, scratch).collect()}
    want = brute.groups([(named[simhash._signed(p)], p) for p in sorted(set(prints))])
    assert {n: found.get(n, n) for n in named.values()} == want


def test_simhash_documents(docs, none):
    found = simhash.near_duplicates(docs)
    named = [(d, brute.simhash(t)) for d, t, *_ in awkward() if d is not None]
    groups = brute.groups(sorted(set(named)))
    want = sorted([(d, f"{brute.simhash(t):016x}") for d, t, *_ in awkward()], key=repr)
    assert rows_of(found.withColumn("hex", simhash.hex_digits("fp")), "doc_id", "hex") == want
    assert {(r["doc_id"], r["component_id"]) for r in found.collect() if r["doc_id"] is not None} == {(d, groups[d]) for d, _ in named}
    kept = simhash.one_of_each_group(with_clashes(docs))
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(groups.values()))
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each_group(none).count() == 0


@pytest.mark.parametrize("options", [{}, {"most": 1}, {"block": 1, "held": 50}])
def test_substring(spark, docs, options):
    rows = [r for i, r in enumerate(awkward()) if r[0] is not None and r not in awkward()[:i]]
    rows += [(100 + i, f"{passage(50)[:180]} {passage(200 + i)} {passage(51)} {passage(50)}", None, None, None) for i in range(30)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute.kept_bytes([(r[0], r[1]) for r in rows])
    found = substring.removal_report(frame, **options)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((d, *v) for d, v in want.items()), key=repr)


def test_substring_repeated_rows_and_columns(docs, none):
    clashing = with_clashes(docs)
    cut = substring.without_repeats(clashing)
    assert cut.schema.names == clashing.schema.names and cut.count() == clashing.count()
    # a null doc_id comes first, so of the shared passage only its copy there stays
    assert [r["text"] for r in cut.where("doc_id is null and text is not null").collect()] == [passage(1)]
    assert {r["text"] for r in cut.where("doc_id in (5, 6)").collect()} == {""}
    assert substring.removal_report(none).count() == 0 and substring.without_repeats(none).count() == 0


def test_transform_columns():
    pick = random.Random(3)
    for _ in range(60):
        strings = [bytes(pick.choice(b"abc\xff") for _ in range(pick.randint(0, 14))) for _ in range(pick.randint(1, 12))]
        ends = np.cumsum([len(s) for s in strings])
        starts = ends - np.array([len(s) for s in strings])
        groups = bwt.repeated(np.frombuffer(b"".join(strings), np.uint8), starts, ends, 3)
        seen = {}
        for i, s in enumerate(strings):
            for at in range(len(s) - 2):
                assert seen.setdefault(groups[at, i], s[at : at + 3]) == s[at : at + 3]
        assert len(set(seen.values())) == len(seen)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.vocabulary_paths()[0])
    slow.encode_special_tokens = True
    found = packing.pack(docs).collect()
    ids = [(d, [*slow.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in awkward()]
    assert sum(r["length"] for r in found) == sum(len(x) for _, x in ids)
    by_doc = {d: x for d, x in ids}
    for r in found:
        if r["doc_id"] is not None:
            own = np.array(by_doc[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and len(own) == r["length"]
            assert r["length"] == 1024 or r["piece"] == 0
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_fullest_combination():
    pick = random.Random(1)
    for _ in range(100):
        lengths = [pick.randint(1, 12) for _ in range(pick.randint(0, 9))]
        room = pick.randint(0, 30)
        counts = [lengths.count(i) for i in range(31)]
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        found = packing.fullest(counts, room)
        assert sum(length * n for length, n in found) == max(s for s in sums if s <= room)
        assert all(n <= counts[length] for length, n in found)


def test_token_engines_agree():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokens.vocabulary_paths()[0])
    slow.encode_special_tokens = True
    pick = random.Random(2)
    texts = ["".join(pick.choice("ab c\n\t\r é'sll  19,.<|endoftext|>  İßЖ漢😀\x00\x1c\x85") for _ in range(200)) for _ in range(300)]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}  {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert tokens.encoder(tokens.vocabulary_paths())(texts) == [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]


def test_training_order(spark, docs, none, tmp_path):
    path = f"file://{tmp_path}/shards"
    found = materialise.write_shards(docs, path, length=64, per_shard=50, waves=3).collect()
    assert sorted(r["slot"] for r in found) == list(range(len(found)))
    stride = 16 + 2 * 64 + 1
    files = sorted(tmp_path.glob("shards/wave-*/part-*"))
    stored = {}
    for shard, file in enumerate(files):
        raw = file.read_bytes()
        for at in range(0, len(raw), stride):
            slot, n, ids = materialise.read_record(raw[at : at + stride])
            assert slot == shard * 50 + at // stride
            stored[slot] = (shard, at, n, ids)
    assert {r["slot"]: (r["shard"], r["byte_start"], r["n_tokens"]) for r in found} == {s: v[:3] for s, v in stored.items()}
    encode = tokens.encoder(tokens.vocabulary_paths())
    assert sum(r["n_tokens"] for r in found) == sum(len(encode([t or ""])[0]) + 1 for _, t, *_ in awkward())
    assert {d for r in found for d in r["doc_ids"]} == {d for d, *_ in awkward()}
    for size in (1, 2, 5, 64, 1000):
        order = materialise.Permutation(size, 9)
        slots = order.slot(np.arange(size))
        assert sorted(slots.tolist()) == list(range(size)) and order.index(slots).tolist() == list(range(size))
    assert materialise.write_shards(none, f"file://{tmp_path}/empty").count() == 0


def test_toxicity(spark, docs, none):
    pick = random.Random(8)
    plain, bad = [passage(1000 + i, 1) for i in range(300)], ["grumbold", "snarkelwitz", "blatherskite"]
    rows, labels = [], []
    for i in range(600):
        words = [pick.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(pick.randint(0, 60), pick.choice(bad))
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, None, int(i % 4 == 0)))
    corpus = spark.createDataFrame(rows + [(None, "x", None, None, None), (700, None, None, None, None)], SCHEMA)
    known = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(corpus, known)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(corpus, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((scores[i] >= 0.3) == (i % 4 == 0) for i in held) / len(held)
    assert right > 0.9, right
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == 602
    assert [r["score"] for r in toxicity.score(docs.limit(3), None).collect()] == [0.0] * 3
    assert toxicity.fit(none, known) is None and toxicity.score(none, model).count() == 0
    assert toxicity.fit(corpus, known.limit(0)) is None
