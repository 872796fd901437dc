"""Shards as a reader finds them: whole, from a slot on, and damaged."""

from __future__ import annotations

import numpy as np
from test_documents import SCHEMA, awkward, with_clashes

from tidemark.llm import materialise, tokens


def test_reader(spark, tmp_path):
    docs = with_clashes(spark.createDataFrame(awkward(), SCHEMA)).repartition(3)
    path = f"file://{tmp_path}/shards"
    wrote = {r["slot"]: r for r in materialise.write_shards(docs, path, length=64, per_shard=50, waves=3, special=True).collect()}
    assert sorted(wrote) == list(range(len(wrote))) and all(r["intact"] for r in wrote.values())
    a_wave = -(-(-(-len(wrote) // 50)) // 3)
    whole = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in materialise.read_shards(spark, path, 64, a_wave, with_ids=True).collect()}
    encode = tokens.encoder(tokens.vocabulary_paths(), True)
    # in the order of slots that the key gives, the ids of all texts come back, each closed by the end id
    index = materialise.Permutation(len(wrote), 20240101).index(np.arange(len(wrote)))
    stream = np.concatenate([whole[s][: wrote[s]["n_tokens"]] for s in np.argsort(index).tolist()]).tolist()
    ours = sorted(tuple(encode([t or ""])[0]) for _, t, *_ in awkward())
    theirs, at = [], 0
    for end in [i for i, x in enumerate(stream) if x == 2]:
        theirs.append(tuple(stream[at:end]))
        at = end + 1
    assert sorted(theirs) == ours and at == len(stream)
    for first in (1, 49, 50, 51, 173, len(wrote) - 1, len(wrote) + 5):
        rows = materialise.read_shards(spark, path, 64, a_wave, first).collect()
        assert sorted(r["slot"] for r in rows) == [s for s in sorted(wrote) if s >= first]
        assert all((r["shard"], r["byte_start"]) == (wrote[r["slot"]]["shard"], wrote[r["slot"]]["byte_start"]) for r in rows)


def test_damage(spark, tmp_path):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    found = materialise.write_shards(docs, f"file://{tmp_path}/shards", length=64, per_shard=50, waves=1)
    assert found.where("not intact").count() == 0
    file = sorted(tmp_path.glob("shards/wave-00000/part-*"))[0]
    raw = bytearray(file.read_bytes())
    raw[16 + 129 * 0 + 20] ^= 1
    file.write_bytes(bytes(raw))
    for crc in tmp_path.glob("shards/wave-00000/.*.crc"):
        crc.unlink()
    assert [r["slot"] for r in materialise.read_shards(spark, f"file://{tmp_path}/shards", 64, 1000).where("not intact").collect()] == [0]
