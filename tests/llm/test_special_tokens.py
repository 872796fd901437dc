"""Token ids as a plain tokenizer gives them, strings of special tokens included."""

from __future__ import annotations

import random
import zlib

import numpy as np
from test_documents import SCHEMA, awkward, with_clashes

from tidemark.llm import packing, tokens


def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_paths()[0])


def test_encoder_with_special_tokens():
    pick = random.Random(6)
    texts = ["".join(pick.choice(["a", " ", "b c", "\n", "<|endoftext|>", "<|endoftext", "|>", "é", " 12"]) for _ in range(60)) for _ in range(300)]
    want = [x.ids for x in plain().encode_batch(texts, add_special_tokens=False)]
    assert tokens.encoder(tokens.vocabulary_paths(), True)(texts) == want
    assert any(50256 in ids for ids in want) and not any(50256 in ids for ids in tokens.encoder(tokens.vocabulary_paths())(texts))
    slow = tokens.encoder((tokens.vocabulary_paths()[0], None), True)
    assert slow(texts) == want


def test_packing_with_special_tokens(spark):
    """Every piece has the ids of a plain tokenizer, and few sequences are more than the least that the ids need."""
    docs = with_clashes(spark.createDataFrame([*awkward(), (900, "a <|endoftext|> b", None, None, None)], SCHEMA))
    slow = plain()
    want = {}
    for doc, text in [*((d, t) for d, t, *_ in awkward()), (900, "a <|endoftext|> b")]:
        want.setdefault(doc, []).append(np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    rows = packing.pack(docs, special=True).collect()
    for r in rows:
        assert any(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for ids in want[r["doc_id"]])
    total = sum(len(ids) for found in want.values() for ids in found)
    assert sum(r["length"] for r in rows) == total
    assert len({r["sequence_id"] for r in rows}) == -(-total // 1024)
