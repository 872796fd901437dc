"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item gives windows of ``window`` consecutive words (an item of fewer, but not none, is one window).
Windows of one length form a pattern set; the block is the last two words under the search head.  ``shift`` tells
how far the head may move without missing a pattern, blocks of shift zero lead to the bucket of patterns that end in
that block, and a direct comparison of all words confirms the occurrence.

Scale: the documents are scanned once, without a shuffle.  The patterns are the stated query set: they are taken in
blocks of at most ``block_bytes`` of benchmark text, one broadcast block at a time, so that a benchmark of any size
runs; each further block adds to the hits in the same row, in the same stage.

Defined cases: null or wordless text has no words, no hits and is not contaminated; an item without words (or null text)
has no window; the windows of an item without an id hit words but add no item; equal windows of several items count for each item; repeated rows are judged row by row; an empty
benchmark leaves every document clean; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import shielded, slices, utf8_list

#: A-Z to a-z; every other ASCII byte that is no digit or letter separates words; bytes from 0x80 on are word bytes.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

HITS = "doc_id long, n_words long, hits binary, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class PatternSet:
    """Wu-Manber tables for patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]) -> None:
        self.length, self.wide = length, length > 1
        block = 2 if self.wide else 1
        self.default = length - block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(block - 1, length):
                key = (words[end - 1], words[end]) if self.wide else words[end]
                self.shift[key] = min(self.shift.get(key, self.default), length - 1 - end)
            self.buckets.setdefault(key, {}).setdefault(words, []).extend(items)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start of each occurrence, in order, with the items of the pattern."""
        length, shift, default, wide = self.length, self.shift.get, self.default, self.wide
        head, n = length - 1, len(words)
        while head < n:
            key = (words[head - 1], words[head]) if wide else words[head]
            step = shift(key, default)
            if step:
                head += step
                continue
            items = self.buckets[key].get(tuple(words[head - length + 1 : head + 1]))
            if items is not None:  # empty: of items without an id alone
                yield head - length + 1, items
            head += 1


def compile_patterns(items: Iterable[tuple[str, bytes]], window: int) -> list[PatternSet]:
    """Pattern sets by length, from (item id, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = tuple(words_of(text))
        if words:
            size = min(window, len(words))
            for at in range(len(words) - size + 1):
                owners = by_length.setdefault(size, {}).setdefault(words[at : at + size], [])
                if item is not None and (not owners or owners[-1] != item):
                    owners.append(item)
    return [PatternSet(size, found) for size, found in sorted(by_length.items())]


def scan(words: list[bytes], sets: list[PatternSet]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal hit runs [start, end) and the items that occur."""
    found, items = [], set()
    for patterns in sets:
        for start, owners in patterns.search(words):
            found.append((start, start + patterns.length))
            items.update(owners)
    return merge_runs(found), items


def merge_runs(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, end))
    return runs


def _pattern_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Blocks of (item id, text), each at most ``block_bytes`` of text or a single item."""
    held, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        raw = text.encode()
        if held and size + len(raw) > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, raw))
        size += len(raw)
    yield held


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 8 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, ``hits`` (int32 pairs of maximal hit word runs) and the ``items`` that occur.

    ``keep`` names further columns of the documents to carry along.
    """
    spark = documents.sparkSession
    others = [f"`{c}`" for c in keep if c not in ("doc_id", "text")]
    found = documents.select("doc_id", "text", *others)
    own, rest = StructType.fromDDL(HITS).fields, found.select(*others).schema.fields if others else []
    blocks = [spark.sparkContext.broadcast(compile_patterns(block, window)) for block in _pattern_blocks(benchmark, block_bytes)]
    for at, block in enumerate(blocks):
        last = at == len(blocks) - 1
        text = [] if last and "text" not in keep else [StructField("text", StringType())]
        schema = StructType(own + text + rest)
        found = found.mapInArrow(_scanner(block, at == 0, schema.names), schema)
    return found


def _scanner(sets, first: bool, names: list[str]):
    """A scan for one block of patterns, which adds to what earlier blocks have found in the same row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sets.value
        for batch in slices(batches, 1024, "text", 4 << 20):
            counts, hits, items = [], [], []
            earlier = [(b"", ())] * batch.num_rows if first else zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (before, owned) in zip(utf8_list(batch.column("text")), earlier, strict=True):
                words = words_of(text)
                runs, owners = scan(words, patterns)
                if before:
                    runs = merge_runs(runs + [tuple(x) for x in np.frombuffer(before, "<i4").reshape(-1, 2).tolist()])
                counts.append(len(words))
                hits.append(np.array(runs, "<i4").tobytes())
                items.append(sorted(owners.union(owned)))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in names[4:]], names=names)

    return run


def digest(hits: DataFrame) -> DataFrame:
    """The columns of a report on :func:`find_hits`."""
    runs = F.length("hits") / 8
    return hits.select(
        "doc_id",
        "n_words",
        _covered("hits").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (runs > 0).alias("contaminated"),
    )


def _covered(column: str):
    """Words in the runs of a ``hits`` column."""

    @F.pandas_udf("long")
    def covered(raw):
        return raw.map(lambda b: int((np.frombuffer(b, "<i4").reshape(-1, 2) @ np.array([-1, 1])).sum()))

    return covered(column)


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit word, with their own columns."""

    def work(plain: DataFrame) -> DataFrame:
        found = find_hits(plain, benchmark, window, keep=tuple(plain.columns))
        return found.where(F.length("hits") == 0).select(*[F.col(f"`{c}`") for c in plain.columns])

    return shielded(documents, ("n_words", "hits", "items"), work)
