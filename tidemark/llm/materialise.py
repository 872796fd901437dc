"""Training-order materialisation of token ids into fixed-stride binary shards.

Documents are tokenised once, each closed by an end id, and cut as one stream a task into sequences of ``length`` ids (the
last of a task is padded).  A sequence's index is its place in task order.  A keyed Feistel permutation over the next
even power of two, with cycle-walking back into the range, gives it a global slot: a bijection that is known from the
key and the number of sequences alone, both ways.  Slots are dealt to shards by range, sorted, and written as records
of one stride, so the record of a slot is found by a division, and a reader goes on from any slot by a seek.

A record: slot (8 bytes), ids that are not padding (4), CRC-32 of the ids (4), all ids (2 bytes each, little-endian), a line end.

Scale: between the steps the sequences lie compressed in the shared folder, written again by wave once their slots are known, so
each is read once.  Shards are written in ``waves`` of slot ranges, so that only part of the corpus is in the shuffle at a time and a failure
costs a wave at most.  The driver holds one number a task.

Defined cases: null or empty text is the end id alone; a very long text runs through as many sequences as it takes; repeated rows are written
each; an empty table makes no sequence and no shard; a null doc_id appears as null in the lists; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import slices
from .tokens import encoder, vocabulary_paths

HEAD = "<qII"
ROUNDS = 6
SEQUENCES = "block int, number long, n_tokens int, ids_crc32 long, doc_ids array<bigint>, payload binary"


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed hash of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


class Permutation:
    """A keyed bijection of 0 .. size - 1."""

    def __init__(self, size: int, key: int) -> None:
        self.size, self.key = size, key
        self.half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)

    def _walk(self, values: np.ndarray, rounds: range) -> np.ndarray:
        values = np.asarray(values, np.uint64).copy()
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        todo = np.arange(len(values))
        while len(todo):
            left, right = values[todo] >> half, values[todo] & mask
            for r in rounds:
                if rounds.step > 0:
                    left, right = right, left ^ (_mixed(right, self.key * 1000003 + r) & mask)
                else:
                    left, right = right ^ (_mixed(left, self.key * 1000003 + r) & mask), left
            values[todo] = left << half | right
            todo = todo[values[todo] >= np.uint64(self.size)]
        return values.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, range(ROUNDS))

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, range(ROUNDS - 1, -1, -1))


def sequences(documents: DataFrame, length: int, paths: tuple[str, str | None], end_id: int, pad_id: int, special: bool = False) -> DataFrame:
    """Rows of SEQUENCES; the payload is the ids in two bytes each, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, number = encoder(paths, special), TaskContext.get().partitionId(), 0
        shrink = zstandard.ZstdCompressor(level=1).compress
        ids, owners = np.zeros(0, "<u2"), []  # the stream that is not cut yet; (doc_id, its end in the stream)

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, owners, number
            whole = len(ids) // length + (last and len(ids) % length > 0)
            if not whole:
                return
            ends = np.array([e for _, e in owners])
            rows = {name: [] for name in ("block", "number", "n_tokens", "ids_crc32", "doc_ids", "payload")}
            for i in range(whole):
                own = ids[i * length : (i + 1) * length]
                first, final = np.searchsorted(ends, [i * length, i * length + len(own) - 1], "right")
                raw = np.concatenate([own, np.full(length - len(own), pad_id, "<u2")]).tobytes()
                for name, value in zip(rows, (part, number, len(own), zlib.crc32(raw), [owners[k][0] for k in range(first, final + 1)], shrink(raw))):
                    rows[name].append(value)
                number += 1
            done = whole * length
            ids, owners = ids[done:], [(d, e - done) for d, e in owners if e > done]
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

        for batch in slices(batches, 1024, "text", 1 << 20):
            found = encode([t or "" for t in batch.column("text").to_pylist()])
            at, parts = len(ids), [ids]
            for doc, own in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                parts.append(np.array([*own, end_id], "<u2"))
                at += len(parts[-1])
                owners.append((doc, at))
            ids = np.concatenate(parts)
            yield from cut(False)
        yield from cut(True)

    return documents.select("doc_id", "text").mapInArrow(run, SEQUENCES)


def write_shards(documents: DataFrame, path: str | None = None, key: int = 20240101, length: int = 1024, per_shard: int = 4096, waves: int = 4, paths: tuple[str, str | None] | None = None, end_id: int = 2, pad_id: int = 50256, special: bool = False) -> DataFrame:
    """Write the shards below ``path`` (a folder a wave, a file a shard, in order) and describe each sequence.

    Returns what :func:`read_shards` reads back (slot, shard, ``byte_start`` in the shard, n_tokens, ids_crc32, intact), and the
    doc_ids of each sequence.
    """
    import gc

    spark = documents.sparkSession
    scratch = Scratch(spark, "materialise")
    path = path or scratch.path("shards")
    made = scratch.save(sequences(documents, length, paths or vocabulary_paths(), end_id, pad_id, special), "sequences")
    counts = {r["block"]: r["n"] for r in made.groupBy("block").agg(F.count("*").alias("n")).collect()}  # one row a task
    blocks = sorted(counts)
    starts = np.zeros(max(blocks, default=-1) + 1, np.int64)
    starts[blocks] = np.cumsum([0, *(counts[b] for b in blocks)])[:-1] if blocks else 0
    total = sum(counts.values())
    shuffle, base = Permutation(total, key), spark.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def slot_of(block, number):
        import pandas as pd

        return pd.Series(shuffle.slot(base.value[block.to_numpy()] + number.to_numpy()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("slot", "n_tokens", "ids_crc32", "payload"))
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack(HEAD, s, n, c) + expand(p) for s, n, c, p in zip(*columns, strict=True)], pa.binary())], names=["record"])

    shards = -(-total // per_shard)
    a_wave = max(1, -(-shards // waves))
    placed = made.withColumn("slot", slot_of("block", "number")).withColumn("wave", F.floor(F.col("slot") / (per_shard * a_wave)).cast("int"))
    placed.select("slot", "n_tokens", "ids_crc32", "doc_ids", "payload", "wave").write.partitionBy("wave").parquet(scratch.path("placed"))
    scratch.drop("sequences")
    schema = "slot long, n_tokens int, ids_crc32 long, doc_ids array<bigint>, payload binary, wave int"
    placed = spark.read.schema(schema).parquet(scratch.path("placed"))
    for wave, first in enumerate(range(0, shards, a_wave)):
        many = min(a_wave, shards - first)
        own = placed.where(F.col("wave") == wave).select("slot", "n_tokens", "ids_crc32", "payload")  # reads this wave's files only
        dealt = own.repartitionById(many, (F.floor(F.col("slot") / per_shard) - first).cast("int")).sortWithinPartitions("slot")
        records = dealt.mapInArrow(pack, "record binary").select(F.col("record").cast("string"))
        records.write.option("lineSep", "\n").text(f"{path}/wave-{wave:05d}")
        gc.collect()
        spark._jvm.System.gc()  # the wave's shuffle files may go
    if not shards:
        return spark.createDataFrame([], READ + ", doc_ids array<bigint>")
    found = read_shards(spark, path, length, a_wave)
    return found.join(placed.select("slot", "doc_ids"), "slot")


READ = "slot long, shard long, byte_start long, n_tokens long, ids_crc32 long, intact boolean"


def read_shards(spark: SparkSession, path: str, length: int, a_wave: int, first: int = 0, with_ids: bool = False) -> DataFrame:
    """The records of the shards from slot ``first`` on, as they lie on disk: READ, and with ``with_ids`` the ``ids`` (little-endian, 2 bytes).

    ``a_wave`` is the number of shards of a wave.  A reader that was interrupted goes on with ``first``: folders of earlier waves
    are not opened, and within a shard the place of the slot is found by a division.  ``intact`` tells whether slot, checksum and
    line end are what they should be.
    """
    kind = np.dtype([("slot", "<i8"), ("n", "<u4"), ("crc", "<u4"), ("ids", "<u2", (length,)), ("end", "u1")])
    names = [x.split()[0] for x in READ.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                wave, part = map(int, _PLACE.search(place).groups())
                rows = np.frombuffer(raw.as_buffer(), kind)
                crc = np.array([zlib.crc32(own.tobytes()) for own in rows["ids"]], np.int64)
                start = np.arange(len(rows)) * kind.itemsize
                fine = (crc == rows["crc"]) & (rows["end"] == 10) & (np.diff(rows["slot"], prepend=rows["slot"][0] - 1) == 1)
                keep = rows["slot"] >= first
                columns = [rows["slot"], np.full(len(rows), wave * a_wave + part), start, rows["n"].astype(np.int64), rows["crc"].astype(np.int64), fine]
                out = [pa.array(np.ascontiguousarray(c[keep])) for c in columns]
                if with_ids:
                    out.append(pa.array([own.tobytes() for own in rows["ids"][keep]], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    if first:
        shard = F.regexp_extract("path", _PLACE.pattern, 1).cast("long") * a_wave + F.regexp_extract("path", _PLACE.pattern, 2).cast("long")
        last = files.select(F.max(shard)).first()[0]  # names only; no content is read
        stride = kind.itemsize
        per_shard = files.where(shard == 0).select("length").first()[0] // stride
        files = files.where(shard >= min(first // per_shard, last))
    return files.select("path", "content").mapInArrow(run, READ + ", ids binary" * with_ids)


_PLACE = re.compile(r"wave-(\d+)/part-(\d+)")


def read_record(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(slot, ids that are not padding, all ids) of a record; raises ValueError if the checksum differs."""
    slot, n, crc = struct.unpack_from(HEAD, raw)
    if zlib.crc32(raw[struct.calcsize(HEAD) : -1]) != crc or raw[-1:] != b"\n":
        raise ValueError(f"the record of slot {slot} is damaged")
    return slot, n, np.frombuffer(raw[:-1], "<u2", offset=struct.calcsize(HEAD))
