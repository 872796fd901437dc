"""Substring dedup: every byte that a ``length``-byte string covers which also starts earlier is removed.

Earlier means in a smaller doc_id, or in the same document at a smaller place; strings are judged on the input and do
not cross documents.

Method.  Texts are cut into fragments by content: consecutive strings that share an anchor (see ``anchors``).  Strings
that are equal have equal anchors at equal places, so all occurrences of a string lie in fragments of one anchor key,
and what follows works on one key at a time:

1. Each fragment is named by its key (a rolling hash of the anchor) and the XXH3 of its whole bytes, 128 bits together.  Equal fragments are one
   string for the construction: all but the first are removed whole.  Fragments whose key occurs once are unique.
2. The distinct fragments of a key that has several go, with their bytes, through the column-wise construction of a
   collection Burrows-Wheeler transform with common prefixes (see ``bwt``).  Runs with a common prefix of the full
   length are the occurrences of one string; all but the first in the order of the corpus are removed.  The anchor,
   which all strings of a fragment hold, is one symbol there, and runs are told apart by key as well.
3. A key with more than ``most`` distinct fragments (a passage in a third of the corpus, followed by something else each
   time) is not built; no more than its fragments' names have met in one task.  Its strings are dealt one by one by their own
   hash and the first of each is found by an
   aggregation with map-side combining.

Scale: step 1 shuffles 16 bytes and an ordinal for each fragment (about one in 26 bytes of text), after equal ones were
combined in the task; step 2 only fragments at the edges of repeats.  Texts are dealt by document twice, once to
cut out those fragments and once to remove; nothing but the small tables between the steps is kept.  Each construction
holds one block of whole keys, about ``block`` strings.  Results of each step are tables in the shared folder.

Defined cases: null or empty text is zero bytes and keeps zero bytes; a text shorter than ``length`` is kept whole; a null
doc_id comes before all others; rows that share a doc_id count as the same document, so that only a smaller place
in either is earlier, and equal rows do not remove each other at equal places; an empty table gives no row; a text of any length is
cut in one task; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import anchors as an
from .bwt import repeated
from .common import shielded, slices, utf8_list

FULL, EDGE, HOT = 0, 1, 2
NO_ID = -(1 << 63)
ANCHOR = 0xFF  # never a byte of valid UTF-8: stands for the anchor


def _fragments(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """Fragments of all texts with their ``ordinal`` in the text, and the bytes and text starts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    with np.errstate(over="ignore"):
        found = an.anchors(data, lengths, length, gram)
    heads = np.searchsorted(found["text"], np.arange(len(texts)))
    found["ordinal"] = np.arange(len(found["text"])) - heads[found["text"]]
    return found | {"data": data, "base": np.cumsum(lengths) - lengths}


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XXH3 of each stretch of bytes."""
    raw, digest = memoryview(data.tobytes()), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _documents(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"id_": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "row_": F.hash("text")})


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows equal in all (sorted) columns start."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _binary_runs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The raw bytes of each run of int64 values as a binary array."""
    offsets = np.append(cuts, len(values)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<i8").tobytes())])


def _mark_rows(ids: np.ndarray, rows: np.ndarray, ordinals: np.ndarray, kinds: np.ndarray) -> pa.RecordBatch:
    """Marks by document: ordinal * 4 + kind."""
    order = np.lexsort((ordinals, rows, ids))
    ids, rows = ids[order], rows[order]
    cuts = _cuts(ids, rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[cuts]), pa.array(rows[cuts].astype(np.int32)), _binary_runs((ordinals * 4 + kinds)[order], cuts)], names=["id_", "row_", "marks"]
    )


def _keys(length: int, gram: int, buckets: int, held: int):
    """Map side of step 1: packs (key, whole, document, ordinal) by bucket; of equal fragments in the task only the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts: list[list[np.ndarray]] = []
        part = TaskContext.get().partitionId()

        def pack() -> Iterator[pa.RecordBatch]:
            key, whole, ids, rows, ordinal = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((ordinal, ids, whole, key))
            first = order[_cuts(key[order], whole[order])]
            again = np.ones(len(key), bool)
            again[first] = False
            # a repeat of the first place itself (rows that share a doc_id) is not later
            lead = np.empty(len(key), np.int64)
            lead[order] = np.repeat(first, np.diff(np.append(_cuts(key[order], whole[order]), len(key))))
            same = (ids == ids[lead]) & (ordinal == ordinal[lead])
            local = np.flatnonzero(again & ~same)
            sent = np.flatnonzero(~again | same)
            bucket = (key[sent] >> np.uint64(40)) % np.uint64(buckets)
            by_bucket = np.argsort(bucket, kind="stable")
            sent, bucket = sent[by_bucket], bucket[by_bucket].astype(np.int32)
            cuts = _cuts(bucket)
            payload = [_pack(key[own], whole[own], ids[own], rows[own], ordinal[own]) for own in np.split(sent, cuts[1:])] if len(sent) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(payload, pa.binary())], names=["bucket", "payload"])
            if len(local):
                marks = _mark_rows(ids[local], rows[local], ordinal[local], np.zeros(len(local), np.int64))
                for at in range(0, marks.num_rows, 4096):
                    own = marks.slice(at, 4096)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, own.schema) as out:
                        out.write_batch(own)
                    yield pa.RecordBatch.from_arrays([pa.array([(part + at // 4096) % buckets], pa.int32()), pa.array([b"M" + sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "payload"])

        count = 0
        for batch in slices(batches, 4096, "text", 1 << 20):
            found = _fragments(utf8_list(batch.column("text")), length, gram)
            if len(found["key"]):
                text = found["text"]
                ids, rows = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("id_", "row_"))
                parts.append([found["key"], _names(found["data"], found["first"], found["last"] + length), ids, rows, found["ordinal"]])
                count += len(text)
            if count > held:
                yield from pack()
                count = 0
        if count:
            yield from pack()

    return run


def _pack(key, whole, ids, rows, ordinal) -> bytes:
    order = np.lexsort((ordinal, rows, ids))
    key, whole, ids, rows, ordinal = (x[order] for x in (key, whole, ids, rows, ordinal))
    cuts = _cuts(ids, rows)
    counts = np.diff(np.append(cuts, len(key))).astype("<u4")
    small = zlib.compress(np.diff(ids[cuts], prepend=0).astype("<i8").tobytes() + counts.tobytes() + ordinal.astype("<u4").tobytes(), 1)
    return b"K" + np.array([len(key), len(cuts), len(small)], "<u4").tobytes() + small + rows[cuts].astype("<i4").tobytes() + key.tobytes() + whole.tobytes()


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n, d, size = np.frombuffer(raw, "<u4", 3, 1).tolist()
    small, at = zlib.decompress(raw[13 : 13 + size]), 13 + size
    counts = np.frombuffer(small, "<u4", d, 8 * d)
    ids = np.repeat(np.cumsum(np.frombuffer(small, "<i8", d)), counts)
    rows = np.repeat(np.frombuffer(raw, "<i4", d, at), counts)
    key, whole = np.frombuffer(raw, "<u8", n, at + 4 * d), np.frombuffer(raw, "<u8", n, at + 4 * d + 8 * n)
    return key, whole, ids, rows, np.frombuffer(small, "<u4", n, 12 * d).astype(np.int64)


def _judge(most: int):
    """Reduce side of step 1: marks fragments as repeated whole (FULL), for the construction (EDGE) or for step 3 (HOT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for raw in batch.column("payload"):
                raw = raw.as_py()
                if raw[:1] == b"M":
                    yield from pa.ipc.open_stream(raw[1:])
                else:
                    part = _unpack(raw)
                    parts.append(part)
        if not parts:
            return
        key, whole, ids, rows, ordinal = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        equal = sorted_key[1:] == sorted_key[:-1]
        busy = np.zeros(len(key), bool)
        busy[1:] |= equal
        busy[:-1] |= equal
        own = order[busy]
        key, whole, ids, rows, ordinal = (x[own] for x in (key, whole, ids, rows, ordinal))
        if not len(key):
            return
        order = np.lexsort((ordinal, ids, whole, key))
        key, whole, ids, rows, ordinal = (x[order] for x in (key, whole, ids, rows, ordinal))
        frags = _cuts(key, whole)
        sizes = np.diff(np.append(frags, len(key)))
        lead = np.repeat(frags, sizes)
        later = (ids != ids[lead]) | (ordinal != ordinal[lead])
        keys = _cuts(key[frags])
        distinct = np.repeat(np.repeat(np.diff(np.append(keys, len(frags))), np.diff(np.append(keys, len(frags)))), sizes)
        kind = np.where(later, FULL, np.where(distinct > most, HOT, EDGE))
        marked = later | (distinct > 1)
        if marked.any():
            yield _mark_rows(ids[marked], rows[marked], ordinal[marked], kind[marked])

    return run


PARTS = "kind int, key long, other long, id_ long, row_ int, start long, many int, off int, body binary"


def _cut_out(length: int, gram: int):
    """Step 2, map side: the spans of FULL fragments, the bytes of EDGE fragments, the strings of HOT ones."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def rows(**columns) -> pa.RecordBatch:
        n = len(columns["id_"])
        full = [columns.get(name, np.zeros(n, np.int64) if kind != pa.binary() else [None] * n) for name, kind in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(full, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, "text", 1 << 20):
            found = _fragments(utf8_list(batch.column("text")), length, gram)
            marks = [np.frombuffer(b"".join(x), "<i8") for x in batch.column("marks").to_pylist()]
            owner = np.repeat(np.arange(len(marks)), [len(x) for x in marks])
            marks = np.concatenate(marks)
            at = np.searchsorted(found["text"], owner) + marks // 4
            kind, base = marks % 4, found["base"][owner]
            ids, row = (batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in ("id_", "row_"))
            first, last, anchor = found["first"][at], found["last"][at], found["anchor"][at]
            own = np.flatnonzero(kind == FULL)
            if len(own):
                order = own[np.lexsort((first[own], owner[own]))]
                cuts = _cuts(owner[order])
                spans = np.stack([first - base, last + length - base], 1)[order]
                body = _binary_runs(spans.reshape(-1), cuts * 2)
                yield rows(kind=np.full(len(cuts), FULL), id_=ids[order[cuts]], row_=row[order[cuts]], body=body)
            own = np.flatnonzero(kind == EDGE)
            if len(own):
                raw = found["data"].tobytes()
                body = [raw[a:m] + b"\xff" + raw[m + gram : b] for a, m, b in zip(first[own].tolist(), anchor[own].tolist(), (last[own] + length).tolist())]
                yield rows(
                    kind=np.full(len(own), EDGE), key=found["key"][at[own]].view(np.int64), id_=ids[own], row_=row[own], start=(first - base)[own],
                    many=(last - first + 1)[own], off=(anchor - first)[own], body=body,
                )
            own = np.flatnonzero(kind == HOT)
            if len(own):
                many = (last - first + 1)[own]
                start = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                with np.errstate(over="ignore"):
                    one = an.GRAM.at(an.GRAM.prefix(found["data"]), start, start + length).view(np.int64)
                two = _names(found["data"], start, start + length).view(np.int64)
                back = np.repeat(own, many)
                yield rows(kind=np.full(len(start), HOT), key=one, other=two, id_=ids[back], row_=row[back], start=start - base[back])

    return run


SPANS = "id_ long, row_ int, body binary"


def _construct(length: int, gram: int, block: int):
    """Step 2: the construction over blocks of whole keys, from rows sorted by key."""

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        take = lambda c: table.column(c).to_numpy()
        key, ids, row, start, many, off = (take(c) for c in ("key", "id_", "row_", "start", "many", "off"))
        body = table.column("body").to_pylist()
        ends = np.cumsum([len(b) for b in body])
        starts = ends - np.array([len(b) for b in body])
        group = repeated(np.frombuffer(b"".join(body), np.uint8), starts, ends, length - gram + 1)
        shift, who = np.nonzero(np.arange(len(group))[:, None] < many[None, :])
        group = group[shift, who]
        place = start[who] + shift
        order = np.lexsort((place, ids[who], key[who], group))
        heads = _cuts(key[who][order], group[order])
        lead = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
        later = np.zeros(len(who), bool)
        later[order] = (ids[who[order]] != ids[who[lead]]) | (place[order] != place[lead])
        own = np.flatnonzero(later)
        if len(own):
            own = own[np.lexsort((place[own], row[who[own]], ids[who[own]]))]
            yield _span_rows(ids[who[own]], row[who[own]], place[own], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column("key").to_numpy()
            done = 0
            for cut in [*_cuts(key)[1:].tolist(), None]:
                size = sum(x.num_rows for x in held)
                if cut is None:
                    held.append(batch.slice(done))
                elif size + cut - done >= block:
                    # the rows before `cut` end a key; a key may have begun in an earlier batch
                    held.append(batch.slice(done, cut - done))
                    yield from solve(held)
                    held, done = [], cut
        if held:
            yield from solve(held)

    return run


def _span_rows(ids: np.ndarray, rows: np.ndarray, place: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of strings at sorted places, by document; strings that touch or overlap are one span."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (place[1:] > place[:-1] + length)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(ids)) - 1
    spans = np.stack([place[heads], place[tails] + length], 1)
    cuts = _cuts(ids[heads], rows[heads])
    return pa.RecordBatch.from_arrays([pa.array(ids[heads[cuts]]), pa.array(rows[heads[cuts]].astype(np.int32)), _binary_runs(spans.reshape(-1), cuts * 2)], names=["id_", "row_", "body"])


def _free(scratch: Scratch) -> None:
    """Let the driver drop the shuffle files of finished steps now."""
    import gc

    gc.collect()
    scratch.spark._jvm.System.gc()


def repeated_spans(documents: DataFrame, length: int = 100, gram: int = 48, most: int = 4096, block: int = 6000, held: int = 1_500_000) -> DataFrame:
    """Per document that has any: id_, row_ and ``spans``, a list of int64 pairs [start, end) as bytes, which may overlap."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "substring")
    # at least 64, so that the rows of marks (one a document and bucket) do not grow with the buckets as well
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = _documents(documents.select("doc_id", "text"))
    keys = docs.select("id_", "row_", "text").mapInArrow(_keys(length, gram, buckets, held), "bucket int, payload binary")
    marks = scratch.save(keys.repartitionById(buckets, F.col("bucket")).mapInArrow(_judge(most), "id_ long, row_ int, marks binary"), "marks")
    _free(scratch)
    by_document = marks.groupBy("id_", "row_").agg(F.collect_list("marks").alias("marks"))
    marked = docs.select("id_", "row_", "text").join(by_document.hint("shuffle_hash"), ["id_", "row_"])
    parts = scratch.save(marked.mapInArrow(_cut_out(length, gram), PARTS), "parts")
    _free(scratch)
    edge = parts.where(F.col("kind") == EDGE).select("key", "id_", "row_", "start", "many", "off", "body")
    built = edge.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(_construct(length, gram, block), SPANS)
    hot = parts.where(F.col("kind") == HOT).select("key", "other", "id_", "row_", "start")
    first = hot.groupBy("key", "other").agg(F.min(F.struct("id_", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = hot.join(first, ["key", "other"]).where((F.col("id_") != F.col("first.id_")) | (F.col("start") != F.col("first.start")))

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, place = (batch.column(c).to_numpy() for c in ("id_", "row_", "start"))
            if len(ids):
                order = np.lexsort((place, rows, ids))
                yield _span_rows(ids[order], rows[order], place[order], length)

    pieces = built.unionByName(later.select("id_", "row_", "start").mapInArrow(spans_of, SPANS)).unionByName(parts.where(F.col("kind") == FULL).select("id_", "row_", "body"))
    spans = scratch.save(pieces.groupBy("id_", "row_").agg(F.collect_list("body").alias("spans")), "spans")
    scratch.drop("marks")
    scratch.drop("parts")
    _free(scratch)
    return spans


def merged(raw: list[bytes]) -> np.ndarray:
    """Maximal spans, as rows [start, end)."""
    spans = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    heads = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[heads, 0], reach[np.append(heads[1:], len(spans)) - 1]], 1)


def without(text: bytes, spans: np.ndarray) -> bytes:
    at = [0, *spans.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))


def with_spans(documents: DataFrame, **options) -> DataFrame:
    """The documents with ``spans_``, null where nothing repeats, beside ``id_`` and ``row_``."""
    return _documents(documents).join(repeated_spans(documents, **options).hint("shuffle_hash").withColumnRenamed("spans", "spans_"), ["id_", "row_"], "left")


def removal_report(documents: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, "text", 4 << 20):
            size, gone, runs, digest = [], [], [], []
            for text, raw in zip(utf8_list(batch.column("text")), batch.column("spans_").to_pylist(), strict=True):
                spans = merged(raw) if raw else np.zeros((0, 2), np.int64)
                size.append(len(text))
                gone.append(int((spans[:, 1] - spans[:, 0]).sum()))
                runs.append(len(spans))
                digest.append(hashlib.sha256(without(text, spans)).hexdigest())
            columns = [batch.column("doc_id").cast(pa.int64()), *[pa.array(x, pa.int64()) for x in (size, gone, runs)], pa.array(digest)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(documents.select("doc_id", "text"), **options)
    return found.select("doc_id", "text", "spans_").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(documents: DataFrame, **options) -> DataFrame:
    """The documents with repeated spans cut from the text; part of a character that a cut leaves behind goes too.

    ``n_chars``, if there is such a column, follows the new text.  Columns keep their order.
    """
    return shielded(documents, ("id_", "row_", "spans_"), lambda plain: _cut_repeats(plain, options))


def _cut_repeats(documents: DataFrame, options: dict) -> DataFrame:
    names = documents.columns
    found = with_spans(documents, **options)

    @F.pandas_udf("string")
    def cut(text, spans):
        import pandas as pd

        return pd.Series([t if r is None or t is None else without(t.encode(), merged(list(r))).decode("utf-8", "ignore") for t, r in zip(text, spans)], dtype=object)

    text = F.when(F.col("spans_").isNull(), F.col("text")).otherwise(cut("text", "spans_"))
    out = found.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("spans_").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*[F.col(f"`{c}`") for c in names])
