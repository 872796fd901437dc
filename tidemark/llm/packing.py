"""Best-fit packing of token pieces into fixed-capacity sequences by minimum bin slack.

A document is its ids and an end id.  Documents longer than the capacity are cut into pieces of full capacity, the
first of which may be shorter.  Minimum bin slack fills one sequence at a time: it takes the longest piece left and
finds, by subset-sum dynamic programming on a bitset over the lengths left, the combination that fills the rest
most fully; that combination is then removed.  A search may end within a slack of the room (see ``fullest``), so the combination
taken need not be the fullest; among several slacks, none included, the plan with the fewest sequences is taken.

Scale: only the number of pieces of each length matters to the plan, at most ``capacity`` counters whatever the
corpus, so the plan is made from that histogram alone.  A combination is repeated as often as the counts allow, which
exhausts a length each time or nearly so; the plan is a short list of (combination, repeats), and the best of several
plans that differ in how much slack ends a search is taken.  A piece finds its place
from its length and its rank among the pieces of that length: ranks come from counts per (block of pieces, length),
whose running totals are the start of each block, so no length is gathered in one task.  Texts are read once; what is
kept for the second step is one small row a piece.

Defined cases: null or empty text is the end id alone; repeated rows are packed each; an empty table packs to none; the
order of equal lengths follows the blocks of the input and has no effect on how full sequences are; a null doc_id stays null
in its pieces; a very long text is cut into as many pieces as it takes; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import slices
from .tokens import encoder, vocabulary_paths

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, own long"


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first are full."""
    first = length % capacity or min(length, capacity)
    bounds = [0, *range(first, length + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def pieces(documents: DataFrame, capacity: int, paths: tuple[str, str | None], end_id: int = 2, special: bool = False) -> DataFrame:
    """One row a piece; ``block`` is the task that made it, ``own`` its rank there among the pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoder(paths, special), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in slices(batches, 4096, "text", 4 << 20):
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "own")}
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                raw = np.array([*ids, end_id], "<u4")
                for number, (start, length) in enumerate(cut(len(raw), capacity)):
                    for name, value in zip(out, (doc, number, start, length, zlib.crc32(raw[start : start + length].tobytes()), seen[length])):
                        out[name].append(value)
                    seen[length] += 1
            kinds = [pa.int32() if name in ("piece", "block") else pa.int64() for name in (*out, "block")]
            out["block"] = [part] * len(out["doc_id"])
            columns = {name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)}
            yield pa.RecordBatch.from_pydict({name: columns[name] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "block", "own")})

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


def fullest(counts: list[int], room: int, slack: int = 0) -> list[tuple[int, int]]:
    """The combination of available lengths with the largest sum up to ``room``: (length, how many).

    ``counts[l]`` pieces of length l are available.  Lengths are offered from the longest; bit s of ``reach[i]`` says
    whether the first i offers can sum to s.  Copies of a length are offered in powers of two.  No shorter lengths are
    offered once a sum within ``slack`` of the room is in reach, which saves the short pieces for later.
    """
    target = (1 << (room + 1)) - 1
    offers, reach = [], [1]
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, step = min(counts[length], room // length), 1
        while left:
            many = min(step, left)
            offers.append((length, many))
            reach.append((reach[-1] | reach[-1] << length * many) & target)
            left -= many
            step *= 2
        if reach[-1] >> max(room - slack, 0):
            break
    total = reach[-1].bit_length() - 1
    used: dict[int, int] = {}
    for (length, many), before in zip(reversed(offers), reversed(reach[:-1])):
        if not before >> total & 1:
            total -= length * many
            used[length] = used.get(length, 0) + many
    return sorted(used.items(), reverse=True)


#: Slacks that are tried; the plan with the fewest sequences is taken.
SLACKS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def best_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The shortest of the plans for several slacks."""
    return min((plan(histogram, capacity, slack) for slack in SLACKS if slack < capacity), key=lambda steps: sum(repeats for repeats, _ in steps))


def plan(histogram: dict[int, int], capacity: int, slack: int = 0) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(repeats, combination) until every piece is placed; a combination is ((length, how many), ...)."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            found = dict(fullest(counts, capacity - longest, slack))
            counts[longest] += 1
            found[longest] = found.get(longest, 0) + 1
            repeats = min(counts[length] // n for length, n in found.items())
            for length, n in found.items():
                counts[length] -= n * repeats
            out.append((repeats, tuple(sorted(found.items(), reverse=True))))
    return out


class Places:
    """Where the r-th piece of a length goes, from a plan."""

    def __init__(self, steps: list[tuple[int, tuple[tuple[int, int], ...]]]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        first, taken = 0, {}
        for repeats, combination in steps:
            offset = 0
            for length, n in combination:
                rank = taken.get(length, 0)
                rows.setdefault(length, []).append((rank, n, first, offset))
                taken[length] = rank + n * repeats
                offset += n * length
            first += repeats
        self.sequences = first
        self.rows = {length: np.array(found, np.int64).T for length, found in rows.items()}

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            starts, many, first, base = self.rows[length]
            step = np.searchsorted(starts, ranks[mine], "right") - 1
            turn = ranks[mine] - starts[step]
            sequence[mine] = first[step] + turn // many[step]
            offset[mine] = base[step] + turn % many[step] * length
        return sequence, offset


def pack(documents: DataFrame, capacity: int = 1024, paths: tuple[str, str | None] | None = None, end_id: int = 2, special: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    ``special``: strings of special tokens in a text are those tokens, else ordinary text.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "packing")
    made = scratch.save(pieces(documents, capacity, paths or vocabulary_paths(), end_id, special), "pieces")
    counts = scratch.save(made.groupBy("length", "block").agg(F.count("*").alias("n")), "counts")
    # at most `capacity` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(best_plan(histogram, capacity)))
    starts = block_starts(counts, "length", "block", "n")
    ranked = made.join(starts, ["length", "block"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = places.value
        for batch in batches:
            take = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            sequence, offset = where(take("length"), take("own") + take("before"))
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    return ranked.select(*columns, "own", "before").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def block_starts(counts: DataFrame, key: str, block: str, n: str, buckets: int = 1024) -> DataFrame:
    """``before``: the sum of ``n`` over the smaller blocks of the same key, in two levels so that no key is one task.

    Blocks fall into ranges by value; ranges are totalled first and each range is then summed within itself.
    """
    by = Window.partitionBy(key, "range_").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.withColumn("range_", F.floor(F.col(block) / buckets))
    totals = ranges.groupBy(key, "range_").agg(F.sum(n).alias("t_"))
    over = Window.partitionBy(key).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "range_", F.coalesce(F.sum("t_").over(over), F.lit(0)).alias("base_"))
    return ranges.join(totals, [key, "range_"]).select(key, block, (F.col("base_") + F.coalesce(F.sum(n).over(by), F.lit(0))).alias("before"))
