"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprint: words of the text with A-Z lower-cased, shingles of ``size`` words joined by a space (fewer words: the
whole sequence), each hashed with XXH64 (seed 42); a bit is set if it is set in over half of the hashes.

Links: two fingerprints that differ in at most 3 of 64 bits.  The 64 bits form a ring of 8 segments of 8 bits.  By the
pigeonring principle some start exists from which every chain of l consecutive segments differs in at most
3 * l / 8 bits: no difference in the first two segments and at most one in the first five.  So two of the segments
3, 4 and 5 of the chain are equal, and with the first two they give a key of 32 equal bits: 8 starts times 3
pairs are 24 keys a fingerprint.  Within a key the whole chain test prunes, then the Hamming test confirms.

Scale: fingerprints are made in one scan; equal ones are collapsed (with map-side combining) before any key is dealt,
so a group of copies counts once.  Keys are dealt by hash and streamed in sorted runs.  A run longer than ``most``
is not compared there: its rows get a longer key for each of 4 parts of the bits that the key leaves open (3
differences leave one part equal) and are dealt again; after two such rounds a still longer run is settled by looking up
all neighbours within 3 of the open bits, a fixed number for each fingerprint.  No run makes all its pairs, only the
links of a spanning forest leave it.  Components come from rounds of min-label contraction over the links between
representatives, each written to the shared folder; nothing is collected.

Defined cases: null, empty or wordless text has fingerprint zero and links like any other; repeated rows share a
fingerprint; ties go to the smallest doc_id; rows with a null doc_id get a fingerprint but can't be the name of a
component (their component_id is that of their fingerprint, null if no other row has one); other columns are not read.

Another text under a doc_id that a dropped copy bears stays.  :func:`near_copies` links by similarity instead, and prunes by the same chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import shielded, slices, utf8_list

SEED, BITS, SEGMENTS, WIDTH = 42, 64, 8, 8


def fingerprint(text: bytes, size: int = 3) -> int:
    """The 64-bit fingerprint of a text."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only \x20 and \x09-\x0D divide
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        whole, ends, at = b" ".join(words), [], -1
        for word in words:
            at += len(word) + 1
            ends.append(at)
        starts = [0] + [end + 1 for end in ends[: 1 - size - 1]]
        shingles = [whole[a:b] for a, b in zip(starts, ends[size - 1 :])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, ``row_`` (hash of the text as it is) and the fingerprint as a signed long, one row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, "text", 4 << 20):
            values = np.array([fingerprint(t, size) for t in utf8_list(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("row_"), pa.array(values.view(np.int64))], names=["doc_id", "row_", "fp"])

    return _rows(documents).mapInArrow(run, "doc_id long, row_ long, fp long")


def chain_masks() -> list[int]:
    """The bits of each of the 24 keys: two consecutive segments and two of the three that follow."""
    segment = [((1 << WIDTH) - 1) << (WIDTH * (SEGMENTS - 1 - i)) for i in range(SEGMENTS)]
    ring = lambda i: segment[i % SEGMENTS]
    return [ring(i) | ring(i + 1) | ring(i + a) | ring(i + b) for i in range(SEGMENTS) for a, b in ((2, 3), (2, 4), (3, 4))]


def finer_masks(mask: int, parts: int = 4) -> list[int]:
    """``mask`` with each of ``parts`` parts of the bits that it leaves open."""
    open_bits = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in open_bits[i::parts]) for i in range(parts)]


def masks_at(depth: int) -> list[int]:
    """The masks of a round; a row's number there is its parent's times 4 plus the part."""
    masks = chain_masks()
    for _ in range(depth):
        masks = [finer for mask in masks for finer in finer_masks(mask)]
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def chain_ok(diff: np.ndarray, start: int) -> np.ndarray:
    """Whether, from segment ``start``, each chain of l segments differs in at most 3 * l / 8 bits."""
    total, fine = np.zeros(len(diff), np.int64), np.ones(len(diff), bool)
    for step in range(SEGMENTS):
        shift = np.uint64(WIDTH * (SEGMENTS - 1 - (start + step) % SEGMENTS))
        total += _popcount((diff >> shift) & np.uint64((1 << WIDTH) - 1))
        fine &= total * SEGMENTS <= 3 * (step + 1)
    return fine


class _Forest:
    """Union-find over the positions of one run."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def short_run_links(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a run, by comparing it with itself shifted."""
    forest, links, n = _Forest(len(fps)), [], len(fps)
    for lag in range(1, n):
        diff = fps[lag:] ^ fps[:-lag]
        for i in np.flatnonzero(chain_ok(diff, start) & (_popcount(diff) <= 3)).tolist():
            if forest.join(i, i + lag):
                links.append((i, i + lag))
    return links


def long_run_links(fps: np.ndarray, mask: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in a sorted run, by looking up each neighbour within the open bits."""
    bits = [np.uint64(1 << b) for b in range(BITS) if not mask >> b & 1]
    forest, links = _Forest(len(fps)), []

    def probe(flip: np.uint64) -> None:
        wanted = fps ^ flip
        at = np.minimum(np.searchsorted(fps, wanted), len(fps) - 1)
        for i in np.flatnonzero((fps[at] == wanted) & (wanted > fps)).tolist():
            if forest.join(i, int(at[i])):
                links.append((i, int(at[i])))

    for i, a in enumerate(bits):
        probe(a)
        for j in range(i):
            probe(a | bits[j])
            for k in range(j):
                probe(a | bits[j] | bits[k])
    return links


LINKS = "kind int, a long, b long"


def _runs(depth: int, most: int, final: bool):
    """Reads rows (kind = number of the mask, key, fp) in sorted runs; yields links (kind -1) and, of runs too long, the rows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = masks_at(depth)

        def out(kinds, a, b):
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

        def again(kind, fps):
            for part in range(4):
                yield out(np.full(len(fps), kind * 4 + part, np.int32), fps.view(np.int64), np.zeros(len(fps), np.int64))

        def settle(kind, fps):
            fps = np.unique(fps)
            if len(fps) <= most:
                links = short_run_links(fps, kind // (3 * 4**depth))
            elif final:
                links = long_run_links(fps, masks[kind])
            else:
                yield from again(kind, fps)
                return
            if links:
                signed = fps.view(np.int64)
                pairs = np.array(links)
                yield out(np.full(len(pairs), -1, np.int32), signed[pairs[:, 0]], signed[pairs[:, 1]])

        held, kind_held, key_held, spilled = [], None, None, False
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            # runs of one row inside the batch link nothing
            busy = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(keys))).tolist() if len(keys) else []
            for at in busy:
                start, end = int(starts[at]), int(ends[at])
                kind, key = int(kinds[start]), int(keys[start])
                if (kind, key) != (kind_held, key_held):
                    if held and not spilled:
                        yield from settle(kind_held, np.concatenate(held))
                    elif held:
                        yield from again(kind_held, np.concatenate(held))
                    held, kind_held, key_held, spilled = [], kind, key, False
                held.append(fps[start:end])
                if not final and sum(map(len, held)) > 4 * most:  # pass a long run on without holding it
                    yield from again(kind_held, np.unique(np.concatenate(held)))
                    held, spilled = [], True
        if held:
            yield from again(kind_held, np.concatenate(held)) if spilled else settle(kind_held, np.concatenate(held))

    return run


def links_between(distinct: DataFrame, scratch: Scratch, most: int = 256, depth: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect all that differ in 3 bits or fewer."""
    rows = distinct.select("fp", F.lit(0).alias("parent"))
    found = None
    for level in range(depth + 1):
        masks = [_signed(m) for m in masks_at(level)]
        if level == 0:
            pairs = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
            dealt = rows.select("fp", F.explode(pairs).alias("p")).select(F.col("p.kind").alias("kind"), F.col("p.key").alias("key"), "fp")
        else:
            table = F.array(*[F.lit(m) for m in masks])
            dealt = rows.select("kind", F.col("fp").bitwiseAND(F.get(table, F.col("kind"))).alias("key"), "fp")
        runs = dealt.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp").mapInArrow(_runs(level, most, level == depth), LINKS)
        runs = scratch.save(runs, f"runs{level}")
        links = runs.where("kind = -1").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = runs.where("kind >= 0").select("kind", F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    return found


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable, for every node that has a link.  Nodes are of any type with an order.

    Alternates large-star and small-star steps, each two shuffles of the remaining links.
    """
    spark = links.sparkSession
    edges = scratch.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges0")
    before = None
    for turn in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large-star: every larger neighbour of u goes to the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, f"large{turn}")
        # small-star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = scratch.save(small, f"edges{turn}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"large{turn}")
        scratch.drop(f"edges{turn - 1}")
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(documents: DataFrame, size: int = 3, most: int = 256, rows: bool = False) -> DataFrame:
    """Per row: doc_id, ``fp`` (signed long) and ``component_id``, the smallest doc_id reachable by links; ``rows``: and group_ and row_ as of :func:`near_copies`."""
    scratch = Scratch(documents.sparkSession, "simhash")
    prints = scratch.save(fingerprints(documents, size), "prints")
    named = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "named")
    links = links_between(named.where("rep is not null").select("fp"), scratch, most)
    groups = _components_of(links, named, scratch, "groups")
    more = [F.coalesce("group_", "fp").alias("group_"), "row_"] if rows else []
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id", *more)


def hex_digits(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


#: The rule of :func:`near_copies`: shared shingles of all, 4 of 5; minima of 32 bands of 4.
SHARED, ALL, BANDS, ROWS = 4, 5, 32, 4
_MINIMA = np.random.default_rng(SEED).integers(1, 1 << 63, (3, BANDS * ROWS), dtype=np.uint64)
#: The stage's fingerprint: a ring of segments of 64 bits, and the differences that a pair may have.  Sets of similarity 0.8 differ in 78 of
#: 512 bits on average (standard deviation 8); 122 lie over five deviations off.  Sets of fewer than ``FEW`` shingles are not filtered.
RING, BUDGET, FEW = 8, 122, 16


def shingles(text: bytes, size: int) -> set[bytes]:
    """The distinct shingles of ``size`` words (fewer words: the whole sequence; no words: none)."""
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _hashes(found: set[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in found), np.uint64, len(found))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima; sets of similarity j share a band with probability 1 - (1 - j ** 4) ** 32."""
    flips, odd, mixes = _MINIMA[0][:, None], _MINIMA[1][:, None] | np.uint64(1), (_MINIMA[2] | np.uint64(1)).reshape(BANDS, ROWS)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[at : at + 4096] ^ flips) * odd).min(axis=1))
    least ^= least >> np.uint64(31)
    key = (least.reshape(BANDS, ROWS) * mixes).sum(axis=1, dtype=np.uint64)
    return key ^ (key >> np.uint64(29)) ^ np.arange(BANDS, dtype=np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """The 512 bits of a set of shingles, by the rule of :func:`fingerprint`: the segments of the ring one after the other."""
    votes = np.zeros(64 * RING, np.int64)
    seeds = np.arange(1, RING + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # 255 votes fit a byte
        mixed = (hashes[at : at + 255, None] ^ seeds) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        votes += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def _wide(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of words, a segment each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, RING)


def ring_ok(one: np.ndarray, two: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Whether fingerprints (rows of words) differ by no more than the budget.

    From some start on the ring of segments, each chain of l segments must differ in at most ``budget`` * l / ``RING`` bits; the
    full Hamming check is made of those that have such a start.
    """
    parts = _popcount(one ^ two).astype(np.int64)
    fine = np.zeros(len(parts), bool)
    for start in range(RING):
        chains = np.cumsum(np.roll(parts, -start, axis=1), axis=1)
        fine |= (chains * RING <= budget * np.arange(1, RING + 1)).all(axis=1)
    fine[fine] = parts[fine].sum(axis=1) <= budget
    return fine


def _name(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(text.lower().split()), SEED)


def _sketches(documents: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, ``row_`` (hash of the text as it is), ``fp`` (hash of all words), ``n`` (distinct shingles), the wide fingerprint and band ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, "text", 4 << 20):
            texts = utf8_list(batch.column("text"))
            hashes = [_hashes(shingles(t, size)) for t in texts]
            keys = pa.array([band_keys(h).view(np.int64) if len(h) else [] for h in hashes], pa.list_(pa.int64()))
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("row_"), pa.array([_name(t) for t in texts], pa.binary()), pa.array([len(h) for h in hashes], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(map(wide_fingerprint, hashes), pa.binary()), keys], names=["doc_id", "row_", "fp", "n", "wide", "keys"])

    return _rows(documents).mapInArrow(run, "doc_id long, row_ long, fp binary, n int, wide binary, keys array<long>")


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("row_"), "text")


CANDIDATES = "key long, many long, a binary, b binary"


def _close(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of rows (key, many, a, b) those whose sizes and fingerprints allow a similarity of 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = np.minimum(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))) < FEW
            keep = few | ring_ok(_wide(batch.column("wide")), _wide(batch.column("wide2")))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "many", "a", "b")], names=["key", "many", "a", "b"]).filter(pa.array(keep))

    one = marks.select(F.col("fp").alias("a"), "n", "wide")
    two = marks.select(F.col("fp").alias("b"), F.col("n").alias("m"), F.col("wide").alias("wide2"))
    both = pairs.join(one, "a").join(two, "b").where(f"{ALL} * least(n, m) >= {SHARED} * greatest(n, m)")
    return both.select("key", "many", "a", "b", "n", "m", "wide", "wide2").mapInArrow(run, CANDIDATES)


def _mixed_runs(rows: DataFrame) -> DataFrame:
    """The rows (key, band, fp, group_) of runs that hold several groups, with the shingles of the run and ``out``, whether a row lies outside the largest group."""
    largest = rows.groupBy("key", "group_").agg(F.count("*").alias("size"), F.sum("n").alias("total")).groupBy("key")
    largest = largest.agg(F.max_by("group_", F.struct("size", "group_")).alias("main"), F.sum("total").alias("total"), F.count("*").alias("groups")).where("groups > 1")
    return rows.join(largest, "key").select("key", "band", "fp", "group_", "total", (F.col("group_") != F.col("main")).alias("out"))


def _outside(rows: DataFrame, named: DataFrame, sets: DataFrame, held_bytes: int = 32 << 20) -> DataFrame:
    """Links (a, b) that connect the rows outside the largest group of their run with all rows of the run in other groups.

    Chains and the Hamming check prune, then shingles are compared.  Both sides of a run are dealt into parts of about ``held_bytes``
    of shingle hashes, and a task holds two parts at a time.  A pair is tried in the first band that it shares only, and only the
    links of a spanning forest of the groups leave a task.
    """
    parts = F.ceil(8 * F.col("total") / held_bytes).cast("int")
    marked = rows.join(named.select("fp", "n", "wide", "keys"), "fp").join(sets, "fp")
    every = F.sequence(F.lit(0), parts - 1)
    own = F.pmod(F.hash("fp"), parts)
    columns = ("key", "band", "fp", "group_", "out", "n", "wide", "keys", "hashes")
    query = marked.where("out").select(*columns, F.lit(0).alias("side"), own.alias("i"), F.explode(every).alias("j"))
    other = marked.select(*columns, F.lit(1).alias("side"), own.alias("j"), F.explode(every).alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        block_of, found = None, []

        def settle() -> None:
            if held[0] and held[1]:
                one, two = ([np.concatenate(c) for c in zip(*side)] for side in held)
                (fps, groups, _, sizes, wide, keys, sets1), (fps2, groups2, out2, sizes2, wide2, keys2, sets2) = one, two
                numbers = {g: i for i, g in enumerate({*groups, *groups2})}
                groups, groups2 = (np.array([numbers[g] for g in x]) for x in (groups, groups2))
                flat = [np.frombuffer(x, "<u8") for x in (*sets1, *sets2)]
                ids = np.unique(np.concatenate(flat), return_inverse=True)[1]  # shingles by number
                cuts = np.cumsum([0, *map(len, flat)])
                starts, starts2, seen = cuts[: len(fps)], cuts[len(fps) :], np.zeros(len(ids) + 1, bool)
                for at in range(len(fps)):
                    near = (groups2 != groups[at]) & (ALL * np.minimum(sizes2, sizes[at]) >= SHARED * np.maximum(sizes2, sizes[at]))
                    near &= ~out2 | (fps2 > fps[at])  # of two such rows one asks
                    near = np.flatnonzero(near)
                    near = near[~(keys2[near, : block_of[3]] == keys[at, : block_of[3]]).any(axis=1)]
                    near = near[(np.minimum(sizes2[near], sizes[at]) < FEW) | ring_ok(wide2[near], wide[at])]
                    if not len(near):
                        continue
                    inside = ids[starts[at] : starts[at] + sizes[at]]
                    seen[inside] = True
                    totals = np.append(0, np.cumsum(seen[ids[starts2[0] :]]))
                    seen[inside] = False
                    both = totals[starts2[near + 1] - starts2[0]] - totals[starts2[near] - starts2[0]]
                    for k in near[ALL * both >= SHARED * (sizes[at] + sizes2[near] - both)].tolist():
                        if groups2[k] != groups[at]:
                            found.append((fps[at], fps2[k]))
                            gone = groups2[k]
                            groups[groups == gone] = groups2[groups2 == gone] = groups[at]
            held[0].clear()
            held[1].clear()

        for batch in batches:
            value = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            raw = lambda c: np.array([*batch.column(c).to_pylist(), None], object)[:-1]  # noqa: E731, B023
            heads = [value(c) for c in ("key", "i", "j", "band")]
            side, columns = value("side"), [raw("fp"), raw("group_"), value("out"), value("n"), _wide(batch.column("wide")), batch.column("keys").flatten().to_numpy().reshape(-1, BANDS), raw("hashes")]
            cuts = (np.flatnonzero(np.any([c[1:] != c[:-1] for c in (*heads[:3], side)], axis=0)) + 1).tolist() if len(side) else []
            for start, end in zip([0, *cuts], [*cuts, len(side)]):
                if start == end:
                    continue
                here = tuple(int(c[start]) for c in heads)
                if here != block_of:
                    settle()
                    block_of = here
                held[int(side[start])].append([x[start:end] for x in columns])
            if found:
                yield _pair_rows(found)
        settle()
        if found:
            yield _pair_rows(found)

    return query.unionByName(other).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, "a binary, b binary")


def _pair_rows(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """The pairs as a batch; empties the list."""
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])
    found.clear()
    return batch


def _similar(pairs: DataFrame, sets: DataFrame, block: int = 512) -> DataFrame:
    """The pairs (a, b), of rows (key, many, a, b), whose sets ``hashes`` of shingles are similar enough.

    A set goes once to each block of its run that compares it: both sides of a run of ``many`` are dealt into parts of about
    ``block``, so a task holds two parts at a time.
    """
    parts = F.ceil(F.col("many") / block)
    dealt = pairs.select("key", F.pmod(F.hash("a"), parts).alias("i"), F.pmod(F.hash("b"), parts).alias("j"), "a", "b")
    wanted = dealt.select("key", "i", "j", F.col("a").alias("fp")).union(dealt.select("key", "i", "j", F.col("b").alias("fp"))).distinct()
    rows = wanted.join(sets, "fp").select("key", "i", "j", F.lit(0).alias("kind"), F.col("fp").alias("a"), F.lit(None).cast("binary").alias("b"), "hashes")
    rows = rows.unionByName(dealt.select("key", "i", "j", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("hashes")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, np.ndarray] = {}
        block_of, open_pairs, good = None, [], []

        def settle() -> None:
            if not open_pairs:
                own.clear()
                return
            at = {name: i for i, name in enumerate(own)}
            sizes = np.array([len(x) for x in own.values()])
            ids = np.unique(np.concatenate(list(own.values())), return_inverse=True)[1]  # shingles by number
            starts = np.cumsum(sizes) - sizes
            first, second = (np.array([at[x] for x in side]) for side in zip(*open_pairs))
            marked = np.zeros(len(ids) + 1, bool)
            order = np.argsort(first, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(first[order]) > 0))
            for mine in np.split(order, cuts[1:]):
                i = first[mine[0]]
                inside = ids[starts[i] : starts[i] + sizes[i]]
                marked[inside] = True
                totals = np.append(0, np.cumsum(marked[ids]))
                marked[inside] = False
                j = second[mine]
                both = totals[starts[j] + sizes[j]] - totals[starts[j]]
                fine = ALL * both >= SHARED * (sizes[i] + sizes[j] - both)
                good.extend(open_pairs[k] for k in mine[fine].tolist())
            own.clear()
            open_pairs.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "kind", "a", "b", "hashes")]
            for key, i, j, kind, one, two, raw in zip(*columns):
                if (key, i, j) != block_of:
                    settle()
                    block_of = (key, i, j)
                if kind:
                    open_pairs.append((one, two))
                else:
                    own[one] = np.frombuffer(raw, "<u8")
            if good:
                yield _pair_rows(good)
        settle()
        if good:
            yield _pair_rows(good)

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "kind").mapInArrow(run, "a binary, b binary")


def near_copies(documents: DataFrame, size: int = 5, most: int = 4) -> DataFrame:
    """Per row: doc_id, ``row_`` (hash of its text), ``group_`` (any name of its group) and ``component_id``, the smallest doc_id there.

    Groups are what links of similar texts connect; texts are told apart by themselves, whatever doc_ids they bear.

    A link: four fifths of the distinct shingles of two texts are shared (Jaccard), or all words are equal.  Equal texts are collapsed.
    Texts that share one of 32 bands of 4 minima form a run (a pair at the limit shares none with a probability of 5e-8).  Within a
    run pigeonring chains over a 512-bit fingerprint prune, the Hamming check follows, and what is left is compared shingle by shingle.

    A run of more than ``most`` rows is first compared with one of its rows, another one in each band, and the links make
    groups.  Then the rows that this leaves outside the largest group of their run are compared with all rows of the run in
    other groups, block by block.  So no link is lost, and no run makes the pairs within its groups.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    prints = scratch.save(_sketches(documents, size), "prints")
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "wide", "keys")]).where("rep is not null")
    named = scratch.save(named, "named")
    dealt = named.select("fp", F.posexplode("keys").alias("band", "key"))
    lead = F.min(F.struct(F.xxhash64("fp", "key").alias("h"), "fp"))["fp"]
    runs = dealt.groupBy("key").agg(lead.alias("lead"), F.count("*").alias("many")).where("many > 1")
    held = scratch.save(dealt.join(runs, "key"), "held")
    short = held.where(F.col("many") <= most)
    pairs = short.select("key", "many", F.col("fp").alias("a")).join(short.select("key", F.col("fp").alias("b")), "key").where("a < b").select("key", "many", "a", "b")
    stars = held.where((F.col("many") > most) & (F.col("fp") != F.col("lead"))).select("key", "many", F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b"))
    pairs = pairs.union(stars).dropDuplicates(["a", "b"])  # each pair in one of its runs
    pairs = scratch.save(_close(pairs, named.select("fp", "n", "wide")), "pairs")
    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp")))
    links = scratch.save(_similar(pairs, _sets_of(wanted, documents, named, size, scratch, "sets")), "links")
    groups = _components_of(links, named, scratch, "groups")
    rows = held.where(F.col("many") > most).join(groups, "fp").join(named.select("fp", "n"), "fp").select("key", "band", "fp", "group_", "n")
    rows = scratch.save(_mixed_runs(rows), "rows")
    more = scratch.save(_outside(rows, named, _sets_of(rows, documents, named, size, scratch, "sets2")), "more")
    if not more.isEmpty():
        groups = _components_of(links.union(more), named, scratch, "groups2")
    for name in ("sets", "sets2", "held", "rows"):
        scratch.drop(name)
    return prints.join(groups, "fp", "left").select("doc_id", "row_", F.coalesce("group_", "fp").alias("group_"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _sets_of(wanted: DataFrame, documents: DataFrame, named: DataFrame, size: int, scratch: Scratch, name: str) -> DataFrame:
    """fp and the ``hashes`` of the shingles (8 bytes each) of all ``fp`` that are wanted."""
    wanted = wanted.select("fp").distinct()
    wanted = scratch.save(wanted.join(named.select("fp", "rep"), "fp"), f"{name}-wanted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, "text", 4 << 20):
            texts = utf8_list(batch.column("text"))
            sets = [_hashes(shingles(t, size)).astype("<u8").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([_name(t) for t in texts], pa.binary()), pa.array(sets, pa.binary())], names=["fp", "hashes"])

    # by doc_id first, which reads no text of the rest; a doc_id may have other texts as well
    texts = documents.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    return scratch.save(texts.mapInArrow(hashed, "fp binary, hashes binary").join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), name)


def _components_of(links: DataFrame, named: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """fp, ``group_`` (the least name that links (a, b) reach) and ``component_id`` (the smallest ``rep`` there) of all that are named."""
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), Scratch(links.sparkSession, "simhash"))
    grouped = named.select("fp", "rep").join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("group_", F.coalesce("component", "fp"))
    least = grouped.where("component is not null or rep is not null").groupBy("group_").agg(F.min("rep").alias("component_id"))
    return scratch.save(grouped.join(least, "group_", "left").select("fp", "group_", "component_id"), name)


def one_of_each_group(documents: DataFrame, size: int = 3) -> DataFrame:
    """One document, with the smallest doc_id, of each group of linked fingerprints (see :func:`_first_of_each`)."""
    return shielded(documents, ("row_",), lambda plain: _first_of_each(plain, near_duplicates(plain, size, rows=True)))


def without_near_copies(documents: DataFrame, size: int = 5, most: int = 4) -> DataFrame:
    """One document, with the smallest doc_id, of each group of near copies (see :func:`near_copies`)."""
    return shielded(documents, ("row_",), lambda plain: _first_of_each(plain, near_copies(plain, size, most)))


def _first_of_each(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Of a group the row with the smallest doc_id, and of several of that the one with the least hash of its text, stays.

    A row is known by its doc_id and text, so an unrelated text under the doc_id of a dropped copy stays; equal rows are one.  Rows
    with a null doc_id have no name to be dropped by and stay.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    counted = groups.where("doc_id is not null").groupBy("group_", "component_id", "doc_id", "row_").agg(F.count("*").alias("n"))
    counted = scratch.save(counted, "rows")
    # only rows with the smallest doc_id are compared, nearly always one a group
    first = counted.where("doc_id = component_id")
    other = first.join(first.groupBy("group_").agg(F.min("row_").alias("first")), "group_").where("row_ != first")
    later = counted.where("doc_id != component_id").select("doc_id", "row_").union(other.select("doc_id", "row_")).distinct()
    named = documents.withColumn("row_", F.xxhash64("text"))
    names = [F.col(f"`{c}`") for c in documents.columns]
    kept = named.join(later, ["doc_id", "row_"], "left_anti")
    twice = counted.where("n > 1").select("doc_id", "row_").distinct()
    if twice.isEmpty():
        return kept.select(*names)
    # a table per kind of row: only repeated rows are dealt anew
    once = kept.join(twice, ["doc_id", "row_"], "left_anti")
    return once.unionByName(kept.join(twice, ["doc_id", "row_"], "left_semi").dropDuplicates(["doc_id", "row_"])).select(*names)
