"""Toxicity by compression distance between two zstandard dictionaries.

Windows are the words of a text, each written in a code of two bytes a character: the character, and a mix of it with the
one before.  A short word is then dear to spell out and cheap to point at, so that what a dictionary knows shows in the
compressed length of a single word.

Training (on the driver, from a bounded sample of labelled texts): a base dictionary is trained on ordinary text.  The
words of either kind that it explains worst for their length (all but the ``cheap`` share) train the two extensions, one on toxic and one on ordinary
text; each goes behind the same base, so that both dictionaries see common words alike.  Further rounds train them on what
the pair before tells apart: of each toxic text the words that speak most for toxic (all dear ones if none does), of
each ordinary text those that wrongly do.

Scoring: each window of the whole text is compressed with either dictionary; the difference of the lengths is looked up in a
table of log likelihood ratios; the sum, as it is and for the length of the text, goes through a logistic curve.  Both were calibrated on texts of the
sample that no dictionary saw, and the curve's offset follows the share of toxic labels.

Scale: the sample is at most ``most_toxic`` and ``most_ordinary`` labelled ids, chosen by hash from the labels alone, of texts up
to ``longest`` bytes; the model is a few hundred KB and goes to each task with the code.  Scoring is one scan without a
shuffle; a task remembers the differences of up to ``KNOWN`` words.

Defined cases: null or empty text has no windows and scores like a difference of zero (the calibrated prior); without labels of
both kinds all scores are 0; repeated rows score alike; labels of ids that are not in the corpus, null labels and ids with labels of
both kinds are skipped; rows with a null doc_id are scored, never learnt from; an empty table gives no row; a text of any length is
scored in whole; other columns, whatever their names, are not read.

The options were chosen by cross-validation within the rows that may be learnt from; no held-out row had a part in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_list

LOW, HIGH, KNOWN = -8, 12, 400_000
_CODE = [bytes([pair & 255, (pair >> 8) * 151 + (pair & 255) * 211 + ((pair >> 8) ^ (pair & 255)) * 7 & 255]) for pair in range(1 << 16)]


def windows(text: bytes, size: int = 32) -> list[bytes]:
    """The lower-cased words of a text; a word of more than twice ``size`` bytes is cut into pieces of that length."""
    found = text.lower().split()
    if found and max(map(len, found)) > 2 * size:
        return [piece for word in found for piece in ([word] if len(word) <= 2 * size else [word[at : at + size] for at in range(0, len(word), size)])]
    return found


def coded(text: bytes) -> bytes:
    """Two bytes a character, as if after a space."""
    return b"".join([_CODE[before << 8 | here] for before, here in zip(b" " + text, text)])


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    table: np.ndarray  # log likelihood ratio of each difference from LOW to HIGH
    weights: np.ndarray  # of the features of a text's evidence
    level: int

    def differences(self):
        """A function from windows to their differences in compressed length; above zero speaks for toxic."""
        toxic, ordinary = compressor(self.toxic, self.level), compressor(self.ordinary, self.level)
        known: dict[bytes, int] = {}

        def measure(found: list[bytes]) -> list[int]:
            out = []
            for window in found:
                value = known.get(window)
                if value is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    raw = coded(window + b" ")
                    value = known[window] = len(ordinary(raw)) - len(toxic(raw))
                out.append(value)
            return out

        return measure

    def evidence(self, differences: list[int]) -> float:
        return float(self.table[np.clip(np.array(differences, np.int64), LOW, HIGH) - LOW].sum()) if differences else 0.0

    def features(self, differences: list[int]) -> list[float]:
        """The evidence, the evidence for the length, the length and a constant."""
        total, n = self.evidence(differences), len(differences)
        return [total, total / float(np.sqrt(n + 1)), float(np.log1p(n)), 1.0]

    def probability(self, differences: list[int]) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.weights @ np.array(self.features(differences)), -500, 500))))


def compressor(dictionary: bytes, level: int):
    shape = zstandard.ZstdCompressionParameters.from_level(level, source_size=80, dict_size=len(dictionary), write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=shape).compress


def _trained(texts: list[list[bytes]], size: int, **shape: int) -> bytes:
    """A dictionary trained on lists of words, or where there is too little to train on, the words themselves as raw content."""
    samples = [coded(b" " + b" ".join(words) + b" ") for words in texts if words]
    try:
        return zstandard.train_dictionary(size, samples, **shape).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:] or bytes(16)


def train(toxic: list[bytes], ordinary: list[bytes], share: float | None = None, level: int = 12, base_bytes: int = 64 << 10, own_bytes: int = 6 << 10, segment: int = 40, cheap: float = 0.35, rounds: int = 6) -> Model | None:
    """A model from texts of both kinds; every fourth text of a kind is kept for the calibration.

    ``share`` is the share of toxic texts that the scores should assume (default: as in the sample).
    """
    if not toxic or not ordinary:
        return None
    one: dict[bytes, bytes] = {}  # equal words share an object
    parts = {k: [[one.setdefault(w, w) for w in windows(t)] for t in texts] for k, texts in ((1, toxic), (0, ordinary))}
    learn = {k: [w for i, w in enumerate(v) if i % 4 or len(v) < 8] for k, v in parts.items()}
    held = {k: [w for i, w in enumerate(v) if not i % 4 or len(v) < 8] for k, v in parts.items()}
    half = len(learn[0]) // 2 or 1
    fresh = learn[0][half:] or learn[0]  # ordinary texts that the base has not seen
    base = _trained(learn[0][:half], base_bytes)
    plain, costs = compressor(base, level), {}

    def dear(word: bytes) -> float:
        """Compressed bytes a character of a word under the base."""
        if word not in costs:
            costs[word] = len(plain(coded(word + b" "))) / (len(word) + 1) if len(word) > 2 else 0.0
        return costs[word]

    rates = [dear(w) for text in fresh for w in text]
    limit = float(np.quantile(rates, cheap)) if rates else 0.0
    chosen = {k: [[w for w in text if dear(w) >= limit] for text in texts] for k, texts in ((1, learn[1]), (0, fresh))}
    for turn in range(rounds):
        extended = {k: base + _trained(chosen[k], own_bytes, k=segment, d=8)[-(own_bytes - 2048) :] for k in (1, 0)}
        model = Model(extended[1], extended[0], np.zeros(HIGH - LOW + 1), np.zeros(4), level)
        measure = model.differences()
        if turn + 1 < rounds:

            def best(text: list[bytes]) -> list[bytes]:
                found = measure(text)
                order = sorted(range(len(text)), key=lambda i: -found[i])[: max(3, len(text) // 50)]
                return [text[i] for i in order if found[i] > 0]

            def telling(text: list[bytes]) -> list[bytes]:
                """The best words of a toxic text; all dear ones if none of them tells it apart yet."""
                return best(text) if max(measure(text), default=0) >= 4 else [w for w in text if dear(w) >= limit]

            chosen = {1: [telling(t) for t in learn[1]], 0: [best(t) for t in learn[0]] + chosen[0][: len(chosen[0]) // 2]}
    found = {k: [measure(t) for t in held[k]] for k in (1, 0)}
    counts = {k: np.bincount(np.clip([x for d in found[k] for x in d], LOW, HIGH).astype(np.int64) - LOW, minlength=HIGH - LOW + 1) + 1.0 for k in (1, 0)}
    table = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    model = Model(model.toxic, model.ordinary, table, np.zeros(4), level)
    features = np.array([model.features(d) for k in (1, 0) for d in found[k]])
    weights = logistic(features, np.array([k for k in (1, 0) for _ in held[k]], float))
    if share is not None and 0 < share < 1:
        weights[-1] += float(np.log(share / (1 - share)) - np.log(len(held[1]) / len(held[0])))
    return Model(model.toxic, model.ordinary, table, weights, level)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights of a logistic curve over features (the last one constant), by Newton's method with a slight pull to zero."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    design, weights, pull = x / scale, np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + pull, design.T @ (y - p) - pull @ weights)
        weights = weights + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return weights / scale


def remainder(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, modulo 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(documents: DataFrame, labels: DataFrame, most_toxic: int = 4000, most_ordinary: int = 8000, longest: int = 128 << 10, **options) -> Model | None:
    """A model from a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(remainder(F.col("doc_id")) != 2)
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").drop("other")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = {}
    for kind, most in ((1, most_toxic), (0, most_ordinary)):
        rows = known.where(F.col("toxic") == kind).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
        chosen |= {r["doc_id"]: kind for r in rows}
    if not chosen:
        return None
    ids = F.broadcast(documents.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long"))  # at most most_toxic + most_ordinary
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text") <= longest).join(ids, "doc_id", "left_semi").collect()
    found = {kind: sorted({(zlib.crc32(str(r["doc_id"]).encode()), r["text"].encode()) for r in texts if chosen[r["doc_id"]] == kind}) for kind in (1, 0)}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return train([t for _, t in found[1]], [t for _, t in found[0]], share, **options)


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model and model.differences()
        for batch in slices(batches, 1024, "text", 8 << 20):
            scores = [model.probability(measure(windows(t))) if model else 0.0 for t in utf8_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
