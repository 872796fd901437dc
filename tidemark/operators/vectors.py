"""Vector search and pluggable embedders."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import cosine


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], count: int) -> DataFrame:
    """The keys most alike to a query vector; each task keeps its own best, ties by key."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(column), wanted).alias("similarity")).orderBy(F.desc("similarity"), key).limit(count)


def _query_blocks(queries: DataFrame, key: str, column: str, block: int) -> Iterator[tuple[list[int], list]]:
    """Keys and vectors of at most ``block`` queries at a time."""
    keys, held = [], []
    for name, vector in queries.select(key, column).toLocalIterator():
        keys.append(name)
        held.append(vector)
        if len(keys) == block:
            yield keys, held
            keys, held = [], []
    if keys:
        yield keys, held


def _units(rows: list, length: int) -> np.ndarray:
    """Vectors of length one; zero for null, for another length and for norm zero, so that their similarity is 0."""
    fits = [r if r is not None and len(r) == length else [0.0] * length for r in rows]
    found = np.array(fits, np.float64).reshape(len(rows), length)
    norms = np.sqrt(np.einsum("ij,ij->i", found, found))
    return found / np.where(norms > 0, norms, 1.0)[:, None]


def _against_each(vectors: DataFrame, key: str, column: str, queries: DataFrame, block: int, pick: Callable) -> DataFrame:
    """(query, key, similarity) of the rows that ``pick`` keeps of each task, for one broadcast block of queries after the other."""
    spark, schema, found = vectors.sparkSession, f"query long, {key} long, similarity double", None
    for keys, held in _query_blocks(queries, key, column, block):
        sent = spark.sparkContext.broadcast((keys, held))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            keys, held = sent.value
            lengths = sorted({len(v) for v in held if v is not None} | {0})
            groups = [(n, [i for i, v in enumerate(held) if len(v or ()) == n]) for n in lengths]
            groups = [(n, own, _units([held[i] for i in own], n)) for n, own in groups if own]

            def scored() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in batches:
                    for at in range(0, batch.num_rows, 1024):
                        part = batch.slice(at, 1024)
                        rows, table = part.column(1).to_pylist(), np.zeros((len(keys), part.num_rows))
                        for n, own, units in groups:
                            table[own] = np.einsum("qi,ri->qr", units, _units(rows, n))
                        yield part.column(0).to_numpy(zero_copy_only=False), table.round(9)

            for query, row, similarity in pick(scored(), len(keys)):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[query]), pa.array(row.astype(np.int64)), pa.array(similarity)], names=["query", key, "similarity"])

        own = vectors.select(key, column).mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], schema) if found is None else found


def nearest_each(vectors: DataFrame, key: str, column: str, queries: DataFrame, count: int, block: int = 512) -> DataFrame:
    """(query, key, similarity, rank): for each row of ``queries`` the keys most alike among all rows; ties (to 9 digits) by key.

    A task keeps ``count`` rows a query.
    """

    def pick(scored, n: int):
        best_keys, best = np.zeros((n, 0), np.int64), np.zeros((n, 0))
        for keys, table in scored:
            all_keys, both = np.hstack([best_keys, np.broadcast_to(keys, table.shape)]), np.hstack([best, table])
            order = np.lexsort((all_keys, -both), axis=1)[:, :count]
            best_keys, best = np.take_along_axis(all_keys, order, 1), np.take_along_axis(both, order, 1)
        yield np.repeat(np.arange(n), best.shape[1]), best_keys.ravel(), best.ravel()

    found = _against_each(vectors, key, column, queries, block, pick)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), key)).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= count)


def alike_each(vectors: DataFrame, key: str, column: str, queries: DataFrame, least: float, block: int = 512) -> DataFrame:
    """(query, key, similarity): for each row of ``queries`` all rows that are more alike than ``least`` (to 9 digits)."""

    def pick(scored, n: int):
        for keys, table in scored:
            query, row = np.nonzero(table > least)
            yield query, keys[row], table[query, row]

    return _against_each(vectors, key, column, queries, block, pick)


def hashed_embedding(texts: pd.Series, dimension: int = 64) -> pd.Series:
    """A deterministic embedding: signed counts of words by hash, of unit length."""
    out = []
    for text in texts:
        vector = np.zeros(dimension)
        for word in (text or "").lower().split():
            code = zlib.crc32(word.encode())
            vector[code % dimension] += 1.0 if code >> 16 & 1 else -1.0
        norm = np.linalg.norm(vector)
        out.append((vector / norm if norm else vector).tolist())
    return pd.Series(out)


def embed(text: Column, embedder: Callable[[pd.Series], pd.Series] = hashed_embedding) -> Column:
    """Embed a text column in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return embedder(texts)

    return run(text)


def semantic_match(frame: DataFrame, left: str, right: str, least: float = 0.7) -> DataFrame:
    """Rows whose two operands point the same way; an operand that is text is embedded first, once a row."""
    kinds = {f.name: f.dataType.typeName() for f in frame.schema.fields}
    vector = lambda c: F.col(c) if kinds[c] == "array" else embed(F.col(c))
    known = frame.withColumns({"left_vector_": vector(left), "right_vector_": vector(right)})
    return known.where(cosine(F.col("left_vector_"), F.col("right_vector_")) > least).drop("left_vector_", "right_vector_")
