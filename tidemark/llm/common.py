"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_list(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, weigh: str | None = None, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``rows`` rows and about ``most`` bytes of column ``weigh``.

    A row larger than ``most`` is a piece of its own; nothing is dropped.
    """
    for batch in batches:
        n, start = batch.num_rows, 0
        if weigh is None:
            for at in range(0, n, rows):
                yield batch.slice(at, rows)
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(weigh).cast(pa.binary())), 0).to_pylist()
        held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < n:
            yield batch.slice(start)


def shielded(frame: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on a frame whose columns of these names (in any case) go by others meanwhile."""
    clash = {c: f"own__{c}" for c in frame.columns if c.lower() in names}
    done = work(frame.withColumnsRenamed(clash)) if clash else work(frame)
    return done.withColumnsRenamed({new: old for old, new in clash.items()}) if clash else done
