"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.sources.io import intermediates  # noqa: F401
from loadlens.sources.io import materialize as keep  # noqa: F401

#: Spark bounds a batch by its bytes (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB by default). What Python makes of a
#: text is several times its size, so a batch is worked off in slices of at most so many bytes, or of one row.
SLICE_BYTES = 4 << 20


def slices(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, in order, as slices whose values in column `text` have SLICE_BYTES bytes at most, or one row; views, not copies."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        upto, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            before = upto[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right")))
            yield batch.slice(first, end - first)
            first = end


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, id_col: str, text_col: str, rows: Callable[[Iterable[bytes]], dict[str, list]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """One output row per input row: the id, then the columns that `rows` gives for a batch of texts.

    Only the two columns named leave the scan. `schema` lists the columns after the id. `done` is called when a task ends, in its worker.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    out = f"`{id_col}` {kind}, {schema}"
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    names: list[str] = [x.strip().split()[0].strip("`") for x in _columns(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches):
                made = rows(as_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names)], names=[id_col, *names])
        finally:
            if done:
                done()

    return source.mapInArrow(run, out)


def _columns(schema: str) -> list[str]:
    """The top-level columns of a DDL string."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
