"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one step of an operator handles at a time; a longer text is one step of its own.
STEP_BYTES = 4_000_000

ArrowColumns = Callable[[pa.RecordBatch], list]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most STEP_BYTES of text each, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > STEP_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The input without columns that an operator is about to add, in whatever case they are spelled."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of the input has, in whatever case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def add_columns(df: DataFrame, text: str, fields: Sequence[T.StructField], make: Callable[[], ArrowColumns]) -> DataFrame:
    """Rows with more columns, computed from each slice of an Arrow batch.

    ``make`` is called once in each task and returns the function of a slice.
    Columns of the input that have a new column's name are replaced, also where
    ``text`` is one of them.
    """
    names = [f.name for f in fields]
    kept = without(df, names).columns
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    order = kept + names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for batch in batches:
            for part in steps(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + columns(part), names=order)

    return df.mapInArrow(run, schema)
