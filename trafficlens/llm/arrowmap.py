"""Appending columns computed from Arrow batches with texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from trafficlens.llm.words import slices


Made = dict[str, object]


def append(df: DataFrame, fields: str, start: Callable[[], Callable[[pa.RecordBatch], Made]], text: str = "text") -> DataFrame:
    """``df`` with further columns made from its rows; no shuffle.

    ``start`` runs once in each task and returns the function that turns a slice of
    rows into the new columns (by name, one value for each row). Columns of ``df``
    that have one of the new names are replaced.
    """

    def started() -> Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, Made]]]:
        make = start()
        return lambda b: iter([(b, make(b))])

    return append_parts(df, fields, started, text)


def append_parts(df: DataFrame, fields: str, start: Callable[[], Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, Made]]]], text: str = "text") -> DataFrame:
    """The same, for a function that gives a slice's rows in parts, each with its new columns."""
    new = StructType.fromDDL(fields)
    df = df.drop(*(f.name for f in new.fields if f.name != text))
    names = [f.name for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in slices(batches, text):
            for part, made in make(b):
                keep = [n for n in part.schema.names if n not in names]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *(made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names)], [*keep, *names])

    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name not in names] + new.fields))
