"""Helpers shared by the operators: column choice and batch building."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slices


def remainder(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % of


def array(values: np.ndarray | pa.Array | list, kind: pa.DataType | None = None) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def with_columns(docs: DataFrame, keep: list[str], added: str, step: Callable[[pa.RecordBatch], dict], most: int = 2 << 20) -> DataFrame:
    """``keep`` columns of ``docs`` plus the columns that ``step`` computes for each piece of text.

    A kept column with the name of an added one gives way to it.
    """
    new = T.StructType.fromDDL(added) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(added)
    held = [c for c in keep if c not in new.names]
    schema = T.StructType([docs.schema[c] for c in held] + list(new))
    columns = list(dict.fromkeys([*held, "text"]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, most=most):
            out = step(piece)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in held), *(array(out[n]) for n in new.names)], names=[*held, *new.names])

    return docs.select(*columns).mapInArrow(run, schema)
