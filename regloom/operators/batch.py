"""Programs of an Arrow batch as flat arrays, and ragged arrays back to Arrow: what ``vm`` and ``check`` share.

Spark deals the rows and hands batches of them to ``arrow_udf`` functions; these take all programs of a batch a step
further at once, with NumPy. Nothing is kept between batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isa

#: Stands for a null or missing argument; no INT has this value.
NONE = 1 << 40
CODE = {name: i for i, name in enumerate(isa.OPS)}
UNKNOWN = len(CODE)
_ALL = [*isa.OPS.values()]
#: By code (the last: unknown): how many registers and literals an operation takes.
REGISTERS = np.array([o.registers for o in _ALL] + [0])
LITERALS = np.array([o.literals for o in _ALL] + [0])


def column(function: Callable, kind: str) -> Callable[..., Column]:
    """An ``arrow_udf`` that is computed once for each row: the optimizer copies none that it holds for not deterministic."""
    return F.arrow_udf(function, kind).asNondeterministic()


def told(df: DataFrame, name: str, function: Callable, kind: str, program: str, *others: Column) -> DataFrame:
    """``df`` with what ``function`` tells of its programs. They get a column of their own before, as Spark leaves a function
    unplanned into whose arguments it has written nested lambdas."""
    return isa.once(df, "_given", F.col(program)).select("*", column(function, kind)("_given", *others).alias(name)).drop("_given")


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if ends.size else 0) + np.repeat(start - (ends - size), size)


def offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size)))


def lists(size: np.ndarray, values: pa.Array | np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Arrow lists of given sizes, one after the other in ``values``."""
    at = pa.array(offsets(size).astype(np.int32), pa.int32())
    held = values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32, copy=False), pa.int32())
    return pa.ListArray.from_arrays(at, held, mask=None if null is None or not null.any() else pa.array(null))


def texts(size: np.ndarray, data: np.ndarray) -> pa.Array:
    """Arrow texts of given sizes in bytes, one after the other in ``data``."""
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets(size).astype(np.int32)), pa.py_buffer(data)])


def sizes(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def coded(*columns: pa.Array) -> tuple[list[np.ndarray], list]:
    """Texts as numbers (null: -1), the same for all columns, and the texts."""
    held = pa.concat_arrays(columns).dictionary_encode()
    codes = np.asarray(pc.fill_null(held.indices, -1)).astype(np.int64)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1]), held.dictionary.to_pylist()


@dataclass
class Programs:
    """``n`` programs; instruction ``i`` of program ``r`` lies at ``at[r] + i`` of the flat arrays."""

    column: pa.Array

    def __post_init__(self) -> None:
        column = self.column.combine_chunks() if isinstance(self.column, pa.ChunkedArray) else self.column
        self.n, self.null, self.size = len(column), np.asarray(column.is_null()), sizes(column)
        self.at, self.rows = offsets(self.size), np.repeat(np.arange(self.n), self.size)
        self.place = np.arange(len(self.rows)) - self.at[self.rows]
        op, args, self._label, self._target = column.flatten().flatten()
        (numbers,), self.names = coded(op)
        found = [CODE.get(x, len(isa.OPS) if x is None or not x.startswith("USEROP_") else CODE["USEROP_0"]) for x in self.names]
        self.known = np.array([x in CODE for x in self.names] + [False])[numbers]
        self.op = np.array(found + [UNKNOWN])[numbers]
        self.given = sizes(args)
        flat, start = np.asarray(pc.fill_null(args.flatten().cast(pa.int64()), NONE)), offsets(self.given)[:-1]
        flat = np.append(flat, NONE)
        self.a, self.b, self.c = (flat[np.where(self.given > k, start + k, -1)] for k in range(3))
        self.unlisted = np.asarray(args.is_null())

    @cached_property
    def marks(self) -> tuple[np.ndarray, np.ndarray, list]:
        """Numbers of each instruction's label and target (none: -1), the same text the same number, and the texts."""
        (label, target), named = coded(self._label, self._target)
        return label, target, named

    @cached_property
    def to(self) -> np.ndarray:
        """The index that a target stands for: the first such label of the program. -1: no target, or nothing has its label."""
        label, target, named = self.marks
        out, many = np.full(len(self.rows), -1), len(named) + 1
        defined, wanted = np.flatnonzero(label >= 0), np.flatnonzero(target >= 0)
        if len(defined) and len(wanted):
            keys, first = np.unique(self.rows[defined] * many + label[defined], return_index=True)
            want = self.rows[wanted] * many + target[wanted]
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            out[wanted] = np.where(keys[place] == want, self.place[defined[first[place]]], -1)
        return out

    def any(self, marked: np.ndarray) -> np.ndarray:
        """For each program whether one of its instructions is marked."""
        return np.bincount(self.rows[marked], minlength=self.n) > 0
