"""Vectorised words, lines and hashes over Arrow batches. Small helpers for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True

#: Byte maps. LOWER: A-Z to a-z. FOLD: the same, and every byte below 0x80 that is no digit or letter to a space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLD = LOWER.copy()
FOLD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no piece holds over ``most`` bytes of text, unless it is a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, stop - start)
            pa.default_memory_pool().release_unused()
            start = stop


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The text column as a string array, nulls as empty texts."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 (one more than values) and the bytes of a string array."""
    n = len(strings)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    bufs = strings.buffers()
    offs = np.frombuffer(bufs[1], np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return offs - offs[0], data


def wrap(offs: np.ndarray, data: np.ndarray) -> pa.Array:
    """A string array from offsets and bytes."""
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def mapped(strings: pa.Array, table: np.ndarray) -> pa.Array:
    """Every byte replaced by ``table``."""
    offs, data = raw(strings)
    return wrap(offs, table[data])


def words(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and where each text's words start (one more than texts)."""
    lists = pc.ascii_split_whitespace(strings)
    flat, offs = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        before = np.concatenate(([0], np.cumsum(full)))
        flat, offs = flat.filter(pa.array(full)), before[offs]
    return flat, offs


def lines(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """\\n-split lines of all texts in a row, and where each text's lines start."""
    lists = pc.split_pattern(strings, "\n")
    return lists.flatten(), lists.offsets.to_numpy().astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, (1 << 16) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def hashes(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit tabulation hash of each string: a sum of a random value for each (position, byte)."""
    offs, data = raw(strings)
    n = len(offs) - 1
    out = np.zeros(n, U64)
    if len(data):
        lens = np.diff(offs)
        code = ((np.arange(len(data), dtype=np.int64) - np.repeat(offs[:-1], lens)) << 8) | data
        values = _TABLE[np.minimum(code, 65535)]
        if (far := code > 65535).any():
            values[far] = mix(code[far].astype(U64) * U64(0x9E3779B97F4A7C15) + U64(1))
        if seed:
            values = mix(values + U64(seed))
        full = lens > 0
        out[full] = np.add.reduceat(values, offs[:-1][full])
    return mix(out + U64(0x9E3779B97F4A7C15) * (np.diff(offs).astype(U64) + U64(seed + 1)))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """``hashes`` of words, each different word hashed once."""
    coded = flat.dictionary_encode()
    return hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]


def spans(starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of every window of ``k`` words that lies in one text."""
    lens = np.diff(starts)
    count = np.maximum(lens - k + 1, 0)
    text = np.repeat(np.arange(len(lens)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[:-1][text]
    return first, text


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` word hashes (runs across texts included; select with spans)."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k, U64)
    for i in range(k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in any interval [first, last)."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, first, 1)
    np.add.at(delta, last, -1)
    return np.cumsum(delta[:-1]) > 0


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[starts[1:]] - total[starts[:-1]]


def binaries(offs: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array over the elements of ``data``: value i holds data[offs[i]:offs[i+1]]."""
    size = data.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer((offs * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys from batches sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            col = batch.column(k)
            if batch.num_rows > 1:
                change[1:] |= pc.not_equal(col.slice(1), col.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if key != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)
