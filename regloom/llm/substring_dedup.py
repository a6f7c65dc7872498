"""Repeated-substring removal by super-k-mer partitioning.

A window is k = 20 consecutive words. The minimiser of a window is the least hash among its m-word runs; consecutive
windows that share it travel together as one packed string (a super-k-mer) to the minimiser's bucket, about three
times the text in all; super-k-mers of a bucket travel in compressed blocks. Equal windows have equal minimisers, so each
bucket sorts its windows by hash, compares equal hashes word by word, and finds exactly which windows start earlier
elsewhere.

Hot minimisers (a passage in a large share of all documents) are dealt over shards by document. A shard settles what
it can, and the first occurrences that are left travel on, one window each, dealt by the whole window's hash.

Defined results: null and empty texts have no words and lose none; a text of fewer than k words is never cut; of
rows that repeat a doc_id the same starts are no repeats of each other, and all share the cuts of the id. Rows with a
null doc_id count as the earliest occurrences and are not cut. An empty table gives no rows; input columns named
n_words, n_removed or kept give way. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import with_columns
from .store import drop, save
from .text import covered, grams, groups, hashes, mix, raw, slices, spans, sums, texts, words, wrap

K, M = 20, 3
SHARDS = 32
ROOM = 1 << 15  # super-k-mers whose windows a bucket's task sorts at once
BLOCK = 24 << 20  # bytes of super-k-mers that are split into blocks at once
BATCH = 8 << 20  # bytes of blocks that travel to a worker at once


def packed(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words joined by single spaces as bytes, and where each word starts (one more than words)."""
    offs, data = raw(flat)
    n = len(offs) - 1
    at = offs + np.arange(n + 1)
    out = np.full(at[-1], 0x20, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offs))] = data
    return at, out


def superkmers(flat: pa.Array, starts: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word, last word (exclusive) and text of each maximal run of windows with one minimiser place."""
    g = grams(hashes(flat), m)
    first, text = spans(starts, k)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    width = k - m + 1
    least, span = g.copy(), 1
    while span < width:  # least of width neighbours by doubling
        step = min(span, width - span)
        least[:-step] = np.minimum(least[:-step], least[step:])
        span += step
    mini = least[first]
    new = np.ones(len(first), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(first)) - 1
    return mini[begin], first[begin], first[end] + k, text[begin]


def blocks(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, payload) of rows (key, doc, start, words, hot): those of one bucket of keys, compressed together."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = one(held)
        bucket = (mix(rows.column("key").to_numpy().view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        there, first = np.unique(bucket[order], return_index=True)
        rows, payload = rows.take(pa.array(order)), []
        for i, j in zip(first, np.append(first[1:], len(order))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows.slice(i, j - i))
            body = sink.getvalue()
            payload.append(body.size.to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(there), pa.array(payload, pa.binary())], names=["bucket", "payload"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= BLOCK:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def unblock(payload: pa.Scalar) -> list[pa.RecordBatch]:
    held = payload.as_buffer()
    body = pa.decompress(held.slice(8), int.from_bytes(held.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    return list(pa.ipc.open_stream(body))


def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bucket_count(size: int) -> int:
    """Buckets for ``size`` bytes of text: of 1 MB of it up to 512 of them, then of 8 MB, so that blocks do not get small.

    A task has several, so that tasks are alike, and holds one at a time.
    """
    return max(64, min(512, size >> 20), size >> 23)


def pieces(docs: DataFrame, doc_id: str, k: int, hot: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of (key, doc, start, words, hot) of all super-k-mers; the key is the minimiser, or for hot ones that and a shard."""

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            flat, starts = words(texts(piece))
            mini, first, last, text = superkmers(flat, starts, k)
            at, data = packed(flat)
            size = at[last] - 1 - at[first]
            offs = np.concatenate(([0], np.cumsum(size)))
            chars = np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(at[first], size)
            key, is_hot = mini.view(np.int64), np.zeros(len(mini), bool)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                shard = piece.column("shard").to_numpy().astype(np.uint64)[text]
                key = np.where(is_hot, mix(mini ^ mix(shard + np.uint64(1))).view(np.int64), key)
            yield pa.RecordBatch.from_arrays([pa.array(key), piece.column("doc").take(pa.array(text)), pa.array((first - starts[text]).astype(np.int32)), wrap(offs, data[chars]), pa.array(is_hot)], names=["key", "doc", "start", "words", "hot"])

    part = docs.select(F.col(doc_id).alias("doc"), F.pmod(F.xxhash64(doc_id), F.lit(SHARDS)).alias("shard"), "text")
    return part.mapInArrow(lambda batches: blocks(found(batches), buckets), "bucket long, payload binary")


def hot_minimisers(spark: SparkSession, docs: DataFrame, k: int, least: int = 2048) -> np.ndarray:
    """Sorted minimisers with over max(``least``, total / 2^22) super-k-mers: at most 2^22 values, 32 MB."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            flat, starts = words(texts(piece))
            value, n = np.unique(superkmers(flat, starts, k)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["mini", "n"])

    counted = docs.select("text").mapInArrow(run, "mini long, n long").groupBy("mini").agg(F.sum("n").alias("n"))
    many = save(spark, counted.where(F.col("n") > least), "minimisers")
    total = many.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    top = many.where(F.col("n") > max(least, total >> 22)).select("mini").toArrow()  # fewer than 2^22 can be above it
    drop(spark, many)
    return np.sort(top.column("mini").to_numpy())


def settle(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Row, start and first word of all windows of some super-k-mers, whether an equal one starts earlier; words, hashes.

    Rows with one key must come sorted by (doc, start). Windows of one hash are compared with the first word by word.
    """
    flat, starts = words(rows.column("words").combine_chunks())
    first, row = spans(starts, k)
    begin = rows.column("start").to_numpy().astype(np.int64)[row] + first - starts[row]
    doc = rows.column("doc").combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)[row]
    h = grams(hashes(flat), k)[first]
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    own = mix(h + mix(rows.column("key").to_numpy().view(np.uint64))[row])  # shards of a hot minimiser stay apart
    order = np.argsort(own, kind="stable")
    later = np.zeros(len(first), bool)
    if len(order):
        new = np.ones(len(order), bool)
        new[1:] = own[order[1:]] != own[order[:-1]]
        head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        same = np.flatnonzero(head != order)
        mine, theirs = order[same], head[same]
        equal = np.ones(len(same), bool)
        for i in range(k):
            equal &= ids[first[mine] + i] == ids[first[theirs] + i]
        later[mine] = equal & ((doc[mine] != doc[theirs]) | (begin[mine] != begin[theirs]))
        for at in mine[~equal].tolist():  # one hash, two windows: compare with every window of that hash
            key = ids[first[at] : first[at] + k].tolist()
            twins = order[own[order] == own[at]].tolist()
            later[at] = any(t < at and ids[first[t] : first[t] + k].tolist() == key and (doc[t], begin[t]) != (doc[at], begin[at]) for t in twins)
    return row, begin, later, first, flat, h


def sort_buckets(rows: DataFrame, kind: str, k: int) -> DataFrame:
    """(doc, start, stop, h, words): spans covered by later windows, h null; and the first windows of hot shards, h set.

    ``rows`` are blocks. A task sorts a bucket's super-k-mers by (key, doc, start), null ids first, and then the windows of
    whole keys, of about ROOM super-k-mers at a time.
    """

    def flush(table: pa.Table) -> pa.RecordBatch:
        row, begin, later, first, flat, h = settle(table, k)
        hit = np.flatnonzero(later)
        new = np.ones(len(hit), bool)  # neighbouring later windows of one super-k-mer make one span
        new[1:] = (row[hit][1:] != row[hit][:-1]) | (begin[hit][1:] != begin[hit][:-1] + 1)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(hit))[: len(a)] - 1
        left = np.flatnonzero(~later & table.column("hot").to_numpy()[row]) if len(row) else hit
        rows_ = np.concatenate((row[hit[a]], row[left]))
        start = np.concatenate((begin[hit[a]], begin[left]))
        stop = np.concatenate((begin[hit[b]], begin[left])) + k
        h_ = pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(h[left].view(np.int64))])
        strings = [None] * len(a) + [" ".join(flat.slice(f, k).to_pylist()) for f in first[left].tolist()]
        doc = table.column("doc").combine_chunks().take(pa.array(rows_))
        return pa.RecordBatch.from_arrays([doc, pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), h_, pa.array(strings, pa.string())], names=["doc", "start", "stop", "h", "words"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, ["bucket"]):
            held = pa.Table.from_batches([b for payload in table.column("payload") for b in unblock(payload)]).combine_chunks()
            del table
            order = pc.sort_indices(held, [(c, "ascending") for c in ("key", "doc", "start")], null_placement="at_start")
            key = held.column("key").to_numpy()[order.to_numpy()]
            ends, start = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)), 0
            while start < len(key):
                stop = int(ends[min(np.searchsorted(ends, start + ROOM), len(ends) - 1)])  # full: go on to the end of the key
                yield flush(held.take(order.slice(start, stop - start)))
                start = stop

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"doc {kind}, start int, stop int, h long, words string")


def covers(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """(doc, spans): for each document with any, the word spans of windows whose word sequence also starts earlier."""
    kind = docs.schema[doc_id].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = bucket_count(size)
    found = save(spark, sort_buckets(pieces(docs, doc_id, k, hot_minimisers(spark, docs, k), buckets), kind, k), "windows", batch=BATCH)
    lone = found.where("h is not null").select(F.col("h").alias("key"), "doc", "start", "words", F.lit(False).alias("hot"))
    lone = lone.mapInArrow(lambda batches: blocks(batches, buckets), "bucket long, payload binary")
    again = sort_buckets(lone, kind, k).select("doc", "start", "stop")
    both = found.where("h is null").select("doc", "start", "stop").unionAll(again)
    out = both.where("doc is not null").groupBy("doc").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    out = save(spark, out, "covers", batch=BATCH)
    drop(spark, found)
    return out


def cut(docs: DataFrame, spans_: DataFrame, keep: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``keep`` columns of every row, n_words, n_removed and kept: what is left, words joined by single spaces."""
    joined = docs.join(spans_.select(F.col("doc").alias("_doc"), F.col("spans").alias("_spans")), F.col(doc_id) == F.col("_doc"), "left")

    def step(piece: pa.RecordBatch) -> dict:
        flat, starts = words(texts(piece))
        lists = piece.column("_spans")
        flat_spans = lists.flatten()
        owner = np.repeat(np.arange(piece.num_rows), np.diff(list_offsets(lists)))
        a, b = (flat_spans.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        high = starts[owner + 1]
        gone = covered(len(flat), np.minimum(starts[owner] + a, high), np.minimum(starts[owner] + b, high))
        kept = flat.filter(pa.array(~gone))
        at, data = packed(kept)
        left = np.concatenate(([0], np.cumsum(~gone)))[starts]
        some = left[1:] > left[:-1]
        size = np.where(some, at[left[1:]] - 1 - at[left[:-1]], 0)
        offs = np.concatenate(([0], np.cumsum(size)))
        chars = np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(at[left[:-1]], size)
        return {"n_words": np.diff(starts), "n_removed": sums(gone, starts), "kept": wrap(offs, data[chars])}

    held = [c for c in keep if c not in ("n_words", "n_removed", "kept")]
    return with_columns(joined, [*held, "_spans"], "n_words long, n_removed long, kept string", step).drop("_spans")


def list_offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of a list column, from 0, nulls as empty lists."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(size)))


def dedup(spark: SparkSession, docs: DataFrame, keep: list[str], doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """Remove every word that lies in a repeated window from each row of ``docs``; see ``cut`` for the columns."""
    return cut(docs, covers(spark, docs, doc_id, k), keep, doc_id)
