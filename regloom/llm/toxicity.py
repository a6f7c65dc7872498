"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded sample of labelled texts (at most ``max_examples``, those of least id hash). Their terms are
all their words and the beginnings of their longer words; none is left out. A term weighs (1 + log tf) * idf * relevance,
relevance being how surely the term is commoner in examples of label 1 (log odds over its standard error, FLOOR at least):
by tf * idf alone the chance likeness of long texts hides what is toxic in them. The examples lie in blocks; for each term
and block the index keeps the largest weight, which bounds what the term adds in a block. The share of the HEAD most
frequent terms is a product of dense matrices; the k-th best of these partial cosines is a threshold, and the postings of
all other terms are read only in the blocks whose bound reaches it, so the neighbours are exact.

Votes weigh by cosine against a prior, and a leave-one-out table over the examples turns votes into calibrated scores.
Evidence: ids and cosines of the neighbours. Counts and leave-one-out votes are made by tasks; the index, bounded by
``max_examples``, goes to the executors as one broadcast.

Defined results: null and empty texts, and texts without a term, have no neighbours and the vote of the prior. Without
examples, or with those of one label only, every score is the share of label 1 among them (0 if there are none). Equal
cosines are ranked by example order, which is that of the ids. A label row with a null id or another label than 0 and 1 is
left out; of several labels of an id the largest counts; repeated documents are one example. Ids may be of any type that
has an order. Rows with a null id and repeated rows are scored each on its own; texts are read whole; an empty table
gives no rows; input columns named like an output column give way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .frames import with_columns
from .text import FOLD, mapped, slices, texts, words

BLOCK = 64
PREFIX = 5
FLOOR = 0.05
HEAD = 512
ROOM = 1 << 21  # (text, term, block) entries that a search holds at once


@dataclass
class Index:
    """Unit vectors of the examples. Postings and blocks of term t lie from ``post_at[t]`` and ``block_at[t]`` on."""

    terms: pa.Array = field(default_factory=lambda: pa.array([], pa.string()))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: pa.Array = field(default_factory=lambda: pa.array([], pa.int64()))
    label: np.ndarray = field(default_factory=lambda: np.zeros(0))
    example: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    block_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where the postings of a block start
    head: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # row of each term in ``dense``, or -1
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # weights of the most frequent terms by example
    prior: float = 0.0
    table: np.ndarray = field(default_factory=lambda: np.zeros(10))  # calibrated score by tenth of the vote

    @property
    def n_blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for size[i] places, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def counted(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Text, term and count of all terms of each text, and the terms."""
    flat, starts = words(mapped(strings, FOLD))
    coded = flat.dictionary_encode()
    plain = coded.dictionary
    long = np.flatnonzero(pc.utf8_length(plain).to_numpy(zero_copy_only=False) > PREFIX)
    heads = pc.binary_join_element_wise(pc.utf8_slice_codeunits(plain.take(pa.array(long)), 0, PREFIX), "-", "").dictionary_encode()
    head = np.full(len(plain), -1, np.int64)
    head[long] = heads.indices.to_numpy(zero_copy_only=False) + len(plain)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    more = head[ids] if len(ids) else ids
    terms = pa.concat_arrays([plain, heads.dictionary])
    pair, n = np.unique(np.concatenate((text, text[more >= 0])) * max(1, len(terms)) + np.concatenate((ids, more[more >= 0])), return_counts=True)
    return pair // max(1, len(terms)), pair % max(1, len(terms)), n, terms


def vectors(index: Index, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each text's terms start, term numbers in the index, and weights of unit length."""
    text, term, n, found = counted(strings)
    number = pc.fill_null(pc.index_in(found, value_set=index.terms), -1).to_numpy(zero_copy_only=False)
    at = number[term] if len(term) else term
    text, n, at = text[at >= 0], n[at >= 0], at[at >= 0]
    w = (1 + np.log(n)) * index.weight[at] if len(at) else np.zeros(0)
    norm = np.sqrt(np.bincount(text, w * w, len(strings)))
    return np.searchsorted(text, np.arange(len(strings) + 1)), at, w / norm[text]


def build(index: Index, rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> Index:
    """Postings and block maxima of (example, term, weight of unit length) added to an index."""
    order = np.lexsort((rows, terms))
    rows, terms, values = rows[order], terms[order], values[order]
    key = terms * max(1, index.n_blocks) + rows // BLOCK
    df = np.bincount(terms, minlength=len(index.terms))
    top = np.lexsort((np.arange(len(df)), -df))[:HEAD]
    index.head = np.full(len(df), -1, np.int64)
    index.head[top] = np.arange(len(top))
    index.dense = np.zeros((len(top), index.n_blocks * BLOCK))
    often = index.head[terms] >= 0
    index.dense[index.head[terms[often]], rows[often]] = values[often]
    rows, terms, values, key = (x[~often] for x in (rows, terms, values, key))
    index.example, index.value = rows.astype(np.int32), values
    first = np.flatnonzero(np.diff(key, prepend=-1))
    index.block, index.first = (rows[first] // BLOCK).astype(np.int32), np.append(first, len(rows))
    index.most = np.maximum.reduceat(values, first) if len(first) else np.zeros(0)
    index.block_at = np.searchsorted(terms[first], np.arange(len(index.terms) + 1))
    return index


def nearest(index: Index, starts: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text the k examples of largest cosine (above 0), -1 beyond, and the cosines; ``skip`` is an example to leave out."""
    n = len(starts) - 1
    best, cosine = np.full((n, k), -1, np.int64), np.zeros((n, k))
    size = np.diff(index.block_at)[term] if len(term) else np.zeros(0, np.int64)
    upto = np.concatenate(([0], np.cumsum(size)))[starts]
    a = 0
    while a < n:  # as many texts at once as there is room for
        b = max(a + 1, min(a + 256, int(np.searchsorted(upto, upto[a] + ROOM, "right")) - 1))
        part = slice(starts[a], starts[b])
        best[a:b], cosine[a:b] = _nearest(index, starts[a : b + 1] - starts[a], term[part], weight[part], k, None if skip is None else skip[a:b])
        a = b
    return best, cosine


def _nearest(index: Index, starts: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    n, blocks = len(starts) - 1, index.n_blocks
    if not len(term) or not blocks:
        return np.full((n, k), -1, np.int64), np.zeros((n, k))
    text = np.repeat(np.arange(n), np.diff(starts))
    often = index.head[term] >= 0
    query = np.zeros((n, len(index.dense)))
    query[text[often], index.head[term[often]]] = weight[often]
    score = query @ index.dense
    text, term, weight = text[~often], term[~often], weight[~often]
    size = index.block_at[term + 1] - index.block_at[term]
    entry = ranges(index.block_at[term], size)
    owner, w = np.repeat(text, size), np.repeat(weight, size)
    cell = owner * blocks + index.block[entry]
    tail = np.bincount(cell, w * index.most[entry], n * blocks).reshape(n, blocks)
    kept = (np.arange(0), np.arange(0)) if skip is None else (np.flatnonzero(skip >= 0), skip[skip >= 0])
    score[kept] = 0
    width = min(k, score.shape[1])
    least = -np.partition(-score, width - 1, axis=1)[:, width - 1]
    opened = (tail > 0) & (score.reshape(n, blocks, BLOCK).max(2) + tail >= least[:, None] - 1e-9)
    some = np.flatnonzero(opened.ravel()[cell])
    long = index.first[entry[some] + 1] - index.first[entry[some]]
    post = ranges(index.first[entry[some]], long)
    at = np.repeat(owner[some], long) * score.shape[1] + index.example[post]
    score += np.bincount(at, np.repeat(w[some], long) * index.value[post], score.size).reshape(score.shape)
    score[kept] = 0
    score = np.round(score, 12)  # sums in another order must not part equal cosines
    floor = -np.partition(-score, width - 1, axis=1)[:, width - 1]
    row, col = np.nonzero((score >= floor[:, None]) & (score > 0))
    order = np.lexsort((col, -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    row, col, place = row[place < k], col[place < k], place[place < k]
    best, cosine = np.full((n, k), -1, np.int64), np.zeros((n, k))
    best[row, place], cosine[row, place] = col, score[row, col]
    return best, cosine


def votes(index: Index, best: np.ndarray, cosine: np.ndarray, weight: float) -> np.ndarray:
    """Labels of the neighbours weighted by cosine, with ``weight`` votes for the prior."""
    label = np.append(index.label, 0.0)[best]
    return ((cosine * label).sum(1) + weight * index.prior) / (cosine.sum(1) + weight)


def tenth(vote: np.ndarray) -> np.ndarray:
    return np.minimum((vote * 10 + 1e-9).astype(np.int64), 9)


def examples(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, max_examples: int) -> DataFrame:
    """(doc_id, label, text) of at most ``max_examples`` labelled rows, those of least hash of the id; one row for each id."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    found = docs.select(F.col(doc_id).alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", max_examples: int = 2048, k: int = 16, prior_votes: float = 0.1) -> Broadcast:
    """Index and calibrate the examples. What reaches the driver are their terms, bounded by ``max_examples``.

    ``labels`` must hold only rows that may be learned from. Equal texts among the examples count once.
    """
    spark = docs.sparkSession
    chosen = examples(docs, labels, label, doc_id, max_examples).persist()
    single = chosen.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    told = chosen.join(F.broadcast(single), "doc_id").persist()
    ids = told.select("doc_id", F.col("label").cast("double").alias("label")).orderBy("doc_id").toArrow()
    index = Index(ids=pa.concat_arrays(ids.column("doc_id").chunks) if len(ids) else Index().ids, label=ids.column("label").to_numpy().astype(float))
    n, positive = len(index.label), float(index.label.sum())
    index.prior = positive / n if n else 0.0
    if not 0 < positive < n:
        index.ids, index.label, index.table = index.ids.slice(0, 0), index.label[:0], np.full(10, index.prior)
        return spark.sparkContext.broadcast(index)
    numbered = told.join(F.broadcast(spark.createDataFrame(pa.table({"doc_id": index.ids, "number": pa.array(np.arange(n))}))), "doc_id")

    def posted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            text, term, count, terms = counted(texts(piece))
            yield pa.RecordBatch.from_arrays([piece.column("number").take(pa.array(text)), terms.take(pa.array(term)), pa.array(count), piece.column("label").take(pa.array(text)).cast(pa.int32())], names=["number", "term", "n", "label"])

    got = numbered.select("number", "label", "text").mapInArrow(posted, "number long, term string, n long, label int").toArrow()
    coded = pa.concat_arrays(got.column("term").combine_chunks().chunks if isinstance(got.column("term").combine_chunks(), pa.ChunkedArray) else [got.column("term").combine_chunks()]).dictionary_encode()
    term, row = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), got.column("number").to_numpy()
    index.terms = coded.dictionary
    with_, toxic = np.bincount(term, minlength=len(index.terms)), np.bincount(term, index.label[row], len(index.terms))
    odds = np.log((toxic + 0.5) / (positive + 1)) - np.log((with_ - toxic + 0.5) / (n - positive + 1))
    sure = odds / np.sqrt(1 / (toxic + 0.5) + 1 / (with_ - toxic + 0.5))
    index.weight = np.log(1 + n / with_) * np.maximum(sure, FLOOR)
    value = (1 + np.log(got.column("n").to_numpy())) * index.weight[term]
    norm = np.sqrt(np.bincount(row, value * value, n))
    build(index, row, term, value / norm[row])
    sent = spark.sparkContext.broadcast(index)

    def left_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            best, cosine = nearest(sent.value, *vectors(sent.value, texts(piece)), k, piece.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(votes(sent.value, best, cosine, prior_votes)), piece.column("label").cast(pa.float64())], names=["vote", "label"])

    tried = numbered.select("number", "label", "text").repartition(spark.sparkContext.defaultParallelism).mapInArrow(left_out, "vote double, label double")
    each = {r.at: (r.n, r.hits) for r in tried.groupBy(F.least(F.floor(F.col("vote") * 10 + 1e-9), F.lit(9)).cast("int").alias("at")).agg(F.count("*").alias("n"), F.sum("label").alias("hits")).collect()}
    chosen.unpersist()
    told.unpersist()
    seen, hits = (np.array([each.get(i, (0, 0.0))[j] for i in range(10)], float) for j in (0, 1))
    index.table = np.maximum.accumulate((hits + 4 * (np.arange(10) + 0.5) / 10) / (seen + 4))
    sent.unpersist()
    return spark.sparkContext.broadcast(index)


def assess(docs: DataFrame, index: Broadcast, keep: list[str], k: int = 16, prior_votes: float = 0.1, threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, score, predicted, and the neighbours as evidence (ids and cosines) of every row."""

    def step(piece: pa.RecordBatch) -> dict:
        x: Index = index.value
        best, cosine = nearest(x, *vectors(x, texts(piece)), k)
        score = x.table[tenth(votes(x, best, cosine, prior_votes))]
        there = best >= 0
        at = pa.array(np.concatenate(([0], np.cumsum(there.sum(1)))).astype(np.int32))
        ids = x.ids.take(pa.array(best[there]))
        return {"score": score, "predicted": (score >= threshold).astype(np.int32), "evidence": pa.ListArray.from_arrays(at, ids), "cosines": pa.ListArray.from_arrays(at, pa.array(cosine[there]))}

    kind = from_arrow_type(index.value.ids.type).simpleString()
    return with_columns(docs, keep, f"score double, predicted int, evidence array<{kind}>, cosines array<double>", step)
