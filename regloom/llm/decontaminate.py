"""Benchmark decontamination by winnowing.

Words are hashed into k-grams (k = 4 words) and of every w = 7 neighbouring k-grams the least hash is kept, so every
shared span of at least w + k - 1 = 10 words leaves a common fingerprint. Benchmark fingerprints go into a bit map of
fixed size, which thins the document fingerprints where they are made; what is left joins the benchmark by fingerprint
and is extended word by word within the reach of a window. An item of fewer than 10 words is one window of its own
length and is fingerprinted by its whole hash, at every place of a document.

Defined results: null and empty texts have no words and no hits; an item without words has no windows. Repeated items
are counted by item_id once. Every row of documents gets hits of its own, by its text, whether its doc_id is null, repeated or
neither. An empty table on either side gives no hits. Texts are read whole. Null item ids cannot be reported and are left
out of the item list, though their words still count as hit. Items are sorted as strings, so their order has no ties.
Of documents only doc_id and text are read by ``report``; ``clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import save
from .text import FOLD, grams, hashes, mapped, mix, slices, spans, texts, words

WINDOW, K = 10, 4
BITS = 1 << 24
FP = "struct<fp:bigint,at:int,from:int,size:int,words:string>"


def winnow(h: np.ndarray, starts: np.ndarray, k: int = K, window: int = WINDOW) -> np.ndarray:
    """First words of the chosen k-grams: in each window the rightmost of the least hashes (all of h; texts by starts)."""
    g = grams(h, k)
    width = window - k + 1
    first, _ = spans(starts, window)
    if not len(first):
        return np.zeros(0, np.int64)
    best, at = g.copy(), np.arange(len(g))
    for i in range(1, width):  # running least of width neighbours
        other = g[i:]
        less = other <= best[: len(other)]
        best[: len(other)][less] = other[less]
        at[: len(other)][less] = np.arange(i, len(g))[less]
    return np.unique(at[first])


def marks(h: np.ndarray, starts: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, place and length of all winnowed k-grams (length K, marked 0) and of all runs of the given lengths."""
    at = winnow(h, starts)
    fps, ats, size = [mix(grams(h, K)[at] + np.uint64(99))], [at], [np.zeros(len(at), np.int64)]
    for n in lengths:
        first, _ = spans(starts, n)
        fps.append(mix(grams(h, n)[first] + np.uint64(n)))
        ats.append(first)
        size.append(np.full(len(first), n))
    return np.concatenate(fps), np.concatenate(ats), np.concatenate(size)


def contexts(flat: pa.Array, starts: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words that any window around each fingerprint can reach: from, number, the words joined by a space."""
    text = np.searchsorted(starts, at, "right") - 1
    low = np.where(size > 0, at, np.maximum(starts[text], at - (WINDOW - K)))
    high = np.where(size > 0, at + size, np.minimum(starts[text + 1], at + WINDOW))
    joined = []
    for a, b in zip(low.tolist(), high.tolist()):
        joined.append(" ".join(flat.slice(a, b - a).to_pylist()))
    return low, text, joined


def fingerprints(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(fp, size, at, words, items): each different context of a benchmark fingerprint with the items that have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            flat, starts = words(mapped(texts(piece), FOLD))
            h, n = hashes(flat), np.diff(starts)
            fp, at, size = marks(h, starts, [])
            short = np.flatnonzero((n > 0) & (n < WINDOW))
            for i in short:
                fp = np.append(fp, mix(grams(h[starts[i] : starts[i + 1]], int(n[i])) + np.uint64(n[i])))
                at, size = np.append(at, starts[i]), np.append(size, n[i])
            low, text, joined = contexts(flat, starts, at, size)
            yield pa.RecordBatch.from_arrays([piece.column("item").take(pa.array(text)), pa.array(fp.view(np.int64)), pa.array(size.astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(joined, pa.string())], names=["item", "fp", "size", "at", "words"])

    schema = f"item {items.schema[item_id].dataType.simpleString()}, fp long, size int, at int, words string"
    found = items.select(F.col(item_id).alias("item"), "text").mapInArrow(run, schema)
    return found.groupBy("fp", "size", "at", "words").agg(F.collect_set("item").alias("items"))


def bitmap(prints: DataFrame) -> np.ndarray:
    """Which of BITS slots hold a benchmark fingerprint: 2 MB packed, whatever the number of items."""
    slots = prints.select(F.pmod("fp", F.lit(BITS)).cast("int").alias("slot")).groupBy("slot").agg(F.lit(1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[batch.column("slot").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(BITS // 8, np.uint8)
    for row in slots.coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total


def row_key() -> Column:
    """What rows are joined by: equal for equal texts alone, so ids need be neither set nor unique."""
    return F.md5(F.coalesce("text", F.lit("")))


def candidates(docs: DataFrame, doc_id: str, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """(id, doc, n_words, found) of every row, doc being its key: the fingerprints that the bit map lets through, with their contexts."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            flat, starts = words(mapped(texts(piece), FOLD))
            fp, at, size = marks(hashes(flat), starts, lengths)
            slot = fp.view(np.int64) % BITS
            hit = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
            hit = hit[np.argsort(at[hit], kind="stable")]
            low, text, joined = contexts(flat, starts, at[hit], size[hit])
            offs = np.searchsorted(text, np.arange(piece.num_rows + 1))
            found = pa.StructArray.from_arrays([pa.array(fp[hit].view(np.int64)), pa.array((at[hit] - low).astype(np.int32)), pa.array((low - starts[text]).astype(np.int32)), pa.array(size[hit].astype(np.int32)), pa.array(joined, pa.string())], names=["fp", "at", "from", "size", "words"])
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("doc"), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), found)], names=["id", "doc", "n_words", "found"])

    return docs.select(F.col(doc_id).alias("id"), row_key().alias("doc"), "text").mapInArrow(run, f"id {kind}, doc string, n_words long, found array<{FP}>")


def extend(pairs: DataFrame, kind: str) -> DataFrame:
    """(doc, start, stop, item): spans that a document and an item share around a common fingerprint.

    The contexts of a pair are laid over each other at the fingerprint and compared word by word to both sides.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, start, stop = [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("words", "at", "from", "size", "item_words", "item_at")))
            for i, (mine, at, low, size, theirs, their_at) in enumerate(rows):
                a, b = mine.split(" "), theirs.split(" ")
                n = size or K
                if a[at : at + n] != b[their_at : their_at + n]:
                    continue
                left, right = 0, n
                if not size:
                    while left < min(at, their_at) and a[at - left - 1] == b[their_at - left - 1]:
                        left += 1
                    while right < min(len(a) - at, len(b) - their_at) and a[at + right] == b[their_at + right]:
                        right += 1
                    if left + right < WINDOW:
                        continue
                keep.append(i)
                start.append(low + at - left)
                stop.append(low + at + right)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(keep, pa.int64())), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), batch.column("items").take(pa.array(keep, pa.int64()))], names=["doc", "start", "stop", "items"])

    columns = ["doc", "words", "at", "from", "size", "item_words", "item_at", "items"]
    schema = f"doc {kind}, start int, stop int, items {pairs.schema['items'].dataType.simpleString()}"
    return pairs.select(*columns).mapInArrow(run, schema)


def hits(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """All documents (id, doc, n_words, found) and, once for each text, the spans (doc, start, stop, items) that they share with items."""
    prints = save(spark, fingerprints(items, item_id), "bench")
    lengths = sorted(r.size for r in prints.where("size > 0").select("size").distinct().collect())
    made = save(spark, candidates(docs, doc_id, bitmap(prints), lengths), "fingerprints")
    left = made.where(F.size("found") > 0).dropDuplicates(["doc"]).select("doc", F.explode("found").alias("f")).select("doc", "f.*")
    right = prints.select("fp", "size", F.col("at").alias("item_at"), F.col("words").alias("item_words"), "items")
    kind = made.schema["doc"].dataType.simpleString()
    return made, extend(left.join(right, ["fp", "size"]), kind)


def report(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """Every row's doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    return hit_counts(spark, *hits(spark, docs, items, doc_id, item_id)).withColumnRenamed("id", doc_id).drop("doc")


def hit_counts(spark: SparkSession, made: DataFrame, spans_: DataFrame) -> DataFrame:
    """(id, doc, n_words, n_hit, n_items, items, contaminated) of every row."""
    spans_ = save(spark, spans_, "spans")
    places = spans_.select("doc", "start", "stop").distinct().groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("s"))
    union = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.stop - F.greatest(x.start, acc.end))).alias("n"), F.greatest(acc.end, x.stop).alias("end")))
    places = places.select("doc", union.n.cast("long").alias("n_hit"))
    named = spans_.select("doc", F.explode("items").alias("item")).distinct().groupBy("doc").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items"))
    out = made.select("id", "doc", "n_words").join(places.join(named, "doc", "left"), "doc", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "id", "doc", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", most_hit: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose share of hit words is at most ``most_hit``."""
    found = hit_counts(spark, *hits(spark, docs, items, doc_id, item_id))
    dirty = found.where(F.col("n_hit") > most_hit * F.col("n_words")).select(F.col("doc").alias("_key")).distinct()
    return docs.withColumn("_row", row_key()).join(dirty, F.col("_row") == F.col("_key"), "left_anti").drop("_row")
