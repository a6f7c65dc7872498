"""Connected groups of a link table, by rounds of joins; nothing is collected to the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, save


def united(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least member of each number's group once x[i] and y[i] are joined; ``up`` holds that from before."""
    x, y = up[x], up[y]
    x, y = x[x != y], y[x != y]
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(higher := up[up], up):
            up = higher
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return up


def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Links that connect what the links (a, b) connect: of each node to the least node of its group."""
    coded = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty_like(order, dtype=np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    up = united(np.arange(len(order)), code[: len(a)], code[len(a) :])
    low = np.flatnonzero(up != np.arange(len(up)))
    return coded.dictionary.take(pa.array(order[low])), coded.dictionary.take(pa.array(order[up[low]]))


def thinned(links: DataFrame, most: int = 1 << 20) -> DataFrame:
    """Links (a, b) with the same connected groups, at most one for each node in every run of ``most`` links of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays(list(stars(*(pa.concat_arrays(table.column(c).chunks) for c in "ab"))), names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, links.select("a", "b").schema)


def components(spark: SparkSession, links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots, root being its group's least node.

    Large-star and small-star rounds (Kiveris et al., 2014), each written to the shared folder. Nulls and loops are
    ignored; no links give no rows. Rounds end when all links are stars to their least node. Each task first thins its
    links to stars, so that groups within one task need no round, and partial aggregation finds the least neighbour of
    hubs before any shuffle.
    """
    edges = thinned(links.where("a <> b"))
    edges = save(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def done(edges: DataFrame) -> bool:
        """Whether every node has one link down, to a node that has none: links are stars, or there are none."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
        return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)").isEmpty()

    while not done(edges):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = save(spark, small.where("a <> b").distinct(), name)
        drop(spark, edges)
        edges = new
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
