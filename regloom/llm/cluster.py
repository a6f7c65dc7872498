"""Connected groups of items under a link that is only checked between items sharing a key.

Keys give candidate groups (a superset of the true ones); every item then travels once to its candidate group, where
a matcher checks links. A group too large for one task is cut into blocks, and each pair of blocks is a task of its
own, so that no task holds an unbounded group and no link inside a group is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import drop, save
from .text import groups

#: matcher(ids, payloads) yields index pairs that are linked, enough of them to connect all linked items.
Matcher = Callable[[list[bytes]], Iterable[tuple[int, int]]]


class Union:
    """Disjoint sets of the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def candidates(spark: SparkSession, links: DataFrame, name: str) -> DataFrame:
    """(node, root) of all ids that links (a, b) connect, roots included."""
    found = components(spark, links, name)
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())


def linked(spark: SparkSession, members: DataFrame, items: DataFrame, matcher: Matcher, name: str, room: int = 12 << 20) -> DataFrame:
    """(node, root) by true links: ``members`` (node, root) are candidate groups, ``items`` (id, payload) what is matched.

    ``room``: bytes of payload in a block; a task holds two blocks at most (and one item, if that alone is larger).
    """
    held = save(spark, items.join(members, items.id == members.node).select("root", "id", "payload"), name + "-items")
    sized = held.groupBy("root").agg(F.sum(F.length("payload") + 64).alias("bytes"), F.count("*").alias("n")).where("n > 1")
    sized = sized.select("root", F.ceil(F.col("bytes") / room).cast("int").alias("blocks"))
    dealt = held.join(sized, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "payload")
    # a number of partitions of its own: small in bytes, costly to match, so tasks must not be merged by size
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, ["root", "i", "j"]):
            if table.num_rows < 2:
                continue
            pairs = np.array(list(matcher(table.column("payload").to_pylist())), np.int64).reshape(-1, 2)
            ids = table.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(pairs[:, 0])), ids.take(pa.array(pairs[:, 1]))], names=["a", "b"])

    out = components(spark, dealt.mapInArrow(run, f"a {kind}, b {kind}"), name)
    drop(spark, held)
    return out
