"""Resharding by minimum-cost flow: which blocks must move so that shards reach new sizes with the fewest bytes moved.

Old shards supply their bytes, new shards take up to their capacity, a byte that stays costs nothing and one that moves
costs 1 (or what a cost matrix says). The flow is solved over shards alone, exactly, by successive shortest paths. Rows are
grouped into blocks (old shard, binary size class of the row, bucket of its id); each old shard's blocks, largest first, go
to the transfer that has most left to fill, so that rounding ends with the smallest ones. Only shards that a block leaves
or enters are written anew; a manifest, written last, names for each shard the generation of files that holds it.

The blocks' table has at most ``MOST_SHARDS * 64 * buckets`` rows at any number of documents and is what the driver plans
and what is broadcast; documents are read twice and shuffled once, by (shard, file), and a block's place in its shard is
known beforehand, so that slots need no window over a shard. A hot old shard is many blocks; raise ``buckets`` where a
block of a very large table should be smaller.

Defined results: a row's size is its text's UTF-8 bytes plus 8, of a null text 8; an old shard that is null or negative
counts as shard 0; repeated rows are rows of their own, and rows that repeat an id share a block; copies of a text are not
kept together, as that would move more bytes; without rows all shards are empty. Rows of a block are ordered by id, null
first, then by the text's crc and hash. Columns named shard or slot give way to the added ones.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MOST_SHARDS = 1024
BUCKETS = 256
#: Bytes of text that go to a file, about.
FILE_BYTES = 128 << 20
OVERHEAD = 8
BLOCK = ["_old", "_class", "_bucket"]


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def min_cost_flow(supply: list[int], capacity: list[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Flow from each supplier to each taker of least total cost that places all supply, exactly, in whole units."""
    m, n = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("capacities are smaller than what is to be placed")
    price = np.array(cost, np.int64) if cost is not None else (np.arange(m)[:, None] != np.arange(n)[None, :]).astype(np.int64)
    left, room, flow = np.array(supply, np.int64), np.array(capacity, np.int64), np.zeros((m, n), np.int64)
    far = np.int64(1) << 60
    while left.any():
        # shortest paths in the residual network, from all that is left to each taker
        old, new = np.where(left > 0, 0, far), np.full(n, far)
        back_new, back_old = np.full(n, -1), np.full(m, -1)
        while True:
            reach = old[:, None] + price
            best = reach.argmin(0)
            nearer = (value := reach[best, np.arange(n)]) < new
            new, back_new = np.where(nearer, value, new), np.where(nearer, best, back_new)
            undo = np.where(flow > 0, new[None, :] - price, far)
            best = undo.argmin(1)
            closer = (value := undo[np.arange(m), best]) < old
            old, back_old = np.where(closer, value, old), np.where(closer, best, back_old)
            if not closer.any():
                break
        end = int(np.where(room > 0, new, far).argmin())
        path, j = [], end
        while True:
            i = int(back_new[j])
            path.append((i, j))
            if back_old[i] < 0:
                break
            j = int(back_old[i])
            path.append((i, j))
        amount = min([int(left[path[-1][0]]), int(room[end]), *(int(flow[i, j]) for i, j in path[1::2])])
        for k, (i, j) in enumerate(path):
            flow[i, j] += amount if k % 2 == 0 else -amount
        left[path[-1][0]] -= amount
        room[end] -= amount
    return flow


def targets(total: int, weights: list[int]) -> list[int]:
    """``total`` bytes by weight, in whole bytes that add up to it."""
    whole = sum(weights)
    if whole <= 0 or min(weights) < 0:
        raise ValueError("weights must be 0 or more, and not all 0")
    ends = [total * sum(weights[: i + 1]) // whole for i in range(len(weights))]
    return [b - a for a, b in zip([0, *ends], ends)]


@dataclass
class Plan:
    """Where each block goes (``to``), the flow that it follows, and shards with files to be written."""

    blocks: pa.Table
    to: np.ndarray
    flow: np.ndarray
    wanted: list[int]
    affected: set[int] = field(default_factory=set)

    @property
    def bytes_moved(self) -> int:
        return int(self.blocks.column("_bytes").to_numpy()[self.to != self.blocks.column("_old").to_numpy()].sum())

    def sizes(self) -> list[int]:
        return np.bincount(self.to, self.blocks.column("_bytes").to_numpy(), len(self.wanted)).astype(np.int64).tolist()


def deal(old: np.ndarray, size: np.ndarray, flow: np.ndarray, wanted: list[int]) -> np.ndarray:
    """New shard of every block: largest first, each to the transfer of its shard that has most left, home before others."""
    to, left = np.zeros(len(old), np.int64), flow.astype(np.int64).copy()
    for k in np.lexsort((np.arange(len(size)), -size)).tolist():
        i, row = int(old[k]), left[old[k]]
        j = int(row.argmax())
        if i < len(wanted) and row[i] == row[j]:
            j = i
        to[k] = j
        row[j] -= size[k]
    return evened(old, size, to, np.array(wanted, np.int64), {int(x) for i, j in zip(*np.nonzero(flow)) if i != j for x in (i, j)})


def evened(old: np.ndarray, size: np.ndarray, to: np.ndarray, wanted: np.ndarray, open_: set[int]) -> np.ndarray:
    """Mends what rounding left: blocks go from the fullest to the emptiest shard that moves touch anyway, as long as
    that brings both nearer to their sizes; blocks that have moved already go first."""
    shards = sorted(j for j in open_ if j < len(wanted))
    over = np.bincount(to, size, len(wanted)).astype(np.int64) - wanted
    held = {(j, home): sorted((int(size[k]), k) for k in np.flatnonzero((to == j) & ((old == j) == home)).tolist()) for j in shards for home in (False, True)}
    enough = max(int(wanted.sum()) // max(len(wanted), 1) // 1000, 1)
    while shards:
        a, b = max(shards, key=lambda j: (over[j], -j)), min(shards, key=lambda j: (over[j], j))
        gap = int(over[a] - over[b])
        found = None
        for home in (False, True):
            if (i := bisect_left(held[a, home], ((gap + 1) // 2, len(size)))) and gap > enough:
                found = home, held[a, home][i - 1]
                break
        if found is None:
            return to
        home, (n, k) = found
        held[a, home].remove((n, k))
        insort(held[b, bool(old[k] == b)], (n, k))
        to[k] = b
        over[a] -= n
        over[b] += n
    return to


def blocks_of(docs: DataFrame, old: Column, doc_id: str, text: str, buckets: int) -> DataFrame:
    """``docs`` with the columns of BLOCK and _size."""
    shard = F.greatest(F.coalesce(old.cast("int"), F.lit(0)), F.lit(0))
    size = row_size(text)
    return docs.select("*", shard.alias("_old"), F.length(F.bin(size)).alias("_class"), F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(buckets)).cast("int").alias("_bucket"), size.alias("_size"))


def plan(rows: DataFrame, weights: list[int], cost: np.ndarray | None = None) -> Plan:
    """``rows``: columns of BLOCK and _size. ``weights``: the new shards' parts of all bytes."""
    if len(weights) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards")
    table = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_bytes")).toArrow().combine_chunks().sort_by([(c, "ascending") for c in BLOCK])
    old, size = (table.column(c).to_numpy().astype(np.int64) for c in ("_old", "_bytes"))
    n_old = int(old.max()) + 1 if len(old) else 0
    if n_old > MOST_SHARDS:
        raise ValueError(f"an old shard above {MOST_SHARDS - 1}")
    wanted = targets(int(size.sum()), weights)
    flow = min_cost_flow(np.bincount(old, size, n_old).astype(np.int64).tolist(), wanted, cost)
    out = Plan(table, deal(old, size, flow, wanted), flow, wanted)
    moved = out.to != old
    out.affected = {*old[moved].tolist(), *out.to[moved].tolist()}
    return out


def placed(spark: SparkSession, rows: DataFrame, found: Plan, doc_id: str, text: str) -> DataFrame:
    """``rows`` of affected shards with shard and slot, each shard's rows cut into files by their bytes."""
    table, to = found.blocks, found.to
    old, n, size = (table.column(c).to_numpy().astype(np.int64) for c in ("_old", "_rows", "_bytes"))
    order = np.lexsort((np.arange(len(to)), old != to, to))  # a shard's own blocks first
    slot, offset = np.zeros(len(to), np.int64), np.zeros(len(to), np.int64)
    for values, where in ((n, slot), (size, offset)):
        before = np.cumsum(values[order]) - values[order]
        first = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0]) if len(to) else []
        where[order] = before - np.repeat(before[first], np.diff(np.r_[first, len(to)])) if len(to) else 0
    live = np.isin(to, sorted(found.affected))
    where = pa.table({**{c: table.column(c) for c in BLOCK}, "shard": to, "_first": slot, "_file": offset // FILE_BYTES}).filter(pa.array(live))
    schema = T.StructType([*(rows.schema[c] for c in BLOCK), *T._parse_datatype_string("shard long, _first long, _file long")])
    target = spark.createDataFrame(where.to_pandas(), schema)
    dealt = rows.join(F.broadcast(target), BLOCK).repartition("shard", "_file")
    inside = Window.partitionBy("shard", "_file", *BLOCK).orderBy(F.col(doc_id), F.crc32(text), F.xxhash64(text))
    return dealt.withColumn("slot", F.col("_first") + F.row_number().over(inside) - 1).drop(*BLOCK, "_size", "_first", "_file").withColumn("shard", F.col("shard").cast("int"))


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, where = _fs(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(where) if fs.exists(_fs(spark, f"{s.getPath()}/_SUCCESS")[1])]
    return sorted(int(n) for n in done if n.isdigit())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, generation, n_rows, n_bytes) of the newest version that was written whole."""
    return spark.read.schema("shard int, generation string, n_rows long, n_bytes long").parquet(f"{path}/manifest/{_versions(spark, path)[-1]}")


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a stored set of shards; ``schema``: its columns without shard and slot."""
    live = [(r.shard, r.generation) for r in manifest(spark, path).where("n_rows > 0").collect()]  # a row for each shard
    full = T.StructType([*(f for f in schema if f.name not in ("shard", "slot")), *T._parse_datatype_string("slot long, shard int")])
    parts = [spark.read.option("basePath", f"{path}/{g}").schema(full).parquet(*(f"{path}/{g}/shard={s}" for s, x in live if x == g)) for g in sorted({g for _, g in live})]
    out = spark.createDataFrame([], full) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _store(spark: SparkSession, rows: DataFrame, found: Plan, path: str, doc_id: str, text: str, before: dict[int, str], every: bool) -> set[int]:
    """Writes the affected shards (``every``: all) as a new generation, then the manifest; what was written."""
    if every:
        found.affected = set(range(len(found.wanted)))
    generation = f"generation-{uuid.uuid4().hex}"
    if found.affected:
        placed(spark, rows, found, doc_id, text).write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/{generation}")
    n = np.bincount(found.to, found.blocks.column("_rows").to_numpy(), len(found.wanted)).astype(np.int64).tolist()
    live = [(j, generation if j in found.affected else before[j], n[j], b) for j, b in enumerate(found.sizes()) if j in found.affected or j in before]
    version = ([0, *_versions(spark, path)])[-1] + 1
    spark.createDataFrame(live, "shard int, generation string, n_rows long, n_bytes long").coalesce(1).write.parquet(f"{path}/manifest/{version}")
    return found.affected


def reshard(spark: SparkSession, docs: DataFrame, old: Column, weights: list[int], path: str, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, cost: np.ndarray | None = None) -> Plan:
    """Writes ``docs``, whose present shard is ``old``, as ``len(weights)`` shards under ``path``; all columns are kept."""
    rows = blocks_of(docs.drop("shard", "slot"), old, doc_id, text, buckets)
    found = plan(rows, weights, cost)
    _store(spark, rows, found, path, doc_id, text, {}, True)
    return found


def rewrite(spark: SparkSession, path: str, schema: T.StructType, weights: list[int], doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, cost: np.ndarray | None = None) -> Plan:
    """Brings a stored set of shards to new sizes; only shards that a block leaves or enters get new files.

    Older generations stay until ``vacuum``, so that a reader of the former manifest is not disturbed.
    """
    stored = read(spark, path, schema)
    rows = blocks_of(stored, F.col("shard"), doc_id, text, buckets)
    found = plan(rows, weights, cost)
    before = {r.shard: r.generation for r in manifest(spark, path).collect()}
    _store(spark, rows.where(F.col("_old").isin(sorted(found.affected))).drop("shard", "slot"), found, path, doc_id, text, before, False)
    return found


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes generations that the newest manifest no longer names, and older manifests."""
    live = {r.generation for r in manifest(spark, path).collect()}
    fs, where = _fs(spark, path)
    gone = [str(s.getPath()) for s in fs.listStatus(where) if s.getPath().getName().startswith("generation-") and s.getPath().getName() not in live]
    gone += [f"{path}/manifest/{v}" for v in _versions(spark, path)[:-1]]
    for g in gone:
        fs, where = _fs(spark, g)
        fs.delete(where, True)
    return gone
