"""Merkle manifest of a table: a tree over each group's rows, a tree over the groups' roots, and a proof for every row.

Hashes form a sparse forest: nodes by (tree, level, index) whose run of siblings is not complete. Two forests merge by
union; a run whose size is known from the tree's number of leaves gives way to its parent once it is complete, and the
last node of a group's tree becomes a leaf of the tree of groups. Merging is associative, commutative and has the empty
forest as identity, so rows may lie in any partitions and partitions may merge in any order.

Rows are sorted by range and saved with their number; counts of partitions give each its place in its group, without a
window over a group. A partition of neighbouring rows leaves at most a few nodes of each level, at its two ends. A tree
reduction merges ``FAN`` neighbours at a time, so that no task holds more than FAN such rims and the driver only the root.
On the way back each round hands what lies above a node (the siblings left and right of its path) to the rim nodes of
the round below, and at last to the rows. Each round is a saved table: lost executors cost one round.

Defined results: rows of a group ascend by id, null ids first, rows of one id by their leaf; equal rows have equal leaves
and each its own place and proof; a null group is a group of its own, the first; a null field is ``-``, an empty one
``0:``; a text of any length is one field; an empty table has no root and no rows. Columns that are not fields are not
looked at; a kept column named like an added one gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .store import drop, save
from .text import groups

ARITY = 3
#: Partitions merged at a time.
FAN = 64
#: Rows of a partition, about.
PART_ROWS = 200_000
#: The tree of groups.
TOP = -1
RUN, ABOVE, NODE = 0, 1, 2
ADDED = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
STATE = "grp long, kind int, at long, tree long, n long, level int, idx long, digest string, claimed string, up string, sub string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """SHA-256 over the fields, each ``-`` if null, else its bytes' count, a colon and the value."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in fields)), 256)


class Forest:
    """Nodes by (tree, level, index) whose siblings are not all known."""

    def __init__(self, sizes: dict[int, int], traced: bool = False):
        self.sizes = dict(sizes)
        self.nodes: dict[tuple[int, int, int], str] = {}
        self.links: dict[tuple[int, int, int], tuple] | None = {} if traced else None

    def width(self, tree: int, level: int) -> int:
        return -(-self.sizes[tree] // ARITY**level)

    def settled(self) -> Forest:
        """Replaces every complete run by its parent, up to the last node of each tree."""
        nodes, links, fresh = self.nodes, self.links, list(self.nodes)
        while fresh:
            made = []
            for tree, level, run in {(t, lv, i // ARITY) for t, lv, i in fresh}:
                width = self.width(tree, level)
                if width == 1:
                    if tree != TOP:
                        found = nodes.pop((tree, level, 0))
                        nodes[TOP, 0, tree] = found
                        made.append((TOP, 0, tree))
                        if links is not None:
                            links[tree, level, 0] = ((TOP, 0, tree), None, found)
                    continue
                keys = [(tree, level, i) for i in range(ARITY * run, min(ARITY * run + ARITY, width))]
                if all(k in nodes for k in keys):
                    parts = [nodes.pop(k) for k in keys]
                    parent = (tree, level + 1, run)
                    nodes[parent] = digest("".join(parts))
                    made.append(parent)
                    if links is not None:
                        for j, k in enumerate(keys):
                            links[k] = (parent, "".join(parts[:j]), "".join(parts[j + 1 :]))
            fresh = made
        return self

    def merge(self, other: Forest) -> Forest:
        """The monoid's operation: union, then all runs that are now complete give way to their parents."""
        out = Forest(self.sizes | other.sizes)
        out.nodes = self.nodes | other.nodes
        return out.settled()

    def above(self, key: tuple[int, int, int], known: dict) -> tuple[str, str | None]:
        """Siblings left and right of each step from a node up to the root, ``left,right;`` each, and its group's root."""
        path = []
        while key not in known:
            parent, left, right = self.links[key]
            path.append((key, left, right))
            key = parent
        for k, left, right in reversed(path):
            up, sub = known[key]
            known[k] = (up, right) if left is None else (f"{left},{right};{up}", sub)
            key = k
        return known[key]


def fold(leaf: str, up: str) -> str:
    """The root that a leaf and the siblings of its path lead to."""
    for step in up.split(";")[:-1]:
        left, right = step.split(",")
        leaf = digest(left + leaf + right)
    return leaf


def numbered(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """``rows`` (_group, _id, digest, ...) in order with their number ``at`` (partition and row of it); runs of one group in
    a partition (grp, at, tree, n, idx: its group's rank and rows, and the place of its first row); partitions; groups."""
    order = ["_group", "_id", "digest"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order)
    rows = save(spark, rows.drop("_tie").withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    runs = rows.groupBy(F.shiftright("at", 33).alias("grp"), "_group").agg(F.count(F.lit(1)).alias("_rows"), F.min("at").alias("at"))
    group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_rows").over(group.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("grp", "at", before.alias("idx"), F.sum("_rows").over(group).alias("n")).withColumn("_new", (F.col("idx") == 0).cast("long"))
    runs = save(spark, runs, "merkle-runs")
    first = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    base = runs.groupBy("grp").agg(F.sum("_new").alias("_starts")).withColumn("_base", F.coalesce(F.sum("_starts").over(first), F.lit(0)))
    inside = F.sum("_new").over(Window.partitionBy("grp").orderBy("at"))
    placed = save(spark, runs.withColumn("_in", inside).join(base, "grp").select("grp", "at", (F.col("_base") + F.col("_in") - 1).alias("tree"), "n", "idx"), "merkle-places")
    drop(spark, runs)
    last = placed.agg(F.max("grp"), F.max("tree")).first()
    return rows, placed, 0 if last[0] is None else last[0] + 1, 0 if last[1] is None else last[1] + 1


def state(df: DataFrame, kind: int, inside: T.StructType | None = None, **given: Column) -> DataFrame:
    """``df`` with all columns of STATE and ``inside``; those that it has not and that are not given are null."""
    has = given | {"kind": F.lit(kind)}
    find = lambda n: has[n] if n in has else F.col(n) if n in df.columns else F.lit(None)
    return df.select(*(find(f.name).cast(f.dataType).alias(f.name) for f in [*T._parse_datatype_string(STATE), *(inside or [])]))


def loaded(table: pa.Table, n_groups: int, traced: bool) -> tuple[Forest, pa.Table, list, dict]:
    """A group's forest before it settles, its node rows and their keys, and what is known to lie above its nodes."""
    kind = table.column("kind").to_numpy()
    forest, known = Forest({TOP: n_groups}, traced), {}
    for r in table.filter(pa.array(kind == ABOVE)).select(["tree", "level", "idx", "up", "sub"]).to_pylist():
        known[r["tree"], r["level"], r["idx"]] = (r["up"], r["sub"])
    nodes, runs = table.filter(pa.array(kind == NODE)), table.filter(pa.array(kind == RUN))
    if runs.num_rows:  # rows of the table: placed by the run that they lie in
        at, begin = (x.column("at").to_numpy() for x in (nodes, runs))
        run = np.searchsorted(begin, at, "right") - 1
        tree, size = (runs.column(c).to_numpy() for c in ("tree", "n"))
        place = (runs.column("idx").to_numpy()[run] + at - begin[run]).tolist()
        forest.sizes.update(zip(tree.tolist(), size.tolist()))
        keys = [(t, 0, i) for t, i in zip(tree[run].tolist(), place)]
    else:
        keys = list(zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "idx"))))
        forest.sizes.update((t, n) for t, n in zip(nodes.column("tree").to_pylist(), nodes.column("n").to_pylist()) if t != TOP)
    forest.nodes.update(zip(keys, nodes.column("digest").to_pylist()))
    return forest, nodes, keys, known


def by_group(df: DataFrame) -> DataFrame:
    return df.repartition("grp").sortWithinPartitions("grp", "kind", "at")


def merged(df: DataFrame, n_groups: int) -> DataFrame:
    """The rim of every group: what stays unresolved of its rows or nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp,), table in groups(batches, ["grp"]):
            forest, *_ = loaded(table, n_groups, False)
            forest.settled()
            keys = sorted(forest.nodes)
            columns = [[grp] * len(keys), *([k[i] for k in keys] for i in range(3)), [forest.sizes[k[0]] for k in keys], [forest.nodes[k] for k in keys]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["grp", "tree", "level", "idx", "n", "digest"])

    return by_group(df).mapInArrow(run, "grp long, tree long, level int, idx long, n long, digest string")


def handed_down(df: DataFrame, n_groups: int) -> DataFrame:
    """What lies above every node of a group (grp of the round below: ``at``), from what lies above its rim."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, ["grp"]):
            forest, nodes, keys, known = loaded(table, n_groups, True)
            forest.settled()
            found = [forest.above(k, known) for k in keys]
            columns = [nodes.column("at").combine_chunks(), *(nodes.column(c).combine_chunks() for c in ("tree", "level", "idx")), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "tree", "level", "idx", "up", "sub"])

    return by_group(df).mapInArrow(run, "grp long, tree long, level int, idx long, up string, sub string")


def proved(df: DataFrame, n_groups: int, root: str, kept: T.StructType) -> DataFrame:
    """Kept columns, at, leaf, up, subroot, root, proof_sha256, folded_root and verified of every row."""
    names = [f.name for f in kept]
    out = T.StructType([*kept, *T._parse_datatype_string("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, up string")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, ["grp"]):
            forest, nodes, keys, known = loaded(table, n_groups, True)
            forest.settled()
            for start in range(0, len(keys), 2000):
                piece = nodes.slice(start, 2000).combine_chunks()
                found = [forest.above(k, known) for k in keys[start : start + 2000]]
                claims = [c or d for c, d in zip(piece.column("claimed").to_pylist(), piece.column("digest").to_pylist())]
                folded = [fold(c, up) for c, (up, _) in zip(claims, found)]
                proofs = [digest(up.replace(",", "").replace(";", "")) for up, _ in found]
                columns = [*(piece.column(c) for c in names), piece.column("digest"), *(pa.array(x, pa.string()) for x in ([s for _, s in found], [root] * len(found), proofs, folded)), pa.array([f == root for f in folded]), pa.array([u for u, _ in found], pa.string())]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=[f.name for f in out])

    return by_group(df).mapInArrow(run, out)


def manifest(spark: SparkSession, docs: DataFrame, leaf: Column, group: str = "source", doc_id: str = "doc_id", claimed: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (the id alone by default), leaf, subroot, root, proof_sha256, folded_root, verified and up of every row.

    ``claimed``: the leaf that is held against the tree, by default the row's own; ``folded_root`` is what it leads to.
    ``up`` lists the siblings of the row's path as ``left,right;`` from the leaf to the root, enough for ``fold``.
    """
    held = [c for c in (keep if keep is not None else [doc_id]) if c not in (*ADDED, "up")]
    other = F.lit(None).cast("string") if claimed is None else F.nullif(claimed, leaf)
    rows = save(spark, docs.select(*(F.col(c).alias(f"_in_{c}") for c in held), F.col(group).cast("string").alias("_group"), F.col(doc_id).alias("_id"), leaf.alias("digest"), other.alias("claimed")), "merkle-leaves")
    inside = T.StructType([T.StructField(f"_in_{c}", docs.schema[c].dataType) for c in held])
    ordered, runs, parts, n_groups = numbered(spark, rows)
    drop(spark, rows)
    rims, count = [], parts
    below = state(runs, RUN).unionAll(state(ordered, NODE, grp=F.shiftright("at", 33)))
    while count:  # up: the rims of each round, until one partition is left
        rim = save(spark, merged(below, n_groups), "merkle-rim")
        rims.append(rim)
        if count == 1:
            break
        count = -(-count // FAN)
        below = joined_rims(rim)
    root = rims[-1].select("digest").first()[0] if rims else ""
    given = state(runs, RUN, inside)
    if rims:  # down: nothing lies above the root; each round's nodes get what lies above them
        above = state(rims[-1], ABOVE, up=F.lit(""))
        for rim in rims[-2::-1]:
            above = save(spark, handed_down(state(above, ABOVE).unionAll(joined_rims(rim)), n_groups), "merkle-above")
        given = given.unionAll(state(above, ABOVE, inside))
    out = proved(given.unionAll(state(ordered, NODE, inside, grp=F.shiftright("at", 33))), n_groups, root, inside)
    return out.select(*(F.col(f"_in_{c}").alias(c) for c in held), *ADDED, "up")


def joined_rims(rim: DataFrame) -> DataFrame:
    """Nodes of a round's rims, ``FAN`` neighbouring partitions to a group; ``at`` keeps the partition that they come from."""
    return state(rim, NODE, grp=F.expr(f"grp div {FAN}"), at=F.col("grp"))
