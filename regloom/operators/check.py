"""Validation of programs: boolean columns and messages. Faults are found for all programs of an Arrow batch together; what
is said of them is put into words in the JVM, where there are any.

``straight_*`` are the set-oriented forms over long tables (one row for each instruction): windows and anti joins, for
programs that are stored that way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import isa
from . import batch
from .batch import CODE, NONE, Programs


def arity(program: Column) -> Column:
    """Messages of instructions whose arguments do not fit their operation."""
    sizes = isa.literal_map({o.name: o.registers + o.literals for o in isa.OPS.values()})

    def fault(x: Column, i: Column) -> Column:
        where = F.concat(F.lit(" at "), i.cast("string"))
        want = F.try_element_at(sizes, x["op"])
        return (
            F.when(want.isNull(), F.concat(F.lit("unknown operation"), where))
            .when(~F.coalesce(F.size(x["args"]) == want, F.lit(False)), F.concat(x["op"], F.lit(" has a wrong number of arguments"), where))
            .when(x["op"].isin("JZ", "JMP") & x["target"].isNull(), F.concat(x["op"], F.lit(" has no target"), where))
        )

    return F.filter(F.transform(program, fault), lambda x: x.isNotNull())


def targets(program: Column) -> Column:
    """Targets that no instruction defines, sorted."""
    return F.array_sort(F.array_compact(F.array_except(F.transform(program, lambda x: x["target"]), F.transform(program, lambda x: x["label"]))))


def ranges(program: Column) -> Column:
    """Messages of register numbers outside 0..7 and literals outside -127..127 (kept apart from validity)."""
    counts = isa.literal_map({o.name: o.registers for o in isa.OPS.values()})

    def fault(x: Column, i: Column) -> Column:
        n = F.coalesce(F.try_element_at(counts, x["op"]), F.lit(0))
        reg = F.exists(F.slice(x["args"], 1, n), lambda r: ~r.between(0, isa.REGISTERS - 1))
        lit = (x["op"] == "LOAD") & ~F.try_element_at(x["args"], F.lit(2)).between(isa.LITERAL_LOW, isa.LITERAL_HIGH)
        where = F.concat(F.lit(" out of range at "), i.cast("string"))
        return F.when(reg, F.concat(F.lit("register"), where)).when(lit, F.concat(F.lit("literal"), where))

    return F.filter(F.transform(program, fault), lambda x: x.isNotNull())


# Both analyses walk all instructions in order, again and again, until nothing changes, and all programs of an Arrow batch
# together. What control brings from the instruction before is one value of each program; only places that a jump can
# reach (slots) are remembered from walk to walk.

#: Programs that are walked together; bounds the memory of a worker.
TOGETHER = 4096
_FOUND = "ARRAY<STRUCT<i:INT,d:INT>>"
_TOLD = f"STRUCT<arity:BOOLEAN,labels:BOOLEAN,userops:BOOLEAN,ranges:BOOLEAN,prints:{_FOUND},stack:{_FOUND}>"


def _jumps(p: Programs) -> tuple[np.ndarray, np.ndarray]:
    """Of each instruction in the flat arrays: whether a jump leads to it, and where its own jump leads (-1: nowhere)."""
    leads = np.where(np.isin(p.op, [CODE["JZ"], CODE["JMP"]]) & (p.to >= 0), p.at[p.rows] + p.to, -1)
    slot = np.zeros(len(p.rows), bool)
    slot[leads[leads >= 0]] = True
    return slot, leads


def _walk(p: Programs, live: np.ndarray, step: Callable) -> None:
    """``step(rows, places)`` for the first instructions of ``live`` programs, then for the second ones, ..."""
    order = live[np.argsort(-p.size[live], kind="stable")]
    many = np.searchsorted(-p.size[order], -np.arange(p.size[order[0]]) if len(order) else [], "left")
    for i, n in enumerate(many):
        step(order[:n], p.at[order[:n]] + i)


def _settled(p: Programs, step: Callable) -> None:
    """Walks until no slot of a program changes, once more than it has instructions at most. ``step`` is given an array to mark changed programs in."""
    live, walks = np.flatnonzero(p.size > 0), 0
    while len(live):
        changed = np.zeros(p.n, bool)
        _walk(p, live, lambda rows, at: step(rows, at, changed))
        walks += 1
        live = live[changed[live] & (walks <= p.size[live])]


def unwritten(p: Programs, userops: bool) -> np.ndarray:
    """Places of prints whose register is not surely written; prints out of control's reach count.

    A userop writes its first register if ``userops``. Registers are bits of a number, -1: out of reach.
    """
    slot, leads = _jumps(p)
    writes = np.array([o.writes or userops and o.slot for o in isa.OPS.values()] + [False])[p.op] & p.known & (p.a >= 0) & (p.a < isa.REGISTERS)
    bit = np.where(writes, 1 << np.where(writes, p.a, 0), 0)
    stops, held, bad = np.isin(p.op, [CODE["HALT"], CODE["JMP"]]), np.full(len(p.rows), -1), []
    meet = lambda a, b: np.where(a == -1, b, np.where(b == -1, a, a & b))

    def step(rows: np.ndarray, at: np.ndarray, changed: np.ndarray | None, cur: np.ndarray) -> None:
        m = np.where(slot[at], meet(held[at], cur[rows]), cur[rows])
        out, reached = m | bit[at], m != -1
        cur[rows] = np.where(reached & ~stops[at], out, -1)
        if changed is None:
            shown = np.flatnonzero(p.op[at] == CODE["PRINT"])
            a = p.a[at[shown]]
            bad.append(at[shown[~((m[shown] >= 0) & (a != NONE) & (m[shown] >> (a & 31) & 1 == 1))]])
            return
        some = np.flatnonzero(reached & (leads[at] >= 0))
        to, old = leads[at[some]], held[leads[at[some]]]
        held[to] = meet(old, out[some])
        changed[rows[some]] |= held[to] != old

    _settled(p, _fresh(p, step))
    _walk(p, np.flatnonzero(p.size > 0), lambda rows, at, cur=np.zeros(p.n, np.int64): step(rows, at, None, cur))
    return np.sort(np.concatenate(bad)) if bad else np.zeros(0, np.int64)


def _fresh(p: Programs, step: Callable) -> Callable:
    """``step`` with what control brings, zeros at the first instructions of every walk."""
    cur = np.zeros(p.n, np.int64)

    def stepped(rows: np.ndarray, at: np.ndarray, changed: np.ndarray) -> None:
        first = rows[p.place[at] == 0]
        cur[first] = 0
        step(rows, at, changed, cur)

    return stepped


def misstacked(p: Programs) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stack fails, in order, and how: -2 underflow, -3 overflow, -4 paths that differ.

    What has failed once stays so and passes nothing on.
    """
    slot, leads = _jumps(p)
    delta = (p.op == CODE["PUSH"]).astype(np.int64) - (p.op == CODE["POP"])
    stops, held, bad = np.isin(p.op, [CODE["HALT"], CODE["JMP"]]), np.full(len(p.rows), -1), []
    meet = lambda a, b: np.where(a < -1, a, np.where(a == -1, b, np.where((b == -1) | (a == b), a, -4)))

    def step(rows: np.ndarray, at: np.ndarray, changed: np.ndarray, cur: np.ndarray) -> None:
        d = np.where(slot[at], meet(held[at], cur[rows]), cur[rows])
        depth = d + delta[at]
        w = np.where(d < 0, d, np.where(depth < 0, -2, np.where(depth > isa.DEPTH, -3, depth)))
        own = np.flatnonzero(slot[at])
        old, new = held[at[own]], np.where(w[own] < -1, w[own], d[own])
        held[at[own]] = new
        changed[rows[own]] |= new != old
        some = np.flatnonzero((w >= 0) & (leads[at] >= 0))
        to, old = leads[at[some]], held[leads[at[some]]]
        held[to] = meet(old, w[some])
        changed[rows[some]] |= held[to] != old
        wrong = np.flatnonzero((w < -1) & ~slot[at])
        if len(wrong):
            bad.append(at[wrong] * 8 - w[wrong])
        cur[rows] = np.where((w < 0) | stops[at], -1, w)

    _settled(p, _fresh(p, step))
    marked = np.flatnonzero(held < -1)
    found = np.unique(np.concatenate([*bad, marked * 8 - held[marked]]))
    found = found[np.lexsort((-(found % 8), found // 8))]
    return found // 8, -(found % 8)


def _told(p: Programs, userops: bool) -> pa.Array:
    """Whether programs may have faults of each kind, and where prints and the stack fail."""
    registers, literals = (np.where(p.known, x[p.op], 0) for x in (batch.REGISTERS, batch.LITERALS))
    label, target, named = p.marks
    jumps, load = np.isin(p.op, [CODE["JZ"], CODE["JMP"]]), p.op == CODE["LOAD"]
    arity = ~p.known | p.unlisted | (p.given != registers + literals) | jumps & (target < 0)
    defined = np.flatnonzero(label >= 0)
    keys, many = np.unique(p.rows[defined] * (len(named) + 1) + label[defined], return_counts=True)
    labels = p.any((target >= 0) & (p.to < 0))
    labels[keys[many > 1] // (len(named) + 1)] = True
    out = lambda x: (x != NONE) & ((x < 0) | (x >= isa.REGISTERS))
    off = (registers > 0) & out(p.a) | (registers > 1) & out(p.b) | (registers > 2) & out(p.c) | load & (p.b != NONE) & ((p.b < isa.LITERAL_LOW) | (p.b > isa.LITERAL_HIGH))
    prints, (stack, how) = unwritten(p, userops), misstacked(p)

    def listed(at: np.ndarray, d: np.ndarray) -> pa.Array:
        found = pa.StructArray.from_arrays([pa.array(p.place[at].astype(np.int32)), pa.array(d.astype(np.int32))], names=["i", "d"])
        return batch.lists(np.bincount(p.rows[at], minlength=p.n), found)

    flags = [pa.array(x) for x in (p.any(arity), labels, p.any((p.op >= CODE["USEROP_0"]) & (p.op != batch.UNKNOWN)), p.any(off))]
    return pa.StructArray.from_arrays([*flags, listed(prints, np.zeros(len(prints))), listed(stack, how)], names=["arity", "labels", "userops", "ranges", "prints", "stack"], mask=pa.array(p.null))


def _flow(userops: bool):
    def flow(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for programs in batches:
            for start in range(0, len(programs), TOGETHER):
                yield _told(Programs(programs.slice(start, TOGETHER)), userops)

    return flow


def validate(df: DataFrame, program: str = "program", userops: bool = False) -> DataFrame:
    """``df`` with ``valid`` and ``errors`` (ARRAY<STRING>), ``range_errors`` apart.

    The stages run in order and the first that finds something ends the list, as later ones would rest on it: argument
    counts, labels (targets without a definition, double definitions), prints of registers that some path has not
    written (an unreachable print counts as such), stack use. ``userops``: whether userops may stand in the program,
    each writing its first register. An empty program is valid; a null one has null columns.
    """
    keep = [c for c in df.columns if c not in ("valid", "errors", "range_errors")]
    p = F.col(program)
    out = batch.told(df.select(*keep), "_flow", _flow(userops), _TOLD, program)
    slots = F.filter(F.transform(p, lambda x, i: F.when(x["op"].startswith("USEROP_"), F.concat(F.lit("userop at "), i.cast("string")))), lambda x: x.isNotNull())
    doubled = F.transform(isa.duplicate_labels(p), lambda x: F.concat(F.lit("label defined twice: "), x))
    unknown = F.transform(targets(p), lambda x: F.concat(F.lit("unknown target: "), x))
    prints = F.expr("transform(_flow.prints, x -> concat('print of an unwritten register at ', x.i))")
    says = "CASE x.d WHEN -2 THEN 'stack underflow' WHEN -3 THEN 'stack overflow' ELSE 'stack depth differs between paths' END"
    stack = F.expr(f"transform(_flow.stack, x -> concat({says}, ' at ', x.i))")
    none = F.array().cast("array<string>")
    seldom = lambda flag, said: F.when(F.col(f"_flow.{flag}"), said)
    stages = [seldom("arity", arity(p)), seldom("labels", F.concat(doubled, unknown))] + ([] if userops else [seldom("userops", slots)]) + [F.coalesce(prints, none), F.coalesce(stack, none)]
    errors = F.coalesce(*(F.when(F.size(s) > 0, s) for s in stages), none)
    out = out.withColumns({"errors": F.when(p.isNotNull(), errors), "range_errors": F.when(p.isNotNull(), F.when(F.col("_flow.ranges"), ranges(p)).otherwise(none))})
    return out.withColumn("valid", F.size("errors") == 0).withColumn("valid", F.when(F.col("errors").isNotNull(), F.col("valid"))).select(*keep, "valid", "errors", "range_errors")


def straight_prints(code: DataFrame, ids: list[str]) -> DataFrame:
    """PRINT rows of a long table (ids, pc, op, a) of straight-line programs, with ``ok``: the register was written before."""
    before = W.partitionBy(*ids).orderBy("pc").rowsBetween(W.unboundedPreceding, -1)
    mask = F.when(F.col("op").isin(isa.WRITING), F.expr("shiftleft(1, a)")).otherwise(0)
    seen = code.withColumn("_seen", F.coalesce(F.bit_or(mask).over(before), F.lit(0)))
    return seen.where(F.col("op") == "PRINT").select(*ids, "pc", "a", F.expr("(_seen & shiftleft(1, a)) <> 0").alias("ok"))


def straight_stack(code: DataFrame, ids: list[str]) -> DataFrame:
    """For each straight-line program its least, greatest and last stack depth, and ``ok``."""
    so_far = W.partitionBy(*ids).orderBy("pc").rowsBetween(W.unboundedPreceding, 0)
    delta = F.when(F.col("op") == "PUSH", 1).when(F.col("op") == "POP", -1).otherwise(0)
    depth = code.withColumn("_delta", delta).withColumn("_depth", F.sum("_delta").over(so_far))
    out = depth.groupBy(*ids).agg(F.min("_depth").alias("least"), F.max("_depth").alias("most"), F.sum("_delta").alias("last"))
    return out.withColumn("ok", (F.col("least") >= 0) & (F.col("most") <= isa.DEPTH))


def straight_targets(code: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of a long table (ids, pc, label, target) whose target no row of the same program defines."""
    defined = code.where(F.col("label").isNotNull()).select(*ids, F.col("label").alias("target")).distinct()
    return code.where(F.col("target").isNotNull()).join(defined, [*ids, "target"], "left_anti").select(*ids, "pc", "target")
