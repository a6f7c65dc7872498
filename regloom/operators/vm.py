"""Execution: all programs of an Arrow batch go on step by step together, each in arrays of its own row.

``run`` is a map over rows: no shuffle, no state between batches. A program that cannot go on gets a status and
keeps the trace up to that point, so that one bad row never ends a job; ``strict`` raises instead.

Statuses: ``halted`` (HALT, or the end was passed), ``step_cap``, ``stack_overflow``, ``stack_underflow``, ``userop``,
``bad_op`` (unknown or null operation), ``bad_target``, ``bad_register`` (index outside 0..7, or too few arguments).
A null program has a null trace and status; an empty one halts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isa, tokens
from . import batch, prompts
from .batch import CODE, NONE, Programs

#: Programs that go on together, with and without step records; bounds the memory of a worker.
TOGETHER = {True: 1024, False: 8192}
#: Programs whose prompts are made together.
SHOWN = 64
STATUS = ["running", "halted", "stack_overflow", "stack_underflow", "userop", "bad_op", "bad_target", "bad_register"]
RUNNING, HALTED, OVER, UNDER, USEROP, BAD_OP, BAD_TARGET, BAD_REGISTER = range(8)
_WRITES = np.array([o.writes for o in isa.OPS.values()] + [False])
_PROMPT = "STRUCT<input_ids:ARRAY<INT>,target_ids:ARRAY<INT>,input_text:STRING,target_text:STRING>"
_END = "STRUCT<steps:{steps},output:ARRAY<INT>,regs:ARRAY<INT>,stack:ARRAY<INT>,status:STRING>".format(steps=f"ARRAY<{isa.STEP}>")


def faults(p: Programs) -> np.ndarray:
    """For each instruction the status that it brings whenever it is reached (0: none)."""
    fine = lambda x: (x >= 0) & (x < isa.REGISTERS)
    n = batch.REGISTERS[p.op]
    bad = (n > 0) & ~fine(p.a) | (n > 1) & ~fine(p.b) | (n > 2) & ~fine(p.c) | (p.op == CODE["LOAD"]) & (p.b == NONE)
    slot = (p.op >= CODE["USEROP_0"]) & (p.op != batch.UNKNOWN)
    return np.where(slot, USEROP, np.where(p.op == batch.UNKNOWN, BAD_OP, np.where(bad, BAD_REGISTER, 0)))


def suffices(p: Programs, turns: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Steps for programs whose loops run ``turns`` times in all; without backward jumps the size is enough."""
    back = p.any((p.to >= 0) & (p.to <= p.place))
    return np.maximum(1, np.minimum(np.where(back, p.size * (1 + turns), p.size), cap))


def executed(p: Programs, fuel: np.ndarray, keep: bool) -> pa.Array:
    """Runs of programs, ``fuel`` steps of each at most, as Arrow structs; ``keep``: with a record of each step."""
    n, fault = p.n, faults(p)
    regs, stack = np.zeros((n, isa.REGISTERS), np.int32), np.zeros((n, isa.DEPTH + 1), np.int32)
    depth, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    status = np.where(p.size == 0, HALTED, RUNNING)
    a, b, c = (np.where((x >= 0) & (x < isa.REGISTERS), x, 0) for x in (p.a, p.b, p.c))
    literal, to = np.clip(p.b, isa.LOW, isa.HIGH), p.to
    live, t, steps, printed = np.flatnonzero(p.size > 0), 0, [], []
    while len(live):
        i = p.at[live] + at[live]
        op, f, first = p.op[i], fault[i], regs[live, a[i]]
        jumps = (op == CODE["JMP"]) | (op == CODE["JZ"]) & (first == 0)
        f = np.where(f > 0, f, np.where((op == CODE["PUSH"]) & (depth[live] >= isa.DEPTH), OVER, np.where((op == CODE["POP"]) & (depth[live] == 0), UNDER, np.where(jumps & (to[i] < 0), BAD_TARGET, 0))))
        if f.any():
            status[live[f > 0]] = f[f > 0]
            on = f == 0
            live, i, op, first, jumps = live[on], i[on], op[on], first[on], jumps[on]
        x, y = regs[live, b[i]], regs[live, c[i]]
        quotient = np.sign(x) * np.sign(y) * (np.abs(x) // np.maximum(np.abs(y), 1))
        made = [literal[i], x, x + y, x - y, x * y, quotient, -x, x == y, x < y]
        writes = np.flatnonzero(_WRITES[op])
        pops, pushes, prints = (np.flatnonzero(op == CODE[o]) for o in ("POP", "PUSH", "PRINT"))
        value = np.clip(np.choose(np.where(op < len(made), op, 1), made), isa.LOW, isa.HIGH)
        if len(pops):
            depth[live[pops]] -= 1
            value[pops] = stack[live[pops], depth[live[pops]]]
        if len(pushes):
            stack[live[pushes], depth[live[pushes]]] = first[pushes]
            depth[live[pushes]] += 1
        regs[live[writes], a[i[writes]]] = value[writes]
        if len(prints):
            printed.append((live[prints], first[prints]))
        if keep:
            steps.append((live, at[live], regs[live], depth[live], stack[live] if depth[live].any() else None, np.where(op == CODE["PRINT"], first.astype(np.int64), NONE)))
        at[live] = np.where(jumps, to[i], at[live] + 1)
        done = (op == CODE["HALT"]) | (at[live] >= p.size[live])
        status[live[done]] = HALTED
        t += 1
        live = live[~done & (t < fuel[live])]
    told = [pa.array([*STATUS[1:], "step_cap"]).take(pa.array(np.where(status == RUNNING, len(STATUS) - 1, status - 1)))]
    ends = np.arange(isa.DEPTH + 1) < depth[:, None]
    shown = _by_row(n, [r for r, _ in printed], [v for _, v in printed])
    fields = [_steps(n, steps) if keep else batch.lists(np.zeros(n, np.int64), _records(0, *(np.zeros(0, np.int64) for _ in range(5)))), shown, batch.lists(np.full(n, isa.REGISTERS), regs.ravel()), batch.lists(depth, stack[ends]), *told]
    return pa.StructArray.from_arrays(fields, names=["steps", "output", "regs", "stack", "status"], mask=pa.array(p.null))


def _by_row(n: int, rows: list[np.ndarray], values: list[np.ndarray]) -> pa.Array:
    """Lists by row of values that were found in order."""
    r, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, values))
    return batch.lists(np.bincount(r, minlength=n), v[np.argsort(r, kind="stable")])


def _records(n: int, pc: np.ndarray, regs: np.ndarray, depth: np.ndarray, stack: np.ndarray, emitted: np.ndarray) -> pa.Array:
    shown = pa.array(np.where(emitted == NONE, 0, emitted).astype(np.int32), mask=emitted == NONE)
    fields = [pa.array(pc.astype(np.int32)), batch.lists(np.full(n, isa.REGISTERS), regs.ravel()), batch.lists(depth, stack), shown]
    return pa.StructArray.from_arrays(fields, names=["pc", "regs", "stack", "emitted"])


def _steps(n: int, steps: list[tuple]) -> pa.Array:
    """Step records by row: step ``t`` of a row comes ``t`` places after its first."""
    if not steps:
        return batch.lists(np.zeros(n, np.int64), _records(0, *(np.zeros(0, np.int64) for _ in range(5))))
    rows = np.concatenate([s[0] for s in steps])
    size = np.bincount(rows, minlength=n)
    place = batch.offsets(size)[rows] + np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
    order = np.empty(len(rows), np.int64)
    order[place] = np.arange(len(rows))
    pc, regs, depth, emitted = (np.concatenate([s[k] for s in steps])[order] for k in (1, 2, 3, 5))
    stacks, start, held = [], [], 0  # the rows of stacks, of steps at which one is not empty
    for _, at, _, _, stack, _ in steps:
        start.append(np.full(len(at), -1) if stack is None else held + np.arange(len(at)))
        if stack is not None:
            stacks.append(stack)
            held += len(at)
    if stacks:
        each = np.concatenate(start)[order]
        flat = np.concatenate(stacks).ravel()[batch.ranges(np.maximum(each, 0) * (isa.DEPTH + 1), depth)]
    else:
        flat = np.zeros(0, np.int32)
    return batch.lists(size, _records(len(rows), pc, regs, depth, flat, emitted))


def _shown(p: Programs, end: pa.StructArray, modes: list[str]) -> Iterator[pa.Array]:
    """Runs with prompts, a few at a time; where a run did not end there are none."""
    for i in range(0, len(end), SHOWN):
        some = end.slice(i, SHOWN)
        if pc.all(pc.equal(some.field("status"), "halted")).as_py():
            made = prompts.rendered(Programs(p.column.slice(i, SHOWN)), some, modes)
        else:
            made = pa.nulls(len(some), pa.struct([(m, prompts.PROMPT) for m in modes]))
        yield pa.StructArray.from_arrays([*some.flatten(), made], names=["steps", "output", "regs", "stack", "status", "renders"])


def _machine(keep: bool, modes: list[str]):
    def machine(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for programs, turns, caps in batches:
            for start in range(0, len(programs), TOGETHER[keep]):
                p = Programs(programs.slice(start, TOGETHER[keep]))
                turn, cap = (np.asarray(x.slice(start, TOGETHER[keep]).fill_null(0)).astype(np.int64) for x in (turns, caps))
                fuel = np.where(turn < 0, np.maximum(1, cap), suffices(p, turn, np.where(cap > 0, cap, np.maximum(p.size, 4096))))
                end = executed(p, fuel, keep)
                yield from _shown(p, end, modes) if modes else [end]

    return machine


def fuel(program: Column, loops: Column | int = 0, cap: Column | int = isa.STEP_CAP) -> Column:
    """Steps that suffice for a program whose loops run ``loops`` times in all; without backward jumps its size is enough.

    ``run`` finds the same from ``turns`` without a look at the program of its own.
    """
    defined = F.transform(program, lambda x: x["label"])
    back = F.exists(F.transform(program, lambda x, i: F.array_position(defined, x["target"]).between(1, i + 1)), lambda x: x)
    turns = F.lit(loops) if isinstance(loops, int) else loops
    most = F.lit(cap) if isinstance(cap, int) else cap
    many = F.least(F.size(program).cast("long") * (1 + turns), most)
    return F.greatest(F.lit(1), F.when(back, many).otherwise(F.least(F.size(program), most))).cast("int")


def run(df: DataFrame, program: str = "program", steps: bool = True, limit: Column | int | None = None, strict: bool = False, turns: Column | int | None = None, modes: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``trace`` (steps, output, halted), ``regs`` and ``stack`` at the end, and ``status``.

    ``limit``: most steps of a row. By default the size for programs that only jump forward, and 4096 for others, since
    an endless loop runs to the limit. ``turns`` instead gives what a program needs whose loops run so often in all, up to
    the machine's cap of 1,000,000. A program that is not done by then has status step_cap (exactly if it would need
    another step). ``steps=False`` keeps no step records.
    ``modes``: ``renders`` is added, with these prompts (``tokens.renders``); this needs ``strict`` and steps.
    Columns of ``df`` with the names of added ones give way.
    """
    made = {"trace", "regs", "stack", "status"}
    wrap = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    if limit is not None:
        bounds = wrap(-1), F.greatest(F.lit(1), wrap(limit).cast("int")).cast("long")
    else:
        bounds = (wrap(isa.STEP_CAP), wrap(0)) if turns is None else (F.greatest(F.lit(0), wrap(turns)), wrap(isa.STEP_CAP))
    if modes and not (strict and steps):
        raise ValueError("prompts need strict runs with steps")
    if unknown := [m for m in modes if m not in tokens.RENDERS]:
        raise KeyError(unknown[0])
    made |= {"renders"} if modes else set()
    kind = _END.replace("status:STRING", f"status:STRING,renders:STRUCT<{','.join(f'{m}:{_PROMPT}' for m in modes)}>") if modes else _END
    held = batch.told(df.select(*(c for c in df.columns if c not in made)), "_end", _machine(steps, list(modes)), kind, program, *bounds)
    status = F.col("_end.status")
    if strict:
        status = F.when(status == "halted", status).otherwise(F.raise_error(F.concat(F.lit("program failed: "), status)))
    trace = F.struct(F.col("_end.steps").alias("steps"), F.col("_end.output").alias("output"), (F.col("_end.status") == "halted").alias("halted"))
    trace = F.when(F.col("_end").isNotNull(), trace)
    shown = {"renders": F.col("_end.renders")} if modes else {}
    return held.withColumns({"trace": trace, "regs": F.col("_end.regs"), "stack": F.col("_end.stack"), "status": F.when(F.col("_end").isNotNull(), status), **shown}).drop("_end")


def step_rows(df: DataFrame, ids: list[str], trace: str = "trace") -> DataFrame:
    """One row for each executed step: ids, t, pc, regs, stack, emitted."""
    return df.select(*ids, F.posexplode(f"{trace}.steps").alias("t", "s")).select(*ids, "t", "s.pc", "s.regs", "s.stack", "s.emitted")
