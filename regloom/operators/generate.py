"""Programs from seeds by counter: each draw is a slice of a SHA-256 of the seed and a counter.

No draw depends on an earlier one: no state, and other engines give the same programs from the same formula. Blocks of
instructions and branched programs are made in Arrow batches, the rest by Column expressions. ``exact`` draws from Python's
Mersenne Twister instead and builds its programs from the same pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from struct import unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isa
from ..sources.specs import words
from . import batch, build

_PROGRAM = isa.PROGRAM


def _key(seed: Column, *tags: Column | str | int) -> Column:
    out = [seed.cast("string")]
    for t in tags:
        out += [F.lit("|"), t.cast("string") if isinstance(t, Column) else F.lit(str(t))]
    return F.concat(*out)


def _pick(items: Column, draw: Column) -> Column:
    return F.get(items, (draw % F.size(items)).cast("int"))


def _literal(draw: Column) -> Column:
    return (draw % (isa.LITERAL_HIGH - isa.LITERAL_LOW + 1) + isa.LITERAL_LOW).cast("int")


def draw(seed: Column, tag: str, i: int | Column, below: int) -> Column:
    """Draw number ``i`` (0 to 7) of a tag, below a bound."""
    return F.get(words(_key(seed, tag)), F.lit(i) if isinstance(i, int) else i) % below


def registers(seed: Column, k: Column | int) -> Column:
    """``k`` different registers: all eight ordered by a draw each, the first ``k``. ``k`` outside 1..8 raises."""
    order = F.array_sort(F.transform(words(_key(seed, "registers")), lambda w, r: F.struct(w.alias("w"), r.cast("int").alias("r"))))
    k = F.lit(k) if isinstance(k, int) else k
    fine = F.when(k.between(1, isa.REGISTERS), k).otherwise(F.raise_error(F.lit("k must be from 1 to 8")).cast("int"))
    return F.transform(F.slice(order, F.lit(1), fine), lambda x: x["r"])


def _words(key: str) -> tuple[int, ...]:
    """``specs.words`` in a Python worker."""
    return unpack(">8I", sha256(key.encode()).digest())


def fill(seed: Column, tag: str, n: Column, active: Column, writable: Column | None = None) -> Column:
    """``n`` straight-line instructions: destinations from ``writable``, sources from ``active``; draws tagged tag|i."""
    return batch.column(_filled, _PROGRAM)(seed.cast("string"), F.lit(tag), n, active, active if writable is None else writable)


def _filled(seed: pa.Array, tag: pa.Array, n: pa.Array, active: pa.Array, writable: pa.Array) -> pa.Array:
    many = np.maximum(np.asarray(n.fill_null(0)), 0).astype(np.int64)
    drawn = b"".join(sha256(f"{s}|{t}|{i}".encode()).digest() for s, t, k in zip(seed.to_pylist(), tag.to_pylist(), many.tolist()) for i in range(1, k + 1))
    d, rows = np.frombuffer(drawn, ">u4").reshape(-1, 8).astype(np.int64), np.repeat(np.arange(len(many)), many)

    def pick(items: pa.Array, draw: np.ndarray) -> np.ndarray:
        size, flat = batch.sizes(items), np.asarray(items.flatten())
        return flat[batch.offsets(size)[rows] + draw % size[rows]]

    op = d[:, 0] % len(isa.FILL)
    a, b, c = pick(writable, d[:, 1]), pick(active, d[:, 2]), pick(active, d[:, 3])
    b = np.where(op == batch.CODE["LOAD"], d[:, 4] % (isa.LITERAL_HIGH - isa.LITERAL_LOW + 1) + isa.LITERAL_LOW, b)
    size = batch.REGISTERS[op] + batch.LITERALS[op]
    args = batch.lists(size, np.stack([a, b, c], 1)[np.arange(3) < size[:, None]])
    none = pa.nulls(len(rows), pa.string())
    return batch.lists(many, pa.StructArray.from_arrays([pa.array(isa.FILL).take(pa.array(op)), args, none, none], names=["op", "args", "label", "target"]))


def counter(df: DataFrame, seed: str = "seed", n: str = "n") -> DataFrame:
    """Adds ``program``: LOAD R0, n-1 of ADD, SUB, NEG, MOV on R0, PRINT, HALT."""
    s = F.col(seed)
    ops = F.array(*(F.lit(x) for x in ("ADD", "SUB", "NEG", "MOV")))

    def one(i: Column) -> Column:
        op = _pick(ops, F.get(words(_key(s, "op", i)), F.lit(0)))
        args = F.when(op.isin("ADD", "SUB"), F.array(F.lit(0), F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(0)))
        return F.struct(op.alias("op"), args.alias("args"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("target"))

    first = F.array(isa.instruction("LOAD", [F.lit(0), _literal(F.get(words(_key(s, "start")), F.lit(0)))]))
    body = F.when(F.col(n) > 1, F.transform(F.sequence(F.lit(1), F.col(n) - 1), one)).otherwise(F.array().cast(_PROGRAM))
    return df.withColumn("program", F.concat(first.cast(_PROGRAM), body.cast(_PROGRAM), F.array(isa.instruction("PRINT", [0]), isa.instruction("HALT")).cast(_PROGRAM)))


def register_trace(df: DataFrame, seed: str = "seed", n: str = "n", k: str = "k", distractors: int = 0, random_print: bool = False) -> DataFrame:
    """Adds ``program``: n fill instructions over k registers, PRINT of the last written register, HALT.

    ``distractors``: so many of the registers (all but one at most) are never printed while another was written; if only
    these were written, the print reads an unwritten register and ``check.validate`` says so. ``random_print``: the
    printed register is drawn from all writes.
    """
    s = F.col(seed)
    out = isa.once(df, "_active", registers(s, F.col(k)))
    out = out.withColumn("_body", fill(s, "fill", F.col(n), F.col("_active")))
    quiet = F.slice(F.col("_active"), F.lit(1), F.least(F.lit(distractors), F.size("_active") - 1))
    wrote = F.filter(F.transform("_body", lambda x: F.get(x["args"], F.lit(0))), lambda r: ~F.array_contains(quiet, r))
    pool = F.when(F.size(wrote) > 0, wrote).otherwise(F.array_except("_active", quiet))
    target = _pick(pool, F.get(words(_key(s, "print")), F.lit(0))) if random_print else F.when(F.size(wrote) > 0, F.element_at(pool, -1)).otherwise(F.get(pool, F.lit(0)))
    tail = ending(target)
    return out.withColumn("program", F.concat(F.col("_body").cast(_PROGRAM), tail.cast(_PROGRAM))).drop("_active", "_body")


def _labelled(block: Column, label: Column) -> Column:
    """The block with a label on its first instruction."""
    return F.transform(block, lambda x, i: F.struct(x["op"].alias("op"), x["args"].alias("args"), F.when(i == 0, label).alias("label"), x["target"].alias("target")))


def _program(*parts: Column) -> Column:
    return F.concat(*(p.cast(_PROGRAM) for p in parts))


def branch(test: Column, c: Column, x: Column, y: Column, then: Column, other: Column | None, other_at: Column, end_at: Column) -> Column:
    """A test into ``c``; if it gives 0 control goes to ``other`` (null or None: to the end), else ``then`` runs. MOV tests ``y`` alone."""
    head = F.when(test == "MOV", F.array(isa.instruction("MOV", [c, y]))).otherwise(F.array(isa.instruction(test, [c, x, y])))
    end = F.array(isa.instruction("NOP", label=end_at))
    plain = _program(head, F.array(isa.instruction("JZ", [c], target=end_at)), then, end)
    if other is None:
        return plain
    both = _program(head, F.array(isa.instruction("JZ", [c], target=other_at)), then, F.array(isa.instruction("JMP", target=end_at)), _labelled(other, other_at), end)
    return F.when(other.isNull(), plain).otherwise(both)


def loop(kind: Column, c: Column, one: Column, turns: Column, body: Column, top: Column, done: Column, limit: Column | None = None, diff: Column | None = None) -> Column:
    """A loop of ``turns`` rounds: after (counts down, tested at the end), before (tested at the top) or up (counts up to ``limit``)."""
    load, back, end = F.array(isa.instruction("LOAD", [c, turns])), F.array(isa.instruction("JMP", target=top)), F.array(isa.instruction("NOP", label=done))
    down, leave = F.array(isa.instruction("SUB", [c, c, one])), lambda label=None: F.array(isa.instruction("JZ", [c], label, done))
    after = _program(load, _labelled(body, top), down, leave(), back, end)
    before = _program(load, leave(top), body, down, back, end)
    made = F.when(kind == "before", before)
    if limit is not None:
        start = F.array(isa.instruction("LOAD", [c, F.lit(0)]), isa.instruction("LOAD", [limit, turns]))
        count = F.array(isa.instruction("ADD", [c, c, one]), isa.instruction("SUB", [diff, limit, c]), isa.instruction("JZ", [diff], target=done))
        made = made.when(kind == "up", _program(start, _labelled(body, top), count, back, end))
    return made.otherwise(after)


def frame(save: Column, back: Column, body: Column) -> Column:
    """A value kept on the stack around ``body``."""
    return _program(F.array(isa.instruction("PUSH", [save])), body, F.array(isa.instruction("POP", [back])))


def ending(shown: Column) -> Column:
    return F.array(isa.instruction("PRINT", [shown]), isa.instruction("HALT"))


def _block(seed: str, tag: str, n: int, active: list[int], writable: list[int]) -> list[dict]:
    """``fill`` for one block, as a record."""
    made, w, r = [], len(writable), len(active)
    for i in range(1, n + 1):
        d = _words(f"{seed}|{tag}|{i}")
        op = isa.FILL[d[0] % len(isa.FILL)]
        if op == "LOAD":
            args = [writable[d[1] % w], d[4] % (isa.LITERAL_HIGH - isa.LITERAL_LOW + 1) + isa.LITERAL_LOW]
        else:
            args = [writable[d[1] % w], active[d[2] % r], active[d[3] % r]][: isa.OPS[op].registers]
        made.append({"op": op, "args": args})
    return made


def _branched(s: str, n: int, k: int, b: int, l: int, frames: int) -> dict:
    """What a branched program draws; see ``branched``."""
    if not 1 <= k <= isa.REGISTERS:
        raise ValueError(f"k must be from 1 to {isa.REGISTERS}, not {k}")
    active = [r for _, r in sorted((w, r) for r, w in enumerate(_words(f"{s}|registers")))][:k]
    loops = min(_words(f"{s}|loops")[0] % min(4, l) + 1, k - 2) if l > 0 else 0
    counters, free = active[k - 1 - loops : k - 1], active[: k - 1 - loops]
    each = max(1, n // (b + loops + 1))
    cuts = [0, *sorted(i for _, i in sorted((_words(f"{s}|cut|{i}")[0], i) for i in range(1, max(l, 2)))[: max(loops - 1, 0)]), l] if loops else []
    d = _words(f"{s}|print")
    out = {"one": active[-1], "shown": free[d[0] % len(free)], "value": d[1] % (isa.LITERAL_HIGH - isa.LITERAL_LOW + 1) + isa.LITERAL_LOW}
    out |= {"start": _block(s, "start", max(k, 4), active, free), "branches": [], "loops": [], "frames": []}
    for i in range(b):
        d = _words(f"{s}|branch|{i}")
        test = ("ADD", "SUB", "MUL")[d[4] % 3] if d[3] % 5 == 0 else ("LT", "EQ")[d[4] % 2]
        sides = {"then": _block(s, f"then|{i}", each, active, free), "other": _block(s, f"else|{i}", each, active, free) if d[3] % 5 >= 3 else None}
        out["branches"].append({"test": test, "c": free[d[2] % len(free)], "x": active[d[0] % k], "y": active[d[1] % k], **sides, "marks": (f"L{2 * i}", f"L{2 * i + 1}")})
    for i, c in enumerate(counters):
        kind = ("after", "before")[_words(f"{s}|loop|{i}")[0] % 2]
        out["loops"].append({"kind": kind, "c": c, "turns": cuts[i + 1] - cuts[i], "body": _block(s, f"loop|{i}", each, active, free), "marks": (f"L{1000 + 2 * i}", f"L{1001 + 2 * i}")})
    for i in range(frames):
        d = _words(f"{s}|frame|{i}")
        out["frames"].append({"save": active[d[0] % k], "back": free[d[1] % len(free)], "body": _block(s, f"frame|{i}", max(2, each // 2), active, free)})
    return out


#: Programs that are made together; bounds the memory of a worker.
TOGETHER = 2048


def _programs(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        rows = list(zip(*(c.to_pylist() for c in columns)))
        for i in range(0, len(rows), TOGETHER):
            yield build.arrow([None if None in r else build.branched(_branched(*r)) for r in rows[i : i + TOGETHER]])


def branched(df: DataFrame, seed: str = "seed") -> DataFrame:
    """Adds ``program`` from n, k, b, l, use_stack, stack_frames: b branches, loops that run l times in all, stack frames.

    Of the k registers the last is the constant 1 and one is the counter of each loop (k-2 loops, four and l at most); fills never
    write these. A register is loaded at the start and printed at the end. Loop turns are cut at drawn places.
    """
    frames = F.when(F.col("use_stack"), F.col("stack_frames")).otherwise(0)
    made = batch.column(_programs, _PROGRAM)(F.col(seed).cast("string"), "n", F.greatest("k", F.lit(2)), "b", "l", frames)
    return df.withColumn("program", made)


def make(df: DataFrame, tier: str) -> DataFrame:
    """Adds ``program`` by tier, from columns seed and the axes."""
    makers = {"tier0": counter, "tier1": register_trace, "tier2": branched}
    if tier not in makers:
        raise ValueError(f"unknown tier {tier!r}; there are {', '.join(makers)}")
    return makers[tier](df)
