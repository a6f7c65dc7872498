"""Prompts of many programs at once: what ``tokens.renders`` gives for programs that ran to their end, from an Arrow batch.

A sequence is a list of pieces (a token, or the tokens of a number) and is spelled out at the end, as ids and as text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..functions import isa, tokens
from .batch import CODE, NONE, REGISTERS, Programs, lists, offsets, ranges, sizes, texts

#: Numbers with a piece of their own: register values, literals, and labels (those not of the form L<n> from 10001 on).
LOWEST, HIGHEST = isa.LOW, 1 << 16
PROMPT = pa.struct([("input_ids", pa.list_(pa.int32())), ("target_ids", pa.list_(pa.int32())), ("input_text", pa.string()), ("target_text", pa.string())])
_STRIP = [isa.ID[t] for t in ("COLON", "EQUALS", "MINUS")]


@lru_cache
def _tables() -> tuple:
    """Ids of pieces, and bytes of ids (a second time without a blank at the end), each flat with first places and sizes."""
    spelled = [[i] for i in range(len(isa.TOKENS))] + [[isa.ID["MINUS" if c == "-" else c] for c in str(v)] for v in range(LOWEST, HIGHEST)]
    shown = [tokens._shown(i, name).encode() for i, name in enumerate(isa.TOKENS)]
    shown += [x.rstrip(b" ") for x in shown]
    sized = [np.array([len(x) for x in table]) for table in (spelled, shown)]
    flat = np.array([i for x in spelled for i in x], np.int32), np.frombuffer(b"".join(shown), np.uint8)
    return tuple((f, offsets(s)[:-1], s) for f, s in zip(flat, sized))


def _number(value: np.ndarray) -> np.ndarray:
    return value - LOWEST + len(isa.TOKENS)


def _labels(p: Programs) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each instruction's label and target, -1 for none."""
    label, target, named = p.marks
    plain = [re.fullmatch("L([0-9]+)", x) for x in named]
    value = np.array([int(m[1]) if m else -2 for m in plain] + [-1])
    out = value[label], value[target]
    for r in np.unique(p.rows[(out[0] == -2) | (out[1] == -2)]):  # names of other forms count by first definition in their program
        own = slice(p.at[r], p.at[r + 1])
        others = [x for x in dict.fromkeys([*label[own], *target[own]]) if x >= 0 and not plain[x]]
        for found, marked in zip(out, (label, target)):
            for i, x in enumerate(marked[own]):
                if x in others:
                    found[p.at[r] + i] = 10001 + others.index(x)
    return out


def _flat(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pieces without the absent ones (-1), flat, and their sizes."""
    there = table >= 0
    return table[there], there.sum(1)


def _lines(p: Programs) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all instructions, flat, and how many each has."""
    table, n = np.full((len(p.rows), 11), -1), REGISTERS[p.op]
    (label, target), load, jumps = _labels(p), p.op == CODE["LOAD"], np.isin(p.op, [CODE["JZ"], CODE["JMP"]])
    marked = label >= 0
    table[marked, 0], table[marked, 1], table[marked, 2] = isa.ID["L"], _number(label[marked]), isa.ID["COLON"]
    table[:, 3] = np.array([isa.ID[isa.BINDINGS.get(x, x)] for x in isa.OPS])[p.op]
    for k, x in enumerate((p.a, p.b, p.c)):
        table[n > k, 4 + k] = x[n > k] + isa.ID["R0"]
    table[load, 7] = _number(p.b[load])
    table[jumps, 8], table[jumps, 9], table[:, 10] = isa.ID["L"], _number(target[jumps]), isa.ID["NEWLINE"]
    return _flat(table)


def _prompt(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of BOS, the parts of each program one after the other, EOS. A part: pieces, flat, and sizes by program."""
    n = len(parts[0][1])
    ends = [(np.full(n, isa.ID[t]), np.ones(n, np.int64)) for t in ("BOS", "EOS")]
    parts = [ends[0], *parts, ends[1]]
    size = sum(s for _, s in parts)
    pieces, start = np.empty(int(size.sum()), np.int64), offsets(size)[:-1]
    for flat, s in parts:
        pieces[ranges(start, s)] = flat
        start = start + s
    (ids, first, many), (shown, at, width) = _tables()
    flat = ids[ranges(first[pieces], many[pieces])]
    size = np.diff(offsets(many[pieces])[offsets(size)])
    bare = np.append(np.isin(flat[1:], _STRIP), False)
    form = flat + len(isa.TOKENS) * bare
    return lists(size, flat), texts(np.diff(offsets(width[form])[offsets(size)]), shown[ranges(at[form], width[form])])


def rendered(p: Programs, end: pa.StructArray, modes: list[str]) -> pa.Array:
    """A struct of prompts by mode (direct, cot) of programs and their runs with step records."""
    flat, size = _lines(p)
    of = lambda x, rows: np.bincount(rows, x, p.n).astype(np.int64)
    code = flat, of(size, p.rows)
    output = end.field("output")
    shown = np.stack([_number(np.asarray(output.flatten()).astype(np.int64)), np.full(int(sizes(output).sum()), isa.ID["NEWLINE"])], 1).ravel()
    values, made = (shown, 2 * sizes(output)), {}
    for mode in modes:
        target = [values]
        if mode == "cot":
            steps = end.field("steps")
            many, each = sizes(steps), steps.flatten()
            rows = np.repeat(np.arange(p.n), many)
            i = p.at[rows] + np.asarray(each.field("pc"))
            told = np.empty((len(i), 3 * isa.REGISTERS + 1), np.int64)
            told[:, 0:-1:3], told[:, 1:-1:3], told[:, -1] = np.arange(isa.REGISTERS) + isa.ID["R0"], isa.ID["EQUALS"], isa.ID["NEWLINE"]
            told[:, 2::3] = _number(np.asarray(each.field("regs").flatten()).astype(np.int64)).reshape(-1, isa.REGISTERS)
            whole = size[i] + told.shape[1]
            pieces, start = np.empty(int(whole.sum()), np.int64), offsets(whole)[:-1]
            pieces[ranges(start, size[i])] = flat[ranges(offsets(size)[i], size[i])]
            pieces[ranges(start + size[i], np.full(len(i), told.shape[1]))] = told.ravel()
            target = [(pieces, of(whole, rows)), values]
        (input_ids, input_text), (target_ids, target_text) = _prompt([code]), _prompt(target)
        made[mode] = pa.StructArray.from_arrays([input_ids, target_ids, input_text, target_text], names=["input_ids", "target_ids", "input_text", "target_text"])
    return pa.StructArray.from_arrays(list(made.values()), names=list(made))
