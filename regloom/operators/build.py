"""Programs from what was drawn for them, in Python workers: lines (op, args, label, target) of a row, and rows as an Arrow array.

Both kinds of draws, those of Python's generator (``exact``) and those by counter (``generate``), make the same records.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

from . import batch

Line = tuple[str, list[int], str | None, str | None]
HALT: Line = ("HALT", [], None, None)


def _block(block: Iterable[dict]) -> list[Line]:
    return [(x["op"], x["args"], None, None) for x in block]


def _labelled(block: list[Line], label: str) -> list[Line]:
    return [(*x[:2], label, x[3]) for x in block[:1]] + block[1:]


def counter(d: dict) -> list[Line]:
    return [("LOAD", [0, d["value"]], None, None), *((op, [0, 0, 0] if op in ("ADD", "SUB") else [0, 0], None, None) for op in d["ops"]), ("PRINT", [0], None, None), HALT]


def register_trace(d: list[dict]) -> list[Line]:
    return [*_block(d), ("PRINT", [d[-1]["args"][0]], None, None), HALT]


def _branch(x: dict) -> list[Line]:
    """A test into ``c``; if it gives 0 control goes to ``other`` (None: to the end), else ``then`` runs. MOV tests ``y`` alone."""
    head = (x["test"], [x["c"], x["y"]] if x["test"] == "MOV" else [x["c"], x["x"], x["y"]], None, None)
    first, last = x["marks"]
    if x["other"] is None:
        return [head, ("JZ", [x["c"]], None, last), *_block(x["then"]), ("NOP", [], last, None)]
    return [head, ("JZ", [x["c"]], None, first), *_block(x["then"]), ("JMP", [], None, last), *_labelled(_block(x["other"]), first), ("NOP", [], last, None)]


def _loop(x: dict, one: int, limit: int | None, diff: int | None) -> list[Line]:
    """A loop of ``turns`` rounds: after (counts down, tested at the end), before (tested at the top) or up (counts up to ``limit``)."""
    c, (top, done), body = x["c"], x["marks"], _block(x["body"])
    back, end, down = ("JMP", [], None, top), ("NOP", [], done, None), ("SUB", [c, c, one], None, None)
    if x["kind"] == "up":
        return [("LOAD", [c, 0], None, None), ("LOAD", [limit, x["turns"]], None, None), *_labelled(body, top), ("ADD", [c, c, one], None, None), ("SUB", [diff, limit, c], None, None), ("JZ", [diff], None, done), back, end]
    load = ("LOAD", [c, x["turns"]], None, None)
    if x["kind"] == "before":
        return [load, ("JZ", [c], top, done), *body, down, back, end]
    return [load, *_labelled(body, top), down, ("JZ", [c], None, done), back, end]


def _marked(x: dict) -> dict:
    """A structure with its two labels: its own ``marks``, or those numbered from ``at`` (a branch without an other side has one)."""
    return x if "marks" in x else x | {"marks": (f"L{x['at']}", f"L{x['at'] + (x.get('other', ()) is not None)}")}


def branched(d: dict) -> list[Line]:
    out = [("LOAD", [d["one"], 1], None, None), ("LOAD", [d["shown"], d["value"]], None, None), *_block(d["start"])]
    for x in d["branches"]:
        out += _branch(_marked(x))
    for x in d["loops"]:
        out += _loop(_marked(x), d["one"], d.get("limit"), d.get("diff"))
    for x in d["frames"]:
        out += [("PUSH", [x["save"]], None, None), *_block(x["body"]), ("POP", [x["back"]], None, None)]
    return [*out, ("PRINT", [d["shown"]], None, None), HALT]


def arrow(programs: list[list[Line] | None]) -> pa.Array:
    """Programs as an Arrow array of ``isa.PROGRAM``."""
    null, programs = np.array([x is None for x in programs], bool), [x or [] for x in programs]
    op, args, label, target = zip(*chain.from_iterable(programs)) if any(programs) else ((), (), (), ())
    size = np.fromiter(map(len, args), np.int64, len(args))
    given = batch.lists(size, np.fromiter(chain.from_iterable(args), np.int32, int(size.sum())))
    lines = pa.StructArray.from_arrays([pa.array(op, pa.string()), given, pa.array(label, pa.string()), pa.array(target, pa.string())], names=["op", "args", "label", "target"])
    return batch.lists(np.fromiter(map(len, programs), np.int64, len(programs)), lines, null)
