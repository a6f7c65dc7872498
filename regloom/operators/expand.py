"""Macro expansion: userops give way to the straight-line instructions that a template names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isa


def check_templates(templates: dict[str, list[tuple[str, list[int]]]]) -> None:
    """Templates are (operation, arguments) without labels or jumps; register arguments are places among the call's."""
    for symbol, lines in templates.items():
        for op, args in lines:
            shape = isa.OPS.get(op)
            if shape is None or shape.slot or shape.jumps:
                raise ValueError(f"template of {symbol}: {op} cannot stand in a straight-line template")
            if len(args) != shape.registers + shape.literals:
                raise ValueError(f"template of {symbol}: {op} takes {shape.registers + shape.literals} arguments")


def expand(program: Column, templates: dict[str, list[tuple[str, list[int]]]], bindings: dict[str, str] = isa.BINDINGS) -> Column:
    """The program with every userop replaced by its template. The call's label moves to the first line; literals stay.

    A userop whose symbol has no template makes the row fail with an error that names the slot.
    """
    check_templates(templates)

    def filled(x: Column, lines: list[tuple[str, list[int]]]) -> Column:
        made = []
        for n, (op, args) in enumerate(lines):
            regs = isa.OPS[op].registers
            mapped = [F.get(x["args"], F.lit(a)) if k < regs else F.lit(a) for k, a in enumerate(args)]
            made.append(isa.instruction(op, mapped, x["label"] if n == 0 else None))
        return F.array(*made).cast(isa.PROGRAM) if made else F.array().cast(isa.PROGRAM)

    def one(x: Column) -> Column:
        out = F.when(~F.coalesce(x["op"].startswith("USEROP_"), F.lit(False)), F.array(x))
        for slot, symbol in bindings.items():
            if symbol in templates:
                out = out.when(x["op"] == slot, filled(x, templates[symbol]))
        return out.otherwise(F.raise_error(F.concat(F.lit("no template for "), x["op"])).cast(isa.PROGRAM))

    return F.flatten(F.transform(program, one))


def expand_rows(code: DataFrame, templates: DataFrame, ids: list[str]) -> DataFrame:
    """The same over long tables: ``code`` (ids, pc, symbol, op, args, label), ``templates`` (symbol, k, op, args, registers).

    The join is on the symbol of userop rows only; templates are a small dimension that the optimizer may broadcast.
    Rows come back as ids, pc, k, op, args, label, to be ordered by (pc, k).
    """
    t = templates.select(F.col("symbol").alias("_symbol"), "k", F.col("op").alias("_op"), F.col("args").alias("_args"), "registers")
    both = code.join(t, F.col("symbol") == F.col("_symbol"), "left")
    mapped = F.transform(F.col("_args"), lambda a, k: F.when(k < F.col("registers"), F.get(F.col("args"), a)).otherwise(a))
    label = F.when(F.coalesce(F.col("k"), F.lit(0)) == 0, F.col("label"))
    made = F.when(F.col("symbol").isNotNull() & F.col("_symbol").isNull(), F.raise_error(F.concat(F.lit("no template for "), F.col("symbol"))).cast("string")).otherwise(F.coalesce("_op", "op"))
    return both.select(*ids, "pc", F.coalesce("k", F.lit(0)).alias("k"), made.alias("op"), F.coalesce(mapped, "args").alias("args"), label.alias("label"))
