"""The register machine as data: limits, operations, vocabulary, and the scalar expressions that need nothing else.

A program is a column ``ARRAY<STRUCT<op STRING, args ARRAY<INT>, label STRING, target STRING>>``. Every function takes
and gives Columns, so that plans stay inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERS, LOW, HIGH, DEPTH = 8, -1024, 1023, 16
LITERAL_LOW, LITERAL_HIGH, STEP_CAP = -127, 127, 1_000_000

INSTRUCTION = "STRUCT<op:STRING,args:ARRAY<INT>,label:STRING,target:STRING>"
PROGRAM = f"ARRAY<{INSTRUCTION}>"
STEP = "STRUCT<pc:INT,regs:ARRAY<INT>,stack:ARRAY<INT>,emitted:INT>"
TRACE = f"STRUCT<steps:ARRAY<{STEP}>,output:ARRAY<INT>,halted:BOOLEAN>"


@dataclass(frozen=True)
class Op:
    """registers, literals: how many arguments of each kind; jumps: has a target; writes: changes its first register."""

    name: str
    code: int
    registers: int = 0
    literals: int = 0
    jumps: bool = False
    writes: bool = False
    slot: bool = False


# Names, codes and argument shapes of the operations.
OPS = {
    op.name: op
    for op in (
        Op("LOAD", 0, 1, 1, writes=True),
        Op("MOV", 1, 2, writes=True),
        Op("ADD", 2, 3, writes=True),
        Op("SUB", 3, 3, writes=True),
        Op("MUL", 4, 3, writes=True),
        Op("DIV", 5, 3, writes=True),
        Op("NEG", 6, 2, writes=True),
        Op("EQ", 7, 3, writes=True),
        Op("LT", 8, 3, writes=True),
        Op("JZ", 9, 1, jumps=True),
        Op("JMP", 10, jumps=True),
        Op("PUSH", 11, 1),
        Op("POP", 12, 1, writes=True),
        Op("PRINT", 13, 1),
        Op("NOP", 14),
        Op("HALT", 15),
        Op("USEROP_0", 16, 2, slot=True),
        Op("USEROP_1", 17, 3, slot=True),
        Op("USEROP_2", 18, 2, slot=True),
        Op("USEROP_3", 19, 3, slot=True),
        Op("USEROP_4", 20, 2, slot=True),
    )
}
BASE = [op.name for op in OPS.values() if not op.slot]
FILL = BASE[:9]
WRITING = [op.name for op in OPS.values() if op.writes]

#: Symbol bound to each userop slot; pass another mapping where a symbol is bound per dataset.
BINDINGS = {"USEROP_0": "DOUBLE", "USEROP_1": "MAX", "USEROP_2": "ABS", "USEROP_3": "MOD", "USEROP_4": "SIGN"}

# The 64 tokens, id by place.
TOKENS = (
    BASE
    + [f"R{i}" for i in range(REGISTERS)]
    + [str(i) for i in range(10)]
    + ["MINUS", "L", "COLON", "EQUALS", "DECOMP", "NEWLINE", "BOS", "EOS", "PAD", "?"]
    + list(BINDINGS.values())
)
TOKENS += [f"RESERVED_{i}" for i in range(64 - len(TOKENS))]
ID = {name: i for i, name in enumerate(TOKENS)}


def names(kind: list[str] | tuple[str, ...]) -> str:
    """A list for SQL's IN."""
    return ", ".join(f"'{x}'" for x in kind)


def literal_map(pairs: dict) -> Column:
    """A constant map; folded once by the optimizer."""
    return F.create_map(*(x if isinstance(x, Column) else F.lit(x) for pair in pairs.items() for x in pair))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once for each row.

    An explode of one element stands between it and later filters and projections: the optimizer would otherwise write
    the whole expression again wherever they use a part of it.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def given(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda every mention of an expression would compute it again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def op_number(op: Column) -> Column:
    """Code of an operation's name; null for an unknown name."""
    return F.try_element_at(literal_map({o.name: o.code for o in OPS.values()}), op)


def op_name(code: Column) -> Column:
    """Name of an operation's code; null for an unknown code."""
    return F.try_element_at(literal_map({o.code: o.name for o in OPS.values()}), code)


def clamp(x: Column) -> Column:
    """Saturated to the register range; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(LOW), F.least(F.lit(HIGH), x)))


def divide(a: Column, b: Column) -> Column:
    """Quotient rounded towards zero; 0 for a zero divisor."""
    return F.when(b == 0, 0).when(b.isNotNull(), F.call_function("div", a, F.when(b != 0, b)).cast("int"))


def alu(op: str, a: Column, b: Column | None = None) -> Column:
    """Value that ``op`` writes, from the values of its sources (for LOAD: of its literal)."""
    found = {
        "LOAD": lambda: clamp(a),
        "MOV": lambda: a,
        "ADD": lambda: clamp(a + b),
        "SUB": lambda: clamp(a - b),
        "MUL": lambda: clamp(a * b),
        "DIV": lambda: clamp(divide(a, b)),
        "NEG": lambda: clamp(-a),
        "EQ": lambda: (a == b).cast("int"),
        "LT": lambda: (a < b).cast("int"),
    }
    if op not in found:
        raise ValueError(f"{op} is no arithmetic operation; there are {', '.join(found)}")
    return found[op]()


def labels(program: Column) -> Column:
    """Map of label to index; a label that is defined twice raises."""
    marked = F.transform(program, lambda x, i: F.struct(x["label"].alias("key"), i.cast("int").alias("value")))
    return F.map_from_entries(F.filter(marked, lambda x: x["key"].isNotNull()))


def duplicate_labels(program: Column) -> Column:
    """Labels that are defined more than once, sorted."""
    named = F.filter(F.transform(program, lambda x: x["label"]), lambda x: x.isNotNull())
    twice = F.filter(named, lambda x: F.size(F.filter(named, lambda y: y == x)) > 1)
    return F.array_sort(F.array_distinct(twice))


def instruction(op, args: list | None = None, label=None, target=None) -> Column:
    """One instruction from plain values or Columns."""
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    held = F.array(*(wrap(a).cast("int") for a in args)) if args else F.array().cast("array<int>")
    return F.struct(wrap(op).cast("string").alias("op"), held.alias("args"), wrap(label).cast("string").alias("label"), wrap(target).cast("string").alias("target"))
