"""Programs derived from tables, and small literal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isa
from ..operators import asm

#: Order of the lines of an order; l_linenumber alone has ties.
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]

#: Own short programs with the output that each must give: one for each kind of step.
LESSONS = [
    ("double by adding", "LOAD R4 21\nADD R4 R4 R4\nPRINT R4\nHALT", [42]),
    ("square plus one", "LOAD R1 6\nLOAD R6 1\nMUL R2 R1 R1\nADD R2 R2 R6\nPRINT R2\nHALT", [37]),
    ("smaller of two", "LOAD R0 12\nLOAD R1 8\nMOV R5 R1\nLT R2 R1 R0\nNEG R2 R2\nLOAD R3 1\nADD R2 R2 R3\nJZ R2 L4\nMOV R5 R0\nL4: PRINT R5\nHALT", [8]),
    ("powers of two", "LOAD R0 1\nLOAD R1 4\nLOAD R2 1\nL7: PRINT R0\nADD R0 R0 R0\nSUB R1 R1 R2\nJZ R1 L8\nJMP L7\nL8: HALT", [1, 2, 4, 8]),
    ("exchange by the stack", "LOAD R2 -15\nLOAD R5 60\nPUSH R2\nPUSH R5\nPOP R2\nPOP R5\nPRINT R2\nPRINT R5\nHALT", [60, -15]),
    ("quotients", "LOAD R0 -7\nLOAD R1 2\nLOAD R2 0\nDIV R3 R0 R1\nDIV R4 R1 R2\nPRINT R3\nPRINT R4\nHALT", [-3, 0]),
]


def _number(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("bigint")


def _fields(x: Column) -> dict[str, Column]:
    return {
        "a": F.pmod(_number(x["l_suppkey"]), F.lit(8)).cast("int"),
        "b": F.pmod(_number(x["l_linenumber"]), F.lit(8)).cast("int"),
        "c": F.pmod(_number(x["l_quantity"]), F.lit(8)).cast("int"),
        "lit": (F.pmod(_number(x["l_partkey"]), F.lit(255)) - 127).cast("int"),
    }


def _args(op: Column, f: dict[str, Column]) -> Column:
    one = [n for n in isa.BASE if isa.OPS[n].registers == 1 and not isa.OPS[n].literals]
    three = [n for n in isa.BASE if isa.OPS[n].registers == 3]
    none = F.array().cast("array<int>")
    return (
        F.when(op == "LOAD", F.array(f["a"], f["lit"]))
        .when(op.isin(three), F.array(f["a"], f["b"], f["c"]))
        .when(op.isin("MOV", "NEG"), F.array(f["a"], f["b"]))
        .when(op.isin(one), F.array(f["a"]))
        .otherwise(none)
    )


def from_orders(lineitem: DataFrame, jumps: bool = False) -> DataFrame:
    """(id, program): the lines of an order are the instructions of a program, in the order of ``ORDER``.

    Straight: l_partkey chooses one of the nine fill operations, and PRINT of the last destination and HALT follow.
    ``jumps``: one of all sixteen operations; jumps only go forward, so that every program ends; HALT follows.
    One shuffle by order; a program is one row.
    """
    lines = F.array_sort(F.collect_list(F.struct(*ORDER))).alias("_lines")
    orders = lineitem.select("l_orderkey", *ORDER).groupBy(F.col("l_orderkey").alias("id")).agg(lines)
    ops = F.array(*(F.lit(n) for n in (isa.BASE if jumps else isa.FILL)))
    n = F.size("_lines")

    def made(x: Column, i: Column) -> Column:
        op = F.get(ops, F.pmod(_number(x["l_partkey"]), F.lit(16 if jumps else 9)).cast("int"))
        label = F.concat(F.lit("L"), i.cast("string")) if jumps else F.lit(None).cast("string")
        to = F.concat(F.lit("L"), F.least(i + 1 + F.pmod(_number(x["l_suppkey"]), F.lit(3)), n).cast("string"))
        target = F.when(op.isin("JZ", "JMP"), to) if jumps else F.lit(None).cast("string")
        return F.struct(op.alias("op"), _args(op, _fields(x)).alias("args"), label.alias("label"), target.alias("target"))

    body = F.transform("_lines", made)
    if jumps:
        tail = F.array(isa.instruction("HALT", label=F.concat(F.lit("L"), n.cast("string"))))
    else:
        last = _fields(F.element_at("_lines", -1))["a"]
        tail = F.array(isa.instruction("PRINT", [last]), isa.instruction("HALT"))
    return orders.select("id", F.concat(body.cast(isa.PROGRAM), tail.cast(isa.PROGRAM)).alias("program"))


def lessons(spark: SparkSession) -> DataFrame:
    """(lesson, source, expected, program)."""
    table = spark.createDataFrame([(n, s, o) for n, s, o in LESSONS], "lesson string, source string, expected array<int>")
    return asm.parse(table).drop("errors", "lines")
