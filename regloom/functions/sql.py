"""The register machine in SQL text: functions and table functions for ``spark.sql``.

All are SQL functions that the optimizer writes into the query, so that a call costs what the expression costs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import isa

_LINE = "pc INT, op STRING, args ARRAY<INT>, label STRING, target STRING"
_STEP = "t INT, pc INT, regs ARRAY<INT>, stack ARRAY<INT>, emitted INT"

#: Name and arguments, result, body.
FUNCTIONS = {
    "vm_clamp(x INT)": ("INT", f"CASE WHEN x IS NOT NULL THEN greatest({isa.LOW}, least({isa.HIGH}, x)) END"),
    "vm_div(a INT, b INT)": ("INT", "CASE WHEN b = 0 THEN 0 WHEN b IS NOT NULL THEN vm_clamp(CAST(a div nullif(b, 0) AS INT)) END"),
    "vm_alu(op STRING, a INT, b INT)": ("INT", "CASE op WHEN 'LOAD' THEN vm_clamp(a) WHEN 'MOV' THEN a WHEN 'ADD' THEN vm_clamp(a + b) WHEN 'SUB' THEN vm_clamp(a - b) WHEN 'MUL' THEN vm_clamp(a * b) WHEN 'DIV' THEN vm_div(a, b) WHEN 'NEG' THEN vm_clamp(-a) WHEN 'EQ' THEN CAST(a = b AS INT) WHEN 'LT' THEN CAST(a < b AS INT) END"),
    "vm_score(predicted ARRAY<INT>, truth ARRAY<INT>)": ("DOUBLE", "CASE WHEN predicted = truth THEN 1.0D ELSE 0.0D END"),
    "vm_op_count(program " + isa.PROGRAM + ")": ("INT", "size(array_distinct(transform(program, x -> x.op)))"),
}
TABLES = {
    "vm_lines(program " + isa.PROGRAM + ")": (_LINE, "SELECT pos, x.op, x.args, x.label, x.target FROM posexplode(program) AS p(pos, x)"),
    "vm_steps(trace " + isa.TRACE + ")": (_STEP, "SELECT pos, s.pc, s.regs, s.stack, s.emitted FROM posexplode(trace.steps) AS p(pos, s)"),
    "vm_pairs(truth ARRAY<INT>, model ARRAY<INT>)": ("idx INT, truth INT, model INT, diverges BOOLEAN", "SELECT i, get(truth, i), get(model, i), i >= size(truth) OR i >= size(model) OR NOT get(truth, i) <=> get(model, i) FROM explode(CASE WHEN greatest(size(truth), size(model)) > 0 THEN sequence(0, greatest(size(truth), size(model)) - 1) END) AS p(i)"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session; known ones are replaced."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, (columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({columns}) RETURN {body}")
