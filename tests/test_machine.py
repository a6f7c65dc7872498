"""Execution, validation, tokens and text on small programs."""

import pytest
from pyspark.sql import functions as F

from regloom.functions import isa, tokens
from regloom.operators import asm, check, expand, vm
from regloom.sources import programs

CASES = [
    # source, output, status, valid
    ("PRINT R3\nHALT", [0], "halted", False),
    ("LOAD R0 100\nMUL R1 R0 R0\nPRINT R1", [1023], "halted", True),
    ("LOAD R0 -100\nLOAD R1 100\nMUL R2 R0 R1\nNEG R3 R2\nPRINT R2\nPRINT R3", [-1024, 1023], "halted", True),
    ("LOAD R0 -7\nLOAD R1 2\nDIV R2 R0 R1\nPRINT R2", [-3], "halted", True),
    ("POP R0", [], "stack_underflow", False),
    ("LOAD R0 1\nPOP R0", [], "stack_underflow", False),
    ("LOAD R0 1\n" + "PUSH R0\n" * 17 + "HALT", [], "stack_overflow", False),
    ("L0: JMP L0", [], "step_cap", True),
    ("JMP L9", [], "bad_target", False),
    ("LOAD R0 1\nJZ R0 L0\nLOAD R1 2\nL0: PRINT R1\nHALT", [2], "halted", False),
    ("LOAD R0 0\nJZ R0 L0\nPUSH R0\nL0: NOP\nHALT", [], "halted", False),
    ("", [], "halted", True),
]


def test_runs_and_checks(spark):
    rows = [(i, c[0]) for i, c in enumerate(CASES)]
    parsed = asm.parse(spark.createDataFrame(rows, "id int, source string"))
    # an empty text still holds one blank line, so it is an empty program
    got = check.validate(vm.run(parsed)).orderBy("id").collect()
    for r, (source, output, status, valid) in zip(got, CASES):
        assert (list(r.trace.output), r.status, r.valid) == (output, status, valid), source
        assert r.trace.halted == (status == "halted")


def test_lessons(spark):
    for r in vm.run(programs.lessons(spark)).collect():
        assert list(r.trace.output) == list(r.expected), r.lesson


def test_userops_and_nulls(spark):
    df = spark.createDataFrame([(1, [("USEROP_0", [1, 0], "L4", None)]), (2, None), (3, [(None, None, None, None)])], f"id int, program {isa.PROGRAM}")
    got = {r.id: r for r in vm.run(df).collect()}
    assert got[1].status == "userop" and got[2].trace is None and got[2].status is None and got[3].status == "bad_op"
    made = df.where("id = 1").select(expand.expand(F.col("program"), {"DOUBLE": [("ADD", [0, 1, 1])]}).alias("p")).first().p
    assert [tuple(x) for x in made] == [("ADD", [1, 0, 0], "L4", None)]
    checked = {r.id: r.valid for r in check.validate(df.where("id = 1"), userops=True).collect()}
    assert checked == {1: True} and not check.validate(df.where("id = 1")).first().valid
    with pytest.raises(ValueError):
        expand.check_templates({"DOUBLE": [("JMP", [])]})
    with pytest.raises(Exception, match="no template"):
        df.where("id = 1").select(expand.expand(F.col("program"), {"MAX": [("ADD", [0, 1, 2])]})).collect()
    with pytest.raises(Exception, match="program failed"):
        vm.run(df.where("id = 1"), strict=True).collect()


def test_tokens_round_trip(spark):
    source = "L2:LOAD R0 -93\nL10:ADD R1 R0 R0\nJZ R1 L10\nPRINT R1\nHALT\n"
    p = asm.parse(spark.createDataFrame([(source,)], "source string"))
    ids = tokens.encode(F.col("program"))
    r = p.select("program", ids.alias("ids"), tokens.decode(ids).alias("back"), asm.render(F.col("program")).alias("again"), tokens.text(ids).alias("text")).first()
    assert r.back.program == r.program and r.back.error is None and r.again == source
    assert r.text == "L2:LOAD R0-93\nL10:ADD R1 R0 R0 \nJZ R1 L10\nPRINT R1 \nHALT \n"
    assert [isa.TOKENS[i] for i in r.ids[:8]] == ["L", "2", "COLON", "LOAD", "R0", "MINUS", "9", "3"]
    bad = spark.createDataFrame([([99],), ([isa.ID["PAD"], isa.ID["NEWLINE"]],), ([isa.ID["HALT"]],)], "ids array<int>")
    assert all(x.d.program is None and x.d.error for x in bad.select(tokens.decode(F.col("ids")).alias("d")).collect())


def test_scores_of_odd_streams(spark):
    i = isa.ID
    rows = [
        ([i["BOS"], i["5"], i["NEWLINE"], i["EOS"]], [i["5"], i["NEWLINE"]], 1.0),
        ([i["0"], i["5"], i["NEWLINE"]], [i["5"], i["NEWLINE"]], 1.0),
        ([i["MINUS"], i["5"], i["NEWLINE"]], [i["5"], i["NEWLINE"]], 0.0),
        ([i["HALT"], i["5"]], [i["5"]], 0.0),
        ([999], [i["5"]], 0.0),
        ([], [], 1.0),
    ]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(rows)], "k int, a array<int>, b array<int>")
    got = df.select("k", tokens.score(F.col("a"), F.col("b")).alias("s")).orderBy("k").collect()
    assert [r.s for r in got] == [x[2] for x in rows]


def test_parse_errors(spark):
    source = "FROB R1\nADD R0 R9 R1\n ; note\nL0: NOP\nL0:\nadd r0 r1 r2 ; x\nLOAD R0-93\nJZ R0"
    r = asm.parse(spark.createDataFrame([(source,), (None,)], "source string")).collect()
    assert [e.line for e in r[0].errors] == [1, 2, 5, 8] and r[0].program is None
    assert r[1].program is None and r[1].errors is None
