"""Generators that must match to the byte, datasets on disk, and queries against DuckDB."""

import glob
import os
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from regloom.functions import tokens
from regloom.operators import asm, check, exact, vm
from regloom.sources import datasets, specs

SF = "/root/testdata/sf0.001"


def test_row_seed(spark):
    r = specs.rows(spark, specs.RECIPES["tier1"], "eval", "len_8").where("idx = 0").first()
    assert int(r.seed) == 7502970485723022491


def test_exact_programs(spark):
    """Two documented rows: seed and axes give a program of a known length and output."""
    rows = [(1, "3896364871974659895", 14, 2, 16, [1]), (2, "16891817541285102663", 8, 4, 10, [94])]
    for _, seed, n, k, length, output in rows:
        drawn = exact.register_trace(exact.Draws(int(seed)), n, k)
        df = spark.createDataFrame([(drawn,)], f"d {exact.KINDS['tier1']}").select(exact.built_trace(F.col("d")).alias("program"))
        r = check.validate(vm.run(df)).first()
        assert len(r.program) == length and list(r.trace.output) == output and r.valid


@pytest.mark.parametrize("tier", ["tier0", "tier1", "tier2"])
@pytest.mark.parametrize("mode", ["exact", "counter"])
def test_generated_programs_are_valid(spark, tier, mode):
    recipe = specs.RECIPES[tier].sized(24, 4)
    made = check.validate(datasets.rows(spark, recipe, "train", mode=mode, per_part=12))
    assert made.where("not valid or size(range_errors) > 0 or not trace.halted").count() == 0 and made.count() == 24


def test_emit_verify_load(spark):
    out = "file://" + tempfile.mkdtemp(prefix="spark-")
    recipe = specs.RECIPES["tier0"].sized(30, 10)
    datasets.emit(spark, recipe, out, per_part=8)
    assert datasets.verify(spark, out + "/tier0").count() == 0
    told = datasets.load_manifest(spark, out + "/tier0")
    assert sum(f["rows"] for f in told["files"].values()) == 40 and len(told["commit"]) in (7, 40) and told["commit"] == datasets.revision()
    assert datasets.load(spark, out + "/tier0", "train", tier="tier0").count() == 30
    assert datasets.load_prompts(spark, out + "/tier0/train.jsonl").where("size(input_ids) > 0").count() == 30
    with pytest.raises(Exception, match="no render"):
        datasets.load_prompts(spark, out + "/tier0/train.jsonl", "cot").collect()
    part = sorted(glob.glob(out[7:] + "/tier0/train.jsonl/part-*"))[0]
    os.remove(f"{os.path.dirname(part)}/.{os.path.basename(part)}.crc")  # else the local file system stops the read itself
    with open(part, "a") as f:
        f.write("x\n")
    assert [r.problem for r in datasets.verify(spark, out + "/tier0").collect()] == ["digest differs"]
    with pytest.raises(FileNotFoundError):
        datasets.load_manifest(spark, out)
    with pytest.raises(ValueError):
        datasets.load(spark, out + "/tier0", "eval", tier="tier0")


def test_single_file_is_the_same_bytes(spark):
    out = "file://" + tempfile.mkdtemp(prefix="spark-")
    recipe = specs.RECIPES["tier1"].sized(20, 2)
    datasets.emit(spark, recipe, out + "/a", single=True, per_part=7)
    datasets.emit(spark, recipe, out + "/b", per_part=3)
    parts = b"".join(open(p, "rb").read() for p in sorted(glob.glob(out[7:] + "/b/tier1/train.jsonl/part-*")))
    assert open(out[7:] + "/a/tier1/train.jsonl", "rb").read() == parts


def test_userop_programs(spark):
    df = spark.createDataFrame([("7",)], "seed string")
    r = exact.userops(df, demos=2, n=10, use_stack=True).first()
    assert len(r.programs) == 3 and all(any(x.op == "USEROP_0" for x in p) for p in r.programs)


def test_structures_of_drawn_programs(spark):
    """Lines and labels of each kind of branch, loop and frame, from given draws."""
    one = [{"op": "ADD", "args": [4, 4, 4]}]
    d = {"one": 1, "shown": 4, "value": -7, "limit": 5, "diff": 6, "start": one}
    d["branches"] = [{"test": "LT", "c": 2, "x": 3, "y": 4, "then": one, "other": None, "at": 0}, {"test": "MOV", "c": 2, "x": 3, "y": 4, "then": one, "other": one, "at": 1}]
    d["loops"] = [{"kind": k, "c": 7, "turns": 2, "body": one, "at": 3 + 2 * i} for i, k in enumerate(("after", "before", "up"))]
    d["frames"] = [{"save": 2, "back": 3, "body": one}]
    text = spark.createDataFrame([(d,)], f"d {exact.BRANCHED}").select(asm.render(exact.built_branched(F.col("d")))).first()[0]
    assert text.splitlines() == [
        "LOAD R1 1", "LOAD R4 -7", "ADD R4 R4 R4",
        "LT R2 R3 R4", "JZ R2 L0", "ADD R4 R4 R4", "L0:NOP",
        "MOV R2 R4", "JZ R2 L1", "ADD R4 R4 R4", "JMP L2", "L1:ADD R4 R4 R4", "L2:NOP",
        "LOAD R7 2", "L3:ADD R4 R4 R4", "SUB R7 R7 R1", "JZ R7 L4", "JMP L3", "L4:NOP",
        "LOAD R7 2", "L5:JZ R7 L6", "ADD R4 R4 R4", "SUB R7 R7 R1", "JMP L5", "L6:NOP",
        "LOAD R7 0", "LOAD R5 2", "L7:ADD R4 R4 R4", "ADD R7 R7 R1", "SUB R6 R5 R7", "JZ R6 L8", "JMP L7", "L8:NOP",
        "PUSH R2", "ADD R4 R4 R4", "POP R3", "PRINT R4", "HALT",
    ]


def test_userop_prompts(spark):
    case = "STRUCT<program:%s,output:ARRAY<INT>>" % tokens.isa.PROGRAM
    call = [("LOAD", [0, -3], None, None), ("USEROP_0", [1, 0], "L2", None), ("USEROP_3", [1, 0, 2], None, None)]
    rows = [(1, [(call, [5, -6])], (call, [7])), (2, [], (call[:1], []))]
    df = spark.createDataFrame(rows, f"id int, demos ARRAY<{case}>, target {case}")
    templates = {"DOUBLE": [("ADD", [0, 1, 1])], "MOD": [("LOAD", [0, -1]), ("MUL", [0, 0, 2])]}
    lines = "LOAD R0-3\nL2:DOUBLE R1 R0 \nMOD R1 R0 R2 \n"
    shown = "LOAD R0-3\nL2:DOUBLE R1 R0 \nDECOMP ADD R1 R0 R0 \nMOD R1 R0 R2 \nDECOMP LOAD R1-1\nMUL R1 R1 R2 \n"
    for given, demo in ((None, lines), (templates, shown)):
        p = tokens.with_text(tokens.render_userops(F.col("demos"), F.col("target"), None if given is None else tokens.templates_of(given)))
        got = {r.id: r.p for r in df.select("id", p.alias("p")).collect()}
        assert (got[1].input_text, got[1].target_text) == (demo + "5\n-6\n" + lines, "7\n") and (got[2].input_text, got[2].target_text) == ("LOAD R0-3\n", "")
    bound = {**tokens.isa.BINDINGS, "USEROP_0": "SIGN"}
    p = tokens.with_text(tokens.render_userops(F.col("demos"), F.col("target"), tokens.templates_of({"SIGN": templates["DOUBLE"], "MOD": templates["MOD"]}), bound))
    assert df.where("id = 1").select(p["input_text"]).first()[0] == shown.replace("DOUBLE", "SIGN") + "5\n-6\n" + lines.replace("DOUBLE", "SIGN")
    with pytest.raises(Exception, match="no template"):
        df.select(tokens.render_userops(F.col("demos"), F.col("target"), tokens.templates_of({"DOUBLE": templates["DOUBLE"]}))).collect()


NAMES = ["alu_div", "vm_forward_jumps", "render_cot_modified", "length_summary", "gen_register_trace", "best_example", "walk_program", "divergence_join", "stack_balance", "asm_parse_errors"]


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    told = con.execute(entry.oracle_sql()[name])
    place = [[d[0] for d in told.description].index(c) for c in columns]
    flat = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    want = sorted((flat([r[i] for i in place]) for r in told.fetchall()), key=repr)
    assert sorted((flat(r) for r in df.select(*columns).collect()), key=repr) == want


def test_round_trips_are_empty(spark):
    q = entry.queries()
    for name in ("decode_roundtrip", "replay_mismatches", "json_roundtrip"):
        assert q[name](spark, SF).count() == 0, name


def test_emit_queries_cover_every_file(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    for tier in ("tier0", "tier1"):
        meta = F.from_json("value", "meta STRUCT<split:STRING,bucket:STRING>")["meta"]
        got = {(r.split, r.bucket): r["count"] for r in entry.queries()[f"emit_{tier}"](spark, SF).select(meta.alias("m")).groupBy("m.split", "m.bucket").count().collect()}
        files = specs.files(specs.RECIPES[tier])
        total = sum(n for _, _, n, _ in files)
        assert got == {(s, b): -(-n * orders // total) for s, b, n, _ in files}
