"""Queries over whole tables, by name. Each takes (spark, folder of Parquet tables) and returns a DataFrame.

Integers come out as BIGINT and arrays as text, so that other engines can be held against them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isa, sql, tokens
from ..operators import asm, check, compare, exact, expand, generate, search, stats, vm
from ..sources import bundles, datasets, digest, golden, programs, scan, scratch, specs

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, arrays of plain values as comma-joined text, decimals as text."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("bigint").alias(name)
        if kind in ("array<int>", "array<bigint>", "array<string>"):
            return F.array_join(c.cast("array<string>"), ",").alias(name)
        return c.cast("string").alias(name) if kind.startswith("decimal") else c

    return df.select(*(one(n, k) for n, k in df.dtypes))


# Arithmetic ----------------------------------------------------------------------------------------------------------


def operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two register values for each line: a from -1024 to 1023, b from -20 to 20 (zeros included)."""
    lines = table(spark, sf_dir, "lineitem")
    a = (F.pmod(F.col("l_partkey") * 37 + F.col("l_linenumber"), F.lit(2048)) - 1024).cast("int")
    b = (F.pmod(F.col("l_suppkey") * 7 + F.col("l_quantity").cast("bigint"), F.lit(41)) - 20).cast("int")
    return lines.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))


def _alu(op: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = F.col("a") * 3 if op == "LOAD" else F.col("a")
        return plain(operands(spark, sf_dir).select("l_orderkey", "l_linenumber", "a", "b", isa.alu(op, a, F.col("b")).alias("value")))

    run.__name__ = f"alu_{op.lower()}"
    return run


for _op in isa.FILL:
    query(_alu(_op))


@query
def digits_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(operands(spark, sf_dir).select("l_orderkey", "l_linenumber", "a", tokens.number(F.col("a")).alias("ids")))


# Seeds and generators ------------------------------------------------------------------------------------------------


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), specs.row_seed(0, "train", F.lower("o_orderpriority"), F.col("o_orderkey")).alias("seed"))


@query
def row_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_seeded(spark, sf_dir))


@query
def counter_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _seeded(spark, sf_dir)
    return plain(s.select("id", *(generate.draw(F.col("seed"), "t", i, m).alias(f"d{i}") for i, m in enumerate((9, 8, 255, 1000)))))


@query
def alloc_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_seeded(spark, sf_dir).select("id", generate.registers(F.col("seed"), (F.col("id") % 8 + 1).cast("int")).alias("registers")))


def _shape(spark: SparkSession, sf_dir: str, tier: str) -> DataFrame:
    n, k = (F.col("id") % 5 + 4).cast("int"), (F.col("id") % 7 + 2).cast("int")
    out = _seeded(spark, sf_dir).repartition(64, "id").withColumns({"n": n, "k": k})
    if tier == "tier2":
        out = out.withColumns({"b": (F.col("id") % 4).cast("int"), "l": (F.col("id") % 9).cast("int"), "use_stack": F.col("id") % 2 == 0, "stack_frames": F.lit(2), "k": (F.col("id") % 5 + 4).cast("int")})
    return generate.make(out, tier)


@query
def gen_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(spark, sf_dir, "tier0").select("id", asm.render(F.col("program")).alias("text"))


@query
def gen_register_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(spark, sf_dir, "tier1").select("id", asm.render(F.col("program")).alias("text"))


@query
def gen_branched_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branched programs of the counter mode with their validity and outcome."""
    made = check.validate(_shape(spark, sf_dir, "tier2"))
    return plain(vm.run(made, steps=False, turns=F.col("l")).select("id", asm.render(F.col("program")).alias("text"), "valid", "status", F.col("trace.output").alias("output")))


def _recipe(spark: SparkSession, sf_dir: str, tier: str) -> specs.Recipe:
    """The recipe with one row for each order, however many there are, dealt over training and buckets in its proportions."""
    whole = specs.RECIPES[tier]
    n, total = table(spark, sf_dir, "orders").count(), sum(rows for _, _, rows, _ in specs.files(whole))
    part = lambda rows: max(1, -(-rows * n // total))
    return replace(whole, train=part(whole.train), buckets=tuple((name, part(rows), axes) for name, rows, axes in whole.buckets))


def _emitted(tier: str) -> Query:
    """Rows of training and of every bucket."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        recipe = _recipe(spark, sf_dir, tier)
        files = [datasets.rows(spark, recipe, split, bucket, per_part=min(5000, max(1, n // 16))) for split, bucket, n, _ in specs.files(recipe)]
        return datasets.to_json(reduce(DataFrame.unionAll, files))

    run.__name__ = f"emit_{tier}"
    return run


for _tier in specs.RECIPES:
    query(_emitted(_tier))


# Execution -----------------------------------------------------------------------------------------------------------


def straight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.from_orders(table(spark, sf_dir, "lineitem"))


def jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.from_orders(table(spark, sf_dir, "lineitem"), jumps=True)


@query
def vm_straightline_regs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(vm.run(straight(spark, sf_dir), steps=False).select("id", "regs", "status"))


@query
def vm_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(vm.run(straight(spark, sf_dir), steps=False).select("id", F.get("trace.output", F.lit(0)).alias("value")))


@query
def vm_trace_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(vm.step_rows(vm.run(straight(spark, sf_dir)), ["id"]).select("id", "t", "pc", "regs", "emitted"))


@query
def vm_forward_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = vm.run(jumping(spark, sf_dir))
    return plain(ran.select("id", "status", "regs", "stack", F.col("trace.output").alias("output"), F.size("trace.steps").alias("steps"), F.col("trace.halted").alias("halted")))


@query
def vm_stack_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(vm.run(jumping(spark, sf_dir), steps=False).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("trace.output")).alias("printed")))


@query
def vm_step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(vm.run(straight(spark, sf_dir), steps=False, limit=4).groupBy("status").agg(F.count("*").alias("n")))


@query
def vm_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = vm.run(programs.lessons(spark))
    return plain(ran.select("lesson", F.col("trace.output").alias("output"), F.size("trace.steps").alias("steps"), (F.col("trace.output") == F.col("expected")).alias("ok")))


# Tokens --------------------------------------------------------------------------------------------------------------


@query
def encode_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(straight(spark, sf_dir).select("id", tokens.encode(F.col("program")).alias("ids")))


@query
def decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that do not come back from their ids; none is right."""
    p = jumping(spark, sf_dir).withColumn("back", tokens.decode(tokens.encode(F.col("program"))))
    return p.where(~F.col("program").eqNullSafe(F.col("back.program"))).select("id", F.col("back.error").alias("error"))


@query
def decode_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs read back from their ids as text; for some ids a newline is missing, a line is none, or an id is unknown."""
    ids, i = F.col("ids"), F.col("id")
    more = lambda *x: F.concat(ids, F.array(*(F.lit(v) for v in x)))
    cut = F.when(i % 5 == 0, F.slice(ids, F.lit(1), F.size(ids) - 1)).when(i % 7 == 1, more(isa.ID["PAD"], isa.ID["NEWLINE"])).when(i % 11 == 3, more(99)).when(i % 13 == 4, more(isa.ID["JZ"], isa.ID["R1"], isa.ID["NEWLINE"])).otherwise(ids)
    coded = isa.once(jumping(spark, sf_dir), "ids", tokens.encode(F.col("program"))).select("id", cut.alias("ids"))
    told = isa.once(coded, "d", tokens.decode(ids))
    return told.select("id", asm.render(F.col("d.program")).alias("text"), F.col("d.error").alias("error"))


@query
def encode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token text of programs in which every second label is a name; names are numbered by first definition."""
    named = lambda x: F.when(F.regexp_extract(x, "([0-9]+)$", 1).cast("int") % 2 == 0, F.concat(F.lit("at_"), F.substring(x, 2, 9))).otherwise(x)
    p = F.transform("program", lambda x: F.struct(x["op"].alias("op"), x["args"].alias("args"), named(x["label"]).alias("label"), named(x["target"]).alias("target")))
    return jumping(spark, sf_dir).withColumn("program", p).select("id", tokens.text(tokens.encode(F.col("program"))).alias("text"))


@query
def program_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order programs as dataset rows: one compact JSON line each."""
    meta = F.struct(F.lit("orders").alias("tier"), split().alias("split"), F.lit(None).cast("string").alias("bucket"), F.col("id").alias("seed"), F.struct(F.size("program").alias("n")).alias("axes"), F.array(F.lit("direct")).alias("renders"))
    ran = _rendered(spark, sf_dir)
    return datasets.to_json(ran.select(meta.alias("meta"), "program", "trace", tokens.renders(F.col("program"), F.col("trace"), ["direct"]).alias("renders")))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vm.run(straight(spark, sf_dir))


@query
def render_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("program"), F.col("trace")
    return plain(_rendered(spark, sf_dir).select("id", tokens.render_direct(*both).alias("p")).select("id", "p.input_ids", "p.target_ids"))


@query
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tokens.with_text(tokens.render_direct(F.col("program"), F.col("trace")))
    return _rendered(spark, sf_dir).select("id", p.alias("p")).select("id", "p.input_text", "p.target_text")


def _cot(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = tokens.render_cot(F.col("program"), F.col("trace"), mode)["target_ids"]
        return _rendered(spark, sf_dir).select("id", tokens.text(p).alias("text"))

    run.__name__ = f"render_cot_{mode}"
    return run


query(_cot("full"))
query(_cot("modified"))


@query
def render_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.col("id") % F.size("trace.steps")).cast("int")
    p = tokens.with_text(tokens.render_probe(F.col("program"), F.col("trace"), t))
    return _rendered(spark, sf_dir).select("id", p.alias("p")).select("id", "p.input_text", "p.target_text")


@query
def probe_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_rendered(spark, sf_dir).select("id", F.posexplode(tokens.probe_targets(F.col("trace"))).alias("t", "regs")))


@query
def decode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = vm.run(jumping(spark, sf_dir))
    ids = tokens.render_direct(F.col("program"), F.col("trace"))["target_ids"]
    return plain(ran.select("id", tokens.values(ids).cast("array<bigint>").alias("numbers")))


@query
def score_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's output against the same with every third one altered."""
    ran = vm.run(straight(spark, sf_dir), steps=True)
    truth = tokens.render_direct(F.col("program"), F.col("trace"))["target_ids"]
    wrong = F.when(F.col("id") % 3 == 0, F.concat(F.slice(F.col("truth"), 1, F.size("truth") - 2), F.array(F.lit(isa.ID["7"])), F.slice(F.col("truth"), F.size("truth") - 1, 2))).otherwise(F.col("truth"))
    held = ran.select("id", truth.alias("truth"))
    return held.select("id", tokens.score(wrong, F.col("truth")).alias("score"))


# Macro expansion -----------------------------------------------------------------------------------------------------

TEMPLATES = {"DOUBLE": [("ADD", [0, 1, 1])], "MAX": [("LT", [0, 1, 2]), ("MUL", [0, 0, 2])], "ABS": [("LOAD", [0, -1]), ("MUL", [0, 0, 1])]}


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order programs in which MOV, EQ and NEG are calls of DOUBLE, MAX and ABS."""
    slot = lambda op: F.when(op == "MOV", "USEROP_0").when(op == "EQ", "USEROP_1").when(op == "NEG", "USEROP_2").otherwise(op)
    p = F.transform("program", lambda x: F.struct(slot(x["op"]).alias("op"), x["args"].alias("args"), x["label"].alias("label"), x["target"].alias("target")))
    return straight(spark, sf_dir).withColumn("program", p)


@query
def macro_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _calls(spark, sf_dir).withColumn("program", expand.expand(F.col("program"), TEMPLATES))
    return made.select("id", asm.render(F.col("program")).alias("text"))


@query
def macro_expand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a join of instructions with template rows."""
    code = stats.instructions(_calls(spark, sf_dir), ["id"]).withColumn("symbol", F.try_element_at(isa.literal_map(isa.BINDINGS), F.col("op")))
    rows = [(s, k, op, args, isa.OPS[op].registers) for s, lines in TEMPLATES.items() for k, (op, args) in enumerate(lines)]
    dim = spark.createDataFrame(rows, "symbol string, k int, op string, args array<int>, registers int")
    return plain(expand.expand_rows(code, dim, ["id"]).select("id", "pc", "k", "op", "args"))


@query
def userop_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as tokens of their symbols."""
    return plain(_calls(spark, sf_dir).select("id", tokens.encode(F.col("program")).alias("ids")))


def _userop_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, demos, target) for each customer: programs with calls of its orders, the last one is to be solved."""
    calls = _calls(spark, sf_dir)
    ran = vm.run(calls.withColumns({"calls": F.col("program"), "program": expand.expand(F.col("program"), TEMPLATES)}), steps=False)
    case = F.struct("id", F.col("calls").alias("program"), F.col("trace.output").alias("output"))
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    held = ran.join(owner, "id").groupBy(F.col("customer").alias("id")).agg(F.array_sort(F.collect_list(case)).alias("_all"))
    return held.select("id", F.slice("_all", F.lit(1), F.size("_all") - 1).alias("demos"), F.element_at("_all", -1).alias("target"))


def _userops(name: str, templates: dict | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prompt = tokens.with_text(tokens.render_userops(F.col("demos"), F.col("target"), None if templates is None else tokens.templates_of(templates)))
        made = isa.once(_userop_cases(spark, sf_dir), "p", prompt)
        return plain(made.select("id", F.size("demos").alias("demos"), "p.input_ids", "p.target_ids", "p.input_text", "p.target_text"))

    run.__name__ = name
    return run


query(_userops("userop_prompts", None))
query(_userops("userop_prompts_decomposed", TEMPLATES))


# Statistics ----------------------------------------------------------------------------------------------------------


def split(id_: str = "id") -> Column:
    return F.concat(F.lit("part_"), (F.col(id_) % 3).cast("string"))


@query
def op_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stats.op_frequency(straight(spark, sf_dir)))


@query
def op_freq_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stats.op_frequency(straight(spark, sf_dir).withColumn("split", split()), ["split"], total=True))


@query
def op_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.transform("program", lambda x: isa.op_number(x["op"]))
    each = straight(spark, sf_dir).select(F.explode(code).alias("code"))
    return plain(stats.histogram(each, F.col("code")))


@query
def register_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stats.register_writes(straight(spark, sf_dir).withColumn("split", split()), ["split"]))


@query
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = _rendered(spark, sf_dir).withColumn("split", split()).withColumn("renders", tokens.renders(F.col("program"), F.col("trace"), ["direct"]))
    names = ["program_length", "trace_steps", "output_len", "input_id_len", "target_id_len", "input_text_chars", "target_text_chars"]
    return plain(stats.summary(stats.lengths(ran), names, ["split"]))


@query
def first_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 program lengths of each part (a raw sample for plots)."""
    sized = straight(spark, sf_dir).select("id", split().alias("split"), F.size("program").alias("length"))
    return plain(stats.first_rows(sized, ["id"], 100, ["split"]))


@query
def output_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stats.output_bins(vm.run(straight(spark, sf_dir), steps=False)))


@query
def distinct_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stats.distinct_outputs(vm.run(straight(spark, sf_dir), steps=False).withColumn("split", split()), ["split"]))


@query
def jz_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stats.before_jumps(jumping(spark, sf_dir)))


@query
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(stats.coverage(jumping(spark, sf_dir)))


@query
def rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flatter output histogram: the counts after at most 20 programs of a bin are kept."""
    ran = vm.run(straight(spark, sf_dir), steps=False)
    return plain(stats.output_bins(stats.rebalance(ran, 20)))


@query
def op_freq_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequency_document(straight(spark, sf_dir).withColumn("split", split()), ["split"])


@query
def sketched_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices in cents: totals merged from sketches of each priority, held against exact ranks and counts.

    ``ok``: the rank of each quantile lies within 1.5 % of the one asked for, and the distinct count within 4 %.
    """
    cents = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    told = stats.told(stats.merged(stats.sketches(cents, "cents", ["split"]))).first()  # one row
    ranks = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
    below = [F.sum((F.col("cents") <= told[q]).cast("bigint")).alias(q) for q in ranks]
    exact_ = cents.agg(F.count("cents").alias("n"), F.countDistinct("cents").alias("distinct"), *below)
    near = lambda q, r: (F.abs(F.col(q) / F.col("n") - r) <= 0.015) & (F.abs(F.lit(told.distinct) / F.col("distinct") - 1) <= 0.04)
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("measure"), near(q, r).alias("ok")) for q, r in ranks.items())))
    return plain(exact_.select("n", "distinct", each.alias("e")).select("e.measure", "n", "distinct", "e.ok"))


# Search --------------------------------------------------------------------------------------------------------------


@query
def best_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.best(_rendered(spark, sf_dir).withColumn("split", split()), "id", least_ops=4, by=["split"])
    return plain(found.select("split", "id", "signature.n_opcodes", "signature.clamping_seen", "signature.output_nonzero"))


@query
def first_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = _rendered(spark, sf_dir).withColumns({"split": split(), "output": F.col("trace.output")})
    return plain(search.first(ran, "id", search.clamps(F.col("program"), F.col("trace")), by=["split"], keep=["output"]))


@query
def pick_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of 997 groups the best program of 6 to 9 lines and 5 operations, or else the group's first program."""
    ran = _rendered(spark, sf_dir).withColumn("part", F.col("id") % 997)
    found = search.pick(ran, "id", F.size("program").between(6, 9), least_ops=5, by=["part"])
    return plain(found.select("part", "id", "signature.n_opcodes", "fallback"))


@query
def zero_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = _rendered(spark, sf_dir).withColumn("places", search.zero_divisions(F.col("program"), F.col("trace")))
    return plain(ran.where(F.size("places") > 0).select("id", "places"))


@query
def walk_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(search.walk(vm.run(jumping(spark, sf_dir)), ["id"]).select("id", "idx", "op", "regs_after", "emitted"))


# Validation ----------------------------------------------------------------------------------------------------------


@query
def validate_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks on programs with jumps: counts by first kind of error."""
    told = check.validate(jumping(spark, sf_dir))
    kind = F.regexp_replace(F.coalesce(F.get("errors", F.lit(0)), F.lit("none")), " at [0-9]+$", "")
    return plain(told.groupBy("valid", kind.alias("kind")).agg(F.count("*").alias("n")))


@query
def program_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each program with jumps is told: prints that some path leaves unwritten, else faults of the stack."""
    return check.validate(jumping(spark, sf_dir)).select("id", "valid", F.array_join("errors", ";").alias("errors"))


@query
def print_write_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = stats.instructions(straight(spark, sf_dir), ["id"]).withColumn("a", F.get("args", F.lit(0)))
    return plain(check.straight_prints(code, ["id"]))


@query
def stack_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(check.straight_stack(stats.instructions(jumping(spark, sf_dir), ["id"]), ["id"]))


@query
def label_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of programs whose even labels were taken away."""
    code = stats.instructions(jumping(spark, sf_dir), ["id"]).withColumn("label", F.when(F.col("pc") % 2 == 1, F.col("label")))
    return plain(check.straight_targets(code, ["id"]))


# Comparison ----------------------------------------------------------------------------------------------------------


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers at the end, and a prediction that is wrong in one place or too short for some."""
    ran = vm.run(straight(spark, sf_dir), steps=False).select("id", F.col("regs").alias("truth"))
    changed = F.transform("truth", lambda v, i: F.when(i == F.col("id") % 11, v + 1).otherwise(v))
    return ran.withColumn("model", F.when(F.col("id") % 5 == 0, F.slice(changed, 1, 6)).otherwise(changed))


@query
def divergence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(compare.pairs(_predicted(spark, sf_dir), ["id"], "truth", "model"))


@query
def divergence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a full outer join of long tables; what both sides come from is run once and kept as a table."""
    path = scratch.fresh(spark, "predicted")
    _predicted(spark, sf_dir).write.parquet(path)
    p = spark.read.parquet(path)
    long = lambda c: p.select("id", F.posexplode(c).alias("idx", "value"))
    return plain(compare.aligned(long("truth"), long("model"), ["id"]))


@query
def first_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _predicted(spark, sf_dir)
    return plain(p.select("id", compare.first_difference(F.col("truth"), F.col("model")).alias("place"), compare.exact(F.col("model"), F.col("truth")).alias("score")))


@query
def changed_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_rendered(spark, sf_dir).select("id", F.posexplode(compare.changed_register(F.col("trace"))).alias("t", "register")))


@query
def stack_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.posexplode(compare.stack_view(F.col("trace"))).alias("t", "v")
    return plain(vm.run(jumping(spark, sf_dir)).select("id", view).select("id", "t", "v.top_down", "v.depth", "v.fill"))


@query
def replay_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces that differ from those of the same programs read back from their text; none is right."""
    ran = vm.run(straight(spark, sf_dir)).select("id", asm.render(F.col("program")).alias("source"), F.col("trace").alias("stored"))
    again = vm.run(asm.parse(ran))
    return compare.mismatches(again, {"stored": "trace"}).select("id")


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, value) bundles of all orders, predictions wrong for every third; by id modulo 13 nine kinds of damage."""
    ran = _rendered(spark, sf_dir)
    wrong = (F.col("id") % 3 == 0).cast("int")
    ended = vm.run(straight(spark, sf_dir), steps=False)
    predictions = ended.select("id", F.posexplode("trace.output").alias("idx", "value")).select("id", "idx", (F.col("value") + wrong).alias("value"))
    kind = F.col("id") % 13
    output = F.transform("trace.output", lambda v: F.when(kind == 5, v + 1).otherwise(v))
    stored = ran.withColumn("trace", F.struct(F.col("trace.steps").alias("steps"), output.alias("output"), (F.col("trace.halted") & (kind != 6)).alias("halted")))
    made = bundles.assemble(stored, predictions, ["id"], F.struct(F.lit("orders").alias("generator"), F.col("id").alias("seed"), F.struct(F.size("program").alias("n")).alias("spec")))
    whole = bundles.text(F.col("bundle"))
    value = (
        F.when(kind == 0, F.substring(whole, F.lit(1), F.length(whole) - 3)).when(kind == 1, F.replace(whole, F.lit(bundles.TAG), F.lit("other/v0"))).when(kind == 2, F.replace(whole, F.lit('"halted" : true'), F.lit('"halted" : "true"')))
        .when(kind == 3, F.concat(F.lit("["), whole, F.lit("]"))).when(kind == 4, F.replace(whole, F.lit('"source" : "'), F.lit('"source" : "FROB R1\\n'))).when(kind == 7, F.replace(whole, F.lit('"prediction"'), F.lit('"predicted"')))
        .when(kind == 8, F.regexp_replace(whole, r'"source" : "[^"]*"', '"source" : 5')).when(kind == 9, F.regexp_replace(whole, r'"regs" : \[[^\]]*\]', '"regs" : ["x"]')).otherwise(whole)
    )
    return made.select("id", value.alias("value"))


@query
def bundle_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bundle's problem or, if it is sound, its parity with a rerun of its text and the first difference of its prediction."""
    told = bundles.judged(bundles.checked(damaged(spark, sf_dir)))
    return plain(told.select("id", "problem", "parity", "place", "score"))


@query
def bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = bundles.judged(bundles.checked(damaged(spark, sf_dir)))
    return plain(told.groupBy("problem", "parity").agg(F.count("*").alias("n"), F.sum(F.coalesce("score", F.lit(0.0))).alias("right")))


@query
def replay_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs whose stored trace is not what a run of their text gives: every ninth has a wrong output, every tenth lacks a step."""
    ran = vm.run(straight(spark, sf_dir)).select("id", asm.render(F.col("program")).alias("source"), "trace")
    steps = F.when(F.col("id") % 10 == 0, F.slice("trace.steps", F.lit(1), F.size("trace.steps") - 1)).otherwise(F.col("trace.steps"))
    output = F.when(F.col("id") % 9 == 0, F.transform("trace.output", lambda v: v + 1)).otherwise(F.col("trace.output"))
    stored = ran.select("id", "source", F.struct(steps.alias("steps"), output.alias("output"), F.col("trace.halted").alias("halted")).alias("stored"))
    found = compare.mismatches(vm.run(asm.parse(stored)), {"stored": "trace"})
    return found.select("id", (~F.col("stored.output").eqNullSafe(F.col("trace.output"))).alias("output_differs"), (F.size("trace.steps") - F.size("stored.steps")).cast("bigint").alias("steps_short"))


# Assembly ------------------------------------------------------------------------------------------------------------


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source texts with jumps in which every seventh order has a broken line."""
    text = asm.render(F.col("program"))
    broken = F.concat(F.lit("; order\nFROB R1\nADD R0 R9 R1\n"), text)
    return jumping(spark, sf_dir).select("id", F.when(F.col("id") % 7 == 0, broken).otherwise(text).alias("source"))


@query
def asm_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = asm.parse(sources(spark, sf_dir))
    return plain(parsed.select("id", F.explode("errors").alias("e")).select("id", "e.line", "e.message"))


@query
def asm_duplicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth source defines its first two labels again at its end: the lines that say so, and no program."""
    text = asm.render(F.col("program"))
    twice = jumping(spark, sf_dir).select("id", F.when(F.col("id") % 4 == 0, F.concat(text, F.lit("L0:\nL1: NOP ; again\n"))).otherwise(text).alias("source"))
    parsed = asm.parse(twice)
    return plain(parsed.select("id", F.size("program").alias("length"), F.explode_outer("errors").alias("e")).select("id", F.when(F.col("length") >= 0, F.col("length")).alias("length"), "e.line", "e.message"))


@query
def asm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source line of each executed step; a source with errors is no program and has none."""
    parsed = asm.parse(sources(spark, sf_dir)).where("program IS NOT NULL")
    steps = vm.step_rows(vm.run(parsed), ["id"])
    lines = parsed.select("id", F.posexplode("lines").alias("n", "idx")).select("id", (F.col("n") + 1).alias("line"), "idx")
    return plain(compare.active_lines(steps, lines, ["id"]))


@query
def asm_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(asm.classes(sources(spark, sf_dir), ["id"]).groupBy("class").agg(F.count("*").alias("n")))


# Files ---------------------------------------------------------------------------------------------------------------


@query
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256, bytes and rows of files: orders as text in order of their keys, a file for each priority and 10,000 keys."""
    orders, path = table(spark, sf_dir, "orders"), scratch.fresh(spark, "order-files")
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    keyed = orders.select(F.substring("o_orderpriority", 1, 1).alias("bucket"), F.expr("o_orderkey div 10000").alias("chunk"), "o_orderkey", line.alias("value"))
    ordered = keyed.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "o_orderkey").select("bucket", "chunk", "value")
    ordered.write.partitionBy("bucket", "chunk").text(path)
    place = lambda n: F.regexp_extract("path", f"/{n}=([^/]+)/", 1)
    return plain(digest.digests(spark, path, "*.txt").select(place("bucket").alias("bucket"), place("chunk").cast("bigint").alias("chunk"), "bytes", "sha256", "rows"))


@query
def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their number in the order of files and rows."""
    return plain(scan.numbered(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")))


@query
def first_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 rows over several files of JSON lines, in the order of their names."""
    path, schema = scratch.fresh(spark, "order-lines"), "o_orderkey bigint, o_custkey bigint"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.json(path)
    files = spark.read.schema(schema).json(path).inputFiles()
    return plain(scan.first_rows(lambda some: spark.read.schema(schema).json(some), files, 2000))


@query
def packed_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs written by split and bucket, and those of the buckets of building customers read again: a join that prunes."""
    path, code = scratch.fresh(spark, "packed"), jumping(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).cast("string").alias("bucket"))
    datasets.pack(code.join(orders, "id").withColumn("split", F.when(F.col("id") % 5 == 0, "eval").otherwise("train")), path)
    chosen = table(spark, sf_dir, "customer").where("c_custkey < 40 and c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 40).cast("string").alias("bucket"))
    found = datasets.packed(spark, path, "eval").withColumn("bucket", F.col("bucket").cast("string")).join(chosen, "bucket")
    return plain(found.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.size("program")).alias("lines")))


@query
def sql_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in SQL alone, over views and the registered functions: what each operation's lines would give on fixed operands."""
    sql.register(spark)
    straight(spark, sf_dir).createOrReplaceTempView("regloom_programs")
    return plain(spark.sql("""
        SELECT l.op, count(*) AS n, count(DISTINCT p.id) AS programs, sum(coalesce(vm_alu(l.op, get(l.args, 0) * 300 - 900, get(l.args, 1) - 3), 0)) AS total, max(vm_op_count(p.program)) AS most
        FROM regloom_programs p, LATERAL vm_lines(p.program) l GROUP BY l.op"""))


@query
def golden_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs generated for the seeds of all orders against a stored table of them in which some rows were changed, left out or added.

    What both sides come from is generated and run once and kept as a table.
    """
    path, i = scratch.fresh(spark, "golden"), F.col("id")
    golden.told(_shape(spark, sf_dir, "tier1").select("id", "program"), ["id"]).write.parquet(f"{path}/now")
    now = spark.read.parquet(f"{path}/now")
    stored = now.where(i % 50 != 1).withColumns({"length": F.when(i % 50 == 2, F.col("length") + 1).otherwise(F.col("length")), "output": F.when(i % 25 == 2, "x").otherwise(F.col("output"))})
    stored.unionAll(now.where(i % 50 == 3).withColumn("id", -i)).write.parquet(f"{path}/stored")
    return golden.differences(spark.read.parquet(f"{path}/stored"), now, ["id"])


@query
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that do not come back from their JSON; none is right."""
    recipe = _recipe(spark, sf_dir, "tier1")
    files = [datasets.rows(spark, recipe, split, bucket, mode="counter", per_part=min(5000, max(1, n // 16))) for split, bucket, n, _ in specs.files(recipe)]
    made = reduce(DataFrame.unionAll, files).drop("idx")
    lines = datasets.to_json(made)
    return datasets.to_json(datasets.from_json(lines, "tier1")).exceptAll(lines)


@query
def exact_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branched programs that follow Python's generator, with validity and output, for the seeds of all orders."""
    made = exact.make(_seeded(spark, sf_dir).repartition(64, "id"), "tier2", "medium")
    return plain(vm.run(check.validate(made), steps=False, turns=F.col("l")).select("id", F.size("program").alias("length"), "valid", "status", F.col("trace.output").alias("output")))
