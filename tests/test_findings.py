"""What reviews found, each held by a small case that failed before."""

import time

import pytest
from pyspark.sql import functions as F

from regloom.functions import isa, tokens
from regloom.operators import check, exact, generate, vm
from regloom.plans import queries as core
from regloom.sources import datasets, scratch, specs


@pytest.mark.parametrize("tier", ["tier0", "tier1", "tier2"])
def test_every_order_gets_a_row(spark, tmp_path, tier):
    """More orders than a recipe has rows: none is left out."""
    spark.range(600_001).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    made = [n for _, _, n, _ in specs.files(core._recipe(spark, str(tmp_path), tier))]
    assert 600_001 <= sum(made) <= 600_001 + len(made)


def _seconds(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_programs_are_validated_and_run_together(spark):
    """4,000 programs of 256 lines; row by row in expressions this takes several times as long."""
    seeds = spark.range(4000).select("id", specs.row_seed(0, "train", None, F.col("id")).alias("seed")).repartition(4)
    path = scratch.fresh(spark, "long")
    exact.make(seeds, "tier2", "ood_len_256").write.parquet(path)
    made = spark.read.parquet(path).repartition(4).persist()
    assert made.count() == 4000
    told = vm.run(check.validate(made), steps=False, turns=F.col("l"))
    assert _seconds(told) < 15 and told.where("not valid or status <> 'halted'").count() == 0
    made.unpersist()


def test_programs_by_counter_are_made_in_batches(spark):
    shape = {"n": 128, "k": 6, "b": 3, "l": 8, "use_stack": True, "stack_frames": 2}
    seeds = spark.range(4000).select("id", specs.row_seed(0, "train", None, F.col("id")).alias("seed"), *(F.lit(v).alias(n) for n, v in shape.items())).repartition(4)
    assert _seconds(generate.make(seeds, "tier2")) < 8


def test_ids_are_read_back_once(spark):
    """Ids that are an expression themselves are computed once for each program, not at every mention."""
    calls = spark.range(20_000).repartition(4).select(F.expr("transform(sequence(1, 12), x -> named_struct('op', 'ADD', 'args', array(1, 2, x % 8), 'label', concat('L', x), 'target', cast(null AS string)))").cast(isa.PROGRAM).alias("program"))
    both = isa.once(calls, "d", tokens.decode(tokens.encode(F.col("program")))).where(~F.col("program").eqNullSafe(F.col("d.program")))
    assert _seconds(both) < 20 and both.count() == 0


def test_prompts_of_generated_programs_are_made_in_batches(spark):
    """What is rendered with the runs is what the expressions give (of those, 1,500 rows took 16.9 s on 8 cores)."""
    recipe = specs.RECIPES["tier2"].sized(600, 1)
    made = datasets.rows(spark, recipe, "train", per_part=150)
    some = made.where("idx < 40")
    differs = some.where(~F.col("renders").eqNullSafe(tokens.renders(F.col("program"), F.col("trace"), list(recipe.renders))))
    assert differs.count() == 0 and _seconds(made) < 10


def test_golden_programs_are_generated_once(spark):
    """What both sides of the comparison come from is read from a table: no program is generated or run by the comparison itself."""
    found = core.golden_differences(spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == found.where("problem in ('missing', 'new', 'output', 'length,output')").count() > 0


def test_bundles_are_judged_in_batches(spark):
    """Reruns of bundles and the runs that they are made of are steps of whole batches, none is a fold in its row."""
    plan = core.bundle_parity(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3 and "step_cap" not in plan
