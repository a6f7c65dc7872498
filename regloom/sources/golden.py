"""A regression harness as data: rows with stored expectations, and what has changed since, by key.

``sweep`` makes fifty programs of all generators; ``told`` is what is kept of programs and their runs; ``differences``
holds any two such tables against each other with one outer join on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asm, exact, vm

#: Generators, how many seeds from 0 each has, and the axes of a seed.
SWEEP = {
    "counter": ("tier0", 8, lambda s: {"n": 3 + s}),
    "register_trace": ("tier1", 12, lambda s: {"n": 8 + 2 * s, "k": 2 + s % 7}),
    "branched": ("tier2", 30, lambda s: {"n": 16 + s, "k": 4 + s % 5, "b": 1 + s % 4, "l": s % 9, "use_stack": s % 2 == 1, "stack_frames": 1 + s % 2}),
}
KEYS, PARTS = ["generator", "seed"], ["text", "length", "steps", "output", "status"]


def sweep(spark: SparkSession) -> DataFrame:
    """(generator, seed, program) of the fifty programs."""

    def one(name: str) -> DataFrame:
        tier, n, axes = SWEEP[name]
        drawn, built = exact.MAKERS[tier]
        seeds = spark.range(n).select(F.lit(name).alias("generator"), F.col("id").alias("seed"))
        made = exact._drawn(seeds, {"_drawn": exact.KINDS[tier]}, lambda s: {"_drawn": drawn(exact.Draws(s), **axes(s))})
        return made.select(*KEYS, built(F.col("_drawn")).alias("program"))

    return reduce(DataFrame.unionAll, (one(n) for n in SWEEP))


def told(programs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, text as a digest, length, steps, output, status) of programs and their runs."""
    ran = vm.run(programs, turns=64)
    text = F.sha2(asm.render(F.col("program")), 256).alias("text")
    return ran.select(*keys, text, F.size("program").alias("length"), F.size("trace.steps").alias("steps"), F.array_join(F.col("trace.output").cast("array<string>"), ",").alias("output"), "status")


def differences(stored: DataFrame, found: DataFrame, keys: list[str] = KEYS, parts: list[str] = PARTS) -> DataFrame:
    """(keys, problem): ``missing`` (stored, not found), ``new``, or the names of the parts that differ; no row: all is as stored.

    Keys name at most one row on each side; a null key is a key like any other, a null part equals a null part.
    """
    a = stored.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*parts).alias("_a"))
    b = found.select(*keys, F.struct(*parts).alias("_b"))
    both = a.join(b, reduce(lambda x, y: x & y, (F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys)), "full_outer")
    changed = F.concat_ws(",", *(F.when(~F.col(f"_a.{p}").eqNullSafe(F.col(f"_b.{p}")), p) for p in parts))
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(changed != "", changed)
    key = [F.when(F.col("_b").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*key, problem.alias("problem")).where("problem IS NOT NULL")
