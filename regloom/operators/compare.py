"""Predicted against true outputs, stored against recomputed ones, and views of single steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isa


def exact(predicted: Column, truth: Column) -> Column:
    """1.0 if both arrays hold the same values in order, else 0.0 (also for a null)."""
    return F.when(predicted == truth, 1.0).otherwise(0.0)


def pairs(df: DataFrame, ids: list[str], truth: str, model: str) -> DataFrame:
    """Both outputs side by side: ids, idx, truth, model, diverges. A side that has ended counts as different; null arrays are empty."""
    none = F.array().cast("array<int>")
    a, b = F.coalesce(F.col(truth), none), F.coalesce(F.col(model), none)
    n = F.greatest(F.size(a), F.size(b))
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.cast("int").alias("idx"), F.get(a, i).alias("truth"), F.get(b, i).alias("model"), ((i >= F.size(a)) | (i >= F.size(b)) | ~F.get(a, i).eqNullSafe(F.get(b, i))).alias("diverges")))
    return df.where(n > 0).select(*ids, F.explode(rows).alias("p")).select(*ids, "p.*")


def first_difference(truth: Column, model: Column) -> Column:
    """Index of the first place where the arrays differ (or one has ended), -1 if there is none."""
    n = F.greatest(F.size(truth), F.size(model))
    at = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & ((i >= F.size(truth)) | (i >= F.size(model)) | ~F.get(truth, i).eqNullSafe(F.get(model, i))))
    return F.coalesce(F.get(at, F.lit(0)).cast("int"), F.lit(-1))


def aligned(left: DataFrame, right: DataFrame, ids: list[str]) -> DataFrame:
    """The same pairing for long tables (ids, idx, value): a full outer join on position."""
    keys = [*ids, "idx"]
    both = left.select(*keys, F.col("value").alias("truth"), F.lit(True).alias("_l")).join(right.select(*keys, F.col("value").alias("model"), F.lit(True).alias("_r")), keys, "full_outer")
    return both.select(*keys, "truth", "model", (F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("truth").eqNullSafe(F.col("model"))).alias("diverges"))


def changed_register(trace: Column) -> Column:
    """For each step the first register that differs from the step before (zeros at the start); null if none does."""
    zeros = F.array_repeat(F.lit(0), isa.REGISTERS)
    past = F.transform(trace["steps"], lambda s: s["regs"])

    def found(s: Column, t: Column) -> Column:
        before = F.coalesce(F.get(past, t - 1), zeros)
        return F.get(F.filter(F.sequence(F.lit(0), F.lit(isa.REGISTERS - 1)), lambda r: F.get(s["regs"], r) != F.get(before, r)), F.lit(0)).cast("int")

    return F.transform(trace["steps"], found)


def stack_view(trace: Column) -> Column:
    """For each step: the stack from its top, and its depth as a share of the most."""
    return F.transform(trace["steps"], lambda s: F.struct(F.reverse(s["stack"]).alias("top_down"), F.size(s["stack"]).alias("depth"), (F.size(s["stack"]) / isa.DEPTH).alias("fill")))


def active_lines(steps: DataFrame, lines: DataFrame, ids: list[str]) -> DataFrame:
    """Source line of each step: ``steps`` (ids, t, pc) with ``lines`` (ids, line, idx) on the instruction index."""
    return steps.join(lines.where("idx IS NOT NULL").select(*ids, "line", F.col("idx").alias("pc")), [*ids, "pc"], "left").select(*ids, "t", "pc", "line")


def parity(df: DataFrame, stored: str, halted: str, status: str = "status", trace: str = "trace") -> DataFrame:
    """``df`` with ``parity``: skipped (a stored fault), match, mismatch, or the status of a rerun that failed."""
    told = F.when(~F.col(halted), "skipped").when(F.col(status) != "halted", F.col(status)).when(F.col(f"{trace}.output") == F.col(stored), "match").otherwise("mismatch")
    return df.withColumn("parity", told)


def mismatches(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows where a stored column differs from its recomputed one, nulls equal; an empty result is a pass."""
    differs = None
    for stored, again in pairs.items():
        one = ~F.col(stored).eqNullSafe(F.col(again))
        differs = one if differs is None else differs | one
    return df.where(differs)
