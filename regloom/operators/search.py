"""Searches for telling examples: signatures, best rows, first matches, walkthroughs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import isa


def signature(program: Column, trace: Column) -> Column:
    """Struct: n_opcodes, output_nonzero, last_regs_nonzero, clamping_seen (a register stood at a bound), opcodes_used."""
    ops = F.array_distinct(F.transform(program, lambda x: x["op"]))
    last = F.try_element_at(trace["steps"], F.lit(-1))["regs"]
    none = F.array().cast("array<int>")
    return F.struct(
        F.size(ops).alias("n_opcodes"),
        F.exists(trace["output"], lambda v: v != 0).alias("output_nonzero"),
        F.exists(F.coalesce(last, none), lambda v: v != 0).alias("last_regs_nonzero"),
        F.exists(trace["steps"], lambda s: F.exists(s["regs"], lambda r: r.isin(isa.LOW, isa.HIGH))).alias("clamping_seen"),
        F.array_sort(ops).alias("opcodes_used"),
    )


def score(sig: Column) -> Column:
    """Struct that orders signatures: output, last registers, clamping, number of operations."""
    return F.struct(*(sig[n].cast("int").alias(n) for n in ("output_nonzero", "last_regs_nonzero", "clamping_seen", "n_opcodes")))


def _rank(sig: Column, idx: str) -> Column:
    return F.struct(score(sig).alias("score"), (-F.col(idx)).alias("earliest"))


def best(df: DataFrame, idx: str, least_ops: int = 5, scan: int | None = None, where: Column | None = None, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """(by, idx, signature, keep) of the row of highest score, the earliest of equals, in each group.

    One pass: an argmax with map-side combine over the few columns that come out, no sort and no second look at the rows.
    ``scan``: only rows with ``idx`` below it are looked at. No row qualifies: no row comes out.
    """
    held = df.where(F.col(idx) < scan) if scan is not None else df
    held = held.where(where) if where is not None else held
    held = isa.once(held, "signature", signature(F.col("program"), F.col("trace"))).where(F.col("signature.n_opcodes") >= least_ops)
    return _argmax(held, _rank(F.col("signature"), idx), [idx, "signature", *keep], by)


def _argmax(df: DataFrame, rank: Column, columns: list[str], by: list[str]) -> DataFrame:
    """``columns`` of the row of greatest rank in each group."""
    columns = list(dict.fromkeys(columns))
    top = df.select(*by, F.struct(*columns).alias("_row"), rank.alias("_rank")).groupBy(*by).agg(F.max_by("_row", "_rank").alias("_row"))
    return top.where("_row IS NOT NULL").select(*by, *(F.col(f"_row.{c}").alias(c) for c in columns if c not in by))


def pick(df: DataFrame, idx: str, where: Column, least_ops: int = 5, scan: int | None = None, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """(by, idx, signature, keep, fallback): of each group the best row that meets ``where`` and has ``least_ops``
    operations; if there is none, its first row, with ``fallback`` true. Both come from the same pass."""
    held = df.where(F.col(idx) < scan) if scan is not None else df
    held = isa.once(held, "signature", signature(F.col("program"), F.col("trace")))
    fits = F.coalesce(where, F.lit(False)) & (F.col("signature.n_opcodes") >= least_ops)
    held = held.withColumn("fallback", ~fits)
    rank = F.struct((~F.col("fallback")).alias("fits"), F.when(~F.col("fallback"), score(F.col("signature"))).alias("score"), (-F.col(idx)).alias("earliest"))
    return _argmax(held, rank, [idx, "signature", *keep, "fallback"], by)


def first(df: DataFrame, idx: str, match: Column, scan: int | None = None, by: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """(by, idx, keep) of the matching row of least ``idx`` in each group, in one pass."""
    held = df.where(F.col(idx) < scan) if scan is not None else df
    return _argmax(held.where(match), -F.col(idx), [idx, *keep], by)


def clamps(program: Column, trace: Column) -> Column:
    """Whether a register stood at a bound and some output is not zero."""
    sig = signature(program, trace)
    return sig["clamping_seen"] & sig["output_nonzero"]


def zero_divisions(program: Column, trace: Column) -> Column:
    """Indexes of DIV instructions whose divisor was 0 when they first ran (registers of the step before, zeros at the start)."""
    zeros = F.array_repeat(F.lit(0), isa.REGISTERS)
    place = F.transform(trace["steps"], lambda s: s["pc"])

    def seen(x: Column, i: Column) -> Column:
        t = F.array_position(place, i).cast("int") - 1
        regs = F.when(t == 0, zeros).when(t > 0, F.get(trace["steps"], t - 1)["regs"])
        return F.when((x["op"] == "DIV") & (F.get(regs, F.try_element_at(x["args"], F.lit(3))) == 0), i.cast("int"))

    return F.array_compact(F.transform(program, seen))


def walk(df: DataFrame, ids: list[str]) -> DataFrame:
    """Each instruction with the registers after its first step, nulls if it never ran: ids, idx, op, args, label, target, regs_after, emitted."""
    place = F.transform(F.col("trace.steps"), lambda s: s["pc"])

    def told(x: Column, i: Column) -> Column:
        t = F.array_position(place, i).cast("int")
        step = F.when(t > 0, F.get(F.col("trace.steps"), t - 1))
        return F.struct(i.cast("int").alias("idx"), x["op"].alias("op"), x["args"].alias("args"), x["label"].alias("label"), x["target"].alias("target"), step["regs"].alias("regs_after"), step["emitted"].alias("emitted"))

    return df.select(*ids, F.explode(F.transform(F.col("program"), told)).alias("w")).select(*ids, "w.*")
