"""Distribution statistics over programs and traces.

Counts go through partial aggregation on the map side before any shuffle. Quantiles by index use value counts: each
distinct value travels once with its count, so that no list of all values is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import isa

#: name: place in the sorted values, of n values (n // 4, n // 2, 3 n // 4, int(0.95 n), int(0.99 n)).
QUANTILES = {"p25": "n div 4", "p50": "n div 2", "p75": "(3 * n) div 4", "p95": "least(n - 1, cast(floor(0.95D * n) AS bigint))", "p99": "least(n - 1, cast(floor(0.99D * n) AS bigint))"}


def instructions(df: DataFrame, ids: list[str], program: str = "program") -> DataFrame:
    """One row for each instruction: ids, pc, op, args, label, target."""
    return df.select(*ids, F.posexplode(program).alias("pc", "x")).select(*ids, "pc", "x.op", "x.args", "x.label", "x.target")


def op_frequency(df: DataFrame, by: list[str] = (), program: str = "program", total: bool = False) -> DataFrame:
    """Count of each operation in each group; ``total`` adds the counts over all groups, with null group columns."""
    each = df.select(*by, F.explode(F.transform(F.col(program), lambda x: x["op"])).alias("op"))
    counts = each.groupBy(*by, "op").agg(F.count("*").alias("n"))
    if not (total and by):
        return counts
    whole = counts.groupBy("op").agg(F.sum("n").alias("n"))
    return counts.withColumn("is_total", F.lit(0)).unionByName(whole.withColumn("is_total", F.lit(1)), allowMissingColumns=True)


def register_writes(df: DataFrame, by: list[str] = (), program: str = "program") -> DataFrame:
    """How often each register is written, with its share of all writes of the group."""
    wrote = F.filter(F.col(program), lambda x: x["op"].isin(isa.WRITING) & (F.size(x["args"]) > 0))
    counts = df.select(*by, F.explode(F.transform(wrote, lambda x: F.get(x["args"], F.lit(0)))).alias("register")).groupBy(*by, "register").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0))))


def lengths(df: DataFrame) -> DataFrame:
    """Sizes of what a row holds: needs program, trace and a direct prompt with texts."""
    d = F.col("renders.direct")
    sizes = {
        "program_length": F.size("program"),
        "trace_steps": F.size("trace.steps"),
        "output_len": F.size("trace.output"),
        "input_id_len": F.size(d["input_ids"]),
        "target_id_len": F.size(d["target_ids"]),
        "input_text_chars": F.length(d["input_text"]),
        "target_text_chars": F.length(d["target_text"]),
    }
    return df.withColumns(sizes)


def summary(df: DataFrame, measures: list[str], by: list[str] = ()) -> DataFrame:
    """For each group and measure: n, min, p25, p50, p75, p95, p99, max, mean. Nulls are left out.

    A quantile is the value at an index of the sorted values. It is found from the counts of distinct values: the first
    value whose running count exceeds the index. A group without values has no row.
    """
    long = df.select(*by, F.expr(f"stack({len(measures)}, {', '.join(f"'{m}', cast({m} AS bigint)" for m in measures)}) AS (measure, value)")).where("value IS NOT NULL")
    counts = long.groupBy(*by, "measure", "value").agg(F.count("*").alias("c"))
    keys = [*by, "measure"]
    running = counts.withColumns({
        "upto": F.sum("c").over(W.partitionBy(*keys).orderBy("value").rowsBetween(W.unboundedPreceding, 0)),
        "n": F.sum("c").over(W.partitionBy(*keys)),
    })
    found = [F.min(F.when(F.col("upto") > F.expr(place), F.col("value"))).alias(q) for q, place in QUANTILES.items()]
    out = running.groupBy(*keys).agg(F.first("n").alias("n"), F.min("value").alias("min"), *found, F.max("value").alias("max"), (F.sum(F.col("c") * F.col("value")) / F.first("n")).alias("mean"))
    return out.select(*keys, "n", "min", *QUANTILES, "max", "mean")


def histogram(df: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """Count of each whole value, with its share of the group in per cent."""
    counts = df.select(*by, value.alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0))))


def output_bins(df: DataFrame, trace: str = "trace", width: int = 100) -> DataFrame:
    """Histogram of the first output value in bins of ``width``, rounded down."""
    first = F.get(F.col(f"{trace}.output"), F.lit(0))
    return histogram(df, F.floor(first / width).cast("bigint"))


def distinct_outputs(df: DataFrame, by: list[str] = (), trace: str = "trace") -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(F.col(f"{trace}.output")).alias("outputs"), F.count("*").alias("programs"))


def first_rows(df: DataFrame, order: list[str], n: int, by: list[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group in the given order, with their ``place`` from 0. ``n`` is the feature, not a cap."""
    place = F.row_number().over((W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n).withColumn("place", F.col("place") - 1)


def before_jumps(df: DataFrame, by: list[str] = (), program: str = "program") -> DataFrame:
    """Which operation stands right before each JZ: counts and share. A JZ at the start has none and is left out."""
    pairs = F.transform(F.col(program), lambda x, i: F.when((x["op"] == "JZ") & (i > 0), F.get(F.col(program), i - 1)["op"]))
    counts = df.select(*by, F.explode(pairs).alias("op")).where("op IS NOT NULL").groupBy(*by, "op").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by) if by else W.partitionBy(F.lit(0))))


def coverage(df: DataFrame, program: str = "program") -> DataFrame:
    """How many programs hold a stack use and a branch, a stack use and a loop, a branch and a loop, and all three.

    A loop is a jump to the same place or back; a branch is a JZ that goes forward.
    """
    p = F.col(program)
    names = F.transform(p, lambda x: x["label"])
    way = F.transform(p, lambda x, i: F.struct(x["op"].alias("op"), (F.array_position(names, x["target"]) - 1 - i).alias("by"), x["target"].alias("target")))
    stack, branch, loop = F.exists(p, lambda x: x["op"] == "PUSH"), F.exists(way, lambda x: x["target"].isNotNull() & (x["op"] == "JZ") & (x["by"] > 0)), F.exists(way, lambda x: x["target"].isNotNull() & (x["by"] <= 0))
    held = df.select(stack.alias("s"), branch.alias("b"), loop.alias("l"))
    return held.agg(*(F.count_if(F.expr(c)).alias(n) for n, c in {"stack_branch": "s AND b", "stack_loop": "s AND l", "branch_loop": "b AND l", "all_three": "s AND b AND l"}.items()))


def rebalance(df: DataFrame, most: int, trace: str = "trace", width: int = 100, order: list[str] = ("id",)) -> DataFrame:
    """A flatter histogram of outputs: of each bin the first ``most`` rows by a hash of ``order``. Sampling is the feature."""
    bin_ = F.floor(F.get(F.col(f"{trace}.output"), F.lit(0)) / width)
    rank = F.row_number().over(W.partitionBy("_bin").orderBy(F.xxhash64(*order), *order))
    return df.withColumn("_bin", bin_).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_bin", "_rank")


def sketches(df: DataFrame, value: str, by: list[str], k: int = 400, lg: int = 14) -> DataFrame:
    """(by, n, quantiles, distinct): mergeable sketches of a whole-number column for each group, nulls left out.

    ``quantiles``: a KLL sketch, of rank error about 1.33 / k ** 0.9 either way; ``distinct``: a HyperLogLog sketch of
    relative error about 1.04 / 2 ** (lg / 2). Their size does not grow with the rows.
    """
    held = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("bigint"))
    return held.groupBy(*by).agg(F.count("*").alias("n"), F.expr(f"kll_sketch_agg_bigint(_v, {k})").alias("quantiles"), F.hll_sketch_agg("_v", lg).alias("distinct"))


def merged(kept: DataFrame, by: list[str] = (), k: int = 400) -> DataFrame:
    """Sketches of several groups put together, without another look at the values."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.expr(f"kll_merge_agg_bigint(quantiles, {k})").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def told(kept: DataFrame, by: list[str] = (), ranks: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """(by, n, distinct, and a column for each rank: p25 and so on) that the sketches stand for."""
    found = [F.expr(f"kll_sketch_get_quantile_bigint(quantiles, {r}D)").alias(f"p{round(100 * r)}") for r in ranks]
    return kept.select(*by, "n", F.hll_sketch_estimate("distinct").alias("distinct"), *found)


def frequency_document(df: DataFrame, by: list[str], program: str = "program") -> DataFrame:
    """(by, op_freq): counts of operations as one JSON object for each group, the commonest first, equals by name."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "op")))
    counts = op_frequency(df, by, program).groupBy(*by).agg(ranked.alias("_r"))
    return counts.select(*by, F.to_json(F.map_from_entries(F.transform("_r", lambda x: F.struct(x["op"].alias("key"), (-x["less"]).alias("value"))))).alias("op_freq"))
