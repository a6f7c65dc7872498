"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Levels (say domain, language, source) form a tree. A token budget goes down it level by level: children share their
parent's budget by weight, but none gets more than its subtree can give (its tokens times ``max_epochs``, without the
subtrees of weight 0 or less); what a child cannot take goes to its siblings first, and to the parent's siblings only if
all of them are full. A leaf's budget is filled with whole epochs and then with a prefix of one more: its documents in the
order of (a seeded hash of seed, epoch and doc_id; tokens) as long as the running sum of tokens stays within the budget.

The running sum is a two-level prefix scan: sums of 4096 hash buckets first, then inside each leaf's one bucket where
the budget ends, so that a leaf with a third of all rows is no task of its own. What comes out is one cut for each leaf;
the rows themselves are then only filtered by it, never joined on their ids.

Defined results: null texts and texts without words have 0 tokens and come in as far as their place in the epoch does;
null levels form a node of their own, "(none)"; null ids hash as an empty one; rows that repeat an id are judged each on
its own, but rows that tie in id and tokens come in all together or not at all; an empty table gives no rows. A weight
of 0 or less keeps a node out. Input columns named like a level, n_tokens or copies give way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import drop, save

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(weights: dict[tuple[str, ...], int], path: list[str]) -> Column:
    """The weight of the node that the columns ``path`` name; 1 where none is given."""
    given = [(k, v) for k, v in weights.items() if len(k) == len(path)]
    if not given:
        return F.lit(1).cast("long")
    found = reduce(lambda c, kv: c.when(reduce(lambda x, y: x & y, (F.col(n) == v for n, v in zip(path, kv[0]))), int(kv[1])), given, F)
    return found.otherwise(1).cast("long")


def share(nodes: DataFrame, parent: list[str], weights: dict[tuple[str, ...], int], path: list[str]) -> DataFrame:
    """``nodes`` (path, cap, budget of the parent) with the column ``given``: water-filling among siblings.

    Siblings are filled by rising cap per weight; those whose cap lies below the level that is left are capped, the
    others get weight times the common level, rounded down.
    """
    nodes = nodes.withColumn("_w", weight_of(weights, path)).withColumn("_r", F.when(F.col("_w") > 0, F.col("cap").cast("double") / F.col("_w")))
    every = Window.partitionBy(*parent)
    before = every.orderBy(F.col("_r").asc_nulls_last(), *path).rowsBetween(Window.unboundedPreceding, -1)
    live = F.col("_w") > 0
    total = lambda c, w: F.coalesce(F.sum(F.when(live, F.col(c)).otherwise(0)).over(w), F.lit(0))
    nodes = nodes.withColumn("_left", F.col("budget") - total("cap", before)).withColumn("_rest", total("_w", every) - total("_w", before))
    nodes = nodes.withColumn("_full", live & (F.col("cap").cast("double") <= F.col("_w") * (F.col("_left").cast("double") / F.greatest(F.col("_rest"), F.lit(1)))))
    taken = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(every)
    heavy = F.sum(F.when(live & ~F.col("_full"), F.col("_w")).otherwise(0)).over(every)
    level = (F.col("budget") - taken).cast("double") / F.greatest(heavy, F.lit(1))
    given = F.when(~live, 0).when(F.col("_full"), F.col("cap")).otherwise(F.greatest(F.floor(F.col("_w") * level), F.lit(0)))
    return nodes.withColumn("given", given.cast("long")).drop("_w", "_r", "_left", "_rest", "_full")


def budgets(leaves: DataFrame, levels: list[str], fraction: tuple[int, int], weights: dict, max_epochs: int) -> DataFrame:
    """(levels, tokens, given) of every leaf (levels, tokens): the token budget that reaches it."""
    caps = []  # of a leaf as each level sees it: nothing if a node between the two is kept out
    for i in range(len(levels)):
        alive = [weight_of(weights, levels[: j + 1]) > 0 for j in range(i + 1, len(levels))]
        caps.append(F.when(reduce(lambda x, y: x & y, alive, F.lit(True)), F.col("tokens") * max_epochs).otherwise(0).alias(f"_cap{i}"))
    leaves = leaves.select("*", *caps)
    out = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * fraction[0] / fraction[1]).cast("long").alias("given")).withColumn("_one", F.lit(1))
    for i in range(len(levels)):
        path = levels[: i + 1]
        nodes = leaves.groupBy(*path).agg(F.sum(f"_cap{i}").alias("cap")).withColumn("_one", F.lit(1))
        parents = out.select("_one", *levels[:i], F.col("given").alias("budget"))
        out = share(nodes.join(parents, ["_one", *levels[:i]]), ["_one", *levels[:i]], weights, path)
    return leaves.select(*levels, "tokens").join(out.select(*levels, "given"), levels)


def epoch_key(seed: int, epoch: Column, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def cuts(rows: DataFrame, names: list[str], plan: DataFrame, seed: int) -> DataFrame:
    """``plan`` (levels, _epochs, _rest) with where each leaf's prefix ends: the bucket _end (null: nowhere), and _last, the
    last (key, n_tokens) that is taken in it. ``rows``: levels, _id, n_tokens."""
    keyed = rows.join(plan, names).withColumn("_key", epoch_key(seed, F.col("_epochs"), "_id")).withColumn("_bucket", bucket("_key"))
    sums = keyed.groupBy(*names, "_bucket", "_rest").agg(F.sum("n_tokens").alias("_in"))
    until = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(until), F.lit(0)))
    ends = sums.where("_before + _in > _rest").groupBy(*names).agg(F.min(F.struct(F.col("_bucket"), F.col("_before"))).alias("_e"))
    ends = ends.select(*names, F.col("_e._bucket").alias("_end"), F.col("_e._before").alias("_upto"))
    inside = Window.partitionBy(*names).orderBy("_order").rangeBetween(Window.unboundedPreceding, 0)  # ties together
    last = keyed.join(small(ends), names).where("_bucket = _end").withColumn("_order", F.struct("_key", "n_tokens"))
    last = last.withColumn("_sum", F.col("_upto") + F.sum("n_tokens").over(inside)).where("_sum <= _rest").groupBy(*names).agg(F.max("_order").alias("_last"))
    return plan.join(ends.select(*names, "_end"), names, "left").join(last, names, "left")


def bucket(key: str) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def small(table: DataFrame, most: int = 10_000) -> DataFrame:
    """The table, to be broadcast if it has at most ``most`` rows; a sort-merge join takes larger ones."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def mix(
    spark: SparkSession, docs: DataFrame, levels: dict[str, Column], doc_id: str = "doc_id", fraction: tuple[int, int] = (1, 2),
    weights: dict[tuple[str, ...], int] | None = None, max_epochs: int = 4, seed: int = 7, tokens: Column | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (doc_id alone by default), the levels, n_tokens and copies (1 or more) of every chosen row.

    ``levels``: columns from the root down. ``fraction``: budget as a share of all tokens. ``weights``: whole numbers by
    path of node names, 1 where none is given. ``tokens``: tokens of a row, by default its words.
    """
    names, none = list(levels), F.lit("(none)")
    added = {**{n: F.coalesce(c.cast("string"), none) for n, c in levels.items()}, "n_tokens": tokens if tokens is not None else n_words()}
    rows = save(spark, docs.select(F.col(doc_id).alias("_id"), *(c.alias(n) for n, c in added.items())), "mix-rows")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, names, fraction, weights or {}, max_epochs)
    plan = plan.withColumn("_epochs", F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(0).cast("long"))
    plan = save(spark, plan.select(*names, "_epochs", (F.col("given") - F.col("_epochs") * F.col("tokens")).alias("_rest"), *(weight_of(weights or {}, names[: i + 1]).alias(f"_w{i}") for i in range(len(names)))), "mix-plan")
    plan_ = plan.where(" AND ".join(f"_w{i} > 0" for i in range(len(names)))).select(*names, "_epochs", "_rest")
    found = save(spark, cuts(rows, names, small(plan_), seed), "mix-cuts")
    drop(spark, rows, plan)
    held = keep if keep is not None else [doc_id]
    out = docs.select(F.col(doc_id).alias("_id"), *(F.col(c).alias(f"_in_{c}") for c in held if c not in (*names, "n_tokens", "copies")), *(c.alias(n) for n, c in added.items()))
    out = out.join(small(found), names).withColumn("_key", epoch_key(seed, F.col("_epochs"), "_id")).withColumn("_bucket", bucket("_key"))
    taken = F.col("_end").isNull() | (F.col("_bucket") < F.col("_end")) | ((F.col("_bucket") == F.col("_end")) & F.coalesce(F.struct("_key", "n_tokens") <= F.col("_last"), F.lit(False)))
    out = out.withColumn("copies", F.col("_epochs") + taken.cast("long")).where("copies > 0")
    return out.select(*(F.col(f"_in_{c}").alias(c) for c in held if c not in (*names, "n_tokens", "copies")), *names, "n_tokens", "copies")
