"""Dataset recipes and row seeds: one row of a specification for each program to be made.

``spark.range`` makes the indexes in parallel and in order; seeds and draws are pure expressions of them, so that any
part can be made again on its own after a lost executor.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Recipe:
    """axes: for the training rows, by name (low, high) of a range, a list of choices, or a chance; buckets: name, rows, fixed axes."""

    tier: str
    train: int
    axes: dict
    buckets: tuple[tuple[str, int, dict], ...]
    renders: tuple[str, ...] = ("direct",)
    names: tuple[str, ...] = field(default=())

    def sized(self, train: int, rows: int) -> Recipe:
        """The same with fewer rows."""
        return Recipe(self.tier, train, self.axes, tuple((n, rows, a) for n, _, a in self.buckets), self.renders)


def _branchy(n: int, k: int, b: int, l: int, use_stack: bool = False, stack_frames: int = 0) -> dict:
    return {"n": n, "k": k, "b": b, "l": l, "use_stack": use_stack, "stack_frames": stack_frames}


# Sizes and difficulty axes of the three tiers.
RECIPES = {
    "tier0": Recipe("tier0", 100_000, {"n": (4, 8)}, (("all", 10_000, {"n": 8}),)),
    "tier1": Recipe("tier1", 200_000, {"n": (8, 32), "k": [2, 4, 8]}, tuple((f"len_{n}", 20_000, {"n": n, "k": 4}) for n in (8, 16, 32, 48, 64, 96, 128))),
    "tier2": Recipe(
        "tier2",
        500_000,
        {"n": (16, 256), "k": [4, 6, 8], "b": (1, 8), "l": (0, 16), "use_stack": 0.5, "stack_frames": (0, 2)},
        (
            ("easy", 10_000, _branchy(32, 4, 1, 0)),
            ("medium", 10_000, _branchy(64, 4, 2, 4)),
            ("hard", 10_000, _branchy(128, 6, 4, 8, True, 1)),
            ("ood_len_256", 10_000, _branchy(256, 4, 2, 4)),
        ),
        ("direct", "cot"),
    ),
}


def row_seed(base: Column | int, split: Column | str, bucket: Column | str | None, index: Column) -> Column:
    """Unsigned 64-bit seed of a row as DECIMAL(20,0): the first eight bytes of SHA-256 of ``base|split|bucket|index``."""
    wrap = lambda x: x if isinstance(x, Column) else F.lit(x)
    key = F.concat(wrap(base).cast("string"), F.lit("|"), wrap(split), F.lit("|"), F.coalesce(wrap(bucket).cast("string"), F.lit("")), F.lit("|"), index.cast("string"))
    return F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(16)), 16, 10).cast("decimal(20,0)")


def words(key: Column) -> Column:
    """Eight draws below 2^32 from one SHA-256 of ``key``, as an array."""
    h = F.sha2(key, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))


def files(recipe: Recipe) -> list[tuple[str, str | None, int, dict | None]]:
    """(split, bucket, rows, fixed axes) of each file."""
    return [("train", None, recipe.train, None)] + [("eval", name, rows, axes) for name, rows, axes in recipe.buckets]


def rows(spark: SparkSession, recipe: Recipe, split: str, bucket: str | None = None, seed_base: int = 0, per_part: int = 5000) -> DataFrame:
    """(tier, split, bucket, idx, seed) of one file, in order, ``per_part`` rows to a partition."""
    found = [(n, a) for s, b, n, a in files(recipe) if (s, b) == (split, bucket)]
    if not found:
        raise ValueError(f"{recipe.tier} has no split {split!r} with bucket {bucket!r}")
    n = found[0][0]
    idx = spark.range(0, n, 1, max(1, -(-n // per_part))).withColumnRenamed("id", "idx")
    named = F.lit(bucket).cast("string")
    return idx.select(F.lit(recipe.tier).alias("tier"), F.lit(split).alias("split"), named.alias("bucket"), "idx", row_seed(seed_base, split, named, F.col("idx")).alias("seed"))


def axes(recipe: Recipe, bucket: str | None, key: Column) -> dict[str, Column]:
    """Axes of a row in counter mode: fixed for an eval bucket, else drawn from SHA-256 of ``key``."""
    if bucket is not None:
        return {n: F.lit(v) for n, v in next(a for b, _, a in recipe.buckets if b == bucket).items()}
    draws, out = words(key), {}
    for i, (name, kind) in enumerate(recipe.axes.items()):
        x = F.get(draws, F.lit(i))
        if isinstance(kind, tuple):
            out[name] = (kind[0] + x % (kind[1] - kind[0] + 1)).cast("int")
        elif isinstance(kind, list):
            out[name] = F.get(F.array(*(F.lit(v) for v in kind)), (x % len(kind)).cast("int"))
        else:
            out[name] = x < int(kind * (1 << 32))
    return out
