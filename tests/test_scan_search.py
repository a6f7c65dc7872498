"""File order, one-pass searches, pruned copies, merged sketches, and SQL functions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from regloom.functions import sql
from regloom.operators import asm, search, stats, vm
from regloom.sources import datasets, scan


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def written(tmp_path, sizes):
    """JSON lines in files whose order by name is not their order by size; all rows in the order that is wanted."""
    rows, rng = [], random.Random(3)
    for name, n in sizes.items():
        with open(f"{tmp_path}/{name}", "w") as f:
            for _ in range(n):
                rows.append(rng.randrange(50))
                f.write(json.dumps({"x": rows[-1], "pad": "p" * rng.randrange(90)}) + "\n")
    return rows


def test_numbers_over_files_in_parts(spark, tmp_path, small_splits):
    want = written(tmp_path, {"a.json": 200, "b.json": 3, "c.json": 0, "d.json": 500, "e.json": 90})
    read = lambda files: spark.read.schema("x int, pad string").json(files)
    df = read(str(tmp_path))
    assert df.rdd.getNumPartitions() > 8  # files are read in parts
    got = {r.idx: r.x for r in scan.numbered(df).select("idx", "x").collect()}
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)
    for n in (0, 1, 200, 204, 650, 10_000):
        some = sorted((r.idx, r.x) for r in scan.first_rows(read, df.inputFiles(), n).select("idx", "x").collect())
        assert some == list(enumerate(want[:n])), n
    first = scan.first_rows(read, df.inputFiles(), 150)
    assert {os.path.basename(f) for f in first.inputFiles()} == {"a.json"}  # the other files are not read
    plan = scan.numbered(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert scan.numbered(read([f"{tmp_path}/c.json"])).count() == 0
    with pytest.raises(ValueError):
        scan.first_rows(read, [], 1)


def test_numbers_over_parquet(spark, tmp_path):
    for i, (a, b) in enumerate(((0, 40), (40, 41), (41, 99))):
        spark.range(a, b).coalesce(1).write.parquet(f"{tmp_path}/part={i}")
    got = scan.numbered(spark.read.parquet(str(tmp_path)).withColumn("idx", F.lit(5)).drop("idx")).select("idx", "id").collect()
    assert sorted((r.idx, r.id) for r in got) == [(i, i) for i in range(99)]


SOURCES = {
    1: "LOAD R0 5\nPRINT R0\nHALT", 2: "LOAD R0 5\nADD R1 R0 R0\nMOV R2 R1\nNEG R3 R2\nPRINT R3\nHALT", 3: "LOAD R0 127\nMUL R0 R0 R0\nMUL R0 R0 R0\nADD R1 R0 R0\nNEG R2 R1\nMOV R3 R2\nPRINT R2\nHALT",
    4: "NOP", 5: "LOAD R0 5\nADD R1 R0 R0\nMOV R2 R1\nNEG R3 R2\nPRINT R3\nHALT", 6: "HALT", 7: "NOP\nHALT",
}


def ran(spark):
    df = spark.createDataFrame([(i, s, "b" if i > 5 else "a") for i, s in SOURCES.items()], "id int, source string, part string")
    return vm.run(asm.parse(df))


def test_best_first_and_fallback(spark):
    df = ran(spark)
    found = {r.part: r for r in search.best(df, "id", by=["part"], keep=["source"]).collect()}
    assert set(found) == {"a"} and found["a"].id == 3 and found["a"].source == SOURCES[3] and found["a"].signature.clamping_seen
    assert search.best(df, "id", by=["part"], scan=3).first().id == 2 and search.best(df, "id", least_ops=50).count() == 0
    short = F.size("program").between(5, 6)
    got = {r.part: (r.id, r.fallback, r.source) for r in search.pick(df, "id", short, by=["part"], keep=["source"]).collect()}
    assert got == {"a": (2, False, SOURCES[2]), "b": (6, True, SOURCES[6])}
    assert [(r.id, r.fallback) for r in search.pick(df, "id", F.lit(None).cast("boolean")).collect()] == [(1, True)]
    assert search.pick(df.limit(0), "id", short).count() == 0
    assert [(r.part, r.id) for r in search.first(df, "id", search.clamps(F.col("program"), F.col("trace")), by=["part"]).collect()] == [("a", 3)]
    plan = search.pick(df, "id", short, by=["part"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_packed_copy_prunes(spark, tmp_path):
    rows = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, "eval").otherwise("train").alias("split"), F.concat(F.lit("b"), (F.col("id") % 20).cast("string")).alias("bucket"))
    datasets.pack(rows, f"{tmp_path}/p")
    text = lambda df: df._jdf.queryExecution().toString()
    one = datasets.packed(spark, f"{tmp_path}/p", "eval", "b4")
    assert sorted(r.id for r in one.collect()) == list(range(4, 400, 20))
    assert "PartitionFilters: [isnotnull(split" in text(one) and len(one.inputFiles()) <= len(datasets.packed(spark, f"{tmp_path}/p").inputFiles())
    spark.createDataFrame([("b8", 1), ("b12", 1), ("b3", 0)], "bucket string, take int").write.parquet(f"{tmp_path}/dim")
    dim = spark.read.parquet(f"{tmp_path}/dim").where("take = 1")
    joined = datasets.packed(spark, f"{tmp_path}/p", "eval").join(dim, "bucket")
    assert "dynamicpruning" in text(joined)
    assert sorted(r.id for r in joined.collect()) == sorted([*range(8, 400, 20), *range(12, 400, 20)])


def test_dataset_to_parquet(spark, tmp_path):
    from regloom.sources import specs

    out, recipe = f"file://{tmp_path}/d", specs.RECIPES["tier0"].sized(6, 4)
    datasets.emit(spark, recipe, out, mode="counter")
    assert {r.split: r["count"] for r in datasets.all_splits(spark, f"{out}/tier0", "tier0").groupBy("split").count().collect()} == {"train": 6, f"eval_{recipe.buckets[0][0]}": 4}
    datasets.to_parquet(spark, f"{out}/tier0", f"{out}/copy", "tier0")
    assert datasets.packed(spark, f"{out}/copy", "train").count() == 6
    assert datasets.packed(spark, f"{out}/copy", "eval", recipe.buckets[0][0]).where("size(program) > 0").count() == 4


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("split"), F.when(F.col("id") % 1000 != 7, F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("v"))
    kept = stats.sketches(df, "v", ["split"])
    whole = stats.told(stats.merged(kept)).first()
    values = sorted(r.v for r in df.where("v is not null").collect())
    assert whole.n == len(values) and abs(whole.distinct / len(set(values)) - 1) < 0.04
    for q, r in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)):
        assert abs(sum(v <= whole[q] for v in values) / len(values) - r) < 0.015
    assert stats.told(kept, ["split"]).count() == 3 and stats.told(stats.merged(stats.sketches(df.limit(0), "v", ["split"]), ["split"]), ["split"]).count() == 0


def test_sql_functions(spark):
    sql.register(spark)
    sql.register(spark)  # again: nothing to complain of
    r = spark.sql("SELECT vm_clamp(5000) a, vm_clamp(NULL) b, vm_div(-7, 2) c, vm_div(7, 0) d, vm_alu('MUL', 1000, -1000) e, vm_alu('LT', 1, 2) f, vm_alu('HALT', 1, 2) g, vm_score(array(1), array(1)) h").first()
    assert tuple(r) == (1023, None, -3, 0, -1024, 1, None, 1.0)
    ran(spark).createOrReplaceTempView("ran")
    got = spark.sql("SELECT r.id, s.t, s.pc, s.emitted FROM ran r, LATERAL vm_steps(r.trace) s WHERE r.id = 1 ORDER BY s.t").collect()
    assert [tuple(x) for x in got] == [(1, 0, 0, None), (1, 1, 1, 5), (1, 2, 2, None)]
    got = spark.sql("SELECT * FROM vm_pairs(array(1, 2, 3), array(1, 5)) ORDER BY idx").collect()
    assert [tuple(x) for x in got] == [(0, 1, 1, False), (1, 2, 5, True), (2, 3, None, True)]
    assert spark.sql("SELECT * FROM vm_pairs(CAST(array() AS array<int>), CAST(array() AS array<int>))").count() == 0
    assert spark.sql("SELECT count(*) FROM ran r, LATERAL vm_lines(r.program) l").first()[0] == sum(len(s.split("\n")) for s in SOURCES.values())
