"""Comparison bundles on disk and damaged ones."""

import glob
import json

from pyspark.sql import functions as F

from regloom.operators import asm, vm
from regloom.sources import bundles


def ran(spark):
    texts = [(1, "LOAD R0 -93\nADD R1 R0 R0\nPRINT R1\nHALT"), (2, "LOAD R2 5\nPRINT R2\nPRINT R2"), (3, "NOP"), (None, "LOAD R1 1\nPRINT R1")]
    return vm.run(asm.parse(spark.createDataFrame(texts, "id bigint, source string")).drop("source"))


def made(spark):
    told = spark.createDataFrame([(1, 0, -186), (2, 0, 5), (2, 1, 6), (2, 1, 9), (2, 2, None), (9, 0, 1)], "id bigint, idx int, value int")
    return bundles.assemble(ran(spark), told, ["id"], F.struct(F.lit("test").alias("generator"), F.col("id").alias("seed")))


def test_files_by_key_and_back(spark, tmp_path):
    out = made(spark).where("id is not null")
    bundles.write(out, f"file://{tmp_path}/a", "id")
    files = sorted(glob.glob(f"{tmp_path}/a/id=*/*.txt"))
    assert len(files) == 3
    plain = json.load(open(files[0]))
    assert list(plain) == sorted(plain) and plain["schema"] == bundles.TAG and plain["source"].startswith("LOAD R0-93") and plain["meta"] == {"generator": "test", "seed": 1}
    got = {r.id: r for r in bundles.judged(bundles.checked(bundles.read(spark, f"file://{tmp_path}/a"))).collect()}
    want = {r.id: r.bundle for r in out.collect()}
    assert {i: r.problem for i, r in got.items()} == dict.fromkeys((1, 2, 3))
    for i, r in got.items():
        assert r.bundle.groundTruth == want[i].groundTruth and r.bundle.prediction == want[i].prediction and r.bundle.source == want[i].source
    assert [(got[i].parity, got[i].place, got[i].score) for i in (1, 2, 3)] == [("match", -1, 1.0), ("match", 1, 0.0), ("match", -1, 1.0)]
    bundles.write_lines(made(spark), f"file://{tmp_path}/b")
    lines = bundles.checked(bundles.read(spark, f"file://{tmp_path}/b", lines=True))
    assert lines.count() == 4 and lines.where("problem is not null").count() == 0


def damaged(whole):
    doc = json.loads(whole)
    yield whole[:-4], "not JSON"
    yield None, "not JSON"
    yield "", "not JSON"
    yield "[1, 2]", "not an object"
    yield "null", "not an object"
    yield json.dumps(doc | {"schema": "v0"}), "schema"
    yield json.dumps({k: v for k, v in doc.items() if k != "schema"}), "schema"
    yield json.dumps(doc | {"source": 7}), "source"
    yield json.dumps(doc | {"groundTruth": None}), "groundTruth"
    yield json.dumps(doc | {"groundTruth": {"trace": []}}), "groundTruth.trace"
    for part in ("steps", "output", "halted"):
        yield json.dumps(doc | {"groundTruth": {"trace": {k: v for k, v in doc["groundTruth"]["trace"].items() if k != part}}}), f"groundTruth.trace.{part}"
    yield json.dumps(doc | {"groundTruth": {"trace": doc["groundTruth"]["trace"] | {"halted": "true"}}}), "groundTruth.trace.halted"
    yield json.dumps(doc | {"prediction": 3}), "prediction"
    yield json.dumps(doc | {"prediction": {"output": {}}}), "prediction.output"
    yield json.dumps(doc | {"prediction": {"output": ["x"]}}), "values"
    yield json.dumps(doc | {"more": {"keys": [1]}}, indent=2), None


def test_damage_is_told_not_raised(spark, tmp_path):
    whole = made(spark).where("id = 1").select(bundles.text(F.col("bundle"))).first()[0]
    cases = list(damaged(whole))
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, value string")
    got = {r.i: r for r in bundles.judged(bundles.checked(df.withColumn("status", F.lit("kept"))).drop("status")).collect()}
    assert [got[i].problem for i in range(len(cases))] == [p for _, p in cases]
    assert all((r.parity is None and r.bundle is None and r.place is None) == (r.problem is not None) for r in got.values())
    assert bundles.checked(df, tag="v0").where("problem is null").count() == 1
    assert bundles.checked(df.limit(0)).count() == 0


def test_parity_of_sources(spark):
    whole = json.loads(made(spark).where("id = 1").select(bundles.text(F.col("bundle"))).first()[0])
    trace = whole["groundTruth"]["trace"]
    cases = [
        (whole | {"source": "FROB R1\n"}, "unparsed"), (whole | {"source": "FROB R1\n", "groundTruth": {"trace": trace | {"halted": False}}}, "unparsed"),
        (whole | {"groundTruth": {"trace": trace | {"halted": False}}}, "skipped"), (whole | {"groundTruth": {"trace": trace | {"output": [1]}}}, "mismatch"),
        (whole | {"source": "POP R1"}, "stack_underflow"), (whole, "match"),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)], "i int, value string")
    assert [r.parity for r in bundles.judged(bundles.checked(df)).orderBy("i").collect()] == [p for _, p in cases]
