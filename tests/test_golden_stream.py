"""The golden sweep against stored expectations, and counts over a stream with late rows."""

import json
import os

from pyspark.sql import functions as F

from regloom.operators import asm
from regloom.sources import golden
from regloom.streaming import programs as streams

STORED = os.path.join(os.path.dirname(__file__), "golden_programs.json")


def test_sweep_is_as_stored(spark):
    found = golden.told(golden.sweep(spark)).persist()
    stored = spark.createDataFrame([tuple(r) for r in json.load(open(STORED))], "generator string, seed bigint, text string, length int, steps int, output string, status string")
    assert stored.count() == found.count() == 50 and found.where("status <> 'halted'").count() == 0
    assert golden.differences(stored, found).count() == 0
    bent = stored.withColumn("output", F.when((F.col("generator") == "branched") & (F.col("seed") == 4), "9").otherwise(F.col("output"))).where("not (generator = 'counter' and seed = 7)")
    assert sorted(tuple(r) for r in golden.differences(bent, found).collect()) == [("branched", 4, "output"), ("counter", 7, "new")]
    assert {r.problem for r in golden.differences(stored, found.where("seed < 20")).collect()} == {"missing"}
    found.unpersist()


def test_null_keys_and_parts(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v int")
    got = golden.differences(rows((None, 1), (1, None), (2, 5)), rows((None, 2), (1, None), (3, 1)), ["k"], ["v"]).collect()
    assert sorted((str(r.k), r.problem) for r in got) == [("2", "missing"), ("3", "new"), ("None", "v")]


def test_counts_of_a_stream_leave_late_rows_out(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    texts = {"a": [("10:00:10", "LOAD R0 1\nPRINT R0"), ("10:00:50", "NOP")], "b": [("11:30:00", "HALT")], "c": [("11:30:30", "HALT")], "d": [("10:00:20", "NOP\nNOP"), ("11:29:00", "HALT")], "e": [("13:00:00", "HALT")]}
    # what is late is told by the watermark of the batch before, so that d is the first to meet that of b
    for age, (name, rows) in enumerate(texts.items()):
        path = f"{tmp_path}/in/{name}.json"
        with open(path, "w") as f:
            for i, (at, source) in enumerate(rows):
                f.write(json.dumps({"id": i, "ts": f"2024-05-01T{at}Z", "source": source}) + "\n")
        os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))  # files are taken by age
    counts = streams.op_counts(asm.parse(streams.read_sources(spark, f"{tmp_path}/in", per_trigger=1)))
    run = counts.writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.start.strftime("%H:%M"), r.op): r.n for r in spark.sql("SELECT * FROM told").collect()}
    assert got == {("10:00", "LOAD"): 1, ("10:00", "PRINT"): 1, ("10:00", "NOP"): 1, ("11:29", "HALT"): 1, ("11:30", "HALT"): 2}
    batch = asm.parse(spark.read.schema("id bigint, ts timestamp, source string").json(f"{tmp_path}/in"))
    assert streams.executed(batch).where("status = 'halted'").count() == 7
