"""Comparison bundles: a program's text, its true trace and a model's output in one JSON document.

Bundles are made by a join of truth and predictions and written by the executors, one file for each key or many to a
file as JSON lines. They are read as whole texts and judged row by row: a damaged one gets a problem, never fails a job.

Problems, the first that holds: ``not JSON`` (also a null text), ``not an object``, ``schema`` (another tag), the path of
a part that is missing or of a wrong kind, ``values`` (right kinds, but elements that do not fit), null for a sound one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isa, tokens
from ..operators import asm, compare, vm

#: Tag of the format; readers and writers take another one as a parameter.
TAG = "regloom/comparison/v1"
_STEP = "STRUCT<emitted:INT,pc:INT,regs:ARRAY<INT>,stack:ARRAY<INT>>"
_BODY = f"groundTruth STRUCT<trace:STRUCT<halted:BOOLEAN,output:ARRAY<INT>,steps:ARRAY<{_STEP}>>>, prediction STRUCT<output:ARRAY<INT>>, schema STRING, source STRING"
_BROKEN = "_broken"
#: Parts by path and the kind of each.
PARTS = {
    "$.source": "STRING", "$.groundTruth": "OBJECT", "$.groundTruth.trace": "OBJECT", "$.groundTruth.trace.steps": "ARRAY", "$.groundTruth.trace.output": "ARRAY",
    "$.groundTruth.trace.halted": "BOOLEAN", "$.prediction": "OBJECT", "$.prediction.output": "ARRAY",
}


def bundle(program: Column, trace: Column, predicted: Column, meta: Column, tag: str = TAG) -> Column:
    """The document as a struct, keys in order. ``meta``: a struct (generator, seed, spec, or whatever tells the origin)."""
    step = lambda s: F.struct(s["emitted"].alias("emitted"), s["pc"].alias("pc"), s["regs"].alias("regs"), s["stack"].alias("stack"))
    told = F.struct(trace["halted"].alias("halted"), trace["output"].alias("output"), F.transform(trace["steps"], step).alias("steps"))
    source = tokens.text(tokens.encode(program))
    return F.struct(F.struct(told.alias("trace")).alias("groundTruth"), meta.alias("meta"), F.struct(predicted.alias("output")).alias("prediction"), F.lit(tag).alias("schema"), source.alias("source"))


def assemble(truth: DataFrame, predictions: DataFrame, ids: list[str], meta: Column, tag: str = TAG) -> DataFrame:
    """(ids, bundle) of ``truth`` (ids, program, trace) and ``predictions`` (ids, idx, value), joined by id.

    A program without predictions has an empty output. Values of one place: the least counts. Null ids join nothing.
    """
    order = F.array_sort(F.collect_set(F.struct("idx", "value")))
    last = F.transform(F.filter(F.col("_v"), lambda x: x["value"].isNotNull()), lambda x: x["value"].cast("int"))
    gathered = predictions.groupBy(*ids, "idx").agg(F.min("value").alias("value")).groupBy(*ids).agg(order.alias("_v")).select(*ids, last.alias("_predicted"))
    both = truth.join(gathered, ids, "left").withColumn("_predicted", F.coalesce("_predicted", F.array().cast("array<int>")))
    return both.select(*ids, bundle(F.col("program"), F.col("trace"), F.col("_predicted"), meta, tag).alias("bundle"))


def text(document: Column, pretty: bool = True) -> Column:
    """The document as JSON with nulls kept; ``pretty`` spreads it over lines."""
    return F.to_json(document, {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def write(bundles: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """One file for each key, in a folder ``key=value``. Rows of a key meet in one task, so that keys make one file each."""
    bundles.select(F.col(key), text(F.col("bundle")).alias("value")).repartition(F.col(key)).write.mode(mode).partitionBy(key).text(path)


def write_lines(bundles: DataFrame, path: str, mode: str = "error") -> None:
    """All bundles as JSON lines, for sets too large for a file each."""
    bundles.select(text(F.col("bundle"), pretty=False).alias("value")).write.mode(mode).text(path)


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(value, file, and the key if files lie by key): the texts as they are; ``checked`` tells which are sound.

    Files of any other reader's making will do: one JSON document to a file, or to a line with ``lines``.
    """
    found = spark.read.text(path, wholetext=not lines)
    return found.select("*", F.col("_metadata.file_path").alias("file"))


def checked(df: DataFrame, value: str = "value", tag: str = TAG) -> DataFrame:
    """``df`` with ``problem`` and ``bundle`` (null if there is a problem). The text's parts are looked at as they are, so
    that a number does not pass for a text."""
    held = isa.once(df.select(*(c for c in df.columns if c not in ("problem", "bundle"))), "_v", F.try_parse_json(value))
    shallow = {"OBJECT": "map<string,variant>", "ARRAY": "array<variant>"}  # a look at one level, however much lies below

    def fits(path: str, want: str) -> Column:
        if want in shallow:
            return F.try_variant_get(F.col("_v"), path, shallow[want]).isNotNull()
        return F.coalesce(F.schema_of_variant(F.try_variant_get(F.col("_v"), path, "variant")), F.lit("")) == want

    problem = F.when(F.col("_v").isNull(), "not JSON").when(~fits("$", "OBJECT"), "not an object")
    problem = problem.when(~fits("$.schema", "STRING") | (F.coalesce(F.try_variant_get(F.col("_v"), "$.schema", "string"), F.lit("")) != tag), "schema")
    for path, want in PARTS.items():
        problem = problem.when(~fits(path, want), path[2:])
    held = isa.once(held, "_problem", problem)
    parsed = F.when(F.col("_problem").isNull(), F.from_json(value, f"{_BODY}, {_BROKEN} STRING", {"columnNameOfCorruptRecord": _BROKEN}))
    held = isa.once(held, "_parsed", parsed)
    body = F.struct(*(F.col(f"_parsed.{c}").alias(c) for c in ("groundTruth", "prediction", "schema", "source")))
    told = F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.col(f"_parsed.{_BROKEN}").isNotNull(), "values")
    return held.withColumns({"problem": told, "bundle": F.when(told.isNull(), body)}).drop("_v", "_problem", "_parsed")


def judged(df: DataFrame) -> DataFrame:
    """Checked bundles with ``parity`` and, of sound ones, ``place`` (first difference of the prediction, -1: none) and ``score``.

    parity: unparsed (the text is no program), skipped (the stored trace is of a fault), match, mismatch, or the status of
    a rerun that failed; null for a bundle with a problem.
    """
    keep = [c for c in df.columns if c not in ("parity", "place", "score", "program", "errors", "lines", "trace", "regs", "stack", "status")]
    ran = vm.run(asm.parse(df.select(*keep, F.col("bundle.source").alias("_source")), "_source"), steps=False)
    truth, told = F.col("bundle.groundTruth.trace"), F.col("bundle.prediction.output")
    found = compare.parity(ran.select("*", truth["output"].alias("_stored"), truth["halted"].alias("_halted")), "_stored", "_halted")
    parity = F.when(F.col("bundle").isNull(), None).when(F.col("program").isNull(), "unparsed").otherwise(F.col("parity"))
    sound = F.col("bundle").isNotNull()
    place, score = F.when(sound, compare.first_difference(truth["output"], told)), F.when(sound, compare.exact(told, truth["output"]))
    return found.withColumn("parity", parity).select(*keep, "parity", place.alias("place"), score.alias("score"))
