"""Datasets on disk: JSON lines or Parquet with a manifest of digests, written last.

Rows are made, run and rendered in parallel, without a shuffle: each partition is an index range and becomes one part
file, in order. The manifest has rows and SHA-256 of every part, computed by the executors in one job over all files.
``single`` writes one file for each split instead, as older readers want it; that is one ordered stream and does not scale.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import isa
from ..operators import exact, generate, vm
from . import digest, specs
from .specs import RECIPES, Recipe

VERSION = "0.1.0"
FILES = "*.{json,jsonl,parquet,txt}"
PROMPT = "STRUCT<input_ids:ARRAY<INT>,target_ids:ARRAY<INT>,input_text:STRING,target_text:STRING>"
_AXES = {"tier0": "n:INT", "tier1": "n:INT,k:INT", "tier2": "n:INT,k:INT,b:INT,l:INT,use_stack:BOOLEAN,stack_frames:INT"}


def schema(tier: str) -> str:
    """DDL of a dataset row."""
    modes = ",".join(f"{m}:{PROMPT}" for m in RECIPES[tier].renders)
    return f"meta STRUCT<tier:STRING,split:STRING,bucket:STRING,seed:DECIMAL(20,0),axes:STRUCT<{_AXES[tier]}>,renders:ARRAY<STRING>>, program {isa.PROGRAM}, trace {isa.TRACE}, renders STRUCT<{modes}>"


def rows(spark: SparkSession, recipe: Recipe, split: str, bucket: str | None = None, seed_base: int = 0, mode: str = "exact", per_part: int = 5000) -> DataFrame:
    """Dataset rows (idx, meta, program, trace, renders) of one file. ``mode``: exact (Python's generator) or counter (all in the JVM)."""
    spec = specs.rows(spark, recipe, split, bucket, seed_base, per_part)
    if mode == "exact":
        made = exact.make(spec, recipe.tier, bucket, recipe)
    elif mode == "counter":
        made = generate.make(spec.withColumns(specs.axes(recipe, bucket, F.concat(F.col("seed").cast("string"), F.lit("|axes")))), recipe.tier)
    else:
        raise ValueError(f"mode is 'exact' or 'counter', not {mode!r}")
    turns = F.col("l") if "l" in made.columns else F.lit(0)
    ran = vm.run(made, strict=True, turns=turns, modes=recipe.renders)
    meta = F.struct("tier", "split", "bucket", "seed", F.struct(*recipe.axes).alias("axes"), F.array(*(F.lit(r) for r in recipe.renders)).alias("renders"))
    shown = F.when(F.col("status") == "halted", F.col("renders")) if recipe.renders else F.lit(None).cast("struct<>")
    return ran.select("idx", meta.alias("meta"), "program", "trace", shown.alias("renders"))


def to_json(df: DataFrame) -> DataFrame:
    """(value) one compact JSON line for each row, keys in order, nulls kept."""
    return df.select(F.to_json(F.struct("meta", "program", "trace", "renders"), {"ignoreNullFields": "false"}).alias("value"))


def from_json(lines: DataFrame, tier: str) -> DataFrame:
    """Rows of JSON lines in column ``value``; a line that is no JSON has nulls."""
    return lines.select(F.from_json("value", schema(tier)).alias("r")).select("r.*")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        raise FileNotFoundError(f"no manifest at {path}: the dataset is incomplete")
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def revision() -> str:
    """The commit of the library's own checkout, "unknown" outside one."""
    git = Path(__file__).resolve().parents[2] / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        name = head.removeprefix("ref: ")
        if (git / name).exists():
            return (git / name).read_text().strip()
        packed = [line.split() for line in (git / "packed-refs").read_text().splitlines() if line.endswith(f" {name}")]
        return packed[0][0]
    except (OSError, IndexError):
        return "unknown"


def emit(spark: SparkSession, recipe: Recipe, out_dir: str, seed_base: int = 0, mode: str = "exact", single: bool = False, per_part: int = 5000, commit: str | None = None) -> str:
    """Write a dataset under out_dir/tier and return the path of its manifest.

    An old manifest goes first and the new one comes last, so that a manifest always means a whole dataset.
    """
    base = f"{out_dir.rstrip('/')}/{recipe.tier}"
    fs, manifest = _fs(spark, f"{base}/manifest.json")
    fs.delete(manifest, False)
    names = []
    for split, bucket, _, _ in specs.files(recipe):
        names.append("train.jsonl" if bucket is None else f"eval/{bucket}.jsonl")
        lines = to_json(rows(spark, recipe, split, bucket, seed_base, mode, per_part))
        fs.delete(_fs(spark, f"{base}/{names[-1]}")[1], True)
        if single:
            _stream(spark, lines, f"{base}/{names[-1]}")
        else:
            lines.write.text(f"{base}/{names[-1]}")
    files = {}
    for r in _files(spark, base).orderBy("file").toLocalIterator():  # a row for each part file
        if any(r.file == n or r.file.startswith(f"{n}/") for n in names):
            files[r.file] = {"rows": r.rows, "sha256": r.sha256}
    told = {"tier": recipe.tier, "seed_base": seed_base, "version": VERSION, "commit": commit or revision(), "generated_at": datetime.now(timezone.utc).isoformat().replace("+00:00", "Z"), "files": files}
    _put(spark, f"{base}/manifest.json", json.dumps(told, indent=2))
    return f"{base}/manifest.json"


def _stream(spark: SparkSession, lines: DataFrame, path: str) -> None:
    """One file from an ordered stream of lines, partition by partition."""
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    for row in lines.toLocalIterator():
        out.write(bytearray((row.value + "\n").encode()))
    out.close()


def _files(spark: SparkSession, dataset: str) -> DataFrame:
    """Digests of a dataset's files with ``file``, the place under its folder."""
    fs, where = _fs(spark, dataset)
    prefix = fs.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    return digest.digests(spark, dataset, FILES).withColumn("file", F.substring_index("path", prefix, -1))


def load_manifest(spark: SparkSession, dataset: str) -> dict:
    """The manifest of a dataset folder; FileNotFoundError means that the dataset is incomplete."""
    return json.loads(_get(spark, f"{dataset.rstrip('/')}/manifest.json"))


def verify(spark: SparkSession, dataset: str) -> DataFrame:
    """(path, problem) of files that are missing, differ from the manifest, or are not in it; no row means all is well."""
    told = load_manifest(spark, dataset)
    root = dataset.rstrip("/")
    listed = spark.createDataFrame([(f, e["sha256"], int(e["rows"])) for f, e in told["files"].items()], "file string, want string, want_rows bigint")
    found = _files(spark, root).where("file <> 'manifest.json'")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("want").isNull(), "not in the manifest").when(F.col("sha256") != F.col("want"), "digest differs").when(F.col("rows") != F.col("want_rows"), "row count differs")
    return listed.join(found, "file", "full_outer").select(F.col("file").alias("path"), problem.alias("problem")).where("problem IS NOT NULL")


def load(spark: SparkSession, dataset: str, split: str, bucket: str | None = None, tier: str = "tier1") -> DataFrame:
    """Rows of a split; eval needs its bucket."""
    if split not in ("train", "eval"):
        raise ValueError(f"split is 'train' or 'eval', not {split!r}")
    if split == "eval" and not bucket:
        raise ValueError("an eval split needs a bucket")
    name = "train.jsonl" if split == "train" else f"eval/{bucket}.jsonl"
    return spark.read.schema(schema(tier)).json(f"{dataset.rstrip('/')}/{name}")


def load_prompts(spark: SparkSession, path: str, mode: str = "direct", strict: bool = True) -> DataFrame:
    """(input_ids, target_ids): the reader gets a schema of nothing else, since JSON is not pruned. A row without the mode raises."""
    narrow = f"renders STRUCT<{mode}:STRUCT<input_ids:ARRAY<INT>,target_ids:ARRAY<INT>>>"
    prompt = F.col(f"renders.{mode}")
    ids = F.when(prompt.isNotNull(), prompt["input_ids"])
    if strict:
        ids = F.when(prompt.isNull(), F.raise_error(F.lit(f"no render named {mode}")).cast("array<int>")).otherwise(prompt["input_ids"])
    return spark.read.schema(narrow).json(path).select(ids.alias("input_ids"), prompt["target_ids"].alias("target_ids"))


def all_splits(spark: SparkSession, dataset: str, tier: str = "tier1") -> DataFrame:
    """Rows of all files with ``split`` as train or eval_bucket, from the files' places."""
    rows_ = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,json,txt}").schema(schema(tier)).json([f"{dataset.rstrip('/')}/train.jsonl", f"{dataset.rstrip('/')}/eval"])
    bucket = F.regexp_extract(F.col("_metadata.file_path"), "/eval/([^/]+)[.]jsonl", 1)
    return rows_.select("*", F.when(bucket != "", F.concat(F.lit("eval_"), bucket)).otherwise("train").alias("split"))


def to_parquet(spark: SparkSession, dataset: str, out: str, tier: str = "tier1") -> None:
    """The columnar copy: a folder for each split and bucket (train: none), so that readers prune by both."""
    rows_ = all_splits(spark, dataset, tier)
    pack(rows_.withColumn("bucket", F.regexp_extract("split", "^eval_(.*)$", 1)).withColumn("split", F.when(F.col("bucket") != "", "eval").otherwise("train")), out)


def pack(rows_: DataFrame, out: str, mode: str = "overwrite", per_file: int = 1_000_000) -> None:
    """Rows with columns split and bucket as Parquet by folders. A folder's rows go to as many tasks as AQE finds fit."""
    rows_.hint("rebalance", "split", "bucket").write.mode(mode).option("maxRecordsPerFile", per_file).partitionBy("split", "bucket").parquet(out)


def packed(spark: SparkSession, out: str, split: str | None = None, bucket: str | None = None) -> DataFrame:
    """The columnar copy, or the folders of a split and bucket alone; a join on split or bucket prunes while it runs."""
    found = spark.read.parquet(out)
    for name, value in (("split", split), ("bucket", bucket)):
        found = found if value is None else found.where(F.col(name) == value)
    return found
