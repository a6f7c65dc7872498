"""SHA-256 of files of any size, and of their blocks, in bounded memory.

The driver lists files (path and length, no content); executors read them. A digest is one ordered stream of a file, so
it is one task of a file, in pieces of ``PIECE`` bytes; files run in parallel. ``blocks`` cuts files into (path, offset)
rows that are read and hashed on their own: it says where two copies differ, and it spreads one large file over tasks.

Executors open a file by its address. Schemes that only Spark's own readers open (``RANGED`` has the others) are read
through Spark's binary source, a file as one value, which ends near 2 GB; ``ranged`` overrules the choice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
#: Schemes that executors open themselves, and the names by which they do.
RANGED = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs"}
DIGEST = "path string, bytes long, sha256 string, rows long"
BLOCK = "path string, offset long, bytes long, sha256 string"


def opened(path: str):
    """A file that can seek, by its address."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, name = fs.FileSystem.from_uri(f"{RANGED[scheme]}:{rest}")
    return system.open_input_file(name)


def pieces(path: str, offset: int = 0, length: int | None = None) -> Iterator[bytes]:
    """Bytes of a file from ``offset``, at most ``PIECE`` at a time."""
    with opened(path) as f:
        f.seek(offset)
        while length is None or length > 0:
            data = f.read(PIECE if length is None else min(PIECE, length))
            if not data:
                return
            length = None if length is None else length - len(data)
            yield data


def hashed(stream: Iterable[bytes]) -> tuple[int, str, int]:
    """Bytes, SHA-256 and newlines of a stream."""
    sha, size, rows = hashlib.sha256(), 0, 0
    for data in stream:
        sha.update(data)
        size += len(data)
        rows += data.count(b"\n")
    return size, sha.hexdigest(), rows


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder, or of one file; contents are not read.

    Spark's scan leaves out files without a byte, so they are taken from its listing.
    """
    scan = _scan(spark, path, pattern)
    every = [re.sub(r"^(\w+):///", r"\1:/", unquote(f)) for f in scan.inputFiles()]
    found = scan.select("path", "length")
    return spark.createDataFrame([(f,) for f in every], "path string").join(found, "path", "left").select("path", F.coalesce("length", F.lit(0)).alias("length"))


def _scan(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def opens(spark: SparkSession, path: str) -> bool:
    """Whether executors open the address themselves."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().getScheme()
    return scheme in RANGED


def _tasks(spark: SparkSession) -> int:
    """A fixed number of tasks: rows are names here, too small to tell how much there is to read."""
    return 4 * spark.sparkContext.defaultParallelism


def digests(spark: SparkSession, path: str, pattern: str = "*", ranged: bool | None = None) -> DataFrame:
    """(path, bytes, sha256, rows) of every file under ``path``; rows are its newlines."""
    if not (opens(spark, path) if ranged is None else ranged):
        whole = _scan(spark, path, pattern).select(F.col("path").alias("_path"), "content")
        found = listed(spark, path, pattern).join(whole, F.col("path") == F.col("_path"), "left").withColumn("content", F.coalesce("content", F.lit(bytearray())))
        newlines = F.length("content") - F.length(F.expr("replace(cast(content AS string), '\\n', '')").cast("binary"))
        return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), newlines.cast("bigint").alias("rows"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                size, sha, rows = hashed(pieces(file))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([sha]), pa.array([rows], pa.int64())], names=["path", "bytes", "sha256", "rows"])

    return listed(spark, path, pattern).select("path").repartition(_tasks(spark), "path").mapInArrow(run, DIGEST)


def blocks(spark: SparkSession, path: str, size: int = 64 << 20, pattern: str = "*") -> DataFrame:
    """(path, offset, bytes, sha256) of every block of ``size`` bytes; an empty file has none."""
    if size < 1:
        raise ValueError("a block has one byte or more")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist()):
                n, sha, _ = hashed(pieces(file, offset, size))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([offset], pa.int64()), pa.array([n], pa.int64()), pa.array([sha])], names=["path", "offset", "bytes", "sha256"])

    starts = listed(spark, path, pattern).where("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("offset"))
    return starts.repartition(_tasks(spark), "path", "offset").mapInArrow(run, BLOCK)


def differences(left: DataFrame, right: DataFrame, base: tuple[str, str]) -> DataFrame:
    """(file, offset, problem) where two folders' blocks differ; files by their place under each folder."""
    side = lambda df, root, n: df.select(F.regexp_replace("path", f"^.*?{re.escape(root.rstrip('/'))}/", "").alias("file"), "offset", F.col("sha256").alias(n))
    both = side(left, base[0], "a").join(side(right, base[1], "b"), ["file", "offset"], "full_outer")
    problem = F.when(F.col("a").isNull(), "only right").when(F.col("b").isNull(), "only left").when(F.col("a") != F.col("b"), "differs")
    return both.select("file", "offset", problem.alias("problem")).where("problem is not null")
