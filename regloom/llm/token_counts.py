"""Token counts of documents in flat token files by separator scan.

A flat token file is nothing but token ids of a fixed width, every document followed by a separator id; there is no
index. Files are read in blocks that may cut documents anywhere. Each block is searched for the separator at once
(one comparison over the whole array) and reports its size, its separators and the distances between them; a prefix
scan over the block reports (running size, running last separator) then gives the one count per block that began in an
earlier block. Only these reports are shuffled.

Defined results: an empty document between two separators has 0 tokens; tokens after a file's last separator are a
document that is marked as not terminated; files without tokens give no rows. For texts: null and empty texts are
documents of 0 tokens, a separator's name inside a text is ordinary text, texts are read whole, repeated rows are
documents of their own, with a null id as with any other; an empty table gives no rows. Of its columns only the id and the
text are read. The vocabulary file travels to the executors with the job.
"""

from __future__ import annotations

import base64
import importlib.util
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import folder, save
from .text import slices, texts

BLOCK = 1 << 20
SEPARATOR = 50256


def default_tokenizers() -> str:
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


#: How byte-level BPE cuts a text into pieces before merging (the public GPT-2 pattern).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def write_files(spark: SparkSession, docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", separator: int = SEPARATOR) -> DataFrame:
    """(file, ordinal, id) of the texts, written to the shared folder as a flat file of little-endian uint16 ids by each task.

    The files hold nothing but ids. A task that runs again writes a file of its own; the list names those that count.
    """
    root = f"{folder(spark)}/regloom/tokens-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        file, n = f"{root}/{uuid.uuid4().hex}.bin", 0
        system, place = opened(file)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        with system.open_output_stream(place) as out:
            for piece in slices(batches):
                for text in texts(piece).to_pylist():
                    out.write(np.array([*encode(text), separator], "<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([file] * piece.num_rows, pa.string()), pa.array(np.arange(n, n + piece.num_rows)), piece.column("doc")], names=["file", "ordinal", "id"])
                n += piece.num_rows

    kind = docs.schema[doc_id].dataType.simpleString()
    made = docs.select(F.col(doc_id).alias("doc"), "text").mapInArrow(run, f"file string, ordinal long, id {kind}")
    return save(spark, made, "token-files")


def sizes(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(file, bytes) of files, patterns and folders; names that start with _ or . are left out of folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(conf)
        found = list(system.globStatus(where) or [])
        if not found:
            raise FileNotFoundError(path)
        for one in found:
            inside = list(system.listStatus(one.getPath())) if one.isDirectory() else [one]
            out += [(x.getPath().toString(), x.getLen()) for x in inside if x is one or (x.isFile() and x.getPath().getName()[0] not in "_.")]
    return out


def read_files(spark: SparkSession, path: str | list[str], width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, payload) of flat token files of any size: little-endian ids of ``width`` bytes.

    There is a row for each (file, offset, length), dealt over tasks; each reads its own ranges.
    """
    found = sizes(spark, [path] if isinstance(path, str) else path)
    for file, size in found:
        if size % width:
            raise ValueError(f"{file}: {size} bytes are no whole number of {width}-byte tokens")
    step = block * width

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = opened(row["file"])
                at, length = row["block"] * step, min(step, row["size"] - row["block"] * step)
                with system.open_input_file(place) as source:
                    part = source.read_at(length, at)
                if len(part) != length:
                    raise OSError(f"{row['file']}: {len(part)} of {length} bytes at {at}")
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([part], pa.binary())], names=["file", "block", "payload"])

    listed = spark.createDataFrame([x for x in found if x[1]], "file string, size long")
    ranges = listed.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {step}"))).alias("block"))
    tasks = max(1, min(sum(-(-size // step) for _, size in found), max(spark.sparkContext.defaultParallelism, sum(size for _, size in found) >> 26)))
    return ranges.repartition(tasks).mapInArrow(run, "file string, block long, payload binary")


def scan(blocks: DataFrame, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """One report for each block: size, separators, places of the first and last one, tokens between them, ids if given."""
    with_ids = "ids" in blocks.columns
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, n, first, last, counts = [], [], [], [], []
            for payload in batch.column("payload"):
                flat = np.frombuffer(payload.as_buffer(), kind)
                at = np.flatnonzero(flat == separator)
                size.append(len(flat))
                n.append(len(at))
                first.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                counts.append(np.diff(at, prepend=-1) - 1)
            arrays = [batch.column("file"), batch.column("block"), *(pa.array(x, pa.int64()) for x in (size, n, first, last)), pa.array(counts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays + ([batch.column("ids")] if with_ids else []), names=["file", "block", "size", "n", "first", "last", "counts"] + ["ids"] * with_ids)

    ids = f", ids {blocks.schema['ids'].dataType.simpleString()}" if with_ids else ""
    return blocks.mapInArrow(run, "file string, block long, size long, n long, first long, last long, counts array<long>" + ids)


def stitch(reports: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, terminated[, id]) of every document, from the block reports."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("size").over(before), F.lit(0))
    placed = reports.withColumn("_at", at).withColumn("_seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("_end", F.col("_at") + F.col("last"))
    placed = placed.withColumn("_open", F.col("_at") - 1 - F.coalesce(F.max("_end").over(before), F.lit(-1)))
    counts = F.transform("counts", lambda c, i: c + F.when(i == 0, F.col("_open")).otherwise(0))
    with_ids = "ids" in reports.columns
    zipped = F.arrays_zip(counts.alias("c"), F.col("ids").alias("id")) if with_ids else F.transform(counts, lambda c: F.struct(c.alias("c")))
    done = placed.select("file", "_seen", F.posexplode(zipped).alias("_i", "_x"))
    id_ = [F.col("_x.id").alias("id")] if with_ids else []
    done = done.select("file", (F.col("_seen") + F.col("_i")).cast("long").alias("ordinal"), F.col("_x.c").alias("n_tokens"), F.lit(True).alias("terminated"), *id_)
    tail = placed.groupBy("file").agg(F.sum("size").alias("size"), F.max("_end").alias("end"), F.sum("n").alias("n"))
    tail = tail.withColumn("n_tokens", F.col("size") - 1 - F.coalesce("end", F.lit(-1))).where("n_tokens > 0")
    none = [F.lit(None).cast(reports.schema["ids"].dataType.elementType).alias("id")] if with_ids else []
    return done.unionByName(tail.select("file", F.col("n").cast("long").alias("ordinal"), "n_tokens", F.lit(False).alias("terminated"), *none))


def count(spark: SparkSession, docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of every row: texts become flat token files, which are read by ranges and scanned for separators."""
    names = write_files(spark, docs, vocabulary, doc_id, separator)
    files = [r.file for r in names.select("file").distinct().collect()]  # one for each task that wrote
    found = stitch(scan(read_files(spark, files, block=block), separator)).where("terminated")
    name = F.substring_index("file", "/", -1).alias("_file")
    found = found.select(name, F.col("ordinal").alias("_ordinal"), "n_tokens")
    return names.select(name, F.col("ordinal").alias("_ordinal"), "id").join(found, ["_file", "_ordinal"]).select(F.col("id").alias(doc_id), "n_tokens")
