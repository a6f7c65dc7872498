"""Documents to a training mix: language ID, line dedup, near-duplicate join, decontamination, mixing.

Each stage reads what its predecessor wrote. Rows with a null doc_id are judged each on its own by every stage but line
dedup and the near-duplicate join, which leave them alone; rows that repeat a doc_id share their fate in those two.
Columns that documents has beyond its own go through; one named lang, domain, n_tokens or copies gives way to the mix. No stage can be expressed in SQL as a whole (a trained classifier comes first), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regloom.llm import decontaminate, jaccard_join, lang_id, line_dedup, mixing
from regloom.llm.frames import remainder
from regloom.llm.queries import WEIGHTS, levels, table
from regloom.llm.store import save

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts whose best language has a probability below 0.5; fills a missing lang."""
    model = lang_id.fit(docs.where(remainder("doc_id", 4) != 2))
    found = lang_id.identify(docs, model, docs.columns).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5))
    return found.select(*(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that repeat an earlier line exactly or nearly; a document that loses all its lines goes."""
    out = line_dedup.dedup(spark, docs).where("not (n_removed > 0 and n_removed = n_lines)")
    return out.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of Jaccard similarity 0.8 and more over five-word shingles."""
    found = jaccard_join.join(spark, docs, n=5, num=80, den=100)
    gone = found.where("not (doc_id <=> component_id)").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row (or a whole shorter item) with a benchmark item."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with domain, n_tokens and how many copies are to be read."""
    return mixing.mix(spark, docs, levels(), weights=WEIGHTS, keep=docs.columns)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("mixing to weights", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
