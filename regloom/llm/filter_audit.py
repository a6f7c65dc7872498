"""Audit of a set of filters: what each removes, alone, after others, and on average over all orders.

A relational word pipeline: words are exploded, counted by (document, word) and then by document for totals and distinct
words; the other flags are outer-joined, and one aggregation by part makes a conditional count for each of the 32 sets of
filters that a document can fail. All 120 orders follow from those counts without another look at a document.

Texts are dealt once by document before they are exploded, so that both counts and their keys stay in one stage; the list
of words itself never travels. The earliest document of each text is a minimum with map-side combining, joined by
(text, id): a text with a third of all rows is no hot key.

Filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * A-Z > 10 * code points; D one of ``#$%&*|``;
E the text of a smaller id.

Defined results: a null text is an empty one; a null part is the empty string; a null id never fails E, as it has no
order; rows that repeat an id are judged each on its own, equal ones do not make each other fail; rows of an id share its
labels, and labels that repeat an id count if any of them does; an empty table has no parts and gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def word_totals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _hash, n_words, n_distinct) of every different (id, text); ``_hash`` tells texts of one id apart.

    The null that ends each list counts the rows, so that equal rows do not add up.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.coalesce(text, F.lit("")).alias("_text")).repartition("_id", "_hash")
    words = rows.select("_id", "_hash", F.explode(F.array_append(F.split("_text", SEPARATOR), F.lit(None).cast("string"))).alias("_word"))
    counts = words.groupBy("_id", "_hash", "_word").agg(F.count(F.lit(1)).alias("_n"))
    real = F.col("_word") != ""
    total, copies = F.sum(F.when(real, F.col("_n"))), F.sum(F.when(F.col("_word").isNull(), F.col("_n")))
    found = counts.groupBy("_id", "_hash").agg(total.alias("_total"), copies.alias("_copies"), F.count_if(real).alias("n_distinct"))
    return found.select("_id", "_hash", F.expr("coalesce(_total, 0) div _copies").alias("n_words"), "n_distinct")


def fails(docs: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, part, A, B, C, D, E) of every row: which filters it fails."""
    t = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.sha2(t, 256).alias("_digest"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        (100 * F.regexp_count(t, F.lit("[A-Z]")) > 10 * F.length(t)).alias("C"), t.rlike("[#$%&*|]").alias("D"),
    )
    first = rows.where("_id is not null").groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    rows = rows.join(first, ["_digest", "_id"], "left").withColumn("E", F.col("_id").isNotNull() & F.col("_first").isNull())
    counts = word_totals(docs, doc_id, text).withColumnsRenamed({"_id": "_id_", "_hash": "_hash_"})
    rows = rows.join(counts, F.col("_id").eqNullSafe(F.col("_id_")) & (F.col("_hash") == F.col("_hash_")), "left")
    a, b = F.coalesce("n_words", F.lit(0)) < 100, 100 * F.coalesce("n_distinct", F.lit(0)) < 80 * F.coalesce("n_words", F.lit(0))
    return rows.select("_id", "part", a.alias("A"), b.alias("B"), "C", "D", "E")


def labelled(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``rows`` with good and toxic, from at most one row of labels for each id."""
    one = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return rows.join(one, "_id", "left")


def conditional_counts(rows: DataFrame, filters: str = FILTERS, outcomes: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """By part: arrays ``n`` and one for each outcome; place m counts the rows that fail just the filters in the bits of m."""
    mask = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    sets, kinds = range(1 << len(filters)), {"n": F.lit(True), **{o: F.coalesce(F.col(o), F.lit(False)) for o in outcomes}}
    columns = [F.count_if((F.col("_mask") == m) & c).alias(f"{k}_{m}") for k, c in kinds.items() for m in sets]
    found = rows.withColumn("_mask", mask).groupBy("part").agg(*columns)
    return found.select("part", *(F.array(*(f"{k}_{m}" for m in sets)).alias(k) for k in kinds))


def over(where: str, counts: str, filters: str = FILTERS, times: str = "1") -> Column:
    """Sum of ``counts`` over the sets m of failed filters that meet ``where``."""
    return F.expr(f"aggregate(filter(sequence(0, {(1 << len(filters)) - 1}), m -> {where}), 0L, (s, m) -> s + {counts}[m] * {times})")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, out of ``conditional_counts``."""
    steps = []
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append(f"struct('{name}', {step}, {1 << i}, {before})")
            before |= 1 << i
    rows = counts.select("*", F.expr(f"inline(array({', '.join(steps)}))").alias("filter_order", "step", "own", "before"))
    here = "(m & own) != 0 and (m & before) = 0"
    orders = len(steps) // len(filters)
    return rows.select(
        "part", "filter_order", "step", over("(m & (own | before)) = 0", "n", filters).alias("kept"), over(here, "n", filters).alias("removed"),
        over("(m & own) != 0 and (m & before) != 0", "n", filters).alias("redundant"), F.expr("n[own]").alias("unique_fails"),
        over(here, "good", filters).alias("good_lost"), over(here, "toxic", filters).alias("toxic_lost"),
        # of the orders of a set's filters each is first in the same number
        over("(m & own) != 0", "n", filters, f"({orders} div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) over all rows."""
    return interactions(conditional_counts(labelled(fails(docs, part, doc_id, text), labels, doc_id)))
