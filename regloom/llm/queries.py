"""One query for each operator, over whole tables, and DuckDB SQL where it can express the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, filter_audit, jaccard_join, lang_id, line_dedup, lm_score, merkle, mixing, quality_rules, resharding, substring_dedup, token_counts, toxicity
from .frames import remainder
from .store import folder

#: Target weights of the mix: whole numbers by path in the tree (domain, lang, source).
WEIGHTS = {("web",): 5, ("books",): 3, ("news",): 2, ("web", "en"): 3, ("books", "en"): 2}


def levels() -> dict[str, Column]:
    """Domain by the number at the source's end, then language, then source."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint)") % 3
    domain = F.when(number == 1, "books").when(number == 2, "news").otherwise("web")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    vocabulary = f"{tokenizers or token_counts.default_tokenizers()}/byte_bpe_50k.tiktoken"
    return token_counts.count(spark, table(spark, sf_dir, "documents"), vocabulary)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_rules.assess(docs, ["doc_id"], order=quality_rules.plan(docs), counts=True)
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"), levels(), weights=WEIGHTS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(remainder("doc_id", 4) != 2))
    return lang_id.identify(docs, model, ["doc_id"]).select("doc_id", lang_id.hold_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(spark, table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(spark, table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    held = F.coalesce(remainder("doc_id", 10) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.where(remainder("doc_id", 4) != 2))
    out = toxicity.assess(docs, index, ["doc_id"])
    return out.select("doc_id", lang_id.hold_out("doc_id").alias("held_out"), "score", "predicted", "evidence")


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 shards by a hash of the source, of which one holds a third of all rows, to 24 of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    old, path = F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(16)), f"{folder(spark)}/regloom/shards-{uuid.uuid4().hex}"
    resharding.reshard(spark, docs.withColumn("old_shard", old.cast("int")), F.col("old_shard"), [1] * 24, path)
    out = resharding.read(spark, path, docs.withColumn("old_shard", old.cast("int")).schema)
    crc = F.coalesce(F.crc32("text"), F.lit(0)).alias("text_crc32")
    return out.select("doc_id", resharding.row_size().alias("size"), crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields]
    leaf = merkle.leaf_of(*(F.col(c) for c in fields))
    claimed = F.when(remainder("doc_id", 2) == 0, merkle.leaf_of(*cut)).otherwise(leaf)
    return merkle.manifest(spark, table(spark, sf_dir, "documents"), leaf, claimed=claimed).select("doc_id", *merkle.ADDED)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM ranked WHERE r > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
left_over AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(cut.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM (SELECT doc_id, s, array_to_string(w[s:s + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS s FROM d))),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 3)) AS i FROM win WHERE c > 1) GROUP BY 1),
line AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(line.dup, 0) AS n_dup_lines, coalesce(line.n, 0) AS n_lines,
  coalesce(rep.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
  length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_alpha FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN line USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
  AND 10 * word_chars >= 25 * n_words AND word_chars <= 12 * n_words AND 2 * n_upper <= n_alpha AS kept FROM f
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

LEAKS = rf"""
WITH b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_FOLDED} AS w FROM benchmark) WHERE len(w) > 0),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
sizes AS (SELECT DISTINCT n FROM item),
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
win AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes)),
hit AS (SELECT doc_id, s, n, item_id FROM win JOIN item USING (n, k)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM k a, k b, k c, k d, k e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, k.bit AS own, (SELECT coalesce(sum(e.bit), 0) FROM k e WHERE strpos(filter_order, e.x) < step) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step), k WHERE substr(filter_order, step, 1) = k.x),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before::int) = 0), 0)::bigint AS kept,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before::int = 0), 0)::bigint AS removed, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before::int > 0), 0)::bigint AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::bigint AS unique_fails, coalesce(sum(good) FILTER (mask & own > 0 AND mask & before::int = 0), 0)::bigint AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before::int = 0), 0)::bigint AS toxic_lost FROM c, s GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::bigint AS shapley FROM r
"""


def _enc(column: str) -> str:
    return f"coalesce(strlen({column}::varchar) || ':' || {column}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST = rf"""
WITH RECURSIVE p(n) AS (SELECT unnest(range(0, 256))),
t AS (SELECT n, n AS c FROM p), t1 AS (SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t),
{", ".join(f"t{i} AS (SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM t{i - 1})" for i in range(2, 9))},
crc(doc_id, rest, c) AS (SELECT DISTINCT doc_id, doc_id::varchar, 4294967295::bigint FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, substr(rest, 2), xor(crc.c // 256, t8.c) FROM crc JOIN t8 ON t8.n = xor(crc.c % 256, ascii(rest)) WHERE rest <> ''),
d AS (SELECT doc_id, source, leaf, CASE WHEN xor(c, 4294967295) % 2 = 0 THEN cut ELSE leaf END AS claimed, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g
  FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("replace(text, chr(10), '')")} AS cut FROM documents) LEFT JOIN (SELECT doc_id, c FROM crc WHERE rest = '') USING (doc_id)),
row_ AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
node(g, lvl, i, w, x) AS (SELECT g, 0, pos, count(*) OVER (PARTITION BY g), leaf FROM row_
  UNION ALL SELECT g, lvl + 1, i // 3, (w + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM node WHERE w > 1 GROUP BY g, lvl, i // 3, w),
high(lvl, i, w, x) AS (SELECT 0, g, count(*) OVER (), x FROM node WHERE w = 1
  UNION ALL SELECT lvl + 1, i // 3, (w + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM high WHERE w > 1 GROUP BY lvl, i // 3, w),
root AS (SELECT x AS root FROM high WHERE w = 1),
side AS (SELECT a.g, a.lvl, a.i, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM node a JOIN node b ON a.g = b.g AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.w > 1 GROUP BY ALL),
wide AS (SELECT a.lvl, a.i, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.x, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM high a JOIN high b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.w > 1 GROUP BY ALL),
step AS (SELECT g, pos, lvl AS k, l, r FROM row_ JOIN side USING (g) WHERE side.i = pos // (3 ** lvl)::bigint
  UNION ALL SELECT g, pos, 1000 + lvl, l, r FROM row_ JOIN wide ON wide.i = g // (3 ** lvl)::bigint),
place AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY k) AS nth FROM step),
proof AS (SELECT g, pos, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256, count(*) AS steps FROM step GROUP BY ALL),
fold(g, pos, nth, x) AS (SELECT g, pos, 0::bigint, claimed FROM row_ UNION ALL SELECT g, pos, fold.nth + 1, sha256(l || x || r) FROM fold JOIN place p USING (g, pos) WHERE p.nth = fold.nth + 1)
SELECT doc_id, leaf, s.x AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.x AS folded_root, fold.x = root AS verified
FROM row_ CROSS JOIN root JOIN (SELECT g, x FROM node WHERE w = 1) s USING (g) LEFT JOIN proof USING (g, pos) JOIN fold USING (g, pos) WHERE fold.nth = coalesce(steps, 0)
"""


def mixing_sql(source: str = "documents") -> str:
    """The mix of op4 in SQL: three rounds of water-filling, then epochs and a running sum in hash order."""
    number = "try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS bigint) % 3"
    parts = [
        f"r AS (SELECT doc_id, CASE WHEN {number} = 1 THEN 'books' WHEN {number} = 2 THEN 'news' ELSE 'web' END AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, len({WORDS}) AS n_tokens FROM {source})",
        "leaf AS (SELECT domain, lang, source, sum(n_tokens)::bigint AS tokens, (4 * sum(n_tokens))::bigint AS cap FROM r GROUP BY ALL)",
        "g0 AS (SELECT cast(floor(coalesce(sum(tokens), 0) * 1 / 2) AS bigint) AS budget FROM leaf)",
    ]
    names = ["domain", "lang", "source"]
    for i in range(3):
        path, up = ", ".join(names[: i + 1]), ", ".join(names[:i])
        case = " ".join(f"WHEN concat_ws('/', {path}) = '{'/'.join(k)}' THEN {v}" for k, v in WEIGHTS.items() if len(k) == i + 1)
        weight = f"CASE {case} ELSE 1 END" if case else "1"
        over = f"PARTITION BY {up}" if up else ""
        before = f"({over} ORDER BY cap::double / w, {path} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        join = f"JOIN g{i} USING ({up})" if up else "CROSS JOIN g0"
        parts += [
            f"n{i} AS (SELECT {path}, cap, budget, {weight} AS w FROM (SELECT {path}, sum(cap)::bigint AS cap FROM leaf GROUP BY {path}) {join})",
            f"o{i} AS (SELECT *, coalesce(sum(cap) OVER {before}, 0)::bigint AS bc, coalesce(sum(w) OVER {before}, 0)::bigint AS bw, sum(w) OVER ({over})::bigint AS tw FROM n{i})",
            f"f{i} AS (SELECT *, cap::double <= w * ((budget - bc)::double / greatest(tw - bw, 1)) AS full_ FROM o{i})",
            f"h{i} AS (SELECT *, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({over})::bigint AS taken, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({over})::bigint AS heavy FROM f{i})",
            f"g{i + 1} AS (SELECT {path}, CASE WHEN full_ THEN cap ELSE greatest(cast(floor(w * ((budget - taken)::double / greatest(heavy, 1))) AS bigint), 0) END AS budget FROM h{i})",
        ]
    return (
        "WITH " + ",\n".join(parts) + """,
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS e, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM leaf JOIN g3 USING (domain, lang, source)),
k AS (SELECT r.*, e, rest, md5(concat_ws(':', '7', e::varchar, doc_id::varchar)) AS key FROM r JOIN p USING (domain, lang, source)),
t AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, n_tokens RANGE UNBOUNDED PRECEDING) <= rest AS take FROM k)
SELECT doc_id, domain, lang, source, n_tokens, (e + CASE WHEN take THEN 1 ELSE 0 END)::bigint AS copies FROM t WHERE e > 0 OR take
"""
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_substring_dedup, op3_quality_rules, op4_mixing, op5_language_id, op6_jaccard_join, op7_lm_score, op8_line_dedup, op9_decontaminate, op10_toxicity, op11_resharding, op12_merkle_manifest, op13_filter_audit)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": SUBSTRINGS, "op3_quality_rules": QUALITY, "op4_mixing": mixing_sql(), "op9_decontaminate": LEAKS, "op12_merkle_manifest": MANIFEST, "op13_filter_audit": AUDIT}
