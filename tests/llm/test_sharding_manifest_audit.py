"""Resharding, the Merkle manifest and the filter audit against brute force, on odd rows, ties, copies and empty tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def odd(spark):
    """Null and repeated ids, equal rows, null and empty texts, nulls in every column, copies, a very long text, clashing columns."""
    words = " ".join(f"word{i}" for i in range(120))
    rows = [(1, words, "en", "a", 5), (2, words, "en", "b", None), (2, words, "en", "b", None), (2, "Other TEXT\nof the id", "en", "b", 3), (4, None, None, None, 0), (5, "", "en", "", None)]
    rows += [(None, words, "en", "a", 1), (None, words, "de", None, 1), (None, None, None, None, None), (7, "x \n" * 40_000, None, "a", 9), (8, "é # ABC\t\nline", "", "c", 2), (9, words.upper(), "de", "a", 1)]
    rows += [(100 + i, f"text {i % 3} of a copy", "fr", "hot", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(7) for c in ("leaf", "root", "verified", "shard", "slot", "part", "n_words", "A", "good", "digest", "at", "grp", "kind")})


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, cut=False):
    out = ""
    for x in (r.doc_id, r.source, r.lang, r.n_chars, r.text.replace("\n", "") if cut and r.text is not None else r.text):
        out += "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(out)


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded, verified of every row, by whole trees."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            begin = i // 3 * 3
            run = level[begin : begin + 3]
            yield "".join(run[: i - begin]), "".join(run[i - begin + 1 :])
            i //= 3

    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for n in names:
        by[n].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = [levels([leaf(r) for r in by[n]]) for n in names]
    top = levels([t[-1][0] for t in trees])
    out = Counter()
    for g, n in enumerate(names):
        for i, r in enumerate(by[n]):
            steps = [*path(trees[g], i), *path(top, g)]
            folded = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0)
            for a, b in steps:
                folded = h(a + folded + b)
            root = top[-1][0]
            out[r.doc_id, leaf(r), trees[g][-1][0], root, h("".join(a + b for a, b in steps)), folded, folded == root] += 1
    return out


@pytest.mark.parametrize("fan, parts", [(2, 7), (64, 4), (64, 1)])
def test_manifest_against_whole_trees(spark, monkeypatch, fan, parts):
    from regloom.llm import merkle, queries

    monkeypatch.setattr(merkle, "FAN", fan)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d = odd(spark)
        monkeypatch.setattr(queries, "table", lambda *_: d)
        got = queries.op12_merkle_manifest(spark, "")
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert Counter(tuple(r) for r in got.collect()) == plain_manifest(d.collect())
        one = d.where("doc_id = 1")
        monkeypatch.setattr(queries, "table", lambda *_: one)
        assert Counter(tuple(r) for r in queries.op12_merkle_manifest(spark, "").collect()) == plain_manifest(one.collect())
        monkeypatch.setattr(queries, "table", lambda *_: d.limit(0))
        assert queries.op12_merkle_manifest(spark, "").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_manifest_keeps_columns_and_finds_any_change(spark):
    from regloom.llm import merkle

    d = odd(spark)
    fields = ["doc_id", "text"]
    of = merkle.leaf_of(*(F.col(c) for c in fields))
    changed = F.when(F.col("doc_id") == 105, merkle.leaf_of(F.col("doc_id"), F.concat("text", F.lit("!")))).otherwise(of)
    got = merkle.manifest(spark, d, of, claimed=changed, keep=d.columns)
    assert got.columns == [c for c in d.columns if c not in merkle.ADDED] + merkle.ADDED + ["up"]
    rows = got.collect()
    assert len(rows) == d.count() and {r.doc_id for r in rows if not r.verified} == {105}
    assert all(merkle.fold(r.leaf, r.up) == r.root for r in rows)


def test_forests_merge_in_any_order():
    from regloom.llm.merkle import TOP, Forest

    rng, sizes = np.random.default_rng(5), {TOP: 3, 0: 1, 1: 29, 2: 4}
    leaves = [((t, 0, i), h(f"{t} {i}")) for t in (0, 1, 2) for i in range(sizes[t])]

    def forest(some):
        out = Forest(sizes)
        out.nodes.update(some)
        return out.settled()

    whole = forest(leaves).nodes
    assert len(whole) == 1
    for _ in range(20):
        rng.shuffle(leaves)
        a, b, c = (forest([(tuple(map(int, k)), str(d)) for k, d in leaves[i::3]]) for i in range(3))
        left, right = a.merge(b).merge(c), a.merge(b.merge(c))
        assert left.nodes == right.nodes == c.merge(a).merge(b).nodes == whole
        assert a.merge(Forest(sizes)).nodes == a.nodes


def test_flow_against_all_flows():
    from regloom.llm.resharding import min_cost_flow

    def least(supply, room, cost):
        if not supply:
            return 0
        best = None
        for part in itertools.product(*(range(min(supply[0], r) + 1) for r in room)):
            if sum(part) == supply[0]:
                rest = least(supply[1:], [r - p for r, p in zip(room, part)], cost[1:])
                if rest is not None:
                    found = rest + sum(p * c for p, c in zip(part, cost[0]))
                    best = found if best is None else min(best, found)
        return best

    rng = np.random.default_rng(2)
    for _ in range(60):
        m, n = rng.integers(1, 4, 2)
        supply, cost = rng.integers(0, 5, m).tolist(), rng.integers(0, 4, (m, n))
        room = rng.integers(0, 4, n).tolist()
        room[0] += max(0, sum(supply) - sum(room))
        flow = min_cost_flow(supply, room, cost)
        assert (flow >= 0).all() and flow.sum(1).tolist() == supply and (flow.sum(0) <= room).all()
        assert (flow * cost).sum() == least(supply, room, cost.tolist())
    with pytest.raises(ValueError):
        min_cost_flow([3], [2])


def law(rows, n):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return [sizes[j] for j in range(n)]


def test_shards_of_documents(spark):
    from regloom.llm.queries import op11_resharding

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = op11_resharding(spark, SF).collect()
    want = Counter((d.doc_id, len(d.text.encode()) + 8, zlib.crc32(d.text.encode()), zlib.crc32(d.source.encode()) % 16) for d in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.old_shard) for r in got) == want
    sizes = law(got, 24)
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 24
    old = Counter()
    for r in got:
        old[r.old_shard] += r.size
    moved, least = sum(r.size for r in got if r.shard != r.old_shard), sum(max(0, x - sum(sizes) / 24) for x in old.values())
    assert moved <= 1.02 * least


def test_shards_of_odd_rows_and_rewriting(spark, tmp_path):
    from regloom.llm import resharding

    d, path = odd(spark).withColumn("old", F.when(F.col("doc_id") > 100, 2).when(F.col("doc_id") < 8, F.lit(None)).otherwise(1)), f"file://{tmp_path}/a"
    kept = [c for c in d.columns if c not in ("shard", "slot")]
    text_of = lambda df: Counter(tuple(r) for r in df.select(*kept).collect())
    resharding.reshard(spark, d, F.col("old"), [1, 1, 1, 0], path)
    first = resharding.read(spark, path, d.schema)
    assert text_of(first) == text_of(d)
    assert law(first.withColumn("size", resharding.row_size()).collect(), 4)[3] == 0
    # the same sizes again: nothing moves, nothing is written
    sizes = [r.n_bytes for r in resharding.manifest(spark, path).orderBy("shard").collect()]
    again = resharding.rewrite(spark, path, d.schema, sizes)
    assert not again.affected and again.bytes_moved == 0
    # two shards trade with each other and with none else: only they get new files
    moved = resharding.rewrite(spark, path, d.schema, [sizes[0], sizes[1] + sizes[2] - sizes[2] // 2, sizes[2] // 2, 0])
    assert moved.affected == {1, 2}
    now = resharding.read(spark, path, d.schema)
    assert text_of(now) == text_of(d)
    law(now.withColumn("size", resharding.row_size()).collect(), 4)
    kinds = {r.shard: r.generation for r in resharding.manifest(spark, path).collect()}
    assert kinds[1] == kinds[2] != kinds[0]
    assert resharding.vacuum(spark, path) and text_of(resharding.read(spark, path, d.schema)) == text_of(d)
    resharding.reshard(spark, d.limit(0), F.col("old"), [1, 2], f"file://{tmp_path}/b")
    assert resharding.read(spark, f"file://{tmp_path}/b", d.schema).count() == 0
    with pytest.raises(ValueError):
        resharding.targets(10, [0, 0])


def plain_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = {r.doc_id for r in labels if r.quality == 1}, {r.doc_id for r in labels if r.toxic == 1}
    first = {}
    for d in docs:
        if d.doc_id is not None:
            first[d.text or ""] = min(first.get(d.text or "", d.doc_id), d.doc_id)
    rows = defaultdict(list)
    for d in docs:
        t = d.text or ""
        w = word.findall(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d.doc_id is not None and d.doc_id > first[t]}
        rows[d.lang or ""].append((d.doc_id, {k for k, v in bad.items() if v}))
    out = set()
    for part, found in rows.items():
        shapley, each = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = found
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                every = [x for x in found if f in x[1]]
                each.append((part, "".join(order), step, len(left), len(gone), len(every) - len(gone), sum(x[1] == {f} for x in every), sum(x[0] in good and x[0] is not None for x in gone), sum(x[0] in toxic and x[0] is not None for x in gone), f))
        out |= {(*x[:-1], shapley[x[-1]]) for x in each}
    return out


def test_audit_against_all_orders(spark):
    from regloom.llm import filter_audit

    d = odd(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (7, None, 1), (105, 1, 0), (110, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(d, labels)
    assert {tuple(r) for r in got.collect()} == plain_audit(d.collect(), labels.collect()) and got.count() == 600 * 4
    assert filter_audit.audit(d.limit(0), labels).count() == 0 and filter_audit.audit(d, labels.limit(0)).count() == 600 * 4
    # one shuffle of texts, none of exploded words
    plan = filter_audit.word_totals(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")


@pytest.mark.parametrize("kind", ["decimal(20,0)", "date", "string", "int"])
def test_toxicity_takes_ids_of_any_ordered_type(spark, kind):
    from regloom.llm import toxicity

    rows = [(i, f"word{i % 7} word{i % 5} " + ("vile words here" if i % 3 == 0 else "plain words there"), int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, text string, toxic int")
    as_id = F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")) if kind == "date" else F.col("n").cast(kind)
    d = df.withColumn("doc_id", as_id)
    got = toxicity.assess(d.select("doc_id", "text"), toxicity.fit(d, d.where("n % 2 = 0")), ["doc_id"])
    assert dict(got.dtypes)["evidence"] == f"array<{kind}>"
    told = {r.doc_id: r for r in got.collect()}
    assert all((told[r.doc_id].predicted == 1) == (r.toxic == 1) and set(told[r.doc_id].evidence) <= set(told) for r in d.collect())
