"""The ten operators and the pipeline on small tables with nulls, empty texts, copies and clashing columns."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = ["op2_substring_dedup", "op3_quality_rules", "op4_mixing", "op9_decontaminate", "op12_merkle_manifest", "op13_filter_audit"]


@pytest.mark.parametrize("name", SQL)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    sql, df = entry.oracle_sql()[name], entry.queries()[name](spark, SF)
    told = con.execute(sql)
    columns = sorted(d[0] for d in told.description)
    place = [[d[0] for d in told.description].index(c) for c in columns]
    want = sorted((tuple(r[i] for i in place) for r in told.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want


def odd(spark):
    """Nulls, empty texts, exact and near copies, a long text, and columns with names that operators add."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en"), (2, words, "en"), (3, words + " tail", "en"), (4, None, None), (5, "", "en"), (6, "one two", "en"), (7, "x " * 3000, "en"), (None, words, "en"), (8, "a b c\n" * 4 + words, "en")]
    return spark.createDataFrame([(*r, "s", 0, True, 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_words bigint, kept boolean, score int")


def shingles(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, n, num):
    from regloom.llm import jaccard_join

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(spark, docs, n=n, num=num).collect()}
    sets = {r.doc_id: shingles(r.text or "", n) for r in docs.collect()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert got == {d: (len(sets[d]), find(d)) for d in ids}


def test_many_like_sets_that_do_not_link():
    """2,000 variants of one text, most of them about as unlike as pairs of candidates are: all links, in a few seconds of CPU."""
    import random
    import time

    import numpy as np

    from regloom.llm.cluster import Union
    from regloom.llm.jaccard_join import matcher

    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(148)]
    sets = [sorted({x if r.random() > share else r.getrandbits(64) for x in base}) for share in (r.choice((0.02, 0.15, 0.2, 0.25)) for _ in range(2000))]
    began = time.process_time()
    links = list(matcher(90, 100)([np.array(s, np.uint64).tobytes() for s in sets]))
    took = time.process_time() - began
    values, code = np.unique(np.concatenate([np.array(s, np.uint64) for s in sets]), return_inverse=True)
    size = np.array([len(s) for s in sets])
    held = np.zeros((len(sets), len(base) + 1), np.float32)  # other elements occur once
    at = np.searchsorted(values, np.array(sorted(base), np.uint64))
    rank = np.full(len(values), -1)
    rank[at] = np.arange(len(at))
    owner = np.repeat(np.arange(len(sets)), size)
    common = rank[code] >= 0
    held[owner[common], rank[code][common]] = 1
    both = held @ held.T
    want = 100 * both >= 90 * (size[:, None] + size - both)
    assert all(want[i, j] for i, j in links)
    found, all_ = Union(len(sets)), Union(len(sets))
    for i, j in links:
        found.join(i, j)
    for i, j in np.argwhere(want).tolist():
        all_.join(i, j)
    assert [found.find(i) for i in range(len(sets))] == [all_.find(i) for i in range(len(sets))]
    assert len(links) > 100 and took < 12, took


def test_linked_sets_share_a_key():
    import random

    import numpy as np

    from regloom.llm.jaccard_join import intervals, signatures
    from regloom.llm.text import mix

    r, tried = random.Random(5), 0
    for _ in range(4000):
        t = r.choice((0.8, 0.9, 0.5))
        size = r.randint(1, 12) if r.random() < 0.5 else r.randint(12, 150)
        pool = mix(np.array([r.getrandbits(60) for _ in range(2 * size)], np.uint64))
        x = set(pool[:size].tolist())
        y = set(r.sample(sorted(x), max(1, size - r.randint(0, int(size * (1 - t)) + 1)))) | set(pool[size : size + r.randint(0, int(size * (1 - t)) + 1)].tolist())
        if len(x & y) >= t * len(x | y) - 1e-12:
            tried += 1
            a, b = (signatures(np.array(sorted(v), np.uint64), intervals(1 << 20, t), t) for v in (x, y))
            assert set(a.tolist()) & set(b.tolist())
    assert tried > 500


def test_substrings_of_odd_rows(spark):
    from regloom.llm import substring_dedup

    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.dedup(spark, odd(spark), ["doc_id"]).where("doc_id is not null").collect()}
    assert got[1] == (60, 60)  # the row without an id comes first
    assert got[2] == (60, 60) and got[3] == (61, 60) and got[4] == (0, 0) and got[5] == (0, 0) and got[6] == (2, 0) and got[7] == (3000, 2980 + 19)


def test_lines_of_odd_rows(spark):
    from regloom.llm import line_dedup

    out = {r.doc_id: r for r in line_dedup.dedup(spark, odd(spark)).where("doc_id is not null").collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == 1 and out[3].n_removed == 1 and out[4].text is None and out[5].text == ""


def test_token_files_by_ranges(spark, tmp_path):
    """Documents cut over several blocks and files, one that is not terminated, and a file without tokens."""
    import random

    import numpy as np

    from regloom.llm import token_counts

    r, want = random.Random(2), set()
    for name in ("a.bin", "b c.bin"):
        lengths = [r.choice((0, 1, 3, 6, 7, 40)) for _ in range(50)]
        flat = [x for n in lengths for x in [5] * n + [9]] + [5] * 17
        np.array(flat, "<u2").tofile(tmp_path / name)
        want |= {(name, i, n, True) for i, n in enumerate(lengths)} | {(name, 50, 17, False)}
    (tmp_path / "empty.bin").write_bytes(b"")
    blocks = token_counts.read_files(spark, str(tmp_path), block=7)
    assert blocks.rdd.getNumPartitions() > 2  # a file is not one task
    found = token_counts.stitch(token_counts.scan(blocks, separator=9)).collect()
    assert len(found) == len(want) and {(x.file.rpartition("/")[2].replace("%20", " "), x.ordinal, x.n_tokens, x.terminated) for x in found} == want


def test_token_counts_through_files(spark):
    from regloom.llm import token_counts

    vocabulary = f"{token_counts.default_tokenizers()}/byte_bpe_50k.tiktoken"
    encode = token_counts.encoding(vocabulary).encode_ordinary
    got = [(r.doc_id, r.n_tokens) for r in token_counts.count(spark, odd(spark).repartition(3), vocabulary, block=50).collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, len(encode(r.text or ""))) for r in odd(spark).collect()), key=str)


def test_distances_found_together():
    import random

    from regloom.llm.line_dedup import distances, edit_distance

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    r = random.Random(7)
    line = lambda: "".join(r.choice("ab \u00e9\U0001f600") for _ in range(r.choice((0, 1, 7, 8, 31, 70))))
    for _ in range(40):
        text, others = line(), [line() for _ in range(r.randint(1, 9))]
        want = [plain(text, o) for o in others]
        assert distances(text, others).tolist() == want == [edit_distance(text, o, 1000) for o in others]


def test_near_lines_against_brute_force(spark):
    """Recall of links of edit similarity 0.8 and more: a word replaced, signs changed, words put in or taken away."""
    import random

    from regloom.llm import line_dedup

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    pairs = []
    while len(pairs) < 300:
        first = [word() for _ in range(r.choice((8, 10, 15, 20, 40, 60)))]
        second = list(first)
        at = r.randrange(len(second))
        kind = len(pairs) % 4
        if kind == 0:
            second[at] = word()
        elif kind == 1:
            second.insert(at, word())
        elif kind == 2:
            del second[at]
        else:
            second[at] = "q" + second[at][1:] + "z"
        a, b = " ".join(first), " ".join(second)
        if a != b and line_dedup.edit_distance(a, b, len(a)) <= int(0.2 * max(len(a), len(b)) + 1e-9):
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id bigint, text string").repartition(5)
    gone = {x.doc for x in line_dedup.removals(spark, docs).collect()}
    assert gone <= {2 * i + 1 for i in range(len(pairs))}  # no unlike lines
    assert len(gone) >= 0.95 * len(pairs)


def test_short_lines_meet_if_one_word_differs(spark):
    """Lines of 5 to 10 words with one word replaced, put in or taken away: every link of similarity 0.8 and more is found."""
    import random

    from regloom.llm import line_dedup

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    pairs = []
    while len(pairs) < 200:
        first = [word() for _ in range(r.randint(5, 10))]
        second, at = list(first), r.randrange(len(first))
        if len(pairs) % 3 == 0:
            second[at] = word()
        elif len(pairs) % 3 == 1 and len(first) < 10:
            second.insert(at, word())
        elif len(first) > 5:
            del second[at]
        a, b = " ".join(first), " ".join(second)
        if a != b and line_dedup.edit_distance(a, b, len(a)) <= int(0.2 * max(len(a), len(b)) + 1e-9):
            pairs.append((a, b))
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id bigint, text string").repartition(5)
    assert {x.doc for x in line_dedup.removals(spark, docs).collect()} == {2 * i + 1 for i in range(len(pairs))}


def test_many_variants_of_one_line(spark):
    """Variants that share keys, over several batches of a task: one group, and far fewer links than pairs."""
    from regloom.llm import line_dedup
    from regloom.llm.graph import components

    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    same, n = "home news sport weather travel business culture radio music food help", 3000
    docs = spark.createDataFrame([(i, f"{same} page {letters(i)} of {letters(i // 7)}") for i in range(n)], "doc_id bigint, text string")
    table = line_dedup.line_table(docs, "doc_id", 5).persist()
    links = line_dedup.near_sketches(table, 0.8).persist()
    found = components(spark, links)
    assert links.count() <= 10 * n
    assert found.select("root").distinct().count() == 1 and found.count() == table.select("sim").distinct().count() - 1
    table.unpersist(), links.unpersist()


def test_short_lines_are_cut_if_equal(spark):
    from regloom.llm import line_dedup

    docs = spark.createDataFrame([(1, "Home\nread more\n\n--\none of a kind"), (2, "HOME\nread mode\n\n--\nOne of a kind!")], "doc_id bigint, text string")
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup(spark, docs).collect()}
    assert out == {1: ("Home\nread more\n\n--\none of a kind", 5, 0), 2: ("read mode\n\n--", 5, 2)}


def test_edit_distance_against_brute_force():
    import random

    from regloom.llm.line_dedup import edit_distance, script_cost, within

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in "ab")
        most = r.randint(0, 14)
        assert min(edit_distance(a, b, most), most + 1) == min(plain(a, b), most + 1)
    for _ in range(300):  # long enough for looks at whole columns and for scripts
        a = "".join(r.choice("abcd ") for _ in range(r.randint(0, 150)))
        b = "".join(r.choice(("", c + "x", "y")) if r.random() < 0.1 else c for c in a) if r.random() < 0.7 else a[::-1]
        most, true = r.randint(0, 60), plain(a, b)
        assert edit_distance(a, b, most) == min(true, most + 1)
        assert within(a, b, most) == (true <= most) and script_cost(a, b, 999) >= true


def test_language_held_out(spark):
    rows = entry.queries()["op5_language_id"](spark, SF).where("held_out").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    known = [r for r in rows if truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in known) >= 0.9 * len(known) and all(0 <= r.score <= 1 for r in rows)


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "domain", "copies"} <= set(out.columns) and 0 < out.count() <= 200


def test_components(spark):
    """A chain, a hub, a loop and nulls, over several partitions: every node but the roots once, with the least of its group."""
    from regloom.llm.graph import components, thinned

    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 300)] + [(500, 500), (None, 1), (600, None)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(7)
    want = {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 300)}
    got = [tuple(r) for r in components(spark, df).collect()]
    assert len(got) == len(want) and dict(got) == want
    binary = components(spark, df.select(*(F.encode(F.lpad(F.col(c).cast("string"), 4, "0"), "utf-8").alias(c) for c in "ab")))
    assert {int(bytes(a)): int(bytes(b)) for a, b in binary.collect()} == want
    short = {tuple(r) for r in components(spark, thinned(df.where("a <> b"), most=3)).collect()}
    assert short == set(want.items())
    assert components(spark, df.where("a < 0")).count() == 0
