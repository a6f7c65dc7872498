"""N-gram Jaccard join over prefix trees.

A document is the set of its hashed word n-grams, all sets ordered by the same (hash) order. Documents that link must
agree on all of at least one of H + 1 parts of the hash space, H being the largest symmetric difference that the
threshold allows at their sizes; the fuller parts are the keys that bring candidates together, so no link is lost. Each
candidate group stores its sets in a compressed trie. A set walks the trie with a running count of what either side
misses, shared by all sets below a node; a subtree is left as soon as misses plus the bound on remaining lengths
exceed what its sizes allow, and never entered if all of it is in the walker's group already or further from it than a
link allows by parities of elements in bins, which never differ in more bins than the sets do in elements.

Equal sets are one class (128-bit digest), represented by the least doc_id, so copies are never expanded into pairs.

Defined results: null texts and texts without words have an empty set, n_shingles 0 and their own doc_id as group;
with fewer than n words the whole sequence is the only n-gram. Repeated rows link as equal sets. Rows with a null
doc_id get a null group unless an equal text has an id. An empty table gives no rows; of the columns only the id and the
text are read; the least id names a group, so ties cannot be. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import candidates, linked
from .graph import stars
from .store import drop, save
from .text import LOWER, binaries, grams, groups, hashes, mapped, mix, slices, texts, words

#: Keys in a bucket, about.
BUCKET = 1 << 19


def sets(strings: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    flat, starts = words(mapped(strings, LOWER))
    h = hashes(flat)
    g = grams(h, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(g[a : b - n + 1]))
        else:
            out.append(grams(h[a:b], b - a) if b > a else g[:0])
    return out


def intervals(most: int, threshold: float) -> np.ndarray:
    """Least sizes of intervals such that linked sets lie in the same or in neighbouring ones."""
    low = [1]
    while low[-1] <= most:
        low.append(int(low[-1] / threshold + 1e-9) + 1)
    return np.array(low)


def signatures(s: np.ndarray, low: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of a set: for its size interval and the one below, the sum of each of its fuller parts of the hash space.

    There are a quarter more parts than ``most`` + 1. A set that can differ in d places keeps the parts of at least m
    n-grams, m being the largest with over d such parts. Of two sets that link, the one with the larger m keeps a part
    in which they agree; the other's m is no larger, so it keeps that part as well.
    """
    at = int(np.searchsorted(low, len(s), "right")) - 1
    m, keys = mix(s + np.uint64(0x51ED27)), []
    for i in (at, at - 1):
        if i < 0:
            continue
        # sizes a <= b of the pair, a in interval i: the difference is at most (a + b)(1 - t)/(1 + t) <= a (1 - t)/t
        most = int((low[i + 1] - 1) * (1 - threshold) / threshold + 1e-9)
        parts = most + 1 + most // 4
        place = (s % np.uint64(parts)).astype(np.int64)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, place, m)
        held = np.bincount(place, minlength=parts)
        differ = min(most, int(len(s) * (1 - threshold) / threshold + 1e-9))
        full = np.flatnonzero(held >= np.sort(held)[parts - 1 - differ])
        keys.append(mix(total[full] + mix(full.astype(np.uint64) + np.uint64(i << 32))))
    return np.concatenate(keys)


class Trie:
    """Compressed trie of the ordered sets of a group: a node is a run of sets, in the order of their elements, with a common start.

    A set walks it only where sets lie that could still link to it; ``Sketches`` name them.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        strings = [s.astype(">u8").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=strings.__getitem__), np.int64)
        self.sets = [sets[i] for i in self.order.tolist()]
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(sets))
        self.sizes = np.array([len(s) for s in self.sets])
        self.common = np.array([0, *(shared(a, b) for a, b in zip(self.sets[:-1], self.sets[1:]))])
        self.num, self.den, self.share = num, den, (den - num) / (den + num)
        self.nodes: dict[tuple[int, int], tuple[int, np.ndarray, int, int]] = {}

    def node(self, a: int, b: int) -> tuple[int, np.ndarray, int, int]:
        """Of the sets a to b: how many elements all begin with, where each branch starts and the last ends, least and largest size."""
        if (a, b) not in self.nodes:
            inner = self.common[a + 1 : b]
            depth, sizes = int(inner.min()), self.sizes[a:b]
            self.nodes[a, b] = depth, np.concatenate(([a], a + 1 + np.flatnonzero(inner == depth), [b])), int(sizes.min()), int(sizes.max())
        return self.nodes[a, b]

    def search(self, me: int, others: np.ndarray, label: np.ndarray) -> Iterator[int]:
        """Those of ``others`` that link to ``me`` and have another label by then. The caller changes labels at each."""
        x = self.sets[self.place[me]]
        a = len(x)
        todo = [(0, len(self.sets), np.sort(self.place[others]), 0, 0, 0)]
        while todo:
            low, high, some, at, missed, depth = todo.pop()
            some = some[label[self.order[some]] != label[me]]
            if not len(some):
                continue
            if len(some) == 1:  # what is left is one path
                low, high = int(some[0]), int(some[0]) + 1
            if high - low == 1:
                path, least, most = self.sets[low][depth:], int(self.sizes[low]), int(self.sizes[low])
            else:
                upto, branches, least, most = self.node(low, high)
                path = self.sets[low][depth:upto]
            allowed = self.share * (a + most) + 1e-9
            to = at
            if len(path):
                place = np.searchsorted(x, path)
                same = int((x[np.minimum(place, a - 1)] == path).sum())
                to = int(np.searchsorted(x, path[-1], "right"))
                missed += (to - at - same) + (len(path) - same)
                depth += len(path)
            rest = a - to
            if missed + max(0, rest - (most - depth), (least - depth) - rest) > allowed:
                continue
            if high - low == 1:
                both = (a + least - missed - rest) // 2
                if self.den * both >= self.num * (a + least - both):
                    yield int(self.order[low])
                continue
            branch = np.searchsorted(branches, some, "right") - 1
            cuts = np.flatnonzero(np.diff(branch, prepend=-1, append=-1))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                k = branch[i]
                todo.append((int(branches[k]), int(branches[k + 1]), some[i:j], to, missed, depth))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements both begin with."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    return int(differ.argmax()) if differ.any() else n


class Sketches:
    """Parities of each set's numbers of elements in bins; as many bins differ for two sets as they have different elements, or fewer.

    There are some 16 bins for each element in which two sets of middle size may differ.
    """

    def __init__(self, sets: list[np.ndarray], share: float):
        sizes = np.array([len(s) for s in sets])
        self.sizes, self.share, self.wide = sizes, share, max(4, int(sizes.mean() * 2 * share / 4) + 1)
        bins = np.uint64(64 * self.wide)
        self.held = np.zeros((self.wide, len(sets)), np.uint64)
        for i, s in enumerate(sets):
            odd = np.bincount((mix(s + np.uint64(0x0DD)) % bins).astype(np.int64), minlength=64 * self.wide) & 1
            self.held[:, i] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)

    def near(self, me: int, first: int) -> np.ndarray:
        """The sets from ``first`` up to ``me`` that may link to it: all that do, and few others."""
        differ = np.zeros(me - first, np.int32)
        for part in self.held:
            differ += np.bitwise_count(part[first:me] ^ part[me])
        return first + np.flatnonzero(differ <= self.share * (self.sizes[first:me] + self.sizes[me]) + 1e-9)


def matcher(num: int, den: int):
    """Links of sets given as bytes, enough to connect all of Jaccard similarity num / den and more."""

    def match(payloads: list[bytes]) -> Iterator[tuple[int, int]]:
        ranked = sorted(range(len(payloads)), key=lambda i: len(payloads[i]))
        sets = [np.frombuffer(payloads[i], np.uint64) for i in ranked]
        trie = Trie(sets, num, den)
        sketches, label = Sketches(sets, trie.share), np.arange(len(sets))
        for me in range(1, len(sets)):
            first = int(np.searchsorted(sketches.sizes, -(-num * len(sets[me]) // den)))  # smaller sets can't link
            if first < me and len(others := sketches.near(me, first)):
                for other in trie.search(me, others, label):
                    yield ranked[other], ranked[me]
                    label[label == label[other]] = label[me]

    return match


def features(docs: DataFrame, doc_id: str, n: int) -> DataFrame:
    """(doc, n, digest) of every row; the digest is null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            size, digest = [], []
            for s in sets(texts(piece), n):
                size.append(len(s))
                total = [int(mix(s + np.uint64(c)).sum()) for c in (1, 2)]
                digest.append(b"".join(int(v).to_bytes(8, "big") for v in total) if len(s) else None)
            yield pa.RecordBatch.from_arrays([piece.column("doc"), pa.array(size, pa.int64()), pa.array(digest, pa.binary())], names=["doc", "n", "digest"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc"), "text").mapInArrow(run, f"doc {kind}, n long, digest binary")


def meetings(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order with an owner each, and links (a, b) of the other owners of a key to that one."""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    first = np.diff(key, prepend=~key[:1]) != 0
    head = owner[first]
    leader = head[np.cumsum(first) - 1]
    apart = owner != leader
    return key[first], head, owner[apart], leader[apart]


def sharing(docs: DataFrame, doc_id: str, n: int, threshold: float, buckets: int) -> DataFrame:
    """Links (a, b) that connect all rows that share a key.

    Keys travel packed by bucket, each once for a piece of text: rows of a piece that share one are linked there.
    """
    low = intervals(1 << 34, threshold)
    kind = docs.schema[doc_id].dataType.simpleString()

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            keys = [signatures(s, low, threshold) if len(s) else s for s in sets(texts(piece), n)]
            key, owner, x, y = meetings(np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            if not len(key):
                continue
            bucket = ((key >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((owner, bucket))
            key, owner, bucket = key[order], owner[order], bucket[order]
            at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            ids = piece.column("doc")
            rows = len(at) - 1
            held = pa.ListArray.from_arrays(pa.array(at, pa.int32()), ids.take(pa.array(owner)))
            a, b = stars(ids.take(pa.array(x)), ids.take(pa.array(y)))
            cuts = pa.array(len(a) * np.arange(rows + 1) // rows, pa.int32())  # links lie in any row
            some = [pa.ListArray.from_arrays(cuts, v) for v in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), binaries(at, key), held, *some], names=["bucket", "key", "id", "a", "b"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, ["bucket"]):
            flat = {c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks]) for c in ("id", "a", "b")}
            key = np.concatenate([np.frombuffer(k.as_buffer(), np.uint64) for k in table.column("key")])
            ids = flat["id"].dictionary_encode()
            _, _, x, y = meetings(key, ids.indices.to_numpy())
            left, right = (pa.concat_arrays([flat[c], ids.dictionary.take(pa.array(v))]) for c, v in (("a", x), ("b", y)))
            yield pa.RecordBatch.from_arrays(list(stars(left, right)), names=["a", "b"])

    some = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), "text")
    dealt = some.mapInArrow(deal, f"bucket int, key binary, id array<{kind}>, a array<{kind}>, b array<{kind}>")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, f"a {kind}, b {kind}")


def payloads(docs: DataFrame, n: int) -> DataFrame:
    """(id, payload) of rows (id, text): the set as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array([s.tobytes() for s in sets(texts(piece), n)], pa.binary())], names=["id", "payload"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, payload binary")


def join(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id of its linked group) of every row.

    Two rows link if their sets have an intersection of at least num / den of the union.
    """
    made = save(spark, features(docs, doc_id, n), "shingles")
    classes = save(spark, made.where("n > 0").groupBy("digest").agg(F.min("doc").alias("rep")), "classes")
    size = made.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = max(64, int(2 * size * (den - num) / num) // BUCKET + 1)
    members = candidates(spark, sharing(docs, doc_id, n, num / den, buckets), "near").join(classes.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    members = save(spark, members, "members")
    chosen = docs.select(F.col(doc_id).alias("id"), "text").join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    found = linked(spark, members, payloads(chosen, n), matcher(num, den), "near")
    drop(spark, members)
    out = made.select("doc", "n", "digest").join(classes, "digest", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "doc").alias("component_id"))
