"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants: one for each previous token (or the start of a text) that training holds, whatever their number; all share
a parent for single tokens, whose base is uniform over the training vocabulary and one unknown token. A context that
training doesn't hold is an empty restaurant, so its tokens are told by the parent alone.

The seating has for each (context, token) its customers ``c`` and tables ``t``. A round of block Gibbs sampling sums
customers and tables by context, tables by token (the customers of the parent) and draws the tables of each pair by the
Chinese-restaurant conditional: the generalised Stirling numbers times the rising weights of further tables in the
context and in the parent, the pair's own tables taken out. All pairs are drawn at once from the sums of the round
before, as parallel samplers do; that, groups of a tenth beyond 64 customers, and parent tables that open only where a
dish has none, are the approximations. Strengths follow the auxiliary variables of the Pitman-Yor process at their
expected values, each round; discounts come from how many counts are 1 and 2. The predictive probability of every pair
is averaged over the last rounds.

Texts are dealt to pieces by a hash of the row. A piece sends its different pairs, packed, to buckets by context, so
that sums by context need no join. A context with 1 / 16384 of all tokens and more (or half of it) is dealt in shards of at most that
share by the hash of the token; the sums of these (at most 3 * 16384 shards) are told to all. Tokens have buckets of
their own: a bucket of contexts sends the tables of its tokens there, in the order it named the tokens at first, and is
answered in the same order. In the end a bucket answers each piece with the values of the piece's pairs, in the order
they came, and the piece looks its tokens up. Tokens with 1 / 131072 of all and more travel as numbers.
Pairs of one customer have one table whatever is drawn, so rounds work on the others alone. Draws follow from the hash
of the pair and the round alone, so a lost task repeats them.

Tokens are told apart by 64-bit hashes. Defined results: null and empty texts are a single end token; every
row is scored by itself, with repeated or null ids as well; rows with a null id are never trained on. Without
training rows every probability is that of the unknown token, 1. An empty table gives no rows; of the columns only the
id and the text are read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, save
from .text import LOWER, groups, hashes, mapped, mix, slices, texts, words

END = mix(np.array([0xE0D], np.uint64))[0]
START = mix(np.array([0x57A], np.uint64))[0]
GOLD = np.uint64(0x9E3779B97F4A7C15)
HOT_SHARE = 1 << 14
FREQUENT = 1 << 17
PAIRS, STATE, SAMPLE, COUNTS, PLACES = 0, 1, 2, 1000, 1001  # kinds of packed rows; SAMPLE + i is the i-th sample
PACKED = "bucket int, kind int, sub int, payload binary"


def coded(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the different tokens and of START, all tokens by their place there (an end after each text), and where each text's tokens start."""
    flat, starts = words(mapped(texts(piece), LOWER))
    found = flat.dictionary_encode()
    h = hashes(found.dictionary)
    vocabulary = np.unique(np.concatenate((h, np.array([START, END], np.uint64))))
    code = np.searchsorted(vocabulary, h)[found.indices.to_numpy(zero_copy_only=False)]
    n = len(starts) - 1
    code = np.insert(code, starts[1:], np.full(n, np.searchsorted(vocabulary, END)))
    return vocabulary, code, starts + np.arange(n + 1)


def previous(vocabulary: np.ndarray, code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code of the token before each, START at the start of a text."""
    before = np.empty_like(code)
    before[1:] = code[:-1]
    before[starts[:-1]] = np.searchsorted(vocabulary, START)
    return before


def tokens(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (an end after each text), the token before each, and where each text's tokens start."""
    vocabulary, code, starts = coded(piece)
    return vocabulary[code], vocabulary[previous(vocabulary, code, starts)], starts


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * GOLD + h)


def is_in(h: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in ``ordered`` and whether it is there."""
    if not len(ordered):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
    return at, ordered[at] == h


def small(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as they need."""
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64).tobytes()
    body = head + b"".join(a.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(payload: pa.Scalar) -> list[np.ndarray]:
    held = payload.as_buffer()
    body = pa.decompress(held.slice(8), int.from_bytes(held.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    n = int(np.frombuffer(body, np.int64, 1)[0])
    head, at, out = np.frombuffer(body, np.int64, 2 * n, 8), 8 + 16 * n, []
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist()):
        out.append(np.frombuffer(body, np.dtype(chr(kind)), size, at))
        at += out[-1].nbytes
    return out


def long(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64)


def summed(place: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole sums of the values of each place."""
    return np.bincount(place, values, size).astype(np.int64)


def rows(held: list[tuple], names: str = PACKED) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(list(v), kinds[kind]) for v, (_, kind) in zip(zip(*held), fields)], names=[name for name, _ in fields])


def by_key(table: DataFrame, key: str, *then: str) -> DataFrame:
    return table.repartition(key).sortWithinPartitions(key, *then)


@dataclass(frozen=True)
class Common:
    """Sorted frequent tokens; hot contexts with their shards; the shards' ids, sorted, with the place of their context."""

    top: np.ndarray
    hot: np.ndarray
    shards: np.ndarray
    ids: np.ndarray
    owner: np.ndarray

    def named(self, u: np.ndarray) -> np.ndarray:
        """The contexts of shards and of others."""
        at, is_shard = is_in(u, self.ids)
        return np.where(is_shard, self.hot[self.owner[at]], u) if len(self.ids) else u

    def split(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Contexts as they are dealt: hot ones by shard."""
        at, is_hot = is_in(u, self.hot)
        if not is_hot.any():
            return u
        shard = (w[is_hot] >> np.uint64(32)) % self.shards[at[is_hot]]
        out = u.copy()
        out[is_hot] = mix(u[is_hot] + GOLD * (shard + np.uint64(1)))
        return out


def common(spark: SparkSession, docs: DataFrame) -> Common:
    """A piece of text leaves out tokens of less than half the least share; who has half of it in what is counted is taken, so none of the share is missed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, most=8 << 20):
            vocabulary, code, _ = coded(piece)
            n = np.bincount(code, minlength=len(vocabulary))
            many = np.flatnonzero(2 * n * max(FREQUENT, HOT_SHARE) >= len(code))
            w = pa.array(np.append(vocabulary[many].view(np.int64), 0), mask=np.append(np.zeros(len(many), bool), True))
            yield pa.RecordBatch.from_arrays([w, pa.array(np.append(n[many], len(code)))], names=["w", "n"])

    found = save(spark, docs.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "frequent")
    total = found.where("w is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = found.where("w is not null").where(F.col("n") * 2 * max(FREQUENT, HOT_SHARE) >= total).toArrow()  # twice that many at most
    drop(spark, found)
    w, n = most.column("w").to_numpy().view(np.uint64), most.column("n").to_numpy()
    top = np.sort(w[2 * n * FREQUENT >= total])
    hot = np.flatnonzero(2 * n * HOT_SHARE >= total)
    u, shards = np.where(w[hot] == END, START, w[hot]), -(-n[hot] * HOT_SHARE // max(total, 1))
    order = np.argsort(u)
    u, shards = u[order], shards[order].astype(np.uint64)
    owner = np.repeat(np.arange(len(u)), long(shards))
    shard = np.arange(len(owner)) - np.repeat(np.cumsum(long(shards)) - long(shards), long(shards))
    ids = mix(u[owner] + GOLD * (shard.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(ids)
    return Common(top, u, shards, ids[order], owner[order])


def dealt(docs: DataFrame, pieces: int) -> DataFrame:
    return docs.withColumn("piece", F.pmod(F.xxhash64("doc", "text"), F.lit(pieces)).cast("int"))


def order_of(vocabulary: np.ndarray, key: np.ndarray, c: Common) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as dealt and tokens of sorted different pairs, and the order in which buckets hold them."""
    u, w = vocabulary[key // len(vocabulary)], vocabulary[key % len(vocabulary)]
    u = c.split(u, w)
    order = np.argsort(u, kind="stable")
    return u[order], w[order], order


def one(table: pa.Table) -> pa.RecordBatch:
    return table.combine_chunks().to_batches()[0]


def count_pairs(docs: DataFrame, c: Common, pieces: int, bits: int) -> DataFrame:
    """Packed rows of the different pairs of each bucket, and of the places there of each piece's pairs, in order.

    PAIRS: contexts, pairs of each, tokens of the bucket, token of each pair, customers in training, occurrences.
    """
    low = np.uint64(64 - bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (piece,), table in groups(batches, ["piece"]):
            batch = one(table)
            vocabulary, code, starts = coded(batch)
            train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(starts))
            both, n = np.unique((previous(vocabulary, code, starts) * len(vocabulary) + code) * 2 + train, return_counts=True)
            key = both >> 1
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            u, w, order = order_of(vocabulary, key[begin], c)
            customers, n = np.add.reduceat(n * (both & 1), begin)[order], np.add.reduceat(n, begin)[order]
            at, is_top = is_in(w, c.top)
            number = np.where(is_top, at + 1, 0)
            cuts = np.searchsorted(u >> low, np.arange((1 << bits) + 1, dtype=np.uint64))
            held = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[b], cuts[b + 1])
                mine = u[part]
                first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
                size = np.diff(np.append(first, len(mine)))
                held.append((b, 0, piece, pack(mine[first], small(size), small(number[part]), w[part][~is_top[part]], small(customers[part]), small(n[part]))))
            yield rows(held)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), table in groups(batches, ["bucket"]):
            parts: list[tuple] = []
            for payload in table.column("payload"):
                contexts, size, number, rest, customers, n = unpack(payload)
                w = np.zeros(len(number), np.uint64)
                w[number == 0] = rest
                w[number > 0] = c.top[long(number[number > 0]) - 1]
                parts.append((contexts, size, w, customers, n))
            contexts, tokens_ = np.unique(np.concatenate([p[0] for p in parts])), np.unique(np.concatenate([p[2] for p in parts]))
            owner = np.concatenate([np.repeat(np.searchsorted(contexts, p[0]), p[1]) for p in parts])
            key, at = np.unique(owner * len(tokens_) + np.searchsorted(tokens_, np.concatenate([p[2] for p in parts])), return_inverse=True)
            customers, n = (summed(at, np.concatenate([p[i] for p in parts]), len(key)) for i in (3, 4))
            each = np.bincount(key // len(tokens_), minlength=len(contexts))
            held = [(bucket, PAIRS, 0, pack(contexts, small(each), tokens_, small(key % len(tokens_)), small(customers), small(n)))]
            cuts = np.cumsum([0, *(len(p[2]) for p in parts)])
            for piece, i, j in zip(table.column("sub").to_pylist(), cuts[:-1], cuts[1:]):
                held.append((bucket, PLACES, piece, pack(small(np.diff(at[i:j], prepend=0)))))
            yield rows(held)

    found = by_key(dealt(docs, pieces).select("piece", "train", "text"), "piece").mapInArrow(run, PACKED)
    return by_key(found, "bucket", "sub").mapInArrow(merged, PACKED)


def stirling(discount: float, most: int = 64) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(most + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
        stay[np.isnan(stay)] = -np.inf
        out[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], out[c][:-1])))
    return out


def uniform(bits: np.ndarray) -> np.ndarray:
    return ((mix(bits) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def binomial(n: np.ndarray, p: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Successes of n trials: by the distribution function for means up to 10, beyond by the normal curve."""
    p = np.minimum(p, 1 - 1e-12)
    u, few = uniform(bits), n * p <= 10
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(bits + GOLD))
    out = np.clip(np.round(n * p + z * np.sqrt(n * p * (1 - p))), 0, n)
    mass = np.exp(n * np.log1p(-p))
    total, k = mass.copy(), np.zeros(len(n))
    for step in range(64):
        over = (u > total) & (k == step)
        k = k + over
        mass = mass * np.maximum(n - step, 0) / (step + 1) * p / (1 - p)
        total = total + mass
    return np.where(few, np.minimum(k, n), out).astype(np.int64)


def seat(c: np.ndarray, weight: Callable, discount: float, bits: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Tables drawn for c customers; ``weight(rows, t)`` is that of a further table for rows that have t.

    Up to 64 customers from the exact conditional; further ones enter in groups of a tenth, at new tables with the
    probability that holds when the group enters. ``bits`` decide the draw of each row.
    """
    out = np.minimum(c, 1).astype(np.int64)
    exact = len(table) - 1
    first, u = np.minimum(c, exact), uniform(bits)
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(2, exact + 2))
    for n in range(2, exact + 1):
        at = order[cuts[n - 2] : cuts[n - 1]]
        for part in np.array_split(at, max(1, len(at) * n >> 20)):
            if len(part):
                scores = table[n, 1 : n + 1] + np.cumsum(np.log(weight(part[:, None], np.arange(n)[None, :])), 1)
                mass = np.cumsum(np.exp(scores - scores.max(1, keepdims=True)), 1)
                out[part] = 1 + np.minimum((mass < u[part, None] * mass[:, -1:]).sum(1), n - 1)
    at = np.flatnonzero(c > exact)
    seated, bits = np.full(len(at), exact), bits[at]
    while len(at):
        group, bits = np.minimum(seated // 10, c[at] - seated), mix(bits + GOLD)
        new = weight(at[:, None], out[at][:, None])[:, 0]
        out[at] += binomial(group, new / (seated - discount * out[at] + new), bits)
        seated = seated + group
        left = seated < c[at]
        at, seated, bits = at[left], seated[left], bits[left]
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, np.float64), 0.0
    for _ in range(8):
        out, x = out - 1 / x, x + 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def evidence(c: np.ndarray, t: np.ndarray, discount: float, strength: float) -> tuple[float, float]:
    """Expected auxiliary variables of restaurants, summed: tables opened by the strength, and minus logs of betas."""
    many = c > 1
    c, t, ratio = c[many], t[many], strength / discount
    return float((ratio * (digamma(t + ratio) - digamma(1 + ratio))).sum()), float((digamma(strength + c) - digamma(strength + 1)).sum())


@dataclass(frozen=True)
class Totals:
    """What all rows share: sizes, discounts and strengths (of contexts, of the parent), customers and tables of the parent
    and of hot contexts."""

    vocabulary: int
    tokens: int
    discount: tuple[float, float]
    strength: tuple[float, float]
    customers: int = 0
    tables: int = 0
    above: tuple = ()

    @property
    def base(self) -> float:
        return (self.strength[1] + self.discount[1] * self.tables) / (self.vocabulary + 1)

    def parent(self, c1, t1):
        """Probability of a token in the parent, of which it has c1 customers and t1 tables."""
        return (c1 - self.discount[1] * t1 + self.base) / (self.strength[1] + self.customers)

    def predict(self, c, t, c_all, t_all, parent):
        """Probability of a token in a context from its customers and tables, those of the context, and the parent's."""
        d, s = self.discount[0], self.strength[0]
        return (c - d * t + (s + d * t_all) * parent) / (s + c_all)


def shares(one: int, two: int) -> float:
    return min(0.95, max(0.1, one / (one + 2 * two))) if one + two else 0.5


def cuts_of(ordered: np.ndarray, bits: int) -> np.ndarray:
    """Where the hashes of each bucket of tokens start."""
    return np.searchsorted(ordered >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def dishes(pairs: DataFrame, bits: int) -> DataFrame:
    """Packed rows by bucket of tokens (sub). STATE: tokens, pairs of one customer of each; PLACES: the places there of the
    tokens of each bucket of contexts; COUNTS: all customers of these. Tokens with 1, 2 and any tables of the parent's customers
    are counted in ones, twos, all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                _, _, w, at, c, _ = unpack(payload)
                sums = [summed(at, v, len(w)) for v in (c, c == 1, c > 0)]
                cuts = cuts_of(w, bits)
                yield rows([(bucket, 0, d, pack(w[i:j], *(small(v[i:j]) for v in sums))) for d, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j])

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dish,), table in groups(batches, ["sub"]):
            parts = [unpack(p) for p in table.column("payload")]
            w, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c, single, any_ = (summed(at, np.concatenate([p[i] for p in parts]), len(w)) for i in (1, 2, 3))
            held = [(-1, STATE, dish, pack(w, small(single)), *(int((any_ == i).sum()) for i in (1, 2)), int((any_ > 0).sum()))]
            cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
            for bucket, i, j in zip(table.column("bucket").to_pylist(), cuts[:-1], cuts[1:]):
                held.append((bucket, PLACES, dish, pack(small(np.diff(at[i:j], prepend=0))), 0, 0, 0))
                held.append((bucket, COUNTS, dish, pack(small(c[at[i:j]])), 0, 0, 0))
            yield rows(held, PACKED + ", ones long, twos long, all long")

    return by_key(pairs.where(F.col("kind") == PAIRS).mapInArrow(run, PACKED), "sub", "bucket").mapInArrow(merged, PACKED + ", ones long, twos long, all long")


SEATED = PACKED + ", a double, b double, hot binary"


def told(bucket: int, c_all: np.ndarray, single: np.ndarray, hot: np.ndarray, mu: np.ndarray, mw: np.ndarray, t: np.ndarray, cuts: np.ndarray, x: Totals) -> tuple[list[tuple], tuple]:
    """What a bucket of contexts sends: its tables by token, to the tokens' buckets, and what its contexts add to the totals."""
    t_all = single + summed(mu, t, len(c_all))
    cold = hot == 0
    a, b = evidence(c_all[cold], t_all[cold], x.discount[0], x.strength[0])
    sums = pack(small(hot[~cold]), small(c_all[~cold]), small(t_all[~cold]))
    t2 = summed(mw, t, int(cuts[-1]))
    messages = [(bucket, SAMPLE, d, pack(small(t2[i:j])), 0.0, 0.0, None) for d, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
    return messages, (a, b, sums)


def begin(pairs: DataFrame, c: Common, x: Totals, bits: int) -> DataFrame:
    """STATE rows of the pairs of two customers and more, one table each: contexts' customers, pairs of one customer and hot
    number, context, token, customers, tables and summed probability of each pair, cuts of the tokens, sampled tables of the
    contexts, half the pairs' hashes; SAMPLE rows for the tokens' buckets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                u, size, w, at, customers, _ = unpack(payload)
                owner = np.repeat(np.arange(len(u)), size)
                place, is_hot = is_in(u, c.ids)
                hot = np.where(is_hot, c.owner[place] + 1, 0) if len(c.ids) else np.zeros(len(u), np.int64)
                c_all, single, many = summed(owner, customers, len(u)), summed(owner, customers == 1, len(u)), customers > 1
                mu, mw, t, cuts = owner[many], long(at[many]), np.ones(int(many.sum()), np.int64), cuts_of(w, bits)
                draws = (pair(c.named(u)[mu], w[mw]) >> np.uint64(32)).astype(np.uint32)
                messages, sums = told(bucket, c_all, single, hot, mu, mw, t, cuts, x)
                state = pack(small(c_all), small(single), small(hot), small(mu), small(mw), customers[many], small(t), np.zeros(0, np.float32), cuts, small(np.zeros(0)), draws)
                yield rows([(bucket, STATE, 0, state, *sums), *messages], SEATED)

    return pairs.where(F.col("kind") == PAIRS).mapInArrow(run, SEATED)


def parents(seated: DataFrame, dish: DataFrame, x: Totals, round_: int, seed: int) -> DataFrame:
    """SAMPLE rows that answer each bucket of contexts: customers and tables of its tokens in the parent, the tables drawn; all of these in c, t."""
    before = x.tables or x.vocabulary

    def drawn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, s, others = x.discount[1], x.strength[1], max(before - 1, 0)
        table = stirling(d)
        for (dish_,), held in groups(batches, ["sub"]):
            kinds, buckets, payloads = held.column("kind").to_pylist(), held.column("bucket").to_pylist(), held.column("payload")
            w, c1 = (unpack(payloads[0]))
            c1, places = long(c1), {}
            for i in range(1, len(kinds)):  # each bucket's SAMPLE row follows its PLACES row
                if kinds[i] == PLACES:
                    places[buckets[i]] = np.cumsum(long(unpack(payloads[i])[0]))
                else:
                    c1[places[buckets[i]]] += long(unpack(payloads[i])[0])
            bits = mix(w) + np.uint64(2 * (seed + 64 * round_) + 1)
            t1 = seat(c1, lambda rows_, t: (s + d * (others + t)) / (x.vocabulary + 1) + 0.0 * rows_, d, bits, table)
            yield rows([(-1, STATE, dish_, None, int(c1.sum()), int(t1.sum()))] + [(b, SAMPLE, dish_, pack(small(c1[at]), small(t1[at])), 0, 0) for b, at in places.items()], PACKED + ", c long, t long")

    names = PACKED.replace(" int", "").replace(" binary", "").split(", ")
    both = dish.where(F.col("kind") != COUNTS).select(*names).unionByName(seated.where(F.col("kind") == SAMPLE).select(*names))
    return by_key(both, "sub", "bucket", F.col("kind").desc()).mapInArrow(drawn, PACKED + ", c long, t long")


def answer(table: pa.Table, kind: int) -> list[np.ndarray]:
    """The arrays of a bucket's rows of one kind, end to end."""
    found = [unpack(p) for k, p in zip(table.column("kind").to_pylist(), table.column("payload")) if k == kind]
    return [long(np.concatenate(part)) for part in zip(*found)]


def step(seated: DataFrame, replies: DataFrame, x: Totals, above: tuple[np.ndarray, np.ndarray], bits_of_round: int, take: bool, draw: bool) -> DataFrame:
    """STATE with the pairs' predictive probabilities added (if ``take``) and tables drawn anew (if ``draw``), and what it tells. ``above``: customers and tables of hot contexts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, s = x.discount[0], x.strength[0]
        table = stirling(d)
        for (bucket,), held in groups(batches, ["bucket"]):
            own, single, hot, mu, mw, c, t, p, cuts, sampled, draws = (v if v.dtype.kind == "f" else long(v) for v in unpack(held.column("payload")[0]))
            c1, t1 = answer(held, SAMPLE)
            c_all, t_all = own.copy(), single + summed(mu, t, len(own))
            is_hot = hot > 0
            c_all[is_hot], t_all[is_hot] = (v[hot[is_hot] - 1] for v in above)
            if take:
                more = x.predict(c, t, c_all[mu], t_all[mu], x.parent(c1[mw], t1[mw]))
                p, sampled = (p + more if len(p) else more), np.concatenate((sampled, t_all))
            if draw:
                rest, mine, over = (t_all[mu] - t), c1[mw] - t, np.minimum(t1[mw], c1[mw] - t)
                sure = x.strength[1] + x.customers - t

                def weight(rows_, i):
                    had = mine[rows_] + i
                    parent = (had - x.discount[1] * np.maximum(over[rows_], had > 0) + x.base) / (sure[rows_] + i)
                    return (s + d * (rest[rows_] + i)) * parent

                t = seat(c, weight, d, mix(draws.astype(np.uint64)) + np.uint64(bits_of_round), table)
            messages, sums = told(bucket, own, single, hot, mu, mw, t, cuts, x) if draw else ([], (0.0, 0.0, None))
            state = pack(small(own), small(single), small(hot), small(mu), small(mw), small(c), small(t), p.astype(np.float32), cuts, small(sampled), draws.astype(np.uint32))
            yield rows([(bucket, STATE, 0, state, *sums), *messages], SEATED)

    both = seated.where(F.col("kind") == STATE).select("bucket", "kind", "sub", "payload").unionByName(replies.where("bucket >= 0").select("bucket", "kind", "sub", "payload"))
    return by_key(both, "bucket", "kind", "sub").mapInArrow(run, SEATED)


def hot_sums(seated: DataFrame, c: Common, x: Totals) -> tuple[float, float, tuple[np.ndarray, np.ndarray]]:
    """Expected auxiliary variables of all contexts, summed; customers and tables of the hot ones. The rows name each shard once."""
    found = seated.where(F.col("kind") == STATE).agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in ("a", "b"))).first()
    above = np.zeros(len(c.hot), np.int64), np.zeros(len(c.hot), np.int64)
    for batch in seated.where("hot is not null").select("hot").toArrow().to_batches():
        for held in batch.column("hot"):
            at, *values = map(long, unpack(held))
            for total, v in zip(above, values):
                np.add.at(total, at - 1, v)
    a, b = evidence(*above, x.discount[0], x.strength[0])
    return found.a + a, found.b + b, above


def values(rows_: DataFrame, c: Common, kept: list[Totals], whole: bool) -> DataFrame:
    """Of each bucket: what each piece's pairs add (score and the customers of the token), in the piece's order; if ``whole`` instead every pair once."""
    names = "u long, w long, c long, n long, t long, p double, c_w long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), held in groups(batches, ["bucket"]):
            payloads = held.column("payload")
            u, size, w, at, customers, n = unpack(payloads[0])
            own, _, hot, _, _, _, mt, mp, _, sampled, _ = unpack(payloads[1])
            owner, customers, at = np.repeat(np.arange(len(u)), size), long(customers), long(at)
            is_hot = hot > 0
            c_all = long(own)
            c_all[is_hot] = above[0][long(hot[is_hot]) - 1]
            p = np.zeros(len(at))
            for i, (x, t_all) in enumerate(zip(kept, long(sampled).reshape(len(kept), len(u)))):
                c1, t1 = answer(held, SAMPLE + i)
                p += x.predict(customers, customers, c_all[owner], t_all[owner], x.parent(c1, t1)[at])
            many, t = customers > 1, customers.copy()
            p[many], t[many] = mp, mt
            p /= len(kept)
            c_w = answer(held, COUNTS)[0][at]
            if whole:
                arrays = [c.named(u)[owner].view(np.int64), w[at].view(np.int64), customers, long(n), t, p, c_w]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=[f.split()[0] for f in names.split(", ")])
                continue
            score_ = np.log10(p).astype(np.float32)
            for kind, piece, payload in zip(held.column("kind").to_pylist(), held.column("sub").to_pylist(), payloads):
                if kind == PLACES:
                    place = np.cumsum(long(unpack(payload)[0]))
                    yield rows([(bucket, 0, piece, pack(score_[place], small(c_w[place])))])

    above = kept[-1].above
    return by_key(rows_, "bucket", "kind", "sub").mapInArrow(run, names if whole else PACKED)


def model(spark: SparkSession, docs: DataFrame, rounds: int, samples: int, seed: int) -> tuple[DataFrame, Common, list[Totals], int, list[DataFrame]]:
    """Packed rows that ``values`` reads; frequent tokens and hot contexts; totals of the samples; number of pieces; tables that are read."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces, bits = max(24, size >> 23), max(5, ((size >> 24) - 1).bit_length() if size >> 24 else 0)
    few = max(4, bits - 2)
    c = common(spark, docs)
    pairs = save(spark, count_pairs(docs, c, pieces, bits), "pairs")
    dish = save(spark, dishes(pairs, few), "dishes")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                v = unpack(payload)[4]
                yield rows([(int(long(v).sum()), int((v == 1).sum()), int((v == 2).sum()))], "n long, ones long, twos long")

    total = lambda table, *names: table.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    of = total(pairs.where(F.col("kind") == PAIRS).mapInArrow(counted, "n long, ones long, twos long"), "n", "ones", "twos")
    ofdishes = total(dish, "ones", "twos", "all")
    x = Totals(int(ofdishes["all"]), int(of.n), (shares(of.ones, of.twos), shares(ofdishes.ones, ofdishes.twos)), (10.0, 100.0))
    seated = save(spark, begin(pairs, c, x, few), "seating")
    kept, samples_ = [], []
    for r in range(rounds + 1):
        take, draw = r > rounds - samples, r < rounds
        a, b, above = hot_sums(seated, c, x)
        replies = save(spark, parents(seated, dish, x, r, seed), "replies")
        size_ = total(replies, "c", "t")
        parent = evidence(np.array([size_.c]), np.array([size_.t]), x.discount[1], x.strength[1])
        strength = tuple(min(1e6, max(1e-3, (1 + i) / (0.01 + j))) for i, j in ((a, b), parent)) if x.tokens else x.strength
        x = replace(x, strength=strength, customers=int(size_.c), tables=int(size_.t), above=above)
        old, seated = seated, save(spark, step(seated, replies, x, above, 2 * (seed + 64 * r), take, draw), "seating")
        drop(spark, old)
        if take:
            kept.append(x)
            samples_.append(replies)
        else:
            drop(spark, replies)
    names = ["bucket", "kind", "sub", "payload"]
    read = pairs.unionByName(seated.where(F.col("kind") == STATE).select(*names)).unionByName(dish.where(F.col("kind") == COUNTS).select(*names))
    for i, replies in enumerate(samples_):
        read = read.unionByName(replies.where("bucket >= 0").withColumn("kind", F.lit(SAMPLE + i)).select(*names))
    return read, c, kept, pieces, [pairs, dish, seated, *samples_]


def fit(spark: SparkSession, docs: DataFrame, rounds: int, samples: int, seed: int) -> tuple[DataFrame, Totals, list[DataFrame]]:
    """(u, w, c, n, t, p, c_w) of every pair of the texts, p its averaged predictive probability; the totals; tables it reads."""
    read, c, kept, _, tables = model(spark, docs, rounds, samples, seed)
    return values(read, c, kept, True), kept[-1], tables


def looked_up(docs: DataFrame, found: DataFrame, c: Common, pieces: int, kind: str) -> DataFrame:
    """(doc, n_tokens, n_known, base, score) of every row: a piece's values come first, in the order of its pairs."""
    names = f"doc {kind}, n_tokens long, n_known long, base double, score double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, ["piece"]):
            is_text = table.column("kind").to_numpy()
            n = int(np.count_nonzero(is_text == 0))
            score_, c_w = (np.concatenate(part) for part in zip(*(unpack(p) for p in table.column("payload")[:n])))
            batch = one(table.slice(n))
            vocabulary, code, starts = coded(batch)
            key, at = np.unique(previous(vocabulary, code, starts) * len(vocabulary) + code, return_inverse=True)
            _, _, order = order_of(vocabulary, key, c)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = place[at]
            c_w, score_ = long(c_w), score_.astype(np.float64)
            base = np.log10(c_w + 0.1)
            sums = [np.add.reduceat(v[at], starts[:-1]) for v in (long(c_w > 0), base, score_)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, (np.diff(starts), *sums))], names=[f.split()[0] for f in names.split(", ")])

    answers = found.select(F.col("sub").alias("piece"), F.lit(0).alias("kind"), "bucket", "payload")
    both = dealt(docs, pieces).select("piece", F.lit(1).alias("kind"), "doc", "text").unionByName(answers, allowMissingColumns=True)
    return by_key(both, "piece", "kind", "bucket").mapInArrow(run, names)


def score(spark: SparkSession, docs: DataFrame, train, doc_id: str = "doc_id", rounds: int = 3, samples: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    ``train``: a boolean column of ``docs``; rows for which it is true are learned from. base_score is that of single
    tokens with 0.1 added to each count, score the model's log10 probability of the text.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    part = docs.select(F.col(doc_id).alias("doc"), F.coalesce(train & F.col(doc_id).isNotNull(), F.lit(False)).alias("train"), "text")
    read, c, kept, pieces, tables = model(spark, part, rounds, samples, seed)
    found = save(spark, values(read, c, kept, False), "values")
    drop(spark, *tables)
    x = kept[-1]
    out = looked_up(part, found, c, pieces, kind)
    return out.select(
        F.col("doc").alias(doc_id), "n_tokens", "n_known", F.lit(x.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(x.tokens + 0.1 * (x.vocabulary + 1)))).alias("base_score"),
        "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
