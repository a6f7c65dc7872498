"""Fuzzy line deduplication.

Lines are normalised (lower case, digits to 0, other ASCII signs to blanks, blanks collapsed); lines without a word are
left alone. Equal normalised lines are one node (128-bit hash), however short. A node of at least ``min_words`` words
is near another if their edit similarity is at least 0.8.

The features of a line are its long words, and each shorter word together with its successor. Their 64-bit SimHash is
what two lines are first compared by; at most BITS bits may differ. A join on blocks of the SimHash itself would have to
let so many bits differ that its blocks say nothing, so the blocks are KEYS keys of EACH minima of the features' hashes
(one-permutation min-hash, empty bins filled from others of the line). A pair whose features agree in the share J meets in
a key with 1 - (1 - J^3)^10. Lines of at most SHORT words have too few features to rely on that: they have further keys,
the line without each of its words and the line itself, so that two short lines that differ in one word (replaced, put in
or taken away) always meet, and no bits are asked of them. Lines that meet and pass the SimHash are candidates; of each
group of candidates the edit similarity is checked, and of each connected group the first occurrence (least doc_id, then
line) stays.

Defined results: null texts stay null and have no lines; empty texts stay empty; rows that repeat a doc_id share their
removals by line number; rows with a null doc_id keep all their lines and are no occurrence; an empty table gives no
rows. Of equal or near lines the one of least (doc_id, line) is first, so there are no ties but between rows of one id.
Texts and lines of any length are handled whole. Input columns named n_lines or n_removed give way to the output's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import linked
from .graph import components, stars, united
from .store import drop, save
from .text import FOLD, binaries, groups, hashes, lines, mapped, mix, raw, slices, texts, words

_NORMAL = FOLD.copy()
_NORMAL[48:58] = 48
ALONE, KEYS, EACH, BITS = 7, 10, 3, 16
BINS = KEYS * EACH
SHORT = KEYS  # words; a line of as many has no room for itself as a key beside the line without each word
NONE, GOLD = ~np.uint64(0), np.uint64(0x9E3779B97F4A7C15)
#: Bit i of a byte as byte i of a word: sums of up to 255 such words count eight bits at once.
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
LOOK = 32
#: Grams and window of the second look for an edit script, which costs a tenth of an exact distance and less.
AGAIN = 6, 128
#: Lines whose keys lie in one value, and its parts.
BLOCK, PARTS = 1 << 14, ["nodes", "sims", "sizes", "wide", "keys"]
BUCKET = 1 << 20  # keys that a task holds at a time, but for those of one key


#: Bytes of a word that are hashed eight at a time; longer words are hashed whole.
EIGHTS = 64
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


class Lines(NamedTuple):
    """What is counted of the words of all normalised lines of some texts."""

    starts: np.ndarray  # of each text, in lines (one more than texts)
    at: np.ndarray  # of each line, in words (one more than lines)
    signs: np.ndarray  # characters of each line, words joined by one blank
    length: np.ndarray  # of each word, in bytes
    h: np.ndarray  # of each word


def normal_lines(strings: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Where each text's lines start, the words of all normalised lines, and where each line's words start."""
    flat, starts = lines(strings)
    words_, at = words(mapped(flat, _NORMAL))
    return starts, words_, at


def counted_lines(strings: pa.Array) -> Lines:
    """The words of ``normal_lines``, hashed and counted where they lie, without a string for each."""
    offs, plain = raw(pc.binary_join_element_wise(strings, "\n", ""))
    ends = np.flatnonzero(plain == 10)
    data = _NORMAL[plain]
    edges = np.flatnonzero(np.diff((data != 32).view(np.int8), prepend=np.int8(0)))
    begin, length = edges[::2], edges[1::2] - edges[::2]
    at = np.concatenate(([0], np.searchsorted(begin, ends)))
    size = np.concatenate(([0], np.cumsum(length)))
    inner = np.searchsorted(np.flatnonzero((plain & 0xC0) == 0x80), ends)  # bytes that begin no character
    signs = np.diff(size[at]) - np.diff(inner, prepend=0) + np.maximum(np.diff(at) - 1, 0)
    return Lines(np.searchsorted(ends, offs), at, signs, length, spelled(data, begin, length))


def spelled(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words without zero bytes, read eight bytes at a time; of words up to eight bytes no two are equal."""
    held = np.append(data, np.zeros(8, np.uint8))  # room for reading behind the last word
    eight = np.ndarray((len(data) + 1,), "<u8", held, 0, (1,))
    h = mix((eight[begin] & _LOW[np.minimum(length, 8)]) ^ GOLD)
    more, k = np.flatnonzero(length > 8), 8
    while len(more) and k < EIGHTS:
        h[more] = mix(h[more] * GOLD + (eight[begin[more] + k] & _LOW[np.minimum(length[more] - k, 8)]))
        k += 8
        more = more[length[more] > k]
    if len(more):
        h[more] = hashes(pa.array([held[i:j].tobytes() for i, j in zip(begin[more].tolist(), (begin + length)[more].tolist())], pa.binary()), 1)
    return h


def spelled_words(flat: pa.Array) -> np.ndarray:
    """``spelled`` of words that are strings."""
    offs, data = raw(flat)
    return spelled(data, offs[:-1], np.diff(offs))


def features(length: np.ndarray, h: np.ndarray, at: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the features of the lines ``take`` in a row, where each line's start, and how many it has."""
    n = np.diff(at)[take]
    starts = np.cumsum(n) - n
    place = np.arange(n.sum()) + np.repeat(at[take] - starts, n)
    word = h[place]
    after = np.append(word[1:], np.uint64(0))
    after[starts + n - 1] = 0
    return mix(np.where(length[place] >= ALONE, word + np.uint64(1), word * GOLD + after)), starts, n


def simhashes(feature: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits of each line: those that over half of its features have."""
    parts = -(-n // 255)
    owner = np.repeat(np.arange(len(n)), parts)
    first = np.cumsum(parts) - parts
    begin = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    by = feature.view(np.uint8).reshape(-1, 8)
    count = np.stack([np.add.reduceat(_LANES[by[:, i]], begin) for i in range(8)], 1).view(np.uint8).reshape(-1, 64)
    bits = 2 * np.add.reduceat(count.astype(np.int64), first, axis=0) > n[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def minima(feature: np.ndarray, n: np.ndarray) -> np.ndarray:
    """BINS values of each line: the least hash in each bin of its features; an empty bin takes that of another bin."""
    line = np.repeat(np.arange(len(n)), n)
    place = lambda h: (((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    least = np.full(len(n) * BINS, NONE)
    turned = (feature << np.uint64(32)) | (feature >> np.uint64(32))  # ordered by the half that does not choose the bin
    np.minimum.at(least, line * BINS + place(feature), np.minimum(turned, NONE - np.uint64(1)))
    out, empty, turn = least.copy(), np.flatnonzero(least == NONE), 0
    while len(empty):
        turn += 1
        other = least[empty // BINS * BINS + place(mix((empty % BINS + 1000 * turn).astype(np.uint64) * GOLD))]
        full = other != NONE
        out[empty[full]] = other[full]
        empty = empty[~full]
    return out.reshape(-1, BINS)


def without_one(h: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """KEYS keys of each line of n <= SHORT words from ``begin`` on: without its words in turn, then whole; the rest repeat the first."""
    if not len(n):
        return np.zeros((0, KEYS), np.uint64)
    place = np.arange(SHORT)
    word, there = h[np.minimum(begin[:, None] + place, len(h) - 1)], place < n[:, None]
    here, moved = (np.where(there, mix(word + mix((place + shift).astype(np.uint64) * GOLD)), np.uint64(0)) for shift in (1, 0))
    whole, rest = here.sum(1, dtype=np.uint64), moved.sum(1, dtype=np.uint64)
    before, upto = np.cumsum(here, 1, dtype=np.uint64) - here, np.cumsum(moved, 1, dtype=np.uint64)
    size = n.astype(np.uint64)[:, None]
    key = np.where(there, mix(before + rest[:, None] - upto + size - np.uint64(1)), mix(whole[:, None] + size))
    return np.where(place <= n[:, None], key, key[:, :1])


def sketches(flat: pa.Array, h: np.ndarray, at: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``sketched`` of lines whose words are strings."""
    signs = np.concatenate(([0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False))))
    return sketched(pc.binary_length(flat).to_numpy(zero_copy_only=False), signs[at[1:]] - signs[at[:-1]] + np.maximum(np.diff(at) - 1, 0), h, at, take)


def sketched(length: np.ndarray, signs: np.ndarray, h: np.ndarray, at: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """SimHash, characters and keys of the lines ``take``: KEYS of 48 bits, as three numbers of 16 each, twice as many for short lines.

    The lowest bit of a key tells the further keys of short lines, which have no order, from those of a place.
    """
    if not len(take):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.binary())
    feature, starts, n = features(length, h, at, take)
    short = n <= SHORT
    key, parts = np.zeros((len(take), 2 * KEYS), np.uint64), minima(feature, n).reshape(-1, KEYS, EACH)
    for i in range(EACH):
        key[:, :KEYS] = mix(key[:, :KEYS] * GOLD + parts[:, :, i])
    key[:, :KEYS] &= ~np.uint64(1)
    key[short, KEYS:] = without_one(h, at[take[short]], n[short]) | np.uint64(1)
    held = key.view(np.uint16).reshape(len(take), 2 * KEYS, 4)[:, :, :3].reshape(len(take), 2 * BINS)
    there = np.repeat(np.stack((np.ones(len(take), bool), short), 1), BINS, axis=1)
    return simhashes(feature, starts, n), signs[take].astype(np.int32), binaries(np.concatenate(([0], np.cumsum(BINS + BINS * short))), held[there])


def whole_keys(held: bytes | np.ndarray) -> np.ndarray:
    """KEYS numbers below 2^48 for each line, from the bytes of as many keys of all."""
    parts = np.frombuffer(held, "<u2").reshape(-1, KEYS, EACH).astype(np.int64)
    return parts[:, :, 0] | (parts[:, :, 1] << 16) | (parts[:, :, 2] << 32)


def digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each line's words in order, as two numbers."""
    place, most = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at)), int(np.diff(at).max(initial=0))
    v = mix(h + mix(np.arange(1, most + 1, dtype=np.uint64) * GOLD)[place])
    out = []
    for x in (v, (v ^ (v >> np.uint64(31))) * (v | np.uint64(1))):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)))
    return np.stack(out, 1)


def line_table(docs: DataFrame, doc_id: str, min_words: int) -> DataFrame:
    """(doc, line, node, sim) of every line with a word; sim is null for lines of fewer than ``min_words`` words.

    The keys of longer lines are only compared with each other, so they stay in blocks of BLOCK lines at most: nodes, sims,
    sizes, wide (how many times KEYS they are) and keys, which lie in one row of their lines and are null in the others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, most=1 << 20):
            starts, at, signs, length, h = counted_lines(texts(piece))
            n, node = np.diff(at), digests(h, at)
            lines_ = np.flatnonzero(n > 0)
            for i in range(0, len(lines_), BLOCK):
                take = lines_[i : i + BLOCK]
                full = n[take] >= min_words
                text = np.searchsorted(starts, take, "right") - 1
                sim, size, keys = sketched(length, signs, h, at, take[full])
                offs, held = raw(keys)
                block = [x.tobytes() for x in (node[take[full]], sim, size, (np.diff(offs) // WIDE).astype(np.uint8), held)]
                near, rest = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full), [None] * (len(take) - 1)
                yield pa.RecordBatch.from_arrays([piece.column("doc").take(pa.array(text)), pa.array((take - starts[text]).astype(np.int32)), binaries(np.arange(len(take) + 1) * 2, node[take].ravel()), pa.array(sim).take(near), *(pa.array([x if len(sim) else None, *rest], pa.binary()) for x in block)], names=["doc", "line", "node", "sim", *PARTS])

    kind = docs.schema[doc_id].dataType.simpleString()
    parts = ", ".join(f"{x} binary" for x in PARTS)
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), "text").mapInArrow(run, f"doc {kind}, line int, node binary, sim long, {parts}")


def near_sketches(lines_: DataFrame, similarity: float, most: int = BITS) -> DataFrame:
    """Links (a, b) that connect the lines of ``line_table`` which share a key, have SimHashes at most ``most`` bits apart (or
    the key of short lines in common) and are of like size.

    Rows are dealt by key, packed by bucket of keys; each is compared with the others of its key until all of them are
    connected: many variants of one line need a few comparisons each. Unlike rows of one key are all compared. Copies of a
    line travel once for each run of BUCKET keys of a task, and all but one are dropped where they meet.
    What connects is thinned to stars before it leaves the task, so a group of n gives about n links.
    """
    buckets = max(64, -(-lines_.where("sim is not null").count() * KEYS // BUCKET))

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, sim, size = (np.concatenate(x) for x in zip(*held))
        bucket = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        full, n = np.unique(bucket, return_counts=True)
        cuts = np.append(0, np.cumsum(n))
        return pa.RecordBatch.from_arrays([pa.array(full), *(binaries(cuts, x[order]) for x in (key, sim, size))], names=["bucket", "key", "sim", "size"])

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in PARTS)):
                held.append([np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.uint64, np.int64, np.int32, np.uint8, np.uint8))])
                n += len(held[-1][1])
                if n * KEYS >= BUCKET:
                    yield packed(expanded(*(np.concatenate(x) for x in zip(*held))))
                    held, n = [], 0
        if n:
            yield packed(expanded(*(np.concatenate(x) for x in zip(*held))))

    def expanded(node: np.ndarray, sim: np.ndarray, size: np.ndarray, wide: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each key with its line's SimHash and size, copies of a line once."""
        node = node.reshape(-1, 2)
        order = np.lexsort((node[:, 1], node[:, 0]))
        once = np.sort(order[np.append(True, (node[order[1:]] != node[order[:-1]]).any(1))])
        first = (np.cumsum(wide, dtype=np.int64) - wide)[once]
        key, sim, size, short = whole_keys(keys), sim[once], size[once], np.flatnonzero(wide[once] > 1)
        further = key[first[short] + 1]
        line, c = np.nonzero((further != further[:, :1]) | (np.arange(KEYS) == 0))
        return [
            ((key[first] << 4 | np.arange(KEYS)).ravel(), np.repeat(sim, KEYS), np.repeat(size, KEYS)),
            (further[line, c] << 4 | 15, sim[short[line]], size[short[line]]),
        ]

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in groups(batches, ["bucket"]):
            key, sim, size = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]) for c, kind in (("key", np.int64), ("sim", np.int64), ("size", np.int32)))
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            order = order[np.append(same, False) | np.append(False, same)]
            order = order[np.lexsort((size[order], sim[order], key[order]))]
            key, sim, size = key[order], sim[order], size[order]
            other = np.append(True, (key[1:] != key[:-1]) | (sim[1:] != sim[:-1]) | (size[1:] != size[:-1]))[: len(key)]
            yield from (thin(x) for x in joins(key[other], sim[other], size[other]))

    def thin(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(stars(*(pa.array(np.concatenate(x)) for x in zip(*found)))), names=["a", "b"])

    def joins(key: np.ndarray, sim: np.ndarray, size: np.ndarray) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
        label, found, n, joined = np.arange(len(key)), [], 0, []
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        at, gap, look = np.arange(len(key)), 1, 4
        while len(at):
            at = at[at >= gap]
            at = at[run[at] == run[at - gap]]
            apart = np.bitwise_count((sim[at] ^ sim[at - gap]).view(np.uint64))
            short, long = np.minimum(size[at], size[at - gap]), np.maximum(size[at], size[at - gap])
            like = ((apart <= most) | (key[at] & 15 == 15)) & (long - short <= (1 - similarity) * long + 1e-9)
            near = at[(like | (apart == 0)) & (label[at] != label[at - gap])]
            if len(near):
                joined.append((near, near - gap))
                found.append((sim[near], sim[near - gap]))
                n += len(near)
            if n > BUCKET:
                yield found
                found, n = [], 0
            gap += 1
            if gap >= look and len(at):
                if joined:
                    label, joined = united(label, *(np.concatenate(x) for x in zip(*joined))), []
                apart_yet = np.add.reduceat(label != label[starts][run], starts) > 0
                at, look = at[apart_yet[run[at]]], 2 * look
        if n:
            yield found

    dealt = lines_.where("nodes is not null").select(*PARTS).mapInArrow(keyed, "bucket int, key binary, sim binary, size binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(pairs, "a long, b long").where("a <> b")


def least_cost(plus: int, minus: int, rows: int, column: int, ahead: int) -> int:
    """Least distance that any path through this column can still end with.

    Row i of the column costs ``column`` plus the differences above it, and at least as many edits follow as the numbers
    of rows and columns that are left differ by.
    """
    size = (rows + 7) // 8
    up, down = (np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), bitorder="little", count=rows).view(np.int8) for v in (plus, minus))
    cost = np.concatenate(([column], column + np.cumsum(up - down, dtype=np.int64)))
    return int((cost + np.abs(np.arange(rows, -1, -1) - ahead)).min())


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance by bit-parallel columns (Myers, 1999), or most + 1 if it is larger.

    Now and then the whole column is looked at, so that unlike strings end soon after their cost passes ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    left, right = 0, min(len(a), len(b))
    while left < right:  # equal ends do not count: halve until the first difference is found
        middle = (left + right + 1) // 2
        left, right = (middle, right) if a[:middle] == b[:middle] else (left, middle - 1)
    a, b = a[left:], b[left:]
    left, right = 0, min(len(a), len(b))
    while left < right:
        middle = (left + right + 1) // 2
        left, right = (middle, right) if a[-middle:] == b[-middle:] else (left, middle - 1)
    a, b = a[: len(a) - left], b[: len(b) - left]
    if not a or not b:
        return max(len(a), len(b))
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    ones = (1 << len(a)) - 1
    plus, minus = ones, 0  # vertical differences of +1 and -1
    look = max(LOOK, most)  # columns before which no look is worth its cost
    for j, ch in enumerate(b):
        if j == look:
            cost = least_cost(plus, minus, len(a), j, len(b) - j)
            if cost > most:
                return most + 1
            look += max(LOOK, most - cost)
        eq = peq.get(ch, 0)
        vertical = eq | minus
        level = (((eq & plus) + plus) ^ plus) | eq
        rise = ((minus | ~(level | plus)) << 1 | 1) & ones
        plus = ((plus & level) << 1 | ~(vertical | rise)) & ones
        minus = rise & vertical
    return min(len(b) + plus.bit_count() - minus.bit_count(), most + 1)


def same_until(a: str, b: str, i: int, j: int) -> int:
    """How many characters from a[i] and b[j] on are equal: doubling steps, then halving ones."""
    n, step, most = 0, 16, min(len(a) - i, len(b) - j)
    while n < most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    while step and n < most:
        if n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
        step //= 2
    return min(n, most)


def script_cost(a: str, b: str, most: int, gram: int = 8, window: int = 32) -> int:
    """Length of an edit script from a to b, so no less than their distance; most + 1 if none as short is found at once.

    Behind each difference the next run of ``gram`` equal characters within ``window`` is looked for.
    """
    i = j = cost = 0
    while cost <= most:
        n = same_until(a, b, i, j)
        i, j = i + n, j + n
        if max(len(a) - i, len(b) - j) <= gram:
            return min(cost + max(len(a) - i, len(b) - j), most + 1)
        for skip in range(min(window, len(a) - i - gram) + 1):
            at = b.find(a[i + skip : i + skip + gram], j, j + window + gram)
            if at >= 0:
                break
        else:
            rest = cost + max(len(a) - i, len(b) - j)
            return rest if rest <= most else most + 1
        cost += max(skip, at - j)
        i, j = i + skip, at
    return most + 1


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a script found at once tells, or else the exact distance."""
    if abs(len(a) - len(b)) > most:
        return False
    return script_cost(a, b, most) <= most or edit_distance(a, b, most) <= most


def distances(text: str, others: list[str]) -> np.ndarray:
    """Edit distances of ``text`` to each of ``others``, found together.

    The columns of all others lie side by side in one number, a blank bit above each, so that every step of the
    bit-parallel method serves all of them. A distance is the last column's sum: len(text) + rises - falls.
    """
    sizes = np.array([len(o) for o in others])
    starts = np.cumsum(sizes + 1) - sizes - 1
    signs = np.frombuffer(("\0".join(others) + "\0").encode("utf-32-le"), np.uint32)
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    held = np.ones(len(signs), bool)
    held[starts + sizes] = False
    first = np.zeros(len(signs), bool)
    first[starts[sizes > 0]] = True
    peq = {ch: number((signs == ord(ch)) & held) for ch in set(text)}
    ones, low = number(held), number(first)
    plus, minus = ones, 0
    for ch in text:
        eq = peq[ch]
        vertical = eq | minus
        level = ((((eq & plus) + plus) ^ plus) | eq) & ones
        rise = ((minus | (ones ^ (level | plus))) << 1 | low) & ones
        fall = ((plus & level) << 1) & ones
        plus = fall | (ones ^ (vertical | rise))
        minus = rise & vertical
    size = (len(signs) + 7) // 8
    up, down = (np.unpackbits(np.frombuffer(v.to_bytes(size, "little"), np.uint8), bitorder="little", count=len(signs)).astype(np.int64) for v in (plus, minus))
    return len(text) + np.add.reduceat(up - down, starts)


#: Bytes of KEYS keys. A payload is the SimHash, the keys, and the line behind a byte that says how many times KEYS they are.
WIDE = 2 * BINS
#: Classes of characters that are counted to tell unlike lines apart.
SIGNS = 32


def matcher(similarity: float, most: int = BITS):
    """Links of (SimHash, keys, line) payloads that meet in a key within ``most`` bits and are like enough, enough to connect all.

    A line is compared with the likest one before it, then with ever more at a time of those not yet in its group. Lines
    whose counts of characters differ by more than the edits allowed are unlike without a comparison.
    """

    def alike(a: bytes, b: bytes) -> bool:
        """Whether two payloads meet and are like enough."""
        bits = (int.from_bytes(a[:8], "little") ^ int.from_bytes(b[:8], "little")).bit_count()
        chunks = lambda p, i: [p[j : j + 2 * EACH] for j in range(9 + i * WIDE, 9 + (i + 1) * WIDE, 2 * EACH)]
        if bits > most or not any(x == y for x, y in zip(chunks(a, 0), chunks(b, 0))):
            if a[8] < 2 or b[8] < 2 or set(chunks(a, 1)).isdisjoint(chunks(b, 1)):
                return False
        x, y = (p[9 + WIDE * p[8] :].decode() for p in (a, b))
        allowed = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
        if abs(len(x) - len(y)) > allowed:
            return False
        if script_cost(y, x, allowed) <= allowed:
            return True
        one, two = (np.bincount(np.frombuffer(v.encode("utf-32-le"), np.uint32) % SIGNS, minlength=SIGNS) for v in (x, y))
        change = one - two
        if max(change[change > 0].sum(), -change[change < 0].sum()) > allowed:
            return False
        return script_cost(y, x, allowed, *AGAIN) <= allowed or edit_distance(y, x, allowed) <= allowed

    def match(payloads: list[bytes]) -> Iterator[tuple[int, int]]:
        if len(payloads) == 2:  # most groups
            if alike(*payloads):
                yield 0, 1
            return
        sims = np.array([int.from_bytes(p[:8], "little") for p in payloads], np.uint64)
        keys = whole_keys(b"".join(p[9 : 9 + WIDE] for p in payloads))
        further = [whole_keys(p[9 + WIDE : 9 + 2 * WIDE])[0].tolist() if p[8] > 1 else () for p in payloads]
        by_key: dict[int, list[int]] = {}  # short lines seen, by key
        strings = [p[9 + WIDE * p[8] :].decode() for p in payloads]
        sizes = np.array([len(s) for s in strings])
        counts = np.stack([np.bincount(np.frombuffer(s.encode("utf-32-le"), np.uint32) % SIGNS, minlength=SIGNS) for s in strings]).astype(np.int32)
        label = np.arange(len(payloads))

        def link(me: int, other: int) -> tuple[int, int]:
            a, b = sorted((int(label[me]), int(label[other])))
            label[label == b] = a
            return other, me

        def meets(me: int) -> set[int]:
            found = set()
            for k in set(further[me]):
                seen = by_key.setdefault(k, [])
                found.update(seen)
                seen.append(me)
            return found

        for me in range(len(payloads)):
            near = np.flatnonzero(np.bitwise_count(sims[:me] ^ sims[me]) <= most)
            near = near[(keys[near] == keys[me]).any(1)]
            if further[me]:
                near = np.union1d(near, np.array(list(meets(me)), np.int64))
            allowed = ((1 - similarity) * np.maximum(sizes[near], sizes[me]) + 1e-9).astype(np.int64)
            change = counts[near] - counts[me]
            maybe = np.maximum(np.maximum(change, 0).sum(1), np.maximum(-change, 0).sum(1)) <= allowed
            near, allowed = near[maybe], allowed[maybe]
            order = np.argsort(np.bitwise_count(sims[near] ^ sims[me]), kind="stable")
            near, allowed = near[order], allowed[order]
            take = 1
            while len(near):
                rest = []
                for other, edits in zip(near[:take].tolist(), allowed[:take].tolist()):
                    if label[other] != label[me]:
                        if script_cost(strings[me], strings[other], edits) <= edits:
                            yield link(me, other)
                        else:
                            rest.append((other, edits))
                rest = [(other, edits) for other, edits in rest if label[other] != label[me]]
                if len(rest) > 2:
                    found = distances(strings[me], [strings[o] for o, _ in rest])
                else:  # a script's cost does as well as the distance, if that is small enough
                    found = [script_cost(strings[me], strings[o], e, *AGAIN) for o, e in rest]
                    found = [f if f <= e else edit_distance(strings[me], strings[o], e) for f, (o, e) in zip(found, rest)]
                for (other, edits), distance in zip(rest, found):
                    if distance <= edits and label[other] != label[me]:
                        yield link(me, other)
                near, allowed, take = near[take:], allowed[take:], min(4 * take, 256)
                left = label[near] != label[me]
                near, allowed = near[left], allowed[left]

    return match


def places(table: DataFrame) -> tuple[Column, Column, Column]:
    """A column that orders the rows of ``table`` by (doc, line), and the doc and the line of such a value, named place.

    Whole numbers are packed into one decimal: Spark takes the least of those by hashing, that of a struct by sorting.
    """
    kind = table.schema["doc"].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.struct("doc", "line"), F.col("place.doc"), F.col("place.line")
    room = F.lit(1 << 31).cast("decimal(10,0)")
    pack = (F.col("doc").cast("decimal(19,0)") * room + F.col("line").cast("decimal(10,0)")).cast("decimal(31,0)")
    line = F.pmod(F.col("place"), room)
    return pack, ((F.col("place") - line) / room).cast(kind), line.cast("int")


def wanted_lines(docs: DataFrame, doc_id: str, wanted: DataFrame, min_words: int) -> DataFrame:
    """(id, payload) of the lines named by ``wanted`` (doc, line): node; SimHash, keys and normalised line.

    All is found from the text again: far fewer lines are wanted than there are, and so only their places travel.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            flat, starts = lines(texts(piece))
            wants = piece.column("wants")
            text, line = np.repeat(np.arange(len(wants)), pc.list_value_length(wants).to_numpy()), wants.flatten().to_numpy()
            there = line < np.diff(starts)[text]  # not in each of the rows that repeat a doc_id
            _, found, at = normal_lines(flat.take(pa.array((starts[text] + line)[there])))
            h, take = spelled_words(found), np.flatnonzero(np.diff(at) >= min_words)
            sim, _, keys = sketches(found, h, at, take)
            words_, at_ = found.to_pylist(), at.tolist()
            out = [s.tobytes() + bytes([len(k) // WIDE]) + k + " ".join(words_[at_[x] : at_[x + 1]]).encode() for s, k, x in zip(sim, keys.to_pylist(), take.tolist())]
            yield pa.RecordBatch.from_arrays([binaries(np.arange(len(take) + 1) * 2, digests(h, at)[take].ravel()), pa.array(out, pa.binary())], names=["id", "payload"])

    per_doc = wanted.groupBy("doc").agg(F.collect_list("line").alias("wants"))
    chosen = docs.select(F.col(doc_id).alias("doc"), "text")
    return chosen.join(per_doc.hint("shuffle_hash"), "doc").select("text", "wants").mapInArrow(run, "id binary, payload binary").dropDuplicates(["id"])


def removals(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", min_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc, gone): for each document with any, the numbers of the lines that occur earlier in their group."""
    min_words = max(min_words, 1)
    table = save(spark, line_table(docs, doc_id, min_words), "lines")
    pack, doc, line = places(table)
    nodes = table.groupBy("node").agg(F.min(pack).alias("place"), F.min("sim").alias("sim"), F.count("*").alias("n"))
    nodes = save(spark, nodes, "line-nodes")
    near = components(spark, near_sketches(table, similarity), "sketches")
    alone = nodes.where("sim is not null").groupBy("sim").agg(F.count("*").alias("nodes")).where("nodes > 1").select("sim", F.col("sim").alias("root"))
    grouped = near.select(F.col("node").alias("sim"), "root").unionAll(near.select(F.col("root").alias("sim"), "root")).unionAll(alone)
    roots = grouped.groupBy("sim").agg(F.min("root").alias("root"))  # a group's root is its least sketch
    members = save(spark, nodes.join(roots.hint("shuffle_hash"), "sim").select("node", "root", "place"), "line-members")
    found = linked(spark, members.select("node", "root"), wanted_lines(docs, doc_id, members.select(doc.alias("doc"), line.alias("line")), min_words), matcher(similarity), "near-lines")
    found = found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())  # a root with one occurrence counts too
    grouped = nodes.join(found.hint("shuffle_hash"), "node", "left").where("n > 1 or root is not null")
    grouped = save(spark, grouped.select("node", F.coalesce("root", "node").alias("root"), "place", "n"), "line-groups")
    firsts = grouped.groupBy("root").agg(F.min("place").alias("first"), F.sum("n").alias("n")).where("n > 1")
    again = grouped.select("node", "root").join(firsts.select("root", "first"), "root").select("node", "first")
    gone = table.select("doc", "line", "node").join(again.hint("shuffle_hash"), "node").where(pack != F.col("first"))
    out = save(spark, gone.groupBy("doc").agg(F.collect_set("line").alias("gone")), "gone-lines")
    drop(spark, table, nodes, members, grouped)
    return out


def dedup(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", min_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """All rows and columns of ``docs`` with the removed lines cut from text, and n_lines and n_removed (of the input)."""
    gone = removals(spark, docs, doc_id, min_words, similarity).select(F.col("doc").alias("_doc"), F.col("gone").alias("_gone"))
    held = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    split = F.split("text", "\n", -1)
    out = docs.select(*held).join(gone.hint("shuffle_hash"), F.col(doc_id) == F.col("_doc"), "left")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains("_gone", i.cast("int"))), "\n")
    text = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)
    return out.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in held),
        F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
