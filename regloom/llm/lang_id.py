"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit a binary classifier over hashed letter trigrams (log odds of the
languages whose bit is 1 against the others; a trigram is of UTF-8 bytes, so about a letter and a half beyond ASCII) gives a margin; the codeword with the least logistic loss over all
margins is the prediction, and a small lead over the second marks it as ambiguous.

Defined results: null texts and texts without a letter give ``und`` with score 0. Rows with a null language never
train, whatever their id. Repeated rows train as often as they occur; equal losses go to the first language by name; an
empty table gives no rows. Without any training row every prediction is ``und``. Very long
texts are read whole. Input columns named like an output column give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import with_columns
from .text import FOLD, mapped, raw, slices, texts

BUCKETS = 1 << 15
_LETTERS = FOLD.copy()
_LETTERS[48:58] = 0x20


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # bits x (BUCKETS + 1); the last bucket weighs nothing


def trigrams(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for the trigram at each byte of the lower-cased, space-padded texts; BUCKETS where there is none."""
    padded = mapped(pc.binary_join_element_wise(" ", pc.utf8_lower(strings), " ", ""), _LETTERS)
    offs, data = raw(padded)
    code = data.astype(np.uint32)
    three = np.zeros(len(data), np.uint32)
    three[:-2] = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    bucket = ((three * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)
    none = three == 0x202020
    none[offs[1:] - 1] = True
    none[offs[1:] - 2] = True
    bucket[none] = BUCKETS
    return bucket, offs


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of -1 and 1: all splits of up to five languages, else the best of 64 seeded random codes."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([[1] + [1 if (j >> i) & 1 else -1 for i in range(n - 1)] for j in range(2 ** (n - 1) - 1)]).T
    bits, rng, best, most = max(10, math.ceil(6 * math.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.integers(0, 2, (n, bits)) * 2 - 1
        if (abs(code.sum(0)) == n).any():
            continue
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if least > most:
            best, most = code, least
    return best


def counts(docs: DataFrame, language: str) -> DataFrame:
    """(lang, bucket, n): trigrams of all labelled texts, summed first in each task; bucket -1 counts documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        size: dict[str, int] = {}
        for piece in slices(batches):
            langs = piece.column(language).to_pylist()
            bucket, offs = trigrams(texts(piece))
            names = sorted(set(langs))
            at = np.searchsorted(names, langs)
            flat = np.bincount(np.repeat(at, np.diff(offs)) * (BUCKETS + 1) + bucket, minlength=len(names) * (BUCKETS + 1))
            for i, name in enumerate(names):
                total[name] = total.get(name, 0) + flat[i * (BUCKETS + 1) : (i + 1) * (BUCKETS + 1) - 1]
                size[name] = size.get(name, 0) + int((at == i).sum())
        for name, row in total.items():
            full = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(full) + 1), pa.string()), pa.array(np.append(full, -1).astype(np.int32)), pa.array(np.append(row[full], size[name]).astype(np.int64))], names=["lang", "bucket", "n"])

    part = docs.where(F.col(language).isNotNull()).select(F.col(language).cast("string").alias(language), "text")
    return part.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, language: str = "lang", smoothing: float = 0.5) -> Model:
    """Train on every row of ``docs`` with a language; every language found is learned.

    What reaches the driver is at most BUCKETS + 1 sums for each language, whatever the input's size.
    """
    table = counts(docs, language).persist()
    names = sorted(r.lang for r in table.where("bucket = -1").select("lang").collect())
    got = table.where("bucket >= 0").toPandas() if names else None
    table.unpersist()
    codes = codewords(len(names))
    freq = np.full((len(names), BUCKETS), smoothing)
    if got is not None and len(got):
        np.add.at(freq, (np.searchsorted(names, got.lang.to_numpy(dtype=str)), got.bucket.to_numpy()), got.n.to_numpy())
    freq /= freq.sum(1, keepdims=True)
    weights = np.zeros((codes.shape[1], BUCKETS + 1), np.float32)
    for b in range(codes.shape[1]):
        weights[b, :BUCKETS] = np.log(freq[codes[:, b] > 0].mean(0)) - np.log(freq[codes[:, b] < 0].mean(0))
    return Model(names, codes, weights)


def decode(model: Model, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword, its probability and its lead, by logistic loss of margins that count more with more trigrams."""
    scaled = margins * (2 * np.sqrt(np.minimum(n, 400)))[:, None]
    loss = np.logaddexp(0, -scaled[:, None, :] * model.codes[None]).sum(2) * 2 / max(1, model.codes.shape[1])
    likely = np.exp(loss.min(1, keepdims=True) - loss)
    likely /= likely.sum(1, keepdims=True)
    best = likely.argmax(1)
    ranked = np.sort(likely, 1)
    return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if likely.shape[1] > 1 else 0)


def identify(docs: DataFrame, model: Model, keep: list[str], ambiguous_below: float = 0.2) -> DataFrame:
    """``keep`` columns and lang_pred, score (0 to 1), ambiguous of every row."""

    def step(piece: pa.RecordBatch) -> dict:
        strings = texts(piece)
        letter = pc.match_substring_regex(strings, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
        if not model.languages:
            return {"lang_pred": ["und"] * len(strings), "score": np.zeros(len(strings)), "ambiguous": np.ones(len(strings), bool)}
        bucket, offs = trigrams(strings)
        n = np.add.reduceat((bucket < BUCKETS).astype(np.int64), offs[:-1])
        total = np.stack([np.add.reduceat(w[bucket], offs[:-1]) for w in model.weights], 1) if len(model.weights) else np.zeros((len(n), 0))
        best, score, lead = decode(model, total / np.maximum(n, 1)[:, None], n)
        name = np.where(letter, np.array(model.languages, object)[best], "und")
        return {"lang_pred": pa.array(name, pa.string()), "score": np.where(letter, score, 0.0), "ambiguous": ~letter | (lead < ambiguous_below)}

    return with_columns(docs, keep, "lang_pred string, score double, ambiguous boolean", step)


def hold_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
