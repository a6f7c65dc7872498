"""Quality rules as a short-circuit cascade.

Each rule is a test on counts of one text. Cost and rejection of every rule are measured on a bounded sample; rules
then run by rejection per cost, each only on the texts that all earlier rules let pass. The verdict does not depend
on the order, only the work does.

Defined results: a null text counts as an empty one and is rejected as too short; ids are not looked at; repeated rows are judged each on
their own; texts are read whole; an empty table gives no rows and keeps the given order of rules. Input columns named
like an output column give way to it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import with_columns
from .text import SEP, covered, lines, raw, spans, sums, texts, words

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


class Page:
    """Counts of a piece of the text column, each computed when first asked for."""

    def __init__(self, strings: pa.Array):
        self.strings = strings
        self.offs, self.data = raw(strings)

    def bytes_in(self, which: np.ndarray) -> np.ndarray:
        return sums(which[self.data], self.offs)

    @cached_property
    def words(self) -> tuple[pa.Array, np.ndarray]:
        return words(self.strings)

    @cached_property
    def n_words(self) -> np.ndarray:
        begins = ~SEP[self.data]
        begins[1:] &= SEP[self.data[:-1]] | np.isin(np.arange(1, len(self.data)), self.offs) if len(self.data) > 1 else True
        return sums(begins, self.offs)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.bytes_in(_LEAD & ~SEP)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.bytes_in(_SYMBOL)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.bytes_in(_UPPER)

    @cached_property
    def n_alpha(self) -> np.ndarray:
        return self.bytes_in(_ALPHA)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        flat, starts = lines(self.strings)
        offs, data = raw(flat)
        full = sums(~SEP[data], offs) > 0
        ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        key = ((text << 32) | ids)[full]
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        dup = np.zeros(len(full), bool)
        dup[np.flatnonzero(full)[again]] = True
        return sums(full, starts), sums(dup, starts)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        flat, starts = self.words
        coded = flat.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint64)
        first, text = spans(starts, 3)
        if not len(first):
            return np.zeros(len(starts) - 1, np.int64)
        two = np.unique((ids[first] << np.uint64(32)) | ids[first + 1], return_inverse=True)[1].astype(np.uint64)
        key = (two << np.uint64(32)) | ids[first + 2]  # numbers of words, not hashes: exact at any size of a text
        order = np.lexsort((key, text))
        same = (key[order[1:]] == key[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        twice = np.zeros(len(first), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        hit = first[twice]
        return sums(covered(len(flat), hit, hit + 3), starts)


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` is true of its page."""

    name: str
    fails: Callable[[Page], np.ndarray]


BASE = [
    Rule("too_short", lambda p: p.n_words < 50),
    Rule("repeated_words", lambda p: 100 * p.n_repeat_words > 50 * p.n_words),
]
RULES = [
    *BASE,
    Rule("symbols", lambda p: 10 * p.n_symbols > p.n_words),
    Rule("repeated_lines", lambda p: 2 * p.n_dup_lines > p.n_lines),
    Rule("word_length", lambda p: (10 * p.word_chars < 25 * p.n_words) | (p.word_chars > 12 * p.n_words)),
    Rule("shouting", lambda p: 2 * p.n_upper > p.n_alpha),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plan(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = 1000) -> list[str]:
    """Rule names by rejection per cost on ``sample_rows`` texts of least hash, of all files. It changes the work, no verdict.

    Greedy: the next rule is the one that rejects most, per second, of what the rules chosen so far let pass.
    """
    rows = docs.select("text").orderBy(F.xxhash64("text")).limit(sample_rows).toArrow().column("text").combine_chunks()
    strings = pc.fill_null(rows.cast(pa.string()), "")
    if not len(strings):
        return [r.name for r in rules]
    bad, cost = [], []
    for rule in rules:
        began = time.perf_counter()
        bad.append(rule.fails(Page(strings)).astype(bool))
        cost.append(time.perf_counter() - began)
    return ordered([r.name for r in rules], np.array(bad), cost)


def ordered(names: list[str], bad: np.ndarray, cost: list[float]) -> list[str]:
    """Names of rules (rows of ``bad``: which texts each rejects) by rejection per cost given the earlier ones."""
    left, alive, out = list(range(len(names))), np.ones(bad.shape[1], bool), []
    while left:
        best = max(left, key=lambda i: ((bad[i] & alive).mean() + 1e-6) / max(cost[i], 1e-9))
        out.append(names[best])
        alive &= ~bad[best]
        left.remove(best)
    return out


def cascade(strings: pa.Array, rules: list[Rule], known: dict | None = None) -> np.ndarray:
    """Index of the first rule that each text fails, or -1; a rule sees only what passed the earlier ones.

    ``known``: counts of the texts that need not be made again, by the page's names.
    """
    failed = np.full(len(strings), -1, np.int64)
    alive, page, seen = np.arange(len(strings)), Page(strings), np.arange(len(strings))
    vars(page).update(known or {})
    for i, rule in enumerate(rules):
        if not len(alive):
            break
        if len(alive) < 0.8 * len(seen):  # fewer texts left: count only those anew
            page, seen = Page(strings.take(pa.array(alive))), alive
            vars(page).update({k: tuple(x[alive] for x in v) if isinstance(v, tuple) else v[alive] for k, v in (known or {}).items()})
        bad = np.zeros(len(strings), bool)
        bad[seen] = rule.fails(page)
        failed[alive[bad[alive]]] = i
        alive = alive[~bad[alive]]
    return failed


def assess(docs: DataFrame, keep: list[str], rules: list[Rule] = RULES, order: list[str] | None = None, counts: bool = False) -> DataFrame:
    """``keep`` columns, kept, failed_rule (null if kept) and, if asked for, the base counts and base_failed of all rows.

    With ``counts`` the base rules are read off those counts and the cascade runs on what they let pass.
    """
    by_name = {r.name: r for r in rules}
    chosen = [by_name[n] for n in order] if order else list(rules)
    base = {r.name for r in BASE}

    def step(piece: pa.RecordBatch) -> dict:
        strings = texts(piece)
        out, failed, names = {}, np.full(len(strings), -1, np.int64), [r.name for r in chosen]
        if counts:
            page = Page(strings)
            out = {c: getattr(page, c).astype(np.int64) for c in COUNTS}
            bad = [r.fails(page) for r in BASE]
            out["base_failed"] = np.logical_or.reduce(bad)
            rest = [r for r in chosen if r.name not in base]
            passed = np.flatnonzero(~out["base_failed"])
            names = [r.name for r in BASE] + [r.name for r in rest]
            known = {c: getattr(page, c)[passed] for c in ("n_words", "word_chars", "n_symbols")} | {"_lines": tuple(x[passed] for x in page._lines)}
            got = cascade(strings.take(pa.array(passed)), rest, known)
            failed[passed] = np.where(got >= 0, got + len(BASE), -1)
            for i in reversed(range(len(BASE))):
                failed[bad[i]] = i
        else:
            failed = cascade(strings, chosen)
        out["kept"] = failed < 0
        out["failed_rule"] = pa.array([names[i] if i >= 0 else None for i in failed], pa.string())
        return out

    added = "".join(f"{c} long, " for c in COUNTS) + "base_failed boolean, " if counts else ""
    return with_columns(docs, keep, added + "kept boolean, failed_rule string", step)
