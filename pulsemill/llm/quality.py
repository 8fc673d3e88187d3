"""Quality rules as a short-circuit cascade, ordered by rejections per unit of cost.

Each rule gets a ``Page`` (the words of a slice of documents) and the documents that are
still in, and says which of them it rejects. Once ``FAIR`` of a page's documents are out, the
page is made anew of the others, so that what is rejected costs nothing later. Cost and
selectivity of every rule are measured on a sample of about ``SAMPLE`` documents, each rule
alone, so that it pays for counts that rules of a cascade share; the verdict does not depend
on the order, only the time does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.llm import words as W

#: documents on which rules are measured, about
SAMPLE = 2000
#: share of a page's documents whose rejection is worth finding the words of the others again
FAIR = 0.25
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Page:
    """Counts of a slice of documents, each made when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.words = W.find(texts)
        self.n_words = self.words.count

    def per_doc(self, table: np.ndarray) -> np.ndarray:
        """Bytes of ``table`` in each whole text."""
        return np.diff(_sums(table[self.words.data])[self.words.bounds])

    def words_with(self, table: np.ndarray) -> np.ndarray:
        """Words of each document that have a byte of ``table``."""
        w, at = self.words, _sums(table[self.words.data])
        return np.diff(_sums(at[w.end] > at[w.start])[w.first])

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in words."""
        w = self.words
        at = _sums((w.data & 0xC0) != 0x80)
        return np.diff(_sums(at[w.end] - at[w.start])[w.first])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.per_doc(SYMBOLS)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word: how many, and how many equal an earlier one."""
        lines = W.find(self.texts, _LINE)
        filled = _sums(W.NOT_SPACE[lines.data])
        real = filled[lines.end] > filled[lines.start]
        doc, n = lines.doc[real], len(self.n_words)
        key = lines.hash[real] ^ W.mix(doc.astype(np.uint64) + np.uint64(1))
        first = np.unique(key, return_index=True)[1]
        total = np.bincount(doc, minlength=n)
        return total, total - np.bincount(doc[first], minlength=n)

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    def repeated(self, alive: np.ndarray) -> np.ndarray:
        """Words in 3-word windows that stand twice or more in their text."""
        w = self.words
        grams, valid = W.grams(w, 3)
        doc = w.doc
        at = np.flatnonzero(valid & alive[doc[: len(valid)]])
        key = grams[at] ^ W.mix(doc[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = np.zeros(len(doc) + 2, bool)
        for j in range(3):
            hit[at[twice] + j] = True
        return np.diff(_sums(hit[: len(doc)])[w.first])


Rule = Callable[[Page, np.ndarray], np.ndarray]
#: rules of the contract: a text with fewer words, or with more repeated words in a hundred, fails
BASE: dict[str, Rule] = {
    "few_words": lambda p, alive: p.n_words < 50,
    "repeats": lambda p, alive: 100 * p.repeated(alive) > 50 * p.n_words,
}
#: further rules; a clean text stays clear of each by a wide margin
RULES: dict[str, Rule] = {
    "word_length": lambda p, alive: (p.word_chars < 2 * p.n_words) | (p.word_chars > 15 * p.n_words),
    "symbols": lambda p, alive: 100 * p.n_symbols > 20 * p.n_words,
    "dup_lines": lambda p, alive: 100 * p.n_dup_lines > 40 * p.n_lines,
    "capitals": lambda p, alive: 100 * _in_capitals(p) > 60 * p.n_words,
    "no_letters": lambda p, alive: 100 * p.words_with(_LETTER) < 60 * p.n_words,
    "digits": lambda p, alive: 100 * p.words_with(_DIGIT) > 50 * p.n_words,
}


def _in_capitals(page: Page) -> np.ndarray:
    """Words with two capitals of A-Z at least that make up over half of their letters' bytes."""
    w = page.words
    upper, letters = _sums(_UPPER[w.data]), _sums(_LETTER[w.data])
    caps = upper[w.end] - upper[w.start]
    shout = (caps > 1) & (2 * caps > letters[w.end] - letters[w.start])
    return np.diff(_sums(shout)[w.first])


def run_cascade(page: Page, rules: list[tuple[str, Rule]]) -> tuple[np.ndarray, list[tuple[str, int, int, float]]]:
    """What every document fails first (-1: nothing), and each rule's documents, rejections and seconds."""
    failed = np.full(len(page.n_words), -1)
    rows = np.arange(len(failed))  # the page's documents
    seen = []
    for i, (name, rule) in enumerate(rules):
        began = time.process_time()
        alive = failed[rows] < 0
        if alive.any() and np.mean(alive) <= 1 - FAIR:
            page, rows = Page(page.texts.take(pa.array(np.flatnonzero(alive)))), rows[alive]
            alive = np.ones(len(rows), bool)
        bad = alive & rule(page, alive) if alive.any() else np.zeros_like(alive)
        seen.append((name, int(alive.sum()), int(bad.sum()), time.process_time() - began))
        failed[rows[bad]] = i
    return failed, seen


def measure(docs: DataFrame, rules: dict[str, Rule], sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """(rule, docs, rejected, seconds): each rule alone, on about ``sample`` documents picked by hash."""
    every = max(1, docs.count() // max(1, sample))
    picked = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text):
            rows = []
            for name, rule in rules.items():
                page = Page(part.column(text))  # anew, so that each rule pays for its own counts
                rows += run_cascade(page, [(name, rule)])[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c)) for c in zip(*rows, strict=True)], ["rule", "docs", "rejected", "seconds"]
            )

    found = picked.mapInArrow(run, "rule string, docs long, rejected long, seconds double")
    return found.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("docs", "rejected", "seconds")))


def ordered(measured: DataFrame, rules: dict[str, Rule]) -> list[str]:
    """Rule names, most rejections per second first; one row per rule comes to the driver."""
    rate = {r["rule"]: (r["rejected"] / max(1, r["docs"])) / max(r["seconds"], 1e-9) for r in measured.collect()}
    return sorted(rules, key=lambda name: -rate.get(name, 0.0))


def assess(docs: DataFrame, rules: dict[str, Rule] | None = None, *, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """``docs`` with counts, ``base_failed``, ``failed_rule`` (null: none) and ``kept``.

    Every document gets the counts; the cascade runs over those that pass the base rules.
    Null and empty texts have no words and fail. Rows are independent of each other, so
    repeated rows get equal results; other columns pass through, unless they bear the name
    of a result, which then replaces them. An empty table stays empty.
    """
    rules = RULES if rules is None else rules
    order = ordered(measure(docs, rules, sample, text), rules)
    chain = [(name, rules[name]) for name in order]
    added = {
        "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
        "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "failed_rule": pa.string(), "kept": pa.bool_(),
    }
    kept = [c for c in docs.columns if c not in added]
    names = pa.array([*order, None], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text):
            page = Page(part.column(text))
            everyone = np.ones(part.num_rows, bool)
            repeats = page.repeated(everyone)
            base = (page.n_words < 50) | (100 * repeats > 50 * page.n_words)
            alive = np.flatnonzero(~base)
            failed = np.full(part.num_rows, -1)
            if len(alive):
                own = page if len(alive) == part.num_rows else Page(part.column(text).take(pa.array(alive)))
                failed[alive] = run_cascade(own, chain)[0]
            columns = [
                page.n_words, page.word_chars, page.n_symbols, page.n_dup_lines, repeats, base,
                names.take(pa.array(np.where(failed < 0, len(order), failed))), ~base & (failed < 0),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), *(pa.array(c).cast(k) for c, k in zip(columns, added.values(), strict=True))],
                [*kept, *added],
            )

    schema = docs.select(*kept).schema
    for name, kind in added.items():
        schema = schema.add(name, {"int64": "long", "bool": "boolean"}.get(str(kind), "string"))
    return docs.mapInArrow(run, schema)
