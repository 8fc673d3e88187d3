"""Toxicity grades by cumulative-link ordinal regression over sparse word features.

P(grade <= k) = logistic(cut_k - w.x), with one weight per feature (a word or the
beginning of one) for all thresholds, and ordered cuts. The model is fitted on the driver from a
bounded sample of labelled rows (``SAMPLE``), of which it gets the chosen features only; every
document is scored where it lies, against the model's word table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.llm import words as W
from pulsemill.session import materialize

#: labelled documents that a model is fitted on, at most
SAMPLE = 10_000
#: words that stand for themselves in a model, at most; a word must be in so many documents
MOST_WORDS, LEAST_DOCS = 50_000, 5
#: deviations above chance at which a word's share of toxic documents makes it a feature
SIGNIFICANT = 6.0
GRADES = 3
#: besides whole words, their beginnings of so many bytes are features: inflected forms share them
BEGINNINGS = (4, 5, 6)


def features(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the document of each, without repeats, by document."""
    hashes, at = [words.hash], [np.arange(len(words.hash))]
    for n in BEGINNINGS:
        found, where = words.prefix(n)
        hashes.append(found)
        at.append(where)
    hashes, doc = np.concatenate(hashes), words.doc[np.concatenate(at)]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


@dataclass
class Model:
    """``words`` are sorted hashes; ``cuts`` ascend, one fewer than there are grades."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -60, 60)))

    def scores(self, words: W.Words) -> np.ndarray:
        """Sum of the weights of the distinct known features of each document."""
        n = len(words.first) - 1
        if not len(self.words):
            return np.zeros(n)
        hashes, docs = [words.hash], [words.doc]
        for size in BEGINNINGS:
            found, where = words.prefix(size)
            hashes.append(found)
            docs.append(docs[0][where])
        pairs = []
        for found, doc in zip(hashes, docs, strict=True):
            at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
            known = np.flatnonzero(self.words[at] == found)
            pairs.append(doc[known] * len(self.words) + at[known])
        pair = np.unique(np.concatenate(pairs))
        return np.bincount(pair // len(self.words), self.weights[pair % len(self.words)], n)


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(label, features): distinct features of up to ``sample`` labelled documents, picked by hash of the id.

    Ids without a label, null ids and null labels are left out; of a repeated label the
    largest counts, of a repeated id the smallest text. The table is written.
    """
    picked = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # ``sample`` rows of two numbers
    met = met.groupBy("doc_id", "_toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            found, doc = features(W.find(part.column("text"), W.ALNUM, W.LOWER))
            own = W.lists(W.as_long(found), np.bincount(doc, minlength=part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_toxic").cast(pa.int64()), own], ["doc_id", "label", "features"])

    return materialize(met.mapInArrow(W.tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, label long, features array<long>"))


def choose_words(rows: DataFrame) -> np.ndarray:
    """Features found in toxic documents far more often than the share of toxic documents explains.

    They are counted on the executors; those chosen, ``MOST_WORDS`` at most, come to the driver.
    """
    n_docs, n_bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))).first()
    if not 0 < n_bad < n_docs:
        return np.zeros(0, np.uint64)
    base = n_bad / n_docs
    counts = rows.select((F.col("label") > 0).cast("long").alias("bad"), F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")
    )
    z = (F.col("bad") - base * F.col("n")) / F.sqrt(F.col("n") * (base * (1 - base)))
    best = counts.where(F.col("n") >= LEAST_DOCS).select("feature", z.alias("z")).where(F.col("z") >= SIGNIFICANT)
    found = best.orderBy(F.col("z").desc(), "feature").limit(MOST_WORDS).toArrow()["feature"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def held(rows: DataFrame, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels of the sampled documents, by id, and which of ``words`` each holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("features")
            flat = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy(zero_copy_only=False))]).astype(np.int64)
            known = np.isin(flat, words)
            kept = [flat[a:b][known[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(kept, pa.binary())], ["doc_id", "label", "words"])

    found = rows.mapInArrow(W.tidy(run), rows.select("doc_id", "label").schema.add("words", "binary")).toArrow().sort_by("doc_id")
    return found["label"].to_numpy(), [np.frombuffer(x, np.uint64) for x in found["words"].to_pylist()]


def severity(labels: np.ndarray, docs: list[np.ndarray], words: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades for rows labelled 0 or 1: toxic rows are cut into grades 1, 2, ... at equal shares
    of the number of significant features they hold. Labels that are grades already (above 1)
    are kept."""
    if not len(labels) or labels.max() > 1 or grades < 3:
        return labels
    held = np.array([np.isin(d, words, assume_unique=True).sum() for d in docs])
    bad = np.flatnonzero(labels > 0)
    out = labels.copy()
    if len(bad):
        inner = np.quantile(held[bad], np.arange(1, grades - 1) / (grades - 1))
        out[bad] = 1 + np.searchsorted(inner, held[bad], "left")
    return out


def fit(grades: np.ndarray, docs: list[np.ndarray], words: np.ndarray, *, ridge: float = 1e-5, steps: int = 400) -> Model:
    """Maximum likelihood with a ridge on the weights, by full-batch Adam; deterministic."""
    top = int(grades.max()) if len(grades) else 0
    if top == 0 or not len(words):
        rate = float(np.mean(grades > 0)) if len(grades) else 0.0
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(words[:0], np.zeros(0), np.array([np.log((1 - rate) / rate)]))
    rows = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    flat = np.concatenate(docs)
    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    real = words[at] == flat
    rows, at = rows[real], at[real]
    n = len(docs)
    shares = np.array([np.mean(grades > k) for k in range(top)]).clip(1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(np.log((1 - shares) / shares) + 1e-2 * np.arange(top))
    x = np.concatenate([np.zeros(len(words)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    one = np.eye(top + 2)[grades]  # grade k lies between cut k-1 and cut k; the outer cuts are infinite
    for t in range(1, steps + 1):
        w, first, gaps = x[: len(words)], x[len(words)], np.exp(x[len(words) + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[at], n)
        below = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -60, 60)))  # P(grade <= k)
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        p = np.maximum((edge[:, 1:] * one[:, : top + 1]).sum(1) - (edge[:, :-1] * one[:, : top + 1]).sum(1), 1e-12)
        up = (slope[:, 1:] * one[:, : top + 1]) / p[:, None]
        low = (slope[:, :-1] * one[:, : top + 1]) / p[:, None]
        d_cuts = (low[:, 1:] - up[:, :-1]).mean(0)  # of the mean negative log likelihood
        d_score = (up - low).sum(1)
        g_w = np.bincount(at, d_score[rows], len(words)) / n + ridge * w
        tail = np.cumsum(d_cuts[::-1])[::-1]
        g = np.concatenate([g_w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cuts = x[len(words)] + np.concatenate([[0.0], np.cumsum(np.exp(x[len(words) + 1 :]))])
    return Model(words, x[: len(words)], cuts)


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, grades: int = GRADES) -> Model:
    """A model from (doc_id, toxic) labels of ``docs``. Without labels, or with one kind of
    them only, it gives every document the same severity."""
    rows = sampled(docs, labels, sample)
    words = choose_words(rows)
    label, own = held(rows, words)
    return fit(severity(label, own, words, grades), own, words)


def grade(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_severity``, ``grade`` (the likeliest) and ``toxic`` (severity of ``least`` or more).

    Whole texts are read; null and empty ones have no words and get the model's base
    severity. Rows are independent of each other; columns with the names of results are
    replaced and others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["expected_severity", "grade", "toxic"]
    kept = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in W.slices(batches, text):
            above = own.at_least(own.scores(W.find(part.column(text), W.ALNUM, W.LOWER)))
            n = part.num_rows
            mass = np.concatenate([np.ones((n, 1)), above], axis=1) - np.concatenate([above, np.zeros((n, 1))], axis=1)
            mean = above.sum(1)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(mean), pa.array(mass.argmax(1)), pa.array(mean >= least)], [*kept, *added]
            )

    schema = docs.select(*kept).schema.add("expected_severity", "double").add("grade", "long").add("toxic", "boolean")
    return docs.mapInArrow(W.tidy(run), schema)
