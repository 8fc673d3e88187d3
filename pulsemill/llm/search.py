"""Ranked lexical search: a set of query texts against all documents.

Documents are indexed for the terms of a block of queries (at most ``BLOCK_TERMS`` terms
or ``BLOCK_ITEMS`` queries, or one query): per document its length and how often it holds
each of these terms. The counts behind the weights are sums over the whole index. Each task
then inverts bounded pieces of the index and ranks every query by accumulators, a term at
a time and the rarest first. Once the bounds of the terms that are left cannot lift a new
document to the k-th best score known (the partial scores here, or whole scores of earlier
pieces), no accumulator is added and the remaining terms update the existing ones only.
The rankings of all pieces are merged; scores are exact integers, whatever the pieces.

A term is a longest run of digits, letters a-z (after lower-casing A-Z) and characters
beyond ASCII. Null and empty texts have no terms: such documents are not counted and such
queries have no rows. Repeated rows are documents, and queries, of their own. Equal scores
go by ascending doc_id, a null one last. Without documents or queries there are no rows.
Columns that are not named are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsemill.llm import words
from pulsemill.session import materialize

BLOCK_TERMS = 1 << 17
BLOCK_ITEMS = 4096
#: postings that a task inverts at once; a document is never cut
PIECE = 1 << 20
#: first merge of the tasks' rankings
SALTS = 64


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents with a score for each item.

    ``docs`` has doc_id (integer) and text, ``items`` has item_id and text.
    """
    queries = materialize(
        items.select("item_id", F.monotonically_increasing_id().alias("item"), "text")
        .mapInArrow(_query_terms, "item_id " + dict(items.dtypes)["item_id"] + ", item bigint, terms array<bigint>")
    )
    n, terms = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-terms // BLOCK_TERMS), -(-n // BLOCK_ITEMS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [_search_block(texts, queries.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    best = reduce(DataFrame.unionByName, found)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "salt"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(texts: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    block = queries.select("item", "terms").toArrow()
    own = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for x in block["terms"]]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]))
    forward = materialize(texts.mapInArrow(_indexer(vocabulary), "doc_id bigint, n bigint, terms array<int>, times array<int>"))
    counts = forward.select("n", "terms").mapInArrow(_counter(len(vocabulary)), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {r["term"]: r["n"] for r in counts.collect()}  # a row per term of the block, and two
    n_docs, n_terms = sums.get(-1, 0), sums.get(-2, 0)
    df = np.array([sums.get(t, 0) for t in range(len(vocabulary))], np.int64)
    weight = np.array([weight_of(n_docs, x) for x in df.tolist()], np.int64)
    ranked = []  # the terms of each query, the rarest first
    for item, terms in zip(block["item"].to_pylist(), own):
        at = np.searchsorted(vocabulary, terms)
        at = at[(df[at] > 0) & (weight[at] > 0)]
        ranked.append((item, at[np.argsort(df[at], kind="stable")]))
    return forward.mapInArrow(_ranker(ranked, weight, n_docs, n_terms, k), "item bigint, doc_id bigint, score bigint").withColumn(
        "salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))
    )


def weight_of(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _found(texts: pa.Array) -> words.Words:
    return words.find(texts, words.ALNUM, words.LOWER)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, item and the distinct terms of each query."""
    for batch in words.slices(batches):
        w = _found(batch.column("text"))
        own = [np.unique(w.hash[a:b]) for a, b in zip(w.first, w.first[1:])]
        flat = words.as_long(np.concatenate([np.zeros(0, np.uint64), *own]))
        terms = words.lists(flat, np.array([len(x) for x in own], np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), terms], ["item_id", "item", "terms"])


def _indexer(vocabulary: np.ndarray):
    """Per document its number of terms, and which of the vocabulary it holds how often."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches):
            w = _found(batch.column("text"))
            at = np.searchsorted(vocabulary, w.hash)
            known = at < len(vocabulary)
            known[known] = vocabulary[at[known]] == w.hash[known]
            pair, times = np.unique(w.doc[known] * (len(vocabulary) + 1) + at[known], return_counts=True)
            doc, term = pair // (len(vocabulary) + 1), pair % (len(vocabulary) + 1)
            per = np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(w.count.astype(np.int64)),
                    words.lists(pa.array(term.astype(np.int32)), per), words.lists(pa.array(times.astype(np.int32)), per),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    return index


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _counter(size: int):
    """How many documents hold each term; under -1 the documents with terms, under -2 all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            n = batch.column("n").to_numpy(zero_copy_only=False)
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
            df += np.bincount(_flat(batch.column("terms")), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([held, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[held], [docs, terms]]))],
            ["term", "n"],
        )

    return count


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc_id, null ids, length, document and term of each posting, and its count, of some documents at a time."""
    for batch in batches:
        counts = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
            part = batch.slice(at, to - at)
            ids = part.column("doc_id")
            yield (
                ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                part.column("n").to_numpy(zero_copy_only=False), np.repeat(np.arange(to - at), counts[at:to]),
                _flat(part.column("terms")), _flat(part.column("times")).astype(np.int64),
            )
            at = to


def _ranker(ranked: list[tuple[int, np.ndarray]], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """The best ``k`` documents of a task's part of the index for each query."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for item, _ in ranked}
        for ids, null, n, doc, term, times in _pieces(batches):
            order = np.argsort(term, kind="stable")
            doc, term, times = doc[order], term[order], times[order]
            length = 50 + 50 * n * n_docs // max(1, n_terms)
            gain = weight[term] * (10**9 * times // (1000 * times + 20 * length[doc]))
            begin = np.searchsorted(term, np.arange(len(weight) + 1))
            held = np.flatnonzero(np.diff(begin))
            bound = np.zeros(len(weight), np.int64)
            if len(held):
                bound[held] = np.maximum.reduceat(gain, begin[held])
            for item, terms in ranked:
                scores, best_ids, best_null = best[item]
                floor = int(scores[-1]) if len(scores) == k else 0
                who, score = accumulate([(doc[begin[t] : begin[t + 1]], gain[begin[t] : begin[t + 1]], int(bound[t])) for t in terms], len(ids), k, floor)
                if not len(who):
                    continue
                scores = np.concatenate([scores, score])
                best_ids, best_null = np.concatenate([best_ids, ids[who]]), np.concatenate([best_null, null[who]])
                top = np.lexsort((best_ids, best_null, -scores))[:k]
                best[item] = scores[top], best_ids[top], best_null[top]
        for item, (scores, best_ids, best_null) in best.items():
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), item)), pa.array(best_ids, pa.int64(), mask=best_null), pa.array(scores)],
                    ["item", "doc_id", "score"],
                )

    return rank


def accumulate(postings: list[tuple[np.ndarray, np.ndarray, int]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and whole scores of all that can be among the ``k`` best or score ``floor``.

    ``postings`` has, rarest term first, ascending documents below ``size``, what the term
    adds to each, and the most that it adds to any.
    """
    rest = np.concatenate([np.cumsum([b for _, _, b in postings][::-1], dtype=np.int64)[::-1], [0]])
    table = np.zeros(size, np.int64)
    at = 0
    while at < len(postings) and not rest[at] < floor:
        doc, gain, _ = postings[at]
        table[doc] += gain
        at += 1
        if at < len(postings) and size >= k and rest[at] < table.max():
            floor = max(floor, int(np.partition(table, size - k)[size - k]))
    who = np.flatnonzero(table)  # from here on nobody is added
    score = table[who]
    for doc, gain, _ in postings[at:]:
        if not len(doc) or not len(who):
            continue
        place = np.minimum(np.searchsorted(doc, who), len(doc) - 1)
        score += np.where(doc[place] == who, gain[place], 0)
    if len(score) > k:
        floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
    able = score >= max(floor, 1)
    return who[able], score[able]
