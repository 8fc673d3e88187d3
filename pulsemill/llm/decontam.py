"""Benchmark decontamination by winnowing.

A window is ``n`` consecutive words of a benchmark item (the whole item if it is shorter).
Its fingerprint is the smallest ``k``-gram hash among the ``n - k + 1`` it holds. A span of
``n`` words that a document shares with an item therefore shares the fingerprint too, so no
such span is missed. Items shorter than ``n`` words are their own fingerprint.

1. Fingerprints of the benchmark set bits of a map of ``2**BITS`` bits: its size is fixed,
   whatever the benchmark's, and it is all that is broadcast.
2. One pass over the documents keeps, around each fingerprint whose bit is set, the windows
   that have it. A fuller map lets more of them pass; the next step stays exact.
3. These windows are joined with the benchmark's by their words, and hits are extended to
   word spans per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemill.llm import words as W
from pulsemill.session import materialize

WINDOW = 10
GRAM = 5
BITS = 24


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` consecutive values."""
    out = values[: max(0, len(values) - width + 1)].copy()
    for j in range(1, width):
        np.minimum(out, values[j : len(out) + j], out=out)
    return out


def _fingerprints(words: W.Words, n: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``n`` words and the fingerprint of each."""
    k = min(k, n) if n == window else n
    grams, valid = W.grams(words, k)
    found = _least(grams, n - k + 1)
    last = words.first[1:][words.doc[: len(found)]]
    start = np.flatnonzero(np.arange(len(found)) + n <= last)
    return start, W.mix(found[start] + np.uint64(n))


def _folded(words: W.Words) -> bytes:
    return W.LOWER[words.data].tobytes()


def benchmark_windows(benchmark: DataFrame, *, n: int = WINDOW, k: int = GRAM, item: str = "item_id", text: str = "text") -> DataFrame:
    """(words, length, fingerprint, items): the distinct windows, each with its items' ids as sorted strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text):
            w = W.find(part.column(text), W.ALNUM, W.LOWER)
            flat, rows = _folded(w), []
            count = w.count
            for size in range(1, n + 1):
                start, prints = _fingerprints(w, size, n, k)
                doc = w.doc[start]
                fits = count[doc] >= n if size == n else count[doc] == size
                for i, d, p in zip(start[fits].tolist(), doc[fits].tolist(), prints[fits].view(np.int64).tolist(), strict=True):
                    rows.append((d, " ".join(flat[w.start[j] : w.end[j]].decode() for j in range(i, i + size)), size, p))
            docs, text_of, sizes, prints = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [part.column("_item").take(pa.array(docs, pa.int64())), pa.array(text_of, pa.string()),
                 pa.array(sizes, pa.int32()), pa.array(prints, pa.int64())],
                ["_item", "words", "length", "fingerprint"],
            )

    given = benchmark.select(F.col(item).cast("string").alias("_item"), F.col(text).alias(text))
    found = given.mapInArrow(W.tidy(run), "_item string, words string, length int, fingerprint long")
    return found.groupBy("words", "length", "fingerprint").agg(F.array_sort(F.collect_set("_item")).alias("items"))


def _bit_map(windows: DataFrame) -> np.ndarray:
    """The bits that fingerprints set, as one byte each eight; at most ``2**BITS / 64`` rows are collected."""
    bit = F.shiftrightunsigned("fingerprint", 64 - BITS)
    cells = windows.groupBy(F.shiftrightunsigned(bit, 6).cast("int").alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("bits")
    )
    out = np.zeros(1 << (BITS - 6), np.int64)
    for row in cells.collect():
        out[row["cell"]] = row["bits"]
    return out.view(np.uint8)


def _passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = (prints >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def overlaps(
    docs: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, k: int = GRAM, keep: tuple[str, ...] = ("doc_id",),
    text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Per document the ``keep`` columns, ``n_words``, ``n_hit``, ``items``, ``spans`` and ``contaminated``.

    ``spans`` are the hit stretches as (first word, end), ``items`` the sorted ids of the
    items that have a window in the document. Words are longest runs of ASCII digits,
    letters (lower-cased) and other characters than ASCII.

    A null or empty text has no words; an item without words hits nothing; an item without
    an id hits words but is not listed; each repeated row gets its own, equal, result. With
    an empty benchmark no document is contaminated, and without documents there is no row.
    """
    windows = materialize(benchmark_windows(benchmark, n=n, k=k, item=item, text=item_text))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # n at most
    bits = docs.sparkSession.sparkContext.broadcast(_bit_map(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for part in W.slices(batches, text):
            w = W.find(part.column(text), W.ALNUM, W.LOWER)
            doc, found = w.doc, {}
            for size in lengths:
                start, prints = _fingerprints(w, size, n, k)
                start = start[_passes(table, prints)]
                for i, d in zip(start.tolist(), doc[start].tolist(), strict=True):
                    found.setdefault(d, []).append((i, size))
            flat = _folded(w) if found else b""
            rows = []
            for d in range(part.num_rows):
                places: dict[str, list[int]] = {}
                own: dict[int, str] = {}
                for i, size in found.get(d, ()):
                    for j in range(i, i + size):
                        if j not in own:
                            own[j] = flat[w.start[j] : w.end[j]].decode()
                    key = own[i] if size == 1 else " ".join([own[j] for j in range(i, i + size)])
                    places.setdefault(key, []).append(i - int(w.first[d]))
                rows.append([{"words": key, "starts": at} for key, at in places.items()])
            kind = pa.list_(pa.struct([("words", pa.string()), ("starts", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(w.count, pa.int64()), pa.array(rows, kind)],
                [*keep, "n_words", "_windows"],
            )

    given = docs.select(*dict.fromkeys([*keep, text]))
    schema = given.select(*keep).schema.add("n_words", "long")
    schema = schema.add("_windows", T.ArrayType(T.StructType().add("words", "string").add("starts", T.ArrayType(T.IntegerType()))))
    seen = materialize(given.mapInArrow(W.tidy(run), schema).withColumn("_row", F.monotonically_increasing_id()))

    cand = seen.where(F.size("_windows") > 0).select("_row", F.explode("_windows").alias("w"))
    cand = cand.select("_row", F.col("w.words").alias("words"), F.col("w.starts").alias("starts"))
    hits = cand.join(windows.select("words", "length", "items"), "words")
    spot = F.transform("starts", lambda s: F.struct(s.alias("at"), (s + F.col("length")).alias("to")))
    per_doc = hits.groupBy("_row").agg(
        F.array_sort(F.flatten(F.collect_list(spot))).alias("_spots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )

    def grow(spans, spot):
        last = F.element_at(spans, -1)
        joined = F.concat(
            F.slice(spans, 1, F.size(spans) - 1),
            F.array(F.struct(last["at"].alias("at"), F.greatest(last["to"], spot["to"]).alias("to"))),
        )
        return F.when((F.size(spans) > 0) & (F.try_element_at(spans, F.lit(-1))["to"] >= spot["at"]), joined).otherwise(
            F.concat(spans, F.array(spot))
        )

    none = F.expr("CAST(array() AS array<struct<at:int,to:int>>)")
    per_doc = per_doc.select("_row", "items", F.aggregate("_spots", none, grow).alias("spans"))
    out = seen.drop("_windows").join(per_doc, "_row", "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["at"])
    return out.select(
        *keep, "n_words", F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
        F.coalesce("spans", none).alias("spans"),
    ).withColumn("contaminated", F.col("n_hit") > 0)
