"""Substring dedup: documents parsed into phrases against an index of the whole corpus.

Every run of ``n`` words that occurs twice or more is found, whole corpus against whole
corpus. In the manner of relative Lempel-Ziv parsing a document becomes a list of phrases,
each of which names an entry of the reference index:

1. Every ``n``-word window has an anchor, its smallest ``k``-gram hash (the leftmost of equal
   ones). Consecutive windows with the same anchor form a phrase; it holds the words of all
   its windows. Equal windows have equal anchors, so whatever repeats meets in the index
   under one anchor. The index has a row per phrase (one per 15 words or so), not per word.
2. An anchor that occurs once has no duplicates. An anchor that occurs more often and always
   in the same phrase makes each such phrase one long factor. This settles the inside of
   copies and shared passages without looking at single windows.
3. At the boundaries of factors, where phrases of one anchor differ, the windows of these
   phrases are looked up one by one, and adjacent hits are joined to factors.

Texts are moved only for documents that have such boundaries, and again for those whose
words are removed in part. Everything is joined and counted by hash: the two keys compared
are 128 bits together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.llm import words as W
from pulsemill.session import materialize

WINDOW = 35
GRAM = 5
KEY_BITS = 24


def anchors(words: W.Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows of ``n`` words that lie in one document, the place of each one's
    anchor, and the hash of that."""
    k = min(k, n)
    value, _ = W.grams(words, k)
    place = np.arange(len(value))
    width, have = n - k + 1, 1
    while have < width:  # least of ``have`` grams becomes least of up to twice as many
        step = min(have, width - have)
        m = len(value) - step
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        right = value[step:] < value[:m]
        place = np.where(right, place[step:], place[:m])
        value = np.where(right, value[step:], value[:m])
        have += step
    last = words.first[1:][words.doc[: len(value)]]
    start = np.flatnonzero(np.arange(len(value)) + n <= last)
    return start, place[start], value[start]


class Runs:
    """Hashes of runs of words, from running sums."""

    def __init__(self, words: W.Words):
        m = len(words.hash)
        self._sums = np.zeros(m + 1, np.uint64)
        np.cumsum(words.hash * W._power("up", m), out=self._sums[1:])
        self._down = W._power("down", m + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return W.mix(((self._sums[stop] - self._sums[start]) * self._down[start]) ^ W.mix((stop - start).astype(np.uint64)))


def phrases(words: W.Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per phrase: first window, windows, hash of the anchor, hash of all its words."""
    start, place, value = anchors(words, n, k)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(start)))
    first = start[at]
    return first, size, value[at], Runs(words).of(first, first + size - 1 + n)


def _digest(words: W.Words, a: int, b: int) -> bytes:
    """SHA-256 of words a to b-1 joined by one space."""
    return hashlib.sha256(b" ".join(words.data[words.start[a] : words.end[b - 1]].tobytes().split())).digest() if b > a else hashlib.sha256().digest()


def index(docs: DataFrame, *, n: int = WINDOW, k: int = GRAM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, _key, n_words, sha, at, size, anchor, phrase): the parse of every document.

    ``_key`` stands for the whole text, ``sha`` is the digest of its words joined by spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            w = W.find(part.column("text"))
            at, size, anchor, phrase = phrases(w, n, k)
            doc = w.doc[at] if len(at) else at
            counts = np.bincount(doc, minlength=part.num_rows)
            whole = [_digest(w, a, b) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            inside = pa.array((at - w.first[doc]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in (*keep, "_key")), pa.array(w.count, pa.int64()), pa.array(whole, pa.binary()),
                 W.lists(inside, counts), W.lists(pa.array(size.astype(np.int32)), counts),
                 W.lists(W.as_long(anchor), counts), W.lists(W.as_long(phrase), counts)],
                [*keep, "_key", "n_words", "sha", "at", "size", "anchor", "phrase"],
            )

    given = _keyed(docs, keep)
    schema = given.select(*keep, "_key").schema.add("n_words", "long").add("sha", "binary")
    for name, kind in (("at", "int"), ("size", "int"), ("anchor", "bigint"), ("phrase", "bigint")):
        schema = schema.add(name, _array(kind))
    return given.mapInArrow(W.tidy(run), schema)


def _array(kind: str):
    from pyspark.sql import types as T

    return T.ArrayType(T.IntegerType() if kind == "int" else T.LongType())


def _keyed(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*keep, text.alias("text"), F.unhex(F.md5(text)).alias("_key"))


def _key_filter(keys: DataFrame, column: str = "_key") -> np.ndarray:
    """A map of ``2**KEY_BITS`` bits (whatever the number of keys) with a bit per key, to leave
    out most texts that a join by key would drop. If many keys fill it up it saves nothing."""
    bit = F.conv(F.substring(F.hex(column), 1, KEY_BITS // 4), 16, 10).cast("int")
    cells = keys.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)))).alias("bits")
    )
    out = np.zeros(1 << (KEY_BITS - 6), np.int64)
    for row in cells.collect():  # 2**18 rows at most
        out[row["cell"]] = row["bits"]
    return out.view(np.uint8)


def _texts_of(docs: DataFrame, keys: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The documents whose key is among ``keys``, and perhaps others."""
    bits = docs.sparkSession.sparkContext.broadcast(_key_filter(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            at = np.array([int.from_bytes(x[: KEY_BITS // 8], "big") for x in batch.column("_key").to_pylist()], np.int64)
            yield batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))

    given = _keyed(docs, keep)
    return given.mapInArrow(W.tidy(run), given.schema)


def repeats(docs: DataFrame, *, n: int = WINDOW, k: int = GRAM, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document the ``keep`` columns, ``n_words``, ``n_removed``, ``kept_sha`` (binary) and ``factors``.

    ``factors`` are the word ranges (at, to) that windows of ``n`` words cover which occur
    elsewhere too, in another document or the same. Words are runs of other characters than
    space and the controls 9 to 13. ``kept_sha`` is the SHA-256 of the words outside the
    factors, joined by one space.

    Null and empty texts have no words; texts of fewer than ``n`` words have no window.
    Repeated rows repeat each other, so all their words are in factors. Hot anchors and
    copies are counted before they are moved, and adaptive execution splits their joins.
    """
    parsed = materialize(index(docs, n=n, k=k, keep=keep).withColumn("_row", F.monotonically_increasing_id()))
    copies = parsed.where(F.size("at") > 0).groupBy("_key").agg(F.count("*").alias("_copies"), F.min("_row").alias("_row"))
    copies = materialize(copies)  # a row per distinct text with a window
    spread = parsed.select("_row", F.explode(F.arrays_zip("at", "size", "anchor", "phrase")).alias("p")).select("_row", "p.*")

    # anchors that occur twice or more: always in the same phrase, or in several
    met = spread.groupBy("anchor").agg(F.count("*").alias("c"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi"))
    # written out, so that both sides of the join are shuffled for it and a hot anchor can be split
    met = materialize(met.where("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")))
    one_each = spread.join(copies.select("_row"), "_row", "left_semi")
    hits = one_each.join(met, "anchor").groupBy("_row").agg(
        F.sort_array(F.collect_list(F.when(~F.col("mixed"), F.struct("at", "size")))).alias("sure"),
        F.sort_array(F.collect_list(F.when(F.col("mixed"), F.struct("at", "size", "anchor")))).alias("open"),
    )
    state = materialize(copies.join(hits, "_row"))  # (_row, _key, _copies, sure, open), distinct texts with any hit

    # windows at the boundaries, looked up one by one
    opened = state.where(F.size("open") > 0).select("_key", "open")
    looked = materialize(_windows(docs, opened, n))
    flat = looked.select("_key", F.explode(F.arrays_zip("at", "anchor", "window")).alias("w")).select("_key", "w.*")
    twice = materialize(flat.groupBy("anchor", "window").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    found = flat.join(twice, ["anchor", "window"]).groupBy("_key").agg(F.collect_set("at").alias("more"))

    single = state.where("_copies = 1").join(found, "_key", "left")
    covers = F.concat(
        F.transform("sure", lambda s: F.struct(s["at"].alias("at"), (s["at"] + s["size"] + (n - 1)).alias("to"))),
        F.transform(F.coalesce("more", F.expr("CAST(array() AS array<int>)")), lambda a: F.struct(a.alias("at"), (a + n).alias("to"))),
    )
    cut = materialize(single.select("_key", F.array_sort(covers).alias("covers")).where(F.size("covers") > 0))

    # copies lose all words, texts without hits none; the rest is cut
    touched = cut.select("_key", F.lit(True).alias("_cut")).unionByName(
        copies.where("_copies > 1").select("_key", F.lit(False).alias("_cut"))
    )
    plain = parsed.select(*keep, "_key", "n_words", "sha").join(touched, "_key", "left").where("_cut IS NULL OR NOT _cut")
    gone = F.col("_cut").isNotNull()
    nothing = F.lit(hashlib.sha256().digest())
    none = F.expr("CAST(array() AS array<struct<at:int,to:int>>)")
    all_of_it = F.array(F.struct(F.lit(0).alias("at"), F.col("n_words").cast("int").alias("to")))
    plain = plain.select(
        *keep, "n_words", F.when(gone, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, nothing).otherwise(F.col("sha")).alias("kept_sha"), F.when(gone, all_of_it).otherwise(none).alias("factors"),
    )
    return plain.unionByName(_cut_texts(docs, cut, keep))


def _windows(docs: DataFrame, opened: DataFrame, n: int) -> DataFrame:
    """(_key, at, anchor, window): the windows of the open phrases of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            w = W.find(part.column("text"))
            runs = Runs(w)
            phrase = part.column("open")
            counts = np.diff(np.asarray(phrase.offsets))
            flat = phrase.flatten()
            at, size = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            anchor = np.asarray(flat.field(2))
            doc = np.repeat(np.arange(part.num_rows), counts)
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            local = np.repeat(at, size) + inside
            owner = np.repeat(doc, size)
            start = local + w.first[owner]
            each = np.bincount(owner, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("_key"), W.lists(pa.array(local.astype(np.int32)), each),
                 W.lists(pa.array(np.repeat(anchor, size)), each), W.lists(W.as_long(runs.of(start, start + n)), each)],
                ["_key", "at", "anchor", "window"],
            )

    met = _texts_of(docs, opened, ()).join(opened, "_key").select("_key", "text", "open")
    schema = met.select("_key").schema
    for name, kind in (("at", "int"), ("anchor", "bigint"), ("window", "bigint")):
        schema = schema.add(name, _array(kind))
    return met.mapInArrow(W.tidy(run), schema)


def _cut_texts(docs: DataFrame, cut: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Documents without the words that ``covers`` cover."""
    factor = pa.struct([("at", pa.int32()), ("to", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            removed, digests, factors = [], [], []
            words = [t.encode().split() for t in part.column("text").to_pylist()]
            for own, covers in zip(words, part.column("covers"), strict=True):
                at, to = (np.asarray(covers.values.field(i)).astype(np.int64) for i in (0, 1))
                depth = np.zeros(len(own) + 1, np.int64)
                np.add.at(depth, at, 1)
                np.add.at(depth, to, -1)
                hit = np.cumsum(depth)[:-1] > 0
                kept = [own[i] for i in np.flatnonzero(~hit).tolist()]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                removed.append(len(own) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).digest())
                factors.append([{"at": a, "to": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array([len(x) for x in words], pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(factors, pa.list_(factor))],
                [*keep, "n_words", "n_removed", "kept_sha", "factors"],
            )

    from pyspark.sql import types as T

    met = _texts_of(docs, cut, keep).join(cut, "_key").select(*keep, "text", "covers")
    schema = met.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha", "binary")
    schema = schema.add("factors", T.ArrayType(T.StructType().add("at", "integer").add("to", "integer")))
    return met.mapInArrow(W.tidy(run), schema)
