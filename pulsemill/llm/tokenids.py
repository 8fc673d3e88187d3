"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of ``CHUNK`` bits. Level 0 holds the lowest chunk of every token;
a bit per token says whether the id goes on, and level 1 holds the next chunk of those that
do, and so on. A rank directory (ones before every ``BLOCK`` bits) turns the place of a
token on one level into its place on the next, so any token is read with one look-up per
level and nothing is decoded before it.

File: magic, then counts, then for the documents their ids, null flags and first token
(the end as well), then per level the chunks, the bitmap and the directory. All numbers are
little-endian; ``HEADER`` and ``LAYOUT`` below describe them.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsemill.llm import files
from pulsemill.llm import words as W

MAGIC = b"DACTOK01"
CHUNK = 8
BLOCK = 512
#: tokens of a file, about; one document is never cut
FILE_TOKENS = 2_000_000
#: tokens that are decoded at once, about
READ_TOKENS = 500_000
#: distinct parts of words whose ids a task remembers
REMEMBERED = 800_000
#: parts that are encoded as one text, and marks that may follow a run of letters
TOGETHER = 1000
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
END = 2
TOKENIZER = "word_bpe_49k.json"
#: magic, documents, tokens, levels
HEADER = np.dtype([("magic", "S8"), ("docs", "<u8"), ("tokens", "<u8"), ("levels", "<u8")])


# -- the codes -------------------------------------------------------------------------


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap bytes, ones before each block)."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk = (rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8)
        rest = rest >> np.uint32(CHUNK)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.zeros(len(more) // BLOCK + 2, np.uint64)
        by_block = np.add.reduceat(more.astype(np.uint64), np.arange(0, len(more), BLOCK)) if len(more) else ones[:0]
        np.cumsum(by_block, out=ones[1 : 1 + len(by_block)])
        ones[1 + len(by_block) :] = ones[len(by_block)]
        levels.append((chunk, bits, ones))
        if not more.any():
            return levels
        rest = rest[more]


def to_bytes(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's content. ``starts`` has one entry more than there are documents."""
    levels = pack(ids)
    head = np.array([(MAGIC, len(doc_ids), len(ids), len(levels))], HEADER)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [head.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known.tobytes(), starts.astype("<u8").tobytes()]
    parts.append(np.array([len(chunk) for chunk, _, _ in levels], "<u8").tobytes())
    for chunk, bits, ones in levels:
        parts += [chunk.tobytes(), bits.tobytes(), ones.astype("<u8").tobytes()]
    return b"".join(parts)


class Reader:
    """Random access to a file: ``source`` is a seekable file object or the bytes of one."""

    def __init__(self, source):
        self._source = source
        head = np.frombuffer(self._bytes(0, HEADER.itemsize), HEADER)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_tokens, n_levels = int(head["docs"]), int(head["tokens"]), int(head["levels"])
        self._ids_at = HEADER.itemsize
        self._known_at = self._ids_at + 8 * self.n_docs
        self._starts_at = self._known_at + self.n_docs
        at = self._starts_at + 8 * (self.n_docs + 1)
        sizes = np.frombuffer(self._bytes(at, 8 * n_levels), "<u8")
        at += 8 * n_levels
        self._levels = []
        for size in sizes.tolist():
            bits_at = at + size
            ones_at = bits_at + (size + 7) // 8
            self._levels.append((size, at, bits_at, ones_at))
            at = ones_at + 8 * (size // BLOCK + 2)

    def _bytes(self, at: int, n: int) -> bytes:
        if isinstance(self._source, (bytes, memoryview)):
            return bytes(self._source[at : at + n])
        self._source.seek(at)
        return self._source.read(n)

    def doc_ids(self) -> list[int | None]:
        ids = np.frombuffer(self._bytes(self._ids_at, 8 * self.n_docs), "<i8").tolist()
        return [i if k else None for i, k in zip(ids, self._bytes(self._known_at, self.n_docs), strict=True)]

    def starts(self, first: int = 0, n: int | None = None) -> np.ndarray:
        n = self.n_docs + 1 if n is None else n
        return np.frombuffer(self._bytes(self._starts_at + 8 * first, 8 * n), "<u8").astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit ``i``: a directory entry and at most ``BLOCK / 8`` bytes of the bitmap."""
        _, _, bits_at, ones_at = self._levels[level]
        block = i // BLOCK
        before = int(np.frombuffer(self._bytes(ones_at + 8 * block, 8), "<u8")[0])
        from_bit = block * BLOCK
        part = np.frombuffer(self._bytes(bits_at + from_bit // 8, (i - from_bit + 7) // 8), np.uint8)
        return before + int(np.unpackbits(part, bitorder="little")[: i - from_bit].sum())

    def token(self, i: int) -> int:
        """The id of token ``i``; reads a chunk, a bit and a rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            _, at, bits_at, _ = self._levels[level]
            value |= self._bytes(at + i, 1)[0] << shift
            if not self._bytes(bits_at + i // 8, 1)[0] >> (i % 8) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + CHUNK

    def tokens(self, first: int, n: int) -> np.ndarray:
        """The ids of ``n`` tokens from ``first``, level by level."""
        out = np.zeros(n, np.uint32)
        where = np.arange(n)
        for level, (_, at, bits_at, _) in enumerate(self._levels):
            if not len(where):
                break
            count = len(where)
            chunk = np.frombuffer(self._bytes(at + first, count), np.uint8)
            out[where] |= chunk.astype(np.uint32) << np.uint32(CHUNK * level)
            low = first // 8
            bits = np.frombuffer(self._bytes(bits_at + low, (first + count + 7) // 8 - low), np.uint8)
            more = np.unpackbits(bits, bitorder="little")[first - 8 * low :][:count].astype(bool)
            if level + 1 < len(self._levels):
                first = self._rank(level, first)
            where = where[more]
        return out


# -- tokenizing ------------------------------------------------------------------------


@dataclass
class _Known:
    """Ids of words: ``ids[at[i] : at[i] + size[i]]`` for the i-th of the ascending ``keys``."""

    keys: np.ndarray
    at: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls) -> _Known:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys``, and which are there."""
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == keys[there]
        return place, there

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Take in new words, whose ids follow each other in ``ids``."""
        order = np.argsort(keys)
        at = (np.cumsum(size) - size + len(self.ids))[order]
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size[order])
        self.ids = np.concatenate([self.ids, ids])


def _loaded(path: str, shared: bool) -> dict:
    """The tokenizer, which ids end a word, and the words known so far; if ``shared``, later tasks
    of the same Python process find them again."""
    kept = sys.modules.setdefault("_pulsemill_tokenizers", types.ModuleType("_pulsemill_tokenizers")).__dict__
    holder = kept if shared else {}
    if path not in holder:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        holder[path] = {"tokenizer": tokenizer, "last": last, "known": _Known.empty()}
    return holder[path]


def encoder(tokenizer_path: str, shared: bool = True):
    """A function from a text column to its ids, equal to the tokenizer's own on the whole texts.

    The tokenizer drops white space and never merges across it, nor across the border of a
    run of letters and the marks behind it, if the letters are letters still when normalized
    (İ becomes i and a dot, which joins the marks). So texts are cut into parts there, each
    distinct part is encoded once, by the library, and texts are put together from parts.
    Parts of letters go to the library many at a time: each ends with the one id whose token has
    the mark of a word's end, which tells them apart; if the number of such ids is not that of
    the parts, and for all other parts, each is encoded alone. Ids are remembered by the parts'
    64-bit hashes, of at most ``REMEMBERED`` parts at a time, and if ``shared`` between the
    tasks of a process as well.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks use the cores already
    held = _loaded(tokenizer_path, shared)
    tokenizer, last = held["tokenizer"], held["last"]
    normalized = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str

    def alone(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sizes and ids of some words at a time."""
        for at in range(0, len(words), TOGETHER):
            ids = [e.ids for e in tokenizer.encode_batch_fast(words[at : at + TOGETHER], add_special_tokens=False)]
            yield np.array([len(x) for x in ids], np.int32), np.array([i for x in ids for i in x], np.uint32)

    def together(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for parts of letters only, given by their bytes."""
        for at in range(0, len(start), TOGETHER):
            size = (end - start)[at : at + TOGETHER]
            to = np.cumsum(size + 1)
            text = np.full(to[-1] - 1, 0x20, np.uint8)
            inside = np.arange(size.sum())
            skip = np.repeat(np.arange(len(size)), size)
            text[inside + skip] = data[np.repeat(start[at : at + TOGETHER] - (np.cumsum(size) - size), size) + inside]
            text = text.tobytes().decode()
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(size) and ends[-1] == len(ids):
                yield np.diff(ends, prepend=0).astype(np.int32), ids
            else:
                yield from alone(text.split(" "))

    def learn(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, plain: np.ndarray) -> None:
        plain = plain & last.any()
        words = [data[i:j].tobytes().decode() for i, j in zip(start[~plain].tolist(), end[~plain].tolist(), strict=True)]
        found = [*together(data, start[plain], end[plain]), *alone(words)]
        if found:
            size, ids = (np.concatenate(x) for x in zip(*found, strict=True))
            held["known"].add(np.concatenate([keys[plain], keys[~plain]]), size, ids)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the number of each text's ids; a null text has none."""
        w = W.find(texts)
        start, end, first, plain = _parts(w, normalized)
        which, keys = pd.factorize(w.span_hash(start, end))
        place, there = held["known"].find(keys)
        if not there.all():
            if len(held["known"].keys) + int((~there).sum()) > REMEMBERED:
                held["known"] = _Known.empty()
                there[:] = False
            at = np.zeros(len(keys), np.int64)
            at[which[::-1]] = np.arange(len(which))[::-1]  # the first place of each distinct part
            at = at[~there]
            learn(w.data, start[at], end[at], keys[~there], plain[at])
            place, _ = held["known"].find(keys)
        known = held["known"]
        each = known.size[place].astype(np.int64)[which]
        before = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=before[1:])
        at = np.repeat(known.at[place][which] - before[:-1], each)
        at += np.arange(before[-1])
        return known.ids[at], np.diff(before[first])

    return encode


#: kinds of bytes for the parts of words
_LETTER, _MARK, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[c for c in range(0x80) if chr(c).isalpha()]] = _LETTER
_KIND[[ord(c) for c in MARKS]] = _MARK


def _parts(w: W.Words, normalized: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words cut into letters and the marks behind them: starts, ends, each document's first part
    (and the end), and which parts are of letters only, as they stand and as normalized."""
    kind = _KIND[w.data]
    if len(w.data) and w.data.max() >= 0x80:
        points = np.frombuffer(w.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        far = points >= 0x80
        rare, which = np.unique(points[far], return_inverse=True)
        letter = np.array([c.isalpha() and normalized(c).isalpha() for c in map(chr, rare.tolist())], bool)
        of_point = np.zeros(len(points), np.uint8)
        of_point[far] = np.where(letter, _LETTER, _OTHER)[which]
        width = 1 + far.astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        kind = np.where(w.data >= 0x80, np.repeat(of_point, width), kind)
    sums = np.zeros((2, len(kind) + 1), np.int64)
    np.cumsum(kind == _LETTER, out=sums[0, 1:])
    np.cumsum(kind == _OTHER, out=sums[1, 1:])
    breaks = np.concatenate([np.flatnonzero(kind != _LETTER), [len(kind)]])
    stop = np.minimum(breaks[np.searchsorted(breaks, w.start)], w.end)  # of the letters that a word starts with
    cut = (stop > w.start) & (stop < w.end) & (sums[0, w.end] == sums[0, stop]) & (sums[1, w.end] == sums[1, w.start])
    twice = 1 + cut.astype(np.int64)
    start, end = np.repeat(w.start, twice), np.repeat(w.end, twice)
    head = np.cumsum(twice)[cut] - 2
    end[head], start[head + 1] = stop[cut], stop[cut]
    first = np.concatenate([[0], np.cumsum(twice)])[w.first]
    return start, end, first, sums[0, end] - sums[0, start] == end - start


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# -- writing and reading ---------------------------------------------------------------


def write(
    docs: DataFrame, folder: str | None = None, *, tokenizer: str | None = None, end: int | None = END,
    id_column: str = "doc_id", text: str = "text", partitions: int | None = None, file_tokens: int = FILE_TOKENS,
    shared: bool = True,
) -> tuple[DataFrame, str]:
    """Encode all documents and write their ids, in ascending order of the id column.

    Returns (catalog, folder). The catalog, also stored below the folder, has a row per file:
    ``part``, ``piece``, ``file``, ``docs``, ``tokens`` and ``first_token``, the number of
    tokens in all files before it. Equal ids stand in the order of a text hash; null ids come
    first; a null text has no ids but ``end``; repeated rows are written each; no documents
    make an empty catalog.

    Documents are dealt out by ranges of (id, hash, place of the row), so one id with many
    rows covers many tasks. A task keeps one file's tokens in memory; with ``shared`` the Python
    process keeps the tokenizer and its words for the next task (some 200 MB), which saves time.
    """
    spark = docs.sparkSession
    folder = folder or files.new_folder(spark, "tokens")
    path = tokenizer or default_tokenizer()
    given = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("text")).select(
        "*", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_m")
    )
    keys = ("_id", "_h", "_m")
    dealt = given.repartitionByRange(partitions, *keys) if partitions else given.repartitionByRange(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, shared)
        part, piece = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, codes, counts, held, piece
            starts = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(np.concatenate(counts), out=starts[1:])
            content = to_bytes(ids, starts, np.concatenate(codes))
            name = files.write(folder, f"part-{part:05d}-{piece:05d}", ".dac", content)
            row = [[part], [piece], [name], [len(ids)], [int(starts[-1])]]
            ids, codes, counts, held, piece = [], [], [], 0, piece + 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                ["part", "piece", "file", "docs", "tokens"],
            )

        for batch in W.slices(batches):
            found, n = encode(batch.column("text"))
            if end is not None:
                found, n = np.insert(found, np.cumsum(n), end), n + 1
            ids += batch.column("_id").to_pylist()
            codes.append(found)
            counts.append(n)
            held += len(found)
            if held >= file_tokens:
                yield flush()
        if ids:
            yield flush()

    schema = "part int, piece int, file string, docs long, tokens long"
    dealt.sortWithinPartitions(*keys).select("_id", "text").mapInArrow(W.tidy(run), schema).write.parquet(f"{folder}/written")
    written = spark.read.parquet(f"{folder}/written")
    per_part = written.groupBy("part").agg(F.sum("tokens").alias("_t"))
    before = F.sum("_t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    catalog = written.join(offsets, "part").select(
        *written.columns, (F.col("_before") + F.coalesce(inside, F.lit(0))).alias("first_token")
    )
    catalog.write.parquet(f"{folder}/catalog")
    return spark.read.parquet(f"{folder}/catalog"), folder


def read(catalog: DataFrame, folder: str, *, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("file").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                fs, path = files.opened(folder)
                with fs.open_input_file(f"{path}/{name}") as source:
                    reader = Reader(source)
                    doc_ids, starts = reader.doc_ids(), reader.starts()
                    at = 0
                    while at < len(doc_ids):  # some documents at a time, or a longer one
                        to = max(at + 1, int(np.searchsorted(starts, starts[at] + READ_TOKENS, "right")) - 1)
                        own = starts[at : to + 1]
                        flat = memoryview(reader.tokens(int(own[0]), int(own[-1] - own[0])).astype("<u4").tobytes())
                        ends = (4 * (own - own[0])).tolist()
                        ids = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                        columns = [doc_ids[at:to], own[:-1] + first, np.diff(own), [zlib.crc32(x) for x in ids]]
                        columns += [[bytes(x) for x in ids]] * with_ids
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                        at = to

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    spread = catalog.select("file", "first_token").repartition(_tasks(catalog), "file")
    return spread.mapInArrow(W.tidy(run), schema)


def _tasks(catalog: DataFrame) -> int:
    """A task for a few files each, so that reading a folder uses the whole cluster."""
    return max(1, min(100_000, catalog.count()))


def tokens_at(catalog: DataFrame, folder: str, places: DataFrame) -> DataFrame:
    """(place) -> (place, token): single tokens by their number in the whole folder.

    Places are matched to files by range; each file is opened once per task and only the
    bytes that a place needs are read. Places outside the folder give no row.
    """
    end = F.col("first_token") + F.col("tokens")
    asked = places.select(F.col("place").cast("long").alias("place"))
    width = FILE_TOKENS
    spans = catalog.select("file", "first_token", end.alias("_end")).withColumn(
        "_cell", F.explode(F.sequence(F.expr(f"first_token div {width}"), F.expr(f"(_end - 1) div {width}")))
    )
    met = asked.withColumn("_cell", F.expr(f"place div {width}")).join(spans, "_cell")
    met = met.where("place >= first_token AND place < _end").select("file", (F.col("place") - F.col("first_token")).alias("at"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = reader = source = None
        fs, path = files.opened(folder)
        for batch in batches:
            found = []
            for file, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), strict=True):
                if file != name:
                    if source:
                        source.close()
                    source = fs.open_input_file(f"{path}/{file}")
                    name, reader = file, Reader(source)
                found.append(reader.token(at))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(found, pa.int64())], ["place", "token"])
        if source:
            source.close()

    return met.sortWithinPartitions("file", "at").mapInArrow(W.tidy(run), "place long, token long")


def open_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog of a written folder."""
    return spark.read.parquet(f"{folder}/catalog")
