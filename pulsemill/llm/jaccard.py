"""Exact set-similarity self-join of documents by a token-group matrix.

A document's tokens are its distinct ``k``-word shingles. Two documents link when
``den * |A and B| >= num * |A or B|``. The result is the connected components of the links.

1. Documents with equal sets become one node.
2. Nodes with a common minimum hash are compared with one of them, the one whose tokens are
   the most frequent (the middle of a cluster of near copies). The links found partition the
   nodes into groups of similar documents; most groups are one node.
3. The matrix says which token is in the union of which group, for the tokens in which two
   linked sets must meet: the first few of each set in one order of all tokens, rarest first. A
   count sketch of fixed size gives the order; any order is exact, and a token that a set share
   of all documents has comes late at every size. Tokens of one node only are counted and
   dropped. Each entry bears what bounds the overlap of a query with
   the group's member behind it: size, place of the token, and a signature of ``SIGNATURE``
   bits. Every token turns over one bit, so the bits in which two signatures differ are no more
   than the tokens in which the sets do.
4. A node opens the groups other than its own whose bound reaches the overlap that a link
   needs, and is compared with their members token by token, in cells of at most
   ``CELL`` members and ``CELL`` queries.

Within a group nothing is compared again: it is connected already. But the matrix has an entry
per token and member, and the join on tokens meets members of the own group before it drops
them: m different near copies in a group give about m * m such pairs per shared prefix token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemill.llm import graph
from pulsemill.llm import words as W
from pulsemill.llm.columns import shield
from pulsemill.session import materialize

SKETCH_BITS = 19
#: bits of a signature, and of a second one that sets of over ``LARGE`` tokens have besides
SIGNATURE, WIDE, LARGE = 512, 4096, 600
#: minimum hashes by which nodes meet in step 2
SEEDS = (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)
CELL = 512
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def token_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased first. A text of fewer
    than ``k`` words, but not none, is one shingle."""
    w = W.find(texts, W.NOT_SPACE, W.LOWER)
    grams, _ = W.grams(w, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for h in w.hash[a:b]:
                one = W.mix(np.array([one]) * _SECOND + h)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a token, by the first bits of its hash: never too low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in W.slices(batches):
            sets = token_sets(part.column("text"), k)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            counts += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(counts, 2**32 - 1).astype("<u4").tobytes()])], ["counts"])

    def add(a: bytes, b: bytes) -> bytes:
        total = np.frombuffer(a, "<u4").astype(np.int64) + np.frombuffer(b, "<u4")
        return np.minimum(total, 2**32 - 1).astype("<u4").tobytes()

    parts = docs.select("text").mapInArrow(W.tidy(run), "counts binary").rdd.map(lambda r: bytes(r[0]))
    return np.frombuffer(parts.treeReduce(add) if not parts.isEmpty() else bytes(4 << SKETCH_BITS), "<u4")


def _signature(s: np.ndarray, bits: int = SIGNATURE) -> np.ndarray:
    """As 64-bit words: bit i says whether an odd number of the tokens hashes to i."""
    at = (W.mix(s + _SECOND) >> np.uint64(32)).astype(np.int64) % bits
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _describe(docs: DataFrame, k: int, num: int, den: int, keep: tuple[str, ...]) -> DataFrame:
    """Per document: keep, _text (a key of the text), _set (a key of the set), n, lows (minimum
    hashes), signature, wide (null sets and small ones have none), and prefix (its first tokens)."""
    seeds = np.array(SEEDS, np.uint64)
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = sketch.value
        for part in W.slices(batches):
            sets = token_sets(part.column("text"), k)
            keys, lows, signatures, wide, prefix = [], [], [], [], []
            for s in sets:
                n = len(s)
                if not n:
                    keys.append(None)
                    lows.append([])
                    signatures.append([])
                    wide.append([])
                    prefix.append(s)
                    continue
                keys.append(np.array([W.mix(s).sum(), W.mix(s ^ _SECOND).sum(), n], np.uint64).tobytes())
                lows.append([int(W.mix(s ^ x).min().view(np.int64)) for x in seeds])
                signatures.append(_signature(s).tolist())
                wide.append(_signature(s, WIDE).tolist() if n > LARGE else [])
                count = often[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                prefix.append(s[np.argsort(count, kind="stable")[: n - -(-num * n // den) + 1]])  # equal ones by hash
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.uint64)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in (*keep, "_text")), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array(lows, longs), pa.array(signatures, longs), pa.array(wide, longs), W.lists(W.as_long(flat), np.array([len(x) for x in prefix], np.int64))],
                [*keep, "_text", "_set", "n", "lows", "signature", "wide", "prefix"],
            )

    given = _keyed(docs, keep)
    schema = given.select(*keep, "_text").schema.add("_set", "binary").add("n", "integer")
    for name in ("lows", "signature", "wide", "prefix"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    return given.mapInArrow(W.tidy(run), schema)


def _shared(nodes: DataFrame) -> DataFrame:
    """(node, fame, kept): each node's first tokens that another node has too, with their places,
    and the mean log number of nodes of all its first tokens."""
    token = nodes.select("node", F.posexplode("prefix").alias("at", "token"))
    often = token.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    met = token.join(materialize(often), "token").groupBy("node").agg(
        F.collect_list(F.struct("at", "token")).alias("kept"), F.sum(F.ln("c")).alias("total")
    )
    size = nodes.select("node", F.size("prefix").alias("m"))
    return met.join(size, "node").select("node", (F.col("total") / F.col("m")).alias("fame"), "kept")


def _keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*keep, text.alias("text"), F.unhex(F.md5(text)).alias("_text"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) for the (node, _text) of ``wanted``, whose keys are unique; copies of a text are
    dropped before it is moved."""
    given = _keyed(docs).join(F.broadcast(wanted.select("_text")), "_text", "left_semi") if _few(wanted) else _keyed(docs)
    once = given.groupBy("_text").agg(F.first("text").alias("text"))  # joins of texts are sort-merge joins at every size
    return materialize(once.hint("merge").join(wanted, "_text").select("node", "text"))


#: keys that may be broadcast to leave out texts that nobody asked for (16 bytes each)
FEW = 1_000_000


def _few(wanted: DataFrame) -> bool:
    return wanted.count() <= FEW


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return (num + den) * common >= num * (len(a) + len(b))


def _star_links(docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): nodes that link with the middle of a group with the same minimum hash."""
    low = nodes.select("node", "n", "fame", F.posexplode("lows").alias("seed", "low"))
    middle = low.groupBy("seed", "low").agg(
        F.count("*").alias("c"), F.max_by(F.struct("node", "n"), F.struct("fame", -F.col("node"))).alias("mid")
    ).where("c > 1").select("seed", "low", F.col("mid.node").alias("b"), F.col("mid.n").alias("n_b"))
    pairs = low.join(middle, ["seed", "low"]).where(
        (F.col("node") != F.col("b")) & (F.least("n", "n_b") * den >= F.greatest("n", "n_b") * num)
    ).select(F.col("node").alias("a"), "b").distinct()
    pairs = materialize(pairs)
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = _texts(docs, nodes.select("node", "_text").join(ends, "node", "left_semi"))
    met = pairs.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    met = met.hint("merge").join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "b", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            left, right = token_sets(part.column("text"), k), token_sets(part.column("other"), k)
            good = pa.array([_linked(x, y, num, den) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], ["a", "b"])

    return materialize(met.mapInArrow(W.tidy(run), "a long, b long"))


def _candidates(nodes: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """(node, grp): nodes and groups other than theirs whose overlap may reach what a link needs."""
    words = range(SIGNATURE // 64)
    placed = nodes.join(groups, "node", "left").select(
        "node", "n", F.coalesce("label", "node").alias("grp"), *(F.col("signature")[i].alias(f"s{i}") for i in words), F.explode("kept").alias("t")
    )
    query = placed.select("node", "n", "grp", *(f"s{i}" for i in words), "t.*")
    # the smaller of two linked sets has one of its first tokens in common with the other's prefix
    early = F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * num) / (num + den))
    matrix = query.where(early).select(
        "token", F.col("grp").alias("g"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("at").alias("aty"),
        *(F.col(f"s{i}").alias(f"y{i}") for i in words),
    )
    n, ny = F.col("n"), F.col("ny")
    need = F.ceil((n + ny) * num / (num + den))  # a quotient of whole numbers, so the ceiling is exact
    differ = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"y{i}"))) for i in words), start=F.lit(0))
    smaller = (ny < n) | ((ny == n) & (F.col("y") < F.col("node")))
    met = query.join(matrix, "token").where(
        (F.col("grp") != F.col("g")) & smaller & (ny * den >= n * num)
        & (n - F.col("at") >= need) & (ny - F.col("aty") >= need) & (n + ny - differ >= 2 * need)
    )
    pairs = met.select("node", "y", F.col("g").alias("grp"), (n + ny - 2 * need).alias("most")).distinct()
    # of large sets the wide signatures decide
    large = nodes.where(n > LARGE).select("node", "wide")
    both = pairs.join(large, "node", "left").join(large.select(F.col("node").alias("y"), F.col("wide").alias("other")), "y", "left")
    apart = F.aggregate(F.zip_with("wide", "other", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, x: total + x)
    known = F.col("wide").isNotNull() & F.col("other").isNotNull()
    return both.where(~known | (apart <= F.col("most"))).select("node", "grp").distinct()


def _open(docs: DataFrame, nodes: DataFrame, groups: DataFrame, asked: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): for each (node, grp) asked, a member of the group's cells that the node links with."""
    members = asked.select("grp").distinct().join(groups.select("node", F.col("label").alias("grp")), "grp", "left")
    members = members.select("grp", F.coalesce("node", "grp").alias("node"))
    size = members.groupBy("grp").agg(F.ceil(F.count("*") / CELL).alias("rows"))
    size = size.join(asked.groupBy("grp").agg(F.ceil(F.count("*") / CELL).alias("cols")), "grp")
    pick = lambda many: F.pmod(F.xxhash64("node"), F.col(many))
    inside = members.join(size, "grp").select(
        "grp", pick("rows").alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)).alias("c"), F.lit(0).alias("role"), "node"
    )
    outside = asked.join(size, "grp").select(
        "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("r"), pick("cols").alias("c"), F.lit(1).alias("role"), "node"
    )
    places = materialize(inside.unionByName(outside))
    texts = _texts(docs, nodes.select("node", "_text").join(places.select("node").distinct(), "node", "left_semi"))
    cells = places.hint("merge").join(texts, "node").repartition("grp", "r", "c").sortWithinPartitions("grp", "r", "c", "role", "node")

    def compare(members: list[tuple[int, np.ndarray]], queries: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        sizes = np.array([len(s) for _, s in members], np.int64)
        token = np.concatenate([s for _, s in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        found = []
        for node, s in queries:
            lo, hi = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            common = np.bincount(owner[at], minlength=len(members))
            good = np.flatnonzero((common > 0) & ((num + den) * common >= num * (len(s) + sizes)))
            if len(good):
                found.append((node, members[good[0]][0]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, queries = None, [], []

        def done() -> pa.RecordBatch:
            found = compare(members, queries) if members and queries else []
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for part in W.slices(batches):
            sets = token_sets(part.column("text"), k)
            rows = zip(*(part.column(c).to_pylist() for c in ("grp", "r", "c", "role", "node")), sets, strict=True)
            for grp, r, c, role, node, s in rows:
                if (grp, r, c) != cell:
                    if cell is not None:
                        yield done()
                    cell, members, queries = (grp, r, c), [], []
                (queries if role else members).append((node, s))
        if cell is not None:
            yield done()

    return materialize(cells.select("grp", "r", "c", "role", "node", "text").mapInArrow(W.tidy(run), "a long, b long"))


def link(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, keep: tuple[str, ...] = ("doc_id",), id_column: str = "doc_id") -> DataFrame:
    """Per document the ``keep`` columns, ``n_shingles``, ``component_id``, and ``_text`` (MD5 of
    the text), ``_row`` (a number of the row) and ``_component`` (one of its component, null if it has no shingle).

    ``component_id`` is the smallest id (``id_column``, one of ``keep``) among the documents
    that links connect. Documents with equal sets link. A null, empty or blank text has no
    shingle and is linked with nothing: its component is its own id. Null ids do not count
    as smallest; repeated rows are one node and each get its result; an empty table stays
    empty. No pair, bucket or group is left out.
    """
    keep = tuple(dict.fromkeys([*keep, id_column]))
    base = materialize(_describe(docs, k, num, den, keep).withColumn("_row", F.monotonically_increasing_id()))
    sets = materialize(
        base.where("n > 0").groupBy("_set").agg(F.min("_row").alias("node"), F.min(id_column).alias("low"))
    )
    of_a_set = sets.select(F.col("node").alias("_row")).hint("merge")
    nodes = materialize(base.drop(*keep).join(of_a_set, "_row", "left_semi").withColumnRenamed("_row", "node"))
    shared = materialize(_shared(nodes))
    nodes = nodes.drop("prefix").join(shared, "node")  # a node without a common token links with nothing
    nodes = materialize(nodes.select("node", "_text", "n", "lows", "signature", "wide", "fame", "kept"))
    # of two nodes with one text key, none exists: equal texts have equal sets
    star = _star_links(docs, nodes, k, num, den)
    groups = graph.components(star)
    asked = materialize(_candidates(nodes, groups, num, den))
    more = _open(docs, nodes, groups, asked, k, num, den)
    labels = graph.components(star.unionByName(more))

    named = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    by_set = named.join(lowest, "label").select("_set", "component_id", F.col("label").alias("_component"))
    out = base.select(*keep, "_text", "_row", F.col("n").cast("long").alias("n_shingles"), "_set").join(by_set, "_set", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(id_column))
    return out.select(*keep, "n_shingles", own.alias("component_id"), "_text", "_row", "_component")


def one_of_each(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), then of the
    first row. Rows without a shingle are linked with nothing and all stay."""
    given, back = shield(docs.withColumnsRenamed({text: "text"}), (id_column, "text"))
    others = (*(c for c in given.columns if c != "text"), "_null")
    given = given.withColumn("_null", F.col("text").isNull())  # their key is that of the empty text
    linked = materialize(link(given, k=k, num=num, den=den, keep=others, id_column=id_column))
    first = F.min(F.struct(F.col(id_column).isNull(), id_column, "_row")).alias("m")
    kept = linked.where("_component IS NOT NULL").groupBy("_component").agg(first).select(F.col("m._row").alias("_row"))
    rows = linked.join(kept, "_row", "left_semi").unionByName(linked.where("_component IS NULL"))
    texts = _keyed(given).groupBy("_text").agg(F.first("text").alias("text"))
    filled = rows.join(texts, "_text").withColumn("text", F.when(~F.col("_null"), F.col("text")))
    return back(filled).withColumnsRenamed({"text": text})
