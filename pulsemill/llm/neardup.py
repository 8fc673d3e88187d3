"""Near duplicates among embedding vectors of one label, by cross-polytope hashing.

A vector is rotated pseudo-randomly (three rounds of random signs and a fast Hadamard
transform); its hash is the axis it lies nearest to. ``ROTATIONS`` hashes together name a
cell, and each of ``TABLES`` tables gives a vector the cell of its nearest axes and, as
multiprobes, the next likely ones, in which one hash or more takes the second nearest axis. Two
vectors are compared if they share any cell, and linked by their cosine in double precision.

What is not spread out: equal vectors are one node with a count. Cells that hold one node,
or the very nodes of another cell, are dropped before any vector moves. A cell's nodes are
dealt into blocks of about ``BLOCK``; a task multiplies two blocks and returns, per node, how
many rows it is linked with, and a spanning set of links: pairs are never written out. A
pair that shares several cells is counted in the one with the smallest code. All members of a
cell are compared, with no bound on its size: a group of m near copies costs m * m / 2
products, and its nodes move m / ``BLOCK`` times.

A vector that is null, empty, zero, or has null or non-finite components links with nothing,
nor does one with a null label; vectors of different lengths are not compared. Repeated rows
are vectors of their own. A component is named by the smallest vec_id in it that is not
null; a vector is kept if it has that id (all rows that have it), alone also with a null id. An
empty table gives an empty result. Columns that are not named are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsemill.llm.graph import components
from pulsemill.llm.words import as_long, lists, mix
from pulsemill.session import materialize

TABLES = 3
ROTATIONS = 3
PROBES = 4
BLOCK = 256
#: vectors of at most so many components in all are hashed at once
PIECE = 1 << 20


def near_duplicates(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding, label)."""
    kind = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.exists(kind, lambda x: x != 0) & F.forall(
        kind, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    )
    same = ["label", "high", "low"]
    keyed = vectors.select(
        "vec_id", "label", "embedding", F.xxhash64("embedding").alias("high"), F.xxhash64(F.lit(seed), "embedding").alias("low"),
        F.coalesce(fine, F.lit(False)).alias("fine"),
    )
    nodes = materialize(
        keyed.where("fine").groupBy(*same)
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"), F.first("embedding").alias("embedding"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    met = materialize(_links(nodes, least, tables, probes, seed))
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(met.where("node != link").select(F.col("node").alias("a"), F.col("link").alias("b")))
    joined = nodes.select("node", "first", "size", *same).join(labels.withColumnRenamed("label", "group"), "node", "left")
    joined = materialize(joined.withColumn("group", F.coalesce("group", "node")))
    names = joined.groupBy("group").agg(F.min("first").alias("component_id"))
    per = joined.join(names, "group").join(counts, "node", "left").select(
        *same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    linked = per.where("n_links > 0")  # the others are known by themselves
    out = keyed.drop("embedding").join(linked.withColumn("fine", F.lit(True)), [*same, "fine"], "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _links(nodes: DataFrame, least: float, tables: int, probes: int, seed: int) -> DataFrame:
    """(node, links, link): parts of each node's number of linked rows, and links that join what is linked."""
    codes = materialize(
        nodes.select("node", "label", "embedding").mapInArrow(_hasher(tables, probes, seed), f"node bigint, label {dict(nodes.dtypes)['label']}, cells array<bigint>")
    )
    entries = codes.select("label", F.explode("cells").alias("cell"), "node")
    cells = entries.groupBy("label", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("m0"), F.max("node").alias("m1"),
        F.bit_xor(F.xxhash64("node")).alias("m2"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("m3"),
    ).where("n > 1")
    cells = cells.groupBy("label", "n", "m0", "m1", "m2", "m3").agg(F.min("cell").alias("cell")).select("label", "cell", "n")
    own = entries.join(cells, ["label", "cell"]).groupBy("node").agg(F.collect_list(F.struct("cell", "n")).alias("own"))  # tables * probes at most
    members = own.join(nodes.select("node", "label", "embedding", "size"), "node").select(
        "node", "label", "embedding", "size", F.col("own")["cell"].alias("cells"), F.explode("own").alias("at")
    )
    blocks = F.ceil(F.col("at")["n"] / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["label", "cell", "left", "right"]
    dealt = members.select(
        "label", F.col("at")["cell"].alias("cell"), F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        "block", "node", "size", "cells", "embedding",
    )
    hashed = dealt.withColumn("pair", F.xxhash64(*key))
    return hashed.repartition("pair").sortWithinPartitions("pair", *key).select("pair", *key[1:], "block", "node", "size", "cells", "embedding").mapInArrow(
        _comparer(least), "node bigint, links bigint, link bigint"
    )


# -- hashing -----------------------------------------------------------------------------


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length, some at a time, and their unit vectors in double precision."""
    column = batch.column("embedding")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        step = max(1, PIECE // int(d))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            yield part, unit(flat[first[part][:, None] + np.arange(d)])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, of a power of two of components."""
    n, d = x.shape
    half = 1
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def cells_of(x: np.ndarray, tables: int, probes: int, seed: int) -> np.ndarray:
    """Per unit vector its cells in each table, the likeliest ``probes`` of them."""
    n, d = x.shape
    wide = np.zeros((n, 1 << max(1, (d - 1).bit_length())))
    wide[:, :d] = x
    choices = np.array(list(itertools.product([0, 1], repeat=ROTATIONS)), np.int64)
    out = []
    for table in range(tables):
        axes, losses = [], []
        for turn in range(ROTATIONS):
            draw = np.random.default_rng([seed, table, turn, d])
            y = wide
            for _ in range(3):
                y = hadamard(y * draw.choice([-1.0, 1.0], y.shape[1]))
            near = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            value = np.take_along_axis(y, near, 1)
            order = np.argsort(-np.abs(value), axis=1, kind="stable")
            near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
            axes.append(near * 2 + (value < 0))
            losses.append((np.abs(value[:, 0]) - np.abs(value[:, 1])) ** 2)
        cost = np.stack(losses, 1) @ choices.T  # of taking the second axis in some turns
        for pick in choices[np.argsort(cost, axis=1, kind="stable")[:, :probes]].transpose(1, 0, 2):
            code = np.full(n, (d << 8) + table, np.uint64)
            for turn in range(ROTATIONS):
                axis = np.take_along_axis(axes[turn], pick[:, turn : turn + 1], 1)[:, 0]
                code = mix(code * np.uint64(0x9E3779B97F4A7C15) + axis.astype(np.uint64) + np.uint64(1))
            out.append(code.view(np.int64))
    return np.stack(out, 1)


def _hasher(tables: int, probes: int, seed: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _matrices(batch):
                found = np.sort(cells_of(x, tables, probes, seed), axis=1)
                fresh = np.concatenate([np.ones((len(rows), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").take(at), batch.column("label").take(at), lists(as_long(found[fresh]), fresh.sum(1))], ["node", "label", "cells"]
                )

    return cells


# -- comparing ---------------------------------------------------------------------------


def _comparer(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch] if rest is None else [*rest, batch])
            key = held["pair"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            whole = int(cuts[-1]) if len(cuts) else 0
            if whole:
                yield from _groups(held.slice(0, whole), cuts, least)
            rest = held.slice(whole).to_batches()
        if rest:
            held = pa.Table.from_batches(rest)
            key = held["pair"].to_numpy()
            yield from _groups(held, np.concatenate([np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]), least)

    return compare


def _groups(held: pa.Table, ends: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Parts of the result for whole pairs of blocks, each of which ends at one of ``ends``."""
    batch = held.combine_chunks().to_batches()[0]
    plain = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "left", "right", "block", "node", "size")}
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = batch.column("cells").flatten().to_numpy(zero_copy_only=False)
    many = pc.list_value_length(batch.column("cells")).to_numpy(zero_copy_only=False).astype(np.int64)
    at, code_at = np.concatenate([[0], np.cumsum(width)]), np.concatenate([[0], np.cumsum(many)])
    out: list[tuple] = []
    for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
        x = unit(flat[at[a] : at[b]].reshape(b - a, width[a]))
        left = plain["block"][a:b] == plain["left"][a]
        inside = plain["left"][a] == plain["right"][a]
        rows, cols = np.flatnonzero(left), np.flatnonzero(left if inside else ~left)
        if not len(rows) or not len(cols):
            continue
        near = x[rows] @ x[cols].T >= least
        if inside:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        counted = near
        earlier = codes[code_at[a] : code_at[b]] < plain["cell"][a]
        owner = np.repeat(np.arange(b - a), many[a:b])[earlier]
        if len(owner):  # the pair shares a cell that comes first
            names, place = np.unique(codes[code_at[a] : code_at[b]][earlier], return_inverse=True)
            holds = np.zeros((b - a, len(names)), np.float32)
            holds[owner, place] = 1
            counted = near & (holds[rows] @ holds[cols].T == 0)
        size = plain["size"][a:b]
        links = np.zeros(b - a, np.int64)
        links[rows] += counted @ size[cols]
        if not inside:
            links[cols] += size[rows] @ counted
        root = np.arange(b - a)
        while True:  # the least row that each can reach
            low = root.copy()
            np.minimum.at(low, rows, np.where(near, root[cols], b - a).min(axis=1))
            np.minimum.at(low, cols, np.where(near, root[rows][:, None], b - a).min(axis=0))
            low = low[low]
            if (low == root).all():
                break
            root = low
        told = (links > 0) | (root != np.arange(b - a))
        node = plain["node"][a:b]
        out.append((node[told], links[told], node[root][told]))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "link"])


def recall(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, seed: int = 11, one_in: int = 50) -> float:
    """The share of the links of every ``one_in``-th vec_id that share a cell, all other rows compared in blocks.

    For choosing ``tables`` and ``probes``: the sample stands on the driver in parts of ``BLOCK``.
    """
    own = vectors.where(f"vec_id % {one_in} = 0").select("vec_id", "label", "embedding").where("label is not null")
    given = vectors.select("vec_id", "label", "embedding").where("label is not null")
    found = hit = 0
    asked = own.toLocalIterator()
    while part := list(itertools.islice(asked, BLOCK)):
        there = given.mapInArrow(_checker([(r["vec_id"], r["label"], list(r["embedding"] or [])) for r in part], least, tables, probes, seed), "found bigint, hit bigint")
        sums = there.agg(F.sum("found"), F.sum("hit")).first()
        found, hit = found + (sums[0] or 0), hit + (sums[1] or 0)
    return hit / found if found else 1.0


def _checker(asked: list[tuple], least: float, tables: int, probes: int, seed: int):
    asked = [a for a in asked if a[2] and all(x is not None and np.isfinite(x) for x in a[2]) and any(a[2])]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = hit = 0
        for batch in batches:
            fine = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for e in batch.column("embedding").to_pylist()]
            batch = batch.filter(pa.array(fine, pa.bool_()))
            label, ids = batch.column("label").to_pylist(), batch.column("vec_id").to_pylist()
            for rows, x in _matrices(batch):
                theirs = cells_of(x, tables, probes, seed)
                for vec, of, e in asked:
                    if len(e) != x.shape[1]:
                        continue
                    q = unit(np.array([e], float))
                    ours = cells_of(q, tables, probes, seed)[0]
                    able = np.array([label[r] == of and ids[r] != vec for r in rows]) & ((x @ q[0]) >= least)
                    found += int(able.sum())
                    hit += int((np.isin(theirs[able], ours).any(axis=1)).sum())
        yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([hit])], ["found", "hit"])

    return check
