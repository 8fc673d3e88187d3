"""Merkle manifest of a table: a tree of digests per group, and one over the groups.

Rows become leaves; in each group they stand in ascending order of a key, and every
``fanout`` consecutive nodes make the node above them. A slot pivot builds the trees:
one aggregation per round spreads the nodes below an ancestor into slot columns (as many
as make some whole levels, ``SLOTS`` at most). The digests of the levels between follow
from concatenated columns, and a node's siblings are the columns of its run but its own.

Digests are lowercase hexadecimal SHA-256 of concatenated inputs. Going up, each round
shuffles a ``SLOTS``-th of the rows before; going down, a block joins the path above it by
(group, place), so that a group with a third of all rows is spread like any other.

Nulls: a null field counts as ``-``; a null group is a group of its own and stands first; a
null key stands first in its group. Rows with equal keys are ordered by their digest, and
repeated rows are leaves of their own. An empty table has no rows and no root. Columns that
are not named are not looked at, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsemill.operators.scale import sorted_runs
from pulsemill.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = 16


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field's length in bytes and value, or a dash for a null."""
    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, fields)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its way up."""
    return F.aggregate(path, start, lambda h, run: F.sha2(F.concat(run["before"], h, run["after"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings on a path, left to right and from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), ""), 256)


def manifest(
    df: DataFrame,
    key: str = "doc_id",
    group: str = "lang",
    fields: Sequence[str] = FIELDS,
    fanout: int = 2,
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``df``: key, group, leaf, subroot (of its group), root, path, and
    the columns that ``keep`` names. ``path`` lists the siblings of each level that has more
    than one node, from the leaf's to the root's: digests before and after, concatenated."""
    if fanout < 2:
        raise ValueError("a node needs at least two slots")
    keep = dict(keep or {})
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp"),  # keeps the order, null first
        F.col(f"`{key}`").alias("key"),
        leaf([F.col(f"`{c}`") for c in fields]).alias("hash"),
        F.struct(F.col(f"`{group}`").alias("group"), *(c.alias(name) for name, c in keep.items())).alias("kept"),
    )
    levels, tops = _up(_numbered(rows, ["key", "hash"]), fanout)
    subtree, single = _up(_numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "hash"), ["of"]), fanout)
    last = single.select("hash").first()
    root = F.lit(last["hash"] if last else None).cast("string")
    empty = F.expr("cast(array() as array<struct<before: string, after: string>>)")
    over = _down(subtree, single.withColumn("path", empty), ["of", F.col("hash").alias("subroot")])
    if not subtree:  # one group at most: its root is the root
        over = tops.select(F.col("grp").alias("of"), F.col("hash").alias("subroot"), empty.alias("path"))
    above = over.select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "subroot", "path")
    own = ["key", F.col("hash").alias("leaf"), "kept"]
    if levels:
        out = _down(levels, above, own, "subroot")
    else:  # no group has two rows: the leaves are the top nodes
        out = tops.join(above.drop("pos"), "grp").select(*own, "subroot", "path")
    return out.select(
        F.col("key").alias(key), F.col("kept")["group"].alias(group), "leaf", "subroot", root.alias("root"), "path",
        *(F.col("kept")[name].alias(name) for name in keep),
    )


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with each one's place ``pos`` in its ``grp`` and the group's size ``n``.

    A group covers as many range partitions as its rows need; sums over (group, run), a
    row each, complete the places.
    """
    runs = sorted_runs(rows, ["grp"], order)
    earlier = W.partitionBy("grp").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    sums = runs.groupBy("grp", "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("here"))
    shifts = materialize(sums.select(  # written, so that its size decides how it is joined
        "grp", "run", (F.coalesce(F.sum("here").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(W.partitionBy("grp")).alias("n"),
    ))
    return runs.join(shifts, ["grp", "run"]).withColumn("pos", F.col("pos") + F.col("shift")).drop("run", "shift")


def _steps(fanout: int) -> int:
    """Levels that one pivot holds."""
    steps = 1
    while fanout ** (steps + 1) <= SLOTS:
        steps += 1
    return steps



def _up(nodes: DataFrame, fanout: int) -> tuple[list[tuple[DataFrame, DataFrame, int]], DataFrame]:
    """Rounds of (nodes, blocks, fanout) from the leaves on, and the top node of each group."""
    steps = _steps(fanout)
    span = fanout**steps
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most > 1:
        blocks = materialize(_pivot(nodes, fanout, steps))
        levels.append((nodes, blocks, fanout))
        nodes = blocks.select("grp", F.col("parent").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("top").alias("hash"))
        most = -(-most // span)
    return levels, nodes


def _pivot(nodes: DataFrame, fanout: int, steps: int) -> DataFrame:
    """Per block of ``fanout ** steps`` consecutive nodes its nodes level by level, and the node above all."""
    span = fanout**steps
    slot = F.col("pos") % span
    out = nodes.groupBy("grp", F.expr(f"pos div {span}").alias("parent"), "n").agg(
        *(F.max(F.when(slot == i, F.col("hash"))).alias(f"c{i}") for i in range(span))
    )
    out = out.select("grp", "parent", "n", F.array_compact(F.array(*(f"c{i}" for i in range(span)))).alias("level0"))
    for j in range(steps):
        below = F.col(f"level{j}")
        out = out.withColumn(f"level{j + 1}", F.when(_more(j, fanout), _parents(below, fanout)).otherwise(below))
    return out.select("grp", "parent", "n", *(f"level{j}" for j in range(steps)), F.col(f"level{steps}")[0].alias("top"))


def _parents(below: Column, fanout: int) -> Column:
    """The digests of each ``fanout`` consecutive ones, concatenated."""
    starts = F.sequence(F.lit(1), F.size(below), F.lit(fanout))
    return F.transform(starts, lambda at: F.sha2(F.array_join(F.slice(below, at, F.lit(fanout)), ""), 256))


def _more(level: int, fanout: int) -> Column:
    """Whether the group has more than one node on a level of its block."""
    return F.col("n") > fanout**level


def _down(levels: list, above: DataFrame, own: list, *passed: str) -> DataFrame:
    """Paths of the first round's nodes, with their columns ``own``, from those of the top nodes."""
    for k, (nodes, blocks, fanout) in reversed(list(enumerate(levels))):
        steps = _steps(fanout)
        up = above.select("grp", F.col("pos").alias("parent"), F.col("path").alias("upper"), *passed)
        blocks = blocks.drop("top").join(up, ["grp", "parent"])
        at = nodes.withColumn("parent", F.expr(f"pos div {fanout**steps}")).drop("n").join(blocks, ["grp", "parent"])
        runs = []
        for j in range(steps):
            place = F.expr(f"cast((pos div {fanout**j}) % {fanout ** (steps - j)} as int)")
            own_slot, level = place % fanout, F.col(f"level{j}")
            before = F.array_join(F.slice(level, place - own_slot + 1, own_slot), "")
            after = F.array_join(F.slice(level, place + 2, F.lit(fanout - 1) - own_slot), "")
            runs.append(F.when(_more(j, fanout), F.struct(before.alias("before"), after.alias("after"))))
        path = F.concat(F.array_compact(F.array(*runs)), F.col("upper")).alias("path")
        columns = own if k == 0 else ["grp", "pos"]
        above = at.select(*columns, *passed, path)
    return above
