"""Mixing sources to target weights: repetition rates per source, copies per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsemill.llm.columns import shield
from pulsemill.operators.scale import dense_index, sorted_runs
from pulsemill.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: no source is repeated more often than this
MOST = 3.0
#: parts of the range of draws in which words are summed before single documents are looked at
PARTS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space and the controls 9 to 13; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only."""
    parts = [F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys]
    digits = F.substring(F.md5(F.concat_ws("\x01", F.lit(str(seed)), *parts)), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def weights_in_turn(sources: DataFrame, turn: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Weights for the sources: 1, 2, 3, 1, ... by code point, null last."""
    keyed = sources.withColumns({"_all": F.lit(0), "_null": F.col("source").isNull()})
    placed = dense_index(keyed, ["_all"], ["_null", "source"], "_place").drop("_all", "_null")
    weight = F.element_at(F.array(*map(F.lit, turn)), (F.col("_place") % len(turn)).cast("int") + 1)
    return placed.withColumn("weight", weight).drop("_place")


def targets(sizes: DataFrame, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(source, weight, source_size) -> the same with ``target``.

    The targets add up to ``share`` of all sizes, in the proportion of the weights, as far
    as no source has to be taken more than ``most`` times; what is over goes to the others
    by weight, again and again. Sources fill up in the order of size over weight, so the
    level at which this ends follows from running sums over that order: with the first j
    sources full, the others get (budget - most * their sizes) / (their weight) per weight,
    and the right j is the first for which source j+1 stays below its limit. There is one
    row per source here; sums run within pieces of the sorted sources, and over a row per piece.
    """
    full = F.col("source_size") * F.lit(most)
    keyed = sizes.withColumns({"_all": F.lit(0), "_full": full, "_ratio": full / F.col("weight"), "_null": F.col("source").isNull()})
    runs = sorted_runs(keyed, ["_all"], ["_ratio", "_null", "source"])
    earlier = Window.partitionBy("_all").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    pieces = materialize(
        runs.groupBy("_all", "run").agg(*(F.sum(c).cast("double").alias(c) for c in ("_full", "weight", "source_size"))).select(
            "run", F.coalesce(F.sum("_full").over(earlier), none).alias("_full0"), F.coalesce(F.sum("weight").over(earlier), none).alias("_weight0"),
            *(F.sum(c).over(Window.partitionBy("_all")).alias(f"_all_{c}") for c in ("weight", "source_size")),
        )
    )
    before = Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.coalesce(F.sum(c).over(before), none)
    step = runs.withColumns({"_full1": over("_full"), "_weight1": over("weight")}).join(pieces, "run")
    left = F.col("_all_source_size") * F.lit(share) - F.col("_full0") - F.col("_full1")
    reached = F.greatest(left, none) / (F.col("_all_weight") - F.col("_weight0") - F.col("_weight1"))
    level = step.select(F.max(F.when(reached * F.col("weight") <= F.col("_full"), reached))).first()[0]  # one number
    target = full if level is None else F.least(F.lit(level) * F.col("weight"), full)
    return sizes.withColumn("target", target)


def mix(
    docs: DataFrame, *, id_column: str = "doc_id", source: str = "source", size: Column | None = None,
    weights: DataFrame | None = None, share: float = 1.0, most: float = MOST, seed: int = 0, settle: bool = True,
) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target``, ``_rate`` and ``_copies``.

    The rate of a source is its target over its size. A document is taken floor(rate) times
    and once more if its draw, a number from 0 to 1 that a hash of id and text gives, is below
    the rest of the rate. With ``settle`` the bound is moved from there to the draw at which the
    words taken come nearest to the target, which matters for sources of few or of very
    different documents; it nears the rest as a source grows. Reruns agree.

    Sizes are summed per source and part of the range of draws before anything is shuffled,
    and only the one part in which a source reaches its target is looked at again. The one row
    per source is joined back by adaptive execution, which splits a hot source. ``weights`` is
    (source, weight) and defaults to 1, 2, 3 in turn; a source without a weight is not taken.

    Null sources form one source; null texts have size 0 and follow their source's rate;
    a source without words has target 0 and rate 0; an empty table stays empty. Repeated rows
    (of one id, text and source) share a draw; with ``settle``, where a source's target lies
    among them, as many of them as come nearest to it are taken once more than the others.
    Columns with the names of results are replaced, and others pass through.
    """
    results = ["_size", "_source_size", "_target", "_rate", "_copies"]
    plain, _ = shield(docs.drop(*results), own := (id_column, "text", source))
    to = {p: c for p, c in zip(plain.columns, docs.drop(*results).columns, strict=True) if p not in own}
    n = word_count(F.col("text")) if size is None else size
    u = draw(F.col(id_column), F.md5(F.coalesce("text", F.lit(""))), seed=seed)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    if size is not None:  # may look at any column
        sized = docs.drop(*results).withColumn("_size", n).select("_size", *(F.col(f"`{c}`").alias(p) for p, c in zip(plain.columns, docs.drop(*results).columns, strict=True)))
    else:
        sized = plain.withColumn("_size", n)
    sized = sized.withColumns({"_draw": u, "_key": key}).withColumn("_part", F.floor(F.col("_draw") * PARTS))
    cells = materialize(sized.groupBy(F.col(source).alias("source"), "_key", "_part").agg(F.sum("_size").alias("words")))
    per_source = cells.groupBy("source", "_key").agg(F.sum("words").alias("source_size"))
    if weights is None:
        weighed = weights_in_turn(per_source)
    else:
        w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double"))
        weighed = per_source.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = materialize(targets(weighed.where("weight > 0"), share, most).select("_key", "source_size", "target", rate.alias("rate")))
    rest = F.col("rate") - F.floor("rate")
    bounds = aims.select("_key", rest.alias("bound"), F.lit(0).cast("long").alias("some"))
    if settle:
        bounds = materialize(_settled(sized, cells, aims.select("_key", (rest * F.col("source_size")).alias("wanted"))))
    per_key = aims.join(bounds, "_key", "left").select(
        "_key", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"),
        F.when(rest > 0, F.coalesce("bound", F.lit(0.0))).otherwise(0.0).alias("_bound"),
        F.when(rest > 0, F.coalesce("some", F.lit(0))).otherwise(0).cast("long").alias("_some"),
    )
    out = sized.join(materialize(per_key), "_key", "left").fillna(0.0, ["_rate", "_target", "_bound"])
    extra = F.col("_draw") < F.col("_bound")
    if settle and not bounds.where("some > 0").isEmpty():
        split = (F.col("_some") > 0) & (F.col("_draw") == F.col("_bound"))
        repeated = dense_index(out.where(split).withColumn("_row", F.monotonically_increasing_id()), ["_key"], ["_row"], "_place")
        out = out.where(~split | split.isNull()).withColumn("_extra", extra).unionByName(
            repeated.withColumn("_extra", F.col("_place") < F.col("_some")).drop("_row", "_place")
        )
    else:
        out = out.withColumn("_extra", extra)
    out = out.withColumn("_copies", F.floor("_rate") + F.col("_extra").cast("long"))
    first = [F.col(f"`{p}`").alias(to.get(p, p)) for p in plain.columns]
    return out.select(*first, *results)


def _settled(sized: DataFrame, cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_key, bound, some): documents with a draw below ``bound``, and ``some`` of the equal
    ones with that draw, hold the number of words nearest to ``wanted``."""
    order = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(order), F.lit(0))
    met = cells.select("_key", "_part", "words", before.alias("before")).join(wanted, "_key").where(
        (F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted"))
    )
    met = materialize(met.select("_key", "_part", "before", "wanted"))  # one part of each source
    near = sized.join(met, ["_key", "_part"]).groupBy("_key", "before", "wanted", "_draw").agg(
        F.sum("_size").alias("words"), F.count(F.lit(1)).alias("rows")
    )
    upto = Window.partitionBy("_key").orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("sum", F.col("before") + F.sum("words").over(upto))
    at = near.where("sum > wanted").groupBy("_key").agg(F.min_by(F.struct("_draw", "rows", "words", "sum", "wanted"), "_draw").alias("at"))
    each = F.col("at")["words"] / F.col("at")["rows"]  # repeated rows have one size
    left = F.col("at")["wanted"] - (F.col("at")["sum"] - F.col("at")["words"])
    whole = F.floor(left / each)
    some = whole + (each - (left - whole * each) < left - whole * each).cast("long")
    step = F.lit(2.0**-49)  # draws are multiples of twice that
    all_of_them = some >= F.col("at")["rows"]
    return at.select(
        "_key", F.when(all_of_them, F.col("at")["_draw"] + step).otherwise(F.col("at")["_draw"]).alias("bound"),
        F.when(all_of_them, F.lit(0)).otherwise(some).cast("long").alias("some"),
    )


def repeat(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``_copies`` says, without the helper columns."""
    helpers = ["_size", "_source_size", "_target", "_rate", "_copies"]
    kept = [F.col(f"`{c}`") for c in mixed.columns if c not in helpers]
    times = F.explode(F.sequence(F.lit(1), F.col("_copies")))
    return mixed.where("_copies > 0").select(*kept, times.alias("_turn")).select(*kept)
