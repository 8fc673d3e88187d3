"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is content-addressed (the SHA-256 of its text). The ledger has
a row per scan of a blob: the blob's address and, for each rule version that was run, the
spans found. A scan takes the distinct blobs of the given versions, leaves out the pairs of
blob and rule version that the ledger has, runs the rules on the rest, appends what it found
and joins the spans back to every version of every path.

Spans come from splitting: a text is cut at the matches of a rule, so the lengths of the
parts between and of the matches add up to the places of the matches, in code points.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemill.session import shared_folder

LEDGER = "blob string, entries array<struct<rule:string,version:string,spans:array<struct<start:int,stop:int>>>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least``
    characters or more. ``pattern`` must have at least ``group`` groups and match no empty text.
    ``hint`` is a plain lower-case text that every match contains in some case; it is looked for first."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"
    hint: tuple[str, ...] = ()


#: base kinds, fixed by their definition
BASE = (
    Rule(
        "assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 8, hint=("passw", "secret", "token", "api"),
    ),
    # a run of 16 characters or more is what is left of all runs after dropping the shorter ones
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, hint=("akia",)),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: public formats of keys, in addition
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint=("private key",)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", hint=("eyj",)),
    Rule("prefixed_key", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})", hint=("gh", "xox", "aiza")),
)
RULES = BASE + EXTRA


def find(text: Column, rule: Rule) -> Column:
    """The (start, stop) of a rule's matches in a text, in code points, stop exclusive."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, F.lit(f"({rule.pattern})" if not rule.pattern.startswith("(?i)") else f"(?i)({rule.pattern[4:]})"), F.lit(1))
    lengths = F.transform(whole, F.length)
    # what stands before each match; the part behind the last one is of no use
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(lengths)).alias("gap"), lengths.alias("n"), F.transform(kept, F.length).alias("key"))
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,stop:int>>)").alias("spans"))

    def add(seen, step):
        at = seen["at"] + step["gap"]
        stop = at + step["n"]
        one = F.array(F.struct(at.alias("start"), stop.alias("stop")))
        return F.struct(
            stop.alias("at"),
            F.when(step["key"] >= rule.least, F.concat(seen["spans"], one)).otherwise(seen["spans"]).alias("spans"),
        )

    return F.aggregate(steps, start, add, lambda seen: seen["spans"])


def _worth(text: Column, rule: Rule) -> Column:
    """Whether a rule can match at all: its hint is in the text, or a cheap search finds it."""
    if rule.hint:
        return text.rlike("(?i)" + "|".join(rule.hint))
    return text.rlike(rule.pattern)


def blobs_of(versions: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text): the distinct contents. Copies are dropped before anything is shuffled."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.sha2(content, 256).alias("blob"), content.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that the ledger does not have."""
    if ledger is None:
        todo = blobs.withColumn("_done", F.expr("CAST(array() AS array<string>)"))
    else:
        marks = F.transform("entries", lambda e: F.concat_ws("\x01", e["rule"], e["version"]))
        done = ledger.select("blob", marks.alias("m")).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("m"))).alias("_done"))
        todo = blobs.join(done, "blob", "left").withColumn("_done", F.coalesce("_done", F.expr("CAST(array() AS array<string>)")))
    none = F.expr("CAST(array() AS array<struct<start:int,stop:int>>)")
    entries = [
        F.when(
            ~F.array_contains("_done", f"{r.name}\x01{r.version}"),
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"),
                F.when(_worth(F.col("text"), r), find(F.col("text"), r)).otherwise(none).alias("spans"),
            ),
        )
        for r in rules
    ]
    unseen = F.exists(F.array(*(F.lit(f"{r.name}\x01{r.version}") for r in rules)), lambda m: ~F.array_contains("_done", m))
    return todo.where(unseen).select("blob", F.filter(F.array(*entries), lambda e: e.isNotNull()).alias("entries"))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Scan all ``versions`` against the ledger stored at the address ``ledger``, and add to it.

    Returns a row per version: the ``keep`` columns and ``spans``, an array of (kind, start,
    stop) by start, then in the order of ``rules``. Only rules given are reported, in their
    given version. A null text is an empty one and has no spans; repeated versions are
    reported each; without versions nothing is scanned.

    The ledger grows by one committed write per call, so a call that failed leaves it as it
    was. A blob that half of all versions share is scanned once; adaptive execution splits
    its join back to them.
    """
    spark = versions.sparkSession
    known = _load(spark, ledger)
    scan_blobs(blobs_of(versions, text), known, rules).write.mode("append").parquet(ledger)
    mine = F.array(*(F.lit(f"{r.name}\x01{r.version}") for r in rules))
    flat = F.flatten(F.transform(
        F.filter("entries", lambda e: F.array_contains(mine, F.concat_ws("\x01", e["rule"], e["version"]))),
        lambda e: F.transform(e["spans"], lambda s: F.struct(
            s["start"].alias("start"), F.array_position(mine, F.concat_ws("\x01", e["rule"], e["version"])).cast("int").alias("rank"),
            e["rule"].alias("kind"), s["stop"].alias("stop"))),
    ))
    found = spark.read.schema(LEDGER).parquet(ledger).select("blob", flat.alias("s")).where(F.size("s") > 0)
    found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    out = versions.select(*keep, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_blob"))
    out = out.join(found, out["_blob"] == found["blob"], "left")
    spans = F.transform("s", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    empty = F.expr("CAST(array() AS array<struct<kind:string,start:int,stop:int>>)")
    return out.select(*keep, F.coalesce(spans, empty).alias("spans"))


def _load(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(ledger) if there else None


def new_ledger(spark: SparkSession) -> str:
    """An address for a ledger below the shared folder."""
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def as_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of some kinds), comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
