"""Model-ready tables from ``embeddings``."""

from pyspark.sql import functions as F

from pulsemill.functions import arrays
from pulsemill.plans import marts
from pulsemill.sources.marts import with_record_ids
from queryset.base import query, r6, sql
from queryset.inputs import ACC_RAW, PPG_RAW, SIGNALS, signal_registry, zscored_sql
from queryset.signals import RESAMPLE


@query(
    "tensor_mart",
    sql(
        [SIGNALS, PPG_RAW.replace("ppg_raw AS", "src AS"), RESAMPLE,
         "ppg_raw AS (SELECT vec_id, j AS i, sum(w * x) AS x FROM src JOIN kern USING (i) GROUP BY vec_id, j)",
         zscored_sql("ppg")],
        f"""SELECT 'hr' AS task, s.split, s.subject_id, s.record_id, {r6('s.hr_ref')} AS y, count(*) AS n,
        ROUND(sum(CAST(CAST(z.z AS FLOAT) AS DOUBLE) * (z.i + 1)), 4) + 0e0 AS checksum
        FROM signals s JOIN ppg_z z ON s.vec_id = z.vec_id WHERE s.quality_label = 1 GROUP BY ALL""",
    ),
)
def tensor_mart(spark, sf):
    """Good windows resampled to 45 Hz and z-scored, with their heart rate."""
    mart = marts.tensor_mart(signal_registry(spark, sf), "hr", target_fs=45.0)
    weighted = F.transform("x", lambda v, i: v.cast("double") * (i + 1))
    return mart.select(
        "task", "split", "subject_id", "record_id", "y", F.size("x").alias("n"),
        F.round(arrays.total(weighted), 4).alias("checksum"),
    )


@query(
    "subject_tensors",
    sql(
        [SIGNALS],
        """SELECT 'quality' AS task, split, subject_id, part, count(*) AS n,
        string_agg(record_id, ',' ORDER BY record_id) AS record_ids, CAST(sum(quality_label) AS BIGINT) AS n_good
        FROM (SELECT *, (row_number() OVER (PARTITION BY split, subject_id ORDER BY record_id) - 1) // 3 AS part FROM signals)
        GROUP BY split, subject_id, part""",
    ),
)
def subject_tensors(spark, sf):
    """The windows of a subject packed in record order, three to a part."""
    packed = marts.subject_tensors(marts.tensor_mart(signal_registry(spark, sf), "quality"), rows_per_part=3)
    return packed.select(
        "task", "split", "subject_id", "part", F.size("x").alias("n"),
        F.array_join("record_ids", ",").alias("record_ids"),
        F.aggregate("y", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("n_good"),
    )


@query(
    "tensor_record_ids",
    sql(
        [SIGNALS],
        """SELECT vec_id, CASE WHEN has_acc THEN record_id ELSE subject_id || '_' || CAST(label AS VARCHAR) END AS record_id
        FROM signals""",
    ),
)
def tensor_record_ids(spark, sf):
    """Windows whose id was not stored get one from subject and position."""
    rows = signal_registry(spark, sf).select(
        "vec_id", "subject_id", F.when(F.col("has_acc"), F.col("record_id")).alias("record_id"),
        ((F.col("hr_ref") - 50.5) / 7.0).cast("bigint").alias("position"),
    )
    return with_record_ids(rows).select("vec_id", "record_id")


@query(
    "mart_manifest",
    sql(
        [SIGNALS],
        """SELECT 'hr' AS task, f.split, count(DISTINCT subject_id) AS subjects, count(subject_id) AS windows,
        50e0 AS target_fs, 30e0 AS source_fs, 'zscore' AS normalize, CAST(42 AS BIGINT) AS seed
        FROM (VALUES ('train'), ('val'), ('test')) f(split)
        LEFT JOIN signals s ON s.split = f.split AND quality_label = 1 AND s.split <> 'val' GROUP BY f.split""",
    ),
)
def mart_manifest(spark, sf):
    """A mart whose validation fold is empty still lists it."""
    mart = marts.tensor_mart(signal_registry(spark, sf).where("split <> 'val'"), "hr")
    return marts.manifest(mart, target_fs=50.0, source_fs=30.0, normalize="zscore", seed=42)


def _entry_sql(p: str, what: str) -> str:
    """Prompt sentence of {p}_st as (vec_id, text)."""
    return f"""
{p}_entry AS (SELECT vec_id, 'This is the {what}, it has mean ' || printf('%.4f', m) || ' and std '
                || printf('%.4f', s) || '.' AS text, n FROM {p}_st)"""


AXES = [
    f"""{a}_raw AS (SELECT vec_id, i - {21 * k} AS i, x FROM ppg_raw WHERE i >= {21 * k} AND i < {21 * k + 21})"""
    for k, a in enumerate("xyz")
]
ENTRIES = [
    SIGNALS, PPG_RAW, ACC_RAW, *AXES,
    *[zscored_sql(p) for p in ("ppg", "acc", "x", "y", "z")],
    _entry_sql("ppg", "PPG signal"),
    _entry_sql("acc", "accelerometer magnitude (L2 norm of the 3 axes)"),
    *[_entry_sql(a, f"accelerometer data on the {a}-axis") for a in "xyz"],
]


@query(
    "prompt_records",
    sql(
        ENTRIES,
        f"""SELECT s.record_id, s.subject_id, s.split, 'hr' AS task,
        CASE WHEN s.has_acc THEN 2 ELSE 1 END + CAST(0 AS BIGINT) AS n_series,
        p.text || CASE WHEN s.has_acc THEN chr(10) || a.text ELSE '' END AS texts,
        CAST(CAST(round_even(s.hr_ref, 0) AS BIGINT) AS VARCHAR) AS answer,
        CAST(s.quality_label AS BIGINT) AS quality_label, {r6('s.hr_ref')} AS hr_ref,
        '{marts.PRE_PROMPT}' AS pre_prompt,
        '{marts.HR_POST_PROMPT.replace("'", "''")}' AS post_prompt
        FROM signals s JOIN ppg_entry p ON s.vec_id = p.vec_id JOIN acc_entry a ON s.vec_id = a.vec_id
        WHERE s.quality_label = 1""",
    ),
)
def prompt_records(spark, sf):
    """HR prompt records with the ACC magnitude where there is one."""
    mart = marts.prompt_mart(signal_registry(spark, sf), "hr", acc_mode="magnitude")
    return mart.select(
        "record_id", "subject_id", "split", "task", F.size("time_series").alias("n_series"),
        F.array_join("time_series.text", "\n").alias("texts"), "answer", "quality_label", "hr_ref",
        "pre_prompt", "post_prompt",
    )


@query(
    "prompt_series_axes",
    sql(
        ENTRIES,
        f"""SELECT record_id, CAST(pos AS BIGINT) AS pos, text, n, {r6('v')} AS checksum FROM (
        SELECT s.record_id, 0 AS pos, e.text, e.n, v.v FROM signals s JOIN ppg_entry e ON s.vec_id = e.vec_id
          JOIN (SELECT vec_id, sum(z * (i + 1)) AS v FROM ppg_z GROUP BY vec_id) v ON v.vec_id = s.vec_id
        """ + "".join(
            f"""UNION ALL SELECT s.record_id, {k} AS pos, e.text, e.n, v.v FROM signals s
          JOIN {a}_entry e ON s.vec_id = e.vec_id
          JOIN (SELECT vec_id, sum(z * (i + 1)) AS v FROM {a}_z GROUP BY vec_id) v ON v.vec_id = s.vec_id
          WHERE s.has_acc """
            for k, a in enumerate("xyz", start=1)
        ) + ")",
    ),
)
def prompt_series_axes(spark, sf):
    """The series of quality prompt records in axes mode, one row per entry."""
    mart = marts.prompt_mart(signal_registry(spark, sf), "quality", acc_mode="axes")
    rows = mart.select("record_id", F.posexplode_outer("time_series").alias("pos", "e"))
    weighted = F.transform("e.series", lambda v, i: v * (i + 1))
    return rows.select(
        "record_id", "pos", "e.text", F.size("e.series").alias("n"),
        arrays.total(weighted).alias("checksum"),
    )


@query(
    "prompt_records_without_acc",
    sql(
        ENTRIES,
        """SELECT s.record_id, p.text AS texts, CASE WHEN s.quality_label = 1 THEN 'good' ELSE 'bad' END AS answer
        FROM signals s JOIN ppg_entry p ON s.vec_id = p.vec_id""",
    ),
)
def prompt_records_without_acc(spark, sf):
    mart, _ = marts.answered(marts.prompt_mart(signal_registry(spark, sf), "quality", acc_mode="none"))
    return mart.select("record_id", F.array_join("time_series.text", "\n").alias("texts"), "answer")
