"""Registry scans, filters and joins."""

from pyspark.sql import functions as F

from pulsemill.functions import labels
from pulsemill.operators import records
from queryset.base import query, r6, sql, table
from queryset.inputs import HASHED_SPLIT, REGISTRY, hashed_split, registry


@query(
    "registry_scan",
    sql(
        [REGISTRY],
        f"""SELECT record_id, subject_id, dataset, CAST(quality_label AS BIGINT) AS quality_label,
        {r6('hr_ref')} AS hr_ref, has_acc, has_ecg, measurement_site, activity FROM registry""",
    ),
)
def registry_scan(spark, sf):
    return registry(spark, sf)


@query(
    "good_quality_rows",
    sql([REGISTRY], f"SELECT record_id, {r6('hr_ref')} AS hr_ref FROM registry WHERE quality_label = 1"),
)
def good_quality_rows(spark, sf):
    return records.task_rows(registry(spark, sf), "hr").select("record_id", "hr_ref")


@query(
    "acc_subset",
    sql([REGISTRY], "SELECT record_id, CAST(quality_label AS BIGINT) AS quality_label FROM registry WHERE has_acc"),
)
def acc_subset(spark, sf):
    rows = records.task_rows(registry(spark, sf), "quality", acc_subset=True)
    return rows.select("record_id", "quality_label")


@query("ecg_subset", sql([REGISTRY], "SELECT record_id, subject_id FROM registry WHERE has_ecg"))
def ecg_subset(spark, sf):
    return records.ecg_rows(registry(spark, sf)).select("record_id", "subject_id")


@query(
    "first_records",
    sql([REGISTRY], "SELECT record_id, subject_id FROM registry ORDER BY record_id LIMIT 100"),
)
def first_records(spark, sf):
    """The ``limit`` argument of ingestion, made deterministic by id order."""
    return records.first_records(registry(spark, sf), 100).select("record_id", "subject_id")


@query(
    "not_landed_records",
    sql(
        [REGISTRY],
        "SELECT record_id FROM registry EXCEPT SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem",
    ),
)
def not_landed_records(spark, sf):
    """Orders are available, line items show which of them have landed."""
    landed = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("record_id"))
    return records.not_landed(registry(spark, sf).select("record_id"), landed)


@query(
    "plausible_rates",
    sql(
        [REGISTRY],
        f"SELECT record_id, {r6('hr_ref')} AS hr_ref FROM registry WHERE hr_ref >= 30 AND hr_ref <= 220",
    ),
)
def plausible_rates(spark, sf):
    rows = registry(spark, sf).where(records.plausible_hr(F.col("hr_ref")))
    return rows.select("record_id", "hr_ref")


@query(
    "task_targets",
    sql(
        [REGISTRY],
        f"""SELECT record_id, 'quality' AS task, CAST(quality_label AS DOUBLE) AS y_true FROM registry
        UNION ALL SELECT record_id, 'hr' AS task, {r6('hr_ref')} AS y_true FROM registry""",
    ),
)
def task_targets(spark, sf):
    base = registry(spark, sf)
    parts = [
        base.select("record_id", F.lit(t).alias("task"), records.target(t).alias("y_true"))
        for t in ("quality", "hr")
    ]
    return parts[0].unionByName(parts[1])


def _annotations(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("ID"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("Quality"),
        (F.col("o_totalprice") / 2200.0).alias("HR"),
    )


def _info(spark, sf):
    """Line items of an order as its (repeated) subject-info rows."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_quantity").alias("age"), F.max("l_linenumber").alias("flag"),
        F.max("l_returnflag").alias("sex"),
    )
    return lines.select(
        F.col("l_orderkey").cast("string").alias("ID"),
        F.col("sex").alias("Gender"),
        F.col("age").alias("Age [years]"),
        (F.col("age") + 100).alias("Height [cm]"),
        F.lit(None).cast("double").alias("Weight [kg]"),
        (F.col("flag") - 6).alias("Ear/finger"),
    )


ANNOTATED = """
info AS (SELECT CAST(l_orderkey AS VARCHAR) AS record_id, max(l_quantity) AS age,
                max(l_linenumber) - 6 AS flag, max(l_returnflag) AS sex FROM lineitem GROUP BY l_orderkey)"""


@query(
    "annotated_records",
    sql(
        [ANNOTATED],
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, substr(CAST(o_orderkey AS VARCHAR), 1, 3) AS subject_id,
        CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS quality_label,
        {r6('o_totalprice / 2200e0')} AS hr_ref, coalesce(i.sex, '') AS sex, {r6('i.age')} AS age,
        {r6('i.age + 100')} AS height, CAST(NULL AS DOUBLE) AS weight,
        CASE WHEN i.flag = 1 THEN 'finger' ELSE 'ear' END AS measurement_site
        FROM orders LEFT JOIN info i ON CAST(o_orderkey AS VARCHAR) = i.record_id""",
    ),
)
def annotated_records(spark, sf):
    """Annotations with subject info, subject id and site; records without info are kept."""
    return records.annotated(_annotations(spark, sf), _info(spark, sf))


@query(
    "subject_and_site",
    sql(
        [],
        """SELECT l_linenumber AS flag, substr(CAST(l_partkey AS VARCHAR), 1, 3) AS subject_id,
        CASE WHEN l_linenumber = 1 THEN 'finger' ELSE 'ear' END AS site, count(*) AS n
        FROM lineitem GROUP BY ALL""".replace("l_linenumber AS flag", "CAST(l_linenumber AS BIGINT) AS flag"),
    ),
)
def subject_and_site(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(
        F.col("l_linenumber").alias("flag"),
        labels.subject_of(F.col("l_partkey").cast("string")).alias("subject_id"),
        labels.site(F.col("l_linenumber")).alias("site"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "signal_availability",
    sql(
        [],
        """SELECT CAST(d.doc_id AS VARCHAR) AS record_id, d.lang, len(l.embedding) IS NOT NULL AS has_acc,
        q.doc_id IS NOT NULL AS has_ecg
        FROM documents d JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 500) p ON d.doc_id = p.doc_id
        LEFT JOIN embeddings l ON d.doc_id = l.vec_id LEFT JOIN labels q ON d.doc_id = q.doc_id""",
    ),
)
def signal_availability(spark, sf):
    """Records with a PPG signal (longer documents), flagged for ACC and ECG."""
    docs = table(spark, sf, "documents")
    record = F.col("doc_id").cast("string").alias("record_id")
    ppg = docs.where("n_chars >= 500").select(
        record, F.array(F.col("n_chars").cast("float")).alias("ppg")
    )
    acc = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("record_id"), F.array("embedding").alias("acc")
    )
    ecg = table(spark, sf, "labels").select(
        record, F.array(F.col("quality").cast("float")).alias("ecg")
    )
    rows = records.with_signals(docs.select(record, "lang"), ppg, acc, ecg)
    return rows.select("record_id", "lang", "has_acc", "has_ecg")


@query(
    "registry_summary",
    sql(
        [REGISTRY],
        """SELECT count(*) AS windows, count(DISTINCT subject_id) AS subjects,
        count(DISTINCT activity) AS activities, count(*) FILTER (has_acc) AS with_acc FROM registry""",
    ),
)
def registry_summary(spark, sf):
    return records.summary(registry(spark, sf))


@query(
    "prediction_targets",
    sql(
        [REGISTRY, HASHED_SPLIT],
        """SELECT fold AS split, count(*) AS n FROM registry JOIN split USING (subject_id) GROUP BY fold""",
    ),
)
def prediction_targets(spark, sf):
    """All folds of the target table (fold ``all``), counted."""
    rows = records.fold_rows(records.with_split(registry(spark, sf), hashed_split(spark, sf)), "all")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
