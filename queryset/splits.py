"""Subject-wise splits over customers and their orders."""

from pyspark.sql import functions as F

from pulsemill.operators import splits
from pulsemill.operators.records import fold_rows, uncovered_subjects, with_split
from queryset.base import query, r6, sql
from queryset.inputs import HASHED_SPLIT, REGISTRY, hashed_split, registry

MODES = """
modes AS (
  SELECT subject_id, measurement_site FROM (
    SELECT subject_id, measurement_site,
           row_number() OVER (PARTITION BY subject_id ORDER BY count(*) DESC, measurement_site) AS rn
    FROM registry GROUP BY subject_id, measurement_site) WHERE rn = 1)"""

STRATA = """
means AS (SELECT subject_id, avg(quality_label) AS q FROM registry GROUP BY subject_id),
strata AS (
  SELECT subject_id,
         CASE WHEN q > (SELECT median(q) FROM means) THEN '1' ELSE '0' END || '|' || measurement_site AS stratum
  FROM means JOIN modes USING (subject_id))"""


def take_sql(name: str, source: str, share: str) -> str:
    """Stratified draw: proportional numbers by largest remainder, order by seeded md5."""
    return f"""
{name}_n AS (SELECT sum(m) AS n, ceil({share} * sum(m)) AS w, min(m) AS least, count(*) AS k
             FROM (SELECT stratum, count(*) AS m FROM {source} GROUP BY stratum)),
{name}_s AS (SELECT subject_id, n, w,
               CASE WHEN least < 2 OR w < k OR n - w < k THEN 'all' ELSE stratum END AS stratum
             FROM {source}, {name}_n),
{name}_q AS (SELECT stratum, floor(m * w / n) AS base, m * w / n - floor(m * w / n) AS rest, w
             FROM (SELECT stratum, CAST(count(*) AS DOUBLE) AS m, CAST(max(n) AS DOUBLE) AS n,
                          CAST(max(w) AS DOUBLE) AS w FROM {name}_s GROUP BY stratum)),
{name}_a AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum)
                     <= w - (SELECT sum(base) FROM {name}_q) THEN 1 ELSE 0 END AS quota FROM {name}_q),
{name} AS (SELECT subject_id, row_number() OVER (PARTITION BY s.stratum
                    ORDER BY md5('42|' || subject_id), subject_id) <= quota AS taken
           FROM {name}_s s JOIN {name}_a a ON s.stratum = a.stratum)"""


MADE = [
    REGISTRY, MODES, STRATA, take_sql("first", "strata", "0.2e0"),
    "remaining AS (SELECT * FROM strata WHERE subject_id IN (SELECT subject_id FROM first WHERE NOT taken))",
    take_sql("second", "remaining", "(0.2e0 / (0.6e0 + 0.2e0))"),
    """made AS (SELECT subject_id, 'test' AS fold FROM first WHERE taken
       UNION ALL SELECT subject_id, CASE WHEN taken THEN 'val' ELSE 'train' END AS fold FROM second)""",
]


@query("subject_mode", sql([REGISTRY, MODES], "SELECT subject_id, measurement_site FROM modes"))
def subject_mode(spark, sf):
    return splits.subject_mode(registry(spark, sf), "measurement_site")


@query("subject_strata", sql([REGISTRY, MODES, STRATA], "SELECT subject_id, stratum FROM strata"))
def subject_strata(spark, sf):
    return splits.subject_strata(registry(spark, sf), ["quality_label", "measurement_site"])


@query("subject_split", sql(MADE, "SELECT subject_id, fold FROM made"))
def subject_split(spark, sf):
    return splits.subject_split(registry(spark, sf))


@query(
    "all_test_split",
    sql([REGISTRY], "SELECT DISTINCT subject_id, 'test' AS fold FROM registry"),
)
def all_test_split(spark, sf):
    return splits.all_test_split(registry(spark, sf))


FRACTIONS, SEEDS = (0.25, 0.5, 1.0), (0, 1, 2)
SUBSETS = """
ranked AS (
  SELECT subject_id, CAST(seed AS BIGINT) AS seed,
         row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || '|' || subject_id), subject_id) AS rk,
         count(*) OVER (PARTITION BY seed) AS n
  FROM split CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed) WHERE fold = 'train'),
subsets AS (
  SELECT seed, fraction, subject_id, k AS n_train_subjects FROM (
    SELECT *, CAST(CASE WHEN fraction >= 1 THEN n ELSE greatest(1, round_even(fraction * n, 0)) END AS BIGINT) AS k
    FROM ranked CROSS JOIN (SELECT unnest([0.25e0, 0.5e0, 1e0]) AS fraction)) WHERE rk <= k)"""


@query(
    "low_data_subsets",
    sql([HASHED_SPLIT, SUBSETS], "SELECT seed, fraction, subject_id, n_train_subjects FROM subsets"),
)
def low_data_subsets(spark, sf):
    return splits.low_data_subsets(hashed_split(spark, sf), FRACTIONS, SEEDS)


@query(
    "low_data_splits",
    sql(
        [HASHED_SPLIT, SUBSETS],
        """SELECT 'f' || CAST(CAST(fraction * 100 AS INTEGER) AS VARCHAR) || '_s' || CAST(seed AS VARCHAR) AS split_id,
        fold, count(*) AS n FROM (
          SELECT seed, fraction, subject_id, 'train' AS fold FROM subsets
          UNION ALL SELECT g.seed, g.fraction, s.subject_id, s.fold
          FROM split s CROSS JOIN (SELECT DISTINCT seed, fraction FROM subsets) g WHERE s.fold <> 'train')
        GROUP BY ALL""",
    ),
)
def low_data_splits(spark, sf):
    made = splits.low_data_splits(hashed_split(spark, sf), FRACTIONS, SEEDS)
    return made.groupBy("split_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "subset_nesting_violations",
    sql(
        [HASHED_SPLIT, SUBSETS,
         "steps AS (SELECT * FROM (VALUES (0.25e0, 0.5e0), (0.5e0, 1e0)) v(lo, hi))",
         # each seed's smallest subset is swapped for the next seed's: most of it must be reported
         """moved AS (SELECT CASE WHEN fraction = 0.25e0 THEN (seed + 1) % 3 ELSE seed END AS seed,
                             fraction, subject_id FROM subsets)"""],
        f"""SELECT m.seed, {r6('s.hi')} AS fraction, m.subject_id FROM moved m JOIN steps s ON m.fraction = s.lo
        WHERE NOT EXISTS (SELECT 1 FROM moved l WHERE l.seed = m.seed AND l.fraction = s.hi
                          AND l.subject_id = m.subject_id)""",
    ),
)
def subset_nesting_violations(spark, sf):
    """The nesting check on subsets whose smallest fractions were mixed up between seeds."""
    made = splits.low_data_subsets(hashed_split(spark, sf), FRACTIONS, SEEDS)
    seed = F.when(F.col("fraction") == 0.25, (F.col("seed") + 1) % 3).otherwise(F.col("seed"))
    return splits.nesting_violations(made.withColumn("seed", seed))


@query(
    "overlapping_subjects",
    sql(
        [HASHED_SPLIT, REGISTRY],
        """SELECT subject_id, string_agg(fold, ',' ORDER BY fold) AS folds FROM (
          SELECT subject_id, fold FROM split
          UNION SELECT DISTINCT subject_id, 'test' AS fold FROM registry WHERE measurement_site = 'URGENT')
        GROUP BY subject_id HAVING count(*) > 1""",
    ),
)
def overlapping_subjects(spark, sf):
    """The leak check on a split into which subjects with urgent windows were put twice."""
    urgent = registry(spark, sf).where("measurement_site = 'URGENT'").select(
        "subject_id", F.lit("test").alias("fold")
    )
    return splits.overlapping_subjects(hashed_split(spark, sf).unionByName(urgent))


@query(
    "uncovered_subjects",
    sql(
        [REGISTRY, HASHED_SPLIT],
        """SELECT DISTINCT subject_id FROM registry
        EXCEPT SELECT subject_id FROM split WHERE fold <> 'val'""",
    ),
)
def uncovered_subjects_(spark, sf):
    """Subjects a split without its validation list does not cover."""
    return uncovered_subjects(registry(spark, sf), hashed_split(spark, sf).where("fold <> 'val'"))


@query("fold_map", sql([HASHED_SPLIT], "SELECT subject_id, fold FROM split"))
def fold_map(spark, sf):
    split = hashed_split(spark, sf)
    parts = [split.where(F.col("fold") == fold) for fold in ("train", "val", "test")]
    return splits.fold_map(*parts)


@query(
    "fold_lists",
    sql(
        [HASHED_SPLIT],
        """SELECT fold, subject_id, row_number() OVER (PARTITION BY fold ORDER BY subject_id) - 1 AS position
        FROM split""",
    ),
)
def fold_lists(spark, sf):
    """The sorted lists of the split file, one row per position."""
    return splits.fold_lists(hashed_split(spark, sf))


@query(
    "registry_with_split",
    sql([REGISTRY, HASHED_SPLIT], "SELECT record_id, subject_id, fold AS split FROM registry JOIN split USING (subject_id)"),
)
def registry_with_split(spark, sf):
    rows = with_split(registry(spark, sf), hashed_split(spark, sf))
    return rows.select("record_id", "subject_id", "split")


@query(
    "fold_rows",
    sql(
        [REGISTRY, HASHED_SPLIT],
        f"""SELECT record_id, {r6('hr_ref')} AS hr_ref FROM registry JOIN split USING (subject_id)
        WHERE fold = 'test'""",
    ),
)
def fold_rows_(spark, sf):
    rows = fold_rows(with_split(registry(spark, sf), hashed_split(spark, sf)), "test")
    return rows.select("record_id", "hr_ref")
