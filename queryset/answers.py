"""Free-text answers built from events, labels and document texts."""

from pyspark.sql import functions as F

from pulsemill.functions import answers
from pulsemill.operators import metrics, records
from queryset.base import query, r6, sql, table
from queryset.inputs import QUALITY_PRED, REGISTRY, quality_predictions, registry


# -- one response per event: its value in several wordings -------------------------------------
def hr_responses(spark, sf):
    value = F.format_string("%.2f", F.col("value"))
    kind = F.col("event_type")
    response = (
        F.when(kind == "view", F.concat(F.lit("Some 12 thoughts.\nAnswer: "), value, F.lit(" bpm")))
        .when(kind == "click", F.concat(F.lit("It is about "), value))
        .when(kind == "signup", F.concat(F.lit("ANSWER :\n 275 or "), value))
        .when(kind == "purchase", F.concat(value, F.lit(" Answer: not sure")))
        .otherwise(F.lit("  "))
    )
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("record_id"),
        F.col("user_id").cast("string").alias("subject_id"),
        F.col("value").alias("hr_ref"),
        response.alias("raw_response"),
    )


HR_TEXT = """
hr_text AS (
  SELECT CAST(event_id AS VARCHAR) AS record_id, CAST(user_id AS VARCHAR) AS subject_id, value AS hr_ref,
         CASE event_type WHEN 'view' THEN 'Some 12 thoughts.' || chr(10) || 'Answer: ' || v || ' bpm'
              WHEN 'click' THEN 'It is about ' || v
              WHEN 'signup' THEN 'ANSWER :' || chr(10) || ' 275 or ' || v
              WHEN 'purchase' THEN v || ' Answer: not sure' ELSE '  ' END AS raw_response
  FROM (SELECT *, printf('%.2f', value) AS v FROM events)),
hr_tail AS (
  SELECT *, regexp_replace(raw_response, '(?is)^.*answer[ \\t\\n\\r]*:[ \\t\\n\\r]*', '') AS tail FROM hr_text),
hr_nums AS (
  SELECT *, CAST(regexp_extract_all(tail, '-?[0-9]+(?:\\.[0-9]+)?') AS DOUBLE[]) AS tail_nums,
         CAST(regexp_extract_all(raw_response, '-?[0-9]+(?:\\.[0-9]+)?') AS DOUBLE[]) AS all_nums FROM hr_tail),
hr_parsed AS (
  SELECT *, CASE WHEN trim(raw_response) = '' THEN NULL
                 WHEN len(tail_nums) > 0 THEN list_filter(tail_nums, lambda v: v BETWEEN 30 AND 220)[1]
                 ELSE list_filter(all_nums, lambda v: v BETWEEN 30 AND 220)[1] END AS y_pred FROM hr_nums)"""


@query("answer_tail", sql([HR_TEXT], "SELECT record_id, tail FROM hr_tail"))
def answer_tail(spark, sf):
    return hr_responses(spark, sf).select(
        "record_id", answers.after_anchor(F.col("raw_response")).alias("tail")
    )


@query(
    "hr_answers",
    sql(
        [HR_TEXT],
        f"""SELECT record_id, {r6('y_pred')} AS y_pred,
        CASE WHEN y_pred IS NULL THEN 'invalid' ELSE 'ok' END AS parse_status FROM hr_parsed""",
    ),
)
def hr_answers(spark, sf):
    rows = hr_responses(spark, sf)
    return rows.withColumn("p", answers.parse_hr(F.col("raw_response"))).select("record_id", "p.*")


# -- one response per labelled document: noise text and a verdict ------------------------------
def quality_responses(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    rows = table(spark, sf, "labels").join(docs, "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    verdict = (
        F.when(toxic, "Answer: good or bad, hard to tell")
        .when(F.col("lang") == "fr", F.when(good, "answer:1").otherwise("answer:0"))
        .when(F.col("lang") == "de", F.when(good, "The signal is clean.").otherwise("Answer: BAD!"))
        .otherwise(F.when(good, "ANSWER: Good").otherwise("Answer : bad"))
    )
    return rows.select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.col("lang").alias("subject_id"),
        F.col("quality").alias("quality_label"),
        F.concat(F.col("text"), F.lit("\n"), verdict).alias("raw_response"),
    )


QUALITY_TEXT = """
quality_text AS (
  SELECT CAST(l.doc_id AS VARCHAR) AS record_id, d.lang AS subject_id, l.quality AS quality_label,
         d.text || chr(10) || CASE WHEN l.toxic = 1 THEN 'Answer: good or bad, hard to tell'
           WHEN d.lang = 'fr' THEN CASE WHEN l.quality = 1 THEN 'answer:1' ELSE 'answer:0' END
           WHEN d.lang = 'de' THEN CASE WHEN l.quality = 1 THEN 'The signal is clean.' ELSE 'Answer: BAD!' END
           ELSE CASE WHEN l.quality = 1 THEN 'ANSWER: Good' ELSE 'Answer : bad' END END AS raw_response
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
quality_tokens AS (
  SELECT *, regexp_extract_all(lower(regexp_replace(raw_response,
            '(?is)^.*answer[ \\t\\n\\r]*:[ \\t\\n\\r]*', '')), '[a-zA-Z0-9]+') AS tokens FROM quality_text),
quality_parsed AS (
  SELECT *, CASE WHEN list_has_any(tokens, ['good', '1']) AND NOT list_has_any(tokens, ['bad', '0']) THEN 1e0
                 WHEN list_has_any(tokens, ['bad', '0']) AND NOT list_has_any(tokens, ['good', '1']) THEN 0e0
            END AS y_pred FROM quality_tokens)"""


@query(
    "quality_answers",
    sql(
        [QUALITY_TEXT],
        """SELECT record_id, y_pred, CASE WHEN y_pred IS NULL THEN 'invalid' ELSE 'ok' END AS parse_status
        FROM quality_parsed""",
    ),
)
def quality_answers(spark, sf):
    rows = quality_responses(spark, sf)
    return rows.withColumn("p", answers.parse_quality(F.col("raw_response"))).select("record_id", "p.*")


@query(
    "answers_to_predictions",
    sql(
        [QUALITY_TEXT],
        """SELECT record_id, subject_id, 'quality' AS task, CAST(quality_label AS DOUBLE) AS y_true, y_pred,
        CAST(NULL AS DOUBLE) AS prob_good, md5(raw_response) AS raw_response,
        CASE WHEN y_pred IS NULL THEN 'invalid' ELSE 'ok' END AS parse_status FROM quality_parsed""",
    ),
)
def answers_to_predictions(spark, sf):
    """Records and responses paired by id; the text is compared by its digest."""
    rows = quality_responses(spark, sf)
    made = records.answers_to_predictions(
        rows.drop("raw_response"), rows.select("record_id", "raw_response"), "quality"
    )
    return made.withColumn("raw_response", F.md5("raw_response"))


@query(
    "answer_summary",
    sql(
        [HR_TEXT],
        f"""SELECT 'events' AS run_id, 'hr' AS task, count(*) AS n_records, count(y_pred) AS n_scored,
        count(*) - count(y_pred) AS n_invalid_responses,
        {r6('1e0 * (count(*) - count(y_pred)) / count(*)')} AS invalid_response_fraction,
        {r6('avg(abs(hr_ref - y_pred))')} AS mae,
        {r6('sqrt(avg((hr_ref - y_pred) * (hr_ref - y_pred)))')} AS rmse FROM hr_parsed""",
    ),
)
def answer_summary(spark, sf):
    """Parse, keep the unreadable answers, score the rest."""
    rows = hr_responses(spark, sf)
    made = records.answers_to_predictions(
        rows.drop("raw_response"), rows.select("record_id", "raw_response"), "hr"
    )
    out = metrics.evaluate(made.withColumn("run_id", F.lit("events")))
    return out.select(
        "run_id", "task", "n_records", "n_scored", "n_invalid_responses", "invalid_response_fraction", "mae", "rmse"
    )


@query(
    "text_answers",
    sql(
        [REGISTRY],
        """SELECT record_id, CASE WHEN quality_label = 1 THEN 'good' WHEN quality_label = 0 THEN 'bad' END AS quality,
        CAST(CAST(round_even(hr_ref, 0) AS BIGINT) AS VARCHAR) AS hr FROM registry""",
    ),
)
def text_answers(spark, sf):
    q, h = F.col("quality_label"), F.col("hr_ref")
    return registry(spark, sf).select(
        "record_id",
        answers.text_answer("quality", q, h).alias("quality"),
        answers.text_answer("hr", q, h).alias("hr"),
    )


@query(
    "recovered_labels",
    sql(
        [QUALITY_PRED],
        """SELECT record_id, 'carried' AS mart, y_true AS label FROM quality_pred
        UNION ALL
        SELECT record_id, 'lost' AS mart, CASE WHEN y_true = 1 THEN 1e0 ELSE 0e0 END AS label FROM quality_pred""",
    ),
)
def recovered_labels(spark, sf):
    """Labels kept where the mart has them, read from the answer where all are missing."""
    mart = quality_predictions(spark, sf).select(
        "record_id",
        F.col("y_true").cast("int").alias("quality_label"),
        F.concat(F.lit(" "), answers.quality_answer(F.col("y_true"))).alias("answer"),
    )
    lost = mart.withColumn("quality_label", F.lit(None).cast("int"))
    parts = [
        records.recover_labels(m, "quality").select(
            "record_id", F.lit(name).alias("mart"), F.col("quality_label").alias("label")
        )
        for name, m in (("carried", mart), ("lost", lost))
    ]
    return parts[0].unionByName(parts[1])
