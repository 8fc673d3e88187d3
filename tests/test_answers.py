"""Answer texts with their expected reading."""

import pytest
from pyspark.sql import functions as F

from pulsemill.functions import answers, labels
from pulsemill.operators import metrics, records

QUALITY = [
    ("Answer: good", 1), ("Answer: bad", 0), ("Answer: 1", 1), ("Answer: 0", 0),
    ("Looks clean.\nAnswer: good", 1), ("Noisy window.\nAnswer: bad", 0), ("Answer:good", 1),
    ("ANSWER: GOOD", 1), ("good against bad features.\nAnswer: bad", 0), ("it is good", 1),
    ("Answer: bad. No, answer : good!", 1), ("Answer: 10", None), ("Answer: goodish", None),
    ("Answer: bad", 0), ("", None), ("   ", None), (None, None), ("Not sure about it.", None),
    ("Answer: maybe", None), ("Answer: good or bad, hard to tell", None), ("bad answer:", None),
]
HR = [
    ("Answer: 72", 72), ("Answer: 72 bpm", 72), ("About 88.5 beats.\nAnswer: 88.5", 88.5),
    ("Answer: 30", 30), ("Answer: 220", 220), ("Answer: 275 or maybe 90", 90), ("", None),
    (None, None), ("I cannot estimate it.", None), ("Answer: 400", None), ("Answer: five", None),
    ("around 65 bpm, answer: unsure", 65),  # nothing numeric behind the anchor: whole text
    ("65 bpm. Answer: 400", None),  # a number out of range behind the anchor ends the search
    ("Answer: -70", None), ("Answer: 70.5.", 70.5), ("71\nAnswer: 72\nAnswer: 73", 73),
]


def parse(spark, cases, parser):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i INT, text STRING")
    return [r["p"] for r in df.select("i", parser(F.col("text")).alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize("cases,parser", [(QUALITY, answers.parse_quality), (HR, answers.parse_hr)])
def test_parsing(spark, cases, parser):
    for (text, want), got in zip(cases, parse(spark, cases, parser)):
        assert (got["y_pred"], got["parse_status"]) == (want, "invalid" if want is None else "ok"), text


def test_long_text_is_read_to_its_end(spark):
    text = "word answer " * 50000 + "Answer: bad"
    assert parse(spark, [(text, 0)], answers.parse_quality)[0]["y_pred"] == 0


def test_expected_answers(spark):
    df = spark.createDataFrame([(1, 72.5), (0, 73.5), (None, None)], "q INT, hr DOUBLE")
    got = [tuple(r) for r in df.select(
        answers.text_answer("quality", F.col("q"), F.col("hr")),
        answers.text_answer("hr", F.col("q"), F.col("hr"))).collect()]
    assert got == [("good", "72"), ("bad", "74"), (None, None)]


def records_of(spark):
    return spark.createDataFrame(
        [("r0", "S0", 1, 70.0), ("r1", "S0", 0, 80.0)],
        "record_id STRING, subject_id STRING, quality_label INT, hr_ref DOUBLE",
    )


def test_round_trip_into_the_evaluator(spark):
    said = spark.createDataFrame([("r1", "Answer: ?"), ("r0", "Answer: good")], "record_id STRING, raw_response STRING")
    made = records.answers_to_predictions(records_of(spark), said, "quality")
    row = metrics.evaluate(made.withColumn("run_id", F.lit("x"))).first()
    assert (row["n_records"], row["n_scored"], row["n_invalid_responses"]) == (2, 1, 1)
    assert {r["raw_response"] for r in made.collect()} == {"Answer: ?", "Answer: good"}


def test_unpaired_responses_fail(spark):
    said = spark.createDataFrame([("r0", "Answer: 70")], "record_id STRING, raw_response STRING")
    with pytest.raises(Exception, match="unpaired"):
        records.answers_to_predictions(records_of(spark), said, "hr").collect()
    with pytest.raises(ValueError, match="unknown task"):
        records.answers_to_predictions(records_of(spark), said, "age")
    whole = records_of(spark).select("record_id").withColumn("raw_response", F.lit("Answer: 70"))
    assert records.answers_to_predictions(records_of(spark), whole, "hr").count() == whole.count()
    with pytest.raises(Exception, match="response twice"):
        records.answers_to_predictions(records_of(spark), whole.unionByName(whole.limit(1)), "hr").collect()
    with pytest.raises(Exception, match="record twice"):
        records.answers_to_predictions(records_of(spark).unionByName(records_of(spark).limit(1)), whole, "hr").collect()


def test_labels_from_answers(spark):
    mart = spark.createDataFrame([("a", " Good "), ("b", "bad")], "record_id STRING, answer STRING")
    assert [r[0] for r in records.recover_labels(mart, "quality").select("quality_label").collect()] == [1.0, 0.0]
    hr = mart.withColumn("answer", F.lit("72")).withColumn("hr_ref", F.lit(None).cast("double"))
    assert [r[0] for r in records.recover_labels(hr, "hr").select("hr_ref").collect()] == [72.0, 72.0]


NAMES = [("ENTER Walking", "Walking"), ("Walking_ENTER", "Walking"), ("EXIT: screen reading", "ScreenReading"),
         ("TSST", "Tsst"), ("2x run", "2XRun"), ("don't stop", "Don'TStop"), ("enter_", None), ("  ", None)]


def test_event_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i INT, n STRING")
    got = [r[0] for r in df.orderBy("i").select(labels.event_name(F.col("n"))).collect()]
    assert got == [want for _, want in NAMES]


LLM = [("org/Model-1B", "1B"), ("g/gemma-3-270m", "270M"), ("g/gemma-x", "Gemma"), ("x/other", "other"), (None, "?"), ("x/", "?")]


def test_model_sizes_and_labels(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(LLM)], "i INT, n STRING")
    assert [r[0] for r in df.orderBy("i").select(labels.llm_size(F.col("n"))).collect()] == [w for _, w in LLM]
    runs = spark.createDataFrame(
        [(0, "trivial", "quality", None, None, None), (1, "trivial", "hr", "dominant_frequency", None, None),
         (2, "trivial", "hr", None, None, None), (3, "opentslm", "hr", None, "a/L-3b", "ckpt"),
         (4, "opentslm", "hr", None, "a/L-3b", None), (5, "mine", "hr", None, None, None)],
        "i INT, model STRING, task STRING, method STRING, llm STRING, ecg STRING",
    )
    label = labels.run_label(*[F.col(c) for c in ("model", "task", "method", "llm", "ecg")])
    got = [tuple(r) for r in runs.orderBy("i").select(label, labels.row_family(label)).collect()]
    assert [g[0] for g in got] == ["Majority class", "Dominant-frequency HR", "Median HR",
                                   "OpenTSLM-3B (ECG)", "OpenTSLM-3B", "mine"]
    assert [g[1] for g in got][3:5] == ["OpenTSLM (ECG)", "OpenTSLM"]


def test_display(spark):
    df = spark.createDataFrame([(0.123456,), (None,)], "v DOUBLE")
    assert [r[0] for r in df.select(labels.display(F.col("v"))).collect()] == ["0.1235", "—"]
