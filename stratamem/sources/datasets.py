"""Reading evaluation datasets: case files and long conversations with dated sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CASES = (
    "id string, sessions array<struct<date: timestamp, turns: array<struct<role: string, content: string>>>>, "
    "questions array<struct<question: string, answer: string, question_type: string, abstention: boolean>>"
)
LONG_CASES = (
    "question_id string, question_type string, question string, answer string, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role: string, content: string>>>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of cases; a missing ``abstention`` is false."""
    rows = spark.read.schema(CASES).json(path, multiLine=True)
    fixed = F.transform("questions", lambda q: q.withField("abstention", F.coalesce(q["abstention"], F.lit(False))))
    return rows.withColumn("questions", fixed)


def read_long_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of one question each, with sessions paired with their dates.

    A date reads ``2019/11/04 (Mon) 06:15``, in UTC; the weekday is ignored. A case with more
    or fewer dates than sessions, or an answer that is an object or a list, is an error. An id
    that ends in ``_abs`` marks an abstention question.
    """
    rows = spark.read.schema(LONG_CASES).json(path, multiLine=True)
    dates, sessions = F.col("haystack_dates"), F.col("haystack_sessions")
    paired = F.when(
        F.size(dates) == F.size(sessions),
        F.zip_with(dates, sessions, lambda d, s: F.struct(F.to_timestamp(F.regexp_replace(d, r"\s*\([A-Za-z]{3}\)\s*", " "), "yyyy/MM/dd HH:mm").alias("date"), s.alias("turns"))),
    ).otherwise(F.raise_error(F.concat(F.lit("dates and sessions differ in number in case "), F.col("question_id"))))
    answer = F.when(F.col("answer").rlike(r"^\s*[\[{]"), F.raise_error(F.concat(F.lit("the answer is no scalar in case "), F.col("question_id")))).otherwise(F.col("answer"))
    question = F.struct("question", answer.alias("answer"), "question_type", F.col("question_id").endswith("_abs").alias("abstention"))
    return rows.select(F.col("question_id").alias("id"), paired.alias("sessions"), F.array(question).alias("questions"))


def session_texts(cases: DataFrame) -> DataFrame:
    """``(actor_id, session_no, as_of, content)``: each session as ``role: content`` lines, for ingest."""
    one = cases.select(F.concat(F.lit("case:"), "id").alias("actor_id"), F.posexplode("sessions").alias("session_no", "s"))
    lines = F.transform("s.turns", lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["content"], F.lit(""))))
    return one.select("actor_id", "session_no", F.col("s.date").alias("as_of"), F.array_join(lines, "\n").alias("content"))
