"""Scores over evaluation results and the comparison of backends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def memory_score(results: DataFrame) -> DataFrame:
    """One row ``(n, accuracy, avg_latency_ms, avg_tokens)``; all 0 without results."""
    zero = F.lit(0.0)
    return results.agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg(F.col("correct").cast("double")), zero), 6).alias("accuracy"),
        F.round(F.coalesce(F.avg("query_latency_ms"), zero), 6).alias("avg_latency_ms"),
        F.round(F.coalesce(F.avg("recalled_context_tokens"), zero), 6).alias("avg_tokens"),
    )


def score_by_type(results: DataFrame) -> DataFrame:
    """``(question_type, n, accuracy)`` by name; abstention questions are their own type, a null type is ``untyped``."""
    kind = F.when(F.col("abstention"), F.lit("abstention")).otherwise(F.coalesce("category", F.lit("untyped")))
    return results.groupBy(kind.alias("question_type")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")).orderBy("question_type")


def aligned(results: DataFrame, backends: Sequence[str]) -> DataFrame:
    """One row per question that every backend answered: ``case_id, question_index`` and each one's ``correct``."""
    got = results.where(F.col("backend").isin(*backends)).groupBy("case_id", "question_index").agg(
        *[F.bool_or(F.when(F.col("backend") == b, F.col("correct"))).alias(b) for b in backends]
    )
    complete = F.lit(True)
    for b in backends:
        complete = complete & F.col(f"`{b}`").isNotNull()
    return got.where(complete)


def missing(results: DataFrame, backends: Sequence[str]) -> DataFrame:
    """``(case_id, question_index, backend)``: answers that a backend owes."""
    asked = results.select("case_id", "question_index").distinct().select("*", F.explode(F.array(*[F.lit(b) for b in backends])).alias("backend"))
    return asked.join(results.select("case_id", "question_index", "backend").distinct(), ["case_id", "question_index", "backend"], "left_anti")


def disagreements(results: DataFrame) -> DataFrame:
    """``(case_id, question_index, n_correct, n)``: questions on which backends differ."""
    n = F.sum(F.col("correct").cast("bigint"))
    return results.groupBy("case_id", "question_index").agg(n.alias("n_correct"), F.count("*").alias("n")).where("n_correct > 0 and n_correct < n")


def comparison_markdown(scores: dict[str, dict[str, float]], split: Sequence[tuple[str, int]] = ()) -> str:
    """A report of small, already collected scores per backend and of the questions they split on."""
    lines = ["# Comparison", "", "| backend | n | accuracy | avg latency ms | avg tokens |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {b} | {s['n']} | {s['accuracy']:.3f} | {s['avg_latency_ms']:.1f} | {s['avg_tokens']:.1f} |" for b, s in scores.items()]
    if split:
        lines += ["", "## Disagreements", ""] + [f"- {case} #{q}" for case, q in split]
    return "\n".join(lines) + "\n"


def profile_markdown(static: Sequence[str], dynamic: Sequence[str]) -> str:
    def part(title: str, rows: Sequence[str]) -> list[str]:
        return [f"## {title}", "", *([f"- {r}" for r in rows] or ["(none)"]), ""]

    return "\n".join(part("Static", static) + part("Recent", dynamic))
