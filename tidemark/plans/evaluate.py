"""Evaluation: hit rates by tag, and what switching an arm changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hit_rates(results: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """(tag, questions, hit_rate, mrr): results are (question_id, source, rank).

    A question without results counts as missed.
    """
    first = results.filter(F.col("rank") <= k).groupBy("question_id", F.col("source").alias("expected_source")).agg(F.min("rank").alias("rank"))
    joined = questions.join(first, ["question_id", "expected_source"], "left")
    return joined.groupBy("tag").agg(F.count("*").alias("questions"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def hit_deltas(with_arm: DataFrame, without_arm: DataFrame) -> DataFrame:
    """(tag, delta) of two :func:`hit_rates`."""
    return with_arm.alias("a").join(without_arm.alias("b"), "tag").select("tag", F.round(F.col("a.hit_rate") - F.col("b.hit_rate"), 6).alias("delta"))
