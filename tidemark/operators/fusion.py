"""Fusion by rank, rerank, and the context that an answer may cite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent, simple_terms
from ..options import RetrievalOptions

NO_ANSWER = "The stored passages don't answer this question."


def ranked(rows: DataFrame, arm: str, *order, id_col: str = "chunk_id") -> DataFrame:
    """(arm, id, rank) of a short ranked list; the id breaks ties."""
    w = Window.orderBy(*order, id_col)
    return rows.select(F.lit(arm).alias("arm"), F.col(id_col), F.row_number().over(w).alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], options: RetrievalOptions = RetrievalOptions(), id_col: str = "chunk_id") -> DataFrame:
    """(id, score, arms): the sum of weight / (constant + rank); the best ``fused_k``.

    An arm without weight, or the graph arm when it is off, has no say.
    """
    weights = {a: w for a, w in options.weights if w > 0 and (options.graph_enabled or a != "graph")}
    every = reduce(DataFrame.union, [x.select("arm", id_col, "rank") for x in lists]).filter(F.col("arm").isin(*weights))
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("arm")]
    fused = every.groupBy(id_col).agg(F.round(F.sum(weight / (options.rrf_constant + F.col("rank"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))
    return fused.orderBy(F.desc("score"), id_col).limit(options.fused_k)


def hop_weight(hops, decay: float = 0.5):
    """Weight of a chunk by its distance in the graph."""
    return F.pow(F.lit(decay), hops)


def lexical_overlap(question, text):
    """Share of the question's distinct words that the text has: the offline reranker."""
    asked = F.array_distinct(simple_terms(question))
    return F.coalesce(F.size(F.array_intersect(asked, simple_terms(text))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def rerank(candidates: DataFrame, question: str, k: int = 5, scorer=lexical_overlap, id_col: str = "chunk_id") -> DataFrame:
    """The best k of ``candidates`` (id, text, score) by ``scorer(question, text)``."""
    return candidates.withColumn("relevance", F.round(scorer(F.lit(question), F.col("text")), 6)).orderBy(F.desc("relevance"), F.desc("score"), id_col).limit(k)


def passages(results: DataFrame) -> DataFrame:
    """One row, ``context``: numbered passages of (rank, title, similarity, text)."""
    block = F.format_string("[%d] (source: %s, %s similar)\n%s", F.col("rank").cast("int"), F.col("title"), percent(F.col("similarity")), F.col("text"))
    parts = results.agg(F.array_sort(F.collect_list(F.struct(F.col("rank"), block.alias("b")))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("context"))


def labelled_context(facts: DataFrame, matchups: DataFrame, chunks: DataFrame) -> DataFrame:
    """(section, label, line): facts f1.., matchups m1.., passages c1.., each (position, line).

    Facts go first where there are any.
    """
    parts = []
    for order, (letter, rows) in enumerate((("f", facts), ("m", matchups), ("c", chunks))):
        n = F.row_number().over(Window.orderBy("position"))
        parts.append(rows.select(F.lit(order).alias("section"), n.alias("n"), F.concat(F.lit(letter), n.cast("string")).alias("label"), "line"))
    return reduce(DataFrame.union, parts)


def check_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Adds ``unknown``, the citations of (answer, citations) that aren't labels of ``context``.

    An answer with unknown citations is asked for once more; the context of one
    question is small.
    """
    labels = context.agg(F.collect_set("label").alias("_labels"))
    return answers.crossJoin(F.broadcast(labels)).withColumn("unknown", F.array_sort(F.array_except("citations", "_labels"))).drop("_labels")


def decline(answers: DataFrame, context: DataFrame) -> DataFrame:
    """With no context the answer is a fixed sentence without citations."""
    some = context.agg((F.count("*") > 0).alias("_some"))
    joined = answers.crossJoin(F.broadcast(some))
    return joined.select(F.when(F.col("_some"), F.col("answer")).otherwise(F.lit(NO_ANSWER)).alias("answer"), F.when(F.col("_some"), F.col("citations")).otherwise(F.array().cast("array<string>")).alias("citations"))
