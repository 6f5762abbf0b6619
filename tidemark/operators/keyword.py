"""Keyword arm: inverted index, all-terms match, BM25 order.

A row matches if it has every query term. The order is BM25 (Robertson and
Zaragoza 2009), documented and portable; arms are fused by rank, so its scale
doesn't matter. The index is a table of (term, id, tf), so a query reads its
terms only; the collection's figures are one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ANALYZERS

K1, B = 1.2, 0.75


def inverted_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: str = "simple") -> DataFrame:
    """(term, id, tf, length) for every distinct term of every row.

    Counting is within a row, so a term that all rows have is no hot key.
    """
    terms = docs.select(id_col, ANALYZERS[analyzer](F.col(text_col)).alias("terms"))
    counted = terms.select(id_col, F.size("terms").cast("long").alias("length"), F.explode("terms").alias("term"))
    return counted.groupBy(id_col, "length", "term").agg(F.count("*").alias("tf")).select("term", id_col, "tf", "length")


def query_terms(spark: SparkSession, query: str, analyzer: str = "simple") -> list[str]:
    """Distinct terms of a query: one row, a handful of words."""
    row = spark.createDataFrame([(query,)], "q string").select(F.array_distinct(ANALYZERS[analyzer](F.col("q"))).alias("t")).first()
    return sorted(row.t)


def keyword_search(docs: DataFrame, query: str, k: int = 50, id_col: str = "doc_id", text_col: str = "text", analyzer: str = "simple") -> DataFrame:
    """(id, score) of the best k rows that have all terms; no term, no rows."""
    wanted = query_terms(docs.sparkSession, query, analyzer)
    if not wanted:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    words = docs.select(id_col, ANALYZERS[analyzer](F.col(text_col)).alias("terms"))
    # Through a generator, so that no filter below is pushed to copy the tokenizer once a term.
    words = words.select(F.inline(F.array(F.struct(id_col, "terms"))))
    tf = [F.size(F.filter("terms", _is(t))).cast("double") for t in wanted]
    rows = words.select(id_col, F.size("terms").cast("double").alias("length"), F.array(*tf).alias("tf"))
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"), F.array(*[F.sum((F.col("tf")[i] > 0).cast("double")) for i in range(len(wanted))]).alias("df"))
    matched = rows.filter(F.forall("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, df = F.col("tf")[i], F.col("df")[i]
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return matched.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def search_index(index: DataFrame, wanted: list[str], n_docs: int, mean_length: float, k: int = 50, id_col: str = "doc_id") -> DataFrame:
    """:func:`keyword_search` on a stored index: only the terms' rows are read."""
    hits = index.filter(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean_length))))
    scored = hits.join(df, "term").groupBy(id_col).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("found"))
    return scored.filter(F.col("found") == len(set(wanted))).select(id_col, "score").orderBy(F.desc("score"), id_col).limit(k)


def _is(term: str):
    return lambda w: w == term
