"""Corpus pipeline: five stages, each on all rows that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``documents``; the last returns what reading the token files gives. Semantics
of nulls, ties, repeated rows and empty tables are those of the operators; rows
with a null ``doc_id`` can't be named by a decision of stage 2 or 3 and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents
from tidemark.llm.decontam import contaminated
from tidemark.llm.langid import keep_identified
from tidemark.llm.mixing import apply_mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.pfor import token_output


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is among ``ids``."""
    gone = ids.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or whose language stays unclear, go."""
    return keep_identified(docs, min_score=0.35)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, similar at 0.8 or more, the smallest doc_id stays."""
    return _without(docs, near_duplicates(docs, percent=80, bands=40, rows=5).filter("not kept"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edits allowed, go."""
    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back."""
    import public_tokenizers

    return token_output(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network and Newton steps are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
