"""Ingest: hash, skip what is unchanged, replace what changed, insert what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ANALYZERS, content_hash, stable_id, title
from ..functions.vectors import hashing_embedder, norm
from ..operators.chunk import chunks_of
from ..operators.graph import cascade
from ..options import ChunkOptions
from ..session import settle
from ..sources.tables import Store


def classify(files: DataFrame, documents: DataFrame) -> DataFrame:
    """``files`` with content_hash, title, and ``change``: new, changed or same."""
    hashed = files.withColumn("content_hash", content_hash(F.col("text"))).withColumn("title", title(F.col("text"), F.col("source_uri")))
    known = documents.select("source_uri", F.col("content_hash").alias("_h"), F.col("id").alias("_id"), F.col("created_at").alias("_at"))
    change = F.when(F.col("_id").isNull(), "new").when(F.col("_h").eqNullSafe(F.col("content_hash")), "same").otherwise("changed")
    return hashed.join(known, "source_uri", "left").withColumn("change", change).drop("_h")


def ingest(store: Store, files: DataFrame, options: ChunkOptions = ChunkOptions(), embed=None, analyzer: str = "english") -> DataFrame:
    """Bring (source_uri, text) into the store; (source_uri, title, skipped, chunks_created).

    A changed document keeps its id and creation time; its old chunks go, with
    mentions, provenance and ledger rows. A document without text keeps its row
    and has no chunks. Documents whose files are gone stay. Derived columns
    (terms, embedding, norm) are made in the select that writes the text. Of rows
    that share a source_uri the one with the greatest text counts; null text is empty. New documents
    are appended; only a changed one rewrites tables. All tables change at once.
    """
    embed = embed or hashing_embedder()
    files = files.groupBy("source_uri").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    documents, chunks = store.read("documents"), store.read("chunks")
    todo = settle(classify(files, documents))
    fresh = todo.filter("change <> 'same'")
    rows = fresh.select(F.coalesce("_id", stable_id(F.col("source_uri"))).alias("id"), "source_uri", "title", "content_hash", F.coalesce("_at", F.current_timestamp()).alias("created_at"), "text")
    parts = rows.select(F.col("id").alias("document_id"), "content_hash", F.explode(chunks_of(F.col("text"), options)).alias("c"))
    made = parts.select(stable_id(F.col("document_id"), F.col("content_hash"), F.col("c.ordinal")).alias("id"), "document_id", "c.ordinal", "c.text").withColumn("embedding", embed("text"))
    made = settle(made.withColumn("norm", norm(F.col("embedding"))).withColumn("terms", ANALYZERS[analyzer](F.col("text"))).withColumn("metadata", F.create_map().cast("map<string,string>")))
    if not fresh.filter("change = 'changed'").head(1):
        if fresh.head(1):
            store.commit(append={"documents": rows, "chunks": made})
        return _results(todo, made)
    kept = chunks.join(rows.select(F.col("id").alias("document_id")), "document_id", "left_anti").select(*chunks.columns)
    new_documents = documents.join(rows.select("source_uri"), "source_uri", "left_anti").unionByName(rows.select(*documents.columns))
    tables = {"documents": new_documents, "chunks": kept.unionByName(made.select(*chunks.columns))}
    for name in ("entities", "entity_aliases", "edges", "chunk_entities", "edge_chunks", "chunk_extractions"):
        tables[name] = store.read(name)
    after = cascade(tables)
    store.commit({name: after[name] for name in ("chunks", "documents", "chunk_entities", "edge_chunks", "chunk_extractions")})
    return _results(todo, made)


def _results(todo: DataFrame, made: DataFrame) -> DataFrame:
    counts = made.groupBy("document_id").agg(F.count("*").alias("n"))
    named = todo.withColumn("document_id", F.coalesce("_id", stable_id(F.col("source_uri")))).join(counts, "document_id", "left")
    return named.select("source_uri", "title", (F.col("change") == "same").alias("skipped"), F.coalesce("n", F.lit(0)).cast("long").alias("chunks_created"))


def summary(results: DataFrame) -> DataFrame:
    """One row: ingested, skipped, chunks."""
    return results.agg(F.count_if(~F.col("skipped")).alias("ingested"), F.count_if("skipped").alias("skipped"), F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("chunks"))
