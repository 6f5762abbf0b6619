"""Graph build: seed, extract what is pending, clean, resolve, upsert, collect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_name
from ..functions.vectors import spelling_embedder
from ..operators import graph as G
from ..schemas import PROPERTIES
from ..session import settle
from ..sources.tables import Store


def build_graph(store: Store, extractor: Callable[[str, str], dict], version: str, embed=None) -> DataFrame:
    """Run the build and return edges by relation and origin.

    ``embed`` maps names to vectors, so that a new spelling of a known entity is
    resolved by cosine; the default knows spelling only. All tables change at once.

    Chunks with a ledger row at ``version`` aren't sent to the extractor again.
    A chunk whose extraction failed twice has no ledger row and is retried next time.
    """
    chunks = store.read("chunks").select(F.col("id").alias("chunk_id"), "text")
    raw = settle(G.extract(G.pending(chunks, store.read("chunk_extractions"), version), extractor)).filter("entities is not null")
    named, related = settle(G.clean_entities(raw)), settle(G.clean_relations(raw))
    seeds, seed_edges = G.seed_edges(store.spark)
    entities = G.upsert(store.read("entities").select("id", "canonical_name", "normalized_name", "type", "embedding", "created_at"), _full(seeds), ("normalized_name", "type"))
    named = settle(named.withColumn("embedding", (embed or spelling_embedder())("normalized_name")))
    ids = settle(G.resolve(named, entities, store.read("entity_aliases")))
    names = named.join(ids, ["normalized_name", "type"])
    fresh = names.join(ids.filter("how = 'new'").select("entity_id"), "entity_id", "left_semi").groupBy("entity_id", "normalized_name", "type").agg(F.mode("name", True).alias("canonical_name"), F.first("embedding", True).alias("embedding"))
    entities = settle(G.upsert(entities, _full(fresh.withColumnRenamed("entity_id", "id")), ("normalized_name", "type")))
    alias = names.select("entity_id", F.explode("aliases").alias("alias")).withColumn("normalized_alias", normalise_name("alias")).dropDuplicates(["normalized_alias", "entity_id"])
    mention = names.groupBy("chunk_id", "entity_id").agg(F.count("*").cast("int").alias("mentions"))
    end = lambda side: names.select("chunk_id", F.col("name").alias(f"{side}_name"), F.col("type").alias(f"{side}_type"), F.col("entity_id").alias(f"{side}_entity_id"))
    found = related.join(end("source"), ["chunk_id", "source_name", "source_type"]).join(end("target"), ["chunk_id", "target_name", "target_type"])
    found = settle(found.withColumn("id", G.edge_id(F.col("source_entity_id"), F.col("relation"), F.col("target_entity_id"))))
    properties = F.struct(F.lit(None).cast("double").alias("multiplier"), F.col("method")).cast(PROPERTIES).alias("properties")
    edges = found.select("id", "source_entity_id", "target_entity_id", "relation", properties, "confidence", F.lit("llm").alias("origin"))
    edges = G.upsert_edges(store.read("edges"), seed_edges.unionByName(edges))
    edge_chunks = settle(G.upsert(store.read("edge_chunks"), found.select(F.col("id").alias("edge_id"), "chunk_id").distinct(), ("edge_id", "chunk_id")))
    mentions = settle(G.upsert(store.read("chunk_entities"), mention, ("chunk_id", "entity_id")))
    entities, edges = (settle(x) for x in G.collect_orphans(entities, settle(edges), mentions, edge_chunks))
    counts = raw.select("chunk_id", F.lit(version).alias("prompt_version"), F.size("entities").alias("entity_count"), F.size("relations").alias("relation_count"), F.current_timestamp().alias("extracted_at"))
    ledger = settle(G.upsert(store.read("chunk_extractions"), counts, ("chunk_id",)))
    aliases = settle(G.upsert(store.read("entity_aliases"), alias.select("entity_id", "alias", "normalized_alias"), ("normalized_alias", "entity_id")))
    store.commit({"entities": entities, "entity_aliases": aliases, "edges": edges, "chunk_entities": mentions, "edge_chunks": edge_chunks, "chunk_extractions": ledger})
    return G.relation_counts(store.read("edges"))


def _full(rows: DataFrame) -> DataFrame:
    embedding = F.col("embedding") if "embedding" in rows.columns else F.lit(None)
    return rows.select("id", "canonical_name", "normalized_name", "type", embedding.cast("array<float>").alias("embedding"), F.current_timestamp().alias("created_at"))
