"""Retrieval: three arms, fusion, rerank, labelled context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import hashing_embedder
from ..functions.vocab import type_chart
from ..operators import fusion, keyword, semantic, walk
from ..options import MAX_QUERY_CHARS, FactOptions, RetrievalOptions, WalkOptions
from ..session import settle
from ..sources.tables import Store


@dataclass
class Retrieved:
    """Frames of one question; each is short."""

    seeds: DataFrame
    entities: DataFrame
    fused: DataFrame
    best: DataFrame
    facts: DataFrame
    context: DataFrame


def validate(question: str) -> str:
    if not isinstance(question, str) or not 1 <= len(question) <= MAX_QUERY_CHARS:
        raise ValueError(f"a question has 1 to {MAX_QUERY_CHARS} characters")
    return question


def retrieve(store: Store, question: str, options: RetrievalOptions = RetrievalOptions(), walk_options: WalkOptions = WalkOptions(max_nodes_per_hop=25), fact_options: FactOptions = FactOptions(), embed=None, scorer=fusion.lexical_overlap) -> Retrieved:
    """Everything that an answer to ``question`` may draw on, with labels to cite."""
    validate(question)
    embed = embed or hashing_embedder()
    chunks = store.read("chunks")
    query = store.spark.createDataFrame([(question,)], "q string").select(embed("q").alias("embedding"))
    rows = chunks.select(F.col("id").alias("chunk_id"), "document_id", "text", "embedding", "norm")
    near = settle(semantic.top_k(rows.select("chunk_id", "embedding", "norm"), query, options.semantic_k, "chunk_id").select("chunk_id", "similarity"))
    words = settle(keyword.keyword_search(rows, question, options.keyword_k, "chunk_id", analyzer="english"))
    lists = [fusion.ranked(near, "semantic", F.desc("similarity")), fusion.ranked(words, "keyword", F.desc("score"))]
    seeds = near.orderBy(F.desc("similarity"), "chunk_id").limit(options.seed_k)
    mentions, edges = store.read("chunk_entities"), store.read("edges")
    entities = settle(walk.seed_entities(seeds, mentions))
    if options.graph_enabled:
        found = settle(walk.graph_search(seeds, mentions, edges, walk_options))
        lists.append(found.select(F.lit("graph").alias("arm"), "chunk_id", "rank"))
    fused = settle(fusion.reciprocal_rank_fusion(lists, options))
    best = settle(fusion.rerank(fused.join(rows.select("chunk_id", "document_id", "text"), "chunk_id"), question, options.final_k, scorer))
    names = store.read("entities")
    weighted = entities.select("entity_id", F.col("mentions").alias("weight"))
    facts = settle(walk.facts(weighted, edges, names, store.read("edge_chunks"), fact_options))
    typed = edges.filter("relation = 'has_type'").join(entities.select(F.col("entity_id").alias("source_entity_id")), "source_entity_id", "left_semi")
    typed = typed.join(names.select(F.col("id").alias("target_entity_id"), F.col("canonical_name").alias("type")), "target_entity_id").select(F.col("source_entity_id").alias("entity_id"), "type")
    lines = walk.matchup_lines(typed, type_chart(store.spark), names).select(F.col("entity_id").alias("position"), "line")
    shown = best.select(F.struct(-F.col("relevance"), -F.col("score"), "chunk_id").alias("position"), F.col("text").alias("line"))
    context = fusion.labelled_context(facts.select("position", "line"), lines, shown)
    return Retrieved(seeds, entities, fused, best, facts, context)


# ---------------------------------------------------------------- single arms


def _shown(found: DataFrame, store: Store, measure: str) -> DataFrame:
    """A short ranked list (chunk_id, measure) with what a reader sees of each chunk."""
    chunks = store.read("chunks").select(F.col("id").alias("chunk_id"), "document_id", "ordinal", "text")
    titles = store.read("documents").select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    full = chunks.join(F.broadcast(found), "chunk_id").join(titles, "document_id")
    return full.select("chunk_id", "document_id", "document_title", "text", "ordinal", measure).orderBy(F.desc(measure), "chunk_id")


def semantic_search(store: Store, question: str, k: int = 5, embed=None) -> DataFrame:
    """(chunk_id, document_id, document_title, text, ordinal, similarity) of the k nearest."""
    query = store.spark.createDataFrame([(validate(question),)], "q string").select((embed or hashing_embedder())("q").alias("embedding"))
    rows = store.read("chunks").select(F.col("id").alias("chunk_id"), "embedding", "norm")
    return _shown(semantic.top_k(rows, query, k, "chunk_id").select("chunk_id", "similarity"), store, "similarity")


def keyword_search(store: Store, question: str, k: int = 50, analyzer: str = "english") -> DataFrame:
    """The same columns with ``score``, for chunks that have all terms."""
    rows = store.read("chunks").select(F.col("id").alias("chunk_id"), "text")
    return _shown(keyword.keyword_search(rows, validate(question), k, "chunk_id", analyzer=analyzer), store, "score")


def _chunk_ids(store: Store, ids: list[str]) -> DataFrame:
    return store.spark.createDataFrame([(i,) for i in ids], "chunk_id string")


def graph_expand(store: Store, seed_chunk_ids: list[str], options: WalkOptions = WalkOptions()) -> tuple[DataFrame, DataFrame]:
    """(entities, chunks) around some chunks: canonical_name, hops; chunk_id, hops, is_seed."""
    seeds, mentions = _chunk_ids(store, seed_chunk_ids), store.read("chunk_entities")
    reached = settle(walk.expand(walk.seed_entities(seeds, mentions), store.read("edges"), options))
    names = store.read("entities").select(F.col("id").alias("entity_id"), "canonical_name", "type")
    return reached.join(names, "entity_id").select("entity_id", "canonical_name", "type", "hops"), walk.reached_chunks(reached, mentions, seeds)


def graph_facts(store: Store, entity_ids: list[str], options: FactOptions = FactOptions()) -> DataFrame:
    """Facts at some entities, the most mentioned first."""
    wanted = store.spark.createDataFrame([(i,) for i in entity_ids], "entity_id string")
    weight = store.read("chunk_entities").join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(F.sum("mentions").alias("weight"))
    weighted = wanted.join(weight, "entity_id", "left").select("entity_id", F.coalesce("weight", F.lit(0)).alias("weight"))
    return walk.facts(weighted, store.read("edges"), store.read("entities"), store.read("edge_chunks"), options)


def graph_trace(store: Store, question: str, options: WalkOptions = WalkOptions(max_nodes_per_hop=25), k: int = 5) -> DataFrame:
    """(step, line) of a question's way through the graph, for people who debug it."""
    near = settle(semantic_search(store, question, k).select("chunk_id", "similarity"))
    ids = [r.chunk_id for r in near.collect()]
    entities, chunks = graph_expand(store, ids, options)
    facts = graph_facts(store, [r.entity_id for r in entities.filter("hops = 0").select("entity_id").collect()])
    return (
        near.select(F.lit("1 seed").alias("step"), F.format_string("%s %.6f", "chunk_id", "similarity").alias("line"))
        .union(entities.select(F.lit("2 entity"), F.format_string("%d %s (%s)", "hops", "canonical_name", "type")))
        .union(chunks.select(F.lit("3 chunk"), F.format_string("%d %s", "hops", "chunk_id")))
        .union(facts.select(F.lit("4 fact"), "line"))
    )
