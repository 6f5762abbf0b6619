"""Registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import norm
from ..functions.vocab import CHART, TYPES, type_chart
from ..operators import fusion, graph, keyword, semantic, walk
from ..operators.chunk import chunk_documents as chunk_op
from ..options import FactOptions, RetrievalOptions, WalkOptions
from . import evaluate, ingest, star

QUESTION = "the and of with"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- vectors


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = semantic.with_norms(_t(spark, sf_dir, "embeddings"), dimension=64)
    return semantic.top_k(e, e.filter("vec_id = 0").select("embedding"), 10).select("vec_id", "label", "similarity")


def semantic_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return semantic.batch_top_k(e, e.filter("vec_id % 50 = 0"), 5)


def semantic_lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return semantic.LshIndex(64).top_k(e, e.filter("vec_id % 50 = 0"), 5)


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dimension"), F.round(norm(F.col("embedding")), 6).alias("norm"))


# ---------------------------------------------------------------- ingest


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_uri"), "text", "lang")


def document_hash_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("source_uri", X.content_hash(F.col("text")).alias("content_hash"), X.title(F.col("text"), F.col("source_uri")).alias("title"))


def _state(files: DataFrame) -> DataFrame:
    """A store that knows English texts as they are and German ones in another version."""
    old = files.filter("lang in ('en', 'de')").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return old.select(F.col("source_uri").alias("id"), "source_uri", X.content_hash(F.col("text")).alias("content_hash"), F.lit(None).cast("timestamp").alias("created_at"))


def change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return ingest.classify(files, _state(files)).select("source_uri", "change")


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunk_counts(spark, sf_dir).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_uri"), "chunks")
    skipped = F.col("change") == "same"
    done = change_detection(spark, sf_dir).join(made, "source_uri", "left").select(skipped.alias("skipped"), F.when(skipped, 0).otherwise(F.coalesce("chunks", F.lit(0))).alias("chunks_created"))
    return ingest.summary(done)


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_op(_t(spark, sf_dir, "documents"))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", X.normalise_name("text").alias("normalized_name"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


def scrubbed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", X.scrub(F.col("text")).alias("text"))


# ---------------------------------------------------------------- keyword, fusion


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(_t(spark, sf_dir, "documents"), QUESTION, 50)


def keyword_english_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.keyword_search(_t(spark, sf_dir, "documents"), "resting", 50, analyzer="english")


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.inverted_index(_t(spark, sf_dir, "documents"))


def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size(X.simple_terms(F.col("text")))).alias("mean")).first()
    return keyword.search_index(keyword.inverted_index(docs), sorted(QUESTION.split()), stats.n, stats.mean)


def _arms(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    near = semantic.top_k(_t(spark, sf_dir, "embeddings"), _t(spark, sf_dir, "embeddings").filter("vec_id = 0"), 50)
    words = keyword_topk(spark, sf_dir)
    return [
        fusion.ranked(near.withColumnRenamed("vec_id", "doc_id"), "semantic", F.desc("similarity"), id_col="doc_id"),
        fusion.ranked(words, "keyword", F.desc("score"), id_col="doc_id"),
    ]


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank_fusion(_arms(spark, sf_dir), RetrievalOptions(), "doc_id")


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    fused = rank_fusion(spark, sf_dir).join(docs, "doc_id")
    return fusion.rerank(fused, "thing over the heat and that", 5, id_col="doc_id").select("doc_id", "score", "relevance")


def context_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    near = semantic_topk(spark, sf_dir).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")))
    return fusion.passages(near.join(docs, F.col("vec_id") == F.col("doc_id")).select("rank", F.col("source").alias("title"), "similarity", "text"))


def arm_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    found = semantic_batch_topk(spark, sf_dir).filter("vec_id <> query_id").join(e.select("vec_id", "label"), "vec_id")
    results = found.select(F.col("query_id").alias("question_id"), F.col("label").cast("string").alias("source"), "rank")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").cast("string").alias("expected_source"), F.concat(F.lit("label-"), "label").alias("tag"))
    return evaluate.hit_rates(results, asked)


# ---------------------------------------------------------------- graph


def _seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s:1", 1)], "entity_id string, mentions int")


def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.expand(_seed(spark), star.edges(spark, sf_dir), WalkOptions(max_hops=2, max_nodes=0, relations=None)).select("entity_id", "hops")


def graph_reached_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = walk.expand(_seed(spark), star.edges(spark, sf_dir), WalkOptions(max_hops=2, max_nodes=0, relations=None))
    none = spark.createDataFrame([], "chunk_id string")
    return walk.reached_chunks(reached, star.mentions(spark, sf_dir), none).select("chunk_id", "hops", "confidence", "mentions")


def graph_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([("o:1",)], "chunk_id string")
    return walk.graph_search(seeds, star.mentions(spark, sf_dir), star.edges(spark, sf_dir), WalkOptions(max_hops=2, max_nodes=0, relations=None), k=50).select("chunk_id", "hops", "confidence", "mentions", "rank")


def graph_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops with a budget of 15 nodes and a cap of 25 in all."""
    return walk.expand(_seed(spark), star.edges(spark, sf_dir), WalkOptions(max_hops=2, max_nodes=25, max_nodes_per_hop=15, relations=None)).select("entity_id", "hops", F.col("weight").alias("links"))


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arms of unequal weight; the graph's orders stand for documents of their number."""
    reached = graph_arm(spark, sf_dir).select(F.lit("graph").alias("arm"), F.substring("chunk_id", 3, 20).cast("long").alias("doc_id"), "rank")
    weights = (("semantic", 1.0), ("keyword", 0.5), ("graph", 2.0))
    return fusion.reciprocal_rank_fusion([*_arms(spark, sf_dir), reached], RetrievalOptions(weights=weights), "doc_id")


def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = star.mentions(spark, sf_dir).groupBy("entity_id").agg(F.sum("mentions").alias("weight"))
    out = walk.facts(weights, star.edges(spark, sf_dir), star.names(spark, sf_dir), star.provenance(spark, sf_dir), FactOptions(max_facts=40, max_facts_per_entity=4))
    return out.select("position", "edge_id", "line")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with the one or two types that its key and size point at."""
    kinds = F.array(*[F.lit(t) for t in TYPES])
    part = _t(spark, sf_dir, "part")
    at = lambda c: F.element_at(kinds, (F.col(c) % 18 + 1).cast("int"))
    return part.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.explode(F.array(at("p_partkey"), at("p_size"))).alias("type")).distinct()


def type_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.matchups(_typed(spark, sf_dir), type_chart(spark))


def type_matchup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.matchup_lines(_typed(spark, sf_dir), type_chart(spark), star.names(spark, sf_dir).filter("id like 'p:%'"))


def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = star.edges(spark, sf_dir)
    again = old.filter("relation in ('supplied_by', 'found_in')").withColumn("confidence", F.lit(0.6).cast("float")).withColumn("origin", F.when(F.col("relation") == "found_in", "seed").otherwise("llm"))
    return graph.upsert_edges(old, again).select("source_entity_id", "relation", "target_entity_id", F.round(F.col("confidence").cast("double"), 6).alias("confidence"), "origin")


def orphan_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges left when only found and mentioned things stay."""
    e = star.edges(spark, sf_dir)
    entities, edges = graph.collect_orphans(star.names(spark, sf_dir), e, star.mentions(spark, sf_dir), star.provenance(spark, sf_dir))
    nodes = entities.groupBy(F.concat(F.lit("node "), F.substring("id", 1, 1)).alias("what")).agg(F.count("*").alias("n"))
    return nodes.union(edges.groupBy(F.concat(F.lit("edge "), F.col("relation"))).agg(F.count("*")))


def pending_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), "o_orderstatus")
    ledger = chunks.filter("o_orderstatus <> 'P'").select("chunk_id", F.when(F.col("o_orderstatus") == "O", "v2").otherwise("v1").alias("prompt_version"))
    return graph.pending(chunks.select("chunk_id"), ledger, "v2")


def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands and nation names against nations, with region names as aliases."""
    known = _t(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("id"), F.lower("n_name").alias("normalized_name"), F.lit("region").alias("type"), F.lit(None).cast("array<float>").alias("embedding"))
    aliases = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("entity_id"), F.lower("r_name").alias("normalized_alias"))
    said = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("n")).union(_t(spark, sf_dir, "nation").select("n_name")).union(_t(spark, sf_dir, "region").select("r_name"))
    mentions = said.select(F.lower("n").alias("normalized_name"), F.lit("region").alias("type"))
    return graph.resolve(mentions, known, aliases).select("normalized_name", F.when(F.col("how") != "new", F.col("entity_id")).alias("entity_id"), "how")


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relation_counts(star.edges(spark, sf_dir))


def uncited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.uncited_edges(star.edges(spark, sf_dir), star.provenance(spark, sf_dir))
    return found.groupBy("relation").agg(F.count("*").alias("edges"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and provenance left when orders that are still open go."""
    chunks = _t(spark, sf_dir, "orders").filter("o_orderstatus <> 'O'").select(F.concat(F.lit("o:"), F.col("o_orderkey")).alias("id"), F.lit("d").alias("document_id"))
    documents = spark.createDataFrame([("d",)], "id string")
    left = graph.cascade({"documents": documents, "chunks": chunks, "chunk_entities": star.mentions(spark, sf_dir), "edge_chunks": star.provenance(spark, sf_dir)})
    rows = [left[t].agg(F.lit(t).alias("what"), F.count("*").alias("n")) for t in ("chunks", "chunk_entities", "edge_chunks")]
    return rows[0].union(rows[1]).union(rows[2])


_ALL = (
    semantic_topk, semantic_batch_topk, semantic_lsh_topk, vector_norms, document_hash_title, change_detection, ingest_summary, chunk_documents, chunk_counts,
    normalised_names, previews, scrubbed_documents, keyword_topk, keyword_english_topk, inverted_index, keyword_index_topk, rank_fusion, reranked, context_passages, arm_hit_rates,
    graph_expand, graph_reached_chunks, graph_arm, graph_budget, weighted_fusion, graph_facts, type_matchups, type_matchup_lines, edge_upsert, orphan_collection, pending_extractions, name_resolution,
    relation_counts, uncited_edges, cascade_delete,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}


# ---------------------------------------------------------------- SQL

_NEAR = """
    q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    near AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q)"""
_BATCH = """
    asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    pairs AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, asked),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 5)"""
_TERMS = """
    words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS terms FROM documents),
    flat AS (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM words),
    idx AS (SELECT term, doc_id, count(*) AS tf, length FROM flat GROUP BY ALL)"""
_BM25 = f"""{_TERMS},
    stats AS (SELECT count(*)::DOUBLE AS n, avg(len(terms)) AS mean FROM words),
    df AS (SELECT term, count(*)::DOUBLE AS df FROM idx WHERE term IN ('the', 'and', 'of', 'with') GROUP BY term),
    part AS (SELECT doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS s FROM idx JOIN df USING (term), stats),
    keyword AS (SELECT doc_id, round(sum(s), 6) AS score FROM part GROUP BY doc_id HAVING count(*) = 4 ORDER BY score DESC, doc_id LIMIT 50)"""
_FUSED = f"""{_NEAR}, {_BM25},
    arms AS (
        SELECT * FROM (SELECT 'semantic' AS arm, vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM near) WHERE rank <= 50
        UNION ALL SELECT 'keyword', doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM keyword
    ),
    fused AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 9) AS score, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms FROM arms GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50)"""
_CHANGE = """
    WITH f AS (SELECT 'doc/' || doc_id || '.md' AS source_uri, text, lang FROM documents),
    c AS (SELECT source_uri, CASE WHEN lang = 'en' THEN 'same' WHEN lang = 'de' THEN 'changed' ELSE 'new' END AS change FROM f)"""
_CHUNKS = r"""
    RECURSIVE s AS (
        SELECT doc_id, 0 AS n, NULL::VARCHAR AS piece, text AS rest, length(text) > 3200 AS long FROM documents WHERE trim(text, ' ' || chr(10)) <> ''
        UNION ALL
        SELECT doc_id, n + 1, CASE WHEN length(rest) > 3200 THEN left(rest, cut + 1) ELSE rest END,
               CASE WHEN length(rest) > 3200 THEN ltrim(substring(rest, cut + 2), ' ' || chr(10)) ELSE '' END, long
        FROM (
            SELECT *, CASE WHEN dot >= 1600 THEN dot WHEN space >= 960 THEN space ELSE 3200 END AS cut
            FROM (
                SELECT *, CASE WHEN contains(left(rest, 3202), '. ') THEN length(left(rest, 3202)) - strpos(reverse(left(rest, 3202)), ' .') - 1 ELSE -1 END AS dot,
                       CASE WHEN contains(left(rest, 3201), ' ') THEN length(left(rest, 3201)) - strpos(reverse(left(rest, 3201)), ' ') ELSE -1 END AS space
                FROM s WHERE rest <> ''
            )
        )
    ),
    p AS (SELECT doc_id, (n - 1)::INT AS ordinal, piece, lag(piece) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM s WHERE n > 0),
    o AS (SELECT *, length(before) - floor(length(before) * 0.15::DOUBLE)::INT AS start FROM p),
    j AS (
        SELECT *, trim(substring(before, CASE WHEN strpos(substring(before, start + 1), ' ') > 0 THEN start + strpos(substring(before, start + 1), ' ') ELSE start + 1 END), ' ' || chr(10))
               || chr(10) || chr(10) || piece AS joined FROM o
    ),
    chunks AS (SELECT doc_id, ordinal, trim(CASE WHEN before IS NULL OR length(joined) > 3200 THEN piece ELSE joined END, ' ' || chr(10)) AS text FROM j)"""
_REACH = f"""
    WITH RECURSIVE {star.SQL.strip()},
    r AS (
        SELECT id AS node, 0 AS hops FROM (SELECT unnest(SEEDS) AS id)
        UNION SELECT b, hops + 1 FROM r JOIN links ON a = node WHERE hops < 2
    ),
    reach AS (SELECT node, min(hops)::INT AS hops FROM r GROUP BY node),
    sure AS (
        SELECT x.node, any_value(x.hops) AS hops, coalesce(max(l.confidence), 1.0::FLOAT) AS confidence
        FROM reach x LEFT JOIN (SELECT b, links.confidence, y.hops FROM links JOIN reach y ON y.node = a) l ON l.b = x.node AND l.hops = x.hops - 1
        GROUP BY x.node
    ),
    near AS (SELECT chunk_id, min(hops) AS hops, max(confidence) AS confidence, sum(mentions)::BIGINT AS mentions FROM mentions JOIN sure ON node = entity_id GROUP BY chunk_id)"""
_FROM_S1 = _REACH.replace("SEEDS", "['s:1']")
_CHART_SQL = "chart(attacker, defender, multiplier) AS (VALUES " + ", ".join(f"('{a}', '{d}', {m}::DOUBLE)" for a, d, m in CHART) + ")"
_KINDS = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
_MATCH = f"""
    WITH {_CHART_SQL},
    typed AS (SELECT DISTINCT 'p:' || p_partkey AS entity_id, unnest([{_KINDS}[p_partkey % 18 + 1], {_KINDS}[p_size % 18 + 1]]) AS type FROM part),
    m AS (SELECT entity_id, attacker, product(multiplier) AS multiplier FROM typed JOIN chart ON type = defender GROUP BY ALL HAVING product(multiplier) <> 1)"""

#: Forms, real and made up ones of the test data, that the published rules of the English stemmer take to one stem.
_REST = "('rest', 'rests', 'rested', 'resting', 'restings', 'restful', 'restfully', 'restfulness', 'restness', 'restly', 'restes', 'restlyed', 'restingly', 'restedly')"
_ENGLISH = f"""
    words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
                                         lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))})) AS terms FROM documents),
    counted AS (SELECT doc_id, len(terms)::DOUBLE AS length, len(list_filter(terms, lambda w: w IN {_REST}))::DOUBLE AS tf FROM words),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, count(*) FILTER (tf > 0)::DOUBLE AS df FROM counted)"""

ORACLE_SQL: dict[str, str] = {
    "semantic_topk": f"WITH {_NEAR} SELECT vec_id, label, similarity FROM near ORDER BY similarity DESC, vec_id LIMIT 10",
    "semantic_batch_topk": f"WITH {_BATCH} SELECT query_id, vec_id, similarity, rank FROM best",
    "vector_norms": "SELECT vec_id, len(embedding) AS dimension, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "document_hash_title": r"""SELECT 'doc/' || doc_id || '.md' AS source_uri, sha256(text) AS content_hash,
        coalesce(nullif(trim(regexp_extract(text, '(?m)^#\s+(.+)$', 1)), ''), doc_id::VARCHAR) AS title FROM documents""",
    "change_detection": f"{_CHANGE} SELECT source_uri, change FROM c",
    "ingest_summary": f"""WITH {_CHUNKS.strip()}, {_CHANGE.strip().removeprefix("WITH")},
        k AS (SELECT 'doc/' || doc_id || '.md' AS source_uri, count(*) AS n FROM chunks GROUP BY doc_id)
        SELECT count(*) FILTER (change <> 'same') AS ingested, count(*) FILTER (change = 'same') AS skipped,
               coalesce(sum(n) FILTER (change <> 'same'), 0)::BIGINT AS chunks FROM c LEFT JOIN k USING (source_uri)""",
    "chunk_documents": f"WITH {_CHUNKS.strip()} SELECT doc_id, ordinal, text FROM chunks",
    "chunk_counts": f"WITH {_CHUNKS.strip()} SELECT doc_id, count(*) AS chunks, max(length(text))::INT AS longest FROM chunks GROUP BY doc_id",
    "normalised_names": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[''’‘ʼ`]', '', 'g'),
        '[^\p{L}\p{N}♀♂]+', ' ', 'g')) AS normalized_name FROM documents""",
    "previews": "SELECT doc_id, replace(substring(text, 1, 200), chr(10), ' ') AS preview FROM documents",
    "scrubbed_documents": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'),
        '\b[0-9]{13,19}\b', '[card]', 'g'), '\+[0-9][0-9 ().-]{7,}[0-9]', '[phone]', 'g') AS text FROM documents""",
    "keyword_topk": f"WITH {_BM25} SELECT doc_id, score FROM keyword",
    "keyword_english_topk": f"""WITH {_ENGLISH} SELECT doc_id, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 6) AS score
        FROM counted, stats WHERE tf > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "keyword_index_topk": f"WITH {_BM25} SELECT doc_id, score FROM keyword",
    "inverted_index": f"WITH {_TERMS} SELECT term, doc_id, tf, length FROM idx",
    "rank_fusion": f"WITH {_FUSED} SELECT doc_id, score, arms FROM fused",
    "reranked": f"""WITH {_FUSED} SELECT doc_id, score, round(len(list_intersect(['thing', 'over', 'the', 'heat', 'and', 'that'], terms)) / 6.0::DOUBLE, 6) AS relevance
        FROM fused JOIN words USING (doc_id) ORDER BY relevance DESC, score DESC, doc_id LIMIT 5""",
    "context_passages": f"""WITH {_NEAR}, top AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM near QUALIFY rank <= 10)
        SELECT string_agg('[' || rank || '] (source: ' || source || ', ' || printf('%.1f', similarity * 100) || '% similar)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
        FROM top JOIN documents ON vec_id = doc_id""",
    "arm_hit_rates": f"""WITH {_BATCH},
        hits AS (SELECT b.query_id, min(rank) AS rank FROM best b JOIN embeddings x ON x.vec_id = b.vec_id JOIN embeddings y ON y.vec_id = b.query_id
                 WHERE b.vec_id <> b.query_id AND x.label = y.label GROUP BY b.query_id)
        SELECT 'label-' || label AS tag, count(*) AS questions, round(avg((rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr
        FROM embeddings LEFT JOIN hits ON query_id = vec_id WHERE vec_id % 50 = 0 GROUP BY label""",
    "graph_expand": f"{_FROM_S1} SELECT node AS entity_id, hops FROM reach",
    "graph_reached_chunks": f"{_FROM_S1} SELECT chunk_id, hops, confidence, mentions FROM near",
    "graph_arm": _REACH.replace("SEEDS", "(SELECT list(entity_id) FROM mentions WHERE chunk_id = 'o:1')")
    + " SELECT *, row_number() OVER (ORDER BY hops, confidence DESC, mentions DESC, chunk_id)::INT AS rank FROM near WHERE chunk_id <> 'o:1' ORDER BY rank LIMIT 50",
    "graph_budget": f"""
        WITH {star.SQL.strip()},
        h1 AS (SELECT b AS entity_id, 1 AS hops, count(DISTINCT a) AS links FROM links WHERE a = 's:1' AND b <> 's:1' GROUP BY b ORDER BY links DESC, entity_id LIMIT 15),
        h2 AS (
            SELECT b AS entity_id, 2 AS hops, count(DISTINCT a) AS links FROM links
            WHERE a IN (SELECT entity_id FROM h1) AND b <> 's:1' AND b NOT IN (SELECT entity_id FROM h1) GROUP BY b ORDER BY links DESC, entity_id LIMIT 15
        )
        SELECT * FROM (SELECT 's:1' AS entity_id, 0 AS hops, 1::BIGINT AS links UNION ALL FROM h1 UNION ALL FROM h2) ORDER BY hops, links DESC, entity_id LIMIT 25""",
    "weighted_fusion": _REACH.replace("SEEDS", "(SELECT list(entity_id) FROM mentions WHERE chunk_id = 'o:1')").replace(" near AS (", " reached AS (")
    + f""", {_NEAR}, {_BM25},
        arms AS (
            SELECT * FROM (SELECT 'semantic' AS arm, vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank, 1.0::DOUBLE AS w FROM near) WHERE rank <= 50
            UNION ALL SELECT 'keyword', doc_id, row_number() OVER (ORDER BY score DESC, doc_id), 0.5 FROM keyword
            UNION ALL SELECT * FROM (SELECT 'graph', substring(chunk_id, 3)::BIGINT, row_number() OVER (ORDER BY hops, confidence DESC, mentions DESC, chunk_id) AS rank, 2.0
                                     FROM reached WHERE chunk_id <> 'o:1') WHERE rank <= 50
        )
        SELECT doc_id, round(sum(w / (60.0::DOUBLE + rank)), 9) AS score, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms
        FROM arms GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""",
    "graph_facts": f"""
        WITH {star.SQL.strip()},
        w AS (SELECT entity_id, sum(mentions) AS weight FROM mentions GROUP BY entity_id ORDER BY weight DESC, entity_id LIMIT 20),
        e AS (
            SELECT source_entity_id || '|' || relation || '|' || target_entity_id AS id, edges.*, s.weight AS sw, t.weight AS tw
            FROM edges LEFT JOIN w s ON s.entity_id = source_entity_id LEFT JOIN w t ON t.entity_id = target_entity_id WHERE s.weight IS NOT NULL OR t.weight IS NOT NULL
        ),
        c AS (
            SELECT *, greatest(sw, tw) AS big FROM e
            QUALIFY row_number() OVER (PARTITION BY CASE WHEN coalesce(sw, -1) >= coalesce(tw, -1) THEN source_entity_id ELSE target_entity_id END ORDER BY confidence DESC, id) <= 4
        ),
        k AS (SELECT *, row_number() OVER (ORDER BY big DESC, confidence DESC, id)::INT AS position FROM c QUALIFY position <= 40),
        v AS (SELECT edge_id, string_agg('chunk:' || left(chunk_id, 8), ' ' ORDER BY chunk_id) AS cited FROM provenance GROUP BY edge_id)
        SELECT position, k.id AS edge_id, a.name || ' --' || relation || '--> ' || b.name || coalesce(' [' || cited || ']', '') AS line
        FROM k JOIN names a ON a.id = source_entity_id JOIN names b ON b.id = target_entity_id LEFT JOIN v ON edge_id = k.id""",
    "type_matchups": f"{_MATCH} SELECT entity_id, attacker, multiplier FROM m",
    "type_matchup_lines": f"""{_MATCH},
        g AS (SELECT entity_id, multiplier, string_agg(attacker, ', ' ORDER BY attacker) AS who FROM m GROUP BY ALL),
        l AS (SELECT entity_id, string_agg(regexp_replace(multiplier::VARCHAR, '\\.0$', '') || 'x from ' || who, '; ' ORDER BY multiplier DESC) AS takes FROM g GROUP BY entity_id),
        t AS (SELECT entity_id, string_agg(type, '/' ORDER BY type) AS types FROM typed GROUP BY entity_id)
        SELECT entity_id, p_name || ' (' || types || ') takes ' || takes AS line FROM l JOIN t USING (entity_id) JOIN part ON entity_id = 'p:' || p_partkey""",
    "edge_upsert": f"""
        WITH {star.SQL.strip()},
        both_ AS (
            SELECT *, 0 AS new FROM edges
            UNION ALL SELECT source_entity_id, target_entity_id, relation, 0.6::FLOAT, CASE WHEN relation = 'found_in' THEN 'seed' ELSE 'llm' END, 1 FROM edges WHERE relation IN ('supplied_by', 'found_in')
        )
        SELECT source_entity_id, relation, target_entity_id, round(confidence::DOUBLE, 6) AS confidence, origin FROM both_
        QUALIFY row_number() OVER (PARTITION BY source_entity_id, relation, target_entity_id ORDER BY origin = 'seed' DESC, confidence DESC, new) = 1""",
    "orphan_collection": f"""
        WITH {star.SQL.strip()},
        kept AS (SELECT * FROM edges WHERE origin = 'seed' OR source_entity_id || '|' || relation || '|' || target_entity_id IN (SELECT edge_id FROM provenance)),
        used AS (SELECT entity_id AS id FROM mentions UNION SELECT source_entity_id FROM kept UNION SELECT target_entity_id FROM kept)
        SELECT 'node ' || left(id, 1) AS what, count(*) AS n FROM names WHERE id IN (SELECT id FROM used) GROUP BY 1
        UNION ALL SELECT 'edge ' || relation, count(*) FROM kept GROUP BY 1""",
    "pending_extractions": "SELECT o_orderkey AS chunk_id FROM orders WHERE o_orderstatus <> 'O'",
    "name_resolution": """
        WITH said AS (SELECT DISTINCT lower(n) AS n FROM (SELECT p_brand AS n FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region)),
        a AS (SELECT lower(r_name) AS n, min('n:' || n_nationkey) AS id FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
        SELECT n AS normalized_name, coalesce('n:' || n_nationkey, id) AS entity_id, CASE WHEN n_nationkey IS NOT NULL THEN 'exact' WHEN id IS NOT NULL THEN 'alias' ELSE 'new' END AS how
        FROM said LEFT JOIN nation ON lower(n_name) = n LEFT JOIN a USING (n)""",
    "relation_counts": f"WITH {star.SQL.strip()} SELECT relation, origin, count(*) AS edges FROM edges GROUP BY ALL",
    "uncited_edges": f"""WITH {star.SQL.strip()} SELECT relation, count(*) AS edges FROM edges
        WHERE origin <> 'seed' AND source_entity_id || '|' || relation || '|' || target_entity_id NOT IN (SELECT edge_id FROM provenance) GROUP BY relation""",
    "cascade_delete": f"""
        WITH {star.SQL.strip()}, left_ AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'O')
        SELECT 'chunks' AS what, count(*) AS n FROM left_
        UNION ALL SELECT 'chunk_entities', count(*) FROM mentions WHERE chunk_id IN (SELECT id FROM left_)
        UNION ALL SELECT 'edge_chunks', count(*) FROM provenance WHERE chunk_id IN (SELECT id FROM left_)""",
}
