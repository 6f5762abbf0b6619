"""Graph build: cleaning extractions, resolving names, upserts, collection, checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_name, stable_id
from ..functions.vectors import cosine
from ..functions.vocab import EFFECTIVENESS, ENTITY_TYPES, RELATIONS, TYPES, endpoint_pairs, seed_owned, type_chart
from ..options import CONFIDENCE_FLOOR, MATCH_THRESHOLD
from ..schemas import PARENTS, PROPERTIES

EXTRACTION = "chunk_id string, entities array<struct<name:string,type:string,aliases:array<string>>>, relations array<struct<source:string,relation:string,target:string,method:string,confidence:double>>"


# ---------------------------------------------------------------- extraction


def pending(chunks: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """Chunks without a ledger row at this prompt version; none on a rerun."""
    return chunks.join(ledger.filter(F.col("prompt_version") == version).select("chunk_id"), "chunk_id", "left_anti")


def extract(chunks: DataFrame, extractor: Callable[[str, str], dict]) -> DataFrame:
    """EXTRACTION rows of (chunk_id, text) by a model behind ``extractor(id, text)``.

    An error is asked again once; a second one gives null lists, and the build
    goes on. Calls in flight are the partitions.
    """
    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for chunk_id, text in zip(batch["chunk_id"], batch["text"]):
                found: dict | None = None
                for _ in range(2):
                    try:
                        found = extractor(chunk_id, text)
                        break
                    except Exception:  # noqa: BLE001 - a model's failures are of any kind
                        continue
                out.append((chunk_id, found and found["entities"], found and found["relations"]))
            yield pd.DataFrame(out, columns=["chunk_id", "entities", "relations"])

    return chunks.select("chunk_id", "text").mapInPandas(run, EXTRACTION)


def clean_entities(extracted: DataFrame) -> DataFrame:
    """(chunk_id, name, normalized_name, type, aliases), one a name and type and chunk.

    An alias that is the name once normalised is dropped, and null lists are empty.
    """
    e = extracted.select("chunk_id", F.posexplode("entities").alias("at", "e")).select("chunk_id", "at", "e.name", "e.type", F.coalesce("e.aliases", F.array().cast("array<string>")).alias("aliases"))
    e = e.withColumn("normalized_name", normalise_name("name")).filter((F.col("normalized_name") != "") & F.col("type").isin(*ENTITY_TYPES))
    first = F.row_number().over(Window.partitionBy("chunk_id", "normalized_name", "type").orderBy("at"))
    e = e.withColumn("_n", first).filter("_n = 1").drop("_n")
    a = e.select("chunk_id", "normalized_name", "type", F.explode("aliases").alias("alias")).withColumn("normalized_alias", normalise_name("alias"))
    a = a.filter("normalized_alias <> '' and normalized_alias <> normalized_name").groupBy("chunk_id", "normalized_name", "type").agg(F.array_sort(F.collect_set("alias")).alias("kept"))
    joined = e.drop("aliases").join(a, ["chunk_id", "normalized_name", "type"], "left")
    return joined.select("chunk_id", "name", "normalized_name", "type", F.coalesce("kept", F.array().cast("array<string>")).alias("aliases"))


def clean_relations(extracted: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Relations that may stand, one a triple and chunk, the first kept.

    Both ends declared in the chunk, types allowed for the relation, not owned by
    the seeded chart, confident enough, and no end its own target.
    """
    spark = extracted.sparkSession
    declared = clean_entities(extracted).select("chunk_id", "normalized_name", "type", "name")
    r = extracted.select("chunk_id", F.posexplode("relations").alias("at", "r")).select("chunk_id", "at", "r.relation", "r.method", "r.confidence", normalise_name("r.source").alias("s"), normalise_name("r.target").alias("t"))
    r = r.filter((F.col("confidence") >= floor) & (F.col("s") != F.col("t")))
    src = declared.select("chunk_id", F.col("normalized_name").alias("s"), F.col("type").alias("source_type"), F.col("name").alias("source_name"))
    dst = declared.select("chunk_id", F.col("normalized_name").alias("t"), F.col("type").alias("target_type"), F.col("name").alias("target_name"))
    r = r.join(src, ["chunk_id", "s"]).join(dst, ["chunk_id", "t"])
    r = r.join(F.broadcast(endpoint_pairs(spark)), ["relation", "source_type", "target_type"], "left_semi")
    r = r.filter(~seed_owned(F.col("relation"), F.col("source_type"), F.col("target_type")))
    first = F.row_number().over(Window.partitionBy("chunk_id", "s", "source_type", "relation", "t", "target_type").orderBy("at"))
    return r.withColumn("_n", first).filter("_n = 1").select("chunk_id", "source_name", "source_type", "relation", "target_name", "target_type", "method", F.col("confidence").cast("float").alias("confidence"))


# ---------------------------------------------------------------- resolution


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """(normalized_name, type, entity_id, how) of every distinct name.

    In turn: equal name and type; alias of an entity of the type (an ambiguous
    one goes to the least id); best cosine at or over ``threshold`` where both
    have an embedding; else a new id from type and name. Each stage sees only
    what the ones before left.
    """
    names = mentions.groupBy("normalized_name", "type").agg(F.first("embedding", True).alias("embedding")) if "embedding" in mentions.columns else mentions.select("normalized_name", "type", F.lit(None).cast("array<float>").alias("embedding")).distinct()
    key = ["normalized_name", "type"]
    exact = entities.groupBy(*key).agg(F.min("id").alias("exact_id"))
    known = aliases.join(entities.select(F.col("id").alias("entity_id"), "type"), "entity_id").groupBy(F.col("normalized_alias").alias("normalized_name"), "type").agg(F.min("entity_id").alias("alias_id"))
    found = names.join(exact, key, "left").join(known, key, "left")
    left = found.filter("exact_id is null and alias_id is null and embedding is not null")
    near = left.join(entities.filter("embedding is not null").select(F.col("id").alias("entity_id"), "type", F.col("embedding").alias("_e")), "type")
    near = near.select(*key, "entity_id", F.round(cosine(F.col("embedding"), F.col("_e")), 6).alias("c")).filter(F.col("c") >= threshold)
    near = near.groupBy(*key).agg(F.max_by("entity_id", F.struct("c", F.col("entity_id"))).alias("near_id"))
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias").when(F.col("near_id").isNotNull(), "embedding").otherwise("new")
    fresh = stable_id(F.col("type"), F.col("normalized_name"))
    return found.join(near, key, "left").select(*key, F.coalesce("exact_id", "alias_id", "near_id", fresh).alias("entity_id"), how.alias("how"))


# ---------------------------------------------------------------- store


def edge_id(source, relation, target):
    return stable_id(source, relation, target)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (source, relation, target): seed over llm, then the surer, then the old."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("source_entity_id", "relation", "target_entity_id").orderBy((F.col("origin") == "seed").desc(), F.desc("confidence"), "_new", "id")
    # By lag, as of a rank Spark would sort all rows before the shuffle too, in partitions whose short rows just became long.
    return both.withColumn("_first", F.lag(F.lit(True)).over(order).isNull()).filter("_first").drop("_first", "_new")


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't among them."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def seed_edges(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of the type chart: 18 types, its pairs as seed edges of confidence 1."""
    types = spark.createDataFrame([(t,) for t in TYPES], "canonical_name string").withColumn("normalized_name", F.lower("canonical_name"))
    entities = types.select(stable_id(F.lit("type"), F.col("normalized_name")).alias("id"), "canonical_name", "normalized_name", F.lit("type").alias("type"))
    relation = F.create_map(*[F.lit(x) for r, m in EFFECTIVENESS.items() for x in (m, r)])[F.col("multiplier")]
    chart = type_chart(spark).select(
        stable_id(F.lit("type"), F.lower("attacker")).alias("source_entity_id"),
        stable_id(F.lit("type"), F.lower("defender")).alias("target_entity_id"),
        relation.alias("relation"),
        F.struct("multiplier", F.lit(None).cast("string").alias("method")).cast(PROPERTIES).alias("properties"),
    )
    edges = chart.select(edge_id(F.col("source_entity_id"), F.col("relation"), F.col("target_entity_id")).alias("id"), "*", F.lit(1.0).cast("float").alias("confidence"), F.lit("seed").alias("origin"))
    return entities, edges


def collect_orphans(entities: DataFrame, edges: DataFrame, chunk_entities: DataFrame, edge_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) left: llm edges need provenance; then entities a mention or an edge."""
    proven = edges.join(edge_chunks.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")
    kept = edges.filter("origin = 'seed'").unionByName(proven.filter("origin <> 'seed'"))
    # Ids are made distinct before they are united, and both ends of an edge come from one pass.
    ends = kept.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).distinct()
    used = chunk_entities.select(F.col("entity_id").alias("id")).distinct().union(ends)
    return entities.join(used, "id", "left_semi"), kept


def cascade(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` without rows whose parents are gone, parents first."""
    out = dict(tables)
    for child in ("chunks", "entity_aliases", "edges", "chunk_entities", "edge_chunks", "chunk_extractions"):
        for column, parent in PARENTS[child]:
            if child in out and parent in out:
                ids = out[parent].select(F.col("id").alias(column))
                out[child] = out[child].join(ids, column, "left_semi").select(*out[child].columns)
    return out


# ---------------------------------------------------------------- checks


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation", "origin").agg(F.count("*").alias("edges"))


def uncited_edges(edges: DataFrame, edge_chunks: DataFrame) -> DataFrame:
    """Edges from extraction without provenance; any row is a fault."""
    return edges.filter("origin <> 'seed'").join(edge_chunks.select(F.col("edge_id").alias("id")), "id", "left_anti")


def overtyped(edges: DataFrame, most: int = 2) -> DataFrame:
    """(entity_id, types) of entities with more types than there can be."""
    return edges.filter("relation = 'has_type'").groupBy(F.col("source_entity_id").alias("entity_id")).agg(F.count_distinct("target_entity_id").alias("types")).filter(F.col("types") > most)


def unknown_relations(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("relation").isin(*RELATIONS))
