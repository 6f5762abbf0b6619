"""Graph walk: bounded breadth-first expansion, facts, matchups.

Edges are unpivoted to (from, to) once, so each hop is an equi-join and never an
OR. A hop keeps nodes that weren't visited (anti-join) and its frontier is
checkpointed, so the plan doesn't grow with the hops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..options import FactOptions, WalkOptions
from ..session import settle


#: Bytes of ids that may be sent to every task.
SENT_BYTES = 32 << 20


def _short(rows: DataFrame, id_col: str) -> bool:
    """Whether ``rows`` can be sent to every task, so that a join with them filters a scan and shuffles nothing."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(id_col).cast("string"))), F.lit(0))).first()
    return size + 40 * n <= SENT_BYTES


def _among(rows: DataFrame, ids: DataFrame, column: str, short: bool | None = None) -> DataFrame:
    """``rows`` whose ``column`` is among ``ids``; few ids are looked up where the rows are read."""
    return rows.join(F.broadcast(ids) if (_short(ids, column) if short is None else short) else ids, column, "left_semi")


def both_ways(edges: DataFrame, relations: tuple[str, ...] | None = None) -> DataFrame:
    """(from_id, to_id, confidence) of every edge and its reverse."""
    kept = edges if relations is None else edges.filter(F.col("relation").isin(*relations))
    out = kept.select(F.col("source_entity_id").alias("from_id"), F.col("target_entity_id").alias("to_id"), "confidence")
    return out.union(kept.select("target_entity_id", "source_entity_id", "confidence"))


def expand(seeds: DataFrame, edges: DataFrame, options: WalkOptions = WalkOptions()) -> DataFrame:
    """(entity_id, hops, seed_links, confidence) of what the seeds (entity_id, mentions) reach.

    Each entity once, at its shortest distance; ties and cycles don't matter. With
    a budget a hop keeps its most mentioned (hop 0) or most linked entities;
    ``max_nodes`` then keeps the nearest. No seeds, no rows.
    """
    budget = options.max_nodes_per_hop
    links = both_ways(edges, options.relations)
    start = seeds.groupBy("entity_id").agg(F.sum("mentions").alias("weight")).select("entity_id", F.lit(0).alias("hops"), F.col("weight").cast("long"), F.lit(1.0).cast("float").alias("confidence"))

    def cheapest(rows: DataFrame) -> DataFrame:
        return rows if budget is None else rows.orderBy(F.desc("weight"), "entity_id").limit(budget)

    frontier = settle(cheapest(start))
    visited = frontier
    for hop in range(1, options.max_hops + 1):
        step = _among(links, frontier.select(F.col("entity_id").alias("from_id")), "from_id")
        step = step.groupBy(F.col("to_id").alias("entity_id")).agg(F.count_distinct("from_id").alias("weight"), F.max("confidence").alias("confidence"))
        fresh = step.join(visited.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(hop).alias("hops"), "weight", "confidence")
        frontier = settle(cheapest(fresh))
        if not frontier.head(1):
            break
        visited = visited.union(frontier)
    order = (F.col("hops"), F.desc("weight"), F.col("entity_id"))
    return visited.orderBy(*order).limit(options.max_nodes) if options.max_nodes else visited


def seed_entities(seed_chunks: DataFrame, chunk_entities: DataFrame) -> DataFrame:
    """(entity_id, mentions) of the entities that the seed chunks mention."""
    return _among(chunk_entities, seed_chunks.select("chunk_id").distinct(), "chunk_id").groupBy("entity_id").agg(F.sum("mentions").alias("mentions"))


def reached_chunks(reached: DataFrame, chunk_entities: DataFrame, seed_chunks: DataFrame, include_seeds: bool = True) -> DataFrame:
    """(chunk_id, hops, confidence, mentions, is_seed) of chunks that mention reached entities.

    An entity counts once, at its least distance, so mentions aren't overcounted.
    """
    at = reached.select("entity_id", "hops", "confidence")
    if _short(reached, "entity_id"):
        near = _among(chunk_entities, reached.select("entity_id"), "entity_id", short=True).join(F.broadcast(at), "entity_id")
    else:
        near = chunk_entities.join(at, "entity_id")
    found = near.groupBy("chunk_id").agg(F.min("hops").alias("hops"), F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"))
    marked = found.join(seed_chunks.select("chunk_id", F.lit(True).alias("_s")).distinct(), "chunk_id", "left").select("chunk_id", "hops", "confidence", "mentions", F.coalesce("_s", F.lit(False)).alias("is_seed"))
    return marked if include_seeds else marked.filter("not is_seed")


def graph_search(seed_chunks: DataFrame, chunk_entities: DataFrame, edges: DataFrame, options: WalkOptions = WalkOptions(), include_seeds: bool = False, k: int = 50) -> DataFrame:
    """The graph arm: (chunk_id, hops, confidence, mentions, is_seed, rank), nearer first."""
    reached = expand(seed_entities(seed_chunks, chunk_entities), edges, options)
    found = reached_chunks(reached, chunk_entities, seed_chunks, include_seeds)
    best = found.orderBy("hops", F.desc("confidence"), F.desc("mentions"), "chunk_id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("hops", F.desc("confidence"), F.desc("mentions"), "chunk_id")))


def number_text(x: Column) -> Column:
    """2.0 as ``2``, 0.5 as ``0.5``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def fact_line(source: Column, relation: Column, target: Column, multiplier: Column, method: Column, chunk_ids: Column) -> Column:
    """``A --relation(qualifier)--> B [chunk:12345678 ...]``; a multiplier of 0 is shown."""
    qualifier = F.coalesce(F.concat(F.lit("("), number_text(multiplier), F.lit("x)")), F.concat(F.lit("("), F.nullif(method, F.lit("")), F.lit(")")), F.lit(""))
    cited = F.array_join(F.transform(chunk_ids, lambda c: F.concat(F.lit("chunk:"), F.substring(c, 1, 8))), " ")
    tail = F.when(F.size(F.coalesce(chunk_ids, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" ["), cited, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(source, F.lit(" --"), relation, qualifier, F.lit("--> "), target, tail)


def facts(entities: DataFrame, edges: DataFrame, names: DataFrame, edge_chunks: DataFrame, options: FactOptions = FactOptions()) -> DataFrame:
    """(position, edge_id, source_name, line, chunk_ids) of edges at ``entities`` (entity_id, weight).

    Edges touch one of them, or join two of them. They are ranked by the heavier
    end; no entity has more than ``max_facts_per_entity`` lines as the heavier
    end, and at most ``max_facts`` are kept.
    """
    e = entities.groupBy("entity_id").agg(F.max("weight").alias("weight"))
    s = e.select(F.col("entity_id").alias("source_entity_id"), F.col("weight").alias("_sw"))
    t = e.select(F.col("entity_id").alias("target_entity_id"), F.col("weight").alias("_tw"))
    how = "inner" if options.require_both_endpoints else "left"
    touched = edges.join(s, "source_entity_id", how).join(t, "target_entity_id", how).filter("_sw is not null or _tw is not null")
    heavier = F.coalesce(F.col("_sw"), F.lit(-1)) >= F.coalesce(F.col("_tw"), F.lit(-1))
    touched = touched.withColumn("_owner", F.when(heavier, F.col("source_entity_id")).otherwise(F.col("target_entity_id"))).withColumn("_w", F.greatest("_sw", "_tw"))
    order = [F.desc("_w"), F.desc("confidence"), F.col("id")]
    capped = touched.withColumn("_n", F.row_number().over(Window.partitionBy("_owner").orderBy(*order[1:]))).filter(F.col("_n") <= options.max_facts_per_entity)
    capped = capped.orderBy(*order).limit(options.max_facts)
    cited = edge_chunks.join(capped.select(F.col("id").alias("edge_id")), "edge_id", "left_semi").groupBy("edge_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    n = names.select(F.col("id").alias("_id"), F.col("canonical_name").alias("_name"))
    full = (
        capped.join(cited.withColumnRenamed("edge_id", "id"), "id", "left")
        .join(n.select(F.col("_id").alias("source_entity_id"), F.col("_name").alias("source_name")), "source_entity_id")
        .join(n.select(F.col("_id").alias("target_entity_id"), F.col("_name").alias("target_name")), "target_entity_id")
    )
    line = fact_line(F.col("source_name"), F.col("relation"), F.col("target_name"), F.col("properties.multiplier"), F.col("properties.method"), F.col("chunk_ids"))
    position = F.row_number().over(Window.orderBy(*order))
    return full.select(position.alias("position"), F.col("id").alias("edge_id"), "source_name", line.alias("line"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"))


def fact_block(rows: DataFrame) -> DataFrame:
    """One row, ``block``: a fact a line, empty without facts."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("block"))


def matchups(typed: DataFrame, chart: DataFrame) -> DataFrame:
    """(entity_id, attacker, multiplier): the chart multiplied over an entity's types.

    ``typed`` is (entity_id, type). A pair the chart lacks counts 1; products of 1
    are dropped. The seeded chart alone is read, so no extracted error multiplies.
    """
    hits = typed.distinct().join(F.broadcast(chart), F.col("type") == F.col("defender"))
    return hits.groupBy("entity_id", "attacker").agg(F.product("multiplier").alias("multiplier")).filter("multiplier <> 1")


def matchup_lines(typed: DataFrame, chart: DataFrame, names: DataFrame) -> DataFrame:
    """(entity_id, line): ``Name (A/B) takes 4x from X; 2x from Y, Z; 0x from W``."""
    groups = matchups(typed, chart).groupBy("entity_id", "multiplier").agg(F.array_join(F.array_sort(F.collect_set("attacker")), ", ").alias("who"))
    part = F.concat(number_text(F.col("multiplier")), F.lit("x from "), F.col("who"))
    joined = groups.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("multiplier")).alias("o"), part.alias("p")))), lambda x: x["p"]), "; ").alias("takes"))
    types = typed.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("type")), "/").alias("types"))
    named = joined.join(types, "entity_id").join(names.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("name")), "entity_id")
    return named.select("entity_id", F.concat("name", F.lit(" ("), "types", F.lit(") takes "), "takes").alias("line"))
