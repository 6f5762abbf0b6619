"""The star schema as a graph, so that graph operators run and are checked at scale.

Nodes are regions, nations, suppliers, customers and parts; orders stand for
chunks and mention their customer and parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PROPERTIES


def _node(letter: str, column: str):
    return F.concat(F.lit(letter + ":"), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_entity_id, target_entity_id, relation, properties, confidence, origin."""
    table = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    one = F.lit(1.0).cast("float")
    supplied = table("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    parts = [
        table("nation").select(_node("n", "n_nationkey"), _node("r", "n_regionkey"), F.lit("member_of"), one, F.lit("seed")),
        table("supplier").select(_node("s", "s_suppkey"), _node("n", "s_nationkey"), F.lit("found_in"), one, F.lit("llm")),
        table("customer").select(_node("c", "c_custkey"), _node("n", "c_nationkey"), F.lit("found_in"), one, F.lit("llm")),
        supplied.select(_node("p", "l_partkey"), _node("s", "l_suppkey"), F.lit("supplied_by"), (F.least("n", F.lit(4)) / 4).cast("float"), F.lit("llm")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.toDF("source_entity_id", "target_entity_id", "relation", "confidence", "origin")
    return out.withColumn("id", F.concat_ws("|", "source_entity_id", "relation", "target_entity_id")).withColumn("properties", F.lit(None).cast(PROPERTIES))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, entity_id, mentions."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_partkey").agg(F.count("*").cast("int").alias("mentions"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(_node("o", "o_orderkey"), _node("c", "o_custkey"), F.lit(1))
    return lines.select(_node("o", "l_orderkey").alias("chunk_id"), _node("p", "l_partkey").alias("entity_id"), "mentions").union(orders)


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, chunk_id: the orders that show a part's supplier."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edge = F.concat_ws("|", _node("p", "l_partkey"), F.lit("supplied_by"), _node("s", "l_suppkey"))
    return line.select(edge.alias("edge_id"), _node("o", "l_orderkey").alias("chunk_id")).distinct()


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, canonical_name, normalized_name, type, embedding of every node."""
    out = None
    for letter, table, key, name, kind in (("r", "region", "r_regionkey", "r_name", "region"), ("n", "nation", "n_nationkey", "n_name", "region"), ("s", "supplier", "s_suppkey", "s_name", "group"), ("c", "customer", "c_custkey", "c_name", "group"), ("p", "part", "p_partkey", "p_name", "item")):
        t = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(_node(letter, key).alias("id"), F.col(name).alias("canonical_name"), F.lit(kind).alias("type"))
        out = t if out is None else out.union(t)
    return out.withColumn("normalized_name", F.lower("canonical_name")).withColumn("embedding", F.lit(None).cast("array<float>"))


#: The same graph in SQL.
SQL = """
    edges AS (
        SELECT 'n:' || n_nationkey AS source_entity_id, 'r:' || n_regionkey AS target_entity_id, 'member_of' AS relation, 1.0::FLOAT AS confidence, 'seed' AS origin FROM nation
        UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'found_in', 1.0::FLOAT, 'llm' FROM supplier
        UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'found_in', 1.0::FLOAT, 'llm' FROM customer
        UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'supplied_by', (least(count(*), 4) / 4)::FLOAT, 'llm' FROM lineitem GROUP BY l_partkey, l_suppkey
    ),
    mentions AS (
        SELECT 'o:' || l_orderkey AS chunk_id, 'p:' || l_partkey AS entity_id, count(*) AS mentions FROM lineitem GROUP BY l_orderkey, l_partkey
        UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 1 FROM orders
    ),
    provenance AS (SELECT DISTINCT 'p:' || l_partkey || '|supplied_by|s:' || l_suppkey AS edge_id, 'o:' || l_orderkey AS chunk_id FROM lineitem),
    names AS (
        SELECT 'r:' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'n:' || n_nationkey, n_name FROM nation
        UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'c:' || c_custkey, c_name FROM customer UNION ALL SELECT 'p:' || p_partkey, p_name FROM part
    ),
    links AS (SELECT source_entity_id AS a, target_entity_id AS b, confidence FROM edges UNION ALL SELECT target_entity_id, source_entity_id, confidence FROM edges)"""
