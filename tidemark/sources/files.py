"""Sources: Markdown folders as documents, and a JDBC reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_files(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """(source_uri, text) of the files named ``*.md`` in ``folder``, not below it.

    The URI is the name behind ``prefix``, not an absolute path, so another
    checkout of the same files is the same documents.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=False)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    return raw.select(F.concat(F.lit(prefix), F.url_decode(name)).alias("source_uri"), F.col("value").alias("text"))


def jdbc_table(spark: SparkSession, url: str, table: str, connections: int = 5, **options: str) -> DataFrame:
    """A database table, read over at most ``connections`` partitions."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", str(connections))
    return reader.options(**options).load()
