"""Streaming ingest: a folder of Markdown files as an idempotent stream of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..plans.ingest import ingest
from ..sources.tables import Store


def job_id(text):
    """Jobs are keyed by content, so sending a file twice is one job."""
    return F.substring(content_hash(text), 1, 32)


def stream_folder(store: Store, folder: str, checkpoint: str, quarantine: str, available_now: bool = True, **options) -> StreamingQuery:
    """Ingest files as they come; texts that can't be read go to ``quarantine`` with a reason.

    A batch that is run again finds its documents unchanged and skips them.
    """
    spark = store.spark
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").load(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    files = raw.select(F.url_decode(name).alias("source_uri"), F.col("value").alias("text"))

    def run(batch: DataFrame, number: int) -> None:
        bad = F.when(F.col("text").contains("\x00"), "binary")
        marked = batch.withColumn("reason", bad)
        failed = marked.filter("reason is not null")
        failed.select(job_id(F.col("text")).alias("job_id"), "source_uri", "reason", F.lit(number).alias("batch")).write.mode("append").parquet(quarantine)
        ingest(store, marked.filter("reason is null").select("source_uri", "text"), **options)

    writer = files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
