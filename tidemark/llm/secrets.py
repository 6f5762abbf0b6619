"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of every path is content-addressed by the SHA-256 of its text. The
ledger is a table, one row for each (blob, rule version) that was ever scanned,
with the spans found. A run scans only pairs that the ledger lacks, each blob
once however many paths and versions share it, appends them, and joins the
findings back to all paths.

Semantics: null text counts as the empty blob; spans are in code points, end
exclusive; matches of one rule don't overlap and go left to right, and those
whose ``group`` is shorter than ``at_least`` are dropped; rows with a null path
or repeated rows are kept as they are; a text of any length is scanned whole, in
one task; columns other than those named are
ignored; an empty table gives an empty result and leaves the ledger as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path


@dataclass(frozen=True)
class Rule:
    """The key holds a digest of the rule itself, so a changed rule is a new one under any version."""

    name: str
    version: int
    pattern: str
    group: int
    at_least: int

    @property
    def key(self) -> str:
        body = hashlib.sha256(f"{self.group}:{self.at_least}:{self.pattern}".encode()).hexdigest()
        return f"{self.name}@{self.version}.{body[:12]}"


#: In the order in which kinds are listed at equal starts.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
_SPANS = "array<struct<start:int,stop:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's matches: the text splits at them, so lengths give positions."""
    pattern = F.lit(rule.pattern)
    whole, group = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("p"), whole.alias("m"), group.alias("g"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["p"])
        stop = start + F.length(part["m"])
        found = F.when(F.length(part["g"]) >= rule.at_least, F.array(F.struct(start.alias("start"), stop.alias("stop")))).otherwise(F.array().cast(_SPANS))
        return F.when(part["m"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.concat(acc["found"], found).alias("found")))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))
    return F.when(text.rlike(rule.pattern), F.aggregate(parts, first, step)["found"]).otherwise(F.array().cast(_SPANS))


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.schema(f"blob binary, spans {_SPANS}, rule string").parquet(path)


def scan(versions: DataFrame, ledger_path: str, path_cols: Sequence[str], text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks, then give ``path_cols``, blob and findings.

    ``versions`` has a row for each version of each path. The result has, for
    every row, ``blob`` (binary) and ``findings``, an array of (start, kind,
    rule, stop) in order. A text is shuffled once, and only one of equal texts
    leaves its scan partition, so a blob of a third of all paths isn't a hot key;
    the last join has one row a blob on the right, so Spark splits its hot blobs.
    """
    spark = versions.sparkSession
    keys = [r.key for r in rules]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(*path_cols, F.unhex(F.sha2(text, 256)).alias("blob"))
    blobs = versions.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    known = _ledger(spark, ledger_path)
    if known is None:
        todo = blobs.withColumn("todo", F.array(*map(F.lit, keys)))
    else:
        seen = known.filter(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("seen", F.array().cast("array<string>"))))
        todo = todo.filter(F.size("todo") > 0)
    each = F.array(*[F.when(F.array_contains("todo", r.key), F.struct(F.lit(r.key).alias("rule"), spans(F.col("text"), r).alias("spans"))) for r in rules])
    found = todo.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("blob", "x.spans", "x.rule")
    found.write.mode("append").partitionBy("rule").parquet(ledger_path)
    known = _ledger(spark, ledger_path)
    if known is None:
        known = found.limit(0)
    kind = F.array_position(F.array(*map(F.lit, keys)), F.col("rule")).cast("int")
    hits = known.filter(F.col("rule").isin(keys) & (F.size("spans") > 0))
    hits = hits.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), kind.alias("kind"), F.col("rule").alias("rule"), s["stop"].alias("stop"))).alias("s"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("findings"))
    empty = F.array().cast("array<struct<start:int,kind:int,rule:string,stop:int>>")
    return rows.join(hits, "blob", "left").withColumn("findings", F.coalesce("findings", empty)).select(*path_cols, "blob", "findings")


def _count(rule: Rule) -> Column:
    return F.size(F.filter("findings", lambda f: f["rule"] == rule.key)).cast("long")


def secret_digest(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scan's findings a document: counts by kind, the spans and their digest."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ledger_path or fresh_path(docs.sparkSession, "secret-ledger"), ["doc_id"])
    name = lambda f: F.element_at(F.split(f["rule"], "@"), 1)
    joined = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", name(f), f["start"], f["stop"])), ",")
    counts = [_count(r).alias(f"n_{r.name}") for r in RULES]
    return found.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
