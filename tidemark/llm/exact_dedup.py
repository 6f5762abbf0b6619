"""Exact dedup by Golomb-coded fingerprint exchange.

1. Each scan partition takes the SHA-256 of every normalised text and sends the
   sorted 62-bit fingerprints, Golomb-coded, to the owners of their ranges, for
   every ``CHUNK_BYTES`` of text anew.
2. An owner tells each sender, a bit a fingerprint, which ones others sent too.
3. Each partition scans again, a chunk at a time. Rows whose fingerprint is alone
   pass at once. Of the suspects it sends every distinct text once, with its
   number of rows and largest id; the texts are grouped byte for byte.

Only suspect texts are shuffled, each at most once a chunk, so a text that holds
a third of all rows never gathers in one task; in the last join, of short rows
with one row a text, Spark splits the skewed side.

Semantics: null text counts as empty; A-Z are lower-cased and nothing else is;
the row with the largest ``doc_id`` stays (null is the smallest); rows that
share both text and ``doc_id`` count separately and share one decision; a very
long text is hashed and compared whole, in a chunk of its own; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import cut, drop_path, lean
from .wordhash import distinct, first_of_each

BITS = 62
CHUNK_BYTES = 1 << 24


def _digests(column):
    for value in column:
        text = value.as_py()
        body = text.encode("utf-8", "surrogatepass").lower() if text else b""
        yield body, hashlib.sha256(body).digest()


def _chunks(batches, id_at: int | None, text_at: int) -> Iterator[tuple[int, list[tuple[int | None, bytes, bytes]]]]:
    """(number, rows of id, text, digest), some ``CHUNK_BYTES`` of text at a time."""
    number, size = 0, 0
    rows: list[tuple[int | None, bytes, bytes]] = []
    for batch in batches:
        ids = [None] * batch.num_rows if id_at is None else batch.column(id_at).to_pylist()
        for i, (body, digest) in zip(ids, _digests(batch.column(text_at))):
            rows.append((i, body, digest))
            size += len(body)
            if size >= CHUNK_BYTES:
                yield number, rows
                rows, size, number = [], 0, number + 1
    if rows:
        yield number, rows


def _finger(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") >> (64 - BITS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    import pyarrow as pa

    spark = docs.sparkSession
    plain = X.pinned(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")))

    @lean
    def send(batches):
        from pyspark import TaskContext

        sender = TaskContext.get().partitionId()
        for number, rows in _chunks(batches, None, 0):
            values = distinct(np.array([_finger(d) for _, _, d in rows], np.uint64))
            yield from X.messages(sender, number, values, bounds)

    def own(bucket, received):
        lists = [X.golomb_decode(p, n, int(bounds[bucket])) for n, p in received]
        every = np.sort(np.concatenate(lists))
        new = np.flatnonzero(first_of_each(every))
        shared = every[new[np.diff(np.append(new, len(every))) > 1]]
        return [(X.checksum(v), X.among(v, shared)) for v in lists]

    @lean
    def resolve(batches):
        from pyspark import TaskContext

        replies = X.read_replies(path, TaskContext.get().partitionId())
        for number, rows in _chunks(batches, 0, 1):
            yield from settle(rows, replies.get(number, []))

    def settle(rows, answers):
        texts: dict[bytes, list] = {}
        for i, body, digest in rows:
            group = texts.get(digest)
            if group is None:
                texts[digest] = [body, 1, i]
            elif group[0] != body:
                raise RuntimeError("two texts with one SHA-256")
            else:
                group[1] += 1
                if group[2] is None or i is not None and i > group[2]:
                    group[2] = i
        order = np.array([_finger(d) for d in texts], np.uint64)
        values = distinct(order)
        shared = values[X.answered(answers, values, bounds)]
        suspect = {d: bool(x) for d, x in zip(texts, X.among(order, shared))}
        names = ["kind", "i", "sha", "n", "keep", "body"]

        def out(kind, lines):
            for a in range(0, len(lines), 512):
                i, sha, n, keep, body = zip(*lines[a : a + 512])
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(i), pa.int32()), pa.array(i, pa.int64()), pa.array(sha, pa.binary()), pa.array(n, pa.int64()), pa.array(keep, pa.int64()), pa.array(body, pa.binary())], names)

        yield from out(0, [(i, d, texts[d][1], texts[d][2], None) for i, _, d in rows if not suspect[d]])
        yield from out(1, [(i, d, None, None, None) for i, _, d in rows if suspect[d]])
        yield from out(2, [(None, d, g[1], g[2], g[0]) for d, g in texts.items() if suspect[d]])

    X.fix_splits(spark)
    bounds = X.bucket_bounds(BITS, X.owners_for(plain, 1000, X.n_partitions(plain)))
    path = X.exchange(plain.select("t"), send, own, len(bounds) - 1, "dedup-replies")
    scan = cut(plain.mapInArrow(resolve, "kind int, i long, sha binary, n long, keep long, body binary"), "dedup-rows", "kind")
    drop_path(spark, path)
    same = scan.filter("kind = 2").groupBy("sha", "body").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"))
    same = same.groupBy("sha").agg(F.sum("n").alias("n"), F.max("keep").alias("keep"), F.count("*").alias("bodies"))
    same = same.filter(F.when(F.col("bodies") > 1, F.raise_error(F.lit("two texts with one SHA-256"))).otherwise(F.lit(True)).cast("boolean"))
    alone = scan.filter("kind = 0").select("i", "keep", "n", "sha")
    grouped = scan.filter("kind = 1").select("i", "sha").join(same.select("sha", "n", "keep"), "sha").select("i", "keep", "n", "sha")
    return alone.unionByName(grouped).select(
        F.col("i").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("i").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
