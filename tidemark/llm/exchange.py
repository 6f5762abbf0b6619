"""Compressed fingerprint exchange between scan partitions and owners.

Senders (scan partitions) send sorted, Golomb-coded hashes to the owner of each
hash range; the owner answers every message with one bit a hash; the senders
read their answers from the shared folder when they scan again. Only hashes and
bits move, no text, and nothing of it passes the driver or a broadcast.

The scan must give the same partitions both times: :func:`pinned` writes
anything but a plain scan as a table first, and :func:`fix_splits` keeps the
splits from following the number of live executors; a checksum in every
answer makes a task fail rather than use answers to other rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_path, fresh_path, lean, open_fs
from .pfor import pack_groups, unpack_groups

MESSAGE = "sender int, chunk int, bucket int, n long, payload binary"
REPLY = "sender int, chunk int, bucket int, n long, sum long, bits binary"


# ---------------------------------------------------------------- coding


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers below 2**width, ``width`` bits each."""
    if not width or not len(values):
        return b""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    return pack_groups(padded.reshape(-1, 64), width).astype("<u8").tobytes()


def packed_size(n: int, width: int) -> int:
    return -(-n // 64) * width * 8 if width else 0


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint64)
    return unpack_groups(np.frombuffer(data, "<u8", -(-n // 64) * width).reshape(-1, width), width).reshape(-1)[:n]


def golomb_encode(values: np.ndarray, base: int) -> bytes:
    """Sorted distinct uint64 values, none below ``base``: Golomb code of the gaps.

    The divisor is the power of two next below the mean gap; quotients are
    unary, remainders have fixed width.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.empty(n, np.uint64)
    gaps[0] = values[0] - np.uint64(base)
    gaps[1:] = values[1:] - values[:-1]
    k = max(0, ((int(values[-1]) - base) // n).bit_length() - 1)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = gaps & np.uint64((1 << k) - 1)
    return bytes([k]) + pack_bits(rest, k) + np.packbits(unary).tobytes()


def golomb_decode(data: bytes, n: int, base: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    k = data[0]
    cut_at = 1 + packed_size(n, k)
    rest = unpack_bits(data[1:cut_at], n, k)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=cut_at)))[:n]
    quotient = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    return np.cumsum((quotient << np.uint64(k)) | rest, dtype=np.uint64) + np.uint64(base)


def bucket_bounds(bits: int, buckets: int) -> np.ndarray:
    """Lowest hash of each owner, and the end, for hashes of ``bits`` bits."""
    return np.array([(b << bits) // buckets for b in range(buckets)] + [(1 << bits) - 1], np.uint64)


def split_by_owner(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Slice positions of the owners' ranges in sorted ``values``."""
    at = np.searchsorted(values, bounds)
    at[-1] = len(values)
    return at


def checksum(values: np.ndarray) -> int:
    return int(values.sum(dtype=np.uint64) & np.uint64((1 << 62) - 1)) if len(values) else 0


# ---------------------------------------------------------------- stable scans


def pinned(df: DataFrame) -> DataFrame:
    """``df`` if it is a plain deterministic file scan, else a table of it."""
    todo, plain = [df._jdf.queryExecution().optimizedPlan()], True
    plain = todo[0].deterministic()
    while todo and plain:
        node = todo.pop()
        plain = node.nodeName().split(" ")[0] in ("LogicalRelation", "Relation", "Project", "Filter") and node.children().size() <= 1
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df if plain and df.inputFiles() else cut(df, "pinned")


def fix_splits(spark: SparkSession) -> None:
    """Keep file splits from depending on how many executors live (stays set)."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def owners_for(df: DataFrame, bytes_a_hash: int, senders: int, hashes: int = 4_000_000) -> int:
    """Owners so that each gets about ``hashes`` of a scan of ``df``, at most two a sender.

    A sender's message to an owner should hold many hashes: for very large inputs
    let ``spark.sql.files.maxPartitionBytes`` and the owners' memory grow together.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(8, min(2 * senders, -(-size // (bytes_a_hash * hashes))))


def among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the sorted ``values`` are in sorted ``found``."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def n_partitions(df: DataFrame) -> int:
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


# ---------------------------------------------------------------- exchange


def exchange(source: DataFrame, send: Callable, own: Callable, owners: int, name: str) -> str:
    """Run senders and owners; the path of the table of replies by sender.

    Each of the ``owners`` buckets is a partition of its own, so none has two.

    ``send`` maps Arrow batches to batches of MESSAGE; ``own`` takes a list of
    (n, payload) of one bucket, with the bucket, and gives (checksum, bit array)
    for each of them.
    """
    import pyarrow as pa

    spark = source.sparkSession

    @lean
    def answer(table):
        if not table.num_rows:
            return pa.table({k: [] for k in ("sender", "chunk", "bucket", "n", "sum", "bits")})
        bucket = table.column("bucket")[0].as_py()
        found = own(bucket, list(zip(table.column("n").to_pylist(), table.column("payload").to_pylist())))
        return pa.table(
            {
                "sender": table.column("sender"),
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "n": table.column("n"),
                "sum": pa.array([s for s, _ in found], pa.int64()),
                "bits": pa.array([np.packbits(b).tobytes() for _, b in found], pa.binary()),
            }
        )

    path = fresh_path(spark, name)
    replies = source.mapInArrow(send, MESSAGE).repartitionById(owners, F.col("bucket")).groupBy("bucket").applyInArrow(answer, REPLY)
    replies.repartition("sender").write.partitionBy("sender").parquet(path)
    return path


def read_replies(path: str, sender: int) -> dict[int, list[tuple[int, int, int, bytes]]]:
    """In a task: the (bucket, n, checksum, bits) of each chunk of this sender, by bucket."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, folder = open_fs(f"{path}/sender={sender}")
    out: dict[int, list[tuple[int, int, int, bytes]]] = {}
    for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                t = pq.ParquetFile(f).read(columns=["chunk", "bucket", "n", "sum", "bits"])
            for chunk, *rest in zip(*(t.column(c).to_pylist() for c in ("chunk", "bucket", "n", "sum", "bits"))):
                out.setdefault(chunk, []).append(tuple(rest))
    return {chunk: sorted(rows) for chunk, rows in out.items()}


def answered(rows: list[tuple[int, int, int, bytes]], values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One boolean for each of the sorted ``values`` that this sender sent."""
    at, out, seen = split_by_owner(values, bounds), np.zeros(len(values), bool), 0
    for bucket, n, total, bits in rows:
        a, b = int(at[bucket]), int(at[bucket + 1])
        if b - a != n or checksum(values[a:b]) != total:
            raise RuntimeError("the second scan gave this partition other rows than the first")
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        seen += n
    if seen != len(values):
        raise RuntimeError("the second scan gave this partition other rows than the first")
    return out


def messages(sender: int, chunk: int, values: np.ndarray, bounds: np.ndarray, extra: Callable[[int, int], bytes] | None = None):
    """Arrow batches of MESSAGE for sorted distinct ``values``."""
    import pyarrow as pa

    at = split_by_owner(values, bounds)
    rows: list[tuple] = []
    for b in range(len(bounds) - 1):
        i, j = int(at[b]), int(at[b + 1])
        if j > i:
            code = golomb_encode(values[i:j], int(bounds[b]))
            rows.append((sender, chunk, b, j - i, (len(code).to_bytes(4, "little") + code + extra(i, j)) if extra else code))
    if rows:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["sender", "chunk", "bucket", "n", "payload"])


__all__ = ["among", "answered", "bucket_bounds", "checksum", "drop_path", "exchange", "fix_splits", "golomb_decode", "golomb_encode", "messages", "n_partitions", "owners_for", "pack_bits", "packed_size", "pinned", "read_replies", "split_by_owner", "unpack_bits"]
