"""Token-ID / binary output: patched frame-of-reference blocks.

Each file holds the ids of one range of documents in ascending ``doc_id`` order
as blocks of 256 values. A block stores its minimum; the differences from it are
packed at the width that the ``percentile`` of them needs; the few that need
more go to an exception list (position, high bits) that patches the block on
reading. The footer indexes where each block and each exception list starts, so
a reader can seek to any document. Integers are little-endian.

    "TPF1" | chunk* | footer | u64 footer offset | "TPF1"
    chunk  = packed u64 words of its blocks | exception positions u8 | high bits u32
    footer = u64 n_docs, n_tokens, n_blocks, n_chunks
           | doc_id i64 | doc is null u8 | tokens of doc u64
           | block minimum u32 | width u8 | exceptions u16 | block start u64
           | blocks of chunk u64 | exception start of chunk u64

Semantics: null text counts as empty; an empty document has only the end id; a
null ``doc_id`` sorts first; rows that share a ``doc_id`` are ordered by the first
64 characters of their texts, then by a hash of them, so that a ``doc_id`` of very
many rows still spreads over tasks; a text of any length is encoded whole, in one
task; other columns are ignored; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, lean, on_leaving, open_fs

BLOCK = 256
CHUNK_BLOCKS = 2048
MAGIC = b"TPF1"

# ---------------------------------------------------------------- tokenizer

_SAFE = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_chars() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(extra)) for b in range(256)]


class _Memo(dict):
    """A dictionary of at most ``most`` bytes; when half of them are new, those not met lately go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.room, self.older = most // 2, most // 2, {}

    def keep(self, key: str, ids: bytes) -> None:
        self.room -= 140 + len(key) + len(ids)
        if self.room < 0:
            self.older, self.room = dict(self), self.most
            self.clear()
        self[key] = ids

    def forget(self) -> None:
        self.clear()
        self.older, self.room = {}, self.most


class _Pieces(_Memo):
    def __init__(self, model, most: int):
        super().__init__(most)
        self.model, self.chars = model, _byte_chars()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is not None:
            self.keep(piece, ids)
            return ids
        mapped = "".join([self.chars[b] for b in piece.encode()])
        ids = np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()
        if len(piece) <= 32:
            self.keep(piece, ids)
        return ids


class _Words(_Memo):
    """Ids of a white-space-delimited word, through the tokenizers library.

    Words of plain ASCII and Latin-1 letters take a short way: the library's
    model on the pieces that its pre-tokenizer would cut. Others take its whole
    pipeline. The memo has a bound in bytes and is dropped with the encoder.
    """

    def __init__(self, tokenizer, most: int):
        super().__init__(most)
        self.tokenizer, self.pieces = tokenizer, _Pieces(tokenizer.model, most // 2)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is not None:
            pass
        elif not word:
            ids = b""
        elif _SAFE.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(word.lower())))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= 40:
            self.keep(word, ids)
        return ids


class Encoder:
    """Text to ``<u4`` id bytes, equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str, memo_bytes: int = 120_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            normal == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [p["type"] for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": _SPLIT}
            and pre[0]["behavior"] == "Removed"
            and pre[0]["invert"]
            and not pre[1]["add_prefix_space"]
            and not pre[1]["use_regex"]
            and spec["model"]["type"] == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or not t["content"].startswith("<|") for t in spec["added_tokens"])
        )
        self.words = _Words(self.tokenizer, memo_bytes)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per Python worker, kept until it runs another operator's task."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
            on_leaving(__name__, cls._by_path.clear)
        return cls._by_path[path]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


# ---------------------------------------------------------------- bit packing


def pack_groups(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 64) values below 2**width to (n, width) 64-bit words."""
    v = np.ascontiguousarray(values.T.astype(np.uint64))
    out = np.zeros((width, values.shape[0]), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= v[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= v[i] >> np.uint64(64 - shift)
    return out.T


def unpack_groups(words: np.ndarray, width: int) -> np.ndarray:
    """Inverse of :func:`pack_groups`."""
    w, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    out = np.zeros((64, words.shape[0]), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[i] = w[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= w[word + 1] << np.uint64(64 - shift)
    return out.T & mask


def bit_lengths(v: np.ndarray) -> np.ndarray:
    return np.where(v > 0, np.floor(np.log2(np.maximum(v, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_chunk(ids: np.ndarray, percentile: float) -> tuple[bytes, dict[str, np.ndarray]]:
    """Some whole blocks of u32 ids to bytes and their index."""
    v = ids.reshape(-1, BLOCK)
    low = v.min(axis=1)
    rest = v - low[:, None]
    kth = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = bit_lengths(np.partition(rest, kth, axis=1)[:, kth]).astype(np.uint8)
    size = width.astype(np.int64) * (BLOCK // 64)
    at = np.concatenate([[0], np.cumsum(size)])
    packed = np.zeros(at[-1], "<u8")
    high = rest >> width[:, None].astype(np.uint32)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            groups = (rest[which] & np.uint32((1 << int(w)) - 1)).reshape(-1, 64)
            packed[at[which][:, None] + np.arange(int(w) * (BLOCK // 64))] = pack_groups(groups, int(w)).reshape(len(which), -1)
    row, position = np.nonzero(high)
    body = packed.tobytes() + position.astype(np.uint8).tobytes() + high[row, position].astype("<u4").tobytes()
    return body, {"low": low, "width": width, "exceptions": np.bincount(row, minlength=len(v)).astype(np.uint16), "at": at[:-1] * 8, "tail": at[-1] * 8}


def decode_chunk(body: bytes, low: np.ndarray, width: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    size = width.astype(np.int64) * (BLOCK // 64)
    at = np.concatenate([[0], np.cumsum(size)])
    packed = np.frombuffer(body, "<u8", at[-1])
    rest = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        if w:
            words = packed[at[which][:, None] + np.arange(int(w) * (BLOCK // 64))].reshape(-1, int(w))
            rest[which] = unpack_groups(words, int(w)).astype(np.uint32).reshape(len(which), BLOCK)
    n = int(exceptions.sum(dtype=np.int64))
    position = np.frombuffer(body, np.uint8, n, at[-1] * 8)
    high = np.frombuffer(body, "<u4", n, at[-1] * 8 + n)
    row = np.repeat(np.arange(len(low)), exceptions)
    rest[row, position] |= high << width[row].astype(np.uint32)
    return (rest + low[:, None]).reshape(-1)


class Writer:
    """Streams documents into one file; memory is one chunk and the index."""

    def __init__(self, sink, percentile: float):
        self.sink, self.percentile, self.offset = sink, percentile, 4
        self.pending: list[bytes] = []
        self.waiting = self.tokens = 0
        self.ids: list[int] = []
        self.null: list[int] = []
        self.counts: list[int] = []
        self.index: list[dict] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.pending.append(ids)
        self.waiting += len(ids) // 4
        self.tokens += len(ids) // 4
        if self.waiting >= CHUNK_BLOCKS * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.pending), "<u4")
        whole, step = len(flat) // BLOCK * BLOCK, CHUNK_BLOCKS * BLOCK
        if last and whole < len(flat):
            flat = np.concatenate([flat, np.full(whole + BLOCK - len(flat), flat[whole:].min(), np.uint32)])
            whole = len(flat)
        for a in range(0, whole, step):
            body, index = encode_chunk(flat[a : min(a + step, whole)], self.percentile)
            index["at"] = index["at"] + self.offset
            index["tail"] = index["tail"] + self.offset
            self.index.append(index)
            self.sink.write(body)
            self.offset += len(body)
        self.pending = [flat[whole:].tobytes()]
        self.waiting = len(flat) - whole

    def close(self) -> None:
        self._flush(True)
        cat = lambda key, kind: np.concatenate([np.asarray(i[key]).reshape(-1) for i in self.index] or [np.zeros(0)]).astype(kind).tobytes()
        blocks = [len(i["low"]) for i in self.index]
        head = np.array([len(self.ids), self.tokens, sum(blocks), len(blocks)], "<u8").tobytes()
        docs = np.array(self.ids, "<i8").tobytes() + np.array(self.null, np.uint8).tobytes() + np.array(self.counts, "<u8").tobytes()
        index = cat("low", "<u4") + cat("width", np.uint8) + cat("exceptions", "<u2") + cat("at", "<u8")
        chunks = np.array(blocks, "<u8").tobytes() + cat("tail", "<u8")
        self.sink.write(head + docs + index + chunks + np.array([self.offset], "<u8").tobytes() + MAGIC)


class Reader:
    """Footer of a file, and its ids chunk by chunk."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 12)
        tail = source.read(12)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        start = int(np.frombuffer(tail, "<u8", 1)[0])
        source.seek(start)
        foot, at = source.read(size - 12 - start), 32
        docs, self.n_tokens, blocks, chunks = (int(x) for x in np.frombuffer(foot, "<u8", 4))

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(foot, kind, n, at)
            at += out.nbytes
            return out

        self.doc_id, self.null, self.counts = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.low, self.width, self.exceptions, self.start = take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks)
        self.blocks = take("<u8", chunks).astype(np.int64)
        self.end = start

    def chunks(self) -> Iterator[np.ndarray]:
        """Ids in order; the last chunk's padding is cut off."""
        b, left = 0, self.n_tokens
        for k, n in enumerate(self.blocks):
            a, b = b, b + int(n)
            stop = int(self.start[b]) if b < len(self.start) else self.end
            self.source.seek(int(self.start[a]))
            ids = decode_chunk(self.source.read(stop - int(self.start[a])), self.low[a:b], self.width[a:b], self.exceptions[a:b])
            yield ids[:left]
            left -= min(left, len(ids))

    def documents(self) -> Iterator[tuple[int | None, int, int, np.ndarray]]:
        """(doc_id, start in the file, number of ids, ids), in file order."""
        chunks, have, d, start = self.chunks(), np.zeros(0, np.uint32), 0, 0
        for d, n in enumerate(self.counts):
            parts, missing = [], int(n)
            while missing:
                if not len(have):
                    have = next(chunks)
                parts.append(have[:missing])
                missing -= len(parts[-1])
                have = have[len(parts[-1]) :]
            ids = parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint32)])
            yield (None if self.null[d] else int(self.doc_id[d])), start, int(n), ids
            start += int(n)


# ---------------------------------------------------------------- Spark


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 2, percentile: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode ``docs`` and write one file per range of ids, in ascending order.

    Returns the manifest, (path, ids in the files before it, ids in it), a row a
    file. One range shuffle of the texts; a task writes under a name of its
    attempt and renames, so that a repeated task replaces its own file.
    """
    import pyarrow as pa

    @lean
    def write(batches):
        from pyarrow.fs import FileType
        from pyspark import TaskContext

        context = TaskContext.get()
        pid, writer, encoder = context.partitionId(), None, Encoder.of(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        fs, folder = open_fs(out_dir)
        name, trial = f"{folder}/part-{pid:07d}.tpf", f"{folder}/_trial-{pid:07d}-{context.taskAttemptId()}"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    fs.create_dir(folder, recursive=True)
                    sink = fs.open_output_stream(trial)
                    writer = Writer(sink, percentile)
                writer.add(doc_id, encoder.ids(text.as_py()) + end)
        if writer is not None:
            writer.close()
            sink.close()
            if fs.get_file_info(name).type != FileType.NotFound:  # of an earlier attempt; some stores don't replace
                fs.delete_file(name)
            fs.move(trial, name)
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int64()), pa.array([name]), pa.array([writer.tokens], pa.int64())], ["pid", "path", "n"])

    plain = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    keys = plain.select("i", F.substring("t", 1, 64).alias("head"), F.xxhash64("t").alias("h"), F.spark_partition_id().alias("from"), "t")
    ordered = keys.repartitionByRange("i", "head", "h", "from").sortWithinPartitions("i", "head", "h")
    done = sorted(ordered.select("i", "t").mapInArrow(write, "pid long, path string, n long").collect())
    manifest, before = [], 0
    for _, path, n in done:
        manifest.append((path, before, n))
        before += n
    return manifest


def read_tokens(spark: SparkSession, manifest: list[tuple[str, int, int]], out_dir: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, a row a document."""
    import pyarrow as pa

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    @lean
    def read(batches):
        fs, _ = open_fs(out_dir)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(path) as source:
                    rows = []
                    for doc_id, start, n, ids in Reader(source, source.size()).documents():
                        rows.append((doc_id, base + start, n, zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                        if len(rows) == 8192:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    files = spark.createDataFrame(manifest, "path string, base long, n long")
    if manifest:
        files = files.repartitionByRange(len(manifest), "path")
    return files.select("path", "base").mapInArrow(read, schema)


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, out_dir: str | None = None, percentile: float = 0.98) -> DataFrame:
    """Write ``docs`` as token files and return what reading them gives."""
    spark = docs.sparkSession
    out_dir = out_dir or fresh_path(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, out_dir, tokenizer_path, end_id, percentile), out_dir)
