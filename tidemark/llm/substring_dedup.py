"""Substring dedup by fixed-block anchors.

The index holds every text's non-overlapping blocks of 7 words. A window of 13
words contains a whole block wherever it lies, so of a window that occurs twice,
7 words of each occurrence equal a block of the other's text. Three scans, with
a compressed exchange after the first and the second (see ``exchange``):

1. Probe: the hash of every rolling 7-word window is sent to the owner of its
   range, marked if it is a block. The owner answers which ones are hits: equal
   to a block, and met more than once.
2. Extend: each 13-word window that holds a hit is looked up whole; its owner
   finds the smallest ``doc_id`` that has it and answers each sender whether
   another sender has a smaller one.
3. Remove: runs of duplicate windows, maximal exact repeats, are cut out.

Block hashes only propose. Whole windows are told apart by 126 bits from two
independent hashes of their words, under keys that are drawn anew for each run,
so no text can be written to collide; among 10**13 windows a wrong match has a
chance of about 10**-12.

Semantics: null text has no words; a text under 13 words has no window; a window
repeated inside one document only is kept; a null ``doc_id`` comes after all
others and never before another null; rows that share a ``doc_id`` don't
displace each other; a text of any length is handled whole, in one task, with
some 40 bytes a word; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import lean
from .wordhash import first_of_each, text_words, windows, windows_at

NO_ID = np.iinfo(np.int64).max


@dataclass
class _Chunk:
    number: int
    keyed: list[np.ndarray]  # hashes of all words, by key
    owner: np.ndarray  # row of each word
    first: np.ndarray  # position of each row's first word
    ids: np.ndarray  # doc_id of each row, NO_ID for null
    null: np.ndarray
    columns: list  # the rows' texts

    @property
    def hashes(self) -> np.ndarray:
        return self.keyed[0]

    def texts(self) -> Iterator[bytes]:
        for column in self.columns:
            for value in column:
                text = value.as_py()
                yield text.encode("utf-8", "surrogatepass") if text else b""


def _chunks(batches, limit: int, keys: tuple[int, ...]) -> Iterator[_Chunk]:
    """The partition's texts, some ``limit`` words at a time, whole texts each."""
    number, have = 0, 0
    hashes: list = []
    counts: list = []
    ids: list = []
    null: list = []
    columns: list = []

    def made() -> _Chunk:
        n = np.concatenate(counts)
        return _Chunk(number, [np.concatenate(x) for x in zip(*hashes)], np.repeat(np.arange(len(n), dtype=np.int32), n), np.cumsum(n) - n, np.concatenate(ids), np.concatenate(null), list(columns))

    for batch in batches:
        all_ids = batch.column(0)
        missing = np.asarray(all_ids.is_null())
        plain = np.asarray(all_ids.fill_null(NO_ID)).astype(np.int64)
        for i, j, words in text_words(batch.column(1), keys=keys):
            hashes.append(words.keyed)
            counts.append(words.last - words.first)
            ids.append(plain[i:j])
            null.append(missing[i:j])
            columns.append(batch.column(1).slice(i, j - i))
            have += len(words.hashes)
            if have >= limit:
                yield made()
                number, have = number + 1, 0
                for x in (hashes, counts, ids, null, columns):
                    x.clear()
    if columns:
        yield made()


def _inside(chunk: _Chunk, n: int) -> np.ndarray:
    """Positions from which ``n`` words lie in one text."""
    m = len(chunk.hashes) - n + 1
    return np.flatnonzero(chunk.owner[:m] == chunk.owner[n - 1 :]) if m > 0 else np.zeros(0, np.int64)


def substring_dedup(docs: DataFrame, window: int = 13, chunk_words: int = 2_000_000, owners: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by a space)."""
    import pyarrow as pa

    spark, block = docs.sparkSession, (window + 1) // 2
    plain = X.pinned(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")))

    def probes(chunk: _Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the rolling windows of texts long enough, and their hashes."""
        at = _inside(chunk, block)
        n = np.diff(np.append(chunk.first, len(chunk.hashes)))
        at = at[n[chunk.owner[at]] >= window]
        return at, windows(chunk.hashes, block)[at] >> np.uint64(64 - bits)

    @lean
    def send_probes(batches):
        from pyspark import TaskContext

        sender = TaskContext.get().partitionId()
        for chunk in _chunks(batches, chunk_words, keys[:1]):
            at, h = probes(chunk, bits)
            is_block = (at - chunk.first[chunk.owner[at]]) % block == 0
            keyed = np.sort((h << np.uint64(1)) | is_block)
            h = keyed >> np.uint64(1)
            new = np.flatnonzero(first_of_each(h))
            times = np.diff(np.append(new, len(h)))
            blocks = (keyed[new + times - 1] & np.uint64(1)).astype(bool) if len(h) else np.zeros(0, bool)
            several = times > 1
            yield from X.messages(sender, chunk.number, h[new], bounds, lambda i, j: np.packbits(blocks[i:j]).tobytes() + np.packbits(several[i:j]).tobytes())

    def own_probes(bucket, received):
        lists, keyed = [], []
        for n, payload in received:
            size = int.from_bytes(payload[:4], "little")
            h = X.golomb_decode(payload[4 : 4 + size], n, int(bounds[bucket]))
            flags = np.frombuffer(payload, np.uint8, offset=4 + size)
            half = len(flags) // 2
            lists.append(h)
            keyed.append((h << np.uint64(2)) | (np.unpackbits(flags[:half], count=n).astype(np.uint64) << np.uint64(1)) | np.unpackbits(flags[half:], count=n))
        every = np.sort(np.concatenate(keyed))
        h = every >> np.uint64(2)
        new = np.flatnonzero(first_of_each(h))
        times = np.diff(np.append(new, len(h)))
        is_block = np.bitwise_or.reduceat((every >> np.uint64(1)) & np.uint64(1), new) > 0
        several = (times > 1) | (np.bitwise_or.reduceat(every & np.uint64(1), new) > 0)
        hits = h[new[is_block & several]]
        return [(X.checksum(v), X.among(v, hits)) for v in lists]

    def candidates(chunk: _Chunk, replies: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of the 13-word windows that hold a hit, and two hashes of each."""
        at, h = probes(chunk, bits)
        order = np.argsort(h)
        h = h[order]
        new = first_of_each(h)
        said = X.answered(replies.get(chunk.number, []), h[new], bounds)
        hit = np.zeros(len(chunk.hashes) + window, np.int8)
        if said.any():
            hit[at[order[said[np.cumsum(new) - 1]]]] = 1
        total = np.cumsum(np.append(np.zeros(1, np.int32), hit), dtype=np.int32)
        whole = _inside(chunk, window)
        whole = whole[total[whole + window - block + 1] > total[whole]]
        return whole, windows_at(chunk.hashes, whole, window) >> np.uint64(2), windows_at(chunk.keyed[1], whole, window)

    def grouped(h, check):
        """An order that brings equal windows together, and where a new one begins in it."""
        order = np.argsort(h)
        new, c = first_of_each(h[order]), check[order]
        if (~new[1:] & (c[1:] != c[:-1])).any():  # two windows of one 62-bit hash
            order = np.lexsort((check, h))
            new = first_of_each(h[order]) | first_of_each(check[order])
        return order, new

    def earliest(chunk: _Chunk, at, h, check):
        """Distinct windows by hash, their smallest id here, and the window of each position."""
        order, new = grouped(h, check)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        ids = np.minimum.reduceat(chunk.ids[chunk.owner[at[order]]], first) if len(first) else np.zeros(0, np.int64)
        return h[order[first]], check[order[first]], ids, which

    def parts(h, check):
        """Two windows of one 62-bit hash take a turn each, as the code needs distinct values."""
        turn = np.zeros(len(h), np.int64)
        while (same := np.flatnonzero((h[1:] == h[:-1]) & (turn[1:] == turn[:-1]))).size:
            turn[same + 1] += 1
        return [np.flatnonzero(turn == k) for k in range(int(turn.max(initial=0)) + 1)]

    @lean
    def send_windows(batches):
        from pyspark import TaskContext

        sender = TaskContext.get().partitionId()
        replies = X.read_replies(path1, sender)
        for chunk in _chunks(batches, chunk_words, keys):
            h, check, ids, _ = earliest(chunk, *candidates(chunk, replies))
            for turn, own in enumerate(parts(h, check)):
                if not len(own):
                    continue
                c, d = check[own], ids[own]
                known = d[d != NO_ID]
                low = int(known.min()) if len(known) else 0
                width = (int(known.max()) - low + 1).bit_length() if len(known) else 0
                delta = np.where(d == NO_ID, np.uint64(0), (d - low + 1).astype(np.uint64))

                def extra(i, j, c=c, delta=delta, low=low, width=width):
                    return low.to_bytes(8, "little", signed=True) + bytes([width]) + c[i:j].astype("<u8").tobytes() + X.pack_bits(delta[i:j], width)

                yield from X.messages(sender, chunk.number * 64 + turn, h[own], wide, extra)

    def own_windows(bucket, received):
        lists = []
        for n, payload in received:
            size = int.from_bytes(payload[:4], "little")
            h = X.golomb_decode(payload[4 : 4 + size], n, int(wide[bucket]))
            rest = payload[4 + size :]
            low, width = int.from_bytes(rest[:8], "little", signed=True), rest[8]
            delta = X.unpack_bits(rest[9 + 8 * n :], n, width).astype(np.int64)
            lists.append((h, np.frombuffer(rest, "<u8", n, 9), np.where(delta == 0, NO_ID, delta - 1 + low)))
        h, check, ids = (np.concatenate(x) for x in zip(*lists))
        order, new = grouped(h, check)
        least = np.empty(len(h), np.int64)
        least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        smaller, out, a = least < ids, [], 0
        for h, _, _ in lists:
            out.append((X.checksum(h), smaller[a : a + len(h)]))
            a += len(h)
        return out

    @lean
    def remove(batches):
        from pyspark import TaskContext

        sender = TaskContext.get().partitionId()
        hits, firsts = X.read_replies(path1, sender), X.read_replies(path2, sender)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
        for chunk in _chunks(batches, chunk_words, keys):
            at, h, check = candidates(chunk, hits)
            values, checks, least, which = earliest(chunk, at, h, check)
            elsewhere = np.zeros(len(values), bool)
            for turn, own in enumerate(parts(values, checks)):
                if len(own):
                    elsewhere[own] = X.answered(firsts.get(chunk.number * 64 + turn, []), values[own], wide)
            again = at[elsewhere[which] | (chunk.ids[chunk.owner[at]] > least[which])] if len(at) else at
            step = np.zeros(len(chunk.hashes) + window + 1, np.int32)
            step[again] += 1
            step[again + window] -= 1
            gone = np.cumsum(step)[: len(chunk.hashes)] > 0
            n = np.diff(np.append(chunk.first, len(chunk.hashes)))
            lost = np.bincount(chunk.owner[gone], minlength=len(n))
            rows = []
            for k, text in enumerate(chunk.texts()):
                words = text.split()
                if lost[k]:
                    a = int(chunk.first[k])
                    words = [w for w, x in zip(words, gone[a : a + len(words)].tolist()) if not x]
                kept = b" ".join(words)
                rows.append((None if chunk.null[k] else int(chunk.ids[k]), int(n[k]), int(lost[k]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    X.fix_splits(spark)
    senders = X.n_partitions(plain)
    bits = min(60, 34 + (senders * chunk_words // 2_000_000 * 4).bit_length())
    owners = owners or X.owners_for(plain, 1, senders)
    keys = (secrets.randbits(64), secrets.randbits(64))
    bounds, wide = X.bucket_bounds(bits, owners), X.bucket_bounds(62, owners)
    path1 = X.exchange(plain, send_probes, own_probes, owners, "probe-replies")
    path2 = X.exchange(plain, send_windows, own_windows, owners, "window-replies")
    return plain.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
