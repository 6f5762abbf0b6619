"""MinHash near-dedup with circulant permutations.

A document's set is its distinct 5-word shingles. One permutation scrambles the
set once; a second one, shifted circularly by 1, 2, ... strides, gives every
coordinate of the signature. Bands of the signature are the buckets; hashes only
propose, and every link is confirmed by the exact Jaccard similarity of the real
words.

Documents of equal word sequences (SHA-256) are one class from the start, so
copies are never paired. In a bucket the first class is the hub and is compared
with all others: if these join its component, the bucket is done. Else the hub
leaves and the next one follows, ``star_rounds`` times; pairs of different
components that still share a bucket are then compared directly. No pair that
shares a bucket stays untested unless its two ends are connected already, and
there is no cap. Before texts move, a pair must agree in as many coordinates of a
sketch (a byte each) as chance allows at the similarity, less seven deviations.

Semantics: A-Z are lower-cased; fewer words than five are one shingle; null text
or no word gives an empty set, linked with nothing; ``component_id`` is the
smallest ``doc_id`` reachable (nulls are passed over, and a null ``doc_id`` alone
has a null component); rows that share a ``doc_id`` are kept or dropped together;
a very long text is compared whole, with some hundred bytes a word; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from .common import cut, drop_path, fresh_path, lean, open_fs, spent
from .wordhash import distinct, first_of_each, text_words, windows
from .wordhash import mix as scramble

SHINGLE = 5
#: A hub with more pairs is split: copies of its text go with parts of the pairs.
HUB_PAIRS = 1000
#: Texts are compared some bytes at a time.
COMPARE_BYTES = 1 << 20
_STRIDE = 0x9E3779B97F4A7C15


def _sets(words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of each shingle, sorted and distinct in each row."""
    counts = words.last - words.first
    row = np.repeat(np.arange(len(counts)), counts)
    m = len(words.hashes) - n + 1
    at = np.flatnonzero(row[:m] == row[n - 1 :]) if m > 0 else np.zeros(0, np.int64)
    h, r = (windows(words.hashes, n)[at] if len(at) else np.zeros(0, np.uint64)), row[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.concatenate([windows(words.hashes[words.first[k] : words.last[k]], int(counts[k]), int(counts[k])) for k in short])
        h, r = np.concatenate([h, extra]), np.concatenate([r, short])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = first_of_each(h) | first_of_each(r)
    return r[new], h[new]


def signatures(h: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys (documents, bands) and sketch bytes (documents, coordinates).

    Document ``k`` has the shingles ``h[starts[k]:starts[k+1]]``.
    """
    first = scramble(h.copy())
    out = np.zeros((len(starts), bands), np.uint64)
    sketch = np.zeros((len(starts), bands * rows), np.uint8)
    for k in range(bands * rows):
        shifted = first + np.uint64((_STRIDE * (k + 1)) & (2**64 - 1))
        shifted ^= shifted >> np.uint64(31)
        shifted *= np.uint64(0xBF58476D1CE4E5B9)
        shifted ^= shifted >> np.uint64(28)
        shifted *= np.uint64(0x94D049BB133111EB)
        least = np.minimum.reduceat(shifted, starts)
        sketch[:, k] = scramble(least.copy()).astype(np.uint8)
        b = k // rows
        out[:, b] = scramble(out[:, b] * np.uint64(_STRIDE) + least + np.uint64(b + 1))
    return out, sketch


def least_agreement(coordinates: int, percent: int) -> int:
    """Sketch bytes in which a pair at the similarity agrees but with a chance below 10**-8."""
    p = percent / 100
    return max(0, math.floor(coordinates * p - 7 * math.sqrt(coordinates * p * (1 - p))))


def _plain_bytes(column) -> Iterator[bytes]:
    """Each text's words, A-Z lower-cased, joined by a space."""
    import pyarrow as pa

    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        body = value.as_py()
        yield b" ".join(body.lower().split()) if body else b""


def _class(body: bytes) -> bytes | None:
    return hashlib.sha256(body).digest()[:16] if body else None


def _scan(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Every document: id, set size, class, and for the first of a class in its partition more.

    ``keys`` are its buckets; ``sender`` and ``at`` say where the scan met it. A
    class of a single shingle is like no other class and has none of these.
    """
    import pyarrow as pa

    @lean
    def scan(batches):
        from pyspark import TaskContext

        sender, row, met = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            ids = batch.column(0)
            for i, j, words in text_words(batch.column(1), lower=True):
                r, h = _sets(words)
                n = np.bincount(r, minlength=j - i)
                classes = [_class(b) for b in _plain_bytes(batch.column(1).slice(i, j - i))]
                new = np.zeros(j - i, bool)
                for k in np.flatnonzero(words.last - words.first >= SHINGLE):
                    if classes[k] not in met:
                        met.add(classes[k])
                        new[k] = True
                mine = np.flatnonzero(new)
                flat, sketches = np.zeros((len(mine), bands), np.uint64), np.zeros((len(mine), bands * rows), np.uint8)
                if len(mine):
                    own = new[r]
                    keys, sketch = signatures(h[own], np.flatnonzero(first_of_each(r[own])), bands, rows)
                    flat, sketches = keys, sketch
                ends = np.zeros(j - i + 1, np.int32)
                ends[1:] = np.cumsum(new) * bands
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.reshape(-1).view(np.int64)))
                raw, size = sketches.tobytes(), bands * rows
                marks: list[bytes | None] = [None] * (j - i)
                for at, k in enumerate(mine):
                    marks[k] = raw[at * size : (at + 1) * size]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(classes, pa.binary()), lists, pa.array(marks, pa.binary()), pa.array([sender] * (j - i), pa.int32()), pa.array(np.arange(row + i, row + j, dtype=np.int64))],
                    ["i", "n", "class", "keys", "sketch", "sender", "at"],
                )
            row += batch.num_rows

    return docs.mapInArrow(scan, "i long, n long, class binary, keys array<long>, sketch binary, sender int, at long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, body) of the ``wanted`` rows (class, sender, at); only these texts leave the scan.

    Each scan partition reads what is wanted of it from the shared folder.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    path = fresh_path(spark, "near-wanted")
    wanted.repartition("sender").write.partitionBy("sender").parquet(path)

    @lean
    def take(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs
        from pyspark import TaskContext

        fs, folder = open_fs(f"{path}/sender={TaskContext.get().partitionId()}")
        want: dict[int, bytes] = {}
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                with fs.open_input_file(info.path) as f:
                    t = pq.ParquetFile(f).read(columns=["at", "class"])
                want.update(zip(t.column("at").to_pylist(), t.column("class").to_pylist()))
        order, k, row = sorted(want), 0, 0
        for batch in batches:
            mine = []
            while k < len(order) and order[k] < row + batch.num_rows:
                mine.append(order[k])
                k += 1
            for a in range(0, len(mine), 256):
                some = mine[a : a + 256]
                bodies = list(_plain_bytes(batch.column(0).take(pa.array([x - row for x in some]))))
                classes = [_class(b) for b in bodies]
                if any(c != want[x] for c, x in zip(classes, some)):
                    raise RuntimeError("the second scan gave this partition other rows than the first")
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(bodies, pa.binary())], ["class", "body"])
            row += batch.num_rows
        if k < len(order):
            raise RuntimeError("the second scan gave this partition other rows than the first")

    texts = cut(docs.select("t").mapInArrow(take, "class binary, body binary"), "near-texts")
    drop_path(spark, path)
    return texts


def shingle_ids(bodies: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of each shingle: equal numbers for equal words, nothing is hashed away.

    Words become numbers by a dictionary, and pairs of numbers are numbered anew,
    so a shingle's number stands for its very words. Texts have ``n`` words or more.
    """
    number: dict[bytes, int] = {}
    counts, ids = [], []
    for body in bodies:
        words = body.split(b" ")
        counts.append(len(words))
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words)))
    flat = np.concatenate(ids)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = a << np.uint64(32) | b
        order = np.argsort(both)
        out = np.empty(len(both), np.uint64)
        out[order] = np.cumsum(first_of_each(both[order])) - 1
        return out

    x, size = flat, 1
    while size < n:
        step = min(size, n - size)
        x, size = joined(x[: len(x) - step], x[step:]), size + step
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(row[: len(x)] == row[n - 1 :])
    return row[at], x[at]


def _compare(hub: bytes, bodies: list[bytes], percent: int) -> np.ndarray:
    """Which texts are at or above the similarity with ``hub``."""
    row, x = shingle_ids([hub, *bodies])
    x = distinct(x | row.astype(np.uint64) << np.uint64(32))
    row, x = (x >> np.uint64(32)).astype(np.int64), (x & np.uint64(2**32 - 1)).astype(np.int64)
    mine = np.zeros(int(x.max(initial=0)) + 1, bool)
    mine[x[row == 0]] = True
    size = np.bincount(row, minlength=len(bodies) + 1)
    same = np.bincount(row, weights=mine[x], minlength=len(bodies) + 1).astype(np.int64)
    return (100 * same >= percent * (size[0] + size - same))[1:]


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs whose sketches (x, y) agree in ``least`` bytes, without the sketches."""
    import pyarrow as pa

    @lean
    def test(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (4, 5))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "ra", "rb"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.select("a", "b", "ra", "rb", "x", "y").mapInArrow(test, "a binary, b binary, ra binary, rb binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, ra, rb) of classes, those at or above the similarity.

    A hub ``b`` may be in a third of all pairs, so its pairs are dealt out to
    parts of about ``HUB_PAIRS``; its text goes once to each part, those of its
    partners once a pair. A part is read in order, the hub first.
    """
    import pyarrow as pa

    @lean
    def test(batches):
        hub, key, waiting, bodies, size = b"", None, [], [], 0

        def flush():
            keep = _compare(hub, bodies, percent)
            out = [w for w, k in zip(waiting, keep) if k]
            waiting.clear()
            bodies.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], ["a", "b", "ra", "rb"])

        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            heads = zip(*(c.to_pylist() for c in columns))
            for (b, part, a, ra, rb), body in zip(heads, batch.column(5)):
                if a is None:
                    if waiting:
                        yield from flush()
                    hub, key, size = body.as_py(), (b, part), 0
                    continue
                if key != (b, part):
                    raise RuntimeError("a part without its hub")
                waiting.append((a, b, ra, rb))
                bodies.append(body.as_py())
                size += len(bodies[-1])
                if size > COMPARE_BYTES:
                    yield from flush()
                    size = 0
        if waiting:
            yield from flush()

    hot = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("parts")).filter("parts > 1"), "near-hot")
    keyed = pairs.join(hot, "b", "left").select("a", "b", "ra", "rb", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    partners = keyed.join(texts.withColumnRenamed("class", "a"), "a").select("b", "part", "a", "ra", "rb", "body")
    nothing = F.lit(None).cast("binary")
    hubs = keyed.select("b", "part").distinct().join(texts.withColumnRenamed("class", "b"), "b").select("b", "part", nothing.alias("a"), nothing.alias("ra"), nothing.alias("rb"), "body")
    both = partners.union(hubs).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())
    links = cut(both.mapInArrow(test, "a binary, b binary, ra binary, rb binary"), "near-links")
    spent(hot)
    return links


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of undirected ``edges`` (a, b); root is the least node.

    Alternating large and small stars: each round hangs neighbours on their least
    neighbour; the rounds grow with the logarithm of the longest path. Raises if
    ``most_rounds`` don't suffice.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        after = cut(small.filter("a <> b").distinct(), "cc")
        spent(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(edges.select("b", "b").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = 30, rows: int = 6, star_rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    With 30 bands of 6 a pair at 0.85 is missed once in a million; ``percent``
    below 85 asks for more bands: at 0.80, 40 of 5 miss one in ten million.
    """
    X.fix_splits(docs.sparkSession)
    plain = X.pinned(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")))
    scanned = cut(_scan(plain, bands, rows), "near-scan")
    rich = scanned.filter("sketch is not null").groupBy("class").agg(F.min(F.struct("sender", "at", "n", "sketch", "keys")).alias("x"))
    classes = cut(rich.select("class", "x.*"), "near-classes")
    buckets = classes.select("class", "n", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    members = cut(buckets.join(shared, "key").select("class", "n", "key"), "near-members")
    wanted = members.select("class").distinct()
    roots = cut(classes.join(wanted, "class", "left_semi").select("class", "sender", "at", "sketch", F.col("class").alias("root")), "near-roots")
    spent(classes)
    texts = _texts(plain, roots.select("class", "sender", "at"))
    alike = 100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")
    least = least_agreement(bands * rows, percent)
    left = cut(members.join(roots.select("class", "root", "sketch"), "class"), "near-left")
    spent(members)
    tested = None
    for turn in range(star_rounds + 1):
        if turn < star_rounds:
            hubs = left.groupBy("key").agg(F.min(F.struct("class", "n", "root", "sketch")).alias("hub"))
            pairs = left.join(hubs, "key").filter((F.col("root") != F.col("hub.root")) & alike)
        else:
            other = left.select("key", F.struct("class", "n", "root", "sketch").alias("hub"))
            pairs = left.join(other, "key").filter((F.col("class") > F.col("hub.class")) & (F.col("root") != F.col("hub.root")) & alike)
        pairs = pairs.select(F.col("class").alias("a"), F.col("hub.class").alias("b"), F.col("root").alias("ra"), F.col("hub.root").alias("rb"), F.col("sketch").alias("x"), F.col("hub.sketch").alias("y"))
        pairs = _agreeing(pairs, least).dropDuplicates(["a", "b"])
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))
        found = _confirmed(pairs, texts, percent)
        merged = components(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        before, roots = roots, cut(roots.join(merged, roots["root"] == merged["node"], "left").select("class", "sketch", F.coalesce(merged["root"], roots["root"]).alias("root")), "near-roots")
        spent(before, found)
        if turn == star_rounds:
            break
        rest = left.join(hubs.select("key", F.col("hub.class").alias("gone")), "key").filter("class <> gone").drop("gone", "root", "sketch")
        rest = rest.join(roots, "class")
        open_ = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
        before, left = left, cut(rest.join(open_, "key").select("class", "n", "key", "root", "sketch"), "near-left")
        spent(before)
        if not left.head(1):
            break
    spent(texts, left)
    return _assign(scanned, roots)


def _assign(scanned: DataFrame, roots: DataFrame) -> DataFrame:
    """Component of each row, by way of its class.

    Only classes in some bucket have a root; copies of the others find each other
    by their class. A hot class is one row on the right side, so the join can be split.
    """
    least = scanned.filter("n > 0").groupBy("class").agg(F.min("i").alias("least"))
    named = least.join(roots.select("class", "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(of_root, "root").select("class", "component_id")
    linked = scanned.filter("n > 0").select("i", "n", "class").join(of_class, "class").select("i", "n", "component_id")
    alone = scanned.filter("n = 0").select("i", "n", F.col("i").alias("component_id"))
    return linked.union(alone).select(F.col("i").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("i").eqNullSafe(F.col("component_id")).alias("kept"))
