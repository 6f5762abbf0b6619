"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by up to ``k = floor(error_rate * length)``
edits. Split into ``k + 1`` pieces, one of them occurs unchanged in any such
passage. All pieces are searched for at once (Aho-Corasick); around each hit,
Myers' bit-parallel distance decides, of growing parts of the item and at last
of the whole.

The items are a stated query set. They are matched in blocks of about
``block_items`` and ``block_chars``, one after the other, so what the driver and a
task hold has a bound whatever their number: a worker takes some 150 MB for a
block of two million characters. Each block is one scan of the documents whose
hits are written, and nothing is shuffled. An item is never cut, so one longer
than a block is a block of its own and takes memory with its length.

Semantics: both sides are lower-cased and every run of white space and ASCII
punctuation is one space; null or empty texts and items match nothing; an item of
under ``1 / error_rate`` characters has no room for an edit and is found as whole
words only, so an item of one word is in every text with that word; items that
share an ``item_id`` are matched each; a row comes for each (row, item id) that
matches, with the least distance; a very long text is searched whole, in time that
grows with its length; other columns are ignored; empty tables give an empty
result.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, on_leaving

_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_ready: dict[str, Index] = {}


def normalise(text: str | None) -> str:
    """Bytes of the normalised text, one character each, with a space at either end."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` consecutive pieces: (offset, piece)."""
    out: list[tuple[int, str]] = []
    todo = [(0, len(item), k)]
    while todo:
        a, b, e = todo.pop()
        if e:
            left = (e - 1) // 2
            middle = a + (b - a) * (left + 1) // (e + 1)
            todo += [(middle, b, e - 1 - left), (a, middle, left)]
        else:
            out.append((a, item[a:b]))
    return out


def spans(offset: int, size: int, k: int) -> list[tuple[int, int, int]]:
    """The spans above the piece at ``offset`` of an item, (start, end, edits), to try in turn.

    A span that may hold ``e`` edits is halved into spans that may hold ``l`` and
    ``r`` with ``l + r + 1 = e``: if both held more, the whole would. So along the
    spans from some unchanged piece to the item all budgets are kept, and a stray
    hit is found out on a short span.
    """
    out, a, b, e = [], 0, size, k
    while e:
        out.append((a, b, e))
        left = (e - 1) // 2
        middle = a + (b - a) * (left + 1) // (e + 1)
        a, b, e = (a, middle, left) if offset < middle else (middle, b, e - 1 - left)
    return out[::-1]


def item_masks(item: str) -> dict[str, int]:
    """Bit i of a character's mask: it is the item's i-th."""
    at: dict[str, int] = {}
    for i, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << i
    return at


def myers(item: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(least distance of ``item`` to a substring of ``text``, its end) if at most ``k``."""
    m = len(item)
    at = masks if masks is not None else item_masks(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    most = len(text) + k
    for j, c in enumerate(text):
        if best is None and score + j > most:
            break
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
        ph = ph << 1 & mask
        pv = (mh << 1 & mask) | ~(xv | ph) & mask
        mv = ph & xv
    return best


class Index:
    """The pieces of some items; what a span needs is made on its first hit.

    Masks of short spans are kept in a memo of bounded size, those of long ones
    for one hit.
    """

    def __init__(self, items: list[str], error_rate: float):
        import ahocorasick

        self.items = [(item, math.floor(error_rate * (len(item) - 2))) for item in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (item, k) in enumerate(self.items):
            for offset, piece in pieces(item, k):
                where.setdefault(piece, []).append((n, offset))
        self.machine = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.some = bool(where)
        if where:
            self.machine.make_automaton()
        self._short = functools.lru_cache(maxsize=4096)(self._masks)

    def _masks(self, n: int, a: int, b: int) -> tuple[str, dict[str, int]]:
        part = self.items[n][0][a:b]
        return part, item_masks(part)

    def find(self, text: str) -> dict[int, int]:
        """Distance of each item, by number, that occurs in normalised ``text``.

        The whole item is tried with twice the margin, which decides all hits that
        put its start within ``k`` of there: a passage is measured once.
        """
        found: dict[int, int] = {}
        tried: dict[int, list[int]] = {}
        for end, (size, uses) in self.machine.iter(text) if self.some else ():
            at = end + 1 - size
            for n, offset in uses:
                if found.get(n) == 0:
                    continue
                item, k = self.items[n]
                start, distance = at - offset, 0
                if n in tried and any(abs(start - x) <= k for x in tried[n][-8:]):
                    continue
                for a, b, e in spans(offset, len(item), k):
                    part, masks = (self._short if b - a <= 512 else self._masks)(n, a, b)
                    margin = e
                    if b - a == len(item):
                        margin = 2 * k
                        tried.setdefault(n, []).append(start)
                    hit = myers(part, text[max(0, start + a - margin) : start + b + margin], e, masks)
                    if hit is None:
                        break
                    distance = hit[0]
                else:
                    found[n] = min(distance, found.get(n, distance))
        return found


def _index(name: str, items: list[tuple[int | None, str]], error_rate: float) -> Index:
    """Built once in each Python worker, which keeps one block at a time."""
    if name not in _ready:
        _ready.clear()
        on_leaving(__name__, _ready.clear)
        _ready[name] = Index([item for _, item in items], error_rate)
    return _ready[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.1, block_items: int = 20_000, block_chars: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, allowed: a row for each document and item it holds."""
    import pyarrow as pa

    plain = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    queries = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).filter("t is not null")
    total = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("size")).first()
    blocks = max(1, math.ceil(total.n / block_items), math.ceil(total.size / block_chars))
    names, kinds = ["doc_id", "item_id", "distance", "allowed"], (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def hits(block: int) -> DataFrame:
        mine = queries.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        items = sorted({(r.i, item) for r in mine if (item := normalise(r.t))}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        name = f"{block}-{error_rate}-{hash(tuple(items))}"

        @lean
        def search(batches):
            index = _index(name, items, error_rate)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    best: dict = {}
                    for n, distance in index.find(normalise(text.as_py())).items():
                        item_id = items[n][0]
                        if item_id not in best or distance < best[item_id][0]:
                            best[item_id] = (distance, index.items[n][1])
                    rows += [(doc_id, item_id, *x) for item_id, x in best.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        return plain.mapInArrow(search, "doc_id long, item_id long, distance int, allowed int")

    if blocks == 1:
        return hits(0)
    # A hit of an item says (row, item id); rows that share an id aren't told apart between blocks.
    out = functools.reduce(DataFrame.union, [cut(hits(block), "leaks") for block in range(blocks)])
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "allowed")).alias("x")).select("doc_id", "item_id", "x.*")
