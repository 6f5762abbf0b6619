"""Language ID by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of widths 2, 3 and 4 slide over them; each filter's
maximum over a window of 256 bytes feeds a softmax over the learned languages. A
text is cut into such windows from its first byte to its last, and the windows'
probabilities are averaged by length. Training takes one window each of at most
``train_rows`` labelled rows, drawn by hash, the same number of each language as
far as it has so many: the only bound. They and the number of rows of each
language are the only things that reach the driver.

Semantics: null text and text without a letter are ``und`` with score 0; rows
with null ``lang`` teach nothing; a null ``doc_id`` counts as the empty string
in the split; rows that share a ``doc_id`` are drawn together and predicted each;
if no row teaches, all are ``und``; a text of any length is read to its end, a
megabyte of windows at a time; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

LENGTH, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: Bytes of text whose windows are classified at once.
PIECE = LENGTH << 12
_WIDEST = max(WIDTHS)


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass
class ByteConv:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (_WIDEST * EMBED, filters); zero beyond each filter's width
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """(n, LENGTH) bytes to the filters' values, (n, positions, filters)."""
        v = self.embed[x].reshape(len(x), -1)
        n = LENGTH - _WIDEST + 1
        cols = np.lib.stride_tricks.sliding_window_view(v, _WIDEST * EMBED, axis=1)[:, :: EMBED][:, :n]
        return (cols.reshape(-1, _WIDEST * EMBED) @ self.filters).reshape(len(x), n, -1)

    def probabilities(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        parts = []
        for a in range(0, len(x), step):
            top = self.features(x[a : a + step]).max(axis=1) + self.bias
            z = np.maximum(top, 0) @ self.out + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def train(texts: list[str], langs: list[str], epochs: int = 8, least_steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConv:
    """Adam on the cross-entropy; gradients pass each filter at its maximum only.

    Few rows are gone through more often, until ``least_steps`` batches.
    """
    epochs = max(epochs, -(-least_steps // max(1, -(-len(texts) // batch))))
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    x = np.frombuffer(b"".join(_bytes(t)[:LENGTH].ljust(LENGTH, b"\0") for t in texts), np.uint8).reshape(-1, LENGTH)
    n = len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat((np.arange(_WIDEST) < w).astype(np.float32), EMBED)[:, None] * np.ones((1, FILTERS), np.float32) for w in WIDTHS], axis=1)
    net = ByteConv(
        names,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, (_WIDEST * EMBED, n)) * mask).astype(np.float32),
        np.zeros(n, np.float32),
        rng.normal(0, 0.2, (n, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            pick = order[a : a + batch]
            xb, m = x[pick], len(pick)
            values = net.features(xb)
            where = values.argmax(axis=1)
            top = np.take_along_axis(values, where[:, None, :], 1)[:, 0] + net.bias
            h = np.maximum(top, 0)
            z = h @ net.out + net.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            p[np.arange(m), y[pick]] -= 1
            p /= m
            g_out, g_out_bias = h.T @ p, p.sum(axis=0)
            g_top = (p @ net.out.T) * (top > 0)
            seen = np.stack([xb[np.arange(m)[:, None], where + j] for j in range(_WIDEST)], axis=2)  # (m, n, widest)
            cols = net.embed[seen].reshape(m, n, -1)
            g_filters = np.einsum("mn,mnk->kn", g_top, cols) * mask
            back = (g_top[:, :, None] * net.filters.T[None]).reshape(m, n, _WIDEST, EMBED)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, seen.reshape(-1), back.reshape(-1, EMBED))
            t += 1
            for k, g in enumerate((g_embed, g_filters, g_top.sum(axis=0), g_out, g_out_bias)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Rows of each language, as even as their numbers allow, ``rows`` in all or all there are."""
    out, left = {}, rows
    for k, lang in enumerate(sorted(counts, key=lambda v: (counts[v], v))):
        out[lang] = min(counts[lang], left // (len(counts) - k))
        left -= out[lang]
    return out


def fit(docs: DataFrame, train_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConv | None:
    """Train on at most ``train_rows`` labelled rows outside the held-out quarter.

    About twice a language's quota is drawn by hash; the first ones by hash teach.
    """
    doc, text, lang = F.col(id_col).cast("string"), F.col(text_col), F.col(lang_col).cast("string")
    labelled = docs.filter(lang.isNotNull() & text.rlike(r"\p{L}") & ~held_out(F.col(id_col)))
    counts = {r.l: r.n for r in labelled.groupBy(lang.alias("l")).agg(F.count("*").alias("n")).collect()}
    wanted = {v: n for v, n in quotas(counts, train_rows).items() if n}
    if not wanted:
        return None
    draw = F.xxhash64(doc, F.lit("langid"))
    limits = F.create_map(*[F.lit(x) for v, n in wanted.items() for x in (v, min(1_000_000, 1000 + 2_000_000 * n // counts[v]))])
    start = 1 + F.pmod(F.xxhash64(F.lit("at"), doc), F.greatest(F.lit(1), F.length(text) - 2 * LENGTH // 3)).cast("int")
    some = labelled.filter(F.pmod(draw, F.lit(1_000_000)) < limits[lang])
    some = some.select(draw.alias("draw"), F.substring(text, start, F.lit(LENGTH)).alias("t"), lang.alias("l"))
    some = some.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("draw", "t")))
    quota = F.create_map(*[F.lit(x) for v, n in wanted.items() for x in (v, n)])
    rows = some.filter(F.col("k") <= quota[F.col("l")]).orderBy("draw", "t", "l").collect()
    return train([r.t for r in rows], [r.l for r in rows]) if rows else None


def classify(texts, model: ByteConv | None) -> tuple[list[str], list[float]]:
    """Language and score of each text, windows of several texts at a time."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    pending: list[tuple[int, int, int]] = []  # text, windows, bytes
    windows: list[bytes] = []
    sums: dict[int, np.ndarray] = {}
    size = 0

    def flush():
        p = model.probabilities(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, LENGTH))
        a = 0
        for k, n, length in pending:
            weight = np.full(n, float(LENGTH))
            weight[-1] = length - (n - 1) * LENGTH
            sums[k] = sums.get(k, 0) + weight @ p[a : a + n]
            a += n
        pending.clear()
        windows.clear()

    for k, text in enumerate(texts):
        text = text.as_py() if hasattr(text, "as_py") else text
        if model is None or not has_letter(text):
            continue
        raw = _bytes(text)
        for a in range(0, len(raw), PIECE):
            part = raw[a : a + PIECE]
            n = -(-len(part) // LENGTH)
            pending.append((k, n, len(part)))
            windows.append(part.ljust(n * LENGTH, b"\0"))
            size += len(part)
            if size >= PIECE:
                flush()
                size = 0
    if pending:
        flush()
    for k, total in sums.items():
        top = int(total.argmax())
        lang[k], score[k] = model.languages[top], float(min(1.0, total[top] / total.sum()))
    return lang, score


def identify(docs: DataFrame, model: ByteConv | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    import pyarrow as pa

    @lean
    def name(batches):
        for batch in batches:
            lang, score = classify(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(name, "doc_id long, lang_pred string, score double")


def language_ids(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    out = identify(docs, fit(docs, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.35, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, whose language is known with ``min_score``.

    The text is classified in the scan, nothing is shuffled.
    """
    import pyarrow as pa

    model = fit(docs, text_col=text_col, **options)
    at = docs.columns.index(text_col)

    @lean
    def keep(batches):
        for batch in batches:
            _, score = classify(batch.column(at), model)
            yield batch.filter(pa.array([x > 0 and x >= min_score for x in score], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
