"""Vectors as arrays of floats: products, norms, guards, an offline embedder."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Null where a norm is 0: such a vector has no direction."""
    return dot(a, b) / F.nullif((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b), F.lit(0.0))


def checked(vector: Column, dimension: int) -> Column:
    """``vector``, or an error where its size isn't ``dimension``."""
    message = F.format_string(f"vector of %d values, expected {dimension}", F.size(vector))
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(message).cast("array<float>"))


def hashing_embedder(dimension: int = 256):
    """A local stand-in for an embedding model: signed feature hashing of words.

    Deterministic and offline. It knows no meaning, only shared words.
    """
    return _hashing(dimension, lambda text: re.findall(r"\w+", text.lower()))


def spelling_embedder(dimension: int = 256):
    """The same of runs of three letters, for names: it knows spelling, not meaning."""
    return _hashing(dimension, lambda text: [f"  {text.lower()} "[k : k + 3] for k in range(len(text) + 1)] if text else [])


def _hashing(dimension: int, parts):

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        import zlib

        out = []
        for text in texts:
            v = np.zeros(dimension, np.float32)
            for w in parts(text or ""):
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if h >> 31 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed
