"""Text functions: hashes, titles, names, analysis, previews."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stem import stem

STOP_WORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split()
)


def content_hash(text: Column) -> Column:
    """SHA-256 of the text, lower-case hex."""
    return F.sha2(text, 256)


def stable_id(*parts: Column) -> Column:
    """An id that follows from its parts alone."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 32)


def title(text: Column, path: Column) -> Column:
    """First level-1 heading anywhere in the text, else the file's stem."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    stem_ = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(heading != "", heading).otherwise(stem_)


#: Bytes of texts that a Python worker turns into objects at a time, and characters of one text.
SLICE_BYTES, PIECE = 1 << 20, 1 << 16


def slices(rows: pa.Array) -> Iterator[pa.Array]:
    """``rows`` in order, in parts of at most ``SLICE_BYTES`` or one row."""
    if len(rows) < 2 or rows.nbytes <= SLICE_BYTES:
        yield rows
    else:
        half = len(rows) // 2
        yield from slices(rows[:half])
        yield from slices(rows[half:])


def on_slices(kind: T.DataType, change: Callable[[pa.Array], pa.Array]):
    """A column function from ``change`` on Arrow arrays, whose memory doesn't grow with the batch."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield change(part)

    return run


def normalise(name: str | None) -> str | None:
    """Lower case, no accents or apostrophes; other marks but gender signs part words.

    A long text goes in pieces that end at a space, which no rule reaches across.
    """
    if name is None:
        return None
    out, at = [], 0
    while at < len(name):
        end = name.find(" ", at + PIECE) + 1 or len(name)
        out.append(_bare(name[at:end]))
        at = end
    return " ".join(filter(None, out))


def _bare(name: str) -> str:
    bare = name.lower()
    if not bare.isascii():
        bare = "".join(c for c in unicodedata.normalize("NFD", bare) if not unicodedata.combining(c))
    bare = re.sub("['’‘ʼ`]", "", bare)
    return " ".join(re.sub(r"[^\w♀♂]|_", " ", bare).split())


normalise_name = on_slices(T.StringType(), lambda names: pa.array(map(normalise, names.to_pylist()), pa.string(), size=len(names)))


def entity_key(type_: Column, normalised: Column) -> Column:
    return F.concat_ws(":", type_, normalised)


def simple_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _stems(words: pa.Array) -> pa.Array:
    """Each list's stems; a word is stemmed once a slice."""
    said = words.flatten().dictionary_encode()
    stems = pa.array([None if w in STOP_WORDS else stem(w) for w in said.dictionary.to_pylist()], pa.string()).take(said.indices)
    ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy())
    kept = np.concatenate([[0], np.cumsum(stems.is_valid().to_numpy(zero_copy_only=False))])
    offsets = kept[np.concatenate([[0], ends])].astype(np.int32)
    return pa.ListArray.from_arrays(offsets, stems.drop_null(), mask=words.is_null())


_stem_lists = on_slices(T.ArrayType(T.StringType()), _stems)


def english_terms(text: Column) -> Column:
    """Stems without stop words, in order."""
    return _stem_lists(simple_terms(text))


ANALYZERS = {"simple": simple_terms, "english": english_terms}


def preview(text: Column, length: int = 200) -> Column:
    """Start of a text on one line."""
    return F.translate(F.substring(text, 1, length), "\n", " ")


def percent(similarity: Column) -> Column:
    return F.format_string("%.1f%%", similarity * 100)


def vector_text(vector: Column) -> Column:
    """``[1.0,2.5]``; :func:`parse_vector` is its inverse."""
    return F.to_json(vector)


def parse_vector(text: Column) -> Column:
    return F.from_json(text, T.ArrayType(T.FloatType()))


def scrub(text: Column) -> Column:
    """Addresses of mail, numbers of phones and cards replaced by their kind."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"\b[0-9]{13,19}\b", "[card]")
    return F.regexp_replace(out, r"\+[0-9][0-9 ().-]{7,}[0-9]", "[phone]")
