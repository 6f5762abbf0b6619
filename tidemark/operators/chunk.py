"""Structure-aware chunks of a document.

Blocks (fenced code, headings, paragraphs) are packed greedily up to a target,
a block over the maximum is cut at a sentence or space, and every chunk but the
first repeats the end of the one before it. A fold over a document's own blocks,
so it runs in an Arrow-batched function; documents are independent and nothing
is shuffled. Null and blank texts have no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import on_slices
from ..options import ChunkOptions

_HEADING = re.compile(r"#{1,6}\s")
CHUNKS = pa.list_(pa.struct([("ordinal", pa.int32()), ("text", pa.string())]))


def blocks(text: str) -> Iterator[str]:
    """Fenced code whole, a heading with the lines right under it, paragraphs."""
    held: list[str] = []
    fenced = False

    def take() -> Iterator[str]:
        block = "\n".join(held)
        held.clear()
        if block.strip():
            yield block

    for line in text.split("\n"):
        bare = line.strip()
        mark = bare.startswith("```")
        if mark and fenced:
            held.append(line)
            yield from take()
            fenced = False
        elif fenced:
            held.append(line)
        else:
            if mark or not bare or _HEADING.match(bare):
                yield from take()
            if bare:
                held.append(line)
            fenced = mark
    yield from take()


def cut_long(block: str, limit: int) -> Iterator[str]:
    """Pieces of at most ``limit + 1`` characters, ending after a stop or a space if it can be."""
    while len(block) > limit:
        at = block.rfind(". ", 0, limit + 2)
        if at < limit * 0.5:
            at = block.rfind(" ", 0, limit + 1)
        if at < limit * 0.3:
            at = limit
        yield block[: at + 1]
        block = block[at + 1 :].lstrip()
    if block:
        yield block


def pack(parts: Iterator[str], options: ChunkOptions) -> Iterator[str]:
    """Neighbouring blocks together up to the target; one blank line between them."""
    held = ""
    for block in parts:
        oversize = len(block) > options.max_size
        if held and (oversize or len(held) + len(block) + 1 > options.target_size):
            yield held
            held = ""
        if oversize:
            yield from cut_long(block, options.max_size)
        else:
            held = f"{held}\n\n{block}" if held else block
    if held:
        yield held


def chunk_text(text: str | None, options: ChunkOptions = ChunkOptions()) -> list[str]:
    """Chunks of one text, in order."""
    if text is None or not text.strip():
        return []
    out: list[str] = []
    before = None
    for raw in pack(blocks(text), options):
        shown = raw
        tail = int(len(before) * options.overlap_fraction) if before is not None else 0
        if tail > 0:
            start = len(before) - tail
            space = before.find(" ", start)
            joined = before[space if space >= 0 else start :].strip() + "\n\n" + raw
            shown = joined if len(joined) <= options.max_size else raw
        out.append(shown.strip())
        before = raw
    return out


def chunks_of(text: Column, options: ChunkOptions = ChunkOptions()) -> Column:
    """Array of (ordinal, text)."""

    def split(texts: pa.Array) -> pa.Array:
        return pa.array(([{"ordinal": i, "text": c} for i, c in enumerate(chunk_text(t, options))] for t in texts.to_pylist()), CHUNKS, size=len(texts))

    return on_slices("array<struct<ordinal:int,text:string>>", split)(text)


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """(id, ordinal, text) of every chunk."""
    return docs.select(id_col, F.explode(chunks_of(F.col(text_col), options)).alias("c")).select(id_col, "c.ordinal", "c.text")
