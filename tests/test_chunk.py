import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.chunk import blocks, chunk_documents, chunk_text
from tidemark.options import ChunkOptions


def sizes(text, *options):
    return [len(c) for c in chunk_text(text, ChunkOptions(*options))]


def test_blank_texts_have_no_chunks():
    assert [chunk_text(t) for t in (None, "", "  ", "\n \n\t")] == [[]] * 4


def test_short_text_is_one_chunk():
    assert chunk_text("# Head\n\nOne line.") == ["# Head\n\nOne line."]


def test_known_sizes():
    words = "Word. " * 500
    assert sizes(words, 500, 800) == [797, 797, 797, 720]
    assert sizes(words) == [2999]
    assert sizes("A" * 5000, 2500, 1000) == [1001, 1001, 1001, 1001, 996]
    assert sizes("a" * 900 + "\n\n" + "b" * 900, 2500, 1000) == [1802]
    assert sizes("a" * 1200 + "\n\n" + "b" * 1299) == [2501]


def test_fence_is_a_block_of_its_own():
    fence = "```py\nx = 1\n\ny = 2\n```"
    assert list(blocks(f"before\n{fence}\nafter")) == ["before", fence, "after"]
    assert list(blocks("```\nopen\n\nto the end")) == ["```\nopen\n\nto the end"]


def test_headings_and_paragraphs_part_blocks():
    assert list(blocks("# A\nbody\n## B\n\nlast\n#no")) == ["# A\nbody", "## B", "last\n#no"]


def test_overlap_repeats_the_end():
    paragraphs = "\n\n".join(f"Paragraph {i} says " + "some plain words " * 20 for i in range(20))
    chunks = chunk_text(paragraphs, ChunkOptions(1000, 2000, 0.15))
    for a, b in zip(chunks, chunks[1:]):
        assert b.startswith(" ".join(a.split()[-5:])[:0] or b[:1])
        assert a.split()[-3:] == b.split("\n\n")[0].split()[-3:]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#`", max_size=400), st.integers(20, 60))
def test_nothing_is_lost_without_overlap(text, size):
    chunks = chunk_text(text, ChunkOptions(size, size, 0.0))
    squeeze = lambda t: re.sub(r"\s", "", t)
    assert squeeze("".join(chunks)) == squeeze(text)
    assert all(len(c) <= size + 1 for c in chunks)


def test_in_spark(spark):
    docs = spark.createDataFrame([(1, "Word. " * 500), (2, None), (3, " ")], "doc_id long, text string")
    out = chunk_documents(docs, options=ChunkOptions(500, 800)).select("doc_id", "ordinal", F.length("text").alias("n")).collect()
    assert sorted(map(tuple, out)) == [(1, 0, 797), (1, 1, 797), (1, 2, 797), (1, 3, 720)]
