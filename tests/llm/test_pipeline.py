"""The pipeline on a small corpus, stage by stage, against plain forms."""

import collections
import zlib

import numpy as np
import pytest
from llm_cases import lower_ascii, words
from test_contracts import fill, plain_distance, plain_near

import corpus_pipeline as P
from tidemark.llm.decontam import normalise
from tidemark.llm.mixing import mix_report


@pytest.fixture(scope="module")
def corpus(spark, sf_dir, tmp_path_factory):
    """Short real documents, with nulls, blanks, repeated rows and leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 700").limit(70)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(8)
    item = bench.first().text
    rows = [tuple(r) for r in docs.collect()]
    rows += [(900, None, None, "src1", 0), (901, "12 34", "en", None, 5), (902, "words before " + item.upper() + " words after", "en", "src2", 0), (903, rows[0][1], "en", "src3", 0), (903, rows[0][1], "en", "src3", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{d}/documents.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        docs = P.cut(stage(spark, docs, corpus), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = before, [tuple(r) for r in docs.collect()]
    before, after = kept["language ID"]
    assert {r[0] for r in before} - {r[0] for r in after} == {900, 901}
    before, after = kept["MinHash near-dedup"]
    stay = {r[0] for r in plain_near([(r[0], r[1]) for r in before]) if r[3]}
    assert collections.Counter(r[0] for r in after) == collections.Counter(r[0] for r in before if r[0] in stay)
    before, after = kept["benchmark decontamination"]
    items = [normalise(r.text) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    leaks = {r[0] for r in before if any(plain_distance(i, normalise(r[1])) <= 0.1 * (len(i) - 2) for i in items)}
    assert 902 in leaks and {r[0] for r in before} - leaks == {r[0] for r in after}
    before, after = kept["mixing sources"]
    sizes, largest = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r[3]] += len(words(r[1]))
        largest[r[3]] = max(largest[r[3]], len(words(r[1])))
    taken = collections.Counter()
    for r in after:
        taken[r[3]] += len(words(r[1]))
    assert all(abs(taken[s] - t) <= largest[s] for s, t in fill(sizes).items())
    report = {r.doc_id: r.copies for r in mix_report(spark.createDataFrame(before, docs.schema)).collect()}
    assert collections.Counter(r[0] for r in after) == {d: c for d, c in report.items() if c}
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in P.STAGES[-1][1](spark, docs, corpus).collect())
    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for d, text, *_ in sorted(after):
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        assert got.pop(0) == (start, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got and lower_ascii("Aé") == "aé"


def test_near_stage_takes_eighty_percent(spark, corpus):
    """Pairs of similarity 0.8 and 0.82 go, one just below 0.8 stays."""
    w = [f"w{k}" for k in range(104)]
    docs = [(1, " ".join(w)), (2, " ".join(w[:93])), (3, " ".join("x" + x for x in w)), (4, " ".join("x" + x for x in w[:86])), (5, " ".join("y" + x for x in w)), (6, " ".join("y" + x for x in w[:83])), (7, " ".join("z" + x for x in w)), (8, " ".join("z" + x for x in w[:84]))]
    rows = [(d, t, "en", "src1", len(t)) for d, t in docs]
    out = P.near_dedup(spark, spark.createDataFrame(rows, spark.read.parquet(f"{corpus}/documents.parquet").schema), corpus)
    stay = {r[0] for r in plain_near(docs, 80) if r[3]}
    assert stay == {1, 3, 5, 6, 7} and {r.doc_id for r in out.collect()} == stay


def test_run(spark, corpus):
    out = P.run(spark, corpus)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 10
    assert 4 <= len(P.STAGES) <= 5 and P.ORACLE_SQL is None
