import pytest
from pyspark.sql import functions as F

from tidemark.operators import fusion
from tidemark.options import RetrievalOptions
from tidemark.plans import retrieve as R
from tidemark.plans.build_graph import build_graph
from tidemark.plans.ingest import ingest, summary
from tidemark.sources.files import markdown_files
from tidemark.sources.tables import Store
from tidemark.streaming.ingest import stream_folder

TEXTS = {"aria.md": "# Aria\n\nAria is a Spark singer who evolves into Bex with a stone.", "bex.md": "# Bex\n\nBex lives in Northland and is heavy.", "empty.md": "\n"}


def extractor(chunk_id, text):
    if "Aria" in text:
        return {"entities": [{"name": "Aria", "type": "pokemon", "aliases": ["Songbird"]}, {"name": "Bex", "type": "pokemon", "aliases": None}, {"name": "Fire", "type": "type", "aliases": None}], "relations": [{"source": "Aria", "relation": "evolves_into", "target": "bex", "method": "stone", "confidence": 0.9}, {"source": "Aria", "relation": "has_type", "target": "Fire", "method": None, "confidence": 0.9}]}
    return {"entities": [{"name": "BEX", "type": "pokemon", "aliases": None}, {"name": "Northland", "type": "region", "aliases": None}], "relations": [{"source": "Bex", "relation": "found_in", "target": "Northland", "method": None, "confidence": 0.8}]}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("md")
    for name, text in TEXTS.items():
        (folder / name).write_text(text)
    (folder / "other.txt").write_text("no")
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    first = ingest(store, markdown_files(spark, str(folder))).collect()
    build_graph(store, extractor, "v1")
    return store, folder, first


def test_ingest_round_trip(spark, built):
    store, folder, first = built
    assert {r.source_uri: (r.title, r.skipped, r.chunks_created) for r in first} == {"aria.md": ("Aria", False, 1), "bex.md": ("Bex", False, 1), "empty.md": ("empty", False, 0)}
    assert store.read("documents").count() == 3 and store.read("chunks").count() == 2
    again = ingest(store, markdown_files(spark, str(folder)))
    assert tuple(summary(again).first()) == (0, 3, 0)
    assert store.duplicate_keys("documents").count() == store.duplicate_keys("edges").count() == 0


def test_graph_build(spark, built):
    store, _, _ = built
    edges = store.read("edges")
    assert {(r.relation, r.origin): r.n for r in edges.filter("origin = 'llm'").groupBy("relation", "origin").agg(F.count("*").alias("n")).collect()} == {("evolves_into", "llm"): 1, ("has_type", "llm"): 1, ("found_in", "llm"): 1}
    assert edges.filter("origin = 'seed'").count() == 120
    assert store.read("entities").filter("type = 'pokemon'").count() == 2

    def never(chunk_id, text):
        raise AssertionError("asked again")

    build_graph(store, never, "v1")
    assert store.read("edges").count() == 123


def test_retrieve(built):
    store, _, _ = built
    got = R.retrieve(store, "What does Aria the singer evolve into?")
    assert "singer" in got.best.first().text
    lines = [r.line for r in got.context.orderBy("section", "n").collect()]
    assert any("--evolves_into(stone)--> bex" in x.lower() for x in lines) and any("Aria (Fire) takes" in x for x in lines)
    off = R.retrieve(store, "Aria", RetrievalOptions(graph_enabled=False))
    assert all("graph" not in r.arms for r in off.fused.collect())
    with pytest.raises(ValueError):
        R.validate("")
    with pytest.raises(ValueError):
        R.validate("x" * 2001)


def test_single_arms(built):
    store, _, _ = built
    top = R.semantic_search(store, "Aria singer stone", 1).first()
    assert top.document_title == "Aria" and top.ordinal == 0 and 0 < top.similarity <= 1
    assert [r.document_title for r in R.keyword_search(store, "heavy Bex").collect()] == ["Bex"]
    entities, chunks = R.graph_expand(store, [top.chunk_id])
    hops = {r.canonical_name.lower(): r.hops for r in entities.collect()}
    assert hops["aria"] == 0 and hops["northland"] == 1
    assert {r.is_seed for r in chunks.collect()} == {True, False}
    ids = [r.entity_id for r in entities.filter("lower(canonical_name) = 'aria'").collect()]
    assert {r.line.split("--")[1] for r in R.graph_facts(store, ids).collect()} == {"evolves_into(stone)", "has_type"}
    assert {r.step[0] for r in R.graph_trace(store, "Aria singer").collect()} == set("1234")
    assert R.graph_expand(store, [])[1].count() == 0


def test_change_and_removal(spark, built, tmp_path):
    store, _, _ = built
    before = {r.source_uri: r.id for r in store.read("documents").collect()}
    files = spark.createDataFrame([("aria.md", "# Aria\n\nNow a drummer.")], "source_uri string, text string")
    assert [(r.skipped, r.chunks_created) for r in ingest(store, files).collect()] == [(False, 1)]
    after = {r.source_uri: r.id for r in store.read("documents").collect()}
    assert before == after and store.read("chunks").count() == 2
    build_graph(store, lambda i, t: {"entities": [], "relations": []}, "v1")
    assert store.read("edges").filter("origin = 'llm'").count() == 1
    assert store.read("entities").filter("normalized_name = 'aria'").count() == 0


def test_one_commit_for_all_tables(spark, tmp_path):
    """Appends add folders; of two writers from one commit the second fails; readers never find nothing."""
    store = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("d1", "a.md", "A", "h")], "id string, source_uri string, title string, content_hash string")
    store.write("documents", one)
    store.commit(append={"documents": one.withColumn("id", F.lit("d2"))})
    assert {r.id for r in store.read("documents").collect()} == {"d1", "d2"}
    store.commit({"documents": store.read("documents").filter("id = 'd2'")}, {"chunks": spark.createDataFrame([("c", "d2")], "id string, document_id string")})
    assert [r.id for r in store.read("documents").collect()] == ["d2"] and store.read("chunks").count() == 1
    late, early = Store(spark, store.root), store._latest()
    store.compact("documents")
    late._latest = lambda: early
    with pytest.raises(Exception, match="exist"):
        late.write("documents", one)
    store.vacuum("documents")
    assert [r.id for r in store.read("documents").collect()] == ["d2"]


def test_a_uri_twice_in_a_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("a.md", "# A\n\none"), ("a.md", "# A\n\ntwo"), ("b.md", None)], "source_uri string, text string")
    for skipped in (False, True):
        got = {r.source_uri: r.skipped for r in ingest(store, files).collect()}
        assert got["a.md"] == skipped and set(got) == {"a.md", "b.md"}
    assert store.duplicate_keys("documents").count() == 0 and [r.text for r in store.read("chunks").collect()] == ["# A\n\ntwo"]


def test_new_spelling_resolves_by_cosine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest(store, spark.createDataFrame([("a.md", "one"), ("b.md", "two")], "source_uri string, text string"))
    said = {"one": "Charizardington Maximus", "two": "Charizardington Maximuss"}
    build_graph(store, lambda i, t: {"entities": [{"name": said[t], "type": "pokemon", "aliases": None}], "relations": []} if t == "one" else {"entities": [], "relations": []}, "v1")
    assert store.read("entities").filter("type = 'pokemon' and embedding is not null").count() == 1
    build_graph(store, lambda i, t: {"entities": [{"name": said[t], "type": "pokemon", "aliases": None}], "relations": []}, "v2")
    assert store.read("entities").filter("type = 'pokemon'").count() == 1
    assert store.read("chunk_entities").count() == 2


def test_walks_leave_the_chart_out(spark):
    from tidemark.operators import walk

    edges = spark.createDataFrame([("a", "b", "has_type", 1.0), ("b", "c", "super_effective_against", 1.0)], "source_entity_id string, target_entity_id string, relation string, confidence float")
    seeds = spark.createDataFrame([("a", 1)], "entity_id string, mentions int")
    assert {r.entity_id for r in walk.expand(seeds, edges).collect()} == {"a", "b"}


def test_fusion_and_context(spark):
    rows = [("semantic", "a", 1), ("semantic", "b", 2), ("keyword", "b", 1), ("graph", "c", 1)]
    lists = [spark.createDataFrame(rows, "arm string, chunk_id string, rank int")]
    got = [(r.chunk_id, round(r.score, 6), r.arms) for r in fusion.reciprocal_rank_fusion(lists).collect()]
    assert got == [("b", round(1 / 61 + 1 / 62, 6), "keyword,semantic"), ("a", round(1 / 61, 6), "semantic"), ("c", round(1 / 61, 6), "graph")]
    frame = lambda *x: spark.createDataFrame([(i, t) for i, t in enumerate(x)], "position int, line string")
    context = fusion.labelled_context(frame("f"), frame(), frame("p", "q"))
    assert [r.label for r in context.orderBy("section", "n").collect()] == ["f1", "c1", "c2"]
    answers = spark.createDataFrame([("yes", ["f1", "c9"])], "answer string, citations array<string>")
    assert fusion.check_citations(answers, context).first().unknown == ["c9"]
    assert fusion.decline(answers, context.limit(0)).first().answer == fusion.NO_ANSWER
    assert fusion.decline(answers, context).first().answer == "yes"


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# A\n\ntext")
    (folder / "bad.md").write_text("nul \x00 inside")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = stream_folder(store, str(folder), str(tmp_path / "cp"), str(tmp_path / "bad"))
        q.awaitTermination(120)
        assert store.read("documents").count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).select("source_uri", "reason").collect() == [("bad.md", "binary")]


def test_stream_takes_long_texts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "long.md").write_text("# Long\n\n" + "some words in a line\n\n" * 460_000)
    store = Store(spark, str(tmp_path / "store"))
    stream_folder(store, str(folder), str(tmp_path / "cp"), str(tmp_path / "bad")).awaitTermination(120)
    assert store.read("documents").count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 0
    assert store.read("chunks").agg({"ordinal": "max"}).first()[0] > 1000
