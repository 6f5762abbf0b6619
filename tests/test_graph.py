import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.vocab import type_chart
from tidemark.operators import graph as G
from tidemark.operators import walk as W
from tidemark.options import FactOptions, WalkOptions
from tidemark.plans import registry
from tidemark.schemas import PROPERTIES

P, T = "pokemon", "type"


def one(spark, entities, relations):
    return spark.createDataFrame([("c", [(n, t, a) for n, t, a in entities], relations)], G.EXTRACTION)


def kept(spark, entities, relations, **options):
    return [tuple(r) for r in G.clean_relations(one(spark, entities, relations), **options).select("source_name", "relation", "target_name", "method").collect()]


def test_clean_relations(spark):
    two = [("Aria", P, None), ("Spark", T, None)]
    assert kept(spark, two, [("aria", "has_type", "SPARK", None, 1.0)]) == [("Aria", "has_type", "Spark", None)]
    assert kept(spark, two, [("Aria", "has_type", "Water", None, 1.0)]) == []
    assert kept(spark, [("Aria", P, None), ("Bex", P, None)], [("Aria", "has_type", "Bex", None, 1.0)]) == []
    types = [("Ice", T, None), ("Dragon", T, None), ("Beam", "move", None)]
    assert kept(spark, types, [("Ice", "super_effective_against", "Dragon", None, 1.0), ("Ice", "no_effect_on", "Dragon", None, 1.0)]) == []
    assert G.clean_entities(one(spark, types, [])).count() == 3
    assert kept(spark, types, [("Beam", "super_effective_against", "Dragon", None, 1.0)]) == [("Beam", "super_effective_against", "Dragon", None)]
    assert kept(spark, two, [("Aria", "has_type", "Spark", None, 0.3)]) == []
    pair = [("Aria", P, None), ("Bex", P, None)]
    assert kept(spark, pair, [("Aria", "evolves_into", "ARIA", None, 1.0)]) == []
    assert kept(spark, pair, [("Aria", "evolves_into", "Bex", "stone", 0.9), ("aria", "evolves_into", "bex", "trade", 0.8)]) == [("Aria", "evolves_into", "Bex", "stone")]


def test_clean_aliases(spark):
    rows = G.clean_entities(one(spark, [("Aria", P, ["ARIA", "Songbird", None]), ("---", P, None), ("Bex", "planet", None)], [])).collect()
    assert [(r.name, r.aliases) for r in rows] == [("Aria", ["Songbird"])]


def test_extractor_is_asked_twice(spark, tmp_path):
    log = str(tmp_path / "calls")

    def extractor(chunk_id, text):
        with open(log, "a") as f:
            f.write(chunk_id + "\n")
        if text == "bad" or text == "once" and open(log).read().count(chunk_id) < 2:
            raise ValueError
        return {"entities": [{"name": "Aria", "type": P, "aliases": None}], "relations": []}

    chunks = spark.createDataFrame([("a", "ok"), ("b", "bad"), ("c", "once")], "chunk_id string, text string").coalesce(1)
    out = {r.chunk_id: r.entities for r in G.extract(chunks, extractor).collect()}
    assert out["b"] is None and out["a"] and out["c"]
    assert sorted(open(log).read().split()) == ["a", "b", "b", "c", "c"]


EDGE = "id string, source_entity_id string, target_entity_id string, relation string, method string, confidence float, origin string"


def edges(spark, rows):
    full = [(f"{s}{t}", s, t, r, m, 1.0, o) for s, t, r, m, o in rows]
    return spark.createDataFrame(full, EDGE).withColumn("properties", F.struct(F.lit(None).cast("double").alias("multiplier"), "method").cast(PROPERTIES)).drop("method")


CHAIN = [("A", "B", "evolves_into", "level 16", "llm"), ("B", "C", "evolves_into", None, "llm"), ("C", "D", "evolves_into", None, "llm")]


@pytest.fixture(scope="module")
def chain(spark):
    mentions = spark.createDataFrame([(f"chunk-{x}-0000", x, 1) for x in "ABCD"], "chunk_id string, entity_id string, mentions int")
    return edges(spark, CHAIN), mentions


def reach(spark, e, seeds, **options):
    s = spark.createDataFrame([(x, 1) for x in seeds], "entity_id string, mentions int")
    return {r.entity_id: r.hops for r in W.expand(s, e, WalkOptions(**options)).collect()}


def test_walk(spark, chain):
    e, _ = chain
    assert reach(spark, e, "A", max_hops=0) == {"A": 0}
    assert reach(spark, e, "A", max_hops=1) == {"A": 0, "B": 1}
    assert reach(spark, e, "A", max_hops=2) == {"A": 0, "B": 1, "C": 2}
    assert reach(spark, e, "D", max_hops=2) == {"D": 0, "C": 1, "B": 2}
    ring = edges(spark, [*CHAIN, ("D", "A", "evolves_into", None, "llm")])
    assert reach(spark, ring, "A", max_hops=3) == {"A": 0, "B": 1, "D": 1, "C": 2}
    assert len(reach(spark, e, "A", max_hops=3, max_nodes=2)) == 2
    assert reach(spark, e, "A", max_hops=2, relations=("has_type",)) == {"A": 0}
    assert reach(spark, e, "", max_hops=2) == {}


def test_hub_budget(spark):
    star = edges(spark, [("H", f"n{i:02d}", "has_type", None, "llm") for i in range(30)] + [("K", "n07", "has_type", None, "llm")])
    got = reach(spark, star, "HK", max_hops=1, max_nodes_per_hop=5)
    assert len(got) == 7 and got["n07"] == 1


def test_walk_agrees_with_plain_search(spark):
    rng = random.Random(3)
    pairs = {(f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(60)}
    got = reach(spark, edges(spark, [(a, b, "member_of", None, "llm") for a, b in pairs]), ["v1", "v2"], max_hops=3, max_nodes=0)
    want, border = {"v1": 0, "v2": 0}, {"v1", "v2"}
    for hop in (1, 2, 3):
        border = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in border} - set(want)
        want |= dict.fromkeys(border, hop)
    assert got == want


def test_graph_arm(spark, chain):
    e, m = chain
    seeds = spark.createDataFrame([("chunk-A-0000",)], "chunk_id string")
    rows = [(r.chunk_id, r.hops, r.rank) for r in W.graph_search(seeds, m, e, WalkOptions(max_hops=2)).orderBy("rank").collect()]
    assert rows == [("chunk-B-0000", 1, 1), ("chunk-C-0000", 2, 2)]
    with_seeds = W.graph_search(seeds, m, e, WalkOptions(max_hops=2), include_seeds=True).orderBy("rank").collect()
    assert [(r.chunk_id, r.is_seed) for r in with_seeds][0] == ("chunk-A-0000", True)


def test_facts(spark, chain):
    e, _ = chain
    names = spark.createDataFrame([(x, f"Name {x}") for x in "ABCD"], "id string, canonical_name string")
    cited = spark.createDataFrame([("AB", "12345678-90"), ("BC", "abcdefgh-1")], "edge_id string, chunk_id string")
    ab = spark.createDataFrame([("A", 2), ("B", 1)], "entity_id string, weight int")
    both = W.facts(ab, e, names, cited, FactOptions(require_both_endpoints=True))
    assert [r.line for r in both.collect()] == ["Name A --evolves_into(level 16)--> Name B [chunk:12345678]"]
    assert W.facts(ab, e, names, cited).count() == 2
    assert W.fact_block(both).first().block.startswith("Name A") and W.fact_block(both.limit(0)).first().block == ""


def test_fact_lines(spark):
    rows = [("has_type", None, None, [], "X --has_type--> Y"), ("super_effective_against", 2.0, None, None, "X --super_effective_against(2x)--> Y"), ("no_effect_on", 0.0, None, [], "X --no_effect_on(0x)--> Y"), ("evolves_into", None, "Stone", ["aaaaaaaa-1", "bbbbbbbb-2"], "X --evolves_into(Stone)--> Y [chunk:aaaaaaaa chunk:bbbbbbbb]"), ("not_very_effective_against", 0.5, "m", [], "X --not_very_effective_against(0.5x)--> Y")]
    df = spark.createDataFrame(rows, "r string, m double, h string, c array<string>, want string")
    got = df.select("want", W.fact_line(F.lit("X"), F.col("r"), F.lit("Y"), F.col("m"), F.col("h"), F.col("c")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_matchups(spark):
    typed = spark.createDataFrame([("z", "Water"), ("z", "Ground")], "entity_id string, type string")
    names = spark.createDataFrame([("z", "Newt")], "id string, canonical_name string")
    line = W.matchup_lines(typed, type_chart(spark), names).first().line
    assert line == "Newt (Ground/Water) takes 4x from Grass; 0.5x from Fire, Poison, Rock, Steel; 0x from Electric"


def test_orphans_and_cascade(spark, chain):
    e, m = chain
    e = e.unionByName(edges(spark, [("E", "F", "has_type", None, "seed"), ("G", "I", "has_type", None, "llm")]))
    names = spark.createDataFrame([(x,) for x in "ABCDEFGIJ"], "id string")
    cited = spark.createDataFrame([("AB", "c")], "edge_id string, chunk_id string")
    nodes, left = G.collect_orphans(names, e, m, cited)
    assert {r.id for r in left.collect()} == {"AB", "EF"} and {r.id for r in nodes.collect()} == set("ABCDEF")
    tables = {"documents": spark.createDataFrame([("d",)], "id string"), "chunks": spark.createDataFrame([("chunk-A-0000", "d"), ("chunk-B-0000", "gone")], "id string, document_id string"), "chunk_entities": m}
    after = G.cascade(tables)
    assert [r.entity_id for r in after["chunk_entities"].collect()] == ["A"]


def test_upsert_and_checks(spark):
    old = edges(spark, [("A", "B", "has_type", None, "seed")])
    new = edges(spark, [("A", "B", "has_type", None, "llm"), ("A", "C", "has_type", None, "llm"), ("A", "D", "has_type", None, "llm")])
    got = G.upsert_edges(old, new)
    assert sorted((r.id, r.origin) for r in got.collect()) == [("AB", "seed"), ("AC", "llm"), ("AD", "llm")]
    assert [tuple(r) for r in G.overtyped(got).collect()] == [("A", 3)]
    assert G.uncited_edges(got, spark.createDataFrame([("AC", "c")], "edge_id string, chunk_id string")).first().id == "AD"


def test_orphans_read_each_end_of_an_edge_in_one_pass(spark, sf_dir):
    plan = registry.orphan_collection(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_") <= 30  # 49 with a pass for either end


def test_walk_filters_the_scan_by_few_ids(spark, sf_dir, monkeypatch):
    """A hop joins below the aggregation of edges; ids that are many are shuffled, with the same rows."""
    links = W.both_ways(registry.star.edges(spark, sf_dir))
    plan = W._among(links, spark.createDataFrame([("s:1",)], "from_id string"), "from_id")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    under = [k for k, x in enumerate(lines) if "Aggregate" in x]
    assert plan.count("Join LeftSemi") > 1 and under and all(any("Join LeftSemi" in x for x in lines[k + 1 : k + 4]) for k in under)
    queries = (registry.graph_arm, registry.graph_reached_chunks)
    few = [sorted(map(tuple, q(spark, sf_dir).collect())) for q in queries]
    monkeypatch.setattr(W, "SENT_BYTES", -1)
    assert few == [sorted(map(tuple, q(spark, sf_dir).collect())) for q in queries]


def test_upsert_keeps_the_first_and_sorts_once(spark):
    one = lambda i, c, o: edges(spark, [("A", "B", "has_type", None, o)]).withColumn("id", F.lit(i)).withColumn("confidence", F.lit(c).cast("float"))
    for old, new, first in ((("o", 0.5, "llm"), ("n", 0.5, "llm"), "o"), (("o", 0.5, "llm"), ("n", 0.6, "llm"), "n"), (("o", 0.5, "seed"), ("n", 0.6, "llm"), "o"), (("o", None, "llm"), ("n", 0.1, None), "o")):
        got = G.upsert_edges(one(*old), one(*new))
        assert [r.id for r in got.collect()] == [first], (old, new)
    two = one("b", 0.5, "llm").union(one("a", 0.5, "llm"))
    assert [r.id for r in G.upsert_edges(two, one("n", 0.5, "llm")).collect()] == ["a"]
    assert "GroupLimit" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_resolution(spark):
    entities = spark.createDataFrame([("1", "aria", P, [1.0, 0.0]), ("2", "aria", "move", None), ("3", "bex", P, [0.0, 1.0])], "id string, normalized_name string, type string, embedding array<float>")
    aliases = spark.createDataFrame([("1", "songbird"), ("3", "songbird")], "entity_id string, normalized_alias string")
    said = spark.createDataFrame([("aria", P, [0.0, 1.0]), ("songbird", P, None), ("bexx", P, [0.1, 1.0]), ("new", P, [0.7, 0.7])], "normalized_name string, type string, embedding array<float>")
    got = {r.normalized_name: (r.entity_id if r.how != "new" else None, r.how) for r in G.resolve(said, entities, aliases).collect()}
    assert got == {"aria": ("1", "exact"), "songbird": ("1", "alias"), "bexx": ("3", "embedding"), "new": (None, "new")}


def test_graph_facts_takes_all_entities(spark, monkeypatch):
    """30 entities of one edge each give 30 facts."""
    made = {
        "mentions": spark.createDataFrame([("o:1", f"c:{k}", 1 + k) for k in range(30)], "chunk_id string, entity_id string, mentions int"),
        "edges": spark.createDataFrame([(f"c:{k}|found_in|n:1", f"c:{k}", "n:1", "found_in", None, 1.0, "llm") for k in range(30)], f"id string, source_entity_id string, target_entity_id string, relation string, properties {PROPERTIES.simpleString()}, confidence float, origin string"),
        "names": spark.createDataFrame([(f"c:{k}", f"C{k}") for k in range(30)] + [("n:1", "N")], "id string, canonical_name string"),
        "provenance": spark.createDataFrame([], "edge_id string, chunk_id string"),
    }
    for name, table in made.items():
        monkeypatch.setattr(registry.star, name, lambda spark, sf_dir, table=table: table)
    got = registry.graph_facts(spark, "").collect()
    assert [r.edge_id for r in sorted(got)] == [f"c:{k}|found_in|n:1" for k in range(29, -1, -1)]
