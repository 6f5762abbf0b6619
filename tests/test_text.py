import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions.stem import stem
from tidemark.functions.vocab import CHART, EFFECTIVENESS, ENTITY_TYPES, INVERSE_LABEL, RELATIONS, TYPES, WALK_RELATIONS, is_seed_owned, is_valid_pair


def test_names():
    same = [("  Aria  ", "aria"), ("ARIA", "aria"), ("Dr.   Vox", "dr vox"), ("Vex'd", "vexd"), ("Vex’d", "vexd"), ("Poly-Z", "poly z"), ("Kind: None", "kind none"), ("Flambéé", "flambee"), ("Nido♀", "nido♀"), ("   ", ""), ("---", "")]
    assert [X.normalise(a) for a, _ in same] == [b for _, b in same]
    assert X.normalise("Nido♀") != X.normalise("Nido♂")
    assert X.normalise(None) is None


def test_texts_go_through_python_in_slices():
    """A batch of long texts isn't held as objects at once, and a long text goes in pieces."""
    long = "Flambée d'ΑΣ Ï̈x_1  " * 20_000
    batch = pa.array([long, None, "", *["é" * 300_000] * 40, "Vex'd"])
    parts = list(X.slices(batch))
    assert pa.concat_arrays(parts).equals(batch) and all(len(p) == 1 or p.nbytes <= X.SLICE_BYTES for p in parts)
    seen = []

    class Name(str):
        def find(self, *args):
            return str.find(self, *args)

        def __getitem__(self, at):
            seen.append(at.stop - at.start)
            return str.__getitem__(self, at)

    bare = "".join(c for c in unicodedata.normalize("NFD", long.lower()) if not unicodedata.combining(c))
    assert X.normalise(Name(long)) == " ".join(bare.replace("'", "").replace("_", " ").split())
    assert max(seen) < X.PIECE + 20


def test_names_of_many_slices(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.concat(F.lit("É-"), "id", F.lit(" ")), 2000)).alias("t"))
    got = rows.select("t", X.normalise_name("t").alias("a"), X.normalise_name(F.upper("t")).alias("b")).collect()
    assert len(got) == 300 and all(r.a == r.b == X.normalise(r.t) for r in got)


def test_stems():
    pairs = dict(running="run", caresses="caress", ties="tie", cries="cri", hopping="hop", hoping="hope", relational="relat", generously="generous", communication="communic", national="nation", agreed="agre", happy="happi", news="news", skies="sky", rate="rate", controlling="control", abilities="abil")
    assert {w: stem(w) for w in pairs} == pairs


def test_words_are_stemmed_once_a_slice(monkeypatch):
    """Word lists stay in Arrow: Python sees the distinct words of a slice, not all."""
    seen = []
    monkeypatch.setattr(X, "stem", lambda w: seen.append(w) or stem(w))
    lists = pa.array([["x"], ["running", "the", "runs"], None, [], ["the"], ["runs", "dogs"] * 1000, None], pa.list_(pa.string()))
    got = X._stems(lists.slice(1))
    assert got.to_pylist() == [["run", "run"], None, [], [], ["run", "dog"] * 1000, None]
    assert sorted(seen) == ["dogs", "running", "runs"]
    assert X._stems(lists.slice(0, 0)).to_pylist() == []


def test_titles_and_ids(spark):
    rows = [("# One \ntext", "a/b.md", "One"), ("text\n# Two", "b.md", "Two"), ("## no", "x/some.name.md", "some.name"), (None, "n.md", "n"), ("#no", "plain", "plain")]
    df = spark.createDataFrame(rows, "t string, p string, e string")
    assert all(r.got == r.e for r in df.select("e", X.title(F.col("t"), F.col("p")).alias("got")).collect())
    a, b = df.select(X.stable_id(F.lit("a"), F.lit("bc")).alias("a"), X.stable_id(F.lit("ab"), F.lit("c")).alias("b")).first()
    assert a != b and len(a) == 32


def test_vector_text(spark):
    row = spark.range(1).select(X.parse_vector(X.vector_text(F.array(F.lit(1.5), F.lit(-2.0)))).alias("v")).first()
    assert row.v == [1.5, -2.0]


def test_vocabulary_is_closed():
    assert len(ENTITY_TYPES) == 7 and len(RELATIONS) == 11 and set(INVERSE_LABEL) == set(RELATIONS)
    assert set(WALK_RELATIONS) == set(RELATIONS) - set(EFFECTIVENESS)
    assert INVERSE_LABEL["evolves_into"] == "evolves_from"
    assert all(s in ENTITY_TYPES and t in ENTITY_TYPES for pairs, _ in RELATIONS.values() for s, t in pairs)


def test_rules():
    assert is_valid_pair("has_type", "pokemon", "type") and not is_valid_pair("has_type", "pokemon", "pokemon") and not is_valid_pair("likes", "move", "type")
    assert is_seed_owned("no_effect_on", "type", "type") and not is_seed_owned("no_effect_on", "move", "type") and not is_seed_owned("has_type", "type", "type")


def test_chart():
    cells = {(a, d): m for a, d, m in CHART}
    assert len(TYPES) == 18 and len(cells) == len(CHART) == 120
    zero = {("Normal", "Ghost"), ("Ghost", "Normal"), ("Fighting", "Ghost"), ("Electric", "Ground"), ("Ground", "Flying"), ("Poison", "Steel"), ("Psychic", "Dark"), ("Dragon", "Fairy")}
    assert {p for p, m in cells.items() if m == 0} == zero
    assert all(cells[p] == 2 for p in (("Ice", "Dragon"), ("Fairy", "Dragon"), ("Dragon", "Dragon"), ("Ghost", "Psychic"))) and ("Psychic", "Ghost") not in cells
