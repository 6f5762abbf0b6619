"""Closed vocabulary of the graph: entity types, relations, rules, type chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY_TYPES = ("ability", "group", "item", "move", "pokemon", "region", "type")

#: relation -> (allowed (source, target) types, label when read backwards)
_SPECIES, _HITS = ("pokemon", "pokemon"), (("move", "type"), ("type", "type"))
RELATIONS: dict[str, tuple[tuple[tuple[str, str], ...], str]] = {
    "evolves_into": ((_SPECIES,), "evolves_from"),
    "regional_variant_of": ((_SPECIES,), "has_regional_variant"),
    "mega_evolves_into": ((_SPECIES,), "mega_evolves_from"),
    "has_type": ((("pokemon", "type"),), "type_of"),
    "learns_move": ((("pokemon", "move"),), "learned_by"),
    "has_ability": ((("pokemon", "ability"),), "ability_of"),
    "found_in": ((("pokemon", "region"),), "home_of"),
    "member_of": ((("pokemon", "group"),), "has_member"),
    "super_effective_against": (_HITS, "weak_to"),
    "not_very_effective_against": (_HITS, "resists"),
    "no_effect_on": (_HITS, "immune_to"),
}
EFFECTIVENESS = {"super_effective_against": 2.0, "not_very_effective_against": 0.5, "no_effect_on": 0.0}
INVERSE_LABEL = {relation: label for relation, (_, label) in RELATIONS.items()}
WALK_RELATIONS = tuple(r for r in RELATIONS if r not in EFFECTIVENESS)


def endpoint_pairs(spark: SparkSession) -> DataFrame:
    """(relation, source_type, target_type) that may be."""
    rows = [(r, s, t) for r, (pairs, _) in RELATIONS.items() for s, t in pairs]
    return spark.createDataFrame(rows, "relation string, source_type string, target_type string")


def is_valid_pair(relation: str, source_type: str, target_type: str) -> bool:
    return (source_type, target_type) in RELATIONS.get(relation, ((), ""))[0]


def is_seed_owned(relation: str, source_type: str, target_type: str) -> bool:
    """Effectiveness between types belongs to the seeded chart alone."""
    return relation in EFFECTIVENESS and source_type == target_type == "type"


def seed_owned(relation: Column, source_type: Column, target_type: Column) -> Column:
    return relation.isin(*EFFECTIVENESS) & (source_type == "type") & (target_type == "type")


def inverse_label(relation: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in INVERSE_LABEL.items() for x in pair])[relation]


#: attacker: defenders hit double / half / not at all; all other pairs are neutral.
_CHART = """
Normal: / Rock Steel / Ghost
Fire: Grass Ice Bug Steel / Fire Water Rock Dragon /
Water: Fire Ground Rock / Water Grass Dragon /
Electric: Water Flying / Electric Grass Dragon / Ground
Grass: Water Ground Rock / Fire Grass Poison Flying Bug Dragon Steel /
Ice: Grass Ground Flying Dragon / Fire Water Ice Steel /
Fighting: Normal Ice Rock Dark Steel / Poison Flying Psychic Bug Fairy / Ghost
Poison: Grass Fairy / Poison Ground Rock Ghost / Steel
Ground: Fire Electric Poison Rock Steel / Grass Bug / Flying
Flying: Grass Fighting Bug / Electric Rock Steel /
Psychic: Fighting Poison / Psychic Steel / Dark
Bug: Grass Psychic Dark / Fire Fighting Poison Flying Ghost Steel Fairy /
Rock: Fire Ice Flying Bug / Fighting Ground Steel /
Ghost: Psychic Ghost / Dark / Normal
Dragon: Dragon / Steel / Fairy
Dark: Psychic Ghost / Fighting Dark Fairy /
Steel: Ice Rock Fairy / Fire Water Electric Steel /
Fairy: Fighting Dragon Dark / Fire Poison Steel /
"""
CHART: tuple[tuple[str, str, float], ...] = tuple(
    (attacker, defender, times)
    for line in _CHART.strip().splitlines()
    for attacker, rest in [line.split(":")]
    for times, names in zip((2.0, 0.5, 0.0), rest.split("/"))
    for defender in names.split()
)
TYPES = tuple(line.split(":")[0] for line in _CHART.strip().splitlines())


def type_chart(spark: SparkSession) -> DataFrame:
    """(attacker, defender, multiplier) of the pairs that aren't neutral."""
    return spark.createDataFrame(list(CHART), "attacker string, defender string, multiplier double")
