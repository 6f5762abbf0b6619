"""Schemas of the store. Ids are strings derived from content, so reruns agree."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: tuple[T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, (kind, null) in fields.items()])


_S, _I, _F, _TS, _V = T.StringType(), T.IntegerType(), T.FloatType(), T.TimestampType(), T.ArrayType(T.FloatType())
PROPERTIES = T.StructType([T.StructField("multiplier", T.DoubleType()), T.StructField("method", _S)])

TABLES: dict[str, T.StructType] = {
    "documents": _schema(id=(_S, False), source_uri=(_S, False), title=(_S, False), content_hash=(_S, False), created_at=(_TS, False)),
    "chunks": _schema(id=(_S, False), document_id=(_S, False), ordinal=(_I, False), text=(_S, False), embedding=(_V, False), norm=(T.DoubleType(), False), terms=(T.ArrayType(_S), False), metadata=(T.MapType(_S, _S), False)),
    "entities": _schema(id=(_S, False), canonical_name=(_S, False), normalized_name=(_S, False), type=(_S, False), summary=(_S, True), embedding=(_V, True), created_at=(_TS, False)),
    "entity_aliases": _schema(entity_id=(_S, False), alias=(_S, False), normalized_alias=(_S, False)),
    "edges": _schema(id=(_S, False), source_entity_id=(_S, False), target_entity_id=(_S, False), relation=(_S, False), properties=(PROPERTIES, True), confidence=(_F, False), origin=(_S, False)),
    "chunk_entities": _schema(chunk_id=(_S, False), entity_id=(_S, False), mentions=(_I, False)),
    "edge_chunks": _schema(edge_id=(_S, False), chunk_id=(_S, False)),
    "chunk_extractions": _schema(chunk_id=(_S, False), prompt_version=(_S, False), entity_count=(_I, False), relation_count=(_I, False), extracted_at=(_TS, False)),
}

#: Columns whose values are unique together.
KEYS: dict[str, tuple[str, ...]] = {
    "documents": ("source_uri",),
    "chunks": ("id",),
    "entities": ("normalized_name", "type"),
    "entity_aliases": ("normalized_alias", "entity_id"),
    "edges": ("source_entity_id", "relation", "target_entity_id"),
    "chunk_entities": ("chunk_id", "entity_id"),
    "edge_chunks": ("edge_id", "chunk_id"),
    "chunk_extractions": ("chunk_id",),
}

#: child -> (column, parent): rows go when their parent goes.
PARENTS: dict[str, tuple[tuple[str, str], ...]] = {
    "chunks": (("document_id", "documents"),),
    "entity_aliases": (("entity_id", "entities"),),
    "edges": (("source_entity_id", "entities"), ("target_entity_id", "entities")),
    "chunk_entities": (("chunk_id", "chunks"), ("entity_id", "entities")),
    "edge_chunks": (("edge_id", "edges"), ("chunk_id", "chunks")),
    "chunk_extractions": (("chunk_id", "chunks"),),
}
