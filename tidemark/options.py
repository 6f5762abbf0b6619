"""Options of every operator whose constants are a choice."""

from __future__ import annotations

from dataclasses import dataclass

from .functions.vocab import WALK_RELATIONS


@dataclass(frozen=True)
class ChunkOptions:
    """Sizes in characters; a lower ``max_size`` alone doesn't lower the merge target."""

    target_size: int = 2500
    max_size: int = 3200
    overlap_fraction: float = 0.15


@dataclass(frozen=True)
class WalkOptions:
    """Graph walk: hop limit, node cap, budget at each hop, relations (None: all; by default not those of the type chart)."""

    max_hops: int = 2
    max_nodes: int = 50
    max_nodes_per_hop: int | None = None
    relations: tuple[str, ...] | None = WALK_RELATIONS


@dataclass(frozen=True)
class FactOptions:
    require_both_endpoints: bool = False
    max_facts: int = 40
    max_facts_per_entity: int = 8


@dataclass(frozen=True)
class RetrievalOptions:
    """60 is the constant of Cormack et al., SIGIR 2009; weights and cuts are ours."""

    semantic_k: int = 50
    keyword_k: int = 50
    seed_k: int = 10
    fused_k: int = 50
    final_k: int = 5
    rrf_constant: float = 60.0
    weights: tuple[tuple[str, float], ...] = (("semantic", 1.0), ("keyword", 1.0), ("graph", 1.0))
    graph_enabled: bool = True


#: Extracted relations under this confidence are dropped.
CONFIDENCE_FLOOR = 0.5
#: Cosine at which a new name is taken for a known entity.
MATCH_THRESHOLD = 0.9
MAX_QUERY_CHARS = 2000
