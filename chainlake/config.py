"""Cutoffs of the pipeline, in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Cutoffs:
    """Effective defaults; override with with_()."""

    n_models: int = 4
    min_pae: float = 7.5
    iptm: float = 0.0
    pdockq: float = 0.0
    contacts: int = 5
    max_valency_contacts: int = 3
    distance: float = 8.0
    plddt: float = 0.0
    fallback_drop: float = 0.2
    multivalent_fraction: float = 0.2
    graph_resolution: float = 0.075
    domain_pae: float = 5.0
    disordered_plddt: float = 60.0
    clash_distance: float = 1.0
    clash_points: int = 10
    clash_share: float = 0.2
    repeat_size: int = 5
    cluster_improvement: float = 0.0
    cluster_extra: int = 3
    cluster_fewer: int = 2

    def with_(self, **changes) -> Cutoffs:
        return replace(self, **changes)


DEFAULT = Cutoffs()
