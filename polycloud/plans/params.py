"""Build-time and search-time settings."""

from __future__ import annotations

from dataclasses import dataclass, replace

FAMILIES = ("flat", "cluster_tree", "lists", "spill_tree", "fde_scan", "fde_graph", "cloud_graph", "pooled_scan", "pooled_graph", "vector_tree", "vector_graph", "emd_routes")

#: Lists, candidates, beam or cells without a limit.
ALL = (1 << 31) - 1


@dataclass(frozen=True)
class IndexParams:
    """One dataclass for all families; each reads what concerns it."""

    family: str = "lists"
    metric: str = "ip"
    #: Children per node (0: square root of its clouds), clouds per leaf, levels (0: no limit).
    k_per_level: int = 0
    max_leaf: int = 100
    max_depth: int = 0
    #: Lloyd rounds, vectors per center cloud (0: mean cloud size), sampled clouds per cluster.
    niters: int = 5
    center_size: int = 0
    mpcc: int = 100
    #: Lists a cloud joins at the root and at the first level (spill).
    spill: tuple[int, int] = (2, 1)
    #: Encoding size of fde_scan; degree, beam and pruning of graphs; clouds per graph shard.
    fde: int = 1280
    degree: int = 24
    beam: int = 48
    alpha: float = 1.0
    two_pass: bool = False
    shard_rows: int = 4096
    #: Prototypes and bucket size of emd_routes.
    prototypes: int = 64
    bucket: int = 256
    #: "exact" or "tq8": buckets by exact distance, or from an 8-bit shortlist of twice their size.
    bucket_build: str = "exact"
    #: "float" or "tq8": what clustering compares.
    assign_on: str = "float"
    seed: int = 0

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"family must be one of {FAMILIES}, not {self.family!r}")

    @staticmethod
    def of(family: str, **more) -> IndexParams:
        return replace(IndexParams(family=family), **more)


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    nprobes: int = 8
    #: Candidates scored anew (0: none) and by what: "float" or "tq8".
    num_rerank: int = 50
    rerank_on: str = "float"
    quantizer: str = "none"
    #: Beam of graph searches, and the cells whose graphs are searched.
    beam: int = 64
    cells: int = 8
    #: emd_routes: "scan" all prototypes or walk their "graph"; prototypes shortlisted per list read.
    routing: str = "scan"
    shortlist: int = 4
    #: "tree" or "flat_leaf": walk the levels, or score every leaf's center.
    strategy: str = "tree"
    #: Query compression for the first scoring: none, ball, ward, dynamic, strict.
    compression: str = "none"
    threshold: float = 0.3
    #: Mean recall of the k nearest to reach (0: as it comes): the settings above are where the search begins to widen them.
    recall: float = 0.0
