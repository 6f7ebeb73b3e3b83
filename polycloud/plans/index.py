"""Index families as sets of tables: build, search, save, load."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.compress import compress_queries
from ..functions.fde import FDEConfig, encode_clouds
from ..functions.quantize import FIT_VECTORS, Quantizer, fitted_state, make, restored
from ..operators import clouds as C
from ..operators import cluster, graph, search
from ..operators.evaluate import recall
from ..sources.manifest import read_manifest, write_manifest
from .params import ALL, IndexParams, SearchParams

VERSION = 1
#: A bounded training set of emd_routes prototypes.
PROTOTYPE_POOL = 2000
#: Levels of a tree; what is still too large for a leaf there becomes one all the same.
MAX_LEVELS = 12
#: Bits of a vector's id that number it within its cloud.
VECTOR_BITS = 20
#: Queries on which a search that is to reach some recall finds its settings.
RECALL_QUERIES = 256
#: How much more than the vectors of the clouds the candidates (24 bytes each) of a widened search may weigh.
CANDIDATES = 8
TREES = ("cluster_tree", "lists", "spill_tree", "vector_tree")


@dataclass
class Index:
    params: IndexParams
    tables: dict[str, DataFrame] = field(default_factory=dict)
    _fitted: dict[str, Quantizer] = field(default_factory=dict)
    _size: int | None = None

    # --- search

    def quantizer(self, name: str) -> Quantizer | None:
        """Fitted on a bounded sample of the corpus when first asked for; what has been fitted is saved with the index. Codes are derived where they are used."""
        if name == "none":
            return None
        if name not in self._fitted:
            q = make(name)
            if name in ("pq", "fastscan", "rabitq", "tqc"):
                rows = C.flatten(self.tables["clouds"]).select("v", F.xxhash64("cloud_id", "vec_pos").alias("h")).orderBy("h").limit(min(FIT_VECTORS, 8192)).collect()
                q.fit(np.array([r.v for r in rows], np.float64))
            self._fitted[name] = q
        return self._fitted[name]

    def search(self, queries: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
        """(query_id, rank, cloud_id, distance) for ``queries(query_id, vectors)``."""
        if params.recall:
            params = self.widened(queries, params)
        if self._reads_all(params):
            return search.exact_top_k(queries, self.reached(), params.k, self.params.metric, make("tq8") if params.rerank_on == "tq8" else None)
        if self._exact_first(params):  # scoring anew would change nothing
            params = replace(params, num_rerank=0)
        first = queries if params.compression == "none" else compress_queries(queries, method=params.compression, threshold=params.threshold, metric=self.params.metric, quantizer=params.quantizer)
        scored = _SEARCH[self.params.family](self, first, params)
        budget = max(params.k, params.num_rerank)
        if not params.num_rerank:
            return search.ranked(scored, params.k)
        return search.rerank(scored, queries, self.tables["clouds"], params.k, self.params.metric, budget, make("tq8") if params.rerank_on == "tq8" else None)

    def size(self) -> int:
        """Clouds of the index."""
        if self._size is None:
            self._size = self.tables["clouds"].count()
        return self._size

    def _exact_first(self, params: SearchParams) -> bool:
        return self.params.family in ("flat", "cluster_tree", "lists", "spill_tree", "cloud_graph") and params.quantizer == "none" and params.compression == "none" and params.rerank_on == "float"

    def _reads_all(self, params: SearchParams) -> bool:
        """Whether a query reads all that the index can reach and scores it all anew, so that one scan gives the same."""
        if not params.num_rerank or params.num_rerank < self.size():
            return False
        t = self.tables
        if self.params.family in TREES:
            leaves, inner = t["nodes"].agg(F.sum(F.col("is_leaf").cast("long")), F.sum((~F.col("is_leaf")).cast("long"))).first()
            return params.nprobes >= leaves and (params.strategy == "flat_leaf" or 2 * params.nprobes >= inner)
        if self.params.family == "emd_routes":
            return params.nprobes >= t["prototypes"].count()
        if "graph" in t:
            return params.cells >= t["routes"].count() and params.beam >= self.size()
        return True

    def reached(self) -> DataFrame:
        """The clouds that the index's own tables lead to."""
        t, base = self.tables, self.tables["clouds"]
        for name in ("postings", "buckets", "graph", "encodings", "pooled"):
            if name in t:
                ids = t[name].select((F.shiftright("cloud_id", VECTOR_BITS) if self.params.family in ("vector_tree", "vector_graph") else F.col("cloud_id")).alias("cloud_id"))
                return C.only(base, ids)
        return base

    def widened(self, queries: DataFrame, params: SearchParams) -> SearchParams:
        """Settings with which a hash sample of the queries finds ``params.recall`` of its nearest, and more by what the sample may err.

        ``params`` come first; lists, beams, cells and candidates are doubled until that is so. Where the candidates of all queries
        would weigh more than CANDIDATES times the vectors of the clouds, or a walk would measure as many distances as there are
        clouds, all clouds are read instead, which costs less.
        """
        asked, (n, weight) = queries.count(), search.weight(self.tables["clouds"])
        some = cluster.persisted(C.subsample(queries, RECALL_QUERIES, "query_id", self.params.seed))
        size = min(asked, RECALL_QUERIES)
        truth = cluster.persisted(search.exact_top_k(some, self.tables["clouds"], params.k, self.params.metric))
        wanted, params = params.recall, replace(params, recall=0.0)
        while True:
            got = recall(self.search(some, params), truth, params.k).agg(F.avg(F.least("recall", F.lit(1.0))).alias("m"), F.stddev("recall").alias("s")).first()
            err = 3 * (got.s or 0) / math.sqrt(max(1, size)) * math.sqrt(max(0, 1 - size / max(1, asked)))
            if (got.m or 0) >= min(1.0, wanted + err):
                return params
            params = replace(params, nprobes=2 * params.nprobes, num_rerank=2 * params.num_rerank, beam=2 * params.beam, cells=2 * params.cells)
            walks = "graph" in self.tables and params.cells * params.beam * self.params.degree > n
            if walks or params.num_rerank >= n or 24 * params.num_rerank * asked > CANDIDATES * weight:
                return replace(params, nprobes=ALL, num_rerank=ALL, beam=ALL, cells=ALL)

    def probe(self, queries: DataFrame, params: SearchParams) -> DataFrame:
        """(query_id, leaf_id, rank) of the lists a query reads."""
        return _probe(self, queries, params)

    # --- introspection

    def flat_clustering(self) -> DataFrame:
        return self.tables["postings"]

    def leaves_of(self, ids: DataFrame) -> DataFrame:
        return self.tables["postings"].join(ids.select("cloud_id"), "cloud_id", "left_semi")

    def root_child_clustering(self) -> DataFrame:
        """(cloud_id, root_child): the child of the root above each of a cloud's leaves."""
        up = self.tables["nodes"].select("node_id", "parent_id")
        at = self.tables["postings"].select("cloud_id", F.col("leaf_id").alias("node_id"))
        for _ in range(self.height()):
            at = at.join(up, "node_id").select("cloud_id", F.when(F.col("parent_id") == 0, F.col("node_id")).otherwise(F.col("parent_id")).alias("node_id"))
        return at.select("cloud_id", F.col("node_id").alias("root_child")).distinct()

    def height(self) -> int:
        return int(self.tables["nodes"].agg(F.max("level")).first()[0]) if "nodes" in self.tables else 0

    # --- storage

    def save(self, path: str) -> None:
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark = next(iter(self.tables.values())).sparkSession
        fitted = [(n, bytearray(state)) for n, q in self._fitted.items() if (state := fitted_state(q))]
        if fitted:
            spark.createDataFrame(fitted, "name string, state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebooks")
        write_manifest(spark, f"{path}/manifest", {"version": VERSION, "params": asdict(self.params), "tables": sorted(self.tables), "codebooks": bool(fitted), "routing": self._routing()})

    def _routing(self) -> str | None:
        """The order of the prototypes that a routing graph is about."""
        if "routing" not in self.tables:
            return None
        return str(self.tables["prototypes"].agg(F.sum(F.xxhash64("proto_id", "train_row").cast("decimal(38,0)"))).first()[0])

    @staticmethod
    def load(spark, path: str) -> Index:
        m = read_manifest(spark, f"{path}/manifest")
        if m["version"] != VERSION:
            raise ValueError(f"index version {m['version']} is not {VERSION}")
        p = m["params"] | {"spill": tuple(m["params"]["spill"])}
        index = Index(IndexParams(**p), {t: spark.read.parquet(f"{path}/{t}") for t in m["tables"]})
        if m.get("routing") != index._routing():
            raise ValueError("the routing graph belongs to other prototypes")
        if m.get("codebooks"):
            index._fitted = {r.name: restored(r.name, bytes(r.state)) for r in spark.read.parquet(f"{path}/codebooks").collect()}
        return index


# --- build


def build(clouds: DataFrame, params: IndexParams = IndexParams()) -> Index:
    """The index of ``clouds(cloud_id, vectors)``; empty clouds are left out, a non-finite coordinate fails the build."""
    rows = C.checked(clouds.select(F.col("cloud_id").cast("long").alias("cloud_id"), "vectors"))
    index = Index(params, {"clouds": rows})
    _BUILD.get(params.family, lambda i: None)(index)
    return index


def _children(n: int, p: IndexParams) -> int:
    return max(1, max(4, min(p.k_per_level or math.ceil(math.sqrt(n)), 4 * (n + p.max_leaf - 1) // p.max_leaf, n))) if n >= 4 else n


def _build_tree(index: Index, depth: int | None = None, spill: tuple[int, int] = (1, 1)) -> None:
    """Level by level: all nodes too large for a leaf are clustered in one job, then their clouds move to the children."""
    p, base = index.params, index.tables["clouds"]
    spark = base.sparkSession
    depth = p.max_depth if depth is None else depth
    at = base.select(F.lit(0).cast("long").alias("node_id"), "cloud_id", "vectors")
    nodes: list[DataFrame] = []
    leaves: list[DataFrame] = []
    level, fresh = 0, 1
    counts = {0: base.count()}
    while True:
        level += 1
        one = depth == 1
        big = {n: c for n, c in counts.items() if (one and n == 0) or c > p.max_leaf}
        if not big or (depth and level > depth):
            break
        ks = {n: (math.ceil(math.sqrt(c)) if one and not p.k_per_level else min(c, p.k_per_level) if one else _children(c, p)) for n, c in big.items()}
        centers = cluster.train(at, ks, big, p.metric, p.niters, p.center_size, p.mpcc, p.seed + level, p.assign_on)
        top = spill[level - 1] if level <= 2 else 1
        placed = cluster.assign(at, centers, p.metric, top)
        first = {}
        for n in ks:  # children of a node get consecutive ids
            first[n] = fresh
            fresh += ks[n]
        start = F.broadcast(spark.createDataFrame(list(first.items()), "node_id long, first long"))
        moved = cluster.persisted(placed.join(start, "node_id").select((F.col("first") + F.col("child")).alias("node_id"), F.col("node_id").alias("parent_id"), "cloud_id", "vectors").dropDuplicates(["node_id", "cloud_id"]))
        here = {r.node_id: (r.n, r.parent_id) for r in moved.groupBy("node_id").agg(F.count("*").alias("n"), F.first("parent_id").alias("parent_id")).collect()}
        # A split that moves everything into one child is no split: that child stays a leaf.
        stuck = {n for n, (c, up) in here.items() if c == counts[up]}
        final = one or (depth and level == depth) or level == MAX_LEVELS
        open_ = {n: c for n, (c, _) in here.items() if c > p.max_leaf and n not in stuck and not final}
        size = F.broadcast(spark.createDataFrame([(n, c, n not in open_) for n, (c, _) in here.items()], "node_id long, n_clouds long, is_leaf boolean"))
        named = centers.join(start, "node_id").select((F.col("first") + F.col("child")).alias("node_id"), F.col("node_id").alias("parent_id"), F.lit(level).alias("level"), F.col("vectors").alias("center"))
        level_nodes = named.join(size, "node_id")
        nodes.append(level_nodes)
        leaves.append(moved.join(size.filter("is_leaf"), "node_id").select(F.col("node_id").alias("leaf_id"), "cloud_id"))
        at = moved.join(size.filter("not is_leaf"), "node_id").select("node_id", "cloud_id", "vectors")
        counts = open_
        if not open_:
            break
    if not nodes:  # a corpus that fits one leaf
        center = base.orderBy("cloud_id").limit(1).select(F.lit(1).cast("long").alias("node_id"), F.lit(0).cast("long").alias("parent_id"), F.lit(1).alias("level"), F.col("vectors").alias("center"), F.lit(counts[0]).cast("long").alias("n_clouds"), F.lit(True).alias("is_leaf"))
        nodes, leaves = [center], [base.select(F.lit(1).cast("long").alias("leaf_id"), "cloud_id")]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    index.tables["nodes"], index.tables["postings"] = union(nodes), union(leaves)
    index.tables["lists"] = index.tables["postings"].join(base, "cloud_id").select("leaf_id", "cloud_id", "vectors")


def _vector_rows(clouds: DataFrame) -> DataFrame:
    """Every vector as a cloud of one, under an id that keeps its cloud apart (2^20 vectors a cloud, ids below 2^43, or it fails)."""
    return C.flatten(clouds).select(_packed("cloud_id", "vec_pos", VECTOR_BITS).alias("cloud_id"), F.array("v").alias("vectors"))


def _packed(id_col: str, pos: str, bits: int):
    ok = F.col(id_col).between(0, (1 << (63 - bits)) - 1) & (F.col(pos) < (1 << bits))
    return F.when(ok, F.col(id_col) * (1 << bits) + F.col(pos)).otherwise(F.raise_error(F.concat(F.lit(f"cloud id out of range or more than {1 << bits} vectors: "), F.col(id_col).cast("string"))))


def _build_vector_tree(index: Index) -> None:
    own = Index(index.params, {"clouds": _vector_rows(index.tables["clouds"])})
    _build_tree(own)
    index.tables |= {"nodes": own.tables["nodes"], "postings": own.tables["postings"], "lists": own.tables["lists"]}


def _graph(index: Index, clouds: DataFrame, metric: str | None = None) -> None:
    p = index.params
    made, routes = graph.build_graphs(clouds, metric or p.metric, p.degree, p.beam, p.alpha, p.shard_rows, p.two_pass, p.seed)
    index.tables |= {"graph": cluster.persisted(made), "routes": routes}


def _walk(index: Index, queries: DataFrame, sp: SearchParams, k: int, beam: int, metric: str | None = None, scorer: Quantizer | None = None) -> DataFrame:
    return graph.search_graphs(queries, index.tables["graph"], index.tables["routes"], k, beam, metric or index.params.metric, scorer, sp.cells)


def _build_fde_graph(index: Index) -> None:
    _build_fde_scan(index)
    _graph(index, index.tables["encodings"], "ip")


def _build_pooled_graph(index: Index) -> None:
    _build_pooled_scan(index)
    _graph(index, index.tables["pooled"])


def _build_fde_scan(index: Index) -> None:
    cfg = FDEConfig.preset(index.params.fde, seed=index.params.seed)
    index.tables["encodings"] = cluster.persisted(encode_clouds(index.tables["clouds"], cfg, False))


def _build_pooled_scan(index: Index) -> None:
    index.tables["pooled"] = C.mean_pooled(index.tables["clouds"], normalize=True)


def _build_emd_routes(index: Index) -> None:
    """Prototypes by k-center under EMD over a bounded pool; buckets are each prototype's nearest clouds, and every cloud that is in none goes to its nearest prototype's."""
    p, base = index.params, index.tables["clouds"]
    pool = C.subsample(base, PROTOTYPE_POOL, "cloud_id", p.seed).orderBy("cloud_id").collect()
    vectors = [np.array(r.vectors, np.float64) for r in pool]
    chosen, radius = cluster.farthest_first(vectors, p.prototypes)
    spark = base.sparkSession
    protos = spark.createDataFrame([(i, pool[c].cloud_id, radius[i], pool[c].vectors) for i, c in enumerate(chosen)], "proto_id long, train_row long, cover_radius double, vectors array<array<float>>")
    asks = protos.select(F.col("proto_id").alias("query_id"), "vectors")
    if p.bucket_build == "tq8":
        buckets = search.rerank(search.exact_top_k(asks, base, 2 * p.bucket, p.metric, make("tq8")), asks, base, p.bucket, p.metric)
    else:
        buckets = search.exact_top_k(asks, base, p.bucket, p.metric)
    near = cluster.persisted(buckets.select(F.col("query_id").alias("proto_id"), "rank", "cloud_id", "distance"))
    # As a query is routed: by the distance from the cloud to the prototype.
    left = base.join(near.select("cloud_id"), "cloud_id", "left_anti").select(F.lit(0).cast("long").alias("node_id"), "cloud_id", "vectors")
    centers = protos.select(F.lit(0).cast("long").alias("node_id"), F.col("proto_id").cast("int").alias("child"), "vectors")
    placed = cluster.assign(left, centers, p.metric).select(F.col("child").cast("long").alias("proto_id"), F.lit(None).cast("int").alias("rank"), "cloud_id", "distance")
    index.tables |= {"prototypes": protos, "buckets": cluster.persisted(near.unionByName(placed))}
    index.tables["lists"] = index.tables["buckets"].select(F.col("proto_id").alias("leaf_id"), "cloud_id").join(base, "cloud_id").select("leaf_id", "cloud_id", "vectors")
    made, routes = graph.build_graphs(protos.select(F.col("proto_id").alias("cloud_id"), "vectors"), p.metric, p.degree, p.beam, p.alpha, p.shard_rows, p.two_pass, p.seed)
    index.tables |= {"routing": cluster.persisted(made), "routing_routes": routes}


_BUILD = {
    "cluster_tree": lambda i: _build_tree(i), "lists": lambda i: _build_tree(i, depth=1), "spill_tree": lambda i: _build_tree(i, spill=i.params.spill),
    "fde_scan": _build_fde_scan, "pooled_scan": _build_pooled_scan, "vector_tree": _build_vector_tree, "emd_routes": _build_emd_routes,
    "fde_graph": _build_fde_graph, "pooled_graph": _build_pooled_graph,
    "cloud_graph": lambda i: _graph(i, i.tables["clouds"]), "vector_graph": lambda i: _graph(i, _vector_rows(i.tables["clouds"])),
}

# --- search


def _probe(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    """Level-synchronous beam: twice ``nprobes`` inner nodes go on per level, the ``nprobes`` best leaves of all levels are read.

    Each level is an equi-join of the beam with the children of its nodes, so the tree may be of any size.
    """
    metric, nodes = index.params.metric, index.tables["nodes"]
    centers = nodes.select(F.col("node_id").alias("cloud_id"), F.col("center").alias("vectors"))
    if sp.strategy == "flat_leaf":
        found = search.exact_top_k(queries, nodes.filter("is_leaf").select(F.col("node_id").alias("cloud_id"), F.col("center").alias("vectors")), sp.nprobes, metric)
        return found.select("query_id", F.col("cloud_id").alias("leaf_id"), "rank", "distance")
    beam = queries.select("query_id", F.lit(0).cast("long").alias("node_id"))
    leaves = None
    height = index.height()
    for level in range(1, height + 1):
        if level == 1:  # every query meets all children of the root
            scored = search.all_distances(queries, nodes.filter("level = 1").select(F.col("node_id").alias("cloud_id"), F.col("center").alias("vectors")), metric)
        else:
            pairs = beam.join(nodes.filter(F.col("level") == level).select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("cloud_id")), "node_id").select("query_id", "cloud_id")
            scored = search.score_pairs(pairs, queries, centers, metric)
        kind = scored.join(nodes.select(F.col("node_id").alias("cloud_id"), "is_leaf"), "cloud_id")
        here = kind.filter("is_leaf").select("query_id", "cloud_id", "distance")
        leaves = here if leaves is None else leaves.unionByName(here)
        if level < height:
            beam = search.ranked(kind.filter("not is_leaf").select("query_id", "cloud_id", "distance"), 2 * sp.nprobes).select("query_id", F.col("cloud_id").alias("node_id"))
    return search.ranked(leaves, sp.nprobes).select("query_id", F.col("cloud_id").alias("leaf_id"), "rank", "distance")


def _search_flat(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    return search.exact_top_k(queries, index.tables["clouds"], max(sp.k, sp.num_rerank), index.params.metric, index.quantizer(sp.quantizer)).drop("rank")


def _search_tree(index: Index, queries: DataFrame, sp: SearchParams, own_bits: int = 0) -> DataFrame:
    """Each probed list gives its best max(num_rerank, k) per query; lists of vectors (``own_bits``) give every cloud that they hold a vector of."""
    probes = cluster.persisted(_probe(index, queries, sp).select("query_id", "leaf_id"))
    return search.nearest(search.score_lists(probes, queries, index.tables["lists"], index.params.metric, None if own_bits else max(sp.k, sp.num_rerank), index.quantizer(sp.quantizer), own_bits))


def _search_fde_scan(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    cfg = FDEConfig.preset(index.params.fde, seed=index.params.seed)
    return search.exact_top_k(encode_clouds(queries, cfg, True, "query_id"), index.tables["encodings"], max(sp.k, sp.num_rerank), "ip", make(sp.quantizer) if sp.quantizer not in ("pq", "fastscan", "rabitq", "tqc", "none") else None).drop("rank")


def _search_pooled_scan(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    pooled = queries.select("query_id", F.array(V.mean_pool("vectors")).alias("vectors"))
    return search.exact_top_k(pooled, index.tables["pooled"], max(sp.k, sp.num_rerank), index.params.metric).drop("rank")


def _search_fde_graph(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    cfg = FDEConfig.preset(index.params.fde, seed=index.params.seed)
    return _walk(index, encode_clouds(queries, cfg, True, "query_id"), sp, max(sp.k, sp.num_rerank), sp.beam, "ip")


def _search_pooled_graph(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    """Documents' means are normalized, queries' are not."""
    return _walk(index, queries.select("query_id", F.array(V.mean_pool("vectors")).alias("vectors")), sp, max(sp.k, sp.num_rerank), sp.beam)


def _query_vectors(queries: DataFrame) -> DataFrame:
    """Every vector of a query as a query (2^12 vectors a query, ids below 2^51, or it fails)."""
    return queries.select("query_id", F.posexplode("vectors").alias("p", "v")).select(_packed("query_id", "p", 12).alias("query_id"), F.array("v").alias("vectors"))


def _vector_hits(near: DataFrame) -> DataFrame:
    """Hits (query vector, cloud, smallest distance) to clouds: sums of minima over the vectors that hit, whatever their number."""
    return search.sum_of_minima(near.select(F.shiftright("query_id", 12).alias("query_id"), F.col("query_id").alias("query_pos"), "cloud_id", "distance"))


def _search_vector_tree(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    return _vector_hits(_search_tree(index, _query_vectors(queries), sp, VECTOR_BITS))


def _search_cloud_graph(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    return _walk(index, queries, sp, max(sp.k, sp.num_rerank), sp.beam, scorer=index.quantizer(sp.quantizer))


def _search_vector_graph(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    walked = _walk(index, _query_vectors(queries), sp, sp.beam, 2 * sp.beam, scorer=index.quantizer(sp.quantizer))
    return _vector_hits(walked.withColumn("cloud_id", F.shiftright("cloud_id", VECTOR_BITS)))


def _search_emd_routes(index: Index, queries: DataFrame, sp: SearchParams) -> DataFrame:
    """Ward-compressed queries shortlist prototypes by 4-bit codes (or walk their graph), 8-bit codes rank the shortlist, the best buckets are united and scored with the quantizer (one bit by default)."""
    protos, metric = index.tables["prototypes"].select(F.col("proto_id").alias("cloud_id"), "vectors"), index.params.metric
    small, wide = compress_queries(queries, method="ward", threshold=sp.threshold, metric=metric, quantizer="tq4"), sp.shortlist * sp.nprobes
    if sp.routing == "graph":
        some = graph.search_graphs(small, index.tables["routing"], index.tables["routing_routes"], wide, max(sp.beam, wide), metric, make("tq4"), sp.cells)
    else:
        some = search.exact_top_k(small, protos, wide, metric, make("tq4"))
    routes = cluster.persisted(search.rerank(some, queries, protos, sp.nprobes, metric, wide, make("tq8")).select("query_id", F.col("cloud_id").alias("leaf_id")))
    return search.nearest(search.score_lists(routes, queries, index.tables["lists"], metric, max(sp.k, sp.num_rerank), index.quantizer(sp.quantizer if sp.quantizer != "none" else "tq1")))


_SEARCH: dict[str, Any] = {
    "flat": _search_flat, "cluster_tree": _search_tree, "lists": _search_tree, "spill_tree": _search_tree, "fde_scan": _search_fde_scan,
    "pooled_scan": _search_pooled_scan, "fde_graph": _search_fde_graph, "pooled_graph": _search_pooled_graph, "vector_tree": _search_vector_tree, "vector_graph": _search_vector_graph, "cloud_graph": _search_cloud_graph, "emd_routes": _search_emd_routes,
}
