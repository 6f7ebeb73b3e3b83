"""SimHash near-duplicates: fingerprints of whole texts, a binary-trie self-join under a Hamming budget, components.

The self-join is spread by pigeonhole: fingerprints within ``budget`` bits agree on at least one of budget + 1 blocks,
so each distinct fingerprint goes to one bucket per block. A bucket of more than BUCKET_ROWS is cut by the same argument
over its remaining bits. Inside a bucket the trie is traversed pairwise: two nodes start equal, each level adds the
differing bit, and a pair is dropped once it is over budget. A bucket returns at most one link per member (a spanning
forest), never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, SOLID, batches_of, components, join_hot, mix, table, text_bytes, union_arrays, unused, word_hashes, word_spans

BITS = 64
#: Node pairs with so few member pairs are compared directly.
LEAF = 64
#: Node or member pairs handled by one numpy step; bounds memory only.
STEP = 1 << 19
#: Larger buckets are cut into smaller ones.
BUCKET_ROWS = 1 << 20
#: Near-duplicate stage: words of the wide fingerprint, and the slices of it that the trie joins.
WIDE_WORDS, SLICE_BITS, SLICES, SLICE_BUDGET = 8, 22, 16, 2
SHINGLE, SIMILARITY = 5, 0.8
#: Standard deviations that a candidate's differing bits may lie above those expected at SIMILARITY.
MARGIN = 4.0

# --- fingerprints


def _majority(h: np.ndarray, groups: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per group (ids in ``groups``, sorted, sizes ``n``) the 64-bit word whose bits are set in over half of ``h``."""
    octets = h.view(np.uint8).reshape(-1, 8)
    bit = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
    out = np.zeros(len(n), np.uint64)
    base = groups * 256
    for k in range(8):
        counts = np.bincount(base + octets[:, k], minlength=len(n) * 256).reshape(-1, 256)
        over = 2 * (counts.astype(np.float64) @ bit) > n[:, None]
        out |= (over.astype(np.uint64) << (np.arange(8, dtype=np.uint64) + np.uint64(8 * k))).sum(1, dtype=np.uint64)
    return out


def fingerprint_batch(data: np.ndarray, offsets: np.ndarray, shingle: int = 4) -> np.ndarray:
    """64-bit SimHash per text: XXH64 (seed 42) of each space-joined shingle of blank-separated, A-Z-lowered words."""
    s, e = word_spans(data, offsets, SOLID)
    first = np.searchsorted(s, offsets)
    n_words = np.diff(first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s] = 1
    inside[e] -= 1  # ends are distinct
    word = np.cumsum(inside[:-1]).astype(bool)
    keep = word.copy()
    keep[1:] |= word[:-1]  # one blank after each word
    text = np.where(word, LOWER[data], 32)[keep]
    to = np.cumsum(keep) - keep
    s2, e2 = to[s], np.append(to, len(text))[e - 1] + 1
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    local = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    a = first[doc] + local
    b = np.minimum(a + shingle, first[doc + 1]) - 1
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[i:j], 42) for i, j in zip(s2[a].tolist(), e2[b].tolist())), np.uint64, len(a))
    return _majority(h, doc, n)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each text, sorted within the text, and the n + 1 bounds; a text under ``shingle`` words is one shingle, one without words has none."""
    s, e = word_spans(data, offsets, ALNUM)
    first = np.searchsorted(s, offsets)
    n_words = np.diff(first)
    h = word_hashes(data, s, e)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(len(n)), n)
    a = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    limit = first[doc + 1]
    g = np.zeros(len(a), np.uint64)
    for k in range(shingle):
        at = np.minimum(a + k, len(h) - 1)
        g = mix(g + np.where(a + k < limit, h[at], np.uint64(k + 1)))
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def wide_batch(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, words: int = WIDE_WORDS) -> np.ndarray:
    """``words`` x 64 SimHash bits per text over its set of word shingles; (texts, words) uint64. A text of no words is zero."""
    g, bounds = shingle_sets(data, offsets, shingle)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    return np.stack([_majority(mix(g ^ np.uint64(0xA0761D6478BD642F * (k + 1) % 2**64)), doc, n) for k in range(words)], 1) if len(n) else np.zeros((0, words), np.uint64)


# --- the trie


def trie_self_join(x: np.ndarray, roots: np.ndarray, depth: int, bits: int, budget: int, found: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Calls ``found(i, j)`` with all index pairs inside one root whose ``bits``-bit values differ in at most ``budget`` bits.

    ``x`` is sorted within the roots; ``roots`` holds their bounds; members of a root agree on the first ``depth`` bits.
    """
    ones: dict[int, np.ndarray] = {}
    lo, hi = roots[:-1], roots[1:]
    many = hi - lo > 1
    stack = [(lo[many], hi[many], lo[many], hi[many], np.zeros(int(many.sum()), np.int8), depth)]
    while stack:
        alo, ahi, blo, bhi, err, d = stack.pop()
        if len(alo) > STEP:
            half = len(alo) // 2
            stack += [(alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half], d), (alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:], d)]
            continue
        small = (ahi - alo) * (bhi - blo) <= LEAF if d < bits else np.ones(len(alo), bool)
        if small.any():
            _compare(x, alo[small], ahi[small], blo[small], bhi[small], budget, found)
        if small.all():
            continue
        alo, ahi, blo, bhi, err = (v[~small] for v in (alo, ahi, blo, bhi, err))
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((x >> np.uint64(bits - 1 - d)) & np.uint64(1), dtype=np.int64)])
        c = ones[d]
        amid, bmid, same = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo]), alo == blo
        parts = [(alo, amid, blo, bmid, err, None), (amid, ahi, bmid, bhi, err, None), (alo, amid, bmid, bhi, err + 1, None), (amid, ahi, blo, bmid, err + 1, ~same)]
        kept = []
        for p, q, r, t, e, extra in parts:
            ok = (q > p) & (t > r) & (e <= budget)
            ok &= True if extra is None else extra
            kept.append((p[ok], q[ok], r[ok], t[ok], e[ok]))
        nxt = tuple(np.concatenate([k[i] for k in kept]) for i in range(5))
        # A node with one member met with itself holds no pair.
        ok = ~((nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1))
        if ok.any():
            stack.append((*(v[ok] for v in nxt), d + 1))


def _compare(x, alo, ahi, blo, bhi, budget, found) -> None:
    na, nb = ahi - alo, bhi - blo
    total = np.cumsum(na * nb)
    i = 0
    while i < len(alo):
        done = int(total[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + 4 * STEP, "right")))
        if j == i + 1 and na[i] * nb[i] > 4 * STEP:  # one huge pair of leaves: row by row
            rows = max(1, 4 * STEP // int(nb[i]))
            spans = [(np.array([p]), np.array([min(p + rows, ahi[i])]), blo[i : j], bhi[i : j]) for p in range(int(alo[i]), int(ahi[i]), rows)]
        else:
            spans = [(alo[i:j], ahi[i:j], blo[i:j], bhi[i:j])]
        for p, q, r, t in spans:
            size = (q - p) * (t - r)
            k = np.repeat(np.arange(len(p)), size)
            local = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            width = (t - r)[k]
            u, v = p[k] + local // width, r[k] + local % width
            ok = (u < v) & (np.bitwise_count(x[u] ^ x[v]) <= budget)
            if ok.any():
                found(u[ok], v[ok])
        i = j


def blocks(bits: int, budget: int) -> list[tuple[int, int]]:
    """(offset from the top, width) of budget + 1 blocks that together are ``bits`` wide."""
    n = budget + 1
    width = [bits // n + (k < bits % n) for k in range(n)]
    return [(sum(width[:k]), width[k]) for k in range(n)]


def _rotated(x: np.ndarray, by: int, bits: int) -> np.ndarray:
    if not by:
        return x
    mask = np.uint64((1 << bits) - 1) if bits < 64 else ~np.uint64(0)
    return ((x << np.uint64(by)) | (x >> np.uint64(bits - by))) & mask


def _buckets(batches: Iterator[pa.RecordBatch], least: int = 1 << 17) -> Iterator[pa.Table]:
    """Tables of whole buckets from rows sorted by ``bucket``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch.column(0).to_numpy()
        cut = int(np.searchsorted(b, b[-1]))  # the last bucket may go on
        if cut and rows + cut >= least:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows = [], 0
            batch = batch.slice(cut)
        elif not cut and rows >= least and held and held[-1].column(0)[-1].as_py() != b[0]:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _bounds(bucket: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])


def _cut(bucket: np.ndarray, kind: int, kinds: int, value: np.ndarray, rest: int, budget: int) -> list[np.ndarray]:
    """Buckets (negative, ``kind`` can be read off) for members whose last ``rest`` bits of ``value`` may differ in ``budget``: one per block of those bits."""
    out = []
    for j, (off, w) in enumerate(blocks(rest, budget)):
        part = (value >> np.uint64(rest - off - w)) & np.uint64((1 << w) - 1)
        h = mix(mix(bucket.view(np.uint64) * np.uint64(8) + np.uint64(j)) ^ part) >> np.uint64(16)
        out.append(-(1 + kind + kinds * h.astype(np.int64)))
    return out


def _bounded(keyed: DataFrame, members: int, cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``keyed(bucket, ...)`` of ``members`` nodes with the buckets of more than BUCKET_ROWS rows cut."""
    if members <= BUCKET_ROWS:  # no bucket can hold more
        return keyed
    large = table(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS).select("bucket"), "large")
    if large.isEmpty():
        return keyed
    hot = keyed.join(large, "bucket", "left_semi").mapInArrow(cut, keyed.schema)
    return keyed.join(large, "bucket", "left_anti").select(keyed.columns).unionAll(hot)


def hamming_links(nodes: DataFrame, fp: str, budget: int) -> DataFrame:
    """Links (u, v) whose transitive closure is that of all pairs of 64-bit values (signed, distinct) within ``budget`` bits."""
    plan = blocks(BITS, budget)
    top = lambda off, w: F.shiftrightunsigned(F.shiftleft(F.col(fp), off), 64 - w)
    keyed = nodes.select(F.explode(F.array(*[F.struct((F.lit(k << 32).cast("long") + top(off, w)).alias("bucket"), F.col(fp).alias("x")) for k, (off, w) in enumerate(plan)])).alias("b")).select("b.bucket", "b.x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for k in np.unique(bucket >> 32).tolist():
                mine = bucket >> 32 == k
                off, width = plan[k]
                for b in _cut(bucket[mine], k, len(plan), _rotated(x[mine], off, BITS), BITS - width, budget):
                    yield pa.RecordBatch.from_arrays([pa.array(b), batch.column(1).filter(pa.array(mine))], names=["bucket", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _buckets(batches):
            bucket, x = whole.column(0).to_numpy(), whole.column(1).to_numpy().view(np.uint64)
            kind = np.where(bucket < 0, -1, bucket >> 32)
            for k in np.unique(kind).tolist():
                mine = kind == k
                off, width = plan[k] if k >= 0 else (0, 0)  # members of a cut bucket share no leading bits
                value, group = _rotated(x[mine], off, BITS), bucket[mine]
                order = np.lexsort((value, group))
                value, node = value[order], x[mine][order].view(np.int64)
                parent = np.arange(len(value))
                trie_self_join(value, _bounds(group[order]), width, BITS, budget, lambda i, j, p=parent: union_arrays(p, i, j))
                linked = np.flatnonzero(parent != np.arange(len(parent)))
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[parent[linked]])], names=["u", "v"])

    return _bounded(keyed, nodes.count(), cut).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u long, v long")


# --- operators


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = 4, name: str = "fp") -> DataFrame:
    """The columns ``carry`` (all by default) plus the 64-bit fingerprint as a signed long; a text without words has 0."""
    carry = docs.columns if carry is None else carry
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, text):
                data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
                fp = fingerprint_batch(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in carry], pa.array(fp.view(np.int64))], names=[*carry, name])

    return docs.mapInArrow(run, schema)


def similar_components(docs: DataFrame, budget: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs(doc_id, text)``.

    Fingerprints at most ``budget`` bits apart are linked; a component is named by its smallest doc_id. Null and empty
    texts have fingerprint zero and link like any other; repeated rows each return a row; a null doc_id never names a
    component unless all its ids are null.
    """
    fp = table(fingerprints(docs.select("doc_id", "text"), carry=["doc_id"], shingle=shingle), "fingerprints")
    nodes = table(fp.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "nodes")
    roots = components(hamming_links(nodes.select("fp"), "fp", budget))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "copies", "least", F.coalesce("root", "fp").alias("root"))
    named = table(joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "copies", "component_id"), "components")
    out = join_hot(fp, named, "fp", "copies", fp.count(), F.monotonically_increasing_id())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def angle_budget(similarity: float, bits: int) -> int:
    """Differing bits expected at a Jaccard similarity (sets of equal size share 2s / (1 + s) of their shingles), plus MARGIN standard deviations: candidates, to be confirmed on the shingles themselves."""
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    return int(p * bits + MARGIN * (p * (1 - p) * bits) ** 0.5)


def candidates(nodes: DataFrame, budget: int, forest: bool) -> DataFrame:
    """Pairs (u, v) of ``nodes(fp, root)`` of different roots that agree on a slice but for SLICE_BUDGET bits and differ in at most ``budget`` bits.

    All of them, or with ``forest`` at most one a member of a bucket, which touch every node that has a pair.
    """
    plan = blocks(SLICE_BITS, SLICE_BUDGET)
    kinds = SLICES * len(plan)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
            buckets = []
            for k in range(SLICES):
                x = _slice(raw, k)
                buckets += [(np.int64((k * len(plan) + b) << 32) + (_rotated(x, off, SLICE_BITS) >> np.uint64(SLICE_BITS - w)).astype(np.int64)) for b, (off, w) in enumerate(plan)]
            for a in range(0, len(buckets), 6):
                some = buckets[a : a + 6]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(some)), pa.concat_arrays([batch.column(0)] * len(some)), pa.concat_arrays([batch.column(1)] * len(some))], names=["bucket", "fp", "root"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
            for t in np.unique(bucket >> 32).tolist():
                mine = bucket >> 32 == t
                off, width = plan[t % len(plan)]
                rest = [c.filter(pa.array(mine)) for c in batch.columns[1:]]
                for b in _cut(bucket[mine], t, kinds, _rotated(_slice(raw[mine], t // len(plan)), off, SLICE_BITS), SLICE_BITS - width, SLICE_BUDGET):
                    yield pa.RecordBatch.from_arrays([pa.array(b), *rest], names=["bucket", "fp", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _buckets(batches, 1 << 16):
            bucket, roots = whole.column(0).to_numpy(), whole.column(2).to_numpy()
            raw = np.frombuffer(b"".join(whole.column(1).to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
            # Members of a cut bucket (negative) share no leading bits.
            kind = np.where(bucket < 0, kinds + (-bucket - 1) % kinds, bucket >> 32)
            for t in np.unique(kind).tolist():
                mine = np.flatnonzero(kind == t)
                off, width = plan[t % len(plan)] if t < kinds else (0, 0)
                t %= kinds
                value = _rotated(_slice(raw[mine], t // len(plan)), off, SLICE_BITS)
                order = np.lexsort((value, bucket[mine]))
                value, w, root = value[order], raw[mine[order]], roots[mine[order]]
                parent = np.arange(len(value))
                pairs: list[tuple[np.ndarray, np.ndarray]] = []

                def found(i: np.ndarray, j: np.ndarray, parent=parent, w=w, root=root, pairs=pairs) -> None:
                    apart = (parent[i] != parent[j]) & (root[i] != root[j])
                    i, j = i[apart], j[apart]
                    near = np.bitwise_count(w[i] ^ w[j]).sum(1) <= budget
                    if forest:
                        union_arrays(parent, i[near], j[near])
                    else:
                        pairs.append((i[near], j[near]))

                trie_self_join(value, _bounds(bucket[mine][order]), width, SLICE_BITS, SLICE_BUDGET, found)
                if forest:
                    at = np.flatnonzero(parent != np.arange(len(parent)))
                    pairs.append((at, parent[at]))
                give = lambda rows, w=w: pa.array([w[r].tobytes() for r in rows.tolist()], pa.binary())
                for i, j in pairs:
                    for a in range(0, len(i), 1 << 16):
                        yield pa.RecordBatch.from_arrays([give(i[a : a + (1 << 16)]), give(j[a : a + (1 << 16)])], names=["u", "v"])

    keyed = nodes.select("fp", "root").mapInArrow(slices, "bucket long, fp binary, root long")
    out = _bounded(keyed, nodes.count(), cut).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "u binary, v binary")
    return out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose sets of shingles have Jaccard similarity ``similarity`` or more; ``sets(fp, shingles)``."""
    a = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([c.values.to_numpy()[p:q] for p, q in zip(c.offsets[:-1].to_pylist(), c.offsets[1:].to_pylist())] for c in (batch.column(2), batch.column(3)))
            both = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)], np.float64)
            size = np.array([len(s) + len(t) for s, t in zip(x, y)], np.float64)
            near = both >= similarity * (size - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(near))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> tuple[DataFrame, str, DataFrame]:
    """The documents written with a row number, the number's column, and (fp, group, keep) of every fingerprint.

    Texts are linked whose sets of five-word shingles have Jaccard similarity ``similarity`` or more; a group is what links
    connect, ``keep`` its row with the smallest doc_id. Candidates come from SLICES slices (SLICE_BITS wide, SLICE_BUDGET
    bits apart) of a 512-bit fingerprint and a wide bound on all its bits; every link is confirmed on the shingles. A pair at
    exactly 0.8 shares no slice with probability 0.002, and by the binomial estimate exceeds the bound with less than 0.0001.

    First a forest of the candidates is confirmed, then all candidates between groups that are still apart, among the texts
    that have any: pairs inside a large group are never listed.
    """
    row, fp = unused(docs, "row_no", "wide_fp")
    schema = T.StructType([*docs.schema, T.StructField(row, T.LongType()), T.StructField(fp, T.BinaryType())])
    i_text = docs.columns.index("text")

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                data, offsets = text_bytes(batch.column(i_text))
                raw = wide_batch(data, offsets, shingle).tobytes()
                n = 8 * WIDE_WORDS
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([raw[i : i + n] for i in range(0, len(raw), n)], pa.binary())], names=[*batch.schema.names, fp])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text"):
                g, bounds = shingle_sets(*text_bytes(batch.column(1)), shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(g.view(np.int64)))], names=["fp", "shingles"])

    all_rows = table(docs.withColumn(row, F.monotonically_increasing_id()).mapInArrow(wide, schema), "wide")
    light = all_rows.select(F.col(row).alias("_row"), F.col("doc_id").alias("id"), F.col(fp).alias("fp"))
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "_row"))).alias("least")
    nodes = table(light.groupBy("fp").agg(least, F.min("_row").alias("_any")), "nodes")
    budget = angle_budget(similarity, 64 * WIDE_WORDS)
    tree = table(candidates(nodes.select("fp", F.xxhash64("fp").alias("root")), budget, True), "forest")
    ends = tree.select(F.col("u").alias("fp")).unionAll(tree.select("v")).distinct()
    chosen = nodes.join(ends, "fp", "left_semi").select(F.col("_any").alias("_row"))
    sets = table(all_rows.join(chosen, all_rows[row] == chosen["_row"], "left_semi").select(F.col(fp).alias("fp"), "text").mapInArrow(shingles, "fp binary, shingles array<long>"), "shingles")
    sure = table(confirmed(tree, sets, similarity), "links")
    roots = components(sure)
    apart = sets.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.xxhash64(F.coalesce("root", "fp")).alias("root"))
    rest = candidates(apart, budget, False).join(tree, ["u", "v"], "left_anti")
    more = table(confirmed(rest, sets, similarity), "links")
    roots = components(sure.unionAll(more))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    keep = joined.groupBy("root").agg(F.min("least").alias("keep"))
    named = table(joined.join(keep, "root").select("fp", F.col("keep._row").alias("keep"), F.col("root").alias("group")), "groups")
    return all_rows, row, named


def _slice(raw: np.ndarray, k: int) -> np.ndarray:
    at, mask = k * SLICE_BITS, np.uint64((1 << SLICE_BITS) - 1)
    word, shift = divmod(at, 64)
    x = raw[:, word] >> np.uint64(shift)
    if shift + SLICE_BITS > 64:
        x = x | (raw[:, word + 1] << np.uint64(64 - shift))
    return x & mask


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Rows with a null doc_id cannot be told apart, so they stay; of rows that repeat a doc_id within a group one stays. Null
    and empty texts are one group; columns of any name stay as they are; an empty table stays empty.
    """
    rows, row, groups = near_duplicates(docs)
    keep, = unused(rows, "keep")
    one = rows.join(groups.select(F.col("keep").alias(keep)).distinct(), F.col(row) == F.col(keep), "left_semi")
    return one.unionByName(rows.filter("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
